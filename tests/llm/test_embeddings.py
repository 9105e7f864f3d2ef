import numpy as np

from marketlake.llm.embeddings import near_duplicates, plan, rotations


def brute(ids, vectors):
    ok = [v is not None and len(v) > 0 and all(c is not None and np.isfinite(c) for c in v) and any(c != 0 for c in v) for v in vectors]
    n, links, root = len(ids), [0] * len(ids), list(ids)
    unit = [np.array(v, float) / np.linalg.norm(np.array(v, float)) if o else None for v, o in zip(vectors, ok)]
    pairs = [(i, j) for i in range(n) for j in range(i) if ok[i] and ok[j] and len(vectors[i]) == len(vectors[j]) and unit[i] @ unit[j] >= 0.9]
    for i, j in pairs:
        links[i] += 1
        links[j] += 1
    for _ in range(n):
        for i, j in pairs:
            root[i] = root[j] = min(root[i], root[j])
    return {d: (links[i], root[i], root[i] == d) for i, d in enumerate(ids)}


def case():
    r = np.random.default_rng(5)
    base = r.normal(size=(60, 32)).astype(np.float32)
    rows = [base[r.integers(60)] + r.normal(size=32).astype(np.float32) * s for s in r.choice([0.05, 0.3, 0.6], 300)]
    hub = r.normal(size=32).astype(np.float32)
    rows += [hub + r.normal(size=32).astype(np.float32) * 0.05 for _ in range(60)] + [hub] * 20 + [hub * 3]
    vectors = [x.tolist() for x in rows]
    vectors += [None, [], [0.0] * 32, [float("nan")] + [1.0] * 31, [float("inf")] + [1.0] * 31, [None] + [1.0] * 31, [1.0, 0.0, 0.0], [2.0, 0.0, 0.0], [1e-30] * 32]
    return list(range(len(vectors))), vectors


def test_equals_brute_force(spark):
    ids, vectors = case()
    df = spark.createDataFrame([(i, v, 1) for i, v in zip(ids, vectors)], "vec_id long, embedding array<float>, rep int").repartition(3)
    want = brute(ids, vectors)
    # A bucket far smaller than the data, and blocks smaller than the hub, take every path.
    for options in ({}, {"bucket": 8, "block": 16, "recall": 0.9999}):
        got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in near_duplicates(df, **options).collect()}
        assert sum(x[0] for x in got.values()) >= 0.98 * sum(x[0] for x in want.values())
        assert all(got[i][0] <= want[i][0] for i in ids)
        if options:
            assert got == want
    assert near_duplicates(df.limit(0)).count() == 0


def test_estimates_are_unbiased_and_bounded():
    r = np.random.default_rng(2)
    x = r.normal(size=(2, 64))
    x[1] = x[0] + 0.5 * x[1]
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    turn = rotations(64, 400, seed=9)
    turned = np.einsum("nd,rde->nre", x, turn)
    code = np.sign(turned[0]) / 8
    factor = (code * turned[0]).sum(axis=1)
    estimate = (code * turned[1]).sum(axis=1) / factor
    bound = 3 * np.sqrt(1 - factor**2) / factor / np.sqrt(63)
    assert abs(estimate.mean() - x[0] @ x[1]) < 0.01 and (np.abs(estimate - x[0] @ x[1]) <= bound).mean() > 0.99
    assert plan(10**4, 64, 0.9, 0.98)[0] < plan(10**7, 64, 0.9, 0.98)[0]


def test_null_and_shared_ids(spark):
    near, far = [1.0, 0.0, 0.1], [0.0, 1.0, 0.0]
    rows = [(None, near), (3, near), (3, [1.0, 0.01, 0.1]), (None, far), (None, far), (7, None), (None, None)]
    got = sorted((r.vec_id or 0, r.n_links, r.component_id or 0, r.kept) for r in near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect())
    assert got == [(0, 0, 0, True), (0, 1, 0, True), (0, 1, 0, True), (0, 2, 3, False), (3, 2, 3, True), (3, 2, 3, True), (7, 0, 7, True)]
