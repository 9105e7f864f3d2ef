import random
import re

import numpy as np

from marketlake.llm.jaccard import deduplicate, jaccard_components, level
from marketlake.llm.shared import components


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if len(w) < 5:
        return {tuple(w)} if w else set()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def brute(docs):
    sets = [(d, shingles(t)) for d, t in docs]
    root = {d: d for d, _ in docs}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (a, s) in enumerate(sets):
        for b, t in sets[:i]:
            both = len(s & t)
            if s and t and 100 * both >= 80 * (len(s) + len(t) - both):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {d: (len(s), find(d)) for d, s in sets}


def case(seed):
    r = random.Random(seed)
    v = [f"{a}{b}" for a in "abcdefgh" for b in "xyzw"] + ["Ünï", "QQ"]
    line = " ".join(r.choice(v) for _ in range(30))
    docs = [(0, None), (1, ""), (2, " \n\t"), (3, "One two"), (4, "one TWO"), (5, "one two three")]
    for d in range(6, 160):
        k = r.random()
        if k < 0.3 or d < 12:
            t = " ".join(r.choice(v) for _ in range(r.choice([3, 6, 40, 80])))
        else:
            w = (docs[r.randrange(6, len(docs))][1] or "x").split(" ")
            for _ in range(r.choice([0, 0, 1, 1, 2, 3])):
                w[r.randrange(len(w))] = r.choice(v)
            t = " ".join(w)
        docs.append((d, t + (" " + line if r.random() < 0.3 else "")))
    base = [f"b{i}" for i in range(100)]
    for d in range(160, 230):
        w = list(base)
        for _ in range(r.randrange(5)):
            w[r.randrange(100)] = f"e{r.randrange(10**6)}"
        docs.append((d, " ".join(w)))
    docs.append((500, "long " * 40_000))
    docs.append((501, "long " * 60_000 + "end"))
    return docs


def test_equals_brute_force(spark):
    for seed, block in ((1, 2048), (2, 7)):
        docs = case(seed)
        df = spark.createDataFrame([(*x, 5) for x in docs], "doc_id long, text string, cls int").repartition(3)
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_components(df, block=block, bits=12).collect()}
        want = brute(docs)
        assert got == want
    kept = {r.doc_id for r in deduplicate(df).collect()}
    assert kept == {d for d, (_, c) in want.items() if c == d}


def test_odd_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert jaccard_components(empty).count() == 0
    again = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (0, "A b c d e f"), (None, "p q r s t u v w x y z"), (None, "p q r s t u v w x y z 1"), (None, None)], "doc_id long, text string")
    assert sorted((r.n_shingles, r.doc_id is None, r.component_id is None, r.component_id or 0) for r in jaccard_components(again).collect()) == [(0, True, True, 0), *[(2, False, False, 0)] * 3, (2, True, False, 0), (7, True, True, 0), (8, True, True, 0)]
    assert sorted((r.doc_id is None, str(r.doc_id), r.text or "") for r in deduplicate(again).collect()) == [(False, "0", "A b c d e f"), (True, "None", ""), (True, "None", "p q r s t u v w x y z")]


def test_chain_components(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (7, 7)], "a long, b long")
    got = {r.node: r.root for r in components(chain).collect()}
    assert got == {i: 0 for i in range(61)} | {100: 100, 101: 100}


def test_level_weighs_candidates_against_postings():
    assert level(np.array([1.0, 1, 1, 1000]), 2, 2) == 1
    assert level(np.array([1000.0, 1000, 1, 1]), 1, 3) == 3


def test_copies_leave_one_set_of_postings():
    """However many copies a task meets."""
    import numpy as np
    import pyarrow as pa

    from marketlake.llm.jaccard import BIN_BITS, PERCENT, WIDTH, _postings

    text = " ".join(f"w{i}" for i in range(60))
    steps = np.zeros(1 << BIN_BITS, np.uint8)
    of = lambda texts: sum(b.num_rows for b in _postings(iter([pa.RecordBatch.from_arrays([pa.array(t)], names=["text"]) for t in texts]), steps, "text", WIDTH, PERCENT, BIN_BITS))
    assert of([[text]]) == of([[text] * 500, [text] * 500]) > 0
    assert of([[text, text + " x"]]) > of([[text]])
