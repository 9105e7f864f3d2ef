import numpy as np
import pytest
from pyspark.sql import functions as F

from marketlake.llm import negatives

SCHEMA = "vec_id long, embedding array<float>, label int, score string"


def plain(rows, positives=5, count=10, low=30, high=90):
    """All pairs in Python's whole numbers."""
    kept = [(k, n, label, [int(np.floor(256 * float(x))) for x in v]) for n, (k, v, label, _) in enumerate(rows) if k is not None and label is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for k, n, label, v in kept:
        if k % 100:
            continue
        scored = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), j, m, other) for j, m, other, w in kept if m != n and len(w) == len(v))
        for s, j, _, _ in [x for x in scored if x[3] == label][:positives]:
            fit = [x for x in scored if x[3] != label and low * -s <= -100 * x[0] <= high * -s][:count]
            out += [(k, j, r + 1, x[1], -s, -x[0]) for r, x in enumerate(fit)]
    return sorted(out)


def rows(number=900, width=8, seed=1, spread=0.35):
    draw = np.random.default_rng(seed)
    centres = draw.normal(size=(6, width))
    out = [(int(i), (centres[i % 6] + spread * draw.normal(size=width)).astype(np.float32).tolist(), int(draw.integers(0, 4)) if i % 3 else 0, "x") for i in range(number)]
    out += [(5000 + i, out[7][1], 1 + i % 2, "x") for i in range(40)]  # copies under two labels
    out += [(6000, out[100][1], out[100][2], "x"), (100, out[100][1], out[100][2], "x"), (7000, [0.0] * width, 2, "x"), (7100, [-0.5] * width, 3, "x")]
    out += [(8000, None, 1, "x"), (8100, [float("nan")] * width, 1, "x"), (8200, [float("inf")] + [0.0] * (width - 1), 1, "x"), (8300, out[3][1], None, "x"), (None, out[3][1], 1, "x"), (8400, [None] * width, 1, "x")]
    return [*out, (9000, [1.0, 2.0], 1, "x"), (9001, [2.0, 1.0], 1, "x"), (9002, [1.0, 1.5], 2, "x"), (9100, [], 1, "x"), (9101, [], 1, "x"), (9102, [], 2, "x")]


@pytest.mark.parametrize("small", [False, True])
def test_against_all_pairs(spark, monkeypatch, small):
    if small:
        monkeypatch.setattr(negatives, "ROWS", 600)
        monkeypatch.setattr(negatives, "ANCHORS", 3)
    found = negatives.mine(spark.createDataFrame(rows(), SCHEMA).repartition(3), F.col("id") % 100 == 0).collect()
    assert sorted(tuple(r) for r in found) == plain(rows())


def test_huge_vectors_are_scored_in_whole_numbers(spark):
    draw = np.random.default_rng(5)
    data = [(i, (draw.normal(size=6) * 8e5).astype(np.float32).tolist(), i % 3, "x") for i in range(120)]
    found = negatives.mine(spark.createDataFrame(data, SCHEMA), F.col("id") % 100 == 0).collect()
    assert sorted(tuple(r) for r in found) == plain(data) and len(found) > 20
    over = negatives.mine(spark.createDataFrame([(0, [1e12, 0.0], 1, "x"), (1, [1.0, 0.0], 1, "x"), (2, [0.5, 0.0], 2, "x")], SCHEMA), F.col("id") % 100 == 0)
    assert not over.collect()


def test_bounds_hold_and_rule_out_tiles():
    draw = np.random.default_rng(3)
    directions = draw.normal(size=(8, 12))
    directions /= np.linalg.norm(directions, axis=1)[:, None]
    ruled = 0
    for _ in range(200):
        centre = draw.normal(size=12) * 300
        tile, anchors = np.floor(centre + draw.normal(size=(40, 12)) * 20), np.floor(draw.normal(size=(30, 12)) * 256)
        tile[0] = centre * 0 if draw.random() < 0.2 else tile[0]
        norm, angle = negatives.angles(anchors, directions)
        norms, theirs = negatives.angles(tile, directions)
        lower, upper = negatives.score_bounds(norm, angle, (norms.min(), norms.max()), (theirs.min(axis=0), theirs.max(axis=0)))
        exact = anchors @ tile.T
        assert (lower <= exact.min(axis=1)).all() and (exact.max(axis=1) <= upper).all()
        ruled += (upper < 0.8 * norm * norms.max()).sum()
    assert ruled > 1000


def test_empty_tables(spark):
    assert not negatives.mine(spark.createDataFrame([], SCHEMA), F.col("id") % 100 == 0).collect()
    assert not negatives.mine(spark.createDataFrame([(0, [1.0], 1, "x")], SCHEMA), F.col("id") % 100 == 0).collect()
