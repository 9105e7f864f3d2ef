import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from marketlake.llm import repeats

WORDS = ["alpha", "beta", "gamma", "über", "東京", "delta", "eps"]


def brute(docs, length=repeats.LENGTH):
    """All windows of all texts, in order of key and row, against a set of those before them."""
    seen, out = set(), []
    for key, text in sorted(docs, key=lambda d: (d[0] is not None, d[0] or 0)):
        data = (text or "").encode()
        gone = np.zeros(len(data) + 1, bool)
        for s in range(len(data) - length + 1):
            if data[s : s + length] in seen:
                gone[s : s + length] = True
            seen.add(data[s : s + length])
        kept = bytes(x for x, g in zip(data, gone, strict=False) if not g)
        out.append((key, len(data), int(gone.sum()), int((np.diff(np.r_[False, gone].astype(int)) > 0).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def texts(number=120, seed=3):
    draw = random.Random(seed)
    prose = lambda n: " ".join(draw.choice(WORDS) + str(draw.randrange(300)) for _ in range(n))
    common, docs = prose(30), []
    for i in range(number):
        text = prose(draw.randrange(0, 60))
        if i % 3 == 0:
            text += common[draw.randrange(0, 30) : len(common) - draw.randrange(0, 40)] + prose(draw.randrange(0, 20))
        if i % 7 == 0:
            text += "a" * draw.randrange(90, 400) + prose(3)
        if i % 11 == 0 and docs:
            text = draw.choice(docs)[1]
        if i % 13 == 0:
            text += text
        docs.append((i, text))
    return [*docs, (500, None), (501, ""), (3, docs[3][1]), (503, docs[3][1] + "x"), (None, docs[5][1])]


@pytest.mark.parametrize("hot", [False, True])
def test_against_all_windows(spark, monkeypatch, hot):
    """Also where every anchor counts as hot, so that whole windows are exchanged."""
    if hot:
        monkeypatch.setattr(repeats, "HOT", 1)
        monkeypatch.setattr(repeats, "SAMPLE", 1)
    docs = texts()
    rows = repeats.report(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)).collect()
    found = sorted(((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in rows), key=str)
    assert found == brute(docs) and sum(x[2] for x in found) > 10_000


def test_pieces_of_long_texts_name_the_same_anchors(monkeypatch):
    """A text cut into pieces gives the contexts that it gives whole."""
    docs = [text or "" for _, text in texts(30)]
    batch = pa.RecordBatch.from_arrays([pa.array(docs), pa.array(range(len(docs))), pa.array(range(len(docs)))], names=["text", "row", "id"])
    seen = []
    for piece in (1 << 20, 150, 1000):
        monkeypatch.setattr(repeats, "PIECE", piece)
        out = pa.Table.from_batches(list(repeats._exchanged(iter([batch]), 100, 50, np.zeros(0, np.uint64)))).to_pylist()
        seen.append({(r["key"], r["cls"], r["row"], r["lo"], r["hi"]) for r in out if not r["known"]})
    assert seen[0] == seen[1] == seen[2]


def test_shared_prefixes_against_comparing_neighbours():
    draw = np.random.default_rng(1)
    for _ in range(100):
        base, parts = draw.integers(1, 4, 40), []
        for _ in range(draw.integers(1, 6)):
            a = draw.integers(0, 30)
            parts += [draw.integers(1, 4, draw.integers(0, 30)), base[a : a + draw.integers(0, 20)], [0]]
        codes = np.concatenate(parts).astype(np.int64)
        order = repeats.suffix_array(codes)
        ends = codes == 0
        rank = np.where(ends, np.cumsum(ends), codes + ends.sum())
        assert order.tolist() == sorted(range(len(codes)), key=lambda i: rank[i:].tolist())
        for length in (1, 3, 5):
            pair = lambda a, b: a + length <= len(codes) and b + length <= len(codes) and codes[a : a + length].all() and (codes[a : a + length] == codes[b : b + length]).all()  # noqa: E731, B023
            assert repeats.shared_prefixes(codes, order, length).tolist() == [False, *(pair(a, b) for a, b in zip(order, order[1:], strict=False))]


def test_empty_tables_other_lengths_and_string_keys(spark):
    assert not repeats.report(spark.createDataFrame([], "doc_id long, text string")).collect()
    docs = [("b", "0123456789abcdefghij"), ("a", "xx0123456789abcdefghijyy"), ("c", "0123456789")]
    rows = {r["doc_id"]: r for r in repeats.repeats(spark.createDataFrame([(*d, "other") for d in docs], "doc_id string, text string, row string"), length=12).collect()}
    assert [(s["lo"], s["hi"]) for s in rows["b"]["spans"]] == [(0, 20)] and bytes(rows["b"]["kept"]) == b""
    assert not rows["a"]["spans"] and not rows["c"]["spans"]
