import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from marketlake.llm import resample

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
DOCS = [
    (1, "Über die Brücke, die Brücke! über 12 a-b"),
    (2, None),
    (3, ""),
    (4, "the QUICK brown fox jumps over the lazy dog " * 5),
    (5, "x" * 70_000 + " tail " + "the fox " * 30),
    (5, "x" * 70_000 + " tail " + "the fox " * 30),
    (6, " ".join(f"w{i}" for i in range(5000))),
    (None, "dog fox " * 12),
    (7, "東京 タワー ŽLUŤOUČKÝ kůň"),
    (8, "\x00bell\x7f\u0080 ok"),
]
TARGET = [(1, "The quick fox over the bridge"), (2, None), (3, "dog dog cat")]


def plain(docs, target, buckets, longest, least_words, percent):
    """Word by word with zlib; numbers in the order of the contract."""
    words = lambda t: WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    runs = lambda t: [" ".join(w[i : i + n]) for w in [words(t)] for n in range(1, longest + 1) for i in range(len(w) - n + 1)]
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = (Counter(bucket(f) for _, x in rows for f in runs(x)) for rows in (docs, target))
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets)))) for b in range(buckets)]
    out = []
    for key, text in docs:
        f = runs(text)
        weight = sum(gain[bucket(x)] for x in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"2024:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
        out.append([key, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words(text)) >= least_words])
    fit = sorted((r for r in out if r[4]), key=lambda r: (-r[3], r[0] is not None, r[0] or 0))
    rank = {id(r): i + 1 for i, r in enumerate(fit) if i < len(fit) * percent // 100}
    return sorted(((*r[:4], rank.get(id(r))) for r in out), key=str)


@pytest.mark.parametrize(("buckets", "longest", "percent"), [(10_000, 1, 50), (97, 3, 100), (7, 2, 10)])
def test_against_plain_hashing(spark, buckets, longest, percent):
    docs = spark.createDataFrame([(*d, "x") for d in DOCS], "doc_id long, text string, score string").repartition(3)
    rows = resample.resample(docs, spark.createDataFrame(TARGET, "id long, text string"), buckets=buckets, longest=longest, percent=percent).collect()
    assert sorted((tuple(r) for r in rows), key=str) == plain(DOCS, TARGET, buckets, longest, resample.LEAST_WORDS, percent)


def test_automaton_emits_what_zlib_computes(monkeypatch):
    """Whatever part of the words is in the dictionary when they are met."""
    draw = np.random.default_rng(2)
    texts = [" ".join(f"w{int(x)}" for x in draw.zipf(1.3, 200) % 3000) for _ in range(40)]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])
    for most, waiting in ((1 << 16, 16), (50, 1), (0, 1)):
        monkeypatch.setattr(resample, "WAITING", waiting)
        dictionary = resample.Dictionary(most)
        for _ in range(2):
            for _, doc, bucket, n in resample.features(batch, dictionary, 1 << 31, 2):
                expect = Counter((d, zlib.crc32(" ".join(w[i : i + k]).encode()) % (1 << 31)) for d, w in enumerate(map(str.split, texts)) for k in (1, 2) for i in range(len(w) - k + 1))
                assert Counter(zip(doc.tolist(), bucket.tolist(), strict=True)) == expect and n == len(texts)
        assert len(dictionary.known) <= most and (dictionary.automaton is None) == (most == 0)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert not resample.resample(none, none).collect()
    rows = resample.resample(spark.createDataFrame(DOCS, "doc_id long, text string"), none).collect()
    assert sorted((tuple(r) for r in rows), key=str) == plain(DOCS, [], 10_000, 1, 20, 10)


def test_ranks_follow_a_total_order(spark):
    rows = spark.range(5000).selectExpr("id", "pmod(xxhash64(id), 50) as score").repartition(7)
    got = [(r["score"], r["id"]) for r in resample.ranked(rows, [rows.score.desc(), rows.id.asc()]).orderBy("rank").collect()]
    assert got == sorted(got, key=lambda r: (-r[0], r[1])) and len(got) == 5000
