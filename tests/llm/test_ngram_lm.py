import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa

from pyspark.sql import functions as F

from marketlake.llm.ngram_lm import END, EliasFano, Shards, Trie, build, op8_ngram_lm_scores, quantise, scores, tokens_of, vocabulary_of


def tokens(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", low), "</end>"]


def case():
    r = random.Random(8)
    v = [f"w{int(r.paretovariate(0.6))}" for _ in range(400)]
    docs = [(0, None), (1, ""), (2, "Wort WORT wört"), (3, "x " * 30_000)]
    for d in range(4, 260):
        w = []
        while len(w) < r.randrange(1, 60):
            w += [r.choice(v)] if r.random() < 0.6 else ["the", "same", "few", "words"]
        docs.append((d, " ".join(w)))
    return docs + [(259, "the same few")]


def test_elias_fano():
    r = np.random.default_rng(1)
    for n, u in ((0, 1), (1, 1), (1, 2**63), (500, 700), (1000, 2**64 - 1), (1000, 50)):
        x = np.sort(r.integers(0, u, n, dtype=np.uint64, endpoint=True))
        ef = EliasFano.of(x)
        assert (ef.values() == x).all()
        if n:
            assert (x[ef.find(x)] == x).all()
            y = r.integers(0, u, 300, dtype=np.uint64, endpoint=True)
            assert ((ef.find(y) >= 0) == np.isin(y, x)).all()
    x = r.normal(size=5000) * 3
    assert (abs(quantise(x) / 2048 - x) <= 0.5 / 2048 + 1e-12).all()


def test_base_equals_brute_force_and_levels_help(spark, tmp_path):
    docs = case()
    folder = tmp_path / "t"
    spark.createDataFrame([(*x, 1.0) for x in docs], "doc_id long, text string, score double").repartition(3).write.parquet(f"{folder}/documents.parquet")
    got = {}
    for r in op8_ngram_lm_scores(spark, str(folder)).collect():
        got.setdefault(r.doc_id, []).append(r)
    out = {d: zlib.crc32(str(d).encode()) % 7 == 2 for d, _ in docs}
    counts = Counter(t for d, text in docs if not out[d] for t in tokens(text))
    n, v = sum(counts.values()), len(counts)
    assert sum(map(len, got.values())) == len(docs) and len(got[259]) == 2
    gain = 0
    for d, text in docs[:-2]:
        w, r = tokens(text), got[d][0]
        want = sum(math.log10((counts[t] + 1) / (n + 1 * (v + 1))) for t in w)
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (out[d], len(w), sum(counts[t] > 0 for t in w), n)
        assert math.isclose(r.base_score, want, rel_tol=1e-9)
        gain += (r.score - r.base_score) * out[d]
    assert gain > 100


def whole(docs):
    """The one-file trie of all texts."""
    grams = Counter()
    for _, text in docs:
        w = tokens(text)
        grams.update((w[i - 2] if i > 1 else None, w[i - 1], w[i]) for i in range(1, len(w)))
    one = Counter(t for _, text in docs for t in tokens(text))
    hash_of = {t: (END if t == "</end>" else tokens_of(pa.array([t]))[0][0]) for t in one}
    order = sorted(one, key=hash_of.get)
    number = {t: i for i, t in enumerate(order)} | {None: -1}
    seen = np.array([[*map(number.get, g), n] for g, n in grams.items()]).T
    return build(sum(one.values()), len(one), np.array([hash_of[t] for t in order], np.uint64), np.array([one[t] for t in order]), tuple(seen)), number


def test_rare_words_by_join_give_the_same(spark):
    docs = case()
    df = spark.createDataFrame(docs, "doc_id long, text string")
    every = F.lit(True)
    a, b = ({(r.doc_id, r.n_tokens): (r.n_known, round(r.base_score, 6)) for r in x.collect()} for x in (scores(df, every, level_bits=6), scores(df, every)))
    assert a == b


def test_probabilities_sum_to_one_and_mapping(tmp_path):
    docs = case()
    trie, number = whole(docs)
    trie.save(str(tmp_path / "m"))
    mapped = Trie.load(str(tmp_path / "m"))
    every = np.arange(len(number) - 1)
    assert (mapped.keys.values() == trie.keys.values()).all() and (mapped.keys.find(trie.keys.values()) == every).all()
    for context in ("the same", "same few", "w1 w1", "w2", "words the"):
        one, two = (number[x] for x in ([None] * 2 + context.split())[-2:])
        a, b = np.full(len(every), one), np.full(len(every), two)
        logs = mapped.log_probs(a, b, every)
        assert (logs == trie.log_probs(a, b, every)).all()
        unseen = int(mapped.log_probs(a[:1], b[:1], np.array([-1]))[0])
        total = (10.0 ** (logs / 2048)).sum() + 10.0 ** (unseen / 2048)
        assert abs(total - 1) < 0.003, (context, total)


def test_every_ngram_counts_whatever_the_shards(spark):
    docs = case() + [(500, "zig zag zog"), (501, None)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    train_on = [(d, t) for d, t in docs if d % 3]
    grams = [Counter(), Counter(), Counter()]
    for _, t in train_on:
        w = tokens(t)
        for k in range(3):
            grams[k].update(tuple(w[i : i + k + 1]) for i in range(len(w) - k))
    one, two, three = grams
    n, v = sum(one.values()), len(one)
    p1 = lambda w: (one[w,] + 1) / (n + v + 1)
    below = {k: {} for k in range(2)}
    for g in two:
        below[0].setdefault(g[:1], []).append(g[1])
    for g in three:
        below[1].setdefault(g[:2], []).append(g[2])
    follow = Counter()
    for g, c in two.items():
        follow[g[0]] += c

    def back(kept, less):
        return max(1 - kept, 1e-9) / max(1 - less, 1e-9)

    def p2(a, w):
        if (a, w) in two:
            return (two[a, w] - 0.75) / follow[a]
        seen = below[0].get((a,), [])
        return back(sum(p2(a, x) for x in seen), sum(p1(x) for x in seen)) * p1(w)

    def p3(a, b, w):
        if (a, b, w) in three:
            return (three[a, b, w] - 0.75) / two[a, b]
        seen = below[1].get((a, b), [])
        return back(sum(p3(a, b, x) for x in seen), sum(p2(b, x) for x in seen)) * p2(b, w)

    def score(t):
        w = tokens(t)
        return sum(math.log10(p1(x) if i == 0 else p2(w[0], x) if i == 1 else p3(w[i - 2], w[i - 1], x)) for i, x in enumerate(w))

    learn = F.expr("doc_id % 3 > 0")
    some, few = ({(r.doc_id, r.n_tokens): r for r in scores(df, learn, **o).collect()} for o in ({}, {"level_bits": 7, "shard_tokens": 100}))
    shards = Shards.plan(vocabulary_of(df.where(learn).select("text"), 7)[1], 100)
    assert shards.number > 20 and shards.usual > 1 and shards.parts.max() > 1
    assert some.keys() == few.keys() and len(some) == len(docs)
    for d, t in docs[:60] + docs[-3:]:
        r = some[d, len(tokens(t))]
        assert abs(r.score - score(t)) < 0.001 * r.n_tokens, d
        assert abs(r.score - few[d, r.n_tokens].score) < 1e-6 and math.isclose(r.base_score, few[d, r.n_tokens].base_score)
    # Words seen once in training, in this order only.
    assert some[500, 4].score > some[500, 4].base_score + 2


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert scores(df, F.lit(True)).count() == 0
    one = spark.createDataFrame([(1, "a b"), (None, None)], "doc_id long, text string")
    r, s = scores(one, F.lit(False)).orderBy("doc_id", ascending=False).collect()
    assert (r.n_tokens, r.n_known, r.base_score, r.score) == (3, 0, 0.0, 0.0)
    assert (s.doc_id, s.n_tokens, s.score) == (None, 1, 0.0)


def test_texts_by_name_and_ties(spark):
    """Ids may be strings and repeat; columns of clashing names are not read; equal texts score alike."""
    df = spark.createDataFrame([("a", "x y x", 1, 2), ("a", "x y x", 3, 4), ("b", "", 5, 6)], "doc_id string, text string, block int, key int")
    rows = scores(df, F.col("doc_id") == "a").orderBy("doc_id").collect()
    assert [r.doc_id for r in rows] == ["a", "a", "b"] and rows[0].score == rows[1].score and rows[2].n_tokens == 1
