import random

import numpy as np
import pyarrow as pa

from marketlake.llm.quality import THRESHOLD, features, fit, op2_quality_classifier, scored, train


def case(n=400):
    r = random.Random(3)
    docs, labels = [], []
    for d in range(n):
        w = ["".join(r.choice("abcdefgh") for _ in range(r.randrange(2, 8))) for _ in range(r.randrange(5, 60))]
        good = r.random() < 0.8
        kind = r.randrange(3)
        text = " ".join(w) if good else " ".join(x.upper() + "!!" for x in w) if kind == 0 else " ".join(x + "###" for x in w) if kind == 1 else " ".join([w[0]] * 60)
        docs.append((d, text))
        labels.append((d, int(good), 0))
    return docs, labels


def test_held_out_accuracy(spark, tmp_path):
    docs, labels = case()
    odd = [(900, None), (901, ""), (902, "x"), (903, "lorem ipsum " * 30_000), (903, "again")]
    spark.createDataFrame([(*x, 9.0) for x in docs + odd], "doc_id long, text string, score double").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([*labels, (901, None, 1), (1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = op2_quality_classifier(spark, str(tmp_path)).toPandas()
    assert len(got) == len(docs) + len(odd) and got.score.between(0, 1).all()
    assert (got.predicted == (got.score >= THRESHOLD)).all()
    want = dict((d, q) for d, q, _ in labels)
    out = got[got.held_out & got.doc_id.isin(want)]
    assert len(out) > 40 and (out.predicted == out.doc_id.map(want)).mean() > 0.95
    empty = got[got.doc_id.isin([900, 901])].score
    assert empty.nunique() == 1


def test_scores_do_not_depend_on_neighbours(spark):
    docs, labels = case(120)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    model = fit(df, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    texts = [t for _, t in docs] + ["", "ab"]
    assert np.allclose(model.scores(pa.array(texts)), [model.scores(pa.array([t]))[0] for t in texts], atol=1e-12)
    assert scored(df.withColumnRenamed("doc_id", "score"), model).columns == ["text", "score"]
    for bucket, first in features(pa.array(texts)):
        assert first[-1] == len(bucket) and len(first) == len(texts) + 1


def test_without_labels(spark):
    docs, _ = case(5)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {round(r.score, 6) for r in scored(df, fit(df, none)).collect()} == {0.5}
    assert scored(df.limit(0), fit(df.limit(0), none)).count() == 0


def test_training_equals_a_plain_one():
    """The same steps, number by number, on a small table."""
    r = random.Random(5)
    bits, dim, epochs, rate, seed = 4, 3, 2, 0.5, 7
    rows = [(np.array(sorted(r.sample(range(16), 3))), np.array([1.0, 2.0, 1.0]), int(r.random() < 0.6)) for _ in range(12)] + [(np.zeros(0, np.int64), np.zeros(0), 1)]
    got = train(rows, bits, dim=dim, epochs=epochs, rate=rate, seed=seed)
    draw = np.random.default_rng(seed)
    table = draw.uniform(-1 / dim, 1 / dim, (16, dim)).tolist()
    share = sum(y for *_, y in rows) / len(rows)
    layer, bias, done = [[0.0, 0.0] for _ in range(dim)], [float(np.log(1 - share)), float(np.log(share))], 0
    for _ in range(epochs):
        for k in draw.permutation(len(rows)):
            bucket, count, label = rows[k]
            lr, done = rate * (1 - done / (epochs * len(rows))), done + 1
            if not len(bucket):
                continue
            part = [c / sum(count) for c in count]
            doc = [sum(p * table[b][d] for p, b in zip(part, bucket)) for d in range(dim)]
            z = [sum(doc[d] * layer[d][c] for d in range(dim)) + bias[c] for c in (0, 1)]
            e = [float(np.exp(x - max(z))) for x in z]
            error = [x / sum(e) - (c == label) for c, x in enumerate(e)]
            back = [sum(layer[d][c] * error[c] for c in (0, 1)) for d in range(dim)]
            for d in range(dim):
                for c in (0, 1):
                    layer[d][c] -= lr * doc[d] * error[c]
                for p, b in zip(part, bucket):
                    table[b][d] -= lr * 50 * p * back[d]
            bias = [bias[c] - lr * 0.1 * error[c] for c in (0, 1)]
    want = [sum(table[b][d] * (layer[d][1] - layer[d][0]) for d in range(dim)) for b in range(16)]
    assert np.allclose(got.weight, want) and np.isclose(got.bias, bias[1] - bias[0])
