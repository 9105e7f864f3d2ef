r"""Quality classifier with supervised subword embeddings.

A document is the average of learned vectors of its words, of its word pairs
and of its character n-grams, each hashed into one table; a softmax layer on
that average gives the class.  A word pair of one word twice counts as the
feature "again", so that repetition can be learned whatever is repeated.
Case is kept; white space counts as one blank in n-grams.  Table and layer are
trained together by stochastic gradient descent in numpy.

Only the text is ever an input.  Training takes at most `train_rows` labelled
documents (those with the smallest hash of their id), whole texts, featurised
on the executors; scoring covers every whole text.  As the layer is linear, the
table is folded to one number per bucket before it is sent to the tasks.

Null and empty texts score as the bias alone.  Of several rows of one
labelled id the one with the smallest text is learned.  Rows are scored each by itself,
so repeats and ties score alike.  Of several labels of one id the smallest
counts; without labels of both classes every score is the share of class 1
(0.5 without any).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from marketlake.llm.shared import crc_remainder
from marketlake.llm.words import SPACE_WORDS, flat, join_hashes, mix, slices, words

BUCKET_BITS = 17
DIM = 8
NGRAMS = (3, 4, 5)
TRAIN_ROWS = 2000
EPOCHS = 6
RATE = 0.5
THRESHOLD = 0.3
FOLDS = 5

_BLANK = np.where(SPACE_WORDS, np.arange(256), 32).astype(np.uint8)


def features(column: pa.Array, bits: int = BUCKET_BITS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each kind of feature: the bucket of each occurrence, and where each text's begin."""
    data, at = flat(column)
    shift = np.uint64(64 - bits)
    w = words(data, at, lower=False)
    yield (w.hash >> shift).astype(np.int64), w.first
    if len(w.hash) > 1:
        pair = join_hashes(w.hash, 2)
        pair[w.hash[1:] == w.hash[:-1]] = np.uint64(0x0123456789ABCDEF)
        inside = w.doc[1:] == w.doc[:-1]
        yield (pair[inside] >> shift).astype(np.int64), _starts(np.maximum(w.count - 1, 0))
    text = _BLANK[data].astype(np.uint64)
    size = np.diff(at)
    for n in NGRAMS:
        if len(text) < n:
            continue
        packed = np.full(len(text) - n + 1, n, np.uint64)
        for i in range(n):
            packed = (packed << np.uint64(8)) | text[i : len(text) - n + 1 + i]
        inside = np.ones(len(packed), dtype=bool)
        for i in range(1, n):  # those that run over the end of a text
            ends = at[1:] - i
            inside[ends[(ends >= 0) & (ends < len(packed))]] = False
        short = np.flatnonzero((size > 0) & (size < n))
        for d in short:
            inside[at[d] : min(at[d + 1], len(packed))] = False
        yield (mix(packed)[inside] >> shift).astype(np.int64), _starts(np.maximum(size - n + 1, 0))


def _starts(counts: np.ndarray) -> np.ndarray:
    return np.r_[0, np.cumsum(counts)]


@dataclass
class Model:
    """Score of each bucket and the bias, on the scale of the logit of class 1."""

    weight: np.ndarray
    bias: float

    def scores(self, column: pa.Array) -> np.ndarray:
        total, number = np.zeros(len(column)), np.zeros(len(column))
        for bucket, first in features(column, int(np.log2(len(self.weight)))):
            some = np.flatnonzero(np.diff(first) > 0)
            if len(some):
                total[some] += np.add.reduceat(self.weight[bucket], first[some])
            number += np.diff(first)
        return 1 / (1 + np.exp(-np.clip(total / np.maximum(number, 1) + self.bias, -700, 700)))


def train(rows: list[tuple[np.ndarray, np.ndarray, int]], bits: int = BUCKET_BITS, dim: int = DIM, epochs: int = EPOCHS, rate: float = RATE, seed: int = 7) -> Model:
    """Gradient descent over (buckets, counts, label) of one document at a time, with a falling rate."""
    share = float(np.mean([y for *_, y in rows])) if rows else 0.5
    if not 0 < share < 1:
        return Model(np.zeros(1 << bits, np.float64), float(np.log(max(share, 1e-6) / max(1 - share, 1e-6))))
    draw = np.random.default_rng(seed)
    table = draw.uniform(-1 / dim, 1 / dim, (1 << bits, dim))
    layer, bias = np.zeros((dim, 2)), np.log([1 - share, share])
    steps, done = epochs * len(rows), 0
    for _ in range(epochs):
        for k in draw.permutation(len(rows)):
            bucket, count, label = rows[k]
            lr, done = rate * (1 - done / steps), done + 1
            if not len(bucket):
                continue
            part = count / count.sum()
            doc = part @ table[bucket]
            z = doc @ layer + bias
            p = np.exp(z - z.max())
            error = p / p.sum()
            error[label] -= 1
            back = layer @ error
            layer -= lr * np.outer(doc, error)
            bias = bias - lr * 0.1 * error
            # Averages make each bucket's share tiny; the rate of the table is scaled to match.
            table[bucket] -= (lr * 50) * part[:, None] * back
    return Model((table @ (layer[:, 1] - layer[:, 0])), float(bias[1] - bias[0]))


def _featurised(batches: Iterator[pa.RecordBatch], text: str, bits: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for run in slices(batch, text):
            found: list[list[np.ndarray]] = [[] for _ in range(run.num_rows)]
            for bucket, first in features(run.column(text), bits):
                for d in range(run.num_rows):
                    found[d].append(bucket[first[d] : first[d + 1]])
            sparse = [np.unique(np.concatenate(x), return_counts=True) if x else (np.zeros(0, np.int64),) * 2 for x in found]
            yield pa.RecordBatch.from_arrays(
                [run.column("id"), run.column("label"), pa.array([b.astype(np.int32) for b, _ in sparse], pa.list_(pa.int32())), pa.array([c.astype(np.int32) for _, c in sparse], pa.list_(pa.int32()))],
                names=["id", "label", "bucket", "number"],
            )


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", folds: int = FOLDS, train_rows: int = TRAIN_ROWS, bits: int = BUCKET_BITS) -> Model:
    """A model from at most `train_rows` labelled rows outside the held-out fold."""
    known = labels.where(F.col(key).isNotNull() & F.col(label).isin(0, 1)).groupBy(F.col(key).alias("id")).agg(F.min(label).cast("int").alias("label"))
    chosen = known.withColumnRenamed("id", key).where(crc_remainder(key, folds) != 0).withColumnRenamed(key, "id").orderBy(F.xxhash64(F.col("id").cast("string")), "id").limit(train_rows)
    texts = docs.select(F.col(key).alias("id"), F.col(text).alias("text")).join(F.broadcast(chosen), "id")
    texts = texts.groupBy("id", "label").agg(F.min("text").alias("text"))  # one row for each id, so that the bound is one on rows
    kind = texts.schema["id"].dataType.simpleString()
    made = texts.mapInArrow(lambda b: _featurised(b, "text", bits), f"id {kind}, label int, bucket array<int>, number array<int>")

    def learn(rows: pa.Table) -> pa.Table:
        size = pc.list_value_length(rows["bucket"]).to_numpy()
        order = np.lexsort([size, rows["id"].to_numpy()]).tolist()
        sample = [(rows["bucket"][i].values.to_numpy().astype(np.int64), rows["number"][i].values.to_numpy().astype(float), rows["label"][i].as_py()) for i in order]
        model = train(sample, bits)
        return pa.table({"weight": pa.array([model.weight.astype(np.float64).tobytes()], pa.binary()), "bias": [model.bias]})

    # One task trains on the sample, which `train_rows` bounds; the driver gets the folded table only.
    got = made.groupBy().applyInArrow(learn, "weight binary, bias double").first()
    return Model(np.frombuffer(got["weight"], np.float64), got["bias"]) if got else train([], bits)


def scored(docs: DataFrame, model: Model, text: str = "text", score: str = "score") -> DataFrame:
    """All columns, and the score of every row's whole text."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    columns = [c for c in docs.columns if c != score]
    out = docs.select(*columns)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for run in slices(batch, text):
                yield pa.RecordBatch.from_arrays([*run.columns, pa.array(held.value.scores(run.column(text)))], names=[*columns, score])

    return out.mapInArrow(apply, StructType([*out.schema.fields, StructField(score, DoubleType())]))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return scored(docs, model).select("doc_id", F.coalesce(crc_remainder("doc_id", FOLDS) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
