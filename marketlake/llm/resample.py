r"""Target-distribution importance resampling with an Aho-Corasick dictionary of hashed words.

Features are runs of one to `longest` consecutive words, joined by one space; the
bucket of a feature is the crc32 of its bytes modulo `buckets`.  Words are
`[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` after lower-casing A-Z.

Each task keeps a dictionary of the distinct words that it has met.  A word stands
in an Aho-Corasick automaton between two delimiters, so that it matches as a whole
word only, and carries its crc32 and its length.  Bytes that belong to no word
become the delimiter, and one scan of the automaton over a run of texts emits the
payloads of its words in order.  The payloads of neighbours compose to that of the run:
crc(a + b) = shift(crc(a), length of b) xor crc(b), where the shift by 2^i bytes is a
table, so no feature is ever written out or read byte by byte.  Words which the
scan leaves are hashed once and join the dictionary, up to `DICTIONARY` words in a
task; beyond that they are hashed where they stand.  What is in the dictionary
changes the time and never the result.

A bucket's gain is floor(1000 * ln of its smoothed share among target features over
that among all features), a document's weight the floored mean of the gains of its
features.  Gumbel noise from the hash of the id turns the largest scores into a
sample without replacement in proportion to exp(weight / 1000).  Ranks come from a
range-partitioned sort and the sizes of its partitions, so no task holds all
rows.  Counts leave each task as one array of `buckets` sums; gains (8 bytes a bucket)
are the only thing broadcast.

Null and empty texts have no features, weight 0 and no rank; a null id is written
as the empty string and sorts before all others; repeated rows are each scored; an
empty target gives the gains of its smoothing alone; other columns, of whatever
name, are left alone.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketlake.llm.shared import held
from marketlake.llm.words import LETTER_WORDS, LOWER, flat, slices

BUCKETS, LONGEST, SEED = 10_000, 1, 2024
#: Documents of fewer words are never drawn; so many of a hundred of the others are.
LEAST_WORDS, PERCENT = 20, 10
#: Words that a task's automaton holds at most, and new ones that wait for its next building at least.
DICTIONARY, WAITING = 1 << 16, 1 << 11
_DELIMITER = 0x20
#: Of crc32, its bits reversed.
_POLYNOMIAL = 0xEDB88320
_NORMAL = np.where(LETTER_WORDS[LOWER], LOWER, _DELIMITER).astype(np.uint8)


def _shifts(number: int = 32) -> list[np.ndarray]:
    """For each i, how a crc32 changes when 2^i zero bytes follow: 4 x 256 words to be xored, by byte of the crc."""
    values = np.arange(256, dtype=np.uint32)[None, :] << (8 * np.arange(4, dtype=np.uint32)[:, None])
    for _ in range(8):
        values = np.where(values & 1, values >> 1 ^ np.uint32(_POLYNOMIAL), values >> 1)
    out = [values]
    while len(out) < number:
        out.append(_apply(out[-1], out[-1]))
    return out


def _apply(shift: np.ndarray, crc: np.ndarray) -> np.ndarray:
    return shift[0, crc & 255] ^ shift[1, crc >> 8 & 255] ^ shift[2, crc >> 16 & 255] ^ shift[3, crc >> 24]


_SHIFTS = _shifts()


def compose(first: np.ndarray, second: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The crc32 of strings on end, from that of each and the length of the second."""
    out = first.astype(np.uint32)
    for i in range(int(length.max(initial=0)).bit_length()):
        some = (length >> i & 1) == 1
        out[some] = _apply(_SHIFTS[i], out[some])
    return out ^ second


class Dictionary:
    """Words met so far, in an automaton that emits their number; crc and length by number."""

    def __init__(self, most: int = DICTIONARY) -> None:
        self.most = most
        self.known: dict[bytes, int] = {}
        self.crc, self.length = np.zeros(0, np.uint32), np.zeros(0, np.int64)
        self.waiting: dict[bytes, int] = {}
        self.automaton = None

    def payloads(self, data: np.ndarray, end: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """crc32 and length of each word of delimited data."""
        crc, length = np.zeros(len(end), np.uint32), end - start
        left = np.ones(len(end), bool)
        if self.automaton is not None:
            found = np.fromiter(chain.from_iterable(self.automaton.iter(data.tobytes().decode("latin-1"))), np.int64).reshape(-1, 2)
            word = np.searchsorted(end, found[:, 0])
            crc[word], length[word] = self.crc[found[:, 1]], self.length[found[:, 1]]
            left[word] = False
        if left.any():
            raw = data.tobytes()
            for i, a, b in zip(np.flatnonzero(left).tolist(), start[left].tolist(), end[left].tolist(), strict=True):
                word = raw[a:b]
                value = self.waiting.get(word)
                if value is None:
                    value = zlib.crc32(word)
                    if len(self.known) + len(self.waiting) < self.most:
                        self.waiting[word] = value
                crc[i] = value
            if len(self.waiting) >= max(WAITING, len(self.known)) or (self.waiting and len(self.known) + len(self.waiting) >= self.most):
                self._build()
        return crc, length

    def _build(self) -> None:
        if self.automaton is None:
            self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for word in self.waiting:
            number = self.known[word] = len(self.known)
            self.automaton.add_word(f" {word.decode('latin-1')} ", number)
        self.automaton.make_automaton()
        self.crc = np.r_[self.crc, np.fromiter(self.waiting.values(), np.uint32)]
        self.length = np.r_[self.length, np.fromiter(map(len, self.waiting), np.int64)]
        self.waiting = {}


def features(batch: pa.RecordBatch, dictionary: Dictionary, buckets: int, longest: int, text: str = "text") -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, int]]:
    """For runs of texts: words of each, text number and bucket of each feature, and the number of texts."""
    for part in slices(batch, text):
        raw, at = flat(part.column(text))
        n = len(at) - 1
        data = np.full(len(raw) + n + 1, _DELIMITER, np.uint8)
        data[np.arange(len(raw)) + np.repeat(np.arange(1, n + 1), np.diff(at))] = _NORMAL[raw]
        inside = data != _DELIMITER
        start, end = np.flatnonzero(inside[1:] & ~inside[:-1]) + 1, np.flatnonzero(inside[:-1] & ~inside[1:]) + 1
        doc = np.searchsorted(at[1:] + np.arange(1, n + 1), start, "right")
        crc, length = dictionary.payloads(data, end, start)
        docs, found, run = [doc], [crc % np.uint32(buckets)], crc
        space = np.full(len(crc), zlib.crc32(b" "), np.uint32)
        joined = compose(space, crc, length)
        for size in range(2, longest + 1):
            run = compose(run[:-1], joined[size - 1 :], length[size - 1 :] + 1)
            same = doc[: len(run)] == doc[size - 1 :]
            docs.append(doc[: len(run)][same])
            found.append((run % np.uint32(buckets))[same])
        yield np.bincount(doc, minlength=n), np.concatenate(docs), np.concatenate(found).astype(np.int64), n


def _counted(batches: Iterator[pa.RecordBatch], buckets: int, longest: int) -> Iterator[pa.RecordBatch]:
    """One sum for each bucket that the task has met."""
    dictionary, total = Dictionary(), np.zeros(buckets, np.int64)
    for batch in batches:
        for _, _, bucket, _ in features(batch, dictionary, buckets, longest):
            total += np.bincount(bucket, minlength=buckets)
    some = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["bucket", "n"])


def counts(docs: DataFrame, text: str = "text", buckets: int = BUCKETS, longest: int = LONGEST) -> DataFrame:
    """(bucket, n) of all features of all texts."""
    return docs.select(F.col(text).alias("text")).mapInArrow(lambda b: _counted(b, buckets, longest), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(source: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, gain) of every bucket, from the counts of all features and of the target's."""
    s, t = held(source), held(target)
    sums = s.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("all_s")).crossJoin(t.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("all_t")))  # one row
    each = source.sparkSession.range(buckets).withColumnRenamed("id", "bucket")
    each = each.join(s.withColumnRenamed("n", "s"), "bucket", "left").join(t.withColumnRenamed("n", "t"), "bucket", "left").crossJoin(F.broadcast(sums))
    d = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("double")
    ratio = (d("t") + 1) * (d("all_s") + buckets) / ((d("s") + 1) * (d("all_t") + buckets))
    return each.select("bucket", F.floor(1000 * F.log(ratio)).cast("long").alias("gain"))


def _weighed(batches: Iterator[pa.RecordBatch], gain: np.ndarray, longest: int) -> Iterator[pa.RecordBatch]:
    dictionary = Dictionary()
    for batch in batches:
        if not batch.num_rows:
            continue
        n_words, number, total = [], [], []
        for words, doc, bucket, n in features(batch, dictionary, len(gain), longest):
            n_words.append(words)
            number.append(np.bincount(doc, minlength=n))
            sums = np.zeros(n, np.int64)
            np.add.at(sums, doc, gain[bucket])
            total.append(sums)
        n_words, number, total = (np.concatenate(x).astype(np.int64) for x in (n_words, number, total))
        weight = np.where(number > 0, total // np.maximum(number, 1), 0)
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(n_words), pa.array(number), pa.array(weight)], names=["id", "n_words", "n_features", "weight"])


def ranked(rows: DataFrame, order: list, name: str = "rank") -> DataFrame:
    """The rows with their place, from 1, in the order of the columns: a range-partitioned sort, whose partitions'
    sizes (one number for each partition) say where each begins."""
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = held(rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id()))
    part, within = F.shiftright("__at", 33), F.col("__at").bitwiseAND((1 << 33) - 1)
    sizes = sorted((r["p"], r["n"]) for r in placed.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect())
    before, table = 0, []
    for p, n in sizes:
        table.append((p, before))
        before += n
    offsets = spark.createDataFrame(table, "__part long, __before long")
    return placed.withColumn("__part", part.cast("long")).join(F.broadcast(offsets), "__part").withColumn(name, F.col("__before") + within + 1).drop("__at", "__part", "__before")


def resample(docs: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", target_text: str = "text", buckets: int = BUCKETS, longest: int = LONGEST, least_words: int = LEAST_WORDS, percent: int = PERCENT, seed: int = SEED) -> DataFrame:
    """(key, n_features, weight, score, rank) of every document; undrawn ones have a null rank."""
    spark = docs.sparkSession
    rows = docs.select(F.col(key).alias("id"), F.col(text).alias("text"))
    table = np.zeros(buckets, np.int64)
    for r in gains(counts(rows, "text", buckets, longest), counts(target, target_text, buckets, longest), buckets).collect():  # `buckets` rows
        table[r["bucket"]] = r["gain"]
    shared = spark.sparkContext.broadcast(table)
    kind = docs.schema[key].dataType.simpleString()
    weighed = rows.mapInArrow(lambda b: _weighed(b, shared.value, longest), f"id {kind}, n_words long, n_features long, weight long")
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))).cast("binary"), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")
    scored = held(weighed.withColumn("score", F.col("weight") + noise))
    fit = scored.where(F.col("n_words") >= least_words)
    drawn = fit.count() * percent // 100
    placed = ranked(fit, [F.col("score").desc(), F.col("id").asc_nulls_first()])
    placed = placed.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    rest = scored.where(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long"))
    return placed.unionByName(rest).select(F.col("id").alias(key), "n_features", "weight", "score", "rank")


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


OP11_SQL = r"""
WITH polynomial AS (
    SELECT list(c ORDER BY i) AS t FROM (
        SELECT i, list_reduce(list_concat([i::UBIGINT], list_transform(range(8), lambda x: x::UBIGINT)), lambda c, x: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384::UBIGINT) ELSE c // 2 END) AS c
        FROM range(256) r(i))
), words AS (
    SELECT 0 AS side, doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM documents
    UNION ALL
    SELECT 1, item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) FROM benchmark
), bytes AS (
    SELECT w, list_transform(range(length(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::UBIGINT) AS b FROM (SELECT w, hex(encode(w)) AS h FROM (SELECT DISTINCT w FROM words))
), bucket AS (
    SELECT w, (xor(list_reduce(list_concat([4294967295::UBIGINT], b), lambda c, x: xor(c // 256, t[(xor(c, x) % 256)::BIGINT + 1])), 4294967295::UBIGINT) % 10000)::BIGINT AS k FROM bytes, polynomial
), counted AS (
    SELECT k, count(*) FILTER (side = 0) AS s, count(*) FILTER (side = 1) AS t FROM words JOIN bucket USING (w) GROUP BY k
), sums AS (
    SELECT sum(s)::DOUBLE AS ss, sum(t)::DOUBLE AS tt FROM counted
), gain AS (
    SELECT k, floor(1000 * ln((t + 1)::DOUBLE * (ss + 10000) / ((s + 1)::DOUBLE * (tt + 10000))))::BIGINT AS g FROM counted, sums
), per_doc AS (
    SELECT doc_id, count(*) AS n, floor(sum(g)::DOUBLE / count(*))::BIGINT AS weight FROM words JOIN bucket USING (w) JOIN gain USING (k) WHERE side = 0 GROUP BY doc_id
), scored AS (
    SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
        coalesce(weight, 0)::BIGINT + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || d.doc_id), 1, 8))::UBIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
    FROM documents d LEFT JOIN per_doc p ON d.doc_id = p.doc_id
), placed AS (
    SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r, count(*) OVER () AS fit FROM scored WHERE n_features >= 20
)
SELECT s.doc_id, s.n_features, s.weight, s.score, CASE WHEN r <= 10 * fit // 100 THEN r END AS rank
FROM scored s LEFT JOIN placed p ON s.doc_id = p.doc_id
"""
