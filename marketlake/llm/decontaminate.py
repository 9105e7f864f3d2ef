r"""Benchmark decontamination with training suffix arrays.

Documents are words `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` after lower-casing A-Z.
Each Arrow batch of documents is a shard.  For a shard a sparse word suffix
array is sorted: of all suffixes it holds those that begin as some test suffix
does (tested on two words, through a bitmap, so none is lost).  Every suffix of
every benchmark item that is at least a window long is then binary-searched in
it, word by word, which narrows a range of the array; the range left after the
last word of the window holds every verbatim occurrence.  Occurrences on one
diagonal join to the longest verbatim match with its location.

Equal windows of several items are searched once; which items they belong to is
looked up once for each document and window.

Shards are independent: documents are never shuffled, so a passage that a
third of the corpus holds costs no more than any other.  The benchmark is a
query set: it goes to the tasks in blocks of `block_mb`, each a pass of its own;
with more than one, rows are numbered first, and what the passes find is joined
by row.  Items with a null id count as one item named `<null>`; items with a null
text have no words.

Null and empty texts have no words and are clean; repeated rows are each
judged; other columns, of whatever name, are carried on by `decontaminate`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketlake.llm.shared import held
from marketlake.llm.words import LETTER_WORDS, flat, join_hashes, slices, words

WINDOW = 10
BLOCK_MB = 16
NO_ID = "<null>"
_BITS = 20
#: Occurrences that are joined along their diagonals at a time, about.
_TOGETHER = 1 << 16


class Queries:
    """Test suffixes of a block of the benchmark, by length of window."""

    def __init__(self, items: list[tuple[str, str]], window: int = WINDOW) -> None:
        self.names = [name for name, _ in items]
        w = words(*flat(pa.array([text for _, text in items], pa.large_string())), LETTER_WORDS)
        #: By length: the distinct windows, where the uses of each begin, and item and offset of each use.
        self.by_length: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = {}
        size = w.count
        for length in np.unique(np.minimum(size[size > 0], window), return_counts=True)[0].tolist():
            mine = np.flatnonzero(size >= window) if length == window else np.flatnonzero(size == length)
            number = size[mine] - length + 1
            item = np.repeat(mine, number)
            offset = np.arange(len(item)) - np.repeat(np.cumsum(number) - number, number)
            test = w.hash[(w.first[item] + offset)[:, None] + np.arange(length)]
            _, one, of = np.unique(join_hashes(test.ravel(), length)[::length], return_index=True, return_inverse=True)
            rank = np.argsort(of, kind="stable")
            self.by_length[length] = test[one], np.searchsorted(of[rank], np.arange(len(one) + 1)), item[rank], offset[rank]
        self.depth = max(self.by_length, default=0)
        self.one = np.zeros(1 << _BITS, dtype=bool)
        self.two = np.zeros(1 << _BITS, dtype=bool)
        for length, (test, _, _, _) in self.by_length.items():
            if length == 1:
                self.one[test[:, 0] >> np.uint64(64 - _BITS)] = True
            else:
                pair = join_hashes(test[:, :2].ravel(), 2)[::2]
                self.two[pair >> np.uint64(64 - _BITS)] = True

    def suffixes(self, h: np.ndarray) -> np.ndarray:
        """Positions of the shard in the order of the words that follow them."""
        begins = self.one[h >> np.uint64(64 - _BITS)]
        begins[:-1] |= self.two[join_hashes(h, 2) >> np.uint64(64 - _BITS)]
        at = np.flatnonzero(begins)
        padded = np.concatenate([h, np.zeros(self.depth, np.uint64)])
        return at[np.lexsort([padded[at + d] for d in reversed(range(self.depth))])]

    def uses(self, length: int, which: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each use of each of some windows: which of them it is, its item, and its offset there."""
        _, first, item, offset = self.by_length[length]
        number = first[which + 1] - first[which]
        of = np.repeat(np.arange(len(which)), number)
        at = first[which][of] + np.arange(len(of)) - np.repeat(np.cumsum(number) - number, number)
        return of, item[at], offset[at]

    def occurrences(self, h: np.ndarray, doc: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each length: windows and their positions in the shard, of all verbatim occurrences."""
        if not self.depth or not len(h):
            return
        order = self.suffixes(h)
        padded = np.concatenate([h, np.zeros(self.depth, np.uint64)])
        for length, (test, _, _, _) in self.by_length.items():
            low, high, live = np.zeros(len(test), np.int64), np.full(len(test), len(order)), np.arange(len(test))
            for d in range(length):
                word = padded[order + d]
                lo = _bound(word, test[live, d], low[live], high[live], False)
                high[live] = _bound(word, test[live, d], lo, high[live], True)
                low[live] = lo
                live = live[low[live] < high[live]]
            number = np.zeros(len(test), np.int64)
            number[live] = high[live] - low[live]
            which = np.repeat(np.arange(len(test)), number)
            at = order[np.repeat(low, number) + np.arange(len(which)) - np.repeat(np.cumsum(number) - number, number)]
            same = at + length <= len(h)
            at, which = at[same], which[same]
            same = doc[at] == doc[at + length - 1]
            yield length, which[same], at[same]


def _bound(word: np.ndarray, key: np.ndarray, low: np.ndarray, high: np.ndarray, right: bool) -> np.ndarray:
    """Binary search of each key in its own range of `word`."""
    low, high = low.copy(), high.copy()
    while len(open_ := np.flatnonzero(low < high)):
        mid = (low[open_] + high[open_]) >> 1
        up = word[mid] <= key[open_] if right else word[mid] < key[open_]
        low[open_[up]] = mid[up] + 1
        high[open_[~up]] = mid[~up]
    return low


def _shard(batch: pa.RecordBatch, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes, text number of each, and number of words of each text."""
    hashes, docs, counts, base = [], [], [], 0
    for part in slices(batch, text):
        w = words(*flat(part.column(text)), LETTER_WORDS)
        hashes.append(w.hash)
        docs.append(w.doc + base)
        counts.append(w.count)
        base += part.num_rows
    return np.concatenate(hashes), np.concatenate(docs), np.concatenate(counts)


def _whole_docs(at: np.ndarray, doc: np.ndarray, size: int) -> Iterator[np.ndarray]:
    """Occurrences in runs of about `size` that never cut a document."""
    order = np.argsort(at, kind="stable")
    last = np.flatnonzero(np.r_[doc[at[order]][1:] != doc[at[order]][:-1], True][: len(order)]) + 1
    begin = 0
    while begin < len(order):
        stop = int(last[min(np.searchsorted(last, begin + size), len(last) - 1)])
        yield order[begin:stop]
        begin = stop


def _search(batches: Iterator[pa.RecordBatch], queries: Queries, key: str, text: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        h, doc, count = _shard(batch, text)
        first = np.cumsum(count) - count
        edge, longest = np.zeros(len(h) + 1, np.int64), np.zeros(batch.num_rows, np.int64)
        found = []
        for length, which, at in queries.occurrences(h, doc):
            np.add.at(edge, at, 1)
            np.add.at(edge, at + length, -1)
            pairs = np.unique(doc[at] * np.int64(len(queries.by_length[length][0])) + which, return_counts=True)[0]
            of, item, _ = queries.uses(length, pairs % len(queries.by_length[length][0]))
            found.append(((pairs // len(queries.by_length[length][0]))[of], item))
            for part in _whole_docs(at, doc, _TOGETHER):
                of, i, o = queries.uses(length, which[part])
                p = at[part][of]
                order = np.lexsort([o, p - o, i])
                i, o, p = i[order], o[order], p[order]
                run = np.flatnonzero(np.r_[True, (np.diff(i) != 0) | (np.diff(p - o) != 0) | (np.diff(o) != 1) | (np.diff(doc[p]) != 0)][: len(p)])
                np.maximum.at(longest, doc[p[run]], np.diff(np.r_[run, len(p)]) + length - 1)
        hit = np.cumsum(edge[:-1]) > 0
        ends = np.flatnonzero(np.diff(np.r_[False, hit, False].astype(np.int8)))
        spans: list[list[dict[str, int]]] = [[] for _ in range(batch.num_rows)]
        for a, b in ends.reshape(-1, 2).tolist():
            # Occurrences never cross a text; spans of neighbouring texts may touch.
            while a < b:
                d = int(doc[a])
                stop = min(b, int(first[d] + count[d]))
                spans[d].append({"first": a - int(first[d]), "end": stop - int(first[d])})
                a = stop
        names: list[set[str]] = [set() for _ in range(batch.num_rows)]
        if found:
            pairs = np.unique(np.stack([np.concatenate(x) for x in zip(*found, strict=True)]), axis=1)
            for d, i in pairs.T.tolist():
                names[d].add(queries.names[i])
        yield pa.RecordBatch.from_arrays(
            [batch.column(key), pa.array(count, pa.int64()), pa.array(spans, _SPANS), pa.array([sorted(x) for x in names], pa.list_(pa.string())), pa.array(longest, pa.int64())],
            names=[key, "n_words", "spans", "items", "longest_match"],
        )


_SPANS = pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))
_MATCHES = "n_words long, spans array<struct<first:long,end:long>>, items array<string>, longest_match long"


def blocks(benchmark: DataFrame, item: str, text: str, block_mb: float) -> Iterator[list[tuple[str, str]]]:
    """The query set in blocks that fit a task, by measured size."""
    size = benchmark.select(F.sum(F.octet_length(text)).alias("n")).first()["n"] or 0
    number = int(size / (block_mb * 1e6)) + 1
    rows = benchmark.select(F.coalesce(F.col(item).cast("string"), F.lit(NO_ID)).alias("i"), F.col(text).alias("t")).where("t is not null")
    for k in range(number):
        part = rows if number == 1 else rows.where(F.pmod(F.xxhash64("i", "t"), F.lit(number)) == k)
        yield [(r["i"], r["t"]) for r in part.collect()]


def longest_matches(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", window: int = WINDOW, block_mb: float = BLOCK_MB) -> DataFrame:
    """A row for each document: n_words, merged word spans that a window of the benchmark covers, the items
    found, and the words of the longest verbatim match."""
    parts = list(blocks(benchmark, item, item_text, block_mb))
    if len(parts) == 1:
        return _pass(docs.select(key, text), parts[0], key, text, window)
    rows = held(docs.select(F.col(key).alias("key"), F.col(text).alias("text"), F.monotonically_increasing_id().alias("row")))
    found = _merged([_pass(rows.select("row", "text"), part, "row", "text", window) for part in parts])
    return rows.select("row", F.col("key").alias(key)).join(found, "row").drop("row")


def _pass(docs: DataFrame, block: list[tuple[str, str]], key: str, text: str, window: int) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(Queries(block, window))
    kind = docs.schema[key].dataType.simpleString()
    return docs.mapInArrow(lambda b: _search(b, shared.value, key, text), f"`{key}` {kind}, {_MATCHES}")


def _merged(passes: list[DataFrame]) -> DataFrame:
    """What several passes found, by the number of the row."""
    every = passes[0]
    for more in passes[1:]:
        every = every.unionByName(more)
    step = "case when size(m) > 0 and element_at(m, -1).end >= s.first then concat(slice(m, 1, size(m) - 1), array(named_struct('first', element_at(m, -1).first, 'end', greatest(element_at(m, -1).end, s.end)))) else concat(m, array(s)) end"
    one = every.groupBy("row").agg(
        F.max("n_words").alias("n_words"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("spans")))).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
        F.max("longest_match").alias("longest_match"),
    )
    return one.withColumn("spans", F.expr(f"aggregate(spans, cast(array() as array<struct<first:bigint,end:bigint>>), (m, s) -> {step})"))


def report(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """Counts for each document, from `longest_matches`."""
    key = options.get("key", "doc_id")
    found = longest_matches(docs, benchmark, **options)
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["first"])
    return found.select(
        key,
        "n_words",
        hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ",").cast("binary"), 256).alias("items_sha256"),
        (hit > 0).alias("contaminated"),
        "longest_match",
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", window: int = WINDOW, block_mb: float = BLOCK_MB) -> DataFrame:
    """The rows in which no window of the benchmark occurs, all columns kept; each is judged by its own text."""
    place = docs.columns.index(text)
    for i, block in enumerate(blocks(benchmark, item, item_text, block_mb)):
        # A pass holds one block in memory; what it keeps is stored before the next.
        docs = held(docs) if i else docs
        shared = docs.sparkSession.sparkContext.broadcast(Queries(block, window))

        def keep(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                one = pa.RecordBatch.from_arrays([batch.column(place)], names=["text"])
                for found in _search(iter([one]), shared.value, "text", "text"):
                    yield batch.filter(pc.equal(pc.list_value_length(found.column("spans")), 0))

        docs = docs.mapInArrow(keep, docs.schema)
    return docs


def op10_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = spark.read.parquet
    return report(read(f"{sf_dir}/documents.parquet").select("doc_id", "text"), read(f"{sf_dir}/benchmark.parquet").select("item_id", "text"))
