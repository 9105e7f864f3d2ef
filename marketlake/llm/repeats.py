r"""Removal of repeated byte strings by threshold-bounded interval expansion on a Burrows-Wheeler transform.

A byte goes if a string of `length` bytes that covers it also starts earlier, in
a smaller document or further left in the same one.

The transform is taken of strings that may be equal, and these are brought
together as follows.  Among the k-byte strings inside each window of `length`
bytes, the one of the smallest hash (the leftmost of equals) is the window's
anchor, so equal windows have equal anchors.  An anchor stands for its context:
all windows that hold it, at most 2 * `length` - k bytes.  Anchors are exchanged by
their hash, without any text.  Equal contexts need no search: all but the first
are repeats.  Where an anchor has several contexts, the bytes of the first of each
are fetched and searched:

  * their suffixes are sorted, and the Burrows-Wheeler transform is kept as a
    wavelet matrix;
  * from the interval of all suffixes, intervals are extended backwards, one
    byte each round, breadth first.  The round that first reaches the right end
    of an interval of l bytes has found that the suffixes on both sides share l-1
    bytes, so common prefixes come by increasing value;
  * the search stops after `length` rounds.  Neighbours whose common prefix is then
    unknown share `length` bytes or more.

Hot passages: an anchor with very many contexts (as where a boilerplate ends and
each document goes on differently) is found on a sample of 1 / `SAMPLE` of the
documents.  The windows of hot anchors are exchanged by the hash of the whole window
instead, so that no group holds rows of different windows, and equal ones are
merged in each task before the exchange.  This decides only where rows meet,
never what is found.  There are at most 2^20 hot anchors, 8 bytes each.

Texts are exchanged once, into a table bucketed by row; later joins move
only anchors and spans.  Hashes are 64 bits wide.  Texts of any length are worked
on in overlapping pieces of bounded size.

Null texts are empty; texts shorter than `length` hold no such string.  A null
key counts as smaller than all others; rows of equal keys follow each other in
the order in which they are read.  Other columns, of whatever name, are left alone.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketlake.llm.shared import folder, held
from marketlake.llm.words import _powers, flat, mix, slices

LENGTH = 100
#: One document in so many tells which anchors are hot: those found `HOT` times there or more.
SAMPLE, HOT, MOST_HOT = 64, 64, 1 << 20
BUCKET_MB, BUCKETS = 16, 50_000
#: Bytes of text that one numpy pass handles at a time.
PIECE = 1 << 20
#: Anchors that are compared with each other before the exchange.
TOGETHER = 1 << 19
_PLACE = np.uint64((1 << 24) - 1)
_UP, _DOWN = 0x9E3779B97F4A7C15 | 1, pow(0x9E3779B97F4A7C15 | 1, -1, 1 << 64)


def _pieces(at: np.ndarray, limit: int, length: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, int, int]]:
    """Runs of whole texts of about `limit` bytes, or pieces of a longer one with margins: first text, edges of the
    texts or piece in the data, where in its text each begins, and the window starts that are the piece's own."""
    i, n = 0, len(at) - 1
    while i < n:
        size = int(at[i + 1] - at[i])
        if size > limit:
            for a in range(0, size - length + 1, limit):
                b = min(a + limit, size - length + 1)
                begin, end = max(0, a - length), min(size, b - 1 + 2 * length)
                yield i, at[i] + np.array([begin, end]), np.array([begin]), a - begin, b - begin
            i += 1
        else:
            j = int(np.searchsorted(at, at[i] + limit, "right")) - 1
            yield i, at[i : j + 1], np.zeros(j - i, np.int64), 0, int(at[j] - at[i])
            i = j


class Hashes:
    """64-bit hashes of any byte ranges of some data."""

    def __init__(self, data: np.ndarray) -> None:
        n = len(data)
        self.down = _powers("down", _DOWN, n + 1)
        self.total = np.zeros(n + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _powers("up", _UP, n + 1)[:n], out=self.total[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.total[end] - self.total[start]) * self.down[start])

    def every(self, size: int) -> np.ndarray:
        return mix((self.total[size:] - self.total[:-size]) * self.down[: len(self.total) - size])


def anchors(data: np.ndarray, at: np.ndarray, own: tuple[int, int], length: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, Hashes]:
    """Window starts that lie in one text, the place of the anchor of each, the hash of the anchor at each place."""
    hashes = Hashes(data)
    h = hashes.every(k)
    least = (h & ~_PLACE) | np.arange(len(h), dtype=np.uint64)
    width, span = length - k + 1, 1
    while 2 * span <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < width:
        least = np.minimum(least[: len(least) - (width - span)], least[width - span :])
    inside = np.zeros(len(least), bool)
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        inside[a : max(a, b - length + 1)] = True
    inside[: own[0]] = False
    inside[own[1] :] = False
    start = np.flatnonzero(inside)
    return start, (least[start] & _PLACE).astype(np.int64), h, hashes


def _found(data: np.ndarray, at: np.ndarray, own: tuple[int, int], length: int, k: int, hot: np.ndarray) -> tuple[np.ndarray, ...]:
    """For each anchor or hot window: its range, the hash by which it is exchanged, and that of the whole range."""
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return none, none, none.astype(np.uint64), none.astype(np.uint64), none
    start, place, h, hashes = anchors(data, at, own, length, k)
    new = np.ones(len(place), bool)
    new[1:] = place[1:] != place[:-1]
    use = place[new]
    key = h[use]
    text = np.searchsorted(at, use, "right") - 1
    lo, hi = np.maximum(at[text], use - (length - k)), np.minimum(at[text + 1], use + length)
    cls = mix(hashes.of(lo, hi) + mix(key) + (use - lo).astype(np.uint64) * np.uint64(0x9FB21C651E98DF25) + (hi - lo).astype(np.uint64))
    if len(hot):
        many = hot[np.minimum(np.searchsorted(hot, key), len(hot) - 1)] == key
        if many.any():
            s = start[many[np.cumsum(new) - 1]]
            whole = mix(hashes.of(s, s + length) + np.uint64(length))
            lo, hi = np.r_[lo[~many], s], np.r_[hi[~many], s + length]
            key, cls = np.r_[key[~many], whole], np.r_[cls[~many], whole]
            order = np.argsort(lo, kind="stable")
            lo, hi, key, cls = lo[order], hi[order], key[order], cls[order]
            text = np.searchsorted(at, lo, "right") - 1
    return lo, hi, key, cls, text


def merged(group: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ranges of each group, joined where they touch or overlap; group numbers are small."""
    if not len(lo):
        return group, lo, hi
    far = np.int64(int(hi.max()) + 2)
    order = np.argsort(group * far + lo, kind="stable")
    g, a, b = group[order], (group * far + lo)[order], (group * far + hi)[order]
    reach = np.maximum.accumulate(b)
    first = np.flatnonzero(np.r_[True, a[1:] > reach[:-1]])
    return g[first], a[first] - g[first] * far, reach[np.r_[first[1:] - 1, len(a) - 1]] - g[first] * far


def _sorted(batch: pa.RecordBatch) -> pa.RecordBatch:
    return batch.take(pc.sort_indices(pa.Table.from_batches([batch]), [("id", "ascending"), ("row", "ascending")], null_placement="at_start"))


def _exchanged(batches: Iterator[pa.RecordBatch], length: int, k: int, hot: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The first of equal contexts of each batch, and the ranges of the others."""
    for batch in batches:
        if not batch.num_rows:
            continue
        batch = _sorted(batch)
        data, at = flat(batch.column("text"))
        kept: list[tuple[np.ndarray, ...]] = []
        number = 0

        def flush(batch: pa.RecordBatch = batch, kept: list = kept) -> Iterator[pa.RecordBatch]:
            lo, hi, key, cls, doc = (np.concatenate(x) for x in zip(*kept, strict=True))
            kept.clear()
            order = np.argsort(cls, kind="stable")
            later = np.zeros(len(order), bool)
            later[order[1:]] = cls[order[1:]] == cls[order[:-1]]
            d, a, b = merged(doc[later], lo[later], hi[later])
            row = batch.column("row").to_numpy()
            spread = mix(row[d].astype(np.uint64)).view(np.int64)
            first = ~later
            of = np.r_[doc[first], d]
            ids = batch.column("id").take(pa.array(of))
            cols = [np.r_[key[first].view(np.int64), spread], np.r_[cls[first].view(np.int64), spread], row[of], np.r_[lo[first], a].astype(np.int64), np.r_[hi[first], b].astype(np.int64)]
            yield pa.RecordBatch.from_arrays([*(pa.array(c) for c in cols), pa.array(np.r_[np.zeros(int(first.sum()), bool), np.ones(len(d), bool)]), ids], names=["key", "cls", "row", "lo", "hi", "known", "id"])

        for first, edge, begin, a, b in _pieces(at, PIECE, length):
            base = int(edge[0])
            lo, hi, key, cls, text = _found(data[base : edge[-1]], edge - base, (a, b), length, k, hot)
            shift = begin[text] - (edge - base)[text]
            kept.append((lo + shift, hi + shift, key, cls, text + first))
            number += len(lo)
            if number >= TOGETHER:
                yield from flush()
                number = 0
        if kept:
            yield from flush()


_EXCHANGED = "key long, cls long, row long, lo long, hi long, known boolean, id {id}"


def _sampled(batches: Iterator[pa.RecordBatch], length: int, k: int) -> Iterator[pa.RecordBatch]:
    """Anchors of a sample of documents with their counts in each batch."""
    for batch in batches:
        data, at = flat(batch.column("text"))
        for _, edge, _, a, b in _pieces(at, PIECE, length):
            base = int(edge[0])
            _, _, key, _, _ = _found(data[base : edge[-1]], edge - base, (a, b), length, k, np.zeros(0, np.uint64))
            one, n = np.unique(key, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(one.view(np.int64)), pa.array(n.astype(np.int64))], names=["key", "n"])


def runs(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Sorted rows again, in tables that never cut a run of equal keys."""
    rest: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        v = batch.column(key).to_numpy()
        last = int(np.searchsorted(v, v[-1]))
        if last or (rest and rest[-1].column(key)[-1].as_py() != v[0]):
            cut = last if last else 0
            rest.append(batch.slice(0, cut))
            yield pa.Table.from_batches(rest).combine_chunks()
            rest = [batch.slice(cut)]
        else:
            rest.append(batch)
    if rest:
        yield pa.Table.from_batches(rest).combine_chunks()


def _classed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows in the order of key, context and place: the ranges that are repeats, and the first of each context of
    the anchors that have several."""
    for rows in runs(batches, "key"):
        if not rows.num_rows:
            continue
        key, cls, known = (rows[c].to_numpy() for c in ("key", "cls", "known"))
        new_key, new_cls = np.ones(len(key), bool), np.ones(len(key), bool)
        new_key[1:] = key[1:] != key[:-1]
        new_cls[1:] = new_key[1:] | (cls[1:] != cls[:-1])
        # Ranges known to be repeats pass; their keys are those of their rows.
        anchor = np.cumsum(new_key) - 1
        lead = new_cls & ~known
        ask = lead & (np.bincount(anchor, lead)[anchor] > 1)
        gone = known | ~new_cls
        use = np.flatnonzero(ask | gone)
        part = rows.select(["key", "id", "row", "lo", "hi"]).take(pa.array(use)).append_column("ask", pa.array(ask[use]))
        yield from part.combine_chunks().to_batches()


def suffix_array(codes: np.ndarray) -> np.ndarray:
    """Suffixes in order; each 0 ends a string and is smaller than all codes and than the zeros after it.

    Ranks by four codes are doubled in reach, only in groups of suffixes that are still equal.
    """
    n = len(codes)
    end = codes == 0
    strings = int(end.sum())
    rank = codes.astype(np.int64) + strings
    rank[end] = np.arange(strings)
    base = int(rank.max()) + 1 if n else 1
    reach = 4 if base < 1 << 15 else 2
    padded = np.r_[rank, np.zeros(reach, np.int64)]
    key = np.zeros(n, np.int64)
    for i in range(reach):
        key = key * base + padded[i : i + n]
    order = np.argsort(key, kind="stable")
    place = np.arange(n)
    new = np.r_[True, key[order][1:] != key[order][:-1]]
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, place, 0))
    open_ = np.flatnonzero(~(new & np.r_[new[1:], True]))
    while len(open_):
        at = order[open_]
        second = np.where(at + reach < n, rank[np.minimum(at + reach, n - 1)] + 1, 0)
        key = rank[at] * (n + 1) + second
        by = np.argsort(key, kind="stable")
        at, key = at[by], key[by]
        order[open_] = at
        new = np.r_[True, key[1:] != key[:-1]]
        rank[at] = np.maximum.accumulate(np.where(new, open_, 0))
        open_ = open_[~(new & np.r_[new[1:], True])]
        reach *= 2
    return order


class Wavelet:
    """A sequence of small numbers that lists, for many ranges at once, the numbers in each and their counts."""

    def __init__(self, codes: np.ndarray) -> None:
        self.levels = max(1, int(codes.max()).bit_length())
        self.ones, self.zeros = [], []
        for level in reversed(range(self.levels)):
            bit = (codes >> level) & 1
            self.ones.append(np.r_[0, np.cumsum(bit)].astype(np.int32))
            self.zeros.append(int(len(codes) - bit.sum()))
            codes = np.concatenate([codes[bit == 0], codes[bit == 1]])
        new = np.r_[True, codes[1:] != codes[:-1]]
        self.first = np.zeros(1 << self.levels, np.int64)
        self.first[codes[new]] = np.flatnonzero(new)

    def within(self, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each range and number in it: the number, and how many of it stand before the range and before its end."""
        number = np.zeros(len(lo), np.int64)
        for ones, zeros in zip(self.ones, self.zeros, strict=True):
            a, b = ones[lo].astype(np.int64), ones[hi].astype(np.int64)
            left, right = hi - lo > b - a, b > a
            lo, hi = np.concatenate([(lo - a)[left], (zeros + a)[right]]), np.concatenate([(hi - b)[left], (zeros + b)[right]])
            number = np.concatenate([2 * number[left], 2 * number[right] + 1])
        return number, lo - self.first[number], hi - self.first[number]


def shared_prefixes(codes: np.ndarray, order: np.ndarray, length: int) -> np.ndarray:
    """Whether each suffix in the order shares `length` codes or more with the one before it."""
    n = len(codes)
    before = codes[order - 1]
    before[order == 0] = 0
    tree = Wavelet(before)
    start = np.r_[0, np.cumsum(np.bincount(codes, minlength=1 << tree.levels))]
    unknown = np.ones(n + 1, bool)
    unknown[: start[1] + 1] = False  # strings' ends are all different
    unknown[n] = True
    lo, hi = np.array([0]), np.array([n])
    for turn in range(length):
        c, a, b = tree.within(lo, hi)
        real = c > 0
        c = c[real]
        lo, hi = start[c] + a[real], start[c] + b[real]
        fresh = unknown[hi]
        lo, hi = lo[fresh], hi[fresh]
        unknown[hi] = False
        if not turn:  # the end of each string is a byte of its own
            lo, hi = np.r_[np.arange(start[1]), lo], np.r_[np.arange(start[1]) + 1, hi]
        if not len(lo):
            break
    return unknown[:n]


def _bytes(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all values on end, and where each begins."""
    values = pa.concat_arrays(column.cast(pa.large_binary()).chunks)
    at = np.frombuffer(values.buffers()[1], np.int64)[values.offset : values.offset + len(values) + 1]
    return np.frombuffer(values.buffers()[2], np.uint8)[at[0] : at[-1]], at - at[0]


def _searched(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """The windows of contexts that are equal to an earlier one, as ranges of their rows."""
    for rows in runs(batches, "key"):
        if not rows.num_rows:
            continue
        data, at = _bytes(rows["context"])
        owner = np.repeat(np.arange(rows.num_rows), np.diff(at))
        seen = np.bincount(data, minlength=256) > 0
        dense = np.cumsum(seen)
        codes = np.zeros(len(data) + rows.num_rows, np.int64)
        codes[np.arange(len(data)) + owner] = dense[data]
        order = suffix_array(codes)
        equal = shared_prefixes(codes, order, length)
        use = np.flatnonzero(equal | np.r_[equal[1:], False])
        if not len(use):
            continue
        group, place = np.cumsum(~equal)[use], order[use]
        starts = at[:-1] + np.arange(rows.num_rows)
        context = np.searchsorted(starts, place, "right") - 1
        by = pc.sort_indices(rows.select(["id", "row"]), [("id", "ascending"), ("row", "ascending")], null_placement="at_start").to_numpy()
        row, lo = rows["row"].to_numpy(), rows["lo"].to_numpy()
        turn = np.empty(len(row), np.int64)
        turn[by] = np.cumsum(np.r_[False, row[by][1:] != row[by][:-1]])
        begin = lo[context] + place - starts[context]
        ranked = np.lexsort([begin, turn[context], group])
        group, context, begin = group[ranked], context[ranked], begin[ranked]
        head = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
        of = head[np.cumsum(np.r_[True, group[1:] != group[:-1]]) - 1]
        later = (turn[context] != turn[context[of]]) | (begin != begin[of])
        first_of_turn = np.full(len(row), -1)
        first_of_turn[turn] = np.arange(len(row))
        t, a, b = merged(turn[context][later], begin[later], begin[later] + length)
        yield pa.RecordBatch.from_arrays([pa.array(row[first_of_turn[t]]), pa.array(a), pa.array(b)], names=["row", "lo", "hi"])


def bucketed(docs: DataFrame, key: str, text: str) -> tuple[DataFrame, int, int]:
    """(row, id, text), bucketed by row, the number of buckets, and the bytes of all texts."""
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length(text)).alias("n")).first()["n"] or 0
    number = int(min(BUCKETS, max(8, size / (BUCKET_MB * 1e6))))
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    name = f"texts_{uuid.uuid4().hex}"
    rows.repartition(number, "row").write.option("path", f"{folder(spark)}/{name}").option("compression", "zstd").bucketBy(number, "row").sortBy("row").saveAsTable(name)
    return spark.table(name), number, size


def repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, k: int | None = None) -> DataFrame:
    """(key, n_bytes, spans, kept) of every document: the sorted byte ranges that go, which do not touch, and the bytes
    that stay."""
    k = k or length // 2
    rows, buckets, size = bucketed(docs, key, text)
    spark, kind = docs.sparkSession, docs.schema[key].dataType.simpleString()
    sample = rows.where(F.pmod(F.xxhash64("row"), F.lit(SAMPLE)) == 0).select("text").mapInArrow(lambda b: _sampled(b, length, k), "key long, n long")
    counts = held(sample.groupBy("key").agg(F.sum("n").alias("n")))
    least = max(HOT, (counts.agg(F.sum("n").alias("n")).first()["n"] or 0) // MOST_HOT)
    hot = np.sort(np.array([r["key"] for r in counts.where(F.col("n") >= least).select("key").collect()], np.int64).view(np.uint64))
    shared = spark.sparkContext.broadcast(hot)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(size / 64e6))
    met = rows.select("row", "id", "text").mapInArrow(lambda b: _exchanged(b, length, k, shared.value), _EXCHANGED.format(id=kind))
    met = met.repartition(parts, "key").sortWithinPartitions("key", "cls", "id", "row", "lo")
    classed = held(met.mapInArrow(_classed, f"key long, id {kind}, row long, lo long, hi long, ask boolean"))
    # What joins the texts is dealt to as many partitions as there are buckets; else the texts would be exchanged again.
    asked = classed.where("ask").repartition(buckets, "row").groupBy("row").agg(F.collect_list(F.struct("key", "lo", "hi")).alias("asked"))
    cut = rows.join(asked, "row").select("id", "row", "text", F.explode("asked").alias("a"))
    cut = cut.select("a.key", "id", "row", "a.lo", F.expr("substring(cast(text as binary), cast(a.lo as int) + 1, cast(a.hi - a.lo as int))").alias("context"))
    searched = cut.repartition(parts, "key").sortWithinPartitions("key").mapInArrow(lambda b: _searched(b, length), "row long, lo long, hi long")
    spans = classed.where("not ask").select("row", "lo", "hi").unionByName(searched)
    by_row = spans.repartition(buckets, "row").groupBy("row").agg(F.collect_set(F.struct("lo", "hi")).alias("found"))
    joined = rows.join(by_row, "row", "left").select("id", "text", "found")
    return joined.mapInArrow(_kept, f"id {kind}, n_bytes long, spans array<struct<lo:bigint,hi:bigint>>, kept binary").withColumnRenamed("id", key)


_SPANS = pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())]))


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Joined spans of each text, and its bytes without them."""
    for batch in (run for b in batches for run in slices(b, "text", 4 * PIECE)):
        data, at = flat(batch.column("text"))
        found = batch.column("found")
        items = found.flatten()
        doc = np.repeat(np.arange(batch.num_rows), pc.fill_null(pc.list_value_length(found), 0).to_numpy(zero_copy_only=False))
        doc, lo, hi = merged(doc, items.field("lo").to_numpy(zero_copy_only=False), items.field("hi").to_numpy(zero_copy_only=False))
        first = np.searchsorted(doc, np.arange(batch.num_rows + 1))
        edge = np.zeros(len(data) + 1, np.int8)
        edge[at[doc] + lo] += 1
        np.subtract.at(edge, at[doc] + hi, 1)
        stay = np.cumsum(edge[:-1], dtype=np.int8) == 0
        rest = data[stay]
        size = np.r_[0, np.cumsum(stay)][at]
        spans = pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.StructArray.from_arrays([pa.array(lo), pa.array(hi)], ["lo", "hi"]))
        kept = pa.LargeBinaryArray.from_buffers(pa.large_binary(), batch.num_rows, [None, pa.py_buffer(size.astype(np.int64)), pa.py_buffer(rest)]).cast(pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(np.diff(at)), spans.cast(_SPANS), kept], names=["id", "n_bytes", "spans", "kept"])


def report(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """Counts for each document, from `repeats`."""
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["hi"] - s["lo"])
    return repeats(docs, key, text, length).select(key, "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op12_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


OP12_SQL = """
WITH texts AS (
    SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, '')))::BIGINT AS n FROM documents
), windows AS (
    SELECT doc_id, s, md5_number(substr(h, 2 * s + 1, 200)) AS k FROM (SELECT doc_id, h, unnest(range(0, n - 99)) AS s FROM texts WHERE n >= 100)
), later AS (
    SELECT doc_id, s FROM (SELECT doc_id, s, row_number() OVER (PARTITION BY k ORDER BY doc_id, s) AS r FROM windows) WHERE r > 1
), runs AS (
    SELECT doc_id, min(s) AS lo, max(s) + 100 AS hi FROM (
        SELECT doc_id, s, sum(fresh) OVER (PARTITION BY doc_id ORDER BY s) AS run FROM (
            SELECT doc_id, s, CASE WHEN s <= lag(s) OVER (PARTITION BY doc_id ORDER BY s) + 100 THEN 0 ELSE 1 END AS fresh FROM later))
    GROUP BY doc_id, run
), edges AS (
    SELECT doc_id, coalesce(lag(hi) OVER w, 0) AS a, lo AS b, hi - lo AS removed FROM runs WINDOW w AS (PARTITION BY doc_id ORDER BY lo)
    UNION ALL
    SELECT doc_id, coalesce(max(hi), 0), max(n), 0 FROM texts LEFT JOIN runs USING (doc_id) GROUP BY doc_id
)
SELECT doc_id, any_value(n) AS n_bytes, sum(removed)::BIGINT AS n_removed, count(*) FILTER (removed > 0) AS n_spans,
    sha256(unhex(string_agg(substr(h, 2 * a + 1, 2 * (b - a)), '' ORDER BY a))) AS kept_sha256
FROM edges JOIN texts USING (doc_id) GROUP BY doc_id
"""
