r"""Similarity join of documents by the Jaccard measure of their word shingles.

A document's set holds its distinct `width`-word shingles (words
`[^\x20\x09-\x0D]+`, A-Z lower-cased; fewer words: the whole sequence as one).
Sets are compared as 64-bit hashes.  Documents with equal sets are one class
from the start, so copies never meet each other.

Candidates come from adaptive multi-match prefixes.  All shingles are put in
one global order, rare first; its counts are taken over the whole corpus in a
table of fixed size (`bins`), which only orders them.  If two sets reach the
threshold, then at any level l at least l of the first n - ceil(t n) + l
shingles of each are shared.  Every document's prefix is lengthened to the
level at which the estimated cost (postings to scan, plus candidates to verify)
is least, and its pairs are verified only with that many shared prefix shingles
and if the position of their first match still allows the threshold.

Groups of near copies would give all their pairs.  A first round therefore
links each document only to the one of its neighbours in each posting list
whose match stands first (the one with the fewest shingles of its own), and
joins what verifies to components; the second round takes all pairs whose
components still differ, so the components are those of the full join.
Long posting lists are dealt in blocks of `block` rows to many tasks.

Null texts and texts without words have an empty set, link with nothing and are
components of their own.  Rows with a null key are documents like any other; the
smallest key is taken among those that are not null, and is null where there are
none.  Where several rows share a key, each is judged by its own text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marketlake.llm.shared import components, held
from marketlake.llm.words import flat, join_hashes, mix, slices, words

WIDTH = 5
PERCENT = 80
BIN_BITS = 21
MOST_LEVELS = 4
BLOCK = 2048
FILTER_BITS = 24
#: What verifying a candidate costs, in postings scanned.
VERIFY_COST = 50.0
#: Pairs of postings that one task compares, about.
PAIR_WORK = 1 << 26
_PARTS = 64


def shingle_sets(column: pa.Array, width: int = WIDTH) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    w = words(*flat(column))
    h = join_hashes(w.hash, width)
    out = []
    for first, n in zip(w.first[:-1].tolist(), w.count.tolist(), strict=True):
        if n >= width:
            s = np.sort(h[first : first + n - width + 1])
            out.append(s[np.r_[True, s[1:] != s[:-1]]])
        else:
            out.append(join_hashes(w.hash[first : first + n], n) if n else np.zeros(0, np.uint64))
    return out


def _class(shingles: np.ndarray) -> int:
    """Equal for equal sets; smallest-first signed 64-bit."""
    twice = mix(shingles ^ np.uint64(0x5851F42D4C957F2D))
    h = mix(np.array([twice.sum(dtype=np.uint64) + np.uint64(len(shingles))]))
    return int(h.view(np.int64)[0])


def _bin(h: np.ndarray, bits: int) -> np.ndarray:
    return (h >> np.uint64(64 - bits)).astype(np.int64)


def _profile(batches: Iterator[pa.RecordBatch], key: str, text: str, width: int, bits: int) -> Iterator[pa.RecordBatch]:
    """A row for each document with a set's size and class; at the end the counts of this task, in parts."""
    counts = np.zeros(1 << bits, np.uint16)
    names = ["doc", "hash", "n", "cls", "part", "counts"]
    kind = None
    for batch in batches:
        kind = batch.column(key).type
        for run in slices(batch, text):
            sets = shingle_sets(run.column(text), width)
            if filled := [s for s in sets if len(s)]:
                seen = np.bincount(_bin(np.concatenate(filled), bits), minlength=len(counts))
                counts = np.minimum(counts + seen, 65535).astype(np.uint16)
            yield pa.RecordBatch.from_arrays(
                [run.column(key), run.column("hash"), pa.array([len(s) for s in sets], pa.int64()), pa.array([_class(s) if len(s) else None for s in sets], pa.int64()), pa.nulls(len(sets), pa.int32()), pa.nulls(len(sets), pa.binary())],
                names=names,
            )
    if kind is not None and counts.any():
        size = len(counts) // _PARTS
        yield pa.RecordBatch.from_arrays(
            [pa.nulls(_PARTS, kind), *[pa.nulls(_PARTS, pa.int64())] * 3, pa.array(range(_PARTS), pa.int32()), pa.array([counts[i * size : (i + 1) * size].tobytes() for i in range(_PARTS)], pa.binary())],
            names=names,
        )


def _add_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of the parts, as steps of an eighth of a power of two."""
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for part, counts in zip(batch.column("part").to_pylist(), batch.column("counts"), strict=True):
            more = np.frombuffer(counts.as_buffer(), np.uint16)
            total[part] = total[part] + more if part in total else more.astype(np.uint64)
    for part, counts in total.items():
        steps = np.minimum(np.round(8 * np.log2(counts + 1.0)), 255).astype(np.uint8)
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([steps.tobytes()], pa.binary())], names=["part", "steps"])


def level(weights: np.ndarray, base: int, most: int) -> int:
    """The number of matches to ask for, by estimated cost of postings and candidates."""
    sums = np.cumsum(weights)
    best = min(range(1, most + 1), key=lambda k: (sums[min(base + k, len(sums)) - 1] * (1 + VERIFY_COST / k), k))
    return best


def _postings(batches: Iterator[pa.RecordBatch], steps: np.ndarray, text: str, width: int, percent: int, bits: int) -> Iterator[pa.RecordBatch]:
    """Prefix tokens of each class that a task meets, once: copies leave no postings of their own."""
    usual = float(np.median(2.0 ** (steps[:: max(1, len(steps) // 65536)] / 8.0)))
    seen: set[int] = set()  # a number for each class of the task's texts
    for batch in batches:
        for run in slices(batch, text):
            out: list[list[np.ndarray]] = [[] for _ in range(6)]
            for s in shingle_sets(run.column(text), width):
                n = len(s)
                if not n or _class(s) in seen:
                    continue
                seen.add(_class(s))
                rank = steps[_bin(s, bits)]
                order = np.argsort(rank, kind="stable")
                need = -(-percent * n // 100)
                most = min(MOST_LEVELS, need)
                size = n - need + most
                order = order[:size]
                weights = np.maximum(2.0 ** (rank[order] / 8.0) - usual, 0) + 0.01
                at = np.arange(size, dtype=np.int32)
                for held_, x in zip(out, (s[order].view(np.int64), np.full(size, _class(s)), np.full(size, n, np.int32), at, np.maximum(at - (n - need) + 1, 1).astype(np.int32), np.full(size, level(weights, n - need, most), np.int32)), strict=True):
                    held_.append(x)
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in out], names=["token", "cls", "n", "at", "lv", "ask"])


def _runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pd.DataFrame]:
    """Sorted rows again, in pieces that never cut a run of equal keys."""
    rest = None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = batch.to_pandas()
        rows = rows if rest is None else pd.concat([rest, rows], ignore_index=True)
        last = (rows[keys] == rows[keys].iloc[-1]).all(axis=1).to_numpy()
        cut = len(rows) - int(np.argmin(last[::-1])) if not last.all() else 0
        rest = rows.iloc[cut:]
        if cut:
            yield rows.iloc[:cut]
    if rest is not None and len(rest):
        yield rest


def _many(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by token and class, each class once, where a token has two classes at least."""
    before: pa.RecordBatch | None = None  # the last row, not yet decided, and whether its token had another class
    joined = False
    for batch in batches:
        rows = pa.Table.from_batches([before, batch] if before is not None else [batch]).combine_chunks()
        token, cls = rows["token"].to_numpy(), rows["cls"].to_numpy()
        fresh = np.r_[True, (token[1:] != token[:-1]) | (cls[1:] != cls[:-1])]
        rows, token = rows.filter(pa.array(fresh)), token[fresh]
        if len(token) == 0:
            continue
        like = np.r_[joined, token[1:] == token[:-1]]
        keep = like | np.r_[like[1:], False]
        joined = bool(like[-1])
        tail = rows.slice(len(token) - 1, 1).to_batches()
        before = tail[0]
        body = rows.slice(0, len(token) - 1).filter(pa.array(keep[:-1]))
        yield from body.to_batches()
    if before is not None and joined:
        yield before


def _pairs(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Pairs of each block of a posting list whose components differ, sizes agree and positions allow the threshold."""
    for rows in _runs(batches, ["token", "left", "right"]):
        edge = np.flatnonzero(np.r_[True, (rows[["token", "left", "right"]].to_numpy()[1:] != rows[["token", "left", "right"]].to_numpy()[:-1]).any(axis=1), True])
        col = {c: rows[c].to_numpy() for c in ("cls", "n", "at", "lv", "ask", "comp", "chunk", "left", "right")}
        for a, b in zip(edge, edge[1:], strict=False):
            x = {c: v[a:b] for c, v in col.items()}
            one = np.flatnonzero(x["chunk"] == x["left"][0])
            two = np.flatnonzero(x["chunk"] == x["right"][0])
            size = x["n"][two]  # rows come sorted by size, so partners of a run of rows are a range
            for i0 in range(0, len(one), 256):
                some = one[i0 : i0 + 256]
                low = np.searchsorted(size, -(-percent * int(x["n"][some[0]]) // 100))
                high = np.searchsorted(size, 100 * int(x["n"][some[-1]]) // percent, "right")
                i, j = some[:, None], two[None, low:high]
                n, m, ai, aj = (x[c][k].astype(np.int64) for c in ("n", "at") for k in (i, j))
                first = (n > m) | ((n == m) & (x["cls"][i] > x["cls"][j]))
                ask = np.where(first, x["ask"][i], x["ask"][j])
                most = np.minimum(n - ai, m - aj)  # as if this were the first shingle that they share
                good = (x["comp"][i] != x["comp"][j]) & ((100 + percent) * most >= percent * (n + m)) & (np.maximum(x["lv"][i], x["lv"][j]) <= ask) & (100 * np.minimum(n, m) >= percent * np.maximum(n, m))
                if x["left"][0] == x["right"][0]:
                    good &= x["cls"][i] < x["cls"][j]
                p, q = np.nonzero(good)
                if len(p):
                    ci, cj = x["cls"][some[p]], x["cls"][two[low + q]]
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(ci, cj)), pa.array(np.maximum(ci, cj)), pa.array(ask[p, q].astype(np.int32))], names=["a", "b", "ask"])


def _linked(batches: Iterator[pa.RecordBatch], width: int, percent: int) -> Iterator[pa.RecordBatch]:
    """The pairs of texts that reach the threshold, exactly."""
    for batch in batches:
        for run in slices(batch, "text_a"):
            one, two = shingle_sets(run.column("text_a"), width), shingle_sets(run.column("text_b"), width)
            good = []
            for s, t in zip(one, two, strict=True):
                both = len(np.intersect1d(s, t, assume_unique=True))
                good.append(len(s) > 0 and 100 * both >= percent * (len(s) + len(t) - both))
            keep = pa.array(good, pa.bool_())
            yield pa.RecordBatch.from_arrays([run.column("a").filter(keep), run.column("b").filter(keep)], names=["a", "b"])


def classes_of(rows: DataFrame, width: int, bits: int) -> DataFrame:
    kind = rows.schema["key"].dataType.simpleString()
    return held(rows.mapInArrow(lambda b: _profile(b, "key", "text", width, bits), f"doc {kind}, hash long, n long, cls long, part int, counts binary"))


def jaccard_components(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH, percent: int = PERCENT, bits: int = BIN_BITS, block: int = BLOCK, pair_work: int = PAIR_WORK) -> DataFrame:
    """(key, n_shingles, component_id) for every document."""
    spark = docs.sparkSession
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), F.xxhash64(text).alias("hash"))
    profile = classes_of(rows, width, bits)
    members = profile.where("part is null").select(F.col("doc").alias("key"), "hash", "n", "cls")
    parts = profile.where("part is not null").select("part", "counts").repartition(_PARTS, "part").mapInArrow(_add_counts, "part int, steps binary").collect()
    steps = np.zeros(1 << bits, np.uint8)
    for r in parts:
        size = len(steps) // _PARTS
        steps[r["part"] * size : (r["part"] + 1) * size] = np.frombuffer(r["steps"], np.uint8)
    order = spark.sparkContext.broadcast(steps)  # 2^bits bytes, whatever the corpus

    postings = rows.select("text").mapInArrow(lambda b: _postings(b, order.value, "text", width, percent, bits), "token long, cls long, n int, at int, lv int, ask int")
    shared = postings.repartition("token").sortWithinPartitions("token", "cls").mapInArrow(_many, postings.schema)
    # Only shingles that another class has can be shared: `before` counts those that stand before in the prefix.
    shared = held(shared.withColumn("before", (F.row_number().over(Window.partitionBy("cls").orderBy("at")) - 1).cast("int")))

    def verified(pairs: DataFrame) -> DataFrame:
        pairs = held(pairs)
        active = _texts(pairs, members, rows, width)
        # Texts are never a side to broadcast, however few a small corpus has.
        near = pairs.join(active.select(F.col("cls").alias("a"), F.col("text").alias("text_a")).hint("merge"), "a")
        near = near.join(active.select(F.col("cls").alias("b"), F.col("text").alias("text_b")).hint("merge"), "b")
        return near.select("a", "b", "text_a", "text_b").mapInArrow(lambda b: _linked(b, width, percent), "a long, b long")

    head = shared.where("lv = 1").groupBy("token").agg(F.min_by(F.struct("cls", "n", "at", "before"), F.struct("at", "cls")).alias("lead"))
    star = shared.where("lv = 1").join(head, "token").where("cls <> lead.cls")
    star = star.where(f"{100 + percent} * (least(before, lead.before) + least(n - at, lead.n - lead.at)) >= {percent} * (n + lead.n)")
    near = held(verified(star.select(F.least("cls", "lead.cls").alias("a"), F.greatest("cls", "lead.cls").alias("b")).distinct()))

    known = components(near)
    lists = shared.join(known.select(F.col("node").alias("cls"), F.col("root").alias("comp")), "cls", "left").withColumn("comp", F.coalesce("comp", "cls"))
    wide = held(lists.groupBy("token").agg(F.count("*").alias("size"), F.min("comp").alias("c0"), F.max("comp").alias("c1")).where("c0 <> c1").select("token", "size", F.expr(f"cast(ceil(size / {block}) as int)").alias("chunks")))
    work = wide.agg(F.sum(F.col("size") * F.col("size"))).first()[0] or 0
    wide = wide.drop("size")
    dealt = lists.join(wide, "token").withColumn("chunk", F.expr("cast(pmod(xxhash64(cls), chunks) as int)")).withColumn("other", F.explode(F.expr("sequence(0, chunks - 1)")))
    dealt = dealt.withColumn("left", F.least("chunk", "other")).withColumn("right", F.greatest("chunk", "other"))
    keys = ["token", "left", "right"]
    pairs = dealt.select(*keys, "chunk", "cls", "n", "at", "lv", "ask", "comp").repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(work) // pair_work), *keys).sortWithinPartitions(*keys, "n").mapInArrow(lambda b: _pairs(b, percent), "a long, b long, ask int")
    # A pair that can reach the threshold comes from the list of its first shared shingle at least; how many
    # they share in their prefixes at the level asked for is counted on the prefixes themselves.
    prefix = shared.groupBy("cls").agg(F.collect_list(F.struct("token", "lv")).alias("prefix"))
    pairs = pairs.groupBy("a", "b").agg(F.max("ask").alias("ask"))
    pairs = pairs.join(prefix.withColumnsRenamed({"cls": "a", "prefix": "of_a"}), "a").join(prefix.withColumnsRenamed({"cls": "b", "prefix": "of_b"}), "b")
    asked = [f"transform(filter({c}, x -> x.lv <= ask), x -> x.token)" for c in ("of_a", "of_b")]
    pairs = pairs.where(f"size(array_intersect({asked[0]}, {asked[1]})) >= ask").select("a", "b")
    more = verified(pairs)

    # A class is named by its smallest document, so the smallest name that links reach is the component's.
    name = F.struct(F.col("key").isNull().alias("none"), F.col("key").alias("key"), F.col("cls").alias("cls"))
    named = held(members.where("cls is not null").groupBy("cls").agg(F.min(name).alias("name")))
    side = lambda c: named.select(F.col("cls").alias(c), F.col("name").alias(f"name_{c}"))
    links = near.unionByName(more).join(side("a"), "a").join(side("b"), "b")
    roots = components(links, "name_a", "name_b").select(F.col("node.cls").alias("cls"), F.col("root.key").alias("root"), F.lit(True).alias("linked"))
    # Written first, so that the last join has a plain exchange on either side, which adaptive execution may split.
    least = named.join(roots, "cls", "left").select("cls", F.when(F.col("linked"), F.col("root")).otherwise(F.col("name.key")).alias("least"))
    found = members.join(held(least), "cls", "left")
    return found.select(F.col("key").alias(key), F.col("n").alias("n_shingles"), F.when(F.col("cls").isNull(), F.col("key")).otherwise(F.col("least")).alias("component_id"))


def _mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen = np.zeros(1 << FILTER_BITS, bool)
    for batch in batches:
        seen[batch.column("bit").to_numpy()] = True
    if seen.any():
        yield pa.RecordBatch.from_arrays([pa.array(range(_PARTS), pa.int32()), pa.array([np.packbits(x).tobytes() for x in np.split(seen, _PARTS)], pa.binary())], names=["part", "bits"])


def _either(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for part, bits in zip(batch.column("part").to_pylist(), batch.column("bits"), strict=True):
            more = np.frombuffer(bits.as_buffer(), np.uint8)
            total[part] = total[part] | more if part in total else more
    for part, bits in total.items():
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([bits.tobytes()], pa.binary())], names=["part", "bits"])


def _texts(pairs: DataFrame, members: DataFrame, rows: DataFrame, width: int) -> DataFrame:
    """A text for each class of the pairs.

    Before the join, a bitmap of fixed size drops most of the documents that no pair names, so
    that their texts are not shuffled; the join itself is exact.
    """
    named = pairs.select(F.col("a").alias("cls")).unionByName(pairs.select(F.col("b").alias("cls"))).distinct()
    chosen = held(members.join(named, "cls").groupBy("cls").agg(F.min(F.struct("key", "hash")).alias("of")).select("cls", F.col("of.key").alias("of_key"), F.col("of.hash").alias("hash")))
    bit = lambda key: F.pmod(F.xxhash64(key, "hash"), F.lit(1 << FILTER_BITS)).cast("int").alias("bit")
    marks = chosen.select(bit("of_key")).mapInArrow(_mark, "part int, bits binary").repartition(_PARTS, "part").mapInArrow(_either, "part int, bits binary").collect()
    seen = np.zeros((_PARTS, (1 << FILTER_BITS) // _PARTS // 8), np.uint8)
    for r in marks:
        seen[r["part"]] = np.frombuffer(r["bits"], np.uint8)
    wanted = rows.sparkSession.sparkContext.broadcast(seen.ravel())
    kind = rows.schema["text"].dataType.simpleString()

    def likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column("bit").to_numpy()
            yield batch.filter(pa.array((wanted.value[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1))

    def of_class(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for run in slices(batch, "text"):
                same = [len(s) > 0 and _class(s) == c for s, c in zip(shingle_sets(run.column("text"), width), run.column("cls").to_pylist(), strict=True)]
                yield run.filter(pa.array(same, pa.bool_()))

    few = rows.select("key", "text", "hash", bit("key"))
    few = few.mapInArrow(likely, few.schema).drop("bit").hint("merge").join(chosen, "hash").where("key <=> of_key")
    # Rows may share key and hash, so the class is checked on the text itself, and one text is kept.
    return held(few.select("cls", "text").mapInArrow(of_class, f"cls long, text {kind}").dropDuplicates(["cls"]))


def deduplicate(docs: DataFrame, key: str = "doc_id", **options) -> DataFrame:
    """One row of each component, the one with the smallest key (null last); rows, not keys, are judged."""
    rows = held(docs.withColumn("__row", F.monotonically_increasing_id()))
    found = jaccard_components(rows, "__row", **options)
    order = F.struct(F.col(key).isNull().alias("none"), F.col(key).alias("key"), F.col("__row").alias("row"))
    first = rows.select("__row", order.alias("o")).join(found, "__row").groupBy("component_id").agg(F.min("o").alias("o"))
    return rows.join(first.select(F.col("o.row").alias("__row")), "__row", "left_semi").select(docs.columns)


def op7_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))
