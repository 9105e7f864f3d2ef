r"""Hard negatives by angular triangle filtering.

Vectors of whole numbers, floor(`scale` * x), are scored by their inner product, an
integer.  Each row stores its angles to some reference directions and its norm.  For
an anchor a, a row x and a direction r the triangle inequality on the sphere says

    |angle(a, r) - angle(x, r)|  <=  angle(a, x)  <=  angle(a, r) + angle(x, r),

so stored angles give an interval of the cosine, and the norms make it one of the
score, widened by what rounding can take (`_SLACK` radians and a relative 1e-9).
Rows come sorted by their nearest direction and their angle to it, in tiles; a
tile has a range of angles to each direction and a range of norms, and so a window
of scores for each anchor.  Only if this window overlaps the one that the anchor
still needs is the tile scored, exactly: by doubles while the product of the norms
is below 2^53, else by 64-bit integers.  What an anchor needs shrinks as it runs: from
the worst score that it still holds up to the upper end of its window.

Two passes: the first finds the best rows of the anchor's own label (the
positives), the second, for each of these, the best rows of other labels whose
score lies between `low` and `high` hundredths of the positive's.  In each, anchors
meet all rows in blocks: anchors by at most `ANCHORS`, rows by at most `ROWS`, so a
label with a third of all rows is many blocks.  A task returns at most so many rows
for each anchor as are asked for.

Rows with a null key, a null label, a null vector, or a null or non-finite component
take no part; nor do those whose squared norm is 2^62 or more, since scores would not
fit a long.  Vectors of different lengths are not compared.  Equal keys are rows of
their own (an anchor row is no positive of itself, a copy of it is).  Empty vectors
score 0.  Ties go to the smaller key.  Keys and labels are whole numbers.  Other
columns, of whatever name, are left alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marketlake.llm.shared import held

SCALE, POSITIVES, NEGATIVES, LOW, HIGH = 256, 5, 10, 30, 90
#: Directions, rows of a tile, and the most anchors and rows of a block.
DIRECTIONS, TILE, ANCHORS, ROWS = 16, 512, 1 << 14, 1 << 18
#: What the error of an arc cosine near 1 and of a product in doubles may move an angle by.
_SLACK = 1e-6
_FAR = 1 << 62
_LEAST, _MOST = -_FAR, _FAR


def _doubles(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), width)


def angles(x: np.ndarray, directions: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Norm of each row and its angle to each direction; a row without length is at a right angle to all."""
    big = np.abs(x).max(axis=1, keepdims=True, initial=0)
    y = x / np.where(big > 0, big, 1)
    norm = np.sqrt((y * y).sum(axis=1))
    cos = (y @ directions.T) / np.where(norm > 0, norm, 1)[:, None]
    return norm * big[:, 0], np.arccos(np.clip(cos, -1, 1))


def _measured(batches: Iterator[pa.RecordBatch], directions: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = _doubles(batch.column("v"), directions.shape[1])
        norm, angle = angles(x, directions)
        near = angle.argmin(axis=1)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * angle.shape[1]), pa.array(angle.ravel()))
        cols = [batch.column("row"), batch.column("id"), batch.column("label"), batch.column("v"), pa.array(norm), pa.array(near.astype(np.int32)), pa.array(angle[np.arange(len(x)), near]), lists]
        yield pa.RecordBatch.from_arrays(cols, names=["row", "id", "label", "v", "norm", "near", "angle", "angles"])


_MEASURED = "row long, id long, label long, v array<double>, norm double, near int, angle double, angles array<double>"


def score_bounds(norm: np.ndarray, angle: np.ndarray, norms: tuple[float, float], angle_range: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Smallest and largest score that each anchor can have with any row of a tile."""
    low, high = angle_range
    least = np.maximum(low - angle, angle - high).max(axis=1, initial=0)
    least = np.cos(np.clip(least - _SLACK, 0, np.pi))
    # The cosine of the largest angle that the direction allows, over the tile's range.
    sums = np.stack([angle + low, angle + high])
    most = np.where((sums[0] <= np.pi) & (sums[1] >= np.pi), -1.0, np.cos(np.clip(sums + np.where(sums < np.pi, _SLACK, -_SLACK), 0, 2 * np.pi)).min(axis=0)).max(axis=1, initial=-1)
    upper = norm * np.where(least > 0, norms[1], norms[0]) * least
    lower = norm * np.where(most > 0, norms[0], norms[1]) * most
    room = 1 + 1e-9 * norm * norms[1]
    return lower - room, upper + room


class Held:
    """The best rows of each slot (an anchor and one of its windows of scores) so far."""

    def __init__(self, low: np.ndarray, high: np.ndarray, number: int) -> None:
        self.low, self.high, self.number = low, high, number
        slots = low.size
        self.score = np.full((slots, number), _LEAST, np.int64)
        self.id = np.full((slots, number), np.iinfo(np.int64).max)
        self.full = np.zeros(slots, bool)

    def needs(self) -> tuple[np.ndarray, np.ndarray]:
        """The scores that each anchor still needs."""
        floor = np.maximum(self.low, np.where(self.full, self.score[:, -1], _LEAST).reshape(self.low.shape))
        open_ = floor <= self.high
        return np.where(open_, floor, _MOST).min(axis=1), np.where(open_, self.high, _LEAST).max(axis=1)

    def add(self, anchor: np.ndarray, score: np.ndarray, fits: np.ndarray, ids: np.ndarray) -> None:
        """Scores of some anchors with the rows of a tile; `fits` says which pairs count."""
        slots, scores, new = [], [], []
        for w in range(self.low.shape[1]):
            slot = anchor * self.low.shape[1] + w
            floor = np.maximum(self.low[anchor, w], np.where(self.full[slot], self.score[slot, -1], _LEAST))
            i, j = np.nonzero(fits & (score >= floor[:, None]) & (score <= self.high[anchor, w][:, None]))
            slots.append(slot[i])
            scores.append(score[i, j])
            new.append(ids[j])
        slot, score, id_ = np.concatenate(slots), np.concatenate(scores), np.concatenate(new)
        if not len(slot):
            return
        met, at = np.unique(slot, return_inverse=True)
        held = np.repeat(np.arange(len(met)), self.number)
        at, score, id_ = np.r_[at, held], np.r_[score, self.score[met].ravel()], np.r_[id_, self.id[met].ravel()]
        order = np.lexsort([id_, -score, at])
        at = at[order]
        place = np.arange(len(at)) - np.searchsorted(at, at)
        top = order[place < self.number]
        self.score[met], self.id[met] = score[top].reshape(-1, self.number), id_[top].reshape(-1, self.number)
        self.full[met] = self.score[met, -1] > _LEAST

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        slot, place = np.nonzero(self.score > _LEAST)
        return slot, self.score[slot, place], self.id[slot, place]


def _scores(a: np.ndarray, x: np.ndarray, most: float) -> np.ndarray:
    return np.rint(a @ x.T).astype(np.int64) if most < 1 << 53 else a.astype(np.int64) @ x.astype(np.int64).T


def _blocks(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """Runs of rows that agree in the named columns, within a batch."""
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = [batch.column(n).to_numpy() for n in names]
        new = np.zeros(batch.num_rows, bool)
        for k in keys:
            new[1:] |= k[1:] != k[:-1]
        cuts = [0, *np.flatnonzero(new).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            yield tuple(k[a] for k in keys), batch.slice(a, b - a)


def _searched(batches: Iterator[pa.RecordBatch], width: int, number: int, same: bool, directions: int) -> Iterator[pa.RecordBatch]:
    """The best rows of each anchor of each block."""
    block, waiting = None, []
    row = label = norm = angle = x = None
    best: Held | None = None

    def gather() -> None:
        nonlocal row, label, norm, angle, x, best
        t = pa.Table.from_batches(waiting).combine_chunks()
        one = lambda c: t[c].combine_chunks()
        row, label, norm = (t[c].to_numpy() for c in ("row", "label", "norm"))
        x, angle = _doubles(one("v"), width), _doubles(one("angles"), directions)
        windows = len(t["low"][0].as_py())
        bound = lambda c: one(c).flatten().to_numpy(zero_copy_only=False).reshape(-1, windows)
        best = Held(bound("low"), bound("high"), number)
        waiting.clear()

    def flush() -> Iterator[pa.RecordBatch]:
        if best is not None:
            slot, score, id_ = best.rows()
            windows = best.low.shape[1]
            yield pa.RecordBatch.from_arrays([pa.array(row[slot // windows]), pa.array((slot % windows).astype(np.int32)), pa.array(score), pa.array(id_)], names=["anchor", "slot", "score", "id"])

    for (*key, kind), batch in _blocks(batches, ["g", "a", "r", "kind"]):
        if key != block:
            yield from flush()
            block, best = key, None
        if kind == 0:
            waiting.append(batch)
            continue
        if waiting:
            gather()
        if best is None:
            continue  # a block without anchors
        for at in range(0, batch.num_rows, TILE):
            part = batch.slice(at, TILE)
            y, other, ids = _doubles(part.column("v"), width), part.column("label").to_numpy(), part.column("id").to_numpy()
            rows, norms, theirs = part.column("row").to_numpy(), part.column("norm").to_numpy(), _doubles(part.column("angles"), directions)
            lower, upper = score_bounds(norm, angle, (norms.min(), norms.max()), (theirs.min(axis=0), theirs.max(axis=0)))
            low, high = best.needs()
            near = np.flatnonzero((upper >= low) & (lower <= high) & (low <= high))
            for k in range(0, len(near), 1024):
                some = near[k : k + 1024]
                fits = (label[some][:, None] == other[None, :]) == same
                if same:
                    fits &= row[some][:, None] != rows[None, :]
                best.add(some, _scores(x[some], y, float(norm[some].max() * norms.max())), fits, ids)
    yield from flush()


def _pass(anchors: DataFrame, rows: DataFrame, width: int, number: int, same: bool, group: Column, directions: int) -> DataFrame:
    """(anchor, slot, score, id): the best of each block of anchors and rows."""
    spark = rows.sparkSession
    wide = int(spark.conf.get("spark.sql.shuffle.partitions"))
    a, r = anchors.withColumn("g", group), rows.withColumn("g", group).withColumn("low", F.lit(None).cast("array<long>")).withColumn("high", F.lit(None).cast("array<long>"))
    sizes = a.groupBy("g").agg(F.count("*").alias("n_a")).join(r.groupBy("g").agg(F.count("*").alias("n_r")), "g")
    all_rows = sizes.agg(F.sum("n_r").alias("n")).first()["n"] or 0
    # So many blocks of rows that all tasks together fill the cluster, each of `ROWS` rows at most.
    most = max(TILE, min(ROWS, -(-all_rows // wide)))
    sizes = held(sizes.select("g", F.expr(f"cast(ceil(n_a / {ANCHORS}) as int)").alias("in_a"), F.expr(f"cast(ceil(n_r / {most}) as int)").alias("in_r")))
    deal = lambda c: F.pmod(F.xxhash64("row"), F.col(c)).cast("int")
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    a = a.join(sizes, "g").withColumn("a", deal("in_a")).withColumn("r", every("in_r")).withColumn("kind", F.lit(0))
    r = r.join(sizes, "g").withColumn("r", deal("in_r")).withColumn("a", every("in_a")).withColumn("kind", F.lit(1))
    names = ["g", "a", "r", "kind", "row", "id", "label", "v", "norm", "near", "angle", "angles", "low", "high"]
    met = a.select(names).unionByName(r.select(names)).repartition(wide, "g", "a", "r").sortWithinPartitions("g", "a", "r", "kind", "near", "angle")
    return met.mapInArrow(lambda b: _searched(b, width, number, same, directions), "anchor long, slot int, score long, id long")


def _best(found: DataFrame, number: int) -> DataFrame:
    """The best of all blocks: as many for each anchor and slot and block as are asked for come together."""
    order = Window.partitionBy("anchor", "slot").orderBy(F.col("score").desc(), F.col("id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= number)


_RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def mine(vectors: DataFrame, is_anchor: Column, key: str = "vec_id", vector: str = "embedding", label: Column | str = "label", positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, scale: int = SCALE, directions: int = DIRECTIONS) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    `is_anchor` is a condition on the key, as column `id`; `label` a column or an expression of the input's columns.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(key).cast("long").alias("id"), (F.col(label) if isinstance(label, str) else label).cast("long").alias("label"), F.col(vector).alias("v"))
    rows = rows.withColumn("v", F.col("v").cast("array<double>")).where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull())
    rows = rows.where(~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) * scale >= float(1 << 31))))
    rows = rows.withColumn("v", F.transform("v", lambda x: F.floor(x * scale).cast("double")))
    rows = rows.where(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x) < float(_FAR))
    rows = held(rows.select(F.monotonically_increasing_id().alias("row"), "id", "label", "v"))
    out = []
    for width in sorted(r["n"] for r in rows.select(F.size("v").alias("n")).distinct().collect()):  # lengths of vectors
        mine_ = rows.where(F.size("v") == width)
        chosen = mine_.where(F.exists("v", lambda x: x != 0)).orderBy(F.xxhash64("v"), "row").select("v").limit(8 * directions).collect()
        base = np.array([list(v) for v in dict.fromkeys(tuple(r["v"]) for r in chosen)][:directions] or [[0.0] * width], np.float64)
        base = base / np.maximum(np.sqrt((base * base).sum(axis=1, keepdims=True)), 1)
        shared, n = spark.sparkContext.broadcast(base), len(base)  # `directions` vectors
        measured = held(mine_.mapInArrow(lambda b, s=shared: _measured(b, s.value), _MEASURED))
        anchors = measured.where(is_anchor)
        every = anchors.withColumn("low", F.array(F.lit(_LEAST))).withColumn("high", F.array(F.lit(_MOST)))
        best = held(_best(_pass(every, measured, width, positives, True, F.col("label"), n), positives))
        # Windows of scores for each positive: low * positive <= 100 * score <= high * positive.
        windows = best.groupBy("anchor").agg(F.array_sort(F.collect_list(F.struct("rank", "score", "id"))).alias("p"))
        share = lambda part: lambda p: p["score"].cast("decimal(20,0)") * F.lit(part) / F.lit(100).cast("decimal(3,0)")
        ends = windows.withColumn("low", F.transform("p", lambda p: F.ceil(share(low)(p)).cast("long"))).withColumn("high", F.transform("p", lambda p: F.floor(share(high)(p)).cast("long")))
        # Anchors with fewer positives get windows that nothing lies in.
        pad = lambda c, v: F.concat(c, F.array_repeat(F.lit(v), F.lit(positives) - F.size(c)))
        second = anchors.withColumnRenamed("row", "anchor").join(ends.select("anchor", pad("low", _MOST).alias("low"), pad("high", _LEAST).alias("high")), "anchor").withColumnRenamed("anchor", "row")
        found = _best(_pass(second, measured, width, negatives, False, F.lit(0).cast("long"), n), negatives)
        names = best.join(anchors.select(F.col("row").alias("anchor"), F.col("id").alias("anchor_id")), "anchor").select("anchor", "anchor_id", (F.col("rank") - 1).alias("slot"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
        out.append(found.withColumnRenamed("id", "negative_id").withColumnRenamed("score", "negative_score").join(names, ["anchor", "slot"]).select(*[c.split()[0] for c in _RESULT.split(", ")]))
    result = spark.createDataFrame([], _RESULT)
    for part in out:
        result = result.unionByName(part)
    return result


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("id") % 100 == 0, label=moved)


OP13_SQL = """
WITH r AS (
    SELECT row_number() OVER () AS n, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
    FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
    SELECT a.n, a.vec_id AS anchor_id, a.label = b.label AS same, b.vec_id AS id, list_sum(list_transform(list_zip(a.v, b.v), lambda z: z[1] * z[2]))::BIGINT AS score
    FROM r a JOIN r b ON a.n <> b.n AND len(a.v) = len(b.v) WHERE a.vec_id % 100 = 0
), p AS (
    SELECT * FROM (SELECT n, anchor_id, id, score, row_number() OVER (PARTITION BY n ORDER BY score DESC, id) AS k FROM s WHERE same) WHERE k <= 5
)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM (
    SELECT p.anchor_id, p.id AS positive_id, s.id AS negative_id, p.score AS positive_score, s.score AS negative_score, row_number() OVER (PARTITION BY p.n, p.k ORDER BY s.score DESC, s.id) AS rank
    FROM p JOIN s ON p.n = s.n AND NOT s.same AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score
) WHERE rank <= 10
"""
