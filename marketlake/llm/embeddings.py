r"""Near duplicates among embeddings by randomised-rotation binary codes.

Every vector is normalised, turned by random rotations and kept as the signs of
its turned coordinates, with the correction factor f = <code, vector>.  For a
vector q, <code_j, q> / f_j estimates <j, q> without bias, and the error stays
within `epsilon` * sqrt((1 - f^2) / f^2) / sqrt(dim - 1) but for a probability
that falls with exp(-epsilon^2).  A pair is recomputed exactly, in double
precision, only if its upper confidence bound reaches the threshold; none is
linked on the estimate alone.  The estimate is one-sided: the code of j against the
turned vector of q in full precision.

Pairs to estimate are those that agree in one of `tables` segments of their
codes.  The bits of a segment grow with the logarithm of the number of vectors,
so buckets keep their size; the number of segments follows from `recall`, the
probability that a pair exactly at the threshold meets.  Equal vectors are one
class from the start.  Buckets of more than `block` rows are dealt in pairs of
blocks to many tasks.  A pair that meets in several segments is counted in the
first.  Tasks return link counts and one link per vector, never lists of pairs.

Vectors that are null, zero, or hold null or non-finite components link with
nothing; vectors of different lengths are not compared.  Rows that share an id
are one vector each, counted by copies.  Rows with a null id are vectors like any
other; a component without any other id has a null one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketlake.llm.shared import components, held

THRESHOLD = 0.9
RECALL = 0.98
EPSILON = 3.0
BUCKET = 64
BLOCK = 1024
#: Pairs that are recomputed at a time.
_SLICE = 1 << 14
SEED = 11


def plan(n: int, dim: int, threshold: float, recall: float, bucket: int = BUCKET) -> tuple[int, int]:
    """Bits of a segment and number of segments."""
    bits = int(min(dim, 30, max(2, np.ceil(np.log2(max(n, 2) / bucket)))))
    agree = (1 - np.arccos(threshold) / np.pi) ** bits
    return bits, int(np.ceil(np.log(1 - recall) / np.log(1 - agree)))


def rotations(dim: int, number: int, seed: int = SEED) -> np.ndarray:
    draw = np.random.default_rng(seed)
    return np.stack([np.linalg.qr(draw.normal(size=(dim, dim)))[0] for _ in range(number)])


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows of length one; scaled first, so that neither tiny nor huge ones are lost."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _keys(bits: np.ndarray, size: int, tables: int) -> np.ndarray:
    """Segment values (rows x tables) of the codes (rows x rotations x dim)."""
    per = bits.shape[2] // size
    use = bits[:, :, : per * size].reshape(len(bits), -1, size)[:, :tables]
    return use @ (1 << np.arange(size, dtype=np.int64))


def _encode(batches: Iterator[pa.RecordBatch], turn: np.ndarray, size: int, tables: int) -> Iterator[pa.RecordBatch]:
    dim = turn.shape[1]
    for batch in batches:
        for at in range(0, batch.num_rows, 1024):
            part = batch.slice(at, 1024)
            x = _unit(_matrix(part.column("vector"), dim))
            turned = np.einsum("nd,rde->nre", x, turn)
            code = turned > 0
            factor = np.abs(turned[:, 0]).sum(axis=1) / np.sqrt(dim)
            keys = _keys(code.astype(np.int64), size, tables)
            packed = pa.array([c.tobytes() for c in np.packbits(code.reshape(len(code), -1), axis=1)], pa.binary())
            for t in range(tables):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(x), t, np.int32)), pa.array(keys[:, t]), part.column("rep"), part.column("copies"), packed, pa.array(factor), part.column("vector")],
                    names=["t", "key", "rep", "copies", "code", "factor", "vector"],
                )


def _runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Sorted rows again, in tables that never cut a run of equal keys, with the edges of the runs."""
    rest: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([batch])
        rows = rows if rest is None else pa.concat_tables([rest, rows])
        edge = _edges(rows, keys)
        cut = int(edge[-2])
        rest = rows.slice(cut)
        if cut:
            yield rows.slice(0, cut).combine_chunks(), edge[:-1]
    if rest is not None:
        yield rest.combine_chunks(), _edges(rest, keys)


def _edges(rows: pa.Table, keys: list[str]) -> np.ndarray:
    new = np.zeros(rows.num_rows, bool)
    new[0] = True
    for k in keys:
        v = rows[k].to_numpy()
        new[1:] |= v[1:] != v[:-1]
    return np.r_[np.flatnonzero(new), rows.num_rows]


def _compare(batches: Iterator[pa.RecordBatch], turn: np.ndarray, size: int, tables: int, threshold: float, epsilon: float) -> Iterator[pa.RecordBatch]:
    """Link counts and local components of each block of a bucket."""
    dim = turn.shape[1]
    for rows, edges in _runs(batches, ["t", "key", "left", "right"]):
        x = _unit(_matrix(rows["vector"].combine_chunks(), dim))
        turned = (x @ turn[0]).astype(np.float32)
        code = np.unpackbits(np.frombuffer(b"".join(rows["code"].to_pylist()), np.uint8).reshape(len(x), -1), axis=1)[:, : turn.shape[0] * dim]
        sign = (code[:, :dim].astype(np.float32) * 2 - 1) / np.float32(np.sqrt(dim))
        factor = rows["factor"].to_numpy()
        error = epsilon * np.sqrt(np.maximum(1 - factor**2, 0)) / factor / np.sqrt(max(dim - 1, 1))
        keys = _keys(code.reshape(len(x), turn.shape[0], dim).astype(np.int64), size, tables)
        rep, copies, t, chunk, left, right = (rows[c].to_numpy() for c in ("rep", "copies", "t", "chunk", "left", "right"))
        ones, twos = [], []
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            if left[a] == right[a]:
                one = two = np.arange(a, b)
            else:
                one, two = a + np.flatnonzero(chunk[a:b] == left[a]), a + np.flatnonzero(chunk[a:b] == right[a])
            upper = (turned[one] @ sign[two].T) / factor[two] + error[two]
            i, j = np.nonzero(upper >= threshold - 1e-6)
            i, j = one[i], two[j]
            if left[a] == right[a]:
                i, j = i[i < j], j[i < j]
            if t[a]:
                first = ~(keys[i, : t[a]] == keys[j, : t[a]]).any(axis=1)
                i, j = i[first], j[first]
            exact = np.concatenate([np.zeros(0, bool), *[np.einsum("nd,nd->n", x[i[k : k + _SLICE]], x[j[k : k + _SLICE]]) >= threshold for k in range(0, len(i), _SLICE)]])
            ones.append(i[exact])
            twos.append(j[exact])
        i, j = np.concatenate(ones), np.concatenate(twos)
        if not len(i):
            continue
        number = np.bincount(i, copies[j], minlength=len(x)) + np.bincount(j, copies[i], minlength=len(x))
        root = rep.copy()
        while True:
            low = np.minimum(root[i], root[j])
            before = root.copy()
            np.minimum.at(root, i, low)
            np.minimum.at(root, j, low)
            if (before == root).all():
                break
        some = np.flatnonzero(number)
        yield pa.RecordBatch.from_arrays([pa.array(rep[some]), pa.array(number[some].astype(np.int64)), pa.array(root[some])], names=["rep", "links", "root"])


def near_duplicates(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", threshold: float = THRESHOLD, recall: float = RECALL, epsilon: float = EPSILON, bucket: int = BUCKET, block: int = BLOCK) -> DataFrame:
    """(key, n_links, component_id, kept) of every row."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col(key).alias("id"), F.col(vector).alias("vector"))
    bad = F.exists("vector", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    usable = F.coalesce(~bad & F.exists("vector", lambda v: v != 0), F.lit(False))
    rows = rows.withColumn("cls", F.when(usable, F.xxhash64("vector")))
    name = F.struct(F.col("id").isNull().alias("none"), F.col("id").alias("id"), F.col("cls").alias("cls"))
    reps = held(rows.where("cls is not null").groupBy("cls", F.size("vector").alias("dim")).agg(F.min(name).alias("name"), F.count("*").alias("copies"), F.first("vector").alias("vector")))
    found = []
    for dim, n in sorted((r["dim"], r["count"]) for r in reps.groupBy("dim").count().collect()):
        size, tables = plan(n, dim, threshold, recall, bucket)
        held_turn = spark.sparkContext.broadcast(rotations(dim, -(-tables // (dim // size))))
        kind = reps.schema["vector"].dataType.simpleString()
        coded = reps.where(F.col("dim") == dim).select(F.col("cls").alias("rep"), "copies", "vector").mapInArrow(lambda b, h=held_turn, s=size, t=tables: _encode(b, h.value, s, t), f"t int, key long, rep long, copies long, code binary, factor double, vector {kind}")
        large = held(coded.groupBy("t", "key").count().where(F.col("count") > block).select("t", "key", F.expr(f"cast(ceil(count / {block}) as int)").alias("chunks")))
        dealt = coded.join(large, ["t", "key"], "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
        dealt = dealt.withColumn("chunk", F.expr("cast(pmod(xxhash64(rep), chunks) as int)")).withColumn("other", F.explode(F.expr("sequence(0, chunks - 1)")))
        dealt = dealt.withColumn("left", F.least("chunk", "other")).withColumn("right", F.greatest("chunk", "other")).drop("other", "chunks")
        keys = ["t", "key", "left", "right"]
        found.append(dealt.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(lambda b, h=held_turn, s=size, t=tables: _compare(b, h.value, s, t, threshold, epsilon), "rep long, links long, root long"))
    if not found:
        found = [spark.createDataFrame([], "rep long, links long, root long")]
    links = found[0]
    for more in found[1:]:
        links = links.unionByName(more)
    links = held(links.groupBy("rep", "root").agg(F.sum("links").alias("links")))
    # A class is named by its smallest id, so the smallest name that links reach is the component's.
    side = lambda c: reps.select(F.col("cls").alias(c), F.col("name").alias(f"name_{c}"))
    edges = links.where("rep <> root").select(F.col("rep").alias("a"), F.col("root").alias("b")).join(side("a"), "a").join(side("b"), "b")
    roots = components(edges, "name_a", "name_b").select(F.col("node.cls").alias("cls"), F.col("root.id").alias("root"), F.lit(True).alias("linked"))
    sums = links.groupBy(F.col("rep").alias("cls")).agg(F.sum("links").alias("links"))
    by_class = reps.select("cls", "dim", "name", "copies").join(sums, "cls", "left").join(roots, "cls", "left")
    by_class = by_class.select("cls", "dim", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.when(F.col("linked"), F.col("root")).otherwise(F.col("name.id")).alias("least"))
    named = rows.select("id", "cls", F.size("vector").alias("dim")).join(by_class, ["cls", "dim"], "left")
    component = F.when(F.col("cls").isNull(), F.col("id")).otherwise(F.col("least"))
    return named.select(F.col("id").alias(key), F.coalesce("n_links", F.lit(0)).alias("n_links"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))


def op1_embedding_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
