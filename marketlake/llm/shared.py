"""Small helpers that several operators use: cutting lineage, and connected components."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def folder(spark: SparkSession) -> str:
    """The folder that the cluster shares; a session on one machine without one (as in a test) gets its own."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoint-"))
        named = spark.sparkContext.getCheckpointDir()
    return named


def held(df: DataFrame) -> DataFrame:
    """The rows, written once as a compressed table to the shared folder and read again.

    This cuts the lineage, later reads survive lost executors, and the planner knows the size.
    """
    path = f"{folder(df.sparkSession)}/held-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def crc_remainder(column: str, modulus: int):
    """crc32 of the column as text, modulo `modulus`."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % F.lit(modulus)


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): the smallest node that links reach, for every node that has a link.

    Large-star and small-star rounds: each hangs neighbours on the smallest node seen, by one
    aggregate and one join on the node, until nothing changes; the rounds grow with the logarithm
    of the longest chain.  A node with very many links is a join key with one row on the other
    side, which adaptive execution may split.  Nulls and self-links are ignored.
    """
    edges = held(links.select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).where("hi <> lo").distinct())
    seen = None
    while True:
        state = edges.agg(F.count("*").alias("n"), F.expr("sum(cast(xxhash64(hi, lo) as decimal(38,0)))").alias("h")).first()
        if seen == (state["n"], state["h"]):
            break
        seen = state["n"], state["h"]
        both = edges.unionByName(edges.select(F.col("lo").alias("hi"), F.col("hi").alias("lo")))
        least = both.groupBy("hi").agg(F.least(F.min("lo"), F.first("hi")).alias("m"))
        large = both.join(least, "hi").where("lo > hi").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        # A node smaller than all its neighbours keeps them: (lo, m) with m = itself.
        large = large.where("hi <> lo").distinct()
        down = large.groupBy("hi").agg(F.min("lo").alias("m"))
        joined = large.join(down, "hi")
        small = joined.select(F.col("lo").alias("hi"), F.col("m").alias("lo")).where("hi <> lo").unionByName(down.select("hi", F.col("m").alias("lo")))
        edges = held(small.distinct())
    return edges.select(F.col("hi").alias("node"), F.col("lo").alias("root")).unionByName(edges.select(F.col("lo").alias("node"), F.col("lo").alias("root")).distinct())
