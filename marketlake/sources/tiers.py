"""Stored candle tables, one for each grain: bucketed by series, sorted by time, partitioned by month.

A series is (asset, quote, source).  As all rows of a series lie in one bucket, roll-ups, latest-version reads and
windows over a series read a tier without an exchange, and so does a chain of roll-ups from the finest tier.  A
series has one candle for each bucket of time at most, 5.3 million minutes in ten years, so no bucket grows with
the number of trades.  Tables lie where `root` says; another session opens them by their path.

Writes replace whole months and leave the others alone.  A job that fails half-way leaves the old months in place,
and one that comes again replaces what it wrote.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marketlake.functions.timebucket import CHILD, bucket_end, bucket_start
from marketlake.operators.candles import COLUMNS, KEYS, rollup
from marketlake.sources.versioned import latest

SERIES = ("asset", "quote", "source")
#: The stored types of a candle.
TYPES = {"ts": "timestamp", "asset": "string", "quote": "string", "source": "string", **{c: "double" for c in ("open", "high", "low", "close", "volume_quote_usd", "close_usd", "vwap", "pf_price_volume")}, **{c: "decimal(38,14)" for c in ("volume_base", "volume_quote", "pf_volume")}, **{c: "bigint" for c in ("trade_count", "version", "pf_trade_count")}}


def month_of(ts: Column | str) -> Column:
    return F.date_format(ts, "yyyy-MM")


class Tiers:
    """The tables of all grains of one market below a folder."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = 64) -> None:
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets
        self.name = "tiers_" + re.sub(r"\W", "_", self.root)[-80:]

    def table(self, grain: str) -> str:
        """The name of a grain's table, which is made on first use."""
        name = f"{self.name}_{'month' if grain == '1M' else grain}"
        if not self.spark.catalog.tableExists(name):
            columns = ", ".join(f"{c} {TYPES[c]}" for c in COLUMNS)
            keys = ", ".join(SERIES)
            self.spark.sql(f"create table {name} ({columns}, month string) using parquet options (partitionOverwriteMode 'dynamic') partitioned by (month) clustered by ({keys}) sorted by ({keys}, ts) into {self.buckets} buckets location '{self.root}/{grain.replace('1M', 'month')}'")
        return name

    def read(self, grain: str, lo: Column | None = None, hi: Column | None = None) -> DataFrame:
        """Candles that start from lo to before hi; only the months of that time are read."""
        rows = self.spark.table(self.table(grain))
        if lo is not None:
            rows = rows.where((F.col("ts") >= lo) & (F.col("month") >= month_of(lo)))
        if hi is not None:
            rows = rows.where((F.col("ts") < hi) & (F.col("month") <= month_of(hi)))
        return rows.select(COLUMNS)

    def latest(self, grain: str) -> DataFrame:
        """One candle for each key, that of the highest version."""
        return latest(self.read(grain), KEYS, "version")

    def replace(self, grain: str, rows: DataFrame) -> None:
        """Months that the rows have take the place of those stored.

        Rows that do not come from a tier are dealt to their buckets first, which is the only exchange.
        """
        name = self.table(grain)
        out = rows.select(*[F.col(c).cast(TYPES[c]).alias(c) for c in COLUMNS], month_of("ts").alias("month"))
        out.write.mode("overwrite").insertInto(name)  # the table's option says that only these months go
        self.spark.catalog.refreshTable(name)

    def dealt(self, rows: DataFrame) -> DataFrame:
        """The rows in as many partitions as there are buckets, so that each file is written by one task."""
        return rows.repartition(self.buckets, *SERIES)

    def roll(self, grain: str, lo: Column | None = None, hi: Column | None = None) -> None:
        """A tier made from its child, whole or in the months of a time: bounds are moved out to whole buckets and months."""
        first = None if lo is None else F.date_trunc("month", lo)
        past = None if hi is None else F.add_months(F.date_trunc("month", hi - F.expr("interval 1 microsecond")), 1).cast("timestamp")
        # A bucket belongs to the month in which it starts, and weeks may end in the next.
        begin = None if first is None else bucket_start(first, grain)
        end = None if past is None else bucket_end(bucket_start(past, grain), grain)
        rows = rollup(self.read(CHILD[grain], begin, end), grain)
        if first is not None:
            rows = rows.where(F.col("ts") >= first)
        if past is not None:
            rows = rows.where(F.col("ts") < past)
        self.replace(grain, rows)

    def roll_all(self, lo: Column | None = None, hi: Column | None = None) -> None:
        for grain in CHILD:
            self.roll(grain, lo, hi)

    def fold(self, grain: str, fresh: DataFrame) -> None:
        """New versions of candles; in each key the highest version stays.  Only the months of the new ones are rewritten."""
        fresh = fresh.select(COLUMNS)
        months = [r["m"] for r in fresh.select(month_of("ts").alias("m")).distinct().collect()]  # a row for each month
        if months:
            old = self.spark.table(self.table(grain)).where(F.col("month").isin(months)).select(COLUMNS)
            self.replace(grain, latest(old.unionByName(fresh), KEYS, "version"))

    def refresh(self, grain: str, fresh: DataFrame) -> None:
        """The buckets that new children touch, rolled up again from the stored child and folded in."""
        touched = fresh.select(*SERIES, bucket_start(F.col("ts"), grain).alias("b")).distinct()
        span = touched.agg(F.min("b").alias("a"), F.max("b").alias("z")).first()  # one row
        if span["a"] is None:
            return
        rows = self.read(CHILD[grain], F.lit(span["a"]), bucket_end(F.lit(span["z"]), grain))
        rows = rows.withColumn("b", bucket_start(F.col("ts"), grain)).join(touched, [*SERIES, "b"], "left_semi").drop("b")
        self.fold(grain, rollup(rows, grain))
