"""Tables in which the latest version of a key wins, and their upkeep."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CANDLE_KEYS = ["asset", "quote", "source", "ts"]


def latest(df: DataFrame, keys: list[str], version: str, ties: list[str] | None = None) -> DataFrame:
    """One row per key: that of the highest version, ties broken by the other columns.

    An aggregate rather than a window: versions are merged in each task before the shuffle.
    """
    rest = [c for c in df.columns if c not in keys]
    order = F.struct(version, *(ties or [c for c in rest if c != version]))
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("r")).select(*keys, "r.*").select(df.columns)


def merge_append(old: DataFrame, new: DataFrame, keys: list[str], version: str) -> DataFrame:
    """Old and new rows as one table; running it again changes nothing."""
    return latest(old.unionByName(new), keys, version)


def dedup_samples(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row per key of samples without a version, the smallest in the order of its columns."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("r")).select(*keys, "r.*").select(df.columns)


def write_candles(df: DataFrame, path: str, rows_per_file: int = 5_000_000) -> None:
    """By month of `ts`; months that are in the data replace those on disk, others stay.

    Each month is dealt to as many tasks as its rows ask for.
    """
    rows = df.withColumn("month", F.date_format("ts", "yyyy-MM"))
    sizes = {r["month"]: r["count"] for r in rows.groupBy("month").count().collect()}  # a row for each month
    files = {m: n // rows_per_file + 1 for m, n in sizes.items()}
    if not files:
        return
    number = F.create_map(*[F.lit(x) for kv in files.items() for x in kv])
    part = F.pmod(F.xxhash64("asset", "quote", "source", "ts"), F.element_at(number, F.col("month")))
    rows.repartition(sum(files.values()), "month", part).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("month").parquet(path)


def expire(df: DataFrame, interval: str, as_of: Column, ts: str = "ts") -> DataFrame:
    """Whole months that ended before `as_of - interval` go."""
    return df.where(F.date_trunc("month", ts) >= F.date_trunc("month", as_of - F.expr(f"interval {interval}")))


def delete_window(df: DataFrame, source: str, lo: Column, hi: Column) -> DataFrame:
    """Rows of a source from lo to before hi go, so that a re-roll cannot tie with them."""
    return df.where(~((F.col("source") == source) & (F.col("ts") >= lo) & (F.col("ts") < hi)))
