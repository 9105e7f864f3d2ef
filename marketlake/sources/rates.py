"""Imported and measured USD rates: loading with checks, promotion, and snapshots of readings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Fixed values of the contract of imported rates.
HEADER = ("ts", "open", "high", "low", "close", "n_obs", "source", "quality", "xcheck_spread_bps", "xcheck_sources")
SOURCES, QUALITIES = ("coingecko", "kraken", "binance", "coinbase", "bitstamp"), ("measured", "measured-disputed", "fallback")
BAND, MOST_PLACES, FLOOR = (0.5, 1.5), 14, 1_577_836_800


def read_rates(spark: SparkSession, path: str) -> DataFrame:
    """The file as text columns; a wrong header fails."""
    df = spark.read.option("header", True).option("enforceSchema", False).csv(path)
    if tuple(df.columns) != HEADER:
        raise ValueError(f"header {df.columns}, expected {list(HEADER)}")
    return df


def load_rates(raw: DataFrame, grain_seconds: int, epoch: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(accepted, rejected with reasons, counts by era, source and quality)."""
    ts, close = F.col("ts").try_cast("timestamp"), F.col("close").try_cast("double")
    copies = F.count("*").over(Window.partitionBy("ts"))
    places = F.length(F.regexp_extract("close", r"\.([0-9]*)$", 1))
    rules = {
        "bad time": ts.isNull(),
        "off the bucket": F.unix_timestamp(ts) % grain_seconds != 0,
        "repeated time": copies > 1,
        "not positive": close.isNull() | (close <= 0),
        "too many places": places > MOST_PLACES,
        "out of band": ~close.between(*BAND),
        "unknown source": ~F.coalesce(F.col("source").isin(*SOURCES), F.lit(False)),
        "unknown quality": ~F.coalesce(F.col("quality").isin(*QUALITIES), F.lit(False)),
    }
    rows = raw.withColumn("reasons", F.array_compact(F.array(*[F.when(c, name) for name, c in rules.items()])))
    era = F.when(F.unix_timestamp(ts) < epoch, "before").otherwise("after")
    good = rows.where(F.size("reasons") == 0).select(ts.alias("ts"), close.alias("rate"), "source", "quality", era.alias("era"))
    return good, rows.where(F.size("reasons") > 0), good.groupBy("era", "source", "quality").agg(F.count("*").alias("rates"))


def promote_rates(usd_rate: DataFrame, shadow: str, promoted: str, epoch: int, version: int) -> DataFrame:
    """Staged rates before the epoch once more, under the method that readers use; nothing is moved."""
    return usd_rate.unionByName(usd_rate.where((F.col("method") == shadow) & (F.unix_timestamp("ts") < epoch)).withColumns({"method": F.lit(promoted), "version": F.lit(version).cast("long")}))


def snapshot_rates(oracle: DataFrame, usd_rate: DataFrame, assets: DataFrame, asset: str, version: int) -> DataFrame:
    """Readings not yet stored with their value; a value corrected later comes again and wins by version.

    Nothing is copied unless the identity names exactly one asset.
    """
    one = assets.where(F.col("asset") == asset).agg((F.count("*") == 1).alias("ok"))
    new = oracle.where((F.col("asset") == asset) & (F.col("price") > 0) & (F.unix_timestamp("ts") >= FLOOR)).select("asset", "ts", F.col("price").alias("rate"))
    stored = usd_rate.where("method = 'oracle'").select("asset", "ts", "rate")
    return new.join(stored, ["asset", "ts", "rate"], "left_anti").join(F.broadcast(one), how="cross").where("ok").select("asset", "ts", F.lit("oracle").alias("method"), "rate", F.lit("measured").alias("quality"), F.lit(version).cast("long").alias("version"))
