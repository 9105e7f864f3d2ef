"""USD series by natural identity, how much of the volume they stand on, and the current-price view."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketlake.functions.prices import PRICE_FLOOR
from marketlake.functions.timebucket import bucket_start
from marketlake.operators.enrich import DOLLAR

REFERENCES = ("USDC", "XLM", "USDT")
MIN_SHARE = 0.5


def natural_key(assets: DataFrame) -> DataFrame:
    kind = F.when((F.col("issuer") == "") & (F.col("contract") == ""), "native").when(F.col("issuer") != "", "credit").otherwise("contract")
    return assets.select("asset", kind.alias("natural_kind"), F.concat_ws(":", kind, "asset", "issuer", F.when(kind == "contract", F.col("contract")).otherwise("")).alias("natural_key"))


def usd_reference(candles: DataFrame) -> DataFrame:
    """What XLM cost in the dollar coin, weighted by price-forming volume."""
    w = F.col("pf_volume").cast("double")
    rows = candles.where((F.col("asset") == "XLM") & (F.col("quote") == DOLLAR) & (F.col("pf_volume") > 0) & (F.col("close") >= PRICE_FLOOR))
    return rows.groupBy("ts").agg((F.sum(F.col("close") * w) / F.sum(w)).alias("reference"))


def eligible_quotes(usd_rate: DataFrame) -> DataFrame:
    fixed = usd_rate.sparkSession.createDataFrame([(a,) for a in REFERENCES], "quote string")
    return fixed.unionByName(usd_rate.select(F.col("asset").alias("quote"))).distinct()


def priced() -> Column:
    return (F.col("close") >= PRICE_FLOOR) & (F.col("close_usd") >= PRICE_FLOOR) & (F.col("pf_volume") > 0) & ((F.col("quote") == DOLLAR) | (F.col("close_usd") != F.col("close")))


def peg_rows(candles: DataFrame, usd_rate: DataFrame, grain: str) -> DataFrame:
    """One row per bucket for the dollar coin: the bucket's best rate (measured before imported, then latest), else 1."""
    best = usd_rate.where(F.col("asset") == DOLLAR).groupBy(bucket_start(F.col("ts"), grain).alias("ts")).agg(F.max_by(F.struct("rate", "method"), F.struct((F.col("method") == "oracle").alias("measured"), "ts")).alias("b"))
    buckets = candles.where(F.col("quote") == DOLLAR).select("ts").distinct()
    return buckets.join(best, "ts", "left").select("ts", F.coalesce("b.rate", F.lit(1.0)).alias("peg"), F.coalesce("b.method", F.lit("peg")).alias("peg_method"))


def _weighed(candles: DataFrame, usd_rate: DataFrame, grain: str) -> DataFrame:
    eligible = eligible_quotes(usd_rate).withColumn("eligible", F.lit(True))
    rows = candles.join(eligible, "quote", "left").withColumn("w", F.col("pf_volume").cast("double"))
    sums = rows.groupBy("asset", "ts").agg(
        F.sum(F.when(priced(), F.col("w")).otherwise(0.0)).alias("rpw"),
        F.sum(F.when(priced() | F.col("eligible"), F.col("w")).otherwise(0.0)).alias("rew"),
        F.sum(F.when(priced(), F.col("close_usd") * F.col("w")).otherwise(0.0)).alias("rpv"),
        F.sum(F.when(priced(), F.col("volume_quote_usd")).otherwise(0.0)).alias("usd"),
    )
    peg = peg_rows(candles, usd_rate, grain).withColumn("asset", F.lit(DOLLAR))
    return sums.join(peg, ["asset", "ts"], "full").fillna(0.0, ["rpw", "rew", "rpv", "usd"])


def price_usd_series(candles: DataFrame, usd_rate: DataFrame, grain: str, min_share: float = MIN_SHARE) -> DataFrame:
    """USD close by identity and bucket where half of the volume at least is priced; the dollar coin has its peg."""
    rows = _weighed(candles, usd_rate, grain)
    pegged = F.col("peg").isNotNull() & (F.col("rpw") == 0)
    share = F.try_divide(F.col("rpw"), F.col("rew"))
    kept = rows.where(pegged | ((F.col("rew") > 0) & (F.col("rpw") > 0) & (share >= min_share)))
    return kept.select("asset", "ts", F.when(pegged, F.col("peg")).otherwise(F.col("rpv") / F.col("rpw")).alias("close_usd"), F.when(pegged, F.col("peg_method")).otherwise("traded").alias("method"), F.when(pegged, 1.0).otherwise(share).cast("decimal(10,6)").alias("priced_volume_share"))


def usd_coverage(candles: DataFrame, usd_rate: DataFrame, grain: str, min_share: float = MIN_SHARE) -> DataFrame:
    """The same without the filter: priced, pending, or without any eligible volume."""
    rows = _weighed(candles, usd_rate, grain)
    share = F.try_divide(F.col("rpw"), F.col("rew"))
    status = F.when(F.col("peg").isNotNull() & (F.col("rpw") == 0), "priced").when(F.col("rew") == 0, "unpriceable").when(share >= min_share, "priced").otherwise("pending")
    return rows.select("asset", "ts", F.coalesce(share, F.lit(0.0)).cast("decimal(10,6)").alias("share"), F.col("usd").alias("priced_usd"), status.alias("status"))


def identity_by_contract(assets: DataFrame) -> DataFrame:
    """Contracts of tokens and wrappers, with the identity that each stands for."""
    own = assets.where("kind = 'contract' and contract <> ''").select("contract", "asset", F.lit("token").alias("via"))
    return own.unionByName(assets.where("kind <> 'contract' and contract <> ''").select("contract", "asset", F.lit("wrapper").alias("via")))


def current_price_usd(snapshot: DataFrame, assets: DataFrame) -> DataFrame:
    """The snapshot by natural identity; a price of 0 is none."""
    return snapshot.join(natural_key(assets), "asset").select("natural_key", F.when(F.col("price_usd") > 0, F.col("price_usd")).alias("price_usd"), "method", "price_status")
