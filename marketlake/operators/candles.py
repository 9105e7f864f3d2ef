"""Fills to one-minute candles, and candles to coarser ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketlake.functions.prices import PRICE_CEILING, PRICE_FLOOR, STORED, STORED_CEILING, gated, ratio, zero
from marketlake.functions.timebucket import CHILD, bucket_end, bucket_start
from marketlake.sources.versioned import delete_window, merge_append

KEYS = ["asset", "quote", "source", "ts"]
ORDER = ("ledger", "tx", "op", "claim", "price", "volume_base", "volume_quote")
#: The stored columns of a candle.
COLUMNS = ["ts", "asset", "quote", "source", "open", "high", "low", "close", "volume_base", "volume_quote", "volume_quote_usd", "close_usd", "vwap", "trade_count", "version", "pf_trade_count", "pf_volume", "pf_price_volume"]
#: How a ledger and an operation make a version.
LEDGER_STEP = 1000
RECONCILE_DAYS, RECONCILE_GRACE = 7, "2 hours"


def _only(condition: Column, c: Column | str) -> Column:
    return F.when(condition, F.col(c) if isinstance(c, str) else c)


def clamp(c: Column) -> Column:
    return F.least(F.greatest(c, F.lit(-PRICE_CEILING)), F.lit(PRICE_CEILING))


def saturated(c: Column) -> Column:
    """The sum of a volume at its stored scale; what is beyond its range is the largest value that can be stored."""
    most = F.lit(STORED_CEILING).cast(STORED)
    exact = F.try_sum(c).cast(STORED)
    return F.when(F.count(c) == 0, F.lit(None)).otherwise(F.coalesce(exact, most))


def minute_aggregates() -> list[Column]:
    """What a candle holds of its fills; in one place, as streams build the same candles."""
    forming, order = F.col("price_forming"), F.struct(*ORDER)
    return [
        zero(F.min_by(F.when(forming, F.col("price")), F.when(forming, order))).alias("open"),
        zero(F.max(_only(forming, "price"))).alias("high"),
        zero(F.min(_only(forming, "price"))).alias("low"),
        zero(F.max_by(F.when(forming, F.col("price")), F.when(forming, order))).alias("close"),
        saturated(F.col("volume_base")).alias("volume_base"),
        saturated(F.col("volume_quote")).alias("volume_quote"),
        F.count("*").alias("trade_count"),
        F.max(F.col("ledger") * LEDGER_STEP + F.col("op")).alias("version"),
        F.count_if(forming).alias("pf_trade_count"),
        F.coalesce(saturated(_only(forming, "volume_base")), F.lit(0)).alias("pf_volume"),
        zero(F.sum(_only(forming, F.col("price") * F.col("volume_base").cast("double")))).alias("pf_price_volume"),
    ]


def _finished(rows: DataFrame) -> DataFrame:
    raw = F.greatest(F.abs(F.col("pf_price_volume")), F.col("high"))
    return rows.withColumns({"vwap": ratio(F.col("volume_quote"), F.col("volume_base")), "volume_quote_usd": F.lit(0.0), "close_usd": F.lit(0.0), "clamped": (raw > PRICE_CEILING) | (F.greatest("volume_base", "volume_quote", "pf_volume") >= F.lit(STORED_CEILING).cast(STORED)), "pf_price_volume": clamp(F.col("pf_price_volume"))})


def candles_1m(fills: DataFrame) -> DataFrame:
    """One candle per minute, pair and venue.  Prices come from price-forming fills, sums from all; 0 is no price.

    Fills are dealt by candle before they are sorted: once, in tasks of a share of all candles, whatever the size of the
    input's splits.  A candle is a minute of one pair and venue, so its fills fit a task.  Time is the first key, as it
    tells most rows apart.
    """
    rows = fills.withColumnsRenamed({"base": "asset"}).withColumn("ts", bucket_start(F.col("closed_at"), "1m")).repartition("ts", "asset", "quote", "source")
    rows = rows.groupBy("ts", "asset", "quote", "source").agg(*minute_aggregates())
    return _finished(rows).select(*COLUMNS, "clamped")


def rollup(child: DataFrame, grain: str, keys: tuple[str, ...] = ("asset", "quote", "source")) -> DataFrame:
    """A coarser tier: gated children lend prices, all lend sums, versions add up so that a fuller roll-up wins."""
    gate, ts = gated(F.col("close"), F.col("pf_trade_count")), F.col("ts")
    rated = (F.col("close_usd") >= PRICE_FLOOR) & (F.col("close") >= PRICE_FLOOR)
    rows = child.groupBy(*keys, bucket_start(ts, grain).alias("ts")).agg(
        zero(F.min_by(_only(gate, "open"), _only(gate, "ts"))).alias("open"),
        zero(F.max(_only(gate, "high"))).alias("high"),
        zero(F.min(_only(gate, "low"))).alias("low"),
        zero(F.max_by(_only(gate, "close"), _only(gate, "ts"))).alias("close"),
        *[saturated(F.col(c)).alias(c) for c in ("volume_base", "volume_quote", "pf_volume")],
        *[F.sum(c).alias(c) for c in ("volume_quote_usd", "trade_count", "version", "pf_trade_count", "pf_price_volume")],
        F.max_by(_only(rated, F.col("close_usd") / F.col("close")), _only(rated, "ts")).alias("rate"),
    )
    usd = F.col("close") * F.col("rate")
    return rows.withColumns({"close_usd": F.when(usd <= PRICE_CEILING, usd).otherwise(0.0), "vwap": ratio(F.col("volume_quote"), F.col("volume_base"))}).select(COLUMNS)


def rollup_all(c1m: DataFrame) -> dict[str, DataFrame]:
    """Every tier, each from the one that it is made of."""
    tiers = {"1m": c1m}
    for grain, child in CHILD.items():
        tiers[grain] = rollup(tiers[child], grain)
    return tiers


def refresh(child: DataFrame, grain: str, lower: Column) -> DataFrame:
    """Only buckets from a bucket-aligned bound on."""
    return rollup(child.where(F.col("ts") >= lower), grain)


def reconcile(child: DataFrame, target: DataFrame, grain: str, as_of: Column) -> DataFrame:
    """Closed buckets of the last days whose key, count or volume the target lacks, rolled up again."""
    again = refresh(child, grain, bucket_start(as_of - F.expr(f"interval {RECONCILE_DAYS} days"), grain))
    closed = again.where(bucket_end(F.col("ts"), grain) <= as_of - F.expr(f"interval {RECONCILE_GRACE}"))
    return closed.join(target.select(*KEYS, "trade_count", "volume_base"), [*KEYS, "trade_count", "volume_base"], "left_anti").select(COLUMNS)


def mismatch_count(child: DataFrame, target: DataFrame, grain: str, as_of: Column) -> DataFrame:
    return reconcile(child, target, grain, as_of).agg(F.lit(grain).alias("tier"), F.count("*").alias("mismatched"))


def preroll(child: DataFrame, grain: str, lo: Column | None = None, hi: Column | None = None) -> DataFrame:
    """The whole history, a range, or all before a boundary."""
    rows = child
    if lo is not None:
        rows = rows.where(F.col("ts") >= lo)
    if hi is not None:
        rows = rows.where(F.col("ts") < hi)
    return rollup(rows, grain)


def reroll_sources(target: DataFrame, child: DataFrame, grain: str, sources: list[str], lo: Column, hi: Column) -> DataFrame:
    """The target with the buckets of some venues made anew; theirs are deleted first, so that versions cannot tie."""
    kept = target
    for s in sources:
        kept = delete_window(kept, s, lo, hi)
    return merge_append(kept, preroll(child.where(F.col("source").isin(sources)), grain, lo, hi), KEYS, "version")


def gap_totals(child: DataFrame, target: DataFrame, lo: Column, hi: Column) -> DataFrame:
    """Do counts and volumes of a range agree between a tier and what it is made of?"""
    inside = (F.col("ts") >= lo) & (F.col("ts") < hi)
    total = lambda df, p: df.where(inside).agg(F.sum("trade_count").alias(f"{p}_count"), F.sum("volume_base").alias(f"{p}_volume"))
    return total(child, "child").crossJoin(F.broadcast(total(target, "target"))).withColumn("equal", F.col("child_count").eqNullSafe(F.col("target_count")) & F.col("child_volume").eqNullSafe(F.col("target_volume")))


def gap_mismatch(child: DataFrame, target: DataFrame, grain: str, lo: Column, hi: Column) -> DataFrame:
    """Buckets that one side lacks or that count differently."""
    inside = (F.col("ts") >= lo) & (F.col("ts") < hi)
    want = child.where(inside).groupBy("asset", "quote", "source", bucket_start(F.col("ts"), grain).alias("ts")).agg(F.sum("trade_count").alias("child_count"))
    have = target.where(inside).select(*KEYS, F.col("trade_count").alias("target_count"))
    return want.join(have, KEYS, "full").where(~F.col("child_count").eqNullSafe(F.col("target_count")))


def month_equal(c1m: DataFrame, c1d: DataFrame) -> DataFrame:
    """Trade counts of each month by the finest and by the daily tier."""
    of = lambda df, name: df.groupBy(F.date_format("ts", "yyyy-MM").alias("month")).agg(F.sum("trade_count").alias(name))
    return of(c1m, "count_1m").join(of(c1d, "count_1d"), "month", "full").withColumn("equal", F.col("count_1m").eqNullSafe(F.col("count_1d")))
