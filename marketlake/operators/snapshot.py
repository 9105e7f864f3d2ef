"""Current prices of all assets, robust across venues, with how each number came about."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketlake.functions.prices import PCT, ratio, rounding_bound, zero
from marketlake.operators.enrich import DOLLAR

#: Fixed values of the snapshot.
LIVE, WINDOW, FUNDED, BAND, MASK_VENUES, MOST_PCT = "2 hours", "24 hours", 100.0, 0.2, 3, 999_999.0
ORDER_BOOK = "sdex"


def _recent(c1m: DataFrame, as_of: Column, window: str = WINDOW) -> DataFrame:
    return c1m.where((F.col("ts") > as_of - F.expr(f"interval {window}")) & (F.col("ts") <= as_of))


def _tied(*more: str) -> Column:
    return F.struct("ts", *more, "volume_base", "source", "quote")


def _tip_sums() -> list[Column]:
    has = F.col("close_usd") > 0
    return [
        zero(F.max_by(F.when(has, F.col("close_usd")), F.when(has, _tied()))).alias("price_usd"),
        zero(F.min_by(F.when(has, F.col("close_usd")), F.when(has, _tied()))).alias("open_usd"),
        F.max(F.when(has, F.col("ts"))).alias("price_ts"),
        F.max(F.when(F.col("pf_trade_count") > 0, F.col("ts"))).alias("formed_ts"),
    ]


def tip(c1m: DataFrame, as_of: Column) -> DataFrame:
    """Latest and first priced close of the last day, before any venue is left out."""
    return _recent(c1m, as_of).groupBy("asset").agg(*_tip_sums())


def per_venue(c1m: DataFrame, as_of: Column) -> DataFrame:
    has = F.col("close_usd") > 0
    return (
        _recent(c1m, as_of)
        .groupBy("asset", "source")
        .agg(zero(F.max_by(F.when(has, F.col("close_usd")), F.when(has, _tied()))).alias("price"), (F.max("ts") > as_of - F.expr(f"interval {LIVE}")).alias("live"), F.sum("volume_quote_usd").alias("volume"))
        .where("price > 0")
    )


def _all_or_some(venues: DataFrame, good: Column) -> DataFrame:
    """Venues that are good, or all of an asset that has none."""
    some = F.max(good).over(Window.partitionBy("asset"))  # an asset has as many rows as venues
    return venues.withColumn("__any", some).where(good | ~F.col("__any")).drop("__any")


def funded_filter(venues: DataFrame, floor: float = FUNDED) -> DataFrame:
    return _all_or_some(venues, F.col("volume") > floor)


def liveness_filter(venues: DataFrame) -> DataFrame:
    return _all_or_some(venues, F.col("live"))


def median_mask(venues: DataFrame, band: float = BAND, min_n: int = MASK_VENUES) -> DataFrame:
    """With three venues or more, those within a fifth of the median."""
    w = Window.partitionBy("asset")
    rows = venues.withColumns({"__m": F.median("price").over(w), "__n": F.count("*").over(w)})
    return rows.where((F.col("__n") < min_n) | (F.abs(F.col("price") / F.col("__m") - 1) <= band)).drop("__m", "__n")


def consensus(venues: DataFrame) -> DataFrame:
    return median_mask(liveness_filter(funded_filter(venues)))


def _vwap() -> Column:
    return ratio(F.sum(F.col("price") * F.col("volume")), F.sum("volume")).alias("vwap_24h")


def _sources() -> Column:
    entry = F.struct("source", F.struct(F.round("price", 8).alias("price"), F.round("volume", 4).alias("volume_24h")).alias("v"))
    return F.to_json(F.map_from_entries(F.array_sort(F.collect_list(entry)))).alias("sources")


def vwap_24h(venues: DataFrame) -> DataFrame:
    return venues.groupBy("asset").agg(_vwap())


def sources_json(venues: DataFrame) -> DataFrame:
    """{venue: {price, volume_24h}} in the order of the names; an asset has as many entries as venues."""
    return venues.groupBy("asset").agg(_sources())


def price_xlm(tips: DataFrame) -> DataFrame:
    xlm = tips.where("asset = 'XLM'").select(F.col("price_usd").alias("xlm"))  # one row at most
    return tips.join(F.broadcast(xlm), how="left").select("asset", ratio(F.col("price_usd"), F.coalesce("xlm", F.lit(0.0))).alias("price_xlm"))


def clamp_pct(c: Column) -> Column:
    return F.least(F.greatest(c, F.lit(-MOST_PCT)), F.lit(MOST_PCT)).cast(PCT)


def changes(tips: DataFrame, c1h: DataFrame, as_of: Column) -> DataFrame:
    """Change since the first priced close of the day, and since the oldest hourly one between 7 and 5 days ago."""
    old = c1h.where((F.col("close_usd") > 0) & (F.col("ts") >= as_of - F.expr("interval 7 days")) & (F.col("ts") <= as_of - F.expr("interval 5 days")))
    old = old.groupBy("asset").agg(F.min_by("close_usd", _tied()).alias("old"))
    pct = lambda base: F.when((base > 0) & (F.col("price_usd") > 0), clamp_pct((F.col("price_usd") / base - 1) * 100))
    return tips.join(old, "asset", "left").select("asset", pct(F.col("open_usd")).alias("change_24h_pct"), pct(F.col("old")).alias("change_7d_pct"))


def volume_both_legs(c1m: DataFrame, as_of: Column) -> DataFrame:
    rows = _recent(c1m, as_of)
    legs = rows.select("asset", "volume_quote_usd").unionByName(rows.select(F.col("quote").alias("asset"), "volume_quote_usd"))
    return legs.groupBy("asset").agg(F.sum("volume_quote_usd").alias("volume_24h_usd"))


def market_cap(tips: DataFrame, supply: DataFrame) -> DataFrame:
    cap = (F.col("price_usd") * F.col("supply")).try_cast("decimal(38,14)")
    return tips.join(supply, "asset", "left").select("asset", F.coalesce(cap, F.lit(0)).cast("double").alias("market_cap"))


def rate_tip(tips: DataFrame, usd_rate: DataFrame, as_of: Column) -> DataFrame:
    """The dollar coin from its latest measured rate of the day, if it has no candle of its own."""
    r = usd_rate.where((F.col("method") == "oracle") & (F.col("asset") == DOLLAR) & (F.col("ts") <= as_of) & (F.col("ts") > as_of - F.expr(f"interval {WINDOW}")))
    one = r.groupBy("asset").agg(F.max_by("rate", "ts").alias("price_usd"), F.max("ts").alias("price_ts"))
    one = one.join(tips, "asset", "left_anti").select("asset", "price_usd", F.lit(0.0).alias("open_usd"), "price_ts", F.col("price_ts").alias("formed_ts"), F.lit("oracle").alias("method"))
    return tips.withColumn("method", F.when(F.col("price_usd") > 0, "traded").otherwise("")).unionByName(one)


def price_status() -> Column:
    """Carried: a newer candle formed price but has no USD value."""
    return F.when(F.col("price_usd") <= 0, "unpriced").when(F.col("price_ts") < F.col("formed_ts"), "carried").otherwise("priced")


def _basis() -> Column:
    units = lambda c: F.floor(F.col(c).cast("double") * 1e7 + 0.5)
    single = (F.col("trade_count") == 1) & ~rounding_bound(units("volume_base"), units("volume_quote"))
    one = (F.col("trade_count") > 1) & (F.col("pf_trade_count") == 1) & ~rounding_bound(units("pf_volume"), units("pf_price_volume") + 1)
    many = (F.col("pf_trade_count") > 1) & ((units("pf_volume") <= 1000) | (units("pf_price_volume") <= 1000))
    confirms = (F.col("source") != ORDER_BOOK) | ~(single | one | many)
    most = F.max(F.when(F.col("pf_trade_count") > 0, confirms))
    return F.when(most, "trades").when(~most, "offer_dust").alias("price_basis")


def price_basis(c1m: DataFrame, as_of: Column) -> DataFrame:
    """Trades, unless no candle of the day confirms that amounts large enough to imply a price were traded."""
    return _recent(c1m, as_of).where(F.col("pf_trade_count") > 0).groupBy("asset").agg(_basis())


def needed(c1m: DataFrame, as_of: Column) -> DataFrame:
    """What a snapshot reads of the minutes, and the day before it that their valuation looks back to."""
    return c1m.where((F.col("ts") >= as_of - F.expr("interval 9 days")) & (F.col("ts") <= as_of))


def current_prices(c1m: DataFrame, c1h: DataFrame, supply: DataFrame, usd_rate: DataFrame, as_of: Column) -> DataFrame:
    """One row per asset with everything above: one aggregate of the day by asset, one by venue, and one by leg."""
    both = _recent(c1m, as_of).groupBy("asset").agg(*_tip_sums(), _basis())
    basis = both.select("asset", "price_basis")
    tips = rate_tip(both.drop("price_basis"), usd_rate, as_of)
    venues = consensus(per_venue(c1m, as_of)).groupBy("asset").agg(_vwap(), _sources())
    out = tips.withColumn("price_status", price_status()).withColumn("as_of", F.coalesce("price_ts", F.timestamp_seconds(F.lit(0))))
    for part in (venues, basis, price_xlm(tips), changes(tips, c1h, as_of), volume_both_legs(c1m, as_of), market_cap(tips, supply)):
        out = out.join(part, "asset", "left")
    return out.fillna(0.0, ["vwap_24h", "volume_24h_usd"]).fillna("{}", ["sources"]).fillna("trades", ["price_basis"])


def attainable(venues: str) -> Column:
    """The averages of an array of venues (source, closes, volume) for every choice of one close each.

    Folds one venue after the other into the sums so far; equal sums are one, so venues without ties add none.
    """
    sums = F.aggregate(venues, F.array(F.lit(0.0)), lambda s, v: F.array_distinct(F.flatten(F.transform(s, lambda x: F.transform(v["closes"], lambda c: x + c.cast("double") * v["volume"].cast("double"))))))
    total = F.aggregate(venues, F.lit(0.0), lambda s, v: s + v["volume"].cast("double"))
    return F.transform(sums, lambda x: F.coalesce(F.try_divide(x, F.nullif(total, F.lit(0.0))), F.lit(0.0)))


def recompute_snapshot(c1m: DataFrame, snapshot: DataFrame, as_of: Column, tolerance: float = 1e-9) -> DataFrame:
    """A verdict for each field of each asset, from the candles of the day.

    Where closes tie at a venue's latest time, whichever was taken is right: a price must be one of those at the
    asset's latest time, and the average that of some choice of one tied close for each of its venues.
    Venues are those that the guards and the mask leave, by name.
    """
    day = _recent(c1m, as_of)
    rows = day.where("close_usd > 0")
    last = rows.groupBy("asset").agg(F.max("ts").alias("ts"))
    ties = rows.join(last, ["asset", "ts"]).groupBy("asset").agg(F.collect_set("close_usd").alias("ties"))
    at_venue = rows.groupBy("asset", "source").agg(F.max("ts").alias("ts"))
    tied = rows.join(at_venue, ["asset", "source", "ts"]).groupBy("asset", "source").agg(F.array_sort(F.collect_set("close_usd")).alias("closes"))
    kept = consensus(per_venue(c1m, as_of)).join(tied, ["asset", "source"]).select("asset", "source", F.struct("source", "closes", "volume").alias("venue"))
    venues = kept.groupBy("asset").agg(F.array_sort(F.collect_list("venue")).alias("venues")).withColumns({"averages": attainable("venues"), "names": F.transform("venues", lambda v: v["source"])})
    found = snapshot.join(ties, "asset", "left").join(venues, "asset", "left").join(volume_both_legs(c1m, as_of).withColumnRenamed("volume_24h_usd", "volume"), "asset", "left")
    near = lambda a, b: F.abs(a - b) <= tolerance * F.greatest(F.abs(b), F.lit(1e-12))
    verdict = lambda known, good: F.when(~known, "no candle").when(good, "match").otherwise("mismatch")
    listed = F.array_sort(F.map_keys(F.from_json("sources", "map<string,string>")))
    return found.select(
        "asset",
        "price_usd",
        verdict(F.col("ties").isNotNull(), F.exists("ties", lambda x: near(F.col("price_usd"), x))).alias("price_verdict"),
        verdict(F.col("volume").isNotNull(), near(F.col("volume_24h_usd"), F.col("volume"))).alias("volume_verdict"),
        verdict(F.col("names").isNotNull(), listed == F.col("names")).alias("venues_verdict"),
        verdict(F.col("names").isNotNull(), F.exists("averages", lambda x: near(F.col("vwap_24h"), x))).alias("vwap_verdict"),
    )
