"""Data-quality checks and analyses of candles, rates and request logs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketlake.functions.prices import PRICE_FLOOR
from marketlake.operators.ranks import quantiles
from marketlake.sources.stored import stored

PEG_TOLERANCE, REPRESENTABLE = 0.02, 5e-14
EMPTY_LAG = 10**9


def _every(tiers: dict[str, DataFrame], columns: list[str]) -> DataFrame:
    return reduce(DataFrame.unionByName, [df.select(F.lit(name).alias("tier"), *columns) for name, df in tiers.items()])


def tier_lag(tiers: dict[str, DataFrame], as_of: Column) -> DataFrame:
    """Seconds since the newest bucket of each tier, given from fine to coarse.

    An empty tier has a sentinel if a coarser one is populated, since data flow from fine to coarse; else no row.
    """
    last = reduce(DataFrame.unionByName, [df.agg(F.lit(name).alias("tier"), F.lit(i).alias("place"), F.max("ts").alias("last")) for i, (name, df) in enumerate(tiers.items())])
    coarsest = F.max(F.when(F.col("last").isNotNull(), F.col("place"))).over(Window.partitionBy(F.lit(1)))  # a row for each tier
    rows = last.withColumn("coarsest", coarsest).where("last is not null or place < coarsest")
    return rows.select("tier", F.coalesce(F.unix_timestamp(as_of) - F.unix_timestamp("last"), F.lit(EMPTY_LAG)).alias("lag_seconds"))


def snapshot_lag(snapshot: DataFrame, updated: str, as_of: Column) -> DataFrame:
    """Seconds since the newest row of the snapshot; none for an empty one."""
    return snapshot.agg(F.max(updated).alias("last")).where("last is not null").select(F.lit("snapshot").alias("tier"), (F.unix_timestamp(as_of) - F.unix_timestamp("last")).alias("lag_seconds"))


def ohlc_band(tiers: dict[str, DataFrame]) -> DataFrame:
    rows = _every(tiers, ["open", "high", "low", "close", "pf_trade_count"]).withColumn("pf", F.col("pf_trade_count") > 0)
    bad = lambda c: F.count_if(F.col("pf") & c)
    return rows.groupBy("tier").agg(
        F.count("*").alias("scanned"),
        bad(F.col("low") > F.least("open", "close")).alias("low_above"),
        bad(F.col("high") < F.greatest("open", "close")).alias("high_below"),
        bad(F.col("low") > F.col("high")).alias("crossed"),
        bad((F.col("open") <= 0) | (F.col("close") <= 0)).alias("not_positive"),
    )


def zero_invariants(c1m: DataFrame) -> DataFrame:
    """A sentinel price beside price-forming trades, a price without any, and a USD price without a close."""
    none = F.col("pf_trade_count") == 0
    return c1m.agg(F.count_if(~none & (F.col("close") == 0)).alias("formed_without_price"), F.count_if(none & (F.col("close") > 0)).alias("price_without_forming"), F.count_if((F.col("close_usd") > 0) & (F.col("close") == 0)).alias("usd_without_close"))


def stranded(c1h: DataFrame, leg: str, as_of: Column, look_back: str = "7 days", grace: str = "2 days") -> DataFrame:
    inside = (F.col("ts") >= as_of - F.expr(f"interval {look_back}")) & (F.col("ts") < as_of - F.expr(f"interval {grace}")) & (F.col("quote") == leg)
    return c1h.where(inside).agg(F.count("*").alias("scanned"), F.count_if((F.col("close_usd") == 0) & (F.col("close") >= REPRESENTABLE) & (F.col("pf_trade_count") > 0)).alias("stranded"))


def peg_applied(c1m: DataFrame, leg: str, tolerance: float = PEG_TOLERANCE) -> DataFrame:
    """Candles of a leg that must not be pegged but look as if they were."""
    return c1m.where((F.col("quote") == leg) & (F.col("close_usd") > 0)).agg(F.count("*").alias("scanned"), F.count_if(F.abs(F.try_divide("close_usd", "close") - 1) < tolerance).alias("pegged"))


def peg_applied_to(c1m: DataFrame, legs: DataFrame, tolerance: float = PEG_TOLERANCE) -> DataFrame:
    """The same for each of some legs (quote, resolved): `resolved` identities answer to its ticker."""
    looks = F.count_if(F.abs(F.try_divide("close_usd", "close") - 1) < tolerance)
    seen = c1m.where("close_usd > 0").groupBy("quote").agg(F.count("*").alias("scanned"), looks.alias("pegged"))
    return legs.join(seen, "quote", "left").select("quote", "resolved", F.coalesce("scanned", F.lit(0)).alias("scanned"), F.coalesce("pegged", F.lit(0)).alias("pegged"))


def guarded(check: DataFrame, scanned: str = "scanned", resolved: str | None = None) -> DataFrame:
    """A check over nothing, or of a leg that is not exactly one identity, is refused, which is not the same as 0."""
    status = F.when(F.col(scanned) > 0, "ok").otherwise("refused: nothing scanned")
    if resolved:
        status = F.when(F.col(resolved) != 1, "refused: leg is not one identity").otherwise(status)
    return check.withColumn("status", status)


def id_collisions(assets: DataFrame, key: str) -> DataFrame:
    return assets.agg((F.count("*") - F.count_distinct(key)).alias("collisions"))


def orphan_candles(c1m: DataFrame, assets: DataFrame) -> DataFrame:
    ids = assets.select(F.col("asset").alias("id"), F.lit(True).alias("here"))
    rows = c1m.join(ids.withColumnsRenamed({"id": "asset", "here": "has_asset"}), "asset", "left").join(ids.withColumnsRenamed({"id": "quote", "here": "has_quote"}), "quote", "left")
    missing = F.when(F.col("has_asset").isNull(), F.col("asset")).otherwise(F.col("quote"))
    return rows.where("has_asset is null or has_quote is null").groupBy(missing.alias("missing")).agg(F.count("*").alias("candles"))


def wrapper_identities(assets: DataFrame, wrappers: DataFrame) -> DataFrame:
    """Contract identities of contracts that are wrappers of something else."""
    return assets.where("kind = 'contract'").join(wrappers.select("contract"), "contract", "left_semi")


def _merged_gaps(segments: Column) -> Column:
    """One segment (first, last, gap) of several in order: the gaps inside them, and those from each to the next."""
    between = F.zip_with(F.slice(segments, 2, F.size(segments)), F.slice(segments, 1, F.size(segments) - 1), lambda b, a: b["first"] - a["last"])
    gap = F.array_max(F.concat(F.transform(segments, lambda s: s["gap"]), between))
    return F.struct(F.element_at(segments, 1)["first"].alias("first"), F.element_at(segments, -1)["last"].alias("last"), gap.alias("gap"))


def largest_gap(c1m: DataFrame) -> DataFrame:
    """The longest time between neighbouring minutes of an asset at a venue.

    Segments of days are merged to months and these to the whole, so that a task holds the minutes of a day, the days
    of a month or the months of a series, and never a series.
    """
    second = F.unix_timestamp("ts")
    keys = ["asset", "source"]
    rows = c1m.select(*keys, F.to_date("ts").alias("day"), F.struct(second.alias("first"), second.alias("last"), F.lit(0).cast("long").alias("gap")).alias("s"))
    days = rows.groupBy(*keys, "day").agg(_merged_gaps(F.array_sort(F.collect_set("s"))).alias("s"))
    months = days.groupBy(*keys, F.trunc("day", "month").alias("month")).agg(_merged_gaps(F.array_sort(F.collect_list("s"))).alias("s"))
    whole = months.groupBy(*keys).agg(_merged_gaps(F.array_sort(F.collect_list("s"))).alias("s"))
    return whole.select(*keys, (F.col("s.gap") / 60).alias("gap_minutes"))


def canonical_ticker(candles: DataFrame, assets: DataFrame) -> DataFrame:
    """Of identities (asset_id, asset, issuer) with one ticker the one with most candles (asset_id)."""
    busy = candles.groupBy("asset_id").agg(F.count("*").alias("candles"))
    return assets.join(busy, "asset_id").groupBy(F.col("asset").alias("ticker")).agg(F.max_by("issuer", F.struct("candles", "issuer")).alias("issuer"), F.max("candles").alias("candles"))


def venue_coverage(c1d: DataFrame) -> DataFrame:
    return c1d.groupBy("source").agg(F.count("*").alias("candles"), F.count_distinct("asset").alias("assets"), F.min("ts").alias("earliest"), F.max("ts").alias("latest"), (F.datediff(F.max("ts"), F.min("ts")) + 1).alias("days"))


def month_completeness(c1d: DataFrame) -> DataFrame:
    return c1d.groupBy(F.date_format("ts", "yyyy-MM").alias("month")).agg(F.count_distinct(F.to_date("ts")).alias("days"), F.count("*").alias("candles"), F.count_distinct("asset").alias("assets"))


def recently_priced(c1m: DataFrame, as_of: Column, k: int = 20) -> DataFrame:
    rows = c1m.where((F.col("ts") > as_of - F.expr("interval 24 hours")) & (F.col("close_usd") > 0))
    return rows.groupBy("asset").agg(F.count("*").alias("candles"), F.max("ts").alias("last")).where("candles >= 2").orderBy(F.desc("candles"), "asset").limit(k)


def _numbered(daily: DataFrame, slot: Column) -> DataFrame:
    """The place of each row in its series (`at`, from 0): its place in its slot behind the rows of the slots before."""
    within = Window.partitionBy("series", "slot").orderBy("day")
    rows = daily.withColumn("slot", slot).withColumn("n", F.row_number().over(within))
    earlier = Window.partitionBy("series").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    # A row for each slot of a series.
    sizes = rows.groupBy("series", "slot").agg(F.count("*").alias("rows")).withColumn("before", F.coalesce(F.sum("rows").over(earlier), F.lit(0))).drop("rows")
    return rows.join(sizes, ["series", "slot"]).withColumn("at", F.col("before") + F.col("n") - 1).drop("slot", "n", "before")


def _longest_run(blocks: Column) -> Column:
    """The longest run over blocks (n, head, tail, prefix, suffix, best) in order; runs that meet where two blocks do are one."""
    start = F.struct(F.lit(0).cast("long").alias("best"), F.lit(0).cast("long").alias("suffix"), F.lit(None).cast("double").alias("tail"))

    def step(s: Column, b: Column) -> Column:
        joined = F.when(F.coalesce(s["tail"] == b["head"], F.lit(False)), s["suffix"]).otherwise(F.lit(0)) + b["prefix"]
        whole = b["prefix"] == b["n"]
        return F.struct(F.greatest(s["best"], joined, b["best"]).alias("best"), F.when(whole, joined).otherwise(b["suffix"]).alias("suffix"), b["tail"].alias("tail"))

    return F.aggregate(blocks, start, step)["best"]


def series_guardrails(daily: DataFrame, window: int = 30, peg: float = 1.0, block: int = 4096) -> DataFrame:
    """Per series (series, day, close, trades, volume): rolling shares of dead days, longest constant run, least volatility in bps.

    Series are cut into blocks of rows.  A block also gets the rows of the one before that its windows reach back to,
    and says of its runs how long the first, the last and the longest is, which is merged over the blocks.
    """
    block = max(block, window)
    rows = _numbered(daily.withColumn("close", F.col("close").cast("double")), F.year("day")).withColumn("own", F.floor(F.col("at") / block))
    late = F.col("at") % block >= block - window
    rows = rows.withColumn("b", F.explode(F.when(late, F.array("own", F.col("own") + 1)).otherwise(F.array("own"))))
    order = Window.partitionBy("series", "b").orderBy("at")
    roll = order.rowsBetween(-(window - 1), 0)
    mine = F.col("b") == F.col("own")
    rows = rows.withColumns({"prev": F.lag("close").over(order), "within": F.coalesce(F.lag(mine).over(order), F.lit(False))}).withColumn("flat", F.coalesce(F.col("close") == F.col("prev"), F.lit(False)))
    rows = rows.withColumns({"ret": F.ln(F.try_divide("close", "prev")), "island": F.sum(F.when(F.col("flat") & F.col("within"), 0).otherwise(1)).over(order)})
    share = lambda c: F.avg(F.when(c, 1.0).otherwise(0.0)).over(roll)
    rows = rows.withColumns(
        {
            "zero_trade": share(F.col("trades") == 0),
            "flat_no_trade": share(F.col("flat") & (F.col("trades") == 0)),
            "at_peg": share(F.col("close") == peg),
            "zero_volume": share(F.col("volume") == 0),
            "vol_bps": F.when(F.count("ret").over(roll) == window, F.stddev_samp("ret").over(roll) * 10_000),
        }
    ).where(mine)
    sums = [F.max(c).alias(f"max_{c}") for c in ("zero_trade", "flat_no_trade", "at_peg", "zero_volume")]
    each = rows.groupBy("series", "b", "island").agg(*sums, F.min("vol_bps").alias("min_vol_bps"), F.count("*").alias("rows"), F.min("at").alias("at"), F.min_by("close", "at").alias("head"), F.max_by("close", "at").alias("tail"))
    again = [F.max(f"max_{c}").alias(f"max_{c}") for c in ("zero_trade", "flat_no_trade", "at_peg", "zero_volume")]
    of = each.groupBy("series", "b").agg(*again, F.min("min_vol_bps").alias("min_vol_bps"), F.sum("rows").alias("n"), F.min_by("head", "at").alias("head"), F.max_by("tail", "at").alias("tail"), F.min_by("rows", "at").alias("prefix"), F.max_by("rows", "at").alias("suffix"), F.max("rows").alias("best"))
    parts = F.array_sort(F.collect_list(F.struct("b", "n", "head", "tail", "prefix", "suffix", "best")))
    return of.groupBy("series").agg(*again, F.min("min_vol_bps").alias("min_vol_bps"), _longest_run(parts).alias("longest_run"))


def rate_gap_bps(oracle: DataFrame, c1h: DataFrame, asset: str = "XLM", quote: str = "USDC") -> DataFrame:
    """Hourly readings against the asset's own market, in basis points."""
    read = oracle.where(F.col("asset") == asset).groupBy(F.date_trunc("hour", "ts").alias("ts")).agg(F.max_by("price", "ts").alias("price"))
    own = c1h.where((F.col("asset") == asset) & (F.col("quote") == quote) & (F.col("close") >= PRICE_FLOOR)).groupBy("ts").agg(F.max_by("close", F.struct("volume_base", "source")).alias("close"))
    gap = read.join(own, "ts").select(((F.col("close") / F.col("price") - 1) * 10_000).alias("bps"))
    gap = stored(gap.select("bps", F.abs("bps").alias("abs")))
    found = quantiles(gap, [], {"p05": ("bps", 0.05), "p50": ("bps", 0.5), "p95": ("bps", 0.95), "abs_p99": ("abs", 0.99)})
    return gap.agg(F.count("*").alias("hours"), F.max("abs").alias("abs_max")).join(F.broadcast(found), how="cross").select("hours", "p05", "p50", "p95", "abs_p99", "abs_max")  # one row each


def depeg_bands(candles: DataFrame, usd_rate: DataFrame) -> DataFrame:
    """Candles of the dollar coin's markets by how far the day's last rate was from par."""
    days = usd_rate.groupBy(F.to_date("ts").alias("day")).agg(F.max_by("rate", F.struct("ts", "method")).alias("rate"))
    off = F.abs(F.col("rate") - 1)
    band = F.when(off <= 0.001, "<=10bps").when(off <= 0.005, "<=50bps").when(off <= 0.02, "<=200bps").otherwise(">200bps")
    return candles.where("quote = 'USDC'").withColumn("day", F.to_date("ts")).join(days, "day").groupBy(band.alias("band")).agg(F.count("*").alias("candles"), F.count_distinct("asset").alias("assets"))


def priced_population(tiers: dict[str, DataFrame], epoch: Column) -> DataFrame:
    rows = _every(tiers, ["quote", "ts", "close_usd"])
    return rows.groupBy("tier", "quote").agg(*[F.count_if((F.col("ts") < epoch if before else F.col("ts") >= epoch) & ((F.col("close_usd") > 0) == has)).alias(n) for before, has, n in ((True, True, "priced_before"), (True, False, "unpriced_before"), (False, True, "priced_after"), (False, False, "unpriced_after"))])


def outlier_prints(c1d: DataFrame, deviation: float = 0.05) -> DataFrame:
    rows = c1d.where((F.col("pf_trade_count") > 0) & (F.col("vwap") > 0))
    share = lambda c: F.avg(F.when(c, 1.0).otherwise(0.0))
    off = F.abs(F.col("close") / F.col("vwap") - 1)
    small = F.exists(F.sequence(F.lit(1), F.lit(10)), lambda d: F.abs(F.col("close") * d - F.round(F.col("close") * d)) < 1e-9)
    return rows.groupBy("source").agg(F.count("*").alias("candles"), share(off > deviation).alias("close_off"), share(F.col("high") > 1.5 * F.col("vwap")).alias("high_off"), share(F.col("low") < 0.67 * F.col("vwap")).alias("low_off"), share(small).alias("small_ratio"))


def deviation_by_size(c1m: DataFrame, c1h: DataFrame) -> DataFrame:
    """How far minute closes are from their hour's average, by traded size."""
    hour = c1h.where("vwap > 0").select("asset", "quote", "source", F.col("ts").alias("hour"), F.col("vwap").alias("hour_vwap"))
    rows = c1m.where("pf_trade_count > 0").withColumn("hour", F.date_trunc("hour", "ts")).join(hour, ["asset", "quote", "source", "hour"])
    size = F.col("volume_quote").cast("double")
    band = F.when(size < 1, "a <1").when(size < 10_000, "b <10k").when(size < 50_000, "c <50k").otherwise("d >=50k")
    off = F.abs(F.col("close") / F.col("hour_vwap") - 1)
    rows = stored(rows.select(band.alias("band"), off.alias("off")))
    sums = rows.groupBy("band").agg(F.count("*").alias("candles"), F.avg(F.when(F.col("off") > 0.05, 1.0).otherwise(0.0)).alias("share_off"))
    return sums.join(quantiles(rows, ["band"], {"p50": ("off", 0.5), "p90": ("off", 0.9)}), "band").select("band", "candles", "p50", "p90", "share_off")


def weighted_median(df: DataFrame, keys: list[str], value: str, weight: str) -> DataFrame:
    """The value at which half of the weight is reached."""
    w = Window.partitionBy(*keys).orderBy(value, weight)
    rows = df.where(F.col(weight) > 0).withColumn("__c", F.sum(weight).over(w)).withColumn("__t", F.sum(weight).over(Window.partitionBy(*keys)))
    return rows.where(F.col("__c") * 2 >= F.col("__t")).groupBy(*keys).agg(F.min(value).alias("weighted_median"))


def par_check(c1d: DataFrame, asset: str = "XLM", external: DataFrame | None = None) -> DataFrame:
    """Per dollar token: days, volume, and how far its XLM price is from the day's weighted median over all of them.

    With an external series (quote, day, rate): on how many days there is one, and how far from it the token's value
    lies that its own market implies.
    """
    rows = c1d.where((F.col("asset") == asset) & (F.col("close") >= PRICE_FLOOR)).groupBy("quote", "ts").agg(F.max_by("close", F.struct("volume_base", "source")).alias("close"), F.sum("volume_base").cast("double").alias("volume"))
    rows = rows.join(weighted_median(rows, ["ts"], "close", "volume"), "ts").withColumn("off", F.abs(F.col("close") / F.col("weighted_median") - 1))
    sums, wanted = [F.count("*").alias("days"), F.sum("volume").alias("volume")], {"median_off": ("off", 0.5)}
    if external is not None:
        rows = rows.withColumn("day", F.to_date("ts")).join(external.where("rate > 0").select("quote", "day", "rate"), ["quote", "day"], "left")
        rows = rows.withColumn("off_external", F.abs(F.col("weighted_median") / F.col("close") / F.col("rate") - 1))
        sums.append(F.count("rate").alias("external_days"))
        wanted["median_off_external"] = ("off_external", 0.5)
    rows = stored(rows)
    return rows.groupBy("quote").agg(*sums).join(quantiles(rows, ["quote"], wanted), "quote", "left")


def interval_uptime(requests: DataFrame, seconds: int = 300) -> DataFrame:
    """Per service (service, ts, failed): one less the mean error rate of its intervals, those without requests having none."""
    slot = F.floor(F.unix_timestamp("ts") / seconds)
    seen = requests.groupBy("service", slot.alias("slot")).agg(F.avg(F.when(F.col("failed"), 1.0).otherwise(0.0)).alias("errors"))
    span = seen.groupBy("service").agg(F.explode(F.sequence(F.min("slot"), F.max("slot"))).alias("slot"))
    return span.join(seen, ["service", "slot"], "left").groupBy("service").agg(F.count("*").alias("intervals"), (1 - F.avg(F.coalesce("errors", F.lit(0.0)))).alias("uptime"))


def lag_share(points: DataFrame, threshold: float) -> DataFrame:
    return points.groupBy("service").agg(F.avg(F.when(F.col("lag") <= threshold, 1.0).otherwise(0.0)).alias("share"), F.max("lag").alias("max_lag"))


def overclaim(c1h: DataFrame, progress: DataFrame) -> DataFrame:
    """Claims (group, claimed) of an earliest candle against the first that is there, and groups without any."""
    first = c1h.groupBy(F.when(F.col("source") == "sdex", "sdex").otherwise("contracts").alias("group")).agg(F.min("ts").alias("first"))
    return progress.join(first, "group", "full").select("group", "claimed", "first", F.when(F.col("claimed").isNull(), "no claim").when(F.col("first").isNull(), "no candle").when(F.col("claimed") < F.col("first"), "overclaimed").otherwise("ok").alias("status"))
