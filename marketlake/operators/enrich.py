"""USD values of candles, in tiers: measured rate, imported rate, peg, and pivot through a reference market."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketlake.functions.prices import PRICE_FLOOR, SCALE, zero
from marketlake.functions.timebucket import SECONDS, bucket_end
from marketlake.operators.asof import asof, asof_by_time
from marketlake.operators.candles import COLUMNS

#: Staleness in seconds, and the two ends of eras in epoch seconds.
ORACLE_AGE, PIVOT_AGE, RECENT = 300, 86_400, 14_400
ORACLE_EPOCH, PRE_USDC_END = 1_773_237_600, 1_612_137_600
DOLLAR, PIVOTS = "USDC", ("XLM", "USDT")


def candidate() -> Column:
    return ((F.col("volume_quote_usd") == 0) | ((F.col("close_usd") == 0) & (F.col("close") > 0))) & (F.col("volume_quote") > 0)


def leftover() -> Column:
    """The narrower rule of the later tiers."""
    return (F.col("close_usd") == 0) & ((F.col("close") > 0) | (F.col("volume_quote_usd") == 0)) & (F.col("volume_quote") > 0)


def rate_age(grain: str) -> int:
    width = {**SECONDS, "1d": 86_400, "1w": 604_800, "1M": 2_678_400}[grain]
    return max(width, 86_400)


def _valued(rows: DataFrame, rate: Column, keep: bool = True) -> DataFrame:
    """Both USD columns and the next version; a USD volume that is there stays if `keep`."""
    volume = rate * F.col("volume_quote").cast("double")
    return rows.withColumns({"volume_quote_usd": F.when((F.col("volume_quote_usd") > 0) & F.lit(keep), F.col("volume_quote_usd")).otherwise(volume), "close_usd": rate * F.col("close"), "version": F.col("version") + 1})


def tier_oracle(candles: DataFrame, oracle: DataFrame, window: int = ORACLE_AGE) -> DataFrame:
    """Candidates whose quote has a reading at their start or at most `window` seconds before, if a value is left after rounding."""
    rows = asof_by_time(candles.where(candidate()), oracle.select(F.col("asset").alias("quote"), "ts", "price").withColumnRenamed("ts", "r"), ["quote"], F.col("ts"), "r", ["price"], window)
    shows = lambda x: F.round(F.col("price") * x.cast("double"), SCALE) > 0
    rows = rows.where(((F.col("volume_quote_usd") == 0) & shows(F.col("volume_quote"))) | ((F.col("close_usd") == 0) & shows(F.col("close"))))
    return _valued(rows, F.col("price")).select(candles.columns)


def external_rates(usd_rate: DataFrame) -> DataFrame:
    return usd_rate.where("method = 'external'")


def tier_external(candles: DataFrame, usd_rate: DataFrame, grain: str, epoch: int = ORACLE_EPOCH) -> DataFrame:
    """Dollar-quoted candles before the first measured rate, at the imported rate strictly before their end."""
    rows = candles.where(leftover() & (F.col("quote") == DOLLAR) & (F.unix_timestamp("ts") < epoch))
    rates = external_rates(usd_rate).select(F.col("asset").alias("quote"), F.col("ts").alias("r"), "rate")
    rows = asof_by_time(rows, rates, ["quote"], bucket_end(F.col("ts"), grain), "r", ["rate"], rate_age(grain), strict=True).where("rate is not null")
    return _valued(rows, F.col("rate"), keep=False).select(candles.columns)


def tier_peg(candles: DataFrame) -> DataFrame:
    """What is left of dollar-quoted candles, at one dollar; no other token is ever pegged."""
    return _valued(candles.where(leftover() & (F.col("quote") == DOLLAR)), F.lit(1.0)).select(candles.columns)


def reference(candles: DataFrame, pivots: tuple[str, ...] = PIVOTS) -> DataFrame:
    """(quote, r, ref): what each pivot asset cost in dollars-coin, over all venues of a time."""
    rows = candles.where(F.col("asset").isin(*pivots) & (F.col("quote") == DOLLAR) & (F.col("close") > 0) & (F.col("volume_base") > 0) & (F.col("pf_trade_count") > 0))
    volume = F.col("volume_base").cast("double")
    return rows.groupBy(F.col("asset").alias("quote"), F.col("ts").alias("r")).agg((F.sum(F.col("close") * volume) / F.sum(volume)).alias("ref"))


def dollar_rates(keys: DataFrame, usd_rate: DataFrame, grain: str) -> DataFrame:
    """(ts, oracle, external): the dollar coin's rates strictly before the end of each distinct `ts`."""
    rows = keys.select("ts").distinct()
    for method in ("oracle", "external"):
        rates = usd_rate.where(F.col("method") == method).select(F.col("ts").alias("r"), F.col("rate").alias(method))
        rows = asof(rows, rates, [], bucket_end(F.col("ts"), grain), "r", [method], rate_age(grain), strict=True).drop("rts")
    return rows


def tier_pivot(candles: DataFrame, refs: DataFrame, usd_rate: DataFrame, grain: str, pivots: tuple[str, ...] = PIVOTS) -> DataFrame:
    """Candles quoted in a pivot, through its market as of their start and the dollar-coin's rate as of their end."""
    rows = candles.where(leftover() & F.col("quote").isin(*pivots))
    keys = asof(rows.select("quote", "ts").distinct(), refs, ["quote"], F.col("ts"), "r", ["ref"], PIVOT_AGE).where("ref is not null").drop("rts")
    rows = rows.join(keys.join(dollar_rates(keys, usd_rate, grain), "ts"), ["quote", "ts"])
    rate = F.coalesce(F.when(F.col("oracle") > 0, F.col("oracle")), F.when(F.col("external") > 0, F.col("external")))
    return _valued(rows.withColumn("rate", F.col("ref") * rate).where("rate is not null"), F.col("rate")).select(candles.columns)


def enrich(candles: DataFrame, oracle: DataFrame, usd_rate: DataFrame, grain: str = "1m", epoch: int = ORACLE_EPOCH) -> DataFrame:
    """All candles, valued by the first tier that has a rate for them; the others stay as they are.

    One pass: the rates of all tiers are found for the distinct quotes and times, which are far fewer and narrower
    than candles, and joined to the candles by equality; the order of the tiers is the order in which they are
    taken, so that no tier reads what another has left.
    """
    dollar = F.col("quote") == DOLLAR
    readings = oracle.select(F.col("asset").alias("quote"), F.col("ts").alias("r"), F.col("price").alias("__oracle"))
    keys = candles.select("quote", "ts").distinct()
    keys = asof(keys, readings, ["quote"], F.col("ts"), "r", ["__oracle"], ORACLE_AGE).drop("rts")
    keys = asof(keys, reference(candles), ["quote"], F.col("ts"), "r", ["ref"], PIVOT_AGE, prefix="__").drop("__rts")
    keys = keys.join(dollar_rates(keys, usd_rate, grain).withColumnsRenamed({"oracle": "__oracle_rate", "external": "__external_rate"}), "ts")
    rows = candles.join(keys, ["quote", "ts"], "left")
    shows = lambda x: F.round(F.col("__oracle") * x.cast("double"), SCALE) > 0
    measured = candidate() & (((F.col("volume_quote_usd") == 0) & shows(F.col("volume_quote"))) | ((F.col("close_usd") == 0) & shows(F.col("close"))))
    imported = leftover() & dollar & (F.unix_timestamp("ts") < epoch) & F.col("__external_rate").isNotNull()
    pivot = F.col("__ref") * F.coalesce(F.when(F.col("__oracle_rate") > 0, F.col("__oracle_rate")), F.when(F.col("__external_rate") > 0, F.col("__external_rate")))
    rate = F.when(measured, F.col("__oracle")).when(imported, F.col("__external_rate")).when(leftover() & dollar, 1.0).when(leftover() & F.col("quote").isin(*PIVOTS), pivot)
    rows = rows.withColumn("__rate", rate)
    volume = F.col("__rate") * F.col("volume_quote").cast("double")
    keep = (F.col("volume_quote_usd") > 0) & (measured | ~imported)
    has = F.col("__rate").isNotNull()
    return rows.select(
        *[
            F.when(has & ~keep, volume).otherwise(F.col(c)).alias(c)
            if c == "volume_quote_usd"
            else F.when(has, F.col("__rate") * F.col("close")).otherwise(F.col(c)).alias(c)
            if c == "close_usd"
            else (F.col(c) + has.cast("long")).alias(c)
            if c == "version"
            else F.col(c)
            for c in candles.columns
        ]
    )


def token_ratio(c1h: DataFrame, tokens: DataFrame) -> DataFrame:
    """(quote, r, factor): XLM for one token, from the token's own market over price-forming volume."""
    own = c1h.where((F.col("quote") == "XLM") & (F.col("pf_volume") > 0)).join(tokens, "asset", "left_semi").groupBy(F.col("asset").alias("quote"), F.col("ts").alias("r")).agg((F.sum("pf_price_volume") / F.sum(F.col("pf_volume").cast("double"))).alias("factor"))
    other = c1h.where((F.col("asset") == "XLM") & (F.col("pf_price_volume") > 0)).join(tokens.select(F.col("asset").alias("quote")), "quote", "left_semi").groupBy("quote", F.col("ts").alias("r")).agg((F.sum(F.col("pf_volume").cast("double")) / F.sum("pf_price_volume")).alias("factor"))
    return own.unionByName(other).groupBy("quote", "r").agg(F.max("factor").alias("factor"))


def reprice_fine(candles: DataFrame, c1h: DataFrame, xlm_rates: DataFrame, tokens: DataFrame, grain: str, until: int = PRE_USDC_END) -> DataFrame:
    """Candles before the dollar coin, quoted in XLM or a dollar token: XLM's imported rate times the token's ratio."""
    rows = candles.where((F.unix_timestamp("ts") < until) & (F.col("volume_quote") > 0))
    rows = rows.join(tokens.select(F.col("asset").alias("quote")).unionByName(rows.sparkSession.createDataFrame([("XLM",)], "quote string")).distinct(), "quote", "left_semi")
    rows = asof_by_time(rows, token_ratio(c1h, tokens), ["quote"], F.col("ts"), "r", ["factor"], PIVOT_AGE).drop("rts")
    rows = rows.withColumn("factor", F.when(F.col("quote") == "XLM", 1.0).otherwise(F.col("factor")))
    rows = asof_by_time(rows, xlm_rates.select(F.col("ts").alias("r"), "rate"), [], bucket_end(F.col("ts"), grain), "r", ["rate"], rate_age(grain), strict=True)
    return _valued(rows.where("rate is not null and factor is not null"), F.col("rate") * F.col("factor"), keep=False).select(COLUMNS)


def reprice_coarse(candles: DataFrame, hourly: DataFrame, grain: str) -> DataFrame:
    """Coarse candles from their hourly children: sums of USD volume, and the latest ratio of USD close to close."""
    from marketlake.functions.timebucket import bucket_start

    rated = (F.col("close_usd") >= PRICE_FLOOR) & (F.col("close") >= PRICE_FLOOR)
    child = hourly.groupBy("asset", "quote", "source", bucket_start(F.col("ts"), grain).alias("ts")).agg(F.sum("volume_quote_usd").alias("usd"), F.max_by(F.when(rated, F.col("close_usd") / F.col("close")), F.when(rated, F.col("ts"))).alias("ratio"))
    rows = candles.join(child, ["asset", "quote", "source", "ts"])
    return rows.withColumns({"volume_quote_usd": F.col("usd"), "close_usd": zero(F.col("close") * F.col("ratio")), "version": F.col("version") + 1}).select(COLUMNS)


def pending_counts(candles: DataFrame, repriced: DataFrame) -> DataFrame:
    """Of rows made anew: how many differ from what is stored, lose their price, or have none."""
    keys = ["asset", "quote", "source", "ts"]
    new = repriced.select(*keys, F.col("close_usd").alias("n_close"), F.col("volume_quote_usd").alias("n_volume"))
    both = candles.join(new, keys)
    differs = ~(F.col("close_usd").eqNullSafe(F.col("n_close")) & F.col("volume_quote_usd").eqNullSafe(F.col("n_volume")))
    return both.agg(F.count_if(differs).alias("pending"), F.count_if((F.col("close_usd") > 0) & (F.col("n_close") == 0)).alias("to_unprice"), F.count_if((F.col("close_usd") == 0) & (F.col("n_close") == 0)).alias("unpriced"))


def reset_usd(candles: DataFrame, quote: str, lo: Column, hi: Column, par_only: bool = False, days: list[DataFrame] | None = None) -> DataFrame:
    """Rows of a leg and window back to unpriced; only those at par, and only on days that all of `days` have, if asked for."""
    rows = candles.where((F.col("quote") == quote) & (F.col("ts") >= lo) & (F.col("ts") < hi) & ((F.col("close_usd") > 0) | (F.col("volume_quote_usd") > 0)))
    if par_only:
        rows = rows.where(F.col("close_usd") == F.col("close"))
    rows = rows.withColumn("day", F.to_date("ts"))
    for d in days or []:
        rows = rows.join(d.select(F.to_date("ts").alias("day")).distinct(), "day", "left_semi")
    return rows.withColumns({"close_usd": F.lit(0.0), "volume_quote_usd": F.lit(0.0), "version": F.col("version") + 1}).select(candles.columns)


def reset_admissible(candles: DataFrame, refs: DataFrame, usd_rate: DataFrame, lo: Column, hi: Column) -> DataFrame:
    """One row of what must hold before a reset."""
    inside = (F.col("ts") >= lo) & (F.col("ts") < hi)
    c = candles.where(inside).agg(F.count("*").alias("n"), F.count_distinct(F.to_date("ts")).alias("days"))
    r = refs.agg(F.min("r").alias("first_ref"))
    u = usd_rate.where(inside).agg(F.count_if(F.col("method") == "oracle").alias("oracle"), F.count_if(F.col("method") == "external").alias("external"), F.count_distinct(F.when(F.col("method") == "external", F.to_date("ts"))).alias("rate_days"))
    one = c.crossJoin(F.broadcast(r)).crossJoin(F.broadcast(u))
    return one.select((F.col("n") > 0).alias("not_empty"), F.coalesce(F.col("first_ref") <= lo, F.lit(False)).alias("reference_known"), (F.col("oracle") == 0).alias("no_oracle_shadow"), (F.col("external") > 0).alias("rates_loaded"), (F.col("rate_days") >= F.col("days")).alias("days_covered"))


def remaining(candles: DataFrame, as_of: Column) -> DataFrame:
    zero_ = candidate()
    return candles.agg(F.count_if(zero_).alias("total"), F.count_if(zero_ & (F.col("ts") >= as_of - F.expr(f"interval {RECENT} seconds"))).alias("recent"))


def months_with_zeros(candles: DataFrame, lo: Column, hi: Column) -> DataFrame:
    rows = candles.where(candidate() & (F.col("ts") >= lo) & (F.col("ts") < hi))
    return rows.groupBy(F.date_trunc("month", "ts").alias("starts")).agg(F.count("*").alias("zeros")).select(F.date_format("starts", "yyyy-MM").alias("month"), "starts", (F.col("starts") + F.expr("interval 1 month")).alias("ends"), "zeros")


def enrich_or_miss(candles: DataFrame, oracle: DataFrame, window: int = ORACLE_AGE) -> tuple[DataFrame, DataFrame]:
    """Candidates with a reading less than `window` seconds old, valued; and the others."""
    rows = asof_by_time(candles.where(candidate()), oracle.select(F.col("asset").alias("quote"), F.col("ts").alias("r"), "price"), ["quote"], F.col("ts"), "r", ["price"], window)
    hit = F.coalesce(F.unix_timestamp("ts") - F.unix_timestamp("rts") < window, F.lit(False))
    return _valued(rows.where(hit), F.col("price")).select(candles.columns), rows.where(~hit).select(candles.columns)
