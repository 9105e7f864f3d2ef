"""Read queries as functions: candle series, listings and batches of prices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketlake.functions.prices import PRICE_FLOOR
from marketlake.functions.timebucket import bucket_end, bucket_start
from marketlake.operators.asof import asof
from marketlake.operators.enrich import DOLLAR, ORACLE_AGE, ORACLE_EPOCH, PRE_USDC_END
from marketlake.operators.series import identity_by_contract

DIVERGENCE = 0.01
#: Worse qualities have higher ranks.
QUALITIES = ("measured", "measured-disputed", "fallback")


def _sum(c: Column, condition: Column) -> Column:
    return F.sum(F.when(condition, c))


def _within(v: Column) -> Column:
    return F.greatest(F.least(v, F.col("high")), F.col("low"))


def newest(df: DataFrame, n: int | None) -> DataFrame:
    """The newest n buckets, oldest first."""
    return df if n is None else df.orderBy(F.desc("ts")).limit(n).orderBy("ts")


def ohlcv_usd(candles: DataFrame, asset: str | None = None, n: int | None = None) -> DataFrame:
    """Venues and quotes of a bucket merged in USD; prices are null where no leg has formed one.

    Legs in the dollar coin or XLM decide if any of them formed a price, even if none of those can be valued.
    """
    rows = candles if asset is None else candles.where(F.col("asset") == asset)
    rows = rows.withColumn("rate", F.try_divide("close_usd", "close"))
    convertible = (F.col("close") >= PRICE_FLOOR) & (F.col("close_usd") >= PRICE_FLOOR) & ((F.col("quote") == DOLLAR) | (F.col("close_usd") != F.col("close")))
    main = F.col("quote").isin(DOLLAR, "XLM")
    rows = rows.withColumns({"valid": convertible & (F.col("pf_trade_count") > 0), "ps": (F.col("pf_trade_count") > 0) & main, "bandc": convertible & main, "conv": convertible}).withColumn("band", F.col("valid") & F.col("ps"))
    order = F.struct("volume_base", "quote", "source")
    out = {}
    for flag, weigh, name in (("band", "bandc", "b"), ("valid", "conv", "v")):
        f, w, base = F.col(flag), F.col(weigh), F.col("volume_base").cast("double")
        out |= {
            f"{name}_open": F.max_by(F.when(f, F.col("open") * F.col("rate")), F.when(f, order)),
            f"{name}_close": F.max_by(F.when(f, F.col("close_usd")), F.when(f, order)),
            f"{name}_high": F.max(F.when(f, F.col("high") * F.col("rate"))),
            f"{name}_low": F.min(F.when(f, F.col("low") * F.col("rate"))),
            f"{name}_vwap": F.try_divide(_sum(F.col("vwap") * F.col("rate") * base, w), _sum(base, w)),
            f"{name}_pf": F.try_divide(_sum(F.col("pf_price_volume") * F.col("rate"), f), F.nullif(_sum(F.col("pf_volume").cast("double"), f), F.lit(0.0))),
        }
    grouped = rows.groupBy("asset", "ts").agg(F.max("ps").alias("any"), F.sum("volume_base").alias("volume_base"), F.sum("volume_quote_usd").alias("volume_usd"), F.sum("trade_count").alias("trade_count"), *[c.alias(k) for k, c in out.items()])
    pick = lambda k: F.when(F.col("any"), F.col(f"b_{k}")).otherwise(F.col(f"v_{k}"))
    made = grouped.select("asset", "ts", *[pick(k).alias(k) for k in ("open", "high", "low", "close", "vwap", "pf")], "volume_base", "volume_usd", "trade_count")
    made = made.withColumns({"high": F.greatest("high", "close"), "low": F.least("low", "close")})
    return newest(made.withColumns({"vwap": F.when(F.col("vwap").isNotNull() & F.col("high").isNotNull(), _within(F.col("vwap"))), "pf_vwap": F.when(F.col("pf").isNotNull(), _within(F.col("pf")))}).drop("pf"), n)


def ohlcv_quote(candles: DataFrame, quote: str, n: int | None = None) -> DataFrame:
    """One quote leg: price-forming venues merged, the one of largest volume giving open and close."""
    forming, order = (F.col("pf_trade_count") > 0) & (F.col("close") >= PRICE_FLOOR), F.struct("volume_base", "source")
    only = lambda c: F.when(forming, F.col(c))
    made = candles.where(F.col("quote") == quote).groupBy("asset", "ts").agg(
        F.max_by(only("open"), F.when(forming, order)).alias("open"),
        F.max(only("high")).alias("high"),
        F.min(only("low")).alias("low"),
        F.max_by(only("close"), F.when(forming, order)).alias("close"),
        F.sum("volume_base").alias("volume_base"),
        F.sum("trade_count").alias("trade_count"),
        F.try_divide(F.sum(only("pf_price_volume")), F.nullif(F.sum(only("pf_volume")).cast("double"), F.lit(0.0))).alias("pf"),
    )
    return newest(made.withColumn("pf_vwap", F.when(F.col("pf").isNotNull(), _within(F.col("pf")))).drop("pf"), n)


def mark_divergence(df: DataFrame, most: float = DIVERGENCE) -> DataFrame:
    return df.withColumn("diverges", F.coalesce(F.abs(F.try_divide("close", "pf_vwap") - 1) > most, F.lit(False)))


def imported_days(usd_rate: DataFrame, reach: int = 34) -> DataFrame:
    """(end, last): the last day with an imported rate up to each day, for `reach` days after one.

    A span of days holds an imported one if the last up to its end does not lie before its start, so one row for each
    day that a span can end on answers for spans of any start.
    """
    days = usd_rate.where("method = 'external' and rate > 0").select(F.to_date("ts").alias("last")).distinct()
    following = F.lead("last").over(Window.partitionBy(F.year("last")).orderBy("last"))  # days of a year
    ends = days.withColumn("until", F.least(F.coalesce(F.date_add(following, -1), F.date_add("last", reach)), F.date_add("last", reach)))
    rows = ends.select("last", F.explode(F.sequence("last", "until")).alias("end"))
    return rows.groupBy("end").agg(F.max("last").alias("last"))  # of the end of a year and the beginning of the next


def usd_method(candles: DataFrame, usd_rate: DataFrame, grain: str = "1m", epoch: int = ORACLE_EPOCH, pre: int = PRE_USDC_END) -> DataFrame:
    """How each candle's USD value came about, from what it looks like.

    An imported rate counts on any day from the one before the candle's start to that of its end, since weeks and
    months take theirs from within.
    """
    rows = candles.withColumn("end", F.to_date(bucket_end(F.col("ts"), grain))).join(imported_days(usd_rate), "end", "left")
    rows = rows.withColumn("covered", F.col("last") >= F.date_add(F.to_date("ts"), -1))
    usdc, sec = F.col("quote") == DOLLAR, F.unix_timestamp("ts")
    ladder = (
        F.when(usdc & (sec < epoch) & (F.col("close_usd") != F.col("close")) & F.coalesce("covered", F.lit(False)), "external")
        .when(usdc & (F.col("close_usd") == F.col("close")), "assumed-par")
        .when(usdc & (sec >= epoch), "oracle")
        .when(usdc, "")
        .when(sec < pre, "external")
        .when(F.col("quote").isin("XLM", "USDT"), "traded")
        .otherwise("")
    )
    return rows.withColumn("method", ladder).drop("end", "last", "covered")


def ohlcv_peg(candles: DataFrame, usd_rate: DataFrame, grain: str, in_xlm: bool = False, epoch: int = ORACLE_EPOCH) -> DataFrame:
    """The dollar coin's own series: per bucket of its XLM market a measured rate, else the day's imported one, else 1."""
    market = candles.where((F.col("asset") == "XLM") & (F.col("quote") == DOLLAR))
    rows = market.groupBy("ts").agg(F.max_by("close", F.struct("volume_base", "source")).alias("xlm"))
    measured = usd_rate.where("method = 'oracle'").select(F.col("ts").alias("r"), "rate")
    width = bucket_end(F.col("ts"), grain)
    rows = asof(rows, measured, [], width, "r", ["rate"], 86_400 * 31, strict=True)
    floor = F.least(F.col("ts"), width - F.expr(f"interval {ORACLE_AGE} seconds"))
    rows = rows.withColumn("oracle", F.when(F.col("rts") >= floor, F.col("rate"))).withColumn("day", F.to_date("ts"))
    imported = usd_rate.where("method = 'external'").groupBy(F.to_date("ts").alias("day")).agg(F.max_by("rate", "ts").alias("external"))
    rows = rows.join(imported, "day", "left").withColumn("external", F.when(F.unix_timestamp("ts") < epoch, F.col("external")))
    price = F.coalesce("oracle", "external", F.lit(1.0))
    method = F.when(F.col("oracle").isNotNull(), "oracle").when(F.col("external").isNotNull(), "external").otherwise("peg")
    return rows.select("ts", (F.try_divide(price, F.nullif(F.col("xlm"), F.lit(0.0))) if in_xlm else price).alias("close"), method.alias("method"))


def _worst_quality(quality: Column) -> Column:
    """The worst label of a bucket; one that is not known is worse than all."""
    rank = F.when(quality == "", 0)
    for i, q in enumerate(QUALITIES):
        rank = rank.when(quality == q, i + 1)
    return F.nullif(F.max_by(quality, F.struct(rank.otherwise(len(QUALITIES) + 1), quality)), F.lit(""))


def ohlcv_native(candles: DataFrame, hourly: DataFrame, dollar: DataFrame, grain: str, lo: Column | None = None, hi: Column | None = None) -> DataFrame:
    """XLM before the dollar coin, in buckets from lo to before hi: prices from imported hourly rates (ts, rate, quality,
    source), volumes from the dollar legs of the hours (of the buckets, for grains below an hour).

    An hour's volume is valued at the newest rate before its end, at most a day old, which may lie before lo.  Below
    an hour, a bucket exists where XLM traded and its hour has a rate; from an hour on, where there is a rate.
    """
    start = lambda c: bucket_start(F.col(c), grain)
    base = F.when(F.col("asset") == "XLM", F.col("volume_base")).otherwise(F.col("volume_quote"))
    legs = dollar_legs(candles, dollar).groupBy("ts").agg(F.sum(base).alias("volume"), F.sum("trade_count").alias("trades"))
    if grain in ("1m", "15m"):
        rows = legs.withColumn("hour", F.date_trunc("hour", "ts")).join(hourly.withColumnRenamed("ts", "hour"), "hour")
        priced = rows.select(F.col("ts").alias("bucket"), F.col("hour").alias("at"), "rate", "quality", "source")
        valued = rows.select(F.col("ts").alias("bucket"), "volume", "trades", "rate")
    else:
        priced = hourly.select(start("ts").alias("bucket"), F.col("ts").alias("at"), "rate", "quality", "source")
        rates = hourly.where("rate > 0").select(F.col("ts").alias("r"), "rate")
        valued = asof(legs, rates, [], F.col("ts") + F.expr("interval 1 hour"), "r", ["rate"], 86_400, strict=True).select(start("ts").alias("bucket"), "volume", "trades", "rate")
    inside = F.lit(True) if lo is None else F.col("bucket") >= lo
    inside = inside if hi is None else inside & (F.col("bucket") < hi)
    prices = priced.where(inside).groupBy("bucket").agg(
        F.min_by("rate", "at").alias("open"),
        F.max("rate").alias("high"),
        F.min("rate").alias("low"),
        F.max_by("rate", "at").alias("close"),
        F.avg("rate").alias("mean"),
        _worst_quality(F.col("quality")).alias("quality"),
        F.when(F.count_distinct("source") == 1, F.nullif(F.min("source"), F.lit(""))).alias("rate_source"),
    )
    amount = F.col("volume").cast("double")
    sums = valued.where(inside).groupBy("bucket").agg(F.sum("volume").alias("volume_base"), F.sum("trades").alias("trade_count"), F.sum(amount * F.col("rate")).alias("volume_usd"), F.sum(F.when(F.col("rate").isNotNull(), amount)).alias("valued"))
    rows = prices.join(sums, "bucket", "left").fillna(0, ["volume_base", "trade_count", "volume_usd", "valued"])
    vwap = F.when(F.col("valued") > 0, F.col("volume_usd") / F.col("valued")).otherwise(F.col("mean"))
    return rows.withColumn("vwap", _within(vwap)).withColumnRenamed("bucket", "ts").drop("mean", "valued")


def merge_series(own: DataFrame, synthetic: DataFrame, n: int | None = None) -> DataFrame:
    """Synthetic buckets win over own ones; the last n of all."""
    return newest(synthetic.unionByName(own.join(synthetic.select("ts"), "ts", "left_anti").select(synthetic.columns)), n)


def dollar_legs(candles: DataFrame, dollar: DataFrame, off_peg: list[str] | None = None) -> DataFrame:
    """Markets of XLM against a dollar token, on either side; tokens known to be off their peg are left out."""
    good = dollar.select(F.col("asset").alias("d")).where(~F.col("d").isin(off_peg or []))
    other = F.when(F.col("asset") == "XLM", F.col("quote")).when(F.col("quote") == "XLM", F.col("asset"))
    return candles.withColumn("d", other).join(good, "d", "left_semi").select(candles.columns)


def list_assets(snapshot: DataFrame, assets: DataFrame, kind: str | None = None, prefix: str = "", sort: str = "volume_24h_usd", descending: bool = True, limit: int | None = None, metadata: DataFrame | None = None, symbols: DataFrame | None = None) -> DataFrame:
    """Priced assets with their metadata (asset, home_domain) and, for contracts without a code, their symbol (contract, symbol).

    By a number of the snapshot, or by `code`, and then by identity, in one direction; `sort_value` is null for a sort
    by code and `sort_text` for the others.
    """
    rows = assets.join(snapshot, "asset").where(F.lower("asset").startswith(prefix.lower()))
    rows = rows if kind is None else rows.where(F.col("kind") == kind)
    rows = rows.join(metadata.select("asset", "home_domain"), "asset", "left") if metadata is not None else rows.withColumn("home_domain", F.lit(None).cast("string"))
    rows = rows.join(symbols.select("contract", "symbol"), "contract", "left") if symbols is not None else rows.withColumn("symbol", F.lit(None).cast("string"))
    rows = rows.withColumn("code", F.when(F.col("kind") == "contract", F.coalesce("symbol", "asset")).otherwise(F.col("asset")))
    by_code = sort == "code"
    rows = rows.withColumns({"sort_value": F.lit(None).cast("double") if by_code else F.coalesce(F.col(sort).cast("double"), F.lit(0.0)), "sort_text": F.col("code") if by_code else F.lit(None).cast("string")})
    order = [F.desc(c) if descending else F.asc(c) for c in ("sort_text" if by_code else "sort_value", "asset")]
    return rows.orderBy(*order) if limit is None else rows.orderBy(*order).limit(limit)


def page_after(df: DataFrame, sort: str, key: str, value: object, last: object, n: int) -> DataFrame:
    """The next page in descending order of (sort, key), and whether there is another."""
    rest = df if last is None else df.where((F.col(sort) < value) | ((F.col(sort) == value) & (F.col(key) < last)))
    page = rest.orderBy(F.desc(sort), F.desc(key)).limit(n + 1)
    more = page.agg((F.count("*") > n).alias("has_more"))  # n + 1 rows at most
    return page.orderBy(F.desc(sort), F.desc(key)).limit(n).join(F.broadcast(more), how="cross")


def resolve_aliases(requests: DataFrame, assets: DataFrame) -> DataFrame:
    """A requested contract stands for the identity behind it."""
    return requests.join(identity_by_contract(assets).select(F.col("contract").alias("requested"), F.col("asset").alias("meant")), "requested", "left").withColumn("asset", F.coalesce("meant", "requested")).drop("meant")


def prices_batch(requests: DataFrame, assets: DataFrame, snapshot: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Prices of all requests, repeats and order kept, and the requests that name nothing known."""
    named = resolve_aliases(requests, assets)
    known = named.join(assets.select("asset", "kind"), "asset", "left")
    found = known.where("kind is not null").join(snapshot.select("asset", "price_usd", "price_status"), "asset", "left").select("ordinal", "requested", "asset", F.coalesce("price_usd", F.lit(0.0)).alias("price_usd"), F.coalesce("price_status", F.lit("unpriced")).alias("price_status"))
    return found, known.where("kind is null").select("ordinal", "requested")


def apply_min_volume(venues: DataFrame, threshold: float) -> DataFrame:
    """Per asset the average over venues above the threshold; as it was if none is below, 0 if none is left."""
    entries = venues.groupBy("asset").agg(F.collect_list(F.struct("source", "price", "volume")).alias("all"))
    entries = entries.withColumn("kept", F.filter("all", lambda v: v["volume"] > threshold))
    total = lambda c, f: F.aggregate(c, F.lit(0.0), lambda a, v: a + f(v))
    vwap = F.coalesce(F.try_divide(total("kept", lambda v: v["price"] * v["volume"]), total("kept", lambda v: v["volume"])), F.lit(0.0))
    return entries.select("asset", F.size("all").alias("venues"), F.size("kept").alias("kept"), vwap.alias("vwap"))


def oracles_for(oracle: DataFrame, names: list[str]) -> DataFrame:
    """The latest reading by each of the columns that name a series."""
    return oracle.groupBy(*names).agg(F.max_by("price", "ts").alias("price"), F.max("ts").alias("ts"))
