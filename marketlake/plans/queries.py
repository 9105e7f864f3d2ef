"""Registered queries over the test tables, each with the SQL that states its result where SQL can."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marketlake.functions.prices import STORED, STORED_CEILING, price_survives, rounding_bound
from marketlake.functions.timebucket import window_lower
from marketlake.operators import candles, enrich, events, fills, identity, jobs, quality, read, series, snapshot
from marketlake.operators.asof import asof
from marketlake.plans.sql import CHILD, COUNTS, KEYS, NAME, PRICES, VOLUMES, shown, with_tables
from marketlake.sources import market, rates, versioned
from marketlake.sources.stored import exists, folder, once, signature, stored
from marketlake.sources.tiers import Tiers
from marketlake.streaming import candles as streaming

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable:
    def register(f: Callable[[Tables], DataFrame]) -> Callable:
        QUERIES[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            ORACLE_SQL[name] = with_tables(sql)
        return f

    return register


class Tables:
    """The test tables and what the operators derive from them."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    @property
    def claims(self) -> DataFrame:
        return market.claims(self.spark, self.sf_dir)

    @property
    def fills(self) -> DataFrame:
        return fills.fills(self.claims)

    @property
    def made_1m(self) -> DataFrame:
        """Minute candles from the raw trades."""
        return candles.candles_1m(self.fills).drop("clamped")

    def _stored(self, name: str, make: Callable[[], DataFrame], *tables: str) -> Tiers:
        """Candle tables that hold some minutes, written once in an application for each state of the tables below them."""

        def write() -> Tiers:
            tiers = Tiers(self.spark, f"{folder(self.spark)}/tiers-{uuid.uuid4().hex}", max(8, min(4096, int(self.spark.conf.get("spark.sql.shuffle.partitions")))))
            tiers.replace("1m", tiers.dealt(make()))
            return tiers

        state = tuple(signature(self.spark, f"{self.sf_dir}/{t}.parquet") for t in tables)
        return once(self.spark, (name, self.sf_dir, state), write, lambda tiers: exists(self.spark, f"{tiers.root}/1m"))

    @property
    def tiers(self) -> Tiers:
        return self._stored("traded", lambda: self.made_1m, "lineitem")

    @property
    def priced(self) -> Tiers:
        return self._stored("priced", lambda: self.valued_1m, "lineitem", "events")

    @property
    def c1m(self) -> DataFrame:
        return self.tiers.read("1m")

    @property
    def oracle(self) -> DataFrame:
        return market.oracle_prices(self.spark, self.sf_dir)

    @property
    def usd_rate(self) -> DataFrame:
        return market.usd_rate(self.spark, self.sf_dir)

    @property
    def supply(self) -> DataFrame:
        return market.asset_supply(self.spark, self.sf_dir)

    @property
    def assets(self) -> DataFrame:
        return market.assets(self.spark, self.sf_dir)

    @property
    def events(self) -> DataFrame:
        return market.contract_events(self.spark, self.sf_dir)

    @property
    def requests(self) -> DataFrame:
        return market.requests(self.spark, self.sf_dir)

    @property
    def valued_1m(self) -> DataFrame:
        """Minute candles valued from the stored ones."""
        return enrich.enrich(self.c1m, self.oracle, self.usd_rate)

    @property
    def p1m(self) -> DataFrame:
        return self.priced.read("1m")

    def c(self, grain: str) -> DataFrame:
        return self.c1m if grain == "1m" else candles.rollup(self.c(CHILD[grain]), grain)

    def p(self, grain: str) -> DataFrame:
        return self.p1m if grain == "1m" else candles.rollup(self.p(CHILD[grain]), grain)

    @property
    def as_of(self) -> Column:
        """The newest close time; one row, asked for when a query is made."""
        return F.lit(self.claims.agg(F.max("closed_at").alias("t")).first()["t"])

    @property
    def middle(self) -> tuple[Column, Column]:
        """From the second day of the trades to the beginning of the last; one row, asked for when a query is made."""
        r = self.claims.agg(F.min("closed_at").alias("a"), F.max("closed_at").alias("b")).first()
        day = lambda x: F.date_trunc("day", F.lit(x))
        return day(r["a"]) + F.expr("interval 1 day"), day(r["b"])

    @property
    def pools(self) -> DataFrame:
        """Registered pools of five venues; C2, C5, C8 and C11 are missing on purpose."""
        venues = {"C0": "soroswap", "C1": "soroswap", "C3": "sushiswap", "C4": "aquarius", "C6": "aquarius", "C7": "comet", "C9": "phoenix", "C10": "phoenix"}
        venue = F.create_map(*[F.lit(x) for kv in venues.items() for x in kv])
        known = self.events.select("contract").distinct().select("contract", F.try_element_at(venue, F.col("contract")).alias("venue")).where("venue is not null")
        pair = F.col("venue").isin(*events.PAIR_VENUES)
        return known.select("contract", "venue", F.when(pair & F.col("contract").isin("C0", "C3"), "AAA").when(pair, "XLM").alias("token_0"), F.when(pair, "USDC").alias("token_1"))


def round_shown(df: DataFrame, *names: str) -> DataFrame:
    """Columns rounded for comparison: prices to 8 places, volumes to 4."""
    out = []
    for n in names or (*KEYS, *PRICES, *VOLUMES, *COUNTS):
        if n in PRICES or n in ("price", "rate", "reference", "open_usd", "price_usd", "pf_vwap"):
            out.append(F.round(F.col(n).cast("double"), 8).alias(n))
        elif n in ("volume_quote_usd", "usd"):
            out.append(F.round(F.col(n).cast("double"), 6).alias(n))
        elif n in VOLUMES or n in ("volume", "volume_usd", "usd"):
            out.append(F.round(F.col(n).cast("double"), 4).alias(n))
        else:
            out.append(F.col(n))
    return df.select(*out)


# Sources and upkeep of tables.


@query("s1_latest", "select asset, ts, method, round(arg_max(rate, version), 8) as rate, max(version) as version from (select * from usd_rate union all select asset, ts, method, rate + 0.01, quality, version - 1 from usd_rate) group by all")
def _(t: Tables) -> DataFrame:
    older = t.usd_rate.withColumns({"rate": F.col("rate") + 0.01, "version": F.col("version") - 1})
    return round_shown(versioned.latest(t.usd_rate.unionByName(older), ["asset", "ts", "method"], "version"), "asset", "ts", "method", "rate", "version")


@query("s2_merge_append", f"select {shown()} from c1h where ts >= timestamp '2024-01-02' union all select {shown()} from (select * replace (version + 1 as version) from c1h where ts < timestamp '2024-01-02')")
def _(t: Tables) -> DataFrame:
    c, cut = t.c("1h"), F.lit("2024-01-02").cast("timestamp")
    return round_shown(versioned.merge_append(c, c.where(F.col("ts") < cut).withColumn("version", F.col("version") + 1), candles.KEYS, "version"))


@query("s3_dedup_samples", "select asset, ts, round(min(price), 8) as price from (select case when user_id % 2 = 0 then 'USDC' else 'XLM' end as asset, date_trunc('second', ts) as ts, value as price from events) group by all")
def _(t: Tables) -> DataFrame:
    e = market.table(t.spark, t.sf_dir, "events").select(F.when(F.col("user_id") % 2 == 0, "USDC").otherwise("XLM").alias("asset"), F.date_trunc("second", F.col("ts").cast("timestamp")).alias("ts"), F.col("value").alias("price"))
    return round_shown(versioned.dedup_samples(e, ["asset", "ts"]), "asset", "ts", "price")


@query("s6_scan_events", "select e.ledger, event_index, contract, topics, c.at as ledger_closed_at from contract_events e join (select ledger, min(closed_at) as at from contract_events group by 1) c using (ledger) where e.ledger between 10 and 500 and contract in (select contract from pools)")
def _(t: Tables) -> DataFrame:
    return events.scan_events(t.events, t.pools, 10, 500).select("ledger", "event_index", "contract", "topics", "ledger_closed_at")


_TYPED = lambda path: f"case when json_extract_string(data, '$.{path}.type') = 'address' then json_extract_string(data, '$.{path}.value') end"
_FACTORY = f"""select * from (select ledger, event_index, case when topic0 = 'add_pool' then 'aquarius' when topic0 = 'create' then 'phoenix' when topic1 = 'new_pair' then 'soroswap' else 'sushiswap' end as venue,
  case when topic0 = 'add_pool' then json_extract_string(data, '$[1].value') when topic0 = 'create' then json_extract_string(data, '$.value') when topic1 = 'new_pair' then {_TYPED('pair')} else {_TYPED('pool_address')} end as contract,
  case when topic1 = 'new_pair' then {_TYPED('token_0')} when topic0 = 'pool_created' then {_TYPED('token0')} end as token_0, case when topic1 = 'new_pair' then {_TYPED('token_1')} when topic0 = 'pool_created' then {_TYPED('token1')} end as token_1
  from topic_events where topic0 in ('add_pool', 'create', 'pool_created') or topic1 = 'new_pair') where contract is not null and (venue in ('aquarius', 'phoenix') or (token_0 is not null and token_1 is not null))"""


@query("s7_scan_factory_events", f"select ledger, event_index, contract, venue, token_0, token_1 from ({_FACTORY}) where ledger between 10 and 800")
def _(t: Tables) -> DataFrame:
    return events.scan_factory_events(t.events, 10, 800).select("ledger", "event_index", "contract", "venue", "token_0", "token_1")


_RAW_RATES = """select cast(date_trunc('minute', ts) as varchar) as ts, cast(round(0.9 + (event_id % 900) / 1000.0, 3) as varchar) as close, case when event_id % 11 = 0 then 'nowhere' else 'kraken' end as source, case when event_id % 13 = 0 then 'guess' else 'measured' end as quality from events where event_type = 'purchase'"""


@query(
    "s8_load_rates",
    f"""with raw as ({_RAW_RATES}), checked as (select *, cast(ts as timestamp) as t, cast(close as double) as rate, count(*) over (partition by ts) as copies from raw)
select case when epoch(t) < 1704326400 then 'before' else 'after' end as era, source, quality, count(*) as rates from checked
where epoch(t) % 300 = 0 and copies = 1 and rate between 0.5 and 1.5 and source = 'kraken' and quality = 'measured' group by all""",
)
def _(t: Tables) -> DataFrame:
    e = market.table(t.spark, t.sf_dir, "events").where("event_type = 'purchase'")
    raw = e.select(F.date_format(F.date_trunc("minute", F.col("ts").cast("timestamp")), "yyyy-MM-dd HH:mm:ss").alias("ts"), F.round(0.9 + F.col("event_id") % 900 / 1000, 3).cast("string").alias("close"), F.when(F.col("event_id") % 11 == 0, "nowhere").otherwise("kraken").alias("source"), F.when(F.col("event_id") % 13 == 0, "guess").otherwise("measured").alias("quality"))
    return rates.load_rates(raw, 300, 1_704_326_400)[2]


@query("s10_promote_rates", "select ts, method, round(rate, 8) as rate, version from usd_rate union all select ts, 'external_promoted', round(rate, 8), 7 from usd_rate where method = 'external' and epoch(ts) < 1704326400")
def _(t: Tables) -> DataFrame:
    return round_shown(rates.promote_rates(t.usd_rate, "external", "external_promoted", 1_704_326_400, 7), "ts", "method", "rate", "version")


@query("s12_expire", f"select {shown()} from c1d where ts >= date_trunc('month', (select t from now) - interval 7 days)")
def _(t: Tables) -> DataFrame:
    return round_shown(versioned.expire(t.c("1d"), "7 days", t.as_of))


@query("s14_snapshot_rates", "select ts, 'oracle' as method, round(price, 8) as rate, 99 as version from oracle_prices o where asset = 'USDC' and price > 0 and not exists (select 1 from usd_rate u where u.method = 'oracle' and u.ts = o.ts and u.rate = o.price and u.quality = 'measured')")
def _(t: Tables) -> DataFrame:
    return round_shown(rates.snapshot_rates(t.oracle, t.usd_rate.where("quality = 'measured'"), t.assets, "USDC", 99), "ts", "method", "rate", "version")


@query("s16_delete_window", f"select {shown()} from c1h where not (source = 'sdex' and ts >= timestamp '2024-01-01 06:00' and ts < timestamp '2024-01-02')")
def _(t: Tables) -> DataFrame:
    return round_shown(versioned.delete_window(t.c("1h"), "sdex", F.lit("2024-01-01 06:00").cast("timestamp"), F.lit("2024-01-02").cast("timestamp")))


# Fills.


@query("f1_trades", "select ledger, tx, op, claim, sold, bought, amount_sold, amount_bought from claims where amount_sold > 0 and amount_bought > 0")
def _(t: Tables) -> DataFrame:
    return fills.trades(t.claims).select("ledger", "tx", "op", "claim", "sold", "bought", "amount_sold", "amount_bought")


@query(
    "f2_attach_offer_price",
    """with ch as (select l_orderkey as tx, l_linenumber as op, l_suppkey as offer_id, l_partkey as pos, l_tax > 0.04 as is_state, l_extendedprice as n, l_quantity as d from lineitem where l_discount < 0.1),
first as (select tx, op, offer_id, arg_min(n, (not is_state, pos, n, d)) as n, arg_min(d, (not is_state, pos, n, d)) as d from ch group by all),
ours as (select l_orderkey as tx, l_linenumber as op, l_suppkey as offer_id from lineitem),
sound as (select a.tx from (select tx, count(distinct op) as k from ours group by 1) a join (select tx, count(distinct op) as k from ch group by 1) b on a.tx = b.tx and a.k = b.k)
select o.tx, o.op, o.offer_id, f.n as offer_n, f.d as offer_d from ours o left join (select * from first where tx in (select tx from sound)) f using (tx, op, offer_id)""",
)
def _(t: Tables) -> DataFrame:
    line = market.table(t.spark, t.sf_dir, "lineitem")
    key = [F.col("l_orderkey").alias("tx"), F.col("l_linenumber").alias("op"), F.col("l_suppkey").alias("offer_id")]
    changes = line.where("l_discount < 0.1").select(*key, F.col("l_partkey").alias("pos"), (F.col("l_tax") > 0.04).alias("is_state"), F.col("l_extendedprice").alias("n"), F.col("l_quantity").alias("d"))
    return fills.attach_offer_price(line.select(*key), changes).select("tx", "op", "offer_id", "offer_n", "offer_d")


@query("f3_offer_lookup_counts", "select count(*) filter (source = 'sdex' and offer_n is not null) as offers, count(*) filter (source = 'sdex' and offer_n is null) as misses, count(*) filter (source <> 'sdex') as pool_fills from claims")
def _(t: Tables) -> DataFrame:
    return fills.offer_lookup_counts(t.claims)


@query("f4_canonicalise", "select ledger, tx, op, base, quote, inverted, amount_base, amount_quote from fills")
def _(t: Tables) -> DataFrame:
    return fills.canonicalise(fills.drop_self_swaps(t.claims)).select("ledger", "tx", "op", "base", "quote", "inverted", "amount_base", "amount_quote")


@query("f5_drop_self_swaps", "select sold, bought, count(*) as trades from claims where sold <> bought group by all")
def _(t: Tables) -> DataFrame:
    return fills.drop_self_swaps(t.claims).groupBy("sold", "bought").agg(F.count("*").alias("trades"))


_WRAPPED = "select ledger, tx, op, case sold when 'AAA' then 'CAAA' else sold end as sold, case bought when 'USDC' then 'CUSDC' else bought end as bought from claims"


def _wrapped(t: Tables) -> DataFrame:
    return t.claims.withColumns({"sold": F.when(F.col("sold") == "AAA", "CAAA").otherwise(F.col("sold")), "bought": F.when(F.col("bought") == "USDC", "CUSDC").otherwise(F.col("bought"))})


@query("f6_collapse_wrapped", "select sold, bought, count(*) as trades from claims group by all")
def _(t: Tables) -> DataFrame:
    return fills.collapse_wrapped(_wrapped(t), t.assets).groupBy("sold", "bought").agg(F.count("*").alias("trades"))


@query("f7_split_unproven", f"select 'kept' as what, sold, bought, count(*) as n from (select * from ({_WRAPPED}) where sold not in ('BBB') and bought not in ('BBB')) group by all union all select 'skipped', contract, null, 1 from (values ('CAAA'), ('BBB'), ('CNONE')) f(contract) where contract not in (select contract from assets where contract <> '') and contract in (select sold from ({_WRAPPED}) union select bought from ({_WRAPPED}))")
def _(t: Tables) -> DataFrame:
    flagged = t.spark.createDataFrame([("CAAA",), ("BBB",), ("CNONE",)], "contract string")
    good, skipped = fills.split_unproven(_wrapped(t), flagged, t.assets)
    kept = good.groupBy(F.lit("kept").alias("what"), "sold", "bought").agg(F.count("*").alias("n"))
    return kept.unionByName(skipped.select(F.lit("skipped").alias("what"), F.col("contract").alias("sold"), F.lit(None).cast("string").alias("bought"), F.lit(1).cast("long").alias("n")))


@query("f8_scale_amounts", "select base, quote, round(sum(amount_base / case base when 'XLM' then 1e7 else 1e6 end), 2) as volume_base, round(sum(amount_quote / 1e7), 2) as volume_quote from fills where base in ('XLM','AAA') group by all")
def _(t: Tables) -> DataFrame:
    decimals = t.spark.createDataFrame([("XLM", 7), ("AAA", 6), ("USDC", 7), ("USDT", 7), ("BBB", 99)], "asset string, decimals int")
    good, _skipped = fills.scale_amounts(fills.canonicalise(fills.drop_self_swaps(t.claims)), decimals)
    return good.groupBy("base", "quote").agg(F.round(F.sum("volume_base").cast("double"), 2).alias("volume_base"), F.round(F.sum("volume_quote").cast("double"), 2).alias("volume_quote"))


@query("f9_fill_price", "select ledger, tx, op, offer_priced, round(price, 8) as price from fills")
def _(t: Tables) -> DataFrame:
    return round_shown(t.fills, "ledger", "tx", "op", "offer_priced", "price")


@query("f10_rounding_bound", "select (amount_sold > 1000 and amount_bought > 1000 and (amount_sold - 1000)::hugeint * (amount_bought - 1000) >= 1000000) as holds, count(*) as n from claims group by all")
def _(t: Tables) -> DataFrame:
    return t.claims.groupBy(rounding_bound(F.col("amount_sold"), F.col("amount_bought")).alias("holds")).agg(F.count("*").alias("n"))


@query("f11_price_survives", "select k, p >= 1e-12 as survives from (select l_linenumber as k, power(10.0, -10 - l_linenumber) as p from lineitem group by 1)")
def _(t: Tables) -> DataFrame:
    k = market.table(t.spark, t.sf_dir, "lineitem").select(F.col("l_linenumber").alias("k")).distinct()
    return k.select("k", price_survives(F.pow(F.lit(10.0), -10 - F.col("k"))).alias("survives"))


@query("f12_price_forming", "select source, offer_priced, price_forming, count(*) as n from fills group by all")
def _(t: Tables) -> DataFrame:
    return t.fills.groupBy("source", "offer_priced", "price_forming").agg(F.count("*").alias("n"))


@query("f13_asset_id", "select count(*) as assets, count(distinct asset || ':' || issuer || ':' || contract) as ids, cast(sum((trim(replace(asset || issuer || contract, ':', '')) = '')::int) as bigint) as sentinels from (select * from assets union all select '', kind, '', '' from assets where asset in ('XLM', 'P3') union all select asset, kind, issuer, contract from assets where asset < 'B')")
def _(t: Tables) -> DataFrame:
    """The registry, two blank identities, and some that stand twice."""
    blank = t.assets.where("asset in ('XLM', 'P3')").withColumns({c: F.lit("") for c in ("asset", "issuer", "contract")})
    a = t.assets.unionByName(blank).unionByName(t.assets.where("asset < 'B'")).withColumn("id", fills.asset_id(F.col("asset"), F.col("issuer"), F.col("contract")))
    return a.agg(F.count("*").alias("assets"), F.count_distinct("id").alias("ids"), F.count_if(F.col("id") == 0).alias("sentinels"))


@query("f14_pending_assets", "select distinct asset from (select sold as asset from claims union all select bought from claims union all select 'SEED') where asset not in (select asset from assets)")
def _(t: Tables) -> DataFrame:
    return fills.pending_assets(t.claims, t.assets, t.spark.createDataFrame([("SEED",)], "asset string"))


@query("f15_oracle_samples", "select date_trunc('second', ts) as ts, 'XLM' as asset, round(value, 8) as price from events where event_type = 'click' union all select date_trunc('second', ts), 'USDC', 1.0 from events where event_type = 'click'")
def _(t: Tables) -> DataFrame:
    e = market.table(t.spark, t.sf_dir, "events").where("event_type = 'click'").select(F.date_trunc("second", F.col("ts").cast("timestamp")).alias("ts"), F.to_json(F.array(F.struct(F.lit("XLM").alias("symbol"), F.col("value").alias("price")), F.struct(F.lit("usdc").alias("symbol"), F.lit(1.0).alias("price")), F.struct(F.lit("???").alias("symbol"), F.lit(2.0).alias("price")))).alias("prices"))
    return round_shown(events.oracle_samples(e, {"XLM": "XLM", "usdc": "USDC"}), "ts", "asset", "price")


@query(
    "f16_normalise_oracle_ts",
    "select event_id, date_trunc('second', ts) as ts from events where event_id % 5 <> 4",
)
def _(t: Tables) -> DataFrame:
    e = market.table(t.spark, t.sf_dir, "events")
    second = F.unix_timestamp(F.col("ts").cast("timestamp"))
    raw = F.when(F.col("event_id") % 5 == 4, second * 0 + 1000).when(F.col("event_id") % 2 == 0, second * 1000 + 7).otherwise(second)
    good, _rejected = events.normalise_oracle_ts(e.select("event_id", raw.alias("raw")), F.lit("2024-03-01").cast("timestamp"))
    return good.select("event_id", "ts")


# Venue events.

_POOLS_KEEP = "contract in (select contract from pools)"


@query("v1_parse_event_json", "select event_id, topic0, topic1, coalesce(try_cast(json_extract_string(data, '$.token_amount_in.value') as bigint), 0) as amount from topic_events")
def _(t: Tables) -> DataFrame:
    return events.parse_topics(t.events).select("event_id", "topic0", "topic1", events.number_at("token_amount_in").cast("long").alias("amount"))


_J = lambda path: f"cast(json_extract_string(data, '$.{path}') as bigint)"
_PAIR = f"""select ledger, event_index, venue as source, case when zero then token_0 else token_1 end as sold, case when zero then token_1 else token_0 end as bought, case when zero then coalesce(a0, i0) else coalesce(a1, i1) end as amount_sold, case when zero then coalesce(-a1, o1) else coalesce(-a0, o0) end as amount_bought from (
  select *, case when venue = 'sushiswap' then a0 > 0 else i0 >= i1 end as zero from (select e.*, venue, token_0, token_1, {_J('amount0.value')} as a0, {_J('amount1.value')} as a1, {_J('amount_0_in.value')} as i0, {_J('amount_1_in.value')} as i1, {_J('amount_0_out.value')} as o0, {_J('amount_1_out.value')} as o1
  from topic_events e join pools using (contract) where (venue = 'soroswap' and topic0 = 'SoroswapPair') or (venue = 'sushiswap' and topic0 = 'swap' and topic1 = 'G1')))"""
_SINGLE = f"select ledger, event_index, 'aquarius' as source, 'AAA' as sold, 'USDC' as bought, {_J('[0].value').replace('$.[', '$[')} as amount_sold, {_J('[1].value').replace('$.[', '$[')} as amount_bought from topic_events where topic0 = 'trade'"
_WEIGHTED = f"select ledger, event_index, 'comet' as source, 'BBB' as sold, 'XLM' as bought, a as amount_sold, b as amount_bought from (select *, {_J('token_amount_in.value')} as a, {_J('token_amount_out.value')} as b from topic_events where topic0 = 'POOL') where a > 0 and b > 0"
_GROUPS = f"""select ledger, tx, contract, min(event_index) as event_index, count(*) as rows, {", ".join(f"arg_min(val, event_index) filter (topic1 = '{f}') as {f}" for f in events.FIELDS)} from (select *, json_extract_string(data, '$.value') as val, row_number() over (partition by ledger, tx, contract order by event_index) as r
  from topic_events where topic0 = 'swap' and topic1 <> 'G1') where r <= 8 group by all"""
_WHOLE = "rows >= 4 and sell_token is not null and buy_token is not null and offer_amount is not null and return_amount is not null"
_MULTI = f"select ledger, event_index, 'phoenix' as source, sell_token as sold, buy_token as bought, cast(offer_amount as bigint) as amount_sold, cast(return_amount as bigint) as amount_bought from ({_GROUPS}) where {_WHOLE}"


def _amounts(df: DataFrame) -> DataFrame:
    return df.select("ledger", "event_index", "source", "sold", "bought", F.col("amount_sold").cast("long").alias("amount_sold"), F.col("amount_bought").cast("long").alias("amount_bought"))


@query("v2_decode_pair_swaps", _PAIR)
def _(t: Tables) -> DataFrame:
    return _amounts(events.decode_pair_swaps(t.events, t.pools))


@query("v3_decode_single_trades", _SINGLE)
def _(t: Tables) -> DataFrame:
    return _amounts(events.decode_single_trades(t.events))


@query("v4_assemble_multirow_swaps", f"select 'trade' as what, sold, bought, count(*) as groups, cast(sum(amount_sold) as bigint) as amount_sold from ({_MULTI}) group by all union all select 'lacking', null, null, count(*), cast(sum(rows) as bigint) from ({_GROUPS}) where not ({_WHOLE})")
def _(t: Tables) -> DataFrame:
    good, short = events.assemble_multirow_swaps(events.multirow_fields(t.events))
    made = good.groupBy(F.lit("trade").alias("what"), "sold", "bought").agg(F.count("*").alias("groups"), F.sum("amount_sold").cast("long").alias("amount_sold"))
    none = F.lit(None).cast("string")
    return made.unionByName(short.agg(F.lit("lacking").alias("what"), none.alias("sold"), none.alias("bought"), F.count("*").alias("groups"), F.sum("rows").cast("long").alias("amount_sold")))


@query("v5_decode_weighted_swaps", _WEIGHTED)
def _(t: Tables) -> DataFrame:
    return _amounts(events.decode_weighted_swaps(t.events))


_OF = lambda sql, venue: sql.replace("topic_events", f"(select * from topic_events where contract in (select contract from pools where venue = '{venue}'))")
_ROUTED = f"{_PAIR} union all {_OF(_SINGLE, 'aquarius')} union all {_OF(_WEIGHTED, 'comet')} union all {_OF(_MULTI, 'phoenix')}"
_SHAPE = "case when topic0 = 'trade' then 'single' when topic0 = 'SoroswapPair' then 'pair' when topic0 = 'swap' and topic1 = 'sell_token' then 'multirow' when topic0 = 'swap' and topic1 = 'G1' then 'signed' when topic0 = 'POOL' then 'weighted' end"


@query(
    "v6_route_events",
    f"""with trades as ({_ROUTED}) select 'trades' as what, source, count(*) as n, cast(sum(amount_sold) as bigint) as amount from trades group by all
union all select 'failed', source, cast(sum(n) as bigint), null from (
  select venue as source, count(*) as n from topic_events join pools using (contract) where {_SHAPE} is not null and {_SHAPE} <> 'multirow' and (ledger, event_index) not in (select (ledger, event_index) from trades) group by 1
  union all select 'phoenix', sum(rows) from ({_OF(_GROUPS, 'phoenix')}) where not ({_WHOLE})) group by source""",
)
def _(t: Tables) -> DataFrame:
    trades, _unregistered, failed = events.route_events(t.events, t.pools)
    made = trades.groupBy(F.lit("trades").alias("what"), "source").agg(F.count("*").alias("n"), F.sum("amount_sold").cast("long").alias("amount"))
    return made.unionByName(failed.groupBy(F.lit("failed").alias("what"), "source").agg(F.sum("rows").alias("n"), F.lit(None).cast("long").alias("amount")))


_LEARNT = f"select contract, case when n.venue is null then p.venue else n.venue end as venue, case when n.venue is null then p.token_0 else n.token_0 end as token_0, case when n.venue is null then p.token_1 else n.token_1 end as token_1 from pools p full join (select * from ({_FACTORY}) qualify row_number() over (partition by contract order by ledger desc, event_index desc) = 1) n using (contract)"


@query("v7_learn_pools", _LEARNT)
def _(t: Tables) -> DataFrame:
    return events.learn_pools(t.events, t.pools)


@query("v8_new_pool_rows", f"select contract, venue, token_0, token_1 from ({_LEARNT}) except select contract, venue, token_0, token_1 from pools")
def _(t: Tables) -> DataFrame:
    return events.new_pool_rows(events.learn_pools(t.events, t.pools), t.pools)


_ANY_SHAPED = f"select *, {_SHAPE} as shape from topic_events where {_SHAPE} is not null"
_SHAPED = f"{_ANY_SHAPED} and not ({_POOLS_KEEP})"


@query("v11_unregistered_shapes", f"select shape, count(*) as events, count(distinct contract) as contracts from ({_SHAPED}) group by all")
def _(t: Tables) -> DataFrame:
    return events.unregistered_shapes(t.events, t.pools)


@query("v12_unresolved_pools", f"select contract, shape, min(ledger) as first_ledger, max(ledger) as last_ledger, count(*) as swaps, not ({_POOLS_KEEP}) as unresolved from ({_ANY_SHAPED}) where contract <> 'C1' group by all")
def _(t: Tables) -> DataFrame:
    return events.unresolved_pools(t.events, t.pools, ["C1"]).drop("sample")


@query("v13_wrapper_proofs", "select contract, arg_min(json_extract_string(topics, '$[#-1].value'), (ledger, event_index)) as proof from topic_events where topic0 in ('trade', 'transfer', 'mint', 'burn', 'clawback') and contract in (select contract from pools) group by contract")
def _(t: Tables) -> DataFrame:
    return events.wrapper_proofs(t.events, t.pools)


# Candles and roll-ups.

#: From the second day of the trades to the beginning of the last.
_MIDDLE = "ts >= (select date_trunc('day', min(closed_at)) + interval 1 day from fills) and ts < (select date_trunc('day', max(closed_at)) from fills)"


@query("c1_candles_1m", f"select {shown()} from c1m")
def _(t: Tables) -> DataFrame:
    return round_shown(t.made_1m)


@query("c2_volume_totals", "select source, cast(sum(trade_count) as bigint) as trades, round(cast(sum(volume_base) as double), 4) as volume_base, round(sum(vwap), 4) as vwaps from c1m group by all")
def _(t: Tables) -> DataFrame:
    return t.c1m.groupBy("source").agg(F.sum("trade_count").alias("trades"), F.round(F.sum("volume_base").cast("double"), 4).alias("volume_base"), F.round(F.sum("vwap"), 4).alias("vwaps"))


@query("c3_price_forming_subset", "select source, cast(sum(pf_trade_count) as bigint) as trades, round(cast(sum(pf_volume) as double), 4) as pf_volume, count(*) filter (close = 0) as unpriced from c1m group by all")
def _(t: Tables) -> DataFrame:
    return t.c1m.groupBy("source").agg(F.sum("pf_trade_count").alias("trades"), F.round(F.sum("pf_volume").cast("double"), 4).alias("pf_volume"), F.count_if(F.col("close") == 0).alias("unpriced"))


@query("c4_versions", "select asset, quote, source, ts, version from c1m")
def _(t: Tables) -> DataFrame:
    return t.c1m.select("asset", "quote", "source", "ts", "version")


_HUGE = "case when ledger % 2 = 0 and source = 'sdex' then 1e20 else 1 end"


@query(
    "c5_clamped",
    f"""select source, cast(sum((vb > 1e24 or vq > 1e24 or pv > 1e24)::int) as bigint) as clamped, count(*) as candles, cast(sum((vb > 1e24)::int) as bigint) as full_base from (
  select source, sum(cast(volume_base as double) * k) as vb, sum(cast(volume_quote as double) * k) as vq, coalesce(sum(price * cast(volume_base as double) * k) filter (price_forming), 0) as pv from (select *, {_HUGE} as k from fills)
  group by base, quote, source, time_bucket(interval 1 minute, closed_at)) group by source""",
)
def _(t: Tables) -> DataFrame:
    """Half of the order-book fills have volumes of which a few fill the stored type."""
    k = F.when((F.col("ledger") % 2 == 0) & (F.col("source") == "sdex"), 1e20).otherwise(1.0)
    huge = t.fills.withColumns({c: F.coalesce((F.col(c).cast("double") * k).try_cast(STORED), F.lit(STORED_CEILING).cast(STORED)) for c in ("volume_base", "volume_quote")})
    full = F.col("volume_base") >= F.lit(STORED_CEILING).cast(STORED)
    return candles.candles_1m(huge).groupBy("source").agg(F.count_if("clamped").alias("clamped"), F.count("*").alias("candles"), F.count_if(full).alias("full_base"))


def _rolled(grain: str) -> None:
    @query(f"r1_rollup_{grain}" if grain != "1M" else "r1_rollup_1month", f"select {shown()} from c{NAME.get(grain, grain)}")
    def _(t: Tables) -> DataFrame:
        return round_shown(t.c(grain))


for _grain in CHILD:
    _rolled(_grain)


@query("r3_close_usd", "select asset, quote, source, ts, round(close_usd, 8) as close_usd from p1d")
def _(t: Tables) -> DataFrame:
    return round_shown(t.p("1d"), "asset", "quote", "source", "ts", "close_usd")


@query("r5_refresh", f"select {shown()} from c1h where ts >= time_bucket(interval 1 hour, (select t from now) - interval 8 hours)")
def _(t: Tables) -> DataFrame:
    return round_shown(candles.refresh(t.c("15m"), "1h", window_lower(t.as_of, "1h")))


@query("r6_rollup_all", "select '15m' as tier, count(*) as candles, cast(sum(trade_count) as bigint) as trades from c15m union all select '1h', count(*), cast(sum(trade_count) as bigint) from c1h union all select '4h', count(*), cast(sum(trade_count) as bigint) from c4h union all select '1d', count(*), cast(sum(trade_count) as bigint) from c1d union all select '1w', count(*), cast(sum(trade_count) as bigint) from c1w union all select '1M', count(*), cast(sum(trade_count) as bigint) from c1mo")
def _(t: Tables) -> DataFrame:
    tiers = candles.rollup_all(t.c1m)
    return reduce(DataFrame.unionByName, [tiers[g].agg(F.lit(g).alias("tier"), F.count("*").alias("candles"), F.sum("trade_count").alias("trades")) for g in CHILD])


_LATE = "select * from c1h where ts >= date_trunc('hour', (select t from now) - interval 7 days) and ts + interval 1 hour <= (select t from now) - interval 2 hours and source = 'sdex'"


@query("r7_reconcile", f"select {shown()} from ({_LATE})")
def _(t: Tables) -> DataFrame:
    return round_shown(candles.reconcile(t.c("15m"), t.c("1h").where("source <> 'sdex'"), "1h", t.as_of))


@query("r8_mismatch_count", f"select '1h' as tier, count(*) as mismatched from ({_LATE})")
def _(t: Tables) -> DataFrame:
    return candles.mismatch_count(t.c("15m"), t.c("1h").where("source <> 'sdex'"), "1h", t.as_of)


@query("r9_preroll", f"select {shown()} from c1h where {_MIDDLE}")
def _(t: Tables) -> DataFrame:
    return round_shown(candles.preroll(t.c("15m"), "1h", *t.middle))


@query("r10_reroll_sources", f"select {shown()} from c1h")
def _(t: Tables) -> DataFrame:
    lo, hi = F.lit("2024-01-01").cast("timestamp"), F.lit("2024-01-02").cast("timestamp")
    wrong = t.c("1h").withColumn("close", F.when((F.col("source") == "aquarius") & (F.col("ts") >= lo) & (F.col("ts") < hi), 1.0).otherwise(F.col("close")))
    return round_shown(candles.reroll_sources(wrong, t.c("15m"), "1h", ["aquarius"], lo, hi))


@query("r11_gap_totals", f"select 'whole' as what, cast(sum(trade_count) as bigint) as child_count, cast(sum(trade_count) as bigint) as target_count, sum(trade_count) = sum(trade_count) as equal from c1h where {_MIDDLE} union all select 'gap', cast(sum(trade_count) as bigint), cast(sum(trade_count) filter (source <> 'sdex') as bigint), sum(trade_count) = sum(trade_count) filter (source <> 'sdex') from c1h where {_MIDDLE}")
def _(t: Tables) -> DataFrame:
    one = lambda what, target: candles.gap_totals(t.c("15m"), target, *t.middle).select(F.lit(what).alias("what"), "child_count", "target_count", "equal")
    return one("whole", t.c("1h")).unionByName(one("gap", t.c("1h").where("source <> 'sdex'")))


@query("r12_gap_mismatch", f"select asset, quote, source, ts, trade_count as child_count, cast(null as bigint) as target_count from c1h where {_MIDDLE} and source = 'sdex'")
def _(t: Tables) -> DataFrame:
    return candles.gap_mismatch(t.c("15m"), t.c("1h").where("source <> 'sdex'"), "1h", *t.middle)


@query("r13_month_equal", "select coalesce(a.month, b.month) as month, count_1m, count_1d, count_1m is not distinct from count_1d as equal from (select strftime(ts, '%Y-%m') as month, cast(sum(trade_count) as bigint) as count_1m from c1m group by 1) a full join (select strftime(ts, '%Y-%m') as month, cast(sum(trade_count) as bigint) as count_1d from c1d where source <> 'sdex' or ts < timestamp '2024-01-05' group by 1) b on a.month = b.month")
def _(t: Tables) -> DataFrame:
    """The daily tier lacks what the order book traded from a day on."""
    return candles.month_equal(t.c1m, t.c("1d").where("source <> 'sdex' or ts < timestamp '2024-01-05'"))


# USD values.


@query("e0_asof", "select c.asset, c.quote, c.source, c.ts, case when epoch(c.ts) - epoch(o.ts) <= 300 then round(o.price, 8) end as price from c1m c asof left join oracle_prices o on c.quote = o.asset and c.ts >= o.ts")
def _(t: Tables) -> DataFrame:
    right = t.oracle.select(F.col("asset").alias("quote"), F.col("ts").alias("r"), "price")
    return round_shown(asof(t.c1m, right, ["quote"], F.col("ts"), "r", ["price"], 300), "asset", "quote", "source", "ts", "price")


_USD = ("asset", "quote", "source", "ts", "close_usd", "volume_quote_usd", "version")


@query("e1_tier_oracle", f"select {shown(*_USD)} from t1")
def _(t: Tables) -> DataFrame:
    return round_shown(enrich.tier_oracle(t.c1m, t.oracle), *_USD)


_T2_ALL = "select c.*, u.rate from (select *, ts + interval 1 minute as e from c1m where volume_quote > 0 and quote = 'USDC') c asof join (select * from usd_rate where method = 'external') u on c.quote = u.asset and c.e > u.ts where epoch(c.e) - epoch(u.ts) <= 86400"


@query("e2_tier_external", f"select asset, quote, source, ts, round(rate * close, 8) as close_usd, round(rate * cast(volume_quote as double), 6) as volume_quote_usd, version + 1 as version from ({_T2_ALL})")
def _(t: Tables) -> DataFrame:
    return round_shown(enrich.tier_external(t.c1m, t.usd_rate, "1m"), *_USD)


@query("e3_tier_peg", "select asset, quote, source, ts, round(close, 8) as close_usd, round(cast(volume_quote as double), 6) as volume_quote_usd, version + 1 as version from c1m where quote = 'USDC' and volume_quote > 0")
def _(t: Tables) -> DataFrame:
    return round_shown(enrich.tier_peg(t.c1m), *_USD)


@query("e4_tier_pivot", f"select {shown(*_USD)} from t4")
def _(t: Tables) -> DataFrame:
    got = enrich.tier_oracle(t.c1m, t.oracle)
    rest = t.c1m.join(got.select(*candles.KEYS), candles.KEYS, "left_anti")
    return round_shown(enrich.tier_pivot(rest, enrich.reference(t.c1m), t.usd_rate, "1m"), *_USD)


@query(
    "e5_reprice_pre_usdc",
    """with tok as (select quote, ts as r, sum(cast(pf_volume as double)) / sum(pf_price_volume) as factor from c1h where asset = 'XLM' and quote in ('USDC', 'USDT') and pf_price_volume > 0 group by all),
c as (select *, ts + interval 1 hour as e, 1 as k from c1h where quote in ('XLM', 'USDC', 'USDT') and volume_quote > 0),
f as (select c.*, case when c.quote = 'XLM' then 1.0::double when epoch(c.ts) - epoch(t.r) <= 86400 then t.factor end as factor from c asof left join tok t on c.quote = t.quote and c.ts >= t.r)
select f.asset, f.quote, f.source, f.ts, round(f.close * r.rate * factor, 8) as close_usd, round(cast(f.volume_quote as double) * r.rate * factor, 6) as volume_quote_usd from f
asof join (select ts, price as rate, 1 as k from oracle_prices where asset = 'XLM') r on f.k = r.k and f.e > r.ts where epoch(f.e) - epoch(r.ts) <= 86400 and factor is not null""",
)
def _(t: Tables) -> DataFrame:
    rates_ = t.oracle.where("asset = 'XLM'").select("ts", F.col("price").alias("rate"))
    tokens = t.spark.createDataFrame([("USDC",), ("USDT",)], "asset string")
    return round_shown(enrich.reprice_fine(t.c("1h"), t.c("1h"), rates_, tokens, "1h", until=2_000_000_000), "asset", "quote", "source", "ts", "close_usd", "volume_quote_usd")


@query(
    "e5_reprice_coarse",
    "select d.asset, d.quote, d.source, d.ts, round(coalesce(d.close * h.r, 0), 8) as close_usd, round(h.usd, 6) as volume_quote_usd from p1d d join (select asset, quote, source, date_trunc('day', ts) as ts, sum(volume_quote_usd) as usd, arg_max(close_usd / close, ts) filter (close_usd >= 1e-12 and close >= 1e-12) as r from p1h group by all) h using (asset, quote, source, ts)",
)
def _(t: Tables) -> DataFrame:
    return round_shown(enrich.reprice_coarse(t.p("1d"), t.p("1h"), "1d"), "asset", "quote", "source", "ts", "close_usd", "volume_quote_usd")


@query("e6_pending_counts", "select count(*) filter (c.close_usd is distinct from n or c.volume_quote_usd is distinct from p.volume_quote_usd) as pending, count(*) filter (c.close_usd > 0 and n = 0) as to_unprice, count(*) filter (c.close_usd = 0 and n = 0) as unpriced from (select *, case when quote = 'XLM' and version % 3 = 0 then 0 else close_usd end as n from p1m) p join (select asset, quote, source, ts, case when version % 2 = 0 then 1.0 else close_usd end as close_usd, volume_quote_usd from c1m) c using (asset, quote, source, ts)")
def _(t: Tables) -> DataFrame:
    """Some stored candles have a price, and some made anew have none."""
    made = t.p1m.withColumn("close_usd", F.when((F.col("quote") == "XLM") & (F.col("version") % 3 == 0), 0.0).otherwise(F.col("close_usd")))
    return enrich.pending_counts(t.c1m.withColumn("close_usd", F.when(F.col("version") % 2 == 0, 1.0).otherwise(F.col("close_usd"))), made)


@query("e7_enrich", f"select {shown(*_USD)} from p1m")
def _(t: Tables) -> DataFrame:
    return round_shown(t.valued_1m, *_USD)


@query("e8_reset_usd", "select asset, quote, source, ts, version + 1 as version, 0.0::double as close_usd from p1m where quote = 'USDC' and ts >= timestamp '2024-01-01' and ts < timestamp '2024-01-03' and (close_usd > 0 or volume_quote_usd > 0) and date_trunc('day', ts) in (select date_trunc('day', ts) from usd_rate where method = 'external')")
def _(t: Tables) -> DataFrame:
    lo, hi = F.lit("2024-01-01").cast("timestamp"), F.lit("2024-01-03").cast("timestamp")
    return enrich.reset_usd(t.p1m, "USDC", lo, hi, days=[enrich.external_rates(t.usd_rate)]).select("asset", "quote", "source", "ts", "version", "close_usd")


_WINDOWS = (("2024-01-01 12:00", "2024-01-02"), ("2023-01-01", "2023-02-01"), ("2024-01-02", "2024-03-01"))


@query(
    "e9_reset_admissible",
    " union all ".join(
        f"""select '{lo}' as lo, (select count(*) from c1m where ts >= l and ts < h) > 0 as not_empty, coalesce((select min(r) from refs) <= l, false) as reference_known, not exists (select 1 from usd_rate where method = 'oracle' and ts >= l and ts < h) as no_oracle_shadow,
  exists (select 1 from usd_rate where method = 'external' and ts >= l and ts < h) as rates_loaded, (select count(distinct cast(ts as date)) from usd_rate where method = 'external' and ts >= l and ts < h) >= (select count(distinct cast(ts as date)) from c1m where ts >= l and ts < h) as days_covered from (select timestamp '{lo}' as l, timestamp '{hi}' as h)"""
        for lo, hi in _WINDOWS
    ),
)
def _(t: Tables) -> DataFrame:
    """A window with all that is needed, one before all data, and one that outlasts them."""
    at = lambda x: F.lit(x).cast("timestamp")
    one = lambda lo, hi: enrich.reset_admissible(t.c1m, enrich.reference(t.c1m), t.usd_rate, at(lo), at(hi)).select(F.lit(lo).alias("lo"), "*")
    return reduce(DataFrame.unionByName, [one(*w) for w in _WINDOWS])


@query("e10_remaining", "select count(*) filter (z) as total, count(*) filter (z and ts >= (select t from now) - interval 14400 seconds) as recent from (select *, (volume_quote_usd = 0 or (close_usd = 0 and close > 0)) and volume_quote > 0 as z from p1m)")
def _(t: Tables) -> DataFrame:
    return enrich.remaining(t.p1m, t.as_of)


@query("e11_months_with_zeros", "select strftime(ts, '%Y-%m') as month, cast(date_trunc('month', ts) as timestamp) as starts, date_trunc('month', ts) + interval 1 month as ends, count(*) as zeros from p1m where (volume_quote_usd = 0 or (close_usd = 0 and close > 0)) and volume_quote > 0 and ts >= timestamp '2024-01-01' and ts < timestamp '2024-03-01' group by 1, 2, 3")
def _(t: Tables) -> DataFrame:
    return enrich.months_with_zeros(t.p1m, F.lit("2024-01-01").cast("timestamp"), F.lit("2024-03-01").cast("timestamp"))


@query("e15_enrich_or_miss", "select hit, count(*) as n from (select coalesce(epoch(c.ts) - epoch(o.ts) < 300, false) as hit from (select * from c1m where volume_quote > 0) c asof left join oracle_prices o on c.quote = o.asset and c.ts >= o.ts) group by all")
def _(t: Tables) -> DataFrame:
    hit, miss = enrich.enrich_or_miss(t.c1m, t.oracle)
    return hit.agg(F.lit(True).alias("hit"), F.count("*").alias("n")).unionByName(miss.agg(F.lit(False).alias("hit"), F.count("*").alias("n")))


# Snapshot.


@query("p1_tip", "select asset, round(price_usd, 8) as price_usd, round(open_usd, 8) as open_usd, price_ts, formed_ts from tips")
def _(t: Tables) -> DataFrame:
    return round_shown(snapshot.tip(t.p1m, t.as_of), "asset", "price_usd", "open_usd", "price_ts", "formed_ts")


_VENUE = ("asset", "source", "price", "live", "volume")


@query("p2_per_venue", f"select {shown(*_VENUE)} from venues")
def _(t: Tables) -> DataFrame:
    return round_shown(snapshot.per_venue(t.p1m, t.as_of), *_VENUE)


@query("p3_funded_filter", f"select {shown(*_VENUE)} from funded")
def _(t: Tables) -> DataFrame:
    return round_shown(snapshot.funded_filter(snapshot.per_venue(t.p1m, t.as_of)), *_VENUE)


@query("p4_liveness_filter", f"select {shown(*_VENUE)} from lively")
def _(t: Tables) -> DataFrame:
    return round_shown(snapshot.liveness_filter(snapshot.funded_filter(snapshot.per_venue(t.p1m, t.as_of))), *_VENUE)


@query("p5_median_mask", f"select {shown(*_VENUE)} from masked")
def _(t: Tables) -> DataFrame:
    return round_shown(snapshot.consensus(snapshot.per_venue(t.p1m, t.as_of)), *_VENUE)


@query("p6_vwap_24h", "select asset, round(coalesce(sum(price * volume) / nullif(sum(volume), 0), 0), 6) as vwap_24h from masked group by asset")
def _(t: Tables) -> DataFrame:
    return snapshot.vwap_24h(snapshot.consensus(snapshot.per_venue(t.p1m, t.as_of))).select("asset", F.round("vwap_24h", 6).alias("vwap_24h"))


@query("p7_sources_json", "select asset, source, round(price, 8) as price from masked")
def _(t: Tables) -> DataFrame:
    j = snapshot.sources_json(snapshot.consensus(snapshot.per_venue(t.p1m, t.as_of)))
    return j.select("asset", F.explode(F.from_json("sources", "map<string,struct<price:double,volume_24h:double>>")).alias("source", "v")).select("asset", "source", F.round("v.price", 8).alias("price"))


@query("p8_price_xlm", "select asset, round(coalesce(price_usd / nullif((select price_usd from tips where asset = 'XLM'), 0), 0), 8) as price_xlm from tips")
def _(t: Tables) -> DataFrame:
    return snapshot.price_xlm(snapshot.tip(t.p1m, t.as_of)).select("asset", F.round("price_xlm", 8).alias("price_xlm"))


_PCT = "case when {0} > 0 and price_usd > 0 then round(greatest(least((price_usd / {0} - 1) * 100, 999999), -999999), 2) end"


@query(
    "p9_changes",
    f"select asset, {_PCT.format('open_usd')} as change_24h_pct, {_PCT.format('old')} as change_7d_pct from tips left join (select asset, arg_min(close_usd, (ts, volume_base, source, quote)) as old from p1h where close_usd > 0 and ts >= (select t from now) - interval 7 days and ts <= (select t from now) - interval 5 days group by 1) using (asset)",
)
def _(t: Tables) -> DataFrame:
    return snapshot.changes(snapshot.tip(t.p1m, t.as_of), t.p("1h"), t.as_of).select("asset", *[F.round(F.col(c).cast("double"), 2).alias(c) for c in ("change_24h_pct", "change_7d_pct")])


@query("p10_volume_both_legs", "select asset, round(sum(v), 2) as volume_24h_usd from (select asset, volume_quote_usd as v, ts from p1m union all select quote, volume_quote_usd, ts from p1m) where ts > (select t from now) - interval 24 hours and ts <= (select t from now) group by asset")
def _(t: Tables) -> DataFrame:
    return snapshot.volume_both_legs(t.p1m, t.as_of).select("asset", F.round("volume_24h_usd", 2).alias("volume_24h_usd"))


@query("p11_market_cap", "select asset, round(coalesce(price_usd * supply, 0), 0) as market_cap from tips left join asset_supply using (asset)")
def _(t: Tables) -> DataFrame:
    return snapshot.market_cap(snapshot.tip(t.p1m, t.as_of), t.supply).select("asset", F.round("market_cap", 0).alias("market_cap"))


@query("p12_rate_tip", "select asset, round(price_usd, 8) as price_usd, price_ts, method from all_tips")
def _(t: Tables) -> DataFrame:
    return round_shown(snapshot.rate_tip(snapshot.tip(t.p1m, t.as_of), t.usd_rate, t.as_of), "asset", "price_usd", "price_ts", "method")


@query("p14_price_status", "select asset, case when price_usd <= 0 then 'unpriced' when price_ts < formed_ts then 'carried' else 'priced' end as price_status from all_tips")
def _(t: Tables) -> DataFrame:
    return snapshot.rate_tip(snapshot.tip(t.p1m, t.as_of), t.usd_rate, t.as_of).select("asset", snapshot.price_status().alias("price_status"))


_U = "floor(cast({} as double) * 1e7 + 0.5)"


@query(
    "p15_price_basis",
    f"""with b as (select *, {_U.format('volume_base')} as vb, {_U.format('volume_quote')} as vq, {_U.format('pf_volume')} as pv, {_U.format('pf_price_volume')} as pq from p1m where pf_trade_count > 0 and ts > (select t from now) - interval 24 hours and ts <= (select t from now))
select asset, case when max(source <> 'sdex' or not ((trade_count = 1 and not (vb > 1000 and vq > 1000 and (vb - 1000) * (vq - 1000) >= 1e6)) or (trade_count > 1 and pf_trade_count = 1 and not (pv > 1000 and pq + 1 > 1000 and (pv - 1000) * (pq - 999) >= 1e6)) or (pf_trade_count > 1 and (pv <= 1000 or pq <= 1000)))) then 'trades' else 'offer_dust' end as price_basis from b group by asset""",
)
def _(t: Tables) -> DataFrame:
    return snapshot.price_basis(t.p1m, t.as_of)


def current(t: Tables) -> DataFrame:
    as_of = t.as_of
    p1m = stored(enrich.enrich(snapshot.needed(t.c1m, as_of), t.oracle, t.usd_rate))  # a stored table in production too
    c1h = candles.rollup(candles.rollup(p1m, "15m"), "1h")
    return snapshot.current_prices(p1m, c1h, t.supply, t.usd_rate, as_of)


@query(
    "p16_current_prices",
    """select a.asset, round(price_usd, 8) as price_usd, method, case when price_usd <= 0 then 'unpriced' when price_ts < formed_ts then 'carried' else 'priced' end as price_status, coalesce(price_ts, timestamp '1970-01-01') as as_of, round(coalesce(v.w, 0), 6) as vwap_24h, round(coalesce(price_usd * supply, 0), 0) as market_cap
from all_tips a left join (select asset, sum(price * volume) / nullif(sum(volume), 0) as w from masked group by 1) v using (asset) left join asset_supply using (asset)""",
)
def _(t: Tables) -> DataFrame:
    return current(t).select("asset", F.round("price_usd", 8).alias("price_usd"), "method", "price_status", "as_of", F.round("vwap_24h", 6).alias("vwap_24h"), F.round("market_cap", 0).alias("market_cap"))


def changed(snapshot_: DataFrame) -> DataFrame:
    """A snapshot with a wrong price, volume, venue and average, each at another asset."""
    is_ = lambda a: F.col("asset") == a
    return snapshot_.withColumns(
        {
            "price_usd": F.when(is_("AAA"), F.col("price_usd") * 1.001).otherwise(F.col("price_usd")),
            "volume_24h_usd": F.when(is_("BBB"), F.col("volume_24h_usd") * 1.001).otherwise(F.col("volume_24h_usd")),
            "sources": F.when(is_("CCC"), F.lit('{"sdex":"1","other":"2"}')).otherwise(F.col("sources")),
            "vwap_24h": F.when(is_("XLM"), F.col("vwap_24h") * 2).otherwise(F.col("vwap_24h")),
        }
    )


@query(
    "p17_recompute_snapshot",
    """with legs as (select distinct asset from (select asset, ts from p1m union all select quote, ts from p1m) where ts > (select t from now) - interval 24 hours and ts <= (select t from now)), m as (select asset, count(*) as n from masked group by 1),
w as (select asset, sum(price * volume) / nullif(sum(volume), 0) as w from masked group by 1)
select a.asset, case when price_usd > 0 and method = 'traded' then case when a.asset = 'AAA' then 'mismatch' else 'match' end else 'no candle' end as price_verdict, case when a.asset in (select asset from legs) then case when a.asset = 'BBB' then 'mismatch' else 'match' end else 'no candle' end as volume_verdict,
  case when n is null then 'no candle' when a.asset = 'CCC' then 'mismatch' else 'match' end as venues_verdict, case when n is null then 'no candle' when a.asset = 'XLM' and w > 0 then 'mismatch' else 'match' end as vwap_verdict
from all_tips a left join m using (asset) left join w using (asset)""",
)
def _(t: Tables) -> DataFrame:
    as_of = t.as_of
    p1m = stored(enrich.enrich(snapshot.needed(t.c1m, as_of), t.oracle, t.usd_rate))
    made = snapshot.current_prices(p1m, candles.rollup(candles.rollup(p1m, "15m"), "1h"), t.supply, t.usd_rate, as_of)
    return snapshot.recompute_snapshot(p1m, changed(made), as_of).drop("price_usd")


# Tables kept up, and streams.


def _fresh(t: Tables) -> Tiers:
    return Tiers(t.spark, f"{folder(t.spark)}/tiers-{uuid.uuid4().hex}", max(8, min(4096, int(t.spark.conf.get("spark.sql.shuffle.partitions")))))


def _run(stream: DataFrame, t: Tables, write: Callable[[DataFrame, int], None]) -> None:
    streaming.resume(stream, f"{folder(t.spark)}/cursor-{uuid.uuid4().hex}", write).awaitTermination()


@query("s5_month_tables", f"select {shown()} from c4h where source <> 'sdex' or ts >= timestamp '2024-01-01' and ts < timestamp '2024-02-01'")
def _(t: Tables) -> DataFrame:
    """Tiers rolled up table by table, then the trades' month written again; other months, if any, keep what they had."""
    tiers = _fresh(t)
    tiers.replace("1m", tiers.dealt(t.c1m.where("source <> 'sdex'")))
    tiers.roll_all()
    lo, hi = F.lit("2024-01-01").cast("timestamp"), F.lit("2024-02-01").cast("timestamp")
    tiers.replace("1m", tiers.dealt(t.tiers.read("1m", lo, hi)))
    tiers.roll_all(lo, hi)
    return round_shown(tiers.read("4h"))


@query("t1_stream_and_tail", f"select {shown()} from c1m")
def _(t: Tables) -> DataFrame:
    """A stream of trades, folded into a stored tier as its minutes close, and the minutes that are still open from a batch."""
    tiers = _fresh(t)
    made = streaming.stream_candles(fills.fills(market.claims(t.spark, t.sf_dir, stream=True))).drop("clamped")
    _run(made, t, streaming.fold_into(tiers, "1m"))
    streamed = tiers.read("1m")
    return round_shown(streamed.unionByName(streaming.open_tail(t.fills, streamed).select(streamed.columns)))


@query("t5_refresh_touched", f"select {shown()} from c1h")
def _(t: Tables) -> DataFrame:
    """Hours of which some minutes come late: only the buckets that these touch are rolled up again."""
    tiers, late = _fresh(t), F.minute("ts") % 7 == 3
    tiers.replace("1m", tiers.dealt(t.c1m.where(~late)))
    tiers.roll("15m")
    tiers.roll("1h")
    fresh = t.c1m.where(late)
    tiers.fold("1m", fresh)
    tiers.refresh("15m", fresh)
    tiers.refresh("1h", fresh)
    return round_shown(tiers.read("1h"))


@query("t8_stream_dedup", "select distinct case when user_id % 2 = 0 then 'USDC' else 'XLM' end as asset, date_trunc('second', ts) as ts from events")
def _(t: Tables) -> DataFrame:
    e = market.table_stream(t.spark, t.sf_dir, "events")
    samples = e.select(F.when(F.col("user_id") % 2 == 0, "USDC").otherwise("XLM").alias("asset"), F.date_trunc("second", F.col("ts").cast("timestamp")).alias("ts"))
    out = f"{folder(t.spark)}/stream-{uuid.uuid4().hex}"
    _run(streaming.stream_dedup(samples, ["asset", "ts"]), t, streaming.merge_into(out))
    return t.spark.read.schema("asset string, ts timestamp").parquet(f"{out}/batch=*")


# Facts by identity: two codes have two issuers each.

#: The identities that price all others.
RESERVED = {code: issuer for code, _, issuer, _ in market.ASSETS if code in ("XLM", "USDC", "USDT")}


def _by_identity(sql: str) -> str:
    """The statement over claims in which another issuer's tokens have a name of their own."""
    body = re.search(r"claims as materialized \((.*?from lineitem)\)", sql, re.DOTALL)[0]
    other = lambda leg, code: f"case when {leg} = '{code}' and source <> 'sdex' then '{code}2' else {leg} end as {leg}"
    return sql.replace(body, body.replace("claims as", "every_claim as", 1) + f",\nclaims as materialized (select * replace (case when sold in ('AAA', 'USDT') and source <> 'sdex' then sold || '2' else sold end as sold, {other('bought', 'USDT')}) from every_claim)", 1)


def keyed_query(name: str, sql: str) -> Callable:
    def register(f: Callable[[Tables], DataFrame]) -> Callable:
        query(name, sql)(f)
        ORACLE_SQL[name] = _by_identity(ORACLE_SQL[name])
        return f

    return register


def _names(t: Tables) -> DataFrame:
    more = t.spark.createDataFrame([(code, market.OTHER[0], "") for code in market.OTHER[1]], "asset string, issuer string, contract string")
    return identity.dictionary(t.assets.select("asset", "issuer", "contract").unionByName(more), RESERVED)


def _keyed_1m(t: Tables) -> DataFrame:
    """Minute candles by key, stored as the others are."""
    made = lambda: candles.candles_1m(fills.fills(identity.keyed(market.issued_claims(t.spark, t.sf_dir), RESERVED))).drop("clamped")
    return t._stored("keyed", made, "lineitem").read("1m")


def _labelled(df: DataFrame, t: Tables, *legs: str) -> DataFrame:
    """Keys as the statements name them: the code, and a 2 for the other issuer."""
    rows = identity.named(df, _names(t), *legs)
    return rows.withColumns({leg: F.concat(F.col(f"{leg}_code"), F.when(F.col(f"{leg}_issuer") == market.OTHER[0], "2").otherwise("")) for leg in legs})


@keyed_query("f13_keyed_candles", f"select {shown()} from c1m")
def _(t: Tables) -> DataFrame:
    return round_shown(_labelled(_keyed_1m(t), t, "asset", "quote"))


@query("f13_key_collisions", "select count(*) as keys, count(distinct asset || ':' || issuer || ':' || case when issuer = '' then contract else '' end) as identities from (select distinct asset, issuer, case when issuer = '' then contract else '' end as contract from (select asset, issuer, contract from assets union all select 'AAA', 'GOTHER', '' union all select 'USDT', 'GOTHER', ''))")
def _(t: Tables) -> DataFrame:
    return _names(t).agg(F.count_distinct("key").alias("keys"), F.count_distinct("asset", "issuer", "contract").alias("identities"))


@keyed_query(
    "p16_keyed_prices",
    """select a.asset, round(price_usd, 8) as price_usd, method, round(coalesce(v.w, 0), 6) as vwap_24h, round(coalesce(price_usd * supply, 0), 0) as market_cap
from all_tips a left join (select asset, sum(price * volume) / nullif(sum(volume), 0) as w from masked group by 1) v using (asset) left join asset_supply using (asset)""",
)
def _(t: Tables) -> DataFrame:
    as_of = t.as_of
    p1m = stored(enrich.enrich(snapshot.needed(_keyed_1m(t), as_of), t.oracle, t.usd_rate))
    own = {code: issuer for code, _, issuer, _ in market.ASSETS}
    issuer = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in own.items() for x in kv]), F.col("asset")), F.lit(""))
    supply = t.supply.withColumn("asset", identity.key(F.col("asset"), issuer, F.lit(""), RESERVED))
    made = snapshot.current_prices(p1m, candles.rollup(candles.rollup(p1m, "15m"), "1h"), supply, t.usd_rate, as_of)
    return _labelled(made, t, "asset").select("asset", F.round("price_usd", 8).alias("price_usd"), "method", F.round("vwap_24h", 6).alias("vwap_24h"), F.round("market_cap", 0).alias("market_cap"))


@keyed_query("d19_keyed_tickers", "select regexp_replace(asset, '2$', '') as ticker, case when arg_max(asset, (n, case when asset like '%2' then 'GOTHER' else 'G' end)) like '%2' then 'GOTHER' else 'own' end as issuer, max(n) as candles from (select asset, count(*) as n from c1m where asset in (select asset from assets) or asset like '%2' group by 1) group by 1")
def _(t: Tables) -> DataFrame:
    """The issuer with most candles of each code, by the keys of the facts."""
    names = _names(t).withColumnRenamed("key", "asset_id")
    found = quality.canonical_ticker(_keyed_1m(t).select(F.col("asset").alias("asset_id")), names)
    return found.withColumn("issuer", F.when(F.col("issuer") == market.OTHER[0], F.col("issuer")).otherwise("own"))


# Series.


@query("u1_usd_reference", "select ts, round(sum(close * cast(pf_volume as double)) / sum(cast(pf_volume as double)), 8) as reference from c1d where asset = 'XLM' and quote = 'USDC' and pf_volume > 0 and close >= 1e-12 group by ts")
def _(t: Tables) -> DataFrame:
    return round_shown(series.usd_reference(t.c("1d")), "ts", "reference")


@query(
    "u2_price_usd_series",
    """select asset, ts, round(case when peg is not null and rpw = 0 then peg else rpv / rpw end, 8) as close_usd, case when peg is not null and rpw = 0 then peg_method else 'traded' end as method, cast(cast(case when peg is not null and rpw = 0 then 1.0 else rpw / rew end as decimal(10,6)) as double) as share from weighed
where (peg is not null and rpw = 0) or (rew > 0 and rpw > 0 and rpw / rew >= 0.5)""",
)
def _(t: Tables) -> DataFrame:
    return series.price_usd_series(t.p("1d"), t.usd_rate, "1d").select("asset", "ts", F.round("close_usd", 8).alias("close_usd"), "method", F.col("priced_volume_share").cast("double").alias("share"))


@query("u3_eligible_quotes", "select 'USDC' as quote union select 'XLM' union select 'USDT' union select asset from usd_rate")
def _(t: Tables) -> DataFrame:
    return series.eligible_quotes(t.usd_rate)


@query("u4_published", "select asset, count(*) as buckets from weighed where rew > 0 and rpw > 0 and rpw / rew >= 0.5 and not (peg is not null and rpw = 0) group by 1")
def _(t: Tables) -> DataFrame:
    return series.price_usd_series(t.p("1d"), t.usd_rate, "1d").where("method = 'traded'").groupBy("asset").agg(F.count("*").alias("buckets"))


@query("u5_peg_fill", "select ts, round(peg, 8) as rate, peg_method as method from weighed where peg is not null")
def _(t: Tables) -> DataFrame:
    return series.peg_rows(t.p("1d"), t.usd_rate, "1d").select("ts", F.round("peg", 8).alias("rate"), F.col("peg_method").alias("method"))


@query("u6_series_method", "select method, count(*) as buckets from (select case when peg is not null and rpw = 0 then peg_method else 'traded' end as method from weighed where (peg is not null and rpw = 0) or (rew > 0 and rpw > 0 and rpw / rew >= 0.5)) group by 1")
def _(t: Tables) -> DataFrame:
    return series.price_usd_series(t.p("1d"), t.usd_rate, "1d").groupBy("method").agg(F.count("*").alias("buckets"))


@query("u7_usd_coverage", "select asset, ts, cast(cast(coalesce(rpw / nullif(rew, 0), 0) as decimal(10,6)) as double) as share, round(usd, 2) as usd, case when peg is not null and rpw = 0 then 'priced' when rew = 0 then 'unpriceable' when rpw / rew >= 0.5 then 'priced' else 'pending' end as status from weighed")
def _(t: Tables) -> DataFrame:
    return series.usd_coverage(t.p("1d"), t.usd_rate, "1d").select("asset", "ts", F.col("share").cast("double").alias("share"), F.round("priced_usd", 2).alias("usd"), "status")


@query("u8_identity_by_contract", "select contract, asset, case when kind = 'contract' then 'token' else 'wrapper' end as via from assets where contract <> ''")
def _(t: Tables) -> DataFrame:
    return series.identity_by_contract(t.assets)


_NATURAL = "case when issuer = '' and contract = '' then 'native' when issuer <> '' then 'credit' else 'contract' end"
_NKEY = f"{_NATURAL} || ':' || asset || ':' || issuer || ':' || case when {_NATURAL} = 'contract' then contract else '' end"


@query("u9_current_price_usd", f"select {_NKEY} as natural_key, round(case when price_usd > 0 then price_usd end, 8) as price_usd, method from all_tips join assets using (asset)")
def _(t: Tables) -> DataFrame:
    return round_shown(series.current_price_usd(current(t), t.assets), "natural_key", "price_usd", "method")


@query("u10_natural_key", f"select asset, {_NATURAL} as natural_kind, {_NKEY} as natural_key from assets")
def _(t: Tables) -> DataFrame:
    return series.natural_key(t.assets)


# Reads.

_Q1_FLAGS = """with f as (select *, close_usd / nullif(close, 0) as rate, close >= 1e-12 and close_usd >= 1e-12 and (quote = 'USDC' or close_usd <> close) as conv, quote in ('USDC','XLM') as main, pf_trade_count > 0 as pf, cast(volume_base as double) as vb from p1d),
g as (select asset, ts, max(pf and main) as any_, sum(volume_quote_usd) as volume_usd, {} from f group by asset, ts),
m as (select asset, ts, volume_usd, {} from g)
select asset, ts, round(open, 8) as open, round(greatest(high, close), 8) as high, round(least(low, close), 8) as low, round(close, 8) as close, round(case when high is not null then greatest(least(vwap, greatest(high, close)), least(low, close)) end, 8) as vwap, round(greatest(least(pf_, greatest(high, close)), least(low, close)), 8) as pf_vwap, round(volume_usd, 2) as volume_usd from m"""
_g, _m = [], []
for _n, _f, _w in (("b", "conv and pf and main", "conv and main"), ("v", "conv and pf", "conv")):
    _g += [
        f"arg_max(open * rate, (volume_base, quote, source)) filter ({_f}) as {_n}_open",
        f"arg_max(close_usd, (volume_base, quote, source)) filter ({_f}) as {_n}_close",
        f"max(high * rate) filter ({_f}) as {_n}_high",
        f"min(low * rate) filter ({_f}) as {_n}_low",
        f"sum(vwap * rate * vb) filter ({_w}) / nullif(sum(vb) filter ({_w}), 0) as {_n}_vwap",
        f"sum(pf_price_volume * rate) filter ({_f}) / nullif(sum(cast(pf_volume as double)) filter ({_f}), 0) as {_n}_pf",
    ]
_m = [f"case when any_ then b_{k} else v_{k} end as {k}{'_' if k == 'pf' else ''}" for k in ("open", "high", "low", "close", "vwap", "pf")]


@query("q1_ohlcv_usd", _Q1_FLAGS.format(", ".join(_g), ", ".join(_m)))
def _(t: Tables) -> DataFrame:
    q = read.ohlcv_usd(t.p("1d"))
    return q.select("asset", "ts", *[F.round(c, 8).alias(c) for c in ("open", "high", "low", "close", "vwap", "pf_vwap")], F.round("volume_usd", 2).alias("volume_usd"))


_Q2 = "select asset, ts, arg_max(open, (volume_base, source)) filter (g) as open, max(high) filter (g) as high, min(low) filter (g) as low, arg_max(close, (volume_base, source)) filter (g) as close, sum(pf_price_volume) filter (g) / nullif(cast(sum(pf_volume) filter (g) as double), 0) as pf, cast(sum(trade_count) as bigint) as trade_count from (select *, pf_trade_count > 0 and close >= 1e-12 as g from c1h where quote = 'USDC') group by asset, ts"


@query("q2_ohlcv_quote", f"select asset, ts, round(open, 8) as open, round(high, 8) as high, round(low, 8) as low, round(close, 8) as close, round(greatest(least(pf, high), low), 8) as pf_vwap, trade_count from ({_Q2})")
def _(t: Tables) -> DataFrame:
    return read.ohlcv_quote(t.c("1h"), "USDC").select("asset", "ts", *[F.round(c, 8).alias(c) for c in ("open", "high", "low", "close", "pf_vwap")], "trade_count")


@query("q4_mark_divergence", f"select diverges, count(*) as buckets from (select coalesce(abs(close / greatest(least(pf, high), low) - 1) > 0.01, false) as diverges from ({_Q2})) group by all")
def _(t: Tables) -> DataFrame:
    return read.mark_divergence(read.ohlcv_quote(t.c("1h"), "USDC")).groupBy("diverges").agg(F.count("*").alias("buckets"))


_SOME_DAYS = "(select * from usd_rate where method <> 'external' or day(ts) % 9 = 0)"
_METHODS = {
    grain: f"""select '{grain}' as grain, quote, case when quote = 'USDC' and close_usd <> close and exists (select 1 from {_SOME_DAYS} u where u.method = 'external' and cast(u.ts as date) >= cast(c.ts as date) - 1 and cast(u.ts as date) <= cast(c.ts + interval {width} as date)) then 'external' when quote = 'USDC' and close_usd = close then 'assumed-par' when quote = 'USDC' then '' when quote in ('XLM','USDT') then 'traded' else '' end as method, count(*) as n from p{NAME.get(grain, grain)} c group by all"""
    for grain, width in (("1m", "1 minute"), ("1d", "1 day"), ("1w", "7 days"), ("1M", "1 month"))
}


@query("q5_usd_method", " union all ".join(_METHODS.values()))
def _(t: Tables) -> DataFrame:
    """With imported rates on every ninth day only."""
    some = t.usd_rate.where("method <> 'external' or day(ts) % 9 = 0")
    return reduce(DataFrame.unionByName, [read.usd_method(t.p(g), some, g).groupBy(F.lit(g).alias("grain"), "quote", "method").agg(F.count("*").alias("n")) for g in _METHODS])


@query(
    "q6_ohlcv_peg",
    """with b as (select *, ts + interval 1 hour as e, 1 as k from (select distinct ts from c1h where asset = 'XLM' and quote = 'USDC')),
o as (select b.ts, case when r.ts >= b.ts then r.rate end as oracle from b asof left join (select ts, rate, 1 as k from usd_rate where method = 'oracle') r on b.k = r.k and b.e > r.ts)
select o.ts, round(coalesce(oracle, d.rate, 1.0), 8) as close, case when oracle is not null then 'oracle' when d.rate is not null then 'external' else 'peg' end as method from o left join (select cast(ts as date) as day, arg_max(rate, ts) as rate from usd_rate where method = 'external' group by 1) d on cast(o.ts as date) = d.day""",
)
def _(t: Tables) -> DataFrame:
    return round_shown(read.ohlcv_peg(t.c("1h"), t.usd_rate, "1h"), "ts", "close", "method")


_HOURLY = "select date_trunc('hour', ts) as ts, arg_max(rate, ts) as rate, arg_max(quality, ts) as quality, 'external' as source from usd_rate where method = 'external' and hour(ts) % 5 <> 2 group by 1"


@query(
    "q7_ohlcv_native",
    f"""with h as ({_HOURLY}),
r as (select date_trunc('day', ts) as ts, arg_min(rate, ts) as open, max(rate) as high, min(rate) as low, arg_max(rate, ts) as close, avg(rate) as mean, case when max((quality = 'fallback')::int) = 1 then 'fallback' else 'measured' end as quality, case when count(distinct source) = 1 then min(source) end as rate_source from h where ts >= timestamp '2024-01-02' group by 1),
l as (select ts, ts + interval 1 hour as e, 1 as k, sum(volume_base) as v, sum(trade_count) as n from c1h where asset = 'XLM' and quote in ('USDC','USDT') group by 1),
a as (select l.*, case when epoch(l.e) - epoch(x.ts) <= 86400 then x.rate end as rate from l asof left join (select *, 1 as k from h) x on l.k = x.k and l.e > x.ts),
v as (select date_trunc('day', ts) as ts, sum(v) as volume_base, cast(sum(n) as bigint) as trade_count, sum(cast(v as double) * rate) as usd, sum(cast(v as double)) filter (rate is not null) as valued from a group by 1)
select r.ts, round(open, 8) as open, round(high, 8) as high, round(low, 8) as low, round(close, 8) as close, quality, rate_source, round(cast(coalesce(volume_base, 0) as double), 4) as volume_base, coalesce(trade_count, 0) as trade_count, round(coalesce(usd, 0), 4) as volume_usd, round(least(greatest(case when valued > 0 then usd / valued else mean end, low), high), 8) as vwap from r left join v on r.ts = v.ts""",
)
def _(t: Tables) -> DataFrame:
    """From the second day on; its first hours are valued at rates of the day before."""
    some = t.usd_rate.where("method = 'external' and hour(ts) % 5 <> 2")
    hourly = some.groupBy(F.date_trunc("hour", "ts").alias("h")).agg(F.max_by("rate", "ts").alias("rate"), F.max_by("quality", "ts").alias("quality")).select(F.col("h").alias("ts"), "rate", "quality", F.lit("external").alias("source"))
    dollar = t.spark.createDataFrame([("USDC",), ("USDT",)], "asset string")
    made = read.ohlcv_native(t.c("1h"), hourly, dollar, "1d", F.lit("2024-01-02").cast("timestamp"))
    return round_shown(made, "ts", "open", "high", "low", "close", "quality", "rate_source", "volume_base", "trade_count", "volume_usd", "vwap")


@query("q8_merge_series", "select ts, round(close, 8) as close from (select ts, rate as close from (select date_trunc('day', ts) as ts, max(rate) as rate from usd_rate where method = 'external' and ts < timestamp '2024-01-03' group by 1) union all select ts, ref as close from (select ts, sum(close) as ref from c1d where asset = 'XLM' and quote = 'USDC' group by 1) where ts >= timestamp '2024-01-03') order by ts desc limit 5")
def _(t: Tables) -> DataFrame:
    cut = F.lit("2024-01-03").cast("timestamp")
    made = t.usd_rate.where((F.col("method") == "external") & (F.col("ts") < cut)).groupBy(F.date_trunc("day", "ts").alias("ts")).agg(F.max("rate").alias("close"))
    own = t.c("1d").where("asset = 'XLM' and quote = 'USDC'").groupBy("ts").agg(F.sum("close").alias("close"))
    return round_shown(read.merge_series(own, made, 5), "ts", "close")


@query("q9_dollar_legs", "select asset, quote, count(*) as candles from c1d where asset = 'XLM' and quote in ('USDC','USDT') group by all")
def _(t: Tables) -> DataFrame:
    dollar = t.spark.createDataFrame([("USDC",), ("USDT",), ("AAA",)], "asset string")
    return read.dollar_legs(t.c("1d"), dollar, ["AAA"]).groupBy("asset", "quote").agg(F.count("*").alias("candles"))


@query("q11_newest", f"select asset, ts, round(close, 8) as close from ({_Q2}) where asset = 'AAA' order by ts desc limit 24")
def _(t: Tables) -> DataFrame:
    return round_shown(read.ohlcv_quote(t.c("1h").where("asset = 'AAA'"), "USDC", 24), "asset", "ts", "close")


_META = "select asset, lower(asset) || '.example' as home_domain from assets where asset not in ('BBB')"
_LISTED = f"select a.asset, kind, case when kind = 'contract' then coalesce(symbol, a.asset) else a.asset end as code, home_domain, coalesce(price_usd, 0) as sort_value from all_tips t join assets a on a.asset = t.asset left join ({_META}) m on m.asset = a.asset left join (select 'CZZZ' as contract, 'ZED' as symbol) s on s.contract = a.contract"


def _meta(t: Tables) -> dict[str, DataFrame]:
    return {"metadata": t.assets.where("asset <> 'BBB'").select("asset", F.concat(F.lower("asset"), F.lit(".example")).alias("home_domain")), "symbols": t.spark.createDataFrame([("CZZZ", "ZED")], "contract string, symbol string")}


@query("q12_list_assets", f"select asset, kind, code, home_domain, round(sort_value, 8) as sort_value from ({_LISTED}) order by round(sort_value, 12) desc, asset desc limit 3")
def _(t: Tables) -> DataFrame:
    return read.list_assets(current(t), t.assets, sort="price_usd", limit=3, **_meta(t)).select("asset", "kind", "code", "home_domain", F.round("sort_value", 8).alias("sort_value"))


@query("q12_list_by_code", f"select asset, kind, code, home_domain from ({_LISTED}) where kind = 'credit' order by code, asset limit 2")
def _(t: Tables) -> DataFrame:
    return read.list_assets(current(t), t.assets, kind="credit", sort="code", descending=False, limit=2, **_meta(t)).select("asset", "kind", "code", "home_domain")


@query("q13_page_after", "select c_custkey, round(c_acctbal, 2) as bal, (select count(*) from customer where c_acctbal < 5000.0 or (c_acctbal = 5000.0 and c_custkey < 50)) > 20 as has_more from customer where (c_acctbal, c_custkey) < (5000.0, 50) order by c_acctbal desc, c_custkey desc limit 20")
def _(t: Tables) -> DataFrame:
    c = market.table(t.spark, t.sf_dir, "customer").select("c_custkey", "c_acctbal")
    return read.page_after(c, "c_acctbal", "c_custkey", 5000.0, 50, 20).select("c_custkey", F.round("c_acctbal", 2).alias("bal"), "has_more")


_MEANT = "select r.ordinal, r.requested, coalesce(w.asset, r.requested) as asset from requests r left join (select contract, asset from assets where contract <> '') w on r.requested = w.contract"


@query("q15_prices_batch", f"select ordinal, requested, m.asset, round(coalesce(price_usd, 0), 8) as price_usd from ({_MEANT}) m join assets a on m.asset = a.asset left join all_tips t on t.asset = m.asset union all select ordinal, requested, null, null from ({_MEANT}) where asset not in (select asset from assets)")
def _(t: Tables) -> DataFrame:
    found, missing = read.prices_batch(t.requests, t.assets, current(t))
    none = missing.select("ordinal", "requested", F.lit(None).cast("string").alias("asset"), F.lit(None).cast("double").alias("price_usd"))
    return round_shown(found, "ordinal", "requested", "asset", "price_usd").unionByName(none)


@query("q16_resolve_aliases", _MEANT)
def _(t: Tables) -> DataFrame:
    return read.resolve_aliases(t.requests, t.assets)


@query("q17_apply_min_volume", "select asset, count(*) as venues, count(*) filter (volume > 1000000) as kept, round(coalesce(sum(price * volume) filter (volume > 1000000) / nullif(sum(volume) filter (volume > 1000000), 0), 0), 6) as vwap from venues group by asset")
def _(t: Tables) -> DataFrame:
    return read.apply_min_volume(snapshot.per_venue(t.p1m, t.as_of), 1_000_000.0).select("asset", "venues", "kept", F.round("vwap", 6).alias("vwap"))


@query("q18_oracles_for", "select asset, round(arg_max(price, ts), 8) as price, max(ts) as ts from oracle_prices group by asset")
def _(t: Tables) -> DataFrame:
    return round_shown(read.oracles_for(t.oracle, ["asset"]), "asset", "price", "ts")


# Data quality.


@query("d1_tier_lag", "select tier, cast(lag as bigint) as lag_seconds from (select '1m' as tier, epoch((select t from now)) - epoch(max(ts)) as lag from c1m union all select '15m', 1000000000 where exists (select 1 from c1h) union all select '1h', epoch((select t from now)) - epoch(max(ts)) from c1h union all select 'snapshot', epoch((select t from now)) - epoch(max(price_ts)) from all_tips)")
def _(t: Tables) -> DataFrame:
    """The quarters are empty, which the hours show to be wrong; the days are too, which nothing does."""
    none = t.c1m.where("false")
    tips = snapshot.rate_tip(snapshot.tip(t.p1m, t.as_of), t.usd_rate, t.as_of)
    lag = quality.tier_lag({"1m": t.c1m, "15m": none, "1h": t.c("1h"), "1d": none}, t.as_of)
    return lag.unionByName(quality.snapshot_lag(tips, "price_ts", t.as_of))


@query("d3_ohlc_band", "select tier, count(*) as scanned, count(*) filter (pf and low > least(open, close)) as low_above, count(*) filter (pf and high < greatest(open, close)) as high_below, count(*) filter (pf and low > high) as crossed, count(*) filter (pf and (open <= 0 or close <= 0)) as not_positive from (select '1m' as tier, *, pf_trade_count > 0 as pf from c1m union all select '1h', *, pf_trade_count > 0 from c1h) group by tier")
def _(t: Tables) -> DataFrame:
    return quality.ohlc_band({"1m": t.c1m, "1h": t.c("1h")})


@query("d4_zero_invariants", "select count(*) filter (pf_trade_count > 0 and close = 0) as formed_without_price, count(*) filter (pf_trade_count = 0 and close > 0) as price_without_forming, count(*) filter (close_usd > 0 and close = 0) as usd_without_close from p1m")
def _(t: Tables) -> DataFrame:
    return quality.zero_invariants(t.p1m)


@query("d5_stranded", "select count(*) as scanned, count(*) filter (close_usd = 0 and close >= 5e-14 and pf_trade_count > 0) as stranded from p1h where quote = 'USDT' and ts >= (select t from now) - interval 7 days and ts < (select t from now) - interval 2 days")
def _(t: Tables) -> DataFrame:
    return quality.stranded(t.p("1h"), "USDT", t.as_of)


@query("d6_peg_applied", "select count(*) as scanned, count(*) filter (abs(close_usd / close - 1) < 0.02) as pegged, case when count(*) > 0 then 'ok' else 'refused: nothing scanned' end as status from p1m where quote = 'XLM' and close_usd > 0")
def _(t: Tables) -> DataFrame:
    return quality.guarded(quality.peg_applied(t.p1m, "XLM"))


_TWINS = "select asset, issuer, contract from assets union all select 'USDT', 'GOTHER', '' union all select 'AAA', 'GOTHER', ''"


def _twins(t: Tables) -> DataFrame:
    """The registry and other issuers of two of its codes."""
    more = t.spark.createDataFrame([("USDT", "GOTHER", ""), ("AAA", "GOTHER", "")], "asset string, issuer string, contract string")
    return t.assets.select("asset", "issuer", "contract").unionByName(more).withColumn("asset_id", F.concat_ws(":", "asset", "issuer"))


@query(
    "d7_guarded",
    f"""with legs as (select asset as quote, count(*) as resolved from ({_TWINS}) where asset in ('USDC', 'USDT', 'XLM', 'ZZZ') group by 1 union all select 'NONE', 0),
seen as (select quote, count(*) as scanned, count(*) filter (abs(close_usd / nullif(close, 0) - 1) < 0.02) as pegged from p1m where close_usd > 0 group by 1)
select quote, resolved, coalesce(scanned, 0) as scanned, coalesce(pegged, 0) as pegged, case when resolved <> 1 then 'refused: leg is not one identity' when coalesce(scanned, 0) > 0 then 'ok' else 'refused: nothing scanned' end as status from legs left join seen using (quote)""",
)
def _(t: Tables) -> DataFrame:
    legs = _twins(t).where("asset in ('USDC', 'USDT', 'XLM', 'ZZZ')").groupBy(F.col("asset").alias("quote")).agg(F.count("*").alias("resolved"))
    legs = legs.unionByName(t.spark.createDataFrame([("NONE", 0)], "quote string, resolved long"))
    return quality.guarded(quality.peg_applied_to(t.p1m, legs), resolved="resolved")


@query("d8_id_collisions", "select count(*) - count(distinct c_nationkey) as collisions from customer")
def _(t: Tables) -> DataFrame:
    return quality.id_collisions(market.table(t.spark, t.sf_dir, "customer"), "c_nationkey")


@query("d9_orphan_candles", "select case when asset not in (select asset from assets) then asset else quote end as missing, count(*) as candles from c1m where asset not in (select asset from assets) or quote not in (select asset from assets) group by 1")
def _(t: Tables) -> DataFrame:
    return quality.orphan_candles(t.c1m, t.assets)


@query("d10_wrapper_identities", "select contract, asset, kind, issuer from assets where kind = 'contract' and contract in ('CZZZ','CAAA')")
def _(t: Tables) -> DataFrame:
    return quality.wrapper_identities(t.assets, t.spark.createDataFrame([("CZZZ",), ("CAAA",)], "contract string")).select("contract", "asset", "kind", "issuer")


_SWEEP = f"select *, topic0 || ' / ' || coalesce(topic1, '') as action, array_to_string(list_transform(cast(topics as json[]), lambda x: json_extract_string(x, '$.type')), '|') || ' -> ' || coalesce(json_extract_string(data, '$.type'), '') as shape from topic_events where event_kind = 'contract' and ledger >= (select max(ledger) from contract_events) - 300 and regexp_matches(topic0 || ' ' || coalesce(topic1, ''), '(?i)swap|trade') and not ({_POOLS_KEEP})"
_TOP = lambda c: f"(select contract, arg_max({c}, (n, {c})) as top_{c} from (select contract, {c}, count(*) as n from sweep group by all) group by 1)"
_SWEPT = f"with sweep as ({_SWEEP}) select contract, count(*) as events, count(distinct (ledger, tx)) as txs, min(ledger) as first_ledger, max(ledger) as last_ledger, any_value(top_action) as top_action, any_value(top_shape) as top_shape from sweep join {_TOP('action')} using (contract) join {_TOP('shape')} using (contract) group by contract"


@query("d11_coverage_sweep", _SWEPT)
def _(t: Tables) -> DataFrame:
    return events.coverage_sweep(t.events, t.pools, 300)


@query("d12_allowlist_partition", f"select contract, case when contract = 'C2' then 'allow-listed' when contract = 'C5' then 'unresolved' else 'unclassified' end as state from ({_SWEPT})")
def _(t: Tables) -> DataFrame:
    one = lambda *c: t.spark.createDataFrame([(x,) for x in c], "contract string")
    return events.allowlist_partition(events.coverage_sweep(t.events, t.pools, 300), one("C2", "CX"), one("C5"))[0].select("contract", "state")


@query("d14_unregistered_emitters", f"select cast(floor(ledger / 100) as bigint) as chunk, contract, count(*) as events from ({_SHAPED}) group by all")
def _(t: Tables) -> DataFrame:
    return events.unregistered_emitters(t.events, t.pools, 100)


@query("d16_overclaim", """with first as (select case source when 'sdex' then 'sdex' else 'contracts' end as g, min(ts) as f from c1h where source <> 'soroswap' group by 1), said as (select * from (values ('sdex', timestamp '2020-01-01'), ('more', timestamp '2024-01-01')) c(g, claimed))
select coalesce(c.g, f.g) as "group", case when claimed is null then 'no claim' when f is null then 'no candle' when claimed < f then 'overclaimed' else 'ok' end as status from said c full join first f on c.g = f.g union all
select 'late ' || g, case when f + interval 1 day < f then 'overclaimed' else 'ok' end from first""")
def _(t: Tables) -> DataFrame:
    hours = t.c("1h").where("source <> 'soroswap'")
    claims = t.spark.createDataFrame([("sdex", "2020-01-01"), ("more", "2024-01-01")], "group string, d string").select("group", F.col("d").cast("timestamp").alias("claimed"))
    late = hours.groupBy(F.when(F.col("source") == "sdex", "sdex").otherwise("contracts").alias("group")).agg((F.min("ts") + F.expr("interval 1 day")).alias("claimed"))
    later = quality.overclaim(hours, late).select(F.concat(F.lit("late "), F.col("group")).alias("group"), "status")
    return quality.overclaim(hours, claims).select("group", "status").unionByName(later)


@query("d18_largest_gap", "select asset, source, max(g) as gap_minutes from (select asset, source, (epoch(ts) - epoch(lag(ts, 1, ts) over (partition by asset, source order by ts))) / 60 as g from (select distinct asset, source, ts from c1m)) group by all")
def _(t: Tables) -> DataFrame:
    return quality.largest_gap(t.c1m)


@query("d19_canonical_ticker", f"""with busy as (select asset || ':' || coalesce(case when asset in ('AAA', 'USDT') and source <> 'sdex' then 'GOTHER' end, issuer) as id, count(*) as n from c1m join assets using (asset) group by 1)
select asset as ticker, arg_max(issuer, (n, issuer)) as issuer, max(n) as candles from ({_TWINS}) join busy on id = asset || ':' || issuer group by 1""")
def _(t: Tables) -> DataFrame:
    """Of two codes the candles off the order book are another issuer's."""
    own = t.c1m.join(t.assets.select("asset", "issuer"), "asset")
    other = F.col("asset").isin("AAA", "USDT") & (F.col("source") != "sdex")
    return quality.canonical_ticker(own.withColumn("asset_id", F.concat_ws(":", "asset", F.when(other, "GOTHER").otherwise(F.col("issuer")))), _twins(t))


@query("d20_venue_coverage", "select source, count(*) as candles, count(distinct asset) as assets, min(ts) as earliest, max(ts) as latest, date_diff('day', min(ts), max(ts)) + 1 as days from c1d group by source")
def _(t: Tables) -> DataFrame:
    return quality.venue_coverage(t.c("1d"))


@query("d21_month_completeness", "select strftime(ts, '%Y-%m') as month, count(distinct cast(ts as date)) as days, count(*) as candles, count(distinct asset) as assets from c1d group by 1")
def _(t: Tables) -> DataFrame:
    return quality.month_completeness(t.c("1d"))


@query("d22_recently_priced", "select asset, count(*) as candles, max(ts) as last from p1m where ts > (select t from now) - interval 24 hours and close_usd > 0 group by asset having count(*) >= 2 order by candles desc, asset limit 20")
def _(t: Tables) -> DataFrame:
    return quality.recently_priced(t.p1m, t.as_of)


_DAILY = "select event_type as series, cast(ts as date) as day, round(case when day(ts) between 5 and 9 then 1.0 else avg(value) end, 6) as close, count(*) filter (value > 10) as trades, round(sum(case when day(ts) = 7 then 0 else value end), 6) as volume from events group by event_type, cast(ts as date), day(ts)"


@query(
    "d23_series_guardrails",
    f"""with d as ({_DAILY}), a as (select *, lag(close) over w as prev from d window w as (partition by series order by day)),
b as (select *, coalesce(close = prev, false) as flat, ln(close / prev) as ret, sum(case when coalesce(close = prev, false) then 0 else 1 end) over (partition by series order by day) as island from a),
c as (select *, avg((trades = 0)::int) over r as zt, avg((flat and trades = 0)::int) over r as fnt, avg((close = 1.0)::int) over r as ap, avg((volume = 0)::int) over r as zv, case when count(ret) over r = 10 then stddev_samp(ret) over r * 10000 end as vb from b window r as (partition by series order by day rows between 9 preceding and current row))
select series, max(zt) as max_zero_trade, max(fnt) as max_flat_no_trade, max(ap) as max_at_peg, max(zv) as max_zero_volume, round(min(vb), 4) as min_vol_bps, any_value(n) as longest_run from c join (select series, max(n) as n from (select series, island, count(*) as n from b group by all) group by 1) using (series) group by series""",
)
def _(t: Tables) -> DataFrame:
    e = market.table(t.spark, t.sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    dom = F.dayofmonth("ts")
    daily = e.groupBy(F.col("event_type").alias("series"), F.to_date("ts").alias("day"), dom.alias("dom")).agg(F.avg("value").alias("v"), F.count_if(F.col("value") > 10).alias("trades"), F.round(F.sum(F.when(dom == 7, 0.0).otherwise(F.col("value"))), 6).alias("volume"))
    daily = daily.withColumn("close", F.round(F.when(F.col("dom").between(5, 9), 1.0).otherwise(F.col("v")), 6))
    out = quality.series_guardrails(daily.select("series", "day", "close", "trades", "volume"), 10)
    return out.withColumn("min_vol_bps", F.round("min_vol_bps", 4))


@query(
    "d24_rate_gap_bps",
    """with g as (select (c.close / r.price - 1) * 10000 as bps from (select date_trunc('hour', ts) as ts, arg_max(price, ts) as price from oracle_prices where asset = 'XLM' group by 1) r join (select ts, arg_max(close, (volume_base, source)) as close from c1h where asset = 'XLM' and quote = 'USDC' and close >= 1e-12 group by 1) c using (ts))
select count(*) as hours, round(quantile_cont(bps, 0.05), 2) as p05, round(quantile_cont(bps, 0.5), 2) as p50, round(quantile_cont(bps, 0.95), 2) as p95, round(quantile_cont(abs(bps), 0.99), 2) as abs_p99, round(max(abs(bps)), 2) as abs_max from g""",
)
def _(t: Tables) -> DataFrame:
    g = quality.rate_gap_bps(t.oracle, t.c("1h"))
    return g.select("hours", *[F.round(c, 2).alias(c) for c in ("p05", "p50", "p95", "abs_p99", "abs_max")])


@query(
    "d25_depeg_bands",
    "select case when off <= 0.001 then '<=10bps' when off <= 0.005 then '<=50bps' when off <= 0.02 then '<=200bps' else '>200bps' end as band, count(*) as candles, count(distinct asset) as assets from c1m join (select cast(ts as date) as day, abs(arg_max(rate, (ts, method)) - 1) as off from usd_rate group by 1) d on cast(c1m.ts as date) = d.day where quote = 'USDC' group by 1",
)
def _(t: Tables) -> DataFrame:
    return quality.depeg_bands(t.c1m, t.usd_rate)


@query("d26_priced_population", "select tier, quote, count(*) filter (b and p) as priced_before, count(*) filter (b and not p) as unpriced_before, count(*) filter (not b and p) as priced_after, count(*) filter (not b and not p) as unpriced_after from (select '1m' as tier, quote, ts < timestamp '2024-01-03' as b, close_usd > 0 as p from p1m union all select '1h', quote, ts < timestamp '2024-01-03', close_usd > 0 from p1h) group by all")
def _(t: Tables) -> DataFrame:
    return quality.priced_population({"1m": t.p1m, "1h": t.p("1h")}, F.lit("2024-01-03").cast("timestamp"))


@query("d27_outlier_prints", "select source, count(*) as candles, round(avg((abs(close / vwap - 1) > 0.05)::int), 8) as close_off, round(avg((high > 1.5 * vwap)::int), 8) as high_off, round(avg((low < 0.67 * vwap)::int), 8) as low_off from c1d where pf_trade_count > 0 and vwap > 0 group by source")
def _(t: Tables) -> DataFrame:
    return quality.outlier_prints(t.c("1d")).select("source", "candles", *[F.round(c, 8).alias(c) for c in ("close_off", "high_off", "low_off")])


@query(
    "d28_deviation_by_size",
    """select case when s < 1 then 'a <1' when s < 10000 then 'b <10k' when s < 50000 then 'c <50k' else 'd >=50k' end as band, count(*) as candles, round(quantile_cont(off, 0.5), 6) as p50, round(quantile_cont(off, 0.9), 6) as p90, round(avg((off > 0.05)::int), 8) as share_off
from (select cast(m.volume_quote as double) as s, abs(m.close / h.vwap - 1) as off from c1m m join c1h h on m.asset = h.asset and m.quote = h.quote and m.source = h.source and date_trunc('hour', m.ts) = h.ts where m.pf_trade_count > 0 and h.vwap > 0) group by 1""",
)
def _(t: Tables) -> DataFrame:
    return quality.deviation_by_size(t.c1m, t.c("1h")).select("band", "candles", F.round("p50", 6).alias("p50"), F.round("p90", 6).alias("p90"), F.round("share_off", 8).alias("share_off"))


@query(
    "d29_par_check",
    """with r as (select quote, ts, arg_max(close, (volume_base, source)) as close, cast(sum(volume_base) as double) as volume from c1d where asset = 'XLM' and close >= 1e-12 group by all),
w as (select *, sum(volume) over (partition by ts order by close, volume) as c, sum(volume) over (partition by ts) as t from r where volume > 0), m as (select ts, min(close) as mid from w where c * 2 >= t group by 1),
x as (select asset as quote, cast(ts as date) as day, arg_max(rate, ts) as rate from usd_rate where method = 'external' and rate > 0 group by all)
select r.quote, count(*) as days, round(sum(volume), 2) as volume, round(quantile_cont(abs(close / mid - 1), 0.5), 6) as median_off, count(rate) as external_days, round(quantile_cont(abs(mid / close / rate - 1), 0.5), 6) as median_off_external from r join m using (ts) left join x on x.quote = r.quote and x.day = cast(r.ts as date) group by r.quote""",
)
def _(t: Tables) -> DataFrame:
    external = t.usd_rate.where("method = 'external'").groupBy(F.col("asset").alias("quote"), F.to_date("ts").alias("day")).agg(F.max_by("rate", "ts").alias("rate"))
    return quality.par_check(t.c("1d"), external=external).select("quote", "days", F.round("volume", 2).alias("volume"), F.round("median_off", 6).alias("median_off"), "external_days", F.round("median_off_external", 6).alias("median_off_external"))


@query(
    "d30_interval_uptime",
    "select service, max(slot) - min(slot) + 1 as intervals, round(1 - sum(e) / (max(slot) - min(slot) + 1), 8) as uptime from (select user_id % 3 as service, cast(floor(epoch(ts) / 300) as bigint) as slot, avg((event_type = 'error')::int) as e from events group by all) group by service",
)
def _(t: Tables) -> DataFrame:
    r = market.table(t.spark, t.sf_dir, "events").select((F.col("user_id") % 3).alias("service"), F.col("ts").cast("timestamp").alias("ts"), (F.col("event_type") == "error").alias("failed"))
    return quality.interval_uptime(r).select("service", "intervals", F.round("uptime", 8).alias("uptime"))


@query("d31_lag_share", "select user_id % 3 as service, round(avg((value <= 10)::int), 8) as share, max(value) as max_lag from events group by 1")
def _(t: Tables) -> DataFrame:
    p = market.table(t.spark, t.sf_dir, "events").select((F.col("user_id") % 3).alias("service"), F.col("value").alias("lag"))
    return quality.lag_share(p, 10.0).select("service", F.round("share", 8).alias("share"), "max_lag")


# Queues and keys.


@query("k1_stalest_queue", "select asset, t as fetched_at from (select 'U' || c_nationkey as asset, min(o_orderdate) as t from customer left join orders on o_custkey = c_custkey and c_custkey % 3 > 0 group by 1) order by t nulls first, asset limit 10")
def _(t: Tables) -> DataFrame:
    c, o = market.table(t.spark, t.sf_dir, "customer"), market.table(t.spark, t.sf_dir, "orders")
    name = F.concat(F.lit("U"), F.col("c_nationkey").cast("string"))
    assets = c.select(name.alias("asset")).distinct().withColumn("kind", F.lit("credit"))
    fetched = c.where("c_custkey % 3 > 0").join(o, c["c_custkey"] == o["o_custkey"]).groupBy(name.alias("asset")).agg(F.min(F.col("o_orderdate").cast("timestamp")).alias("fetched_at"))
    return jobs.stalest_queue(assets, fetched, 10)


@query("k2_symbol_queue", "select contract, attempts from (select 'C' || s_suppkey as contract, s_nationkey % 5 as attempts, s_suppkey % 4 = 0 as known from supplier) where not known and attempts < 3 order by attempts, contract limit 15")
def _(t: Tables) -> DataFrame:
    s = market.table(t.spark, t.sf_dir, "supplier").withColumn("contract", F.concat(F.lit("C"), F.col("s_suppkey").cast("string")))
    tried = s.select("contract", F.when(F.col("s_suppkey") % 4 == 0, "SYM").alias("symbol"), (F.col("s_nationkey") % 5).alias("attempts"), F.lit("2024-01-01").cast("timestamp").alias("fetched_at"))
    return jobs.symbol_queue(s.select("contract"), tried, 15)


@query("k2_merge_answers", """select contract, case when s_suppkey % 3 = 0 and s_suppkey % 5 < 3 then 'S' || s_suppkey end as symbol, case when s_suppkey % 3 = 0 and s_suppkey % 5 < 3 then 0 when s_suppkey % 3 < 2 then s_nationkey % 5 + 1 else s_nationkey % 5 end as attempts
from (select *, 'C' || s_suppkey as contract from supplier) where s_suppkey % 4 > 0""")
def _(t: Tables) -> DataFrame:
    s = market.table(t.spark, t.sf_dir, "supplier").withColumn("contract", F.concat(F.lit("C"), F.col("s_suppkey").cast("string")))
    kind = F.col("s_suppkey") % 3
    answers = s.where("s_suppkey % 4 > 0").select("contract", F.when(kind == 0, "resolved").when(kind == 1, "negative").otherwise("failed").alias("outcome"), F.when(kind == 0, F.concat(F.when(F.col("s_suppkey") % 5 == 3, "S" * 32).when(F.col("s_suppkey") % 5 == 4, "\u202e").otherwise(" "), F.lit("S"), F.col("s_suppkey").cast("string"), F.lit("  "))).alias("symbol"))
    return jobs.merge_answers(s.select("contract", (F.col("s_nationkey") % 5).alias("attempts")), answers)


@query("k4_supply_total", "select s_suppkey as asset, round(abs(s_acctbal), 2) + 1.5 as supply from supplier where s_suppkey % 5 > 0")
def _(t: Tables) -> DataFrame:
    s = market.table(t.spark, t.sf_dir, "supplier")
    body = F.to_json(F.struct((F.col("s_suppkey") % 5 > 0).alias("found"), F.format_string("%.2f", F.abs("s_acctbal")).alias("balances_authorized"), F.lit("").alias("pools"), F.lit("1.5").alias("contracts")))
    return jobs.supply_total(s.select(F.col("s_suppkey").alias("asset"), body.alias("body"))).withColumn("supply", F.round("supply", 2))


_NEW = "case when asset in ('AAA','BBB') then 'same' else lower(asset) end"
_MAP = f"select asset as old_id, {_NEW} as new_id, case when count(*) over (partition by {_NEW}) > 1 then 'colliding' else 'mapped' end as state from assets union all select distinct asset, null, 'orphan' from (select asset from c1m union select quote from c1m) where asset <> '' and asset not in (select asset from assets)"


def _mapping(t: Tables) -> DataFrame:
    return jobs.id_map(t.assets, t.c1m, F.when(F.col("asset").isin("AAA", "BBB"), "same").otherwise(F.lower("asset")))


@query("k5_id_map", _MAP)
def _(t: Tables) -> DataFrame:
    return _mapping(t)


_COPIES = "select * from m union all select '', 'blank', 'mapped' union all select old_id || '2', new_id, state from m where state = 'mapped' and old_id < 'P1'"


@query("k6_id_map_gates", f"with m as ({_MAP}) select count(*) filter (old_id = '') as blank_ids, count(*) filter (state = 'colliding') as collisions, count(*) filter (state = 'mapped') - count(distinct new_id) filter (state = 'mapped') as repeated_copies from ({_COPIES})")
def _(t: Tables) -> DataFrame:
    """A mapping with a blank id, and ids that were copied twice."""
    m = _mapping(t)
    blank = t.spark.createDataFrame([("", "blank", "mapped")], "old_id string, new_id string, state string")
    twice = m.where("state = 'mapped' and old_id < 'P1'").withColumn("old_id", F.concat("old_id", F.lit("2")))
    return jobs.id_map_gates(m.unionByName(blank).unionByName(twice))


@query("k7_rewrite_ids", f"with m as ({_MAP}) select a.new_id as asset, q.new_id as quote, source, ts, version from c1m join m a on c1m.asset = a.old_id and a.state = 'mapped' join m q on c1m.quote = q.old_id and q.state = 'mapped'")
def _(t: Tables) -> DataFrame:
    return jobs.rewrite_ids(t.c1m, _mapping(t)).select("asset", "quote", "source", "ts", "version")


@query("k8_classify_rows", f"with m as (select old_id, case state when 'mapped' then 0 when 'colliding' then 2 else 1 end as score from ({_MAP})) select ['copied', 'orphan', 'colliding', 'unmapped'][greatest(coalesce(a.score, 3), coalesce(q.score, 3)) + 1] as state, count(*) as rows from c1m left join m a on c1m.asset = a.old_id left join m q on c1m.quote = q.old_id group by 1")
def _(t: Tables) -> DataFrame:
    return jobs.classify_counts(t.c1m, _mapping(t))


_UNIQUE = "select '{}' as what, (select count(*) = count(distinct asset) from ({})) as assets_unique, (select coalesce(max(n) <= 1, true) from (select count(*) as n from ({}) group by asset, quote, source, ts)) as one_row_per_key"


_COPIED = "select strftime(ts, '%Y-%m') as month, count(*) filter (asset in ('AAA', 'BBB') or quote in ('AAA', 'BBB')) as colliding_rows from c1m group by 1 union all select '2023-12', 3 union all select '2023-11', 0"
_RESTORED = {"same": "select 'AAA' as old_id, 'same' as new_id, 'colliding' as state union all select 'BBB', 'same', 'colliding' union all select 'XLM', 'xlm', 'mapped'", "shared": "select 'AAA', 'same', 'colliding' union all select 'BBB', 'same', 'colliding' union all select 'XLM', 'same', 'mapped'"}


@query(
    "k9_colliding_restored",
    " union all ".join(
        f"""select '{what}' as mapping, m.month, m.colliding_rows, m.colliding_rows = 0 or exists (select 1 from (select ts, case when asset in ('AAA', 'BBB') then 'same' else asset end as asset, quote from c1m) c where strftime(c.ts, '%Y-%m') = m.month and (c.asset in (select new_id from i_{what}) or c.quote in (select new_id from i_{what}))) as restored
from ({_COPIED}) m"""
        for what in _RESTORED
    ).join(["with " + ", ".join(f"i_{what} as (select new_id from ({sql}) x(old_id, new_id, state) group by 1 having count(*) filter (state = 'colliding') > 0 and count(*) filter (state = 'mapped') = 0)" for what, sql in _RESTORED.items()) + " ", ""]),
)
def _(t: Tables) -> DataFrame:
    """Rows of two ids that were one are back in the trades' month, and nowhere else; and the same where a clean id shares theirs."""
    either = F.col("asset").isin("AAA", "BBB") | F.col("quote").isin("AAA", "BBB")
    months = t.c1m.groupBy(F.date_format("ts", "yyyy-MM").alias("month")).agg(F.count_if(either).alias("colliding_rows")).unionByName(t.spark.createDataFrame([("2023-12", 3), ("2023-11", 0)], "month string, colliding_rows long"))
    facts = t.c1m.withColumn("asset", F.when(F.col("asset").isin("AAA", "BBB"), "same").otherwise(F.col("asset")))
    of = lambda xlm: t.spark.createDataFrame([("AAA", "same", "colliding"), ("BBB", "same", "colliding"), ("XLM", xlm, "mapped")], "old_id string, new_id string, state string")
    return reduce(DataFrame.unionByName, [jobs.colliding_restored(facts, of(xlm), months).select(F.lit(what).alias("mapping"), "*") for what, xlm in (("same", "xlm"), ("shared", "same"))])


@query("k9_post_checks", _UNIQUE.format("whole", "select asset from assets", "select * from c1m") + " union all " + _UNIQUE.format("twice", "select asset from assets union all select asset from assets where asset < 'B'", "select asset, quote, source, ts from c1m union all select asset, quote, source, ts from c1m where source = 'sdex'"))
def _(t: Tables) -> DataFrame:
    """The tables, and the tables with rows that stand twice."""
    c, a = t.c1m.select(*candles.KEYS), t.assets
    twice = jobs.post_checks(a.unionByName(a.where("asset < 'B'")), c.unionByName(c.where("source = 'sdex'")), candles.KEYS)
    return jobs.post_checks(a, c, candles.KEYS).select(F.lit("whole").alias("what"), "*").unionByName(twice.select(F.lit("twice").alias("what"), "*"))
