"""Market tables seen in the test tables: fills, rates, supply, events and requests."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

EPOCH = "2024-01-01 00:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def table_stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The files of a table as a stream; a pattern, as the table may be a file or a folder of files."""
    return spark.readStream.schema(table(spark, sf_dir, name).schema).parquet(f"{sf_dir}/{name}.parque[t]")


def _pick(c: Column, *names: str) -> Column:
    return F.get(F.array(*[F.lit(n) for n in names]), (c % len(names)).cast("int"))


def claims(spark: SparkSession, sf_dir: str, stream: bool = False) -> DataFrame:
    """Raw trades of integer amounts, some with the price of the offer that was taken; as a stream of files, if asked for."""
    t = table(spark, sf_dir, "lineitem")
    if stream:
        t = table_stream(spark, sf_dir, "lineitem")
    dust, offered = F.col("l_tax") == 0, (F.col("l_returnflag") == "A") & (F.col("l_discount") > 0.05)
    cents = F.round(F.col("l_extendedprice") * 100)
    return t.select(
        F.col("l_orderkey").alias("ledger"),
        F.col("l_linenumber").cast("long").alias("tx"),
        (F.col("l_suppkey") % 100).alias("op"),
        F.lit(0).cast("long").alias("claim"),
        F.timestamp_seconds(F.unix_timestamp(F.lit(EPOCH).cast("timestamp")) + F.col("l_orderkey") % 43200 * 60).alias("closed_at"),
        _pick(F.col("l_partkey"), "XLM", "AAA", "BBB", "CCC").alias("sold"),
        _pick(F.col("l_suppkey"), "USDC", "XLM", "USDT").alias("bought"),
        F.when(F.col("l_returnflag") == "A", "sdex").when(F.col("l_returnflag") == "N", "aquarius").otherwise("soroswap").alias("source"),
        F.when(dust, F.col("l_quantity")).otherwise(F.col("l_quantity") * 10_000_000).cast("long").alias("amount_sold"),
        F.when(dust, F.col("l_linenumber") * 3).otherwise(cents * 100_000).cast("long").alias("amount_bought"),
        F.when(offered, cents).alias("offer_n"),
        F.when(offered, F.col("l_quantity") * 100).alias("offer_d"),
    )


CLAIMS_SQL = """claims as (
select l_orderkey as ledger, cast(l_linenumber as bigint) as tx, l_suppkey % 100 as op, cast(0 as bigint) as claim,
  timestamp '2024-01-01 00:00:00' + to_minutes(cast(l_orderkey % 43200 as bigint)) as closed_at,
  ['XLM','AAA','BBB','CCC'][l_partkey % 4 + 1] as sold, ['USDC','XLM','USDT'][l_suppkey % 3 + 1] as bought,
  case l_returnflag when 'A' then 'sdex' when 'N' then 'aquarius' else 'soroswap' end as source,
  cast(case when l_tax = 0 then l_quantity else l_quantity * 10000000 end as bigint) as amount_sold,
  cast(case when l_tax = 0 then l_linenumber * 3 else round(l_extendedprice * 100) * 100000 end as bigint) as amount_bought,
  case when l_returnflag = 'A' and l_discount > 0.05 then round(l_extendedprice * 100) end as offer_n,
  case when l_returnflag = 'A' and l_discount > 0.05 then l_quantity * 100 end as offer_d
from lineitem)"""


def oracle_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings of USD prices; several in one second are merged, the last event winning."""
    e = table(spark, sf_dir, "events").where(F.col("event_type").isin("view", "click"))
    usdc = F.col("user_id") % 2 == 0
    rows = e.select(
        F.timestamp_seconds(F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000)).alias("ts"),
        F.when(usdc, "USDC").otherwise("XLM").alias("asset"),
        F.when(usdc, 0.98 + F.floor("value") % 40 / 1000).otherwise(0.1 + F.floor("value") % 50 / 1000).alias("price"),
        "event_id",
    )
    return rows.groupBy("asset", "ts").agg(F.max_by("price", "event_id").alias("price"))


ORACLE_SQL = """oracle_prices as (
select asset, ts, arg_max(price, event_id) as price from (
  select event_id, date_trunc('second', ts) as ts, case when user_id % 2 = 0 then 'USDC' else 'XLM' end as asset,
    case when user_id % 2 = 0 then 0.98::double + (floor(value)::bigint % 40)::double / 1000 else 0.1::double + (floor(value)::bigint % 50)::double / 1000 end as price
  from events where event_type in ('view','click')) group by all)"""


def usd_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measured and imported USDC rates, with two rows exactly on bucket edges."""
    e = table(spark, sf_dir, "events").where(F.col("event_type").isin("view", "click", "purchase"))
    rows = e.select(
        F.lit("USDC").alias("asset"),
        F.timestamp_seconds(F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000)).alias("ts"),
        F.when(F.col("event_type") == "purchase", "external").otherwise("oracle").alias("method"),
        (0.98 + F.floor("value") % 40 / 1000).alias("rate"),
        F.when(F.col("event_id") % 5 == 0, "fallback").otherwise("measured").alias("quality"),
        F.col("event_id").alias("version"),
    )
    edge = spark.range(2).select(F.lit("USDC").alias("asset"), F.timestamp_seconds(F.unix_timestamp(F.lit(EPOCH).cast("timestamp")) + (F.col("id") + 1) * 3600).alias("ts"), F.lit("external").alias("method"), F.lit(0.99).alias("rate"), F.lit("measured").alias("quality"), (F.col("id") - 2).alias("version"))
    rows = rows.unionByName(edge)
    return rows.groupBy("asset", "ts", "method").agg(F.max_by("rate", "version").alias("rate"), F.max_by("quality", "version").alias("quality"), F.max("version").alias("version"))


RATE_SQL = """usd_rate as (
select 'USDC' as asset, ts, method, arg_max(rate, version) as rate, arg_max(quality, version) as quality, max(version) as version from (
  select date_trunc('second', ts) as ts, case when event_type = 'purchase' then 'external' else 'oracle' end as method,
    0.98::double + (floor(value)::bigint % 40)::double / 1000 as rate, case when event_id % 5 = 0 then 'fallback' else 'measured' end as quality, event_id as version
  from events where event_type in ('view','click','purchase')
  union all select timestamp '2024-01-01 01:00:00', 'external', 0.99::double, 'measured', -2
  union all select timestamp '2024-01-01 02:00:00', 'external', 0.99::double, 'measured', -1) group by all)"""


def asset_supply(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    return c.groupBy(_pick(F.col("c_custkey"), "XLM", "AAA", "BBB", "CCC").alias("asset")).agg(F.sum(F.abs(F.round(F.col("c_acctbal") * 100).cast("long"))).alias("cents")).select("asset", (F.col("cents") / 100).alias("supply"))


SUPPLY_SQL = "asset_supply as (select ['XLM','AAA','BBB','CCC'][c_custkey % 4 + 1] as asset, sum(abs(cast(round(c_acctbal * 100) as bigint))) / 100.0::double as supply from customer group by 1)"

#: The registry of the test markets.
ASSETS = (
    ("XLM", "native", "", ""),
    ("USDC", "credit", "GUSDC", "CUSDC"),
    ("USDT", "credit", "GUSDT", ""),
    ("AAA", "credit", "GAAA", "CAAA"),
    ("BBB", "credit", "GBBB", ""),
    ("ZZZ", "contract", "", "CZZZ"),
)


#: The issuer that some tokens of these codes have off the order book.
OTHER = ("GOTHER", ("AAA", "USDT"))


def issued_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The claims with the issuers of both legs, two codes having two issuers each."""
    issuer = F.create_map(*[F.lit(x) for code, _, by, _ in ASSETS for x in (code, by)])
    of = lambda leg: F.when(F.col(leg).isin(*OTHER[1]) & (F.col("source") != "sdex"), OTHER[0]).otherwise(F.coalesce(F.try_element_at(issuer, F.col(leg)), F.lit("")))
    return claims(spark, sf_dir).withColumns({f"{leg}_issuer": of(leg) for leg in ("sold", "bought")})


def assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identities by code: the test markets (CCC is missing on purpose) and a token for every part."""
    fixed = spark.createDataFrame(list(ASSETS), "asset string, kind string, issuer string, contract string")
    n, classic = F.col("p_partkey").cast("string"), F.col("p_partkey") % 2 == 0
    parts = table(spark, sf_dir, "part").select(
        F.concat(F.lit("P"), n).alias("asset"),
        F.when(classic, "credit").otherwise("contract").alias("kind"),
        F.when(classic, F.concat(F.lit("GP"), n)).otherwise("").alias("issuer"),
        F.when(F.col("p_partkey") % 4 == 2, "").otherwise(F.concat(F.lit("CP"), n)).alias("contract"),
    )
    return fixed.unionByName(parts)


ASSETS_SQL = (
    "assets as (select * from (values "
    + ", ".join(str(a) for a in ASSETS)
    + """) t(asset, kind, issuer, contract) union all select 'P' || p_partkey, case when p_partkey % 2 = 0 then 'credit' else 'contract' end,
  case when p_partkey % 2 = 0 then 'GP' || p_partkey else '' end, case when p_partkey % 4 = 2 then '' else 'CP' || p_partkey end from part)"""
)


#: Fields of a swap that is written as one event for each: whole, with more than is needed, and lacking one.
_FIELDS = (["sell_token", "buy_token", "offer_amount"], ["sender", "sell_token", "buy_token", "offer_amount", "return_amount", "spread_amount"], ["sell_token", "buy_token", "offer_amount", "return_amount"])


def contract_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract events with typed JSON topics and data: swaps in six shapes, and pools that four factories make."""
    e = table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("long")).withColumn("v", F.floor(F.col("value") * 100).cast("long"))
    fields = [F.array(*[F.lit(x) for x in f]) for f in _FIELDS]
    rows = F.when(F.col("event_type") == "error", F.when(F.col("event_id") % 5 == 0, fields[0]).when(F.col("event_id") % 5 == 1, fields[1]).otherwise(fields[2])).otherwise(F.array(F.lit("")))
    e = e.select("*", F.posexplode(rows).alias("i", "f"))
    contract = F.concat(F.lit("C"), (F.col("user_id") % 12).cast("string"))
    pool = F.concat(F.lit("C"), (F.col("k") % 16).cast("string"))

    def one(kind: str, value: Column | str) -> Column:
        return F.concat(F.lit(f'{{"type":"{kind}","value":"'), (F.lit(value) if isinstance(value, str) else value).cast("string"), F.lit('"}'))

    def listed(*parts: Column) -> Column:
        return F.concat(F.lit("["), F.concat_ws(",", *parts), F.lit("]"))

    def keyed(**parts: Column) -> Column:
        return F.concat(F.lit("{"), F.concat_ws(",", *[F.concat(F.lit(f'"{k}":'), v) for k, v in parts.items()]), F.lit("}"))

    zero, kind, four = F.lit(0), F.col("event_type"), F.col("event_id") % 4
    signed, back = (kind == "view") & (F.col("event_id") % 2 == 0), F.col("event_id") % 3 == 0
    token = F.when(F.col("k") % 2 == 0, "AAA").otherwise("BBB")
    topics = (
        F.when(signed, listed(one("sym", "swap"), one("address", "G1")))
        .when(kind == "view", listed(one("string", "SoroswapPair"), one("sym", "swap")))
        .when(kind == "click", listed(one("sym", "trade"), one("address", "AAA"), one("address", "USDC")))
        .when(kind == "purchase", listed(one("sym", "POOL"), one("sym", "swap")))
        .when(kind == "error", listed(one("string", "swap"), one("string", F.col("f"))))
        .when(four == 0, listed(one("string", "SoroswapFactory"), one("sym", "new_pair")))
        .when(four == 1, listed(one("sym", "add_pool")))
        .when(four == 2, listed(one("sym", "create"), one("sym", "liquidity_pool")))
        .otherwise(listed(one("sym", "pool_created")))
    )
    num = lambda c: one("i128", c)
    tokens = [one("address", token), F.when(F.col("k") % 7 == 0, one("sym", "")).otherwise(one("address", "USDC"))]
    data = (
        F.when(signed, keyed(amount0=num(F.col("k") - 20), amount1=num(-3 * (F.col("k") - 20))))
        .when((kind == "view") & back, keyed(amount_0_in=num(zero), amount_1_in=num(F.col("k") + 1), amount_0_out=num(F.col("v")), amount_1_out=num(zero)))
        .when(kind == "view", keyed(amount_0_in=num(F.col("k")), amount_1_in=num(zero), amount_0_out=num(zero), amount_1_out=num(F.col("v"))))
        .when(kind == "click", listed(num(F.col("k")), num(F.col("v")), num(F.lit(1))))
        .when(kind == "purchase", keyed(token_in=one("address", "BBB"), token_out=one("address", "XLM"), token_amount_in=num(F.col("k") - 20), token_amount_out=num(F.col("v"))))
        .when((kind == "error") & F.col("f").isin("sell_token", "buy_token", "sender"), one("address", F.when(F.col("f") == "sell_token", token).when(F.col("f") == "buy_token", "USDC").otherwise("G1")))
        .when(kind == "error", num(F.when(F.col("f") == "offer_amount", F.col("k") + 1).otherwise(F.col("v"))))
        .when(four == 0, keyed(token_0=tokens[0], token_1=tokens[1], pair=one("address", pool)))
        .when(four == 1, listed(one("sym", "stable"), one("address", pool)))
        .when(four == 2, one("address", pool))
        .otherwise(keyed(fee=num(F.lit(30)), pool_address=one("address", pool), token0=tokens[0], token1=tokens[1]))
    )
    return e.select(
        "event_id",
        F.floor(F.col("event_id") / 10).cast("long").alias("ledger"),
        F.floor(F.col("event_id") / 2).cast("long").alias("tx"),
        (F.col("event_id") % 10 * 10 + F.col("i")).cast("long").alias("event_index"),
        contract.alias("contract"),
        F.when(F.col("event_id") % 17 == 0, "diagnostic").otherwise("contract").alias("event_kind"),
        F.col("ts").cast("timestamp").alias("closed_at"),
        topics.alias("topics"),
        data.alias("data"),
    )


EVENTS_SQL = """contract_events as (
select event_id, event_id // 10 as ledger, event_id // 2 as tx, event_id % 10 * 10 + i as event_index, 'C' || (user_id % 12)::varchar as contract,
  case when event_id % 17 = 0 then 'diagnostic' else 'contract' end as event_kind, ts as closed_at,
  case when event_type = 'view' and event_id % 2 = 0 then '[' || sym('swap') || ',' || adr('G1') || ']'
    when event_type = 'view' then '[' || str('SoroswapPair') || ',' || sym('swap') || ']'
    when event_type = 'click' then '[' || sym('trade') || ',' || adr('AAA') || ',' || adr('USDC') || ']'
    when event_type = 'purchase' then '[' || sym('POOL') || ',' || sym('swap') || ']'
    when event_type = 'error' then '[' || str('swap') || ',' || str(f) || ']'
    when event_id % 4 = 0 then '[' || str('SoroswapFactory') || ',' || sym('new_pair') || ']'
    when event_id % 4 = 1 then '[' || sym('add_pool') || ']'
    when event_id % 4 = 2 then '[' || sym('create') || ',' || sym('liquidity_pool') || ']'
    else '[' || sym('pool_created') || ']' end as topics,
  case when event_type = 'view' and event_id % 2 = 0 then '{"amount0":' || num(k - 20) || ',"amount1":' || num(-3 * (k - 20)) || '}'
    when event_type = 'view' and event_id % 3 = 0 then '{"amount_0_in":' || num(0) || ',"amount_1_in":' || num(k + 1) || ',"amount_0_out":' || num(v) || ',"amount_1_out":' || num(0) || '}'
    when event_type = 'view' then '{"amount_0_in":' || num(k) || ',"amount_1_in":' || num(0) || ',"amount_0_out":' || num(0) || ',"amount_1_out":' || num(v) || '}'
    when event_type = 'click' then '[' || num(k) || ',' || num(v) || ',' || num(1) || ']'
    when event_type = 'purchase' then '{"token_in":' || adr('BBB') || ',"token_out":' || adr('XLM') || ',"token_amount_in":' || num(k - 20) || ',"token_amount_out":' || num(v) || '}'
    when event_type = 'error' and f in ('sell_token', 'buy_token', 'sender') then adr(case f when 'sell_token' then token when 'buy_token' then 'USDC' else 'G1' end)
    when event_type = 'error' then num(case f when 'offer_amount' then k + 1 else v end)
    when event_id % 4 = 0 then '{"token_0":' || adr(token) || ',"token_1":' || second || ',"pair":' || adr(pool) || '}'
    when event_id % 4 = 1 then '[' || sym('stable') || ',' || adr(pool) || ']'
    when event_id % 4 = 2 then adr(pool)
    else '{"fee":' || num(30) || ',"pool_address":' || adr(pool) || ',"token0":' || adr(token) || ',"token1":' || second || '}' end as data
from (select *, case when k % 2 = 0 then 'AAA' else 'BBB' end as token, 'C' || (k % 16)::varchar as pool, case when k % 7 = 0 then sym('') else adr('USDC') end as second, unnest(fields) as f, generate_subscripts(fields, 1) - 1 as i from (
  select *, cast(json_extract_string(props, '$.k') as bigint) as k, cast(floor(value * 100) as bigint) as v,
    case when event_type = 'error' then (case event_id % 5 when 0 then FIELDS0 when 1 then FIELDS1 else FIELDS2 end) else [''] end as fields from events)))"""
for _i, _f in enumerate(_FIELDS):
    EVENTS_SQL = EVENTS_SQL.replace(f"FIELDS{_i}", str(_f))
for _name, _type in (("num", "i128"), ("sym", "sym"), ("adr", "address"), ("str", "string")):
    EVENTS_SQL = re.sub(rf"\b{_name}\(((?:[^()]|\([^()]*\))*)\)", rf"""'{{"type":"{_type}","value":"' || (\1)::varchar || '"}}'""", EVENTS_SQL)


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requested identities, with repeats and unknown ones."""
    s = table(spark, sf_dir, "supplier")
    return s.select(F.col("s_suppkey").alias("ordinal"), _pick(F.col("s_suppkey") * 7 + F.col("s_nationkey"), "XLM", "AAA", "CAAA", "BBB", "QQQ", "USDC", "CUSDC", "CNONE").alias("requested"))


REQUESTS_SQL = "requests as (select s_suppkey as ordinal, ['XLM','AAA','CAAA','BBB','QQQ','USDC','CUSDC','CNONE'][(s_suppkey * 7 + s_nationkey) % 8 + 1] as requested from supplier)"
