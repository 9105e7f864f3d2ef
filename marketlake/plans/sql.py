"""The test tables and derived tables in DuckDB SQL, for statements of what queries must return."""

from __future__ import annotations

import re

from marketlake.sources import market

PRICES = ("open", "high", "low", "close", "close_usd", "vwap")
VOLUMES = ("volume_base", "volume_quote", "volume_quote_usd", "pf_volume", "pf_price_volume")
COUNTS = ("trade_count", "version", "pf_trade_count")
KEYS = ("asset", "quote", "source", "ts")

_GATE = "pf_trade_count > 0 and close >= 1e-12"
_RATED = "close_usd >= 1e-12 and close >= 1e-12"
TRUNC = {"15m": "time_bucket(interval 15 minutes, {})", "1h": "time_bucket(interval 1 hour, {})", "4h": "time_bucket(interval 4 hours, {})", "1d": "date_trunc('day', {})", "1w": "cast(date_trunc('week', {}) as timestamp)", "1M": "cast(date_trunc('month', {}) as timestamp)"}
CHILD = {"15m": "1m", "1h": "15m", "4h": "1h", "1d": "4h", "1w": "1d", "1M": "1d"}


def rollup(child: str, grain: str) -> str:
    sums = ", ".join(f"sum({c}) as {c}" for c in ("volume_base", "volume_quote", "volume_quote_usd", "pf_volume", "pf_price_volume")) + ", " + ", ".join(f"cast(sum({c}) as bigint) as {c}" for c in COUNTS)
    return f"""(select ts, asset, quote, source, open, high, low, close, volume_base, volume_quote, volume_quote_usd, coalesce(close * rate, 0.0) as close_usd,
  coalesce(cast(volume_quote as double) / nullif(cast(volume_base as double), 0), 0) as vwap, trade_count, version, pf_trade_count, pf_volume, pf_price_volume from (
  select asset, quote, source, {TRUNC[grain].format("ts")} as ts, coalesce(arg_min(open, ts) filter ({_GATE}), 0) as open, coalesce(max(high) filter ({_GATE}), 0) as high,
    coalesce(min(low) filter ({_GATE}), 0) as low, coalesce(arg_max(close, ts) filter ({_GATE}), 0) as close, {sums}, arg_max(close_usd / close, ts) filter ({_RATED}) as rate
  from {child} group by asset, quote, source, {TRUNC[grain].format("ts")}))"""


def _valued(rows: str, rate: str) -> str:
    return f"select ts, asset, quote, source, open, high, low, close, volume_base, volume_quote, {rate} * cast(volume_quote as double) as volume_quote_usd, {rate} * close as close_usd, vwap, trade_count, version + 1 as version, pf_trade_count, pf_volume, pf_price_volume from {rows}"


_REST = "select * from {0} c where not exists (select 1 from {1} t where t.asset = c.asset and t.quote = c.quote and t.source = c.source and t.ts = c.ts)"
_COLS = "ts, asset, quote, source, open, high, low, close, volume_base, volume_quote, volume_quote_usd, close_usd, vwap, trade_count, version, pf_trade_count, pf_volume, pf_price_volume"
_RANK = "(case {} when 'USDC' then 0 when 'USDT' then 1 when 'XLM' then 2 else 3 end)"
_INV = f"({_RANK.format('sold')} < {_RANK.format('bought')} or ({_RANK.format('sold')} = 3 and {_RANK.format('bought')} = 3 and bought < sold))"
BOUND = "({a} > 1000 and {b} > 1000 and cast({a} - 1000 as double) >= ceil(1e6 / cast({b} - 1000 as double)))"

TABLES: dict[str, str] = {
    "claims": market.CLAIMS_SQL,
    "oracle_prices": market.ORACLE_SQL,
    "usd_rate": market.RATE_SQL,
    "asset_supply": market.SUPPLY_SQL,
    "assets": market.ASSETS_SQL,
    "contract_events": market.EVENTS_SQL,
    "requests": market.REQUESTS_SQL,
    "fills": f"""fills as (select *, (offer_priced or {BOUND.format(a="amount_base", b="amount_quote")}) and round(price, 14) between 1e-12 and 1e24 as price_forming,
  cast(cast(amount_base as double) / 1e7 as decimal(38,14)) as volume_base, cast(cast(amount_quote as double) / 1e7 as decimal(38,14)) as volume_quote from (
  select *, case when offer_priced then case when inverted then offer_d / offer_n else offer_n / offer_d end else cast(amount_quote as double) / cast(amount_base as double) end as price from (
  select *, case when inverted then bought else sold end as base, case when inverted then sold else bought end as quote, case when inverted then amount_bought else amount_sold end as amount_base,
    case when inverted then amount_sold else amount_bought end as amount_quote, offer_n is not null and offer_d is not null as offer_priced from (
  select *, {_INV} as inverted from claims where amount_sold > 0 and amount_bought > 0 and sold <> bought))))""",
    "c1m": """c1m as (select ts, asset, quote, source, open, high, low, close, volume_base, volume_quote, 0.0::double as volume_quote_usd, 0.0::double as close_usd,
  coalesce(cast(volume_quote as double) / nullif(cast(volume_base as double), 0), 0) as vwap, trade_count, version, pf_trade_count, pf_volume, pf_price_volume from (
  select date_trunc('minute', closed_at) as ts, base as asset, quote, source,
    coalesce(arg_min(price, (ledger, tx, op, claim, price, volume_base, volume_quote)) filter (price_forming), 0) as open, coalesce(max(price) filter (price_forming), 0) as high,
    coalesce(min(price) filter (price_forming), 0) as low, coalesce(arg_max(price, (ledger, tx, op, claim, price, volume_base, volume_quote)) filter (price_forming), 0) as close,
    sum(volume_base) as volume_base, sum(volume_quote) as volume_quote, count(*) as trade_count, max(ledger * 1000 + op) as version, count(*) filter (price_forming) as pf_trade_count,
    coalesce(sum(volume_base) filter (price_forming), 0) as pf_volume, coalesce(sum(price * cast(volume_base as double)) filter (price_forming), 0) as pf_price_volume
  from fills group by all))""",
    "now": "now as (select max(closed_at) as t from fills)",
    "refs": "refs as (select asset as quote, ts as r, sum(close * cast(volume_base as double)) / sum(cast(volume_base as double)) as ref from c1m where asset in ('XLM','USDT') and quote = 'USDC' and close > 0 and volume_base > 0 and pf_trade_count > 0 group by all)",
    "t1": "t1 as (" + _valued("(select c.*, o.price from (select * from c1m where volume_quote > 0) c asof join oracle_prices o on c.quote = o.asset and c.ts >= o.ts where epoch(c.ts) - epoch(o.ts) <= 300)", "price") + ")",
    "l1": "l1 as (" + _REST.format("c1m", "t1") + ")",
    "t2": "t2 as (" + _valued("(select c.*, u.rate from (select *, ts + interval 1 minute as e from l1 where volume_quote > 0 and quote = 'USDC') c asof join (select * from usd_rate where method = 'external') u on c.quote = u.asset and c.e > u.ts where epoch(c.e) - epoch(u.ts) <= 86400)", "rate") + ")",
    "l2": "l2 as (" + _REST.format("l1", "t2") + ")",
    "t3": "t3 as (" + _valued("l2 where volume_quote > 0 and quote = 'USDC'", "1.0::double") + ")",
    "l3": "l3 as (" + _REST.format("l2", "t3") + ")",
    "t4": "t4 as ("
    + _valued(
        """(select c.*, c.ref * coalesce(case when epoch(c.e) - epoch(o.ts) <= 86400 then o.rate end, case when epoch(c.e) - epoch(x.ts) <= 86400 then x.rate end) as rate from (
      select c.*, f.ref, c.ts + interval 1 minute as e, 1 as k from (select * from l3 where volume_quote > 0 and quote in ('XLM','USDT')) c asof join refs f on c.quote = f.quote and c.ts >= f.r where epoch(c.ts) - epoch(f.r) <= 86400) c
      asof left join (select *, 1 as k from usd_rate where method = 'oracle') o on c.k = o.k and c.e > o.ts
      asof left join (select *, 1 as k from usd_rate where method = 'external') x on c.k = x.k and c.e > x.ts) where rate is not null""",
        "rate",
    )
    + ")",
    "p1m": f"p1m as (select {_COLS} from t1 union all select {_COLS} from t2 union all select {_COLS} from t3 union all select {_COLS} from t4 union all select {_COLS} from ({_REST.format('l3', 't4')}))",
}
#: SQL names do not tell 1m from 1M.
NAME = {"1M": "1mo"}
for _g, _c in CHILD.items():
    for _p in "cp":
        TABLES[f"{_p}{NAME.get(_g, _g)}"] = f"{_p}{NAME.get(_g, _g)} as {rollup(_p + _c, _g)}"

_DAY = "ts > (select t from now) - interval 24 hours and ts <= (select t from now)"
TABLES |= {
    "tips": f"""tips as (select asset, coalesce(arg_max(close_usd, (ts, volume_base, source, quote)) filter (close_usd > 0), 0) as price_usd, coalesce(arg_min(close_usd, (ts, volume_base, source, quote)) filter (close_usd > 0), 0) as open_usd,
  max(ts) filter (close_usd > 0) as price_ts, max(ts) filter (pf_trade_count > 0) as formed_ts from p1m where {_DAY} group by asset)""",
    "venues": f"""venues as (select * from (select asset, source, coalesce(arg_max(close_usd, (ts, volume_base, source, quote)) filter (close_usd > 0), 0) as price, max(ts) > (select t from now) - interval 2 hours as live, sum(volume_quote_usd) as volume from p1m where {_DAY} group by all) where price > 0)""",
    "funded": "funded as (select * exclude (a) from (select *, max(volume > 100) over (partition by asset) as a from venues) where volume > 100 or not a)",
    "lively": "lively as (select * exclude (a) from (select *, max(live) over (partition by asset) as a from funded) where live or not a)",
    "masked": "masked as (select * exclude (m, n) from (select *, median(price) over (partition by asset) as m, count(*) over (partition by asset) as n from lively) where n < 3 or abs(price / m - 1) <= 0.2)",
    "all_tips": """all_tips as (select *, case when price_usd > 0 then 'traded' else '' end as method from tips union all
  select asset, price_usd, 0.0, price_ts, price_ts, 'oracle' from (select asset, arg_max(rate, ts) as price_usd, max(ts) as price_ts from usd_rate where method = 'oracle' and asset = 'USDC' and ts <= (select t from now) and ts > (select t from now) - interval 24 hours group by asset) where asset not in (select asset from tips))""",
    "weighed": """weighed as (select coalesce(s.asset, p.asset) as asset, coalesce(s.ts, p.ts) as ts, coalesce(rpw, 0) as rpw, coalesce(rew, 0) as rew, coalesce(rpv, 0) as rpv, coalesce(usd, 0) as usd, peg, peg_method from (
  select asset, ts, sum(case when pr then w else 0 end) as rpw, sum(case when pr or el then w else 0 end) as rew, sum(case when pr then close_usd * w else 0 end) as rpv, sum(case when pr then volume_quote_usd else 0 end) as usd from (
    select *, cast(pf_volume as double) as w, close >= 1e-12 and close_usd >= 1e-12 and pf_volume > 0 and (quote = 'USDC' or close_usd <> close) as pr, quote in (select 'USDC' union select 'XLM' union select 'USDT' union select asset from usd_rate) as el from p1d) group by all) s
  full join (select 'USDC' as asset, b.ts, coalesce(r.rate, 1.0) as peg, coalesce(r.method, 'peg') as peg_method from (select distinct ts from p1d where quote = 'USDC') b left join (
    select date_trunc('day', ts) as d, arg_max(rate, (method = 'oracle', ts)) as rate, arg_max(method, (method = 'oracle', ts)) as method from usd_rate where asset = 'USDC' group by 1) r on b.ts = r.d) p on s.asset = p.asset and s.ts = p.ts)""",
    "topic_events": """topic_events as (select *, json_extract_string(topics, '$[0].value') as topic0, json_extract_string(topics, '$[1].value') as topic1 from contract_events)""",
    "pools": "pools as (select contract, venue, case when venue in ('soroswap', 'sushiswap') then case when contract in ('C0','C3') then 'AAA' else 'XLM' end end as token_0, case when venue in ('soroswap', 'sushiswap') then 'USDC' end as token_1 from (values ('C0', 'soroswap'), ('C1', 'soroswap'), ('C3', 'sushiswap'), ('C4', 'aquarius'), ('C6', 'aquarius'), ('C7', 'comet'), ('C9', 'phoenix'), ('C10', 'phoenix')) t(contract, venue) where contract in (select contract from contract_events))",
}


def _needs(name: str, seen: list[str]) -> None:
    if name in seen:
        return
    body = TABLES[name]
    for other in TABLES:
        if other != name and re.search(rf"\b{re.escape(other)}\b", body.split(" as ", 1)[1]):
            _needs(other, seen)
    if name not in seen:
        seen.append(name)


def with_tables(select: str) -> str:
    """The statement after the definitions of all tables that it names."""
    seen: list[str] = []
    for name in TABLES:
        if re.search(rf"\b{re.escape(name)}\b", select):
            _needs(name, seen)
    own = select.lstrip()
    defs = ",\n".join(TABLES[n].replace(" as (", " as materialized (", 1) for n in seen)
    if own.lower().startswith("with ") and defs:
        return f"with {defs},\n{own[5:]}"
    return f"with {defs}\n{own}" if defs else own


def shown(*names: str) -> str:
    """Columns rounded as `shown` in the Spark queries rounds them."""
    out = []
    for n in names or (*KEYS, *PRICES, *VOLUMES, *COUNTS):
        if n in PRICES or n in ("price", "rate", "reference", "open_usd", "price_usd", "pf_vwap"):
            out.append(f"round(cast({n} as double), 8) as {n}")
        elif n in ("volume_quote_usd", "usd"):
            out.append(f"round(cast({n} as double), 6) as {n}")
        elif n in VOLUMES or n in ("volume", "volume_usd", "usd"):
            out.append(f"round(cast({n} as double), 4) as {n}")
        else:
            out.append(n)
    return ", ".join(out)
