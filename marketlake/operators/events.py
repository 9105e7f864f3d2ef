"""Contract events with typed JSON values: trades of six venue shapes, and the registry of pools.

Events are rows (ledger, tx, event_index, contract, closed_at, topics, data) and optionally `event_kind`;
registries are rows (contract, venue, token_0, token_1), tokens being null where events name them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketlake.sources.stored import stored

ADDRESSES = "array<struct<type:string,value:string>>"
#: The types of topics that may name an action or a field.
TEXTS = ("sym", "string")
PLACE = ("ledger", "event_index", "contract", "closed_at")
#: Rows of a multi-row swap, of which only so many are read, and the reading's limits in time.
MOST_ROWS, LEAST_ROWS = 8, 4
MS_FROM, GENESIS = 100_000_000_000, 1_443_571_200
#: Venues whose swaps do not name their tokens.
PAIR_VENUES = ("soroswap", "sushiswap")


def parse_topics(events: DataFrame) -> DataFrame:
    """topic0, topic1, and the values and types of all topics; text0 and text1 only where a symbol or string stands there;
    `parsed`, the data, and `keyed`, its typed values by name where it has names.  Both JSON texts are parsed once, to
    variants; what is no JSON is null."""
    listed = F.try_variant_get(F.try_parse_json("topics"), "$", ADDRESSES)
    rows = events.withColumns({"listed_topics": listed, "parsed": F.try_parse_json("data")})
    rows = rows.withColumn("keyed", F.try_variant_get("parsed", "$", f"map<string,{ADDRESSES[6:-1]}>"))
    rows = rows.withColumns({"topic_values": F.transform("listed_topics", lambda t: t["value"]), "topic_types": F.transform("listed_topics", lambda t: t["type"])}).drop("listed_topics")
    at = lambda i: F.get("topic_values", F.lit(i))
    text = lambda i: F.when(F.get("topic_types", F.lit(i)).isin(*TEXTS), at(i))
    return rows.withColumns({"topic0": at(0), "topic1": at(1), "text0": text(0), "text1": text(1)})


def value_at(path: str) -> Column:
    return F.try_element_at("keyed", F.lit(path))["value"]


def number_at(path: str) -> Column:
    """An integer of the data; what cannot be read is 0."""
    return F.coalesce(value_at(path).try_cast("decimal(38,0)"), F.lit(0).cast("decimal(38,0)"))


#: What a decoder makes of an event.
TRADE = ("source", "sold", "bought", "amount_sold", "amount_bought")


def _trade(source: str | Column, *rest: Column) -> Column:
    first = F.lit(source) if isinstance(source, str) else source
    return F.struct(*[c.alias(n) for n, c in zip(TRADE, (first, *rest), strict=True)])


def pair_trade() -> Column:
    """The trade of a two-token pool with known tokens (venue, token_0, token_1), or null: four amounts of which one
    side is paid in, or two signed ones."""
    in0, in1, out0, out1 = (number_at(p) for p in ("amount_0_in", "amount_1_in", "amount_0_out", "amount_1_out"))
    signed, a0, a1 = F.col("shape") == "signed", number_at("amount0"), number_at("amount1")
    zero_in = F.when(signed, a0 > 0).otherwise(in0 >= in1)
    sold = F.when(signed, F.when(a0 > 0, a0).otherwise(a1)).otherwise(F.when(in0 >= in1, in0).otherwise(in1))
    bought = F.when(signed, F.when(a0 > 0, -a1).otherwise(-a0)).otherwise(F.when(in0 >= in1, out1).otherwise(out0))
    fits = F.col("shape").isin("pair", "signed") & F.col("venue").isin(*PAIR_VENUES) & F.col("token_0").isNotNull() & F.col("token_1").isNotNull() & ((F.col("shape") == "pair") == (F.col("venue") == "soroswap"))
    return F.when(fits, _trade(F.col("venue"), F.when(zero_in, F.col("token_0")).otherwise(F.col("token_1")), F.when(zero_in, F.col("token_1")).otherwise(F.col("token_0")), sold, bought))


def single_trade() -> Column:
    """The trade of an event that has its tokens in the topics and its amounts in a list of three or more, or null."""
    v = F.try_variant_get("parsed", "$", ADDRESSES)
    amount = lambda i: F.coalesce(F.get(v, F.lit(i))["value"].try_cast("decimal(38,0)"), F.lit(0).cast("decimal(38,0)"))
    return F.when((F.col("shape") == "single") & (F.size(v) >= 3), _trade("aquarius", F.get("topic_values", F.lit(1)), F.get("topic_values", F.lit(2)), amount(0), amount(1)))


def weighted_trade() -> Column:
    sold, bought = number_at("token_amount_in"), number_at("token_amount_out")
    return F.when((F.col("shape") == "weighted") & (sold > 0) & (bought > 0), _trade("comet", value_at("token_in"), value_at("token_out"), sold, bought))


def _decoded(rows: DataFrame, trade: Column) -> DataFrame:
    return rows.withColumn("trade", trade).where("trade is not null").select(*PLACE, "trade.*")


def shaped(events: DataFrame) -> DataFrame:
    return parse_topics(events).withColumn("shape", swap_shape())


def decode_pair_swaps(events: DataFrame, pools: DataFrame) -> DataFrame:
    """Swaps of two-token pools.  A pool whose tokens are not known gives no trades."""
    return _decoded(shaped(events).join(pools.select("contract", "venue", "token_0", "token_1"), "contract"), pair_trade())


def decode_single_trades(events: DataFrame) -> DataFrame:
    return _decoded(shaped(events), single_trade())


def decode_weighted_swaps(events: DataFrame) -> DataFrame:
    return _decoded(shaped(events), weighted_trade())


FIELDS = ("sell_token", "buy_token", "offer_amount", "return_amount")


def is_field() -> Column:
    """Is an event one field of a swap that is written as several?"""
    return F.coalesce((F.col("text0") == "swap") & (F.size("topic_values") == 2) & F.col("text1").isNotNull(), F.lit(False))


def multirow_fields(events: DataFrame) -> DataFrame:
    """The rows (tx, contract, pos, field, value) of swaps written as one event per field."""
    rows = parse_topics(events).where(is_field())
    return rows.select("tx", "contract", F.col("event_index").alias("pos"), F.col("text1").alias("field"), F.try_variant_get("parsed", "$.value", "string").alias("value"), "ledger", "event_index", "closed_at")


def assemble_multirow_swaps(rows: DataFrame, along: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """Swaps that are written as one row per field (tx, contract, pos, field, value): trades, and groups that lack a field.

    Only the first eight rows of a contract in a transaction are read, and four are needed.  Columns `along` are
    those of a group's first row.
    """
    w = Window.partitionBy("tx", "contract").orderBy("pos")
    read = rows.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= MOST_ROWS)
    made = read.groupBy("tx", "contract").agg(F.count("*").alias("rows"), *[F.min_by(F.when(F.col("field") == f, F.col("value")), F.when(F.col("field") == f, F.col("pos"))).alias(f) for f in FIELDS], *[F.min_by(c, "pos").alias(c) for c in along])
    whole = (F.col("rows") >= LEAST_ROWS) & F.forall(F.array(*[F.col(f).isNotNull() for f in FIELDS]), lambda x: x)
    number = lambda f: F.col(f).try_cast("decimal(38,0)")
    good = made.where(whole).select("tx", "contract", *along, F.lit("phoenix").alias("source"), F.col("sell_token").alias("sold"), F.col("buy_token").alias("bought"), number("offer_amount").alias("amount_sold"), number("return_amount").alias("amount_bought"))
    return good, made.where(~whole).select("tx", "contract", "rows")


def factory_pools(events: DataFrame) -> DataFrame:
    """Pools that factory events name, by the shape of the event, whoever emits it: (contract, venue, token_0, token_1, ledger, event_index).

    The action stands in the first topic, or behind the factory's name in the second.  A pair without both tokens is none.
    """
    # Texts without a factory's word need no parsing, unless they write a letter as an escape.
    rows = parse_topics(events.where(F.col("topics").rlike(r"add_pool|create|new_pair|\\")))
    made = F.col("text0").isin("add_pool", "create", "pool_created") | (F.col("text1") == "new_pair")
    inner = lambda path: F.try_variant_get("parsed", path, "string")
    rows = rows.withColumn("listed", F.get(F.filter(F.try_variant_get("parsed", "$", ADDRESSES), lambda v: v["type"] == "address"), F.lit(0))["value"])
    named = lambda path: F.when(F.try_element_at("keyed", F.lit(path))["type"] == "address", value_at(path))
    plain = F.when(inner("$.type") == "address", inner("$.value"))
    pair, none = F.lit(None).cast("string"), F.lit(None).cast("string")
    found = (
        F.when(F.col("text0") == "add_pool", F.struct(F.col("listed").alias("contract"), F.lit("aquarius").alias("venue"), none.alias("token_0"), none.alias("token_1")))
        .when(F.col("text0") == "create", F.struct(F.when(F.col("text1") == "liquidity_pool", plain).otherwise(pair).alias("contract"), F.lit("phoenix").alias("venue"), none.alias("token_0"), none.alias("token_1")))
        .when(F.col("text1") == "new_pair", F.struct(named("pair").alias("contract"), F.lit("soroswap").alias("venue"), named("token_0").alias("token_0"), named("token_1").alias("token_1")))
        .otherwise(F.struct(named("pool_address").alias("contract"), F.lit("sushiswap").alias("venue"), named("token0").alias("token_0"), named("token1").alias("token_1")))
    )
    # A filter would be pushed below the parsing and parse again; what a generator drops is not.
    out = rows.select(F.inline(F.array_compact(F.array(F.when(made, found)))), "ledger", "event_index").where("contract is not null")
    return out.where(~F.col("venue").isin(*PAIR_VENUES) | (F.col("token_0").isNotNull() & F.col("token_1").isNotNull()))


def learn_pools(events: DataFrame, registry: DataFrame, fixed: DataFrame | None = None) -> DataFrame:
    """Pools of factory events, the last for each contract, over the registry, under a fixed list."""
    p = F.struct("venue", "token_0", "token_1").alias("p")
    new = factory_pools(events).groupBy("contract").agg(F.max_by(p, F.struct("ledger", "event_index")).alias("p")).select("contract", "p", F.lit(1).alias("rank"))
    every = registry.select("contract", p, F.lit(0).alias("rank")).unionByName(new)
    if fixed is not None:
        every = every.unionByName(fixed.select("contract", p, F.lit(2).alias("rank")))
    return every.groupBy("contract").agg(F.max_by("p", "rank").alias("p")).select("contract", "p.*")


def new_pool_rows(registry: DataFrame, persisted: DataFrame) -> DataFrame:
    """Pools that are not stored, or not like this; nulls compare as values."""
    p = persisted.select(*[F.col(c).alias(f"p_{c}") for c in registry.columns])
    same = [F.col(c).eqNullSafe(F.col(f"p_{c}")) for c in registry.columns]
    on = same[0]
    for s in same[1:]:
        on = on & s
    return registry.join(p, on, "left_anti")


def swap_shape() -> Column:
    """Which kind of swap an event looks like: by topics that are symbols or strings, and by the keys of its data where
    two kinds share them.  A router's summary has no such keys."""
    t0, t1 = F.col("text0"), F.col("text1")
    address = lambda i: F.get("topic_types", F.lit(i)) == "address"
    has = lambda key: F.map_contains_key("keyed", key)
    return (
        F.when((t0 == "trade") & address(1) & address(2), "single")
        .when((t0 == "SoroswapPair") & (t1 == "swap"), "pair")
        .when((t0 == "swap") & (t1 == "sell_token"), "multirow")
        .when((t0 == "swap") & has("amount0") & has("amount1"), "signed")
        .when((t0 == "POOL") & (t1 == "swap"), "weighted")
    )


def routed(events: DataFrame, registry: DataFrame) -> DataFrame:
    """Swap-like events and fields of swaps in one pass: the venue of the contract (null if it is not registered), the
    shape, the trade that the venue's decoder makes of it (null if none), and of a field its name and value."""
    rows = shaped(events).join(registry.select("contract", "venue", "token_0", "token_1"), "contract", "left")
    part = is_field() & (F.col("venue") == "phoenix")
    trade = F.coalesce(pair_trade(), F.when(F.col("venue") == "aquarius", single_trade()), F.when(F.col("venue") == "comet", weighted_trade()))
    name, value = F.when(part, F.col("text1")), F.when(part, F.try_variant_get("parsed", "$.value", "string"))
    found = F.struct(*PLACE, "tx", "venue", "shape", trade.alias("trade"), name.alias("field"), value.alias("value"))
    # A filter would be pushed below the parsing and parse everything again; what a generator drops is not.
    return rows.select(F.inline(F.array_compact(F.array(F.when(F.col("shape").isNotNull() | part, found)))))


def unregistered(routed_: DataFrame) -> DataFrame:
    return routed_.where("venue is null").select(*PLACE, "tx", "shape")


def route_events(events: DataFrame, registry: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Trades of registered contracts by the decoder of their venue, swap-like events of the others, and swaps of
    registered contracts that no trade came of: (contract, source, rows), so that no group vanishes without a count.

    Events are scanned and parsed once, and what is left of them is a narrow table that all three read.
    """
    rows = stored(routed(events, registry))
    fields = rows.where("field is not null").withColumn("pos", F.col("event_index"))
    multi, short = assemble_multirow_swaps(fields, PLACE[:2] + PLACE[3:])
    trades = rows.where("trade is not null").select(*PLACE, "trade.*")
    trades = trades.unionByName(multi.select(trades.columns))
    lost = rows.where("venue is not null and shape <> 'multirow' and trade is null").groupBy("contract", F.col("venue").alias("source")).agg(F.count("*").alias("rows"))
    return trades, unregistered(rows), lost.unionByName(short.select("contract", F.lit("phoenix").alias("source"), "rows"))


def unregistered_shapes(events: DataFrame, registry: DataFrame) -> DataFrame:
    return unregistered(routed(events, registry)).groupBy("shape").agg(F.count("*").alias("events"), F.count_distinct("contract").alias("contracts"))


def unresolved_pools(events: DataFrame, registry: DataFrame, routers: list[str] | None = None) -> DataFrame:
    """Contracts with swap-like events, and whether the registry lacks them."""
    rows = shaped(events.where(~F.col("contract").isin(routers or []))).where("shape is not null")
    sums = rows.groupBy("contract", "shape").agg(F.min("ledger").alias("first_ledger"), F.max("ledger").alias("last_ledger"), F.count("*").alias("swaps"), F.min_by("data", F.struct("ledger", "event_index")).alias("sample"))
    known = registry.select("contract", F.lit(True).alias("known"))
    return sums.join(known, "contract", "left").withColumn("unresolved", F.col("known").isNull()).drop("known")


def wrapper_proofs(events: DataFrame, contracts: DataFrame) -> DataFrame:
    """For each contract the first event whose last topic names the asset behind it."""
    rows = parse_topics(events).join(contracts.select("contract").distinct(), "contract", "left_semi").where("text0 in ('trade', 'transfer', 'mint', 'burn', 'clawback')")
    last = F.element_at("topic_values", -1)
    return rows.groupBy("contract").agg(F.min_by(last, F.struct("ledger", "event_index")).alias("proof"))


def scan_events(events: DataFrame, contracts: DataFrame, lo: int, hi: int) -> DataFrame:
    """Events of a range of ledgers and a set of contracts, with their ledger's close time, in order of application."""
    closed = events.groupBy("ledger").agg(F.min("closed_at").alias("ledger_closed_at"))
    rows = events.where(F.col("ledger").between(lo, hi)).join(contracts.select("contract").distinct(), "contract", "left_semi")
    return rows.join(closed.where(F.col("ledger").between(lo, hi)), "ledger", "left").orderBy("ledger", "event_index")


def scan_factory_events(events: DataFrame, lo: int, hi: int) -> DataFrame:
    """Events of a range of ledgers that name a new pool."""
    return factory_pools(events.where(F.col("ledger").between(lo, hi)))


def coverage_sweep(events: DataFrame, registry: DataFrame, last_ledgers: int) -> DataFrame:
    """Contracts that the registry lacks with swap- or trade-like contract events in the last ledgers: how many events
    and transactions, when, and the most frequent action and shape of topics and data."""
    top = events.agg(F.max("ledger").alias("top"))  # one row
    rows = events.where("event_kind = 'contract'") if "event_kind" in events.columns else events
    rows = parse_topics(rows.join(F.broadcast(top), how="cross").where(F.col("ledger") >= F.col("top") - last_ledgers))
    like = lambda i: F.coalesce(F.get("topic_types", F.lit(i)).isin("sym", "string") & F.get("topic_values", F.lit(i)).rlike("(?i)swap|trade"), F.lit(False))
    rows = rows.where(like(0) | like(1)).join(registry.select("contract"), "contract", "left_anti")
    action = F.concat(F.coalesce("topic0", F.lit("")), F.lit(" / "), F.substring(F.coalesce("topic1", F.lit("")), 1, 20))
    shape = F.concat(F.array_join("topic_types", "|"), F.lit(" -> "), F.coalesce(F.try_variant_get("parsed", "$.type", "string"), F.lit("")))
    each = rows.select("contract", "tx", "ledger", action.alias("action"), shape.alias("shape"))
    most = lambda c: each.groupBy("contract", c).count().groupBy("contract").agg(F.max_by(c, F.struct("count", c)).alias(f"top_{c}"))
    sums = each.groupBy("contract").agg(F.count("*").alias("events"), F.count_distinct("ledger", "tx").alias("txs"), F.min("ledger").alias("first_ledger"), F.max("ledger").alias("last_ledger"))
    return sums.join(most("action"), "contract").join(most("shape"), "contract")


def allowlist_partition(sweep: DataFrame, allow: DataFrame, unresolved: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Each swept contract as allowed, unresolved or unclassified; and entries that match nothing."""
    rows = sweep.join(allow.select("contract", F.lit(True).alias("a")), "contract", "left").join(unresolved.select("contract").distinct().withColumn("u", F.lit(True)), "contract", "left")
    state = F.when(F.col("a"), "allow-listed").when(F.col("u"), "unresolved").otherwise("unclassified")
    return rows.withColumn("state", state).drop("a", "u"), allow.join(sweep.select("contract"), "contract", "left_anti")


def unregistered_emitters(events: DataFrame, registry: DataFrame, chunk: int) -> DataFrame:
    rows = unregistered(routed(events, registry))
    return rows.groupBy(F.floor(F.col("ledger") / chunk).alias("chunk"), "contract").agg(F.count("*").alias("events"))


def oracle_samples(events: DataFrame, symbols: dict[str, str]) -> DataFrame:
    """Samples of one update event (ts, prices as JSON list of symbol and price); unknown symbols are dropped."""
    rows = events.withColumn("p", F.explode(F.from_json("prices", "array<struct<symbol:string,price:double>>")))
    names = F.create_map(*[F.lit(x) for kv in symbols.items() for x in kv])
    return rows.select("ts", F.try_element_at(names, F.col("p.symbol")).alias("asset"), F.col("p.price").alias("price")).where("asset is not null")


def normalise_oracle_ts(samples: DataFrame, as_of: Column) -> tuple[DataFrame, DataFrame]:
    """Raw times in seconds or milliseconds as timestamps, and how many lie before the network began or in the future."""
    second = F.when(F.col("raw") >= MS_FROM, F.floor(F.col("raw") / 1000)).otherwise(F.col("raw"))
    good = (second >= GENESIS) & (second <= F.unix_timestamp(as_of) + 3600)
    return samples.where(good).withColumn("ts", F.timestamp_seconds(second)), samples.agg(F.count_if(~good).alias("rejected"))
