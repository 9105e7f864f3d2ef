"""From decoded claims to fills with a canonical pair, scaled amounts and a price."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketlake.functions.prices import STORED, price_forming
from marketlake.operators.lookup import sendable
from marketlake.sources.stored import stored

#: Quote preference, and decimals of classic assets.
RANKS = {"USDC": 0, "USDT": 1, "XLM": 2}
DECIMALS = 7
MOST_DECIMALS = 28


def trades(claims: DataFrame) -> DataFrame:
    """Claims that moved both assets."""
    return claims.where((F.col("amount_sold") > 0) & (F.col("amount_bought") > 0))


def attach_offer_price(claims: DataFrame, changes: DataFrame) -> DataFrame:
    """The price of the resting offer as it was before the operation.

    `changes` has (tx, op, offer_id, pos, is_state, n, d).  The first state row of an offer counts, else its
    first row.  A transaction whose numbers of operations disagree between the two takes none.
    """
    first = changes.groupBy("tx", "op", "offer_id").agg(F.min_by(F.struct("n", "d"), F.struct((~F.col("is_state")).alias("late"), "pos", "n", "d")).alias("o"))
    ours = claims.groupBy("tx").agg(F.count_distinct("op").alias("ops"))
    theirs = changes.groupBy("tx").agg(F.count_distinct("op").alias("ops"))
    sound = ours.join(theirs, ["tx", "ops"]).select("tx")
    usable = first.join(sound, "tx", "left_semi").select("tx", "op", "offer_id", F.col("o.n").alias("offer_n"), F.col("o.d").alias("offer_d"))
    return claims.drop("offer_n", "offer_d").join(usable, ["tx", "op", "offer_id"], "left")


def offer_lookup_counts(rows: DataFrame) -> DataFrame:
    book = F.col("source") == "sdex"
    return rows.agg(F.count_if(book & F.col("offer_n").isNotNull()).alias("offers"), F.count_if(book & F.col("offer_n").isNull()).alias("misses"), F.count_if(~book).alias("pool_fills"))


def rank(asset: Column) -> Column:
    out = F.lit(len(RANKS))
    for name, r in RANKS.items():
        out = F.when(asset == name, r).otherwise(out)
    return out


def drop_self_swaps(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("sold") != F.col("bought"))


def collapse_wrapped(rows: DataFrame, assets: DataFrame) -> DataFrame:
    """A wrapper's contract is the asset that it wraps; the registry decides, of which only what the rows name is sent."""
    by = sendable(assets.where("contract <> ''").select(F.col("contract").alias("c"), F.col("asset").alias("a")), "c", rows, "sold", "bought")
    for leg in ("sold", "bought"):
        rows = rows.join(by, rows[leg] == by["c"], "left").withColumn(leg, F.coalesce("a", leg)).drop("a", "c")
    return rows


def split_unproven(rows: DataFrame, flagged: DataFrame, assets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Trades without a leg in a flagged contract that no asset proves, and those contracts."""
    unproven = flagged.join(assets.where("contract <> ''"), "contract", "left_anti").select("contract").distinct()
    legs = rows.select(F.col("sold").alias("contract")).unionByName(rows.select(F.col("bought").alias("contract"))).distinct()
    good, sent = rows, sendable(stored(unproven), "contract", rows, "sold", "bought")
    for leg in ("sold", "bought"):
        good = good.join(sent.withColumnRenamed("contract", leg), leg, "left_anti")
    return good.select(rows.columns), legs.join(unproven, "contract", "left_semi")


def canonicalise(rows: DataFrame) -> DataFrame:
    """base, quote, amounts of each, and whether the trade runs against that direction."""
    sold, bought = rank(F.col("sold")), rank(F.col("bought"))
    none = len(RANKS)
    inverted = (sold < bought) | ((sold == none) & (bought == none) & (F.col("bought") < F.col("sold")))
    out = rows.withColumn("inverted", inverted)
    pick = lambda a, b: F.when(F.col("inverted"), F.col(a)).otherwise(F.col(b))
    return out.withColumns({"base": pick("bought", "sold"), "quote": pick("sold", "bought"), "amount_base": pick("amount_bought", "amount_sold"), "amount_quote": pick("amount_sold", "amount_bought")})


def scale_amounts(rows: DataFrame, decimals: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Volumes by each token's decimals, and trades of tokens whose decimals are unknown or absurd, counted by token."""
    known = sendable(decimals.where(F.col("decimals").between(0, MOST_DECIMALS)), "asset", rows, "base", "quote")
    for leg in ("base", "quote"):
        rows = rows.join(known.select(F.col("asset").alias(leg), F.col("decimals").alias(f"d_{leg}")), leg, "left")
    whole = F.col("d_base").isNotNull() & F.col("d_quote").isNotNull()
    # A filter would put the rules of pairs, many times over, below the joins: more code than the JVM compiles.  What a
    # generator drops it does not move.
    good = rows.select(F.inline(F.array_compact(F.array(F.when(whole, F.struct(*rows.columns))))))
    for leg in ("base", "quote"):
        good = good.withColumn(f"volume_{leg}", (F.col(f"amount_{leg}").cast("double") / F.pow(F.lit(10.0), F.col(f"d_{leg}"))).cast(STORED))
    missing = rows.where(~whole).select(F.explode(F.array_compact(F.array(*[F.when(F.col(f"d_{leg}").isNull(), F.col(leg)) for leg in ("base", "quote")]))).alias("asset"))
    return good.drop("d_base", "d_quote"), missing.groupBy("asset").agg(F.count("*").alias("skipped"))


def fill_price(rows: DataFrame) -> DataFrame:
    """The price of the offer where there is one, else that of the amounts; quote per base, at the stored scale."""
    n, d = F.col("offer_n"), F.col("offer_d")
    offered = F.when(F.col("inverted"), F.try_divide(d, n)).otherwise(F.try_divide(n, d))
    implied = F.try_divide(F.col("amount_quote").cast("double"), F.col("amount_base").cast("double"))
    return rows.withColumn("offer_priced", n.isNotNull() & d.isNotNull()).withColumn("price", F.when(F.col("offer_priced"), offered).otherwise(implied))


def fills(claims: DataFrame) -> DataFrame:
    """Claims of classic assets as fills: pair, volumes, price, and whether it forms price."""
    rows = fill_price(canonicalise(drop_self_swaps(trades(claims))))
    forming = price_forming(F.col("offer_priced"), F.col("amount_base"), F.col("amount_quote"), F.col("price"))
    scale = 10.0**DECIMALS
    return rows.withColumns({"price_forming": forming, "volume_base": (F.col("amount_base") / scale).cast(STORED), "volume_quote": (F.col("amount_quote") / scale).cast(STORED)})


def asset_id(code: Column, issuer: Column, contract: Column) -> Column:
    """A number that the identity fixes; a blank identity has the sentinel 0."""
    text = F.concat_ws(":", code, issuer, contract)
    return F.when(F.length(F.btrim(text, F.lit(": "))) > 0, F.xxhash64(text)).otherwise(F.lit(0))


def pending_assets(rows: DataFrame, assets: DataFrame, seeds: DataFrame | None = None) -> DataFrame:
    """Identities of the trades, and of a seed list, that the registry lacks."""
    legs = rows.select(F.col("sold").alias("asset")).unionByName(rows.select(F.col("bought").alias("asset")))
    if seeds is not None:
        legs = legs.unionByName(seeds.select("asset"))
    return legs.distinct().join(assets, "asset", "left_anti")
