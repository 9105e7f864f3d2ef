"""Surrogate keys: facts of two assets with one code stay apart from the trades on.

The key of an asset is its code and a hash of its whole identity (code, issuer, contract).  It is computed where the
trades are, without a look-up, so no trade waits for a registry; the registry says what a key stands for, and a gate
finds keys that would stand for two.  The identities that price all others are known by their code alone, so rules
that name them hold for keyed facts as they are; another issuer's token of the same code gets a key of the other kind
and with it neither their rank nor their peg.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketlake.operators.fills import asset_id
from marketlake.operators.lookup import sendable

MARK = "#"


def key(code: Column, issuer: Column, contract: Column, reserved: dict[str, str]) -> Column:
    """`reserved`: the issuer of each code that is its own key."""
    code, issuer, contract = (F.coalesce(c, F.lit("")) for c in (code, issuer, contract))
    own = F.lit(False)
    for name, by in reserved.items():
        own = own | ((code == name) & (issuer == by))
    return F.when(own, code).otherwise(F.concat(code, F.lit(MARK), F.lower(F.hex(asset_id(code, issuer, contract)))))


def code_of(c: Column) -> Column:
    return F.substring_index(c, MARK, 1)


def dictionary(assets: DataFrame, reserved: dict[str, str]) -> DataFrame:
    """(key, asset, issuer, contract), a row for each identity of a registry; a contract is part of it only where there is
    no issuer, as it else wraps the asset."""
    contract = F.when(F.col("issuer") == "", F.col("contract")).otherwise(F.lit(""))
    return assets.select("asset", "issuer", contract.alias("contract")).distinct().withColumn("key", key(F.col("asset"), F.col("issuer"), F.col("contract"), reserved)).select("key", "asset", "issuer", "contract")


def collisions(names: DataFrame) -> DataFrame:
    """Keys that stand for more than one identity; facts must not be written while there are any."""
    return names.groupBy("key").agg(F.count_distinct("asset", "issuer", "contract").alias("identities")).where("identities > 1")


def keyed(claims: DataFrame, reserved: dict[str, str]) -> DataFrame:
    """Claims (sold, sold_issuer, bought, bought_issuer) with keys for their codes, made once for each row: a filter on
    them does not pass the generator, below which it would hash again."""
    legs = {leg: key(F.col(leg), F.col(f"{leg}_issuer"), F.lit(""), reserved) for leg in ("sold", "bought")}
    rows = claims.withColumns(legs).drop("sold_issuer", "bought_issuer")
    return rows.select(F.inline(F.array(F.struct(*rows.columns))))


def named(facts: DataFrame, names: DataFrame, *legs: str) -> DataFrame:
    """Facts with code and issuer of each leg beside its key; unknown keys have their code and no issuer."""
    sent = sendable(names.select("key", "issuer"), "key", facts, *legs)
    for leg in legs:
        of = sent.select(F.col("key").alias(leg), F.col("issuer").alias(f"{leg}_issuer"))
        facts = facts.join(of, leg, "left").withColumn(f"{leg}_code", code_of(F.col(leg)))
    return facts
