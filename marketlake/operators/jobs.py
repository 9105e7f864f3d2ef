"""Work queues and the migration of keys, as table jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MOST_ATTEMPTS = 3
#: Fixed value: characters of a symbol.
LONGEST_SYMBOL = 32
STATES = ("copied", "orphan", "colliding", "unmapped")


def stalest_queue(assets: DataFrame, supply: DataFrame, n: int) -> DataFrame:
    """Classic assets, those never fetched first, then by oldest fetch (supply has asset, fetched_at)."""
    return assets.where("kind = 'credit'").join(supply.select("asset", "fetched_at"), "asset", "left").orderBy(F.col("fetched_at").asc_nulls_first(), "asset").limit(n).select("asset", "fetched_at")


def symbol_queue(assets: DataFrame, symbols: DataFrame, n: int) -> DataFrame:
    """Contracts without a symbol and with tries left; `symbols` has contract, symbol, attempts, fetched_at."""
    last = symbols.groupBy("contract").agg(F.max_by(F.struct("symbol", "attempts"), "fetched_at").alias("s")).select("contract", "s.*")
    rows = assets.where("contract <> ''").select("contract").join(last, "contract", "left").withColumn("attempts", F.coalesce("attempts", F.lit(0)))
    return rows.where(F.col("symbol").isNull() & (F.col("attempts") < MOST_ATTEMPTS)).orderBy("attempts", "contract").limit(n).select("contract", "attempts")


def sanitised(symbol: Column) -> Column:
    """A symbol fit to be stored and shown, without space around it, or null: letters, digits and a few marks only, as
    others may hide or turn the text around them."""
    trimmed = F.regexp_replace(symbol, r"(?U)^\s+|\s+$", "")
    return F.when(trimmed.rlike(rf"^[\p{{IsAlphabetic}}\p{{N}}.+_: -]{{1,{LONGEST_SYMBOL}}}$"), trimmed)


def merge_answers(queue: DataFrame, answers: DataFrame) -> DataFrame:
    """A symbol resets the tries, a definite no adds one, a passing failure leaves them (answers: contract, outcome, symbol).

    A symbol that is not fit to be stored is a no."""
    rows = answers.withColumn("symbol", F.when(F.col("outcome") == "resolved", sanitised(F.col("symbol"))))
    rows = rows.withColumn("outcome", F.when((F.col("outcome") == "resolved") & F.col("symbol").isNull(), "negative").otherwise(F.col("outcome")))
    outcome = F.col("outcome")
    return queue.join(rows, "contract").select("contract", "symbol", F.when(outcome == "resolved", 0).when(outcome == "negative", F.col("attempts") + 1).otherwise(F.col("attempts")).alias("attempts"))


PARTS = ("balances_authorized", "balances_maintain", "balances_unauthorized", "claimable", "pools", "contracts")


def supply_total(bodies: DataFrame) -> DataFrame:
    """The sum of six parts of a JSON body, blanks being 0; a body without a record has none."""
    schema = "found boolean, " + ", ".join(f"{p} string" for p in PARTS)
    rows = bodies.withColumn("b", F.from_json("body", schema)).where("b.found")
    total = sum((F.coalesce(F.col(f"b.{p}").try_cast("decimal(38,7)"), F.lit(0).cast("decimal(38,7)")) for p in PARTS[1:]), F.coalesce(F.col(f"b.{PARTS[0]}").try_cast("decimal(38,7)"), F.lit(0).cast("decimal(38,7)")))
    return rows.select("asset", total.cast("double").alias("supply"))


def id_map(assets: DataFrame, facts: DataFrame, new_id: Column) -> DataFrame:
    """Old ids (asset) to new ones: mapped, colliding, orphan, or the sentinel (an empty id)."""
    rows = assets.select(F.col("asset").alias("old_id"), new_id.alias("new_id"))
    n = F.count("*").over(Window.partitionBy("new_id"))
    known = rows.withColumn("state", F.when(n > 1, "colliding").otherwise("mapped"))
    used = facts.select(F.col("asset").alias("old_id")).unionByName(facts.select(F.col("quote").alias("old_id"))).distinct()
    orphans = used.where("old_id <> ''").join(rows, "old_id", "left_anti").select("old_id", F.lit(None).cast(rows.schema["new_id"].dataType).alias("new_id"), F.lit("orphan").alias("state"))
    sentinel = used.where("old_id = ''").select("old_id", F.lit(None).cast(rows.schema["new_id"].dataType).alias("new_id"), F.lit("sentinel").alias("state"))
    return known.unionByName(orphans).unionByName(sentinel)


def id_map_gates(mapping: DataFrame) -> DataFrame:
    copy = F.col("state") == "mapped"
    return mapping.agg(F.count_if(F.col("old_id") == "").alias("blank_ids"), F.count_if(F.col("state") == "colliding").alias("collisions"), (F.count_if(copy) - F.count_distinct(F.when(copy, F.col("new_id")))).alias("repeated_copies"))


def classify_rows(facts: DataFrame, mapping: DataFrame) -> DataFrame:
    """The state of each fact row; the worse of its two legs counts."""
    worst = {"mapped": 0, "orphan": 1, "sentinel": 1, "colliding": 2}
    score = F.lit(3)
    for name, v in worst.items():
        score = F.when(F.col("state") == name, v).otherwise(score)
    legs = mapping.select("old_id", "new_id", score.alias("score"))
    rows = facts
    for leg in ("asset", "quote"):
        rows = rows.join(legs.select(F.col("old_id").alias(leg), F.col("new_id").alias(f"{leg}_new"), F.col("score").alias(f"{leg}_score")), leg, "left")
    each = [F.coalesce(f"{leg}_score", F.lit(3)) for leg in ("asset", "quote")]
    return rows.withColumn("state", F.get(F.array(*[F.lit(s) for s in STATES]), F.greatest(*each)))


def classify_counts(facts: DataFrame, mapping: DataFrame) -> DataFrame:
    return classify_rows(facts, mapping).groupBy("state").agg(F.count("*").alias("rows"))


def rewrite_ids(facts: DataFrame, mapping: DataFrame) -> DataFrame:
    """Rows that can be copied, under their new ids."""
    rows = classify_rows(facts, mapping).where("state = 'copied'")
    return rows.select(*[F.col(f"{c}_new").alias(c) if c in ("asset", "quote") else F.col(c) for c in facts.columns])


def post_checks(assets: DataFrame, facts: DataFrame, keys: list[str]) -> DataFrame:
    """Are ids unique, and is there one row per key?"""
    a = assets.agg((F.count("*") == F.count_distinct("asset")).alias("assets_unique"))
    f = facts.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.coalesce(F.max("n") <= 1, F.lit(True)).alias("one_row_per_key"))
    return a.crossJoin(F.broadcast(f))


def colliding_restored(facts: DataFrame, mapping: DataFrame, months: DataFrame) -> DataFrame:
    """For each copied month (month, colliding_rows): are rows of colliding ids back, where there were any?

    An id that some clean old id is also mapped to has copied rows anyway and shows nothing, so it does not count.
    """
    ids = mapping.groupBy("new_id").agg(F.count_if(F.col("state") == "colliding").alias("bad"), F.count_if(F.col("state").isin("mapped", "sentinel")).alias("clean")).where("bad > 0 and clean = 0").select("new_id")
    legs = facts.select(F.date_format("ts", "yyyy-MM").alias("month"), F.explode(F.array_distinct(F.array("asset", "quote"))).alias("new_id"))
    # Ids and months are few; rows are counted before they meet them.
    back = legs.groupBy("month", "new_id").agg(F.count("*").alias("n")).join(ids, "new_id", "left_semi").groupBy("month").agg(F.sum("n").alias("legs"))
    return months.join(back, "month", "left").select("month", "colliding_rows", ((F.col("colliding_rows") == 0) | (F.coalesce("legs", F.lit(0)) > 0)).alias("restored"))
