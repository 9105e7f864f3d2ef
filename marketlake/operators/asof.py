"""Backward as-of join without a non-equi join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Seconds of a slot, at most.
SLOT = 3600


def asof(left: DataFrame, right: DataFrame, on: list[str], at: Column, rts: str, values: list[str], max_age: int, strict: bool = False, prefix: str = "") -> DataFrame:
    """Each left row with the values of the right row of its key that is latest at (or, if strict, before) `at`.

    A match older than `max_age` seconds is a miss.  Both sides are put on one time line, cut into slots of an hour
    or of `max_age`, if that is less.  A right row also stands in the next slot; where slots are shorter than `max_age`,
    the last of a slot is carried into those that follow, up to the next with one of its own.  So every slot has all that can match in it, however old a match may be, and a key that
    holds most rows is still spread over as many tasks as it has slots.  In a slot the last right row is carried along
    by a window; from slot to slot by another, over one row for each slot, which is 87,660 for a key in ten years.
    Left rows with a null key or time match nothing; of right rows of one key and time the one with the greatest
    values counts.  `on` may be empty: then slots alone deal the rows out.
    """
    second, place = F.unix_micros(F.col("__t")), max(1, max_age) * 1_000_000
    width = min(place, SLOT * 1_000_000)
    slot = F.floor(second / width)
    new = [f"{prefix}{v}" for v in values]
    payload = F.struct(*[F.col(v).alias(n) for v, n in zip(values, new, strict=True)], F.col(rts).alias("__rts"))
    cols = left.columns
    l_rows = left.select(*on, F.struct(*cols).alias("__l"), at.alias("__t")).withColumn("__slot", slot).withColumn("__side", F.lit(0 if strict else 1))
    r_rows = right.where(F.col(rts).isNotNull()).select(*on, payload.alias("__r"), F.col(rts).alias("__t")).withColumn("__slot", slot).withColumn("__side", F.lit(1 if strict else 0))
    if place <= SLOT * 1_000_000:
        r_rows = r_rows.withColumn("__slot", F.explode(F.array("__slot", F.col("__slot") + 1)))
    else:
        r_rows = r_rows.unionByName(_carried(r_rows, on, -(-place // width)))
    both = l_rows.unionByName(r_rows, allowMissingColumns=True)
    line = Window.partitionBy(*on, "__slot").orderBy("__t", "__side", "__r").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    carried = both.withColumn("__m", F.last("__r", ignorenulls=True).over(line)).where(F.col("__l").isNotNull())
    fresh = (second - F.unix_micros("__m.__rts")) <= place
    return carried.select("__l.*", *[F.when(fresh, F.col(f"__m.{n}")).alias(n) for n in new], F.when(fresh, F.col("__m.__rts")).alias(f"{prefix}rts"))


def _carried(rows: DataFrame, on: list[str], reach: int) -> DataFrame:
    """The last row of each slot, in each later slot up to the next that has its own, and `reach` slots on at most."""
    ends = rows.groupBy(*on, "__slot").agg(F.max_by(F.struct("__r", "__t"), F.struct("__t", "__r")).alias("__e"))
    following = F.lead("__slot").over(Window.partitionBy(*(on or [F.lit(0)])).orderBy("__slot"))
    far = F.col("__slot") + F.lit(reach)
    last = F.least(F.coalesce(following, far), far)
    return ends.withColumn("__last", last).select(*on, "__e.*", F.explode(F.sequence(F.col("__slot") + 1, "__last")).alias("__slot")).withColumn("__side", F.lit(-1))


def asof_by_time(left: DataFrame, right: DataFrame, on: list[str], at: Column, rts: str, values: list[str], max_age: int, strict: bool = False, prefix: str = "") -> DataFrame:
    """The same for left rows that are many and wide for each key and `ts`, of which `at` is made.

    The distinct keys and times are matched, and joined back by equality: left rows cross one exchange at most.
    """
    found = asof(left.select(*on, "ts").distinct(), right, on, at, rts, values, max_age, strict, prefix)
    return left.join(found, [*on, "ts"], "left").select(*left.columns, *[c for c in found.columns if c not in (*on, "ts")])
