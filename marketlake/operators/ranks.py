"""Exact quantiles by selection: histograms of ranges that shrink to the value of a rank."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marketlake.sources.stored import stored

BINS = 4096


def quantiles(df: DataFrame, keys: list[str], wanted: dict[str, tuple[str, float]], bins: int = BINS) -> DataFrame:
    """For each key a column for each of `wanted` (name: column, share), interpolated between the two nearest ranks.

    Each round counts the values of a range in `bins` parts of it, keeps the part in which the rank lies, and goes on
    with the smallest and the largest value there until these are equal.  A round divides the values in question by
    `bins` where they are spread, and a value that fills a part ends it, so three to five rounds do for 10^12 values.
    A task holds `bins` counts for each key and rank, never values, so a key with most of the rows is no hot spot.

    Nulls, NaN and infinite values are left out; keys are not null; a key without values has no row, and without keys
    there is always one.
    """
    columns = sorted({c for c, _ in wanted.values()})
    values = F.explode(F.array(*[F.struct(F.lit(i).alias("c"), F.col(c).cast("double").alias("v")) for i, c in enumerate(columns)]))
    rows = df.select(*keys, values.alias("x")).select(*keys, "x.*").where("v is not null and not isnan(v) and abs(v) < double('infinity')")
    rows = stored(rows)
    by = [*keys, "c"]
    ends = rows.groupBy(*by).agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    place = lambda p: (F.col("n") - 1) * F.lit(p)
    ask = [F.struct(F.lit(name).alias("name"), F.lit(columns.index(c)).alias("of"), F.lit(part).alias("part"), part_of(place(p)).cast("long").alias("rank"), (place(p) - F.floor(place(p))).alias("share")) for name, (c, p) in wanted.items() for part, part_of in (("low", F.floor), ("high", F.ceil))]
    state = ends.withColumn("a", F.explode(F.array(*ask))).select(*by, "lo", "hi", "a.*").where("of = c").drop("of")
    # `rank` counts within the range from lo to hi.
    state = stored(state)
    while state.where("lo < hi").limit(1).count():
        ranges = state.where("lo < hi").select(*by, "lo", "hi").distinct()  # a row for each key and rank at most
        part = F.least(F.lit(bins - 1), F.floor((F.col("v") / 2 - F.col("lo") / 2) / (F.col("hi") / 2 - F.col("lo") / 2) * bins))
        inside = rows.join(ranges, by).where("v between lo and hi")
        counts = inside.groupBy(*by, "lo", "hi", part.alias("bin")).agg(F.count("*").alias("n"), F.min("v").alias("from"), F.max("v").alias("to"))
        line = Window.partitionBy(*by, "lo", "hi").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
        counts = counts.withColumn("before", F.coalesce(F.sum("n").over(line), F.lit(0)))
        met = state.where("lo < hi").join(counts, [*by, "lo", "hi"]).where("rank >= before and rank < before + n")
        met = met.select(*by, F.col("from").alias("lo"), F.col("to").alias("hi"), "name", "part", (F.col("rank") - F.col("before")).alias("rank"), "share")
        state = stored(state.where("lo = hi").select(met.columns).unionByName(met))
    low, high = (F.max(F.when(F.col("part") == x, F.col("lo"))) for x in ("low", "high"))
    # Adding nothing for equal neighbours keeps their value as it is.
    found = state.groupBy(*keys, "name").agg((low + F.when(high > low, F.max("share") * (high - low)).otherwise(0.0)).alias("q"))
    return found.groupBy(*keys).agg(*[F.max(F.when(F.col("name") == name, F.col("q"))).alias(name) for name in wanted])
