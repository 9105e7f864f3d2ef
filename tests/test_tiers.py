import pytest
from pyspark.sql import functions as F

from marketlake.functions.timebucket import CHILD
from marketlake.operators import candles
from marketlake.sources.tiers import TYPES, Tiers

ROUNDED = ("open", "high", "low", "close", "vwap", "pf_price_volume", "volume_quote_usd", "close_usd")


def minutes(spark, start="2024-01-20 00:00:00", step=47, number=2500, version=1):
    """Minutes of six series from January to April."""
    n = F.col("id")
    price = 10 + n % 13
    rows = spark.range(number).select(
        F.timestamp_seconds(F.unix_timestamp(F.lit(start).cast("timestamp")) + n * step * 60).alias("ts"),
        F.element_at(F.array(F.lit("AAA"), F.lit("BBB"), F.lit("XLM")), (n % 3 + 1).cast("int")).alias("asset"),
        F.lit("USDC").alias("quote"),
        F.when(n % 2 == 0, "sdex").otherwise("comet").alias("source"),
        *[price.alias(c) for c in ("open", "high", "low", "close", "vwap")],
        *[(n % 7 + 1).alias(c) for c in ("volume_base", "volume_quote", "pf_volume", "trade_count", "pf_trade_count")],
        *[price.alias(c) for c in ("volume_quote_usd", "close_usd", "pf_price_volume")],
        F.lit(version).alias("version"),
    )
    return rows.select(*[F.col(c).cast(TYPES[c]).alias(c) for c in candles.COLUMNS])


def rounded(df):
    return sorted(tuple(r) for r in df.select(*[F.round(c, 6).alias(c) if c in ROUNDED else F.col(c) for c in candles.COLUMNS]).collect())


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def tiers(spark, tmp_path):
    made = Tiers(spark, str(tmp_path / "market"), 4)
    made.replace("1m", made.dealt(minutes(spark)))
    return made


def test_chain_from_stored_minutes_has_no_exchange(tiers, spark):
    made = candles.rollup_all(tiers.read("1m"))
    want = candles.rollup_all(minutes(spark))
    for grain in CHILD:
        assert "Exchange" not in plan(made[grain])
        assert rounded(made[grain]) == rounded(want[grain])
    assert "Exchange" not in plan(tiers.latest("1m"))


def test_roll_all_and_a_part(tiers, spark):
    """A part rolls whole months, with the weeks that begin in them and end in the next; other months are left alone."""
    tiers.roll_all()
    want = {g: rounded(df) for g, df in candles.rollup_all(minutes(spark)).items()}
    assert all(rounded(tiers.read(g)) == want[g] for g in CHILD)
    other = minutes(spark).where("month(ts) in (2, 3)").withColumns({"close": F.col("close") + 1, "version": F.col("version") + 1})
    tiers.replace("1m", tiers.dealt(other))
    lo, hi = F.lit("2024-02-10 12:00:00").cast("timestamp"), F.lit("2024-02-11").cast("timestamp")
    tiers.roll_all(lo, hi)
    changed = candles.rollup_all(minutes(spark).where("month(ts) not in (2, 3)").unionByName(other))
    for grain in CHILD:
        got, inside = rounded(tiers.read(grain)), lambda rows: [r for r in rows if r[0].month == 2]
        assert [r for r in got if r[0].month != 2] == [r for r in want[grain] if r[0].month != 2]
        # The last week's days in March are those of the day tier, which has not been rolled for March.
        if grain != "1w":
            assert inside(got) == inside(rounded(changed[grain])) != inside(want[grain])
    assert plan(tiers.read("1h", lo, hi)).count("month") and rounded(tiers.read("1h", lo, hi)) == [r for r in rounded(tiers.read("1h")) if "2024-02-10 12" <= str(r[0]) < "2024-02-11"]


def test_fold_keeps_the_highest_version_once(tiers, spark):
    newer = minutes(spark, number=40).withColumns({"close": F.lit(99.0), "version": F.lit(5).cast("long")})
    older = minutes(spark, number=80).withColumns({"close": F.lit(1.0), "version": F.lit(0).cast("long")})
    fresh = newer.unionByName(older).unionByName(minutes(spark, "2023-12-01 00:00:00", number=3))
    for _ in range(2):
        tiers.fold("1m", fresh)
        got = tiers.read("1m")
        assert got.count() == 2503 and got.where("close = 99").count() == 40 and got.where("close = 1").count() == 0
    tiers.fold("1m", fresh.limit(0))
    assert tiers.read("1m").count() == 2503


def test_refresh_of_touched_buckets_equals_a_full_roll(tiers, spark):
    tiers.roll("15m")
    tiers.roll("1h")
    late = minutes(spark, "2024-02-29 23:30:00", step=1, number=90, version=3)
    tiers.fold("1m", late)
    tiers.refresh("15m", late)
    tiers.refresh("1h", late)
    want = candles.rollup(candles.rollup(tiers.read("1m"), "15m"), "1h")
    assert rounded(tiers.read("1h")) == rounded(want)
    tiers.refresh("1h", late.limit(0))


def test_another_handle_opens_the_same_tables(tiers, spark):
    again = Tiers(spark, tiers.root, 4)
    assert again.read("1m").count() == 2500 and again.read("4h").count() == 0


def test_queries_share_minutes_and_make_them_again(spark, tmp_path):
    """Once for each state of the table below them; again if that changes or what was stored is gone."""
    import shutil

    from marketlake.plans.queries import Tables

    shutil.copytree("/root/testdata/sf0.001", tmp_path / "sf", copy_function=shutil.copyfile)
    of = lambda: Tables(spark, str(tmp_path / "sf")).tiers
    first = of()
    assert of() is first and first.read("1m").count() > 5000
    shutil.rmtree(first.root.removeprefix("file:"))
    second = of()
    assert second is not first and second.read("1m").count() > 5000
    few = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").limit(100)
    few.write.mode("overwrite").parquet(str(tmp_path / "few"))
    table = tmp_path / "sf" / "lineitem.parquet"
    shutil.rmtree(table) if table.is_dir() else table.unlink()
    shutil.copytree(tmp_path / "few", table)
    assert 0 < of().read("1m").count() <= 100
