"""The stream, its open tail and reconciliation together give what a batch gives."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from marketlake.operators.candles import KEYS, candles_1m
from marketlake.operators.asof import asof
from marketlake.sources.tiers import Tiers
from marketlake.sources.versioned import latest
from marketlake.streaming import candles as s
from tests.test_market import FILLS, T, fill, fills_of


def _files(spark, tmp_path, batches):
    for i, rows in enumerate(batches):
        fills_of(spark, rows).coalesce(1).write.parquet(f"{tmp_path}/in/{i:03d}")
    schema = fills_of(spark, batches[0]).schema
    return schema, spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")


def test_stream_and_tail_equal_batch(spark, tmp_path):
    batches = [[fill(k, 1.0 + k, minute=m + b * 10) for m in range(10) for k in (1, 2)] for b in range(4)]
    schema, stream = _files(spark, tmp_path, batches)
    out = s.stream_candles(stream).drop("clamped")
    s.resume(out, f"{tmp_path}/ck", s.merge_into(f"{tmp_path}/out")).awaitTermination(120)
    streamed = s.read_merged(spark, f"{tmp_path}/out", KEYS, "version", out.columns)
    every = fills_of(spark, [r for b in batches for r in b])
    batch = candles_1m(every).drop("clamped")
    assert 0 < streamed.count() < batch.count()
    both = streamed.unionByName(s.open_tail(every, streamed).select(streamed.columns))
    assert sorted(map(str, both.collect())) == sorted(map(str, batch.select(both.columns).collect()))
    # Going on from the checkpoint without new files changes nothing.
    before = streamed.count()
    s.resume(out, f"{tmp_path}/ck", s.merge_into(f"{tmp_path}/out")).awaitTermination(120)
    assert s.read_merged(spark, f"{tmp_path}/out", KEYS, "version", out.columns).count() == before
    assert schema["price"].dataType.simpleString() == "double" and FILLS


def test_refresh_touched(spark):
    c = candles_1m(fills_of(spark, [fill(1, 2.0, minute=m) for m in range(40)])).drop("clamped")
    old = s.refresh_touched(c.limit(0), c.where("ts < '2024-01-01 00:10'"), c.limit(0), "15m")
    assert old.count() == 0
    first = s.refresh_touched(c.where("ts < '2024-01-01 00:10'"), c.where("ts < '2024-01-01 00:10'"), c.limit(0), "15m")
    then = s.refresh_touched(c.where("ts >= '2024-01-01 00:10'"), c, first, "15m")
    assert sorted(r.trade_count for r in then.collect()) == [10, 15, 15]


def test_dedup_and_learning(spark, tmp_path):
    rows = [("USDC", T + timedelta(seconds=k // 2), 1.0) for k in range(20)]
    spark.createDataFrame(rows, "asset string, ts timestamp, price double").write.parquet(f"{tmp_path}/d")
    stream = spark.readStream.schema("asset string, ts timestamp, price double").parquet(f"{tmp_path}/d")
    q = s.stream_dedup(stream, ["asset", "ts"]).writeStream.format("memory").queryName("dedup").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.table("dedup").count() == 10
    batch = spark.createDataFrame(
        [
            ("CF", 1, 1, 0, '[{"type":"sym","value":"pool_created"}]', '{"pool_address":{"type":"address","value":"C1"},"token0":{"type":"address","value":"A"},"token1":{"type":"address","value":"B"}}'),
            ("C1", 1, 1, 1, '[{"type":"sym","value":"swap"},{"type":"address","value":"G"}]', '{"amount0":{"type":"i128","value":"5"},"amount1":{"type":"i128","value":"-7"}}'),
        ],
        "contract string, ledger long, tx long, event_index long, topics string, data string",
    ).withColumn("closed_at", F.lit(datetime(2024, 1, 1)))
    none = spark.createDataFrame([], "contract string, venue string, token_0 string, token_1 string")
    pools, trades, unresolved, failed = s.learn_then_route(batch, none)
    assert [r.contract for r in pools.collect()] == ["C1"] and unresolved.count() == 0 == failed.count()
    assert [(r.sold, r.bought, int(r.amount_sold), int(r.amount_bought)) for r in trades.collect()] == [("A", "B", 5, 7)]


def test_stream_enrich(spark, tmp_path):
    at = lambda n: T + timedelta(seconds=n)
    spark.createDataFrame([("AAA", "USDC", "v", at(n), 2.0) for n in (0, 100, 500, 2000)], "asset string, quote string, source string, ts timestamp, close double").coalesce(1).write.parquet(f"{tmp_path}/c")
    spark.createDataFrame([("USDC", at(50), 0.9), ("USDC", at(100), 0.8), ("USDC", at(5000), 1.0)], "asset string, ts timestamp, price double").coalesce(1).write.parquet(f"{tmp_path}/r")
    read = lambda p, schema: spark.readStream.schema(schema).parquet(f"{tmp_path}/{p}")
    out = s.stream_enrich(read("c", "asset string, quote string, source string, ts timestamp, close double"), read("r", "asset string, ts timestamp, price double"))
    q = out.writeStream.format("memory").queryName("enriched").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {(r.ts - T).seconds: r.price for r in latest(spark.table("enriched"), ["ts"], "close").collect()}
    assert got == {0: None, 100: 0.8, 500: None, 2000: None}


def test_stream_enrich_spreads_a_quote_over_keys(spark, tmp_path):
    """A hundred assets of one quote in several batches, against the batch join; more than one key of state."""
    at = lambda n: T + timedelta(seconds=n)
    candles = [(f"A{i}", "USDC", "v", at(60 * m + i % 7), float(i + m)) for m in range(20) for i in range(100) if (i + m) % 9 == 0]
    prices = [("USDC", at(45 * m), 1 + m / 100) for m in range(20)] + [("USDC", at(9000), 1.0)]
    half = len(candles) // 2
    for n, rows in enumerate((candles[:half], candles[half:])):
        spark.createDataFrame(rows, "asset string, quote string, source string, ts timestamp, close double").coalesce(1).write.parquet(f"{tmp_path}/c/{n}")
    for n, rows in enumerate((prices[:9], prices[9:])):
        spark.createDataFrame(rows, "asset string, ts timestamp, price double").coalesce(1).write.parquet(f"{tmp_path}/r/{n}")
    read = lambda p, schema: spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/{p}")
    out = s.stream_enrich(read("c", "asset string, quote string, source string, ts timestamp, close double"), read("r", "asset string, ts timestamp, price double"), shares=4)
    q = out.writeStream.format("memory").queryName("spread").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(180)
    right = spark.createDataFrame(prices, "quote string, r timestamp, price double")
    want = asof(spark.createDataFrame(candles, "asset string, quote string, source string, ts timestamp, close double"), right, ["quote"], F.col("ts"), "r", ["price"], 300)
    rows = lambda df: sorted((r.asset, r.ts, r.close, r.price) for r in df.collect())
    assert rows(spark.table("spread")) == rows(want)
    assert spark.table("spread").select(F.pmod(F.xxhash64("asset"), F.lit(4))).distinct().count() == 4


def test_folded_stream_equals_batch(spark, tmp_path):
    batches = [[fill(k, 1.0 + k, minute=m + b * 10) for m in range(10) for k in (1, 2)] for b in range(3)]
    _, stream = _files(spark, tmp_path, batches)
    tiers = Tiers(spark, f"{tmp_path}/tiers", 2)
    out = s.stream_candles(stream).drop("clamped")
    s.resume(out, f"{tmp_path}/ck", s.fold_into(tiers, "1m")).awaitTermination(180)
    streamed = tiers.read("1m")
    every = fills_of(spark, [r for b in batches for r in b])
    both = streamed.unionByName(s.open_tail(every, streamed).select(streamed.columns))
    batch = candles_1m(every).drop("clamped").select(both.columns)
    assert 0 < streamed.count() and sorted(map(str, both.collect())) == sorted(map(str, batch.collect()))


def test_fan_out_writes_every_table_of_a_batch(spark, tmp_path):
    spark.createDataFrame([("AAA", n) for n in range(10)], "asset string, n long").coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("asset string, n long").parquet(f"{tmp_path}/in")
    made = {"even": lambda b: b.where("n % 2 = 0"), "sums": lambda b: b.groupBy("asset").agg(F.sum("n").alias("n"))}
    write = s.fan_out(made, f"{tmp_path}/out")
    stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start().awaitTermination(60)
    read = lambda name: sorted(r.n for r in spark.read.parquet(f"{tmp_path}/out/{name}").collect())
    assert read("even") == [0, 2, 4, 6, 8] and read("sums") == [45]
    write(spark.createDataFrame([("AAA", 4)], "asset string, n long"), 0)  # a batch that is run again replaces its own rows
    assert read("even") == [4] and read("sums") == [4]


def test_streamed_fills_are_dealt_before_they_are_sorted(spark, tmp_path, capsys):
    _, stream = _files(spark, tmp_path, [[fill(1, 2.0)]])
    s.stream_candles(stream).explain()
    text = capsys.readouterr().out
    assert text.count("Exchange ") == 1 and text.rindex("Exchange ") > text.rindex("SortAggregate(") and "window" not in text


def test_a_minute_closes_when_the_delay_has_passed_since_its_end(spark, tmp_path):
    """The newest fill is in minute 19, so 16 closes, with a fill that comes as it does, and 17 stays open."""
    _, stream = _files(spark, tmp_path, [[fill(1, 2.0, minute=m) for m in range(20)], [fill(2, 3.0, minute=16), fill(3, 3.0, minute=17)]])
    s.resume(s.stream_candles(stream).drop("clamped"), f"{tmp_path}/ck", s.merge_into(f"{tmp_path}/out")).awaitTermination(120)
    got = spark.read.parquet(f"{tmp_path}/out/batch=*").select(((F.unix_timestamp("ts") - F.unix_timestamp(F.lit(T))) / 60).cast("int").alias("m"), "trade_count").collect()
    assert sorted((r.m, r.trade_count) for r in got) == [*[(m, 1) for m in range(16)], (16, 2)]


def test_tail_sorts_the_fills_of_open_minutes_alone(spark, monkeypatch):
    """A whole minute that is open, another's pair that came late, and a fill without a time; many open minutes and few."""
    rows = [fill(k, 1.0 + k, minute=m) for m in range(6) for k in (1, 2)]
    every = fills_of(spark, rows).unionByName(fills_of(spark, [fill(9, 5.0, minute=2)]).withColumn("base", F.lit("LATE"))).unionByName(fills_of(spark, [fill(9, 5.0)]).withColumn("closed_at", F.lit(None).cast("timestamp")))
    batch = candles_1m(every).drop("clamped")
    streamed = candles_1m(fills_of(spark, rows)).drop("clamped").where(F.col("ts") < F.lit(T + timedelta(minutes=5)))
    want = sorted(map(str, batch.join(streamed, KEYS, "left_anti").select(batch.columns).collect()))
    assert len(want) == 3
    for most in (1 << 16, 1):
        monkeypatch.setattr("marketlake.operators.lookup.MOST", most)
        tail = s.open_tail(every, streamed).drop("clamped")
        assert "LeftSemi" in tail._jdf.queryExecution().optimizedPlan().toString()
        assert sorted(map(str, tail.select(batch.columns).collect())) == want
