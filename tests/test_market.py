"""Literal edge cases of the market operators."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from marketlake.functions.prices import price_survives, rounding_bound
from marketlake.functions.timebucket import bucket_end, bucket_start
from marketlake.operators import candles, enrich, fills, quality, read, snapshot
from marketlake.operators.asof import asof
from marketlake.sources import rates
from marketlake.sources.versioned import dedup_samples, latest, merge_append, write_candles

T = datetime(2024, 1, 1)


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def fill(tx, price, vb="1", pf=True, minute=0, source="sdex", quote="USDC", base="AAA"):
    return (1, tx, 0, 0, T + timedelta(minutes=minute, seconds=tx), base, quote, source, price, float(vb), float(vb) * price, pf)


FILLS = "ledger long, tx long, op long, claim long, closed_at timestamp, base string, quote string, source string, price double, b double, q double, price_forming boolean"


def fills_of(spark, rows):
    return spark.createDataFrame(rows, FILLS).withColumns({"volume_base": F.col("b").cast("decimal(38,14)"), "volume_quote": F.col("q").cast("decimal(38,14)")}).drop("b", "q")


def test_price_rules(spark):
    n = lambda x: F.lit(x).cast("long")
    assert one(spark, rounding_bound(n(1000), n(10**15)), rounding_bound(n(1001), n(1_001_000)), rounding_bound(n(2000), n(2000)), rounding_bound(n(2000), n(1999)))[:] == (False, True, True, False)
    assert one(spark, *[price_survives(F.lit(p)) for p in (9.9e-13, 1e-12, 1e24, 5.0)])[:] == (False, True, False, True)


def test_buckets(spark):
    ts = F.lit("2024-01-31 23:59:59").cast("timestamp")
    got = one(spark, *[bucket_start(ts, g).alias(g) for g in ("15m", "4h", "1d", "1w", "1M")], bucket_end(bucket_start(ts, "1M"), "1M").alias("e"))
    assert got[:] == (datetime(2024, 1, 31, 23, 45), datetime(2024, 1, 31, 20), datetime(2024, 1, 31), datetime(2024, 1, 29), datetime(2024, 1, 1), datetime(2024, 2, 1))


def test_candle_of_dust_and_ties(spark):
    rows = [fill(1, 2.0), fill(2, 3.0), fill(3, 9.0, pf=False), fill(1, 7.0, pf=False, minute=1), fill(5, 4.0, minute=2), fill(5, 6.0, minute=2)]
    got = {r.ts.minute: r for r in candles.candles_1m(fills_of(spark, rows)).collect()}
    assert (got[0].open, got[0].high, got[0].low, got[0].close, got[0].trade_count, got[0].pf_trade_count) == (2.0, 3.0, 2.0, 3.0, 3, 2)
    assert (got[1].open, got[1].close, got[1].trade_count, got[1].pf_trade_count, got[1].pf_price_volume) == (0.0, 0.0, 1, 0, 0.0)
    assert (got[2].open, got[2].close) == (4.0, 6.0)


def candle(minute, close, close_usd=0.0, pf=1, source="sdex", quote="USDC", asset="AAA", vqu=0.0, vb=1.0):
    return (T + timedelta(minutes=minute), asset, quote, source, close, close, close, close, vb, vb * close, vqu, close_usd, close, 1, 5, pf, vb, vb * close)


CANDLE = "ts timestamp, asset string, quote string, source string, open double, high double, low double, close double, volume_base double, volume_quote double, volume_quote_usd double, close_usd double, vwap double, trade_count long, version long, pf_trade_count long, pf_volume double, pf_price_volume double"


def candles_of(spark, *rows):
    return spark.createDataFrame(list(rows), CANDLE)


def test_rollup_gates(spark):
    c = candles_of(spark, candle(0, 2.0, 1.0), candle(1, 3.0), candle(2, 99.0, pf=0), candle(3, 4e-14, 5e-14))
    r = candles.rollup(c, "15m").first()
    assert (r.open, r.high, r.low, r.close, r.close_usd, r.trade_count, r.version) == (2.0, 3.0, 2.0, 3.0, 1.5, 4, 20)


def test_asof_edges(spark):
    left = spark.createDataFrame([(1, "k", T), (2, "k", T + timedelta(seconds=301)), (3, "k", T - timedelta(seconds=1)), (4, "z", T), (5, None, T)], "id int, k string, t timestamp")
    right = spark.createDataFrame([("k", T, 5.0), ("k", T - timedelta(days=9), 1.0)], "k string, r timestamp, v double")
    at = lambda strict: {r.id: r.v for r in asof(left, right, ["k"], F.col("t"), "r", ["v"], 300, strict).collect()}
    assert at(False) == {1: 5.0, 2: None, 3: None, 4: None, 5: None}
    assert at(True) == {1: None, 2: None, 3: None, 4: None, 5: None}
    assert {r.id: r.v for r in asof(left, right, ["k"], F.col("t"), "r", ["v"], 86_400 * 30).collect()} == {1: 5.0, 2: 5.0, 3: 1.0, 4: None, 5: None}


def test_tiers(spark):
    c = candles_of(spark, candle(0, 2.0), candle(60, 2.0), candle(0, 7.0, quote="USDT"), candle(0, 3.0, quote="XLM"), candle(0, 0.5, asset="XLM"))
    oracle = spark.createDataFrame([("USDC", T, 0.99)], "asset string, ts timestamp, price double")
    rate = spark.createDataFrame([("USDC", T + timedelta(minutes=61), "external", 0.9, "measured", 1)], "asset string, ts timestamp, method string, rate double, quality string, version long")
    got = {(r.asset, r.quote, r.ts.hour): (round(r.close_usd, 9), r.version) for r in enrich.enrich(c, oracle, rate).collect()}
    # 01:00 has no reading within 300 s, and the imported rate stands exactly at its end, so it is pegged.
    assert got[("AAA", "USDC", 0)] == (1.98, 6) and got[("AAA", "USDC", 1)] == (2.0, 6)
    assert got[("AAA", "USDT", 0)] == (0.0, 5) and got[("AAA", "XLM", 0)] == (0.0, 5)
    with_rate = rate.unionByName(rate.withColumns({"ts": F.lit(T), "method": F.lit("oracle"), "rate": F.lit(0.98)}))
    got = {(r.asset, r.quote): r.close_usd for r in enrich.enrich(c.where("ts < '2024-01-01 00:30'"), oracle, with_rate).collect()}
    assert abs(got[("AAA", "XLM")] - 0.5 * 3 * 0.98) < 1e-12


def test_venue_filters(spark):
    v = lambda *rows: spark.createDataFrame([("A", f"v{i}", *r) for i, r in enumerate(rows)], "asset string, source string, price double, live boolean, volume double")
    kept = lambda df: sorted(r.source for r in df.collect())
    assert kept(snapshot.median_mask(v((1.0, True, 1.0), (1.0, True, 1.0), (1.25, True, 1.0)))) == ["v0", "v1"]
    assert kept(snapshot.median_mask(v((1.0, True, 1.0), (1.25, True, 1.0)))) == ["v0", "v1"]
    assert kept(snapshot.funded_filter(v((1.0, True, 100.0), (1.0, True, 50.0)))) == ["v0", "v1"]
    assert kept(snapshot.funded_filter(v((1.0, True, 100.0), (1.0, True, 100.5)))) == ["v1"]
    assert kept(snapshot.liveness_filter(v((1.0, False, 1.0), (1.0, True, 1.0)))) == ["v1"]
    assert kept(snapshot.liveness_filter(v((1.0, False, 1.0), (1.0, False, 1.0)))) == ["v0", "v1"]


def test_versions_and_writes(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1, 5), ("a", 2, 1), ("a", 2, 3), ("b", 1, None)], "k string, version long, v int")
    assert sorted(r[:] for r in latest(rows, ["k"], "version").collect()) == [("a", 2, 3), ("b", 1, None)]
    once = merge_append(rows, rows, ["k"], "version")
    assert sorted(r[:] for r in merge_append(once, rows, ["k"], "version").collect()) == sorted(r[:] for r in once.collect())
    assert dedup_samples(rows, ["k"]).count() == 2
    c = candles_of(spark, candle(0, 1.0), candle(60 * 24 * 40, 2.0))
    write_candles(c, f"{tmp_path}/c")
    write_candles(candles_of(spark, candle(0, 9.0)), f"{tmp_path}/c")
    assert sorted(r.close for r in spark.read.parquet(f"{tmp_path}/c").collect()) == [2.0, 9.0]


def test_reconcile_is_a_no_op_on_equal_tiers(spark):
    c = candles_of(spark, *[candle(m, 1.0 + m) for m in range(0, 600, 7)])
    as_of = F.lit(T + timedelta(hours=24)).cast("timestamp")
    r = candles.rollup(c, "15m")
    assert candles.reconcile(c, r, "15m", as_of).count() == 0
    assert candles.reconcile(c, r.where("close > 100"), "15m", as_of).count() == r.where("close <= 100").count()


def test_rates_file(spark, tmp_path):
    head = ",".join(rates.HEADER)
    body = ["2024-01-01 00:00:00,1,1,1,0.99,3,kraken,measured,1,a", "2024-01-02 00:00:00,1,1,1,7,3,kraken,measured,1,a", "2024-01-03 12:00:00,1,1,1,1,3,kraken,measured,1,a", "x,1,1,1,1,3,who,measured,1,a"]
    (tmp_path / "r.csv").write_text("\n".join([head, *body]))
    good, bad, counts = rates.load_rates(rates.read_rates(spark, str(tmp_path / "r.csv")), 86_400, 1_704_153_600)
    assert [r.rate for r in good.collect()] == [0.99] and counts.first().era == "before"
    assert sorted(tuple(r.reasons) for r in bad.collect()) == [("bad time", "unknown source"), ("off the bucket",), ("out of band",)]


def test_pages_and_min_volume(spark):
    rows = spark.createDataFrame([(i, float(i // 2)) for i in range(10)], "id int, v double")
    seen, value, last = [], None, None
    while True:
        page = read.page_after(rows, "v", "id", value, last, 3).collect()
        seen += [r.id for r in page]
        if not page or not page[-1].has_more:
            break
        value, last = page[-1].v, page[-1].id
    assert seen == list(range(9, -1, -1))
    v = spark.createDataFrame([("A", "x", 1.0, 5.0), ("A", "y", 3.0, 15.0)], "asset string, source string, price double, volume double")
    assert [read.apply_min_volume(v, t).first().vwap for t in (0.0, 10.0, 99.0)] == [2.5, 3.0, 0.0]


def test_guard_and_weighted_median(spark):
    w = spark.createDataFrame([("a", 1.0, 1.0), ("a", 2.0, 1.0), ("a", 9.0, 5.0)], "k string, v double, w double")
    assert quality.weighted_median(w, ["k"], "v", "w").first().weighted_median == 9.0
    none = candles_of(spark, candle(0, 1.0)).where("false")
    assert quality.guarded(quality.peg_applied(none, "XLM")).first().status.startswith("refused")


def test_pair_direction(spark):
    rows = [("XLM", "USDC"), ("USDC", "XLM"), ("BBB", "AAA"), ("AAA", "BBB"), ("USDT", "AAA")]
    df = spark.createDataFrame([(a, b, 1, 2) for a, b in rows], "sold string, bought string, amount_sold long, amount_bought long")
    got = {(r.sold, r.bought): (r.base, r.quote, r.inverted) for r in fills.canonicalise(df).collect()}
    assert got == {("XLM", "USDC"): ("XLM", "USDC", False), ("USDC", "XLM"): ("XLM", "USDC", True), ("BBB", "AAA"): ("AAA", "BBB", True), ("AAA", "BBB"): ("AAA", "BBB", False), ("USDT", "AAA"): ("AAA", "USDT", True)}
