"""Read queries and checks on small tables."""

import random
from datetime import UTC, date, datetime, timedelta
from itertools import product

import pytest
from pyspark.sql import functions as F

from marketlake.operators import events, jobs, read, snapshot

START = datetime(2020, 1, 1, tzinfo=UTC)


def test_methods_of_weeks_and_months(spark):
    """An imported rate within the span, on its last day or on the day before it counts; one two days before does not."""
    rates = spark.createDataFrame([(datetime(2019, 12, 30, 5, tzinfo=UTC), "external", 1.1), (datetime(2020, 3, 17, 23, tzinfo=UTC), "external", 1.1), (datetime(2020, 5, 2, tzinfo=UTC), "external", 0.0), (datetime(2020, 5, 3, tzinfo=UTC), "oracle", 1.1)], "ts timestamp, method string, rate double")
    days = [date(2019, 12, 30), date(2020, 3, 17)]
    for grain, width in (("1d", 1), ("1w", 7), ("1M", None)):
        starts = [START + timedelta(days=i) for i in range(-10, 150)]
        starts = starts if grain == "1d" else [s for s in starts if (s.weekday() == 0 if grain == "1w" else s.day == 1)]
        candles = spark.createDataFrame([(s, "USDC", 2.0, 3.0) for s in starts], "ts timestamp, quote string, close double, close_usd double")
        found = {r["ts"].replace(tzinfo=UTC): r["method"] for r in read.usd_method(candles, rates, grain).collect()}
        for s in starts:
            end = s + timedelta(days=width) if width else (s.replace(day=28) + timedelta(days=4)).replace(day=1)
            assert found[s] == ("external" if any(s.date() - timedelta(days=1) <= d <= end.date() for d in days) else ""), (grain, s)


def hour(n):
    return START + timedelta(hours=n)


def test_native_series(spark):
    """Volumes at the newest rate before the hour's end and at most a day old; worst quality; buckets only where rates are."""
    rates = [(hour(0), 0.10, "measured", "k"), (hour(1), 0.30, "odd", "k"), (hour(1), 0.30, "fallback", "k"), (hour(24), 0.20, "measured", "k"), (hour(50), 0.40, "", ""), (hour(120), 0.5, "measured", "a"), (hour(121), 0.5, "measured", "b")]
    trades = [(hour(0), "XLM", "USDC", 10), (hour(2), "USDT", "XLM", 7), (hour(25), "XLM", "USDC", 4), (hour(80), "XLM", "USDC", 5), (hour(26), "XLM", "AAA", 999)]
    c = spark.createDataFrame([(t, a, q, float(v) if a == "XLM" else 1.0, 1.0 if a == "XLM" else float(v), 1) for t, a, q, v in trades], "ts timestamp, asset string, quote string, volume_base double, volume_quote double, trade_count long")
    hourly = spark.createDataFrame(rates, "ts timestamp, rate double, quality string, source string")
    dollar = spark.createDataFrame([("USDC",), ("USDT",)], "asset string")
    rows = {r["ts"].replace(tzinfo=UTC): r for r in read.ohlcv_native(c, hourly, dollar, "1d").collect()}
    assert sorted(rows) == [hour(0), hour(24), hour(48), hour(120)]
    first = rows[hour(0)]
    assert (first["open"], first["high"], first["low"], first["quality"], first["rate_source"]) == (0.10, 0.30, 0.10, "odd", "k")
    assert first["volume_base"] == 17 and first["volume_usd"] == pytest.approx(10 * 0.10 + 7 * 0.30) and first["vwap"] == pytest.approx(3.1 / 17) and first["trade_count"] == 2
    assert (rows[hour(48)]["quality"], rows[hour(48)]["rate_source"], rows[hour(48)]["volume_base"], rows[hour(48)]["vwap"]) == (None, None, 0, 0.4)
    assert rows[hour(120)]["rate_source"] is None
    late = read.ohlcv_native(c, hourly.where(F.col("ts") < F.lit(hour(24))), dollar, "1d", F.lit(hour(0)), F.lit(hour(24))).collect()
    assert len(late) == 1 and late[0]["volume_usd"] == pytest.approx(3.1)
    quarter = read.ohlcv_native(c.unionByName(c.withColumn("ts", F.col("ts") + F.expr("interval 15 minutes"))), hourly, dollar, "15m").collect()
    assert sorted((r["ts"].replace(tzinfo=UTC), r["close"]) for r in quarter) == [(hour(0), 0.10), (hour(0) + timedelta(minutes=15), 0.10)]


def test_attainable_averages_are_those_of_all_choices(spark):
    draw = random.Random(3)
    for ties in ([1], [2, 1, 3], [2, 2, 2, 2]):
        venues = [(f"s{i}", [float(draw.randrange(1, 9)) for _ in range(n)], float(draw.randrange(1, 50))) for i, n in enumerate(ties)]
        df = spark.createDataFrame([(venues,)], "venues array<struct<source:string,closes:array<double>,volume:double>>")
        found = sorted(set(df.select(snapshot.attainable("venues").alias("a")).first()["a"]))
        total = sum(v for _, _, v in venues)
        want = sorted({sum(c * v for c, (_, _, v) in zip(choice, venues, strict=True)) / total for choice in product(*[c for _, c, _ in venues])})
        assert found == pytest.approx(want)
    none = spark.createDataFrame([([("s", [2.0], 0.0)],)], "venues array<struct<source:string,closes:array<double>,volume:double>>")
    assert none.select(snapshot.attainable("venues").alias("a")).first()["a"] == [0.0]


def test_average_between_two_choices_is_a_mismatch(spark):
    ts = datetime(2024, 1, 2, tzinfo=UTC)
    rows = [(ts, "AAA", q, "sdex", 2.0, p, 500.0, 1, 1) for q, p in (("USDC", 1.0), ("XLM", 3.0))]
    c = spark.createDataFrame(rows, "ts timestamp, asset string, quote string, source string, close double, close_usd double, volume_quote_usd double, pf_trade_count long, version long").withColumn("volume_base", F.lit(1.0))
    for average, verdict in ((1.0, "match"), (3.0, "match"), (2.0, "mismatch")):
        made = spark.createDataFrame([("AAA", 1.0, 1000.0, '{"sdex":"1"}', average)], "asset string, price_usd double, volume_24h_usd double, sources string, vwap_24h double")
        assert snapshot.recompute_snapshot(c, made, F.lit(ts)).first()["vwap_verdict"] == verdict


def test_symbols(spark):
    rows = [(" USDC ", "USDC"), ("a.b-c_d+e:f g", "a.b-c_d+e:f g"), ("токен1", "токен1"), ("", None), ("  ", None), (None, None), ("x" * 32, "x" * 32), ("x" * 33, None), ("a‮b", None), ("​", None), ("<b>", None), (" A\t", "A")]
    found = spark.createDataFrame(rows, "symbol string, want string").select(jobs.sanitised(F.col("symbol")).alias("got"), "want").collect()
    assert [r["got"] for r in found] == [r["want"] for r in found]


def test_topics_are_told_by_their_types(spark):
    """An address that spells an action is none; a router's swap lacks the keys of a pool's; what is no JSON is nothing."""
    topic = lambda *t: "[" + ",".join(f'{{"type":"{k}","value":"{v}"}}' for k, v in t) + "]"
    pool, router = '{"amount0":{"type":"i128","value":"5"},"amount1":{"type":"i128","value":"-9"}}', '{"amount_in":{"type":"i128","value":"5"}}'
    rows = [
        (topic(("sym", "swap"), ("address", "G1")), pool, "signed"),
        (topic(("string", "swap")), pool, "signed"),
        (topic(("address", "swap")), pool, None),
        (topic(("sym", "swap"), ("address", "G1")), router, None),
        (topic(("sym", "swap"), ("string", "sell_token")), "{}", "multirow"),
        (topic(("sym", "swap"), ("address", "sell_token")), "{}", None),
        (topic(("sym", "trade"), ("address", "A"), ("address", "B")), "[]", "single"),
        (topic(("sym", "trade"), ("sym", "A"), ("address", "B")), "[]", None),
        (topic(("sym", "POOL"), ("sym", "swap")), "not json", "weighted"),
        ("not json", pool, None),
        (None, None, None),
    ]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, topics string, data string, want string")
    assert [r["shape"] for r in events.shaped(df).orderBy("i").collect()] == [r[2] for r in rows]


def test_routing_scans_once(spark):
    e = spark.createDataFrame([(1, 1, 0, "C0", None, '[{"type":"string","value":"SoroswapPair"},{"type":"sym","value":"swap"}]', '{"amount_0_in":{"type":"i128","value":"7"},"amount_1_in":{"type":"i128","value":"0"},"amount_0_out":{"type":"i128","value":"0"},"amount_1_out":{"type":"i128","value":"3"}}')], "ledger long, tx long, event_index long, contract string, closed_at timestamp, topics string, data string")
    pools = spark.createDataFrame([("C0", "soroswap", "AAA", "USDC")], "contract string, venue string, token_0 string, token_1 string")
    assert events.routed(e, pools)._jdf.queryExecution().executedPlan().toString().count("parse_json") <= 2
    trades, other, failed = events.route_events(e, pools)
    assert [(r["sold"], r["bought"], int(r["amount_sold"]), int(r["amount_bought"])) for r in trades.collect()] == [("AAA", "USDC", 7, 3)] and not other.collect() and not failed.collect()


def test_keys_keep_issuers_of_one_code_apart(spark):
    """Reserved identities are their code; others of the same code are not, nor do they get its rank; no two share a key."""
    from marketlake.operators import fills, identity

    reserved = {"XLM": "", "USDC": "GUSDC"}
    assets = spark.createDataFrame([("XLM", "", ""), ("USDC", "GUSDC", "C1"), ("USDC", "GFAKE", ""), ("AAA", "G1", ""), ("AAA", "G2", ""), ("AAA", "G2", "C9"), ("", "", "C2"), ("", "", "C3")], "asset string, issuer string, contract string")
    names = identity.dictionary(assets, reserved)
    keys = {(r["asset"], r["issuer"], r["contract"]): r["key"] for r in names.collect()}
    assert keys["XLM", "", ""] == "XLM" and keys["USDC", "GUSDC", ""] == "USDC" and ("AAA", "G2", "C9") not in keys
    assert len(set(keys.values())) == len(keys) == 7 and not identity.collisions(names).collect()
    claims = spark.createDataFrame([("AAA", "G1", "USDC", "GUSDC"), ("AAA", "G2", "USDC", "GFAKE"), ("ZZZ", None, "XLM", "")], "sold string, sold_issuer string, bought string, bought_issuer string").withColumns({"amount_sold": F.lit(5), "amount_bought": F.lit(6)})
    rows = fills.canonicalise(identity.keyed(claims, reserved))
    got = [(r["base_code"], r["base_issuer"], r["quote_code"], r["quote_issuer"]) for r in identity.named(rows, names, "base", "quote").collect()]
    assert sorted(got, key=str) == [("AAA", "G1", "USDC", "GUSDC"), ("AAA", "G2", "USDC", "GFAKE"), ("ZZZ", None, "XLM", "")]
    clash = names.unionByName(spark.createDataFrame([(keys["AAA", "G1", ""], "BBB", "G9", "")], "key string, asset string, issuer string, contract string"))
    assert [r["identities"] for r in identity.collisions(clash).collect()] == [2]
