"""Plans of steps that many queries share: nothing in them grows with the rows of a hot key or the size of a split."""

from datetime import datetime

from pyspark.sql import functions as F

from marketlake.operators import candles, events, fills, identity

CLAIM = "sold string, bought string, amount_sold long, amount_bought long"


def plan(df):
    return df._jdf.queryExecution().sparkPlan().toString()


def test_minutes_sort_fills_once_after_they_are_dealt(spark):
    raw = spark.createDataFrame([(1, 1, 0, 0, datetime(2024, 1, 1), "AAA", "USDC", "sdex", 2.0, 1.0, 2.0, True)], "ledger long, tx long, op long, claim long, closed_at timestamp, base string, quote string, source string, price double, b double, q double, price_forming boolean")
    made = candles.candles_1m(raw.withColumns({"volume_base": F.col("b").cast("decimal(38,14)"), "volume_quote": F.col("q").cast("decimal(38,14)")}))
    done = made._jdf.queryExecution().executedPlan().toString()
    assert done.count("- Sort [") == 1 and done.count("- Exchange ") == 1
    assert [r["close"] for r in made.collect()] == [2.0]


def test_registry_is_sent_to_the_rows(spark):
    rows = spark.createDataFrame([("CAAA", "XLM", 1, 1), ("XLM", "CAAA", 1, 1), ("ZZZ", "XLM", 1, 1)], CLAIM)
    assets = spark.createDataFrame([("AAA", "CAAA"), ("XLM", "")], "asset string, contract string")
    out = fills.collapse_wrapped(rows, assets)
    assert "SortMergeJoin" not in plan(out) and sorted((r["sold"], r["bought"]) for r in out.collect()) == [("AAA", "XLM"), ("XLM", "AAA"), ("ZZZ", "XLM")]


def test_long_registry_gives_what_the_rows_name(spark, monkeypatch):
    from marketlake.operators import lookup

    monkeypatch.setattr(lookup, "MOST", 2)
    rows = spark.createDataFrame([("C1", "XLM", 1, 1), ("C2", "C1", 1, 1), ("C3", "C9", 1, 1)], CLAIM)
    assets = spark.range(8).select(F.concat(F.lit("A"), "id").alias("asset"), F.concat(F.lit("C"), "id").alias("contract"))
    for n in (3, 2):  # three named entries are too many to send, then two
        out = fills.collapse_wrapped(rows.limit(n), assets)
        want = [("A1", "XLM"), ("A2", "A1"), ("A3", "C9")][:n]
        assert "SortMergeJoin" not in plan(out) and sorted((r["sold"], r["bought"]) for r in out.collect()) == want


def test_scaled_amounts_filter_nothing_below_the_joins(spark):
    rows = fills.canonicalise(spark.createDataFrame([("AAA", "XLM", 10, 20), ("AAA", "QQQ", 10, 20)], CLAIM))
    good, missing = fills.scale_amounts(rows, spark.createDataFrame([("AAA", 1), ("XLM", 1)], "asset string, decimals int"))
    text = plan(good)
    assert "SortMergeJoin" not in text and not [line for line in text.splitlines() if "Filter" in line and "CASE" in line]
    assert [(float(r["volume_base"]), float(r["volume_quote"])) for r in good.collect()] == [(1.0, 2.0)] and {*good.columns} == {*rows.columns, "volume_base", "volume_quote"}
    assert missing.collect()[0]["asset"] == "QQQ"


def test_keys_are_hashed_once(spark):
    claims = spark.createDataFrame([("AAA", "G", "XLM", "")], "sold string, sold_issuer string, bought string, bought_issuer string")
    text = plan(fills.drop_self_swaps(identity.keyed(claims, {"XLM": ""})))
    assert not [line for line in text.splitlines() if "Filter" in line and "xxhash64" in line]


def test_factory_words_are_sought_before_parsing(spark):
    rows = [(1, 1, '[{"type":"sym","value":"add_pool"}]', '[{"type":"address","value":"C1"}]'), (2, 1, '[{"type":"sym","value":"\\u0061dd_pool"}]', '[{"type":"address","value":"C2"}]'), (3, 1, '[{"type":"sym","value":"swap"}]', '[{"type":"address","value":"C3"}]')]
    found = events.factory_pools(spark.createDataFrame(rows, "ledger long, event_index long, topics string, data string"))
    assert not [line for line in plan(found).splitlines() if "Filter" in line and "parse" in line.lower()]
    assert sorted(r["contract"] for r in found.collect()) == ["C1", "C2"]
