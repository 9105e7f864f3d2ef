"""Selection, segments and carried joins against plain Python."""

import random
from datetime import UTC, datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from marketlake.operators import quality, ranks
from marketlake.operators.asof import asof

START = datetime(2024, 1, 1, tzinfo=UTC)


def at(seconds):
    return START + timedelta(seconds=seconds)


def stamp(x):
    return None if x is None else int(x.replace(tzinfo=UTC).timestamp() - START.timestamp())


@pytest.mark.parametrize("bins", [2, 7, 4096])
def test_quantiles_equal_sorted_ones(spark, bins):
    """Hot values, one value, negative ones, far apart ones; nulls and what is not finite is left out."""
    draw = random.Random(4)
    groups = {
        "spread": [draw.gauss(0, 1e6) for _ in range(300)],
        "hot": [0.25] * 200 + [draw.random() for _ in range(99)] + [None, float("nan"), float("inf")],
        "one": [7.5],
        "far": [-1e300, 1e300, 1e-300, 0.0, -0.0, 3.0],
        "same": [2.0] * 50,
        "none": [None],
    }
    rows = [(k, v, None if v is None else -2 * v) for k, vs in groups.items() for v in vs]
    wanted = {"q0": ("v", 0.0), "q37": ("v", 0.37), "q50": ("w", 0.5), "q99": ("v", 0.99), "q100": ("w", 1.0)}
    found = {r["k"]: r for r in ranks.quantiles(spark.createDataFrame(rows, "k string, v double, w double").repartition(3), ["k"], wanted, bins).collect()}
    assert set(found) == set(groups) - {"none"}
    for k, r in found.items():
        for name, (c, p) in wanted.items():
            values = [v * (1 if c == "v" else -2) for v in groups[k] if v is not None and np.isfinite(v)]
            values = [v for v in values if np.isfinite(v)]
            assert r[name] == pytest.approx(float(np.quantile(values, p)), rel=1e-12, abs=1e-300), (k, name)


def test_quantiles_without_keys_or_rows(spark):
    df = spark.range(101).select(F.col("id").cast("double").alias("v"))
    assert ranks.quantiles(df, [], {"m": ("v", 0.5), "t": ("v", 0.905)}).first() == (50.0, 90.5)
    assert ranks.quantiles(df.limit(0), [], {"m": ("v", 0.5)}).first() == (None,)


def test_largest_gap_over_days_and_months(spark):
    draw, rows = random.Random(2), []
    for series in range(6):
        t = 0
        for _ in range(draw.choice([1, 2, 200])):
            rows.append((f"a{series % 3}", f"s{series}", at(60 * t)))
            t += draw.choice([0, 1, 5, 1440, 90 * 1440 if draw.random() < 0.02 else 3])
    found = {(r["asset"], r["source"]): r["gap_minutes"] for r in quality.largest_gap(spark.createDataFrame(rows, "asset string, source string, ts timestamp").repartition(3)).collect()}
    times = {}
    for a, s, t in rows:
        times.setdefault((a, s), set()).add(t)
    assert found == {k: max([0, *[(b - a).total_seconds() / 60 for a, b in zip(sorted(v), sorted(v)[1:], strict=False)]]) for k, v in times.items()}


def plain_guardrails(rows, window):
    rows = sorted(rows, key=lambda r: r[1])
    close, trades, volume = ([r[i] for r in rows] for i in (2, 3, 4))
    flat = [i > 0 and close[i] is not None and close[i] == close[i - 1] for i in range(len(rows))]
    ret = [np.log(close[i] / close[i - 1]) if i and close[i] and close[i - 1] else None for i in range(len(rows))]
    share = lambda c: max(np.mean(c[max(0, i - window + 1) : i + 1]) for i in range(len(rows)))
    run = best = 0
    for f in flat:
        run = run + 1 if f else 1
        best = max(best, run)
    vols = [np.std(ret[i - window + 1 : i + 1], ddof=1) * 1e4 for i in range(window - 1, len(rows)) if None not in ret[i - window + 1 : i + 1]]
    return share([t == 0 for t in trades]), share([f and t == 0 for f, t in zip(flat, trades, strict=True)]), share([c == 1.0 for c in close]), share([v == 0 for v in volume]), min(vols, default=None), best


@pytest.mark.parametrize("block", [6, 10, 4096])
def test_guardrails_in_blocks_equal_the_whole_series(spark, block):
    """Runs that end at, cross and fill blocks; two years; nulls."""
    draw, rows = random.Random(8), []
    for series, length in (("long", 700), ("short", 3), ("constant", 60), ("walk", 200)):
        value = 1.0
        for day in range(length):
            value = value if series == "constant" or draw.random() < 0.7 else draw.choice([1.0, 1.1, 0.9])
            rows.append((series, (START + timedelta(days=300 + day)).date(), None if series == "walk" and day % 41 == 0 else value, draw.choice([0, 1]), draw.choice([0.0, 2.0])))
    df = spark.createDataFrame(rows, "series string, day date, close double, trades long, volume double").repartition(4)
    found = {r["series"]: r for r in quality.series_guardrails(df, window=5, block=block).collect()}
    for series in ("long", "short", "constant", "walk"):
        want = plain_guardrails([r for r in rows if r[0] == series], 5)
        got = [found[series][c] for c in ("max_zero_trade", "max_flat_no_trade", "max_at_peg", "max_zero_volume", "min_vol_bps", "longest_run")]
        assert got == [None if w is None else pytest.approx(w, abs=1e-9) for w in want], series


@pytest.mark.parametrize(("age", "strict", "keyed"), [(300, False, True), (5000, True, True), (86_400 * 3, False, False), (86_400 * 31, True, False), (1, False, True)])
def test_asof_carries_over_slots(spark, age, strict, keyed):
    draw = random.Random(age)
    left = [(draw.choice("ab"), draw.randrange(86_400 * 9), i) for i in range(150)] + [("a", None, 900)]
    right = [(draw.choice("ab"), draw.randrange(86_400 * 8), float(i)) for i in range(25)] + [("a", 3600, 99.0), ("a", 3600, 98.0), ("b", None, 1.0)]
    left += [("a", 3600, 901), ("a", 3600 + age, 902), ("a", 3601 + age, 903)]
    lines = lambda rows, names: spark.createDataFrame([(k, None if t is None else at(t), v) for k, t, v in rows], names).repartition(3)
    out = asof(lines(left, "k string, ts timestamp, i long"), lines(right, "k string, r timestamp, v double").select(*(["k"] if keyed else []), "r", "v"), ["k"] if keyed else [], F.col("ts"), "r", ["v"], age, strict=strict)
    found = {r["i"]: (r["v"], stamp(r["rts"])) for r in out.collect()}
    for k, t, i in left:
        fit = sorted((x, v) for key, x, v in right if x is not None and t is not None and (not keyed or key == k) and (x < t if strict else x <= t) and t - x <= age)
        assert found[i] == ((fit[-1][1], fit[-1][0]) if fit else (None, None))
    assert len(found) == len(left)
    assert not out.where("false").collect()
