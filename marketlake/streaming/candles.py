"""Candles from a stream of fills, their repair, and rates joined on the way."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues

from marketlake.functions.timebucket import bucket_start
from marketlake.operators.candles import COLUMNS, KEYS, _finished, candles_1m, minute_aggregates, rollup
from marketlake.operators.events import learn_pools, route_events
from marketlake.operators.lookup import few
from marketlake.sources.stored import stored
from marketlake.sources.tiers import Tiers
from marketlake.sources.versioned import latest, merge_append

DELAY = "2 minutes"


def stream_candles(fills: DataFrame, delay: str = DELAY) -> DataFrame:
    """Each minute once, when the watermark says that no fill can extend it; later ones are left to reconciliation.

    Fills are dealt by candle to the tasks that keep its state before they are sorted, as `candles_1m` deals them, and
    time comes first.  The watermark is that of the minutes' starts, so the length of one is added to the delay.
    """
    rows = fills.where("closed_at is not null").withColumnRenamed("base", "asset").withColumn("ts", bucket_start(F.col("closed_at"), "1m"))
    keys = ["ts", "asset", "quote", "source"]
    rows = rows.withWatermark("ts", f"{delay} 1 minute").repartition(*keys)
    return _finished(rows.groupBy(*keys).agg(*minute_aggregates())).select(*COLUMNS, "clamped")


def open_tail(fills: DataFrame, streamed: DataFrame) -> DataFrame:
    """The minutes that the stream has not closed, from a batch over the same fills.

    A minute of which the stream has counted every fill lacks no candle, so only the fills of the others are sorted.
    """
    rows = fills.withColumn("ts", bucket_start(F.col("closed_at"), "1m"))
    counts = rows.groupBy("ts").agg(F.count("*").alias("n")).unionByName(streamed.groupBy("ts").agg((-F.sum("trade_count")).alias("n")))
    left = stored(counts.groupBy(F.col("ts").alias("left")).agg(F.sum("n").alias("n")).where("n <> 0").select("left"))
    rows = rows.join(F.broadcast(left) if few(left) else left.hint("shuffle_hash"), F.col("ts").eqNullSafe(F.col("left")), "left_semi")
    return candles_1m(rows).join(streamed.select(*KEYS), KEYS, "left_anti")


def stream_dedup(samples: DataFrame, keys: list[str], delay: str = DELAY) -> DataFrame:
    return samples.withWatermark("ts", delay).dropDuplicatesWithinWatermark(keys)


def resume(stream: DataFrame, checkpoint: str, write: Callable[[DataFrame, int], None]):
    """A query that goes on from its checkpoint; `write` is idempotent, as the last batch may come again."""
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def merge_into(path: str) -> Callable[[DataFrame, int], None]:
    """Writes each batch to a folder of its number, so that a batch that comes again replaces itself; see `read_merged`."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write


def fold_into(tiers: Tiers, grain: str) -> Callable[[DataFrame, int], None]:
    """Folds each batch into a stored tier: only the months that it touches are written again, so nothing piles up,
    and a batch that comes again changes nothing."""

    def write(batch: DataFrame, number: int) -> None:
        tiers.fold(grain, batch)

    return write


def read_merged(spark: SparkSession, path: str, keys: list[str], version: str, columns: list[str]) -> DataFrame:
    """The table that `merge_into` wrote, the latest version of each key."""
    return latest(spark.read.option("basePath", path).parquet(f"{path}/batch=*").select(columns), keys, version)


def fan_out(writers: dict[str, Callable[[DataFrame], DataFrame]], path: str) -> Callable[[DataFrame, int], None]:
    """Several tables from one batch, all written before the stream's cursor moves on."""

    def write(batch: DataFrame, number: int) -> None:
        batch.persist()
        for name, make in writers.items():
            make(batch).write.mode("overwrite").parquet(f"{path}/{name}/batch={number}")
        batch.unpersist()

    return write


def refresh_touched(batch: DataFrame, child: DataFrame, stored: DataFrame, grain: str) -> DataFrame:
    """The stored tier with the buckets that a batch of children touches rolled up again."""
    touched = batch.select("asset", "quote", "source", bucket_start(F.col("ts"), grain).alias("b")).distinct()
    rows = child.withColumn("b", bucket_start(F.col("ts"), grain)).join(touched, ["asset", "quote", "source", "b"], "left_semi").drop("b")
    return merge_append(stored, rollup(rows, grain), KEYS, "version")


def learn_then_route(batch: DataFrame, registry: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Pools learned from a batch count for the swaps of the same batch: (pools, trades, unresolved, failed)."""
    pools = learn_pools(batch, registry)
    return (pools, *route_events(batch, pools))


class _Carry(StatefulProcessor):
    """Of one quote and share of the assets: the rates of the last `max_age` seconds, and the candles that wait for the
    watermark, by the time on which a timer is set for them."""

    def __init__(self, max_age: int) -> None:
        self.max_age = max_age

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.rates = handle.getMapState("rates", "us long", "price double")
        self.waiting = handle.getMapState("waiting", "us long", "rows array<struct<asset:string,source:string,close:double>>")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        for batch in rows:
            us = batch["ts"].astype("datetime64[us]").astype("int64")
            rate = batch["side"] == 1
            for t, price in zip(us[rate].tolist(), batch["price"][rate].tolist(), strict=True):
                self.rates.updateValue((t,), (price,))
            for t, some in batch[~rate].groupby(us[~rate]):
                held = list(self.waiting.getValue((t,))[0]) if self.waiting.containsKey((t,)) else []
                self.waiting.updateValue((t,), ([*map(tuple, held), *some[["asset", "source", "close"]].itertuples(index=False, name=None)],))
                self.handle.registerTimer(t // 1000 + 1)
            # A rate alone needs no candle to go: its own timer ends it.
            for t in us[rate].unique().tolist():
                self.handle.registerTimer(t // 1000 + self.max_age * 1000 + 1)
        yield from ()

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        mark = (expiredTimerInfo.getExpiryTimeInMs() - 1) * 1000
        due = sorted(t for (t,) in self.waiting.keys() if t // 1000 == mark // 1000)
        known = sorted((t, p) for (t,), (p,) in self.rates.iterator())
        for t in due:
            last = next(((at, p) for at, p in reversed(known) if at <= t), None)
            price = last[1] if last and t - last[0] <= self.max_age * 1_000_000 else None
            rows = list(map(tuple, self.waiting.getValue((t,))[0]))
            yield pd.DataFrame({"quote": [key[0]] * len(rows), "ts": pd.to_datetime([t] * len(rows), unit="us"), "asset": [r[0] for r in rows], "source": [r[1] for r in rows], "close": [r[2] for r in rows], "price": pd.Series([price] * len(rows), dtype="float64")})
            self.waiting.removeKey((t,))
        for t, _ in known:
            if t < mark - self.max_age * 1_000_000:
                self.rates.removeKey((t,))

    def close(self) -> None:
        pass


def stream_enrich(candles: DataFrame, rates: DataFrame, max_age: int = 300, delay: str = DELAY, shares: int = 16) -> DataFrame:
    """Candles (asset, quote, source, ts, close) with the latest earlier rate of their quote (asset, ts, price).

    State is kept by quote and share of its assets, so that a quote with most candles is `shares` keys; the few rates
    go to each of them.  A timer on a candle's time hands it on when the watermark has passed it, and one behind a
    rate lets it go when it is of no use.  Needs the RocksDB state store, which `session` sets.
    """
    share = F.pmod(F.xxhash64("asset"), F.lit(shares)).cast("int")
    left = candles.select(F.col("quote").alias("k"), share.alias("share"), "ts", F.lit(0).alias("side"), "asset", "source", F.col("close").cast("double").alias("close"), F.lit(None).cast("double").alias("price"))
    right = rates.select(F.col("asset").alias("k"), F.explode(F.sequence(F.lit(0), F.lit(shares - 1))).alias("share"), "ts", F.lit(1).alias("side"), F.lit("").alias("asset"), F.lit("").alias("source"), F.lit(None).cast("double").alias("close"), F.col("price").cast("double").alias("price"))
    both = left.unionByName(right).withWatermark("ts", delay)
    return both.groupBy("k", "share").transformWithStateInPandas(_Carry(max_age), "quote string, ts timestamp, asset string, source string, close double, price double", "Append", "EventTime")
