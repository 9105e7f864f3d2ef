"""Session defaults that the rest of the library relies on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "marketlake", master: str | None = None, shuffle_partitions: int | None = None, checkpoint_dir: str | None = None, driver_memory: str | None = None) -> SparkSession:
    """A session in UTC with adaptive execution; cluster settings win where they are given."""
    builder = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").config("spark.ui.enabled", "false").config("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    if checkpoint_dir:
        builder = builder.config("spark.checkpoint.dir", checkpoint_dir)
    if driver_memory:
        builder = builder.config("spark.driver.memory", driver_memory)
    return builder.getOrCreate()
