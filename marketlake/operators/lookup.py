"""Joins of many rows, whose keys may be few and hot, with a table of what the keys stand for."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketlake.sources.stored import stored

#: Rows of a table that is sent to all tasks, at most.
MOST = 1 << 16


def few(table: DataFrame) -> bool:
    return table.limit(MOST + 1).count() <= MOST


def sendable(table: DataFrame, key: str, rows: DataFrame, *legs: str) -> DataFrame:
    """The table, marked for its joins with the rows by `key`, so that no task sorts or gathers the rows of a hot key.

    Tables of few rows go to all tasks, and so do the entries that the rows name, if those are few.  Else the tasks hash
    their part of the table and the rows stream past it.
    """
    if few(table):
        return F.broadcast(table)
    named = rows.select(F.explode(F.array(*[F.col(leg) for leg in legs])).alias(key)).distinct()
    used = stored(table.join(named, key, "left_semi"))
    return F.broadcast(used) if few(used) else used.hint("shuffle_hash")
