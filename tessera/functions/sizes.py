"""Broadcasts only behind a check of size, and joins that hold no hot key together."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A side is broadcast if it has at most this many rows, all of which were counted.
MAX_ROWS = 200_000
#: A key with more than one of so many parts of a side's rows is hot; there are fewer of them than this.
HOT_KEYS = 1000


def small(df: DataFrame, limit: int = MAX_ROWS) -> bool:
    """Whether ``df`` has at most ``limit`` rows."""
    return df.limit(limit + 1).count() <= limit


def maybe_broadcast(df: DataFrame, limit: int = MAX_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it is small; else Spark shuffles it."""
    return F.broadcast(df) if small(df, limit) else df


def look_up(rows: DataFrame, table: DataFrame, key: str, limit: int = MAX_ROWS, counts: DataFrame | None = None) -> DataFrame:
    """``rows`` left-joined with ``table``, which has a key once, whatever share of the rows a key has.

    A small table is broadcast. Else the rows of hot keys, which are few,
    meet theirs by a broadcast, and only the others are shuffled; Spark itself
    broadcasts none of those. ``counts`` (key, _n), if known, has at least as many
    rows a key as ``rows``, and saves counting them.
    """
    if small(table, limit):
        return rows.join(F.broadcast(table), key, "left")
    most = (rows.count() if counts is None else counts.agg(F.sum("_n")).first()[0] or 0) / HOT_KEYS
    counts = rows.groupBy(key).agg(F.count("*").alias("_n")) if counts is None else counts
    hot = counts.where(F.col("_n") > most).select(key)
    table = table.hint("merge")
    if hot.isEmpty():
        return rows.join(table, key, "left")
    hot = F.broadcast(hot)
    few = F.broadcast(table.join(hot, key, "left_semi"))
    return rows.join(hot, key, "left_semi").join(few, key, "left").unionByName(rows.join(hot, key, "left_anti").join(table, key, "left"))
