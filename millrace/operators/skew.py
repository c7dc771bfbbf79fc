"""Joins that survive a key which holds a large part of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A key is hot from this many rows and this part of all rows; so there are at most ``PARTS`` hot keys.
HOT_ROWS, PARTS = 50_000, 200


def hot_keys(rows: DataFrame, on: str) -> list:
    """The keys that hold more than 1/200 of ``rows``, which should be cheap to read twice; fewer than 200."""
    n = rows.count()
    limit = max(HOT_ROWS, n // PARTS)
    if n <= limit:
        return []
    return [r[0] for r in rows.where(F.col(on).isNotNull()).groupBy(on).count().where(F.col("count") > limit).select(on).collect()]


def salted_join(left: DataFrame, right: DataFrame, on: str, hot: list, by: Column, parts: int = 64) -> DataFrame:
    """``left`` joined with ``right``, which has one wide row per ``on``: rows of ``hot`` keys lie in ``parts`` by a hash of ``by``, for which ``right`` is repeated."""
    if not hot:
        return left.join(right, on)
    is_hot = F.coalesce(F.col(on).isin(hot), F.lit(False))
    salt = F.when(is_hot, F.pmod(F.xxhash64(by), F.lit(parts)).cast("int")).otherwise(0)
    every = F.when(is_hot, F.sequence(F.lit(0), F.lit(parts - 1))).otherwise(F.array(F.lit(0)))
    return left.withColumn("__salt", salt).join(right.withColumn("__salt", F.explode(every)), [on, "__salt"]).drop("__salt")


def lookup(left: DataFrame, right: DataFrame, on: str, how: str = "left") -> DataFrame:
    """``left`` joined with ``right``, which has one row per ``on``.

    The keys that hold more than 1/200 of ``left`` are counted first: there are fewer than 200 of them, and only their rows
    of ``right`` are broadcast; all other keys are joined by shuffle. ``left`` should be cheap to read more than once.
    """
    hot = hot_keys(left, on)
    if not hot:
        return left.join(right, on, how)
    is_hot = F.coalesce(F.col(on).isin(hot), F.lit(False))
    return left.where(is_hot).join(F.broadcast(right.where(F.col(on).isin(hot))), on, how).unionByName(left.where(~is_hot).join(right, on, how))
