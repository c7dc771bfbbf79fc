"""Assertions on data: errors that say what is wrong, raised before anything is built on it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class CheckFailed(AssertionError):
    """Data are not what they are said to be."""


def compared(recorded: DataFrame, rebuilt: DataFrame, key: str, value: str) -> DataFrame:
    """``key, recorded, rebuilt, status``: "equal", "differs", or on which side a key is missing."""
    j = recorded.select(key, F.col(value).alias("recorded"), F.lit(True).alias("__a")).join(rebuilt.select(key, F.col(value).alias("rebuilt"), F.lit(True).alias("__b")), key, "full")
    status = F.when(F.col("__a").isNull(), "not_recorded").when(F.col("__b").isNull(), "not_rebuilt").when(F.col("recorded").eqNullSafe(F.col("rebuilt")), "equal").otherwise("differs")
    return j.select(key, "recorded", "rebuilt", status.alias("status"))


def _refuse(bad: DataFrame, key: str, what: str) -> None:
    some = bad.orderBy(key).limit(6).collect()
    if some:
        raise CheckFailed(f"{what}: " + ", ".join(str(r[0]) for r in some[:5]) + (", ..." if len(some) > 5 else ""))


def assert_counts(recorded: DataFrame, rebuilt: DataFrame, key: str, value: str) -> None:
    """An error that names the keys whose value is not the recorded one."""
    _refuse(compared(recorded, rebuilt, key, value).where("status <> 'equal'"), key, "not as recorded")


def shared(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys that both sides have, each once."""
    return a.where(F.col(key).isNotNull()).select(key).intersect(b.where(F.col(key).isNotNull()).select(key))


def assert_no_leak(train: DataFrame, held_out: DataFrame, key: str) -> None:
    """An error that names keys which are both in the training data and held out."""
    _refuse(shared(train, held_out, key), key, f"{key} both in training and held out")


def unmatched(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """``key, n``: keys of ``left`` that a lookup in ``right`` doesn't find, null too, and how many rows have them."""
    return left.join(right.select(key), key, "left_anti").groupBy(key).agg(F.count(F.lit(1)).alias("n"))
