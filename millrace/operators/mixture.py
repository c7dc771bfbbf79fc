"""Allocations of a mixture and the order of its windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators.order import hash_rank

MODES = ("strict", "cap_proportional", "use_all")


class AllocationRefused(RuntimeError):
    """A source has less than its budget in ``strict`` mode."""


def allocate(budgets: DataFrame, ctx: int, mode: str = "strict", by: tuple[str, ...] = ()) -> DataFrame:
    """``source, budget, actual, take``: what to take from each source, a multiple of ``ctx``. ``by`` names several mixtures in one table.

    ``strict`` refuses and names every short source, ``cap_proportional`` scales all budgets by the smallest part that any
    source has, ``use_all`` takes what there is up to the budget. ``budgets`` is small: one row per source.
    """
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode!r}: one of {', '.join(MODES)}")
    b = budgets.select(*by, "source", F.col("budget").cast("bigint").alias("budget"), F.coalesce(F.col("actual"), F.lit(0)).cast("bigint").alias("actual"))
    if mode == "strict":
        short = b.where("actual < budget").orderBy("source").collect()
        if short:
            raise AllocationRefused("short of budget: " + ", ".join(f"{r['source']} by {r['budget'] - r['actual']}" for r in short))
        take = F.col("budget")
    elif mode == "use_all":
        take = F.least("actual", "budget")
    else:
        part = F.min(F.try_divide(F.col("actual").cast("double"), F.col("budget").cast("double"))).over(Window.partitionBy(*by))
        take = F.floor(F.col("budget") * F.least(F.coalesce(part, F.lit(1.0)), F.lit(1.0)))
    return b.withColumn("take", (F.floor(take / ctx) * ctx).cast("bigint"))


def interleave(windows: DataFrame, seed: int = 0, by: tuple[str, ...] = ()) -> DataFrame:
    """``source, window_id, slot`` from ``source, windows``: all windows of all sources in one random order, for each mixture in ``by``.

    Every stretch of slots has about the sources' shares; the k-th slot of a source holds its k-th window in order of the
    hash. Windows are numbered in blocks of the hash, so no task sorts all of them.
    """
    each = windows.where("windows > 0").select(*by, "source", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("windows").cast("bigint") - 1)).alias("window_id"))
    slots = hash_rank(each, [*[F.col(c) for c in by], F.col("source"), F.col("window_id")], "slot", by=list(by), seed=seed)
    return slots


def plan_counts(categories: DataFrame, total: int) -> DataFrame:
    """``category, paired, planned``: whole numbers by share (halves to even), even ones for paired categories, what is missing added to the largest unpaired one."""
    n = F.bround(F.lit(float(total)) * F.col("share"), 0).cast("bigint")
    c = categories.select("category", "paired", F.when(F.col("paired"), n + n % 2).otherwise(n).alias("planned"))
    all_of = Window.partitionBy()
    largest = F.max(F.when(~F.col("paired"), F.struct(F.col("planned"), F.col("category")))).over(all_of)
    missing = F.lit(total) - F.sum("planned").over(all_of)
    return c.select("category", "paired", (F.col("planned") + F.when(F.col("category") == largest["category"], missing).otherwise(0)).cast("bigint").alias("planned"))
