"""Training and validation rows, groups kept whole."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators.order import group_prefix


def validation_split(rows: DataFrame, group: Column, fraction: float, seed: int = 0, order: Column | None = None) -> DataFrame:
    """``rows`` with ``split``: whole groups in a hash order go to "val" until ``fraction`` of the rows is reached, the rest to "train".

    The last group may go beyond. Rows of a null group are a group each, so ``group`` should fall back on a stable id. The order
    is that of the group's name alone: rows that are added later move no other row but at the boundary.
    """
    d = rows.withColumn("__group", group)
    sizes = d.groupBy("__group").agg(F.count(F.lit(1)).alias("__n"))
    total = sizes.agg(F.coalesce(F.sum("__n"), F.lit(0))).first()[0]
    target = round(total * fraction)
    taken = group_prefix(sizes, "__n", F.lit(target), "__group", seed, order).select(F.col("__group").alias("__g"), F.col("taken"))
    split = F.when(F.col("taken"), "val").otherwise("train")
    return d.join(taken, F.col("__group").eqNullSafe(F.col("__g"))).withColumn("split", split).drop("__group", "__g", "taken")
