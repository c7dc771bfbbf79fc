"""Statistics as column expressions; sums stay whole numbers where they can, and divisions are safe on empty input."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators.order import block_of
from millrace.operators.skew import lookup


def rate(part: Column, whole: Column) -> Column:
    """``part / whole``, 0 for an empty whole."""
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


def wilson(hits: Column, n: Column, z: float = 1.96) -> Column:
    """A struct of ``low`` and ``high``, the score interval of a share; both 0 for no trials."""
    h, m = hits.cast("double"), n.cast("double")
    p = h / m
    z2 = F.lit(z * z)
    middle, width, scale = p + z2 / (2 * m), F.lit(z) * F.sqrt(p * (1 - p) / m + z2 / (4 * m * m)), 1 + z2 / m
    low = F.when(m > 0, F.greatest(F.lit(0.0), (middle - width) / scale)).otherwise(0.0)
    high = F.when(m > 0, F.least(F.lit(1.0), (middle + width) / scale)).otherwise(0.0)
    return F.struct(low.alias("low"), high.alias("high"))


def upper_median(c: Column) -> Column:
    """An aggregate: the middle value, of two middle ones the larger."""
    return F.element_at(F.sort_array(F.collect_list(c)), (F.floor(F.count(c) / 2) + 1).cast("int"))


def correlation(x: Column, y: Column) -> Column:
    """An aggregate: Pearson's correlation of pairs without nulls, null without variance."""
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, x.cast("double")), F.when(both, y.cast("double"))
    n = F.count(F.when(both, 1)).cast("double")
    sx, sy, sxx, syy, sxy = F.sum(a), F.sum(b), F.sum(a * a), F.sum(b * b), F.sum(a * b)
    return F.try_divide(n * sxy - sx * sy, F.sqrt(F.greatest((n * sxx - sx * sx) * (n * syy - sy * sy), F.lit(0.0))))


def average_rank(df: DataFrame, value: str, out: str) -> DataFrame:
    """Ranks from 1, equal values share the mean of theirs; null for null. Values are counted, cut into blocks and added up within their block; a value that many rows have is joined by broadcast."""
    values = df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count(F.lit(1)).alias("__n"))
    values = values.withColumn("__block", block_of(values, F.col(value)))
    ahead = lambda *by: Window.partitionBy(*by[:-1]).orderBy(by[-1]).rowsBetween(Window.unboundedPreceding, -1)
    totals = values.groupBy("__block").agg(F.sum("__n").alias("__t")).select("__block", F.coalesce(F.sum("__t").over(ahead("__block")), F.lit(0)).alias("__b"))  # a row per block
    inside = F.coalesce(F.sum("__n").over(ahead("__block", value)), F.lit(0))
    ranks = values.join(F.broadcast(totals), "__block").select(value, (F.col("__b") + inside + (F.col("__n") + 1) / 2.0).alias(out))
    return lookup(df, ranks, value)


def spearman(df: DataFrame, x: str, y: str, least: int = 4) -> DataFrame:
    """``cells, rho``: the rank correlation with shared ranks; null under ``least`` rows, 0 without variance."""
    usable = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(x, y)
    ranked = average_rank(average_rank(usable, x, "__rx"), y, "__ry")
    rho = F.coalesce(correlation(F.col("__rx"), F.col("__ry")), F.lit(0.0))
    return ranked.agg(F.count(F.lit(1)).alias("cells"), F.when(F.count(F.lit(1)) >= least, rho).alias("rho"))


def perplexity(loss: Column) -> Column:
    """``exp`` of the loss, of 30 at most; null stays null."""
    return F.when(loss.isNotNull(), F.exp(F.least(loss, F.lit(30.0))))


def weighted_mean(value: Column, weight: Column) -> Column:
    """An aggregate: the mean of values, each with its weight; rows of weight 0 don't count."""
    on = weight > 0
    return F.try_divide(F.sum(F.when(on, value * weight)), F.sum(F.when(on, weight)).cast("double"))


def vector_norm(v: Column) -> Column:
    """The Euclidean norm of an array."""
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))


def scored_tokens(labels: Column) -> Column:
    """Labels other than -100 after the first place, which predicts nothing."""
    return F.size(F.filter(F.slice(labels, 2, F.greatest(F.size(labels) - 1, F.lit(0))), lambda x: x != -100))


def warm_cosine(step: Column, total: int, warmup: int, peak: float, floor: float = 0.0) -> Column:
    """A learning rate: rises in a line to ``peak``, falls along half a cosine to ``floor``, stays there."""
    done = F.least(F.lit(1.0), (step - warmup) / F.lit(float(max(1, total - warmup))))
    fall = F.lit(floor) + F.lit((peak - floor) / 2) * (1 + F.cos(F.lit(math.pi) * done))
    return F.when(step < warmup, F.lit(peak) * (step + 1) / F.lit(float(max(1, warmup)))).otherwise(fall)


#: Dense BF16 peak of devices in TFLOPS; the first name that stands in a device's name, in capitals, counts. Fixed values.
PEAKS = (("RTX PRO 6000", 500.0), ("H100 SXM", 989.0), ("H100 NVL", 989.0), ("H100", 756.0), ("A100", 312.0), ("RTX 6000 ADA", 182.0), ("L40", 181.0), ("L4", 121.0), ("V100", 125.0), ("A10", 125.0), ("T4", 65.0))
DEFAULT_PEAK = 989.0


def peak_tflops(device: Column) -> Column:
    """The peak of a device by its name; that of the usual one if it isn't known."""
    name = F.regexp_replace(F.upper(device), "[_ -]+", " ")
    h100 = name.contains("H100") & (name.contains("SXM") | name.contains("NVL"))
    blackwell = name.contains("RTX 6000") & name.contains("BLACKWELL")
    ada = name.contains("RTX 6000") & name.contains("ADA")
    first = F.when(blackwell, PEAKS[0][1]).when(h100, PEAKS[1][1]).when(ada, 182.0)
    return F.coalesce(first, *[F.when(name.contains(n), F.lit(v)) for n, v in PEAKS], F.lit(DEFAULT_PEAK))


def mfu(tokens_per_second: Column, parameters: Column, peak_tflops: Column) -> Column:
    """Percent of a device's peak that training at a speed uses: six operations for each parameter and token."""
    return F.try_divide(tokens_per_second * parameters * 6 / F.lit(1e12) * 100, peak_tflops)
