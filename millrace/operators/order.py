"""Operators on ordered rows: prefix sums, ranks, caps, shares of a sequence.

A window function over a whole table, or over a key that holds much of it, is one task. ``prefix_sum`` and ``hash_rank`` cut
the order into blocks instead: block totals are summed first, a small table, and rows only within their block.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType


def _named(columns: list[str] | None) -> list[str]:
    return list(columns or [])


def prefix_sum(df: DataFrame, by: list[str] | None, order: str, value: Column, out: str, block: int = 65_536) -> DataFrame:
    """``out``: the sum of ``value`` over the rows of the same ``by`` with a smaller ``order``, a whole number.

    Rows with equal ``order`` are taken in the order of all their columns' hash. Blocks are ``order div block``, so ``order``
    should not be much sparser than rows are. Null values count 0; a null order comes first.
    """
    keys = _named(by)
    d = df.withColumn("__v", F.coalesce(value.cast("bigint"), F.lit(0))).withColumn("__block", F.coalesce(F.floor(F.col(order) / block), F.lit(-(2**62))))
    totals = d.groupBy(*keys, "__block").agg(F.sum("__v").alias("__t"))
    w = Window.partitionBy(*keys).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.withColumn("__before", F.coalesce(F.sum("__t").over(w), F.lit(0))).drop("__t")
    joined = d.join(totals.select(*[F.col(k).alias(f"__t_{k}") for k in keys], F.col("__block").alias("__t_block"), "__before"), _equal(keys))
    inside = Window.partitionBy(*keys, "__block").orderBy(F.col(order).asc_nulls_first(), F.xxhash64(*df.columns)).rowsBetween(Window.unboundedPreceding, -1)
    done = joined.withColumn(out, F.col("__before") + F.coalesce(F.sum("__v").over(inside), F.lit(0)))
    return done.select(*df.columns, out)


def _equal(keys: list[str]) -> Column:
    c = F.col("__block") == F.col("__t_block")
    for k in keys:
        c = c & F.col(k).eqNullSafe(F.col(f"__t_{k}"))
    return c


#: Rows in one block of an order, about, and blocks at most.
BLOCK_ROWS, MOST_BLOCKS = 65_536, 1_000
#: A run is long from this part of all rows on; so there are fewer long runs.
LONG_PARTS = 200


def block_of(df: DataFrame, order: Column, rows: int | None = None) -> Column:
    """A number for each of the stretches into which the values of ``order`` are cut, about ``rows`` rows in each, equal values together; null for null.

    The cuts are approximate quantiles, at most MOST_BLOCKS numbers; they only decide which task does what.
    """
    x = order.cast("double")
    n = min(MOST_BLOCKS, df.count() // (rows or BLOCK_ROWS))
    if n < 2:
        return F.when(order.isNotNull(), F.lit(0))
    cuts = df.agg(F.percentile_approx(x, [i / n for i in range(1, n)], F.lit(10_000))).first()[0] or []
    below = F.array(*[F.lit(c) for c in sorted(set(cuts))])
    return F.when(order.isNotNull(), F.size(F.filter(below, lambda c: c < x)))


def hash_rank(df: DataFrame, key: list[Column], out: str, by: list[str] | None = None, seed: int = 0) -> DataFrame:
    """``out``: 0, 1, ... in the order of a hash of ``key``: a shuffle that is the same however the rows are partitioned."""
    h = df.withColumn("__h", F.shiftrightunsigned(F.xxhash64(*key, F.lit(seed)), 1))
    return prefix_sum(h, by, "__h", F.lit(1), out, block=1 << 47).drop("__h")


def token_budget(df: DataFrame, source: str, order: str, tokens: Column, budget: Column, block: int = 65_536) -> DataFrame:
    """Each source's rows in order until its budget is full: ``taken`` tokens of each row, the last one cut to fit exactly.

    ``budget`` is a column of ``df``. Rows after the budget are left out, so are those without tokens.
    """
    d = df.withColumn("__n", F.coalesce(tokens.cast("bigint"), F.lit(0)))
    d = prefix_sum(d, [source], order, F.col("__n"), "before", block).where((F.col("before") < budget) & (F.col("__n") > 0))
    return d.withColumn("taken", F.least(F.col("__n"), budget - F.col("before"))).drop("__n")


def window_cut(df: DataFrame, by: list[str], order: str, tokens: Column, size: int, block: int = 65_536) -> DataFrame:
    """Which tokens of each row lie in which window of ``size`` tokens of its sequence: ``window_id, start_in_row, taken``. The last, partial window of a sequence is kept; ``full`` says which are."""
    d = df.withColumn("__n", F.coalesce(tokens.cast("bigint"), F.lit(0)))
    return cut_at(prefix_sum(d, by, order, F.col("__n"), "__at", block), size)


def window_count(df: DataFrame, by: list[str], tokens: Column, size: int) -> DataFrame:
    """``by, windows``: whole windows of ``size`` tokens in every sequence; null lengths count 0."""
    return df.groupBy(*by).agg(F.floor(F.coalesce(F.sum(tokens), F.lit(0)) / size).alias("windows"))


def cut_at(d: DataFrame, size: int) -> DataFrame:
    """The cut of ``window_cut`` for rows whose place ``__at`` in their sequence and length ``__n`` are known."""
    d = d.where("__n > 0").withColumn("window_id", F.explode(F.sequence(F.floor(F.col("__at") / size), F.floor((F.col("__at") + F.col("__n") - 1) / size))))
    lo = F.greatest(F.col("__at"), F.col("window_id") * size)
    hi = F.least(F.col("__at") + F.col("__n"), (F.col("window_id") + 1) * size)
    return d.withColumn("start_in_row", lo - F.col("__at")).withColumn("taken", hi - lo).drop("__n", "__at")


def cap_per_cell(df: DataFrame, cell: list[str], order: list, cap: Column, most: int | None = None) -> DataFrame:
    """The first ``cap`` rows of every cell, an exact subsequence of the rows. With ``most``, a number no cap is above, Spark cuts cells to it before it shuffles them."""
    d = df.withColumn("__r", F.row_number().over(Window.partitionBy(*cell).orderBy(*order)))
    return (d if most is None else d.where(F.col("__r") <= most)).where(F.col("__r") <= cap).drop("__r")


def first_n(df: DataFrame, by: list[str], order: list, n: int) -> DataFrame:
    """The first ``n`` rows of every group; Spark cuts groups to ``n`` rows before it shuffles them."""
    return df.withColumn("__r", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("__r") <= n).drop("__r")


def spread(df: DataFrame, category: str, order: str, n: int) -> DataFrame:
    """``n`` rows taken from the categories in turn, in the order in which categories and their rows first come."""
    first = df.groupBy(category).agg(F.min(order).alias("__first"))
    few = first_n(df, [category], [order], n)
    ranked = few.withColumn("__r", F.row_number().over(Window.partitionBy(category).orderBy(order)))
    return ranked.join(first, category).orderBy("__r", "__first").limit(n).drop("__r", "__first")


def round_robin(df: DataFrame, number: str, outer: int, inner: int, names: tuple[str, str] = ("outer_no", "inner_no")) -> DataFrame:
    """Item ``i`` goes to ``i mod outer`` and, within that, to ``(i div outer) mod inner``."""
    i = F.col(number)
    return df.withColumn(names[0], F.pmod(i, F.lit(outer))).withColumn(names[1], F.pmod(F.floor(i / outer), F.lit(inner)))


def balanced_halves(df: DataFrame, flag: str, order: list, n: int) -> DataFrame:
    """The first ``n div 2`` rows with the flag and as many without."""
    return first_n(df.where(F.col(flag).isNotNull()), [flag], order, n // 2)


def running_distinct(df: DataFrame, key: list[str], order: str, out: str = "distinct_so_far", block: int = 65_536) -> DataFrame:
    """At every row the number of distinct keys up to it."""
    first = df.groupBy(*key).agg(F.min(order).alias("__first"))
    d = df.join(first, key).withColumn("__new", (F.col(order) == F.col("__first")).cast("int"))
    d = prefix_sum(d, None, order, F.col("__new"), out, block)
    return d.withColumn(out, F.col(out) + F.col("__new")).drop("__first", "__new")


def group_prefix(groups: DataFrame, size: str, target: Column, key: str, seed: int = 0, order: Column | None = None) -> DataFrame:
    """Whole groups in a hash order until ``target`` rows are reached; the last may go beyond. ``groups`` has one row per group."""
    if order is None:
        order = F.shiftrightunsigned(F.xxhash64(F.col(key), F.lit(seed)), 1)
    d = prefix_sum(groups.withColumn("__h", order), None, "__h", F.col(size), "__before", block=1 << 47)
    return d.withColumn("taken", F.col("__before") < target).drop("__h", "__before")


def ema(df: DataFrame, run: str, order: str, value: str, alpha: float = 0.05, out: str = "ema", rows: int | None = None) -> DataFrame:
    """An exponential moving average along each run, seeded with its first value: ``run, order, value, ema``.

    Spark sorts the runs; a task goes through its sorted rows once, run after run, in Arrow batches. Only a run with more than
    ``rows`` rows (BLOCK_ROWS) and 1/LONG_PARTS of all is cut into blocks of its order: a block is first averaged as if nothing
    came before, what comes before adds the last average of the blocks before, fading with every row, and from there on the
    block is averaged again. So a long run is many tasks' work, and only its blocks, one row each, come together. Rows without
    a value are left out, null orders come last, equal orders are taken by value, a null run is a run.
    """
    d = df.where(F.col(value).isNotNull()).select(run, order, F.col(value).cast("double").alias(value))
    after, n = F.lit(None).cast("double"), d.count()
    limit = max(rows or BLOCK_ROWS, n // LONG_PARTS)
    long = [r[0] for r in d.groupBy(run).count().where(F.col("count") > limit).select(run).collect()] if n > limit else []
    d = d.withColumn("__block", F.lit(0))
    if long:
        is_long = F.coalesce(F.col(run).isin([r for r in long if r is not None]) | (F.col(run).isNull() & F.lit(None in long)), F.lit(False))
        d = d.withColumn("__block", F.when(is_long, F.coalesce(block_of(d.where(is_long), F.col(order), rows), F.lit(MOST_BLOCKS))).otherwise(0))
        starts = _block_starts(d.where(is_long), run, order, value, alpha).select(F.col(run).alias("__run"), F.col("__block").alias("__b"), "__start")
        d = d.join(F.broadcast(starts), F.col(run).eqNullSafe(F.col("__run")) & (F.col("__block") == F.col("__b")), "left")  # fewer than LONG_PARTS runs, a row per block
        after = F.col("__start")
    return _averaged(d, run, order, value, after, alpha, out).select(run, order, value, out)


def _averaged(d: DataFrame, run: str, order: str, value: str, after: Column, alpha: float, out: str) -> DataFrame:
    """``out`` for the rows of each run and ``__block``, with their place ``__at``; ``after`` is the average before the block, null where the run begins."""
    w = Window.partitionBy(run, "__block").orderBy(F.col(order).asc_nulls_last(), value)
    d = d.select(run, order, value, "__block", F.row_number().over(w).alias("__at"), after.alias("__after"))  # the window leaves its rows sorted

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for b in batches:
            averages, before = [], b.column(5)
            for i, (v, at) in enumerate(zip(*(b.column(k).to_numpy().tolist() for k in (2, 4)))):
                if at == 1:
                    last = before[i].as_py()
                last = v if last is None else last + alpha * (v - last)
                averages.append(last)
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(averages, pa.float64())], [*b.schema.names[:5], out])

    return d.mapInArrow(fold, StructType([*d.schema.fields[:5], StructField(out, DoubleType())]))


def _block_starts(d: DataFrame, run: str, order: str, value: str, alpha: float) -> DataFrame:
    """``run, __block, __start``: the average before each ``__block`` of the runs, null for a run's first."""
    own = _averaged(d, run, order, value, F.lit(0.0), alpha, "__own")
    ends = own.groupBy(run, "__block").agg(F.max_by("__own", "__at").alias("__own"), F.max("__at").alias("__n"), F.min_by(value, "__at").alias("__first"))
    ends = ends.withColumn("__at", F.row_number().over(Window.partitionBy(run).orderBy("__block")))  # a row per block

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = None
        for b in batches:
            starts = []
            for own, n, first, at in zip(*(b.column(i).to_pylist() for i in range(2, 6))):
                starts.append(None if at == 1 else before)
                before = first if at == 1 else before
                before = own + (1 - alpha) ** n * before if math.isfinite(before) else math.nan
            yield pa.RecordBatch.from_arrays([*b.columns[:2], pa.array(starts, pa.float64())], [*b.schema.names[:2], "__start"])

    return ends.mapInArrow(chain, StructType([*ends.schema.fields[:2], StructField("__start", DoubleType())]))


def rebalance(df: DataFrame, cell: list[str], key: Column, cap: int, exempt: Column, seed: int = 0) -> DataFrame:
    """At most ``cap`` rows of each cell, chosen by a hash of their key; exempt rows all stay."""
    rest = first_n(df.where(~exempt).withColumn("__h", F.xxhash64(key, F.lit(seed))), cell, ["__h"], cap).drop("__h")
    return df.where(exempt).unionByName(rest)


def sample_groups(df: DataFrame, cell: list[str], group: str, least: int, seed: int = 0) -> DataFrame:
    """Of every cell whole groups in a hash order until ``least`` rows are there; the last may go beyond."""
    sizes = df.groupBy(*cell, group).agg(F.count(F.lit(1)).alias("__n")).withColumn("__h", F.shiftrightunsigned(F.xxhash64(F.col(group), F.lit(seed)), 1))
    taken = prefix_sum(sizes, cell, "__h", F.col("__n"), "__before", block=1 << 47).where(F.col("__before") < least).select(*cell, group)
    return df.join(taken, [*cell, group], "left_semi")


def first_to_last(df: DataFrame, by: list[str], order: str, value: str) -> DataFrame:
    """``first, last, delta`` of a value along an order."""
    g = df.where(F.col(value).isNotNull()).groupBy(*by).agg(F.min_by(value, order).alias("first"), F.max_by(value, order).alias("last"))
    return g.withColumn("delta", F.col("last") - F.col("first"))


def smallest_reaching(curve: DataFrame, at: str, reached: str, fraction: float) -> DataFrame:
    """The smallest ``at`` of a growing curve at which ``fraction`` of its end is reached."""
    end = F.max(reached).over(Window.partitionBy())  # one row per point of the curve
    return curve.withColumn("__end", end).where(F.col(reached) >= F.col("__end") * fraction).agg(F.min(at).alias(at), F.max("__end").alias("most"))
