"""Counterfactual pairs: two branches that are kept, judged and counted together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.jsonx import diff_paths


def pivot_pairs(rows: DataFrame, pair: str, branch: str, order: str, fields: list[str]) -> DataFrame:
    """``pair, a, b``: structs of ``fields`` of the branches; of repeated branches the last one counts. A missing branch is null."""
    whole = F.struct(*fields)
    last = {x: F.max_by(whole, F.when(F.col(branch) == x, F.col(order))) for x in "ab"}
    there = {x: F.count_if(F.col(branch) == x) > 0 for x in "ab"}
    return rows.where(F.col(pair).isNotNull()).groupBy(pair).agg(*[F.when(there[x], last[x]).alias(x) for x in "ab"])


def integrity(rows: DataFrame, pair: str, branch: str) -> DataFrame:
    """``pair, branches``: the pairs whose branches are not just a and b."""
    g = rows.where(F.col(pair).isNotNull()).groupBy(pair).agg(F.array_sort(F.collect_set(branch)).alias("branches"))
    return g.where(F.col("branches") != F.array(F.lit("a"), F.lit("b")))


#: Faults of a whole pair, in the order in which they are looked for. Fixed values.
PAIR_FAULTS = ("swap_memory_diverged", "swap_state_diverged", "swap_request_diverged")


def swap_checks() -> list[tuple[Column, str]]:
    """Checks for ``pair_faults`` on branches with ``memory, state, request``: memory and request must be the same text, the states must differ at one place and no other."""
    same = lambda field: F.col(f"a.{field}").eqNullSafe(F.col(f"b.{field}"))
    one = F.size(diff_paths(F.col("a.state"), F.col("b.state"))) == 1
    return list(zip((~same("memory"), ~one, ~same("request")), PAIR_FAULTS))


def pair_faults(pairs: DataFrame, checks: list[tuple[Column, str]], branch_fault: dict[str, Column]) -> DataFrame:
    """``pairs`` with ``fault_a`` and ``fault_b``: a fault of the pair is both branches', a branch's own drops its innocent partner too."""
    missing = F.when(F.col("a").isNull() | F.col("b").isNull(), "missing_branch")
    whole = F.coalesce(missing, *[F.when(F.coalesce(c, F.lit(True)), F.lit(n)) for c, n in checks])
    own = {x: F.when(whole.isNull(), branch_fault[x]) for x in "ab"}
    partner = {x: F.when(own["b" if x == "a" else "a"].isNotNull(), "partner_failed") for x in "ab"}
    return pairs.withColumns({f"fault_{x}": F.coalesce(whole, own[x], partner[x]) for x in "ab"})


def outcomes(graded: DataFrame, group: str, by: list[str] | None = None) -> DataFrame:
    """``pairs, dropped_incomplete, both, one, neither, grounded_rate`` over groups of exactly two rows."""
    keys = by or []
    g = graded.where(F.col(group).isNotNull()).groupBy(*keys, group).agg(F.count(F.lit(1)).alias("n"), F.count_if("correct").alias("c"))
    two = F.col("n") == 2
    out = g.groupBy(*keys).agg(F.count_if(two).alias("pairs"), F.count_if(~two).alias("dropped_incomplete"), *[F.count_if(two & (F.col("c") == k)).alias(name) for name, k in (("both", 2), ("one", 1), ("neither", 0))])
    return out.withColumn("grounded_rate", F.coalesce(F.try_divide(F.col("both").cast("double"), F.col("pairs").cast("double")), F.lit(0.0)))


def branch_bias(graded: DataFrame, group: str, branch: str) -> DataFrame:
    """``branch, wins, skew`` over pairs of which just one is correct; ``skew`` is the larger branch's share."""
    pair = graded.where(F.col(group).isNotNull()).groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.count_if("correct").alias("c"), F.max(F.when(F.col("correct"), F.col(branch))).alias("winner"))
    wins = pair.where("n = 2 and c = 1").groupBy(F.col("winner").alias("branch")).agg(F.count(F.lit(1)).alias("wins"))
    all_of = Window.partitionBy()  # one row per branch
    return wins.select("branch", "wins", (F.max("wins").over(all_of) / F.sum("wins").over(all_of)).alias("skew"))


def judged_outcomes(scores: DataFrame, group: str, score: str, good: int = 4) -> DataFrame:
    """``pairs, grounded, one_branch``: both scores are good, or only the better one."""
    g = scores.where(F.col(group).isNotNull() & F.col(score).isNotNull()).groupBy(group).agg(F.min(score).alias("lo"), F.max(score).alias("hi"), F.count(F.lit(1)).alias("n")).where("n = 2")
    return g.agg(F.count(F.lit(1)).alias("pairs"), F.count_if(F.col("lo") >= good).alias("grounded"), F.count_if((F.col("lo") < good) & (F.col("hi") >= good)).alias("one_branch"))
