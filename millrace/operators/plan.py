"""Plans of requests: how many of each category, domain and subtype, which tools each is offered, in pairs where a category is paired."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def check_shares(shares: dict[str, float], known: Iterable[str]) -> None:
    """An error unless all keys are known and the shares, none negative, add up to 1."""
    known = set(known)
    if unknown := sorted(set(shares) - known):
        raise ValueError(f"unknown categories: {', '.join(unknown)}; known are {', '.join(sorted(known))}")
    if bad := sorted(k for k, v in shares.items() if v is None or v < 0):
        raise ValueError(f"shares must not be negative: {', '.join(bad)}")
    if abs(sum(shares.values()) - 1) > 1e-6:
        raise ValueError(f"shares add up to {sum(shares.values())}, not to 1")


def unpaired(specs: DataFrame, cap: int | None = None) -> DataFrame:
    """``category, i, id, domain, subtype`` from ``category, planned, domains, subtypes``: cells are gone through in turn.

    Request ``i`` has domain ``i mod domains`` and subtype ``i div domains mod subtypes``; with ``cap`` a cell keeps its first
    so many requests, so a capped plan is a part of the plan without a cap, whose numbers and draws it keeps. A category
    without domains or subtypes has null there; a null or negative count plans nothing.
    """
    s = specs.where("planned > 0").withColumn("i", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("planned").cast("bigint") - 1)))
    nd, ns = (F.greatest(F.coalesce(F.size(c), F.lit(0)), F.lit(1)).cast("bigint") for c in ("domains", "subtypes"))
    domain, subtype = F.get("domains", (F.col("i") % nd).cast("int")), F.get("subtypes", (F.floor(F.col("i") / nd) % ns).cast("int"))
    if cap is not None:
        s = s.where(F.floor(F.col("i") / (nd * ns)) < cap)
    return s.select("category", "i", F.format_string("%s-%09d", "category", "i").alias("id"), domain.alias("domain"), subtype.alias("subtype"))


def paired(specs: DataFrame, most: int | None = None) -> DataFrame:
    """``category, pair_id, branch, id, subtype``: two rows for each pair, of an even number of requests, at most ``most`` pairs; subtypes are gone through in turn."""
    n = F.floor(F.col("planned") / 2)
    n = n if most is None else F.least(n, F.lit(most))
    s = specs.where("planned is not null").withColumn("n", n).where("n > 0").withColumn("p", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1)))
    subtype = F.get("subtypes", (F.col("p") % F.greatest(F.size("subtypes"), F.lit(1))).cast("int"))
    s = s.select("category", F.format_string("pair-%09d", "p").alias("pair_id"), subtype.alias("subtype"), F.explode(F.array(F.lit("a"), F.lit("b"))).alias("branch"))
    return s.select("category", "pair_id", "branch", F.concat("pair_id", F.lit("-"), "branch").alias("id"), "subtype")


def sampled_tools(pool: Column, key: Column, n: Column, include: Column | None = None, exclude: Column | None = None) -> Column:
    """``n`` names of a pool in an order that depends on ``key`` alone, those of ``include`` always among them, none of ``exclude``."""
    none = F.array().cast("array<string>")
    must = F.coalesce(include, none) if include is not None else none
    rest = F.array_except(F.array_except(pool, must), F.coalesce(exclude, none) if exclude is not None else none)
    drawn = F.transform(F.array_sort(F.transform(rest, lambda t: F.struct(F.xxhash64(t, key).alias("h"), t.alias("t")))), lambda x: x["t"])
    return F.array_sort(F.concat(must, F.slice(drawn, F.lit(1), F.greatest(n - F.size(must), F.lit(0)))))


def capacity(trials: DataFrame, by: str, fingerprint: Column, most: float = 0.5) -> DataFrame:
    """``by, trials, distinct, saturated``: how many different documents trials of a specification gave; it is saturated if they are fewer than ``most`` of the trials, so that more trials give little."""
    g = trials.groupBy(by).agg(F.count(F.lit(1)).alias("trials"), F.count_distinct(fingerprint).alias("distinct"))
    return g.withColumn("saturated", F.col("distinct") < F.col("trials") * most)


def histogram(requests: DataFrame, category: str, subtype: str) -> DataFrame:
    """``category, subtype, n, share``: of every subtype, of every category (subtype null) and of all (both null); ``level`` 0, 1 and 2."""
    g = requests.rollup(category, subtype).agg(F.count(F.lit(1)).alias("n"), (F.grouping(category) + F.grouping(subtype)).alias("level"))
    total = requests.agg(F.count(F.lit(1)).alias("total"))
    return g.crossJoin(F.broadcast(total)).select(category, subtype, F.col("level").cast("int").alias("level"), "n", F.try_divide(F.col("n").cast("double"), F.col("total")).alias("share"))  # one row
