"""Splits that keep related records together (problem 2)."""

from __future__ import annotations

from functools import cached_property

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.operators.components import connected_components
from millrace.operators.order import prefix_sum
from millrace.operators.skew import lookup
from millrace.workspace import materialise

#: Entities with more than 1 / HEAD of all records are placed one by one on the driver: fewer than HEAD of them.
HEAD = 5_000
#: Labels; what is wanted of each by every split is a table on the driver.
MAX_LABELS = 1_000


def entities(records: DataFrame, record_id: Column, ties: list[Column], label: Column) -> DataFrame:
    """``record_id, root, label``: records with the same root are tied by an equal key, directly or through others.

    The graph has the keys as nodes, joined where a record has two of them, so that a key's records are never listed. Rows of
    one id are one record with all their keys and the least of their labels; rows without an id are left out. A null key ties
    nothing; a record without keys is an entity of its own.
    """
    keys = F.array_compact(F.array(*[F.concat(F.lit(f"{i}:"), t) for i, t in enumerate(ties)]))
    rows = records.select(record_id.alias("record_id"), label.alias("label"), F.explode_outer(keys).alias("k")).where("record_id is not null")
    rows = rows.groupBy("record_id", "k").agg(F.min("label").alias("label"))
    own = Window.partitionBy("record_id")  # the different keys of one record
    rows = materialise(rows.select("record_id", "k", F.min("k").over(own).alias("node"), F.min("label").over(own).alias("label")), "records")
    roots = connected_components(rows.where("k != node").select(F.col("k").alias("a"), F.col("node").alias("b")))
    per = rows.where("k <=> node").select("record_id", "label", "node")  # one row for every record
    return lookup(per, roots, "node").select("record_id", F.coalesce("root", "node", F.concat(F.lit("="), F.col("record_id").cast("string"))).alias("root"), "label")


def place(sizes: np.ndarray, wanted: np.ndarray, tie: np.ndarray) -> np.ndarray:
    """The split of every entity. ``sizes``: entity x label, ``wanted``: split x label, changed to what is still wanted.

    Grouped iterative stratification: the label with the fewest records outstanding is taken, its entities one by one from the
    largest down go to the split that wants most of the label, ties to the split that wants most records.
    """
    out = np.full(len(sizes), -1)
    left = sizes.sum(axis=0)
    order = np.lexsort((tie, -sizes.sum(axis=1)))
    while True:
        open_labels = np.flatnonzero(left > 0)
        if not len(open_labels):
            break
        rare = open_labels[np.argmin(left[open_labels])]
        own = order[(out[order] < 0) & (sizes[order, rare] > 0)]
        for e in own[np.argsort(-sizes[own, rare], kind="stable")].tolist():
            v = sizes[e]
            need = wanted[:, rare]
            best = np.flatnonzero(need == need.max())
            s = best[np.argmax(wanted[best].sum(axis=1))] if len(best) > 1 else best[0]
            out[e] = s
            wanted[s] -= v
            left = left - v
    return out


def boundaries(wanted: np.ndarray, outstanding: float, carry: np.ndarray) -> np.ndarray:
    """Places along ``outstanding`` records of a label at which one split ends and the next begins, whole numbers. ``carry`` holds what rounding took from each boundary so far; it is changed."""
    w = np.maximum(wanted, 0)
    upto = np.cumsum(w) * (outstanding / w.sum() if w.sum() else 0)
    at = np.clip(np.floor(upto + carry + 0.5), 0, outstanding)
    at = np.maximum.accumulate(at)
    at[-1] = outstanding
    carry += upto - at
    return at


class Split:
    """Stages of a split, each computed when it is first asked for."""

    def __init__(self, records: DataFrame, names: list[str], part: np.ndarray, record_id: Column, ties: list[Column], label: Column):
        self._source, self._names, self._part = records, names, part
        self._of = (record_id, ties, F.coalesce(label, F.lit("")))

    @cached_property
    def _members(self) -> DataFrame:
        return materialise(entities(self._source, *self._of), "members")

    @cached_property
    def _counts(self) -> DataFrame:
        """``root, label, n, least``: combined before the shuffle, however large an entity is."""
        return materialise(self._members.groupBy("root", "label").agg(F.count(F.lit(1)).alias("n"), F.min("record_id").alias("least")), "counts")

    @cached_property
    def entities(self) -> DataFrame:
        """``record_id, entity_id, entity_size, label``: an entity's id is the least id of its records. Nothing is placed for it."""
        e = self._counts.groupBy("root").agg(F.min("least").alias("entity_id"), F.sum("n").alias("entity_size"))
        return lookup(self._members, e, "root", "inner").select("record_id", "entity_id", "entity_size", F.nullif("label", F.lit("")).alias("label"))

    @cached_property
    def _totals(self) -> dict[str, int]:
        totals = dict(self._counts.groupBy("label").agg(F.sum("n")).orderBy("label").limit(MAX_LABELS + 1).collect())
        if len(totals) > MAX_LABELS:
            raise ValueError(f"more than {MAX_LABELS} labels")
        return totals

    @cached_property
    def _placed(self) -> DataFrame:
        """``root, entity_id, entity_size, split_name``."""
        labels = list(self._totals)
        total = np.array(list(self._totals.values()), float)
        spark, wanted, n = self._source.sparkSession, self._part[:, None] * total[None, :], int(total.sum())
        by_label = F.map_from_entries(F.collect_list(F.struct("label", "n")))
        entity = self._counts.groupBy("root").agg(F.min("least").alias("entity_id"), F.sum("n").alias("entity_size"), by_label.alias("m"))
        vector = F.array(*[F.coalesce(F.try_element_at("m", F.lit(x)), F.lit(0).cast("bigint")) for x in labels]) if labels else F.array().cast("array<bigint>")
        entity = materialise(entity.select("root", "entity_id", "entity_size", vector.alias("vector")), "entities")
        limit = max(n // HEAD, 1)
        head = entity.where(F.col("entity_size") > limit).orderBy(F.desc("entity_size"), "entity_id").toPandas()
        placed = entity.select("root", "entity_id", "entity_size", F.lit("").alias("split_name")).where("false")
        left = total.copy()
        if len(head):
            v = np.array(head["vector"].tolist(), float)
            at = place(v, wanted, np.arange(len(head)))
            left -= v.sum(axis=0)
            placed = spark.createDataFrame([(r, i, z, self._names[s]) for r, i, z, s in zip(head["root"].tolist(), head["entity_id"].tolist(), head["entity_size"].tolist(), at)], placed.schema)
        rarest = np.argsort(left, kind="stable").tolist()
        primary = F.get(F.filter(F.array(*[F.lit(i) for i in rarest]), lambda i: F.get("vector", i) > 0), F.lit(0)) if labels else F.lit(0)
        tail = entity.where(F.col("entity_size") <= limit).withColumn("primary", primary).withColumn("own", F.get("vector", F.col("primary")))
        tail = tail.withColumn("h", F.shiftrightunsigned(F.xxhash64("entity_id", F.lit(11)), 1))
        tail = materialise(prefix_sum(tail, ["primary"], "h", F.col("own"), "before", block=1 << 47).drop("h"), "tail")
        groups = {r["primary"]: r for r in tail.groupBy("primary").agg(F.sum("own").alias("own"), F.sum("entity_size").alias("all")).collect()}
        carry, cuts = np.zeros(len(self._names)), []
        middle = F.col("before") + F.col("own") / 2
        side = lambda at: F.size(F.filter(at, lambda x: x < middle))
        for i in rarest:
            g = groups.get(i)
            if g is None:
                continue
            at = boundaries(wanted[:, i], float(g["own"]), carry)
            cuts.append((i, at.tolist()))
            if g["all"] > g["own"]:  # its entities have other labels too, which count for the labels that come later
                sums = tail.where(F.col("primary") == i).select(side(F.array(*[F.lit(x) for x in at.tolist()])).alias("s"), F.posexplode("vector").alias("at", "n"))
                for r in sums.groupBy("s", "at").agg(F.sum("n").alias("n")).collect():
                    wanted[r["s"], r["at"]] -= r["n"]
        bounds = spark.createDataFrame(cuts, "primary int, cuts array<double>")  # a row per label
        rest = tail.join(F.broadcast(bounds), "primary").withColumn("split_name", F.get(F.array(*[F.lit(x) for x in self._names]), side(F.col("cuts"))))
        return materialise(placed.unionByName(rest.select(placed.columns)), "placed")

    @cached_property
    def records(self) -> DataFrame:
        """``record_id, entity_id, entity_size, label, split_name``."""
        return lookup(self._members, self._placed, "root", "inner").select("record_id", "entity_id", "entity_size", F.nullif("label", F.lit("")).alias("label"), "split_name")

    @cached_property
    def report(self) -> DataFrame:
        """``split_name, label, wanted, records, share``."""
        spark, labels = self._source.sparkSession, list(self._totals)
        ask = spark.createDataFrame([(s, x, float(self._part[i]), self._totals[x]) for i, s in enumerate(self._names) for x in labels], "split_name string, label string, wanted double, n bigint")
        got = lookup(self._counts, self._placed.select("root", "split_name"), "root", "inner").groupBy("split_name", "label").agg(F.sum("n").alias("records"))
        report = ask.join(got, ["split_name", "label"], "left").fillna({"records": 0})
        return report.select("split_name", F.nullif("label", F.lit("")).alias("label"), "wanted", "records", (F.col("records") / F.col("n")).alias("share"))


def split_records(records: DataFrame, splits: DataFrame, record_id: Column, ties: list[Column], label: Column) -> Split:
    """Every record in one of the splits (``split_name, fraction``), records tied by a key in the same, labels spread evenly.

    Entities are found by contraction of the graph of keys; labels are counted per entity before anything is gathered. Grouped
    iterative stratification at every size: the fewer than 5,000 entities with more than 1/5,000 of all records are placed one by
    one, those of the rarest outstanding label first, into the split that wants it most. Of the others, which are small, the
    labels are gone through from the rarest outstanding on: a label's entities lie in the order of a hash, one after the other by
    their number of its records, and go to the splits in stretches as long as each still wants of it. Stretches end at whole
    records, what rounding takes from one label goes to the next; other labels that a stretch brings are summed up and count for
    the labels that follow. So every label ends within an entity of what each split wants, whatever the table's size, and no
    task sees more than a block of the order. The same input gives the same splits.

    Rows without an id are left out, null labels are a label, repeated rows of an id are one record; an empty table gives an
    empty result. Fractions are taken relative to their sum. More than 1,000 labels are an error.
    """
    of = [(r[0], float(r[1])) for r in splits.where("split_name is not null and fraction > 0").select("split_name", "fraction").orderBy("split_name").collect()]
    if not of:
        raise ValueError("no split has a positive fraction")
    part = np.array([f for _, f in of])
    return Split(records, [n for n, _ in of], part / part.sum(), record_id, ties, label)
