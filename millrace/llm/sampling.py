"""A sample whose categories have target shares (problem 5)."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.words import mix
from millrace.workspace import materialise

#: Targets, and cells of the records that meet some target; both are small tables on the driver.
MAX_TARGETS, MAX_CELLS = 100_000, 100_000
_NEAR = 1e-9


def calibrate(moments: np.ndarray, member: np.ndarray, totals: np.ndarray, base: float, steps: int = 100) -> np.ndarray:
    """Probabilities ``base * exp(lambda . member)`` of cells, at most 1, for which constraints have their totals.

    ``moments``: records of each cell; ``member``: constraint x cell, which cells a constraint counts, any number of them may
    overlap; ``totals``: what they are to hold. The probabilities are those of exponential tilting: lambda is the minimum of the
    dual, the sum of ``moments * p`` less ``totals . lambda``, found by Newton steps with the Hessian ``member diag(moments * p)
    member'`` and halved while they don't lower it. Cells that come out above 1 are taken whole, what they hold is taken from
    the totals, and the others are calibrated anew, until none is. Constraints that can't hold are met as far as they can be; a cell that no
    constraint counts, or one with a total of 0, gets 0.
    """
    used = member[totals > 0].any(axis=0) & ~member[totals <= 0].any(axis=0) & (moments > 0)
    p = np.zeros(len(moments))
    whole = np.zeros(len(moments), bool)
    alone = (member[:, used].sum(axis=0) <= 1).all()  # no cell is counted twice, so the Hessian is diagonal
    while True:
        free = used & ~whole
        if not free.any():
            break
        a, n = member[:, free].astype(float), moments[free]
        goal = totals - (member[:, whole] * moments[whole]).sum(axis=1)
        on = (a.sum(axis=1) > 0) & (goal > 0)
        a, goal = a[on], goal[on]
        lam = np.zeros(len(goal))
        now = n * base * np.exp(lam @ a)
        value = now.sum() - goal @ lam
        for _ in range(steps):
            slope = a @ now - goal
            if alone:
                step = slope / np.maximum(a @ now, 1e-300)
            else:
                step = np.linalg.lstsq((a * now) @ a.T, slope, rcond=1e-12)[0]
            step = np.clip(step, -4, 4)
            size = 1.0
            while True:
                new = np.clip(lam - size * step, -60, 60)
                new_now = n * base * np.exp(np.clip(new @ a, -200, 200))
                new_value = new_now.sum() - goal @ new
                if new_value <= value + 1e-9 * abs(value) or size < 1e-4:
                    break
                size /= 2
            lam, now, value = new, new_now, new_value
            if np.abs(size * step).max(initial=0) < 1e-13:
                break
        p[free] = now / n
        over = free & (p > 1)
        if not over.any():
            break
        whole |= over
        p[whole] = 1.0
    return np.minimum(p, 1.0)


def _uniform(h: np.ndarray, salt: int) -> np.ndarray:
    return (mix(h.view(np.uint64) ^ np.uint64((salt * 0x9E3779B97F4A7C15 + 0x1234567) % 2**64)) >> np.uint64(11)).astype(np.float64) / 2.0**53


def duels(p: np.ndarray, group: np.ndarray, h: np.ndarray, salt: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The pivotal method within groups: places of what is drawn, places that stay open, one for each group at most, and their probability.

    In rounds, neighbours of a group meet in pairs; of two that have less than 1 together one gets it all, else one is drawn and
    the other keeps the rest, with chances that leave everyone's probability as it was. ``group`` is sorted.
    """
    at, drawn = np.flatnonzero(p > _NEAR), []
    while True:
        q = p[at]
        sure = q >= 1 - _NEAR
        drawn.append(at[sure])
        at = at[~sure & (q > _NEAR)]
        g = group[at]
        first = np.flatnonzero(np.diff(g, prepend=-1))
        number = np.arange(len(at)) - np.repeat(first, np.diff(np.append(first, len(at))))
        x = np.flatnonzero((number[:-1] % 2 == 0) & (g[:-1] == g[1:]))
        if not len(x):
            return np.concatenate(drawn), at, p[at]
        i, j = at[x], at[x + 1]
        salt += 1
        u = _uniform(h[i] ^ (h[j] << 1), salt)
        a, b = p[i], p[j]
        s = a + b
        stays = np.where(s < 1, u * s < a, u * (2 - s) < 1 - a)  # the first remains open
        opened, other = np.where(stays, i, j), np.where(stays, j, i)
        p[other] = np.where(s < 1, 0.0, 1.0)
        p[opened] = np.where(s < 1, s, s - 1)


_OUT = pa.schema([("plan_id", pa.string()), ("record_id", pa.string()), ("cell", pa.int32()), ("p", pa.float64())])
OUT = "plan_id string, record_id string, cell int, p double"


def _draw(names: list[str], weights: np.ndarray):
    """Draws for all plans from a task's records; what a plan's cell leaves open comes out with its probability."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = [(np.zeros(0, object), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)) for _ in names]

        def out(name, ids, cells, p):
            m = len(ids)
            return pa.RecordBatch.from_arrays([pa.array(np.full(m, name, object), pa.string()), pa.array(ids, pa.string()), pa.array(cells, pa.int32()), p], schema=_OUT)

        for number, b in enumerate(batches):
            ids, cell, h = np.array(b.column(0).to_pylist(), object), b.column(1).to_numpy().astype(np.int64), b.column(2).to_numpy()
            for k, name in enumerate(names):
                q = weights[k, cell]
                mine = np.flatnonzero(q > 0)
                i, c, g, p = (np.concatenate([x, y]) for x, y in zip(kept[k], (ids[mine], cell[mine], h[mine], q[mine])))
                order = np.argsort(c, kind="stable")
                i, c, g, p = i[order], c[order], g[order], p[order]
                drawn, left, rest = duels(p, c, g, 1000 * k + 50 * number)
                kept[k] = (i[left], c[left], g[left], rest)
                if len(drawn):
                    yield out(name, i[drawn], c[drawn], pa.nulls(len(drawn), pa.float64()))
        for name, (i, c, _, p) in zip(names, kept):
            if len(i):
                yield out(name, i, c, pa.array(p))

    return run


def _last(pdf: pd.DataFrame) -> pd.DataFrame:
    """The duels between the records that tasks left open, first in each cell, then of a plan's cells in their order, and the last one's lot."""
    pdf = pdf.sort_values(["cell", "record_id"]).reset_index(drop=True)
    cell, h, p = pdf["cell"].to_numpy(np.int64), pdf["h"].to_numpy(np.int64), pdf["p"].to_numpy(float).copy()
    drawn, left, rest = duels(p, cell, h, 7_000_000)
    more, last, rest = duels(rest.copy(), np.zeros(len(left), np.int64), h[left], 8_000_000)
    lot = last[_uniform(h[left[last]], 9_000_000) < rest]
    at = np.concatenate([drawn, left[more], left[lot]])
    return pdf.loc[at, ["plan_id", "record_id", "cell"]]


class Sample:
    """``report``: a row per plan and target with what was wanted and can be had. ``records``: plan_id, record_id and the cell's columns, drawn when asked for."""

    def __init__(self, full: DataFrame, report: DataFrame, cells: DataFrame, names: list[str], plans: list[str], weights: np.ndarray, seed: int):
        self.report, self._full, self._cells, self._names, self._plans, self._weights, self._seed = report, full, cells, names, plans, weights, seed

    @cached_property
    def records(self) -> DataFrame:
        cells = F.broadcast(self._cells)  # at most MAX_CELLS
        h = F.xxhash64("record_id", F.lit(self._seed))
        fed = self._full.join(cells, self._names).select("record_id", "cell", h.alias("h")).repartition("record_id").sortWithinPartitions("h", "record_id")
        drawn = materialise(fed.mapInArrow(_draw(self._plans, self._weights), OUT), "drawn")
        last = drawn.where("p is not null").withColumn("h", h).groupBy("plan_id").applyInPandas(_last, "plan_id string, record_id string, cell int")  # a row per task and cell
        return drawn.where("p is null").drop("p").unionByName(last).join(cells, "cell").select("plan_id", "record_id", *self._names)


def _records(records: DataFrame, record_id: Column, newest: Column, cell: dict[str, Column]) -> DataFrame:
    """Distinct records with the cell of their newest row, of equally new ones the greatest."""
    rows = records.select(record_id.cast("string").alias("record_id"), newest.alias("__at"), *[c.alias(n) for n, c in cell.items()]).where("record_id is not null")
    last = rows.groupBy("record_id").agg(F.max(F.struct("__at", *cell)).alias("__r"))
    return materialise(last.select("record_id", *[F.col("__r")[n].alias(n) for n in cell]), "records")


def _bounded(df: DataFrame, most: int, what: str) -> pd.DataFrame:
    got = df.limit(most + 1).toPandas()
    if len(got) > most:
        raise ValueError(f"more than {most} {what}")
    return got


def _frame(spark, got: pd.DataFrame, fields: str) -> DataFrame:
    order = [x.split()[0] for x in fields.split(", ")]
    clean = got[order].astype(object).where(got[order].notna(), None)
    return spark.createDataFrame([tuple(r) for r in clean.itertuples(index=False)], fields)


def sample_cells(records: DataFrame, targets: DataFrame, record_id: Column, cell: dict[str, Column], newest: Column, seed: int = 23) -> Sample:
    """For every plan of ``targets`` a sample of distinct records whose cells have the target shares and at least their floors.

    ``targets`` has ``plan_id, sample_fraction, target_share, min_rows`` and the columns of ``cell``. A plan draws
    ``sample_fraction`` of all distinct records; a cell is asked for the larger of ``min_rows`` and ``target_share`` of that. The
    records of every cell are counted in one distributed aggregation; ``calibrate`` gives every cell the probability that meets
    its total, at most 1: a cell that would need more is taken whole and reported as short, the others keep their totals. The
    pivotal method draws with these probabilities: each task leaves one open record for a plan and cell, and these meet in a
    last round of at most one record per task and cell, so a cell gets the floor or ceiling of its total and so does the plan. Lots are hashes of
    ids and tasks see their records in the order of a hash: a task that is run again draws the same.

    A record's cell is that of its newest row, of equally new ones the greatest. Rows without an id are left out; a record with
    a null in the cell is in no cell but counts in all; a target with a null in its cell is asked for and has no records. Plans
    with a null name, null shares and floors (taken as 0) and an empty table (nothing drawn, floors short) are allowed.
    """
    spark, names = records.sparkSession, list(cell)
    one = _records(records, record_id, newest, cell)
    total = one.count()
    full = one.where(" and ".join(f"`{n}` is not null" for n in names))
    have = full.groupBy(*names).agg(F.count(F.lit(1)).alias("available"))
    ask = targets.select("plan_id", F.coalesce("sample_fraction", F.lit(0.0)).alias("sample_fraction"), *names, F.coalesce("target_share", F.lit(0.0)).alias("target_share"), F.coalesce("min_rows", F.lit(0)).alias("min_rows"))
    got = _bounded(ask.join(have, names, "left").fillna({"available": 0}), MAX_TARGETS, "targets")
    got["wanted"] = np.maximum(got["min_rows"].to_numpy(float), got["target_share"].to_numpy(float) * got["sample_fraction"].to_numpy(float) * total)
    got["probability"] = 0.0
    keys = list(got[names].itertuples(index=False, name=None))
    number = {k: i for i, k in enumerate(sorted(dict.fromkeys(keys), key=repr))}
    got["cell"] = [number[k] for k in keys]
    plans, weights = [], []
    for plan, g in got.groupby("plan_id", sort=True):
        of = np.unique(g["cell"].to_numpy(), return_inverse=True)[1]
        n = np.zeros(of.max() + 1)
        n[of] = g["available"]
        wanted = np.zeros(len(n))
        np.maximum.at(wanted, of, g["wanted"].to_numpy(float))  # of repeated targets the largest
        p = calibrate(n, np.eye(len(n), dtype=bool), wanted, max(float(g["sample_fraction"].iloc[0]), 1e-6))[of]
        got.loc[g.index, "probability"] = p
        w = np.zeros(len(number))
        w[g["cell"]] = p
        plans.append(plan)
        weights.append(w)
    held = (got["probability"] >= 1) | (got["available"] == 0)  # nothing more to be drawn
    got["short"] = held & (got["available"] < got["wanted"]) | got["plan_id"].isna() & (got["available"] < got["wanted"])
    fields = "plan_id string, " + ", ".join(f"{n} string" for n in names) + ", target_share double, min_rows int, wanted double, available bigint, probability double, short boolean"
    cells = spark.createDataFrame([(*k, i) for k, i in number.items()], ", ".join(f"{n} string" for n in names) + ", cell int")
    return Sample(full, _frame(spark, got, fields), cells, names, plans, np.array(weights), seed)


def sample_margins(records: DataFrame, targets: DataFrame, record_id: Column, cell: dict[str, Column], newest: Column, seed: int = 29) -> Sample:
    """As ``sample_cells``, but targets are shares of single columns, which overlap: ``plan_id, sample_fraction, dimension, value, target_share, min_rows``.

    ``dimension`` names a column of ``cell``. The records are counted by cell, all columns together, in one aggregation; a plan's
    targets are constraints on sums over these cells, and ``calibrate`` finds the probabilities that meet them and are nearest to
    equal ones. ``report`` has ``wanted``, ``available``, ``expected``, what the probabilities give, and ``short`` where that is less
    than wanted by more than a thousandth of a record: targets of a plan may contradict each other or the records. A null value
    or an unknown dimension has no records. Records with a value for which a plan has no target in that dimension are not drawn for it. More than
    100,000 targets or cells are an error.
    """
    spark, names = records.sparkSession, list(cell)
    one = _records(records, record_id, newest, cell)
    total = one.count()
    full = one.where(" and ".join(f"`{n}` is not null" for n in names))
    cells = _bounded(full.groupBy(*names).agg(F.count(F.lit(1)).alias("n")).orderBy(*names), MAX_CELLS, "cells")
    ask = targets.select("plan_id", F.coalesce("sample_fraction", F.lit(0.0)).alias("sample_fraction"), "dimension", "value", F.coalesce("target_share", F.lit(0.0)).alias("target_share"), F.coalesce("min_rows", F.lit(0)).alias("min_rows"))
    got = _bounded(ask, MAX_TARGETS, "targets")
    got["wanted"] = np.maximum(got["min_rows"].to_numpy(float), got["target_share"].to_numpy(float) * got["sample_fraction"].to_numpy(float) * total)
    got["available"], got["expected"] = 0, 0.0
    n = cells["n"].to_numpy(float)
    plans, weights = [], []
    for plan, g in got.groupby("plan_id", sort=True):
        member = np.array([(cells[d] == v).to_numpy() if d in names else np.zeros(len(cells), bool) for d, v in zip(g["dimension"], g["value"])]).reshape(len(g), len(cells))
        inside = np.ones(len(cells), bool)
        for d in names:
            rows = (g["dimension"] == d).to_numpy()
            if rows.any():
                inside &= member[rows].any(axis=0)
        p = calibrate(n * inside, member, g["wanted"].to_numpy(float), max(float(g["sample_fraction"].iloc[0]), 1e-6))
        got.loc[g.index, "available"] = (member * n).sum(axis=1).astype(np.int64)
        got.loc[g.index, "expected"] = (member * n * p).sum(axis=1)
        plans.append(plan)
        weights.append(p)
    got["short"] = got["expected"] < got["wanted"] - 1e-3
    fields = "plan_id string, dimension string, value string, target_share double, min_rows int, wanted double, available bigint, expected double, short boolean"
    named = spark.createDataFrame([(*k, i) for i, k in enumerate(cells[names].itertuples(index=False, name=None))], ", ".join(f"{n} string" for n in names) + ", cell int")
    return Sample(full, _frame(spark, got, fields), named, names, plans, np.array(weights).reshape(len(plans), len(cells)), seed)
