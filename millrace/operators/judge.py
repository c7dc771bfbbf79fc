"""Replies to be judged, and the seam for a judge: any function of a prompt."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators.order import balanced_halves, first_n


def targets(graded: DataFrame, capped: dict[str, tuple[Column, int]], order: list, always: dict[str, Column]) -> DataFrame:
    """Well-formed rows with the dimension to judge them by: all that meet a condition of ``always``, the first so many of ``capped``."""
    ok = graded.where("fault is null")
    parts = [ok.where(c).withColumn("dimension", F.lit(n)) for n, c in always.items()]
    for n, (c, most) in capped.items():
        parts.append(first_n(ok.where(c).withColumn("dimension", F.lit(n)), ["dimension"], order, most))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def calibration_targets(graded: DataFrame, order: list, n: int) -> DataFrame:
    """Half of ``n`` correct rows and half wrong ones, well-formed, the first of each."""
    return balanced_halves(graded.where("fault is null"), "correct", order, n)


def run_probes(rows: DataFrame, prompt: str, ask: Callable[[str], str]) -> DataFrame:
    """``rows`` with ``reply`` and ``error``: what a probe answers, or the kind and text of its failure; one failure ends no other probe."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def one(p) -> tuple[str | None, str | None]:
            try:
                return ask(p), None
            except Exception as e:
                return None, f"{type(e).__name__}: {e}"

        for pdf in parts:
            got = [one(p) for p in pdf[prompt]]
            yield pdf.assign(reply=pd.Series([r for r, _ in got], dtype=object, index=pdf.index), error=pd.Series([e for _, e in got], dtype=object, index=pdf.index))

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInPandas(run, f"{fields}, reply string, error string")


def ask_all(rows: DataFrame, prompt: str, ask: Callable[[str], str], parse: Column) -> DataFrame:
    """``rows`` with ``reply`` and ``score``: a failure of one call is that row's null reply, never the end of the job or a 0.

    Rows are sorted by the length of their prompts within partitions, so that batches are even. ``parse`` is a column of ``reply``.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def one(p):
            try:
                return ask(p)
            except Exception:
                return None

        for pdf in parts:
            yield pdf.assign(reply=pd.Series([one(p) for p in pdf[prompt]], dtype=object, index=pdf.index))

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.sortWithinPartitions(F.length(prompt)).mapInPandas(run, f"{fields}, reply string").withColumn("score", parse)
