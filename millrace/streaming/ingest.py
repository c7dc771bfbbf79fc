"""Structured Streaming: budgeted ingest, ids seen before, a moving average with state, event-time windows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from millrace.operators.dedup import signatures
from millrace.operators.order import token_budget


def ingest(stream: DataFrame, budgets: DataFrame, target: str, checkpoint: str, source: str, order: str, tokens: Column) -> StreamingQuery:
    """Append a stream's rows by source until each source's budget is reached, the last row cut to fit.

    A batch writes to a folder of its own number, which it replaces: a batch that is run again after a failure writes the same
    rows once. What earlier batches took is read from their folders, the truth, and not from a counter beside them. Ends when
    no more input is there; started again with the same ``checkpoint`` it goes on.
    """

    def write(batch: DataFrame, number: int) -> None:
        try:
            done = batch.sparkSession.read.parquet(target).where(F.col("batch_no") < number)
            have = done.groupBy(source).agg(F.sum("taken").alias("__have"))
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":  # only the first batch finds nothing
                raise
            have = batch.sparkSession.createDataFrame([], f"{source} string, __have bigint")
        left = budgets.join(have, source, "left").select(source, (F.col("budget") - F.coalesce("__have", F.lit(0))).alias("__left"))
        rows = token_budget(batch.join(left, source), source, order, tokens, F.col("__left")).drop("__left", "before")
        rows.write.mode("overwrite").parquet(f"{target}/batch_no={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def unseen(stream: DataFrame, key: str, time: str | None = None, delay: str = "1 hour") -> DataFrame:
    """The first row of every key; with ``time``, keys are forgotten ``delay`` after it, so that the state stays bounded."""
    if time is None:
        return stream.dropDuplicates([key])
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


def moving_average(stream: DataFrame, run: str, order: str, value: str, alpha: float = 0.05) -> DataFrame:
    """``run, order, value, ema`` with the last average of every run as state; rows of a batch are taken in order."""
    kinds = dict(stream.dtypes)

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(parts)).sort_values(order, kind="stable")
        last = state.get[0] if state.exists else None
        out = []
        for v in rows[value].astype(float):
            last = v if last is None else last + alpha * (v - last)
            out.append(last)
        if last is not None:
            state.update((last,))
        yield rows[[run, order, value]].assign(ema=out)

    d = stream.where(F.col(value).isNotNull()).select(run, order, value)
    return d.groupBy(run).applyInPandasWithState(step, f"{run} {kinds[run]}, {order} {kinds[order]}, {value} {kinds[value]}, ema double", "last double", "append", GroupStateTimeout.NoTimeout)


def near_duplicates(stream: DataFrame, key: str, text: Column, threshold: float = 0.85, n: int = 128, bands: int = 16) -> DataFrame:
    """``key, band, duplicate_of``: of every text and each of its bands, the earlier text in the band that it nearly repeats, or null.

    The signatures kept in each band are the state. A text is a duplicate if any of its bands says so; bands are looked at one
    by one, so a text that was dropped in one band may be kept in another, where it drops later ones: the batch operator is exact.
    """
    rows = n // bands
    sig = stream.select(F.col(key).cast("string").alias(key), signatures(text, n).alias("sig"))
    cell = F.explode(F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda i: F.struct(i.alias("band"), F.xxhash64(i, F.slice("sig", i * rows + 1, rows)).alias("h"))))
    banded = sig.select(key, "sig", cell.alias("c")).select(key, "sig", "c.band", "c.h")

    def step(at: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        ids, kept = (list(state.get[0]), [np.array(s) for s in state.get[1]]) if state.exists else ([], [])
        out = []
        for i, band, s in _ordered(parts, key):
            s = np.asarray(s)
            same = next((ids[k] for k, x in enumerate(kept) if (x == s).mean() >= threshold), None)
            if same is None:
                ids.append(i)
                kept.append(s)
            out.append((i, band, same))
        state.update((ids, [s.tolist() for s in kept]))
        yield pd.DataFrame(out, columns=[key, "band", "duplicate_of"])

    return banded.groupBy("h").applyInPandasWithState(step, f"`{key}` string, band int, duplicate_of string", "ids array<string>, kept array<array<bigint>>", "append", GroupStateTimeout.NoTimeout)


def _ordered(parts: Iterator[pd.DataFrame], key: str) -> list[tuple]:
    rows = pd.concat(list(parts)).sort_values([key, "band"], kind="stable")
    return list(zip(rows[key], rows["band"].astype(int), rows["sig"]))


def windowed(stream: DataFrame, time: str, length: str, delay: str, by: list[str], **aggregates: Column) -> DataFrame:
    """Aggregates of event-time windows; rows more than ``delay`` late are dropped by the watermark."""
    w = stream.withWatermark(time, delay).groupBy(F.window(time, length), *by).agg(*[c.alias(n) for n, c in aggregates.items()])
    return w.select(F.col("window.start").alias("window_start"), *by, *aggregates)
