"""Packing whole examples into fixed windows, group by group, in mixed order."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.workspace import materialise


def fill(lengths: np.ndarray, size: int, chunk: int = 256, most_open: int = 128) -> np.ndarray:
    """The window of every item, items in the order given.

    Items are taken in chunks, in each from the longest down, so that windows stay mixed; an item goes into the first open
    window with room. At most ``most_open`` windows stay open, those with the most room. Rooms of open windows are one array, so
    that the search for the first is one comparison.
    """
    out = np.empty(len(lengths), np.int64)
    room, name, made = np.zeros(0, np.int64), np.zeros(0, np.int64), 0
    for lo in range(0, len(lengths), chunk):
        part = lengths[lo : lo + chunk]
        for i in np.argsort(-part, kind="stable"):
            need = part[i]
            fits = room >= need
            at = int(fits.argmax()) if len(room) else 0
            if len(room) and fits[at]:
                room[at] -= need
                out[lo + i] = name[at]
                continue
            out[lo + i] = made
            room, name = np.append(room, size - need), np.append(name, made)
            made += 1
            if len(room) > most_open:
                keep = np.argsort(room, kind="stable")[-most_open:]
                room, name = room[keep], name[keep]
    return out


def bin_pack(items: DataFrame, key: str, length: str, size: int, seed: int = 0, group: int = 20_000, chunk: int = 256, most_open: int = 128) -> DataFrame:
    """``key, length, pack_group, window_no, position``: whole items in windows of ``size``.

    Items are dealt by a hash to groups of about ``group`` items, each packed alone by one task in hash order; a group leaves
    about one badly filled window. One group is the plain sequential method. Items without a length or longer than ``size``
    are left out; ``refused`` lists them.
    """
    d = items.where((F.col(length) >= 0) & (F.col(length) <= size)).select(F.col(key), F.col(length).cast("bigint").alias(length)).withColumn("__h", F.xxhash64(F.col(key), F.lit(seed)))
    d = materialise(d, "items")  # lengths are computed once, for the number of groups and for the packing
    groups = max(1, -(-d.count() // group))
    d = d.withColumn("pack_group", F.pmod(F.col("__h"), F.lit(groups)).cast("int"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["__h", key], kind="stable")
        w = fill(pdf[length].to_numpy(), size, chunk, most_open)
        pdf = pdf.assign(window_no=w, __at=np.arange(len(w)))
        pdf["position"] = pdf.groupby("window_no")["__at"].rank(method="first").astype("int64") - 1
        return pdf[[key, length, "pack_group", "window_no", "position"]]

    kind = dict(items.dtypes)[key]
    return d.groupBy("pack_group").applyInPandas(run, f"`{key}` {kind}, `{length}` bigint, pack_group int, window_no bigint, position bigint")


def refused(items: DataFrame, key: str, length: str, size: int) -> DataFrame:
    """``key, length, drop_reason``: the items that ``bin_pack`` can't place, "no_length" or "too_long"."""
    n = F.col(length)
    reason = F.when(n.isNull() | (n < 0), "no_length").when(n > size, "too_long")
    return items.select(F.col(key), n.cast("bigint").alias(length), reason.alias("drop_reason")).where("drop_reason is not null")


def lay_out(packed: DataFrame, ids: str, mask: str, size: int, pad: int) -> DataFrame:
    """``pack_group, window_no, ids, mask``: the items' arrays one after the other, filled with ``pad`` and mask 0 up to ``size``."""
    ordered = F.sort_array(F.collect_list(F.struct("position", F.col(ids).alias("i"), F.col(mask).alias("m"))))
    w = packed.groupBy("pack_group", "window_no").agg(ordered.alias("__p"))
    i, m = F.flatten(F.transform("__p", lambda x: x["i"])), F.flatten(F.transform("__p", lambda x: x["m"]))
    w = w.select("pack_group", "window_no", i.alias("i"), m.alias("m")).withColumn("__pad", F.lit(size) - F.size("i"))
    return w.select("pack_group", "window_no", F.concat("i", F.array_repeat(F.lit(pad), F.col("__pad"))).alias("ids"), F.concat("m", F.array_repeat(F.lit(0).cast("tinyint"), F.col("__pad"))).alias("mask"))


def pack_stats(packed: DataFrame, length: str, size: int, category: str | None = None) -> DataFrame:
    """``items, windows, tokens, utilisation``, of all or by category (windows then count those with an item of it)."""
    by = [category] if category else []
    window = F.struct("pack_group", "window_no")
    g = packed.groupBy(*by).agg(F.count(F.lit(1)).alias("items"), F.countDistinct(window).alias("windows"), F.coalesce(F.sum(length), F.lit(0)).alias("tokens"))
    return g.withColumn("utilisation", F.coalesce(F.try_divide(F.col("tokens").cast("double"), F.col("windows") * F.lit(float(size))), F.lit(0.0)))


def steps(windows: int, epochs: int, batch: int) -> int:
    """Optimizer steps of a run: whole batches of all epochs' windows, at least one."""
    return max(1, windows * epochs // batch)


def missing_tokens(vocabulary: dict[str, int], needed: tuple[str, ...]) -> list[str]:
    """Special tokens that a vocabulary lacks, in order."""
    return [t for t in needed if t not in vocabulary]
