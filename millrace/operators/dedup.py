"""MinHash signatures and banded deduplication in which the first of similar texts is kept."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators.skew import lookup
from millrace.workspace import materialise, release

#: Modulus of the permutations and seed of their coefficients. Fixed values.
PRIME, SEED = (1 << 61) - 1, 0xC0FFEE


def permutations(n: int, seed: int = SEED) -> tuple[list[int], list[int]]:
    """Coefficients of ``n`` permutations; with 32-bit hashes all products fit into 63 bits."""
    rng = np.random.default_rng(seed)
    return rng.integers(1, 1 << 31, n).tolist(), rng.integers(0, 1 << 31, n).tolist()


_WORD = re.compile("[a-z0-9_]+")


def shingles(text: str | None, k: int = 5) -> np.ndarray:
    """Distinct CRC-32 values of ``k`` words in a row; one gram for fewer words, none for no words. Words are ASCII letters, digits and underscores after lower-casing."""
    words = _WORD.findall((text or "").lower())
    grams = {" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else ()
    return np.unique(np.fromiter((zlib.crc32(g.encode()) for g in grams), np.uint64, len(grams)))


def signature(grams: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The MinHash signature of a set of grams; all components are PRIME for the empty set."""
    if not len(grams):
        return np.full(len(a), PRIME, np.uint64)
    out = np.full(len(a), PRIME, np.uint64)
    for lo in range(0, len(grams), 4096):  # a long text in parts
        x = grams[None, lo : lo + 4096] * a[:, None] + b[:, None]  # under 2 ** 63
        x = (x & np.uint64(PRIME)) + (x >> np.uint64(61))  # the modulus is 2 ** 61 - 1
        np.minimum(out, np.minimum(x, x - np.uint64(PRIME)).min(axis=1), out=out)  # the difference wraps where x is reduced
    return out


def signatures(text: Column, n: int = 128, seed: int = SEED, k: int = 5) -> Column:
    """Signatures of texts, batch by batch; the arithmetic of 128 permutations is numpy's, lambdas in the JVM are interpreted."""
    a, b = (np.array(x, np.uint64) for x in permutations(n, seed))

    @F.pandas_udf("array<bigint>")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([signature(shingles(t, k), a, b).view(np.int64) for t in texts], dtype=object)

    return run(text)


def estimated_jaccard(x: Column, y: Column) -> Column:
    """The part of equal components."""
    return F.size(F.filter(F.zip_with(x, y, lambda p, q: p == q), lambda e: e)) / F.size(x)


#: Members of a band that one task compares, about; larger bands are split into cells for pairs of parts.
CELL = 4_000
#: Rounds in which only the first member of a band is compared with the others; the first always, further ones while a band has more than WIDE members.
LEADER_ROUNDS, WIDE = 2, 200
#: Confirmed pairs that one task goes through at the end; more are settled in rounds first.
LAST_PAIRS = 1_000_000


def _compare(threshold: float, n: int):
    """Pairs (earlier, later) of a cell's members with an estimated similarity of ``threshold``. Rows come sorted by cell."""

    def pairs(o: np.ndarray, sig: np.ndarray, kind: pa.DataType) -> pa.RecordBatch:
        at = np.argsort(o, kind="stable")
        o, sig, first, second = o[at], sig[at], [], []
        for i in range(len(o) - 1):
            hit = np.flatnonzero((sig[i + 1 :] == sig[i]).sum(axis=1) >= threshold * n - 1e-9)
            first.append(np.full(len(hit), o[i], o.dtype))
            second.append(o[i + 1 + hit])
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(first or [o[:0]]), kind), pa.array(np.concatenate(second or [o[:0]]), kind)], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, held, kind = None, [], None
        for b in batches:
            cells, o, kind = b.column(0).to_numpy(), b.column(1).to_numpy(zero_copy_only=False), b.schema.field(1).type
            sig = b.column(2).flatten().to_numpy().reshape(-1, n)
            cuts = [0, *(np.flatnonzero(np.diff(cells)) + 1).tolist(), len(cells)]
            for lo, hi in zip(cuts, cuts[1:]):
                if hi > lo and cells[lo] != cell:
                    if held:
                        yield pairs(np.concatenate([x for x, _ in held]), np.concatenate([y for _, y in held]), kind)
                    cell, held = cells[lo], []
                held.append((o[lo:hi], sig[lo:hi]))
        if held:
            yield pairs(np.concatenate([x for x, _ in held]), np.concatenate([y for _, y in held]), kind)

    return run


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of at most LAST_PAIRS confirmed pairs (earlier, later), the texts that are dropped when they are gone through in order."""
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    t = pa.Table.from_batches(held).sort_by([("a", "ascending"), ("b", "ascending")])
    gone: dict = {}
    for a, b in zip(t.column("a").to_pylist(), t.column("b").to_pylist()):
        if a not in gone:
            gone[b] = True
    yield pa.RecordBatch.from_arrays([pa.array(list(gone), t.schema.field("a").type)], ["__o"])


def dedup(docs: DataFrame, order: str, text: str, threshold: float = 0.85, n: int = 128, bands: int = 16, seed: int = SEED) -> DataFrame:
    """``order, kept``: a text is dropped if a kept earlier one shares a band with it and has an estimated similarity of ``threshold``.

    The result is that of going through the texts in order. Equal signatures are one text, the first. In two rounds, a text that
    is the first undecided one in all its bands is kept and compared with the others in its bands, which drops large groups of
    similar texts without listing their pairs. What is left in a band is compared within it, and only the pairs that are
    confirmed come out; on these, in rounds, a text without an undecided earlier neighbour is kept and its later ones are dropped,
    until no more than a million pairs are left, which one task goes through in order.
    A band with many members is split into cells. ``order`` is unique, a number or a text; empty texts are all alike, so the first
    is kept.
    """
    if n % bands:
        raise ValueError(f"{bands} bands don't divide {n} permutations")
    kind = dict(docs.dtypes)[order]
    rows, cores = n // bands, docs.sparkSession.sparkContext.defaultParallelism
    texts = docs.select(F.col(order).alias("__o"), F.coalesce(text, F.lit("")).alias("__t"))
    if texts.rdd.getNumPartitions() < cores:  # a small file is one task else
        texts = texts.repartition(cores)
    sigs = materialise(texts.select("__o", signatures(F.col("__t"), n, seed).alias("sig")).withColumn("key", F.xxhash64("sig")), "signatures")
    heads = sigs.groupBy("key", "sig").agg(F.min("__o").alias("__o"))
    sigs = materialise(heads.select("__o", "sig"), "heads")
    band = F.explode(F.array(*[F.xxhash64(F.lit(i), F.slice("sig", i * rows + 1, rows)) for i in range(bands)]))
    all_bands = sigs.select("__o", band.alias("band"))
    shared = all_bands.groupBy("band").count().where("count > 1").select("band")
    open_bands = materialise(all_bands.join(shared, "band"), "bands")
    dropped: list[DataFrame] = []
    for number in range(LEADER_ROUNDS):
        if number and (open_bands.groupBy("band").count().agg(F.max("count")).first()[0] or 0) <= WIDE:
            break
        first = open_bands.groupBy("band").agg(F.min("__o").alias("first"))
        led = lookup(open_bands, first, "band", "inner")
        lead = led.groupBy("__o").agg(F.bool_and(F.col("__o") == F.col("first")).alias("l")).where("l").select("__o")
        lead = materialise(lead, "kept")
        near_by = materialise(led.where("__o != first").select("__o", "first").distinct().join(lead.select(F.col("__o").alias("first")), "first", "left_semi"), "near")
        near = lookup(near_by, sigs.select(F.col("__o").alias("first"), F.col("sig").alias("a")), "first", "inner").join(sigs.select("__o", F.col("sig").alias("b")), "__o")
        gone = materialise(near.where(estimated_jaccard(F.col("a"), F.col("b")) >= threshold).select("__o").distinct(), "dropped")
        dropped.append(gone)
        rest = materialise(open_bands.join(lead.unionByName(gone), "__o", "left_anti"), "bands")
        release(open_bands, near_by)
        open_bands = rest
    counted = open_bands.join(open_bands.groupBy("band").count().where("count > 1"), "band").withColumn("parts", F.ceil(F.col("count") / CELL).cast("int"))
    part = F.pmod(F.xxhash64("__o"), F.col("parts")).cast("int")
    cells = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda j: F.least(part, j) * F.col("parts") + F.greatest(part, j))
    members = counted.select("__o", F.explode(cells).alias("c"), "band").select("__o", F.xxhash64("band", "c").alias("cell")).join(sigs, "__o")
    pairs = members.select("cell", "__o", "sig").repartition("cell").sortWithinPartitions("cell").mapInArrow(_compare(threshold, n), f"a {kind}, b {kind}").distinct()
    edges = materialise(pairs, "edges")
    while (n_pairs := edges.count()) > LAST_PAIRS:
        later = edges.select(F.col("b").alias("a")).distinct()
        gone = materialise(edges.join(later, "a", "left_anti").select(F.col("b").alias("__o")).distinct(), "dropped")
        dropped.append(gone)
        kept = edges.join(later, "a", "left_anti").select("a").distinct()
        out = gone.select(F.col("__o").alias("a")).unionByName(kept)
        rest = materialise(edges.join(out, "a", "left_anti").join(gone.select(F.col("__o").alias("b")), "b", "left_anti"), "edges")
        release(edges)
        edges = rest
    if n_pairs:
        dropped.append(materialise(edges.coalesce(1).mapInArrow(_settle, f"__o {kind}"), "dropped"))
    gone = dropped[0]
    for x in dropped[1:]:
        gone = gone.unionByName(x)
    alive = sigs.select("__o").join(gone, "__o", "left_anti").select(F.col("__o").alias(order), F.lit(True).alias("kept"))
    return docs.select(F.col(order)).join(alive, order, "left").select(order, F.coalesce("kept", F.lit(False)).alias("kept"))


def dedup_groups(docs: DataFrame, group: str, order: str, text: str, **options) -> DataFrame:
    """``dedup`` of groups: a group's texts in order are one text, kept or dropped whole. A null group is each row alone.

    Groups are small by their meaning, the branches of a pair.
    """
    g = F.coalesce(F.concat(F.lit("g"), F.col(group)), F.concat(F.lit("r"), F.col(order).cast("string")))
    joined = docs.select(g.alias("__g"), F.col(order).alias("__i"), F.col(text).alias("__t")).groupBy("__g").agg(F.min("__i").alias("__first"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("__i", "__t"))), lambda x: x["__t"]), "\n", "").alias("__text"))
    joined = materialise(joined, "groups")
    keep = dedup(joined, "__first", "__text", **options)
    verdict = joined.join(keep, "__first").select("__g", "kept")
    return docs.withColumn("__g", g).join(verdict, "__g").drop("__g")


def top_up(existing: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of ``new`` whose stable key the existing rows don't have; of repeated new keys one row."""
    return new.dropDuplicates([key]).join(existing.select(key), key, "left_anti")


def top_up_deduped(existing: DataFrame, new: DataFrame, key: str, group: str, text: str, **options) -> DataFrame:
    """Rows of ``new`` to be added: those of ``top_up`` that don't nearly repeat an existing row or an earlier addition.

    Both tables are gone through in the order of (is new, key), so existing rows win; groups are kept or dropped whole. Both have
    ``key``, ``group`` and ``text``; number keys are not negative.
    """
    name = F.col(key) if dict(new.dtypes)[key] == "string" else F.lpad(F.col(key).cast("string"), 20, "0")
    fresh = materialise(top_up(existing, new, key), "additions")
    part = lambda d, n: d.select(F.concat(F.lit(f"{n}:"), name).alias("__o"), group, text)
    both = part(existing.dropDuplicates([key]), 0).unionByName(part(fresh, 1))
    kept = dedup_groups(both, group, "__o", text, **options).where("kept").select("__o")
    return fresh.withColumn("__o", F.concat(F.lit("1:"), name)).join(kept, "__o", "left_semi").drop("__o")
