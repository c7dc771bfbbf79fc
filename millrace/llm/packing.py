"""Filling fixed-capacity containers with items (problem 6)."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.workspace import materialise

#: Size classes of the program and units in which the knapsack measures a container.
CLASSES, UNITS = 512, 4096
#: Part of a class's items by which one step of the program covers it at most, and how strongly coverage lowers a price.
STEP, RATE = 0.1, 3.0
#: Units of the check of the bound; up to this capacity it is that of the sizes themselves.
FINE = 16_384
#: Items of one size in one shard of the numbering, about; limits whose patterns are sent to the workers at a time.
SHARD, AT_ONCE = 250_000, 16
#: Items that are packed one by one after the program is rounded.
REST = 30_000


@dataclass
class Packing:
    """``items``: limit_id, doc_id, piece_no, start_token, end_token, container_id. ``report``: a row per limit."""

    items: DataFrame
    report: DataFrame


def _knapsack(size: np.ndarray, price: np.ndarray, most: np.ndarray, units: int) -> np.ndarray:
    """How many of each class fill ``units`` at the highest price, none more often than ``most``; dynamic programming over room.

    The classes in order of price for their room, the last one in part, give a bound; filled in that order they give a
    packing. What lies between both says of a class how many a better packing can hold at most, or at least: those are
    settled before, so that few classes are left to the program.
    """
    out = np.zeros(len(size), np.int64)
    k = np.flatnonzero((most > 0) & (price > 0) & (size <= units))
    if not len(k):
        return out
    density = price[k] / size[k]
    k = k[np.argsort(-density, kind="stable")]
    w, v = size[k], price[k]
    top = np.minimum(most[k], units // w)
    density, room = v / w, np.cumsum(w * top)
    last = int(np.searchsorted(room, units))
    if last == len(k):  # all fit
        out[k] = top
        return out
    before = int(room[last - 1]) if last else 0
    filled, left = float((v * top)[:last].sum()), units - before
    bound = filled + left * density[last]
    for x, y, n in zip(w[last:].tolist(), v[last:].tolist(), top[last:].tolist()):
        if x <= left:
            m = min(n, left // x)
            filled += m * y
            left -= m * x
            if not left:
                break
    loss, gap = np.abs(density - density[last]) * w, max(0.0, bound - filled) + 1e-12 * bound
    free = np.where(loss * top > gap, np.floor(gap / np.maximum(loss, 1e-300)), top)
    free = np.minimum(free, top).astype(np.int64)
    fixed = np.where(np.arange(len(k)) < last, top - free, 0)
    out[k] = fixed
    rest = units - int((fixed * w).sum())
    best = np.zeros(rest + 1)
    steps = []
    for i in np.flatnonzero(free).tolist():
        x, n, lot = int(w[i]), min(int(free[i]), rest // int(w[i])), 1
        while n > 0:
            lot = min(lot, n)
            n -= lot
            r, worth = x * lot, v[i] * lot
            if r <= rest:
                more = best[: rest + 1 - r] + worth
                take = more > best[r:]
                np.maximum(best[r:], more, out=best[r:])
                steps.append((i, lot, r, take))
            lot *= 2
    at = rest
    for i, lot, r, take in reversed(steps):
        if at >= r and take[at - r]:
            out[k[i]] += lot
            at -= r
    return out


def ready_prices(size: np.ndarray, count: np.ndarray, capacity: int) -> np.ndarray:
    """The prices of sizes, no container worth more than 1, for which all items are worth most, out of functions that are known to be feasible.

    These are a size's part of the capacity; whole ``k + 1``-ths of it in ``k``-ths; and, for a limit ``e``, nothing below ``e``, all
    above ``capacity - e`` and the part of the capacity between.
    """
    part = size / capacity
    best = part
    for k in range(1, 101):
        whole, cut = np.divmod(size * (k + 1), capacity)
        y = np.where(cut == 0, part, whole / k)
        best = y if (y * count).sum() > (best * count).sum() else best
    order = np.argsort(size)
    s, n = size[order], count[order]
    items, room = np.concatenate([[0], np.cumsum(n)]), np.concatenate([[0], np.cumsum(n * s)])
    e = np.unique(s[s * 2 <= capacity])
    low, high = np.searchsorted(s, e), np.searchsorted(s, capacity - e, side="right")
    worth = (items[-1] - items[high]) + (room[high] - room[low]) / capacity
    if len(e) and worth.max() > (best * count).sum():
        e = e[int(worth.argmax())]
        best = np.where(size > capacity - e, 1.0, np.where(size >= e, part, 0.0))
    return best


def cover(size: np.ndarray, count: np.ndarray, capacity: int, start: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Patterns, how many containers use each, a fraction, and prices of the sizes: a solution of the configuration linear program.

    The program asks for the fewest containers whose patterns hold all items of every size. Multiplicative weights: the weight of
    a size is what its items are worth at first, ``start``, times ``exp(-RATE * coverage)``; the knapsack prices out the pattern that
    is worth most at weight / items for each size; it is used until one of its sizes has a further STEP of its items covered. A
    size whose items are covered has no weight, and no pattern holds more of a size than are left. The prices returned are the
    mean of all steps, those of the dual program.
    """
    units = min(capacity, UNITS)
    need = np.maximum(1, -(-size * units // capacity))
    covered = np.zeros(len(size))
    at: dict[bytes, int] = {}
    patterns, uses, mean = [], [], np.zeros(len(size))
    while (open_ := covered < 1 - 1e-9).any():
        w = np.where(open_, start * np.exp(-RATE * (covered - covered.min())), 0.0)
        w /= w.sum()
        most = np.ceil((1 - covered) * count - 1e-9).astype(np.int64)
        pattern = _knapsack(need, np.where(open_, w / count, 0.0), np.where(open_, most, 0), units)
        on = pattern > 0
        share = pattern[on] / count[on]
        d = min(STEP / share.max(), float(((1 - covered[on]) / share).max()))
        covered[on] += d * share
        i = at.setdefault(pattern.tobytes(), len(patterns))
        if i == len(patterns):
            patterns.append(pattern)
            uses.append(0.0)
        uses[i] += d
        mean += d * w
    return patterns, np.array(uses), mean / max(mean.sum(), 1e-300) / count


def worth_at_most(size: np.ndarray, count: np.ndarray, price: np.ndarray, capacity: int) -> float:
    """No container of items of these sizes is worth more at these prices: a knapsack over sizes rounded down."""
    units = min(capacity, FINE)
    low = size * units // capacity
    free = low == 0
    w = np.where(free, 1, low)
    most = np.where(free, 0, np.minimum(count, units // w))
    return float((_knapsack(w, price, most, units) * price).sum() + (price * count)[free].sum())


def solve(size: np.ndarray, count: np.ndarray, capacity: int, start: np.ndarray | None = None) -> tuple[list[tuple[np.ndarray, int]], np.ndarray, np.ndarray]:
    """Patterns with the number of containers that use them, the items of each ``size`` that remain, and dual prices.

    The solution of the linear program is rounded: every pattern is used the whole number of times in its fraction, the longest
    used first. What remains is less than a container for each pattern; while that is more than REST items, patterns of the most room
    filled are taken, each as often as its items last.
    """
    patterns, uses, price = cover(size, count, capacity, size * count / (size * count).sum() if start is None else start)
    left, out = count.astype(np.int64).copy(), []
    for i in np.argsort(-uses, kind="stable").tolist():
        on = patterns[i] > 0
        n = min(int(uses[i] + 1e-9), int((left[on] // patterns[i][on]).min()))
        if n:
            left -= patterns[i] * n
            out.append((patterns[i], n))
    units = min(capacity, UNITS)
    need = np.maximum(1, -(-size * units // capacity))
    while left.sum() > REST:
        lag = np.exp(0.3 * left / count)  # among patterns of equal room, those of sizes that many are left of
        pattern = _knapsack(need, np.where(left > 0, size / capacity * lag, 0.0), left, units)
        on = pattern > 0
        n = max(1, int((left[on] // pattern[on]).min()))
        left -= pattern * n
        out.append((pattern, n))
    return out, left, price


def best_fit(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The container of each item, the largest first, each where it leaves the least room."""
    rooms: list[tuple[int, int]] = []  # room and container, by room
    out, made = np.empty(len(sizes), np.int64), 0
    for i in np.argsort(-sizes, kind="stable").tolist():
        n = int(sizes[i])
        k = bisect_left(rooms, (n, -1))
        room, container = rooms.pop(k) if k < len(rooms) else (capacity, made)
        made += container == made
        out[i] = container
        if room > n:
            insort(rooms, (room - n, container))
    return out


def classes(size: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The greatest size of each of about CLASSES classes, lying as the root of the density of sizes does: this makes the room lost by taking an item for its class's greatest least."""
    if len(size) <= CLASSES:
        return size
    order = np.argsort(size)
    size, count = size[order], count[order]
    cell = size * 1024 // (size[-1] + 1)
    total = np.cumsum(np.sqrt(np.bincount(cell, weights=count, minlength=1024)))
    before = np.concatenate([[0.0], total[:-1]])[cell]
    place = CLASSES * (before + (total[cell] - before) * ((size * 1024 / (size[-1] + 1)) - cell)) / total[-1]
    last = np.append(np.flatnonzero(np.diff(np.floor(place).astype(int))), len(size) - 1)
    return size[last]


_SOLVED = "limit_id string, kind string, a bigint, b bigint, c bigint, d bigint, e bigint, bound double"


def _solve_limit(h: pd.DataFrame) -> pd.DataFrame:
    """Classes of sizes, places of patterns and totals of one capacity, from its histogram: at most one row per size."""
    name, capacity = h["limit_id"].iloc[0], int(h["c"].iloc[0])
    full, tokens = int(h["full"].sum()), int(h["tokens"].sum())
    h = h[h["size"] > 0].sort_values("size")
    s, n = h["size"].to_numpy(np.int64), h["count"].to_numpy(np.int64)
    rows, used, bound = [], 0, 0.0
    if len(s):
        top = classes(s, n)
        of = np.searchsorted(top, s)
        count = np.bincount(of, weights=n, minlength=len(top)).astype(np.int64)
        begin = np.cumsum(n) - n  # items of smaller sizes
        first = begin - (np.cumsum(count) - count)[of]
        rows += [("class", int(x), int(k), int(f), 0, 0, 0.0) for x, k, f in zip(s, of, first)]
        ready = ready_prices(s, n, capacity)
        start = np.bincount(of, weights=0.9 * ready * n + 0.1 * s * n / capacity, minlength=len(top))
        place = np.zeros(len(top), np.int64)
        plan, left, price = solve(top, count, capacity, start / start.sum())
        for pattern, uses in plan:
            for k in np.flatnonzero(pattern).tolist():
                rows.append(("slot", k, int(place[k]), used, int(pattern[k]), 0, 0.0))
                place[k] += pattern[k] * uses
            used += uses
        k = np.repeat(np.arange(len(top)), left)  # what remains, item by item, at its own size
        number = np.arange(len(k)) - np.repeat(np.cumsum(left) - left, left) + place[k]
        of_item = s[np.searchsorted(begin + n, (np.cumsum(count) - count)[k] + number, side="right")]
        held = best_fit(of_item, capacity)
        rows += [("slot", int(a), int(b), used + int(c), 1, 0, 0.0) for a, b, c in zip(k, number, held)]
        used += int(held.max(initial=-1)) + 1
        dual = price[of] * s / top[of]
        bound = max(float((ready * n).sum()), float((dual * n).sum()) / worth_at_most(s, n, dual, capacity))
    rows.append(("total", int(n.sum()), full, used + full, tokens, 0, bound + full))
    out = pd.DataFrame(rows, columns=["kind", "a", "b", "c", "d", "e", "bound"])
    out["kind"] = out["kind"].astype(object)
    out.insert(0, "limit_id", pd.Series([name] * len(out), dtype=object))
    return out


@dataclass
class _Places:
    """Where the items of a capacity go: the place of each size's first item in its class, and the slots of every class by their first item."""

    size: np.ndarray
    place: np.ndarray  # class << 40 | number of the size's first item
    slot: np.ndarray  # class << 40 | number of the slot's first item
    base: np.ndarray
    per: np.ndarray

    @classmethod
    def of(cls, solved: pd.DataFrame) -> _Places:
        c, s = (solved[solved.kind == k] for k in ("class", "slot"))
        c = c.sort_values("a")
        slot = ((s["a"].to_numpy(np.int64) << 40) | s["b"].to_numpy(np.int64)).astype(np.int64)
        o = np.argsort(slot)
        return cls(c["a"].to_numpy(np.int64), (c["b"].to_numpy(np.int64) << 40) | c["c"].to_numpy(np.int64), slot[o], s["c"].to_numpy(np.int64)[o], s["d"].to_numpy(np.int64)[o])

    def container(self, size: np.ndarray, number: np.ndarray) -> np.ndarray:
        at = self.place[np.searchsorted(self.size, size)] + number
        i = np.searchsorted(self.slot, at, side="right") - 1
        return self.base[i] + (at - self.slot[i]) // self.per[i]


_PLACED = pa.schema([("limit_id", pa.string()), ("doc_id", pa.int64()), ("piece_no", pa.int32()), ("start_token", pa.int64()), ("end_token", pa.int64()), ("container_id", pa.string())])


def _assign(broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        limits: list[tuple[str, int, _Places]] = broadcast.value
        for b in batches:
            which, doc, size, full, number = (b.column(i).to_numpy() for i in range(5))
            for k in np.unique(which).tolist():
                name, capacity, places = limits[k]
                on = which == k
                start = full[on] * capacity
                held = places.container(size[on], number[on])
                columns = (np.full(len(start), name, object), doc[on], full[on], start, start + size[on], [f"c{x}" for x in held.tolist()])
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(columns, _PLACED)], schema=_PLACED)

    return run


def pack(documents: DataFrame, limits: DataFrame, doc_id: str = "doc_id", size: Column | None = None, max_limits: int = 100) -> Packing:
    """Each document's container for every capacity of ``limits`` (``limit_id, capacity_tokens``).

    ``size`` is the number of tokens, by default UTF-8 bytes of ``text``. A document larger than the capacity is cut into full
    containers and a rest, which is an item like the others; no other is cut. From a histogram of sizes, at most one row per
    size up to the capacity, one task for each capacity solves the configuration linear program over some 512 size classes by
    multiplicative weights with knapsack pricing, rounds it, packs the rest of at most 30,000 items one by one at their own sizes,
    the largest first where it leaves the least room, and gives a lower bound: the worth of all items at dual prices for
    which no container is worth more than 1. Its work does not grow with the documents. An item is taken for the largest of
    its class; with at most 512 different sizes each is its own class. Items are numbered within their size, in shards by a hash of their id so that
    a size that a third of all documents have is no single task, and an item's number says which container's place it gets.
    Patterns are fewer than classes / STEP, with the rest a megabyte or two for each capacity; they are what is broadcast, for
    16 capacities at a time.

    Rows of one id are one document, the largest counts; rows without an id are left out. Null and empty texts have size 0 and
    lie in the container "empty", which uses no room. An empty table has no containers. More than ``max_limits`` limits are an error.
    """
    spark = documents.sparkSession
    small = [(r[0], int(r[1])) for r in limits.where("limit_id is not null and capacity_tokens > 0").select("limit_id", "capacity_tokens").distinct().orderBy("limit_id").limit(max_limits + 1).collect()]
    if len(small) > max_limits:
        raise ValueError(f"more than {max_limits} limits")
    measure = F.octet_length("text") if size is None else size
    docs = documents.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).cast("bigint").alias("doc_id"), F.greatest(F.coalesce(measure.cast("bigint"), F.lit(0)), F.lit(0)).alias("n"))
    docs = materialise(docs.groupBy("doc_id").agg(F.max("n").alias("n")), "sizes")
    caps = F.array(*[F.struct(F.lit(i).alias("which"), F.lit(n).alias("limit_id"), F.lit(c).cast("bigint").alias("c")) for i, (n, c) in enumerate(small)])
    each = docs.select("doc_id", "n", F.explode(caps).alias("cap")).select("doc_id", "n", "cap.*") if small else docs.where("false").withColumns({"which": F.lit(0), "limit_id": F.lit("none"), "c": F.lit(1).cast("bigint")})
    rest = F.when(F.col("n") <= F.col("c"), F.col("n")).otherwise(F.col("n") % F.col("c"))
    each = each.withColumn("size", rest).withColumn("full", F.when(F.col("n") > F.col("c"), F.floor(F.col("n") / F.col("c"))).otherwise(0).cast("bigint"))
    hist = each.groupBy("which", "limit_id", "c", "size").agg(F.count(F.lit(1)).alias("count"), F.sum("full").alias("full"), F.sum("n").alias("tokens"))

    def solve_all(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = [p for p in parts if len(p)]
        if held:
            yield from (_solve_limit(g) for _, g in pd.concat(held).groupby("which"))

    solved = materialise(hist.repartitionById(max(1, len(small)), F.col("which")).mapInPandas(solve_all, _SOLVED), "patterns")
    shards = max(1, -(-docs.count() // SHARD))
    items = each.where("size > 0").select("which", "size", F.pmod(F.xxhash64("doc_id"), F.lit(shards)).cast("int").alias("shard"), "doc_id", "full")
    inside = Window.partitionBy("which", "size", "shard").orderBy("doc_id")
    items = items.withColumn("number", (F.row_number().over(inside) - 1).cast("bigint"))
    if shards > 1:
        before = Window.partitionBy("which", "size").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # a row per shard
        counts = each.where("size > 0").groupBy("which", "size", F.pmod(F.xxhash64("doc_id"), F.lit(shards)).cast("int").alias("shard")).count()
        offset = counts.select("which", "size", "shard", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("offset"))
        items = items.join(offset, ["which", "size", "shard"]).withColumn("number", F.col("number") + F.col("offset"))
    packed = items.select(F.lit("").alias("limit_id"), "doc_id", F.lit(0).alias("piece_no"), F.col("size").alias("start_token"), F.col("size").alias("end_token"), F.lit("").alias("container_id")).where("false")
    for lo in range(0, len(small), AT_ONCE):
        some = small[lo : lo + AT_ONCE]
        found = solved.where(F.col("kind").isin("class", "slot") & F.col("limit_id").isin([n for n, _ in some])).toPandas()
        sent = spark.sparkContext.broadcast([(n, c, _Places.of(found[found.limit_id == n])) for n, c in some])
        mine = items.where(F.col("which").between(lo, lo + len(some) - 1)).select((F.col("which") - lo).alias("which"), "doc_id", "size", "full", "number")
        packed = packed.unionByName(mine.mapInArrow(_assign(sent), "limit_id string, doc_id bigint, piece_no int, start_token bigint, end_token bigint, container_id string"))
    whole = each.where("full > 0").select("limit_id", "doc_id", "c", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("full") - 1)).alias("k"))
    whole = whole.select("limit_id", "doc_id", F.col("k").cast("int").alias("piece_no"), (F.col("k") * F.col("c")).alias("start_token"), ((F.col("k") + 1) * F.col("c")).alias("end_token"), F.concat(F.lit("d"), F.col("doc_id").cast("string"), F.lit("-"), F.col("k").cast("string")).alias("container_id"))
    none = each.where("n = 0").select("limit_id", "doc_id", F.lit(0).alias("piece_no"), F.lit(0).cast("bigint").alias("start_token"), F.lit(0).cast("bigint").alias("end_token"), F.lit("empty").alias("container_id"))
    named = spark.createDataFrame(small, "limit_id string, capacity_tokens int")
    t = solved.where("kind = 'total'").select("limit_id", F.col("a").alias("items"), F.col("b").alias("full_containers"), F.col("c").alias("containers"), F.col("d").alias("tokens"), F.col("bound").alias("lower_bound"))
    used = F.try_divide(F.col("tokens").cast("double"), F.col("containers") * F.col("capacity_tokens"))
    report = named.join(t, "limit_id", "left").fillna(0).select("limit_id", "capacity_tokens", "items", "full_containers", "containers", F.coalesce(used, F.lit(0.0)).alias("utilisation"), F.col("lower_bound").cast("double").alias("lower_bound"))
    return Packing(packed.unionByName(whole).unionByName(none), report)
