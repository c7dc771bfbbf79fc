"""Near-duplicate records with small edits (problem 4): an exact similarity join of n-gram sets."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.words import gram_sets, mix
from millrace.operators.components import connected_components
from millrace.operators.skew import hot_keys, salted_join
from millrace.workspace import materialise

#: Cells of the frequency table are 2 ** bits, one for every eight n-grams of the table between these bounds; CHUNK of them travel in one row.
LEAST_BITS, MOST_BITS, CHUNK = 21, 24, 1 << 16
#: Logarithmic steps of a frequency per doubling: a byte holds frequencies up to 2 ** 42.
STEPS = 6
#: Sets in one bucket of the join, about.
BUCKET_SETS = 40_000
#: An n-gram in more sets than this is split into cells of pairs of parts.
HOT_GRAM = 20_000
#: Bytes of a set's signature.
SIGNATURE = 32
#: Levels of the tree below the first n-gram that two sets share; node pairs or pairs of sets that are looked at at a time.
DEPTH, AT_ONCE = 4, 1 << 20
_END = np.uint32(0xFFFFFFFF)


def _binary(flat: np.ndarray, count: np.ndarray) -> pa.Array:
    """``count`` elements of ``flat`` in each row, as bytes."""
    offsets = np.concatenate([[0], np.cumsum(count * flat.itemsize)]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(count), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(np.ascontiguousarray(flat).tobytes())])


def _starts(n: np.ndarray) -> np.ndarray:
    return np.cumsum(n) - n


def _sums(x: np.ndarray, n: np.ndarray) -> np.ndarray:
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(x, dtype=np.uint64)])  # sums wrap
    s = _starts(n)
    return total[s + n] - total[s]


def _class_keys(h: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits that are equal for equal sets."""
    return _sums(mix(h), n).view(np.int64), _sums(mix(h ^ np.uint64(0x5851F42D4C957F2D)), n).view(np.int64)


_FIRST = pa.schema([("id", pa.string()), ("k1", pa.int64()), ("k2", pa.int64()), ("n", pa.int32()), ("chunk", pa.int32()), ("counts", pa.binary())])


def _fresh(k1: np.ndarray, k2: np.ndarray, n: np.ndarray, seen: set) -> np.ndarray:
    """Which sets have n-grams and come for the first time in this task."""
    new = np.zeros(len(n), bool)
    for i, key in enumerate(zip(k1.tolist(), k2.tolist())):
        if n[i] and key not in seen:
            seen.add(key)
            new[i] = True
    return new


def _survey(k: int, bits: int):
    """Pass 1: the class key of every set, and how many different sets of this task fall into each cell of the frequency table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, seen = np.zeros(1 << bits, np.uint32), set()
        for b in batches:
            h, n = gram_sets(b.column(1).to_pylist(), k)
            k1, k2 = _class_keys(h, n)
            new = np.repeat(_fresh(k1, k2, n, seen), n)
            np.add.at(counts, (h[new] >> np.uint64(64 - bits)).astype(np.int64), np.uint32(1))
            m = len(n)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(k1), pa.array(k2), pa.array(n.astype(np.int32)), pa.nulls(m, pa.int32()), pa.nulls(m, pa.binary())], schema=_FIRST)
        rows = [(i // CHUNK, zlib.compress(counts[i : i + CHUNK].tobytes(), 1)) for i in range(0, len(counts), CHUNK) if counts[i : i + CHUNK].any()]
        if rows:
            m = len(rows)
            yield pa.RecordBatch.from_arrays([pa.nulls(m, pa.string()), pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64()), pa.nulls(m, pa.int32()), pa.array([c for c, _ in rows], pa.int32()), pa.array([z for _, z in rows], pa.binary())], schema=_FIRST)

    return run


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums the frequency cells of all tasks, a few chunks in each task, and leaves one byte of each."""
    total: dict[int, np.ndarray] = {}
    for b in batches:
        for c, z in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            x = np.frombuffer(zlib.decompress(z), np.uint32)
            total[c] = total[c] + x if c in total else x.astype(np.uint64)
    for c, x in total.items():
        level = np.round(STEPS * np.log2(1.0 + x)).astype(np.uint8)
        yield pa.RecordBatch.from_arrays([pa.array([c], pa.int32()), pa.array([level.tobytes()], pa.binary())], ["chunk", "levels"])


def _spread(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    return np.repeat(start, n) + np.arange(int(n.sum())) - np.repeat(_starts(n), n)


def _signatures(h: np.ndarray, n: np.ndarray) -> np.ndarray:
    """SIGNATURE * 8 bits of each set: those that its n-grams hash to."""
    words = SIGNATURE // 8
    bit = (mix(h ^ np.uint64(0xA24BAED4963EE407)) >> np.uint64(40)) % np.uint64(SIGNATURE * 8)
    word, value = (bit // np.uint64(64)).astype(np.int64), np.uint64(1) << (bit % np.uint64(64))
    out = np.zeros((len(n), words), np.uint64)
    full = np.flatnonzero(n)
    for w in range(words if len(full) else 0):
        out[full, w] = np.bitwise_or.reduceat(np.where(word == w, value, np.uint64(0)), _starts(n)[full])
    return out


_ROUTED = pa.schema([("bucket", pa.int32()), ("k1", pa.int64()), ("k2", pa.int64()), ("n", pa.int32()), ("signature", pa.binary()), ("grams", pa.binary()), ("places", pa.binary())])


def _label(key: np.ndarray, f: np.ndarray) -> np.ndarray:
    """32 bits of an n-gram that are in the global order: its frequency, then a hash."""
    return (f.astype(np.uint32) << np.uint32(24)) | (mix(key ^ np.uint64(0x8CB92BA72F3D8DD7)) >> np.uint64(40)).astype(np.uint32)


def _parts(f: np.ndarray) -> np.ndarray:
    return np.maximum(1, np.ceil(np.exp2(f / STEPS) / HOT_GRAM)).astype(np.int64)


def _route(levels, bits: int, buckets: int, k: int, threshold: float):
    """Pass 2: the path of each distinct set down to where a partner must have branched off, cut by the bucket of its n-grams."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level, seen = levels.value, set()
        for b in batches:
            h, n = gram_sets(b.column(0).to_pylist(), k)
            k1, k2 = _class_keys(h, n)
            fresh = _fresh(k1, k2, n, seen)
            h, n, k1, k2 = h[np.repeat(fresh, n)], n[fresh], k1[fresh], k2[fresh]
            if not len(n):
                continue
            signature = _signatures(h, n)
            f = level[(h >> np.uint64(64 - bits)).astype(np.int64)]
            label = _label(h, f)
            row = np.repeat(np.arange(len(n)), n)
            order = np.argsort((row.astype(np.uint64) << np.uint64(32)) | label, kind="stable")  # rare n-grams first; the order is the same everywhere
            h, f, label = h[order], f[order], label[order]
            place = np.arange(len(h)) - np.repeat(_starts(n), n)
            path = n - np.ceil(threshold * n - 1e-9).astype(np.int64) + 1
            keep = (place < path[row]) & (f > STEPS)  # a cell with one set has no partner
            h, f, label, row, place = h[keep], f[keep], label[keep], row[keep], place[keep]
            parts, key = _parts(f), h
            if (parts > 1).any():  # pairs of parts, each a cell: part i meets part j in cell (i, j)
                mine = (k1.view(np.uint64)[row] % parts.astype(np.uint64)).astype(np.int64)
                other = _spread(np.zeros(len(h), np.int64), parts)
                h, f, label, row, place, mine, p = (np.repeat(x, parts) for x in (h, f, label, row, place, mine, parts))
                cell = np.minimum(mine, other) * p + np.maximum(mine, other)
                key = np.where(p > 1, mix(h + cell.astype(np.uint64)), h)
                label = np.where(p > 1, _label(key, f), label)
            bucket = (mix(key ^ np.uint64(0xD6E8FEB86659FD93)) % np.uint64(buckets)).astype(np.int64)
            order = np.lexsort((label, bucket, row))
            row, bucket, label, place = row[order], bucket[order], label[order], place[order]
            if not len(row):
                continue
            first = np.flatnonzero((np.diff(row, prepend=-1) != 0) | (np.diff(bucket, prepend=-1) != 0))
            count = np.diff(np.append(first, len(row)))
            r = row[first]
            yield pa.RecordBatch.from_arrays([pa.array(bucket[first].astype(np.int32)), pa.array(k1[r]), pa.array(k2[r]), pa.array(n[r].astype(np.int32)), _binary(signature[r].reshape(-1), np.full(len(r), SIGNATURE // 8)), _binary(label, count), _binary(np.minimum(place, 65535).astype(np.uint16), count)], schema=_ROUTED)

    return run


_PAIRS = pa.schema([("a1", pa.int64()), ("a2", pa.int64()), ("b1", pa.int64()), ("b2", pa.int64())])


def _bytes(column: pa.Array, kind) -> tuple[np.ndarray, np.ndarray]:
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    return data.view(kind) if len(data) else np.zeros(0, kind), np.diff(offsets) // np.dtype(kind).itemsize


class _Trie:
    """The paths of a bucket as a prefix tree: below every n-gram the lengths of the sets that have it, below those what follows it on their paths.

    Paths are sorted, so a node is a range of them and is held once, however many share it. A node knows the lengths of the
    sets below it and the most that remains on one of their paths from the first n-gram on.
    """

    def __init__(self, gram: np.ndarray, band: np.ndarray, path: list[np.ndarray], size: np.ndarray, rest: np.ndarray):
        keys = [gram.astype(np.uint64) << np.uint64(32) | band.astype(np.uint64), *path]
        change = np.ones(len(gram), bool)
        change[1:] = gram[1:] != gram[:-1]
        starts = [np.flatnonzero(change)]
        for key in keys:
            change = change.copy()
            change[1:] |= key[1:] != key[:-1]
            starts.append(np.flatnonzero(change))
        total = len(gram)
        offset = np.cumsum([0, *map(len, starts)])
        self.first = np.concatenate(starts)
        self.last = np.concatenate([np.append(s[1:], total) for s in starts])
        self.shortest, self.longest, self.rest = (np.concatenate([f.reduceat(x, s) for s in starts]) for f, x in ((np.minimum, size), (np.maximum, size), (np.maximum, rest)))
        labels = [gram, band.astype(np.uint32), *path]
        self.label = np.concatenate([x[s] for x, s in zip(labels, starts)])
        child, children = [], []
        for d, s in enumerate(starts[:-1]):
            c = np.searchsorted(starts[d + 1], s)
            child.append(c + offset[d + 1])
            children.append(np.diff(np.append(c, len(starts[d + 1]))))
        child.append(np.zeros(len(starts[-1]), np.int64))
        children.append(np.zeros(len(starts[-1]), np.int64))
        self.child, self.children = np.concatenate(child), np.concatenate(children)
        self.leaf = np.arange(len(self.label)) >= offset[len(starts) - 1]
        self.leaf |= (np.arange(len(self.label)) >= offset[2]) & (self.label == _END)
        self.roots = len(starts[0])


def _grouped(n: np.ndarray) -> Iterator[slice]:
    """Stretches of about AT_ONCE in all."""
    upto = np.cumsum(n)
    lo = 0
    while lo < len(n):
        hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + AT_ONCE, side="right")))
        yield slice(lo, hi)
        lo = hi


def _traverse(t: _Trie, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Pairs of nodes below which similar sets may lie, with the n-grams that either side is known to lack in the other: node, node, missed, missed.

    Both sides go down together from the n-gram that they share, as in a merge of two paths. What is known of the overlap
    is known once for all sets below two nodes: a shared n-gram is passed on both sides, one that the other side's path has
    gone past is missed. A pair of subtrees is cut off when lengths don't fit, or when what remains of the shorter path
    without what was missed is less than the overlap that the shortest sets below would need.
    """
    ratio = threshold / (1 + threshold)
    own = _spread(t.child[: t.roots], t.children[: t.roots])  # the lengths below every n-gram, in order
    root = np.repeat(np.arange(t.roots), t.children[: t.roots])
    near = np.flatnonzero((root[1:] == root[:-1]) & (t.label[own[1:]] == t.label[own[:-1]] + 1))
    zero = lambda x: np.zeros(len(x), np.int32)
    stack = [(own, own, zero(own), zero(own), True), (own[near], own[near + 1], zero(near), zero(near), True)]
    while stack:
        u, v, a, b, passed = stack.pop()
        ok = (t.longest[u] >= threshold * t.shortest[v] - 1e-9) & (t.longest[v] >= threshold * t.shortest[u] - 1e-9) & ((u != v) | (t.last[u] - t.first[u] > 1))
        ok &= np.minimum(t.rest[u] - a, t.rest[v] - b) >= np.ceil(ratio * (t.shortest[u] + t.shortest[v]) - 1e-9)
        u, v, a, b = u[ok], v[ok], a[ok], b[ok]
        end = t.leaf[u] | t.leaf[v]
        if end.any():
            yield u[end], v[end], a[end], b[end]
            u, v, a, b = u[~end], v[~end], a[~end], b[~end]
        if not len(u):
            continue
        down_u, down_v = np.ones(len(u), bool), np.ones(len(u), bool)
        if not passed:
            less, more = t.label[u] < t.label[v], t.label[u] > t.label[v]
            a, b = a + less, b + more
            down_u, down_v = ~more, ~less
        left = np.where(down_u, t.children[u], 1)
        for part in _grouped(left):
            n = left[part]
            at = np.repeat(np.arange(part.start, part.start + len(n)), n)
            c = _spread(np.where(down_u[part], t.child[u[part]], u[part]), n)
            lo = np.where(u[at] == v[at], c, np.where(down_v[at], t.child[v[at]], v[at]))  # of two equal subtrees each pair once
            hi = np.where(down_v[at], t.child[v[at]] + t.children[v[at]], v[at] + 1)
            for some in _grouped(hi - lo):
                m = (hi - lo)[some]
                x = np.repeat(at[some], m)
                stack.append((np.repeat(c[some], m), _spread(lo[some], m), a[x], b[x], False))


def _join(threshold: float):
    """Pass 3: pairs of sets of a bucket whose overlap can reach what the threshold asks for."""
    ratio, width = threshold / (1 + threshold), np.log(1 / threshold) * (1 + 1e-6)  # lengths that fit differ by one band at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [[] for _ in range(7)]
        for b in batches:
            grams, count = _bytes(b.column(5), np.uint32)
            places, _ = _bytes(b.column(6), np.uint16)
            for x, y in zip(got, (b.column(1).to_numpy(), b.column(2).to_numpy(), b.column(3).to_numpy(), _bytes(b.column(4), np.uint64)[0].reshape(len(count), -1), count, grams, places)):
                x.append(y)
        if not got[0]:
            return
        k1, k2, size, sig, count, gram, place = (np.concatenate(x) for x in got)
        order = np.lexsort((k2, k1))  # equal sets from several tasks are one path
        new = np.ones(len(k1), bool)
        new[order[1:]] = (k1[order[1:]] != k1[order[:-1]]) | (k2[order[1:]] != k2[order[:-1]])
        row = np.repeat(np.arange(len(k1)), count)
        keep = new[row]
        row, gram, place = row[keep], gram[keep], place[keep].astype(np.int32)
        size = size.astype(np.int32)
        count = np.where(new, count, 0)
        end = np.repeat(np.cumsum(count), count)  # of each path
        cell = gram * np.uint32(0x9E3779B1) >> np.uint32(10)
        shared = np.flatnonzero(np.bincount(cell, minlength=1 << 22)[cell] > 1)  # and a few that only share a cell
        if not len(shared):
            return
        hot = _parts((gram >> np.uint32(24)).astype(np.float64)) > 1  # only a part of its sets is here: what it says ends there
        path = []
        for d in range(1, DEPTH + 1):
            at = shared + d
            inside = at < end[shared]
            at = np.minimum(at, len(gram) - 1)
            path.append(np.where(inside & ~hot[at], gram[at], _END))
        g, r, n = gram[shared], row[shared], size[row[shared]]
        rest = n - place[shared]
        band = np.floor(np.log(n) / width).astype(np.int64)
        order = np.lexsort((*(p for p in path[::-1]), band, g))
        g, r, n, rest, band = (x[order] for x in (g, r, n, rest, band))
        trie = _Trie(g, band, [p[order] for p in path], n, rest)
        found = []
        for u, v, ma, mb in _traverse(trie, threshold):
            first_v, wide = trie.first[v], trie.last[v] - trie.first[v]
            for rows in _grouped(trie.last[u] - trie.first[u]):
                deep = (trie.last[u] - trie.first[u])[rows]
                at = np.repeat(np.arange(rows.start, rows.start + len(deep)), deep)
                i = _spread(trie.first[u[rows]], deep)
                lo = np.where(u[at] == v[at], i + 1, first_v[at])
                m = first_v[at] + wide[at] - lo
                for some in _grouped(m):
                    x, ii, jj = np.repeat(at[some], m[some]), np.repeat(i[some], m[some]), _spread(lo[some], m[some])
                    na, nb = n[ii], n[jj]
                    need = np.ceil(ratio * (na + nb) - 1e-9).astype(np.int32)
                    ok = (r[ii] != r[jj]) & (np.minimum(na, nb) >= threshold * np.maximum(na, nb) - 1e-9) & (np.minimum(rest[ii] - ma[x], rest[jj] - mb[x]) >= need)
                    p, q, total, need = r[ii[ok]], r[jj[ok]], (na + nb)[ok], need[ok]
                    apart = np.bitwise_count(sig[p] ^ sig[q]).sum(axis=1, dtype=np.int32)
                    ok = total - apart >= 2 * need
                    if ok.any():
                        found.append(np.stack([np.minimum(p[ok], q[ok]), np.maximum(p[ok], q[ok])]))
            if len(found) > 64:
                found = [np.unique(np.concatenate(found, axis=1), axis=1)]
        if found:
            a, b = np.unique(np.concatenate(found, axis=1), axis=1)
            swap = (k1[a] > k1[b]) | ((k1[a] == k1[b]) & (k2[a] > k2[b]))
            a, b = np.where(swap, b, a), np.where(swap, a, b)
            for lo in range(0, len(a), 100_000):
                x, y = a[lo : lo + 100_000], b[lo : lo + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array(k1[x]), pa.array(k2[x]), pa.array(k1[y]), pa.array(k2[y])], schema=_PAIRS)

    return run


def _sets_of(bitmap, bits: int, k: int):
    """The sets of the ids whose bit is set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = bitmap.value
        for b in batches:
            at = (b.column(2).to_numpy().view(np.uint64) % np.uint64(1 << bits)).astype(np.int64)
            hit = np.flatnonzero((wanted[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1))
            if len(hit):
                own = b.take(pa.array(hit))
                h, n = gram_sets(own.column(1).to_pylist(), k)
                offsets = pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32))
                yield pa.RecordBatch.from_arrays([own.column(0), pa.ListArray.from_arrays(offsets, pa.array(h.view(np.int64)))], ["id", "grams"])

    return run


class SimilarSets:
    """Near-duplicates among texts: ``classes`` (id, k1, k2, n), ``links`` between the least ids of different sets (id_a, id_b, similarity)."""

    def __init__(self, classes: DataFrame, links: DataFrame):
        self.classes, self.links = classes, links
        self._same = ["k1", "k2", "n"]

    def pairs(self) -> DataFrame:
        """Every pair of different ids that are near-duplicates, ``id_a < id_b``, copies among each other too."""
        c = self.classes.where("n > 0")
        head = c.groupBy(*self._same).agg(F.min("id").alias("head"), F.count(F.lit(1)).alias("copies"))
        salts = max(1, -(-(head.agg(F.max("copies")).first()[0] or 0) // 5000))
        m = c.join(head.where("copies > 1"), self._same).select("head", "id")
        left = m.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(salts)))
        right = m.withColumnRenamed("id", "other").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(salts - 1).cast("bigint"))))
        copies = left.join(right, ["head", "salt"]).where("id < other").select(F.col("id").alias("id_a"), F.col("other").alias("id_b"))
        linked = self.links.select("id_a").union(self.links.select("id_b")).distinct()
        own = m.join(linked.withColumnRenamed("id_a", "head"), "head", "left_semi")  # sets with copies; the others are their own head
        x = self.links.join(own.select(F.col("head").alias("id_a"), F.col("id").alias("x")), "id_a", "left").withColumn("x", F.coalesce("x", "id_a"))
        x = x.join(own.select(F.col("head").alias("id_b"), F.col("id").alias("y")), "id_b", "left").withColumn("y", F.coalesce("y", "id_b"))
        return copies.unionByName(x.select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b")))

    def groups(self) -> DataFrame:
        """A row per id: ``class_id`` (the least id that links lead to), ``copies`` with the same set, ``links`` to other sets."""
        head = self.classes.groupBy(*self._same).agg(F.min("id").alias("head"), F.count(F.lit(1)).alias("copies"))
        ends = self.links.select(F.col("id_a").alias("head")).unionByName(self.links.select(F.col("id_b").alias("head")))
        degree = ends.groupBy("head").agg(F.count(F.lit(1)).alias("links"))
        roots = connected_components(self.links, "id_a", "id_b")
        least = roots.groupBy("root").agg(F.min("node").alias("class_id"))
        of = roots.join(least, "root").select(F.col("node").alias("head"), "class_id")
        head = head.join(degree, "head", "left").join(of, "head", "left")
        empty = self.classes.where("n = 0").select("id", F.col("id").alias("class_id"), F.lit(1).cast("bigint").alias("copies"), F.lit(0).cast("bigint").alias("links"))
        rest = self.classes.where("n > 0").join(head, self._same).select("id", F.coalesce("class_id", "head").alias("class_id"), "copies", F.coalesce("links", F.lit(0).cast("bigint")).alias("links"))
        return rest.unionByName(empty)


def similar_sets(texts: DataFrame, id: str = "id", text: str = "text", k: int = 3, threshold: float = 0.6) -> SimilarSets:
    """All pairs of texts whose sets of ``k``-grams of words have a Jaccard similarity of ``threshold`` or more: exact, without loss.

    Equal sets are one class, whatever their number. N-grams have one global order, rare ones first by a hashed frequency table
    that grows with the texts up to 16 MB. A set is a path of n-grams in that order; two similar sets meet at an n-gram among the
    first ``n - ceil(threshold * n) + 1`` of both. Paths are cut by buckets of n-grams and sent there. A bucket builds a prefix tree
    below each n-gram that several sets have: their lengths, then the next n-grams of their paths that lie in the bucket, common
    ones once. It is joined with itself by going down two subtrees at a time, with one account of the overlap for all sets
    below them, and cut where lengths or the remaining paths can't give the overlap that is needed; what lies below the last level is
    a signature of 256 bits, the bits in which two differ bound their overlap. The pairs that remain are compared in full. An
    n-gram with more than 20,000 sets is split into cells for pairs of parts, which lie in different buckets.

    Rows with a null id are left out, of rows with one id the least text counts, null and empty texts and those of fewer than
    ``k`` words have no n-grams and no partner. ``texts`` may be empty.
    """
    spark = texts.sparkSession
    base = texts.where(F.col(id).isNotNull()).select(F.col(id).cast("string").alias("id"), F.col(text).alias("text")).groupBy("id").agg(F.min("text").alias("text"))
    base = materialise(base, "texts")
    size = base.agg(F.sum(F.octet_length("text").cast("bigint"))).first()[0] or 0
    bits = max(LEAST_BITS, min(MOST_BITS, (size // 48).bit_length()))  # some six bytes a word, eight n-grams a cell
    first = materialise(base.mapInArrow(_survey(k, bits), "id string, k1 bigint, k2 bigint, n int, chunk int, counts binary"), "survey")
    classes = first.where("id is not null").select("id", "k1", "k2", "n")
    level = np.zeros(1 << bits, np.uint8)
    for c, x in first.where("chunk is not null").select("chunk", "counts").repartition("chunk").mapInArrow(_merge, "chunk int, levels binary").collect():
        level[c * CHUNK : (c + 1) * CHUNK] = np.frombuffer(x, np.uint8)
    levels = spark.sparkContext.broadcast(level)
    buckets = max(spark.sparkContext.defaultParallelism, -(-classes.count() // BUCKET_SETS))
    routed = base.select("text").mapInArrow(_route(levels, bits, buckets, k, threshold), "bucket int, k1 bigint, k2 bigint, n int, signature binary, grams binary, places binary")
    pairs = routed.repartitionById(buckets, F.col("bucket")).mapInArrow(_join(threshold), "a1 bigint, a2 bigint, b1 bigint, b2 bigint").distinct()
    heads = classes.where("n > 0").groupBy("k1", "k2").agg(F.min("id").alias("id"))
    a = heads.select(F.col("k1").alias("a1"), F.col("k2").alias("a2"), F.col("id").alias("x"))
    b = heads.select(F.col("k1").alias("b1"), F.col("k2").alias("b2"), F.col("id").alias("y"))
    asked = materialise(pairs.join(a, ["a1", "a2"]).join(b, ["b1", "b2"]).select("x", "y"), "candidates")
    ids = asked.select(F.col("x").alias("id")).union(asked.select("y"))
    marked = max(16, min(27, int(asked.count() * 16).bit_length()))  # beyond 8 million links more sets than needed are looked up
    at = F.pmod(F.xxhash64("id"), F.lit(1 << marked))  # as unsigned, in the workers
    marks = ids.select(at.alias("p")).groupBy(F.shiftright("p", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("v")).toPandas()
    bitmap = np.zeros(1 << (marked - 6), np.uint64)
    bitmap[marks["w"].to_numpy(np.int64)] = marks["v"].to_numpy(np.int64).view(np.uint64)
    sets = base.select("id", "text", F.xxhash64("id").alias("h")).mapInArrow(_sets_of(spark.sparkContext.broadcast(bitmap), marked, k), "id string, grams array<bigint>")
    hot = hot_keys(ids, "id")
    x = salted_join(asked, sets.select(F.col("id").alias("x"), F.col("grams").alias("gx")), "x", hot, F.col("y"))
    x = salted_join(x, sets.select(F.col("id").alias("y"), F.col("grams").alias("gy")), "y", hot, F.col("x"))
    both = F.size(F.array_intersect("gx", "gy"))
    x = x.select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"), both.alias("both"), (F.size("gx") + F.size("gy")).alias("total"))
    links = x.withColumn("similarity", F.col("both") / (F.col("total") - F.col("both"))).where(F.col("similarity") >= threshold)
    return SimilarSets(classes, materialise(links.select("id_a", "id_b", "similarity"), "links"))


def example_texts(examples: DataFrame, requests: DataFrame) -> DataFrame:
    """``id, text``: an example's request's seed topic, its user text and its think texts in turn order, joined by a blank."""
    said = F.concat(F.transform(F.filter("turns", lambda t: t["role"] == "user"), lambda t: t["text"]), F.transform(F.filter("turns", lambda t: t["role"] == "assistant"), lambda t: t["think"]))
    e = examples.where("id is not null").select("id", F.array_join(said, " ", "").alias("said")).groupBy("id").agg(F.min("said").alias("said"))
    r = requests.where("id is not null and seed_topic is not null").groupBy("id").agg(F.max_by("seed_topic", "loaded_utc").alias("topic"))
    return e.join(r, "id", "left").select("id", F.concat_ws(" ", F.coalesce("topic", F.lit("")), F.coalesce("said", F.lit(""))).alias("text"))
