"""Connected components by randomised contraction, the contracted rest in one task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.operators.skew import lookup
from millrace.workspace import materialise, release

#: Links that one task takes at the end, some 100 MB with names of usual length. A graph with more is contracted first.
LAST_LINKS = 1_000_000


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The root of every node of at most LAST_LINKS links: the larger root is hung under the smaller, then paths are halved."""
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    whole = pa.Table.from_batches(held)
    n = whole.num_rows
    ends = pa.concat_arrays([c for name in ("u", "v") for c in whole.column(name).chunks]).dictionary_encode()
    code = ends.indices.to_numpy().astype(np.int64)
    u, v, root = code[:n], code[n:], np.arange(len(ends.dictionary))
    while True:
        a, b = root[u], root[v]
        apart = a != b
        if not apart.any():
            break
        u, v, a, b = u[apart], v[apart], a[apart], b[apart]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
    yield from pa.table({"node": ends.dictionary, "root": ends.dictionary.take(pa.array(root))}).to_batches(max_chunksize=100_000)


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", seed: int = 5) -> DataFrame:
    """``node, root``: two nodes have the same root if edges lead from one to the other. Nodes without an edge to another have no row.

    In every round each node takes the name of the node with the least hash among itself and its neighbours, with another
    hash each time; edges are renamed, loops and repeats dropped. Nodes are expected to shrink by a constant factor each
    round, whatever the shape of the graph. Neighbours are never collected, only their minimum, which is combined before the
    shuffle; nodes with a large part of all edges are renamed by broadcast. Each round is written to the shared folder, and the
    tables of the round before are deleted. As soon as no more than LAST_LINKS links are left, one task of an executor settles
    them; the driver sees none. Null ends, loops and repeated edges are ignored; ``root`` is some node of the component.
    """
    x, y = F.col(a), F.col(b)
    e = edges.where(x.isNotNull() & y.isNotNull() & (x != y)).select(F.least(x, y).alias("u"), F.greatest(x, y).alias("v")).distinct()
    e = materialise(e, "edges")
    kind = e.schema["u"].dataType.simpleString()
    maps: list[DataFrame] = []
    while (n := e.count()) > LAST_LINKS:
        def h(c: str, k: int = len(maps)):
            return F.xxhash64(F.col(c), F.lit(seed + k))

        both = e.select(F.col("u").alias("node"), F.col("v").alias("other")).unionByName(e.select(F.col("v").alias("node"), F.col("u").alias("other")))
        best = both.groupBy("node").agg(F.min(F.struct(h("other").alias("h"), F.col("other").alias("n"))).alias("m"))
        own = F.struct(h("node").alias("h"), F.col("node").alias("n"))
        step = materialise(best.select("node", F.least(own, F.col("m"))["n"].alias("root")), "names")
        maps.append(step)
        one = lookup(e.withColumnRenamed("u", "node"), step, "node", "inner").select(F.col("root").alias("u"), F.col("v").alias("node"))
        two = lookup(one, step, "node", "inner").select("u", F.col("root").alias("v"))
        rest = materialise(two.where("u != v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "edges")
        release(e)
        e = rest
    if n or not maps:
        maps.append(materialise(e.coalesce(1).mapInArrow(_settle, f"node {kind}, root {kind}"), "names"))
    release(e)
    roots = maps[-1]
    for step in reversed(maps[:-1]):
        up = roots.select(F.col("node").alias("root"), F.col("root").alias("top"))
        above = roots
        roots = materialise(lookup(step, up, "root").select("node", F.coalesce("top", "root").alias("root")), "roots")
        release(step, above)
    return roots
