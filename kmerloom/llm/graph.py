"""Connected components of links. The links never leave the cluster."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Links that a task contracts at once, and at most as many are settled in one task: about 50 bytes each.
AT_ONCE = 1_000_000


def roots_of(a: np.ndarray, b: np.ndarray, own: np.ndarray | None = None) -> np.ndarray:
    """The least node reachable from each of the nodes 0 to n - 1 by the edges (a, b); `own` are roots found before."""
    root = np.arange(int(max(a.max(initial=-1), b.max(initial=-1))) + 1) if own is None else own.copy()
    while True:
        x, y = root[a], root[b]
        apart = x != y
        if not apart.any():
            return root
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (deep := root[root] != root).any():
            root[deep] = root[root[deep]]


def _contracted(batches):
    """The links of a task as stars around the least node of each part; AT_ONCE links at a time."""
    import pyarrow as pa

    held: list = []

    def stars():
        a, b = (np.concatenate([h[k] for h in held]) for k in (0, 1))
        held.clear()
        nodes, place = np.unique(np.concatenate([a, b]), return_inverse=True)
        root = nodes[roots_of(place[: len(a)], place[len(a) :], np.arange(len(nodes)))]
        far = root != nodes
        return pa.RecordBatch.from_pydict({"a": nodes[far], "b": root[far]})

    for batch in batches:
        held.append((batch.column("a").to_numpy(), batch.column("b").to_numpy()))
        if sum(len(a) for a, _ in held) > AT_ONCE:
            yield stars()
    if held:
        yield stars()


def contracted(edges: DataFrame) -> DataFrame:
    """Fewer links (a > b) with the same components: each task's as stars."""
    return edges.select("a", "b").mapInArrow(_contracted, "a bigint, b bigint")


def _star_round(edges: DataFrame, rows: int) -> DataFrame:
    """Hang each node's larger neighbours, then its smaller ones and itself, on its least neighbour; edges run from larger to smaller."""

    def least(e: DataFrame) -> DataFrame:
        return common.counted_broadcast(e.groupBy(F.col("a").alias("_v")).agg(F.min("b").alias("_m")), rows)

    large = edges.join(least(edges), F.col("b") == F.col("_v"), "left").select("a", F.coalesce("_m", "b").alias("b"))
    moved = large.join(least(large), F.col("a") == F.col("_v"))
    pairs = F.array(F.struct(F.col("a").alias("a"), F.col("_m").alias("b")), F.struct(F.col("b").alias("a"), F.col("_m").alias("b")))
    return moved.select(F.explode(pairs).alias("e")).select("e.a", "e.b").filter("a <> b").distinct()


def components(scratch: common.Scratch, edges: DataFrame, bound: int = AT_ONCE) -> DataFrame:
    """(node, root) for every node of the links (a, b); root is the component's smallest node.

    Every task first contracts its own links. Up to `bound` links (counted) then go to one task, as they would for
    a broadcast; more are settled by rounds of alternating stars.
    """
    edges = scratch.save(contracted(edges))
    rows = edges.count()
    if rows <= bound:
        now = scratch.save(contracted(edges.coalesce(1)))
        scratch.drop(edges)
        edges = now
    else:
        while True:
            now = scratch.save(_star_round(edges, edges.count()))
            scratch.drop(edges)
            edges = now
            rows = edges.count()
            inner = edges.join(common.counted_broadcast(edges.select(F.col("a").alias("b")).distinct(), rows), "b", "left_semi")
            if not inner.limit(1).count() and rows == edges.select("a").distinct().count():
                break
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
