"""Connected components of an edge table, by repeated contraction."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

#: A key with over one HOT-th of the rows is no key of a shuffle; there are fewer than HOT of them.
HOT = 1000
#: Edges (16 bytes each) that are left when one task finishes the rest, at most.
LOCAL = 1 << 20


def forest(u: np.ndarray, v: np.ndarray, n: int) -> np.ndarray:
    """The least node of the component of each of the nodes 0 to n - 1, by edges u to v."""
    root = np.arange(n)
    while (keep := root[u] != root[v]).any():
        u, v = u[keep], v[keep]
        low = np.minimum(root[u], root[v])
        np.minimum.at(root, root[u], low)
        np.minimum.at(root, root[v], low)
        while (root != root[root]).any():
            root = root[root]
    return root


def _finished(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    ends = [np.stack([batch.column(0).to_numpy(), batch.column(1).to_numpy()]) for batch in batches]
    if ends:
        nodes, at = np.unique(np.concatenate(ends, axis=1), return_inverse=True)
        u, v = at.reshape(2, -1)
        yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[forest(u, v, len(nodes))])], ["node", "root"])


def _often(rows: DataFrame, key: str) -> DataFrame:
    """The keys of a written table that have over one HOT-th of its rows."""
    return rows.groupBy(key).count().where(F.col("count") * HOT > rows.count()).select(key)


def _labelled(rows: DataFrame, key: str, often: DataFrame, labels: DataFrame, name: str) -> DataFrame:
    """rows with the root, as `name`, that labels (node, root) has for their `key`; null where there is none.

    Rows of the keys in `often` (key), fewer than HOT, get it from a table that every task has, and the others by a
    shuffle, of which no key has more than one HOT-th.
    """
    of = labels.select(F.col("node").alias(key), F.col("root").alias(name))
    hot = F.broadcast(written(often.join(of.join(F.broadcast(often), key, "left_semi"), key, "left"), "hot"))
    return rows.join(hot, key).unionByName(rows.join(hot.select(key), key, "left_anti").join(of, key, "left"))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges (u, v), both long; root is one node of the component, the same for all.

    In every round nodes have a new random order, each points to the least of itself and its neighbours, and the edges
    between what they point to stay. A node stays with odds of a half at most, so rounds grow with the logarithm of the
    number of nodes, whatever the ids along a chain. Once LOCAL edges or fewer are left, one task contracts these. Nothing
    reaches the driver but numbers of edges. A hub's edges are reduced by partial minima before the shuffle, and neither
    they nor the nodes of a large component meet in one task.
    Loops and repeated edges do no harm; no edges give no rows.
    """
    edges = written(edges.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "edges")
    steps = []
    while edges.count() > LOCAL:
        placed = lambda node: F.struct(F.xxhash64(F.lit(len(steps)), node).alias("place"), F.col(node).alias("node"))  # noqa: B023, E731
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min(placed("v")).alias("least"))
        step = written(least.select(F.col("u").alias("node"), F.least(placed("u"), "least")["node"].alias("root")), "step")
        ends = _labelled(_labelled(edges, "u", _often(edges, "u"), step, "a"), "v", _often(edges, "v"), step, "b")
        edges = written(ends.where("a <> b").select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct(), "edges")
        steps.append(step)
    out, *more = [*steps, written(edges.coalesce(1).mapInArrow(_finished, "node long, root long"), "step")]
    for step in more:
        out = written(_labelled(out, "root", _often(out, "root"), step, "next").select("node", F.coalesce("next", "root").alias("root")), "roots")
    return out
