"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import discard, hub_join, lean, settle


#: Edges that a task unites at once.
EDGES = 1 << 20


def _union(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Union-find over up to EDGES edges at a time: they become stars around the smallest node reached."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= EDGES:
            yield _stars(held)
            held, n = [], 0
    if held:
        yield _stars(held)


def _stars(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    a, b = (np.concatenate([x.column(i).to_numpy(zero_copy_only=False) for x in batches]) for i in (0, 1))
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    parent = np.arange(len(nodes))
    while len(x):  # trees are hooked onto smaller ones, then flattened, until no edge joins two
        one, two = parent[x], parent[y]
        apart = one != two
        x, y, one, two = x[apart], y[apart], one[apart], two[apart]
        np.minimum.at(parent, np.maximum(one, two), np.minimum(one, two))
        while (up := parent[parent]).tobytes() != parent.tobytes():
            parent = up
    root = nodes[parent]
    own = root != nodes
    return pa.RecordBatch.from_arrays([pa.array(nodes[own]), pa.array(root[own])], ["u", "v"])


def _is_stars(edges: DataFrame) -> bool:
    """Whether each node has one edge to a smaller node, and that has none."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("v").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    return ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or (up = 1 and down = 1)").isEmpty()


def _least(both: DataFrame) -> DataFrame:
    return both.groupBy("u").agg(F.min("v").alias("m"))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of edges (two long columns): root is the smallest node of its component.

    Union-find over up to EDGES edges in a task first, then star steps over the shuffled rest until each component is
    a star (Kiveris et al., 2014: a logarithmic number of rounds in practice). Minima are
    pre-aggregated; a hub's edges meet its minimum by a broadcast of bounded size.
    Null ends and loops are ignored; an empty table gives an empty result. edges is read twice: a settled table is best.
    """
    a, b = edges.columns[:2]
    plain = edges.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")).where("a <> b")
    now = settle(plain.coalesce(max(1, -(-edges.count() // EDGES))).mapInArrow(lean(_union), "u long, v long").distinct())
    while not _is_stars(now):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = hub_join(both, _least(both), "u").where("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v")).distinct()
        small = large.join(_least(large), "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").where("u > v").distinct()
        after = settle(small)
        discard(now)
        now = after
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())

