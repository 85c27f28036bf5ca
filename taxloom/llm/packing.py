"""Conflict-constrained best-fit packing of documents into bins of one size."""

from __future__ import annotations

from bisect import bisect_left, insort

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import settle


def best_fit(lengths: list[int], sources: list, clusters: list, capacity: int) -> list[int]:
    """The bin of each item, taken longest first (the order given).

    Open bins are ordered by what is left in them. Each carries a bitmap of its sources and one of its
    duplicate clusters. From the first bin with room enough, successors are tried until one holds neither the
    item's source nor its cluster: the tightest compatible bin. Without one, a bin is opened. A null conflicts with nothing.
    """
    source_bit = {s: 1 << i for i, s in enumerate(dict.fromkeys(s for s in sources if s is not None))}
    cluster_bit = {c: 1 << i for i, c in enumerate(dict.fromkeys(c for c in clusters if c is not None))}
    open_bins: list[tuple[int, int]] = []
    has_source, has_cluster, out = [], [], []
    for length, source, cluster in zip(lengths, sources, clusters, strict=True):
        s, c = source_bit.get(source, 0), cluster_bit.get(cluster, 0)
        at = bisect_left(open_bins, (length, -1))
        while at < len(open_bins) and (has_source[open_bins[at][1]] & s or has_cluster[open_bins[at][1]] & c):
            at += 1
        if at < len(open_bins):
            left, b = open_bins.pop(at)
        else:
            left, b = capacity, len(has_source)
            has_source.append(0)
            has_cluster.append(0)
        has_source[b] |= s
        has_cluster[b] |= c
        if left > length:
            insort(open_bins, (left - length, b))
        out.append(b)
    return out


def pack(docs: DataFrame, *, classes: DataFrame | None = None, capacity: int = 8192, group_rows: int = 4096) -> DataFrame:
    """(doc_id, segment, start, length, bin_id, place) of every segment of every document.

    A text of more than capacity characters is cut into segments of capacity and a rest. Two segments in a
    bin never have the same source or the same duplicate cluster: the class of classes (node, root), as near_classes() gives it, for texts in one,
    else equal texts. Segments are dealt by hash into groups of about group_rows, each packed by itself in one task, longest first: a bin is never
    shared between groups, which costs a fraction of a bin a group. Only lengths and keys are shuffled, not texts.
    start counts characters from 0; place is the order in a bin.

    Null and empty texts get one row of length 0 with null bin_id and place. A null source or doc_id conflicts with
    nothing. Repeated rows are items of their own (and never share a bin, being of one cluster). Other columns are
    ignored. Empty table: no rows.
    """
    light = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.xxhash64("text").alias("node"), F.coalesce(F.length("text"), F.lit(0)).alias("chars"))
    light = light.withColumnRenamed("node", "cluster") if classes is None else light.join(classes.select("node", "root"), "node", "left").withColumn("cluster", F.coalesce("root", "node")).drop("node", "root")
    light = settle(light)
    items = light.withColumn("segment", F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(F.col("chars") / capacity) - 1, F.lit(0)).cast("int"))))
    items = items.withColumn("start", F.col("segment") * capacity).withColumn("length", F.least(F.col("chars") - F.col("start"), F.lit(capacity))).drop("chars")
    segments = light.agg(F.sum(F.ceil(F.col("chars") / capacity))).first()[0] or 0
    groups = max(1, -(-segments // group_rows))
    dealt = items.where("length > 0").withColumn("part", F.pmod(F.xxhash64("doc_id", "segment", "cluster"), F.lit(groups)))

    def packed(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "doc_id", "segment", "cluster"], ascending=[False, True, True, True], kind="stable")
        sources = [None if pd.isna(s) else s for s in rows["source"]]
        bins = pd.Series(best_fit(rows["length"].tolist(), sources, rows["cluster"].tolist(), capacity), index=rows.index, dtype="int64")
        place = bins.groupby(bins).cumcount()
        return rows[["doc_id", "segment", "start", "length"]].assign(bin_id=rows["part"] * (1 << 32) + bins, place=place.astype("int32"))

    schema = "doc_id long, segment int, start int, length int, bin_id long, place int"
    none = items.where("length = 0").select("doc_id", "segment", "start", "length", F.lit(None).cast("long").alias("bin_id"), F.lit(None).cast("int").alias("place"))
    return dealt.groupBy("part").applyInPandas(packed, schema).unionByName(none)
