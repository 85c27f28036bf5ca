"""Families of near-equal texts: banded MinHash buckets, pruned link forests, exact blockwise verification.

No step emits all pairs of a group. A bucket or family with more members than `block` is dealt over
block pairs, so that each task holds two blocks at most; a task emits a spanning forest and counts.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .scratch import discard, hub_join, lean, runtime_filters, settle, small_join
from .shingles import Shingles, pieces

#: (hashes compared so far, least matches with which a pair goes on).
Floors = list[tuple[int, int]]


def posterior_floors(threshold: float, tolerance: float, hashes: int, step: int) -> Floors:
    """BayesLSH's test (Satuluri & Parthasarathy, 2012) as a table.

    With a uniform prior, P(similarity >= threshold | m of n hashes agree) is the chance that a
    binomial (n + 1, threshold) count is at most m; below tolerance, the pair is dropped.
    """
    floors = []
    for n in range(step, hashes + 1, step):
        tail, m = 0.0, 0
        for m in range(n + 1):
            tail += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if tail >= tolerance:
                break
        floors.append((n, m))
    return floors


def agreeing(one: np.ndarray, many: np.ndarray, floors: Floors) -> np.ndarray:
    """Rows of many that may be near one: hashes are compared a step at a time, among those not yet dropped."""
    alive, matches, done = np.arange(len(many)), np.zeros(len(many), np.int64), 0
    for n, least in floors:
        matches = matches + (many[alive, done:n] == one[done:n]).sum(1)
        keep = matches >= least
        alive, matches, done = alive[keep], matches[keep], n
        if not len(alive):
            break
    return alive


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups of the first columns, by which the rows are sorted, and where groups begin (and the last ends)."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(keys)]
        new = np.zeros(batch.num_rows, bool)
        new[0] = not held or any(c[0] != held[-1].column(i)[-1].as_py() for i, c in enumerate(cols))
        for c in cols:
            new[1:] |= c[1:] != c[:-1]
        cut = np.flatnonzero(new)
        if len(cut):
            held.append(batch.slice(0, cut[-1]))
            if table := _table(held):
                yield table, _starts(table, keys)
            held = []
        held.append(batch.slice(cut[-1] if len(cut) else 0))
    if table := _table(held):
        yield table, _starts(table, keys)


def _table(held: list[pa.RecordBatch]) -> pa.Table | None:
    rows = [b for b in held if b.num_rows]
    return pa.Table.from_batches(rows).combine_chunks() if rows else None


def _starts(table: pa.Table, keys: int) -> np.ndarray:
    new = np.zeros(table.num_rows + 1, bool)
    new[[0, -1]] = True
    for i in range(keys):
        c = table.column(i).to_numpy()
        new[1:-1] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, width)


def _linker(hashes: int, floors: Floors) -> Callable:
    """mapInArrow function from bucket members (key, bi, bj, node, sig) to a forest (a, b) of the links that aren't pruned."""

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in _groups(batches, 3):
            nodes, sigs = table.column("node").to_numpy(), _matrix(table.column("sig"), hashes)
            two = starts[:-1][np.diff(starts) == 2]
            near = np.ones(len(two), bool)
            for n, least in floors:
                near &= (sigs[two, :n] == sigs[two + 1, :n]).sum(1) >= least
            ends = [(nodes[two[near]], nodes[two[near] + 1])]
            for s, e in zip(starts[:-1], starts[1:], strict=True):
                if e - s > 2:
                    rest, queue = np.arange(s, e), []
                    while len(rest):
                        i = queue.pop() if queue else rest[0]
                        rest = rest[rest != i]
                        got = agreeing(sigs[i], sigs[rest], floors)
                        ends.append((np.full(len(got), nodes[i]), nodes[rest[got]]))
                        queue += rest[got].tolist()
                        rest = np.delete(rest, got)
                    # what the queue still holds has nothing left to meet
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([x[i] for x in ends]), pa.int64()) for i in (0, 1)], ["a", "b"])

    return link


def _dealt(df: DataFrame, by: str, n: Column, block: int) -> DataFrame:
    """Adds (bi, bj): a member of a group of n rows goes to every pair of blocks that holds its own block."""
    k = F.greatest(F.ceil(n / block), F.lit(1)).cast("int")
    own = F.pmod(F.xxhash64("node", by), k).cast("int")
    return df.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), k - 1))).withColumn("bi", F.least("own", "other")).withColumn("bj", F.greatest("own", "other")).drop("other")


def candidates(sigs: DataFrame, hashes: int, rows: int, floors: Floors, block: int = 512) -> DataFrame:
    """(node, root) of texts with a possible link: components of the links that survive pruning within buckets.

    sigs: (node long, sig binary), a node perhaps several times. A bucket is a band of `rows` hashes.
    """
    width = 2 * rows
    bands = [F.xxhash64(F.lit(i), F.substring("sig", 1 + i * width, width)) for i in range(hashes // rows)]
    keys = sigs.select("node", F.explode(F.array(*bands)).alias("key"))
    with runtime_filters(sigs.sparkSession):  # most buckets hold one text; their rows needn't be shuffled twice
        crowded = settle(keys.groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo < hi").select("key", "n")).where("n > 1")
        members = settle(small_join(keys, crowded, "key").distinct())
        nodes = settle(members.select("node").distinct())
        own = small_join(sigs, nodes, "node", "left_semi").dropDuplicates(["node"])
        dealt = _dealt(members, "key", F.col("n"), block).join(own, "node").select("key", "bi", "bj", "node", "sig")
        links = settle(dealt.repartition("key", "bi", "bj").sortWithinPartitions("key", "bi", "bj").mapInArrow(lean(_linker(hashes, floors)), "a long, b long"))
    found = settle(components(links))
    discard(crowded, members, nodes, links)
    return found


def _verifier(shingle: Callable[[list[str | None]], Shingles], hashes: int, floors: Floors, threshold: float, counting: bool) -> Callable:
    """mapInArrow function from members (root, bi, bj, own, node, group, sig, text) to (a, b, links).

    Each pair of different texts is looked at in one task: pruned by signatures, then its exact
    Jaccard similarity is compared. Out go a forest of the links (a, b, 0) and, if counting, each text's links found here (a, null, links).
    Without counting, texts of one group, or already connected in the task, aren't compared.
    """

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in _groups(batches, 3):
            texts = table.column("text").to_pylist()
            lengths = np.array([len(t or "") for t in texts])
            sizes = np.add.reduceat(lengths, starts[:-1])
            for first, last in _spans(sizes):
                yield from _verified(table.slice(starts[first], starts[last] - starts[first]), starts[first : last + 1] - starts[first], texts[starts[first] : starts[last]])

    def _spans(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
        first = held = 0
        for i, s in enumerate(sizes):
            held += s
            if held >= 1 << 19:
                yield first, i + 1
                first, held = i + 1, 0
        if first < len(sizes):
            yield first, len(sizes)

    def _verified(table: pa.Table, starts: np.ndarray, texts: list) -> Iterator[pa.RecordBatch]:
        nodes, owns, sigs = table.column("node").to_numpy(), table.column("own").to_numpy(), _matrix(table.column("sig"), hashes)
        bi, bj, groups = (table.column(c).to_numpy() for c in ("bi", "bj", "group"))
        sets: list[np.ndarray] = []
        for a, b in pieces(texts):
            values, at = shingle(texts[a:b])
            sets += [np.unique(values[s:e]) for s, e in zip(at[:-1], at[1:], strict=True)]
        out_a, out_b, out_n = [], [], []
        for s, e in zip(starts[:-1], starts[1:], strict=True):
            order = s + np.unique(nodes[s:e], return_index=True)[1]  # a text may come once from each partition
            if len(order) < 2:
                continue
            own, cross = [sets[i] for i in order], bi[s] != bj[s]
            vocabulary, ids = np.unique(np.concatenate(own), return_inverse=True)
            size = np.array([len(x) for x in own])
            ends = np.cumsum(size)
            links, there = np.zeros(len(order), np.int64), np.zeros(len(vocabulary), np.int64)
            label = np.arange(len(order)) if counting else np.unique(groups[order], return_inverse=True)[1]
            for x in range(len(order) - 1):
                rest = np.arange(x + 1, len(order))
                if cross:
                    rest = rest[owns[order[rest]] != owns[order[x]]]
                if not counting:
                    rest = rest[label[rest] != label[x]]
                rest = rest[agreeing(sigs[order[x]], sigs[order[rest]], floors)]
                rest = rest[np.minimum(size[rest], size[x]) >= threshold * np.maximum(size[rest], size[x])]
                if not len(rest):
                    continue
                there[ids[ends[x] - size[x] : ends[x]]] = 1
                at = np.cumsum(size[rest]) - size[rest]
                shared = np.add.reduceat(there[np.concatenate([ids[ends[y] - size[y] : ends[y]] for y in rest])], at)
                there[ids[ends[x] - size[x] : ends[x]]] = 0
                near = rest[shared >= threshold * (size[rest] + size[x] - shared) - 1e-9]
                links[x] += len(near)
                links[near] += 1
                for y in near.tolist():
                    if label[x] != label[y]:
                        label[label == label[y]] = label[x]
                        out_a.append(nodes[order[x]]), out_b.append(nodes[order[y]]), out_n.append(0)
            for x in np.flatnonzero(links) if counting else ():
                out_a.append(nodes[order[x]]), out_b.append(None), out_n.append(links[x])
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (out_a, out_b, out_n)], ["a", "b", "links"])

    return verify


def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first row of each node (the first column) in a partition: a large group of copies shrinks before it's dealt."""
    seen: set[int] = set()
    for batch in batches:
        keep = []
        for i, node in enumerate(batch.column(0).to_pylist()):
            if node not in seen:
                seen.add(node)
                keep.append(i)
        yield batch.take(pa.array(keep, pa.int64()))


def classes(texts: DataFrame, sigs: DataFrame, shingle: Callable, hashes: int, rows: int, floors: Floors, threshold: float, block: int = 256, counting: bool = True) -> DataFrame:
    """(node, root, links) of every text with a near text: its class's least node, and its number of links (null unless counting).

    texts: (node long, text string), any number of rows for a node, read anew for the texts in question only. Counting
    compares all pairs of a family. Else a family is dealt once, each block with the family's first text, which mostly connects it;
    only where a family of several blocks stays in parts are the parts compared, each text outside the largest with all others.
    """
    spark = texts.sparkSession
    loose = candidates(sigs, hashes, rows, floors)
    wanted = settle(hub_join(loose, loose.groupBy("root").agg(F.count("*").alias("n")), "root", "n"))
    asked = wanted.where("n > 1")  # true of all; a filter is what lets Spark make a runtime filter of it
    own = small_join(sigs, loose.select("node"), "node", "left_semi").dropDuplicates(["node"])

    def verified(members: DataFrame) -> DataFrame:
        """members: node, text, root, bi, bj, own, group."""
        dealt = members.join(own, "node").select("root", "bi", "bj", "own", "node", "group", "sig", "text")
        with runtime_filters(spark):  # most texts have no near text; they needn't be shuffled to learn that
            return settle(dealt.repartition("root", "bi", "bj").sortWithinPartitions("root", "bi", "bj").mapInArrow(lean(_verifier(shingle, hashes, floors, threshold, counting)), "a long, b long, links long"))

    text = lambda of: small_join(texts, of, "node").select("node", "text", *[c for c in of.columns if c != "node"]).mapInArrow(once, f"node long, text string, {', '.join(f'{c} long' for c in of.columns if c != 'node')}")
    if counting:
        found = verified(_dealt(text(asked), "root", F.col("n"), block).withColumn("group", F.col("node")))
        links = found.where("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
        return components(found.where("b is not null").select("a", "b")).join(links, "node")
    k = F.ceil(F.col("n") / block).cast("int")
    first = F.when(F.col("node") == F.col("root"), F.sequence(F.lit(0), k - 1)).otherwise(F.array(F.pmod(F.xxhash64("node"), k).cast("int")))
    found = verified(text(asked).withColumn("bi", F.explode(first)).withColumns({"bj": F.col("bi"), "own": F.col("bi"), "group": F.col("node")}))
    parts = settle(components(found.select("a", "b")))
    large = asked.where(F.col("n") > block)
    parted = settle(large.join(parts.withColumnRenamed("root", "group"), "node", "left").withColumn("group", F.coalesce("group", "node")))
    sizes = parted.groupBy("root", "group").agg(F.count("*").alias("m")).groupBy("root").agg(F.max_by("group", F.struct("m", "group")).alias("main"), F.max("m").alias("m"), F.count("*").alias("groups"))
    open_ = settle(hub_join(parted, sizes.where("groups > 1").select("root", "main", "m"), "root"))
    if not open_.isEmpty():
        j, m = F.ceil((F.col("n") - F.col("m")) / block).cast("int"), F.ceil(F.col("m") / block).cast("int")
        inside = F.col("group") == F.col("main")
        own_block = F.when(inside, j + F.pmod(F.xxhash64("node"), m)).otherwise(F.pmod(F.xxhash64("node"), j)).cast("int")
        dealt = text(open_).withColumn("own", own_block).withColumn("other", F.explode(F.sequence(F.lit(0), F.when(inside, j - 1).otherwise(j + m - 1))))
        more = verified(dealt.withColumns({"bi": F.least("own", "other"), "bj": F.greatest("own", "other")}))
        parts = settle(components(found.unionByName(more).select("a", "b")))
    return parts.withColumn("links", F.lit(None).cast("long"))
