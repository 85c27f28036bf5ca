"""K-d tree sharding of documents to shards of near equal bytes."""

from __future__ import annotations

import heapq
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import discard, hub_join, settle

#: Bits of a coordinate, and of each of the two parts of the hash that orders rows of one coordinate.
BITS = 12
CELLS = 1 << BITS
DIMENSIONS = ("c_size", "c_lang", "c_source")


@dataclass
class Node:
    """Shards first to first + shards - 1; before a cut, all rows of the node."""

    first: int
    shards: int
    dimension: str = ""
    prefix: int = 0  # of the cut key, as far as it is known
    below: int = 0  # bytes of the keys under that prefix


def _choose(nodes: dict[int, Node], pick) -> Column:
    """A value for each row by its node."""
    chain = None
    for k, node in nodes.items():
        chain = F.when(F.col("node") == k, pick(node)) if chain is None else chain.when(F.col("node") == k, pick(node))
    return chain


def _cut(rows: DataFrame, nodes: dict[int, Node], extent: dict[str, int], room: list[float]) -> DataFrame:
    """Splits each of nodes along its widest dimension at the weighted median of its keys (or the fraction that its left shards have of the room).

    A key is a coordinate and 24 bits of a hash. It is found in three steps of 12 bits; a step sums bytes by
    node and cell in one pass, and at most 4096 sums of each node reach the driver.
    """
    here = rows.where(F.col("node").isin(list(nodes)))
    spans = here.groupBy("node").agg(F.sum("size").alias("bytes"), *[(F.max(c) - F.min(c)).alias(c) for c in DIMENSIONS]).collect()
    total = {}
    for r in spans:
        total[r.node] = r.bytes
        nodes[r.node].dimension = max(DIMENSIONS, key=lambda c: r[c] / max(1, extent[c]))
    nodes_now = {k: n for k, n in nodes.items() if k in total}
    if not nodes_now:
        return rows
    key = _choose(nodes_now, lambda n: F.col(n.dimension).cast("long") * (1 << 2 * BITS) + F.col("tie"))
    keyed = here.withColumn("key", key)
    for step in (2, 1, 0):
        shift = 1 << step * BITS
        within = keyed if step == 2 else keyed.where(F.floor(F.col("key") / (shift * CELLS)) == _choose(nodes_now, lambda n: F.lit(n.prefix)))
        sums: dict[int, list] = {}
        for r in within.groupBy("node", F.pmod(F.floor(F.col("key") / shift), F.lit(CELLS)).alias("cell")).agg(F.sum("size").alias("bytes")).collect():
            sums.setdefault(r.node, []).append((r.cell, r.bytes))
        for k, n in nodes_now.items():
            mine = room[n.first : n.first + n.shards]
            target = total[k] * (sum(mine[: n.shards // 2]) / sum(mine) if sum(mine) else n.shards // 2 / n.shards)
            cells = sorted(sums[k])
            for i, (cell, size) in enumerate(cells):
                if n.below + size > target or i == len(cells) - 1:
                    over = step == 0 and n.below + size - target < target - n.below
                    n.below += size if over else 0
                    n.prefix = n.prefix * CELLS + cell + over
                    break
                n.below += size
    left = F.col("key") < _choose(nodes_now, lambda n: F.lit(n.prefix))
    key_all = _choose(nodes_now, lambda n: F.col(n.dimension).cast("long") * (1 << 2 * BITS) + F.col("tie"))
    right = _choose(nodes_now, lambda n: F.lit(n.first + n.shards // 2))
    return rows.withColumn("key", key_all).withColumn("node", F.when(F.col("key").isNull() | left, F.col("node")).otherwise(right)).drop("key")


def _place(groups: list[tuple[int, int]], shards: int) -> tuple[dict[int, int], list[int]]:
    """The shard of each (hash, bytes), the largest first into the emptiest shard, and the bytes that each shard then holds."""
    held = [(0, s) for s in range(shards)]
    at = {}
    for w, h in sorted(((w, h) for h, w in groups), reverse=True):
        load, s = heapq.heappop(held)
        heapq.heappush(held, (load + w, s))
        at[h] = s
    loads = [0] * shards
    for load, s in held:
        loads[s] = load
    return at, loads


def kd_shards(docs: DataFrame, *, shards: int = 24, together: float = 0.02, slot_rows: int = 20_000) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) of every document, under the law `bytes`.

    A document's size is its text's UTF-8 bytes plus 8. The tree's dimensions are metadata: the logarithm of the
    size, the language and the source. A node with several shards is cut along its widest dimension (against the
    whole table's extent) at the distributed weighted median, for an odd number of shards at the fraction of
    its left part, until each leaf is a shard. Rows of one coordinate are ordered by a hash of the text.

    Equal texts stay in one shard: they share the least language and source of their group, and the hash. A group of more
    bytes than `together` of a shard is placed before the tree is cut, the largest first into the emptiest shard, and the cuts leave its
    room (at most shards / together groups reach the driver). Only a group that no shard can hold, of more bytes than an equal share of the table, is cut like single
    documents, ordered by doc_id too. Slots count from 0 without gaps in a shard. grown_shard is null under this law.

    Null and empty texts have size 8; null lang, source or doc_id are a value of their own. Repeated rows are documents of their
    own. With fewer rows than shards, some shards are empty. Other columns are ignored. Empty table: no rows.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    light = settle(docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("h"),
        F.col("lang").cast("string").alias("lang"),
        F.col("source").cast("string").alias("source"),
    ))
    groups = settle(light.groupBy("h").agg(F.sum("size").alias("w"), F.count("*").alias("n"), F.min("lang").alias("lang"), F.min("source").alias("source")))
    whole = groups.agg(F.sum("w").alias("w"), F.sum("n").alias("n")).first()
    share = (whole.w or 0) / shards
    big = groups.where((F.col("n") > 1) & (F.col("w") > together * share) & (F.col("w") <= share)).select("h", "w").collect()
    at, loads = _place([(r.h, r.w) for r in big], shards)
    room = [max(0.0, share - x) for x in loads]
    fixed = docs.sparkSession.createDataFrame(list(at.items()), "h long, fixed int")
    code = lambda c: F.pmod(F.xxhash64(F.coalesce(F.col(c), F.lit("\0"))), F.lit(CELLS)).cast("int")
    tie = F.when(F.col("w") > share, F.xxhash64("h", "doc_id")).otherwise(F.xxhash64("h"))
    rows = (
        hub_join(light.drop("lang", "source"), groups.join(F.broadcast(fixed), "h", "left"), "h", "n")
        .select(F.coalesce(-1 - F.col("fixed"), F.lit(0)).alias("node"), "doc_id", "size", "text_crc32", "h", F.least(F.floor(F.log2("size") * 128), F.lit(CELLS - 1)).cast("int").alias("c_size"), code("lang").alias("c_lang"), code("source").alias("c_source"), F.pmod(tie, F.lit(CELLS * CELLS)).alias("tie"))
    )
    placed, leaves = settle(rows), [Node(0, shards)]  # a row of a placed group has the node -1 - shard, which is never cut
    extent = placed.agg(*[(F.max(c) - F.min(c)).alias(c) for c in DIMENSIONS]).first().asDict()
    extent = {c: v or 0 for c, v in extent.items()}
    while any(n.shards > 1 for n in leaves):
        cut = {n.first: n for n in leaves if n.shards > 1}
        before, placed = placed, settle(_cut(placed, cut, extent, room))
        discard(before)
        leaves = [x for n in leaves for x in ([n] if n.shards == 1 else [Node(n.first, n.shards // 2), Node(n.first + n.shards // 2, n.shards - n.shards // 2)])]
    parts = max(1, -(-(whole.n or 0) // (shards * slot_rows)))
    placed = settle(placed.select("doc_id", "size", "text_crc32", "h", F.when(F.col("node") < 0, -1 - F.col("node")).otherwise(F.col("node")).cast("int").alias("shard"), F.pmod(F.xxhash64("doc_id", "h"), F.lit(parts)).alias("part")))
    counts = placed.groupBy("shard", "part").agg(F.count("*").alias("n"))
    before = counts.withColumn("before", F.sum("n").over(Window.partitionBy("shard").orderBy("part")) - F.col("n")).drop("n")
    slot = F.row_number().over(Window.partitionBy("shard", "part").orderBy("doc_id", "h")) - 1
    return placed.withColumn("at", slot).join(before, ["shard", "part"]).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("before") + F.col("at")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
