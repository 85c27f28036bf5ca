"""Sources mixed to target weights by hash-threshold histograms, by built-in functions only.

A document's hash has 60 bits. Words are summed by source and the hash's first 12 bits; along the buckets of a source the sums
run up to its budget, and the bucket in which they pass it is the boundary. Only its documents are counted again, by
the next 16 and the last 32 bits, until one hash is left. Documents under the threshold are in: nothing is sorted but buckets, and a smaller
budget's documents are among a larger one's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import settle, small_join

#: Of the hash, from its top: a first histogram of 4,096 buckets a source; those of one bucket are few, and fewer still of one of its.
BITS = (12, 16, 32)
WORD = r"[^\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    """How many words a text has, without a list of them; null has none."""
    marks = F.translate(F.regexp_replace(text, WORD, "x"), " \t\n\v\f\r", "")
    return F.coalesce(F.length(marks), F.lit(0)).cast("long")


def source_key(source: Column) -> Column:
    """A text that is never null and sorts as sources do: by code point, null last."""
    return F.coalesce(F.concat(F.lit("0"), source), F.lit("1"))


def unit_hash(doc_id: Column, text: Column) -> Column:
    """60 bits of doc_id and text: rows that repeat both rise and fall together."""
    said = F.concat_ws(":", F.coalesce(doc_id.cast("string"), F.lit("")), F.coalesce(text, F.lit("")))
    return F.conv(F.substring(F.md5(said.cast("binary")), 1, 15), 16, 10).cast("long")


def _ranked(sources: DataFrame) -> DataFrame:
    """Adds rank, from 0 by key: ranges of keys are numbered apart and meet the few counts of the ranges before them."""
    parts = settle(sources.repartitionByRange(8, "key").withColumn("part", F.spark_partition_id()))
    starts = parts.groupBy("part").count().withColumn("from", F.coalesce(F.sum("count").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return parts.withColumn("at", F.row_number().over(Window.partitionBy("part").orderBy("key"))).join(F.broadcast(starts.select("part", "from")), "part").select("key", "source_size", (F.col("from") + F.col("at") - 1).alias("rank"))


def targets(sources: DataFrame, weights: tuple[int, ...] = (5, 2, 1), budget: float = 1.0, most: int = 3) -> DataFrame:
    """(key, source_size, target) of each source (key, source_size): shares of budget times all sizes by weight, none above most times its size.

    Weights repeat along the keys. What a source can't take is shared again by weight, until none is above: each
    round is a sum over the table of sources. A budget above most gives each source most times its size.
    """
    weight = F.get(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights)).cast("int"))
    ranked = settle(_ranked(sources).withColumn("weight", weight).withColumn("cap", F.col("source_size") * float(most)))
    total = ranked.agg(F.sum("source_size").alias("n")).first().n or 0
    left, share, full = budget * total, 0.0, -1
    while True:
        # sources that the share of the round before fills are full for good, as shares only grow
        filled = (F.col("weight") * left >= F.col("cap") * share) if share else F.lit(False)
        now = ranked.agg(F.count(F.when(filled, 1)).alias("n"), F.coalesce(F.sum(F.when(filled, F.col("cap"))), F.lit(0.0)).alias("taken"), F.coalesce(F.sum(F.when(~filled, F.col("weight"))), F.lit(0.0)).alias("weight")).first()
        if now.n <= full:
            break
        full, left, share = now.n, budget * total - now.taken, now.weight
        if not share:
            return ranked.select("key", "source_size", F.col("cap").alias("target"))
    target = F.when(filled, F.col("cap")).otherwise(F.col("weight") * left / share)
    return ranked.select("key", "source_size", target.alias("target"))


def thresholds(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """(key, below) for each source of wanted (key, rest): words of rows (key, hash, size) with a hash under below come nearest to rest.

    The document that rest falls into is in if its middle isn't beyond rest.
    """
    own = Window.partitionBy("key").orderBy("bucket")
    scope, before, found, shift = rows.where("size > 0"), wanted.select("key", "rest", F.lit(0).cast("long").alias("prefix"), F.lit(0).cast("long").alias("base")), None, sum(BITS)
    for bits in BITS:
        all_in, shift = F.shiftleft(F.col("prefix") + 1, shift), shift - bits
        counts = scope.groupBy("key", F.shiftright("hash", shift).alias("bucket")).agg(F.sum("size").alias("size"))
        sums = small_join(counts, before, "key").withColumn("upto", F.col("base") + F.sum("size").over(own)).withColumn("from", F.col("upto") - F.col("size"))
        into = F.col("upto") > F.col("rest") if shift else F.col("from") + F.col("upto") > 2 * F.col("rest")
        # the first bucket that isn't wholly in; none if all are
        edge = settle(sums.where(into).groupBy("key").agg(F.min_by(F.struct("bucket", "from", "rest"), "bucket").alias("edge")).select("key", "edge.*"))
        # what the budget doesn't run into needs no closer look
        open_ = F.col("from") < F.col("rest") if shift else F.lit(False)
        ends = edge.where(~open_).select("key", F.shiftleft("bucket", shift).alias("below")).unionByName(before.join(edge, "key", "left_anti").select("key", all_in.alias("below")))
        found = ends if found is None else found.unionByName(ends)
        before = edge.where(open_).select("key", "rest", F.col("bucket").alias("prefix"), F.col("from").alias("base"))
        if shift:
            scope = settle(small_join(scope, before.select("key", "prefix"), "key").where(F.shiftright("hash", shift) == F.col("prefix")).drop("prefix"))
    return settle(found)


def mix(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (5, 2, 1), budget: float = 1.0, most: int = 3) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken) of each document: taken is its size times how often the mix has it, at most `most` times.

    Sources come by code point, null last, with weights in turn; see targets(). A source whose target is k times its size and some rest
    gives each document k times, and those under the rest's threshold once more, so that what it gives differs from the target by half a document
    at most. Documents without words have size 0 and taken 0; a source without words has target 0. Rows that repeat doc_id and text
    count as one document of their sizes' sum; other repeated doc_ids are documents of their own. An empty table gives no
    rows; other columns are ignored. The same table gives the same mix, whatever its order and partitions. A hot source is summed
    before it's shuffled, and is never gathered.
    """
    text = F.col(text_col)
    rows = settle(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), source_key(F.col(source_col)).alias("key"), unit_hash(F.col(id_col), text).alias("hash"), words(text).alias("size")))
    shares = targets(rows.groupBy("key").agg(F.sum("size").alias("source_size")), weights, budget, most)
    times = F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(most))).otherwise(0).cast("long")
    shares = settle(shares.withColumn("times", times).withColumn("rest", F.col("target") - F.col("times") * F.col("source_size")))
    under = thresholds(rows.select("key", "hash", "size"), shares.where("rest > 0").select("key", "rest"))
    plan = settle(shares.join(under, "key", "left"))
    more = F.when((F.col("hash") < F.col("below")) & (F.col("times") < most), 1).otherwise(0)
    return small_join(rows, plan, "key").select("doc_id", "source", "size", "source_size", "target", (F.col("size") * (F.col("times") + more)).alias("taken"))
