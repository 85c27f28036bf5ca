"""Totals of registers, kept up to date as lines arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.reconcile import classified, material
from ..plans.dimensions import GST, Pack


def keep_totals(lines: DataFrame, pack: Pack = GST) -> DataFrame:
    """Amount and count by register and bucket of a stream (in update or complete mode) or a table of register lines; state is a row for each register and bucket."""
    return classified(lines, pack).groupBy("recon_id", "bucket").agg(F.sum(F.when(material(), F.col("amount"))).alias("amount"), F.count_if(material()).alias("lines"))


def keep_registers(lines: DataFrame, pack: Pack = GST, ts: str | None = None) -> DataFrame:
    """What reconcile.registers() and summary() tell of each register, of a stream (in update or complete mode) or a table: total, counted, skipped, suppliers, mostly_open, no_status, and buckets (bucket: amount, lines, share; those with material lines).

    Two stateful operators: the first lets a supplier's first material line (and first immaterial one, which counts
    for nothing) in a register pass, the second sums lines and first sights together. State is a flag or two for each
    supplier of a register, on tasks by both, and a row for each register. With ts (a timestamp column that has a watermark) a flag goes when the watermark passes its
    first line's time by the watermark's delay; a supplier that comes back later counts again. Without it flags stay.
    """
    flagged = classified(lines, pack).withColumn("_in", material())
    # No filter on what is worked out: it would be pushed below the patterns and work them out twice.
    sights = ["recon_id", "supplier_gstin", "_in"]
    first = flagged.where(F.trim("supplier_gstin") != "").select(*sights, *([ts] if ts else []))
    first = first.dropDuplicatesWithinWatermark(sights) if ts else first.dropDuplicates(sights)
    kept = flagged.select("recon_id", "bucket", F.when(F.col("_in"), F.col("amount")).alias("amount"), F.col("_in").cast("int").alias("lines"), F.coalesce((F.trim("status") != ""), F.lit(False)).cast("int").alias("told"), F.lit(0).alias("supplier"), F.lit(1).alias("line"))
    seen = first.select("recon_id", F.col("_in").cast("int").alias("supplier"), F.lit(0).alias("line"))
    keys = [b for b, *_ in pack.buckets]
    of = lambda b, c: F.sum(F.when(F.col("bucket") == b, F.col(c)))
    sums = kept.unionByName(seen, allowMissingColumns=True).groupBy("recon_id").agg(
        F.sum("amount").alias("total"), F.sum("lines").alias("counted"), (F.sum("line") - F.sum("lines")).alias("skipped"), F.sum("supplier").alias("suppliers"), F.sum("told").alias("told"),
        *[of(b, "amount").alias(f"_a{i}") for i, b in enumerate(keys)], *[of(b, "lines").alias(f"_n{i}") for i, b in enumerate(keys)],
    )
    share = lambda i: F.col(f"_a{i}").cast("double") / F.col("total").cast("double")
    entries = [F.struct(F.lit(b).alias("key"), F.struct(F.col(f"_a{i}").cast("double").alias("amount"), F.col(f"_n{i}").alias("lines"), F.round(share(i), 6).alias("share")).alias("value")) for i, b in enumerate(keys)]
    rest = F.coalesce(F.col(f"_a{keys.index(pack.rest)}"), F.lit(0)) / F.col("total")
    return sums.select(
        "recon_id", F.col("total").cast("double").alias("total"), "counted", "skipped", "suppliers", F.coalesce(rest > 0.25, F.lit(False)).alias("mostly_open"), (F.col("told") == 0).alias("no_status"),
        F.map_from_entries(F.filter(F.array(*entries), lambda e: e["value"]["lines"] > 0)).alias("buckets"),
    )
