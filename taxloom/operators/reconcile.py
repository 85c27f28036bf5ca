"""Reconciliation of invoice registers: buckets, shares, exposure, warnings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import money as M
from ..plans.dimensions import BRIEF_FOOT, BRIEF_HEAD, GST, Pack, buckets

IMMATERIAL = 1.0


FIGURES = ("difference", "amount_books", "amount_2a", "tax_amount")


def classified(lines: DataFrame, pack: Pack = GST) -> DataFrame:
    """Adds amount (null or under a rupee: immaterial) and bucket to register lines. Narrow: nothing is shuffled.

    What later expressions use more than once is projected first: Catalyst keeps such projections apart, so
    each cell is read by its patterns once.
    """
    read = lines.withColumns({f"_{c}": M.plain_number(F.col(c)) for c in FIGURES} | {"_said": M.folded("status"), "_about": M.folded("supplier_name", "invoice_no")})
    signed = read.withColumns({f"_{c}": M.signed(F.col(c), F.col(f"_{c}")) for c in FIGURES})
    whole = signed.withColumn("amount", M.amount_in_issue(*[F.col(f"_{c}") for c in FIGURES])).withColumn("bucket", M.bucket_of(F.col("_said"), F.col("_about"), pack))
    return whole.drop("_said", "_about", *[f"_{c}" for c in FIGURES])


def material() -> F.Column:
    return F.coalesce(F.col("amount") >= IMMATERIAL, F.lit(False))


def _summed(lines: DataFrame, *by: str) -> DataFrame:
    """Amount and count of the material lines by key. The test stands in the aggregates: as a filter, it would be pushed below the projections with all patterns in it, and be worked out twice."""
    sums = lines.groupBy(*by).agg(F.sum(F.when(material(), F.col("amount"))).alias("amount"), F.count_if(material()).alias("lines"))
    return sums.where("lines > 0")


def summary(lines: DataFrame, pack: Pack = GST) -> DataFrame:
    """Amount, count and share by register and bucket, largest first; the window runs over the few aggregated rows."""
    sums = _summed(classified(lines, pack), "recon_id", "bucket")
    return _ranked(sums, lines.sparkSession, pack).select("recon_id", "rank", "bucket", "label", "strength", F.col("amount").cast("double").alias("amount"), "lines", "share")


def _ranked(sums: DataFrame, spark: SparkSession, pack: Pack) -> DataFrame:
    whole = Window.partitionBy("recon_id")
    ranked = sums.withColumn("share", F.round(F.col("amount").cast("double") / F.sum("amount").over(whole).cast("double"), 6)).withColumn("rank", F.row_number().over(whole.orderBy(F.desc("amount"), "bucket")))
    return ranked.join(F.broadcast(buckets(spark, pack)), "bucket")


def briefs(lines: DataFrame, pack: Pack = GST) -> DataFrame:
    """(recon_id, brief): a register told by its buckets, largest first, each with its amount, lines, share, strength and position. It names no line and no supplier, and its length doesn't grow with the register; one without material lines has none.

    Figures are rounded half to even. A bucket without a position has an empty line in its place.
    """
    told = _ranked(_summed(classified(lines, pack), "recon_id", "bucket"), lines.sparkSession, pack)
    rupees = lambda c: F.concat(F.lit("Rs. "), F.format_number(c, 0))
    percent = F.format_number(F.col("amount").cast("double") / F.sum("amount").over(Window.partitionBy("recon_id")).cast("double") * 100, 0)
    line = F.concat(
        F.lit("- "), "label", F.lit(": "), rupees(F.col("amount")), F.lit(" ("), F.col("lines").cast("string"), F.lit(" line(s), "), percent, F.lit("% of the difference) — position: "), F.upper("strength"),
        F.lit("\n    "), F.coalesce("position", F.lit("")), F.lit("\n\n"),
    )
    rows = told.withColumn("_line", F.struct("rank", line.alias("text"))).groupBy("recon_id").agg(F.array_sort(F.collect_list("_line")).alias("_lines"), F.sum("amount").alias("total"), F.sum("lines").alias("lines"))
    head = F.concat(F.lit(BRIEF_HEAD + "\n\nTotal difference analysed: "), rupees(F.col("total")), F.lit(" across "), F.col("lines").cast("string"), F.lit(" line(s).\n\n"))
    return rows.select("recon_id", F.concat(head, F.array_join(F.transform("_lines", lambda x: x["text"]), ""), F.lit(BRIEF_FOOT)).alias("brief"))


def by_supplier(lines: DataFrame) -> DataFrame:
    """Amount in issue by register and supplier; blank suppliers go before the shuffle."""
    return _summed(classified(lines.where(F.trim("supplier_gstin") != "")), "recon_id", "supplier_gstin")


def top_exposures(lines: DataFrame, k: int = 5, mask: bool = False) -> DataFrame:
    """The k suppliers of each register with most in issue; masked, only the first two and last three characters show."""
    rank = F.row_number().over(Window.partitionBy("recon_id").orderBy(F.desc("amount"), "supplier_gstin"))
    top = by_supplier(lines).withColumn("rank", rank).where(F.col("rank") <= k)
    shown = F.concat(F.left("supplier_gstin", F.lit(2)), F.lit("**********"), F.right("supplier_gstin", F.lit(3))) if mask else F.col("supplier_gstin")
    return top.select("recon_id", "rank", shown.alias("supplier_gstin"), F.col("amount").cast("double").alias("amount"), "lines")


def registers(lines: DataFrame, pack: Pack = GST) -> DataFrame:
    """Totals of each register, its distinct suppliers and warnings: over a quarter unreconciled, no status at all. Lines are classified once, and summed by supplier first."""
    flagged = classified(lines, pack).withColumn("counted", material())
    each = flagged.groupBy("recon_id", "supplier_gstin").agg(
        F.sum(F.when(F.col("counted"), F.col("amount"))).alias("total"),
        F.count_if("counted").alias("counted"),
        F.count_if(~F.col("counted")).alias("skipped"),
        F.sum(F.when(F.col("counted") & (F.col("bucket") == pack.rest), F.col("amount"))).alias("open"),
        F.count_if(F.trim("status") != "").alias("told"),
    )
    named = (F.col("counted") > 0) & (F.trim("supplier_gstin") != "")
    totals = each.groupBy("recon_id").agg(*[F.sum(c).alias(c) for c in ("total", "counted", "skipped", "open", "told")], F.count_if(named).alias("suppliers"))
    share = F.coalesce(F.col("open"), F.lit(0)) / F.col("total")
    return totals.select(
        "recon_id", F.col("total").cast("double").alias("total"), "counted", "skipped", "suppliers",
        F.coalesce(share > 0.25, F.lit(False)).alias("mostly_open"), (F.col("told") == 0).alias("no_status"),
    )
