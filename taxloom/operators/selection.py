"""Exact medians by counting passes over the bits of a value, so that no task holds a group's values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bits that a pass decides, and passes over the 64.
DIGIT, PASSES = 16, 4
#: Bits of a double's fraction, the offset of its exponent, and its least normal and least positive values.
FRACTION, OFFSET, NORMAL, LEAST = 52, 1023, 2.0**-1022, 2.0**-1074
SIGN = -(1 << 63)


def with_ordered(rows: DataFrame, value: str, out: str) -> DataFrame:
    """Adds a finite double as a long of the same order: 0 for both zeros and for null, below zero for what is below it.

    A step that later ones use more than once is projected first, so that Catalyst doesn't copy it into them.
    """
    size = F.abs(F.col(value).cast("double"))
    near = F.floor(F.log2("_size")).cast("int")
    power = F.col("_near") + F.when(F.col("_size") < F.pow(F.lit(2.0), F.col("_near")), -1).when(F.col("_size") >= F.pow(F.lit(2.0), F.col("_near") + 1), 1).otherwise(0)
    fraction = ((F.col("_size") / F.pow(F.lit(2.0), F.col("_power")) - 1) * 2.0**FRACTION).cast("long")
    bits = F.when(F.col("_size") < NORMAL, (F.col("_size") / F.lit(LEAST)).cast("long")).otherwise((F.col("_power") + OFFSET).cast("long") * (1 << FRACTION) + fraction)
    steps = rows.withColumn("_size", size).withColumn("_near", near).withColumn("_power", power).withColumn("_bits", F.coalesce(bits, F.lit(0)))
    return steps.withColumn(out, F.when(F.col(value) < 0, -F.col("_bits")).otherwise(F.col("_bits"))).drop("_size", "_near", "_power", "_bits")


def from_ordered(k: Column) -> Column:
    """The double whose with_ordered() is k."""
    size = F.abs(k)
    fraction = 1 + size.bitwiseAND((1 << FRACTION) - 1) / F.lit(2.0**FRACTION)
    value = F.when(size < (1 << FRACTION), size * F.lit(LEAST)).otherwise(fraction * F.pow(F.lit(2.0), F.shiftright(size, FRACTION) - OFFSET))
    return F.when(k < 0, -value).otherwise(value)


def medians(rows: DataFrame, by: str, value: str) -> DataFrame:
    """(by, median, samples) of the finite values, the mean of the middle two where they are even in number; nulls, NaN and infinities take no part, and a group of nothing else has no row.

    by is of few values, whose number the caller bounds: a pass broadcasts one or two rows of each. A pass counts
    the values that share the prefix of a middle one by their next 16 bits, so a group's state is 65,536 counts for
    each prefix, however many values there are and however they lie; the rows are read once a pass.
    """
    finite = F.col(value).isNotNull() & (F.abs(F.col(value)) < float("inf"))
    keyed = with_ordered(rows.where(finite).select(by, value), value, "_key").select(by, F.col("_key").bitwiseXOR(F.lit(SIGN)).alias("_key"))
    prefix = lambda left: F.shiftrightunsigned("_key", left)
    found = None
    for at in range(1, PASSES + 1):
        longer = prefix(64 - DIGIT * at) if at < PASSES else F.col("_key")
        if found is None:
            cells = keyed.groupBy(by, longer.alias("_prefix")).agg(F.count("*").alias("_n")).withColumn("_group", F.lit(0))
            n = F.sum("_n").over(Window.partitionBy(by))
            cells = cells.withColumn("samples", n).withColumn("_ranks", F.array_distinct(F.array(F.floor((n - 1) / 2), F.floor(n / 2))))
        else:
            held = F.broadcast(found.withColumnRenamed(by, "_by"))
            met = keyed.join(held, F.col(by).eqNullSafe(F.col("_by")) & (prefix(64 - DIGIT * (at - 1)) == F.col("_prefix")))
            cells = met.groupBy(by, F.col("_prefix").alias("_group"), longer.alias("_prefix")).agg(F.count("*").alias("_n"), F.first("samples").alias("samples"), F.first("_ranks").alias("_ranks"))
        # The last prefix is a whole key, whose order is that of a number without sign.
        before = F.sum("_n").over(Window.partitionBy(by, "_group").orderBy(F.col("_prefix").bitwiseXOR(F.lit(SIGN if at == PASSES else 0)))) - F.col("_n")
        placed = cells.withColumn("_before", before)
        inside = F.filter("_ranks", lambda r: (r >= F.col("_before")) & (r < F.col("_before") + F.col("_n")))
        found = placed.withColumn("_ranks", F.transform(inside, lambda r: r - F.col("_before"))).where(F.size("_ranks") > 0).select(by, "_prefix", "_ranks", "samples")
    weight = F.size("_ranks")
    middle = F.sum(from_ordered(F.col("_prefix").bitwiseXOR(F.lit(SIGN))) * weight) / F.sum(weight)
    return found.groupBy(by).agg(middle.alias("median"), F.first("samples").alias("samples"))
