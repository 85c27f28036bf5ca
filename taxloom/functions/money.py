"""Column functions on money cells, statutory arithmetic and deadlines. Unread figures stay null."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans.dimensions import GST, Pack

MONEY = "decimal(18,2)"
# Ceilings of the amount bands and their names, and the name of anything above.
BANDS = [(100_000, "under INR 1 lakh"), (1_000_000, "INR 1-10 lakh"), (5_000_000, "INR 10-50 lakh"), (10_000_000, "INR 50 lakh - 1 crore"), (50_000_000, "INR 1-5 crore"), (100_000_000, "INR 5-10 crore")]
TOP_BAND, NO_BAND = "over INR 10 crore", "an undisclosed amount"
CRITICAL_DAYS, URGENT_DAYS = 3, 7
ARGUED = ("contested", "partial", "undecided")
AMNESTY_YEARS = ("2017-18", "2018-19", "2019-20")


def plain_number(cell: Column) -> Column:
    """The first number of a cell without its commas, else null."""
    return F.regexp_extract(F.replace(cell, F.lit(","), F.lit("")), r"-?\d+(?:\.\d+)?", 0).try_cast(MONEY)


def signed(cell: Column, number: Column) -> Column:
    """The number, below zero if the cell stands in brackets."""
    text = F.trim(cell)
    return F.when(F.startswith(text, F.lit("(")) & F.endswith(text, F.lit(")")), -F.abs(number)).otherwise(number).cast(MONEY)


def parse_amount(cell: Column) -> Column:
    """The first number of a cell without its commas; brackets around the cell make it negative; else null."""
    return signed(cell, plain_number(cell))


def amount_in_issue(difference: Column, books: Column, portal: Column, tax: Column) -> Column:
    """The stated difference, else books less portal, else whichever figure there is, without its sign."""
    return F.coalesce(F.abs(difference), F.abs(books - portal), F.abs(books), F.abs(portal), F.abs(tax)).cast(MONEY)


def folded(*columns: str) -> Column:
    """Columns in lower case, a space between, nulls left out."""
    return F.lower(F.concat_ws(" ", *columns))


def bucket_of(said: Column, about: Column, pack: Pack = GST) -> Column:
    """The pack's first bucket that has a keyword in said; else, for some buckets, in about; else its rest. Both are in lower case.

    A keyword counts anywhere, within a word too. One pattern for each bucket keeps the generated code small.
    """
    chain = F
    for text, names in ((said, [b for b, *_ in pack.buckets]), (about, pack.by_name)):
        for bucket, _, _, words in pack.buckets:
            if words and bucket in names:
                chain = chain.when(text.rlike("|".join(re.escape(w) for w in words)), bucket)
    return F.lit(pack.rest) if chain is F else chain.otherwise(pack.rest)


def classify(status: Column, name: Column, invoice: Column) -> Column:
    """bucket_of() a line's status, and its supplier's name and invoice number."""
    return bucket_of(F.lower(F.coalesce(status, F.lit(""))), F.lower(F.concat_ws(" ", name, invoice)))


def amount_band(amount: Column) -> Column:
    chain = F.when(amount.isNull(), NO_BAND)
    for ceiling, label in BANDS:
        chain = chain.when(amount < ceiling, label)
    return chain.otherwise(TOP_BAND)


def needs_panel(posture: Column) -> Column:
    """Whether a limb is argued; no posture counts as undecided."""
    return F.coalesce(posture, F.lit("undecided")).isin(*ARGUED)


def urgency(days: Column) -> Column:
    return F.when(days.isNull(), "none").when(days < 0, "overdue").when(days <= CRITICAL_DAYS, "critical").when(days <= URGENT_DAYS, "urgent").otherwise("due")


def deadline_label(days: Column) -> Column:
    return (
        F.when(days.isNull(), "No reply date on file")
        .when(days == -1, "OVERDUE by 1 day")
        .when(days < 0, F.concat(F.lit("OVERDUE by "), F.abs(days).cast("string"), F.lit(" days")))
        .when(days == 0, "Due TODAY")
        .when(days == 1, "Due tomorrow")
        .otherwise(F.concat(days.cast("string"), F.lit(" days remaining")))
    )


def interest(amount: Column, start: Column, end: Column, utilised: Column) -> Column:
    """Simple interest for the days from start (excluded) to end: 24 % a year if the credit was used, else 18 %.

    Null without dates or a positive amount; 0 if the dates don't run. Rounded half up to paise.
    """
    days = F.date_diff(end, start)
    rate = F.when(utilised, 24).otherwise(18)
    paise = F.floor((amount.cast("decimal(18,2)") * 100).cast("decimal(38,0)") * rate * F.greatest(days, F.lit(0)) / 36500 + F.lit(0.5).cast("decimal(2,1)"))
    return F.when(days.isNotNull() & (amount > 0), (paise / 100).cast(MONEY))


def penalty_scheme(section: Column, fraud: Column) -> Column:
    """74A is tried before 74; without a finding of fraud it is the track without."""
    s = F.replace(F.upper(F.trim(section)), F.lit(" "), F.lit(""))
    return F.when(s.startswith("74A"), F.when(fraud, "74A_fraud").otherwise("74A_non_fraud")).when(s.startswith("74"), "74").when(s.startswith("73"), "73")


def predeposit(tax: Column, penalty_only: Column) -> Column:
    """10 % of the tax, 20 crore at most; 25 % where only a penalty is in dispute; null unless positive."""
    return F.when(tax > 0, F.when(penalty_only, tax * F.lit(0.25).cast("decimal(3,2)")).otherwise(F.least(tax * F.lit(0.10).cast("decimal(3,2)"), F.lit(200_000_000)))).cast(MONEY)


def limitation(order_date: Column, as_on: Column) -> Column:
    """in_time within three calendar months, condonable within one more, then time_barred."""
    return F.when(order_date.isNull(), None).when(as_on <= F.add_months(order_date, 3), "in_time").when(as_on <= F.add_months(order_date, 4), "condonable").otherwise("time_barred")


def financial_year(period: Column) -> Column:
    """'FY 2019-20', '2019-20' and '2019-2020' as '2019-20'."""
    start = F.regexp_extract(period, r"(20\d{2})\s*[-–/]\s*(\d{2,4})", 1)
    end = F.regexp_extract(period, r"(20\d{2})\s*[-–/]\s*(\d{2,4})", 2)
    return F.when(start != "", F.concat(start, F.lit("-"), F.when(F.length(end) == 4, F.right(end, F.lit(2))).otherwise(end)))


def amnesty_eligible(section: Column, period: Column) -> Column:
    """Section 73 (not 74 or 74A) and one of three years."""
    return F.coalesce(F.trim(section).startswith("73"), F.lit(False)) & F.coalesce(financial_year(period).isin(*AMNESTY_YEARS), F.lit(False))


def amnesty_condition(eligible: Column, paid: Column) -> Column:
    return F.when(~eligible, "ineligible").when(paid, "paid").when(~paid, "unpaid").otherwise("confirm_payment")


def indian_digits(amount: Column) -> Column:
    """12,34,567.89: the last three digits of the rupees, then pairs."""
    whole = F.regexp_replace(F.regexp_extract(amount.cast(MONEY).cast("string"), r"^-?(\d+)", 1), r"(\d)(?=(\d\d)*\d{3}$)", "$1,")
    return F.concat(F.when(amount < 0, "-").otherwise(""), whole, F.regexp_extract(amount.cast(MONEY).cast("string"), r"(\.\d+)$", 1))
