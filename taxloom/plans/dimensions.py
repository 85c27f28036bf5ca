"""Small dimension tables of a domain pack; another tax law is plugged in by other rows."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

# Bucket keys, labels, strengths and keywords, in the order in which they are tried.
BUCKETS: list[tuple[str, str, str, list[str]]] = [
    ("rcm", "Reverse charge — not expected in GSTR-2A", "strong", ["rcm", "reverse charge", "self invoice", "section 9(3)", "section 9(4)"]),
    ("import_igst", "IGST on imports — not expected in GSTR-2A", "strong", ["import", "boe", "bill of entry", "customs", "igst on import"]),
    ("isd", "ISD credit — distributed, not invoiced", "strong", ["isd", "input service distributor"]),
    ("timing", "Timing — supplier furnished GSTR-1 in a later period", "strong", ["timing", "later period", "subsequent period", "next month", "filed late", "delayed filing", "reflected subsequently", "appears in later", "belated", "next quarter"]),
    ("amendment", "Amendments and credit notes", "defensible", ["amendment", "amended", "credit note", "debit note", "revised", "cdnr", "b2ba"]),
    ("supplier_error", "Supplier reporting error", "defensible", ["supplier error", "wrong gstin", "reported under", "wrongly reported", "b2c instead", "incorrect gstin", "supplier mistake"]),
    ("non_filer", "Supplier appears not to have furnished GSTR-1", "weak", ["non filer", "non-filer", "not filed", "supplier not filed", "return defaulter", "gstr-1 not filed", "supplier defaulter", "cancelled supplier", "registration cancelled"]),
    ("ineligible", "Ineligible credit under section 17(5)", "concede", ["ineligible", "blocked", "17(5)", "section 17(5)", "blocked credit", "not eligible", "disallowed"]),
    ("clerical", "Clerical or data entry difference", "defensible", ["clerical", "data entry", "typo", "rounding", "keying error", "posting error", "duplicate"]),
    ("unreconciled", "Not yet reconciled", "weak", []),
]
# What is argued of each bucket, and what the reply does with it.
POSITIONS: dict[str, tuple[str, str]] = {
    "rcm": ("Tax paid under reverse charge is self-assessed and discharged by the recipient. It appears in GSTR-3B by design and has no counterpart in GSTR-2A. It is not a mismatch and its inclusion in the notice is an error of comparison.", "Excluded from the demand at the threshold."),
    "import_igst": ("IGST paid on import of goods is availed on the strength of the Bill of Entry and is reflected in GSTR-2A only through ICEGATE. Absence from GSTR-2A does not bear on eligibility.", "Excluded from the demand at the threshold."),
    "isd": ("Credit distributed by an Input Service Distributor is availed on an ISD invoice and reported separately. It is not expected to appear in the recipient's GSTR-2A as a supplier invoice.", "Excluded from the demand at the threshold."),
    "timing": ("GSTR-2A is a dynamic statement that updates as suppliers furnish GSTR-1. Where the supplier has since filed and the credit now appears, the conditions in section 16(2) were satisfied at the material time and no reversal arises. The subsequent GSTR-2A is produced in support.", "Contested with documentary proof of the later filing."),
    "amendment": ("The difference arises from amendments or credit notes reflected in one statement and not the other for the period under comparison. Reconciled on the documents.", "Contested with the amendment trail."),
    "supplier_error": ("The supplier has reported the supply incorrectly — against another GSTIN, or as B2C. The recipient has satisfied every condition within its control under section 16(2), and cannot be visited with the consequence of the supplier's reporting error.", "Contested; supplier confirmation to be obtained."),
    "non_filer": ("This is the exposed category. Section 16(2)(c) requires the tax to have been paid to the Government. Where the supplier has not filed, the department will press this and the recipient's answer rests on having satisfied the conditions within its control — a genuine transaction, an invoice, receipt of the supply, and payment through banking channels. Establish each on the documents, and consider whether contesting this portion is commercially worthwhile.", "Weakest limb. Documentary proof essential; consider the arithmetic of contesting versus reversing."),
    "ineligible": ("Credit blocked under section 17(5) is not available. Where it has been availed it should be reversed voluntarily with interest, which both closes the exposure and supports a plea against penalty.", "Reverse voluntarily. Do not contest."),
    "clerical": ("A recording difference rather than a credit issue. Reconciled on the books and corrected.", "Explained with the corrected working."),
    "unreconciled": ("This portion has not been explained. Until it is traced to a category it must be treated as unsupported, and the reply should not assert a position on it.", "Trace before filing, or concede this portion."),
}
# The text around a register's brief.
BRIEF_HEAD = "RECONCILIATION OF THE DIFFERENCE (from the taxpayer's own records):"
BRIEF_FOOT = "HOW TO USE THIS:\nArgue each category on its own footing and quantify it. A reply that meets the difference as a single figure concedes ground it need not concede — the mechanical categories fall away at the threshold, the timing difference is answered on documents, and only the residue is genuinely in issue. Where a category is weak or unreconciled, say so to the signing partner rather than papering over it."
#: Buckets that the supplier's name and invoice number may show when the status says nothing.
BY_NAME = ("rcm", "import_igst", "isd")

# Penalty scheme, order of the stage, stage, percent of the tax, whether the floor holds, days of the concession.
PENALTY_STAGES: list[tuple[str, int, str, int, bool, int | None]] = [
    ("73", 0, "before_notice", 0, False, None),
    ("73", 1, "within_30_days", 0, False, 30),
    ("73", 2, "on_order", 10, True, None),
    ("74", 0, "before_notice", 15, False, None),
    ("74", 1, "within_30_days", 25, False, 30),
    ("74", 2, "on_order", 100, False, None),
    ("74A_non_fraud", 0, "before_notice", 0, False, None),
    ("74A_non_fraud", 1, "within_60_days", 0, False, 60),
    ("74A_non_fraud", 2, "on_order", 10, True, None),
    ("74A_fraud", 0, "before_notice", 15, False, None),
    ("74A_fraud", 1, "within_60_days", 25, False, 60),
    ("74A_fraud", 2, "within_60_days_of_order", 50, False, None),
    ("74A_fraud", 3, "on_order", 100, False, None),
]

# Form codes of notices, their statute, and the form of the reply.
NOTICE_TYPES: list[tuple[str, str, str | None]] = [
    ("ASMT-10", "Section 61 read with Rule 99", "ASMT-11"),
    ("DRC-01A", "Section 73(5)/74(5) read with Rule 142(1A)", "DRC-01A Part B"),
    ("DRC-01", "Section 73 / 74 / 74A read with Rule 142(1)", "DRC-06"),
    ("DRC-07", "Section 73/74 read with Rule 142(5)", "APL-01 (appeal)"),
    ("ADT-01", "Section 65 read with Rule 101", None),
    ("ADT-02", "Section 65(6) read with Rule 101(5)", None),
    ("RFD-08", "Section 54 read with Rule 92(3)", "RFD-09"),
    ("REG-17", "Section 29 read with Rule 22", "REG-18"),
    ("DRC-01C", "Rule 88D", "DRC-01C Part B"),
    ("MOV-07", "Section 129 read with Rule 138", None),
    ("ASMT-11", "Section 61(2) read with Rule 99(2)", "ASMT-11"),
    ("ASMT-12", "Section 61(3) read with Rule 99(3)", None),
    ("ASMT-13", "Section 62 read with Rule 100(1)", "Return under s.62(2)"),
    ("ASMT-14", "Section 63 read with Rule 100(2)", "ASMT-15"),
    ("DRC-01B", "Rule 88C", "DRC-01B Part B"),
    ("DRC-03", "Section 73(5)/74(5) read with Rule 142(2)/(3)", None),
    ("DRC-06", "Rule 142(4)", "DRC-06"),
    ("DRC-13", "Section 79(1)(c) read with Rule 145", "DRC-14 / representation"),
    ("APL-01", "Section 107 read with Rule 108", "APL-01"),
    ("APL-05", "Section 112 read with Rule 110", "APL-05"),
    ("ADT-04", "Section 66 read with Rule 102", None),
    ("RFD-06", "Section 54 read with Rule 92", "APL-01 (appeal)"),
    ("REG-03", "Rule 9(2)", "REG-04"),
    ("REG-23", "Rule 23(3)", "REG-24"),
    ("REG-31", "Rule 21A", None),
    ("MOV-06", "Section 129(1) read with Rule 140", "MOV-09 representation"),
    ("MOV-09", "Section 129(3)", "APL-01 (appeal)"),
    ("MOV-10", "Section 130 read with Rule 141", None),
    ("SUMMONS-70", "Section 70", None),
    ("SPL-01", "Section 128A", "SPL-01 / SPL-02"),
    ("ARA-01", "Section 97 read with Rule 104", None),
    ("OTHER", "As specified in the notice", None),
]


@dataclass(frozen=True)
class Pack:
    """The rules of a domain that jobs take as a parameter: buckets in the order in which they are tried, those that a name may show, the bucket of the rest, what is argued of each and done with it, penalty stages, and notices' form codes."""

    buckets: tuple[tuple[str, str, str, list[str]], ...] = tuple(BUCKETS)
    by_name: tuple[str, ...] = BY_NAME
    rest: str = "unreconciled"
    positions: Mapping[str, tuple[str, str]] = field(default_factory=lambda: POSITIONS)
    penalty_stages: tuple[tuple[str, int, str, int, bool, int | None], ...] = tuple(PENALTY_STAGES)
    notice_types: tuple[tuple[str, str, str | None], ...] = tuple(NOTICE_TYPES)


GST = Pack()


def buckets(spark: SparkSession, pack: Pack = GST) -> DataFrame:
    rows = [(i, k, label, strength, *pack.positions.get(k, (None, None))) for i, (k, label, strength, _) in enumerate(pack.buckets)]
    return spark.createDataFrame(rows, "ordinal int, bucket string, label string, strength string, position string, action string")


def penalty_stages(spark: SparkSession, pack: Pack = GST) -> DataFrame:
    return spark.createDataFrame(list(pack.penalty_stages), "scheme string, ordinal int, stage string, percent int, floored boolean, window int")


def notice_types(spark: SparkSession, pack: Pack = GST) -> DataFrame:
    return spark.createDataFrame(list(pack.notice_types), "code string, statute string, reply_form string")
