"""Types of limbs of a goods-and-services-tax notice: what names them, and the law and posture that each starts from."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Key, label, patterns of a heading or body (case doesn't count), statute, sections, rules, first posture, tags of authorities; in the order in which they are tried.
LIMB_TYPES = [
    ("outward_short_payment", "Short payment of tax on outward supplies", [r"short\s+payment.{0,40}outward", r"short\s+payment\s+of\s+tax", r"outward\s+turnover\s+discrepanc", r"difference\s+in\s+liability", r"liability.{0,60}gstr[\s-]*1.{0,60}gstr[\s-]*3b", r"\brule\s*88C\b"],
        "Section 73/74 read with Sections 37 and 39", ["37", "39", "73"], [], "explained", []),
    ("turnover_difference", "Difference in turnover across returns and statements", [r"difference\s+in\s+turnover", r"turnover\s+(?:variance|difference|mismatch)", r"reconcil\w+\s+the\s+turnover"],
        "Section 61 read with Rule 99; Sections 35(5)/44", ["44", "61"], [], "explained", []),
    ("credit_notes", "Credit notes — compliance with Section 34 and Section 15(3)(b)", [r"credit\s+notes?\b", r"section\s*34\b.{0,40}credit", r"15\s*\(\s*3\s*\)\s*\(\s*b\s*\)"],
        "Section 34 read with Section 15(3)(b) and Rule 53", ["15(3)(b)", "34", "34(2)"], ["53"], "explained", []),
    ("itc_excess_2b", "Excess input tax credit availed against GSTR-2B", [r"excess\s+(?:claim|availment)\s+of\s+itc", r"itc.{0,30}w\.?r\.?t\.?\s*gstr[\s-]*2[ab]", r"excess\s+itc\s+availed", r"input\s+tax\s+discrepanc", r"(?:itc|input\s+tax\s+credit)\s+availed\s+in\s+excess",
        r"excess\s+input\s+tax\s+credit", r"(?:itc|input\s+tax\s+credit).{0,50}(?:excess|exceeds|mismatch|difference).{0,50}gstr[\s-]*2[ab]", r"gstr[\s-]*2[ab].{0,40}(?:vs\.?|versus|and)\s*gstr[\s-]*3b"],
        "Section 16(2)(aa) read with Rule 36(4); Rule 88D", ["16(2)(aa)", "16(2)(b)", "16(2)(c)", "16(2)(d)", "73"], ["36(4)", "88D"], "undecided", ["itc_2a_2b_mismatch", "itc_supplier_default"]),
    ("itc_blocked_17_5", "Blocked credit under Section 17(5)", [r"ineligible\s+itc", r"17\s*\(\s*5\s*\)", r"blocked\s+credit"],
        "Section 17(5)", ["16(1)", "17(5)", "17(5)(a)", "17(5)(b)", "17(5)(c)", "17(5)(d)", "2(119)"], [], "contested", ["itc_blocked_17_5", "works_contract"]),
    ("itc_time_limit", "Input tax credit denied as time-barred under Section 16(4)", [r"16\s*\(\s*4\s*\)", r"time\s*[- ]?barred?\s+(?:itc|credit)", r"belated\s+availment"],
        "Section 16(4), read with Sections 16(5) and 16(6)", ["16(4)", "16(5)", "16(6)"], [], "contested", ["itc_time_limit"]),
    ("itc_supplier_default", "Input tax credit denied for supplier default under Section 16(2)(c)", [r"16\s*\(\s*2\s*\)\s*\(\s*c\s*\)", r"supplier[s]?\b.{0,30}\bnot\s+(?:filed|paid|furnished|discharged)", r"non[\s-]?filer\s+supplier", r"tax\s+not\s+paid\s+(?:to\s+)?(?:the\s+)?government"],
        "Section 16(2)(c) read with Section 155", ["16(2)(c)", "155"], [], "contested", ["itc_supplier_default"]),
    ("itc_common_credit", "Common credit reversal under Rules 42 and 43", [r"rule\s*4[23]\b", r"common\s+credit", r"exempt\s+turnover.{0,30}revers"],
        "Section 17(2) read with Rules 42 and 43", ["17(2)"], ["42", "43"], "undecided", []),
    ("itc_180_days", "Reversal for non-payment to supplier within 180 days (Rule 37)", [r"rule\s*37\b", r"180\s*days", r"one\s+hundred\s+and\s+eighty\s+days", r"second\s+proviso.{0,30}16\s*\(\s*2"],
        "Second proviso to Section 16(2) read with Rule 37", ["16(2)"], ["37"], "explained", []),
    ("rcm", "Reverse charge liability short paid", [r"reverse\s+charge", r"\brcm\b", r"section\s*9\s*\(\s*[34]\s*\)"],
        "Section 9(3)/9(4) read with Section 31(3)(f)", ["9(3)", "9(4)", "31(3)(f)"], [], "undecided", []),
    ("late_fee", "Late fee for belated returns", [r"late\s+fee", r"section\s*47\b", r"filed\s+belatedly"],
        "Section 47(1) read with Section 37 and Rule 59", ["37", "47(1)"], ["59"], "agreed_paid", []),
    ("interest_delayed_payment", "Interest on delayed payment of tax", [r"interest\s+on\s+(?:delayed|belated)", r"section\s*50\s*\(\s*1\s*\)", r"interest\s+on\s+invoice\s+value\s+increased", r"interest.{0,30}amendment",
        r"interest\s+(?:payable|leviable|liable|chargeable).{0,30}(?:delayed|belated|late)", r"non[\s-]*payment\s+of\s+interest"],
        "Section 50(1) read with Rule 88B", ["50(1)", "50(3)"], ["88B"], "agreed_paid", []),
    ("einvoice", "Non-compliance with e-invoicing under Rule 48(4)", [r"\be[\s-]?invoic", r"rule\s*48\s*\(\s*[45]\s*\)", r"\birn\b", r"invoice\s+registration\s+portal"],
        "Rule 48(4) and 48(5) read with Section 125", ["2(6)", "122", "125", "126"], ["48(4)", "48(5)"], "contested", ["penalty_general", "minor_breach"]),
    ("penalty_general", "General penalty proposed under Section 125", [r"section\s*125\b", r"general\s+penalt"],
        "Section 125 read with Section 126", ["125", "126"], [], "contested", ["penalty_general", "minor_breach"]),
    ("eway_bill", "E-way bill contravention and penalty", [r"e[\s-]?way\s*bill", r"section\s*129\b", r"\bMOV[\s-]?\d"],
        "Section 129 read with Rule 138", ["122", "126", "129", "130"], ["138"], "contested", ["eway_bill"]),
    ("classification", "Classification or rate dispute", [r"classification", r"\bhsn\b.{0,30}(?:incorrect|wrong|mis)", r"rate\s+of\s+tax.{0,30}(?:incorrect|wrong|applicable)"],
        "Section 9 read with the rate notifications and the Tariff", ["9"], [], "contested", ["classification"]),
    ("valuation", "Valuation dispute", [r"valuation", r"section\s*15\s*\(\s*[12]\s*\)", r"transaction\s+value", r"related\s+(?:person|part(?:y|ies))", r"\brule\s*28\b", r"open\s+market\s+value"],
        "Section 15 read with the Valuation Rules", ["15"], [], "contested", []),
    ("place_of_supply", "Place of supply and wrong-head tax", [r"place\s+of\s+supply", r"section\s*1[０0]\s*(?:of\s+)?(?:the\s+)?igst", r"wrong\s+head", r"section\s*77\b"],
        "Sections 10 to 13 of the IGST Act; Section 77 CGST / Section 19 IGST", ["77"], [], "contested", ["place_of_supply"]),
    ("registration", "Registration — cancellation or suspension proposed", [r"cancellation\s+of\s+registration", r"section\s*29\b", r"\bREG[\s-]?1[78]\b"],
        "Section 29 read with Rule 22", ["29", "30"], ["22"], "contested", ["registration"]),
    ("refund_rejection", "Refund rejection proposed", [r"\brefund\s+(?:claim|application|of|order|reject|sanction|is\b)", r"rejection\s+of\s+.{0,30}refund", r"\brefund\b.{0,20}(?:inadmissible|not\s+admissible|rejected)", r"\bRFD[\s-]?0?[689]\b", r"section\s*54\b", r"rule\s*89\b"],
        "Section 54 read with Rules 89 to 96", ["54", "54(1)", "56"], ["89", "92(3)"], "contested", ["refund"]),
    ("other", "Other discrepancy", [r"^other\b"], "As specified in the notice", [], [], "undecided", []),
]


def catalogue() -> list[tuple[str, list[str]]]:
    """(key, patterns) as limbs_of() and typed() take them."""
    return [(key, [f"(?i){p}" for p in patterns]) for key, _, patterns, *_ in LIMB_TYPES]


def limb_types(spark: SparkSession) -> DataFrame:
    """type, label, statute, sections, rules, posture, tags: what a limb of a type starts from. A limb's own key is one of its tags."""
    rows = [(key, label, statute, sections, rules, posture, [*tags, key]) for key, label, _, statute, sections, rules, posture, tags in LIMB_TYPES]
    return spark.createDataFrame(rows, "type string, label string, statute string, sections array<string>, rules array<string>, posture string, tags array<string>")
