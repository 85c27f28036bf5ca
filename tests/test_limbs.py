from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from taxloom.operators import evaluate, limbs, notices, talk
from taxloom.sources import files

NOTICE = """FORM GST ASMT-10
1. Excess credit claimed
Working 100 100 50 0 250
Difference 10 10 20 0 40
2. Late fee
S.No | No of GSTR-1 filed | SGST late fee | CGST late fee
1 2 3 4
1 12 23800 23800
3. Penalty for delay
penalty of Rs. 25000/- each under CGST and SGST
4. Turnover differs
5 Difference (Highest of 1 to 3)-4 481548
5. Nothing read here
see the annexure
Proper officer
This closes what the officer has found in the returns of the year, and each of the points above is to be answered in writing with the papers at hand.
Total tax payable in (excess claim) above 7 8 0 0 15
Grand total 100 200 300 0 600"""


def read(spark, text, catalogue=None):
    df = spark.createDataFrame([(1, text)], "notice_id int, text string")
    return notices.figures(notices.limbs(df, catalogue)).orderBy("index").collect()


def test_readings(spark):
    got = [(r.heading, r.basis, r.total and float(r.total)) for r in read(spark, NOTICE)]
    assert got == [("Excess credit claimed", "labelled", 40), ("Late fee", "paired", 47600), ("Penalty for delay", "each_head", 50000), ("Turnover differs", "unallocated", 481548), ("Nothing read here", "unread", None)]
    checked = notices.checked(spark.createDataFrame([(1, NOTICE)], "notice_id int, text string")).first()
    assert (checked.printed, checked.limbs, checked.unread, checked.flags[:2]) == (Decimal(15), 5, 1, ["does_not_reconcile", "unread_figures"])


@pytest.mark.parametrize(
    ("text", "total"),
    [("Total tax due 10 2 3 0 15\nGrand total 10 20 30 0 60", 15), ("Total tax payable 500 0 0 0 500", 500), ("Grand total 10 20 30 0 60", None), ("Total demand 5\nwork 1 2 7 0 10", None), ("total amount payable as above: 4 4 4 0 12", 12), (None, None)],
)
def test_printed_total(spark, text, total):
    got = spark.createDataFrame([(text,)], "t string").select(limbs.printed_total(F.col("t")).alias("x")).first().x
    assert got == (None if total is None else Decimal(total))


def test_rows(spark):
    text = "IGST CGST SGST CESS\n• Credit excess :\n1 2 3 4 5\nExcess claimed 5 6 7 0 18\n• Other rows :\nplain 1 2 3 4 10 then 100 100 0 0 200\n• Not a row :\nsee GSTR-1 and GSTR-1, 1 and 1 2 3\n• Drift here :\nnet 1000.50 10 10 0 1022"
    got = {r.heading: (r.basis, r.heads) for r in read(spark, text)}
    assert got["Credit excess"] == ("labelled", {"igst": Decimal(5), "cgst": Decimal(6), "sgst": Decimal(7)})
    assert got["Other rows"] == ("largest", {"igst": Decimal(100), "cgst": Decimal(100)})
    assert got["Not a row"][0] == "unread" and got["Drift here"][0] == "labelled"


def test_headings(spark):
    both = "Defect -1: \n• Inner head :\nExcess 1,00,000.50 0 0 0 1,00,000.50\n1. Not this\nDefect - 2 : Trail\nDifference of 50 and 150"
    assert [(r["index"], r.heading, r.basis) for r in read(spark, both)] == [(1, "Inner head", "labelled"), (2, "Trail", "unallocated")]
    catalogue = [("credit", ["(?i)excess credit", "(?i)itc"]), ("fee", ["(?i)late fee"])]
    numbered = "1. Late fee for delay\nfoo\n2. A sentence on itc.\n7. ITC of the year\nbar\n3. Late fee again\n9. Rent of land"
    assert [(r["index"], r.heading) for r in read(spark, numbered, catalogue)] == [(1, "Late fee for delay"), (7, "ITC of the year")]
    prose = "Before it. The itc is wrong and the late fee was not paid; excess of 700"
    assert [(r["index"], r.heading, r.basis) for r in read(spark, prose, catalogue)] == [(1, "credit", "unread"), (2, "fee", "unallocated")]
    assert read(spark, None) == read(spark, "") == []


def test_operative_region(spark):
    head, tail = "x" * 600, "y" * 900
    texts = [f"{head} The total tax due on account of these deficiencies is {tail}", f"The total tax due on account of these deficiencies is {tail}", f"{head}\nProper officer\n{tail[:300]}", f"a\nProper officer\n{tail}"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(F.length(limbs.operative_region(F.col("t"))).alias("n")).collect()
    assert [r.n for r in got] == [601, len(texts[1]), 601, len(texts[3])]


def test_preamble_serves_the_first_limb(spark):
    got = read(spark, "Difference 5 5 0 0 10\n• First point :\nnothing\n• Second point :\nnothing")
    assert [r.basis for r in got] == ["labelled", "unread"]


def test_forms_and_dates(spark):
    df = spark.createDataFrame([("FORM GST APL - 05",), ("drc 13",), ("DRC-01A",), ("XDRC-01",)], "t string").select(notices.form_code(F.col("t")).alias("form"))
    assert [r.form for r in df.collect()] == ["APL-05", "DRC-13", "DRC-01A", None]
    named = notices.with_reply_form(df).collect()
    assert [(r.form, r.reply_form) for r in named] == [("APL-05", "APL-05"), ("DRC-13", "DRC-14 / representation"), ("DRC-01A", "DRC-01A Part B"), (None, None)] and named[3].statute == "As specified in the notice"
    days = spark.createDataFrame([("on 14th June, 2026 and 1 May 2025, 31/02/2020, 3-4-2021",)], "text string").select(F.lit(1).alias("notice_id"), "text")
    assert [str(d) for d in notices.fields(days).first().dates] == ["2026-06-14", "2025-05-01", "2021-04-03"]


def test_rankings_and_terms(spark):
    text = "1. Response B is my first impression\nORDER OF MERIT:\n1. Response A\n2. Response C\n3. Response Z"
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert one(talk.parse_ranking(F.lit(text))) == ["Response A", "Response C", "Response Z"]
    assert one(talk.parse_ranking(F.lit(text), F.array(F.lit("Response C"), F.lit("Response A")))) == ["Response A", "Response C"]
    assert one(talk.parse_ranking(F.lit("x FINAL RANKING: none"))) == []
    assert one(evaluate.terms(F.lit("Report of the tax data for each month: E-way bill"))) == ["e-way", "bill"]


def test_headers_follow_the_order_of_aliases():
    assert files.header_map(["Vendor GSTIN", "GSTIN", "Trade name", "Doc no"]) == {"supplier_gstin": 0, "supplier_name": 2, "invoice_no": 3}
    assert files.header_map(["GSTR-2A", "As per Books", "Net difference (Rs.)"]) == {"amount_2a": 0, "amount_books": 1, "difference": 2}


def test_names(spark):
    code = "29AAAAA0001A1Z5"
    far = "x " * 400
    cases = {
        f"Legal Name: Tvl. F Care Plus Llp\nGSTIN {code}": "F Care Plus Llp",
        f"Details of the Tax payer\nTrade Name\nAcme Foods\n{code}\nReg Status": "Acme Foods",
        f"Details of the Tax payer\nlegal name\n{code}\nM/s. Beta Works Ltd": "Beta Works Ltd",
        f"GSTIN : {code}\nGamma Steel Private Limited\n{far}\nTHE NEW INDIA ASSURANCE CO LIMITED": "Gamma Steel Private Limited",
        "no code, but Delta Traders and The Long Epsilon Industries": "The Long Epsilon Industries",
        f"{code} nobody": None,
    }
    df = spark.createDataFrame(list(enumerate(cases)), "i int, t string")
    assert [r.n for r in df.select("i", notices.entity_name(F.col("t")).alias("n")).orderBy("i").collect()] == list(cases.values())


def test_tiers(spark):
    from taxloom.operators import matters

    df = spark.createDataFrame([(" Free",), ("PRO",), (None,), ("gold",)], "t string")
    assert [r.x for r in df.select(matters.tier_of(F.col("t")).alias("x")).collect()] == ["draft", "pro", "draft", "draft"]
