"""Readings of texts in batches: what is tried where, which line ends count, and that what isn't asked for isn't read."""

import re

from taxloom.functions.texts import Lines, paise, pattern, rupees
from taxloom.operators import filing, intake, notices
from taxloom.queries import QUERIES

SF = "/root/testdata/sf0.001"
ODD = [
    "xref no ZD123456789012A, rsec 5; SE1234567890123 FY12345678901 FY2019-20, F.Y. 2018 / 19 20-21 2020 – 21", "₹ 5 é₹6 Rs.7 inr 8,000.5 rs", "Reference No : ZD330226255583F Date : 14/06/2026\x01\x02", "GSTIN33AAAAA0001A1Z5 33AAAAA0001A1Z5 133AAAAA0001A1Z5 on  or\nbefore 1.2.2026",
    "1st may 2025, 14th June, 2026 12345.50 1-2-2026 u/s 16 ( 4 ) rules 36 drc\n01a apl - 05 XDRC-01 din 20260659XY0000111AB2 Legal  Name: Tvl. A B", "", "Date by which reply to be submitted 01.02.2020 within (5) days of service Circle : A b\r\nDesignation : Of\n", "\n".join(["tax period 2017-18 " + "x" * 50] * 30),
]


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_only_places_that_may_begin_a_match_are_tried(monkeypatch):
    """As if every kind were tried at every place, whatever the blocks."""
    whole = [(kind, pattern((r"\b" if look.endswith(r"\b") else "") + f"(?:{p})", re.I)) for look, of in intake.KINDS for kind, p in of]

    def slow(t):
        found, at = {}, 0
        while at < len(t):
            kind, m = next(((k, m) for k, p in whole if (m := p.match(t, at))), (None, None))
            if m:
                found.setdefault(kind, []).append((at, m[1]))
                if kind == "dated" and m[2]:
                    found.setdefault("dated_id", []).append((at, m[2]))
            at = m.end() if m else at + 1
        return found

    for block in (1, 300, 1 << 16):
        monkeypatch.setattr(intake, "BLOCK", block)
        assert list(intake.scan(ODD)) == [slow(t) for t in ODD]


def test_fields_are_read_in_batches(spark):
    text = plan(QUERIES["notice_fields"](spark, SF))
    assert text.count("ArrowEvalPython") == 1 and "lambda" not in text.replace("lambdafunction(", "")
    got = notices.fields(spark.createDataFrame([(i, t) for i, t in enumerate(ODD)], "notice_id int, text string")).orderBy("notice_id").collect()
    assert [x.reference for x in got[:3]] == ["ZD123456789012A", None, "ZD330226255583F"] and str(got[2].notice_date) == "2026-06-14" and [str(a) for a in got[1].amounts] == ["5.00", "6.00", "7.00", "8000.50"]


def test_sources_are_read_with_their_snippets(spark):
    df = QUERIES["field_sources"](spark, SF)
    assert "truncated_start" not in df._jdf.queryExecution().optimizedPlan().toString().split("Generate")[0] and plan(df).count("ArrowEvalPython") == 1
    long = "x " * 100 + "DIN : 20260659XY0000111AB2 " + "y " * 100
    row = notices.sourced(spark.createDataFrame([(1, long)], "notice_id int, text string"), ("din",)).first()
    want = notices.fields(spark.createDataFrame([(1, long)], "notice_id int, text string")).select("snippets").first().snippets["din"]
    assert row.snippet == want and want.truncated_start and want.truncated_end


def test_lines_end_as_in_spark():
    begins = lambda t: [a for a, _ in Lines(r"(?=.{1}b$)").spans(t)]
    assert begins("ab\nab\rab\r\nab ab") == [0, 3, 6, 10, 13] and begins("ab\n\nab\nabc") == [0, 4] and begins("\x85b\nab") == [3]
    assert Lines(r"\s*x$").first("a\n\n x\n").start() == 2 and Lines("x").first("") is None


def test_money():
    assert [paise(x) for x in ("1,00,000.5", "7", "0.05", ",", "9999999999999999", "10000000000000000", "00000000000000000007")] == [10000050, 700, 5, None, 999999999999999900, None, 700]
    assert [str(x) for x in rupees([123, None, -5, 999999999999999999]).to_pylist()] == ["1.23", "None", "-0.05", "9999999999999999.99"]


def test_checks_read_figures_in_batches(spark):
    text = plan(QUERIES["notice_checks"](spark, SF))
    assert "ArrowEvalPython" in text and "regexp_extract_all" not in text
    told = "1. A point is made\nDifference 5 5 0 0 10\n2. Another point\nDifference 1 9 10 0 20\nProper officer\nTotal demand 6 14 10 0 30"
    rows = notices.checked(spark.createDataFrame([(1, None), (2, told), (3, told.replace("\n", "\r\n"))], "notice_id int, text string")).orderBy("notice_id").collect()
    assert [(r.limbs, r.limb_sum, r.unread, r.printed, r.reconciles) for r in rows] == [(0, None, 0, None, None), *[(2, 30, 0, 30, True)] * 2]


def test_the_report_reads_no_fields(spark):
    text = plan(QUERIES["corpus_report"](spark, SF))
    arrow = next(line for line in text.splitlines() if "ArrowEvalPython" in line)
    assert text.count("ArrowEvalPython") == 1 and arrow.count("batch(") == 1


def test_prose_is_read_in_batches(spark):
    text = plan(QUERIES["contentions"](spark, SF))
    assert text.count("ArrowEvalPython") == 1 and "lambda" not in text.replace("lambdafunction(", "")
    said = ["•  First :\tit  is so.\n1 2 3 4 5. ok. no\xa0end. x", "a.b: c. ddd", " . : x", "", None, "1,2 , , 3 4 and 5", "x" * 699 + ". " + "y" * 5 + ": zzz. more"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(said)], "i int, t string").select(filing.contention("t").alias("c"), filing.opening("t").alias("o")).collect()
    assert [r.c for r in rows] == ["First : it is so. ok. no\xa0end.", "a.b: ddd", "", "", "", "", "x" * 699 + ". yyyyy:"]
    assert [r.o for r in rows[:5]] == ["• First : it is so. 1 2 3 4 5.", "a.b: c. ddd", ". : x", "", ""]
