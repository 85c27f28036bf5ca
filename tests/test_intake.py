"""Notice fields: portal rows, letters, windows, years, days, officers, and where each was read."""

import datetime

import pytest

from taxloom.operators import intake, notices

PORTAL = """FORM GST ASMT-10
Reference No : ZD330226255583F Date : 14/06/2026
GSTIN : 33AAAAA0001A1Z5
DIN : 20260659XY0000111AB2
Section under which the notice is issued - 61
Tax Period : 2022-23
Date by which reply has to be submitted : 30.06.2026
The rate was notified on 18.07.2022. ARN AD330226081676X. See section 16(2) (aa), u/s 73(1) and rule 36 (4).
A sum of Rs. 1,200.50 and INR 70 is due.
Signature
Name : R. KUMAR
Designation : Deputy State Tax Officer
Jurisdiction : RAM NAGAR , Coimbatore-
II , COIMBATORE , Tamil Nadu
"""
D = datetime.date


def read(spark, *texts):
    rows = notices.fields(spark.createDataFrame(list(enumerate(texts)), "notice_id int, text string")).orderBy("notice_id").collect()
    return rows[0] if len(texts) == 1 else rows


def test_portal_form(spark):
    x = read(spark, PORTAL)
    assert (x.reference, x.arn, x.din, x.gstin, x.state, x.form) == ("ZD330226255583F", "AD330226081676X", "20260659XY0000111AB2", "33AAAAA0001A1Z5", "Tamil Nadu", "ASMT-10")
    assert (x.section, x.sections, x.rules, x.period) == ("61", ["16(2)(aa)", "73(1)"], ["36(4)"], "2022-23")
    assert (x.notice_date, x.due_date, x.window_days) == (D(2026, 6, 14), D(2026, 6, 30), None)
    assert x.officer == "R. KUMAR, Deputy State Tax Officer" and x.office == "RAM NAGAR, Coimbatore-II, COIMBATORE, Tamil Nadu"
    assert [str(a) for a in x.amounts] == ["1200.50", "70.00"] and [str(d) for d in x.dates] == ["2026-06-14", "2026-06-30", "2022-07-18"]
    assert x.missing == ["name"]


def test_sources_and_snippets(spark):
    x = read(spark, PORTAL)
    assert x.sources["state"] == "gstin" and x.sources["section"] == x.sources["notice_date"] == x.sources["due_date"] == "notice-labelled" and x.sources["reference"] == "notice"
    assert set(x.sources) == set(x.snippets) and "name" not in x.sources
    for field, start in (("due_date", "Date by which"), ("section", "Section under"), ("gstin", "33AAAAA"), ("din", "DIN :"), ("form", "ASMT-10"), ("reference", "Reference No"), ("officer", "Signature"), ("office", "Jurisdiction")):
        assert PORTAL[x.snippets[field].offset :].startswith(start), field
        assert start.split()[0] in x.snippets[field].text


@pytest.mark.parametrize(("said", "due", "window", "source"), [
    ("You shall explain the reasons for the above discrepancy on or before 19.01.2026.", D(2026, 1, 19), None, "notice-directed"),
    ("File your objection\nif any, on or before 19/01/2026", D(2026, 1, 19), None, "notice-directed"),
    ("Show cause\n\nwhy it is not due, on or before 19-01-2026", D(2026, 1, 19), None, "notice-directed"),
    ("Appear in person on or before 19.01.2026", None, None, None),
    ("Invoices on or before 01.04.2020; " + "x" * 200 + " reply on or before 02.04.2020", D(2020, 4, 2), None, "notice-directed"),
    ("Reply " + "x" * 200 + " on or before 02.04.2020", None, None, None),
    ("reply within (30) days from the date of receipt of this notice", None, 30, None),
    ("reply within 15 days of service", None, 15, None),
    ("within 7 days from the issuance hereof", None, 7, None),
    ("within 15 days of service. Date by which the reply is to be submitted: 1.2.2026", D(2026, 2, 1), None, "notice-labelled"),
    ("Date by which reply has to be submitted: 31.02.2026. Reply on or before 01.03.2026", None, None, None),
])
def test_deadlines(spark, said, due, window, source):
    x = read(spark, said)
    assert (x.due_date, x.window_days, x.sources.get("due_date")) == (due, window, source)


def test_sections_and_years(spark):
    got = read(spark, "u/s 73(1)", "Section under which notice is issued: 73(1)", "sec. 16 ( 4 ) then Section 17(5)", "F.Y. 2019-20", "financial year 2019-2020", "in 2019–20 it was", "FY 2020/21 and 2017-18", "from 2019-2020", "")
    assert [x.section for x in got[:3]] == ["73(1)", "73", "16(4)"] and got[2].sections == ["16(4)", "17(5)"]
    assert [x.period for x in got[3:]] == ["2019-20", "2019-20", "2019-20", "2020-21", None, None]


def test_first_day_and_amounts(spark):
    a, b, c = read(spark, "dated 03/04/2024", "on the 99.99.2024, then on 14th June, 2026 and 1.1.2025", "RS. 5000 and rs 70, INR1,00,000.5 and Rs. , none")
    assert a.notice_date == D(2024, 4, 3) and a.sources["notice_date"] == "notice-inferred"
    assert b.notice_date == D(2026, 6, 14) and b.snippets["notice_date"].offset == 27 and len(b.dates) == 2
    assert [str(x) for x in c.amounts] == ["5000.00", "70.00", "100000.50"]


def test_references(spark):
    got = read(spark, "scrutiny ref ZD330226255583F", "notice proposing ZD330226255583F here", "ref no. zd330226255583f", "Reference No: 12345 Date: 1.2.2026", "no proposing", "Circle : Ram Nagar II, x")
    assert [x.reference for x in got] == ["ZD330226255583F", "ZD330226255583F", "zd330226255583f", None, None, None]
    assert got[3].notice_date == D(2026, 2, 1) and got[3].sources["notice_date"] == "notice-labelled" and got[5].office == "Ram Nagar II"


def test_marks_in_texts_and_nulls(spark):
    got = read(spark, "a\x01b\x02 GSTIN 33AAAAA0001A1Z5 \x01", None, "x" * 5000)
    assert got[0].gstin == "33AAAAA0001A1Z5" and got[0].snippets["gstin"].offset == 11
    assert got[1].gstin is None and got[2].missing == list(notices.FIELDS)


def test_one_scan(spark):
    plan = notices.fields(spark.createDataFrame([(1, "x")], "notice_id int, text string")).select("gstin", "din", "office", "sections", "due_date", "snippets")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace(translate(") <= 1, plan[:3000]
    assert intake.GROUPS.count("dated_id") == 1
