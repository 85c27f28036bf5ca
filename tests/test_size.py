"""Work that must stay bounded as tables grow: tasks by rows, fields read on their own, and steps that only what is asked for pays for."""

from pyspark.sql import functions as F

from taxloom.operators import citations, evaluate, filing, intake, limbs, notices, talk
from taxloom.queries import QUERIES
from taxloom.sources import views

SF = "/root/testdata/sf0.001"


def test_tasks_of_a_view_have_bounded_rows(spark, monkeypatch):
    monkeypatch.setattr(views, "TASK_ROWS", 100)
    df = views.view(spark, SF, "notices")
    assert df.rdd.getNumPartitions() == -(-df.count() // 100) > 2
    assert df.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0] <= 110


def test_jurisdictions_need_no_scan(spark):
    assert "reference\\s*No" not in QUERIES["jurisdictions"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    texts = ["GSTIN : 33AAAAA0001A1Z5, 27AAAAA0001A1Z5", "x33AAAAA0001A1Z5", "33aaaaa0001A1Z5", "", None]
    rows = spark.createDataFrame(list(enumerate(texts)), "notice_id int, text string")
    want = {r.notice_id: r.gstin for r in notices.fields(rows).collect()}
    assert {r.notice_id: r.gstin for r in notices.identified(rows).collect()} == want and want[0] == "33AAAAA0001A1Z5"


def test_a_place_is_tried_by_its_first_characters(spark):
    """Every kind has a guard, but the sign of an amount, and what it lets through is found as before."""
    assert all(look for look, of in intake.KINDS if len(of) > 1)
    text = "REF NO ZD330226255583F; Ref. Date by which reply to be submitted 01.02.2020, rs 5 INR 6 ₹ 7, FY2019-20, F.Y. 2018-19, u/s 16 sec 5 Sec.6, MOV-07 drc 01A"
    x = notices.fields(spark.createDataFrame([(1, text)], "notice_id int, text string")).first()
    assert (x.reference, str(x.due_date), [int(a) for a in x.amounts], x.period, x.sections, x.form) == ("ZD330226255583F", "2020-02-01", [5, 6, 7], "2019-20", ["16", "5", "6"], "DRC-01A")


def test_one_type_does_not_gather_hearing_briefs(spark):
    plan = QUERIES["hearing_briefs"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning(type" not in plan


def test_guarded_scrubs_once(spark):
    texts = ["mail a.b@c.in", "GSTIN 27AAPFU0939F1ZV, 9876543210", "no digits", "a 1234 @ b", None, ""]
    clean, leaks = talk.guarded(spark.createDataFrame([(t,) for t in texts], "t string"), "t")
    assert sorted(str(r.scrubbed) for r in clean.collect()) == sorted(["mail [EMAIL]", "GSTIN [GSTIN], [PHONE]", "no digits", "a 1234 @ b", "None", ""]) and leaks.count() == 0
    plan = QUERIES["scrubbed_clean"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("[GSTIN]") == 1


def test_limbs_with_the_same_tags_share_a_list(spark):
    library = spark.createDataFrame([(i, "filed", "case", [f"t{i % 3}"]) for i in range(9)], "authority_id int, certainty string, kind string, tags array<string>")
    limbs = spark.createDataFrame([(1, 1, ["t1", "t1"]), (1, 1, ["t0"]), (2, 1, ["t0", "t1"]), (3, 1, ["t2", None]), (4, 1, []), (5, 1, None)], "matter_id int, index int, tags array<string>")
    df = citations.authorities_for(limbs, library, 2)
    assert sorted((r.matter_id, r["rank"], r.authority_id) for r in df.collect()) == [(1, 1, 0), (1, 2, 1), (2, 1, 0), (2, 2, 1), (3, 1, 2), (3, 2, 5)]
    assert "Aggregate [set" in df._jdf.queryExecution().optimizedPlan().toString()


def test_contention_stops_at_its_limit(spark):
    text = "• " + "x" * 400 + ". " + "y" * 300 + ". 1 2 3 4 5 6. " + "z" * 9 + ".\t\n" + "w" * 50 + ". end"
    got = spark.range(1).select(filing.contention(F.lit(text)).alias("c"), filing.opening(F.lit(text)).alias("o")).first()
    assert got.c == "x" * 400 + ". " + "y" * 300 + "." and got.o == ("• " + "x" * 400 + ". " + "y" * 300 + ". 1 2 3 4 5 6.")[:800]


def test_extraction_reads_notices_once(spark):
    expected = spark.createDataFrame([(1, 1, "a", 5.0, None, False), (1, 2, "b", 7.0, None, False), (2, 1, "a", 0.0, None, True)], "notice_id int, index int, type string, total double, declared double, may_be_unread boolean")
    read = spark.createDataFrame([(1, 1, "a", 7.0), (1, 2, "b", None), (2, 1, "a", 3.0)], "notice_id int, index int, type string, total double")
    df = evaluate.extraction_scores(expected, read)
    assert {r.notice_id: (r.found, r.off, r.unread) for r in df.collect()} == {1: (2, 2, 1), 2: (1, 0, 0)}
    assert df._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1


def test_rows_of_figures_at_their_limits(spark):
    """The sum may be off by 2 rupees and by half a percent, exactly; figures too long for money are none."""
    said = ["100 100 100 100 402", "100 100 100 100 402.02", "100 100 100 0 301.50", "100 100 100 0 301.51", "1 2 3 3 9", "1 2 3 4 10", "9999999999999999 0 0 0 9999999999999999", "99999999999999999 0 0 0 99999999999999999"]
    rows = spark.createDataFrame([(t,) for t in said], "t string").select("t", F.size(limbs.head_rows(F.col("t"))).alias("n")).collect()
    assert [r.n for r in rows] == [1, 0, 1, 0, 0, 1, 1, 0]
