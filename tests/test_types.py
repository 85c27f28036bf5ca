from pyspark.sql import functions as F

from taxloom.operators import desk, notices, talk
from taxloom.sources import files


def test_limb_types(spark):
    catalogue = [("credit", ["(?i)credit", "(?i)itc"]), ("fee", ["(?i)late fee"])]
    rows = [(1, "Excess credit", "late fee"), (2, "Late fee", "itc credit"), (3, None, None), (4, "x", "late fee, credit")]
    df = spark.createDataFrame(rows, "index int, heading string, body string")
    assert {r["index"]: r.type for r in notices.typed(df, catalogue).collect()} == {1: "credit", 2: "fee", 3: None, 4: "credit"}
    assert notices.typed(df, []).where("type is not null").count() == 0


def test_restore(spark):
    df = spark.createDataFrame([("[PAN-1] and [PAN-11]", {"[PAN-1]": "A", "[PAN-11]": "B"}), ("same", None), (None, {"x": "y"})], "t string, m map<string,string>")
    assert [r.x for r in df.select(talk.restore(F.col("t"), F.col("m")).alias("x")).collect()] == ["A and B", "same", None]


def test_catalogue(spark):
    rows = [("Input tax credit availed in excess of that appearing in GSTR-2B", "late fee"), ("Suppliers who have not filed", ""), ("x", "See section 129 and late fee, section 47"), (None, None)]
    got = [(r.type, r.posture, r.tags[-1]) for r in notices.catalogued(spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "index int, heading string, body string")).orderBy("index").collect()]
    assert got == [("itc_excess_2b", "undecided", "itc_excess_2b"), ("itc_supplier_default", "contested", "itc_supplier_default"), ("late_fee", "agreed_paid", "late_fee"), ("other", "undecided", "other")]


def test_guard_in_one_pass(spark, tmp_path):
    df = spark.createDataFrame([(1, "PAN AAAAA1111A, a@b.co"), (2, None), (3, "plain 12345678901234567890123")], "id int, text string")
    assert talk.write_guarded(df, "text", str(tmp_path / "out")) == (3, 0)
    got = {r.id: (r.scrubbed, r.leaks) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got[1] == ("PAN [PAN], [EMAIL]", "false") and got[2] == (None, "false")
    plan = talk.audit_leaks(df, "id", "text", labels=["PAN"]).collect()
    assert [(r.label, r.matches, r.texts) for r in plan] == [("PAN", 1, 1)]


def test_what_a_role_sees_and_files(spark, tmp_path):
    m = spark.createDataFrame([(1, 2, "x", "y")], "id int, cost int, analyses string, verdict string")
    assert desk.redacted(m, True, True).columns == m.columns and tuple(desk.redacted(m, False, False).first()) == (1, "", "y", True)
    lists = m.withColumn("analyses", F.array("analyses"))
    assert desk.redacted(lists, True, False).first().analyses == []
    (tmp_path / "n").mkdir()
    (tmp_path / "n" / "a.txt").write_text("FORM GST DRC-01\nGSTIN 33AAAAA0001A1Z5")
    read = files.read_notices(spark, str(tmp_path / "n"))
    assert [(r.notice_id, r.gstin, r.form) for r in notices.fields(read).collect()] == [("a.txt", "33AAAAA0001A1Z5", "DRC-01")]
    notices.review_sheet(notices.checked(read), str(tmp_path / "sheet"))
    sheet = spark.read.option("header", True).csv(str(tmp_path / "sheet")).first()
    assert (sheet.notice_id, sheet.limbs, sheet.reconciles, sheet.correct) == ("a.txt", "0", None, None) and sheet.flags.startswith("no_limbs; scan")
    said = spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "assistant", " "), (1, 2, "assistant", "b" * 2000), (1, 3, "user", "c"), (1, 4, "system", "s")], "conv_id int, turn int, role string, text string")
    assert talk.snippet(said, n=1).first().snippet == f"assistant: {'b' * 1500} [cut]\n\nuser: c"
    limbs = spark.createDataFrame([(1, 1, "t", ["A"], ["x", "y"], ["x"]), (1, 2, None, None, ["x"], None)], "matter_id int, index int, type string, annexures array<string>, evidence_required array<string>, evidence_held array<string>")
    asks = spark.createDataFrame([("t", ["q1"])], "type string, questions array<string>")
    assert [(r.questions, r.carry, r.gaps) for r in desk.hearing_brief(limbs, asks, ["d"]).orderBy("index").collect()] == [(["q1"], ["A"], ["y"]), (["d"], ["x"], ["x"])]
