from decimal import Decimal

from pyspark.sql import functions as F

from taxloom.operators import evaluate, filing
from taxloom.streaming.lockout import lockouts_batch


def test_numbered_scrub(spark):
    rows = [("PAN AAAPA1234A and BBBPB1234B, mail a@b.in; ACME traders, Acme", "Acme Traders"), (None, None), ("nothing", "ab")]
    df = spark.createDataFrame(rows, "t string, c string").select(filing.numbered(F.col("t"), F.col("c")).alias("s"))
    got = [r.s for r in df.collect()]
    assert got[0].text == "PAN [PAN-1] and [PAN-2], mail [EMAIL-1]; the Taxpayer, the Taxpayer"
    assert got[0].tokens == {"the Taxpayer": "Acme Traders", "[PAN-1]": "AAAPA1234A", "[PAN-2]": "BBBPB1234B", "[EMAIL-1]": "a@b.in"}
    assert (got[1].text, got[1].tokens, got[2].text) == ("", {}, "nothing")


def test_anonymised(spark):
    kind = "id int, client_name string, gstin string, facts string, amount_disputed double, defects array<struct<index:int,heading:string,preamble:string>>"
    df = spark.createDataFrame([(1, "Acme Ltd", "29AAAAA0001A1Z5", "Acme Ltd of 29AAAAA0001A1Z5", 2_000_000.0, [(1, "Credit of acme", None)]), (2, None, None, None, None, None)], kind)
    got = {r.id: r for r in filing.anonymised(df).collect()}
    assert set(got[1].asDict()) == {"id", "facts", "amount_disputed", "defects", "tokens"}
    assert (got[1].facts, got[1].amount_disputed, got[1].defects[0].heading, got[1].defects[0].preamble) == ("the Taxpayer of [GSTIN-1]", "INR 10-50 lakh", "Credit of the Taxpayer", None)
    assert got[1].tokens["facts: [GSTIN-1]"] == "29AAAAA0001A1Z5" and got[2].facts is None and got[2].amount_disputed is None


def test_prose(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert [one(filing.is_residue(F.lit(t))) for t in ("1 2 3 4", "1 2 3", "S.No and so", "SGST CGST IGST", "12345 ab", "a plain sentence 7")] == [True, True, True, True, True, False]
    assert one(filing.contention(F.lit("•  First: it is so. 1 2 3 4 5. ok"))) == "First: it is so." and one(filing.contention(F.lit(None).cast("string"))) == ""
    assert one(filing.opening(F.lit("A. B. C. D."))) == "A. B. C."
    long = "word " * 100
    s = one(filing.snippet_at(F.lit(long), F.lit(200)))
    assert s.truncated_start and s.truncated_end and s.text.startswith("word") and s.text.endswith("word") and len(s.text) <= 200
    assert one(filing.snippet_at(F.lit("short"), F.lit(2))).text == "short" and one(filing.snippet_at(F.lit(None).cast("string"), F.lit(2))) is None


def test_amounts_and_blockers(spark):
    matters = spark.createDataFrame([(1, 50.0), (2, 50.0), (3, 0.0), (4, 70.0)], "matter_id int, declared double")
    limbs = spark.createDataFrame([(1, 1, "h", 10.0), (2, 1, "h", 10.0), (2, 2, None, None), (3, 1, "h", None)], "matter_id int, index int, heading string, total double")
    assert {r.matter_id: (r.amount, r.incomplete) for r in filing.matter_amounts(matters, limbs).collect()} == {1: (Decimal(10), False), 2: (Decimal(50), True), 3: (Decimal(0), True), 4: (Decimal(70), False)}
    told = spark.createDataFrame([(2, 1, "cites 1 GSTL 2 wrongly")], "matter_id int, index int, text string")
    gaps = spark.createDataFrame([(2, "1 GSTL 2", "not verified"), (2, "9 GSTL 9", "not covered")], "matter_id int, citation string, text string")
    got = filing.filing_blockers(told, gaps, limbs).where("matter_id = 2").orderBy("number").collect()
    assert [r.text for r in got] == ["cites 1 GSTL 2 wrongly", "not covered", "Limb 2 (unheaded): the amount could not be read"]


def test_scores(spark):
    results = spark.createDataFrame([(1, "Limitation  ran\nout", ["limitation ran out", "rate"]), (2, "x", None), (3, None, ["rate"])], "matter_id int, text string, issues array<string>")
    assert {r.matter_id: (r.rate, r.missed, r.passed) for r in evaluate.issue_coverage(results).collect()} == {1: (0.5, ["rate"], False), 2: (None, None, None), 3: (0.0, ["rate"], False)}
    kind = "struct<recommended_position:string,lead_argument:string,preliminary_submissions:string,working_note:string,board_summary:string,risk_flags:array<string>,defects:array<struct<heading:string,our_position:string,department_contention:string,facts:string,submission:string,prayer_relief:string,evidence_required:array<string>,evidence_gap:array<string>>>>"
    d = spark.createDataFrame([((("contest", None, "p", None, None, ["flag"], [("h", None, None, None, "s", None, ["ledger", "bill"], None)])),)], f"d {kind}")
    assert d.select(evaluate.determination_text("d").alias("t")).first().t == "contest\np\nh\ns\nledger\nbill\nflag"
    costs = spark.createDataFrame([(True, 1.0), (False, None), (None, 0.5)], "passed boolean, cost double")
    card = evaluate.scorecard(costs, [], "cost").first()
    assert (card.matters, card.passed, card.total_cost, card.cost_per_matter) == (3, 1, 1.5, 0.5)


def test_lockouts_over_batches(spark):
    rows = [(k, float(i), False) for k in ("a", None, "b") for i in range(7)]
    df = spark.createDataFrame(rows, "key string, at double, success boolean")
    size = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.set(size, "3")
    try:
        got = {r.key: (r.attempts, r.refused, r.locks, r.failures) for r in lockouts_batch(df).collect()}
    finally:
        spark.conf.unset(size)
    assert got == dict.fromkeys(["a", None, "b"], (7, 2, 1, 5)) and lockouts_batch(df.limit(0)).count() == 0


def test_pack_is_a_parameter(spark):
    from taxloom.operators import reconcile
    from taxloom.plans.dimensions import Pack

    pack = Pack(buckets=(("late", "Late", "weak", ["delay"]), ("open", "Open", "weak", [])), by_name=("late",), rest="open")
    rows = [("r", "delayed", "x", "1", "5", None, None, None, "g1"), ("r", "", "delay ltd", "2", "7", None, None, None, "g2"), ("r", "rcm", "y", "3", "9", None, None, None, None)]
    df = spark.createDataFrame(rows, "recon_id string, status string, supplier_name string, invoice_no string, difference string, amount_books string, amount_2a string, tax_amount string, supplier_gstin string")
    assert {r.bucket: (r.lines, r.label) for r in reconcile.summary(df, pack).collect()} == {"late": (2, "Late"), "open": (1, "Open")}
    got = reconcile.registers(df, pack).first()
    assert (got.total, got.suppliers, got.mostly_open) == (21.0, 2, True)


def test_client_leaks(spark):
    from taxloom.operators import talk

    df = spark.createDataFrame([(1, "ACME and acme, a@b.in", "Acme"), (2, "none", "Acme"), (3, "ab ab", "ab"), (4, None, None)], "i int, t string, c string")
    assert {r.label: (r.matches, r.texts) for r in talk.audit_leaks(df, "i", "t", "c").collect()} == {"CLIENT": (2, 1), "EMAIL": (1, 1)}
