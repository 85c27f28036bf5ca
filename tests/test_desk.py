import csv
import io
import json

from pyspark.sql import functions as F

from taxloom.operators import citations, desk, evaluate, notices
from taxloom.sources import files


def test_registers(spark, tmp_path):
    (tmp_path / "a.csv").write_text('Register of Q1\n\nSupplier GSTIN;Party Name;Bill No;As per Books;GSTR-2A;Remarks\n29AAAAA0001A1Z5;"Acme; Co";7;1,000;900;timing\n\n;b;8;(5);;\n')
    (tmp_path / "b.csv").write_text("Invoice No,Variance,Reason\n9,12.5,RCM\n")
    got = {(r.recon_id, r.row_no): r for r in files.read_registers(spark, str(tmp_path)).collect()}
    assert set(got) == {("a.csv", 3), ("a.csv", 5), ("b.csv", 1)}
    a = got["a.csv", 3]
    assert (a.supplier_gstin, a.supplier_name, a.invoice_no, a.amount_books, a.amount_2a, a.status, a.difference) == ("29AAAAA0001A1Z5", "Acme; Co", "7", "1,000", "900", "timing", None)
    assert (got["b.csv", 1].difference, got["b.csv", 1].status) == ("12.5", "RCM")


def test_wide_register(spark, tmp_path):
    fill = [f"extra column {i}" for i in range(60)]
    (tmp_path / "wide.csv").write_text("\n".join(",".join(r) for r in (["GSTIN", "Invoice No", *fill, "Status"], ["29AAAAA0001A1Z5", "7", *["x"] * 60, "timing"])))
    got = files.read_registers(spark, str(tmp_path)).first()
    assert (got.supplier_gstin, got.invoice_no, got.status) == ("29AAAAA0001A1Z5", "7", "timing")


def test_json_sources(spark, tmp_path):
    (tmp_path / "x.json").write_text(json.dumps({"intake": {"gstin": "g"}}))
    (tmp_path / "y.json").write_text("{broken")
    (tmp_path / "z.json").write_text(json.dumps({"id": "zz"}))
    assert [r.id for r in files.load_golden(spark, str(tmp_path), "id string, intake struct<gstin:string>").collect()] == ["x"]
    assert [r.id for r in files.read_documents_json(spark, str(tmp_path), "id string, intake struct<gstin:string>", ["id"]).collect()] == ["zz"]


def test_notice_edges(spark):
    rows = [("none", None), ("empty", ""), ("window", "Reply within 30 days of the receipt of this. Difference 12"), ("defects", "1. not this\nDefect -1 Credit\nDifference 10 10 0 0 20\nDefect - 2 Fee\nnothing")]
    df = spark.createDataFrame(rows, "notice_id string, text string")
    got = {r.notice_id: r for r in notices.checked(df).collect()}
    assert got["none"].limbs == got["empty"].limbs == got["window"].limbs == 0 and "window_without_date" in got["window"].flags
    assert (got["defects"].limbs, float(got["defects"].limb_sum), got["defects"].unread) == (2, 20.0, 1)
    bad = spark.createDataFrame([("n", "on or before 31/02/2024 reply")], "notice_id string, text string")
    assert notices.fields(bad).first().dates == []


def test_sets(spark):
    found = spark.createDataFrame([("s", 2, "gstin", "b", False), ("s", 1, "gstin", "a", True), ("s", 0, "gstin", " ", False)], "set_id string, doc_no int, field string, value string, scanned boolean")
    assert [(r.value, r.source) for r in notices.merge_sets(found).collect()] == [("a", "1-ocr")]
    counts = spark.createDataFrame([("s", 0, 2), ("s", 1, 3), ("s", 2, 3)], "set_id string, doc_no int, limbs int")
    assert notices.limb_document(counts).first().doc_no == 1


def test_citations_in_text(spark):
    t = "See (2023) 45 GSTL 123 and ( 2023 ) 45 GSTL 123; AIR 2019 SC 456. Circular No. 183/15/2022 applies, as (2023)  45 gstl 123."
    got = spark.createDataFrame([(t,), (None,)], "t string").select(citations.in_text(F.col("t")).alias("c")).collect()
    assert got[0].c == ["(2023) 45 GSTL 123", "( 2023 ) 45 GSTL 123", "AIR 2019 SC 456", "Circular No. 183/15/2022"] and got[1].c is None


def test_limb_matching_and_gaps(spark):
    expected = spark.createDataFrame([("m", 1, "zzz"), ("m", 7, "Late  fee"), ("m", 9, "nowhere")], "matter_id string, index int, fragment string")
    produced = spark.createDataFrame([("m", 1, "Excess"), ("m", 2, "On late fee"), ("m", 3, "late fee")], "matter_id string, index int, heading string")
    assert {r["index"]: r.produced for r in evaluate.matched_limbs(expected, produced).collect()} == {1: 1, 7: 2, 9: None}
    row = spark.range(1).select(evaluate.gap_caught(F.lit("Copy of the bank statement"), F.lit("the BANK says")).alias("a"), evaluate.gap_caught(F.lit("Ledger"), F.lit(None).cast("string")).alias("b")).first()
    assert (row.a, row.b) == (True, False)


def test_merge_and_problems(spark):
    limbs = spark.createDataFrame([("m", 1, "h1", 10.0, None, '{"submission": "old"}'), ("m", 2, "h2", None, None, '{"submission": "keep"}'), ("m", 3, "h3", 1.0, "partial", None), ("m", 4, "h4", 1.0, "partial", None)], "matter_id string, index int, heading string, total double, posture string, held string")
    said = [("m", 1, 0, '{"posture": "contested", "submission": "new"}'), ("m", 2, 0, '{"posture": "bogus", "submission": ""}'), ("m", 5, 0, '{"posture": "partial", "submission": "extra"}'), ("m", 4, 0, '{"facts": 5, "payment": "in words", "splits": [], "legal_framework": ["a"]}')]
    said += [("m", 1, 1, '{"posture": "explained", "submission": null, "payment": {"reference": "R"}}'), ("m", 1, 2, '["no object"]'), ("m", None, 0, None)]
    answers = spark.createDataFrame(said, "matter_id string, index int, place int, answer string")
    variant = lambda df, c: df.withColumn(c, F.parse_json(c))
    rows = {r["index"]: r for r in desk.merged(variant(limbs, "held"), variant(answers, "answer")).where("index is not null").collect()}
    got = {i: (r.heading, r.posture, r.submission, r.answered) for i, r in rows.items()}
    assert got == {1: ("h1", "explained", "new", True), 2: ("h2", "undecided", "keep", True), 3: ("h3", "partial", None, False), 4: ("h4", "partial", None, True), 5: (None, "partial", "extra", True)}
    assert rows[1].payment == '{"reference":"R"}' and (rows[4].facts, rows[4].payment, rows[4].splits, rows[4].legal_framework) == ("5", None, None, '["a"]')
    kind = "matter_id string, index int, posture string, payment_ref string, accepted double, disputed double, total double, annexures array<string>, evidence_required array<string>, evidence_held array<string>"
    rows = spark.createDataFrame([("m", 1, None, None, None, None, 5.0, ["A"], ["x"], ["x"]), ("m", 2, "partial", None, 1.0, 2.0, 9.0, None, ["x"], None), ("m", 3, "agreed_paid", "", None, None, 1.0, ["B", "C"], None, None)], kind)
    assert [(r.number, r["index"], r.problem) for r in desk.problems(rows).orderBy("number").collect()] == [(1, 1, "no_posture"), (2, 2, "split_off"), (3, 2, "no_annexure"), (4, 2, "evidence_gap"), (5, 3, "paid_without_reference")]
    assert [(r.annexure, r.number) for r in desk.annexures(rows).orderBy("number").collect()] == [("A", 1), ("B", 2), ("C", 3)]


def test_recover_json(spark):
    texts = ['{"a": 1}', 'so\n```json\n{"b": 2}\n```', 'well {not json} then {"c": {"d": "}"}} end', "nothing", None]
    got = desk.recovered(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string"), "t").orderBy("i").collect()
    assert [json.loads(r.json) if r.json else None for r in got] == [{"a": 1}, {"b": 2}, {"c": {"d": "}"}}, None, None]
    assert [r.degraded for r in got] == [False, False, False, True, True]


def test_pages(spark):
    boxes = spark.createDataFrame([("p", 0.0, 50.0, "b", 0.9), ("p", 10.0, 0.0, "a", 0.7), ("p", 20.0, 0.0, "c", 0.95), ("p", 30.0, 5.0, "d", 0.99)], "page_id string, top double, left double, text string, confidence double")
    lines = desk.page_lines(boxes)
    assert [(r.text, r.confidence) for r in lines.orderBy("line_no").collect()] == [("a b", 0.7), ("c d", 0.95)]
    q = desk.page_quality(lines).first()
    assert (q.lines, q.doubtful, q.doubtful_lines, q.poor) == (2, 1, ["a b"], True)


def test_estimates_and_fit(spark):
    matters = spark.createDataFrame([(1, "pro", 2), (2, "draft", 0), (3, "draft", 3)], "matter_id int, tier string, argued int")
    rates = spark.createDataFrame([("draft", 0.05, 3), ("pro", 9.0, 2)], "tier string, rate double, samples int")
    assert {r.matter_id: (r.learned, r.usd) for r in desk.estimates(matters, rates).collect()} == {1: (False, 0.48), 2: (True, 0.0), 3: (True, 0.15)}
    slots = spark.createDataFrame([("cheap", "v", 10, 5.0), ("big", "w", 10, None)], "slot string, vendor string, least_context int, price_ceiling double")
    models = spark.createDataFrame([("v/a", "v", 20, 4.0), ("w/b", "w", 30, 1.0), ("w/c", "w", 5, 1.0), ("x/d", "x", 90, 0.0), ("x/e", "x", None, 2.0), ("x/f", "x", 50, None)], "model_id string, vendor string, context int, price double")
    assert [(r.slot, r.model_id) for r in desk.fitting(slots, models).orderBy("slot", "rank").collect()] == [("big", "w/b"), ("big", "v/a"), ("big", "x/e"), ("cheap", "v/a"), ("cheap", "w/b"), ("cheap", "x/e")]
    names = spark.createDataFrame([("a", "x/e", 10, 5.0), ("b", "w/c", 10, None), ("c", "x/f", 10, 5.0)], "slot string, model_id string, least_context int, price_ceiling double")
    assert {r.slot: r.verdict for r in desk.verdicts(names, models).collect()} == {"a": "OK", "b": "WRONG SHAPE", "c": "OK"}
    tiers = spark.createDataFrame([(1, "free", 1), (2, None, 1), (3, "", 1), (4, " Pro", 1), (5, "gold", 1)], "matter_id int, tier string, argued int")
    assert {r.matter_id: (r.tier, r.usd) for r in desk.estimates(tiers, rates.limit(0)).collect()} == {1: ("draft", 0.03), 2: ("pro", 0.3), 3: ("pro", 0.3), 4: ("pro", 0.3), 5: ("draft", 0.03)}


def test_totals_stream_agrees_with_batch(spark, tmp_path):
    from taxloom.sources.views import view
    from taxloom.streaming.totals import keep_totals

    lines = view(spark, "/root/testdata/sf0.001", "register_lines")
    lines.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(lines.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    keep_totals(stream).writeStream.format("memory").queryName("sums").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    batch = keep_totals(lines)
    assert sorted(map(str, spark.table("sums").collect())) == sorted(map(str, batch.collect()))


def test_last_verdict_counts_and_lists(spark):
    found = spark.createDataFrame([(1, 0, "a", "settled"), (1, 1, "b", "settled")], "matter_id int, position int, citation string, certainty string")
    said = spark.createDataFrame([(1, 0, 1, "verified", "b"), (1, 0, 0, "NOT_FOUND", "a")], "matter_id int, position int, place int, status string, note string").withColumn("as_of", F.lit(None).cast("date"))
    got = citations.judged(found, said)
    assert {r.position: (r.status, r.note) for r in got.collect()} == {0: ("VERIFIED", "b"), 1: ("UNVERIFIED", None)}
    assert (lambda r: (r.verified, r.total))(citations.verification(got).first()) == (1, 2)
    library = spark.createDataFrame([(i, "filed" if i > 15 else "to_verify", "statute" if i % 2 else "case", ["t", "t", f"u{i % 3}"]) for i in range(20)], "authority_id int, certainty string, kind string, tags array<string>")
    limbs = spark.createDataFrame([(1, 1, ["t", "u0"]), (1, 2, ["u1", "t"]), (1, 3, ["none"]), (1, 4, None)], "matter_id int, index int, tags array<string>")
    rows = citations.authorities_for(limbs, library, 3).orderBy("index", "rank").collect()
    assert [(r["index"], r.authority_id, r["rank"]) for r in rows] == [(1, 17, 1), (1, 19, 2), (1, 16, 3), (2, 17, 1), (2, 19, 2), (2, 16, 3)]


def test_points_and_headings(spark):
    points = spark.createDataFrame([(1, ["a", "b"], None, ["a"]), (2, None, ["a"], None)], "matter_id int, expected array<string>, chairman array<string>, counsel array<string>")
    assert {r.matter_id: (r.found, r.missed, r.dropped) for r in evaluate.procedural_points(points).collect()} == {1: (["a"], ["b"], ["a"]), 2: ([], [], [])}
    expected = spark.createDataFrame([(1, 9, "gstr 3b"), (2, 9, "gstr-3b  of"), (3, 9, "")], "matter_id int, index int, fragment string")
    produced = spark.createDataFrame([(k, 1, "Excess in GSTR-3B\n of 2019") for k in (1, 2, 3)], "matter_id int, index int, heading string")
    assert {r.matter_id: r.produced for r in evaluate.matched_limbs(expected, produced).collect()} == {1: None, 2: 1, 3: None}


def test_registers_over_lines(spark, tmp_path):
    """Files whose header stands far down, has delimiters within, or whose cells hold line ends, as the csv module reads them."""
    files_ = {
        "deep.csv": "\n" * 160 + "Supplier GSTIN,Supplier name,Invoice No\n29A,x,1\n",
        "titled.csv": "".join(f"title {i}\n\n,,\n" for i in range(12)) + 'GSTIN,Supplier name,Invoice No\n29A,"y ""z""",2\n,,\n29B,5" pipe,3\n',
        "quoted.csv": '"S.No, serial",GSTIN,Supplier name,Invoice No\n1,29A,Name1,7\n2,29B,"Name\n\n""2"", Ltd",8\n3,29C,Name3,9\n',
    }
    for name, text in files_.items():
        (tmp_path / name).write_text(text)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in (before, "64b"):  # blocks that end within cells
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            got = sorted((r.recon_id, r.supplier_gstin, r.supplier_name, r.invoice_no) for r in files.read_registers(spark, str(tmp_path)).collect())
            assert got == [("deep.csv", "29A", "x", "1"), ("quoted.csv", "29A", "Name1", "7"), ("quoted.csv", "29B", 'Name\n\n"2", Ltd', "8"), ("quoted.csv", "29C", "Name3", "9"), ("titled.csv", "29A", 'y "z"', "2"), ("titled.csv", "29B", '5" pipe', "3")]
            want = {name: [x for x in csv.reader(io.StringIO(text))] for name, text in files_.items()}
            for r in files.read_records(spark, str(tmp_path)).collect():
                assert next(csv.reader(io.StringIO(r.value)), []) == want[r.file][r.row_no]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_results_of_a_run_are_replaced(spark, tmp_path):
    at = str(tmp_path / "scores")
    df = spark.createDataFrame([("r1", 1), ("r2", 2)], "run_id string, score int")
    for part in (df, df.where("run_id = 'r2'").withColumn("score", F.lit(5)), df.where("run_id = 'r1'")):
        files.write_results(part, at)
    assert sorted((r.run_id, r.score) for r in spark.read.parquet(at).collect()) == [("r1", 1), ("r2", 5)]
