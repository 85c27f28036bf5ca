"""Domain tables derived from the star tables, by expressions that Spark and DuckDB both read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

AS_ON = "1998-06-01"

_n = lambda e: f"CAST({e} AS STRING)"
#: Figures of a notice: a head's, the third head's whole part, a lump, its limbs' totals (null where unread or absent), and what is added to the printed total.
HEAD, THIRD, LUMP = "(o_orderkey % 900 + 10)", "(o_custkey % 70)", "(1000 + o_orderkey % 1000)"
FIRST = f"CASE WHEN o_orderkey % 17 = 0 THEN NULL WHEN o_orderkey % 5 < 2 THEN 2 * {HEAD} + {THIRD} + 0.5 WHEN o_orderkey % 5 < 4 THEN 2 * {HEAD} ELSE {LUMP} END"
SECOND = f"CASE WHEN o_orderkey % 2 = 0 THEN {LUMP} END"
OFF = "CASE WHEN o_orderkey % 11 = 0 THEN 9 ELSE 0 END"
_lump = f"'1,' || lpad({_n('o_orderkey % 1000')}, 3, '0')"
_third = f"{_n(THIRD)} || '.50'"
_total = f"{_n(f'2 * {HEAD} + {THIRD}')} || '.50'"
_heading = lambda n, name: f"CASE o_orderkey % 3 WHEN 0 THEN '{n}. {name}' WHEN 1 THEN 'Defect - {n}: {name}' ELSE '• {name} :' END || chr(10)"
_printed = f"coalesce({FIRST}, 0) + coalesce({SECOND}, 0) + {OFF}"
_whole = f"{_n(f'CAST(floor({_printed}) AS BIGINT)')} || CASE WHEN o_orderkey % 17 <> 0 AND o_orderkey % 5 < 2 THEN '.50' ELSE '.00' END"
_filler = "The returns of the period were examined together with the records that are on file in this office, and what was found is put before the taxpayer for an answer in writing."
#: A notice of one or two limbs: rows of a portal's form or words of a letter, five ways to write a year, four of a deadline or none; three kinds of headings, five of figures, or none; two ends of its operative part; scans without text.
NOTICE = f"""CASE WHEN o_orderkey % 29 = 0 THEN 'FORM GST DRC-01' ELSE CASE o_orderkey % 3 WHEN 0 THEN 'FORM GST DRC - 01' WHEN 1 THEN 'FORM GST ASMT-10' ELSE 'FORM GST DRC-01A' END
    || chr(10) || CASE WHEN o_orderkey % 4 = 1 THEN 'To' || chr(10) || 'M/s. ' ELSE 'Legal Name : ' END || 'Trader T' || {_n('o_custkey')} || chr(10) || CASE WHEN o_orderkey % 7 = 0 THEN '' ELSE CASE o_orderkey % 5 WHEN 0 THEN 'Tax Period : 2019-20' WHEN 1 THEN 'For F.Y. 2019-2020' WHEN 2 THEN 'Financial year - 2019/20' WHEN 3 THEN 'Returns of 2019-20' ELSE 'Tax Period : FY 2019-20' END || chr(10) END
    || CASE WHEN o_orderkey % 4 = 3 THEN 'Ref. No. ZD' ELSE 'Reference No : ZD' END || lpad({_n('o_orderkey')}, 12, '0') || 'F   ' || CASE WHEN o_orderkey % 4 = 3 THEN 'dated ' ELSE 'Date : ' END || lpad({_n('day(o_orderdate)')}, 2, '0') || '/' || lpad({_n('month(o_orderdate)')}, 2, '0') || '/' || {_n('year(o_orderdate)')}
    || CASE WHEN o_orderkey % 6 = 0 THEN chr(10) || 'DIN : 2025' || lpad({_n('o_orderkey')}, 14, '0') ELSE '' END
    || chr(10) || 'GSTIN : ' || lpad({_n('o_custkey % 40')}, 2, '0') || 'AAAAA' || lpad({_n('o_custkey % 10000')}, 4, '0') || 'A1Z5'
    || chr(10) || CASE o_orderkey % 3 WHEN 0 THEN 'Section under which notice is issued : 73 (1)' WHEN 1 THEN 'Section under which the notice is issued - 61' ELSE 'Issued u/s 74 (1)' END || chr(10) || 'This is under section 16(2) and rule 36 (4).' || CASE WHEN o_orderkey % 4 < 2 THEN '' ELSE ' {_filler} {_filler}' END || chr(10)
    || {_heading(1, 'Excess credit claimed')} || CASE WHEN o_orderkey % 17 = 0 THEN 'What was claimed stands in the annexure.' ELSE CASE o_orderkey % 5
        WHEN 0 THEN 'As returned and as allowed:' || chr(10) || 'Difference  ' || {_n(HEAD)} || '  ' || {_n(HEAD)} || '  ' || {_third} || '  0  ' || {_total}
        WHEN 1 THEN 'IGST CGST SGST CESS' || chr(10) || '1 2 3 4 5' || chr(10) || 'Excess claimed ' || {_third} || ' ' || {_n(HEAD)} || ' ' || {_n(HEAD)} || ' 0 ' || {_total}
        WHEN 2 THEN 'S.No | No of GSTR-1 filed late' || chr(10) || '1 2 3 4' || chr(10) || '1 9 ' || {_n(HEAD)} || ' ' || {_n(HEAD)}
        WHEN 3 THEN 'A penalty of Rs. ' || {_n(HEAD)} || '/- each under CGST and SGST is due.'
        ELSE '5 Difference (Highest of 1 to 3)-4 ' || {_lump} END END
    || CASE WHEN o_orderkey % 2 = 0 THEN chr(10) || {_heading(2, 'Late fee for delay')} || 'Difference of Rs. ' || {_lump} || chr(10) || '1. not a limb here' ELSE '' END
    || chr(10) || CASE WHEN o_orderkey % 4 < 2 THEN 'Proper officer' ELSE 'The total tax payable on account of these deficiencies is arrived at below.' END || chr(10) || '{_filler}' || chr(10) || 'Total tax payable  0  0  ' || {_whole} || '  0  ' || {_whole}
    || chr(10) || CASE WHEN o_orderkey % 23 = 0 THEN 'A reply is due within (30) days from the date of receipt of this notice.' WHEN o_orderkey % 31 = 0 THEN 'Appear in person on or before 30/06/2025.'
        WHEN o_orderkey % 3 = 0 THEN 'Date by which reply has to be submitted : 30.06.2025' WHEN o_orderkey % 3 = 1 THEN 'You are to submit a reply' || chr(10) || 'on or before 30/06/2025.' ELSE 'Explain the reasons for the above discrepancy on or before 30-06-2025.' END
    || CASE WHEN o_orderkey % 2 = 0 THEN chr(10) || 'Signature' || chr(10) || 'Name : R. KUMAR' || chr(10) || 'Designation : State Tax Officer' || chr(10) || 'Jurisdiction : RAM NAGAR , Coimbatore-' || chr(10) || 'II , Tamil Nadu' ELSE '' END END"""
#: Each view: the tables it joins (first, then (table, left column, right column)), and its columns.
VIEWS: dict[str, tuple[list, dict[str, str]]] = {
    "register_lines": (
        ["lineitem", ("supplier", "l_suppkey", "s_suppkey")],
        {
            "recon_id": "l_orderkey % 50",
            "supplier_gstin": "CASE WHEN l_suppkey % 11 = 0 THEN '' ELSE lpad(CAST(s_nationkey + 1 AS STRING), 2, '0') || 'AAAAA' || lpad(CAST(l_suppkey % 10000 AS STRING), 4, '0') || 'A1Z5' END",
            "supplier_name": "CASE WHEN l_partkey % 17 = 0 THEN 'RCM - ' || s_name ELSE s_name END",
            "invoice_no": "CASE WHEN l_partkey % 23 = 0 THEN 'BOE IMPORT ' ELSE 'INV-' END || CAST(l_orderkey AS STRING)",
            "amount_books": "CASE l_linenumber % 4 WHEN 0 THEN '(' || CAST(l_partkey AS STRING) || ')' WHEN 1 THEN 'Rs. ' || CAST(l_partkey AS STRING) || '.50' WHEN 2 THEN '1,' || lpad(CAST(l_partkey % 1000 AS STRING), 3, '0') || '.25' ELSE CAST(l_partkey AS STRING) END",
            "amount_2a": "CASE WHEN l_partkey % 5 = 0 THEN '' ELSE CAST(l_partkey % 700 AS STRING) || '.75' END",
            "difference": "CASE WHEN l_partkey % 7 = 0 THEN CAST(l_orderkey % 4000 AS STRING) WHEN l_partkey % 29 = 0 THEN '0.40' ELSE 'n/a' END",
            "tax_amount": "CAST(l_partkey % 90 AS STRING)",
            "status": "CASE l_partkey % 14 WHEN 0 THEN 'Reverse charge, self invoice' WHEN 1 THEN 'IMPORTANT: see BoE' WHEN 2 THEN 'ISD credit' WHEN 3 THEN 'Filed late by supplier' WHEN 4 THEN 'Credit note booked' WHEN 5 THEN 'Wrong GSTIN quoted' WHEN 6 THEN 'Supplier NOT FILED' WHEN 7 THEN 'Blocked credit 17(5)' WHEN 8 THEN 'Typo' WHEN 9 THEN 'non-filer, timing' ELSE '' END",
        },
    ),
    "matters": (
        ["orders", ("customer", "o_custkey", "c_custkey")],
        {
            "matter_id": "o_orderkey",
            "section": "CASE o_orderkey % 5 WHEN 0 THEN '73' WHEN 1 THEN '74' WHEN 2 THEN '74A' WHEN 3 THEN '74 (1)' ELSE '61' END",
            "period": "CASE o_orderkey % 4 WHEN 0 THEN 'FY 2019-20' WHEN 1 THEN '2018-2019' WHEN 2 THEN 'FY 2023-24' ELSE 'unknown' END",
            "tax": "CAST(CASE WHEN o_orderkey % 19 = 0 THEN NULL ELSE (o_orderkey * 7919) % 300000000 END AS DECIMAL(18,2))",
            "notice_date": "CAST(CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE o_orderdate END AS DATE)",
            "due_date": "CAST(CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE CAST('1998-06-01' AS DATE) + CAST((o_orderkey * 31) % 41 - 20 AS INT) END AS DATE)",
            "fraud": "CASE o_custkey % 3 WHEN 0 THEN TRUE WHEN 1 THEN FALSE END",
            "tax_paid": "CASE o_orderkey % 3 WHEN 0 THEN TRUE WHEN 1 THEN FALSE END",
            "itc_utilised": "CASE (o_orderkey + o_custkey) % 3 WHEN 0 THEN TRUE WHEN 1 THEN FALSE END",
            "penalty_only": "o_orderkey % 8 = 0",
            "state": "CASE WHEN c_nationkey % 9 = 0 THEN '' ELSE lpad(CAST(c_nationkey + 1 AS STRING), 2, '0') END",
            "status": "CASE o_orderstatus WHEN 'F' THEN 'filed' WHEN 'O' THEN 'complete' ELSE 'open' END",
            "tier": "CASE o_orderkey % 2 WHEN 0 THEN 'draft' ELSE 'pro' END",
            "cost_cents": "CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE (o_orderkey * 13) % 900 END",
            "argued": "o_orderkey % 4",
            "limbs": "o_orderkey % 4 + o_custkey % 3",
        },
    ),
    "limbs": (
        ["lineitem"],
        {
            "matter_id": "l_orderkey",
            "posture": "CASE l_partkey % 7 WHEN 0 THEN 'explained' WHEN 1 THEN 'contested' WHEN 2 THEN 'agreed_paid' WHEN 3 THEN 'paid_under_protest' WHEN 4 THEN 'partial' WHEN 5 THEN 'undecided' END",
            "cgst": "CAST(CASE WHEN l_linenumber % 3 = 0 THEN NULL ELSE l_partkey % 5000 END AS DECIMAL(18,2))",
            "sgst": "CAST(CASE WHEN l_linenumber % 3 = 0 THEN NULL ELSE l_partkey % 5000 END AS DECIMAL(18,2))",
            "igst": "CAST(CASE WHEN l_linenumber % 3 = 0 THEN l_orderkey % 9000 END AS DECIMAL(18,2))",
        },
    ),
    "calls": (
        ["events"],
        {
            "run_id": "user_id % 20",
            "stage": "event_type",
            "tokens": "CASE WHEN event_id % 9 = 0 THEN NULL ELSE event_id % 4000 END",
            "cost_micros": "CASE WHEN event_id % 7 = 0 THEN NULL ELSE event_id % 900 END",
            "body": """CASE event_id % 6 WHEN 0 THEN 'upstream timeout' WHEN 1 THEN '{"error": {"code": 429}}' WHEN 2 THEN '{"choices": []}' WHEN 3 THEN '{"choices": [{"finish_reason": "length", "message": {"content": ""}}]}' WHEN 4 THEN '{"choices": [{"finish_reason": "stop", "message": {"content": " "}}]}' ELSE '{"choices": [{"finish_reason": "stop", "message": {"content": "' || event_type || '"}}]}' END""",
        },
    ),
    "notices": (["orders"], {"notice_id": "o_orderkey", "text": NOTICE}),
    "authorities": (
        ["lineitem"],
        {
            "matter_id": "l_orderkey",
            "source": "l_linenumber % 3",
            "place": "l_linenumber",
            "citation": "CASE l_partkey % 4 WHEN 0 THEN '(2023)  ' WHEN 1 THEN '[2024] ' WHEN 2 THEN '(2023) ' ELSE '' END || CASE WHEN l_partkey % 4 = 3 THEN '' ELSE CAST(l_suppkey % 3 AS STRING) || ' GSTL ' || CAST(l_linenumber % 3 + 100 AS STRING) END",
            "certainty": "CASE WHEN l_suppkey % 5 = 0 THEN 'to_verify' ELSE 'settled' END",
        },
    ),
    "verdicts": (
        ["orders"],
        {
            "matter_id": "o_orderkey",
            "position": "o_orderkey % 3",
            "status": "CASE o_orderkey % 5 WHEN 0 THEN 'verified' WHEN 1 THEN 'VERIFIED' WHEN 2 THEN 'NOT_FOUND' WHEN 3 THEN 'maybe' ELSE 'SUPERSEDED' END",
            "note": "CASE WHEN o_orderkey % 5 = 4 THEN 'overruled' END",
            "as_of": "o_orderdate",
        },
    ),
    "results": (
        ["orders"],
        {
            "matter_id": "o_orderkey",
            "text": "CASE o_orderkey % 6 WHEN 0 THEN 'We CONTEST and resist it' WHEN 1 THEN 'Settle: pay the demand' WHEN 2 THEN 'Contest one limb, concede one' WHEN 3 THEN 'No view' WHEN 4 THEN 'Oppose; time barred' END",
            "expected": "CASE o_orderkey % 4 WHEN 0 THEN 'contest' WHEN 1 THEN 'concede' WHEN 2 THEN 'mixed' END",
        },
    ),
    "sheets": (
        ["lineitem"],
        {
            "matter_id": "l_orderkey",
            "index": "l_linenumber",
            "posture": "CASE l_partkey % 7 WHEN 0 THEN 'explained' WHEN 1 THEN 'contested' WHEN 2 THEN 'agreed_paid' WHEN 3 THEN 'paid_under_protest' WHEN 4 THEN 'partial' WHEN 5 THEN 'undecided' END",
            "payment_ref": "CASE WHEN l_suppkey % 2 = 0 THEN 'DRC-03' ELSE ' ' END",
            "accepted": "CASE WHEN l_suppkey % 3 = 0 THEN NULL ELSE l_partkey % 50 END",
            "disputed": "CASE WHEN l_suppkey % 3 = 0 THEN NULL ELSE 25 END",
            "total": "l_partkey % 50 + 25 + CASE WHEN l_suppkey % 4 = 0 THEN 9 ELSE 0 END",
            "annexure": "CASE WHEN l_partkey % 5 <> 0 THEN 'Annexure ' || CAST(l_suppkey AS STRING) END",
        },
    ),
}


#: Views whose rows are worked on long enough to be worth a shuffle first.
HEAVY = ("notices", "register_lines")


#: Rows of such a view that one task works on.
TASK_ROWS = 50_000


def spread(df: DataFrame) -> DataFrame:
    """A table of fewer pieces than there are cores, or of long ones, dealt out before its rows are worked on; only the columns in use are moved. The count reads the files' footers."""
    n = max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // TASK_ROWS))
    return df.repartition(n) if df.rdd.getNumPartitions() < n else df


def view(spark: SparkSession, sf_dir: str, name: str, heavy: bool | None = None) -> DataFrame:
    """A view as a DataFrame, dealt out if it is heavy (by default those of HEAVY); the joined tables are dimensions, whose size Spark knows before it broadcasts one."""
    (first, *joins), columns = VIEWS[name]
    df = spark.read.parquet(f"{sf_dir}/{first}.parquet")
    df = spread(df) if (name in HEAVY if heavy is None else heavy) else df
    for table, left, right in joins:
        df = df.join(spark.read.parquet(f"{sf_dir}/{table}.parquet"), F.col(left) == F.col(right))
    return df.selectExpr(*[f"{e} AS {c}" for c, e in columns.items()])


def view_sql(name: str) -> str:
    """The same view for DuckDB."""
    (first, *joins), columns = VIEWS[name]
    tables = first + "".join(f" JOIN {t} ON {left} = {right}" for t, left, right in joins)
    return f"SELECT {', '.join(f'{e} AS {c}' for c, e in columns.items())} FROM {tables}"

