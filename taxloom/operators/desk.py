"""The desk: answers merged onto limbs, problems, annexures, hearing briefs, run estimates, candidate fit, redaction, scanned pages."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions.money import needs_panel
from .matters import run_tier

POSTURES = ("explained", "contested", "agreed_paid", "paid_under_protest", "partial", "undecided")
# US dollars by argued limb and by run of each tier, the band around an estimate, runs before history counts, rupees for a dollar.
TIERS = [("draft", 0.02, 0.01), ("pro", 0.18, 0.12)]
BAND, SAMPLES, RUPEES = 0.45, 3, 88.0
# Points of a line's top that part two lines, confidences below which a line is doubtful and a page poor, doubtful lines listed.
LINE_GAP, DOUBTFUL, POOR, LISTED = 14, 0.80, 0.90, 12


# What an answer may say of a limb, and the shape in which each is taken.
ANSWERS = {
    "posture": "text", "strength": "text", "our_position": "text", "facts": "text", "submission": "text", "department_contention": "text", "legal_framework": "list", "authorities": "list",
    "evidence_required": "list", "evidence_gap": "list", "annexures": "list", "payment": "object", "splits": "list", "prayer_relief": "text", "amount_note": "text",
}


def merged(limbs: DataFrame, answers: DataFrame) -> DataFrame:
    """Answers folded onto limbs by (matter_id, index): a limb keeps its heading and total, and each of ANSWERS that an answer gives overrides what the limb holds.

    limbs: matter_id, index, heading, total, posture, held (VARIANT, an object); answers: matter_id, index, place, answer (VARIANT). An answer without a limb makes one.
    Empty values ("", [], {}, null) and values of another shape override nothing; of several answers the last by place that says something of a key
    counts for it. An answered limb whose posture isn't known is undecided; a limb without an answer keeps its own. What is no text comes as JSON.
    """
    kinds = {"list": "ARRAY", "object": "OBJECT"}

    def said(value: str, key: str, shape: str) -> Column:
        at = F.try_variant_get(F.col(value), f"$.{key}", "variant")
        text = F.to_json(at)
        if shape == "text":
            return F.nullif(F.coalesce(F.try_variant_get(F.col(value), f"$.{key}", "string"), F.when(~text.isin("null", "[]", "{}"), text)), F.lit(""))
        return F.when(F.startswith(F.schema_of_variant(at), F.lit(kinds[shape])) & ~text.isin("[]", "{}"), text)

    read = answers.where(F.startswith(F.schema_of_variant("answer"), F.lit("OBJECT"))).select("matter_id", "index", "place", *[said("answer", k, shape).alias(f"_{k}") for k, shape in ANSWERS.items()])
    told = read.groupBy("matter_id", "index").agg(*[F.max_by(f"_{k}", F.when(F.col(f"_{k}").isNotNull(), F.col("place"))).alias(f"_{k}") for k in ANSWERS], F.lit(True).alias("answered"))
    both = limbs.join(told, ["matter_id", "index"], "full_outer").withColumn("answered", F.coalesce("answered", F.lit(False)))
    posture = F.coalesce("_posture", "posture")
    posture = F.when(~F.col("answered") | posture.isin(*POSTURES), posture).otherwise("undecided")
    return both.select("matter_id", "index", "heading", "total", posture.alias("posture"), *[F.coalesce(f"_{k}", said("held", k, shape)).alias(k) for k, shape in ANSWERS.items() if k != "posture"], "answered")


def problems(limbs: DataFrame) -> DataFrame:
    """limbs: matter_id, index, posture, payment_ref, accepted, disputed, total, annexures, evidence_required, evidence_held. What stands in the way of filing, a row each, numbered within its matter."""
    parts = F.coalesce(F.col("accepted"), F.lit(0)) + F.coalesce(F.col("disputed"), F.lit(0))
    gap = F.size(F.array_except(F.coalesce("evidence_required", F.array().cast("array<string>")), F.coalesce("evidence_held", F.array().cast("array<string>")))) > 0
    found = F.array_compact(F.array(
        F.when(F.coalesce("posture", F.lit("undecided")) == "undecided", "no_posture"),
        F.when(F.col("posture").isin("agreed_paid", "paid_under_protest") & (F.coalesce(F.trim("payment_ref"), F.lit("")) == ""), "paid_without_reference"),
        F.when((F.col("posture") == "partial") & F.col("accepted").isNull() & F.col("disputed").isNull(), "partial_without_split"),
        F.when((F.col("posture") == "partial") & (parts > 0) & (F.abs(parts - F.col("total")) > 1), "split_off"),
        F.when(F.coalesce(F.size("annexures"), F.lit(0)) <= 0, "no_annexure"),
        F.when(gap, "evidence_gap"),
    ))
    order = F.array_position(F.array(*[F.lit(p) for p in ("no_posture", "paid_without_reference", "partial_without_split", "split_off", "no_annexure", "evidence_gap")]), F.col("problem"))
    rows = limbs.select("matter_id", "index", F.explode(found).alias("problem"))
    return rows.withColumn("number", F.row_number().over(Window.partitionBy("matter_id").orderBy("index", order)))


def annexures(limbs: DataFrame) -> DataFrame:
    """Enclosures of each matter numbered from 1 across its limbs."""
    rows = limbs.select("matter_id", "index", F.posexplode("annexures").alias("at", "annexure"))
    return rows.select("matter_id", "index", "annexure", F.row_number().over(Window.partitionBy("matter_id").orderBy("index", "at", "annexure")).alias("number"))


def hearing_brief(limbs: DataFrame, questions: DataFrame, default: list[str]) -> DataFrame:
    """limbs: matter_id, index, type, annexures, evidence_required, evidence_held; questions: type, questions (a row for each type of the catalogue, so it is broadcast: few types must not decide where limbs go). What a limb's hearing asks, six documents to carry and six gaps."""
    have = lambda c: F.coalesce(F.col(c), F.array().cast("array<string>"))
    carry = F.when(F.size(have("annexures")) > 0, have("annexures")).otherwise(have("evidence_required"))
    asked = F.coalesce("questions", F.array(*[F.lit(q) for q in default]))
    return limbs.join(F.broadcast(questions), "type", "left").select("matter_id", "index", asked.alias("questions"), F.slice(carry, 1, 6).alias("carry"), F.slice(F.array_except(have("evidence_required"), have("evidence_held")), 1, 6).alias("gaps"))


def estimates(matters: DataFrame, rates: DataFrame) -> DataFrame:
    """matters: matter_id, tier (see tier_of), argued; rates: tier, rate (dollars a limb), samples. A run's cost in dollars and rupees with its band."""
    given = matters.sparkSession.createDataFrame(TIERS, "tier string, unit double, fixed double")
    known = F.coalesce(F.col("samples") >= SAMPLES, F.lit(False))
    n = F.greatest(F.coalesce("argued", F.lit(0)), F.lit(0))
    cost = F.when(known, F.col("rate") * n).otherwise(F.col("unit") * n + F.col("fixed"))
    joined = matters.withColumn("tier", run_tier(F.col("tier"))).join(F.broadcast(given), "tier", "left").join(rates, "tier", "left").withColumn("cost", cost)
    return joined.select("matter_id", "tier", known.alias("learned"), F.round("cost", 4).alias("usd"), F.round(F.col("cost") * (1 - BAND), 4).alias("low"), F.round(F.col("cost") * (1 + BAND), 4).alias("high"), F.round(F.col("cost") * RUPEES, 2).alias("inr"))


def fitting(slots: DataFrame, catalogue: DataFrame, k: int = 3, most: int = 1000) -> DataFrame:
    """slots (at most `most`, or it fails): slot, vendor, least_context, price_ceiling (null: any). The k fitting models of each: its own vendor's first, then the cheapest (with a ceiling) or those of the largest context.

    A free model, or one of unknown price, fits no slot; an unknown context (null or 0) fits any.
    """
    if slots.count() > most:
        raise ValueError(f"over {most} slots")
    wide = (F.coalesce("context", F.lit(0)) == 0) | (F.col("context") >= F.col("least_context"))
    fits = wide & (F.col("price") > 0) & (F.col("price_ceiling").isNull() | (F.col("price") <= F.col("price_ceiling")))
    met = catalogue.join(F.broadcast(slots.withColumnRenamed("vendor", "own")), fits)
    order = [F.desc(F.coalesce(F.col("vendor") == F.col("own"), F.lit(False))), F.when(F.col("price_ceiling").isNotNull(), F.col("price")).otherwise(-F.coalesce("context", F.lit(0))), F.col("model_id")]
    return met.withColumn("rank", F.row_number().over(Window.partitionBy("slot").orderBy(*order))).where(F.col("rank") <= k).select("slot", "rank", "model_id")


def verdicts(slots: DataFrame, catalogue: DataFrame) -> DataFrame:
    """slots: slot, model_id, least_context, price_ceiling. Whether a slot's model is MISSING from the catalogue, of the WRONG SHAPE, or OK."""
    known = catalogue.select(F.col("model_id").alias("_id"), "context", "price")
    wrong = F.coalesce((F.col("context") > 0) & (F.col("context") < F.col("least_context")), F.lit(False)) | F.coalesce(F.col("price") > F.col("price_ceiling"), F.lit(False))
    joined = slots.join(known, F.col("model_id") == F.col("_id"), "left")
    return joined.select("slot", "model_id", F.when(F.col("_id").isNull(), "MISSING").when(wrong, "WRONG SHAPE").otherwise("OK").alias("verdict"))


def redacted(matters: DataFrame, costs: bool, deliberation: bool) -> DataFrame:
    """What a role may see: without costs no usage or cost columns, without deliberation empty analyses and cross-examinations."""
    out = matters if costs else matters.drop("usage", "cost", "cost_cents", "tokens")
    blank = {c: F.array().cast(t) if t.startswith("array") else F.lit("").cast(t) for c, t in out.dtypes if c in ("analyses", "cross_exams")}
    return out if deliberation else out.withColumns(blank).withColumn("deliberation_hidden", F.lit(True))


def _balanced(text: str | None) -> str | None:
    """The first JSON object that begins somewhere in the text."""
    decoder = json.JSONDecoder()
    at = (text or "").find("{")
    while at >= 0:
        try:
            return json.dumps(decoder.raw_decode(text, at)[0])
        except (ValueError, RecursionError):
            at = text.find("{", at + 1)
    return None


@F.pandas_udf(StringType())
def _scan(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for t in texts:
        yield t.map(_balanced)


def recovered(answers: DataFrame, text: str) -> DataFrame:
    """Adds json (text of an object) and degraded: the whole text, a fenced block, else the first object in it. Only texts that both built-in ways fail on reach Python."""
    ok = lambda c: F.when(F.try_parse_json(c).isNotNull() & F.btrim(c).startswith("{"), F.btrim(c))
    fence = F.nullif(F.regexp_extract(text, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1), F.lit(""))
    easy = answers.withColumn("json", F.coalesce(ok(F.col(text)), ok(fence)))
    hard = easy.where("json is null").withColumn("json", _scan(F.col(text)))
    return easy.where("json is not null").unionByName(hard).withColumn("degraded", F.col("json").isNull())


def page_lines(boxes: DataFrame) -> DataFrame:
    """boxes: page_id, top, left, text, confidence. (page_id, line_no, top, text, confidence): a box starts a line if its top is over LINE_GAP from the top of the line's first box.

    The rule looks back to a line's first box, so a page's boxes meet in one row and are folded there; a page holds few.
    """
    box = F.array_sort(F.collect_list(F.struct(F.col("top").cast("double").alias("top"), F.col("left").cast("double").alias("left"), "text", F.col("confidence").cast("double").alias("confidence"))))
    kind = "array<struct<anchor:double,boxes:array<struct<left:double,top:double,text:string,confidence:double>>>>"

    def add(lines: Column, b: Column) -> Column:
        one = F.struct(b["left"].alias("left"), b["top"].alias("top"), b["text"].alias("text"), b["confidence"].alias("confidence"))
        last = F.try_element_at(lines, F.lit(-1))
        grown = F.struct(last["anchor"].alias("anchor"), F.array_append(last["boxes"], one).alias("boxes"))
        new = F.struct(b["top"].alias("anchor"), F.array(one).alias("boxes"))
        return F.when((F.size(lines) == 0) | (F.abs(b["top"] - last["anchor"]) > LINE_GAP), F.array_append(lines, new)).otherwise(F.array_append(F.slice(lines, 1, F.greatest(F.size(lines) - 1, F.lit(0))), grown))

    folded = boxes.where("top is not null").groupBy("page_id").agg(box.alias("b")).select("page_id", F.posexplode(F.aggregate("b", F.array().cast(kind), add)).alias("line_no", "l"))
    across = F.array_sort("l.boxes")
    return folded.select("page_id", "line_no", F.col("l.anchor").alias("top"), F.array_join(F.transform(across, lambda x: x["text"]), " ").alias("text"), F.array_min(F.transform(across, lambda x: x["confidence"])).alias("confidence"))


def page_quality(lines: DataFrame) -> DataFrame:
    """Lines of each page, their mean and least confidence, how many are doubtful, the first of those, and whether the page is poor."""
    rank = F.row_number().over(Window.partitionBy("page_id").orderBy("line_no"))
    doubt = lines.where(F.col("confidence") < DOUBTFUL).withColumn("_r", rank).where(F.col("_r") <= LISTED)
    first = doubt.groupBy("page_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "text"))), lambda x: x["text"]).alias("doubtful_lines"))
    sums = lines.groupBy("page_id").agg(F.count("*").alias("lines"), F.avg("confidence").alias("mean"), F.min("confidence").alias("least"), F.count_if(F.col("confidence") < DOUBTFUL).alias("doubtful"))
    return sums.join(first, "page_id", "left").withColumn("poor", F.col("mean") < POOR)


def briefs(limbs: DataFrame) -> DataFrame:
    """limbs: matter_id, index, heading, posture, total. A text of a line for each limb, to argue or settled."""
    line = F.format_string("%d. %s: %s [%s]", F.col("index"), F.coalesce("heading", F.lit("untitled")), F.coalesce(F.col("total").cast("string"), F.lit("not read")), F.when(needs_panel(F.col("posture")), "ARGUE").otherwise("settled"))
    return limbs.groupBy("matter_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("index", line.alias("line")))), lambda x: x["line"]), "\n").alias("brief"))
