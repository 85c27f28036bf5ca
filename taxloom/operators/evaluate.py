"""Evaluation of determinations against expectations. What can't be judged is null and neither passes nor fails."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Words that show a position.
CONTEST = ["contest", "resist", "defend", "challenge", "oppose", "reject the"]
CONCEDE = ["concede", "accept the demand", "pay the demand", "settle", "voluntary payment", "avail the amnesty", "discharge the liability"]
# Words that say nothing of a document.
STOP = [
    "the", "for", "of", "and", "a", "an", "in", "on", "with", "its", "every", "listing", "report", "data", "tax", "period", "first", "month", "each",
    "that", "this", "was", "were", "is", "are", "to", "by", "from", "at",
]
TERMS = 8


def plain(text: Column) -> Column:
    """Lower case, runs of white space as one space."""
    return F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"\s+", " ")


def _count(text: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a + b, [F.regexp_count(text, F.lit(w)) for w in words])


def position(text: Column) -> Column:
    """contest or concede, whichever has more words in the text, mixed if equal, null if neither."""
    low = plain(text)
    yes, no = _count(low, CONTEST), _count(low, CONCEDE)
    return F.when((yes == 0) & (no == 0), None).when(yes == no, "mixed").when(yes > no, "contest").otherwise("concede")


def said(phrases: Column, text: Column) -> Column:
    """The phrases, other than empty ones, that the text contains, without regard to case and white space."""
    low = plain(text)
    return F.filter(phrases, lambda p: (plain(p) != "") & F.contains(low, plain(p)))


def share(found: Column, of: Column) -> Column:
    """found over of, to 3 places; null where there is nothing to find."""
    return F.when(F.size(of) > 0, F.round(F.size(found) / F.size(of), 3))


def position_scores(results: DataFrame) -> DataFrame:
    """results: matter_id, text, expected, keywords, forbidden. A position that reads as mixed agrees with any, and one that can't be read or expected doesn't fail; a forbidden phrase does."""
    got = results.withColumn("inferred", position(F.col("text"))).withColumn("must_not", said(F.col("forbidden"), F.col("text")))
    agrees = F.when(F.col("expected").isNull() | F.col("inferred").isNull(), None).otherwise((F.col("inferred") == F.col("expected")) | (F.col("inferred") == "mixed"))
    passed = F.coalesce(agrees, F.lit(True)) & (F.coalesce(F.size("must_not"), F.lit(0)) <= 0)
    return got.select("matter_id", "inferred", agrees.alias("agrees"), share(said(F.col("keywords"), F.col("text")), F.col("keywords")).alias("keyword_rate"), "must_not", passed.alias("passed"))


def procedural_points(points: DataFrame) -> DataFrame:
    """points: matter_id, expected, chairman, counsel (arrays; null: none). Found by either, missed by both, and dropped by the chairman."""
    expected, chairman, counsel = (F.coalesce(F.col(c), F.array().cast("array<string>")) for c in ("expected", "chairman", "counsel"))
    either = F.array_union(chairman, counsel)
    return points.select("matter_id", F.array_intersect(expected, either).alias("found"), F.array_except(expected, either).alias("missed"), F.array_except(counsel, chairman).alias("dropped"))


def integrity(verification: DataFrame) -> DataFrame:
    """Share of verified citations of each matter; passed where none was not found or superseded, null where none was checked."""
    n = F.col("total")
    return verification.select("matter_id", F.when(n > 0, F.round(F.col("verified") / n, 3)).alias("rate"), F.when(n > 0, (F.col("not_found") == 0) & (F.col("superseded") == 0)).alias("passed"))


def matched_limbs(expected: DataFrame, produced: DataFrame) -> DataFrame:
    """expected: matter_id, index, fragment; produced: matter_id, index, heading. Each expected limb with the produced one of its index, else the first whose heading holds the fragment.

    Case and white space don't count, signs do. Both joins are equi-joins on matter_id; a matter has few limbs.
    """
    p = produced.groupBy("matter_id", "index").agg(F.min("heading").alias("heading"))
    e = expected.join(p.select("matter_id", "index", F.col("index").alias("by_index")), ["matter_id", "index"], "left")
    other = e.where("by_index is null").join(p.select("matter_id", F.col("index").alias("at"), "heading"), "matter_id").where((plain(F.col("fragment")) != "") & F.contains(plain(F.col("heading")), plain(F.col("fragment"))))
    by_heading = other.groupBy("matter_id", "index").agg(F.min("at").alias("by_heading"))
    return e.join(by_heading, ["matter_id", "index"], "left").select("matter_id", "index", F.coalesce("by_index", "by_heading").alias("produced"))


def terms(document: Column) -> Column:
    """The first words of a document's name that say something; repeats are kept."""
    words = F.regexp_extract_all(F.lower(document), F.lit(r"[a-z0-9/()\-]{2,}"), F.lit(0))
    return F.slice(F.filter(words, lambda w: ~w.isin(*STOP)), 1, TERMS)


def gap_caught(document: Column, evidence: Column) -> Column:
    """Whether at least half of the terms, and one, stand in the evidence text."""
    own, low = terms(document), plain(evidence)
    return F.size(F.filter(own, lambda w: F.contains(low, w))) >= F.greatest(F.lit(1), F.floor(F.size(own) / 2))


def determination_text(d: str) -> Column:
    """A determination (a struct of texts, defects and panel_disagreements) as one text, for a search for phrases. Arrays and structs within are walked in order."""
    parts = [F.col(f"{d}.{c}") for c in ("recommended_position", "lead_argument", "preliminary_submissions", "working_note", "board_summary")]
    limb = lambda x: F.concat_ws("\n", *[x[c] for c in ("heading", "our_position", "department_contention", "facts", "submission", "prayer_relief", "evidence_required", "evidence_gap")])
    return F.concat_ws("\n", *parts, F.transform(F.col(f"{d}.defects"), limb), F.col(f"{d}.risk_flags"))


def issue_coverage(results: DataFrame) -> DataFrame:
    """results: matter_id, text, issues (array). The issues found in the text and missed; all must be found; null without issues."""
    some = F.coalesce(F.size("issues"), F.lit(0)) > 0
    got = results.withColumn("found", said(F.col("issues"), F.col("text")))
    missed = F.array_except("issues", "found")
    return got.select("matter_id", "found", missed.alias("missed"), share(F.col("found"), F.col("issues")).alias("rate"), F.when(some, F.size(missed) == 0).alias("passed"))


#: What a determination must state.
REQUIRED = ("recommended_position", "preliminary_submissions", "defects", "working_note")


def determination_integrity(results: DataFrame) -> DataFrame:
    """results: matter_id, degraded, and the REQUIRED fields (texts, and defects as an array). Which are missing; passed if none is and it isn't degraded."""
    empty = lambda c: (F.coalesce(F.size(c), F.lit(0)) <= 0) if results.schema[c].dataType.typeName() == "array" else F.coalesce(F.col(c), F.lit("")) == ""
    missing = F.array_compact(F.array(*[F.when(empty(c), c) for c in REQUIRED]))
    bad = F.coalesce("degraded", F.lit(False))
    return results.select("matter_id", bad.alias("degraded"), missing.alias("missing"), (~bad & (F.size(missing) == 0)).alias("passed"))


def limb_coverage(expected: DataFrame, produced: DataFrame) -> DataFrame:
    """expected: matter_id, index, fragment, posture; produced: matter_id, index, heading, posture. By matter: limbs expected, found (see matched_limbs()) and of the right posture, and their shares; passed if all are found.

    missed: fragments (or, without one, indexes) of limbs not found; posture_errors: the fragment, the posture wanted and got of those found with another one. Both by index.
    """
    expected = expected.groupBy("matter_id", "index").agg(F.min("fragment").alias("fragment"), F.min("posture").alias("posture"))
    hits = matched_limbs(expected, produced)
    stated = produced.groupBy("matter_id", F.col("index").alias("produced")).agg(F.min("posture").alias("got"))
    rows = expected.join(hits, ["matter_id", "index"]).join(stated, ["matter_id", "produced"], "left")
    rows = rows.withColumn("name", F.coalesce(F.nullif("fragment", F.lit("")), F.col("index").cast("string")))
    lost, off = F.col("produced").isNull(), F.col("produced").isNotNull() & F.col("posture").isNotNull() & ~F.col("got").eqNullSafe(F.col("posture"))
    listed = lambda when, *columns: F.transform(F.array_sort(F.collect_list(F.when(when, F.struct("index", F.struct(*columns).alias("of"))))), lambda x: x["of"])
    sums = rows.groupBy("matter_id").agg(F.count("*").alias("expected"), F.count("produced").alias("found"), F.count_if(F.col("got") == F.col("posture")).alias("posture_matches"), listed(lost, "name").alias("missed"), listed(off, "name", F.col("posture").alias("expected"), "got").alias("posture_errors"))
    sums = sums.withColumn("missed", F.transform("missed", lambda m: m["name"]))
    return sums.select("*", F.round(F.col("found") / F.col("expected"), 3).alias("rate"), F.round(F.col("posture_matches") / F.col("expected"), 3).alias("posture_rate"), (F.col("found") == F.col("expected")).alias("passed"))


def matter_scores(matters: DataFrame, checks: dict[str, DataFrame]) -> DataFrame:
    """A row for each of matters (matter_id): passed of every check (matter_id, passed), and whether none of them is false. A check that has no row for a matter, or can't tell, doesn't fail it."""
    out = matters.select("matter_id")
    for name, scores in checks.items():
        out = out.join(scores.select("matter_id", F.col("passed").alias(name)), "matter_id", "left")
    ok = reduce(lambda a, b: a & b, [F.coalesce(F.col(c), F.lit(True)) for c in checks], F.lit(True))
    return out.withColumn("passed", ok)


#: Rupees by which a limb's figure, and a notice's total, may be off.
LIMB_OFF, TOTAL_OFF = 1, 2


def extraction_scores(expected: DataFrame, read: DataFrame) -> DataFrame:
    """expected: notice_id, index, type, total (null or 0: not to be compared), declared (the notice's total, repeated), may_be_unread; read: notice_id, index, type, total (null: unread).

    By notice: types that weren't found, whether the counts agree, limbs whose figure is off by over a rupee or unread though one is expected, whether as many are unread as
    may be, and whether the sum is the declared total within 2 (or, with unread limbs, not over it). passed if all hold.
    """
    e = expected.groupBy("notice_id").agg(F.count("*").alias("expected"), F.array_sort(F.collect_set("type")).alias("types"), F.max("declared").alias("declared"), F.count_if("may_be_unread").alias("allowed"), F.collect_list(F.when(F.col("total") != 0, F.struct("index", F.col("total").alias("want")))).alias("wanted"))
    r = read.groupBy("notice_id").agg(F.count("*").alias("found"), F.collect_set("type").alias("got"), F.sum("total").alias("sum"), F.count_if(F.col("total").isNull()).alias("unread"), F.collect_list(F.struct("index", "total")).alias("rows"))
    # a notice has few limbs, so they are compared within its row, and notices are read once
    wrong = lambda w: F.size(F.filter("rows", lambda x: (x["index"] == w["index"]) & F.coalesce(F.abs(x["total"] - w["want"]) > LIMB_OFF, F.lit(True))))
    off = F.aggregate(F.transform("wanted", wrong), F.lit(0).cast("long"), lambda a, n: a + n)
    both = e.join(r, "notice_id", "left").withColumn("off", F.when(F.col("rows").isNotNull(), off)).fillna({"found": 0, "unread": 0, "off": 0})
    missing = F.array_except("types", F.coalesce("got", F.array().cast("array<string>")))
    gap = F.coalesce("sum", F.lit(0)) - F.col("declared")
    meets = F.when(F.col("declared").isNull(), None).when(F.col("unread") > 0, gap <= TOTAL_OFF).otherwise(F.abs(gap) <= TOTAL_OFF)
    scored = both.select("notice_id", "expected", "found", missing.alias("missing"), "off", "unread", "allowed", meets.alias("reconciles"))
    passed = (F.size("missing") == 0) & (F.col("expected") == F.col("found")) & (F.col("off") == 0) & (F.col("unread") == F.col("allowed")) & F.coalesce("reconciles", F.lit(True))
    return scored.withColumn("passed", passed)


def score_items(judged: DataFrame, missed: DataFrame) -> DataFrame:
    """judged: matter_id, citation, status; missed: matter_id, document. (kind, matter_id, item): what a scorecard lists, a row each: fabricated and superseded citations, documents that weren't asked for."""
    kind = F.when(F.col("status") == "NOT_FOUND", "fabricated").when(F.col("status") == "SUPERSEDED", "superseded")
    cited = judged.select(kind.alias("kind"), "matter_id", F.col("citation").alias("item")).where("kind is not null")
    return cited.unionByName(missed.select(F.lit("missed").alias("kind"), "matter_id", F.col("document").alias("item")))


def scorecard(scores: DataFrame, metrics: list[str], cost: str | None = None) -> DataFrame:
    """One row: matters, those that pass, and each metric's mean over the matters that have it; of a cost column, its sum and the mean of all matters."""
    costs = [F.round(F.coalesce(F.sum(cost), F.lit(0)), 4).alias("total_cost"), F.round(F.coalesce(F.sum(cost), F.lit(0)) / F.count("*"), 4).alias("cost_per_matter")] if cost else []
    return scores.agg(F.count("*").alias("matters"), F.count_if("passed").alias("passed"), F.round(F.avg(F.col("passed").cast("int")), 3).alias("pass_rate"), *[F.round(F.avg(m), 3).alias(m) for m in metrics], *costs)
