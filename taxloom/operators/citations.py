"""Citations: found in texts, collected once a matter, met with verdicts, and gated for filing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Patterns of reported cases, law reports, case names, writs and appeals, circulars, in the order in which they are tried.
PATTERNS = [
    r"(?i)[\(\[]\s*\d{4}\s*[\)\]]\s*\d+\s+(?:GSTL|STR|ELT|ITR|SCC|taxmann\.com|VST|GST|TMI)\s+\d+",
    r"(?i)\bAIR\s+\d{4}\s+[A-Z]{2,4}\s+\d+",
    r"\b[A-Z][\w&.,'\- ]{2,60}?\s+v(?:s?\.?|ersus)\s+[A-Z][\w&.,'\- ]{2,60}?(?=[,\(\[]|\s+\d{4}|\s*$)",
    r"(?i)\b(?:W\.?P\.?|Writ Petition|C\.?A\.?|Civil Appeal|SLP|TS)\s*(?:\(C\)|\(Civil\))?\s*(?:No\.?)?\s*\d+[\d/\-]*\s*(?:of\s*\d{4})?",
    r"(?i)\b(?:Circular|Notification|Instruction)\s+No\.?\s*\d+[\w/\-.]*(?:\s*[-–]\s*(?:CT|IT|GST|Central Tax)[\w()/ \-]*)?(?:\s*dated\s+[\d.\-/]+)?",
]
LEAST_CHARS, MOST = 6, 25
STATUSES = ("VERIFIED", "SUPERSEDED", "UNVERIFIED", "NOT_FOUND")


def key(citation: Column) -> Column:
    """Lower case with single spaces: what makes two citations the same."""
    return F.lower(F.btrim(F.regexp_replace(citation, r"\s+", " ")))


def in_text(text: Column) -> Column:
    """Citations by pattern, then place; each key once."""
    found = F.filter(F.transform(F.flatten(F.array(*[F.regexp_extract_all(text, F.lit(p), F.lit(0)) for p in PATTERNS])), lambda c: F.btrim(c, F.lit(" \n\t,.;"))), lambda c: F.length(c) >= LEAST_CHARS)
    keys = F.transform(found, key)
    return F.filter(found, lambda c, i: F.array_position(keys, key(c)) == i + 1)


def authority_sources(determinations: DataFrame) -> DataFrame:
    """All that a determination cites, as one stream in the order in which it counts: its table, then of each limb its list, its framework and its prose, then the matter's prose.

    determinations: matter_id, authorities (array of citation, proposition, certainty), defects (array of index, heading, authorities, legal_framework (array of provision, relevance),
    submission, facts, our_position), preliminary_submissions, lead_argument, unstructured_output. Gives matter_id, source (0, as place alone orders), place, kind, citation,
    proposition, certainty (asserted if none is stated), defect_index, defect_heading: rows for collected(). One unnest of tagged arrays; blank citations go.
    """
    none = F.lit(None)

    def row(kind: str, citation: Column, proposition: Column, certainty: Column, limb: Column | None = None) -> Column:
        of = (none.cast("int"), none.cast("string")) if limb is None else (limb["index"].cast("int"), limb["heading"])
        return F.struct(F.lit(kind).alias("kind"), F.btrim(citation, F.lit(" \n\t\r")).alias("citation"), F.coalesce(proposition, F.lit("")).alias("proposition"), F.coalesce(F.nullif(certainty, F.lit("")), F.lit("asserted")).alias("certainty"), of[0].alias("defect_index"), of[1].alias("defect_heading"))

    empty = F.array().cast("array<struct<kind:string,citation:string,proposition:string,certainty:string,defect_index:int,defect_heading:string>>")
    some = lambda rows: F.coalesce(rows, empty)
    listed = lambda rows, kind, limb=None: some(F.transform(rows, lambda a: row(kind, a["citation"], a["proposition"], a["certainty"], limb)))
    said = lambda text, limb=None: some(F.transform(in_text(text), lambda c: row("filed_text", c, none.cast("string"), none.cast("string"), limb)))

    def of_limb(d: Column) -> Column:
        framework = some(F.transform(d["legal_framework"], lambda e: row("legal_framework", e["provision"], e["relevance"], none.cast("string"), d)))
        return F.flatten(F.array(listed(d["authorities"], "defect", d), framework, *[said(d[c], d) for c in ("submission", "facts", "our_position")]))

    prose = [said(F.col(c)) for c in ("preliminary_submissions", "lead_argument", "unstructured_output")]
    every = F.flatten(F.array(listed(F.col("authorities"), "authorities_table"), some(F.flatten(F.transform("defects", of_limb))), *prose))
    return determinations.select("matter_id", F.posexplode(F.filter(every, lambda a: a["citation"] != "")).alias("place", "a")).select("matter_id", F.lit(0).alias("source"), "place", "a.*")


def collected(sources: DataFrame, most: int = MOST) -> DataFrame:
    """sources: matter_id, source (its rank: 0 comes first), place, citation, and what authority_sources() adds. Each citation of a matter once, from its first source; the first `most`, numbered from 0.

    Copies are folded by a minimum before the shuffle; the window sees different citations only.
    """
    said = sources.where(F.length(F.trim("citation")) > 0).withColumn("key", key(F.col("citation")))
    more = [c for c in ("kind", "proposition", "certainty", "defect_index", "defect_heading") if c in sources.columns]
    once = said.groupBy("matter_id", "key").agg(F.min(F.struct("source", "place", "citation", *more)).alias("m"))
    number = F.row_number().over(Window.partitionBy("matter_id").orderBy("m.source", "m.place", "key")) - 1
    return once.withColumn("position", number).where(F.col("position") < most).select("matter_id", "position", "key", "m.citation", "m.source", *[f"m.{c}" for c in more])


def judged(citations: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Adds status, note and as_of by (matter_id, position). Without a valid verdict a citation is UNVERIFIED; one marked to_verify is never VERIFIED.

    Of several verdicts on a position the last one by place counts.
    """
    last = verdicts.groupBy("matter_id", "position").agg(F.max(F.struct("place", F.upper("status").alias("said"), "note", "as_of")).alias("v")).select("matter_id", "position", "v.said", "v.note", "v.as_of")
    said = citations.join(last, ["matter_id", "position"], "left")
    valid = F.when(F.col("said").isin(*STATUSES), F.col("said")).otherwise("UNVERIFIED")
    return said.withColumn("status", F.when((valid == "VERIFIED") & (F.col("certainty") == "to_verify"), "UNVERIFIED").otherwise(valid)).drop("said")


# What is said of citations that weren't found, are superseded, are yet to be confirmed, or are all good.
NOT_FOUND_NOTE = " could not be located and must be removed or replaced before filing"
SUPERSEDED_NOTE = " no longer represent the current position and must not be relied on as cited"
UNVERIFIED_NOTE = "No fabricated or superseded authorities detected. Items marked UNVERIFIED still require manual confirmation before filing."
VERIFIED_NOTE = "All authorities were traced, support the propositions cited, and appear to remain good law."


def _note() -> Column:
    part = lambda c, said: F.when(F.col(c) > 0, F.concat(F.col(c).cast("string"), F.lit(said)))
    wrong = F.concat_ws("; ", part("not_found", NOT_FOUND_NOTE), part("superseded", SUPERSEDED_NOTE))
    return F.when(wrong != "", F.concat(F.lit("Of the authorities checked, "), wrong, F.lit("."))).when(F.col("unverified") > 0, UNVERIFIED_NOTE).otherwise(VERIFIED_NOTE)


def verification(judged: DataFrame) -> DataFrame:
    """Counts by status of each matter, the most serious status there is (not found, superseded, unverified, or verified), and a sentence that says so."""
    counts = judged.groupBy("matter_id").agg(*[F.count_if(F.col("status") == s).alias(s.lower()) for s in STATUSES], F.count("*").alias("total"))
    return counts.withColumn("worst", F.when(F.col("not_found") > 0, "NOT_FOUND").when(F.col("superseded") > 0, "SUPERSEDED").when(F.col("unverified") > 0, "UNVERIFIED").otherwise("VERIFIED")).withColumn("note", _note())


def _verified(judged: DataFrame) -> DataFrame:
    return judged.where("status = 'VERIFIED'").select("matter_id", key(F.col("citation")).alias("key")).distinct()


def filable(authorities: DataFrame, judged: DataFrame) -> DataFrame:
    """Authorities whose citation is verified in the same matter."""
    return authorities.withColumn("key", key(F.col("citation"))).join(_verified(judged), ["matter_id", "key"], "left_semi")


def withheld(authorities: DataFrame, judged: DataFrame) -> DataFrame:
    """The other authorities."""
    return authorities.withColumn("key", key(F.col("citation"))).join(_verified(judged), ["matter_id", "key"], "left_anti")


def prose_gaps(texts: DataFrame, judged: DataFrame) -> DataFrame:
    """texts: matter_id, text. Citations in the filed text that aren't verified, once a matter, with the status or 'not covered'."""
    found = texts.select("matter_id", F.explode(in_text(F.col("text"))).alias("citation")).withColumn("key", key(F.col("citation"))).groupBy("matter_id", "key").agg(F.min("citation").alias("citation"))
    known = judged.groupBy("matter_id", key(F.col("citation")).alias("key")).agg(F.bool_or(F.col("status") == "VERIFIED").alias("ok"), F.min("status").alias("status"))
    return found.join(known, ["matter_id", "key"], "left").where(~F.coalesce("ok", F.lit(False))).select("matter_id", "key", "citation", F.coalesce("status", F.lit("not covered")).alias("status"))


def authorities_for(limbs: DataFrame, library: DataFrame, k: int = 8) -> DataFrame:
    """limbs: matter_id, index, tags; library: authority_id, certainty, kind, tags. The first k authorities that share a tag with a limb: filed ones first, of these statutes.

    That order doesn't hang on the limb, so each tag keeps its k best (cut before the shuffle, where a tag is popular), and each set of tags
    that limbs have merges the lists of its tags once: it meets k rows a tag at most, however many the library has, and limbs with the same tags share the list.
    """
    order = F.struct((F.col("certainty") != "filed").alias("later"), (F.col("kind") != "statute").alias("softer"), "authority_id", "certainty", "kind").alias("a")
    held = library.select(F.explode(F.array_distinct("tags")).alias("tag"), order).distinct()
    best = held.withColumn("n", F.row_number().over(Window.partitionBy("tag").orderBy("a"))).where(F.col("n") <= k)
    lists = best.groupBy("tag").agg(F.collect_list("a").alias("list"))
    # a limb may have several rows; its tags meet, not the longer lists
    tagged = limbs.groupBy("matter_id", "index").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("tags")))).alias("set"))
    sets = tagged.select("set").distinct()
    met = sets.select("set", F.explode("set").alias("tag")).join(lists, "tag").groupBy("set").agg(F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("list")))), 1, k).alias("list"))
    return tagged.join(met, "set").select("matter_id", "index", F.posexplode("list").alias("at", "a")).select("matter_id", "index", "a.authority_id", "a.certainty", "a.kind", (F.col("at") + 1).alias("rank"))
