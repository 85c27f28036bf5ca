"""What goes into a reply and its file note: registers, splits, relief, payments, blockers, amounts, contentions as prose, anonymised matters."""

from __future__ import annotations

import functools
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.money import MONEY, amount_band, indian_digits, needs_panel
from ..functions.texts import each, pattern, reading
from .limbs import let
from .talk import IDENTIFIERS

# What a posture is called, the verb of its relief, what an unread figure is called, patterns of tables in prose, and limits.
POSTURE_LABELS = {"explained": "Explained — drop requested", "contested": "Contested", "agreed_paid": "Agreed and paid", "paid_under_protest": "Paid under protest", "partial": "Part contested, part discharged", "undecided": "Not yet settled"}
RELIEF_VERBS = {"explained": "DROP", "contested": "DROP", "agreed_paid": "ACKNOWLEDGE", "paid_under_protest": "TAKE ON RECORD", "partial": "DROP in part and TAKE ON RECORD in part", "undecided": "CONSIDER"}
UNREAD = "Not read from the notice"
NUMBER_RUN = r"(?=[\d,])(?:(?<![\w.])[\d,]+(?:\.\d+)?(?![\w.])\s+){3,}(?<![\w.])[\d,]+(?:\.\d+)?(?![\w.])"
COLUMN_HEADER = r"(?i)(?=[str])\b(?:S\.?\s?No\.?|Sl\.?\s?No\.?|Table\s+No\.?|Return\s*/\s*Statement|Taxable\s+value\s+SGST|SGST\s+CGST\s+IGST)\b"
DIGIT_SHARE, LEAST_SENTENCE, MOST_PROSE, SUMMARY_SENTENCES, SUMMARY_CHARS = 0.30, 3, 700, 3, 800
BEFORE, AFTER = 90, 110
TAXPAYER, LEAST_NAME, LEAST_HEAD, NO_HEADS = "the Taxpayer", 3, 4, ("the", "shri", "smt", "messrs")
DROPPED, SCRUBBED, LIMB_SCRUBBED = ("client_name", "gstin", "client_ref"), ("issues", "facts", "documents_available"), ("heading", "department_contention", "notice_extract", "preamble", "fallback_text")
_spaces = pattern(r"\s+")


def _of(key: Column, names: dict[str, str]) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in names.items() for x in pair]), key)


def matter_summaries(matters: DataFrame) -> DataFrame:
    """Nested matters (id, created_at, updated_at, domain, tier, status, created_by, intake, result, metadata) as one flat row each."""
    limbs = F.coalesce("intake.defects", F.array().cast(matters.select("intake.defects").schema[0].dataType))
    blank = lambda c: F.coalesce(F.col(f"intake.{c}"), F.lit("")).alias(c)
    return matters.select(
        "id", "created_at", F.coalesce("updated_at", "created_at").alias("updated_at"), F.coalesce("domain", F.lit("gst")).alias("domain"), "tier", F.coalesce("status", F.lit("draft")).alias("status"), "created_by",
        F.size(limbs).alias("limbs"), F.size(F.filter(limbs, lambda d: needs_panel(d["posture"]))).alias("argued"),
        *[blank(c) for c in ("client_name", "notice_type", "state", "tax_period")], "intake.amount_disputed", "intake.due_date",
        "result.determination.confidence", F.greatest(F.size("result.determination.risk_flags"), F.lit(0)).alias("risk_flags"), F.col("result.verification.summary").alias("verification"), F.col("metadata.usage").alias("usage"),
    )


def recent(summaries: DataFrame, k: int = 8) -> DataFrame:
    """The k newest matters."""
    return summaries.orderBy(F.desc("created_at"), "id").limit(k)


def limb_register(limbs: DataFrame) -> DataFrame:
    """limbs: matter_id, index, heading, posture, total (null: unread), note. The amount in Indian digits, or that it wasn't read; the posture in words."""
    unread = F.concat(F.lit(UNREAD), F.coalesce(F.concat(F.lit(" — "), F.nullif(F.trim("note"), F.lit(""))), F.lit("")))
    return limbs.select("matter_id", "index", F.coalesce("heading", F.lit("")).alias("heading"), F.coalesce(indian_digits(F.col("total")), unread).alias("amount"), F.coalesce(_of(F.col("posture"), POSTURE_LABELS), "posture", F.lit("")).alias("posture"))


def evidence_gaps(limbs: DataFrame) -> DataFrame:
    """A row for each document of a limb's evidence_gap, in order."""
    return limbs.select("matter_id", "index", F.posexplode("evidence_gap").alias("place", "document"))


def split_rows(limbs: DataFrame) -> DataFrame:
    """A row for each of a limb's splits (description, amount, posture)."""
    rows = limbs.select("matter_id", "index", F.posexplode("splits").alias("place", "s"))
    return rows.select("matter_id", "index", "place", F.coalesce("s.description", F.lit("")).alias("description"), F.col("s.amount").alias("amount"), F.coalesce(_of(F.col("s.posture"), POSTURE_LABELS), "s.posture", F.lit("")).alias("position"))


def relief_rows(limbs: DataFrame) -> DataFrame:
    """limbs: matter_id, index, heading, posture, total, relief. The relief asked for: as given, else the posture's verb on the allegation and its amount; numbered in each matter."""
    verb = F.coalesce(_of(F.col("posture"), RELIEF_VERBS), F.lit(RELIEF_VERBS["undecided"]))
    tail = F.when(F.col("total") != 0, F.concat(F.lit(" of Rs. "), indian_digits(F.col("total")))).otherwise("")
    usual = F.concat(verb, F.lit(" the allegation at Issue "), F.col("index").cast("string"), F.lit(" — "), F.coalesce("heading", F.lit("")), F.coalesce(tail, F.lit("")), F.lit("."))
    asked = limbs.select("matter_id", "index", F.coalesce(F.nullif("relief", F.lit("")), usual).alias("relief"))
    return asked.withColumn("number", F.row_number().over(Window.partitionBy("matter_id").orderBy("index", "relief")))


def payment_statement(limbs: DataFrame) -> DataFrame:
    """limbs: matter_id, index, posture, total, payment_ref, payment_date, paid, under_protest. Payments with a reference, numbered across a matter's limbs; one without an amount has its limb's."""
    paid = limbs.where(F.trim("payment_ref") != "")
    protest = F.coalesce(F.col("under_protest"), F.lit(False)) | F.coalesce(F.col("posture") == "paid_under_protest", F.lit(False))
    said = F.concat("payment_ref", F.coalesce(F.concat(F.lit(" dated "), F.col("payment_date").cast("string")), F.lit("")))
    rows = paid.select("matter_id", "index", F.coalesce(F.nullif("paid", F.lit(0)), "total").cast(MONEY).alias("amount"), said.alias("reference"), F.when(protest, "Paid under protest").otherwise("Agreed and paid").alias("remarks"))
    return rows.withColumn("number", F.row_number().over(Window.partitionBy("matter_id").orderBy("index", "reference", "remarks", "amount")))


def matter_amounts(matters: DataFrame, limbs: DataFrame) -> DataFrame:
    """matters: matter_id, declared; limbs: matter_id, total (null: unread). The sum of the limbs, but the declared amount where there are none, or where one is unread and the amount isn't 0."""
    sums = limbs.groupBy("matter_id").agg(F.coalesce(F.sum("total"), F.lit(0)).alias("sum"), F.count_if(F.col("total").isNull()).alias("unread"))
    both = matters.join(sums, "matter_id", "left")
    stated = F.col("sum").isNull() | ((F.col("unread") > 0) & (F.coalesce("declared", F.lit(0)) != 0))
    return both.select("matter_id", F.when(stated, F.col("declared")).otherwise(F.col("sum")).cast(MONEY).alias("amount"), F.coalesce("unread", F.lit(0)).alias("unread"), (F.coalesce("unread", F.lit(0)) > 0).alias("incomplete"))


def filing_blockers(problems: DataFrame, gaps: DataFrame, limbs: DataFrame) -> DataFrame:
    """problems: matter_id, index, text; gaps: matter_id, citation, text; limbs: matter_id, index, heading, total. What stands in the way of filing a matter, numbered.

    First the problems, then citations in the prose of which no problem of the matter holds the text, then figures that weren't read. The
    anti join is an equi-join on the matter, which has few of either.
    """
    known = problems.select(F.col("matter_id").alias("_m"), F.col("text").alias("_t"))
    new = gaps.join(known, (F.col("matter_id") == F.col("_m")) & F.contains(F.col("_t"), F.col("citation")), "left_anti")
    unread = limbs.where("total is null").select("matter_id", F.lit(2).alias("part"), F.col("index").cast("long").alias("place"), F.concat(F.lit("Limb "), F.col("index").cast("string"), F.lit(" ("), F.coalesce("heading", F.lit("unheaded")), F.lit("): the amount could not be read")).alias("text"))
    rows = problems.select("matter_id", F.lit(0).alias("part"), F.col("index").cast("long").alias("place"), "text").unionByName(new.select("matter_id", F.lit(1).alias("part"), F.lit(0).cast("long").alias("place"), "text")).unionByName(unread)
    return rows.select("matter_id", F.row_number().over(Window.partitionBy("matter_id").orderBy("part", "place", "text")).alias("number"), "text")


def merged_provisions(known: Column, cited: Column) -> Column:
    """The catalogue's provisions, then those cited that aren't among them, each in its order."""
    none = F.array().cast("array<string>")
    return F.array_union(F.coalesce(known, none), F.coalesce(cited, none))


_runs, _headers, _digits = pattern(NUMBER_RUN), pattern(COLUMN_HEADER), pattern(r"\d")
#: Sentences that were looked at are kept: so many.
KEPT = 1 << 12


@functools.lru_cache(KEPT)
def _residue(sentence: str) -> bool:
    digits = len(_digits.findall(sentence))
    return digits > len(sentence) * DIGIT_SHARE or (digits + sentence.count(",") > 3 and _runs.search(sentence) is not None) or _headers.search(sentence) is not None


#: Whether a sentence is what is left of a table: four numbers in a row, words of a column's head, or over 30 % digits.
is_residue = reading("boolean", each(lambda s: None if s is None else _residue(s)), pa.bool_())


def _single_spaced(text: str | None) -> str:
    """White space as single spaces, none around; only texts with runs or other white space are made anew."""
    if text and any(w in text for w in ("  ", "\n", "\t", "\r", "\x0b", "\x0c")):
        text = b" ".join(text.encode("utf-8", "surrogatepass").split()).decode("utf-8", "surrogatepass")
    return (text or "").strip(" ")


def _sentences(spaced: str) -> list[str]:
    """Of a single-spaced text, which has no line end."""
    return spaced.replace(". ", ".\n").replace(": ", ":\n").split("\n")


def _contention(text: str | None) -> str:
    chars, kept = 0, []
    for s in _sentences(_single_spaced(text).lstrip("•‣▪ ")):
        if len(s) >= LEAST_SENTENCE and not _residue(s):
            kept.append(s)
            # nothing is tried once the limit is passed
            if (chars := chars + len(s)) > MOST_PROSE:
                break
    return " ".join(kept)


#: A limb's text as prose: sentences of 3 characters or more that aren't residue, up to the one with which they pass 700 characters.
contention = reading("string", each(_contention), pa.string())
#: The first three sentences, 800 characters at most.
opening = reading("string", each(lambda t: " ".join(_sentences(_single_spaced(t))[:SUMMARY_SENTENCES])[:SUMMARY_CHARS]), pa.string())


def snippet_at(text: Column, offset: Column) -> Column:
    """struct(text, offset, truncated_start, truncated_end): 90 characters before and 110 after an offset (from 0), snapped inwards to spaces; null without either."""

    def cut(at: Column) -> Column:
        start, end = F.greatest(at - BEFORE, F.lit(0)), F.least(at + AFTER, F.length(text))
        first = F.instr(F.substr(text, start + 1, at - start), F.lit(" "))
        last = F.instr(F.reverse(F.substr(text, at + 1, end - at)), F.lit(" "))
        start = F.when((start > 0) & (first > 0), start + first).otherwise(start)
        end = F.when((end < F.length(text)) & (last > 0), end - last).otherwise(end)
        return let(F.struct(start.alias("a"), end.alias("b")), lambda x: F.struct(F.trim(F.regexp_replace(F.substr(text, x["a"] + 1, x["b"] - x["a"]), r"\s+", " ")).alias("text"), at.alias("offset"), (x["a"] > 0).alias("truncated_start"), (x["b"] < F.length(text)).alias("truncated_end")))

    return F.when((offset >= 0) & (F.length(text) > 0), let(offset, cut))


def snippet(text: str, at: int | None) -> tuple[str, int, bool, bool] | None:
    """snippet_at() of one text, within a task."""
    if at is None or not text:
        return None
    start, end = max(at - BEFORE, 0), min(at + AFTER, len(text))
    first, last = text.find(" ", start, at), text.rfind(" ", at, end)
    start, end = first + 1 if start > 0 and first >= 0 else start, last if end < len(text) and last >= 0 else end
    return _spaces.sub(" ", text[start:end]).strip(" "), at, start > 0, end < len(text)


def numbered(text: Column, client: Column | None = None, labels: tuple[str, ...] | None = None) -> Column:
    """struct(text, tokens map): identifiers replaced by [LABEL-n], n counting a label's matches from 1; tokens holds what each stands for.

    The client's name, of three letters or more, goes first, and its first word, of four or more, with it.
    """
    kind = "struct<text:string,tokens:map<string,string>>"
    start = F.struct(F.coalesce(text, F.lit("")).alias("text"), F.create_map().cast("map<string,string>").alias("tokens")).cast(kind)
    if client is not None:
        name = F.trim(client)
        head = F.regexp_extract(name, r"^\S+", 0)
        whole, word = F.concat(F.lit("(?i)\\Q"), name, F.lit("\\E")), F.concat(F.lit("(?i)\\b\\Q"), head, F.lit("\\E\\b"))
        known = F.coalesce(F.length(name) >= LEAST_NAME, F.lit(False))
        once = F.when(known & (F.length(head) >= LEAST_HEAD) & ~F.lower(head).isin(*NO_HEADS), F.regexp_replace(F.regexp_replace(text, whole, F.lit(TAXPAYER)), word, F.lit(TAXPAYER))).when(known, F.regexp_replace(text, whole, F.lit(TAXPAYER))).otherwise(text)
        tokens = F.when(known & F.coalesce(F.regexp_like(text, whole), F.lit(False)), F.create_map(F.lit(TAXPAYER), name)).otherwise(F.create_map().cast("map<string,string>"))
        start = F.struct(F.coalesce(once, F.lit("")).alias("text"), tokens.alias("tokens")).cast(kind)

    def step(label: str, pattern: str):
        def put(acc: Column) -> Column:
            token = lambda i: F.concat(F.lit(f"[{label}-"), i.cast("string"), F.lit("]"))
            text = F.array_join(F.transform(F.split(acc["text"], pattern), lambda p, i: F.when(i == 0, p).otherwise(F.concat(token(i), p))), "")
            found = F.transform(F.regexp_extract_all(acc["text"], F.lit(pattern), F.lit(0)), lambda m, i: F.struct(token(i + 1).alias("key"), m.alias("value")))
            return F.struct(text.alias("text"), F.map_concat(acc["tokens"], F.map_from_entries(found)).alias("tokens")).cast(kind)

        return put

    steps = [step(label, p) for label, p in IDENTIFIERS if labels is None or label in labels]
    return reduce(lambda acc, put: let(acc, put), steps, start)


def _keyed(field: str) -> Column:
    """The tokens of a scrubbed field, each with the field's name."""
    return F.transform(F.map_entries(F.col(f"_{field}.tokens")), lambda e: F.struct(F.concat(F.lit(f"{field}: "), e["key"]).alias("key"), e["value"].alias("value")))


def anonymised(matters: DataFrame) -> DataFrame:
    """Matters without identity: client_name, gstin and client_ref are dropped, free texts and five texts of each limb (defects) are scrubbed, the amount is a band.

    Columns that a table lacks are passed over. tokens holds what the placeholders of the free texts stand for.
    """
    client = F.col("client_name") if "client_name" in matters.columns else None
    texts = [c for c in SCRUBBED if c in matters.columns]
    out = matters.withColumns({f"_{c}": numbered(F.col(c), client) for c in texts})
    if "defects" in matters.columns:
        fields = matters.schema["defects"].dataType.elementType.names
        clean = lambda d: F.struct(*[(F.when(d[f] != "", numbered(d[f], client)["text"]).otherwise(d[f]) if f in LIMB_SCRUBBED else d[f]).alias(f) for f in fields])
        out = out.withColumn("defects", F.transform("defects", clean))
    tokens = F.map_from_entries(F.array_distinct(F.flatten(F.array(*[_keyed(c) for c in texts])))) if texts else F.create_map().cast("map<string,string>")
    out = out.withColumns({"tokens": tokens, **{c: F.when(F.col(c).isNotNull(), F.col(f"_{c}.text")) for c in texts}}).drop(*[f"_{c}" for c in texts], *DROPPED)
    return out.withColumn("amount_disputed", F.when(F.col("amount_disputed").isNotNull(), amount_band(F.col("amount_disputed").cast(MONEY)))) if "amount_disputed" in matters.columns else out
