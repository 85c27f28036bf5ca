"""Notice texts: fields, limbs, head-wise figures, checksum, flags. All narrow; texts are read within Arrow batches and never shuffled."""

from __future__ import annotations

import datetime
import re
from collections.abc import Callable
from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.money import MONEY
from ..functions.texts import each, lists, paise, pattern, reading, rupees, structs
from ..plans.dimensions import GST, Pack, notice_types
from ..plans.places import PLACES, places
from ..plans.limb_types import catalogue as known_types
from ..plans.limb_types import limb_types
from .filing import snippet, snippet_at
from .intake import CODES, DIRECTION, DIRECTION_LOOKBACK, GSTIN, NAME, NAME_LABEL, as_date, bare_code, best_form, best_known, compact, office, scan, years
from .intake import first as first_of
from .limbs import Catalogue, figure_of, head_order, limbs_of, sums

# Patterns of a taxpayer's name, of the block that states it, lines of that block that are no name, and how far a name stands from the GSTIN.
LABELLED_NAME = NAME_LABEL + NAME
PREFIXED_NAME = r"(?:M/s\.?|Tvl\.?|Messrs\.?)[ \t]*\n?[ \t]*([A-Z][\w&.'\-]*(?:[ \t]+[A-Z][\w&.'\-]*){0,7})"
SUFFIXED_NAME = r"\b((?:[A-Z][\w&.'\-]*[ \t]+){1,6}(?i:PRIVATE[ \t]+LIMITED|PVT\.?[ \t]*LTD\.?|PUBLIC[ \t]+LIMITED|LIMITED|LTD\.?|LLP|LIMITED[ \t]+LIABILITY[ \t]+PARTNERSHIP|&[ \t]*CO\.?|AND[ \t]+COMPANY|&[ \t]*SONS|ENTERPRISES|INDUSTRIES|ASSOCIATES|TRADERS|AGENCIES|ELECTRICALS|HOTELS))\b"
TAXPAYER_BLOCK = r"(?i)Details\s+of\s+the\s+Tax\s?payer|Reg\s+Status|Trade\s+Name"
NO_NAMES = [
    "gstin", "gstn", "pan", "name", "trade name", "legal name", "reg status", "status", "active", "inactive", "financial year", "zone", "circle",
    "details of the tax payer", "details of the taxpayer", "office details", "designation of the proper officer",
]
NAME_WINDOW = 600
SCAN_CHARS = 200
#: Fields that a notice should state.
FIELDS = ("name", "gstin", "form", "state", "period", "due_date", "notice_date", "section")
BLANK = " \t\x0b\f\r"
_labelled, _prefixed, _suffixed, _code = (pattern(p) for p in (LABELLED_NAME, PREFIXED_NAME, SUFFIXED_NAME, GSTIN))
_spaces, _letters, _ends = (pattern(p) for p in (r"\s+", "[A-Za-z]{2}", r"\n{3,}"))
#: Tried on texts in lower case, which is faster than without regard to case.
_block, _direction = (pattern(p.removeprefix("(?i)").lower()) for p in (TAXPAYER_BLOCK, DIRECTION))


def tidy(text: Column) -> Column:
    """Runs of blanks as one space, three or more line ends as two, nothing around."""
    return F.btrim(F.regexp_replace(F.regexp_replace(text, r"[ \t]{2,}|\t", " "), r"\n{3,}", "\n\n"), F.lit(" \n\t\r"))


def first(text: Column, pattern: str, group: int = 1) -> Column:
    """The first match, or null."""
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def every(text: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def form_code(text: Column) -> Column:
    """The longest known code that the text names; of equally long ones the first in the table. One scan finds all that are named."""
    return best_form(every(text, r"(?i)\b(?:" + "|".join(c.replace("-", r"[\s-]*") for c in CODES) + r")\b", 0))


def _bare(name: str | None) -> str | None:
    return (name or "").strip(" .,") or None


def _longest(text: str, names: re.Pattern) -> str | None:
    """The longest name that a pattern finds; the first of equals."""
    return max((n for x in names.findall(text) if (n := _bare(x))), key=len, default=None)


def _line_above(text: str, code: str) -> str | None:
    """The line above the first place where a code stands alone on its line; up to two blank lines may lie between."""
    at = text.find(code)
    while at >= 0:
        begins, ends = text.rfind("\n", 0, at) + 1, text.find("\n", at)
        if not (text[begins:at] + text[at + len(code) : ends if ends >= 0 else len(text)]).strip(BLANK):
            said = next((x for x in reversed(text[: begins - 1].rsplit("\n", 3)[-3:]) if x.strip(BLANK)), None) if begins else None
            if said is not None:
                return said
        at = text.find(code, at + 1)
    return None


def _name(text: str | None, labelled: str | None = None, code: str | None = None) -> str | None:
    """entity_name() of a text whose labelled name and first code are known."""
    if name := _bare(labelled):
        return name
    if code:
        at = text.find(code)
        window = text[max(at - NAME_WINDOW, 0) : at + len(code) + NAME_WINDOW]
        if _block.search(window.lower()):
            line = (_line_above(text, code) or "").strip(" ").strip(".,;")
            if 3 <= len(line) <= 80 and ":" not in line and not line[0].isdigit() and _letters.search(line) and _spaces.sub(" ", line).lower() not in NO_NAMES:
                return line
        if name := _longest(window, _prefixed) or _longest(window, _suffixed):
            return name
    return _longest(text, _prefixed) or _longest(text, _suffixed)


def _name_alone(text: str | None) -> str | None:
    group = lambda p: m[1] if (m := p.search(text)) else None
    return None if text is None else _name(text, group(_labelled), group(_code))


#: The taxpayer's name: labelled, else on the line above a GSTIN (the first) that stands alone in the taxpayer's block, else (the longest) after a prefix or
#: before a legal suffix within 600 characters of the GSTIN, else in all the text. A name far off is mostly a supplier's.
entity_name = reading("string", each(_name_alone), pa.string())


def _tidied(text: str) -> str:
    """tidy() of one text."""
    text = text.replace("\t", " ")
    while "  " in text:
        text = text.replace("  ", " ")
    return (_ends.sub("\n\n", text) if "\n\n\n" in text else text).strip(" \n\t\r")


def _directed(text: str, found: dict) -> tuple[int | None, str | None]:
    """The first "on or before" a date that a direction to answer leads up to."""
    return next(((at, day) for at, day in found.get("on_or_before", ()) if _direction.search(text[max(at - DIRECTION_LOOKBACK, 0) : at].lower())), (None, None))


def _days(found: dict) -> list[tuple[int, datetime.date]]:
    return [(at, d) for at, x in found.get("date", ()) if (d := as_date(x))]


#: What _read() tells of a notice, in order, and how it is held.
READ = {
    "gstin": pa.string(), "reference": pa.string(), "arn": pa.string(), "din": pa.string(), "form": pa.string(), "sections": partial(lists, of=pa.string()), "rules": partial(lists, of=pa.string()), "period": pa.string(), "name": pa.string(), "state": pa.string(),
    "notice_date": pa.date32(), "due_date": pa.date32(), "officer": pa.string(), "office": pa.string(), "dates": partial(lists, of=pa.date32()), "amounts": partial(lists, of=rupees), "section": pa.string(), "window_days": pa.int32(), "missing": partial(lists, of=pa.string()),
}
_READ = f"struct<gstin:string,reference:string,arn:string,din:string,form:string,sections:array<string>,rules:array<string>,period:string,name:string,state:string,notice_date:date,due_date:date,officer:string,office:string,dates:array<date>,amounts:array<{MONEY}>,section:string,window_days:int,missing:array<string>>"
STATES = {code: state for code, state, _ in PLACES}


def _read(t: str, found: dict) -> tuple:
    """What a tidied notice states of itself, as READ has it, by what its scan found."""
    one = lambda *kinds: first_of(found, *kinds)[1]
    every = lambda kind: [x for _, x in found.get(kind, ())]
    gstin, days, sections, due = one("gstin"), _days(found), compact(every("section")), one("labelled_due")
    # a labelled row that can't be read leaves no deadline, as it is believed before prose
    due_date = as_date(due if due is not None else _directed(t, found)[1])
    officer = ", ".join(x for k in ("officer", "designation") if (x := (one(k) or "").strip(" "))) or None
    circle, window, section, bare_year = one("circle"), one("window"), one("labelled_section"), one("year")
    said = {
        "gstin": gstin, "reference": one("dated_id", "referred") or one("portal_id"), "arn": one("arn"), "din": one("din"), "form": best_known(every("form")), "sections": sections, "rules": compact(every("rule")),
        "period": years(one("bare_year") if bare_year is None else bare_year), "name": _name(t, one("name"), gstin), "state": STATES.get(gstin[:2]) if gstin else None, "notice_date": as_date(one("dated")) or (days[0][1] if days else None), "due_date": due_date, "officer": officer,
        "office": office(one("jurisdiction")) if "jurisdiction" in found else circle and circle.strip(" ,"), "dates": list(dict.fromkeys(d for _, d in days)), "amounts": [x for a in every("amount") if (x := paise(a)) is not None],
        "section": section if section is not None else sections[0] if sections else None, "window_days": int(window) if window and due_date is None else None,
    }
    # a reply that is due within days of receipt has no date to miss
    gone = [f for f in FIELDS if said[f] is None and (f != "due_date" or said["window_days"] is None)]
    return (*said.values(), gone)


def _told(t: str, found: dict, only: frozenset[str] | None = None) -> list[tuple[str, str, int | None]]:
    """Field, source and place, from 0 and null where it isn't known, of each field that a tidied notice states, or of those asked for."""
    at = lambda *kinds: first_of(found, *kinds)[0]
    one = lambda *kinds: first_of(found, *kinds)[1]
    out = []

    def put(field: str, source: str, *places: int | None) -> None:
        if only is None or field in only:
            out.append((field, source, next((p for p in places if p is not None), None)))

    gstin = one("gstin")
    if gstin is not None:
        put("gstin", "notice", at("gstin"))
        if gstin[:2] in STATES:
            put("state", "gstin", at("gstin"))
    if (only is None or "name" in only) and (name := _name(t, one("name"), gstin)):
        put("name", "notice", p if (p := t.find(name)) >= 0 else None)
    if form := best_known([x for _, x in found.get("form", ())]):
        put("form", "notice", next(p for p, x in found["form"] if bare_code(x) == form.replace("-", "")))
    if "year" in found or "bare_year" in found:
        put("period", "notice", at("year"), at("bare_year"))
    if "dated_id" in found or "referred" in found or "portal_id" in found:
        put("reference", "notice", at("dated_id", "referred"), at("portal_id"))
    for field in ("arn", "din"):
        if field in found:
            put(field, "notice", at(field))
    if "labelled_section" in found or "section" in found:
        put("section", "notice-labelled" if "labelled_section" in found else "notice", at("labelled_section"), at("section"))
    if as_date(one("dated")):
        put("notice_date", "notice-labelled", at("dated"))
    elif days := _days(found):
        put("notice_date", "notice-inferred", days[0][0])
    due, directed = "labelled_due" in found, _directed(t, found)
    due_date = as_date(one("labelled_due") if due else directed[1])
    if due_date:
        put("due_date", "notice-labelled" if due else "notice-directed", at("labelled_due"), directed[0])
    elif "window" in found:
        put("window_days", "notice", at("window"))
    if any((one(k) or "").strip(" ") for k in ("officer", "designation")):
        put("officer", "notice", at("officer"), at("designation"))
    if "jurisdiction" in found or "circle" in found:
        put("office", "notice", at("jurisdiction"), at("circle"))
    return out


def _scanned(read: Callable, blank: object) -> Callable[[pa.Array], list]:
    """A batch of texts read by what their scans found; blank stands for no text."""

    def batch(texts: pa.Array) -> list:
        tidied = [None if t is None else _tidied(t) for t in texts.to_pylist()]
        found = scan([t for t in tidied if t is not None])
        return [blank if t is None else read(t, next(found)) for t in tidied]

    return batch


_stated = reading(_READ, _scanned(_read, (None,) * (len(READ) - 1) + (list(FIELDS),)), partial(structs, kinds=READ))


_AT = {"field": pa.string(), "source": pa.string(), "at": pa.int32()}
_sources = reading("array<struct<field:string,source:string,at:int>>", _scanned(_told, []), partial(lists, of=partial(structs, kinds=_AT)))
_SNIPPET = {"text": pa.string(), "offset": pa.int32(), "truncated_start": pa.bool_(), "truncated_end": pa.bool_()}
_AROUND = {"text": pa.string(), "told": partial(lists, of=partial(structs, kinds={"field": pa.string(), "source": pa.string(), "snippet": partial(structs, kinds=_SNIPPET)}))}
_AROUND_TYPE = "struct<text:string,told:array<struct<field:string,source:string,snippet:struct<text:string,offset:int,truncated_start:boolean,truncated_end:boolean>>>>"


def _around(t: str, found: dict, only: frozenset[str] | None) -> tuple[str, list[tuple]]:
    """A tidied notice, and _told() with the text around each place instead of it."""
    return t, [(field, source, snippet(t, at)) for field, source, at in _told(t, found, only)]


def fields(notices: DataFrame) -> DataFrame:
    """Adds what a notice (notice_id, text) states of itself; null where it doesn't.

    One scan of the text (see intake) gives all but the name. A labelled row is believed before prose, a deadline is labelled or directed, never just a late date, and
    a window of days is no date; a notice's date may be the first that it has. sources: where each field came from (notice, notice-labelled, notice-directed,
    notice-inferred, gstin); snippets: the text around each, with its place. Neither is worked out if it isn't used.
    """
    t = F.col("text")
    read = notices.withColumns({"_read": _stated(t), "_told": _sources(t), "text": tidy(t)})
    read = read.withColumns({k: F.col(f"_read.{k}") for k in READ if k not in ("section", "window_days", "missing")}).withColumn("scan_like", F.length(t) < SCAN_CHARS).withColumns({k: F.col(f"_read.{k}") for k in ("section", "window_days")})
    entries = lambda value: F.map_from_entries(F.transform("_told", lambda e: F.struct(e["field"].alias("key"), value(e).alias("value"))))
    read = read.withColumns({"sources": entries(lambda e: e["source"]), "snippets": entries(lambda e: snippet_at(F.col("text"), e["at"]))})
    return read.withColumn("missing", F.col("_read.missing")).drop("_read", "_told")


def sourced(notices: DataFrame, only: tuple[str, ...] | None = None) -> DataFrame:
    """(notice_id, text, field, source, snippet): a row for each field that a notice states, as fields() has them in maps; only the fields asked for are worked out.

    An outer explode, as an inner one would put a test of the whole array, with the scan in it, before all.
    """
    around = reading(_AROUND_TYPE, _scanned(partial(_around, only=only and frozenset(only)), (None, [])), partial(structs, kinds=_AROUND))
    told = notices.select("notice_id", around(F.col("text")).alias("a")).select("notice_id", "a.text", F.explode_outer("a.told").alias("e")).where("e is not null")
    return told.select("notice_id", "text", "e.field", "e.source", "e.snippet")


def identified(notices: DataFrame) -> DataFrame:
    """Adds gstin, the first that stands in a notice: all that with_jurisdiction() needs, without the scan for the other fields."""
    return notices.withColumn("gstin", first(F.col("text"), r"(?=\d)" + GSTIN))


def with_jurisdiction(df: DataFrame) -> DataFrame:
    """Adds state and high_court by the GSTIN's first two digits; unknown ones stay, with nulls."""
    return df.drop("state").withColumn("code", F.left("gstin", F.lit(2))).join(F.broadcast(places(df.sparkSession)), "code", "left").drop("code")


def with_reply_form(df: DataFrame, pack: Pack = GST) -> DataFrame:
    """Adds statute and reply_form of the notice's form; a form that the pack doesn't know has those of its OTHER, or nulls without one."""
    known = F.broadcast(notice_types(df.sparkSession, pack))
    other = next((x for x in pack.notice_types if x[0] == "OTHER"), (None, None, None))
    hit = F.col("code").isNotNull()
    joined = df.join(known, F.col("form") == F.col("code"), "left")
    return joined.withColumns({"statute": F.when(hit, F.col("statute")).otherwise(other[1]), "reply_form": F.when(hit, F.col("reply_form")).otherwise(other[2])}).drop("code")


def limbs(notices: DataFrame, catalogue: Catalogue | None = None) -> DataFrame:
    """(notice_id, index, heading, body, pre, head_order) of each limb; see limbs_of(). pre, the text before all limbs, stands with the first only."""
    read = notices.select("notice_id", tidy(F.col("text")).alias("t")).select("notice_id", head_order(F.col("t")).alias("head_order"), limbs_of(F.col("t"), catalogue).alias("got"))
    return read.select("notice_id", "head_order", "got.pre", F.posexplode("got.limbs").alias("at", "l")).select("notice_id", "l.index", "l.heading", "l.body", F.when(F.col("at") == 0, F.col("pre")).alias("pre"), "head_order")


def figures(limbs: DataFrame) -> DataFrame:
    """Adds heads (map), total, basis and label to limbs(): basis tells which reading of figure_of() it is, unread, with null figures, if none."""
    read = limbs.withColumn("_f", figure_of(F.col("body"), F.col("pre"), F.col("head_order")))
    return read.withColumns({"heads": F.col("_f.heads"), "total": F.col("_f.total"), "basis": F.coalesce("_f.basis", F.lit("unread")), "label": F.col("_f.label")}).drop("_f", "pre", "head_order")


def checked(notices: DataFrame, catalogue: Catalogue | None = None) -> DataFrame:
    """A row for each notice: its limbs, their sum, the printed total, whether the two agree within 2 rupees, and flags, worst first.

    Figures and fields are read apart, so that what asks for one alone pays for one. A printed total that just repeats a limb is no total.
    """
    t = F.col("text")
    figures = reading(f"struct<limbs:bigint,limb_sum:{MONEY},unread:int,printed:{MONEY}>", each(lambda x: (0, None, 0, None) if x is None else sums(_tidied(x), catalogue)), partial(structs, kinds={"limbs": pa.int64(), "limb_sum": rupees, "unread": pa.int32(), "printed": rupees}))
    stated = notices.select("notice_id", _stated(t).alias("s"), figures(t).alias("f"), (F.length(tidy(t)) < SCAN_CHARS).alias("scan_like"))
    joined = stated.select("notice_id", "s.missing", "scan_like", "f.printed", "f.limbs", "f.limb_sum", "f.unread", (F.abs(F.col("f.printed") - F.col("f.limb_sum")) <= 2).alias("reconciles"), F.col("s.window_days").alias("_window"))
    flags = [
        F.when(F.col("limbs") == 0, "no_limbs"), F.when(~F.col("reconciles"), "does_not_reconcile"), F.when(F.col("unread") > 0, "unread_figures"), F.when(F.col("scan_like"), "scan"),
        F.when(F.col("_window").isNotNull(), "window_without_date"), F.when(F.size("missing") > 0, "fields_missing"), F.when(F.col("printed").isNull(), "no_printed_total"),
    ]
    return joined.withColumn("flags", F.array_compact(F.array(*flags))).drop("_window")


def corpus_report(checked: DataFrame) -> DataFrame:
    """One row: notices read, segmented, checkable, reconciled, like scans, and their limbs."""
    return checked.agg(F.count("*").alias("notices"), F.count_if(F.col("limbs") > 0).alias("segmented"), F.count_if(F.col("reconciles").isNotNull()).alias("checkable"), F.count_if("reconciles").alias("reconciled"), F.count_if("scan_like").alias("scans"), F.sum("limbs").alias("limbs"))


def review_sheet(checked: DataFrame, path: str) -> None:
    """A CSV row for each notice, with blank columns for a reader."""
    verdict = F.when(F.col("reconciles"), "yes").when(~F.col("reconciles"), "NO").otherwise("")
    checked.select("notice_id", "limbs", "limb_sum", "printed", verdict.alias("reconciles"), F.array_join("flags", "; ").alias("flags"), F.lit("").alias("correct"), F.lit("").alias("remarks")).write.mode("overwrite").option("header", True).csv(path)


def merge_sets(found: DataFrame) -> DataFrame:
    """found: set_id, doc_no, field, value, scanned. The first document that states a field supplies it; min_by combines before the shuffle."""
    stated = found.where("value is not null and trim(value) <> ''").groupBy("set_id", "field").agg(F.min(F.struct("doc_no", "value", "scanned")).alias("m"))
    return stated.select("set_id", "field", "m.value", F.concat("m.doc_no", F.when(F.col("m.scanned"), "-ocr").otherwise("")).alias("source"))


def limb_document(counts: DataFrame) -> DataFrame:
    """counts: set_id, doc_no, limbs. The document with the most limbs supplies a set's limbs; the earliest of equals."""
    return counts.groupBy("set_id").agg(F.max_by("doc_no", F.struct("limbs", -F.col("doc_no"))).alias("doc_no"), F.max("limbs").alias("limbs"))


def typed(limbs: DataFrame, catalogue: list[tuple[str, list[str]]]) -> DataFrame:
    """Adds type to limbs: each pattern of a catalogue entry scores 10 in the heading, else 1 in the body; the highest score wins, the first of equals; none at 0."""
    score = lambda p: F.when(F.coalesce(F.col("heading"), F.lit("")).rlike(p), 10).when(F.coalesce(F.col("body"), F.lit("")).rlike(p), 1).otherwise(0)
    entries = [F.struct(F.aggregate(F.array(*[score(p) for p in patterns]), F.lit(0), lambda a, x: a + x).alias("score"), F.lit(-i).alias("before"), F.lit(name).alias("type")) for i, (name, patterns) in enumerate(catalogue) if patterns]
    if not entries:
        return limbs.withColumn("type", F.lit(None).cast("string"))
    best = limbs.withColumn("_best", F.array_max(F.array(*entries)))
    return best.withColumn("type", F.when(F.col("_best.score") > 0, F.col("_best.type"))).drop("_best")


def catalogued(limbs: DataFrame) -> DataFrame:
    """Adds what the catalogue knows of each limb's type: type (other where nothing matches), label, statute, sections, rules, posture, tags."""
    found = typed(limbs, known_types()).withColumn("type", F.coalesce("type", F.lit("other")))
    return found.join(F.broadcast(limb_types(limbs.sparkSession)), "type")
