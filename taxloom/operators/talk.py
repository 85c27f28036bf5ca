"""Conversations, call outcomes, rankings, and identifiers in texts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

# Identifier labels and patterns, the most specific first.
IDENTIFIERS = [
    ("GSTIN", r"\b[0-9]{2}[A-Z]{5}[0-9]{4}[A-Z][0-9A-Z]{3}\b"),
    ("CIN", r"\b[LUu][0-9]{5}[A-Z]{2}[0-9]{4}[A-Z]{3}[0-9]{6}\b"),
    ("AADHAAR", r"\b[2-9][0-9]{3}\s?[0-9]{4}\s?[0-9]{4}\b"),
    ("TAN", r"\b[A-Z]{4}[0-9]{5}[A-Z]\b"),
    ("PAN", r"\b[A-Z]{5}[0-9]{4}[A-Z]\b"),
    ("EMAIL", r"\b[\w.+-]+@[\w-]+\.[\w.]+\b"),
    ("PHONE", r"(?<!\d)(?:\+?91[\-\s]?)?[6-9][0-9]{9}(?!\d)"),
    ("ACCOUNT", r"(?<!\d)\d{9,18}(?!\d)"),
]


def recent_history(turns: DataFrame, n: int = 6) -> DataFrame:
    """The last 2n messages of each conversation, in order: user turns, and assistant turns that say something."""
    used = turns.where("role = 'user' or (role = 'assistant' and trim(text) <> '')")
    last = used.withColumn("back", F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn"), F.desc("text")))).where(F.col("back") <= 2 * n)
    return last.select("conv_id", "turn", "role", "back", F.length("text").cast("long").alias("chars"))


def snippet(turns: DataFrame, n: int = 3, most: int = 1500, marker: str = " [cut]") -> DataFrame:
    """The last 2n messages joined by blank lines, each cut at `most` characters; only the chosen few of a conversation meet in a row."""
    used = turns.where("role = 'user' or (role = 'assistant' and trim(text) <> '')")
    last = used.withColumn("back", F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn"), F.desc("text")))).where(F.col("back") <= 2 * n)
    cut = F.when(F.length("text") > most, F.concat(F.left("text", F.lit(most)), F.lit(marker))).otherwise(F.col("text"))
    rows = F.transform(F.reverse(F.array_sort(F.collect_list(F.struct("back", F.concat("role", F.lit(": "), cut).alias("said"))))), lambda r: r["said"])
    return last.groupBy("conv_id").agg(F.array_join(rows, "\n\n").alias("snippet"))


def scrub(text: Column) -> Column:
    """Identifiers replaced by their labels, unnumbered. A text is searched only for what may be in it; see may_hold()."""
    may, of = may_hold(text), text
    for label, pattern in IDENTIFIERS:
        of = F.regexp_replace(of, pattern, f"[{label}]")
    return F.when(may["ACCOUNT"], of).when(may["EMAIL"], F.regexp_replace(text, dict(IDENTIFIERS)["EMAIL"], "[EMAIL]")).otherwise(text)


def may_hold(text: Column) -> dict[str, Column]:
    """Of each label, whether a text may hold it: e-mail addresses have an @, all others four digits in a row."""
    return {label: F.contains(text, F.lit("@")) if label == "EMAIL" else text.rlike("[0-9]{4}") for label, _ in IDENTIFIERS}


def leaking(text: Column) -> Column:
    """Whether a text holds an identifier; false if it is null."""
    may = may_hold(text)
    return F.coalesce(reduce(lambda a, b: a | b, [may[label] & text.rlike(p) for label, p in IDENTIFIERS]), F.lit(False))


def audit_leaks(texts: DataFrame, id_col: str, text_col: str, client_col: str | None = None, labels: list[str] | None = None) -> DataFrame:
    """How often each kind of identifier (or only those of labels), and a client's name of three letters or more, stands in the texts, and in how many of them.

    The counts are combined before the shuffle. All kinds but e-mail addresses hold four digits in a row, so only texts with these are searched for them.
    """
    may = may_hold(F.col(text_col))
    found = [F.struct(F.lit(label).alias("label"), F.when(may[label], F.regexp_count(text_col, F.lit(p))).otherwise(0).alias("n")) for label, p in IDENTIFIERS if labels is None or label in labels]
    if client_col:
        name = F.trim(client_col)
        found.append(F.struct(F.lit("CLIENT").alias("label"), F.when(F.length(name) >= 3, F.regexp_count(text_col, F.concat(F.lit("(?i)\\Q"), name, F.lit("\\E")))).otherwise(0).alias("n")))
    kinds = F.array(*found)
    return texts.select(id_col, F.explode(kinds).alias("k")).where("k.n > 0").groupBy("k.label").agg(F.sum("k.n").alias("matches"), F.count("*").alias("texts"))


def guarded(texts: DataFrame, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(clean, quarantine): rows whose scrubbed text holds no identifier, and those that still leak."""
    done = texts.withColumn("scrubbed", scrub(F.col(text_col)))
    # as an element, the scrubbed text is worked out once for all patterns, also where a filter is put below the column
    leaks = F.exists(F.array("scrubbed"), leaking)
    return done.where(~leaks), done.where(leaks)


def write_guarded(texts: DataFrame, text_col: str, path: str) -> tuple[int, int]:
    """Writes each row with its scrubbed text to path, parted by leaks (true or false), and gives how many don't leak and do: counted in the pass that writes.

    The text of a row that leaks is replaced by nothing, so that what is quarantined can't be read.
    """
    leaks = F.exists(F.array("scrubbed"), leaking)
    done = texts.withColumn("scrubbed", scrub(F.col(text_col))).withColumn("leaks", leaks).withColumn("scrubbed", F.when(~F.col("leaks"), F.col("scrubbed"))).drop(text_col)
    seen = Observation()
    done.observe(seen, F.count_if(~F.col("leaks")).alias("clean"), F.count_if("leaks").alias("leaking")).write.mode("overwrite").partitionBy("leaks").parquet(path)
    return seen.get["clean"], seen.get["leaking"]


def call_outcome(body: Column) -> Column:
    """What became of a model call, from its JSON body."""
    parsed = F.try_parse_json(body)
    get = lambda path: F.get_json_object(body, path)
    content = F.trim(F.coalesce(get("$.choices[0].message.content"), F.lit("")))
    return (
        F.when(parsed.isNull(), "not_json")
        .when(get("$.error").isNotNull(), "refused")
        .when(get("$.choices[0]").isNull(), "no_completion")
        .when((content == "") & get("$.choices[0].finish_reason").isin("length", "max_tokens"), "starved")
        .when(content == "", "empty")
        .otherwise("ok")
    )


def aggregate_rankings(reviews: DataFrame) -> DataFrame:
    """Mean place of each model, from 0 to 1 within a review (0.5 where only one is ranked), best first.

    reviews: review_id, ranking array<string>, models map<label, model>; unknown labels count in the length only.
    """
    n = F.size("ranking")
    place = reviews.select("models", n.alias("n"), F.posexplode("ranking").alias("pos", "label"))
    share = F.when(F.col("n") == 1, 0.5).otherwise(F.col("pos") / (F.col("n") - 1))
    known = place.withColumn("model", F.try_element_at("models", F.col("label"))).where("model is not null").withColumn("share", share)
    return known.groupBy("model").agg(F.round(F.avg("share"), 6).alias("mean_place"), F.count("*").alias("rankings"))


# Headers of a closing ranking.
RANKING_HEADERS = ["ORDER OF MERIT:", "FINAL RANKING:", "RANKING:"]


def parse_ranking(text: Column, valid: Column | None = None) -> Column:
    """Labels "Response X" of a referee's text: after the last header the numbered ones, else any; each once, and, if valid (an array) is given, only those in it."""
    tail = F.regexp_extract(text, rf"(?s)^.*(?:{'|'.join(RANKING_HEADERS)})(.*)$", 1)
    tail = F.when(text.rlike("|".join(RANKING_HEADERS)), tail).otherwise(text)
    listed = F.regexp_extract_all(tail, F.lit(r"\d+\.\s*(Response [A-Z])"), F.lit(1))
    found = F.array_distinct(F.when(F.size(listed) > 0, listed).otherwise(F.regexp_extract_all(tail, F.lit("Response [A-Z]"), F.lit(0))))
    return found if valid is None else F.filter(found, lambda x: F.array_contains(valid, x))


def restore(text: Column, tokens: Column) -> Column:
    """The text with each token of a map replaced by what it stands for; the longest tokens first."""
    pairs = F.reverse(F.array_sort(F.transform(F.map_entries(tokens), lambda e: F.struct(F.length(e["key"]).alias("n"), e["key"].alias("key"), e["value"].alias("value")))))
    return F.when(tokens.isNull(), text).otherwise(F.aggregate(pairs, text, lambda t, e: F.replace(t, e["key"], F.coalesce(e["value"], F.lit("")))))
