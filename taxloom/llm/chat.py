"""Chat formatting whose output parses back to its source, by built-in functions only.

Grammar of a formatted conversation:

    chat = ("<chat raw>" | "<chat escaped>") "\\n" turn*
    turn = "### " role ": " text "</turn>" "\\n"

A deterministic parser cuts the part after the header before every "### ", and each turn at its first ": "
and first "</turn>". A conversation is rendered raw and parsed again; if the turns found aren't the source's, it is
rendered escaped, which no content can break: a backslash becomes "\\b", "###" becomes "\\h", "</turn>"
becomes "\\t" and, in a role, ":" becomes "\\c".
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, END, RAW, ESCAPED = "### ", "</turn>\n", "<chat raw>\n", "<chat escaped>\n"


def _swap(text: Column, *pairs: tuple[str, str]) -> Column:
    for old, new in pairs:
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def escape(text: Column, role: bool = False) -> Column:
    """Without "###", "</turn>" (and ":"); backslashes come first, so that each that is left starts a code."""
    return _swap(text, ("\\", "\\b"), ("###", "\\h"), ("</turn>", "\\t"), *[(":", "\\c")] * role)


def unescape(text: Column) -> Column:
    """The inverse of escape(); backslashes come last."""
    return _swap(text, ("\\h", "###"), ("\\t", "</turn>"), ("\\c", ":"), ("\\b", "\\"))


def _render(turns: Column, escaped: bool) -> Column:
    same = lambda c, role=False: escape(c, role) if escaped else c
    texts = F.transform(turns, lambda t: F.concat(F.lit(OPEN), same(t["role"], True), F.lit(": "), same(t["text"]), F.lit(END)))
    return F.concat(F.lit(ESCAPED if escaped else RAW), F.array_join(texts, ""))


def parse(formatted: Column) -> Column:
    """Turns of a formatted conversation, as its text alone tells them: array of (role, text, at, size).

    at and size are where the turn's text, as formatted, stands: its first code point, from 0, and its code points.
    """
    escaped = F.startswith(formatted, F.lit(ESCAPED))
    bare = lambda c: F.when(escaped, unescape(c)).otherwise(c)
    parts = F.split(formatted, OPEN)

    def turn(part: Column) -> Column:
        role = F.substring_index(part, ": ", 1)
        text = F.substring_index(F.substr(part, F.length(role) + 3), "</turn>", 1)
        return F.struct(bare(role).alias("role"), bare(text).alias("text"), (F.length(role) + 2).alias("skip"), F.length(text).alias("size"), F.length(part).alias("length"))

    turns = F.transform(F.slice(parts, 2, F.size(parts)), turn)
    start = F.length(F.element_at(parts, 1))
    # where each turn's text stands: running sums, kept in a string-free fold over the few numbers of a turn
    ends = F.aggregate(
        turns,
        F.struct(start.alias("end"), F.array().cast("array<struct<role:string,text:string,at:int,size:int>>").alias("out")),
        lambda acc, t: F.struct((acc["end"] + len(OPEN) + t["length"]).alias("end"), F.concat(acc["out"], F.array(F.struct(t["role"].alias("role"), t["text"].alias("text"), (acc["end"] + len(OPEN) + t["skip"]).alias("at"), t["size"].alias("size")))).alias("out")),
    )
    return ends["out"]


def _plain(turns: Column) -> Column:
    return F.transform(turns, lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))


def format_chats(turns: DataFrame) -> DataFrame:
    """(conv_id, formatted) of every conversation of turns (conv_id, turn, role, text).

    Turns are in the order of turn, then role and text (nulls first); repeated rows are turns of their own. A null role or
    text counts as empty. Rows without a conv_id are one conversation. Long texts stay whole; other columns are ignored; an
    empty table gives no rows. A conversation, being one string, is put together in one row. Should even
    the escaped form not parse back to the source, the job fails rather than return it.
    """
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    chats = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct(F.coalesce(F.col("turn"), F.lit(-(2**63))).alias("turn"), blank("role").alias("role"), blank("text").alias("text")))).alias("turns"))
    chats = chats.select("conv_id", _plain(F.col("turns")).alias("turns"))
    raw = chats.withColumn("raw", _render(F.col("turns"), False))
    chosen = raw.withColumn("formatted", F.when(_plain(parse(F.col("raw"))) == F.col("turns"), F.col("raw")).otherwise(_render(F.col("turns"), True)))
    kept = F.when(_plain(parse(F.col("formatted"))) == F.col("turns"), F.col("formatted")).otherwise(F.raise_error("a formatted conversation doesn't parse back"))
    return chosen.select("conv_id", kept.alias("formatted"))


def with_loss_spans(chats: DataFrame) -> DataFrame:
    """Adds turns (as parsed back) and spans: (at, size) in code points of each assistant text, the loss mask of formatted."""
    turns = parse(F.col("formatted"))
    spans = F.transform(F.filter(F.col("turns"), lambda t: t["role"] == "assistant"), lambda t: F.struct(t["at"].alias("at"), t["size"].alias("size")))
    return chats.withColumn("turns", turns).withColumn("spans", spans)


def chat_digests(chats: DataFrame) -> DataFrame:
    """What the outputs of format_chats() hold, read back from formatted alone, by digests."""
    read = with_loss_spans(chats)
    escaped = F.startswith("formatted", F.lit(ESCAPED))
    masked = F.transform("spans", lambda s: F.substr(F.col("formatted"), s["at"] + 1, s["size"]))
    loss = F.array_join(F.transform(masked, lambda t: F.when(escaped, unescape(t)).otherwise(t)), "")
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return read.select("conv_id", F.size("turns").cast("long").alias("n_turns"), digest(said).alias("turns_sha256"), F.length(loss).cast("long").alias("loss_chars"), digest(loss).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))
