"""Corpus-wide fuzzy line deduplication by MinHash."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .families import classes, posterior_floors
from .scratch import discard, hub_join, lean, runtime_filters, settle
from .shingles import Shingles, char_shingles, pieces, signatures

LINES = "doc_id long, text_hash long, line_no int, node long, sig binary, line string"
#: Lines that a task remembers having signed.
SEEN = 1 << 17


def _split(shingle: Callable[[list[str | None]], Shingles], hashes: int) -> Callable:
    """mapInArrow function from (doc_id, text_hash, text) to LINES; sig and line stand only where a task meets a line first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            texts = batch.column(2).to_pylist()
            for a, b in pieces(texts):
                own = [[(i, s) for i, x in enumerate(t.split("\n")) if (s := x.strip(" \t\r"))] if t else [] for t in texts[a:b]]
                flat = [s for lines in own for _, s in lines]
                nodes = np.array([xxhash.xxh64_intdigest(s) for s in flat], np.uint64).view(np.int64)
                sigs: list[bytes | None] = [None] * len(flat)
                new = [i for i, node in enumerate(nodes.tolist()) if not (node in seen or seen.add(node))]
                for i, sig in zip(new, signatures(shingle([flat[i] for i in new]), hashes), strict=True):
                    sigs[i] = sig.tobytes()
                if len(seen) > SEEN:
                    seen.clear()
                docs = batch.slice(a, b - a).take(pa.array(np.repeat(np.arange(b - a), [len(x) for x in own])))
                line_no = pa.array([i for lines in own for i, _ in lines], pa.int32())
                lines = pa.array([s if sig is not None else None for s, sig in zip(flat, sigs, strict=True)], pa.string())
                yield pa.RecordBatch.from_arrays([docs.column(0), docs.column(1), line_no, pa.array(nodes), pa.array(sigs, pa.binary()), lines], ["doc_id", "text_hash", "line_no", "node", "sig", "line"])

    return run


def text_hash() -> F.Column:
    """What tells rows of one doc_id apart."""
    return F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("text_hash")


def repeated_lines(docs: DataFrame, *, size: int = 8, threshold: float = 0.8, hashes: int = 40, rows: int = 4) -> DataFrame:
    """(doc_id, text_hash, dropped array<int>): the numbers, from 0, of the lines that a document loses; only documents that lose any.

    Lines are compared trimmed; those of white space alone are no lines. Lines whose sets of character shingles have a Jaccard
    similarity of threshold or more are linked; of each connected component of lines, equal ones included, the occurrence
    with the least (doc_id, text_hash, line_no) stays. Lines under 11 characters have too few shingles to be near but not equal.
    Candidates share a band of `rows` MinHash values (a pair at exactly threshold is missed with a chance
    of (1 - threshold ** rows) ** (hashes / rows), 0.005 here, one at 0.9 with 0.00002); whether they are
    linked is decided on exact shingle sets (as 64-bit hashes); components come from a distributed union-find.

    A document is a doc_id and a text: rows that repeat a doc_id with other texts are documents of their own, in the order of
    text_hash; rows that repeat both are one, so that a line which stays in one stays in all. Null and empty texts have
    no lines to lose. Documents without a doc_id take no part. Other columns are ignored. Empty table: no rows.
    """
    shingle = partial(char_shingles, size=size)
    texts = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), text_hash(), "text")
    lines = settle(texts.mapInArrow(lean(_split(shingle, hashes)), LINES))
    signed = lines.where("sig is not null")
    near = classes(signed.select("node", F.col("line").alias("text")), signed.select("node", "sig"), shingle, hashes, rows, posterior_floors(threshold, 1e-4, hashes, hashes // 2), threshold, counting=False)
    at = F.struct("doc_id", "text_hash", "line_no")
    first = lines.groupBy("node").agg(F.min(at).alias("first"), F.count("*").alias("n")).join(near.select("node", "root"), "node", "left").where("n > 1 or root is not null")
    first = settle(first.select("node", F.coalesce("root", "node").alias("root"), "first", "n"))
    kept = first.groupBy("root").agg(F.min("first").alias("kept"))
    doomed = settle(hub_join(first.select("node", "root", "n"), kept, "root").select("node", "kept", "n")).where("kept is not null")
    with runtime_filters(docs.sparkSession):  # most lines stand once and are like no other
        lost = settle(hub_join(lines.select("doc_id", "text_hash", "line_no", "node"), doomed, "node", "n").where(at != F.col("kept")).groupBy("doc_id", "text_hash").agg(F.array_sort(F.collect_set("line_no")).alias("dropped")))
    discard(lines, first, doomed)
    return lost


def drop_repeated_lines(docs: DataFrame, **parameters) -> DataFrame:
    """docs with the lines of repeated_lines() taken out of text, and n_chars, if there is one, counted anew.

    Documents of which nothing but white space is left go; those that were so before, or have no doc_id, stay as they are.
    """
    lost = repeated_lines(docs, **parameters).select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), "dropped")
    joined = docs.join(lost, (F.col("doc_id").cast("long") == F.col("_id")) & (text_hash() == F.col("_hash")), "left")
    text = F.array_join(F.filter(F.split("text", "\n"), lambda line, i: ~F.array_contains("dropped", i)), "\n")
    new = joined.withColumn("text", F.when(F.col("dropped").isNull(), F.col("text")).otherwise(text)).where("dropped is null or text rlike '\\\\S'")
    if "n_chars" in docs.columns:
        new = new.withColumn("n_chars", F.when(F.col("dropped").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))
    return new.select(*docs.columns)
