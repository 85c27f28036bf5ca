"""The registered queries of this subpackage: each applies an operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chat import chat_digests, format_chats
from .chroma import alignments, catalogue, fingerprints, members
from .forest import nearest
from .line_dedup import repeated_lines, text_hash
from .mixing import mix
from .ngram_join import near_classes, ngram_join
from .packing import pack
from .periods import periodic_runs, plant_repeats, run_digests
from .pieces import piece_digests
from .quality import quality_scores
from .repair import damage, repair, repair_digests
from .shards import kd_shards
from .warc import archive_index


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_chroma(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's UTF-8 bytes are the 8-bit samples of its media column, at 2,756 a second; every 50th document is aligned with all.

    Rows with a doc_id: each document, with its recording, and n_aligned if it's a query. Rows without: each alignment of a query's recording with a partner.
    """
    media = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("media_id"), F.col("text").cast("binary").alias("audio"))
    is_query = F.col("media_id") % 50 == 0
    known, recordings = catalogue(fingerprints(media, rate=2_756, frame=64), is_query)
    pairs = alignments(recordings)
    counts = pairs.groupBy("recording").agg(F.count("*").alias("n")).withColumn("is_query", F.lit(True))
    rows = members(known, recordings).withColumn("is_query", is_query).join(counts, ["recording", "is_query"], "left")
    rows = rows.withColumn("n_aligned", F.when(F.col("is_query"), F.coalesce("n", F.lit(0)))).drop("n", "is_query").withColumnRenamed("media_id", "doc_id")
    return rows.unionByName(pairs, allowMissingColumns=True)


def op2_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op3_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return piece_digests(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = archive_index(_table(spark, sf_dir, "pages"))
    return index.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "captured", "position")


def op5_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kd_shards(_table(spark, sf_dir, "documents"))


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join(_table(spark, sf_dir, "documents"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near copies (classes of the n-gram join) are one cluster, as equal texts are."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return pack(docs, classes=near_classes(docs))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    lost = repeated_lines(docs).withColumnRenamed("text_hash", "_hash")
    rows = docs.select("doc_id", text_hash().alias("_hash"), (F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n"), F.lit(""))) + 1).alias("n_lines"))
    return rows.join(lost, ["doc_id", "_hash"], "left").select("doc_id", "n_lines", F.coalesce(F.size("dropped"), F.lit(0)).alias("n_dropped"), "dropped")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = r"\### Assistant: </turn> ok"
    hard = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    return chat_digests(format_chats(turns.unionByName(hard)))


def op11_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_digests(periodic_runs(plant_repeats(_table(spark, sf_dir, "documents"))))


def op12_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_digests(repair(damage(_table(spark, sf_dir, "conversations"))))


def op13_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(_table(spark, sf_dir, "documents")).drop("source")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_chroma, op2_forest, op3_pieces, op4_warc, op5_kd_shards, op6_ngram_join, op7_packing, op8_line_dedup, op9_quality, op10_chat, op11_periods, op12_repair, op13_mixing)}

ORACLES: dict[str, str] = {
    "op10_chat": r"""
        WITH t AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
            UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
        c AS (
            SELECT conv_id, bool_or(contains(text, '### ') OR contains(text, '</turn>')) AS hard, count(*) AS n_turns,
                string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS said,
                coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS loss,
                sum(length(role) + length(text)) + 14 * count(*) AS raw_chars,
                sum(length(role) + length(replace(replace(replace(text, '\', '\b'), '###', '\h'), '</turn>', '\t'))) + 14 * count(*) AS escaped_chars
            FROM t GROUP BY conv_id)
        SELECT conv_id, n_turns, sha256(said) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256,
            CAST(CASE WHEN hard THEN escaped_chars + 15 ELSE raw_chars + 11 END AS BIGINT) AS formatted_chars
        FROM c""",
    "op13_mixing": r"""
        WITH d AS (
            SELECT doc_id, coalesce('0' || source, '1') AS key, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size,
                substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')), 1, 15) AS hash
            FROM documents),
        s AS (
            SELECT key, CAST(sum(size) AS DOUBLE) AS source_size, CASE (row_number() OVER (ORDER BY key) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight
            FROM d GROUP BY key),
        -- by the share of a unit of weight at which they are full; those before are full if that share is reached
        o AS (
            SELECT *, sum(source_size) OVER () AS total,
                coalesce(sum(3 * source_size) OVER w, 0) AS taken, sum(weight) OVER () - coalesce(sum(weight) OVER w, 0) AS left_weight
            FROM s WINDOW w AS (ORDER BY source_size / weight, key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
        f AS (SELECT *, weight * (total - taken) >= 3 * source_size * left_weight AS is_full FROM o),
        u AS (
            SELECT min(total) AS total, coalesce(sum(3 * source_size) FILTER (is_full), 0) AS taken, sum(weight) FILTER (NOT is_full) AS weight FROM f),
        t AS (
            SELECT key, source_size, CASE WHEN is_full THEN 3 * source_size ELSE f.weight * (u.total - u.taken) / u.weight END AS target FROM f, u),
        k AS (SELECT *, CASE WHEN source_size > 0 THEN least(floor(target / source_size), 3) ELSE 0 END AS times FROM t),
        h AS (SELECT key, hash, sum(size) AS size, sum(sum(size)) OVER (PARTITION BY key ORDER BY hash) AS upto FROM d WHERE size > 0 GROUP BY key, hash),
        i AS (
            SELECT h.key, h.hash, h.upto + h.upto - h.size <= 2 * (target - times * source_size) AND times < 3 AS more FROM h JOIN k USING (key))
        SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(source_size AS BIGINT) AS source_size, target,
            CAST(size * (times + CASE WHEN more THEN 1 ELSE 0 END) AS BIGINT) AS taken
        FROM d JOIN k USING (key) LEFT JOIN i USING (key, hash)""",
}
