"""N-gram Jaccard self-join of documents with Bayesian candidate pruning."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .families import classes, posterior_floors
from .scratch import hub_join, lean, settle
from .shingles import signer, word_shingles


def ngram_join(docs: DataFrame, *, words: int = 5, threshold: float = 0.8, tolerance: float = 1e-5, hashes: int = 64, rows: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Classes of documents whose sets of word n-grams have a Jaccard similarity of threshold or more.

    Returns a row per document: doc_id, class_id (the least doc_id of its class), n_links (different
    texts that this text is linked to) and n_copies (rows with exactly this text). Equal texts are one
    member of a class and aren't expanded into pairs.

    Method: texts in a bucket of `rows` MinHash values are candidates; their signatures are compared 16
    hashes at a time, and a pair is dropped when the posterior probability of reaching threshold falls
    below tolerance; the rest are verified on exact n-gram sets (as 64-bit hashes), block against block.
    A pair at exactly threshold shares no bucket with a chance of (1 - threshold ** rows) ** (hashes / rows),
    0.0002 here, and is compared even then if other texts connect it.

    Nulls, empty texts and texts without a word: no links, a class of equal texts. Texts of 1 to words - 1
    words are one n-gram. Very long texts are taken whole. A null doc_id gets a row; it isn't a class_id unless all
    of the class have none. Repeated rows: a row each. Other columns are ignored. Empty table: no rows.
    Texts are told apart by a 64-bit hash: two different ones collide with a chance of n * n / 2 ** 65.
    """
    rows_of = docs.select(F.col(id_col).alias("doc_id"), _node(text_col))
    near = settle(_near(docs, words, threshold, tolerance, hashes, rows, text_col, True))
    nodes = settle(rows_of.groupBy("node").agg(F.min("doc_id").alias("least"), F.count("*").alias("n_copies")).join(near, "node", "left").withColumn("root", F.coalesce("root", "node")))
    least = nodes.groupBy("root").agg(F.min("least").alias("class_id"))
    nodes = hub_join(nodes, least, "root").select("node", "class_id", F.coalesce("links", F.lit(0)).alias("n_links"), "n_copies")
    return rows_of.join(nodes, "node").select("doc_id", "class_id", "n_links", "n_copies")


def _node(text_col: str) -> F.Column:
    return F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("node")


def _near(docs: DataFrame, words: int, threshold: float, tolerance: float, hashes: int, rows: int, text_col: str, counting: bool) -> DataFrame:
    """(node, root, links) of texts with a near text."""
    texts = docs.select(_node(text_col), F.col(text_col).alias("text"))
    shingle = partial(word_shingles, size=words)
    sigs = settle(texts.mapInArrow(lean(signer(shingle, hashes)), "node long, sig binary"))
    return classes(texts, sigs, shingle, hashes, rows, posterior_floors(threshold, tolerance, hashes, 16), threshold, counting=counting)


def near_classes(docs: DataFrame, *, words: int = 5, threshold: float = 0.8, tolerance: float = 1e-5, hashes: int = 64, rows: int = 4, text_col: str = "text") -> DataFrame:
    """(node, root): the class, by its least node, of each text that has a near one; node is the text's xxhash64 (a null text's that of an empty one).

    The classes of ngram_join, found without counting links, so that a large family isn't compared in pairs once it's connected.
    """
    return settle(_near(docs, words, threshold, tolerance, hashes, rows, text_col, False).select("node", "root"))


def drop_near_copies(docs: DataFrame, **parameters) -> DataFrame:
    """docs without all but one row of each class of near_classes(), equal texts being one class: that with the least doc_id, of equal ones that
    with the least hash of its text, of rows that agree in both the least by all columns.

    A row goes only if its own text is of the class, so that rows which repeat a doc_id with unlike texts all stay.
    Documents without a doc_id take no part and stay.
    """
    known = docs.where(F.col("doc_id").isNotNull())
    near = near_classes(known, **parameters)
    rows_of = known.select("doc_id", _node("text"))
    firsts = settle(rows_of.groupBy("node").agg(F.min("doc_id").alias("doc_id")).join(near, "node", "left").withColumn("root", F.coalesce("root", "node")))
    kept = firsts.groupBy("root").agg(F.min(F.struct("doc_id", "node")).alias("k")).select(F.col("k.doc_id").alias("_id"), F.col("k.node").alias("_node"))
    copies = rows_of.join(kept, (F.col("doc_id") == F.col("_id")) & (F.col("node") == F.col("_node"))).groupBy("_id", "_node").agg(F.count("*").alias("_n"))
    copies = settle(copies)
    met = (F.col("doc_id") == F.col("_id")) & (F.xxhash64(F.coalesce(F.col("text"), F.lit(""))) == F.col("_node"))
    one = known.join(copies.where("_n = 1").drop("_n"), met, "left_semi")
    more = known.join(copies.where("_n > 1").drop("_n"), met).groupBy("_id", "_node").agg(F.min(F.struct(*docs.columns)).alias("r")).select("r.*")
    return one.unionByName(more).unionByName(docs.where(F.col("doc_id").isNull()))
