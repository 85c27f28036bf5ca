"""Approximate nearest neighbours by a hash-prefix forest (LSH Forest)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .blocks import against

#: A hash string: CHARS characters of 5 bits, then one bit for each of the first SIGNS coordinates.
CHARS, SIGNS = 4, 24
BITS = 5 * CHARS + SIGNS


class Forest:
    """Sorted arrays of 44-bit hash strings, one for each tree, over the rows of one block.

    Rows are scaled to the longest, and get a coordinate that makes them of length 1, so that the largest inner product is the least angle.
    A tree turns vectors at random. A character is the largest by size of 16 turned coordinates, with its sign: of vectors that have little in common it
    tells 32 kinds apart, yet near ones agree in it more often than in five sides of hyperplanes. The bits are signs of coordinates.
    """

    def __init__(self, vectors: np.ndarray, trees: int, seed: int) -> None:
        rng, d = np.random.default_rng(seed), vectors.shape[1] + 1
        n = 16 * CHARS
        self.turns = [np.concatenate([np.linalg.qr(rng.standard_normal((d, d)))[0] for _ in range(-(-n // d))])[:n].astype(np.float32) for _ in range(trees)]
        units, norms = _units(vectors)
        share = norms / norms.max() if len(norms) else norms
        rows = _column(units * share[:, None], np.sqrt(np.maximum(0, 1 - share**2)))
        self.order, self.keys = [], []
        for t in range(trees):
            keys = self.hashed(rows, t)
            order = np.argsort(keys)
            self.order.append(order.astype(np.int32))
            self.keys.append(keys[order])

    def hashed(self, columns: np.ndarray, tree: int) -> np.ndarray:
        turned = self.turns[tree] @ columns
        parts = turned.reshape(CHARS, 16, -1)
        most, code = np.full((CHARS, parts.shape[2]), -1, np.float32), np.zeros((CHARS, parts.shape[2]), np.uint8)
        for j in range(16):
            size = np.abs(parts[:, j])
            code = np.where(size > most, (parts[:, j] > 0) + np.uint8(2 * j), code)
            np.maximum(most, size, out=most)
        key = np.zeros(parts.shape[2], np.uint64)
        for c in code:
            key = (key << np.uint64(5)) | c
        for byte in np.packbits(turned[:SIGNS] > 0, axis=0):
            key = (key << np.uint64(8)) | byte
        return key

    def candidates(self, queries: np.ndarray, least: int) -> Iterator[list[np.ndarray]]:
        """For each query its rows, by tree.

        Descent: in each tree the longest prefix of the query's string that any row has. Ascent, in all trees at once, from
        the longest of these: at each length a tree gives the run of rows with that prefix; it ends at the greatest length
        at which the runs hold `least` rows in all, or at length 0, which is every row. Runs only grow on the way up, so that length is bisected.
        """
        columns = _column(_units(queries)[0], np.zeros(len(queries)))
        hashes = [self.hashed(columns, t) for t in range(len(self.keys))]
        high = np.zeros(len(queries), np.int64)
        for h, keys in zip(hashes, self.keys, strict=True):
            at = np.searchsorted(keys, h)
            for near in (keys[np.minimum(at, len(keys) - 1)], keys[np.maximum(at - 1, 0)]):
                apart = (h ^ near).astype(np.float64)
                high = np.maximum(high, BITS - np.where(apart > 0, np.floor(np.log2(np.maximum(apart, 1))) + 1, 0).astype(np.int64))

        def runs(length: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
            rest = (np.uint64(1) << (BITS - length).astype(np.uint64)) - np.uint64(1)
            return [(np.searchsorted(k, h & ~rest), np.searchsorted(k, h | rest, side="right")) for h, k in zip(hashes, self.keys, strict=True)]

        low = np.zeros(len(queries), np.int64)  # a length that will do
        while (low < high).any():
            middle = (low + high + 1) // 2
            full = sum(hi - lo for lo, hi in runs(middle)) >= least
            low, high = np.where(full, middle, low), np.where(full, high, middle - 1)
        found = runs(low)
        for i in range(len(queries)):
            yield [o[lo[i] : hi[i]] for o, (lo, hi) in zip(self.order, found, strict=True)]


def _units(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of length 1, and their lengths before; without overflow."""
    most = np.abs(vectors).max(1, keepdims=True, initial=0)
    small = vectors / np.maximum(most, 5e-324)
    norms = np.sqrt((small**2).sum(1))
    return small / np.maximum(norms, 1e-300)[:, None], norms * most[:, 0]


def _column(vectors: np.ndarray, last: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(np.column_stack([vectors, last]).T, np.float32)


def _usable(vector: str) -> Column:
    """Not null, nothing null or non-finite in it, not all zero."""
    v = F.col(vector)
    big = F.transform(v, lambda x: F.abs(x.cast("double")))
    return v.isNotNull() & (F.size(v) > 0) & ~F.exists(big, lambda x: x.isNull() | F.isnan(x) | (x == float("inf"))) & F.exists(big, lambda x: x > 0)


def nearest(vectors: DataFrame, is_query: Column, *, k: int = 20, trees: int = 192, share: float = 0.1, row_block: int = 65_536, query_block: int = 4096, seed: int = 11, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for each row that is_query holds for, its k nearest other rows found, by inner product.

    Rows are dealt by hash into blocks; a task builds the forest of its block and searches it for a block of queries. In each
    block a query looks at runs of at least share times the block's rows in all trees together, before rows that
    several trees give are taken once; scores of these are exact, in double precision. Ties go to the smaller vec_id.

    Vectors that are null, empty, zero or hold a null or non-finite component take no part, neither do rows without an id or of another
    dimension than most rows have. Rows that repeat a vec_id are candidates of their own for others, never for each
    other; a repeated query is one query (its greatest vector). Other columns are ignored. Empty table: no rows.
    """
    own = vectors.where(F.col(id_col).isNotNull() & _usable(vector_col)).select(F.col(id_col).cast("long").alias("vec_id"), F.transform(vector_col, lambda x: x.cast("double")).alias("v"), is_query.alias("asks"))
    common = own.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").first()
    own = own.where(F.size("v") == (common.d if common else 0))
    asked = own.where("asks").groupBy("vec_id").agg(F.max("v").alias("v"))

    def search(rows: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(rows) and len(queries):
            x, q = np.stack(rows["v"].to_numpy()), np.stack(queries["v"].to_numpy())
            ids, asking = rows["vec_id"].to_numpy(), queries["vec_id"].to_numpy()
            forest = Forest(x, trees, seed)
            least = max(int(np.ceil(share * len(x))), (k + 1) * trees)  # the second: of k + 1 rows at least, as each stands once in a tree
            for i, runs in enumerate(forest.candidates(q, least)):
                hit = np.zeros(len(x), bool)
                for r in runs:
                    hit[r] = True
                at = np.flatnonzero(hit & (ids != asking[i]))
                score = x[at] @ q[i]
                if len(at) > k:
                    edge = np.partition(score, len(at) - k)[len(at) - k]
                    at, score = at[score >= edge], score[score >= edge]
                best = np.lexsort((ids[at], -score))[:k]
                found.append(pd.DataFrame({"query_id": asking[i], "vec_id": ids[at[best]], "score": (x[at[best]] * q[i]).sum(1)}))
        return pd.concat(found) if found else pd.DataFrame({"query_id": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})

    found = against(own.drop("asks"), asked, F.col("vec_id"), search, "query_id long, vec_id long, score double", row_block, query_block)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
