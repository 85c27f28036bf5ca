"""A stated query set against all rows, block against block: each task holds one block of rows and one of queries."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def against(rows: DataFrame, queries: DataFrame, key: Column, run: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame], schema: str, row_block: int, query_block: int) -> DataFrame:
    """run(rows of a block, queries of a block) for each pair of blocks.

    key deals both tables into blocks of about row_block and query_block rows by its hash. A row goes to
    as many tasks as there are blocks of queries, a query to as many as there are blocks of rows;
    nothing is collected, and no pair of rows is made outside run.
    """
    n, m = (max(1, -(-df.count() // size)) for df, size in ((rows, row_block), (queries, query_block)))
    spread = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    left = rows.withColumn("rb", F.pmod(F.xxhash64(key), F.lit(n)).cast("int")).withColumn("qb", spread(m))
    right = queries.withColumn("qb", F.pmod(F.xxhash64(key), F.lit(m)).cast("int")).withColumn("rb", spread(n))
    right = right.select(*[F.col(c).alias(c) for c in right.columns])  # columns of its own, should both tables come from one
    return left.groupBy("rb", "qb").cogroup(right.groupBy("rb", "qb")).applyInPandas(run, schema)
