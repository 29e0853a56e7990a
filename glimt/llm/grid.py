"""Vectors, and a stated set of query vectors held against all rows in blocks.

Rows and queries are dealt by hash into blocks and chunks of bounded size, and each block meets each chunk of its
group in one task. Nothing is broadcast or collected, and no key can be hot: a block is a share of a hash.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glimt.llm.common import quoted

#: Rows of a block: a 256th of all, but at least and at most so many. Queries that a task holds at once.
LEAST_ROWS, MOST_ROWS, QUERIES = 4096, 65_536, 16_384


def vectors(df: DataFrame, id_col: str, vector_col: str, *others: Column) -> DataFrame:
    """(id, vec, dim, norm, v1, v2: 128 bits of the vector, and ``others``) of rows with an id and a vector of finite numbers."""
    kind = df.select(quoted(vector_col)).dtypes[0][1]
    vec = quoted(vector_col) if kind in ("array<float>", "array<double>") else quoted(vector_col).cast("array<double>")
    rows = df.select(quoted(id_col).cast("long").alias("id"), vec.alias("vec"), *others)
    odd = F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = rows.where(F.col("id").isNotNull() & F.col("vec").isNotNull() & ~odd)
    square = F.aggregate("vec", F.lit(0.0), lambda total, x: total + x.cast("double") * x.cast("double"))
    return rows.withColumns({"dim": F.size("vec"), "norm": F.sqrt(square), "v1": F.xxhash64("vec"), "v2": F.xxhash64(F.lit("row"), "vec")})


def matrix(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    """A list column of one length as rows of doubles."""
    flat = [x.flatten().to_numpy(zero_copy_only=False) for x in column.chunks]
    return np.concatenate([*flat, np.zeros(0)]).astype(np.float64).reshape(len(column), dim)


def meet(rows: DataFrame, queries: DataFrame, keys: list[str], work: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    """``work(block, chunk)`` for every block of rows and every chunk of queries that agree in ``keys`` (columns of both, with v1)."""
    rows, queries = (x.select(*(F.col(c).alias(c) for c in x.columns)) for x in (rows, queries))  # both may come from one table
    n, m = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")), queries.groupBy(*keys).agg(F.count(F.lit(1)).alias("_m"))
    size = F.least(F.greatest(F.col("_n") / 256, F.lit(LEAST_ROWS)), F.lit(MOST_ROWS))
    sizes = n.join(m, keys).select(*keys, F.ceil(F.col("_n") / size).alias("_blocks"), F.ceil(F.col("_m") / QUERIES).alias("_chunks"))
    cells = sizes.agg(F.sum(F.col("_blocks") * F.col("_chunks"))).first()[0] or 1
    parts = int(min(4 * cells, 20_000))  # some cells share a part, so more parts than cells
    draw = lambda what, of: F.pmod(F.xxhash64(F.lit(what), "id", "v1"), F.col(of))
    every = lambda of: F.explode(F.sequence(F.lit(0).cast("long"), F.col(of) - 1))
    cell = [*keys, "_block", "_chunk"]
    left = rows.join(sizes, keys).withColumn("_block", draw("block", "_blocks")).withColumn("_chunk", every("_chunks")).drop("_blocks", "_chunks")
    right = queries.join(sizes, keys).withColumn("_chunk", draw("chunk", "_chunks")).withColumn("_block", every("_blocks")).drop("_blocks", "_chunks")
    left, right = (x.repartition(parts, *cell).groupBy(*cell) for x in (left, right))
    return left.cogroup(right).applyInArrow(work, schema)
