"""Joins and running sums whose hot keys are work for many tasks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glimt.functions.storage import kept

#: Rows of one key that make it hot, and the most hot keys that are sent to all tasks.
HOT_ROWS, MOST_HOT = 100_000, 100_000
#: Rows of one series that make it long.
LONG_ROWS = 20_000


def join_hot(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "left", hot_rows: int = HOT_ROWS, counted: DataFrame | None = None, mark: str | None = None) -> DataFrame:
    """``left`` joined with ``right``, which has one row a key. No key of ``left`` is gathered in one task.

    Keys with more than ``hot_rows`` rows, at most MOST_HOT of them, meet their rows of ``right`` by a broadcast; the rest by a shuffle.
    ``counted``, where it is at hand, holds the keys of ``left`` with at least their ``_rows``; the column ``mark``, if wanted, tells whether a key was hot.
    """
    keys = list(on)
    hot = (left.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows")) if counted is None else counted).where(F.col("_rows") > hot_rows).select(*keys).limit(MOST_HOT)
    marks = lambda x, was: x.withColumn(mark, F.lit(was)) if mark else x
    if hot.isEmpty():
        return marks(left.join(right, keys, how), False)
    hot = kept(hot.join(right, keys, "left").withColumn("_hot", F.lit(True)), "hot")  # a row a hot key
    marked = left.join(F.broadcast(hot.select(*keys, "_hot")), keys, "left")  # at most MOST_HOT rows
    cold = marked.where("_hot is null").drop("_hot").join(right, keys, how)
    met = marked.where("_hot").drop("_hot").join(F.broadcast(hot.drop("_hot")), keys, "left")
    if how == "inner":
        met = met.join(F.broadcast(hot.join(right.select(*keys), keys, "left_semi").select(*keys)), keys, "left_semi")
    return marks(cold, False).unionByName(marks(met, True))


def running_sum(rows: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, name: str, parts: int | None = None) -> DataFrame:
    """``name``: the sum of ``value`` over the rows before in the order of their key, none of which need fit into one task.

    Rows are dealt by ranges of key and order; each range is summed by itself, and a small table carries its total into the next.
    """
    cut = rows.repartitionByRange(parts, *keys, *order) if parts else rows.repartitionByRange(*keys, *order)
    dealt = kept(cut.withColumn("_part", F.spark_partition_id()), "ranges")
    inside = Window.partitionBy(*keys, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    own = dealt.withColumn("_inside", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = dealt.groupBy(*keys, "_part").agg(F.sum(value).alias("_total"))
    totals = totals.select(*keys, "_part", F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_before"))  # a row a range
    return own.join(totals, [*keys, "_part"]).withColumn(name, F.col("_inside") + F.col("_before")).drop("_inside", "_before", "_part")


def previous(rows: DataFrame, keys: Sequence[Column], order: Sequence[str], held: Sequence[str], chunk: Column, counted: DataFrame | None = None, long_rows: int | None = None) -> DataFrame:
    """``_before``: the columns ``held`` of the row before in the same series (null at its first), by ``order``. Null keys are equal.

    A count tells series of more than ``long_rows`` rows; ``counted`` is what it counts, where rows that cost less hold all series (and perhaps more
    rows of them). These are cut into chunks, which ``chunk`` numbers in the order of the rows; all others are one window each.
    """
    series = F.struct(*(k.alias(f"k{i}") for i, k in enumerate(keys))) if keys else F.struct(F.lit(0).alias("k0"))
    hot = (rows if counted is None else counted).groupBy(F.xxhash64(series).alias("_hash")).agg(F.count(F.lit(1)).alias("_rows"))
    hot = hot.where(F.col("_rows") > (LONG_ROWS if long_rows is None else long_rows)).select("_hash").limit(MOST_HOT)
    dealt = rows.withColumn("_series", series)
    if hot.isEmpty():
        return _before(dealt, order, held).drop("_series")
    hot = F.broadcast(kept(hot, "hot"))  # at most MOST_HOT rows
    dealt = dealt.withColumn("_hash", F.xxhash64("_series"))
    short = _before(dealt.join(hot, "_hash", "left_anti").drop("_hash"), order, held)
    long = _before_by_chunks(dealt.join(hot, "_hash", "left_semi").drop("_hash").withColumn("_chunk", chunk), order, held)
    return short.unionByName(long).drop("_series")


def _before(dealt: DataFrame, order: Sequence[str], held: Sequence[str]) -> DataFrame:
    inside = Window.partitionBy("_series").orderBy(*(F.asc_nulls_first(x) for x in order))
    return dealt.withColumn("_before", F.lag(F.struct(*held)).over(inside))


def _before_by_chunks(dealt: DataFrame, order: Sequence[str], held: Sequence[str]) -> DataFrame:
    """The last row of each chunk is carried to the next by a table with a row a chunk, so no window is larger than a chunk, however long a series is."""
    dealt = dealt.repartition("_series", "_chunk")  # both branches read this exchange
    inside = Window.partitionBy("_series", "_chunk").orderBy(*(F.asc_nulls_first(x) for x in order))
    state = F.struct(*held)
    marked = dealt.withColumns({"_lag": F.lag(state).over(inside), "_first": F.row_number().over(inside) == 1})
    last = dealt.groupBy("_series", "_chunk").agg(F.max_by(state, F.struct(*order)).alias("_last"))
    carried = last.select("_series", "_chunk", F.lag("_last").over(Window.partitionBy("_series").orderBy("_chunk")).alias("_carried"))  # a row a chunk
    joined = marked.join(carried, ["_series", "_chunk"], "left")
    return joined.withColumn("_before", F.when(F.col("_first"), F.col("_carried")).otherwise(F.col("_lag"))).drop("_lag", "_first", "_carried", "_chunk")
