"""Time buckets: index, label, and rows for buckets that nothing fell into."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST_BUCKETS = 3000


def bucket_index(ts: Column, start: int, end: int, n: int) -> Column:
    """(ts - start) div max(1, (end - start) div n), at most n - 1."""
    width = max(1, (end - start) // n)
    return F.least(F.call_function("div", ts - F.lit(start), F.lit(width)), F.lit(n - 1)).cast("int")


def bucket_label(index: Column, start: int, end: int, n: int, floored: bool = False) -> Column:
    """Where bucket ``index`` begins: start + (end - start) * i / n; ``floored``: steps of the whole bucket width."""
    if floored:
        return (F.lit(start) + index.cast("long") * F.lit(max(1, (end - start) // n))).cast("long")
    whole, rest = divmod(end - start, n)
    i = index.cast("long")
    return (F.lit(start) + i * F.lit(whole) + F.floor(i * F.lit(rest) / F.lit(n))).cast("long")


def bucket_count(start: int, end: int, step_nanos: int | None = None) -> int:
    """ceil(span / max(step, 1 s)) from 1 to MOST_BUCKETS; 200 without a step."""
    if not step_nanos:
        return 200
    return max(1, min(MOST_BUCKETS, -(-(end - start) // max(step_nanos, 1_000_000_000))))


def every_bucket(df: DataFrame, n: int) -> DataFrame:
    return df.sparkSession.range(n).select(F.col("id").cast("int").alias("bucket"))


def fill(counts: DataFrame, n: int, keys: Sequence[str] = (), zero: Sequence[str] = ()) -> DataFrame:
    """A row for each of n buckets (for each group of ``keys`` seen), zeros in the columns ``zero``; others stay null."""
    if keys:
        # one pass: what a group has, and a row of nulls for each bucket that it lacks
        rest = [c for c in counts.columns if c not in (*keys, "bucket")]
        kinds = {f.name: f.dataType for f in counts.schema}
        listed = counts.select(*(F.col(f"`{k}`") for k in keys), F.when(F.col("bucket").between(0, n - 1), F.struct(F.col("bucket").cast("int").alias("bucket"), *(F.col(f"`{c}`") for c in rest))).alias("_cell"))
        listed = listed.groupBy(*(F.col(f"`{k}`") for k in keys)).agg(F.collect_list("_cell").alias("_cells"))
        empty = lambda b: F.struct(b.alias("bucket"), *(F.lit(None).cast(kinds[c]).alias(c) for c in rest))
        lacking = F.array_except(F.sequence(F.lit(0), F.lit(n - 1)), F.transform("_cells", lambda x: x["bucket"]))
        out = listed.select(*(F.col(f"`{k}`") for k in keys), F.explode(F.concat("_cells", F.transform(lacking, empty))).alias("_cell"))
        out = out.select(*(F.col(f"`{k}`") for k in keys), "_cell.bucket", *(F.col(f"_cell.`{c}`").alias(c) for c in rest))
    else:
        out = every_bucket(counts, n).join(counts, "bucket", "left")
    return out.fillna(0, list(zero)) if zero else out
