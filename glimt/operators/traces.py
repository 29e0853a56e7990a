"""Spans and traces: lookup, search, facets, volumes, trace lists, trees, self time, critical path, correlation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from glimt.functions.buckets import bucket_index, bucket_label, fill
from glimt.functions.fields import quoted
from glimt.operators import forest
from glimt.operators import logs as log_ops

PAD_NANOS = 3_600_000_000_000
#: Spans of a trace that one task works on at most.
GIANT_SPANS = 200_000
SORTS = {
    "recent": [F.desc, "start_time_nanos"],
    "slowest": [F.desc_nulls_last, "duration_nanos"],
    "errors": [F.desc_nulls_last, "status_code"],
}


def get_trace(spans: DataFrame, trace_id: str, hint: tuple[int, int] | None = None) -> DataFrame:
    """All spans of one trace; a time hint, padded by an hour, lets the scan skip files."""
    where = F.col("trace_id") == trace_id
    if hint:
        where = where & F.col("start_time_nanos").between(hint[0] - PAD_NANOS, hint[1] + PAD_NANOS)
    return spans.where(where)


def search(spans: DataFrame, where: Column, sort: str = "recent", offset: int = 0, limit: int = 100) -> DataFrame:
    """Matching spans: newest, slowest, or errors first; ties by (start for errors,) span and trace id."""
    order, column = SORTS[sort]
    ties = [F.desc("start_time_nanos")] if sort == "errors" else []
    found = spans.where(where).orderBy(order(column), *ties, "span_id", "trace_id")
    return (found.offset(offset) if offset else found).limit(log_ops._limit(limit))


def count(spans: DataFrame, where: Column) -> DataFrame:
    return log_ops.count(spans, where)


def search_with_count(spans: DataFrame, where: Column, sort: str = "recent", limit: int = 100) -> DataFrame:
    total = count(spans, where).withColumn("_one", F.lit(1))
    return search(spans, where, sort, 0, limit).withColumn("_one", F.lit(1)).join(F.broadcast(total), "_one").drop("_one")  # one row of totals


def facet(spans: DataFrame, field: str, where: Column, limit: int = 10) -> DataFrame:
    return log_ops.facet(spans, "spans", field, where, limit)


def volume(spans: DataFrame, where: Column, start: int, end: int, n: int) -> DataFrame:
    """Counts by status in n buckets; no or odd status counts as unset."""
    code = F.col("status_code")
    rows = spans.where(where).withColumn("bucket", bucket_index(F.col("start_time_nanos"), start, end, n))
    counts = rows.groupBy("bucket").agg(F.count_if(code == 1).alias("ok"), F.count_if(code == 2).alias("error"), F.count_if(~F.coalesce(code.isin(1, 2), F.lit(False))).alias("unset"), F.count(F.lit(1)).alias("total"))
    names = ["ok", "error", "unset", "total"]
    return fill(counts, n, zero=names).select("bucket", bucket_label(F.col("bucket"), start, end, n).alias("start_nanos"), *names)


field_catalog = log_ops.field_catalog


def trace_list(spans: DataFrame, where: Column, start: int, end: int, sort: str = "recent", offset: int = 0, limit: int | None = None, root_attributes: Sequence[str] = (), cap: int | None = None) -> DataFrame:
    """Traces with a matching span, rolled up over all their spans (those up to an hour outside the window too).

    ``cap`` keeps the newest so many traces before the roll-up, for interactive use; without it none is left out.
    """
    matched = spans.where(where).groupBy("trace_id").agg(F.max("start_time_nanos").alias("_newest"))
    if cap is not None:
        matched = matched.orderBy(F.desc("_newest"), "trace_id").limit(cap)
    padded = spans.where(F.col("start_time_nanos").between(start - PAD_NANOS, end + PAD_NANOS))
    whole = padded.join(matched.select("trace_id"), "trace_id", "left_semi")
    wanted = [quoted(a) if a in spans.columns else F.col("attributes").getItem(a) for a in root_attributes]
    root = F.struct(quoted("service.name").alias("service"), F.col("name"), F.col("start_time_nanos").alias("start"), F.col("duration_nanos").alias("duration"), *(c.cast("string").alias(f"a{i}") for i, c in enumerate(wanted)))
    first = F.struct((F.col("parent_span_id").isNotNull()).alias("inner"), "start_time_nanos", "span_id")
    rolled = whole.groupBy("trace_id").agg(
        F.count(F.lit(1)).alias("span_count"), F.count_if(F.col("status_code") == 2).alias("error_count"),
        F.array_sort(F.collect_set(quoted("service.name"))).alias("services"), F.min_by(root, first).alias("_root"),
        F.min("start_time_nanos").alias("_from"), F.max("end_time_nanos").alias("_to"))
    out = rolled.select(
        "trace_id", "span_count", "error_count", "services", F.col("_root.service").alias("root_service"), F.col("_root.name").alias("root_name"), F.col("_root.start").alias("start_nanos"),
        F.coalesce(F.col("_root.duration"), F.greatest(F.col("_to") - F.col("_from"), F.lit(0))).alias("duration_nanos"), *(F.col(f"_root.a{i}").alias(a) for i, a in enumerate(root_attributes)))
    first_key = {"recent": [], "slowest": [F.desc_nulls_last("duration_nanos")], "errors": [F.desc("error_count")]}[sort]
    if limit is not None or offset:
        out = out.orderBy(*first_key, F.desc("start_nanos"), "trace_id")
        out = out.offset(offset) if offset else out
        out = out.limit(limit) if limit is not None else out
    return out


def matched_traces(spans: DataFrame, where: Column) -> DataFrame:
    return spans.where(where).agg(F.count_distinct("trace_id").alias("matched_count"))


def span_end() -> Column:
    """The end of a span, by its duration where it is missing, and never before its start."""
    return F.greatest(F.col("start_time_nanos"), F.coalesce("end_time_nanos", F.col("start_time_nanos") + F.coalesce("duration_nanos", F.lit(0))))


def trace_tree(spans: DataFrame, giant: int = GIANT_SPANS) -> DataFrame:
    """Per span: pre-order position, depth, offset from the trace's start, clock skew, error in its subtree, on the critical path.

    Traces are worked on whole and many at once, in parallel; those of more than ``giant`` spans are spread over all tasks instead.
    """
    rows = spans.select("trace_id", "span_id", "parent_span_id", F.col("start_time_nanos").alias("start"), span_end().alias("end"), F.coalesce("status_code", F.lit(0)).alias("status_code"))
    whole = lambda x: x.repartition("trace_id").sortWithinPartitions("trace_id").mapInArrow(forest.forests, forest.SCHEMA)
    counted, seen = rows.groupBy("trace_id").agg(F.count(F.lit(1)).alias("n")), Observation()
    large = (F.col("n") > giant) & F.col("trace_id").isNotNull()  # spans without a trace id meet no giant
    found = counted.observe(seen, F.count_if(~large).alias("small")).where(large).select("trace_id")
    if not (ids := found.collect()):  # at most a row for each ``giant`` spans, as in the broadcast that follows
        return whole(rows)
    giants = F.broadcast(rows.sparkSession.createDataFrame(ids, found.schema))
    spread = forest.giant_forest(rows.join(giants, "trace_id", "left_semi"))
    return whole(rows.join(giants, "trace_id", "left_anti")).unionByName(spread) if seen.get["small"] else spread


def critical_path(spans: DataFrame) -> DataFrame:
    """From the last-ending root always to the last-ending child."""
    return trace_tree(spans).where("critical").select("trace_id", "span_id", "depth")


def self_time(spans: DataFrame) -> DataFrame:
    """Per span: duration less the union of its children's intervals, cut to its own."""
    rows = spans.select("trace_id", "span_id", "parent_span_id", quoted("service.name").alias("service"), F.col("start_time_nanos").alias("start"), span_end().alias("end"))
    child = rows.where(F.col("parent_span_id").isNotNull() & (F.col("parent_span_id") != F.col("span_id"))).select("trace_id", F.col("parent_span_id").alias("span_id"), F.col("start").alias("c_start"), F.col("end").alias("c_end"), F.col("span_id").alias("c_id"))
    both = child.join(rows.select("trace_id", "span_id", "start", "end"), ["trace_id", "span_id"])
    both = both.select("trace_id", "span_id", "c_id", F.greatest("c_start", "start").alias("s"), F.least("c_end", "end").alias("e")).where("e > s")
    before = Window.partitionBy("trace_id", "span_id").orderBy("s", "e", "c_id").rowsBetween(Window.unboundedPreceding, -1)
    reached = F.coalesce(F.max("e").over(before), F.col("s"))
    covered = both.withColumn("covered", F.greatest(F.lit(0), F.col("e") - F.greatest("s", reached))).groupBy("trace_id", "span_id").agg(F.sum("covered").alias("covered"))
    out = rows.join(covered, ["trace_id", "span_id"], "left")
    return out.select("trace_id", "span_id", "service", F.greatest(F.col("end") - F.col("start") - F.coalesce("covered", F.lit(0)), F.lit(0)).alias("self_nanos"))


def self_time_by_service(spans: DataFrame) -> DataFrame:
    return self_time(spans).groupBy("service").agg(F.sum("self_nanos").alias("self_nanos"), F.count(F.lit(1)).alias("spans"))


def logs_of_spans(logs: DataFrame, spans: DataFrame, by_span: bool = True) -> DataFrame:
    """Logs of the selected spans (by trace and span id) or of their traces; the optimizer broadcasts a small selection."""
    keys = ["trace_id", "span_id"] if by_span else ["trace_id"]
    return logs.join(spans.select(*keys).distinct(), keys, "left_semi")


def traces_of_logs(spans: DataFrame, logs: DataFrame) -> DataFrame:
    """All spans of the traces that the selected logs name."""
    return spans.join(logs.where("trace_id is not null").select("trace_id").distinct(), "trace_id", "left_semi")


def of_service(df: DataFrame, service: str) -> DataFrame:
    return df.where(quoted("service.name") == service)
