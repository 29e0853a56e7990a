"""Stored sketches for each step of time and key, merged for any window: percentiles over long ranges without a span read again.

A rollup row holds counts, Apdex bands and a KLL sketch of the values. Sketches merge, so a month is the merge of its minutes, and a
coarser rollup is the merge of a finer one. The rank of a merged quantile is off by about ``rank_error(k)`` of all rows at most.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glimt.functions.buckets import bucket_index, bucket_label, fill
from glimt.functions.fields import quoted, resolve
from glimt.operators.apm import with_threshold

MINUTE_NANOS = 60_000_000_000
#: Size of a sketch; larger is more exact.
SIZE = 400
POINTS = {"p50": 0.5, "p90": 0.9, "p99": 0.99}
COUNTS = ("count", "errors", "satisfied", "tolerating", "frustrated")


def rank_error(k: int = SIZE) -> float:
    """How far the rank of a quantile may be off, as a share of all rows, in all but one of a hundred sketches."""
    return 2.446 / k**0.9433


def step_of(time: str, step_nanos: int) -> Column:
    return (F.call_function("div", F.col(time), F.lit(step_nanos)) * step_nanos).alias("step")


def span_rollup(spans: DataFrame, step_nanos: int = MINUTE_NANOS, thresholds: DataFrame | None = None, size: int = SIZE) -> DataFrame:
    """(step, service, operation, tenant, counts, sketch of durations) of spans; what a sink or a stream appends to the rollup's table."""
    rows = with_threshold(spans, thresholds).withColumn("_tenant", resolve(spans, "spans", "tenant"))
    t, d = F.col("_t"), F.col("duration_nanos")
    bands = {"satisfied": d <= t, "tolerating": (d > t) & (d <= t * 4), "frustrated": d > t * 4}
    measures = [F.count(F.lit(1)).alias("count"), F.count_if(F.col("status_code") == 2).alias("errors"), *(F.count_if(F.coalesce(c, F.lit(False))).alias(n) for n, c in bands.items())]
    return rows.groupBy(step_of("start_time_nanos", step_nanos), "service", F.col("name").alias("operation"), F.col("_tenant").alias("tenant")).agg(*measures, F.kll_sketch_agg_bigint("duration_nanos", F.lit(size)).alias("sketch"))


def coarser(rollup: DataFrame, keys: Sequence[str], step_nanos: int) -> DataFrame:
    """A rollup of longer steps, or of fewer keys, from a finer one."""
    merged = rollup.groupBy(step_of("step", step_nanos), *keys).agg(*(F.sum(c).alias(c) for c in COUNTS), F.kll_merge_agg_bigint("sketch").alias("sketch"))
    return merged.select("step", *keys, *COUNTS, "sketch")


def _quantiles(sketch: str = "sketch") -> list[Column]:
    some = F.kll_sketch_get_n_bigint(sketch) > 0
    return [F.when(some, F.kll_sketch_get_quantile_bigint(sketch, F.lit(p))).alias(n) for n, p in POINTS.items()]


def _merged(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    found = rows.groupBy(*keys).agg(*(F.sum(c).alias(c) for c in COUNTS), F.kll_merge_agg_bigint("sketch").alias("sketch"))
    return found.select(*keys, *COUNTS[:2], *_quantiles(), *COUNTS[2:])


def within(rollup: DataFrame, start: int, end: int) -> DataFrame:
    """The steps that begin in [start, end)."""
    return rollup.where((F.col("step") >= start) & (F.col("step") < end))


def red_by_operation(rollup: DataFrame, start: int, end: int) -> DataFrame:
    """As ``apm.red_by_operation`` for whole steps, from the rollup alone."""
    return _merged(within(rollup, start, end).where("service is not null"), ["service", "operation"])


def red_by_service(rollup: DataFrame, start: int, end: int) -> DataFrame:
    return _merged(within(rollup, start, end).where("service is not null"), ["service", "tenant"])


def latency_percentiles(rollup: DataFrame, start: int, end: int, where: Column | None = None) -> DataFrame:
    rows = within(rollup, start, end)
    return _merged(rows if where is None else rows.where(where), []).select(*POINTS)


def red_series(rollup: DataFrame, start: int, end: int, n: int, by_service: bool = False) -> DataFrame:
    """As ``apm.red_series``, for buckets of whole steps."""
    keys = ["service"] if by_service else []
    rows = within(rollup, start, end).withColumn("bucket", bucket_index(F.col("step"), start, end, n))
    out = fill(_merged(rows, [*keys, "bucket"]), n, keys, list(COUNTS))
    return out.withColumn("start_nanos", bucket_label(F.col("bucket"), start, end, n, floored=True))


def vital_rollup(points: DataFrame, step_nanos: int = MINUTE_NANOS, size: int = SIZE) -> DataFrame:
    """(step, app, metric_name, route, count, sketch of values) of browser vitals."""
    route = F.col("attributes").getItem("browser.route")
    rows = points.where("value is not null")
    return rows.groupBy(step_of("timestamp_nanos", step_nanos), quoted("service.name").alias("app"), "metric_name", route.alias("route")).agg(F.count(F.lit(1)).alias("count"), F.kll_sketch_agg_double("value", F.lit(size)).alias("sketch"))


def vitals_summary(rollup: DataFrame, start: int, end: int, keys: Sequence[str] = ("app",)) -> DataFrame:
    """Per key and metric: how many values, and their 75th percentile."""
    found = within(rollup, start, end).groupBy(*keys, "metric_name").agg(F.sum("count").alias("count"), F.kll_merge_agg_double("sketch").alias("_sketch"))
    return found.select(*keys, "metric_name", "count", F.kll_sketch_get_quantile_double("_sketch", F.lit(0.75)).alias("p75"))
