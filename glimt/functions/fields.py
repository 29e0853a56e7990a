"""Schemas of the three signals and how a field's name is resolved to a column."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

PROMOTED = ("service.name", "host.name", "tenant")
ATTRIBUTES = T.MapType(T.StringType(), T.StringType(), True)
ALIASES = {
    "logs": {"service": "service.name", "severity": "severity_text", "scope": "scope_name"},
    "spans": {"service": "service.name", "operation": "name", "scope": "scope_name", "duration": "duration_nanos"},
    "metrics": {"service": "service.name", "name": "metric_name", "scope": "scope_name"},
}
_TYPES = {"s": T.StringType(), "l": T.LongType(), "i": T.IntegerType(), "d": T.DoubleType(), "b": T.BooleanType()}


def _schema(fixed: str, promoted: Sequence[str], extra: Sequence[T.StructField] = ()) -> T.StructType:
    fields = [T.StructField(n.rstrip("!"), _TYPES[k], not n.endswith("!")) for n, k in (x.split(":") for x in fixed.split())]
    return T.StructType([*fields, *extra, *(T.StructField(p, T.StringType()) for p in promoted), T.StructField("attributes", ATTRIBUTES)])


def log_schema(promoted: Sequence[str] = PROMOTED) -> T.StructType:
    return _schema("timestamp_nanos!:l observed_nanos:l severity_number:i severity_text:s body:s trace_id:s span_id:s scope_name:s", promoted)


EVENTS = T.ArrayType(T.StructType([T.StructField("name", T.StringType()), T.StructField("time_unix_nano", T.LongType()), T.StructField("attributes", ATTRIBUTES)]))
LINKS = T.ArrayType(T.StructType([T.StructField("trace_id", T.StringType()), T.StructField("span_id", T.StringType()), T.StructField("attributes", ATTRIBUTES)]))


def span_schema(promoted: Sequence[str] = PROMOTED) -> T.StructType:
    extra = [T.StructField("events", EVENTS), T.StructField("links", LINKS)]
    return _schema("trace_id!:s span_id!:s parent_span_id:s name:s kind:i kind_text:s start_time_nanos!:l end_time_nanos:l duration_nanos:l status_code:i status_text:s status_message:s scope_name:s", promoted, extra)


_LONG, _DOUBLE = T.LongType(), T.DoubleType()
_COUNTS, _BOUNDS = T.ArrayType(_LONG), T.ArrayType(_DOUBLE)


def _struct(**kinds: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in kinds.items()])


HISTOGRAM = _struct(count=_LONG, sum=_DOUBLE, bucket_counts=_COUNTS, explicit_bounds=_BOUNDS, min=_DOUBLE, max=_DOUBLE)
_SIDE = _struct(offset=T.IntegerType(), bucket_counts=_COUNTS)
EXP_HISTOGRAM = _struct(count=_LONG, sum=_DOUBLE, scale=T.IntegerType(), zero_count=_LONG, positive=_SIDE, negative=_SIDE, min=_DOUBLE, max=_DOUBLE)
SUMMARY = _struct(count=_LONG, sum=_DOUBLE, quantiles=T.ArrayType(_struct(quantile=_DOUBLE, value=_DOUBLE)))
GAUGE, SUM, HISTOGRAM_TYPE, EXP_HISTOGRAM_TYPE, SUMMARY_TYPE = range(5)
DELTA, CUMULATIVE = 1, 2


def metric_schema(promoted: Sequence[str] = PROMOTED) -> T.StructType:
    extra = [T.StructField("histogram", HISTOGRAM), T.StructField("exp_histogram", EXP_HISTOGRAM), T.StructField("summary", SUMMARY)]
    return _schema("metric_name!:s metric_type!:i type_text:s temporality:i is_monotonic:b unit:s timestamp_nanos:l start_nanos:l scope_name:s value:d", promoted, extra)


def quoted(name: str) -> Column:
    """A top-level column, dots and all."""
    return F.col(f"`{name}`")


def resolve(df: DataFrame, signal: str, name: str) -> Column:
    """Alias, then a column of the table (fixed or promoted), then a key of the attribute map."""
    name = ALIASES[signal].get(name, name)
    if name in df.columns and name != "attributes":
        return quoted(name)
    return F.col("attributes").getItem(name) if "attributes" in df.columns else F.lit(None).cast("string")


def signal_time(signal: str) -> str:
    return "start_time_nanos" if signal == "spans" else "timestamp_nanos"
