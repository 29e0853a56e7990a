"""Logs: search, counts, facets, volumes, field catalog and rendering."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glimt.functions.buckets import bucket_index, bucket_label, fill
from glimt.functions.fields import PROMOTED, quoted, resolve

MOST_ROWS = 1000


def _limit(limit: int, most: int = MOST_ROWS) -> int:
    if not 0 <= limit <= most:
        raise ValueError(f"limit must be between 0 and {most}")
    return limit


def search(logs: DataFrame, where: Column, limit: int = 100, tiebreak: Sequence[str] = ("trace_id", "span_id", "body")) -> DataFrame:
    """The newest rows that match."""
    return logs.where(where).orderBy(F.desc("timestamp_nanos"), *tiebreak).limit(_limit(limit))


def count(logs: DataFrame, where: Column) -> DataFrame:
    return logs.where(where).agg(F.count(F.lit(1)).alias("matched_count"))


def search_with_count(logs: DataFrame, where: Column, limit: int = 100) -> DataFrame:
    """``search`` with the unlimited ``matched_count`` on each row."""
    total = count(logs, where).withColumn("_one", F.lit(1))
    return search(logs, where, limit).withColumn("_one", F.lit(1)).join(F.broadcast(total), "_one").drop("_one")  # one row of totals


def facet(df: DataFrame, signal: str, field: str, where: Column, limit: int = 10) -> DataFrame:
    """Most frequent values (null left out): value, count, and whether there are more than ``limit``."""
    value = resolve(df, signal, field).cast("string")
    counted = df.where(where).select(value.alias("value")).where("value is not null").groupBy("value").agg(F.count(F.lit(1)).alias("count"))
    top = counted.orderBy(F.desc("count"), "value").limit(_limit(limit) + 1)
    numbered = top.agg(F.array_sort(F.collect_list(F.struct((-F.col("count")).alias("n"), "value"))).alias("rows"))  # at most limit + 1 rows
    shown = numbered.select(F.explode(F.slice("rows", 1, limit) if limit else F.array().cast("array<struct<n:bigint,value:string>>")).alias("r"), (F.size("rows") > limit).alias("capped"))
    return shown.select("r.value", (-F.col("r.n")).alias("count"), "capped")


def volume(logs: DataFrame, where: Column, start: int, end: int, n: int) -> DataFrame:
    """Counts by severity in n equal buckets, zero where nothing fell; no or odd severity counts as info."""
    severity = F.col("severity_number")
    ranges = {"debug": severity.between(1, 8), "warn": severity.between(13, 16), "error": severity.between(17, 20), "fatal": severity.between(21, 24)}
    other = ~F.coalesce(severity.between(1, 8) | severity.between(13, 24), F.lit(False))
    rows = logs.where(where).withColumn("bucket", bucket_index(F.col("timestamp_nanos"), start, end, n))
    counts = rows.groupBy("bucket").agg(*(F.count_if(c).alias(k) for k, c in ranges.items()), F.count_if(other).alias("info"), F.count(F.lit(1)).alias("total"))
    names = ["debug", "info", "warn", "error", "fatal", "total"]
    filled = fill(counts, n, zero=names)
    return filled.select("bucket", bucket_label(F.col("bucket"), start, end, n).alias("start_nanos"), *names)


def field_catalog(df: DataFrame, where: Column, promoted: Sequence[str] = PROMOTED) -> DataFrame:
    """Every field name with its kind: fixed, promoted, or attribute (keys of the maps of matching rows)."""
    known = [(c, "promoted" if c in promoted else "fixed") for c in df.columns if c != "attributes"]
    fixed = df.sparkSession.createDataFrame(known, "name string, kind string")
    keys = df.where(where).select(F.explode(F.map_keys("attributes")).alias("name")).distinct().withColumn("kind", F.lit("attribute"))
    return fixed.unionByName(keys)


def services(df: DataFrame) -> DataFrame:
    return df.select(quoted("service.name").alias("service")).where("service is not null").distinct().orderBy("service")


def severity_key(number: Column) -> Column:
    """What a row shows; absent severity is info."""
    return F.when(F.coalesce(number, F.lit(0)) <= 0, "info").when(number <= 8, "debug").when(number <= 12, "info").when(number <= 16, "warn").when(number <= 20, "error").otherwise("fatal")


def render(logs: DataFrame, promoted: Sequence[str] = PROMOTED) -> DataFrame:
    """Rows as shown: severity key, and one JSON object of attributes with the promoted ones that are set."""
    own = [p for p in promoted if p in logs.columns]
    top = F.map_filter(F.create_map(*(x for p in own for x in (F.lit(p), quoted(p)))), lambda k, v: v.isNotNull()) if own else F.create_map().cast("map<string,string>")
    rest = F.map_filter(F.coalesce("attributes", F.create_map().cast("map<string,string>")), lambda k, v: ~k.isin(own))
    merged = F.map_from_entries(F.array_sort(F.map_entries(F.map_concat(top, rest))))
    return logs.select("timestamp_nanos", severity_key(F.col("severity_number")).alias("severity"), "body", "trace_id", "span_id", F.to_json(merged).alias("attributes_json"))
