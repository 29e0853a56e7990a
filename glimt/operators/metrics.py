"""Metric series, counters, catalog, labels and series statistics."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glimt.functions.buckets import bucket_index, bucket_label, fill
from glimt.functions.fields import ALIASES, CUMULATIVE, PROMOTED, SUM, quoted, resolve
from glimt.functions.spread import previous
from glimt.functions.terms import conjunction, metric_filter

GAUGE_AGGS = {"avg": F.avg, "min": F.min, "max": F.max, "sum": F.sum}
MOST_VALUES = 1000
#: A series is followed in chunks of so much time, each in a task of its own.
CHUNK_NANOS = 86_400_000_000_000


def default_aggregation(kind: Column, monotonic: Column) -> Column:
    """gauge avg, monotonic sum rate, other sum sum, histograms p99, summary median."""
    return F.when(kind == 0, "avg").when((kind == SUM) & F.coalesce(monotonic, F.lit(False)), "rate").when(kind == SUM, "sum").when(kind.isin(2, 3), "p99").otherwise("median")


def labelled(points: DataFrame, labels: Sequence[str]) -> DataFrame:
    """The points with each label as a column of its own name."""
    return points.select("*", *(resolve(points, "metrics", x).cast("string").alias(f"label.{x}") for x in labels))


def _keys(labels: Sequence[str]) -> list[Column]:
    return [quoted(f"label.{x}") for x in labels]


def _finish(values: DataFrame, labels: Sequence[str], start: int, end: int, n: int) -> DataFrame:
    """labels, bucket, t, v with a row for every bucket of each series seen; null where nothing was."""
    out = fill(values, n, [f"label.{x}" for x in labels])
    return out.select(*(quoted(f"label.{x}").alias(x) for x in labels), "bucket", bucket_label(F.col("bucket"), start, end, n).alias("t"), "v")


def with_increases(rows: DataFrame, keys: Sequence[Column], value: str = "value", chunk: int = CHUNK_NANOS, counted: DataFrame | None = None) -> DataFrame:
    """``_up``: what a cumulative counter grew by at each sample: 0 at the first, the new value after a reset (it fell, or its start moved on).

    ``_since``: the time of the sample before. Long series are cut into chunks of time, so that none is too long for a task;
    ``counted`` as in ``previous``.
    """
    at = F.call_function("div", F.col("timestamp_nanos"), F.lit(chunk))
    seen = previous(rows, keys, ["timestamp_nanos", "start_nanos", value], [value, "start_nanos", "timestamp_nanos"], at, counted)
    before = F.col("_before")
    reset = (F.col(value) < before[value]) | F.coalesce(F.col("start_nanos") > before["start_nanos"], F.lit(False))
    up = F.when(before.isNull(), F.lit(0.0)).when(reset, F.col(value)).otherwise(F.col(value) - before[value])
    return seen.withColumns({"_up": up, "_since": before["timestamp_nanos"]}).drop("_before")


def raw_series(points: DataFrame, leave_out: Sequence[str] = ()) -> list[Column]:
    """Columns that tell every raw series apart: the promoted attributes and the rest as text in order of keys."""
    rest = F.map_filter("attributes", lambda k, _: ~k.isin(list(leave_out))) if leave_out else F.col("attributes")
    return [*(quoted(p) for p in PROMOTED if p in points.columns and p not in leave_out), F.to_json(F.map_from_entries(F.array_sort(F.map_entries(rest))))]


def series(points: DataFrame, name: str, start: int, end: int, n: int, agg: str = "avg", labels: Sequence[str] = (), terms: Sequence[Column] = (), cumulative: bool | None = None, series_key: str = "attributes", chunk: int = CHUNK_NANOS) -> DataFrame:
    """A metric's bucketed series: avg, min, max, sum, count, last, or a sum's increase or rate.

    ``cumulative``: whether increase and rate follow a counter (by default what each point says). ``series_key``: `attributes` follows every
    raw series and adds up, so no window is larger than a series; `group` takes the rows of the labels as one series.
    """
    rows = labelled(points.where(metric_filter(name, start, end, terms)), labels).where("value is not null")
    rows = rows.withColumn("bucket", bucket_index(F.col("timestamp_nanos"), start, end, n))
    keys = _keys(labels)
    if agg in GAUGE_AGGS:
        value = GAUGE_AGGS[agg]("value")
    elif agg == "count":
        value = F.count(F.lit(1)).cast("double")
    elif agg == "last":
        value = F.max_by("value", F.struct("timestamp_nanos", "value"))
    elif agg in ("increase", "rate"):
        own = keys if series_key == "group" else [*keys, *raw_series(points)]
        counted = F.lit(cumulative) if cumulative is not None else F.coalesce(F.col("temporality") == CUMULATIVE, F.lit(False))
        rows = with_increases(rows.withColumn("_counted", counted), [*own, F.col("_counted")], chunk=chunk)
        rows = rows.withColumn("_up", F.when(F.col("_counted"), F.col("_up")).otherwise(F.col("value")))
        value = F.sum("_up") / F.lit((end - start) / n / 1e9 if agg == "rate" else 1.0)
    else:
        raise ValueError(f"unknown aggregation {agg}")
    return _finish(rows.groupBy(*keys, "bucket").agg(value.alias("v")), labels, start, end, n)


def as_json(points: DataFrame, labels: Sequence[str]) -> Column:
    """The labels of a point as a JSON object."""
    if not labels:
        return F.lit("{}")
    return F.to_json(F.struct(*(resolve(points, "metrics", x).cast("string").alias(x) for x in labels)))


_OF = {"avg": "_avg", "min": "_min", "max": "_max", "sum": "_sum", "count": "_count", "last": "_last", "increase": "_grown", "rate": "_grown"}


def shared(points: DataFrame, specs: Mapping[str, Mapping], pack: Callable[[DataFrame, Sequence[str]], Column] = as_json) -> DataFrame:
    """(query, labels, bucket, v) of many series in one scan: each point is matched once to the specs that it feeds, and one aggregation follows.

    A spec has name, start, end, n, and perhaps agg, labels and terms, with the meaning of ``series``. Counters are followed once for all specs;
    those with terms, which choose samples, or with labels that are fixed columns, which cut series up, are followed by themselves.
    """
    specs = {q: {"agg": "avg", "n": 1, "labels": (), "terms": ()} | dict(s) for q, s in specs.items()}
    if unknown := {s["agg"] for s in specs.values()} - set(_OF):
        raise ValueError(f"unknown aggregation {unknown}")
    fixed = {c for c in points.columns if c not in PROMOTED}
    counts = lambda s: s["agg"] in ("increase", "rate")
    alone = {q: s for q, s in specs.items() if counts(s) and (s["terms"] or any(ALIASES["metrics"].get(x, x) in fixed for x in s["labels"]))}
    many = {q: s for q, s in specs.items() if q not in alone}
    parts = []
    if many:
        parts.append(_matched(points, many, pack))
    for q, s in alone.items():
        rows = series(points, s["name"], s["start"], s["end"], s["n"], s["agg"], s["labels"], s["terms"]).where("v is not null")
        named = rows.select(*(quoted(x).alias(x) for x in s["labels"]), "bucket", "v").withColumn("attributes", F.create_map().cast("map<string,string>"))
        parts.append(named.select(F.lit(q).alias("query"), pack(named, s["labels"]).alias("labels"), "bucket", "v"))
    return reduce(DataFrame.unionByName, parts)


def _matched(points: DataFrame, specs: Mapping[str, Mapping], pack: Callable) -> DataFrame:
    sets = list(dict.fromkeys(tuple(s["labels"]) for s in specs.values()))
    tests = [(q, conjunction(s["terms"])) for q, s in specs.items() if s["terms"]]
    at = {q: i for i, (q, _) in enumerate(tests)}
    by_name: dict[str, list[Column]] = {}
    for q, s in specs.items():
        width, seconds = max(1, (s["end"] - s["start"]) // s["n"]), (s["end"] - s["start"]) / s["n"] / 1e9
        values = {"query": q, "start": s["start"], "end": s["end"], "width": width, "n": s["n"], "agg": s["agg"]}
        values |= {"set": sets.index(tuple(s["labels"])), "test": at.get(q), "per": seconds if s["agg"] == "rate" else 1.0}
        kinds = {"start": "long", "end": "long", "width": "long", "n": "int", "set": "int", "test": "int", "per": "double"}
        by_name.setdefault(s["name"], []).append(F.struct(*(F.lit(x).cast(kinds.get(k, "string")).alias(k) for k, x in values.items())))
    table = F.create_map(*(x for name, own in by_name.items() for x in (F.lit(name), F.array(*own))))
    t = F.col("timestamp_nanos")
    window = t.between(min(s["start"] for s in specs.values()), max(s["end"] for s in specs.values()))
    rows = points.where(F.col("metric_name").isin(list(by_name)) & window & F.col("value").isNotNull())
    rows = rows.withColumns({"_tests": F.array(*(F.coalesce(x, F.lit(False)) for _, x in tests)), "_sets": F.array(*(pack(points, x) for x in sets))})
    if any(s["agg"] in ("increase", "rate") for s in specs.values()):
        counters = [s["name"] for s in specs.values() if s["agg"] in ("increase", "rate")]
        counted = F.coalesce(F.col("temporality") == CUMULATIVE, F.lit(False))
        rows = rows.withColumn("_counted", counted)
        follow = F.col("metric_name").isin(counters) & F.col("_counted")
        grown = with_increases(rows.where(follow), [F.col("metric_name"), *raw_series(points)])
        rest = rows.where(~follow).withColumns({"_up": F.col("value"), "_since": F.lit(None).cast("long")})
        rows = grown.unionByName(rest)
    else:
        rows = rows.withColumns({"_counted": F.lit(False), "_up": F.col("value"), "_since": F.lit(None).cast("long")})
    fed = F.filter(table[F.col("metric_name")], lambda s: t.between(s["start"], s["end"]) & (s["test"].isNull() | F.coalesce(F.get("_tests", s["test"]), F.lit(False))))
    rows = rows.select(t, "value", "_counted", "_up", "_since", "_sets", F.explode(fed).alias("s"))
    s = F.col("s")
    bucket = F.least(F.call_function("div", t - s["start"], s["width"]), s["n"] - 1).cast("int")
    # a counter's first sample of the spec's own window has nothing before it
    up = F.when(F.col("_counted") & (F.col("_since").isNull() | (F.col("_since") < s["start"])), F.lit(0.0)).otherwise(F.col("_up"))
    keys = [s["query"].alias("query"), F.get("_sets", s["set"]).alias("labels"), bucket.alias("bucket")]
    measures = [f("value").alias(f"_{name}") for name, f in GAUGE_AGGS.items()]
    measures += [F.count(F.lit(1)).cast("double").alias("_count"), F.max_by("value", F.struct("timestamp_nanos", "value")).alias("_last")]
    measures += [(F.sum(up) / F.max(s["per"])).alias("_grown"), F.max(s["agg"]).alias("_agg")]
    found = rows.groupBy(*keys).agg(*measures)
    value = reduce(lambda w, a: w.when(F.col("_agg") == a, F.col(_OF[a])), sorted({x["agg"] for x in specs.values()}), F.when(F.lit(False), F.lit(None).cast("double")))
    return found.select("query", "labels", "bucket", value.alias("v"))


def multi(points: DataFrame, specs: Mapping[str, Mapping], start: int, end: int, n: int) -> DataFrame:
    """Several series in one scan and one result: query, labels (a JSON object), bucket, t, v."""
    found = shared(points, {q: dict(s) | {"start": start, "end": end, "n": n} for q, s in specs.items()})
    seen = found.select("query", "labels").distinct()
    bare = [(q, "{}") for q, s in specs.items() if not s.get("labels")]  # these have a row a bucket whatever was seen
    if bare:
        seen = seen.unionByName(points.sparkSession.createDataFrame(bare, "query string, labels string")).distinct()
    frame = seen.select("*", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("bucket"))
    return frame.join(found, ["query", "labels", "bucket"], "left").select("query", "labels", "bucket", bucket_label(F.col("bucket"), start, end, n).alias("t"), "v")


def catalog(points: DataFrame, search: str = "", kinds: Sequence[int] = (), promoted: Sequence[str] = PROMOTED, exact: bool = False) -> DataFrame:
    """Per metric: type, unit, temporality, monotonic, last_seen, series_count over promoted labels, default aggregation.

    Names x_bucket with x_count and x_sum fold into one histogram x; the type filter applies after that.
    """
    own = [quoted(p) for p in promoted if p in points.columns]
    distinct = F.count_distinct if exact else F.approx_count_distinct
    kind = [*(F.min(c).alias(c) for c in ("metric_type", "unit", "temporality")), F.bool_or("is_monotonic").alias("is_monotonic")]
    rows = points.groupBy("metric_name").agg(*kind, F.max("timestamp_nanos").alias("last_seen"), distinct(F.concat_ws("\x1f", *own)).alias("series_count"))
    base = F.regexp_extract("metric_name", r"^(.+)_(bucket|sum|count)$", 1)
    family = rows.withColumn("_base", base).where("_base <> ''").groupBy("_base").agg(F.count(F.lit(1)).alias("_members"))
    rows = rows.withColumn("_base", base).join(family, "_base", "left")
    is_part = F.coalesce(F.col("_members") == 3, F.lit(False))
    latest = [F.max(c).alias(c) for c in ("last_seen", "series_count")]
    folded = rows.where(is_part).groupBy(F.col("_base").alias("metric_name")).agg(F.lit(2).alias("metric_type"), *kind[1:], *latest)
    out = rows.where(~is_part).drop("_base", "_members").unionByName(folded)
    if search:
        out = out.where(F.contains(F.lower("metric_name"), F.lit(search.lower())))
    if kinds:
        out = out.where(F.col("metric_type").isin(list(kinds)))
    return out.withColumn("default_aggregation", default_aggregation(F.col("metric_type"), F.col("is_monotonic")))


def metadata(points: DataFrame, name: str, promoted: Sequence[str] = PROMOTED, exact: bool = False) -> DataFrame:
    """The catalog row of one metric (of the histogram that a classic family folds into, too), with its attribute keys."""
    own = points.where(F.col("metric_name").isin(name, *(f"{name}_{x}" for x in ("bucket", "sum", "count"))))
    keys = own.select(F.explode(F.map_keys("attributes")).alias("k")).agg(F.array_sort(F.collect_set("k")).alias("attribute_keys")).withColumn("_one", F.lit(1))
    return catalog(own, promoted=promoted, exact=exact).where(F.col("metric_name") == name).withColumn("_one", F.lit(1)).join(F.broadcast(keys), "_one").drop("_one")  # one row of keys


def label_keys(points: DataFrame, name: str, start: int, end: int, promoted: Sequence[str] = PROMOTED) -> DataFrame:
    rows = points.where(metric_filter(name, start, end))
    keys = rows.select(F.explode(F.map_keys("attributes")).alias("key")).distinct()
    return keys.unionByName(points.sparkSession.createDataFrame([(p,) for p in promoted if p in points.columns], "key string")).distinct()


def label_values(points: DataFrame, name: str, label: str, start: int, end: int, limit: int = MOST_VALUES) -> DataFrame:
    from glimt.operators.logs import facet

    return facet(points, "metrics", label, metric_filter(name, start, end), limit)


def stats(found: DataFrame, labels: Sequence[str]) -> DataFrame:
    """Per series of (labels, t, v): latest value, its change against the mean in percent, and direction beyond half a percent."""
    rows = found.where("v is not null").groupBy(*(quoted(x).alias(x) for x in labels)).agg(F.max_by("v", "t").alias("latest"), F.avg("v").alias("mean"))
    change = F.when(F.col("mean") != 0, (F.col("latest") - F.col("mean")) / F.col("mean") * 100)
    return rows.withColumn("change_pct", change).withColumn("direction", F.when(F.col("change_pct") > 0.5, "up").when(F.col("change_pct") < -0.5, "down").otherwise("flat"))


def stacked(found: DataFrame, label: str, values: Sequence[str]) -> DataFrame:
    """One row a bucket, a column for each of the given label values."""
    return found.groupBy("bucket", "t").pivot(label, list(values)).agg(F.max("v"))


def namespaces(rows: DataFrame, search: str = "") -> DataFrame:
    """metric_name with its namespace (first part before . or _; names alone in theirs go to `other`) and, for a search, its rank."""
    first = F.regexp_extract("metric_name", r"^([^._]+)", 1)
    named = rows.select("metric_name").distinct().withColumn("_first", first)
    named = named.withColumn("namespace", F.when(F.count(F.lit(1)).over(Window.partitionBy("_first")) > 1, F.col("_first")).otherwise("other")).drop("_first")
    low, q = F.lower("metric_name"), search.lower()
    boundary = F.regexp_like(low, F.concat(F.lit("[._]"), F.lit("\\Q" + q + "\\E"))) if q else F.lit(False)
    score = F.when(low.startswith(q), 0).when(boundary, 1).when(low.contains(q), 2)
    return named.withColumn("score", score).where("score is not null")


def legend(found: DataFrame, labels: Sequence[str]) -> DataFrame:
    """Per series: last, min, avg and max of its points, and the largest max of all series."""
    out = found.where("v is not null").groupBy(*(quoted(x).alias(x) for x in labels)).agg(F.max_by("v", "t").alias("last"), F.min("v").alias("min"), F.avg("v").alias("avg"), F.max("v").alias("max"))
    worst = out.agg(F.max("max").alias("worst_max")).withColumn("_one", F.lit(1))
    return out.withColumn("_one", F.lit(1)).join(F.broadcast(worst), "_one").drop("_one")  # one row
