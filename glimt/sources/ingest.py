"""Raw telemetry to table rows: OTLP JSON, Prometheus remote write, browser beacons, tenants and apps.

Every function maps a DataFrame of raw records to rows, so the same code serves batch reads and streams.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glimt.functions.fields import EXP_HISTOGRAM, HISTOGRAM, PROMOTED, SUMMARY, quoted

_ANY = "struct<stringValue:string,boolValue:boolean,intValue:string,doubleValue:double,bytesValue:string,arrayValue:string,kvlistValue:string>"
_KEYS = f"array<struct<key:string,value:{_ANY}>>"
_HEAD = f"resource:struct<attributes:{_KEYS}>"
_SCOPE = "scope:struct<name:string>"
LOGS_JSON = f"struct<resourceLogs:array<struct<{_HEAD},scopeLogs:array<struct<{_SCOPE},logRecords:array<struct<timeUnixNano:string,observedTimeUnixNano:string,severityNumber:int,severityText:string,body:{_ANY},traceId:string,spanId:string,attributes:{_KEYS}>>>>>>>"
TRACES_JSON = (
    f"struct<resourceSpans:array<struct<{_HEAD},scopeSpans:array<struct<{_SCOPE},spans:array<struct<traceId:string,spanId:string,parentSpanId:string,name:string,kind:int,startTimeUnixNano:string,endTimeUnixNano:string,"
    f"status:struct<code:int,message:string>,attributes:{_KEYS},events:array<struct<name:string,timeUnixNano:string,attributes:{_KEYS}>>,links:array<struct<traceId:string,spanId:string,attributes:{_KEYS}>>>>>>>>>"
)
_TIME = f"timeUnixNano:string,startTimeUnixNano:string,attributes:{_KEYS}"
_SIDE = "struct<offset:int,bucketCounts:array<string>>"
_DATA = {
    "gauge": f"dataPoints:array<struct<{_TIME},asInt:string,asDouble:double>>",
    "sum": f"aggregationTemporality:int,isMonotonic:boolean,dataPoints:array<struct<{_TIME},asInt:string,asDouble:double>>",
    "histogram": f"aggregationTemporality:int,dataPoints:array<struct<{_TIME},count:string,sum:double,bucketCounts:array<string>,explicitBounds:array<double>,min:double,max:double>>",
    "exponentialHistogram": f"aggregationTemporality:int,dataPoints:array<struct<{_TIME},count:string,sum:double,scale:int,zeroCount:string,positive:{_SIDE},negative:{_SIDE},min:double,max:double>>",
    "summary": f"dataPoints:array<struct<{_TIME},count:string,sum:double,quantileValues:array<struct<quantile:double,value:double>>>>",
}
METRICS_JSON = f"struct<resourceMetrics:array<struct<{_HEAD},scopeMetrics:array<struct<{_SCOPE},metrics:array<struct<name:string,unit:string," + ",".join(f"{k}:struct<{v}>" for k, v in _DATA.items()) + ">>>>>>>"
_KIND_TEXT = ("UNSPECIFIED", "INTERNAL", "SERVER", "CLIENT", "PRODUCER", "CONSUMER")
_STATUS_TEXT = ("UNSET", "OK", "ERROR")


def number_text(value: Column) -> Column:
    """A double as text; whole numbers without a fraction."""
    whole = (value == F.floor(value)) & (F.abs(value) < 1e15)
    return F.when(whole, value.cast("long").cast("string")).otherwise(value.cast("string"))


#: Levels of lists and maps inside each other that are written out; deeper ones stay as their JSON text.
DEPTH = 3


def scalar_text(value: Column) -> Column:
    """A typed value that is no list or map, as text: bytes as hex, nothing as the empty text."""
    raw = F.lower(F.hex(F.unbase64(value["bytesValue"])))
    return F.coalesce(value["stringValue"], value["intValue"], value["boolValue"].cast("string"), number_text(value["doubleValue"]), raw, F.lit(""))


def any_text(value: Column, depth: int = DEPTH) -> Column:
    """A typed value as text: lists as [a,b], maps as {k=v}."""
    if depth == 0:
        return F.coalesce(value["arrayValue"], value["kvlistValue"], scalar_text(value))
    inner = lambda x: F.coalesce(any_text(x, depth - 1), F.lit(""))
    items = F.coalesce(F.from_json(value["arrayValue"], f"struct<values:array<{_ANY}>>")["values"], F.array().cast(f"array<{_ANY}>"))
    pairs = F.coalesce(F.from_json(value["kvlistValue"], f"struct<values:{_KEYS}>")["values"], F.array().cast(_KEYS))
    listed = F.concat(F.lit("["), F.array_join(F.transform(items, inner), ","), F.lit("]"))
    mapped = F.concat(F.lit("{"), F.array_join(F.transform(pairs, lambda p: F.concat(p["key"], F.lit("="), inner(p["value"]))), ","), F.lit("}"))
    return F.when(value["arrayValue"].isNotNull(), listed).when(value["kvlistValue"].isNotNull(), mapped).otherwise(scalar_text(value))


def attribute_map(keys: Column) -> Column:
    """An attribute list as a map; of equal keys the last counts. Lists of scalars without repeated keys, almost all, take a short way."""
    keys = F.coalesce(keys, F.array().cast(_KEYS))
    names = F.transform(keys, lambda e: e["key"])
    nested = F.exists(keys, lambda e: e["value"]["arrayValue"].isNotNull() | e["value"]["kvlistValue"].isNotNull())
    plain = ~nested & (F.size(F.array_distinct(names)) == F.size(names))
    short = F.map_from_arrays(names, F.transform(keys, lambda e: scalar_text(e["value"])))
    last = F.filter(keys, lambda e, i: ~F.array_contains(F.slice(names, i + 2, F.size(names)), e["key"]))
    long = F.map_from_entries(F.transform(last, lambda e: F.struct(e["key"].alias("key"), any_text(e["value"]).alias("value"))))
    return F.when(plain, short).otherwise(long)


def merged(under: Column, over: Column) -> Column:
    """Both maps in one; ``over`` wins."""
    return F.map_concat(F.map_filter(under, lambda k, _: ~F.array_contains(F.map_keys(over), k)), over)


def promote(rows: DataFrame, promoted: Sequence[str] = PROMOTED) -> DataFrame:
    """The promoted attributes as columns of their own, no longer in the map."""
    rest = F.map_filter("attributes", lambda k, _: ~k.isin(list(promoted)))
    others = [c for c in rows.columns if c != "attributes"]
    return rows.select(*others, *(F.col("attributes").getItem(p).alias(p) for p in promoted), rest.alias("attributes"))


def _empty_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def _nanos(c: Column) -> Column:
    return F.nullif(c.cast("long"), F.lit(0).cast("long"))


def _flat(raw: DataFrame, column: str, schema: str, outer: str, scopes: str, inner: str) -> DataFrame:
    """One row (resource map, scope name, record) for each innermost record.

    What a level keeps is taken out before its list is exploded, so no row carries the list that it comes from: cost is in proportion to a batch.
    """
    parsed = raw.select(F.explode(F.from_json(column, schema)[outer]).alias("r"))
    parsed = parsed.select(attribute_map(F.col("r.resource.attributes")).alias("resource"), F.col(f"r.{scopes}").alias("_scopes"))
    scoped = parsed.select("resource", F.explode("_scopes").alias("s")).select("resource", F.col("s.scope.name").alias("scope_name"), F.col(f"s.{inner}").alias("_records"))
    return scoped.select("resource", "scope_name", F.explode("_records").alias("x"))


def otlp_logs(raw: DataFrame, column: str = "value", promoted: Sequence[str] = PROMOTED) -> DataFrame:
    flat = _flat(raw, column, LOGS_JSON, "resourceLogs", "scopeLogs", "logRecords")
    flat = flat.withColumn("own", attribute_map(F.col("x.attributes")))
    x = F.col("x")
    time, seen = _nanos(x["timeUnixNano"]), _nanos(x["observedTimeUnixNano"])
    rows = flat.select(
        F.coalesce(time, seen, F.lit(0)).alias("timestamp_nanos"), seen.alias("observed_nanos"), F.nullif(x["severityNumber"], F.lit(0)).alias("severity_number"), _empty_to_null(x["severityText"]).alias("severity_text"),
        F.when(x["body"].isNotNull(), any_text(x["body"])).alias("body"), _empty_to_null(F.lower(x["traceId"])).alias("trace_id"), _empty_to_null(F.lower(x["spanId"])).alias("span_id"), _empty_to_null(F.col("scope_name")).alias("scope_name"), merged(F.col("resource"), F.col("own")).alias("attributes"))
    return promote(rows, promoted)


def otlp_traces(raw: DataFrame, column: str = "value", promoted: Sequence[str] = PROMOTED) -> DataFrame:
    flat = _flat(raw, column, TRACES_JSON, "resourceSpans", "scopeSpans", "spans")
    flat = flat.withColumn("own", attribute_map(F.col("x.attributes")))
    x = F.col("x")
    start, end = F.coalesce(x["startTimeUnixNano"].cast("long"), F.lit(0)), _nanos(x["endTimeUnixNano"])
    text = lambda names, code: F.coalesce(F.get(F.array(*map(F.lit, names)), code), F.lit(names[0]))
    kind, code = F.coalesce(x["kind"], F.lit(0)), F.coalesce(x["status"]["code"], F.lit(0))
    events = F.transform(x["events"], lambda e: F.struct(e["name"].alias("name"), e["timeUnixNano"].cast("long").alias("time_unix_nano"), attribute_map(e["attributes"]).alias("attributes")))
    links = F.transform(x["links"], lambda e: F.struct(F.lower(e["traceId"]).alias("trace_id"), F.lower(e["spanId"]).alias("span_id"), attribute_map(e["attributes"]).alias("attributes")))
    rows = flat.select(
        F.lower(x["traceId"]).alias("trace_id"), F.lower(x["spanId"]).alias("span_id"), _empty_to_null(F.lower(x["parentSpanId"])).alias("parent_span_id"), x["name"].alias("name"), kind.alias("kind"), text(_KIND_TEXT, kind).alias("kind_text"),
        start.alias("start_time_nanos"), end.alias("end_time_nanos"), F.when(end.isNotNull(), F.greatest(end - start, F.lit(0))).alias("duration_nanos"), code.alias("status_code"), text(_STATUS_TEXT, code).alias("status_text"), _empty_to_null(x["status"]["message"]).alias("status_message"),
        _empty_to_null(F.col("scope_name")).alias("scope_name"), events.alias("events"), links.alias("links"), merged(F.col("resource"), F.col("own")).alias("attributes"))
    return promote(rows, promoted)


def otlp_metrics(raw: DataFrame, column: str = "value", promoted: Sequence[str] = PROMOTED) -> DataFrame:
    """One pass over the metrics: whatever kind of data each has becomes points of one shape."""
    flat = _flat(raw, column, METRICS_JSON, "resourceMetrics", "scopeMetrics", "metrics")
    longs = lambda c: F.transform(c, lambda v: v.cast("long"))
    none = lambda t: F.lit(None).cast(t)

    def points(kind: int, name: str, text: str) -> Column:
        data = F.col(f"x.{name}")
        simple, has_temporality = name in ("gauge", "sum"), name not in ("gauge", "summary")

        def one(p: Column) -> Column:
            value = F.coalesce(p["asDouble"], p["asInt"].cast("double")) if simple else none("double")
            side = lambda s: F.when(s.isNotNull(), F.struct(F.coalesce(s["offset"], F.lit(0)).alias("offset"), longs(s["bucketCounts"]).alias("bucket_counts")))
            histogram = F.struct(p["count"].cast("long").alias("count"), p["sum"].alias("sum"), longs(p["bucketCounts"]).alias("bucket_counts"), p["explicitBounds"].alias("explicit_bounds"), p["min"].alias("min"), p["max"].alias("max")) if name == "histogram" else none(HISTOGRAM)
            exp = F.struct(p["count"].cast("long").alias("count"), p["sum"].alias("sum"), p["scale"].alias("scale"), F.coalesce(p["zeroCount"].cast("long"), F.lit(0)).alias("zero_count"), side(p["positive"]).alias("positive"), side(p["negative"]).alias("negative"), p["min"].alias("min"), p["max"].alias("max")) if name == "exponentialHistogram" else none(EXP_HISTOGRAM)
            summary = F.struct(p["count"].cast("long").alias("count"), p["sum"].alias("sum"), p["quantileValues"].alias("quantiles")) if name == "summary" else none(SUMMARY)
            return F.struct(
                F.lit(kind).alias("metric_type"), F.lit(text).alias("type_text"), (data["aggregationTemporality"] if has_temporality else none("int")).alias("temporality"), (data["isMonotonic"] if name == "sum" else none("boolean")).alias("is_monotonic"),
                p["timeUnixNano"].cast("long").alias("timestamp_nanos"), _nanos(p["startTimeUnixNano"]).alias("start_nanos"), value.alias("value"), histogram.alias("histogram"), exp.alias("exp_histogram"), summary.alias("summary"), attribute_map(p["attributes"]).alias("own"))

        return F.transform(data["dataPoints"], one)

    kinds = (("gauge", "GAUGE"), ("sum", "SUM"), ("histogram", "HISTOGRAM"), ("exponentialHistogram", "EXPONENTIAL_HISTOGRAM"), ("summary", "SUMMARY"))
    every = F.flatten(F.array_compact(F.array(*(points(i, n, t) for i, (n, t) in enumerate(kinds)))))
    rows = flat.select("resource", "scope_name", F.col("x.name").alias("metric_name"), _empty_to_null(F.col("x.unit")).alias("unit"), F.explode(every).alias("p"))
    plain = [c for c in rows.select("p.*").columns if c != "own"]
    return promote(rows.select("metric_name", "unit", "scope_name", *(F.col(f"p.{c}") for c in plain), merged(F.col("resource"), F.col("p.own")).alias("attributes")), promoted)


def remote_write(series: DataFrame, promoted: Sequence[str] = PROMOTED) -> DataFrame:
    """(labels map, samples array of (timestamp ms, value)) to points; series without a name are dropped."""
    name, job = F.col("labels").getItem("__name__"), F.col("labels").getItem("job")
    rest = F.map_filter("labels", lambda k, _: ~k.isin("__name__", "job", "service.name") | ((k == "service.name") & job.isNull()))
    attributes = F.when(job.isNotNull(), F.map_concat(rest, F.create_map(F.lit("service.name"), job))).otherwise(rest)
    counter = F.col("metric_name").rlike("_(total|bucket|count|sum)$")
    rows = series.where(name.isNotNull()).select(name.alias("metric_name"), attributes.alias("attributes"), F.explode("samples").alias("s"))
    rows = rows.select("metric_name", F.when(counter, 1).otherwise(0).alias("metric_type"), F.when(counter, "SUM").otherwise("GAUGE").alias("type_text"), F.when(counter, 2).alias("temporality"), F.when(counter, True).alias("is_monotonic"), (F.col("s.timestamp") * 1_000_000).alias("timestamp_nanos"), F.col("s.value").alias("value"), "attributes")
    return promote(rows, promoted)


BEACON_JSON = (
    "struct<app:string,key:string,session:string,view:struct<id:string,route:string,path:string,seq:bigint,prev:string,nav:string,dur:double>,ctx:struct<ua:string,conn:string>,trace:string,"
    "vitals:array<struct<n:string,v:double,attr:struct<element:string,url:string,target:string,source:string,ttfb:double,rld:double,rlt:double,erd:double,id:double,pd:double,pr:double>>>,errors:array<struct<kind:string,type:string,msg:string,stack:string,src:string,line:bigint>>>"
)
#: Vital codes, sub-parts (key, metric) and string attributes (key, attribute) of each.
VITALS = ("LCP", "INP", "CLS", "FCP", "TTFB", "ROUTE_CHANGE")
PARTS = {
    "LCP": (("ttfb", "web_vitals.lcp.ttfb"), ("rld", "web_vitals.lcp.resource_load_delay"), ("rlt", "web_vitals.lcp.resource_load_time"), ("erd", "web_vitals.lcp.element_render_delay")),
    "INP": (("id", "web_vitals.inp.input_delay"), ("pd", "web_vitals.inp.processing_duration"), ("pr", "web_vitals.inp.presentation_delay")),
}
STRINGS = {"LCP": (("element", "lcp.element"), ("url", "lcp.url")), "INP": (("target", "inp.target"),), "CLS": (("source", "cls.source"),)}


def user_agent(ua: Column) -> tuple[Column, Column]:
    """Device and browser class by the first rule that fits."""
    has = lambda *words: reduce(lambda a, b: a | b, (ua.contains(w) for w in words))
    device = F.when(has("iPad", "Tablet"), "tablet").when(has("Mobi", "Android", "iPhone"), "mobile").otherwise("desktop")
    browser = F.when(has("Edg"), "Edge").when(has("Firefox", "FxiOS"), "Firefox").when(has("Chrome", "CriOS"), "Chrome").when(has("Safari"), "Safari").otherwise("Other")
    return device, browser


def beacons(raw: DataFrame, column: str = "value", now: str = "received_nanos") -> DataFrame:
    """Parsed beacons (b, received_nanos, base attributes); text that is no beacon is dropped."""
    parsed = raw.select(F.from_json(column, BEACON_JSON).alias("b"), F.col(now).alias("received_nanos"), *([quoted(c) for c in raw.columns if c not in (column, now)])).where("b.key is not null or b.app is not null")
    device, browser = user_agent(F.coalesce(F.col("b.ctx.ua"), F.lit("")))
    pairs = {"service.name": F.col("b.app"), "browser.route": F.col("b.view.route"), "url.path": F.col("b.view.path"), "device.type": device, "browser.name": browser, "network.connection": F.col("b.ctx.conn"), "session.id": F.col("b.session"), "view.id": F.col("b.view.id"), "nav": F.col("b.view.nav"), "view.seq": F.col("b.view.seq").cast("string"), "view.previous_route": F.col("b.view.prev")}
    base = F.map_filter(F.create_map(*(x for k, v in pairs.items() for x in (F.lit(k), v))), lambda _, v: v.isNotNull() & (v != ""))
    return parsed.withColumn("base", base)


def beacon_vitals(parsed: DataFrame, promoted: Sequence[str] = PROMOTED) -> DataFrame:
    """Gauges: each known vital with its string attributes, its sub-parts, and the time on the view."""
    point = lambda name, unit, value, extra: F.struct(name.alias("metric_name"), unit.alias("unit"), value.alias("value"), extra.alias("extra"))
    none = F.create_map().cast("map<string,string>")
    code = lambda v: F.upper(v["n"])

    def one(v: Column) -> Column:
        strings = [x for k, pairs in STRINGS.items() for key, attribute in pairs for x in (F.lit(attribute), F.when(code(v) == k, v["attr"][key]))]
        extra = F.map_filter(F.create_map(*strings), lambda _, s: s.isNotNull())
        main = point(F.concat(F.lit("web_vitals."), F.lower(v["n"])), F.when(code(v) == "CLS", "1").otherwise("ms"), v["v"], extra)
        parts = [F.when((code(v) == k) & v["attr"][key].isNotNull(), point(F.lit(metric), F.lit("ms"), v["attr"][key], none)) for k, own in PARTS.items() for key, metric in own]
        return F.array_compact(F.array(main, *parts))

    known = F.filter(F.coalesce("b.vitals", F.array().cast("array<struct<n:string,v:double,attr:struct<element:string,url:string,target:string,source:string,ttfb:double,rld:double,rlt:double,erd:double,id:double,pd:double,pr:double>>>")), lambda v: code(v).isin(*VITALS))
    view = F.array_compact(F.array(F.when(F.col("b.view.dur").isNotNull(), point(F.lit("web_vitals.view_duration"), F.lit("ms"), F.col("b.view.dur"), none))))
    rows = parsed.select("base", "received_nanos", F.explode(F.concat(F.flatten(F.transform(known, one)), view)).alias("p"))
    return promote(rows.select(F.col("p.metric_name"), F.lit(0).alias("metric_type"), F.lit("GAUGE").alias("type_text"), F.col("p.unit"), F.col("received_nanos").alias("timestamp_nanos"), F.col("p.value"), merged(F.col("base"), F.col("p.extra")).alias("attributes")), promoted)


def fnv1a(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """FNV-1a of UTF-8 bytes as 16 hex digits, a column of bytes at a time over all rows of a batch."""
    for batch in texts:
        raw = [(t or "").encode() for t in batch]
        h = np.full(len(raw), 0xCBF29CE484222325, np.uint64)
        size = np.array([len(r) for r in raw])
        order = np.argsort(-size, kind="stable")
        grid = [raw[i] for i in order]
        for k in range(int(size.max(initial=0))):
            live = int(np.searchsorted(-size[order], -k, "left"))
            column = np.array([r[k] for r in grid[:live]], np.uint64)
            h[:live] = (h[:live] ^ column) * np.uint64(0x100000001B3)
        out = np.empty(len(raw), object)
        out[order] = [f"{x:016x}" for x in h.tolist()]
        yield pd.Series(out)


def fingerprint(kind: Column, message: Column, frame: Column, native: bool = False) -> Column:
    """Of an error's type, message with digits masked, and frame. ``native`` hashes in the JVM, to other values."""
    text = F.concat_ws("\x1f", F.coalesce(kind, F.lit("")), F.regexp_replace(F.coalesce(message, F.lit("")), "[0-9]+", "#"), F.coalesce(frame, F.lit("")))
    return F.lower(F.hex(F.xxhash64(text))) if native else F.pandas_udf(fnv1a, "string")(text)


def beacon_errors(parsed: DataFrame, promoted: Sequence[str] = PROMOTED, native: bool = False) -> DataFrame:
    """Error logs with the fingerprint of their issue."""
    rows = parsed.select("base", "received_nanos", F.col("b.trace").alias("trace"), F.explode("b.errors").alias("e"))
    e = F.col("e")
    frame = F.when(F.coalesce(e["src"], F.lit("")) == "", F.lit(None)).when(e["line"].isNotNull(), F.concat_ws(":", e["src"], e["line"].cast("string"))).otherwise(e["src"])
    trace = F.when(F.col("trace").rlike("^[0-9a-fA-F]{32}$") & ~F.col("trace").rlike("^0+$"), F.lower("trace"))
    rows = rows.withColumn("_fp", fingerprint(e["type"], e["msg"], frame, native))
    text = lambda c: F.coalesce(c, F.lit(""))
    own = F.create_map(F.lit("error.kind"), text(e["kind"]), F.lit("exception.type"), text(e["type"]), F.lit("exception.message"), text(e["msg"]), F.lit("rum.error.fingerprint"), F.col("_fp"), F.lit("exception.stacktrace"), e["stack"])
    own = F.map_filter(own, lambda k, v: v.isNotNull() & ((k != "exception.stacktrace") | (v != "")))
    return promote(rows.select(F.col("received_nanos").alias("timestamp_nanos"), F.lit(17).alias("severity_number"), F.lit("ERROR").alias("severity_text"), text(e["msg"]).alias("body"), trace.alias("trace_id"), merged(F.col("base"), own).alias("attributes")), promoted)


def stamp_tenant(rows: DataFrame, keys: DataFrame, key_col: str = "api_key") -> DataFrame:
    """The tenant of each row's sender as the attribute `tenant`; what senders put there is removed. Keys: (token, tenant)."""
    joined = rows.join(keys.select(F.col("token").alias(key_col), F.col("tenant").alias("_tenant")), key_col, "left")
    bare = F.map_filter("attributes", lambda k, _: k != "tenant")
    stamped = F.when(F.col("_tenant").isNotNull(), F.map_concat(bare, F.create_map(F.lit("tenant"), F.col("_tenant")))).otherwise(bare)
    return joined.withColumn("attributes", stamped).drop("_tenant", key_col)


def app_gate(parsed: DataFrame, apps: DataFrame, key: Column, origin: Column, identity: Column) -> DataFrame:
    """Beacons of registered keys from allowed origins, of which the app's sample rate stays (the same ones in every run)."""
    joined = parsed.withColumn("_key", key).join(apps.select(F.col("key").alias("_key"), "allowed_origins", "sample_rate"), "_key")
    draw = F.pmod(F.xxhash64(identity), F.lit(1_000_000))
    return joined.where(F.array_contains("allowed_origins", origin) & (draw < F.col("sample_rate") * 1_000_000)).drop("_key", "allowed_origins", "sample_rate")
