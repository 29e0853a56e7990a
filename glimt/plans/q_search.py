"""Queries over logs, spans and traces, and over RED metrics, with their DuckDB twins. Names follow the operator inventory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glimt.functions import buckets, terms
from glimt.functions.fields import quoted
from glimt.functions.storage import kept, shared_folder
from glimt.operators import apm, logs, rollups, traces
from glimt.plans import views as v
from glimt.sources import manifest, tables

S, E = v.MONTH
YS, YE = v.YEAR
N = 30
QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return add


def label_sql(i: str, start: int, end: int, n: int) -> str:
    whole, rest = divmod(end - start, n)
    return f"{start} + {i} * {whole} + ({i} * {rest}) // {n}"


def index_sql(ts: str, start: int, end: int, n: int) -> str:
    return f"least(({ts} - {start}) // {max(1, (end - start) // n)}, {n - 1})"


def _logs(body: str) -> str:
    return v.sql(body, logs=v.LOGS)


def _spans(body: str, **more: str) -> str:
    return v.sql(body, spans=v.SPANS, **more)


# ---- filters -------------------------------------------------------------------------------------------------


@query("f1_match", _logs("SELECT trace_id, service FROM logs WHERE service IN ('svc-1', 'svc-2') AND k IN ('7', '8')"))
def f1(spark: SparkSession, d: str) -> DataFrame:
    df = v.logs(spark, d)
    return df.where(terms.conjunction([terms.match(df, "logs", "service", ["svc-1", "svc-2"]), terms.match(df, "logs", "k", ["7", "8"])])).select("trace_id", quoted("service.name").alias("service"))


@query("f2_exists", _spans("SELECT trace_id, span_id FROM spans WHERE db_system IS NOT NULL"))
def f2(spark, d):
    df = v.spans(spark, d)
    return df.where(terms.exists(df, "spans", "db.system")).select("trace_id", "span_id")


@query("f3_compare", _spans("SELECT span_id, duration_nanos FROM spans WHERE CAST(lines AS DOUBLE) >= 5 AND duration_nanos > 50000000"))
def f3(spark, d):
    df = v.spans(spark, d)
    return df.where(terms.conjunction([terms.compare(df, "spans", "lines", ">=", 5), terms.compare(df, "spans", "duration", ">", 50, "ms")])).select("span_id", "duration_nanos")


@query("f4_free_text", "SELECT CAST(doc_id AS VARCHAR) AS trace_id, source AS service FROM documents WHERE contains(text, 'License')")
def f4(spark, d):
    return v.text_logs(spark, d).where(terms.free_text("logs", "License")).select("trace_id", quoted("service.name").alias("service"))


@query("f5_level", _logs("SELECT trace_id, severity_number FROM logs WHERE severity_number BETWEEN 13 AND 20"))
def f5(spark, d):
    return v.logs(spark, d).where(terms.level(["warn", "error"])).select("trace_id", "severity_number")


@query("f6_f7_status_kind", _spans("SELECT span_id FROM spans WHERE status_code = 2 AND kind IN (2, 3)"))
def f67(spark, d):
    return v.spans(spark, d).where(terms.status(["error"]) & terms.kind(["server", "client"])).select("span_id")


@query("f8_negation", _logs("SELECT trace_id FROM logs WHERE (severity_number BETWEEN 17 AND 20) IS NOT TRUE AND (CAST(k AS DOUBLE) >= 50) IS NOT TRUE"))
def f8(spark, d):
    df = v.logs(spark, d)
    return df.where(terms.negate(terms.level(["error"])) & terms.negate(terms.compare(df, "logs", "k", ">=", 50))).select("trace_id")


@query("f9_f10_log_filter", _logs(f"SELECT trace_id FROM logs WHERE timestamp_nanos BETWEEN {S} AND {S + 9 * 24 * v.HOUR} AND service IN ('svc-3', 'svc-4') AND severity_number BETWEEN 1 AND 12 AND contains(body, '5') AND user_id IS NOT NULL"))
def f10(spark, d):
    df = v.logs(spark, d)
    return df.where(terms.log_filter(df, S, S + 9 * 24 * v.HOUR, ["svc-3", "svc-4"], ["debug", "info"], "5", [terms.exists(df, "logs", "user.id")])).select("trace_id")


@query("f11_span_filter", _spans(f"SELECT span_id FROM spans WHERE start_time_nanos BETWEEN {YS} AND {YE} AND contains(name, 'R')"))
def f11(spark, d):
    return v.spans(spark, d).where(terms.span_filter(YS, YE, [terms.free_text("spans", "R")])).select("span_id")


@query("f12_f13_metric_filter_host_pin", v.sql(f"SELECT timestamp_nanos, value FROM points WHERE metric_name = 'queue.depth' AND timestamp_nanos BETWEEN {S} AND {E} AND host = 'host-3' AND tenant = 't1'", points=v.POINTS))
def f12(spark, d):
    df = v.points(spark, d)
    return df.where(terms.metric_filter("queue.depth", S, E, [terms.host_pin("host-3", terms.match(df, "metrics", "tenant", ["t1"]))])).select("timestamp_nanos", "value")


# ---- logs ----------------------------------------------------------------------------------------------------

_ERR = "severity_number BETWEEN 17 AND 20"


@query("l1_log_search", _logs(f"SELECT timestamp_nanos, trace_id, body, service FROM logs WHERE {_ERR} ORDER BY timestamp_nanos DESC, trace_id, span_id, body LIMIT 200"))
def l1(spark, d):
    return logs.search(v.logs(spark, d), terms.level(["error"]), 200).select("timestamp_nanos", "trace_id", "body", quoted("service.name").alias("service"))


@query("l2_log_search_count", _logs(f"SELECT timestamp_nanos, trace_id, (SELECT count(*) FROM logs WHERE {_ERR}) AS matched_count FROM logs WHERE {_ERR} ORDER BY timestamp_nanos DESC, trace_id, span_id, body LIMIT 50"))
def l2(spark, d):
    return logs.search_with_count(v.logs(spark, d), terms.level(["error"]), 50).select("timestamp_nanos", "trace_id", "matched_count")


@query("l3_log_count", _logs("SELECT count(*) AS matched_count FROM logs WHERE severity_number BETWEEN 13 AND 16"))
def l3(spark, d):
    return logs.count(v.logs(spark, d), terms.level(["warn"]))


@query("l4_log_facet", _logs("SELECT value, count, total > 20 AS capped FROM (SELECT k AS value, count(*) AS count, count(*) OVER () AS total FROM logs GROUP BY k) ORDER BY count DESC, value LIMIT 20"))
def l4(spark, d):
    return logs.facet(v.logs(spark, d), "logs", "k", F.lit(True), 20)


@query("l5_log_volume", _logs(f"""SELECT CAST(b AS INT) AS bucket, {label_sql('b', S, E, N)} AS start_nanos, coalesce(debug, 0) AS debug, coalesce(info, 0) AS info, coalesce(warn, 0) AS warn, coalesce(error, 0) AS error, coalesce(fatal, 0) AS fatal, coalesce(total, 0) AS total
 FROM range({N}) r(b) LEFT JOIN (SELECT {index_sql('timestamp_nanos', S, E, N)} AS i, count(*) FILTER (severity_number BETWEEN 1 AND 8) AS debug, count(*) FILTER (severity_number BETWEEN 13 AND 16) AS warn, count(*) FILTER ({_ERR}) AS error, count(*) FILTER (severity_number BETWEEN 21 AND 24) AS fatal,
 count(*) FILTER ((severity_number BETWEEN 1 AND 8 OR severity_number BETWEEN 13 AND 24) IS NOT TRUE) AS info, count(*) AS total FROM logs WHERE timestamp_nanos BETWEEN {S} AND {E} GROUP BY 1) ON i = b"""))
def l5(spark, d):
    return logs.volume(v.logs(spark, d), terms.in_window("logs", S, E), S, E, N)


@query("l6_log_fields", "SELECT * FROM (VALUES ('timestamp_nanos', 'fixed'), ('severity_number', 'fixed'), ('severity_text', 'fixed'), ('body', 'fixed'), ('trace_id', 'fixed'), ('span_id', 'fixed'), ('service.name', 'promoted'), ('host.name', 'promoted'), ('user.id', 'attribute'), ('k', 'attribute'), ('session.id', 'attribute')) t(name, kind)")
def l6(spark, d):
    return logs.field_catalog(v.logs(spark, d), F.lit(True))


@query("l6_field_manifest", "SELECT * FROM (VALUES ('timestamp_nanos', 'fixed'), ('severity_number', 'fixed'), ('severity_text', 'fixed'), ('body', 'fixed'), ('trace_id', 'fixed'), ('span_id', 'fixed'), ('service.name', 'promoted'), ('host.name', 'promoted')) t(name, kind) UNION ALL SELECT DISTINCT unnest(['user.id', 'k', 'session.id', 'day' || (epoch_us(ts) // 86400000000 % 3)]), 'attribute' FROM events WHERE epoch_us(ts) // 86400000000 BETWEEN 19727 AND 19728")
def l6m(spark, d):
    """Fields of two days' files (each day has a key of its own) from the manifest alone, after a merge of small files and a purge."""
    day = F.call_function("div", F.col("timestamp_nanos"), F.lit(86_400_000_000_000))
    rows = v.logs(spark, d).withColumn("attributes", F.map_concat("attributes", F.create_map(F.concat(F.lit("day"), day % 3), F.lit("x"))))
    out = tables.sink(rows, shared_folder(spark, "tables"), "logs", "overwrite", 40)
    tables.consolidate(spark, out, "logs", shared_folder(spark, "staging"))
    tables.purge(spark, out, "logs", 19_727 * 86_400_000_000_000)
    return manifest.field_catalog(spark, out, 19_727 * 86_400_000_000_000, 19_729 * 86_400_000_000_000 - 1, rows.columns)


@query("l7_services", _logs("SELECT DISTINCT service FROM logs"))
def l7(spark, d):
    return logs.services(v.logs(spark, d))


@query("l8_log_rows", _logs("""SELECT timestamp_nanos, CASE WHEN coalesce(severity_number, 0) <= 0 THEN 'info' WHEN severity_number <= 8 THEN 'debug' WHEN severity_number <= 12 THEN 'info' WHEN severity_number <= 16 THEN 'warn' WHEN severity_number <= 20 THEN 'error' ELSE 'fatal' END AS severity, body, trace_id, span_id,
 '{"host.name":"' || host || '","k":"' || k || '","service.name":"' || service || '","session.id":"' || session_id || '","user.id":"' || user_id || '"}' AS attributes_json FROM logs"""))
def l8(spark, d):
    return logs.render(v.logs(spark, d))


# ---- spans and traces ----------------------------------------------------------------------------------------


@query("t1_get_trace", _spans("SELECT span_id, name, duration_nanos FROM spans WHERE trace_id = '7'"))
def t1(spark, d):
    return traces.get_trace(v.spans(spark, d), "7").select("span_id", "name", "duration_nanos")


for _sort, _order in (("recent", "start_time_nanos DESC"), ("slowest", "duration_nanos DESC NULLS LAST"), ("errors", "status_code DESC NULLS LAST, start_time_nanos DESC")):

    @query(f"t{dict(recent=2, slowest=3, errors=4)[_sort]}_span_search_{_sort}", _spans(f"SELECT trace_id, span_id, start_time_nanos, duration_nanos, status_code FROM spans WHERE kind = 3 ORDER BY {_order}, span_id, trace_id LIMIT 100 OFFSET 20"))
    def _search(spark, d, sort=_sort):
        return traces.search(v.spans(spark, d), terms.kind(["client"]), sort, 20, 100).select("trace_id", "span_id", "start_time_nanos", "duration_nanos", "status_code")


@query("t5_span_search_count", _spans("SELECT span_id, (SELECT count(*) FROM spans WHERE status_code = 2) AS matched_count FROM spans WHERE status_code = 2 ORDER BY start_time_nanos DESC, span_id, trace_id LIMIT 60"))
def t5(spark, d):
    return traces.search_with_count(v.spans(spark, d), terms.status(["error"]), "recent", 60).select("span_id", "matched_count")


@query("t6_span_facet", _spans("SELECT value, count, total > 5 AS capped FROM (SELECT server_address AS value, count(*) AS count, count(*) OVER () AS total FROM spans WHERE server_address IS NOT NULL GROUP BY 1) ORDER BY count DESC, value LIMIT 5"))
def t6(spark, d):
    return traces.facet(v.spans(spark, d), "server.address", F.lit(True), 5)


@query("t7_span_volume", _spans(f"""SELECT CAST(b AS INT) AS bucket, {label_sql('b', YS, YE, N)} AS start_nanos, coalesce(ok, 0) AS ok, coalesce(error, 0) AS error, coalesce(unset, 0) AS unset, coalesce(total, 0) AS total FROM range({N}) r(b) LEFT JOIN
 (SELECT {index_sql('start_time_nanos', YS, YE, N)} AS i, count(*) FILTER (status_code = 1) AS ok, count(*) FILTER (status_code = 2) AS error, count(*) FILTER (status_code NOT IN (1, 2)) AS unset, count(*) AS total FROM spans WHERE start_time_nanos BETWEEN {YS} AND {YE} GROUP BY 1) ON i = b"""))
def t7(spark, d):
    return traces.volume(v.spans(spark, d), terms.in_window("spans", YS, YE), YS, YE, N)


@query("t8_span_fields", "SELECT * FROM (VALUES " + ", ".join(f"('{c}', 'fixed')" for c in "trace_id span_id parent_span_id name kind start_time_nanos end_time_nanos duration_nanos status_code".split()) + ", ('service.name', 'promoted'), ('tenant', 'promoted'), ('db.system', 'attribute'), ('db.name', 'attribute'), ('server.address', 'attribute'), ('peer.service', 'attribute'), ('lines', 'attribute')) t(name, kind)")
def t8(spark, d):
    return traces.field_catalog(v.spans(spark, d), F.lit(True))


_ROLL = f"""SELECT trace_id, count(*) AS span_count, count(*) FILTER (status_code = 2) AS error_count, array_to_string(list_sort(list_distinct(list(service))), ',') AS services,
 arg_min(service, k) AS root_service, arg_min(name, k) AS root_name, arg_min(start_time_nanos, k) AS start_nanos, arg_min(duration_nanos, k) AS duration_nanos, arg_min(lines, k) AS root_lines
 FROM (SELECT *, (CASE WHEN parent_span_id IS NULL THEN '0' ELSE '1' END) || lpad(CAST(start_time_nanos AS VARCHAR), 20, '0') || span_id AS k FROM spans WHERE start_time_nanos BETWEEN {YS - v.HOUR} AND {YE + v.HOUR}
 AND trace_id IN (SELECT trace_id FROM spans WHERE status_code = 2 AND start_time_nanos BETWEEN {YS} AND {YE})) GROUP BY trace_id"""


@query("t9_trace_list", _spans(_ROLL))
def t9(spark, d):
    found = traces.trace_list(v.spans(spark, d), terms.span_filter(YS, YE, [terms.status(["error"])]), YS, YE, root_attributes=["lines"])
    return found.withColumn("services", F.array_join("services", ",")).withColumnRenamed("lines", "root_lines")


@query("t9_trace_list_slowest", _spans(f"SELECT trace_id, duration_nanos, error_count FROM ({_ROLL}) ORDER BY duration_nanos DESC NULLS LAST, start_nanos DESC, trace_id LIMIT 40 OFFSET 10"))
def t9s(spark, d):
    return traces.trace_list(v.spans(spark, d), terms.span_filter(YS, YE, [terms.status(["error"])]), YS, YE, "slowest", 10, 40).select("trace_id", "duration_nanos", "error_count")


@query("t9_trace_matched_count", _spans(f"SELECT count(DISTINCT trace_id) AS matched_count FROM spans WHERE status_code = 2 AND start_time_nanos BETWEEN {YS} AND {YE}"))
def t9c(spark, d):
    return traces.matched_traces(v.spans(spark, d), terms.span_filter(YS, YE, [terms.status(["error"])]))


@query("t10_trace_tree", _spans("""SELECT c.trace_id, c.span_id, CAST(floor(log2(c.nth)) AS BIGINT) AS depth, row_number() OVER (PARTITION BY c.trace_id ORDER BY bin(c.nth)) - 1 AS position, c.start_time_nanos - min(c.start_time_nanos) OVER (PARTITION BY c.trace_id) AS offset_nanos,
 coalesce(c.start_time_nanos < p.start_time_nanos OR c.end_time_nanos > p.end_time_nanos, false) AS clock_skew, EXISTS (SELECT 1 FROM nth k WHERE k.trace_id = c.trace_id AND k.status_code = 2 AND starts_with(bin(k.nth), bin(c.nth))) AS subtree_has_error
 FROM nth c LEFT JOIN spans p ON p.trace_id = c.trace_id AND p.span_id = c.parent_span_id""", nth="SELECT *, CAST(split_part(span_id, '-', 2) AS BIGINT) AS nth FROM spans"))
def t10(spark, d):
    """Span n of a trace hangs from span n / 2, so the binary digits of n are its path, and their order is pre-order."""
    return traces.trace_tree(v.spans(spark, d)).select("trace_id", "span_id", "depth", "position", "offset_nanos", "clock_skew", "subtree_has_error")


@query("t10_giant_traces", _spans("""SELECT trace_id, span_id, CAST(CASE WHEN parent_span_id IS NULL THEN 0 WHEN parent_span_id = 'root' THEN 1 ELSE 2 END AS BIGINT) AS depth, CAST(row_number() OVER (PARTITION BY trace_id ORDER BY top, top_id, r) - 1 AS BIGINT) AS position, subtree_has_error FROM placed""",
    tree="SELECT 'g' || (CAST(trace_id AS BIGINT) % 3) AS trace_id, span_id AS own, CASE WHEN parent_span_id IS NULL THEN trace_id ELSE span_id END AS span_id, CASE WHEN parent_span_id IS NULL THEN 'root' ELSE trace_id END AS parent_span_id, trace_id AS top_id, start_time_nanos AS began, status_code = 2 AS bad, CAST(split_part(span_id, '-', 2) AS BIGINT) AS nth FROM spans UNION ALL SELECT 'g' || k, '', 'root', NULL, '', 0, false, 0 FROM range(3) r(k)",
    placed="SELECT trace_id, span_id, parent_span_id, top_id, CASE WHEN parent_span_id IS NULL THEN 0 ELSE min(began) OVER (PARTITION BY trace_id, top_id) END AS top, CASE WHEN parent_span_id IS NULL OR parent_span_id = 'root' THEN 0 ELSE nth END AS r, CASE WHEN parent_span_id IS NULL THEN max(bad) OVER (PARTITION BY trace_id) WHEN parent_span_id = 'root' THEN max(bad) OVER (PARTITION BY trace_id, top_id) ELSE bad END AS subtree_has_error FROM tree"))
def t10g(spark, d):
    """All spans as three traces, each beyond what one task works on: a root, the first span of each order below it, and its others below that."""
    top = F.col("parent_span_id").isNull()
    rows = v.spans(spark, d).select(F.concat(F.lit("g"), F.col("trace_id").cast("long") % 3).alias("trace_id"), F.when(top, F.col("trace_id")).otherwise(F.col("span_id")).alias("span_id"), F.when(top, "root").otherwise(F.col("trace_id")).alias("parent_span_id"), "start_time_nanos", "end_time_nanos", "duration_nanos", "status_code")
    zero = F.lit(0).cast("long")
    roots = spark.range(3).select(F.concat(F.lit("g"), "id").alias("trace_id"), F.lit("root").alias("span_id"), F.lit(None).cast("string").alias("parent_span_id"), zero.alias("start_time_nanos"), zero.alias("end_time_nanos"), zero.alias("duration_nanos"), F.lit(0).alias("status_code"))
    return traces.trace_tree(rows.unionByName(roots), giant=1000).select("trace_id", "span_id", "depth", "position", "subtree_has_error")


_SELF = """SELECT s.trace_id, s.span_id, s.service, greatest(s.end_time_nanos - s.start_time_nanos - coalesce(c.covered, 0), 0) AS self_nanos FROM spans s LEFT JOIN
 (SELECT trace_id, span_id, CAST(sum(greatest(0, e - greatest(s, coalesce(r, s)))) AS BIGINT) AS covered FROM (SELECT *, max(e) OVER (PARTITION BY trace_id, span_id ORDER BY s, e, c_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM
  (SELECT p.trace_id, p.span_id, k.span_id AS c_id, greatest(k.start_time_nanos, p.start_time_nanos) AS s, least(k.end_time_nanos, p.end_time_nanos) AS e FROM spans k JOIN spans p ON k.trace_id = p.trace_id AND k.parent_span_id = p.span_id) WHERE e > s) GROUP BY 1, 2) c ON s.trace_id = c.trace_id AND s.span_id = c.span_id"""


@query("t11_self_time", _spans("SELECT trace_id, span_id, self_nanos FROM self", self=_SELF))
def t11(spark, d):
    return traces.self_time(v.spans(spark, d)).select("trace_id", "span_id", "self_nanos")


@query("t11_self_time_by_service", _spans("SELECT service, CAST(sum(self_nanos) AS BIGINT) AS self_nanos, count(*) AS spans FROM self GROUP BY service", self=_SELF))
def t11s(spark, d):
    return traces.self_time_by_service(v.spans(spark, d))


@query("t12_critical_path", f"""WITH RECURSIVE spans AS ({v.SPANS}), best AS (SELECT *, row_number() OVER (PARTITION BY trace_id, parent_span_id ORDER BY end_time_nanos DESC, start_time_nanos, span_id DESC) AS r FROM spans),
 w AS (SELECT trace_id, span_id, 0 AS depth FROM best WHERE parent_span_id IS NULL AND r = 1 UNION ALL SELECT b.trace_id, b.span_id, w.depth + 1 FROM best b JOIN w ON b.trace_id = w.trace_id AND b.parent_span_id = w.span_id WHERE b.r = 1) SELECT trace_id, span_id, depth FROM w""")
def t12(spark, d):
    return traces.critical_path(v.spans(spark, d))


@query("x1_logs_of_spans", v.sql("SELECT DISTINCT l.trace_id, body FROM logs l JOIN spans s ON l.trace_id = s.trace_id AND l.span_id = s.span_id WHERE s.status_code = 2", logs=v.LOGS, spans=v.SPANS))
def x1(spark, d):
    return traces.logs_of_spans(v.logs(spark, d), v.spans(spark, d).where(terms.status(["error"]))).select("trace_id", "body")


@query("x1_traces_of_logs", v.sql(f"SELECT span_id FROM spans WHERE trace_id IN (SELECT trace_id FROM logs WHERE {_ERR})", logs=v.LOGS, spans=v.SPANS))
def x1b(spark, d):
    return traces.traces_of_logs(v.spans(spark, d), v.logs(spark, d).where(terms.level(["error"]))).select("span_id")


# ---- RED and APM ---------------------------------------------------------------------------------------------

_T = apm.DEFAULT_APDEX_NANOS // 10
_THRESHOLD = f"(CASE service WHEN 'svc-1' THEN 20000000 WHEN 'svc-2' THEN 90000000 ELSE {apm.DEFAULT_APDEX_NANOS} END)"


def thresholds(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("svc-1", 20_000_000), ("svc-2", 90_000_000)], "service string, t_nanos long")


def red_sql(t: str = _THRESHOLD) -> str:
    disc = ", ".join(f"CAST(quantile_disc(duration_nanos, {q}) AS BIGINT) AS {n}" for q, n in ((0.5, "p50"), (0.9, "p90"), (0.99, "p99")))
    return f"count(*) AS count, count(*) FILTER (status_code = 2) AS errors, {disc}, count(*) FILTER (duration_nanos <= {t}) AS satisfied, count(*) FILTER (duration_nanos > {t} AND duration_nanos <= 4 * {t}) AS tolerating, count(*) FILTER (duration_nanos > 4 * {t}) AS frustrated"


_IN_YEAR = f"start_time_nanos BETWEEN {YS} AND {YE}"
_BY_SERVICE = f"SELECT service, tenant, {red_sql()} FROM spans WHERE {_IN_YEAR} GROUP BY service, tenant"
SECONDS = (YE - YS) / 1e9
_DERIVED = f"SELECT *, count / {SECONDS} AS rate, errors / count AS error_rate, (satisfied + tolerating / 2) / (satisfied + tolerating + frustrated) AS apdex FROM ({_BY_SERVICE})"
_STATUS = "CASE WHEN count = 0 THEN 'idle' WHEN error_rate >= 0.05 OR coalesce(apdex, 1) < 0.7 THEN 'critical' WHEN error_rate >= 0.01 OR coalesce(apdex, 1) < 0.85 THEN 'degraded' ELSE 'healthy' END"


def _services(spark: SparkSession, d: str) -> DataFrame:
    return apm.derived(apm.red_by_service(v.spans(spark, d), terms.span_filter(YS, YE), thresholds(spark), exact=True), SECONDS)


def red_operations(spark: SparkSession, d: str) -> DataFrame:
    return apm.derived(apm.red_by_operation(v.spans(spark, d), terms.span_filter(YS, YE), thresholds(spark), exact=True), SECONDS)


@query("a1_latency_percentiles", _spans("SELECT " + ", ".join(f"CAST(quantile_disc(duration_nanos, {q}) AS BIGINT) AS {n}" for q, n in ((0.5, "p50"), (0.9, "p90"), (0.99, "p99"))) + f" FROM spans WHERE {_IN_YEAR}"))
def a1(spark, d):
    return apm.latency_percentiles(v.spans(spark, d), terms.span_filter(YS, YE), exact=True)


@query("a2_latency_histogram", _spans(f"""SELECT CAST(b AS INT) AS bucket, CAST(round(lo * exp(b * ln(hi / lo) / 24)) AS BIGINT) AS start_nanos, coalesce(n, 0) AS count FROM ends, range(24) r(b) LEFT JOIN
 (SELECT greatest(least(CAST(floor(ln(greatest(duration_nanos, lo) / lo) / ln(hi / lo) * 24) AS INT), 23), 0) AS i, count(*) AS n FROM spans, ends WHERE {_IN_YEAR} GROUP BY 1) ON i = b""", ends=f"SELECT CAST(greatest(min(duration_nanos), 1) AS DOUBLE) AS lo, CAST(max(duration_nanos) AS DOUBLE) AS hi FROM spans WHERE {_IN_YEAR}"))
def a2(spark, d):
    return apm.latency_histogram(v.spans(spark, d), terms.span_filter(YS, YE), 24)


@query("a3_a5_a6_red_by_operation", _spans(f"SELECT *, count / {SECONDS} AS rate, errors / count AS error_rate, (satisfied + tolerating / 2) / (satisfied + tolerating + frustrated) AS apdex FROM (SELECT service, name AS operation, {red_sql()} FROM spans WHERE {_IN_YEAR} GROUP BY service, name)"))
def a3(spark, d):
    return red_operations(spark, d)


@query("a4_red_by_service", _spans(_BY_SERVICE))
def a4(spark, d):
    return apm.red_by_service(v.spans(spark, d), terms.span_filter(YS, YE), thresholds(spark), exact=True)


@query("a5_apdex_default", _spans(f"SELECT service, count(*) FILTER (duration_nanos <= {_T}) AS satisfied, count(*) FILTER (duration_nanos > {_T} AND duration_nanos <= {4 * _T}) AS tolerating, count(*) FILTER (duration_nanos > {4 * _T}) AS frustrated FROM spans GROUP BY service"))
def a5(spark, d):
    rows = apm.with_threshold(v.spans(spark, d), None, _T)
    return rows.groupBy("service").agg(*(F.count_if(c).alias(n) for n, c in (("satisfied", F.col("duration_nanos") <= F.col("_t")), ("tolerating", (F.col("duration_nanos") > F.col("_t")) & (F.col("duration_nanos") <= 4 * F.col("_t"))), ("frustrated", F.col("duration_nanos") > 4 * F.col("_t")))))


_SERIES_COLUMNS = "coalesce(count, 0) AS count, coalesce(errors, 0) AS errors, p50, p90, p99, coalesce(satisfied, 0) AS satisfied, coalesce(tolerating, 0) AS tolerating, coalesce(frustrated, 0) AS frustrated"


@query("a7_red_series", _spans(f"SELECT CAST(b AS INT) AS bucket, {YS} + b * {(YE - YS) // N} AS start_nanos, {_SERIES_COLUMNS} FROM range({N}) r(b) LEFT JOIN (SELECT {index_sql('start_time_nanos', YS, YE, N)} AS i, {red_sql()} FROM spans WHERE {_IN_YEAR} AND service = 'svc-1' GROUP BY 1) ON i = b"))
def a7(spark, d):
    return apm.red_series(v.spans(spark, d), terms.span_filter(YS, YE) & (quoted("service.name") == "svc-1"), YS, YE, N, thresholds(spark), exact=True)


@query("a7_red_series_by_service", _spans(f"SELECT s.service, CAST(b AS INT) AS bucket, {YS} + b * {(YE - YS) // N} AS start_nanos, {_SERIES_COLUMNS} FROM (SELECT DISTINCT service FROM spans WHERE {_IN_YEAR}) s CROSS JOIN range({N}) r(b) LEFT JOIN (SELECT service, {index_sql('start_time_nanos', YS, YE, N)} AS i, {red_sql()} FROM spans WHERE {_IN_YEAR} GROUP BY 1, 2) x ON i = b AND x.service = s.service"))
def a7b(spark, d):
    return apm.red_series(v.spans(spark, d), terms.span_filter(YS, YE), YS, YE, N, thresholds(spark), by_service=True, exact=True)


_DEPENDENCY = """SELECT service, CASE WHEN db_system IS NOT NULL THEN 'database' ELSE 'external' END AS kind, CASE WHEN db_system IS NOT NULL THEN db_system || '.' || db_name ELSE coalesce(server_address, peer_service) END AS name, status_code, duration_nanos FROM spans WHERE kind = 3"""


@query("a8_dependencies", _spans("SELECT service, kind, name, count(*) AS count, count(*) FILTER (status_code = 2) AS errors, " + ", ".join(f"CAST(quantile_disc(duration_nanos, {q}) AS BIGINT) AS {n}" for q, n in ((0.5, "p50"), (0.95, "p95"), (0.99, "p99"))) + f" FROM ({_DEPENDENCY}) WHERE name IS NOT NULL GROUP BY 1, 2, 3"))
def a8(spark, d):
    return apm.dependencies(v.spans(spark, d), F.lit(True), by_caller=True, exact=True)


@query("a9_health", _spans(f"SELECT service, tenant, {_STATUS} AS status, concat_ws(',', CASE WHEN count > 0 AND error_rate >= 0.01 THEN 'error_rate' END, CASE WHEN count > 0 AND coalesce(apdex, 1) < 0.85 THEN 'apdex' END) AS reasons FROM ({_DERIVED})"))
def a9(spark, d):
    return apm.health(_services(spark, d)).select("service", "tenant", "status", F.array_join("reasons", ",").alias("reasons"))


@query("a10_health_counts", _spans(f"SELECT {_STATUS} AS status, count(*) AS services FROM ({_DERIVED}) GROUP BY 1"))
def a10(spark, d):
    return apm.health_counts(apm.health(_services(spark, d)))


@query("a10_attention", _spans(f"SELECT service, tenant, status FROM (SELECT *, {_STATUS} AS status FROM ({_DERIVED})) WHERE status IN ('critical', 'degraded') ORDER BY CASE status WHEN 'critical' THEN 0 ELSE 1 END, error_rate DESC, apdex ASC NULLS LAST, rate DESC, service LIMIT 3"))
def a10b(spark, d):
    return apm.attention(apm.health(_services(spark, d))).select("service", "tenant", "status")


_KPI = f"SELECT start_time_nanos >= {YS} AS now, CAST(count(*) AS DOUBLE) AS requests, count(*) / {SECONDS} AS rate, count(*) FILTER (status_code = 2) / count(*) AS error_rate, CAST(quantile_disc(duration_nanos, 0.99) AS DOUBLE) AS p99 FROM spans WHERE start_time_nanos BETWEEN {2 * YS - YE} AND {YE} GROUP BY 1"


@query("a11_fleet_kpis", _spans("SELECT kpi, current, previous, CASE WHEN previous <> 0 THEN (current - previous) / previous END AS delta FROM (SELECT kpi, max(CASE WHEN now THEN value END) AS current, max(CASE WHEN NOT now THEN value END) AS previous FROM kpis UNPIVOT (value FOR kpi IN (requests, rate, error_rate, p99)) GROUP BY kpi)", kpis=_KPI))
def a11(spark, d):
    return apm.fleet_kpis(v.spans(spark, d), YS, YE, exact=True)


# ---- stored sketches -----------------------------------------------------------------------------------------

_WEEK = 7 * 24 * v.HOUR
_WEEKS = (YS // _WEEK * _WEEK + _WEEK, YS // _WEEK * _WEEK + 41 * _WEEK)
_ROLLED = f"SELECT service, name AS operation, count(*) AS count, count(*) FILTER (status_code = 2) AS errors, count(*) FILTER (duration_nanos <= {apm.DEFAULT_APDEX_NANOS}) AS satisfied, count(*) FILTER (duration_nanos > {apm.DEFAULT_APDEX_NANOS} AND duration_nanos <= {4 * apm.DEFAULT_APDEX_NANOS}) AS tolerating, true AS p50_near, true AS p90_near, true AS p99_near FROM spans WHERE start_time_nanos >= {_WEEKS[0]} AND start_time_nanos < {_WEEKS[1]} GROUP BY 1, 2"


@query("a3_red_from_rollup", _spans(_ROLLED))
def a3r(spark, d):
    """RED of forty weeks from a rollup of days, written and merged twice; each quantile's rank is held against the spans themselves."""
    spans = v.spans(spark, d)
    days = kept(rollups.span_rollup(spans, 24 * v.HOUR), "rollup")
    weeks = kept(rollups.coarser(days, ["service", "operation", "tenant"], _WEEK), "rollup")
    red = rollups.red_by_operation(weeks, *_WEEKS)
    own = spans.where((F.col("start_time_nanos") >= _WEEKS[0]) & (F.col("start_time_nanos") < _WEEKS[1])).select(quoted("service.name").alias("service"), F.col("name").alias("operation"), "duration_nanos")
    ranks = own.join(red, ["service", "operation"]).groupBy("service", "operation").agg(*(F.struct(F.avg((F.col("duration_nanos") < F.col(n)).cast("int")).alias("low"), F.avg((F.col("duration_nanos") <= F.col(n)).cast("int")).alias("high")).alias(f"_{n}") for n in rollups.POINTS))
    error = 2 * rollups.rank_error()
    near = [((F.col(f"_{n}.low") <= p + error) & (F.col(f"_{n}.high") >= p - error)).alias(f"{n}_near") for n, p in rollups.POINTS.items()]
    return red.join(ranks, ["service", "operation"]).select("service", "operation", "count", "errors", "satisfied", "tolerating", *near)
