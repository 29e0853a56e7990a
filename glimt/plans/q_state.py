"""Queries over alerts, uptime, usage, tenants and ingest, with their DuckDB twins, and streams over the given tables."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glimt.functions import terms
from glimt.functions.fields import quoted
from glimt.functions.storage import kept, shared_folder
from glimt.functions.terms import in_window
from glimt.operators import alerts, apm, uptime, usage
from glimt.plans import q_metrics, q_search
from glimt.plans import views as v
from glimt.plans.q_search import index_sql
from glimt.sources import ingest, tables
from glimt.streaming import live

S, E = v.MONTH
DAY = 24 * v.HOUR
QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return add


# ---- alerts --------------------------------------------------------------------------------------------------

NOW, WINDOW = S + 20 * DAY, 5 * DAY
_WIN = f"timestamp_nanos BETWEEN {NOW - WINDOW} AND {NOW}"


@query("e1_metric_sample", v.sql(f"SELECT 'service=' || service AS series_key, max(value) AS value FROM points WHERE metric_name = 'queue.depth' AND {_WIN} GROUP BY 1", points=v.POINTS))
def e1(spark, d):
    return alerts.metric_sample(v.points(spark, d), "queue.depth", NOW, WINDOW, "max", ["service"]).select("series_key", "value")


@query("e2_log_sample", v.sql(f"SELECT 'service=' || service AS series_key, CAST(count(*) AS DOUBLE) AS value FROM logs WHERE {_WIN} AND severity_number = 17 GROUP BY 1 UNION ALL SELECT '', CAST(count(*) AS DOUBLE) FROM logs WHERE {_WIN} AND severity_number BETWEEN 21 AND 24", logs=v.LOGS))
def e2(spark, d):
    df = v.logs(spark, d)
    return alerts.log_sample(df, NOW, WINDOW, [terms.level(["error"])], True).unionByName(alerts.log_sample(df, NOW, WINDOW, [terms.level(["fatal"])]))


_MANY = {f"{agg}-{name}-{days}": {"name": name, "agg": agg, "window": days * DAY, "labels": ["service"]} for name in ("queue.depth", "bytes.sent") for agg in ("avg", "max", "sum", "count") for days in (1, 2, 5, 9)}
_MANY |= {f"increase-{days}": {"name": "requests_total", "agg": "increase", "window": days * DAY, "labels": []} for days in (3, 7)}
_MANY_SQL = " UNION ALL ".join(
    [f"SELECT '{k}' AS rule_id, 'service=' || service AS series_key, CAST({r['agg']}(value) AS DOUBLE) AS value FROM points WHERE metric_name = '{r['name']}' AND timestamp_nanos BETWEEN {NOW - r['window']} AND {NOW} GROUP BY 2" for k, r in _MANY.items() if r["agg"] != "increase"]
    + [f"SELECT '{k}', '', CAST(sum(up) AS DOUBLE) FROM (SELECT {q_metrics._UP} AS up FROM points WHERE metric_name = 'requests_total' AND timestamp_nanos BETWEEN {NOW - r['window']} AND {NOW} WINDOW w AS (PARTITION BY \"user\" ORDER BY timestamp_nanos, value))" for k, r in _MANY.items() if r["agg"] == "increase"]
)


@query("e1_many_rules", v.sql(f"SELECT rule_id, series_key, round(value, 6) AS value FROM ({_MANY_SQL})", points=v.POINTS))
def e1m(spark, d):
    """Thirty-four rules of several metrics, windows and aggregations over one scan of the points."""
    return alerts.metric_samples(v.points(spark, d), _MANY, NOW).withColumn("value", F.round("value", 6))


@query("e2_many_rules", v.sql(" UNION ALL ".join(f"SELECT '{days}-{low}' AS rule_id, {key} AS series_key, CAST(count(*) AS DOUBLE) AS value FROM logs WHERE timestamp_nanos BETWEEN {NOW} - {days * DAY} AND {NOW} AND severity_number >= {low}{group}" for days in (1, 4, 9) for low, key, group in ((9, "'service=' || service", " GROUP BY 2"), (17, "''", ""), (21, "''", ""))), logs=v.LOGS))
def e2m(spark, d):
    rules = {f"{days}-{low}": {"window": days * DAY, "terms": [F.col("severity_number") >= low], "by_service": low == 9} for days in (1, 4, 9) for low in (9, 17, 21)}
    return alerts.log_samples(v.logs(spark, d), rules, NOW)


_TN, _TW = v.YEAR[1], v.YEAR[1] - v.YEAR[0]


@query("e3_trace_sample", v.sql(f"SELECT 'service=' || service || ',tenant=' || tenant AS series_key, count(*) FILTER (status_code = 2) * 100.0 / count(*) AS value FROM spans WHERE start_time_nanos BETWEEN {_TN - _TW} AND {_TN} GROUP BY 1", spans=v.SPANS))
def e3(spark, d):
    return alerts.trace_sample(v.spans(spark, d), _TN, _TW, "error_rate", exact=True).withColumn("value", F.col("value").cast("double"))


@query("e4_rum_sample", v.sql("SELECT '' AS series_key, quantile_disc(value, 0.75) AS value FROM vitals WHERE metric_name = 'web_vitals.lcp' AND route = '/pay' UNION ALL SELECT '', CAST((SELECT count(*) FROM errors) AS DOUBLE)", vitals=v.VITALS, errors=v.ERRORS))
def e4(spark, d):
    a = alerts.rum_sample(v.vitals(spark, d), None, in_window("metrics", S, E), "lcp", "/pay", exact=True)
    return a.unionByName(alerts.rum_sample(None, v.browser_errors(spark, d), in_window("logs", S, E), "errors"))


def rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("high", "gt", 4000.0, 7200, "critical", True), ("low", "lte", 400.0, 0, "warning", False)], "rule_id string, op string, threshold double, for_secs long, severity string, enabled boolean")


_RULES = "SELECT * FROM (VALUES ('high', 'gt', 4000.0::DOUBLE, 7200, 'critical', true), ('low', 'lte', 400.0::DOUBLE, 0, 'warning', false)) r(rule_id, op, threshold, for_secs, severity, enabled)"
_BREACH = "coalesce(CASE op WHEN 'gt' THEN value > threshold WHEN 'lte' THEN value <= threshold END, false)"


def samples(spark: SparkSession, d: str) -> DataFrame:
    """Hourly evaluations of both rules: each user's largest value of the hour; users without an event have none."""
    at = F.call_function("div", F.col("timestamp_nanos"), F.lit(v.HOUR)) * (v.HOUR // 1_000_000)
    rows = v.points(spark, d).where("metric_name = 'queue.depth'").groupBy(F.concat(F.lit("user="), F.col("attributes").getItem("user").cast("int") % 20).alias("series_key"), at.alias("at")).agg(F.max("value").alias("value"))
    return rows.select(F.explode(F.array(F.lit("high"), F.lit("low"))).alias("rule_id"), "series_key", "at", "value")


_SAMPLES = f"SELECT rule_id, series_key, \"at\", value FROM (SELECT 'user=' || CAST(CAST(\"user\" AS INT) % 20 AS VARCHAR) AS series_key, timestamp_nanos // {v.HOUR} * {v.HOUR // 1_000_000} AS \"at\", max(value) AS value FROM points WHERE metric_name = 'queue.depth' GROUP BY 1, 2) CROSS JOIN (VALUES ('high'), ('low')) x(rule_id)"


@query("e5_threshold_preview", v.sql(f"SELECT rule_id, series_key, \"at\", value, {_BREACH} AS breaching FROM s JOIN r USING (rule_id)", points=v.POINTS, s=_SAMPLES, r=_RULES))
def e5(spark, d):
    return alerts.preview(samples(spark, d), rules(spark)).select("rule_id", "series_key", "at", "value", "breaching")


_MACHINE = f"""SELECT *, CASE WHEN state = 'triggered' AND p <> 'triggered' THEN 'triggered' WHEN state = 'ok' AND p = 'triggered' THEN 'resolved' WHEN state = 'pending' AND p = 'ok' THEN 'pending' END AS transition FROM (SELECT *, coalesce(lag(state) OVER (PARTITION BY rule_id, series_key ORDER BY "at"), 'ok') AS p FROM
 (SELECT rule_id, series_key, "at", value, CASE WHEN NOT breach THEN 'ok' WHEN "at" - min(CASE WHEN breach THEN "at" END) OVER (PARTITION BY rule_id, series_key, run) >= for_secs * 1000 THEN 'triggered' ELSE 'pending' END AS state FROM
 (SELECT *, count(*) FILTER (NOT breach) OVER (PARTITION BY rule_id, series_key ORDER BY "at" ROWS UNBOUNDED PRECEDING) AS run FROM (SELECT rule_id, series_key, "at", value, for_secs, {_BREACH} AS breach FROM
 (SELECT e.rule_id, f.series_key, e."at", s.value FROM (SELECT DISTINCT rule_id, "at" FROM s) e JOIN (SELECT rule_id, series_key, min("at") AS a FROM s GROUP BY 1, 2) f ON e.rule_id = f.rule_id AND e."at" >= f.a LEFT JOIN s ON s.rule_id = e.rule_id AND s.series_key = f.series_key AND s."at" = e."at") JOIN r USING (rule_id)))))"""


def machine(spark: SparkSession, d: str) -> DataFrame:
    rows = samples(spark, d)
    return alerts.state_machine(rows, rows.select("rule_id", "at").distinct(), rules(spark))


@query("e6_alert_states", v.sql(f"SELECT rule_id, series_key, \"at\", value, state, transition FROM ({_MACHINE})", points=v.POINTS, s=_SAMPLES, r=_RULES))
def e6(spark, d):
    return machine(spark, d)


_INCIDENTS = f"SELECT rule_id, series_key, min(\"at\") AS started_at, min(CASE WHEN transition = 'resolved' THEN \"at\" END) AS ended_at, max(CASE WHEN state = 'triggered' THEN value END) AS peak_value FROM (SELECT *, count(*) FILTER (transition = 'triggered') OVER (PARTITION BY rule_id, series_key ORDER BY \"at\" ROWS UNBOUNDED PRECEDING) AS no FROM ({_MACHINE})) WHERE no > 0 GROUP BY rule_id, series_key, no"


@query("e7_alert_incidents", v.sql(f"SELECT i.*, severity FROM ({_INCIDENTS}) i JOIN r USING (rule_id)", points=v.POINTS, s=_SAMPLES, r=_RULES))
def e7(spark, d):
    return alerts.incidents(machine(spark, d), rules(spark))


@query("u8_alert_counts", v.sql(f"SELECT (SELECT count(*) FROM ({_INCIDENTS}) WHERE ended_at IS NULL) AS triggered, count(*) FILTER (enabled) AS active, count(*) FILTER (NOT enabled) AS paused FROM r", points=v.POINTS, s=_SAMPLES, r=_RULES))
def u8b(spark, d):
    return alerts.counts(alerts.incidents(machine(spark, d)), rules(spark))


@query("e3_many_rules", v.sql(" UNION ALL ".join(f"SELECT '{m}-{part}' AS rule_id, 'service=' || service || ',tenant=' || tenant AS series_key, round(CAST({x} AS DOUBLE), 6) AS value FROM spans WHERE start_time_nanos BETWEEN {v.YEAR[1]} - {(v.YEAR[1] - v.YEAR[0]) // part} AND {v.YEAR[1]} GROUP BY 2" for part in (1, 3) for m, x in (("error_rate", "count(*) FILTER (status_code = 2) * 100.0 / count(*)"), ("request_rate", f"count(*) / {(v.YEAR[1] - v.YEAR[0]) // part / 1e9}"), ("p90", "quantile_disc(duration_nanos, 0.9)"))), spans=v.SPANS))
def e3m(spark, d):
    rules = {f"{m}-{part}": {"window": (v.YEAR[1] - v.YEAR[0]) // part, "measure": m} for part in (1, 3) for m in ("error_rate", "request_rate", "p90")}
    return alerts.trace_samples(v.spans(spark, d), rules, v.YEAR[1], exact=True).withColumn("value", F.round("value", 6))


# ---- uptime --------------------------------------------------------------------------------------------------

_SINCE = (S + 23 * DAY) // 1000


def monitors(spark: SparkSession, d: str) -> DataFrame:
    seen = v.read(spark, d, "events").select(F.concat(F.lit("m"), "user_id").alias("monitor_id"), (F.col("user_id") % 5 != 0).alias("enabled")).distinct()
    return seen.unionByName(spark.createDataFrame([("never", True)], "monitor_id string, enabled boolean"))


_MONITORS = "SELECT DISTINCT 'm' || user_id AS monitor_id, user_id % 5 <> 0 AS enabled FROM events UNION ALL SELECT 'never', true"


@query("u1_uptime", v.sql(f"SELECT m.monitor_id, coalesce(beats, 0) AS beats, coalesce(uptime_pct, 100.0) AS uptime_pct FROM m LEFT JOIN (SELECT monitor_id, count(*) AS beats, CAST(count(*) FILTER (ok) * 100.0 / count(*) AS DOUBLE) AS uptime_pct FROM beats WHERE ts >= {_SINCE} GROUP BY 1) b USING (monitor_id)", beats=v.BEATS, m=_MONITORS))
def u1(spark, d):
    return uptime.availability(v.heartbeats(spark, d), monitors(spark, d), _SINCE).withColumn("uptime_pct", F.col("uptime_pct").cast("double"))


_STATES = """SELECT *, CASE WHEN state = 'down' AND p <> 'down' THEN 'went_down' WHEN state = 'up' AND p = 'down' THEN 'recovered' WHEN state = 'up' AND p = 'pending' THEN 'went_up' END AS transition FROM (SELECT *, coalesce(lag(state) OVER (PARTITION BY monitor_id ORDER BY ts), 'pending') AS p FROM
 (SELECT *, coalesce(last_value(st IGNORE NULLS) OVER (PARTITION BY monitor_id ORDER BY ts ROWS UNBOUNDED PRECEDING), 'pending') AS state FROM (SELECT *, CASE WHEN ok THEN 'up' WHEN sum(CASE WHEN ok THEN 0 ELSE 1 END) OVER (PARTITION BY monitor_id, run ORDER BY ts) >= 2 THEN 'down' END AS st FROM
 (SELECT *, count(*) FILTER (ok) OVER (PARTITION BY monitor_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS run FROM beats))))"""


@query("u2_uptime_states", v.sql(f"SELECT monitor_id, ts, state, transition FROM ({_STATES})", beats=v.BEATS))
def u2(spark, d):
    return uptime.states(v.heartbeats(spark, d), 2).select("monitor_id", "ts", "state", "transition")


_DOWN = f"SELECT monitor_id, ts AS started_at, ended_at, coalesce(error, 'down') AS cause FROM (SELECT *, lead(ts) OVER (PARTITION BY monitor_id ORDER BY ts) AS ended_at FROM ({_STATES}) WHERE transition IN ('went_down', 'recovered')) WHERE transition = 'went_down'"


@query("u3_incidents", v.sql(f"{_DOWN} ORDER BY started_at DESC, monitor_id LIMIT 100", beats=v.BEATS))
def u3(spark, d):
    return uptime.incidents(v.heartbeats(spark, d), 2, 100)


@query("u4_incident_bridge", v.sql(f"SELECT 'uptime:' || monitor_id AS rule_id, '' AS series_key, started_at, ended_at, 'critical' AS severity, cause AS summary FROM ({_DOWN})", beats=v.BEATS))
def u4(spark, d):
    return uptime.as_alert_incidents(uptime.incidents(v.heartbeats(spark, d), 2))


@query("u5_uptime_statistics", v.sql(f"SELECT (SELECT count(*) FROM beats WHERE ts >= {_SINCE}) AS heartbeats, count(*) AS incidents, count(*) FILTER (ended_at IS NULL) AS open_incidents FROM ({_DOWN}) WHERE ended_at IS NULL OR ended_at >= {_SINCE}", beats=v.BEATS))
def u5(spark, d):
    beats = v.heartbeats(spark, d)
    return uptime.statistics(uptime.pruned(beats, _SINCE), uptime.pruned_incidents(uptime.incidents(beats, 2), _SINCE))


@query("u6_response_times", v.sql("SELECT monitor_id, min(latency_ms) AS min_ms, avg(latency_ms) AS avg_ms, max(latency_ms) AS max_ms, max(latency_ms) FILTER (r = least(n * 95 // 100, n - 1)) AS p95_ms FROM (SELECT *, count(*) OVER (PARTITION BY monitor_id) AS n, row_number() OVER (PARTITION BY monitor_id ORDER BY latency_ms, ts) - 1 AS r FROM beats WHERE ok) GROUP BY 1", beats=v.BEATS))
def u6(spark, d):
    return uptime.response_times(v.heartbeats(spark, d))


@query("u7_outage_bands", v.sql("""SELECT monitor_id, coalesce((b + f) // 2, f) AS start, coalesce((t + a) // 2, t) AS "end", beats FROM (SELECT monitor_id, run, min(ts) AS f, max(ts) AS t, arg_min(bef, ts) AS b, CASE WHEN count(aft) < count(*) THEN NULL ELSE arg_max(aft, ts) END AS a, count(*) AS beats FROM
 (SELECT *, lag(ts) OVER w AS bef, lead(ts) OVER w AS aft, count(*) FILTER (ok) OVER (PARTITION BY monitor_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS run FROM beats WINDOW w AS (PARTITION BY monitor_id ORDER BY ts)) WHERE NOT ok GROUP BY 1, 2)""", beats=v.BEATS))
def u7(spark, d):
    return uptime.outage_bands(v.heartbeats(spark, d))


@query("u8_monitor_counts", v.sql(f"SELECT count(*) FILTER (enabled AND state = 'up') AS up, count(*) FILTER (enabled AND state = 'down') AS down, count(*) FILTER (NOT enabled) AS paused, count(*) AS total FROM m LEFT JOIN (SELECT monitor_id, arg_max(state, ts) AS state FROM ({_STATES}) GROUP BY 1) USING (monitor_id)", beats=v.BEATS, m=_MONITORS))
def u8(spark, d):
    return uptime.monitor_counts(uptime.latest_states(v.heartbeats(spark, d), 2), monitors(spark, d))


@query("a12_overview", v.sql(f"""SELECT round(sum(rate), 12) AS rate, round(sum(rate * error_rate) / sum(rate), 9) AS error_rate, max(p99) AS worst_p99, (SELECT max(p75) FROM (SELECT app, quantile_disc(value, 0.75) AS p75 FROM vitals WHERE metric_name = 'web_vitals.lcp' GROUP BY app)) AS lcp_p75,
 (SELECT count(*) FILTER (state = 'up') FROM last) AS monitors_up, (SELECT count(*) FROM last) AS monitors FROM svc""", spans=v.SPANS, svc=q_search._DERIVED, vitals=v.VITALS, beats=v.BEATS, last=f"SELECT monitor_id, arg_max(state, ts) AS state FROM ({_STATES}) GROUP BY 1"))
def a12(spark, d):
    found = apm.overview(q_search._services(spark, d), q_metrics._vsum(spark, d), uptime.latest_states(v.heartbeats(spark, d), 2))
    return found.select(F.round("rate", 12).alias("rate"), F.round("error_rate", 9).alias("error_rate"), "worst_p99", "lcp_p75", "monitors_up", "monitors")


# ---- usage and tenants ---------------------------------------------------------------------------------------

N = 60


def usage_samples(spark: SparkSession, d: str) -> DataFrame:
    """Samples of three signals from the events: levels from the id, a counter that restarts after 500 samples of a signal."""
    rows = v.read(spark, d, "events").withColumn("signal", F.element_at(F.array(*map(F.lit, ("logs", "spans", "metrics"))), (F.col("event_id") % 3 + 1).cast("int")))
    nth = (F.row_number().over(Window.partitionBy("signal").orderBy("ts", "event_id")) - 1).cast("long")
    ms = F.call_function("div", v.nanos("ts"), F.lit(1_000_000))
    return rows.select(ms.alias("ts_ms"), "signal", (F.col("event_id") * 7).alias("hot_bytes"), (F.col("event_id") * 100).alias("durable_bytes"), F.col("event_id").alias("total_rows"), (nth % 500 * 10).alias("ingest_rows"))


_USAGE = "SELECT epoch_us(ts) // 1000 AS ts_ms, CASE event_id % 3 WHEN 0 THEN 'logs' WHEN 1 THEN 'spans' ELSE 'metrics' END AS signal, event_id * 7 AS hot_bytes, event_id * 100 AS durable_bytes, event_id AS total_rows, (row_number() OVER (PARTITION BY event_id % 3 ORDER BY ts, event_id) - 1) % 500 * 10 AS ingest_rows FROM events"
_SMS, _EMS = S // 1_000_000, E // 1_000_000
_USERIES = f"""SELECT signal, CAST(b AS INT) AS bucket, hot_bytes, durable_bytes, total_rows, CASE WHEN ingest_rows >= lag(ingest_rows) OVER w THEN ingest_rows - lag(ingest_rows) OVER w END AS ingested, {_SMS} + (b + 1) * {(_EMS - _SMS) // N} AS ts FROM
 (SELECT signal, {index_sql('ts_ms', _SMS, _EMS, N)} AS b, arg_max(hot_bytes, ts_ms) AS hot_bytes, arg_max(durable_bytes, ts_ms) AS durable_bytes, arg_max(total_rows, ts_ms) AS total_rows, arg_max(ingest_rows, ts_ms) AS ingest_rows FROM usage GROUP BY 1, 2) WINDOW w AS (PARTITION BY signal ORDER BY b)"""


@query("d1_usage_series", v.sql(_USERIES, usage=_USAGE))
def d1(spark, d):
    return usage.usage_series(usage_samples(spark, d), _SMS, _EMS, N)


@query("d3_durable_bytes", "SELECT CASE event_id % 4 WHEN 0 THEN 'logs' WHEN 1 THEN 'spans' ELSE 'metrics' END AS signal, CAST(sum(event_id) AS BIGINT) AS bytes, count(*) AS files FROM events WHERE event_id % 4 < 3 GROUP BY 1")
def d3(spark, d):
    path = F.concat(F.element_at(F.array(*map(F.lit, ("data/", "data-spans/", "data-metrics/", "other/"))), (F.col("event_id") % 4 + 1).cast("int")), F.col("event_id"), F.lit(".parquet"))
    return usage.durable_bytes(v.read(spark, d, "events").select(path.alias("path"), F.col("event_id").alias("bytes")))


@query("d4_composition", v.sql("SELECT signal, bytes, round(bytes * 100.0 / sum(bytes) OVER (), 9) AS share_pct FROM (SELECT signal, max(durable_bytes) AS bytes FROM usage GROUP BY 1) WHERE bytes > 0", usage=_USAGE))
def d4(spark, d):
    levels = usage_samples(spark, d).groupBy("signal").agg(F.max("durable_bytes").alias("bytes"))
    return usage.composition(levels).withColumn("share_pct", F.round(F.col("share_pct").cast("double"), 9))


@query("d4_current_rate", v.sql(f"SELECT sum(d) / {(_EMS - _SMS) // N / 1000} AS rows_per_second FROM (SELECT signal, arg_max(ingested, bucket) AS d FROM s WHERE ingested IS NOT NULL GROUP BY 1)", usage=_USAGE, s=_USERIES))
def d4b(spark, d):
    return usage.current_rate(usage.usage_series(usage_samples(spark, d), _SMS, _EMS, N), (_EMS - _SMS) // N / 1000)


def tenant_points(spark: SparkSession, d: str) -> DataFrame:
    kind = F.col("event_type")
    name = F.when(kind == "view", "tenant.up").when(kind == "click", "tenant.hot.bytes").when(kind == "purchase", "tenant.incidents.open").otherwise("tenant.ingest.rows")
    value = F.when(name == "tenant.ingest.rows", F.col("event_id")).otherwise(F.col("user_id")).cast("double")
    return v.read(spark, d, "events").select(name.alias("metric_name"), v.nanos("ts").alias("timestamp_nanos"), value.alias("value"), F.concat(F.lit("t"), F.col("user_id") % 6).alias("tenant"), v.attributes(mode=F.when(F.col("user_id") % 2 == 0, "agent").otherwise("full")).alias("attributes"))


@query("n1_tenant_summary", v.sql(f"""SELECT h.tenant, last_seen, mode, hot_bytes, open_incidents, CASE WHEN ({E} - last_seen) / 1e9 <= 120 THEN 'up' WHEN ({E} - last_seen) / 1e9 <= 600 THEN 'stale' ELSE 'down' END AS status, rows_per_second, points, line FROM
 (SELECT tenant, max(t) FILTER (m = 'tenant.up') AS last_seen, arg_max(mode, t) FILTER (m = 'tenant.up') AS mode, arg_max(val, t) FILTER (m = 'tenant.hot.bytes') AS hot_bytes, arg_max(val, t) FILTER (m = 'tenant.incidents.open') AS open_incidents FROM p GROUP BY 1) h
 LEFT JOIN (SELECT tenant, greatest((arg_max(v, b) - arg_min(v, b)) / ((max(t) - min(t)) / 1e9), 0) AS rows_per_second, count(r) AS points, round(sum(r * i), 6) AS line FROM (SELECT *, greatest((v - lag(v) OVER w) / ((t - lag(t) OVER w) / 1e9), 0) AS r, row_number() OVER w - 1 AS i FROM (SELECT tenant, {index_sql('t', S, E, 30)} AS b, arg_max(val, t) AS v, max(t) AS t FROM p WHERE m = 'tenant.ingest.rows' GROUP BY 1, 2) WINDOW w AS (PARTITION BY tenant ORDER BY b)) GROUP BY 1) USING (tenant)""",
    p="SELECT epoch_us(ts) * 1000 AS t, CASE event_type WHEN 'view' THEN 'tenant.up' WHEN 'click' THEN 'tenant.hot.bytes' WHEN 'purchase' THEN 'tenant.incidents.open' ELSE 'tenant.ingest.rows' END AS m, CAST(CASE WHEN event_type IN ('view', 'click', 'purchase') THEN user_id ELSE event_id END AS DOUBLE) AS val, 't' || (user_id % 6) AS tenant, CASE WHEN user_id % 2 = 0 THEN 'agent' ELSE 'full' END AS mode FROM events"))
def n1(spark, d):
    found = usage.tenant_summary(tenant_points(spark, d), E, E - S)
    weighed = F.aggregate(F.transform("sparkline", lambda x, i: x * i), F.lit(0.0), lambda a, x: a + x)  # tells lines of another order apart
    return found.withColumns({"points": F.size("sparkline").cast("long"), "line": F.round(weighed, 6)}).drop("sparkline")


_N2 = "WITH l AS (SELECT 't' || (user_id % 6) AS tenant, count(*) AS rows, sum(event_id) AS bytes, max(event_id) AS hot, max(user_id) AS open FROM events GROUP BY 1) " + " UNION ALL ".join(f"SELECT '{n}' AS metric_name, CAST({c} AS DOUBLE) AS value, tenant, {2 if 'ingest' in n else 'NULL'} AS temporality FROM l" for n, c in (("tenant.up", "1"), ("tenant.ingest.rows", "rows"), ("tenant.ingest.bytes", "bytes"), ("tenant.hot.bytes", "hot"), ("tenant.incidents.open", "open")))


@query("n2_tenant_points", _N2)
def n2(spark, d):
    levels = v.read(spark, d, "events").groupBy(F.concat(F.lit("t"), F.col("user_id") % 6).alias("tenant"), F.col("event_type").alias("signal")).agg(F.count(F.lit(1)).alias("rows"), F.sum("event_id").alias("bytes"), F.max("event_id").alias("hot_bytes"), F.max("user_id").alias("open_incidents"))
    return usage.tenant_health_points(levels, E).select("metric_name", "value", "tenant", "temporality")


# ---- ingest --------------------------------------------------------------------------------------------------


#: What one OTLP document holds at most, whatever the input's size: events' ids, orders, and days of a supplier.
BATCH_EVENTS, BATCH_TRACES, BATCH_DAYS = 5_000, 500, 100


def _typed(**values):
    """An OTLP attribute list."""
    return F.array(*(F.struct(F.lit(k.replace("__", ".")).alias("key"), F.struct(value.alias("stringValue")).alias("value")) for k, value in values.items()))


def raw_logs(spark: SparkSession, d: str) -> DataFrame:
    """The log view as OTLP JSON, a batch for each host and service of BATCH_EVENTS events' ids; the host is an attribute of the resource."""
    rows = v.logs(spark, d).select("*", F.col("`service.name`").alias("svc"), F.col("`host.name`").alias("host"))
    record = F.struct(F.col("timestamp_nanos").cast("string").alias("timeUnixNano"), F.col("severity_number").alias("severityNumber"), F.coalesce("severity_text", F.lit("")).alias("severityText"), F.struct(F.col("body").alias("stringValue")).alias("body"), F.col("trace_id").alias("traceId"), F.col("span_id").alias("spanId"), _typed(user__id=F.col("attributes").getItem("user.id"), host__name=F.col("host")).alias("attributes"))
    part = F.call_function("div", F.col("trace_id").cast("long"), F.lit(BATCH_EVENTS))
    grouped = rows.groupBy("svc", "host", part.alias("part")).agg(F.collect_list(record).alias("logRecords"))
    scope = F.array(F.struct(F.struct(F.lit("app").alias("name")).alias("scope"), "logRecords"))
    batch = F.struct(F.array(F.struct(F.struct(_typed(service__name=F.col("svc"), host__name=F.lit("other")).alias("attributes")).alias("resource"), scope.alias("scopeLogs"))).alias("resourceLogs"))
    return grouped.select(F.to_json(batch).alias("value"))


@query("s3_otlp_logs", v.sql("SELECT timestamp_nanos, severity_number, severity_text, body, trace_id, span_id, 'app' AS scope_name, service, host, user_id FROM logs", logs=v.LOGS))
def s3(spark, d):
    rows = ingest.otlp_logs(raw_logs(spark, d))
    return rows.select("timestamp_nanos", "severity_number", "severity_text", "body", "trace_id", "span_id", "scope_name", quoted("service.name").alias("service"), quoted("host.name").alias("host"), F.col("attributes").getItem("user.id").alias("user_id"))


def raw_traces(spark: SparkSession, d: str) -> DataFrame:
    """The span view as OTLP JSON, a batch for each service of BATCH_TRACES orders. Spans in error have an event, inner ones a link to their parent."""
    rows = v.spans(spark, d).select("*", F.col("`service.name`").alias("svc"))
    event = F.struct(F.lit("exception").alias("name"), F.col("end_time_nanos").cast("string").alias("timeUnixNano"), _typed(exception__type=F.col("name")).alias("attributes"))
    link = F.struct(F.upper("trace_id").alias("traceId"), F.upper("parent_span_id").alias("spanId"), _typed(kind=F.lit("parent")).alias("attributes"))
    span = F.struct(F.col("trace_id").alias("traceId"), F.col("span_id").alias("spanId"), F.coalesce("parent_span_id", F.lit("")).alias("parentSpanId"), "name", "kind", F.col("start_time_nanos").cast("string").alias("startTimeUnixNano"), F.col("end_time_nanos").cast("string").alias("endTimeUnixNano"), F.struct(F.col("status_code").alias("code")).alias("status"), _typed(lines=F.col("attributes").getItem("lines")).alias("attributes"), F.when(F.col("status_code") == 2, F.array(event)).alias("events"), F.when(F.col("parent_span_id").isNotNull(), F.array(link)).alias("links"))
    part = F.call_function("div", F.col("trace_id").cast("long"), F.lit(BATCH_TRACES))
    grouped = rows.groupBy("svc", part.alias("part")).agg(F.collect_list(span).alias("spans"))
    batch = F.struct(F.array(F.struct(F.struct(_typed(service__name=F.col("svc")).alias("attributes")).alias("resource"), F.array(F.struct("spans")).alias("scopeSpans"))).alias("resourceSpans"))
    return grouped.select(F.to_json(batch).alias("value"))


@query("s4_otlp_traces", v.sql("SELECT trace_id, span_id, parent_span_id, name, kind, start_time_nanos, duration_nanos, status_code, CASE status_code WHEN 2 THEN 'ERROR' WHEN 1 THEN 'OK' ELSE 'UNSET' END AS status_text, service, lines FROM spans", spans=v.SPANS))
def s4(spark, d):
    out = ingest.otlp_traces(raw_traces(spark, d))
    return out.select("trace_id", "span_id", "parent_span_id", "name", "kind", "start_time_nanos", "duration_nanos", "status_code", "status_text", quoted("service.name").alias("service"), F.col("attributes").getItem("lines").alias("lines"))


@query("s4_span_events", v.sql("SELECT trace_id, span_id, 'event' AS what, 'exception' AS name, end_time_nanos AS at, name AS attribute FROM spans WHERE status_code = 2 UNION ALL SELECT trace_id, span_id, 'link', trace_id || '/' || parent_span_id, NULL, 'parent' FROM spans WHERE parent_span_id IS NOT NULL", spans=v.SPANS))
def s4e(spark, d):
    out = ingest.otlp_traces(raw_traces(spark, d))
    events = out.select("trace_id", "span_id", F.lit("event").alias("what"), F.explode("events").alias("e")).select("trace_id", "span_id", "what", "e.name", F.col("e.time_unix_nano").alias("at"), F.col("e.attributes").getItem("exception.type").alias("attribute"))
    links = out.select("trace_id", "span_id", F.lit("link").alias("what"), F.explode("links").alias("e"))
    return events.unionByName(links.select("trace_id", "span_id", "what", F.concat_ws("/", "e.trace_id", "e.span_id").alias("name"), F.lit(None).cast("long").alias("at"), F.col("e.attributes").getItem("kind").alias("attribute")))


@query("s5_otlp_metrics", v.sql("SELECT metric_name, metric_type, temporality, is_monotonic, timestamp_nanos, value, service FROM points", points=v.POINTS))
def s5(spark, d):
    rows = v.points(spark, d).select("*", F.col("`service.name`").alias("svc"))
    point = F.struct(F.col("timestamp_nanos").cast("string").alias("timeUnixNano"), F.col("value").cast("long").cast("string").alias("asInt"))
    parts = max(64, v.read(spark, d, "events").count() // BATCH_EVENTS)  # the count is in the footers
    part = F.pmod(F.xxhash64("timestamp_nanos", F.col("attributes").getItem("user")), F.lit(parts))
    grouped = rows.groupBy("svc", "metric_name", "metric_type", "temporality", "is_monotonic", part.alias("part")).agg(F.collect_list(point).alias("dataPoints"))
    metric = F.struct(F.col("metric_name").alias("name"), F.when(F.col("metric_type") == 0, F.struct("dataPoints")).alias("gauge"), F.when(F.col("metric_type") == 1, F.struct(F.col("temporality").alias("aggregationTemporality"), F.col("is_monotonic").alias("isMonotonic"), "dataPoints")).alias("sum"))
    batch = F.struct(F.array(F.struct(F.struct(_typed(service__name=F.col("svc")).alias("attributes")).alias("resource"), F.array(F.struct(F.array(metric).alias("metrics"))).alias("scopeMetrics"))).alias("resourceMetrics"))
    out = ingest.otlp_metrics(grouped.select(F.to_json(batch).alias("value")))
    return out.select("metric_name", "metric_type", "temporality", "is_monotonic", "timestamp_nanos", "value", quoted("service.name").alias("service"))


_ORDER_TIME = "epoch_us(l_shipdate) * 1000"


@query("s5_otlp_distributions", f"""WITH h AS (SELECT l_suppkey AS k, {_ORDER_TIME} AS t, count(*) AS n, CAST(sum(l_quantity) AS DOUBLE) AS s, count(*) FILTER (l_quantity <= 10) AS c0, count(*) FILTER (l_quantity > 10 AND l_quantity <= 30) AS c1, count(*) FILTER (l_quantity > 30) AS c2, min(l_quantity) AS lo, max(l_quantity) AS hi FROM lineitem GROUP BY 1, 2)
 SELECT 'line.quantity' AS metric_name, 2 AS metric_type, 1 AS temporality, k AS supplier, t AS timestamp_nanos, n AS count, s AS sum, c0 || ',' || c1 || ',' || c2 AS buckets, '10.0,30.0' AS layout, lo AS low, hi AS high FROM h
 UNION ALL SELECT 'line.spread', 3, 2, k, t, n, s, c1 || ',' || c2, '2/' || c0 || '/3', lo, hi FROM h UNION ALL SELECT 'line.summary', 4, NULL, k, t, n, s, lo || ',' || hi, '0.0,1.0', NULL, NULL FROM h""")
def s5d(spark, d):
    """Histogram, exponential and summary points through the mapping, two metrics' worth of each batch in one."""
    q = F.col("l_quantity")
    rows = v.read(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("k"), v.nanos("l_shipdate").alias("t")).agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").cast("double").alias("s"), F.count_if(q <= 10).alias("c0"), F.count_if((q > 10) & (q <= 30)).alias("c1"), F.count_if(q > 30).alias("c2"), F.min(q).cast("double").alias("lo"), F.max(q).cast("double").alias("hi"))
    text = lambda *names: F.array(*(F.col(c).cast("string") for c in names))
    base = [F.col("t").cast("string").alias("timeUnixNano"), _typed(supplier=F.col("k").cast("string")).alias("attributes"), F.col("n").cast("string").alias("count"), F.col("s").alias("sum")]
    ends = [F.col("lo").alias("min"), F.col("hi").alias("max")]
    plain = F.struct(*base, text("c0", "c1", "c2").alias("bucketCounts"), F.array(F.lit(10.0), F.lit(30.0)).alias("explicitBounds"), *ends)
    spread = F.struct(*base, F.lit(2).alias("scale"), F.col("c0").cast("string").alias("zeroCount"), F.struct(F.lit(3).alias("offset"), text("c1", "c2").alias("bucketCounts")).alias("positive"), *ends)
    summary = F.struct(*base, F.array(F.struct(F.lit(0.0).alias("quantile"), F.col("lo").alias("value")), F.struct(F.lit(1.0).alias("quantile"), F.col("hi").alias("value"))).alias("quantileValues"))
    # a batch: a supplier's points of BATCH_DAYS days, so no document grows with the input
    grouped = rows.groupBy("k", F.call_function("div", "t", F.lit(BATCH_DAYS * DAY)).alias("part")).agg(F.collect_list(plain).alias("a"), F.collect_list(spread).alias("b"), F.collect_list(summary).alias("c"))
    kinds = (("line.quantity", "histogram", "a", 1), ("line.spread", "exponentialHistogram", "b", 2), ("line.summary", "summary", "c", None))
    # a metric has the data of one kind; the others are absent
    metric = lambda name, kind, *_: F.struct(F.lit(name).alias("name"), *((F.struct(F.lit(t).alias("aggregationTemporality"), F.col(c).alias("dataPoints")) if k == kind else F.lit(None).cast(f"struct<aggregationTemporality:int,dataPoints:{dict(grouped.dtypes)[c]}>")).alias(k) for _, k, c, t in kinds))
    batch = F.struct(F.array(F.struct(F.array(F.struct(F.array(*(metric(*x) for x in kinds)).alias("metrics"))).alias("scopeMetrics"))).alias("resourceMetrics"))
    out = ingest.otlp_metrics(grouped.select(F.to_json(batch).alias("value")))
    h, e, u = F.col("histogram"), F.col("exp_histogram"), F.col("summary")
    joined = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
    return out.select(
        "metric_name", "metric_type", "temporality", F.col("attributes").getItem("supplier").cast("long").alias("supplier"), "timestamp_nanos", F.coalesce(h["count"], e["count"], u["count"]).alias("count"), F.coalesce(h["sum"], e["sum"], u["sum"]).alias("sum"),
        F.coalesce(joined(h["bucket_counts"]), joined(e["positive"]["bucket_counts"]), joined(F.transform(u["quantiles"], lambda x: x["value"]))).alias("buckets"),
        F.coalesce(joined(h["explicit_bounds"]), F.when(e.isNotNull(), F.concat_ws("/", e["scale"], e["zero_count"], e["positive"]["offset"])), joined(F.transform(u["quantiles"], lambda x: x["quantile"]))).alias("layout"), F.coalesce(h["min"], e["min"]).alias("low"), F.coalesce(h["max"], e["max"]).alias("high"))


@query("s6_remote_write", "SELECT 'events_total' AS metric_name, 1 AS metric_type, 2 AS temporality, true AS is_monotonic, epoch_us(ts) // 1000 * 1000000 AS timestamp_nanos, CAST(event_id AS DOUBLE) AS value, 'svc-' || (user_id % 10) AS service, event_type AS kind FROM events WHERE event_type <> 'view'")
def s6(spark, d):
    name = F.when(F.col("event_type") != "view", "events_total")
    labels = F.map_filter(F.create_map(F.lit("__name__"), name, F.lit("job"), F.concat(F.lit("svc-"), F.col("user_id") % 10), F.lit("kind"), F.col("event_type")), lambda _, x: x.isNotNull())
    sample = F.struct(F.call_function("div", v.nanos("ts"), F.lit(1_000_000)).alias("timestamp"), F.col("event_id").cast("double").alias("value"))
    out = ingest.remote_write(v.read(spark, d, "events").select(labels.alias("labels"), F.array(sample).alias("samples")))
    return out.select("metric_name", "metric_type", "temporality", "is_monotonic", "timestamp_nanos", "value", quoted("service.name").alias("service"), F.col("attributes").getItem("kind").alias("kind"))


_UAS = ("Mozilla iPhone Safari", "Mozilla Windows Chrome Edg", "Mozilla X11 Firefox", "Mozilla iPad Safari", "curl")


def raw_beacons(spark: SparkSession, d: str) -> DataFrame:
    user, cents = F.col("user_id"), F.round(F.col("value") * 100)
    view = F.struct(F.lit("v").alias("id"), F.lit("/r").alias("route"), F.when(F.col("event_id") % 2 == 0, cents).alias("dur"))
    vital = F.struct(F.lit("LCP").alias("n"), cents.alias("v"), F.struct(F.lit("img").alias("element"), (cents / 2).alias("ttfb")).alias("attr"))
    error = F.struct(F.lit("error").alias("kind"), F.lit("TypeError").alias("type"), F.concat(F.lit("bad chunk "), F.col("event_id")).alias("msg"), F.lit("app.js").alias("src"), (user % 3).alias("line"))
    ua = F.element_at(F.array(*map(F.lit, _UAS)), (user % 5 + 1).cast("int"))
    beacon = F.struct(F.concat(F.lit("app"), user % 3).alias("app"), F.concat(F.lit("key"), user % 3).alias("key"), (user % 40).cast("string").alias("session"), view.alias("view"), F.struct(ua.alias("ua")).alias("ctx"), F.md5(F.col("event_id").cast("string")).alias("trace"), F.array(vital).alias("vitals"), F.when(F.col("event_type") == "error", F.array(error)).otherwise(F.array().cast("array<struct<kind:string,type:string,msg:string,src:string,line:bigint>>")).alias("errors"))
    return v.read(spark, d, "events").select(F.to_json(beacon).alias("value"), v.nanos("ts").alias("received_nanos"), F.concat(F.lit("https://o"), user % 4).alias("origin"))


_DEVICE = "CASE user_id % 5 WHEN 0 THEN 'mobile' WHEN 3 THEN 'tablet' ELSE 'desktop' END"
_BROWSER = "CASE user_id % 5 WHEN 0 THEN 'Safari' WHEN 1 THEN 'Edge' WHEN 2 THEN 'Firefox' WHEN 3 THEN 'Safari' ELSE 'Other' END"


@query("s7_beacon_vitals", f"""SELECT epoch_us(ts) * 1000 AS timestamp_nanos, n AS metric_name, CASE n WHEN 'web_vitals.lcp.ttfb' THEN round(value * 100) / 2 ELSE round(value * 100) END AS value, 'app' || (user_id % 3) AS service, {_DEVICE} AS device, {_BROWSER} AS browser, CASE WHEN n = 'web_vitals.lcp' THEN 'img' END AS element
 FROM events CROSS JOIN (VALUES ('web_vitals.lcp'), ('web_vitals.lcp.ttfb'), ('web_vitals.view_duration')) x(n) WHERE n <> 'web_vitals.view_duration' OR event_id % 2 = 0""")
def s7(spark, d):
    out = ingest.beacon_vitals(ingest.beacons(raw_beacons(spark, d)))
    get = F.col("attributes").getItem
    return out.select("timestamp_nanos", "metric_name", "value", quoted("service.name").alias("service"), get("device.type").alias("device"), get("browser.name").alias("browser"), get("lcp.element").alias("element"))


@query("s8_beacon_errors", "SELECT epoch_us(ts) * 1000 AS timestamp_nanos, 'bad chunk ' || event_id AS body, md5(CAST(event_id AS VARCHAR)) AS trace_id, 'app' || (user_id % 3) AS service, dense_rank() OVER (ORDER BY user_id % 3) AS issue FROM events WHERE event_type = 'error'")
def s8(spark, d):
    out = ingest.beacon_errors(ingest.beacons(raw_beacons(spark, d)))
    fp = F.col("attributes").getItem("rum.error.fingerprint")
    known = F.element_at(F.create_map(*(F.lit(x) for k in range(3) for x in (_fnv(f"TypeError\x1fbad chunk #\x1fapp.js:{k}"), k + 1))), fp)
    return out.select("timestamp_nanos", "body", "trace_id", quoted("service.name").alias("service"), known.cast("long").alias("issue"))


def _fnv(text: str) -> str:
    h = 0xCBF29CE484222325
    for b in text.encode():
        h = (h ^ b) * 0x100000001B3 % (1 << 64)
    return f"{h:016x}"


@query("s9_user_agents", f"SELECT {_DEVICE} AS device, {_BROWSER} AS browser, count(*) AS n FROM events GROUP BY 1, 2")
def s9(spark, d):
    device, browser = ingest.user_agent(F.element_at(F.array(*map(F.lit, _UAS)), (F.col("user_id") % 5 + 1).cast("int")))
    return v.read(spark, d, "events").groupBy(device.alias("device"), browser.alias("browser")).agg(F.count(F.lit(1)).alias("n"))


@query("s10_tenant_stamp", "SELECT CAST(event_id AS VARCHAR) AS trace_id, CASE WHEN user_id % 4 < 3 THEN 'tenant' || (user_id % 4) END AS tenant FROM events")
def s10(spark, d):
    keys = spark.createDataFrame([(f"k{i}", f"tenant{i}") for i in range(3)], "token string, tenant string")
    rows = v.logs(spark, d).withColumn("api_key", F.concat(F.lit("k"), (F.col("attributes").getItem("user.id").cast("int") % 4))).withColumn("attributes", F.map_concat("attributes", F.create_map(F.lit("tenant"), F.lit("forged"))))
    return ingest.stamp_tenant(rows, keys).select("trace_id", F.col("attributes").getItem("tenant").alias("tenant"))


@query("s11_app_gate", "SELECT 'app' || (user_id % 3) AS app, count(*) AS n FROM events WHERE user_id % 3 < 2 AND user_id % 4 IN (0, 1) GROUP BY 1")
def s11(spark, d):
    apps = spark.createDataFrame([(f"key{i}", ["https://o0", "https://o1"], 1.0) for i in range(2)], "key string, allowed_origins array<string>, sample_rate double")
    parsed = ingest.beacons(raw_beacons(spark, d))
    return ingest.app_gate(parsed, apps, F.col("b.key"), F.col("origin"), F.col("b.trace")).groupBy(F.col("b.app").alias("app")).agg(F.count(F.lit(1)).alias("n"))


@query("s11_app_sampling", "SELECT 'app' || (user_id % 3) AS app, true AS near_its_rate, true AS same_when_repeated, true AS whole_traces FROM events WHERE user_id % 3 < 2 AND user_id % 4 IN (0, 1) GROUP BY 1")
def s11s(spark, d):
    """Of two apps a half and a fifth of the beacons stay, within five standard deviations; the same ones each time, decided by trace."""
    rates = {0: 0.5, 1: 0.2}
    apps = spark.createDataFrame([(f"key{i}", ["https://o0", "https://o1"], r) for i, r in rates.items()], "key string, allowed_origins array<string>, sample_rate double")
    parsed = ingest.beacons(raw_beacons(spark, d).unionByName(raw_beacons(spark, d)))  # each beacon twice, as one that was sent again
    gate = lambda table: ingest.app_gate(parsed, table, F.col("b.key"), F.col("origin"), F.col("b.trace")).select(F.col("b.app").alias("app"), F.col("b.trace").alias("trace"))
    every = gate(apps.withColumn("sample_rate", F.lit(1.0))).groupBy("app").agg(F.count_distinct("trace").alias("all"))
    kept = gate(apps).groupBy("app", "trace").agg(F.count(F.lit(1)).alias("copies"))
    again = gate(apps).select("app", "trace").distinct().withColumn("_again", F.lit(True))
    rate = F.when(F.col("app") == "app0", rates[0]).otherwise(rates[1])
    near = F.abs(F.count(F.lit(1)) - F.first("all") * F.first(rate)) <= 5 * F.sqrt(F.first("all") * F.first(rate) * (1 - F.first(rate))) + 1
    return kept.join(again, ["app", "trace"], "full").join(every, "app").groupBy("app").agg(near.alias("near_its_rate"), F.bool_and(F.col("_again").isNotNull() & F.col("copies").isNotNull()).alias("same_when_repeated"), F.bool_and(F.col("copies") == 2).alias("whole_traces"))


@query("s12_s1_sink_and_scan", v.sql(f"SELECT trace_id, timestamp_nanos, service FROM logs WHERE timestamp_nanos BETWEEN {S + 3 * DAY} AND {S + 5 * DAY + 7}", logs=v.LOGS))
def s12(spark, d):
    root = shared_folder(spark, "tables")
    tables.sink(v.logs(spark, d), root, "logs", "overwrite", 8)
    return tables.scan(spark, root, "logs", S + 3 * DAY, S + 5 * DAY + 7).select("trace_id", "timestamp_nanos", quoted("service.name").alias("service"))


@query("s2_raw_sql", v.sql("SELECT service, count(*) AS n, max(duration_nanos) AS longest FROM spans WHERE status_code = 2 GROUP BY service", spans=v.SPANS))
def s2(spark, d):
    return tables.sql(spark, "SELECT `service.name` AS service, count(*) AS n, max(duration_nanos) AS longest FROM spans WHERE status_code = 2 GROUP BY 1", {"spans": v.spans(spark, d)})


_QUARTER = f"timestamp_nanos // {DAY // 4} % 4"


def small_files(spark: SparkSession, d: str) -> str:
    """The logs as a table to which each quarter of the days was appended alone: a file for each quarter of a date with rows."""
    out = f"{shared_folder(spark, 'tables')}/data"
    rows = tables.with_date(v.logs(spark, d), "logs")
    for k in range(4):
        quarter = F.call_function("div", F.col("timestamp_nanos"), F.lit(DAY // 4)) % 4
        rows.where(quarter == k).coalesce(1).write.mode("append").partitionBy("date").parquet(out)
    return out


@query("s13_consolidation", v.sql(f"SELECT CAST(make_date(1970, 1, 1) + CAST(timestamp_nanos // {DAY} AS INT) AS VARCHAR) AS date, count(DISTINCT {_QUARTER}) AS files_before, CAST(1 AS BIGINT) AS files_after, count(*) AS rows, count(*) AS rows_left FROM logs GROUP BY 1 HAVING count(DISTINCT {_QUARTER}) > 1", logs=v.LOGS))
def s13(spark, d):
    """Every date that has several files has one afterwards, with the same rows."""
    out = small_files(spark, d)
    report = tables.consolidate(spark, out, "logs", shared_folder(spark, "staging"), 100_000_000)
    left = tables.files(spark, out, "logs").groupBy("date").agg(F.count(F.lit(1)).alias("files_after"), F.sum("rows").alias("rows_left"))
    return report.drop("files_after").join(left, "date").select(F.col("date").cast("string").alias("date"), "files_before", "files_after", "rows", "rows_left")


_OLD = f"timestamp_nanos // {DAY} < {(S + 10 * DAY) // DAY}"


@query("s14_retention", v.sql(f"SELECT count(*) FILTER ({_OLD}) AS rows_removed, count(*) FILTER (NOT {_OLD}) AS rows_left, min(timestamp_nanos) FILTER (NOT {_OLD}) AS oldest FROM logs", logs=v.LOGS))
def s14(spark, d):
    out = tables.sink(v.logs(spark, d), shared_folder(spark, "tables"), "logs", "overwrite", 4)
    removed = tables.purge(spark, out, "logs", S + 10 * DAY)
    left = spark.read.parquet(out).agg(F.count(F.lit(1)).alias("rows_left"), F.min("timestamp_nanos").alias("oldest"))
    return removed.select("rows_removed").join(left)  # one row each


@query("s15_statistics", v.sql(f"SELECT count(DISTINCT (timestamp_nanos // {DAY}, {_QUARTER})) AS file_count, count(*) AS total_rows, min(timestamp_nanos) AS min_ts, max(timestamp_nanos) AS max_ts, true AS has_bytes FROM logs", logs=v.LOGS))
def s15(spark, d):
    stats = tables.statistics(spark, small_files(spark, d), "logs")
    return stats.select("file_count", "total_rows", "min_ts", "max_ts", (F.col("bytes") > 0).alias("has_bytes"))


@query("d2_usage_samples", v.sql(f"SELECT day * 86400000 AS ts_ms, 'logs' AS signal, total_rows, ingest_rows FROM (SELECT timestamp_nanos // {DAY} AS day, CAST(sum(count(*)) OVER (ORDER BY timestamp_nanos // {DAY}) AS BIGINT) AS total_rows, count(*) AS ingest_rows FROM logs GROUP BY 1) WHERE day >= (SELECT max(timestamp_nanos) // {DAY} - 12 FROM logs)", logs=v.LOGS))
def d2(spark, d):
    """A sample for each day of the log table as it grew, appended in two turns; days older than twelve are pruned."""
    day = F.call_function("div", F.col("timestamp_nanos"), F.lit(DAY))
    daily = v.logs(spark, d).groupBy(day.alias("day")).agg(F.count(F.lit(1)).alias("n"))
    grown = daily.withColumn("total_rows", F.sum("n").over(Window.partitionBy(F.lit(0)).orderBy("day")))  # a row a day
    zero = F.lit(0).cast("long")
    rows = grown.select((F.col("day") * 86_400_000).alias("ts_ms"), F.lit("logs").alias("signal"), zero.alias("hot_bytes"), zero.alias("durable_bytes"), "total_rows", zero.alias("file_count"), F.col("n").alias("ingest_rows"))
    out = shared_folder(spark, "usage")
    last = rows.agg(F.max("ts_ms")).first()[0]
    for part in (rows.where(F.col("ts_ms") < last), rows.where(F.col("ts_ms") == last)):
        usage.record(spark, part, out, last, 12)
    return spark.read.parquet(out).select("ts_ms", "signal", "total_rows", "ingest_rows")


# ---- streams over the same rows ------------------------------------------------------------------------------


def _stream(spark: SparkSession, rows: DataFrame, files: int = 4) -> DataFrame:
    """A stream of two batches, over as many files as the session has shuffle partitions (``files`` at least)."""
    path = shared_folder(spark, "stream")
    rows.repartition(max(files, int(spark.conf.get("spark.sql.shuffle.partitions")))).write.parquet(path)
    half = -(-len(spark.read.schema(rows.schema).parquet(path).inputFiles()) // 2)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", max(half, 1)).parquet(path)


@contextmanager
def _state_store(spark: SparkSession):
    """Streams with state of their own need this store; the session is left as it was."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, live.STATE_STORE)
    try:
        yield
    finally:
        spark.conf.set(name, before) if before else spark.conf.unset(name)


def _all(spark: SparkSession, stream: DataFrame, mode: str = "append", later: Sequence[Callable[[], None]] = ()) -> DataFrame:
    """What a stream yields once all is read, ``later`` parts (see ``_batches``) included. A complete result is written anew by each batch, and the last is read."""
    out, check, last = shared_folder(spark, "out"), shared_folder(spark, "check"), []

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/{number}")
        last.append(number)

    with _state_store(spark):
        for put in (None, *later):
            if put is not None:
                put()
            writing = stream.writeStream.outputMode(mode).option("checkpointLocation", check).trigger(availableNow=True)
            (writing.format("parquet").option("path", out) if mode == "append" else writing.foreachBatch(keep)).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(out if mode == "append" else f"{out}/{last[-1]}")


_W = "date_trunc('day', make_timestamp(timestamp_nanos // 1000))"


@query("w2_continuous_log_volume", v.sql(f"SELECT CAST(epoch_us({_W}) AS BIGINT) AS start_us, CASE WHEN severity_number BETWEEN 1 AND 8 THEN 'debug' WHEN severity_number BETWEEN 13 AND 16 THEN 'warn' WHEN severity_number BETWEEN 17 AND 20 THEN 'error' WHEN severity_number BETWEEN 21 AND 24 THEN 'fatal' ELSE 'info' END AS level, count(*) AS count FROM logs GROUP BY 1, 2", logs=v.LOGS))
def w2(spark, d):
    rows = live.continuous_log_volume(_stream(spark, v.logs(spark, d)), "1 day", "60 days")
    return _all(spark, rows, "complete").select(F.unix_micros("start").alias("start_us"), "level", "count")


@query("w3_continuous_red", v.sql(f"SELECT CAST(epoch_us(date_trunc('day', make_timestamp(start_time_nanos // 1000))) AS BIGINT) AS start_us, service, count(*) AS count, count(*) FILTER (status_code = 2) AS errors, count(*) FILTER (duration_nanos <= {apm.DEFAULT_APDEX_NANOS}) AS satisfied FROM spans GROUP BY 1, 2", spans=v.SPANS))
def w3(spark, d):
    rows = live.continuous_red(_stream(spark, v.spans(spark, d)), "1 day", late="5000 days")
    return _all(spark, rows, "complete").select(F.unix_micros("start").alias("start_us"), "service", "count", "errors", "satisfied")


def _in_order(spark: SparkSession, rows: DataFrame, time: str, batches: int = 3) -> tuple[DataFrame, list[Callable[[], None]]]:
    """A stream of several batches in order of time (see ``_batches``): state goes from one to the next."""
    rows = kept(rows, "rows")
    return _batches(spark, [rows.where((F.col(time) >= a) & (F.col(time) < b)) for a, b in _cuts(rows, time, batches)])


def _cuts(rows: DataFrame, time: str, parts: int) -> list[tuple[int, int]]:
    first, last = rows.agg(F.min(time), F.max(time)).first()
    ends = [first + k * (last - first + 1) // parts for k in range(parts + 1)]
    return list(zip(ends, ends[1:], strict=False))


def _batches(spark: SparkSession, parts: list[DataFrame]) -> tuple[DataFrame, list[Callable[[], None]]]:
    """A stream that holds the first of ``parts``, and what puts each of the others under it.

    A query that is started anew (one checkpoint, all that is there) after each of them sees every part as one batch, of any number of files.
    """
    path = shared_folder(spark, "stream")
    puts = [lambda part=part: part.write.mode("append").parquet(path) for part in parts]
    puts[0]()
    return spark.readStream.schema(parts[0].schema).parquet(path), puts[1:]


_LATE = [(0, 10), (20, 26), (26, 31), (10, 16)]  # days of the month, in the order in which they come


@query("w7_late_rows", v.sql(f"SELECT CAST(epoch_us({_W}) AS BIGINT) AS start_us, count(*) AS count FROM logs WHERE (timestamp_nanos < {S + 10 * DAY} OR timestamp_nanos >= {S + 20 * DAY}) AND epoch_us({_W}) + 86400000000 <= (SELECT max(timestamp_nanos) // 1000 - 3 * 86400000000 FROM logs) GROUP BY 1", logs=v.LOGS))
def w7(spark, d):
    """Logs by day where the last file comes ten days late: the watermark, three days behind, is past its days, so its rows are dropped."""
    rows = v.logs(spark, d)
    parts = [rows.where((F.col("timestamp_nanos") >= S + a * DAY) & (F.col("timestamp_nanos") < S + b * DAY)) for a, b in _LATE]
    stream, later = _batches(spark, parts)
    counted = live.continuous_log_volume(stream, "1 day", "3 days")
    return _all(spark, counted, later=later).groupBy(F.unix_micros("start").alias("start_us")).agg(F.sum("count").alias("count"))


@query("w2_continuous_span_volume", v.sql("SELECT CAST(epoch_us(date_trunc('day', make_timestamp(start_time_nanos // 1000))) AS BIGINT) AS start_us, CASE status_code WHEN 1 THEN 'ok' WHEN 2 THEN 'error' ELSE 'unset' END AS status, count(*) AS count FROM spans GROUP BY 1, 2", spans=v.SPANS))
def w2b(spark, d):
    rows = live.continuous_span_volume(_stream(spark, v.spans(spark, d)), "1 day", "5000 days")
    return _all(spark, rows, "complete").select(F.unix_micros("start").alias("start_us"), "status", "count")


_GONE = 90 * 60_000
_GAPS = f"""SELECT rule_id, series_key, "at", value FROM s UNION ALL SELECT rule_id, series_key, "at" + {_GONE}, NULL FROM (SELECT *, lead("at") OVER (PARTITION BY rule_id, series_key ORDER BY "at") AS nxt, max("at") OVER () AS last FROM s) WHERE coalesce(nxt, 9e18) > "at" + {_GONE} AND (nxt IS NOT NULL OR "at" + {_GONE} < last - 3600000)"""
_TIMED = f"""SELECT *, CASE WHEN state = 'triggered' AND p <> 'triggered' THEN 'triggered' WHEN state = 'ok' AND p = 'triggered' THEN 'resolved' WHEN state = 'pending' AND p = 'ok' THEN 'pending' END AS transition FROM (SELECT *, coalesce(lag(state) OVER (PARTITION BY rule_id, series_key ORDER BY "at"), 'ok') AS p FROM
 (SELECT rule_id, series_key, "at", CASE WHEN NOT breach THEN 'ok' WHEN "at" - min(CASE WHEN breach THEN "at" END) OVER (PARTITION BY rule_id, series_key, run) >= for_secs * 1000 THEN 'triggered' ELSE 'pending' END AS state FROM
 (SELECT *, count(*) FILTER (NOT breach) OVER (PARTITION BY rule_id, series_key ORDER BY "at" ROWS UNBOUNDED PRECEDING) AS run FROM (SELECT g.rule_id, series_key, "at", value, for_secs, {_BREACH} AS breach FROM ({_GAPS}) g JOIN r ON g.rule_id = r.rule_id))))"""


@query("w4_vanished_series", v.sql(f"SELECT rule_id, series_key, \"at\", transition FROM ({_TIMED}) WHERE transition IS NOT NULL", points=v.POINTS, s=_SAMPLES, r=_RULES))
def w4c(spark, d):
    """Samples alone, in several batches; a series without one for 90 minutes is gone, by a timer of event time."""
    stream, later = _in_order(spark, samples(spark, d), "at")
    return _all(spark, live.alert_transitions(stream, rules(spark), _GONE), later=later).select("rule_id", "series_key", "at", "transition")


_STEP = 30 * DAY
_RAW_RULES = [("errors", "error_rate", "gt", 24.0, 60 * 86_400), ("quiet", "request_rate", "lt", 0.000004, 0)]
_RAW = f"""SELECT rule_id, series_key, "at", CASE WHEN rule_id = 'errors' THEN e * 100.0 / n ELSE n / {_STEP / 1e9} END AS value FROM (SELECT 'service=' || service || ',tenant=' || tenant AS series_key, (start_time_nanos // {_STEP} + 1) * {_STEP // 1_000_000} AS "at", count(*) AS n, count(*) FILTER (status_code = 2) AS e FROM spans WHERE start_time_nanos // {_STEP} % 7 <> 3 OR service <> 'svc-1' GROUP BY 1, 2) CROSS JOIN (VALUES ('errors'), ('quiet')) x(rule_id)"""
_RAW_R = "SELECT * FROM (VALUES ('errors', 'gt', 24.0::DOUBLE, 5184000::BIGINT), ('quiet', 'lt', 0.000004::DOUBLE, 0::BIGINT)) r(rule_id, op, threshold, for_secs)"
_RAW_BREACH = "coalesce(CASE op WHEN 'gt' THEN value > threshold WHEN 'lt' THEN value < threshold END, false)"


@query("w4_alerts_from_spans", v.sql(f"SELECT rule_id, series_key, \"at\", transition FROM ({_MACHINE.replace(_BREACH, _RAW_BREACH)}) WHERE transition IS NOT NULL", spans=v.SPANS, s=_RAW, r=_RAW_R))
def w4r(spark, d):
    """Raw spans in several batches through windowed samples and the state machine in one query; a service goes silent in every seventh window."""
    rows = v.spans(spark, d).select("start_time_nanos", "status_code", "`service.name`", "tenant")
    rows = rows.where((F.call_function("div", F.col("start_time_nanos"), F.lit(_STEP)) % 7 != 3) | (quoted("service.name") != "svc-1"))
    rows = kept(rows, "rows")
    last = rows.agg(F.max("start_time_nanos")).first()[0]
    # spans of another service move the watermark on, so that the last windows and timers are seen
    beyond = [spark.createDataFrame([(last + k * 100 * DAY, 0, "beyond", None)], rows.schema) for k in (1, 2, 3)]
    table = spark.createDataFrame(_RAW_RULES, "rule_id string, measure string, op string, threshold double, for_secs long")
    parts = [rows.where((F.col("start_time_nanos") >= a) & (F.col("start_time_nanos") < b)) for a, b in _cuts(rows, "start_time_nanos", 3)]
    stream, later = _batches(spark, [*parts, *beyond])
    found = live.alerts_from_spans(stream, table, "30 days", _STEP // 1_000_000, "1 day")
    # series still there at the end are not gone
    return _all(spark, found, later=later).where(F.col("series_key").contains("svc-") & (F.col("at") <= (last // _STEP + 1) * (_STEP // 1_000_000))).select("rule_id", "series_key", "at", "transition")


@query("w4_streaming_uptime", v.sql(f"SELECT monitor_id, ts, transition FROM ({_STATES}) WHERE transition IS NOT NULL", beats=v.BEATS))
def w4(spark, d):
    stream, later = _in_order(spark, v.heartbeats(spark, d), "ts")
    return _all(spark, live.uptime_transitions(stream, 2), later=later).select("monitor_id", "ts", "transition")


@query("w4_streaming_alerts", v.sql(f"SELECT rule_id, series_key, \"at\", transition FROM ({_MACHINE}) WHERE transition IS NOT NULL", points=v.POINTS, s=_SAMPLES, r=_RULES))
def w4b(spark, d):
    rows = samples(spark, d)
    seen = rows.groupBy("rule_id", "series_key").agg(F.min("at").alias("_first"))
    gone = rows.select("rule_id", "at").distinct().join(seen, "rule_id").where("at >= _first").join(rows, ["rule_id", "series_key", "at"], "left").select("rule_id", "series_key", "at", "value")
    stream, later = _in_order(spark, gone, "at")
    return _all(spark, live.alert_transitions(stream, rules(spark)), later=later).select("rule_id", "series_key", "at", "transition")


@query("w5_streaming_counter", v.sql(f"SELECT \"user\" AS series, timestamp_nanos, CAST({q_metrics._UP} AS DOUBLE) AS increase FROM points WHERE metric_name = 'requests_total' WINDOW w AS (PARTITION BY \"user\" ORDER BY timestamp_nanos, value)", points=v.POINTS))
def w5(spark, d):
    rows = v.points(spark, d).where("metric_name = 'requests_total'").select("metric_name", F.col("attributes").getItem("user").alias("series"), "timestamp_nanos", "start_nanos", "value")
    stream, later = _in_order(spark, rows, "timestamp_nanos")
    return _all(spark, live.counter_increases(stream), later=later).select("series", "timestamp_nanos", "increase")


@query("w6_streaming_ingest", v.sql("SELECT timestamp_nanos, body, trace_id, service FROM logs", logs=v.LOGS))
def w6(spark, d):
    root = shared_folder(spark, "tables")
    live.ingest(_stream(spark, raw_logs(spark, d)), ingest.otlp_logs, root, "logs", shared_folder(spark, "check"), availableNow=True).awaitTermination()
    return spark.read.parquet(f"{root}/data").select("timestamp_nanos", "body", "trace_id", quoted("service.name").alias("service"))


@query("w1_s16_live_tail", v.sql("SELECT timestamp_nanos, trace_id FROM logs WHERE severity_number = 17 ORDER BY timestamp_nanos DESC, trace_id LIMIT 300", logs=v.LOGS))
def w1(spark, d):
    """All flushes' newest rows; the newest of all are among them."""
    out = shared_folder(spark, "tail")
    query = live.live_tail(_stream(spark, v.logs(spark, d)), terms.level(["error"]), "logs", lambda rows, n: rows.write.mode("overwrite").parquet(f"{out}/flush={n}"), shared_folder(spark, "check"), 300, availableNow=True)
    query.awaitTermination()
    return spark.read.parquet(out).orderBy(F.desc("timestamp_nanos"), "trace_id").limit(300).select("timestamp_nanos", "trace_id")


@query("w1_span_tail", v.sql("SELECT trace_id, span_id, CAST(NULL AS DOUBLE) AS matched_per_second FROM spans WHERE status_code = 2 AND start_time_nanos >= (SELECT max(start_time_nanos) - 86400000000000 FROM spans) UNION ALL SELECT trace_id, span_id, (SELECT count(*) FROM spans WHERE status_code = 2) / 2.0 FROM (SELECT * FROM spans WHERE status_code = 2 ORDER BY start_time_nanos DESC, trace_id, span_id LIMIT 50)", spans=v.SPANS))
def w1s(spark, d):
    """Two flushes of the span tail: the last day's errors, all shown; and all errors, of which the newest fifty stand for a rate."""
    rows = kept(v.spans(spark, d), "rows")
    last = rows.agg(F.max("start_time_nanos")).first()[0]
    out, check, where = shared_folder(spark, "tail"), shared_folder(spark, "check"), terms.status(["error"])
    stream, later = _batches(spark, [rows.where(F.col("start_time_nanos") >= last - DAY), rows])
    emit = lambda shown, n: shown.write.mode("overwrite").parquet(f"{out}/flush={n}")
    for cap, put in zip((1_000_000, 50), (None, *later), strict=True):
        if put is not None:
            put()
        live.live_tail(stream, where, "spans", emit, check, cap, 2.0, availableNow=True).awaitTermination()
    return spark.read.parquet(out).select("trace_id", "span_id", "matched_per_second")


@query("w7_late_rows_kept", v.sql(f"SELECT CAST(epoch_us({_W}) AS BIGINT) AS start_us, count(*) AS count, timestamp_nanos // {DAY} BETWEEN {(S + 10 * DAY) // DAY} AND {(S + 16 * DAY) // DAY - 1} AS late FROM logs WHERE timestamp_nanos < {S + 16 * DAY} OR timestamp_nanos >= {S + 20 * DAY} GROUP BY ALL", logs=v.LOGS))
def w7k(spark, d):
    """The same stream, dealt: the days that come ten days late are kept beside those in time, and nothing is lost."""
    rows = v.logs(spark, d)
    parts = [rows.where((F.col("timestamp_nanos") >= S + a * DAY) & (F.col("timestamp_nanos") < S + b * DAY)) for a, b in _LATE]
    root = shared_folder(spark, "split")
    check = shared_folder(spark, "check")
    stream, later = _batches(spark, parts)
    for put in (None, *later):
        if put is not None:
            put()
        live.split_late(stream, "logs", DAY, 3 * DAY, root, check, availableNow=True).awaitTermination()
    late = live.late_rows(spark, root, rows.schema).withColumn("late", F.lit(True))
    timely = spark.read.schema(rows.schema).parquet(f"{root}/rows/batch=*/late=false").withColumn("late", F.lit(False))
    day = F.call_function("div", F.col("timestamp_nanos"), F.lit(DAY)) * (DAY // 1000)
    return late.drop("batch").unionByName(timely).groupBy(day.alias("start_us"), "late").agg(F.count(F.lit(1)).alias("count"))
