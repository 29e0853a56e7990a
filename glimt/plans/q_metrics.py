"""Queries over metric series, distributions, browser vitals and hosts, with their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from glimt.functions.fields import quoted
from glimt.functions.terms import in_window, metric_filter
from glimt.operators import distributions, infra, metrics, rum
from glimt.plans import views as v
from glimt.plans.q_search import index_sql, label_sql

S, E = v.MONTH
LS, LE = (788_918_400_000_000_000, 1_009_843_200_000_000_000)  # the line items' years
N = 40
STEP = (E - S) / N / 1e9
QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return add


_B = index_sql("timestamp_nanos", S, E, N)


def _series(inner: str, keys: str = "service", view: str = "points", body: str = v.POINTS, start: int = S, end: int = E, n: int = N, **more: str) -> str:
    """``inner``: a query of keys, b and v; the twin of a filled series."""
    names = [k.strip() for k in keys.split(",") if k.strip()]
    listed = ", ".join(f"k.{k}" for k in names)
    same = " AND ".join(f"k.{k} IS NOT DISTINCT FROM x.{k}" for k in names)
    groups = f"(SELECT DISTINCT {', '.join(names)} FROM x) k CROSS JOIN " if names else ""
    return v.sql(f"SELECT {listed}{', ' if names else ''}CAST(r.b AS INT) AS bucket, {label_sql('r.b', start, end, n)} AS t, x.v FROM {groups}range({n}) r(b) LEFT JOIN x ON x.b = r.b{' AND ' + same if names else ''}", **{view: body}, **more, x=inner)


for _agg in ("avg", "min", "max", "sum", "count"):

    @query(f"m2_series_{_agg}", _series(f"SELECT service, {_B} AS b, CAST({_agg}(value) AS DOUBLE) AS v FROM points WHERE metric_name = 'queue.depth' GROUP BY 1, 2"))
    def _m2(spark, d, agg=_agg):
        return metrics.series(v.points(spark, d), "queue.depth", S, E, N, agg, ["service"]).withColumnRenamed("service", "service")


@query("m2_series_map_label", _series(f"SELECT \"user\", {_B} AS b, avg(value) AS v FROM points WHERE metric_name = 'queue.depth' AND service = 'svc-1' GROUP BY 1, 2", '"user"'))
def m2b(spark, d):
    df = v.points(spark, d)
    return metrics.series(df, "queue.depth", S, E, N, "avg", ["user"], [quoted("service.name") == "svc-1"])


@query("m3_delta_rate", _series(f"SELECT service, {_B} AS b, sum(value) / {STEP} AS v FROM points WHERE metric_name = 'bytes.sent' GROUP BY 1, 2"))
def m3(spark, d):
    return metrics.series(v.points(spark, d), "bytes.sent", S, E, N, "rate", ["service"])


_UP = "CASE WHEN lag(value) OVER w IS NULL THEN 0 WHEN value < lag(value) OVER w THEN value ELSE value - lag(value) OVER w END"
for _key, _part in (("attributes", "service, \"user\""), ("group", "service")):

    @query(f"m4_counter_increase_{_key}", _series(f"SELECT service, {_B} AS b, sum(up) AS v FROM (SELECT *, {_UP} AS up FROM points WHERE metric_name = 'requests_total' WINDOW w AS (PARTITION BY {_part} ORDER BY timestamp_nanos, value)) GROUP BY 1, 2"))
    def _m4(spark, d, key=_key):
        return metrics.series(v.points(spark, d), "requests_total", S, E, N, "increase", ["service"], series_key=key)


@query("m5_gauge_last", _series(f"SELECT service, {_B} AS b, arg_max(value, timestamp_nanos) AS v FROM points WHERE metric_name = 'queue.depth' GROUP BY 1, 2"))
def m5(spark, d):
    return metrics.series(v.points(spark, d), "queue.depth", S, E, N, "last", ["service"])


def quantile_sql(cells: list[tuple[str, str, str]], q: float) -> str:
    """Linear within the range that holds rank q * total, of columns (lo, hi, c); hi NULL is open."""
    total = "(" + " + ".join(c for *_, c in cells) + ")"
    whens, before = [], "0"
    for lo, hi, c in cells:
        value = lo if hi == "NULL" else f"{lo} + ({hi} - {lo}) * (({q} * {total} - ({before})) / {c})"
        whens.append(f"WHEN {c} > 0 AND {before} + {c} >= {q} * {total} THEN {value}")
        before = f"{before} + {c}"
    return f"CASE WHEN {total} <= 0 THEN NULL {' '.join(whens)} END"


_Q = [("0.0", "10.0"), ("10.0", "20.0"), ("20.0", "30.0"), ("30.0", "40.0"), ("40.0", "NULL")]
_CELLS = [(lo, hi, f"c{i}") for i, (lo, hi) in enumerate(_Q)]
_COUNTS = ", ".join(f"CAST(count(*) FILTER (l_quantity > {'-1e9' if i == 0 else lo} AND l_quantity <= {'1e9' if hi == 'NULL' else hi}) AS DOUBLE) AS c{i}" for i, (lo, hi) in enumerate(_Q))
_LB = index_sql("epoch_us(l_shipdate) * 1000", LS, LE, N)
_HIST = f"SELECT 'svc-' || (l_suppkey % 10) AS service, {_LB} AS b, {_COUNTS}, CAST(count(*) AS DOUBLE) AS n, sum(l_quantity) AS s FROM lineitem WHERE epoch_us(l_shipdate) * 1000 BETWEEN {LS} AND {LE} GROUP BY 1, 2"
for _agg, _value in (("p50", quantile_sql(_CELLS, 0.5)), ("p99", quantile_sql(_CELLS, 0.99)), ("count", "n"), ("sum", "s"), ("avg", "s / n")):

    @query(f"m6_m7_histogram_{_agg}", _series(f"SELECT service, b, {_value} AS v FROM h", view="h", body=_HIST, start=LS, end=LE))
    def _m6(spark, d, agg=_agg):
        return distributions.histogram_series(v.histograms(spark, d), "line.quantity", LS, LE, N, agg, ["service"])


def exponential(spark, d):
    """Exponential histograms (scale 0 or 1) of the line quantities of a day and supplier."""
    q = F.col("l_quantity")
    rows = v.read(spark, d, "lineitem").groupBy("l_shipdate", "l_suppkey").agg(*(F.count_if((q > 2.0**i) & (q <= 2.0 ** (i + 1))).alias(f"p{i}") for i in range(6)), F.count_if(q <= 1).alias("p"), F.count(F.lit(1)).alias("n"), F.sum(q).alias("s"))
    side = lambda offset, counts: F.struct(F.lit(offset).alias("offset"), counts.alias("bucket_counts"))
    none = F.lit(None).cast("struct<offset:int,bucket_counts:array<bigint>>")
    # scale 1 puts all of a power of two into the lower of its two buckets
    fine = F.flatten(F.array(*(F.array(F.col(f"p{i}"), F.lit(0).cast("long")) for i in range(6))))
    one = lambda scale, counts: F.struct(F.col("n").alias("count"), F.col("s").alias("sum"), F.lit(scale).alias("scale"), F.col("p").alias("zero_count"), side(0, counts).alias("positive"), none.alias("negative"), F.lit(None).cast("double").alias("min"), F.lit(None).cast("double").alias("max"))
    value = F.when(F.col("l_suppkey") % 2 == 0, one(0, F.array(*(F.col(f"p{i}") for i in range(6))))).otherwise(one(1, fine))
    return rows.select(F.lit("line.exp").alias("metric_name"), F.lit(3).alias("metric_type"), F.lit(1).alias("temporality"), v.nanos("l_shipdate").alias("timestamp_nanos"), F.lit(None).cast("long").alias("start_nanos"), value.alias("exp_histogram"), F.concat(F.lit("svc-"), F.col("l_suppkey") % 10).alias("service.name"), v.attributes(supplier=F.col("l_suppkey")).alias("attributes"))


# merged to the coarsest scale of a bucket: services of odd suppliers only stay at scale 1, where each power has a half bucket
_ECELLS0 = [("0.0", "0.0", "z")] + [(f"{2.0**i}", f"{2.0 ** (i + 1)}", f"p{i}") for i in range(6)]
_ECELLS1 = [("0.0", "0.0", "z")] + [(f"{2.0**i}", f"{2.0**i} * sqrt(2.0)", f"p{i}") for i in range(6)]
_EXP = "SELECT 'svc-' || (l_suppkey % 10) AS service, min(l_suppkey % 2) AS sc, " + _LB + " AS b, CAST(count(*) FILTER (l_quantity <= 1) AS DOUBLE) AS z, " + ", ".join(f"CAST(count(*) FILTER (l_quantity > {2.0**i} AND l_quantity <= {2.0 ** (i + 1)}) AS DOUBLE) AS p{i}" for i in range(6)) + f", CAST(count(*) AS DOUBLE) AS n FROM lineitem WHERE epoch_us(l_shipdate) * 1000 BETWEEN {LS} AND {LE} GROUP BY 1, 3"


@query("m8_exponential_histogram_p90", _series(f"SELECT service, b, round(CASE WHEN sc = 0 THEN {quantile_sql(_ECELLS0, 0.9)} ELSE {quantile_sql(_ECELLS1, 0.9)} END, 6) AS v FROM h", view="h", body=_EXP, start=LS, end=LE))
def m8(spark, d):
    return distributions.exponential_series(exponential(spark, d), "line.exp", LS, LE, N, "p90", ["service"]).withColumn("v", F.round("v", 6))


@query("m8_exponential_histogram_count", _series("SELECT service, b, n AS v FROM h", view="h", body=_EXP, start=LS, end=LE))
def m8c(spark, d):
    return distributions.exponential_series(exponential(spark, d), "line.exp", LS, LE, N, "count", ["service"])


_EXP_DAYS = "SELECT l_suppkey, l_shipdate, month(l_shipdate) % 2 AS sc, CAST(sum(count(*)) OVER (PARTITION BY l_suppkey ORDER BY l_shipdate) AS DOUBLE) AS cum FROM lineitem GROUP BY 1, 2"
_EXP_UP = f"""SELECT 'svc-' || (l_suppkey % 10) AS service, {_LB} AS b, sum(up) AS n FROM (SELECT *, CASE WHEN lag(cum) OVER w IS NULL THEN 0 WHEN sc <> lag(sc) OVER w THEN cum ELSE cum - lag(cum) OVER w END AS up
 FROM ({_EXP_DAYS}) WHERE epoch_us(l_shipdate) * 1000 BETWEEN {LS} AND {LE} WINDOW w AS (PARTITION BY l_suppkey ORDER BY l_shipdate)) GROUP BY 1, 2"""


@query("m8_cumulative_exponential_count", _series("SELECT service, b, n AS v FROM h", view="h", body=_EXP_UP, start=LS, end=LE))
def m8u(spark, d):
    """A supplier's lines counted up day by day; the scale changes with the month, which starts the series anew."""
    daily = v.read(spark, d, "lineitem").groupBy("l_shipdate", "l_suppkey").agg(F.count(F.lit(1)).alias("n"))
    cum = F.sum("n").over(Window.partitionBy("l_suppkey").orderBy("l_shipdate"))
    none = F.lit(None).cast("struct<offset:int,bucket_counts:array<bigint>>")
    value = F.struct(F.col("cum").alias("count"), F.col("cum").cast("double").alias("sum"), (F.month("l_shipdate") % 2).alias("scale"), F.lit(0).cast("long").alias("zero_count"), F.struct(F.lit(0).alias("offset"), F.array("cum").alias("bucket_counts")).alias("positive"), none.alias("negative"), F.lit(None).cast("double").alias("min"), F.lit(None).cast("double").alias("max"))
    points = daily.withColumn("cum", cum).select(F.lit("line.exp").alias("metric_name"), F.lit(3).alias("metric_type"), F.lit(2).alias("temporality"), v.nanos("l_shipdate").alias("timestamp_nanos"), F.lit(None).cast("long").alias("start_nanos"), value.alias("exp_histogram"), F.concat(F.lit("svc-"), F.col("l_suppkey") % 10).alias("service.name"), v.attributes(supplier=F.col("l_suppkey")).alias("attributes"))
    return distributions.exponential_series(points, "line.exp", LS, LE, N, "count", ["service"])


def summaries(spark, d):
    cents = F.round(F.col("value") * 100)
    q = F.array(*(F.struct(F.lit(p).alias("quantile"), (cents + k).alias("value")) for k, p in enumerate((0.5, 0.9, 0.99))))
    value = F.struct((F.col("event_id") % 50).alias("count"), cents.alias("sum"), q.alias("quantiles"))
    return v.read(spark, d, "events").select(F.lit("req.summary").alias("metric_name"), v.nanos("ts").alias("timestamp_nanos"), value.alias("summary"), F.concat(F.lit("svc-"), F.col("user_id") % 10).alias("service.name"), v.attributes(u=F.col("user_id")).alias("attributes"))


_SUM = f"SELECT 'svc-' || (user_id % 10) AS service, {index_sql('epoch_us(ts) * 1000', S, E, N)} AS b, arg_max(round(value * 100), ts) AS s, CAST(arg_max(event_id % 50, ts) AS DOUBLE) AS c FROM events GROUP BY 1, 2"
for _agg, _value in (("p99", "s + 2"), ("median", "s"), ("avg", "CASE WHEN c > 0 THEN s / c END")):

    @query(f"m9_summary_{_agg}", _series(f"SELECT service, b, {_value} AS v FROM h", view="h", body=_SUM))
    def _m9(spark, d, agg=_agg):
        return distributions.summary_series(summaries(spark, d), "req.summary", S, E, N, agg, ["service"])


# a user's counters grow by each event; the first sample of each user in the window counts nothing
_CLASSIC = f"""SELECT 'svc-' || (user_id % 10) AS service, user_id AS u, {index_sql('epoch_us(ts) * 1000', S, E, N)} AS b, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r, CAST(round(value * 100) AS BIGINT) AS x FROM events"""
_CCELLS = [("0.0", "500.0", "c0"), ("500.0", "1000.0", "c1"), ("1000.0", "2000.0", "c2"), ("2000.0", "5000.0", "c3"), ("5000.0", "NULL", "c4")]
_CGROUP = "SELECT u, b, " + ", ".join(f"CAST(count(*) FILTER (r > 1 AND x > {lo if i else '-1e9'} AND x <= {'1e18' if hi == 'NULL' else hi}) AS DOUBLE) AS {c}" for i, (lo, hi, c) in enumerate(_CCELLS)) + ", CAST(count(*) FILTER (r > 1) AS DOUBLE) AS n, CAST(coalesce(sum(x) FILTER (r > 1), 0) AS DOUBLE) AS s FROM e GROUP BY 1, 2"
for _agg, _value in (("p50", quantile_sql(_CCELLS, 0.5)), ("p90", quantile_sql(_CCELLS, 0.9)), ("count", "n"), ("sum", "s"), ("avg", "CASE WHEN n > 0 THEN s / n END")):

    @query(f"{'m10' if _agg[0] == 'p' else 'm11'}_classic_histogram_{_agg}", _series(f"SELECT CAST(u AS VARCHAR) AS \"user\", b, {_value} AS v FROM g", '"user"', view="e", body=_CLASSIC, g=_CGROUP))
    def _m10(spark, d, agg=_agg):
        return distributions.classic_series(v.classic_buckets(spark, d), "value", S, E, N, agg, ["user"], series_key="group")


_CATALOG = """SELECT metric_name, metric_type, CASE metric_name WHEN 'queue.depth' THEN NULL WHEN 'bytes.sent' THEN 1 ELSE 2 END AS temporality, CASE WHEN metric_name <> 'queue.depth' THEN true END AS is_monotonic, max(timestamp_nanos) AS last_seen, count(DISTINCT service || host || tenant) AS series_count, CASE metric_type WHEN 0 THEN 'avg' ELSE 'rate' END AS default_aggregation FROM points GROUP BY 1, 2"""


@query("m1_m12_metric_catalog", v.sql(_CATALOG, points=v.POINTS))
def m12(spark, d):
    return metrics.catalog(v.points(spark, d), exact=True).drop("unit")


@query("m12_metric_families", f"SELECT 'value' AS metric_name, 2 AS metric_type, max(epoch_us(ts) * 1000) AS last_seen, 'p99' AS default_aggregation FROM events")
def m12b(spark, d):
    rows = v.classic_buckets(spark, d).withColumn("unit", F.lit("1"))
    return metrics.catalog(rows, "VAL", [2], exact=True).select("metric_name", "metric_type", "last_seen", "default_aggregation")


@query("m13_metric_metadata", v.sql(f"SELECT metric_name, metric_type, series_count, 'user' AS attribute_keys FROM ({_CATALOG}) WHERE metric_name = 'bytes.sent'", points=v.POINTS))
def m13(spark, d):
    return metrics.metadata(v.points(spark, d), "bytes.sent", exact=True).select("metric_name", "metric_type", "series_count", F.array_join("attribute_keys", ",").alias("attribute_keys"))


@query("m14_label_keys", "SELECT * FROM (VALUES ('user'), ('service.name'), ('host.name'), ('tenant')) t(key) WHERE EXISTS (SELECT 1 FROM events)")
def m14(spark, d):
    return metrics.label_keys(v.points(spark, d), "queue.depth", S, E)


@query("m14_label_values", v.sql("SELECT value, count, total > 25 AS capped FROM (SELECT \"user\" AS value, count(*) AS count, count(*) OVER () AS total FROM points WHERE metric_name = 'queue.depth' GROUP BY 1) ORDER BY count DESC, value LIMIT 25", points=v.POINTS))
def m14b(spark, d):
    return metrics.label_values(v.points(spark, d), "queue.depth", "user", S, E, 25)


@query("m17_multi_query", v.sql(f"""SELECT q AS query, CASE q WHEN 'a' THEN '{{"service":"' || service || '"}}' ELSE '{{}}' END AS labels, CAST(r.b AS INT) AS bucket, {label_sql('r.b', S, E, N)} AS t, x.v FROM (SELECT DISTINCT q, service FROM u) k CROSS JOIN range({N}) r(b) LEFT JOIN u x USING (q, service, b)""",
    points=v.POINTS, u=f"SELECT 'a' AS q, service, {_B} AS b, max(value) AS v FROM points WHERE metric_name = 'queue.depth' GROUP BY 2, 3 UNION ALL SELECT 'b', '', {_B}, sum(value) FROM points WHERE metric_name = 'bytes.sent' GROUP BY 3"))
def m17(spark, d):
    return metrics.multi(v.points(spark, d), {"a": {"name": "queue.depth", "agg": "max", "labels": ["service"]}, "b": {"name": "bytes.sent", "agg": "sum"}}, S, E, N)


_FOUND = f"SELECT service, {_B} AS b, max(value) AS v FROM points WHERE metric_name = 'queue.depth' GROUP BY 1, 2"


def _found(spark, d):
    return metrics.series(v.points(spark, d), "queue.depth", S, E, N, "max", ["service"])


@query("m18_series_stats", v.sql("SELECT *, CASE WHEN change_pct > 0.5 THEN 'up' WHEN change_pct < -0.5 THEN 'down' ELSE 'flat' END AS direction FROM (SELECT service, arg_max(v, b) AS latest, avg(v) AS mean, (arg_max(v, b) - avg(v)) / avg(v) * 100 AS change_pct FROM f GROUP BY 1)", points=v.POINTS, f=_FOUND))
def m18(spark, d):
    return metrics.stats(_found(spark, d), ["service"])


@query("m19_stacked", v.sql(f"SELECT CAST(r.b AS INT) AS bucket, {label_sql('r.b', S, E, N)} AS t, max(v) FILTER (service = 'svc-1') AS \"svc-1\", max(v) FILTER (service = 'svc-2') AS \"svc-2\" FROM range({N}) r(b) LEFT JOIN f ON f.b = r.b GROUP BY 1, 2", points=v.POINTS, f=_FOUND))
def m19(spark, d):
    return metrics.stacked(_found(spark, d), "service", ["svc-1", "svc-2"])


@query("m20_namespaces", v.sql("SELECT DISTINCT metric_name, CASE WHEN metric_name LIKE 'system%' THEN 'system' ELSE 'other' END AS namespace, CASE WHEN starts_with(metric_name, 'system') THEN 0 WHEN contains(metric_name, 'system') THEN 2 END AS score FROM hosts WHERE contains(metric_name, 'system')", hosts=v.HOSTS))
def m20(spark, d):
    return metrics.namespaces(v.hosts(spark, d), "system")


@query("m21_legend", v.sql("SELECT service, arg_max(v, b) AS last, min(v) AS min, avg(v) AS avg, max(v) AS max, (SELECT max(v) FROM f) AS worst_max FROM f GROUP BY 1", points=v.POINTS, f=_FOUND))
def m21(spark, d):
    return metrics.legend(_found(spark, d), ["service"])


# ---- browser vitals ------------------------------------------------------------------------------------------

_CASES = lambda k: "CASE metric " + " ".join(f"WHEN '{m}' THEN {t[k]}" for m, t in rum.THRESHOLDS.items()) + " END"
_VIT = v.VITALS
_SUMMARY = f"""SELECT app, metric, count(*) AS count, quantile_disc(value, 0.75) AS p75, count(*) FILTER (value <= g) AS good, count(*) FILTER (value > g AND value <= p) AS needs, count(*) FILTER (value > p) AS poor FROM
 (SELECT *, {_CASES(0)} AS g, {_CASES(1)} AS p FROM (SELECT *, substr(metric_name, 12) AS metric FROM vitals)) WHERE g IS NOT NULL GROUP BY app, metric"""
_RATED = lambda rows: f"SELECT *, CASE WHEN p75 <= {_CASES(0)} THEN 'good' WHEN p75 <= {_CASES(1)} THEN 'needs' ELSE 'poor' END AS rating FROM ({rows})"


def _vsum(spark, d):
    return rum.vitals_summary(v.vitals(spark, d), in_window("metrics", S, E), by_app=True, exact=True)


def _pages(spark, d):
    return rum.pages(v.vitals(spark, d), in_window("metrics", S, E), by_app=True, exact=True)


def _issues(spark, d):
    return rum.issues(v.browser_errors(spark, d), in_window("logs", S, E), by_app=True)


@query("r1_vitals_summary", v.sql(_RATED(_SUMMARY), vitals=_VIT))
def r1(spark, d):
    return _vsum(spark, d)


_BREAK = lambda key: f"SELECT app, {key}, max(p75) FILTER (metric = 'lcp') AS lcp_p75, max(p75) FILTER (metric = 'inp') AS inp_p75, max(p75) FILTER (metric = 'cls') AS cls_p75, max(n) AS pageviews FROM (SELECT app, {key}, substr(metric_name, 12) AS metric, count(*) AS n, quantile_disc(value, 0.75) AS p75 FROM vitals WHERE substr(metric_name, 12) IN ('lcp', 'inp', 'cls', 'view_duration') GROUP BY ALL) GROUP BY app, {key}"


@query("r2_vitals_breakdown", v.sql(f"SELECT app, device AS key, lcp_p75, inp_p75, cls_p75, pageviews FROM ({_BREAK('device')})", vitals=_VIT))
def r2(spark, d):
    return rum.vitals_breakdown(v.vitals(spark, d), in_window("metrics", S, E), "device.type", by_app=True, exact=True)


@query("r3_pages", v.sql(_BREAK("route"), vitals=_VIT))
def r3(spark, d):
    return _pages(spark, d)


_ISSUES = "SELECT app, fingerprint, count(*) AS count, count(DISTINCT session) AS sessions, min(type) AS type, min(body) AS message, min(trace_id) AS trace_id FROM errors GROUP BY 1, 2"


_DETAIL = f"""SELECT 'page' AS section, route AS key, pageviews AS n FROM (SELECT route, max(n) AS pageviews FROM (SELECT route, metric_name, count(*) AS n FROM here WHERE substr(metric_name, 12) IN ('lcp', 'inp', 'cls') GROUP BY 1, 2) GROUP BY 1)
 UNION ALL SELECT 'device', device, max(n) FROM (SELECT device, metric_name, count(*) AS n FROM here WHERE substr(metric_name, 12) IN ('lcp', 'inp', 'cls') GROUP BY 1, 2) GROUP BY 2
 UNION ALL SELECT 'issue', fingerprint, count(*) FROM errors WHERE route = '/cart' GROUP BY 2 UNION ALL SELECT DISTINCT 'lcp', substr(metric_name, 16), NULL FROM here WHERE metric_name LIKE 'web_vitals.lcp.%'"""


@query("r4_page_detail", v.sql(_DETAIL, vitals=_VIT, errors=v.ERRORS, here="SELECT * FROM vitals WHERE route = '/cart'"))
def r4(spark, d):
    found = rum.page_detail(v.vitals(spark, d), v.browser_errors(spark, d), in_window("metrics", S, E), in_window("logs", S, E), "/cart", exact=True)
    n = F.coalesce(F.get_json_object("measures", "$.pageviews"), F.get_json_object("measures", "$.count")).cast("long")
    return found.select("section", "key", n.alias("n"))


_PARTS = ", ".join(f"avg(value) FILTER (metric_name = 'web_vitals.lcp.{p}') AS {p}" for p in rum.SUBPARTS)


@query("r5_lcp_attribution", v.sql(f"SELECT {_PARTS}, (SELECT element FROM vitals WHERE metric_name = 'web_vitals.lcp' GROUP BY 1 ORDER BY count(*) DESC, element LIMIT 1) AS element FROM vitals", vitals=_VIT))
def r5(spark, d):
    return rum.lcp_attribution(v.vitals(spark, d), in_window("metrics", S, E))


@query("r6_error_issues", v.sql(_ISSUES, errors=v.ERRORS))
def r6(spark, d):
    return _issues(spark, d)


@query("r7_issue_header", v.sql("SELECT count(*) AS occurrences, count(DISTINCT session) AS sessions, min(timestamp_nanos) AS first_seen, max(timestamp_nanos) AS last_seen, min(type) AS kind FROM errors WHERE fingerprint = 'fp3'", errors=v.ERRORS))
def r7(spark, d):
    return rum.issue_header(v.browser_errors(spark, d), in_window("logs", S, E), "fp3").drop("stack")


@query("r7_issue_series", v.sql(f"SELECT CAST(b AS INT) AS bucket, {label_sql('b', S, E, 48)} AS start_nanos, coalesce(n, 0) AS count FROM range(48) r(b) LEFT JOIN (SELECT {index_sql('timestamp_nanos', S, E, 48)} AS i, count(*) AS n FROM errors WHERE fingerprint = 'fp3' GROUP BY 1) ON i = b", errors=v.ERRORS))
def r7b(spark, d):
    return rum.issue_series(v.browser_errors(spark, d), in_window("logs", S, E), "fp3", S, E)


@query("r7_newest_events", v.sql("SELECT timestamp_nanos, body, trace_id, app FROM errors WHERE fingerprint = 'fp3' ORDER BY timestamp_nanos DESC, trace_id LIMIT 20", errors=v.ERRORS))
def r7c(spark, d):
    return rum.newest_events(v.browser_errors(spark, d), in_window("logs", S, E), "fp3")


_FACETS = {"exception.type": "type", "error.kind": "kind", "browser.route": "route", "browser.name": "browser", "device.type": "device", "network.connection": "connection"}


@query("r8_error_facets", v.sql("SELECT field, value, count FROM (SELECT *, row_number() OVER (PARTITION BY field ORDER BY count DESC, value) AS r FROM (" + " UNION ALL ".join(f"SELECT '{f}' AS field, {c} AS value, count(*) AS count FROM errors GROUP BY 2" for f, c in _FACETS.items()) + ")) WHERE r <= 20", errors=v.ERRORS))
def r8(spark, d):
    return rum.top_values(v.browser_errors(spark, d), in_window("logs", S, E))


_FLEET = "SELECT metric, CAST(sum(count) AS BIGINT) AS count, CAST(sum(good) AS BIGINT) AS good, CAST(sum(needs) AS BIGINT) AS needs, CAST(sum(poor) AS BIGINT) AS poor, round(sum(p75 * count) / sum(count), 6) AS p75 FROM s GROUP BY metric"


@query("r9_fleet_vitals", v.sql(_RATED(_FLEET), vitals=_VIT, s=_SUMMARY))
def r9(spark, d):
    return rum.fleet_vitals(_vsum(spark, d)).withColumn("p75", F.round("p75", 6))


_APPS = f"""SELECT a.*, coalesce(v.pageviews, 0) AS pageviews, coalesce(e.errors, 0) AS errors, coalesce(e.sessions, 0) AS error_sessions FROM (SELECT app, sum(good) AS good, sum(needs) AS needs, sum(poor) AS poor, max(CASE rating WHEN 'poor' THEN 2 WHEN 'needs' THEN 1 ELSE 0 END) FILTER (metric IN ('lcp', 'inp', 'cls')) AS worst, max(p75) FILTER (metric = 'lcp') AS lcp_p75 FROM ({_RATED(_SUMMARY)}) GROUP BY app) a
 LEFT JOIN (SELECT app, sum(pageviews) AS pageviews FROM ({_BREAK('route')}) GROUP BY app) v USING (app) LEFT JOIN (SELECT app, sum(count) AS errors, sum(sessions) AS sessions FROM ({_ISSUES}) GROUP BY app) e USING (app)"""


@query("r10_fleet_kpis", v.sql("SELECT CAST(sum(pageviews) AS BIGINT) AS pageviews, CAST(sum(good) AS DOUBLE) / sum(good + needs + poor) AS good_share, count(*) FILTER (worst = 0) AS apps_passing, count(*) AS apps, CAST(sum(errors) AS BIGINT) AS errors, CAST(sum(error_sessions) AS BIGINT) AS error_sessions, (SELECT app FROM apps ORDER BY lcp_p75 DESC, app DESC LIMIT 1) AS slowest_app FROM apps", vitals=_VIT, errors=v.ERRORS, apps=_APPS))
def r10(spark, d):
    return rum.fleet_kpis(_vsum(spark, d), _pages(spark, d), _issues(spark, d))


@query("r11_app_ranking", v.sql("SELECT app, CAST(poor AS BIGINT) AS poor, CAST(needs AS BIGINT) AS needs, CAST(errors AS BIGINT) AS errors, CAST(pageviews AS BIGINT) AS pageviews, row_number() OVER (ORDER BY poor DESC, needs DESC, errors DESC, pageviews DESC, app) AS position FROM apps", vitals=_VIT, errors=v.ERRORS, apps=_APPS))
def r11(spark, d):
    return rum.app_ranking(_vsum(spark, d), _pages(spark, d), _issues(spark, d))


@query("r12_top_issues", v.sql(f"{_ISSUES} ORDER BY count DESC, app, fingerprint LIMIT 6", errors=v.ERRORS))
def r12(spark, d):
    return rum.top_issues(_issues(spark, d))


@query("r12_slowest_routes", v.sql(f"{_BREAK('route')} ORDER BY lcp_p75 DESC, app, route LIMIT 5", vitals=_VIT))
def r12b(spark, d):
    return rum.slowest_routes(_pages(spark, d))


@query("r13_lcp_shares", v.sql("SELECT part, average, round(average * 100 / sum(average) OVER (), 6) AS share_pct, average = max(average) OVER () AS dominant FROM (SELECT substr(metric_name, 16) AS part, avg(value) AS average FROM vitals WHERE metric_name LIKE 'web_vitals.lcp.%' GROUP BY 1)", vitals=_VIT))
def r13(spark, d):
    return rum.lcp_shares(v.vitals(spark, d), in_window("metrics", S, E)).withColumn("share_pct", F.round("share_pct", 6))


# ---- hosts ---------------------------------------------------------------------------------------------------

_HOSTLIST = """SELECT host, max(a) FILTER (m = 'system.cpu.utilization') AS cpu, max(t) FILTER (m = 'system.cpu.utilization') AS last_seen, max(a) FILTER (m = 'system.memory.utilization') AS memory, max(a) FILTER (m = 'system.filesystem.utilization') AS disk_max, avg(a) FILTER (m = 'system.filesystem.utilization') AS disk_mean, count(*) FILTER (m = 'system.filesystem.utilization') AS disks,
 max(a) FILTER (m = 'system.gpu.utilization') AS gpu_max, avg(a) FILTER (m = 'system.gpu.utilization') AS gpu_mean, count(*) FILTER (m = 'system.gpu.utilization') AS gpus FROM (SELECT host, metric_name AS m, coalesce(mount, gpu) AS g, avg(value) AS a, max(timestamp_nanos) AS t FROM hosts WHERE metric_name <> 'process.cpu.utilization' AND (metric_name NOT IN ('system.filesystem.utilization', 'system.gpu.utilization') OR coalesce(mount, gpu) IS NOT NULL) GROUP BY 1, 2, 3) GROUP BY host"""


def _hosts(spark, d):
    return infra.host_list(v.hosts(spark, d), in_window("metrics", S, E))


@query("i1_host_list", v.sql(f"SELECT host, cpu, last_seen, memory, disk_max, round(disk_mean, 6) AS disk_mean, disks, gpu_max, round(gpu_mean, 6) AS gpu_mean, gpus, gpus > 0 AS has_gpu FROM ({_HOSTLIST})", hosts=v.HOSTS))
def i1(spark, d):
    return _hosts(spark, d).withColumns({"disk_mean": F.round("disk_mean", 6), "gpu_mean": F.round("gpu_mean", 6)})


@query("i2_host_detail", v.sql("SELECT host, max(timestamp_nanos) FILTER (metric_name = 'system.cpu.utilization') AS last_seen, arg_max(os, timestamp_nanos) AS os_type, array_to_string(list_sort(list_distinct(list(gpu_name) FILTER (gpu_name IS NOT NULL))), ',') AS gpu_names FROM hosts WHERE host = 'host-2' GROUP BY host", hosts=v.HOSTS))
def i2(spark, d):
    return infra.host_detail(v.hosts(spark, d), in_window("metrics", S, E), "host-2").select("host", "last_seen", "os_type", F.array_join("gpu_names", ",").alias("gpu_names"))


@query("i3_host_processes", v.sql("SELECT service, avg(value) * 100 AS cpu_pct FROM hosts WHERE host = 'host-2' AND metric_name = 'process.cpu.utilization' GROUP BY 1", hosts=v.HOSTS))
def i3(spark, d):
    return infra.host_processes(v.hosts(spark, d), in_window("metrics", S, E), "host-2").select("service", "cpu_pct")


_DISK = f"SELECT mount, {_B} AS b, avg(value) AS v FROM hosts WHERE host = 'host-3' AND metric_name = 'system.filesystem.utilization' GROUP BY 1, 2"


@query("i4_host_series", _series(_DISK, "mount", view="hosts", body=v.HOSTS))
def i4(spark, d):
    return infra.host_series(v.hosts(spark, d), "disk", "host-3", S, E, N).withColumnRenamed("mountpoint", "mount")


@query("i5_host_status", v.sql("SELECT max(l) AS worst, round(avg(l), 6) AS mean, count(*) AS groups, CASE WHEN max(l) >= 90 THEN 'error' WHEN max(l) >= 80 THEN 'warning' ELSE 'ok' END AS status FROM (SELECT mount, arg_max(v, b) AS l FROM x GROUP BY 1)", hosts=v.HOSTS, x=_DISK))
def i5(spark, d):
    found = infra.host_series(v.hosts(spark, d), "disk", "host-3", S, E, N)
    return infra.latest_rollup(found, "mountpoint").withColumn("mean", F.round("mean", 6))


@query("i6_host_kpis", v.sql(f"SELECT count(*) AS hosts, count(*) FILTER (w >= 80 AND w < 90) AS warning, count(*) FILTER (w >= 90) AS critical, round(avg(cpu), 6) AS mean_cpu, count(*) FILTER (gpus > 0) AS gpu_hosts FROM (SELECT *, greatest(coalesce(cpu, 0), coalesce(memory, 0), coalesce(disk_max, 0)) AS w FROM ({_HOSTLIST}))", hosts=v.HOSTS))
def i6(spark, d):
    return infra.fleet_kpis(_hosts(spark, d)).withColumn("mean_cpu", F.round("mean_cpu", 6))
