"""Telemetry tables derived from the given ones, each once in Spark and once as DuckDB SQL.

Only integer arithmetic is used, so both sides hold the same rows.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

LINE = "l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_extendedprice l_discount l_tax l_returnflag l_linestatus l_shipdate".split()
#: The month of the events, and a year of the orders, in nanoseconds.
MONTH = (1_704_067_200_000_000_000, 1_706_659_200_000_000_000)
YEAR = (820_454_400_000_000_000, 852_076_800_000_000_000)
HOUR = 3_600_000_000_000


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.sparkContext.environment.setdefault("PYTHONPATH", str(Path(__file__).resolve().parents[2]))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def nanos(column: str) -> Column:
    return F.unix_micros(F.col(column).cast("timestamp")) * 1000


def attributes(**values: Column) -> Column:
    """A map of those that are set."""
    pairs = F.create_map(*(x for k, v in values.items() for x in (F.lit(k.replace("__", ".")), v.cast("string"))))
    return F.map_filter(pairs, lambda k, v: v.isNotNull())


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    rn = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*LINE))
    rows = read(spark, sf_dir, "lineitem").withColumn("rn", rn).join(read(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"), F.col("l_orderkey") == F.col("o_orderkey"))
    trace, start = F.col("l_orderkey").cast("string"), nanos("o_orderdate") + F.col("rn").cast("long") * 1_000_000
    span = lambda n: F.concat_ws("-", trace, n.cast("string"))
    duration, part = F.round(F.col("l_extendedprice") * 1000).cast("long"), F.col("l_partkey") % 4
    return rows.select(
        trace.alias("trace_id"), span(F.col("rn")).alias("span_id"), F.when(F.col("rn") > 1, span(F.floor(F.col("rn") / 2))).alias("parent_span_id"),
        F.concat("l_returnflag", "l_linestatus").alias("name"), (F.col("l_linenumber") % 5 + 1).cast("int").alias("kind"), start.alias("start_time_nanos"), (start + duration).alias("end_time_nanos"), duration.alias("duration_nanos"),
        F.when(F.col("l_returnflag") == "R", 2).when(F.col("l_returnflag") == "A", 1).otherwise(0).alias("status_code"), F.concat(F.lit("svc-"), F.col("l_suppkey") % 10).alias("service.name"), F.concat(F.lit("t"), F.col("l_suppkey") % 3).alias("tenant"),
        attributes(db__system=F.when(part == 0, "postgres"), db__name=F.when(part == 0, F.concat(F.lit("db"), F.col("l_suppkey") % 3)), server__address=F.when(part == 1, F.concat(F.lit("srv"), F.col("l_suppkey") % 4)), peer__service=F.when(part == 2, F.concat(F.lit("svc-"), F.col("l_suppkey") % 7)), lines=F.col("l_linenumber")).alias("attributes"))


SPANS = """SELECT CAST(l_orderkey AS VARCHAR) AS trace_id, l_orderkey || '-' || rn AS span_id, CASE WHEN rn > 1 THEN l_orderkey || '-' || (rn // 2) END AS parent_span_id,
 l_returnflag || l_linestatus AS name, l_linenumber % 5 + 1 AS kind, epoch_us(o_orderdate) * 1000 + rn * 1000000 AS start_time_nanos,
 CAST(round(l_extendedprice * 1000) AS BIGINT) AS duration_nanos, epoch_us(o_orderdate) * 1000 + rn * 1000000 + CAST(round(l_extendedprice * 1000) AS BIGINT) AS end_time_nanos,
 CASE l_returnflag WHEN 'R' THEN 2 WHEN 'A' THEN 1 ELSE 0 END AS status_code, 'svc-' || (l_suppkey % 10) AS service, 't' || (l_suppkey % 3) AS tenant,
 CASE WHEN l_partkey % 4 = 0 THEN 'postgres' END AS db_system, CASE WHEN l_partkey % 4 = 0 THEN 'db' || (l_suppkey % 3) END AS db_name,
 CASE WHEN l_partkey % 4 = 1 THEN 'srv' || (l_suppkey % 4) END AS server_address, CASE WHEN l_partkey % 4 = 2 THEN 'svc-' || (l_suppkey % 7) END AS peer_service, CAST(l_linenumber AS VARCHAR) AS lines
 FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY """ + ", ".join(LINE) + """) AS rn FROM lineitem) JOIN orders ON l_orderkey = o_orderkey"""


def logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    severity = F.when(kind == "error", 17).when(kind == "signup", 13).when(kind == "purchase", 9).when(kind == "view", 5)
    text = F.when(kind == "error", "ERROR").when(kind == "signup", "WARN").when(kind == "purchase", "INFO").when(kind == "view", "DEBUG")
    user = F.col("user_id")
    return read(spark, sf_dir, "events").select(
        nanos("ts").alias("timestamp_nanos"), severity.alias("severity_number"), text.alias("severity_text"), F.concat_ws(" ", kind, "props").alias("body"), F.col("event_id").cast("string").alias("trace_id"), F.concat(F.col("event_id"), F.lit("-1")).alias("span_id"),
        F.concat(F.lit("svc-"), user % 10).alias("service.name"), F.concat(F.lit("host-"), user % 7).alias("host.name"),
        attributes(user__id=user, k=F.regexp_extract("props", r"(\d+)", 1), session__id=user % 40).alias("attributes"))


LOGS = r"""SELECT epoch_us(ts) * 1000 AS timestamp_nanos, CASE event_type WHEN 'error' THEN 17 WHEN 'signup' THEN 13 WHEN 'purchase' THEN 9 WHEN 'view' THEN 5 END AS severity_number,
 CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'signup' THEN 'WARN' WHEN 'purchase' THEN 'INFO' WHEN 'view' THEN 'DEBUG' END AS severity_text, event_type || ' ' || props AS body,
 CAST(event_id AS VARCHAR) AS trace_id, event_id || '-1' AS span_id, 'svc-' || (user_id % 10) AS service, 'host-' || (user_id % 7) AS host,
 CAST(user_id AS VARCHAR) AS user_id, regexp_extract(props, '(\d+)', 1) AS k, CAST(user_id % 40 AS VARCHAR) AS session_id FROM events"""


def text_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as log bodies, for free text over real prose."""
    return read(spark, sf_dir, "documents").select(F.col("doc_id").alias("timestamp_nanos"), F.lit(None).cast("int").alias("severity_number"), F.col("text").alias("body"), F.col("doc_id").cast("string").alias("trace_id"), F.lit(None).cast("string").alias("span_id"), F.col("source").alias("service.name"), attributes(lang=F.col("lang")).alias("attributes"))


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A gauge (cents), a delta sum (cents) and a cumulative counter (restarts after 50 samples of a user) from the events."""
    user, cents = F.col("user_id"), F.round(F.col("value") * 100).cast("long")
    nth = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    base = read(spark, sf_dir, "events").select(nanos("ts").alias("timestamp_nanos"), user.alias("user"), cents.alias("cents"), nth.cast("long").alias("nth"))
    counter = F.sum("cents").over(Window.partitionBy("user", F.expr("nth div 50")).orderBy("nth")).cast("double")
    one = lambda name, kind, temporality, monotonic, value: F.struct(F.lit(name).alias("metric_name"), F.lit(kind).alias("metric_type"), F.lit(temporality).cast("int").alias("temporality"), F.lit(monotonic).cast("boolean").alias("is_monotonic"), value.alias("value"))
    rows = base.withColumn("total", counter).select("*", F.explode(F.array(one("queue.depth", 0, None, None, F.col("cents").cast("double")), one("bytes.sent", 1, 1, True, F.col("cents").cast("double")), one("requests_total", 1, 2, True, F.col("total")))).alias("m"))
    return rows.select("m.*", "timestamp_nanos", F.lit(None).cast("long").alias("start_nanos"), F.lit("1").alias("unit"), F.element_at(F.array(F.lit("gauge"), F.lit("sum")), F.col("m.metric_type") + 1).alias("type_text"), F.concat(F.lit("svc-"), F.col("user") % 10).alias("service.name"), F.concat(F.lit("host-"), F.col("user") % 7).alias("host.name"), F.concat(F.lit("t"), F.col("user") % 3).alias("tenant"), attributes(user=F.col("user")).alias("attributes"))


POINTS = """SELECT metric_name, metric_type, temporality, is_monotonic, CAST(v AS DOUBLE) AS value, timestamp_nanos, 'svc-' || (u % 10) AS service, 'host-' || (u % 7) AS host, 't' || (u % 3) AS tenant, CAST(u AS VARCHAR) AS user FROM
 (WITH e AS (SELECT epoch_us(ts) * 1000 AS timestamp_nanos, user_id AS u, CAST(round(value * 100) AS BIGINT) AS cents, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS nth FROM events),
  f AS (SELECT *, sum(cents) OVER (PARTITION BY u, nth // 50 ORDER BY nth) AS total FROM e)
  SELECT 'queue.depth' AS metric_name, 0 AS metric_type, NULL::INT AS temporality, NULL::BOOLEAN AS is_monotonic, cents AS v, timestamp_nanos, u FROM f
  UNION ALL SELECT 'bytes.sent', 1, 1, true, cents, timestamp_nanos, u FROM f UNION ALL SELECT 'requests_total', 1, 2, true, total, timestamp_nanos, u FROM f)"""

BOUNDS = (10.0, 20.0, 30.0, 40.0)


def histograms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Delta histograms of line quantities, a point for each day and supplier."""
    q = F.col("l_quantity")
    edges = [float("-inf"), *BOUNDS, float("inf")]
    counts = F.array(*(F.count_if((q > a) & (q <= b)) for a, b in zip(edges, edges[1:], strict=False)))
    days = read(spark, sf_dir, "lineitem").groupBy(F.col("l_shipdate"), "l_suppkey").agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("s"), counts.alias("c"))
    value = F.struct(F.col("n").alias("count"), F.col("s").alias("sum"), F.col("c").alias("bucket_counts"), F.array(*map(F.lit, BOUNDS)).alias("explicit_bounds"), F.lit(None).cast("double").alias("min"), F.lit(None).cast("double").alias("max"))
    return days.select(F.lit("line.quantity").alias("metric_name"), F.lit(2).alias("metric_type"), F.lit(1).alias("temporality"), nanos("l_shipdate").alias("timestamp_nanos"), F.lit(None).cast("long").alias("start_nanos"), F.lit(None).cast("double").alias("value"), value.alias("histogram"), F.concat(F.lit("svc-"), F.col("l_suppkey") % 10).alias("service.name"), attributes(supplier=F.col("l_suppkey")).alias("attributes"))


def classic_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events' values as Prometheus histogram counters of each user: value_bucket{le}, value_sum and value_count."""
    user, cents = F.col("user_id"), F.round(F.col("value") * 100).cast("long")
    rows = read(spark, sf_dir, "events").select(nanos("ts").alias("timestamp_nanos"), user.alias("user"), cents.alias("cents"), "event_id")
    order = Window.partitionBy("user", "name", "le").orderBy("timestamp_nanos", "event_id")
    part = lambda name, le, add: F.struct(F.lit(name).alias("name"), F.lit(le).cast("string").alias("le"), add.cast("double").alias("add"))
    parts = [part("value_bucket", le, (F.col("cents") <= (10**15 if le == "+Inf" else int(le))).cast("int")) for le in ("500", "1000", "2000", "5000", "+Inf")]
    parts += [part("value_sum", None, F.col("cents")), part("value_count", None, F.lit(1))]
    long = rows.select("*", F.explode(F.array(*parts)).alias("p")).select("timestamp_nanos", "user", "event_id", "p.*").withColumn("value", F.sum("add").over(order))
    return long.select(F.col("name").alias("metric_name"), F.lit(1).alias("metric_type"), F.lit(2).alias("temporality"), F.lit(True).alias("is_monotonic"), "timestamp_nanos", F.lit(None).cast("long").alias("start_nanos"), "value", F.concat(F.lit("svc-"), F.col("user") % 10).alias("service.name"), attributes(le=F.col("le"), user=F.col("user")).alias("attributes"))


ROUTES = ("/", "/cart", "/pay", "/help")


def vitals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Browser vitals: click is INP, view LCP, purchase FCP, signup TTFB, error CLS, from the events' values."""
    kind, user, cents = F.col("event_type"), F.col("user_id"), F.round(F.col("value") * 100).cast("long")
    name = F.concat(F.lit("web_vitals."), F.element_at(F.create_map(*(F.lit(x) for pair in (("click", "inp"), ("view", "lcp"), ("purchase", "fcp"), ("signup", "ttfb"), ("error", "cls")) for x in pair)), kind))
    part = F.concat(F.lit("web_vitals.lcp."), F.element_at(F.array(*map(F.lit, ("ttfb", "resource_load_delay", "resource_load_time", "element_render_delay"))), (F.col("event_id") % 4 + 1).cast("int")))
    value = F.when(kind == "error", cents / 10_000.0).otherwise(cents.cast("double"))
    rows = read(spark, sf_dir, "events").select("*", F.explode(F.array_compact(F.array(F.struct(name.alias("n"), value.alias("v")), F.when(kind == "view", F.struct(part.alias("n"), cents.cast("double").alias("v")))))).alias("m"))
    return rows.select(
        F.col("m.n").alias("metric_name"), F.lit(0).alias("metric_type"), nanos("ts").alias("timestamp_nanos"), F.col("m.v").alias("value"), F.concat(F.lit("app"), user % 3).alias("service.name"),
        attributes(browser__route=F.element_at(F.array(*map(F.lit, ROUTES)), (user % 4 + 1).cast("int")), device__type=F.when(user % 2 == 0, "mobile").otherwise("desktop"), session__id=user % 40, lcp__element=F.when(kind == "view", F.concat(F.lit("img#"), user % 5))).alias("attributes"))


_ROUTE = "CASE user_id % 4 WHEN 0 THEN '/' WHEN 1 THEN '/cart' WHEN 2 THEN '/pay' ELSE '/help' END"
VITALS = f"""SELECT 'web_vitals.' || CASE event_type WHEN 'click' THEN 'inp' WHEN 'view' THEN 'lcp' WHEN 'purchase' THEN 'fcp' WHEN 'signup' THEN 'ttfb' ELSE 'cls' END AS metric_name, epoch_us(ts) * 1000 AS timestamp_nanos,
 CASE WHEN event_type = 'error' THEN round(value * 100) / 10000.0 ELSE round(value * 100) END AS value, 'app' || (user_id % 3) AS app, {_ROUTE} AS route, CASE WHEN user_id % 2 = 0 THEN 'mobile' ELSE 'desktop' END AS device, CASE WHEN event_type = 'view' THEN 'img#' || (user_id % 5) END AS element FROM events
 UNION ALL SELECT 'web_vitals.lcp.' || CASE event_id % 4 WHEN 0 THEN 'ttfb' WHEN 1 THEN 'resource_load_delay' WHEN 2 THEN 'resource_load_time' ELSE 'element_render_delay' END, epoch_us(ts) * 1000, round(value * 100), 'app' || (user_id % 3), {_ROUTE}, CASE WHEN user_id % 2 = 0 THEN 'mobile' ELSE 'desktop' END, 'img#' || (user_id % 5) FROM events WHERE event_type = 'view'"""


def browser_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Error events as browser error logs with a fingerprint."""
    user = F.col("user_id")
    k = F.regexp_extract("props", r"(\d+)", 1)
    return read(spark, sf_dir, "events").where("event_type = 'error'").select(
        nanos("ts").alias("timestamp_nanos"), F.lit(17).alias("severity_number"), F.concat(F.lit("fail "), k).alias("body"), F.col("event_id").cast("string").alias("trace_id"), F.concat(F.lit("app"), user % 3).alias("service.name"),
        attributes(rum__error__fingerprint=F.concat(F.lit("fp"), k.cast("int") % 12), exception__type=F.concat(F.lit("E"), k.cast("int") % 4), session__id=user % 40, error__kind=F.concat(F.lit("k"), user % 2), network__connection=F.concat(F.lit("n"), user % 5), browser__route=F.element_at(F.array(*map(F.lit, ROUTES)), (user % 4 + 1).cast("int")), device__type=F.when(user % 2 == 0, "mobile").otherwise("desktop"), browser__name=F.concat(F.lit("b"), user % 3), exception__stacktrace=F.when(F.col("event_id") % 5 == 0, F.concat(F.lit("at line "), k))).alias("attributes"))


ERRORS = rf"""SELECT epoch_us(ts) * 1000 AS timestamp_nanos, 'fail ' || kk AS body, CAST(event_id AS VARCHAR) AS trace_id, 'app' || (user_id % 3) AS app, 'fp' || (CAST(kk AS INT) % 12) AS fingerprint, 'E' || (CAST(kk AS INT) % 4) AS type,
 CAST(user_id % 40 AS VARCHAR) AS session, {_ROUTE} AS route, CASE WHEN user_id % 2 = 0 THEN 'mobile' ELSE 'desktop' END AS device, 'b' || (user_id % 3) AS browser, 'k' || (user_id % 2) AS kind, 'n' || (user_id % 5) AS connection FROM (SELECT *, regexp_extract(props, '(\d+)', 1) AS kk FROM events WHERE event_type = 'error')"""

HOST_METRICS = {"view": "system.cpu.utilization", "click": "system.memory.utilization", "purchase": "system.filesystem.utilization", "signup": "system.gpu.utilization", "error": "process.cpu.utilization"}


def hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host and process gauges from the events, in hundredths."""
    user, kind = F.col("user_id"), F.col("event_type")
    name = F.element_at(F.create_map(*(F.lit(x) for pair in HOST_METRICS.items() for x in pair)), kind)
    group = F.concat(F.lit("d"), user % 3)
    return read(spark, sf_dir, "events").select(
        name.alias("metric_name"), F.lit(0).alias("metric_type"), nanos("ts").alias("timestamp_nanos"), (F.round(F.col("value") * 100).cast("long") % 101).cast("double").alias("value"), F.concat(F.lit("svc-"), user % 10).alias("service.name"), F.concat(F.lit("host-"), user % 7).alias("host.name"),
        attributes(mountpoint=F.when(kind == "purchase", group), gpu=F.when((kind == "signup") & (user % 7 < 4), group), gpu__name=F.when((kind == "signup") & (user % 7 < 4), F.concat(F.lit("G"), user % 2)), os__type=F.when(user % 2 == 0, "linux").otherwise("bsd")).alias("attributes"))


HOSTS = """SELECT CASE event_type WHEN 'view' THEN 'system.cpu.utilization' WHEN 'click' THEN 'system.memory.utilization' WHEN 'purchase' THEN 'system.filesystem.utilization' WHEN 'signup' THEN 'system.gpu.utilization' ELSE 'process.cpu.utilization' END AS metric_name,
 epoch_us(ts) * 1000 AS timestamp_nanos, CAST(CAST(round(value * 100) AS BIGINT) % 101 AS DOUBLE) AS value, 'svc-' || (user_id % 10) AS service, 'host-' || (user_id % 7) AS host,
 CASE WHEN event_type = 'purchase' THEN 'd' || (user_id % 3) END AS mount, CASE WHEN event_type = 'signup' AND user_id % 7 < 4 THEN 'd' || (user_id % 3) END AS gpu, CASE WHEN event_type = 'signup' AND user_id % 7 < 4 THEN 'G' || (user_id % 2) END AS gpu_name, CASE WHEN user_id % 2 = 0 THEN 'linux' ELSE 'bsd' END AS os FROM events"""


def heartbeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A monitor for each user; an error event is a failed beat."""
    ok = F.col("event_type") != "error"
    return read(spark, sf_dir, "events").select(F.concat(F.lit("m"), "user_id").alias("monitor_id"), (F.unix_micros(F.col("ts").cast("timestamp"))).alias("ts"), ok.alias("ok"), F.when(ok, F.round(F.col("value") * 100).cast("long")).alias("latency_ms"), F.when(~ok, F.col("props")).alias("error"))


BEATS = "SELECT 'm' || user_id AS monitor_id, epoch_us(ts) AS ts, event_type <> 'error' AS ok, CASE WHEN event_type <> 'error' THEN CAST(round(value * 100) AS BIGINT) END AS latency_ms, CASE WHEN event_type = 'error' THEN props END AS error FROM events"


def sql(body: str, **views: str) -> str:
    """``body`` with the named views as common table expressions."""
    return "WITH " + ", ".join(f"{k} AS ({v})" for k, v in views.items()) + " " + body if views else body
