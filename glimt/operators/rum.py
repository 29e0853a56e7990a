"""Real-user monitoring: web vitals, pages, attribution of LCP, error issues, fleet numbers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glimt.functions.buckets import bucket_index, bucket_label, fill
from glimt.functions.fields import quoted, resolve
from glimt.operators.apm import percentiles

#: Upper ends of `good` and of `needs improvement`, names of metrics and attributes.
THRESHOLDS = {"lcp": (2500.0, 4000.0), "inp": (200.0, 500.0), "cls": (0.1, 0.25), "fcp": (1800.0, 3000.0), "ttfb": (800.0, 1800.0), "route_change": (1000.0, 3000.0)}
CORE = ("lcp", "inp", "cls")
SUBPARTS = ("ttfb", "resource_load_delay", "resource_load_time", "element_render_delay")
PREFIX = "web_vitals."
ERROR_FACETS = ("exception.type", "error.kind", "browser.route", "browser.name", "device.type", "network.connection")


def _bound(metric: Column, which: int) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for m, t in THRESHOLDS.items() for x in (m, t[which]))), metric)


def rating(metric: Column, value: Column) -> Column:
    return F.when(value <= _bound(metric, 0), "good").when(value <= _bound(metric, 1), "needs").otherwise("poor")


def _vitals(points: DataFrame, where: Column, names: Sequence[str]) -> DataFrame:
    return points.where(where & F.col("metric_name").isin([PREFIX + n for n in names])).where("value is not null").withColumn("metric", F.substring("metric_name", len(PREFIX) + 1, 100))


def vitals_summary(points: DataFrame, where: Column, by_app: bool = False, exact: bool = False) -> DataFrame:
    """Per vital (and app): count, p75, how many were good, need improvement or poor, and the rating of the p75."""
    rows = _vitals(points, where, list(THRESHOLDS)).withColumn("app", quoted("service.name"))
    v, m = F.col("value"), F.col("metric")
    keys = (["app"] if by_app else []) + ["metric"]
    out = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("count"), percentiles("value", [0.75], exact)[0].alias("p75"), F.count_if(v <= _bound(m, 0)).alias("good"),
        F.count_if((v > _bound(m, 0)) & (v <= _bound(m, 1))).alias("needs"), F.count_if(v > _bound(m, 1)).alias("poor"))
    return out.withColumn("rating", rating(F.col("metric"), F.col("p75")))


def vitals_breakdown(points: DataFrame, where: Column, dimension: str, by_app: bool = False, exact: bool = False) -> DataFrame:
    """Per value of a dimension: p75 of LCP, INP and CLS, and pageviews, the most samples that any vital has."""
    rows = _vitals(points, where, [*CORE, "view_duration"]).withColumns({"key": resolve(points, "metrics", dimension), "app": quoted("service.name")}).where("key is not null")
    keys = (["app"] if by_app else []) + ["key"]
    per = rows.groupBy(*keys, "metric").agg(F.count(F.lit(1)).alias("n"), percentiles("value", [0.75], exact)[0].alias("p75"))
    return per.groupBy(*keys).agg(*(F.max(F.when(F.col("metric") == m, F.col("p75"))).alias(f"{m}_p75") for m in CORE), F.max("n").alias("pageviews"))


def pages(points: DataFrame, where: Column, by_app: bool = False, exact: bool = False) -> DataFrame:
    return vitals_breakdown(points, where, "browser.route", by_app, exact).withColumnRenamed("key", "route")


def lcp_attribution(points: DataFrame, where: Column) -> DataFrame:
    """One row: averages of the four parts of LCP and its most common element."""
    parts = points.where(where).where(F.col("metric_name").isin([f"{PREFIX}lcp.{p}" for p in SUBPARTS]))
    average = parts.agg(*(F.avg(F.when(F.col("metric_name") == f"{PREFIX}lcp.{p}", F.col("value"))).alias(p) for p in SUBPARTS)).withColumn("_one", F.lit(1))
    elements = points.where(where).where(F.col("metric_name") == PREFIX + "lcp").select(F.col("attributes").getItem("lcp.element").alias("e")).where("e is not null").groupBy("e").agg(F.count(F.lit(1)).alias("n"))
    top = elements.agg(F.min_by("e", F.struct(-F.col("n"), "e")).alias("element")).withColumn("_one", F.lit(1))
    return average.join(F.broadcast(top), "_one").drop("_one")  # one row each


def lcp_shares(points: DataFrame, where: Column) -> DataFrame:
    """Per part of LCP its average, its share of all four, and whether it is the largest."""
    rows = lcp_attribution(points, where).select(F.explode(F.array(*(F.struct(F.lit(p).alias("part"), F.col(p).alias("average")) for p in SUBPARTS))).alias("x")).select("x.*").where("average is not null")
    whole = Window.partitionBy(F.lit(0))
    return rows.withColumns({"share_pct": F.try_divide(F.col("average") * 100, F.sum("average").over(whole)), "dominant": F.col("part") == F.max_by("part", "average").over(whole)})


def page_detail(points: DataFrame, errors: DataFrame, where: Column, error_where: Column, route: str, exact: bool = False) -> DataFrame:
    """The page's row, its device rows, its error issues and LCP parts as (section, key, measures as JSON)."""
    here, err_here = where & (F.col("attributes").getItem("browser.route") == route), error_where & (F.col("attributes").getItem("browser.route") == route)
    section = lambda name, key, df: df.select(F.lit(name).alias("section"), F.col(key).cast("string").alias("key"), F.to_json(F.struct(*(c for c in df.columns if c != key))).alias("measures"))
    return (section("page", "route", pages(points, here, exact=exact)).unionByName(section("device", "key", vitals_breakdown(points, here, "device.type", exact=exact)))
            .unionByName(section("issue", "fingerprint", issues(errors, err_here))).unionByName(section("lcp", "part", lcp_shares(points, here))))


def _errors(errors: DataFrame, where: Column) -> DataFrame:
    get = lambda name: resolve(errors, "logs", name)
    return errors.where(where).where(F.col("severity_number").between(17, 24)).withColumns({"fingerprint": get("rum.error.fingerprint"), "_type": get("exception.type"), "_session": get("session.id"), "_stack": get("exception.stacktrace"), "app": quoted("service.name")}).where("fingerprint is not null")


def issues(errors: DataFrame, where: Column, route: str | None = None, by_app: bool = False) -> DataFrame:
    """Per fingerprint: occurrences, sessions, and a type, message and trace id of it."""
    if route is not None:
        where = where & (resolve(errors, "logs", "browser.route") == route)
    return _errors(errors, where).groupBy(*(["app"] if by_app else []), "fingerprint").agg(F.count(F.lit(1)).alias("count"), F.count_distinct("_session").alias("sessions"), F.min("_type").alias("type"), F.min("body").alias("message"), F.min("trace_id").alias("trace_id"))


def issue_header(errors: DataFrame, where: Column, fingerprint: str) -> DataFrame:
    rows = _errors(errors, where).where(F.col("fingerprint") == fingerprint)
    stack = F.when(F.coalesce(F.col("_stack"), F.lit("")) != "", F.struct("timestamp_nanos", "trace_id", F.col("_stack").alias("stack")))
    return rows.agg(F.count(F.lit(1)).alias("occurrences"), F.count_distinct("_session").alias("sessions"), F.min("timestamp_nanos").alias("first_seen"), F.max("timestamp_nanos").alias("last_seen"), F.min("_type").alias("kind"), F.min(stack)["stack"].alias("stack"))


def issue_series(errors: DataFrame, where: Column, fingerprint: str, start: int, end: int, n: int = 48) -> DataFrame:
    rows = _errors(errors, where).where((F.col("fingerprint") == fingerprint) & F.col("timestamp_nanos").between(start, end)).withColumn("bucket", bucket_index(F.col("timestamp_nanos"), start, end, n))
    return fill(rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("count")), n, zero=["count"]).withColumn("start_nanos", bucket_label(F.col("bucket"), start, end, n))


def top_values(errors: DataFrame, where: Column, fields: Sequence[str] = ERROR_FACETS, limit: int = 20, fingerprint: str | None = None) -> DataFrame:
    """The most frequent values of several fields in one pass: field, value, count."""
    rows = _errors(errors, where) if fingerprint is None else _errors(errors, where).where(F.col("fingerprint") == fingerprint)
    pairs = rows.select(F.explode(F.array(*(F.struct(F.lit(f).alias("field"), resolve(errors, "logs", f).alias("value")) for f in fields))).alias("x")).select("x.*").where("value is not null")
    counted = pairs.groupBy("field", "value").agg(F.count(F.lit(1)).alias("count"))
    rank = F.row_number().over(Window.partitionBy("field").orderBy(F.desc("count"), "value"))
    return counted.withColumn("_r", rank).where(F.col("_r") <= limit).drop("_r")


def newest_events(errors: DataFrame, where: Column, fingerprint: str, limit: int = 20) -> DataFrame:
    return _errors(errors, where).where(F.col("fingerprint") == fingerprint).orderBy(F.desc("timestamp_nanos"), "trace_id").limit(limit).select("timestamp_nanos", "body", "trace_id", "app")


def fleet_vitals(summary: DataFrame) -> DataFrame:
    """Over apps: summed ratings, and the mean p75 weighted by count (a plain mean without counts)."""
    out = summary.groupBy("metric").agg(*(F.sum(c).alias(c) for c in ("count", "good", "needs", "poor")), F.coalesce(F.try_divide(F.sum(F.col("p75") * F.col("count")), F.sum("count")), F.avg("p75")).alias("p75"))
    return out.withColumn("rating", rating(F.col("metric"), F.col("p75")))


def _by_app(summary: DataFrame, pageviews: DataFrame, issue_rows: DataFrame) -> DataFrame:
    rank = F.when(F.col("rating") == "poor", 2).when(F.col("rating") == "needs", 1).otherwise(0)
    worst = F.max(F.when(F.col("metric").isin(*CORE), rank))
    base = summary.groupBy("app").agg(F.sum("good").alias("good"), F.sum("needs").alias("needs"), F.sum("poor").alias("poor"), worst.alias("worst"), F.max(F.when(F.col("metric") == "lcp", F.col("p75"))).alias("lcp_p75"))
    views = pageviews.groupBy("app").agg(F.sum("pageviews").alias("pageviews"))
    errors = issue_rows.groupBy("app").agg(F.sum("count").alias("errors"), F.sum("sessions").alias("error_sessions"))
    return base.join(views, "app", "left").join(errors, "app", "left").fillna(0, ["pageviews", "errors", "error_sessions"])


def fleet_kpis(summary: DataFrame, pageviews: DataFrame, issue_rows: DataFrame) -> DataFrame:
    """One row: pageviews, share of good samples, apps whose worst core rating is good, errors, sessions with errors, slowest app by LCP."""
    rows = _by_app(summary, pageviews, issue_rows)
    return rows.agg(F.sum("pageviews").alias("pageviews"), F.try_divide(F.sum("good"), F.sum(F.col("good") + F.col("needs") + F.col("poor"))).alias("good_share"), F.count_if(F.col("worst") == 0).alias("apps_passing"), F.count(F.lit(1)).alias("apps"), F.sum("errors").alias("errors"), F.sum("error_sessions").alias("error_sessions"), F.max_by("app", F.struct("lcp_p75", "app")).alias("slowest_app"))


def app_ranking(summary: DataFrame, pageviews: DataFrame, issue_rows: DataFrame) -> DataFrame:
    """Apps with a position: poor, then samples that need improvement, errors and pageviews, most first."""
    order = Window.partitionBy(F.lit(0)).orderBy(F.desc("poor"), F.desc("needs"), F.desc("errors"), F.desc("pageviews"), "app")
    return _by_app(summary, pageviews, issue_rows).select("app", "poor", "needs", "errors", "pageviews").withColumn("position", F.row_number().over(order))


def top_issues(issue_rows: DataFrame, limit: int = 6) -> DataFrame:
    return issue_rows.orderBy(F.desc("count"), "app", "fingerprint").limit(limit)


def slowest_routes(page_rows: DataFrame, limit: int = 5) -> DataFrame:
    return page_rows.where("lcp_p75 is not null").orderBy(F.desc("lcp_p75"), "app", "route").limit(limit)
