"""Alert rules: samples of conditions, thresholds, the state machine over evaluations, incidents."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glimt.functions.fields import quoted, resolve
from glimt.functions.terms import log_filter, span_filter
from glimt.operators import apm, metrics, rum


def series_key(labels: Sequence[str]) -> Column:
    """`k=v,k=v` by key; empty for a rule without labels."""
    return F.concat_ws(",", *(F.concat(F.lit(f"{x}="), F.coalesce(quoted(x), F.lit(""))) for x in sorted(labels)))


def metric_sample(points: DataFrame, name: str, now: int, window: int, agg: str = "avg", labels: Sequence[str] = (), terms: Sequence[Column] = ()) -> DataFrame:
    """(series_key, value) of a metric over one bucket, [now - window, now]."""
    if agg == "p95":
        raise ValueError("p95 is no alert aggregation")
    found = metrics.series(points, name, now - window, now, 1, agg, labels, terms)
    return found.select(series_key(labels).alias("series_key"), F.col("v").alias("value")).where("value is not null")


def log_sample(logs: DataFrame, now: int, window: int, terms: Sequence[Column] = (), by_service: bool = False) -> DataFrame:
    """Matching logs; 0 is a sample only where nothing groups them."""
    rows = logs.where(log_filter(logs, now - window, now, terms=terms))
    if by_service:
        return rows.groupBy(F.concat(F.lit("service="), quoted("service.name")).alias("series_key")).agg(F.count(F.lit(1)).cast("double").alias("value"))
    return rows.agg(F.count(F.lit(1)).cast("double").alias("value")).select(F.lit("").alias("series_key"), "value")


def trace_sample(spans: DataFrame, now: int, window: int, measure: str, terms: Sequence[Column] = (), exact: bool = False) -> DataFrame:
    """Per service: error_rate in percent, request_rate a second, or p50, p90, p99 in nanoseconds."""
    red = apm.red_by_service(spans, span_filter(now - window, now, terms), exact=exact)
    value = {"error_rate": F.col("errors") * 100.0 / F.col("count"), "request_rate": F.col("count") / F.lit(window / 1e9)}.get(measure, F.col(measure).cast("double") if measure.startswith("p") else None)
    return red.select(F.concat_ws(",", F.concat(F.lit("service="), "service"), F.concat(F.lit("tenant="), "tenant")).alias("series_key"), value.alias("value"))


def rum_sample(points: DataFrame, errors: DataFrame, where: Column, measure: str, route: str | None = None, exact: bool = False) -> DataFrame:
    """The p75 of a vital, or the number of errors, of the given rows."""
    if measure == "errors":
        return rum.issues(errors, where, route).agg(F.coalesce(F.sum("count"), F.lit(0)).cast("double").alias("value")).select(F.lit("").alias("series_key"), "value")
    if route is not None:
        where = where & (F.col("attributes").getItem("browser.route") == route)
    return rum.vitals_summary(points, where, exact=exact).where(F.col("metric") == measure).select(F.lit("").alias("series_key"), F.col("p75").alias("value"))


def metric_samples(points: DataFrame, rules: Mapping[str, Mapping], now: int) -> DataFrame:
    """(rule_id, series_key, value) of many metric rules in one scan. A rule has name and window, and perhaps agg, labels and terms."""
    if any(r.get("agg") == "p95" for r in rules.values()):
        raise ValueError("p95 is no alert aggregation")
    specs = {k: {x: v for x, v in r.items() if x != "window"} | {"start": now - r["window"], "end": now, "n": 1} for k, r in rules.items()}

    def pack(df: DataFrame, labels: Sequence[str]) -> Column:
        values = {x: quoted(x) if x in df.columns else resolve(df, "metrics", x).cast("string") for x in labels}
        return F.concat_ws(",", *(F.concat(F.lit(f"{x}="), F.coalesce(values[x], F.lit(""))) for x in sorted(values)))

    found = metrics.shared(points, specs, pack)
    return found.where("v is not null").select(F.col("query").alias("rule_id"), F.col("labels").alias("series_key"), F.col("v").alias("value"))


def _fed(rows: DataFrame, conditions: Mapping[str, Column]) -> DataFrame:
    """Each row once for each rule that it feeds, as ``rule_id``; rows that feed none are filtered out first."""
    some = reduce(lambda a, b: a | b, (F.coalesce(c, F.lit(False)) for c in conditions.values()))
    fed = F.array_compact(F.array(*(F.when(c, F.lit(k)) for k, c in conditions.items())))
    return rows.where(some).withColumn("rule_id", F.explode(fed))


def log_samples(logs: DataFrame, rules: Mapping[str, Mapping], now: int) -> DataFrame:
    """(rule_id, series_key, value) of many log rules in one scan. A rule has window, and perhaps terms and by_service."""
    conditions = {k: log_filter(logs, now - r["window"], now, terms=r.get("terms", ())) for k, r in rules.items()}
    grouped = [k for k, r in rules.items() if r.get("by_service")]
    key = F.when(F.col("rule_id").isin(grouped), F.concat(F.lit("service="), quoted("service.name"))).otherwise("") if grouped else F.lit("")
    found = _fed(logs, conditions).groupBy("rule_id", key.alias("series_key")).agg(F.count(F.lit(1)).cast("double").alias("value"))
    bare = logs.sparkSession.createDataFrame([(k, "", 0.0) for k in rules if k not in grouped], "rule_id string, series_key string, value double")
    return found.unionByName(bare).groupBy("rule_id", "series_key").agg(F.max("value").alias("value"))  # 0 is a sample where nothing groups


def trace_samples(spans: DataFrame, rules: Mapping[str, Mapping], now: int, exact: bool = False) -> DataFrame:
    """(rule_id, series_key, value) per service and tenant of many span rules in one scan. A rule has window, measure, and perhaps terms."""
    conditions = {k: span_filter(now - r["window"], now, r.get("terms", ())) for k, r in rules.items()}
    rows = _fed(spans, conditions).withColumn("_tenant", resolve(spans, "spans", "tenant")).withColumn("service", quoted("service.name")).where("service is not null")
    measured = {r["measure"] for r in rules.values()}
    points = sorted(float(m[1:]) / 100 for m in measured if m.startswith("p"))
    columns = [c.cast("double").alias(f"p{round(p * 100)}") for c, p in zip(apm.percentiles("duration_nanos", points, exact), points, strict=True)] if points else []
    red = rows.groupBy("rule_id", "service", F.col("_tenant").alias("tenant")).agg(F.count(F.lit(1)).alias("count"), F.count_if(F.col("status_code") == 2).alias("errors"), *columns)
    value = F.lit(None).cast("double")
    for k, r in rules.items():
        one = {"error_rate": F.col("errors") * 100.0 / F.col("count"), "request_rate": F.col("count") / F.lit(r["window"] / 1e9)}.get(r["measure"])
        value = F.when(F.col("rule_id") == k, (F.col(r["measure"]) if one is None else one).cast("double")).otherwise(value)
    key = F.concat_ws(",", F.concat(F.lit("service="), "service"), F.concat(F.lit("tenant="), "tenant"))
    return red.select("rule_id", key.alias("series_key"), value.alias("value"))


def breaches(value: Column, op: Column, threshold: Column) -> Column:
    return F.when(op == "gt", value > threshold).when(op == "gte", value >= threshold).when(op == "lt", value < threshold).when(op == "lte", value <= threshold)


def preview(samples: DataFrame, rules: DataFrame) -> DataFrame:
    """Samples (rule_id, series_key, value) with whether each breaches its rule (rule_id, op, threshold) now."""
    return samples.join(rules.select("rule_id", "op", "threshold"), "rule_id").withColumn("breaching", breaches(F.col("value"), F.col("op"), F.col("threshold")))


def state_machine(samples: DataFrame, evaluations: DataFrame, rules: DataFrame, every: bool = True) -> DataFrame:
    """Ok, pending and triggered of each (rule, series) at each successful evaluation (rule_id, at) of its rule, from its first sample on.

    A breach is pending until it has lasted for_secs, then triggered; a triggered series that stops or vanishes is resolved. Samples stand
    at evaluations. Evaluations are numbered for each rule, and a jump of the number between a series' samples shows where it was gone; with
    ``every`` off only the first evaluation of such a gap is given, so that the result follows the samples.
    """
    numbered = evaluations.distinct().withColumn("_number", F.row_number().over(Window.partitionBy("rule_id").orderBy("at")))
    series = Window.partitionBy("rule_id", "series_key").orderBy("_number")
    ends = numbered.groupBy("rule_id").agg(F.max("_number").alias("_end"))  # a row a rule
    seen = samples.join(numbered, ["rule_id", "at"]).join(ends, "rule_id").select("rule_id", "series_key", "at", "value", "_number", F.coalesce(F.lead("_number").over(series), F.col("_end") + 1).alias("_next"))
    last = F.col("_next") - 1 if every else F.least(F.col("_next") - 1, F.col("_number") + 1)
    gaps = seen.where(F.col("_next") > F.col("_number") + 1).select("rule_id", "series_key", F.explode(F.sequence(F.col("_number") + 1, last)).alias("_number"))
    gone = gaps.join(numbered, ["rule_id", "_number"]).select("rule_id", "series_key", "at", F.lit(None).cast("double").alias("value"))
    frame = seen.select("rule_id", "series_key", "at", F.col("value").cast("double").alias("value")).unionByName(gone)
    rows = frame.join(rules.select("rule_id", "op", "threshold", "for_secs"), "rule_id").withColumn("breach", F.coalesce(breaches(F.col("value"), F.col("op"), F.col("threshold")), F.lit(False)))
    order = Window.partitionBy("rule_id", "series_key").orderBy("at")
    rows = rows.withColumn("_run", F.count_if(~F.col("breach")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    since = F.min(F.when(F.col("breach"), F.col("at"))).over(Window.partitionBy("rule_id", "series_key", "_run"))
    state = F.when(~F.col("breach"), "ok").when(F.col("at") - since >= F.col("for_secs") * 1000, "triggered").otherwise("pending")
    rows = rows.withColumn("state", state)
    before = F.coalesce(F.lag("state").over(order), F.lit("ok"))
    move = F.when((F.col("state") == "triggered") & (before != "triggered"), "triggered").when((F.col("state") == "ok") & (before == "triggered"), "resolved").when((F.col("state") == "pending") & (before == "ok"), "pending")
    return rows.withColumn("transition", move).select("rule_id", "series_key", "at", "value", "state", "transition")


def incidents(machine: DataFrame, rules: DataFrame | None = None) -> DataFrame:
    """Triggered periods: when opened and resolved (null: open), and the largest value meanwhile."""
    order = Window.partitionBy("rule_id", "series_key").orderBy("at")
    rows = machine.withColumn("_no", F.count_if(F.col("transition") == "triggered").over(order.rowsBetween(Window.unboundedPreceding, 0))).where("_no > 0")
    out = rows.groupBy("rule_id", "series_key", "_no").agg(F.min("at").alias("started_at"), F.min(F.when(F.col("transition") == "resolved", F.col("at"))).alias("ended_at"), F.max(F.when(F.col("state") == "triggered", F.col("value"))).alias("peak_value")).drop("_no")
    return out if rules is None else out.join(rules.select("rule_id", "severity"), "rule_id")


def counts(open_incidents: DataFrame, rules: DataFrame) -> DataFrame:
    """One row: open incidents, active and paused rules."""
    one = open_incidents.agg(F.count_if(F.col("ended_at").isNull()).alias("triggered")).withColumn("_one", F.lit(1))
    return one.join(F.broadcast(rules.agg(F.count_if("enabled").alias("active"), F.count_if(~F.col("enabled")).alias("paused")).withColumn("_one", F.lit(1))), "_one").drop("_one")  # one row each
