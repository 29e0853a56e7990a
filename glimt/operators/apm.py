"""Latency, RED and Apdex per operation and service, dependencies, health, fleet numbers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glimt.functions.buckets import bucket_index, bucket_label, fill
from glimt.functions.fields import quoted, resolve

DEFAULT_APDEX_NANOS = 500_000_000
ACCURACY = 10_000


def percentiles(column: str, points: Sequence[float], exact: bool, accuracy: int = ACCURACY) -> list[Column]:
    """A value of the column for each point: the estimate of a sketch, or exactly the smallest that reaches the rank."""
    if exact:
        return [F.expr(f"percentile_disc({p}) within group (order by {column})") for p in points]
    estimate = F.percentile_approx(column, list(points), accuracy)
    return [estimate[i] for i in range(len(points))]


def latency_percentiles(spans: DataFrame, where: Column, exact: bool = False) -> DataFrame:
    """p50, p90 and p99 of the durations; zeros without any above 0."""
    got = spans.where(where).agg(*(c.alias(n) for c, n in zip(percentiles("duration_nanos", (0.5, 0.9, 0.99), exact), ("p50", "p90", "p99"), strict=True)), F.max("duration_nanos").alias("_max"))
    return got.select(*(F.when(F.col("_max") > 0, F.col(n)).otherwise(0).cast("long").alias(n) for n in ("p50", "p90", "p99")))


def latency_histogram(spans: DataFrame, where: Column, n: int) -> DataFrame:
    """n geometric bins from max(min, 1) to max: bin, the duration where it begins, count."""
    rows = spans.where(where).where("duration_nanos is not null").select(F.col("duration_nanos").cast("double").alias("d"))
    ends = rows.agg(F.greatest(F.min("d"), F.lit(1.0)).alias("lo"), F.max("d").alias("hi")).where("hi > 0").withColumn("_one", F.lit(1))
    ends = ends.withColumn("step", F.log(F.greatest(F.col("hi") / F.col("lo"), F.lit(1.0))))
    place = F.when(F.col("step") > 0, F.floor(F.log(F.greatest("d", "lo") / F.col("lo")) / F.col("step") * n)).otherwise(0)
    binned = rows.withColumn("_one", F.lit(1)).join(F.broadcast(ends), "_one").select(F.least(F.greatest(place, F.lit(0)), F.lit(n - 1)).cast("int").alias("bucket"))  # `ends` is one row
    counts = fill(binned.groupBy("bucket").agg(F.count(F.lit(1)).alias("count")), n, zero=["count"]).withColumn("_one", F.lit(1))
    start = F.round(F.col("lo") * F.exp(F.col("bucket") * F.col("step") / n)).cast("long")
    return counts.join(F.broadcast(ends), "_one").select("bucket", start.alias("start_nanos"), "count")


def _red(exact: bool) -> list[Column]:
    banded = F.col("duration_nanos").isNotNull()
    t, d = F.col("_t"), F.col("duration_nanos")
    return [
        F.count(F.lit(1)).alias("count"), F.count_if(F.col("status_code") == 2).alias("errors"),
        *(c.cast("long").alias(n) for c, n in zip(percentiles("duration_nanos", (0.5, 0.9, 0.99), exact), ("p50", "p90", "p99"), strict=True)),
        F.count_if(banded & (d <= t)).alias("satisfied"), F.count_if(banded & (d > t) & (d <= t * 4)).alias("tolerating"), F.count_if(banded & (d > t * 4)).alias("frustrated"),
    ]


def with_threshold(spans: DataFrame, thresholds: DataFrame | None, default: int = DEFAULT_APDEX_NANOS) -> DataFrame:
    """``_t``: the Apdex threshold of each span's service, from a table (service, t_nanos) or the default."""
    named = spans.withColumn("service", quoted("service.name"))
    if thresholds is None:
        return named.withColumn("_t", F.lit(default).cast("long"))
    return named.join(thresholds.select("service", F.col("t_nanos").alias("_own")), "service", "left").withColumn("_t", F.coalesce("_own", F.lit(default)).cast("long"))


def red_by_operation(spans: DataFrame, where: Column, thresholds: DataFrame | None = None, limit: int | None = 1000, exact: bool = False) -> DataFrame:
    """Count, errors, percentiles and Apdex bands per service and operation; spans without service are left out."""
    out = with_threshold(spans.where(where), thresholds).where("service is not null").groupBy("service", F.col("name").alias("operation")).agg(*_red(exact))
    return out if limit is None else out.orderBy(F.desc("count"), "service", "operation").limit(limit)


def red_by_service(spans: DataFrame, where: Column, thresholds: DataFrame | None = None, exact: bool = False) -> DataFrame:
    """The same per service and tenant (promoted column or attribute)."""
    rows = with_threshold(spans.where(where), thresholds).where("service is not null").withColumn("_tenant", resolve(spans, "spans", "tenant"))
    return rows.groupBy("service", F.col("_tenant").alias("tenant")).agg(*_red(exact))


def derived(red: DataFrame, seconds: float) -> DataFrame:
    """Adds rate (a second), error_rate (a fraction) and the Apdex score (null without durations)."""
    banded = F.col("satisfied") + F.col("tolerating") + F.col("frustrated")
    return red.withColumns({
        "rate": F.col("count") / F.lit(float(seconds)),
        "error_rate": F.when(F.col("count") > 0, F.col("errors") / F.col("count")).otherwise(0.0),
        "apdex": F.when(banded > 0, (F.col("satisfied") + F.col("tolerating") / 2) / banded),
    })


def red_series(spans: DataFrame, where: Column, start: int, end: int, n: int, thresholds: DataFrame | None = None, by_service: bool = False, exact: bool = False) -> DataFrame:
    """RED in n buckets of floor((end - start) / n), zero counts where nothing fell."""
    keys = ["service"] if by_service else []
    rows = with_threshold(spans.where(where), thresholds).withColumn("bucket", bucket_index(F.col("start_time_nanos"), start, end, n))
    counts = rows.groupBy(*keys, "bucket").agg(*_red(exact))
    out = fill(counts, n, keys, ["count", "errors", "satisfied", "tolerating", "frustrated"])
    return out.withColumn("start_nanos", bucket_label(F.col("bucket"), start, end, n, floored=True))


def dependencies(spans: DataFrame, where: Column, by_caller: bool = False, exact: bool = False) -> DataFrame:
    """Client spans by what they call: a database, else an external host or peer; p50, p95, p99 by sketch, or ``exact`` by nearest rank."""
    value = lambda name: F.nullif(resolve(spans, "spans", name), F.lit(""))
    system, database = value("db.system"), value("db.name")
    key = F.when(system.isNotNull(), F.concat_ws(".", system, database)).otherwise(F.coalesce(value("server.address"), value("net.peer.name"), value("peer.service")))
    rows = spans.where(where).where("kind = 3").select(quoted("service.name").alias("service"), F.when(system.isNotNull(), "database").otherwise("external").alias("kind"), key.alias("name"), "status_code", "duration_nanos").where("name is not null")
    keys = (["service"] if by_caller else []) + ["kind", "name"]
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("count"), F.count_if(F.col("status_code") == 2).alias("errors"), *(c.cast("long").alias(n) for c, n in zip(percentiles("duration_nanos", (0.5, 0.95, 0.99), exact), ("p50", "p95", "p99"), strict=True)))


def health(services: DataFrame) -> DataFrame:
    """Adds status (idle, critical, degraded, healthy) and reasons to rows with count, error_rate and apdex."""
    bad_rate, poor_apdex = F.col("error_rate"), F.coalesce("apdex", F.lit(1.0))
    status = F.when(F.col("count") == 0, "idle").when((bad_rate >= 0.05) | (poor_apdex < 0.7), "critical").when((bad_rate >= 0.01) | (poor_apdex < 0.85), "degraded").otherwise("healthy")
    reasons = F.array_compact(F.array(F.when((F.col("count") > 0) & (bad_rate >= 0.01), "error_rate"), F.when((F.col("count") > 0) & (poor_apdex < 0.85), "apdex")))
    return services.withColumns({"status": status, "reasons": reasons})


def worst_first(services: DataFrame) -> list[Column]:
    rank = F.when(F.col("status") == "critical", 0).when(F.col("status") == "degraded", 1).when(F.col("status") == "healthy", 2).otherwise(3)
    return [rank.asc(), F.desc("error_rate"), F.asc_nulls_last("apdex"), F.desc("rate"), F.asc("service")]


def health_counts(services: DataFrame) -> DataFrame:
    return services.groupBy("status").agg(F.count(F.lit(1)).alias("services"))


def attention(services: DataFrame, limit: int = 3) -> DataFrame:
    """The worst services that need a look."""
    return services.where(F.col("status").isin("critical", "degraded")).orderBy(*worst_first(services)).limit(limit)


def fleet_kpis(spans: DataFrame, start: int, end: int, exact: bool = False) -> DataFrame:
    """Rate, error rate, p99 and requests of [start, end] and of the equal window before, one scan, with relative change (null if it was 0)."""
    length = end - start
    rows = spans.where(F.col("start_time_nanos").between(start - length, end) & quoted("service.name").isNotNull()).withColumn("now", F.col("start_time_nanos") >= start)
    seconds = length / 1e9
    stats = rows.groupBy("now").agg(F.count(F.lit(1)).alias("requests"), F.count_if(F.col("status_code") == 2).alias("errors"), percentiles("duration_nanos", [0.99], exact)[0].cast("double").alias("p99"))
    stats = stats.select("now", F.explode(F.map_from_arrays(F.array(*map(F.lit, ("requests", "rate", "error_rate", "p99"))), F.array(F.col("requests").cast("double"), F.col("requests") / seconds, F.col("errors") / F.col("requests"), F.col("p99")))).alias("kpi", "value"))
    out = stats.groupBy("kpi").agg(F.max(F.when(F.col("now"), F.col("value"))).alias("current"), F.max(F.when(~F.col("now"), F.col("value"))).alias("previous"))
    return out.withColumn("delta", F.when(F.col("previous") != 0, (F.col("current") - F.col("previous")) / F.col("previous")))


def overview(services: DataFrame, vitals: DataFrame, monitors: DataFrame) -> DataFrame:
    """One row: total rate, rate-weighted error rate, worst p99, LCP, and monitors up of all. Each part is a single row."""
    one = lambda df: df.withColumn("_one", F.lit(1))
    fleet = services.agg(F.sum("rate").alias("rate"), F.try_divide(F.sum(F.col("rate") * F.col("error_rate")), F.sum("rate")).alias("error_rate"), F.max("p99").alias("worst_p99"))
    lcp = vitals.where("metric = 'lcp'").agg(F.max("p75").alias("lcp_p75"))
    up = monitors.agg(F.count_if(F.col("state") == "up").alias("monitors_up"), F.count(F.lit(1)).alias("monitors"))
    return one(fleet).join(F.broadcast(one(lcp)), "_one").join(F.broadcast(one(up)), "_one").drop("_one")
