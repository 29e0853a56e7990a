"""Usage of storage and ingest, and summaries of tenants."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glimt.functions.buckets import bucket_index

UP_SECONDS, STALE_SECONDS = 120, 600


def signal_of(path: Column) -> Column:
    """Of a table file's path below the root; null for other files."""
    is_file = path.endswith(".parquet")
    return F.when(is_file & path.startswith("data-spans/"), "spans").when(is_file & path.startswith("data-metrics/"), "metrics").when(is_file & path.startswith("data/"), "logs")


def durable_bytes(files: DataFrame) -> DataFrame:
    """Bytes and files per signal of (path, bytes)."""
    return files.select(signal_of(F.col("path")).alias("signal"), "bytes").where("signal is not null").groupBy("signal").agg(F.sum("bytes").alias("bytes"), F.count(F.lit(1)).alias("files"))


def usage_series(samples: DataFrame, start: int, end: int, n: int) -> DataFrame:
    """Per signal and bucket: the last level, and the growth of the ingest counter against the bucket before (null at first and after a reset); ``ts`` is the bucket's end."""
    rows = samples.where(F.col("ts_ms").between(start, end)).withColumn("bucket", bucket_index(F.col("ts_ms"), start, end, n))
    last = lambda c: F.max_by(c, F.struct("ts_ms", c)).alias(c)
    per = rows.groupBy("signal", "bucket").agg(last("hot_bytes"), last("durable_bytes"), last("total_rows"), last("ingest_rows"))
    before = F.lag("ingest_rows").over(Window.partitionBy("signal").orderBy("bucket"))
    delta = F.when(F.col("ingest_rows") >= before, F.col("ingest_rows") - before)
    width = max(1, (end - start) // n)
    return per.withColumn("ingested", delta).withColumn("ts", F.lit(start) + (F.col("bucket") + 1).cast("long") * width).drop("ingest_rows")


def composition(levels: DataFrame) -> DataFrame:
    """Share of the bytes per signal; signals without any are left out."""
    rows = levels.where("bytes > 0")
    return rows.withColumn("share_pct", F.col("bytes") * 100.0 / F.sum("bytes").over(Window.partitionBy(F.lit(0))))


def current_rate(series: DataFrame, bucket_seconds: float) -> DataFrame:
    """Rows a second over all signals: each one's last known growth by the bucket's length."""
    last = series.where("ingested is not null").groupBy("signal").agg(F.max_by("ingested", "bucket").alias("d"))
    return last.agg((F.sum("d") / F.lit(bucket_seconds)).alias("rows_per_second"))


def sample(stats: DataFrame, signal: str, at_ms: int, ingest_rows: int = 0, hot_bytes: int = 0) -> DataFrame:
    """A usage row of a storage-statistics row, for appending."""
    return stats.select(F.lit(at_ms).cast("long").alias("ts_ms"), F.lit(signal).alias("signal"), F.lit(hot_bytes).cast("long").alias("hot_bytes"), F.col("bytes").alias("durable_bytes"), "total_rows", "file_count", F.lit(ingest_rows).cast("long").alias("ingest_rows"))


def record(spark: SparkSession, samples: DataFrame, folder: str, now_ms: int, keep_days: int = 30) -> None:
    """Append usage rows to the sample table, a folder for each day, and drop the days that are wholly older than ``keep_days``."""
    day = F.date_from_unix_date(F.call_function("div", F.col("ts_ms"), F.lit(86_400_000)).cast("int"))
    samples.withColumn("day", day).write.mode("append").partitionBy("day").parquet(folder)
    oldest = now_ms // 86_400_000 - keep_days
    path = spark._jvm.org.apache.hadoop.fs.Path
    system = path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    for status in system.listStatus(path(folder)):
        name = status.getPath().getName()
        if name.startswith("day=") and (date.fromisoformat(name[4:]) - date(1970, 1, 1)).days < oldest:
            system.delete(status.getPath(), True)


def tenant_summary(points: DataFrame, now: int, window: int, n: int = 30, up: str = "tenant.up", rows: str = "tenant.ingest.rows", hot: str = "tenant.hot.bytes", open_incidents: str = "tenant.incidents.open") -> DataFrame:
    """All tenants in one pass: status by age of the last point, mode of it, rows a second between the first and last bucket, a sparkline of rates, open incidents, hot bytes."""
    own = points.where(F.col("timestamp_nanos").between(now - window, now) & F.col("tenant").isNotNull()).withColumn("bucket", bucket_index(F.col("timestamp_nanos"), now - window, now, n))
    m, v, at = F.col("metric_name"), F.col("value"), F.struct("timestamp_nanos", "value")
    mode = F.col("attributes").getItem("mode")
    head = own.groupBy("tenant").agg(F.max(F.when(m == up, F.col("timestamp_nanos"))).alias("last_seen"), F.max_by(mode, F.when(m == up, F.col("timestamp_nanos"))).alias("mode"), F.max_by(v, F.when(m == hot, at)).alias("hot_bytes"), F.max_by(v, F.when(m == open_incidents, at)).alias("open_incidents"))
    age = (F.lit(now) - F.col("last_seen")) / 1e9
    head = head.withColumn("status", F.when(age <= UP_SECONDS, "up").when(age <= STALE_SECONDS, "stale").otherwise("down"))
    per = own.where(m == rows).groupBy("tenant", "bucket").agg(F.max_by("value", at).alias("v"), F.max("timestamp_nanos").alias("t"))
    order = Window.partitionBy("tenant").orderBy("bucket")
    per = per.withColumn("rate", F.greatest((F.col("v") - F.lag("v").over(order)) / ((F.col("t") - F.lag("t").over(order)) / 1e9), F.lit(0.0)))
    lines = per.groupBy("tenant").agg(F.greatest(F.try_divide(F.max_by("v", "bucket") - F.min_by("v", "bucket"), (F.max("t") - F.min("t")) / 1e9), F.lit(0.0)).alias("rows_per_second"), F.transform(F.array_sort(F.collect_list(F.when(F.col("rate").isNotNull(), F.struct("bucket", "rate")))), lambda x: x["rate"]).alias("sparkline"))
    return head.join(lines, "tenant", "left")


def tenant_health_points(levels: DataFrame, at_nanos: int, mode: str = "agent") -> DataFrame:
    """Metric points about each tenant of (tenant, signal, rows, bytes, hot_bytes, open_incidents)."""
    names = {"tenant.ingest.rows": "rows", "tenant.ingest.bytes": "bytes", "tenant.hot.bytes": "hot_bytes", "tenant.incidents.open": "open_incidents"}
    totals = levels.groupBy("tenant").agg(F.sum("rows").alias("rows"), F.sum("bytes").alias("bytes"), F.max("hot_bytes").alias("hot_bytes"), F.max("open_incidents").alias("open_incidents"))
    points = F.array(F.struct(F.lit("tenant.up").alias("n"), F.lit(1.0).alias("v")), *(F.struct(F.lit(n).alias("n"), F.col(c).cast("double").alias("v")) for n, c in names.items()))
    rows = totals.select("tenant", F.explode(points).alias("p"))
    counter = F.col("p.n").startswith("tenant.ingest")
    return rows.select(F.col("p.n").alias("metric_name"), F.when(counter, 1).otherwise(0).alias("metric_type"), F.when(counter, 2).alias("temporality"), F.lit(at_nanos).cast("long").alias("timestamp_nanos"), F.col("p.v").alias("value"), "tenant", F.create_map(F.lit("mode"), F.lit(mode)).alias("attributes"))
