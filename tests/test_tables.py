"""Storage: sorted sink, bounded scan, consolidation, retention; and alerts from batch and stream."""

from pyspark.sql import functions as F

from glimt.functions.fields import log_schema
from glimt.operators import alerts
from glimt.sources import tables
from glimt.streaming import live

DAY = tables.DAY_NANOS


def rows_of(spark, n=300):
    base = spark.range(n).select((F.col("id") * (DAY // 50)).alias("timestamp_nanos"), F.lit(None).cast("long").alias("observed_nanos"), F.lit(9).alias("severity_number"), F.lit("INFO").alias("severity_text"), F.col("id").cast("string").alias("body"), F.lit("t").alias("trace_id"), F.lit("s").alias("span_id"), F.lit("x").alias("scope_name"), F.concat(F.lit("svc"), F.col("id") % 3).alias("service.name"), F.lit("h").alias("host.name"), F.lit(None).cast("string").alias("tenant"), F.create_map().cast("map<string,string>").alias("attributes"))
    return base.select([f"`{f.name}`" for f in log_schema()])


def test_storage_life(spark, tmp_path):
    root = str(tmp_path)
    tables.with_date(rows_of(spark), "logs").repartition(5).write.partitionBy("date").parquet(f"{root}/data")
    before = tables.files(spark, f"{root}/data", "logs").count()
    report = tables.consolidate(spark, f"{root}/data", "logs", f"{root}/staging", 1000).collect()
    listing = tables.files(spark, f"{root}/data", "logs")
    assert len(report) == 6 and sum(r["rows"] for r in report) == 300 and listing.count() < before
    assert sorted(int(r[0]) for r in tables.scan(spark, root, "logs", 2 * DAY, 3 * DAY).select("body").collect()) == list(range(100, 151))
    stats = tables.statistics(spark, f"{root}/data", "logs").first()
    assert (stats["total_rows"], stats["min_ts"], stats["max_ts"]) == (300, 0, 299 * (DAY // 50))
    removed = tables.purge(spark, f"{root}/data", "logs", 2 * DAY + 5).first()
    left = spark.read.parquet(f"{root}/data").agg(F.count("*"), F.min("timestamp_nanos")).first()
    assert removed["rows_removed"] == 100 and tuple(left) == (200, 2 * DAY)


def test_consolidation_keeps_to_its_groups(spark, tmp_path):
    root = str(tmp_path)
    tables.with_date(rows_of(spark, 40), "logs").repartition(7).write.partitionBy("date").parquet(f"{root}/data")
    before = {r["path"]: r["rows"] for r in tables.files(spark, f"{root}/data", "logs").collect()}
    report = tables.consolidate(spark, f"{root}/data", "logs", f"{root}/staging", 14).collect()
    after = {r["path"]: r["rows"] for r in tables.files(spark, f"{root}/data", "logs").collect()}
    assert sum(after.values()) == 40 and max(after.values()) <= 14 and 1 < len(after) < len(before) == 7
    assert [(r["files_before"], r["files_after"], r["rows"]) for r in report] == [(7, len(after), 40)]
    import pyarrow.parquet as pq

    for path in set(after) - set(before):
        file = pq.ParquetFile(path.replace("file://", ""))
        times = [tuple(r.values()) for r in file.read(columns=["service.name", "timestamp_nanos"]).to_pylist()]
        assert times == sorted(times) and file.metadata.row_group(0).column(0).compression == "ZSTD"
    assert tables.consolidate(spark, f"{root}/data", "logs", f"{root}/again", 1).count() == 0


def test_row_groups(spark, tmp_path):
    import pyarrow.parquet as pq

    out = tables.sink(rows_of(spark, 50).withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(6000)))).drop("k"), str(tmp_path), "logs", partitions=1)
    groups = [pq.ParquetFile(p).metadata.row_group(i).num_rows for p in map(str, (tmp_path / "data").glob("date=*/*.parquet")) for i in range(pq.ParquetFile(p).metadata.num_row_groups)]
    assert sum(groups) == 300_000 and max(groups) <= tables.GROUP_ROWS and out


def test_usage_samples_are_pruned(spark, tmp_path):
    from glimt.operators import usage

    sample = lambda day: spark.createDataFrame([(day * 86_400_000 + 5, "logs", day)], "ts_ms long, signal string, total_rows long")
    for day in (10, 20, 41):
        usage.record(spark, sample(day), str(tmp_path / "u"), day * 86_400_000 + 6)
    assert sorted(r["total_rows"] for r in spark.read.parquet(str(tmp_path / "u")).collect()) == [20, 41]


def test_plan_groups_neighbours(spark):
    files = [("d1", "a", 40, 0), ("d1", "b", 50, 1), ("d1", "c", 30, 2), ("d1", "big", 500, 3), ("d1", "e", 10, 4), ("d2", "f", 5, 0)]
    listing = spark.createDataFrame(files, "date string, path string, rows long, min_ts long")
    got = {r["path"]: (r["date"], r["grp"]) for r in tables.consolidation_plan(listing, 100, 32).collect()}
    assert got == {"a": ("d1", 0), "b": ("d1", 0), "c": ("d1", 1), "e": ("d1", 1)}
    assert {r["path"] for r in tables.retention_plan(listing.withColumn("max_ts", F.col("min_ts")), 2).collect()} == {"a", "b", "f"}


def test_alerts_pending_triggered_resolved(spark, tmp_path):
    rules = spark.createDataFrame([("r", "gt", 5.0, 2)], "rule_id string, op string, threshold double, for_secs long")
    values = {1000: 9.0, 2000: 9.5, 3000: 12.0, 4000: 1.0, 5000: 9.0, 6000: None, 7000: 8.0, 9000: 8.0, 10000: None}
    samples = spark.createDataFrame([("r", "k=v", t, x) for t, x in values.items() if x is not None], "rule_id string, series_key string, at long, value double")
    times = spark.createDataFrame([("r", t) for t in values], "rule_id string, at long")
    machine = alerts.state_machine(samples, times, rules)
    states = [(r["state"], r["transition"]) for r in machine.orderBy("at").collect()]
    assert states == [("pending", "pending"), ("pending", None), ("triggered", "triggered"), ("ok", "resolved"), ("pending", "pending"), ("ok", None), ("pending", "pending"), ("triggered", "triggered"), ("ok", "resolved")]
    assert [(r["started_at"], r["ended_at"], r["peak_value"]) for r in alerts.incidents(machine).orderBy("started_at").collect()] == [(3000, 4000, 12.0), (9000, 10000, 8.0)]
    times.join(samples.drop("series_key"), ["rule_id", "at"], "left").withColumn("series_key", F.lit("k=v")).select("rule_id", "series_key", "at", "value").write.parquet(str(tmp_path / "in"))
    stream = live.alert_transitions(spark.readStream.schema("rule_id string, series_key string, at long, value double").parquet(str(tmp_path / "in")), rules)
    stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    got = sorted((r["at"], r["transition"]) for r in spark.read.schema(stream.schema).parquet(str(tmp_path / "out")).collect())
    assert got == [(r["at"], r["transition"]) for r in machine.where("transition is not null").orderBy("at").collect()]
