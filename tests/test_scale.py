"""What keeps large tables workable: footers, the manifest of keys, chunked series, shared scans, the streaming sink and late rows."""

import os
import random
import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from glimt.functions import spread
from glimt.functions.terms import match
from glimt.operators import alerts, distributions, logs, metrics
from glimt.sources import manifest, tables
from glimt.streaming import live

DAY = tables.DAY_NANOS
LOGS = "timestamp_nanos long, body string, trace_id string, span_id string, `service.name` string, attributes map<string,string>"


def log_rows(spark, n=200, per_day=40, first=0):
    base = spark.range(n).withColumn("i", F.col("id") + first)
    own = F.map_filter(F.create_map(F.lit("every"), F.lit("x"), F.concat(F.lit("day"), (F.col("i") / per_day).cast("int")), F.lit("y"), F.lit("odd"), F.when(F.col("i") % 2 == 1, "z")), lambda k, v: v.isNotNull())
    return base.select((F.col("i") * (DAY // per_day)).alias("timestamp_nanos"), F.concat(F.lit("b"), "i").alias("body"), F.lit("t").alias("trace_id"), F.lit("s").alias("span_id"), F.concat(F.lit("svc"), F.col("i") % 3).alias("service.name"), own.alias("attributes"))


def paths(folder):
    return sorted(Path(folder).rglob("date=*/*.parquet"))


def listing(df):
    return sorted((r["path"], r["bytes"], r["date"], r["rows"], r["min_ts"], r["max_ts"]) for r in df.collect())


def test_footers_say_what_a_scan_says(spark, tmp_path):
    out = tables.sink(log_rows(spark), str(tmp_path), "logs", partitions=3)
    want = listing(tables.scanned_files(spark, out, "logs"))
    assert listing(tables.files(spark, out, "logs")) == want and sum(x[3] for x in want) == 200
    for p in paths(out):  # without any page of data
        raw = bytearray(p.read_bytes())
        end = len(raw) - 8 - int.from_bytes(raw[-8:-4], "little")
        raw[4:end] = bytes(end - 4)
        p.write_bytes(raw)
        crc = p.with_name(f".{p.name}.crc")
        if crc.exists():
            os.unlink(crc)
    assert listing(tables.files(spark, out, "logs")) == want
    assert tables.statistics(spark, out, "logs").first()["total_rows"] == 200


def test_footers_without_statistics(spark, tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    folder = tmp_path / "data" / "date=1970-01-01"
    folder.mkdir(parents=True)
    pq.write_table(pa.table({"timestamp_nanos": [5, None, 3], "body": ["a", "b", "c"]}), folder / "a.parquet", write_statistics=False)
    pq.write_table(pa.table({"timestamp_nanos": pa.array([None, None], pa.int64()), "body": ["a", "b"]}), folder / "b.parquet")
    got = [x[3:] for x in listing(tables.files(spark, str(tmp_path / "data"), "logs"))]
    assert got == [(3, 3, 5), (2, None, None)]


def catalog(spark, out, start, end):
    return sorted(map(tuple, manifest.field_catalog(spark, out, start, end, ["timestamp_nanos", "body", "service.name", "attributes", "date"]).collect()))


def test_manifest_through_the_life_of_a_table(spark, tmp_path):
    out = tables.sink(log_rows(spark, 120), str(tmp_path), "logs", partitions=2)
    first = catalog(spark, out, 0, 10 * DAY)
    tables.sink(log_rows(spark, 80, first=120), str(tmp_path), "logs", partitions=3)
    # as a scan says, for windows of whole days
    for a, b in ((0, 5), (1, 2), (3, 4), (9, 10)):
        df = spark.read.parquet(out)
        window = F.col("timestamp_nanos").between(a * DAY, b * DAY - 1)
        want = sorted(map(tuple, logs.field_catalog(df.select("timestamp_nanos", "body", "`service.name`", "attributes").where(window), F.lit(True)).collect()))
        assert catalog(spark, out, a * DAY, b * DAY - 1) == want, (a, b)
    whole = catalog(spark, out, 0, 10 * DAY)
    assert len(first) < len(whole)
    scans = []
    real, manifest.scanned_keys = manifest.scanned_keys, lambda *a: scans.append(a) or real(*a)
    try:  # neither a merge nor a purge reads rows for the manifest
        report = tables.consolidate(spark, out, "logs", str(tmp_path / "staging"), 1000)
        assert report.count() > 0 and catalog(spark, out, 0, 10 * DAY) == whole
        known = {r["path"] for r in manifest.keys(spark, out).collect()}
        assert known == {r["path"] for r in tables.files(spark, out, "logs").collect()}
        tables.purge(spark, out, "logs", 2 * DAY)
    finally:
        manifest.scanned_keys = real
    assert not scans and {n for n, k in catalog(spark, out, 0, 10 * DAY) if k == "attribute"} == {"every", "odd", "day2", "day3", "day4"}
    assert "date" in spark.read.parquet(out).columns and spark.read.parquet(out).count() == 120  # readers pass the manifest over


def test_manifest_of_metrics(spark, tmp_path):
    rows = [("cpu", 5, 1.0, "a", {"host": "h", "core": "1"}), ("cpu", 2 * DAY, 1.0, "a", {"late": "1"}), ("mem", 6, 1.0, "a", {"kind": "free"}), ("bare", 7, 1.0, "a", {})]
    df = spark.createDataFrame(rows, "metric_name string, timestamp_nanos long, value double, `service.name` string, attributes map<string,string>")
    out = tables.sink(df, str(tmp_path), "metrics", partitions=1)
    get = lambda name, a, b: sorted(r["key"] for r in manifest.label_keys(spark, out, name, a, b, ["service.name"]).collect())
    assert get("cpu", 0, 10) == ["core", "host", "service.name"] and get("cpu", 0, 3 * DAY) == ["core", "host", "late", "service.name"]
    assert get("bare", 0, 10) == get("none", 0, 10) == ["service.name"]


# ---- series --------------------------------------------------------------------------------------------------

POINTS = "metric_name string, metric_type int, temporality int, is_monotonic boolean, timestamp_nanos long, start_nanos long, value double, unit string, `service.name` string, attributes map<string,string>"


def random_points(spark, n=600, seed=4):
    rng, rows = random.Random(seed), []
    for name, temporality in (("req", 2), ("sent", 1), ("depth", None)):
        level = 0.0
        for i in range(n):
            level = 0.0 if rng.random() < 0.08 else level + rng.randrange(5)
            rows.append((name, 0 if temporality is None else 1, temporality, None, i * 10 + rng.randrange(3), rng.choice([None, None, i // 100]), level, rng.choice(["u", "v"]), rng.choice(["a", "b", None]), {"user": str(rng.randrange(3)), "zone": rng.choice(["x", "y"])}))
    return spark.createDataFrame(rows, POINTS).repartition(4)


def found(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def test_chunks_of_a_series_change_nothing(spark):
    df = random_points(spark)
    # chunks of one point, of ten, and one that ends where the counter starts anew
    for chunk in (10, 100, 130, 1_000):
        for labels in ([], ["service"]):
            for agg in ("increase", "rate"):
                args = (df, "req", 0, 6000, 7, agg, labels)
                assert found(metrics.series(*args, chunk=chunk), *labels, "bucket", "v") == found(metrics.series(*args, chunk=10**9), *labels, "bucket", "v")
    h = F.struct(F.col("value").cast("long").alias("count"), F.col("value").alias("sum"), F.array(F.col("value").cast("long"), F.lit(0).cast("long")).alias("bucket_counts"), F.array(F.when(F.col("unit") == "u", 1.0).otherwise(2.0)).alias("explicit_bounds"), F.lit(None).cast("double").alias("min"), F.lit(None).cast("double").alias("max"))
    hist = df.where("metric_name = 'req'").withColumn("histogram", h)
    for agg in ("count", "p90"):
        assert found(distributions.histogram_series(hist, "req", 0, 6000, 5, agg, ["service"], chunk=40), "service", "bucket", "v") == found(distributions.histogram_series(hist, "req", 0, 6000, 5, agg, ["service"], chunk=10**9), "service", "bucket", "v")


def test_chunks_of_long_series_change_nothing(spark, monkeypatch):
    df = random_points(spark)
    args = (df, "req", 0, 6000, 7, "increase", ["service"])
    want = found(metrics.series(*args), "service", "bucket", "v")
    monkeypatch.setattr(spread, "LONG_ROWS", 30)
    for chunk in (10, 130):
        assert found(metrics.series(*args, chunk=chunk), "service", "bucket", "v") == want


@pytest.mark.parametrize("agg", ["sum", "p90"])
def test_histograms_read_the_points_once(spark, agg):
    """Delta points and cumulative ones are read once each."""
    half = F.struct(F.lit(0).alias("offset"), F.array(F.lit(1).cast("long")).alias("bucket_counts"))
    value = [F.lit(1).cast("long").alias("count"), F.col("value").alias("sum")]
    edges = [F.array(F.lit(1).cast("long"), F.lit(0).cast("long")).alias("bucket_counts"), F.array(F.lit(1.0)).alias("explicit_bounds")]
    powers = [F.lit(0).alias("scale"), F.lit(0).cast("long").alias("zero_count"), half.alias("positive"), half.alias("negative")]
    df = random_points(spark).withColumns({"histogram": F.struct(*value, *edges), "exp_histogram": F.struct(*value, *powers)})
    for made in (distributions.histogram_series, distributions.exponential_series):
        plan = made(df, "req", 0, 6000, 5, agg, ["service"])._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Scan ExistingRDD") <= 2 and "SortMergeJoin" not in plan


def test_no_window_is_larger_than_a_chunk(spark):
    """One series of 40,000 samples is the work of many tasks."""
    df = spark.range(40_000).selectExpr("'c' as metric_name", "1 as metric_type", "2 as temporality", "true as is_monotonic", "id as timestamp_nanos", "cast(null as long) as start_nanos", "cast(id % 1000 as double) as value", "'u' as unit", "'a' as `service.name`", "map('k', 'v') as attributes")
    rows = metrics.with_increases(df, metrics.raw_series(df), chunk=1000)
    sizes = rows.groupBy(F.call_function("div", "timestamp_nanos", F.lit(1000))).count().agg(F.max("count")).first()[0]
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert sizes == 1000 and "_chunk" in plan and rows.agg(F.sum("_up")).first()[0] == sum((i % 1000) - ((i - 1) % 1000) if i % 1000 else 0 for i in range(1, 40_000))


def test_many_series_in_one_scan(spark):
    df = random_points(spark)
    specs, rng = {}, random.Random(8)
    for i in range(60):
        agg = rng.choice(["avg", "min", "max", "sum", "count", "last", "increase", "rate"])
        name = rng.choice(["req", "sent", "depth", "gone"])
        terms = [match(df, "metrics", "zone", ["x"])] if rng.random() < 0.3 else []
        start = rng.randrange(0, 3000)
        specs[f"q{i}"] = {"name": name, "agg": agg, "labels": rng.choice([[], ["service"], ["user", "service"], ["unit"]]), "terms": terms, "start": start, "end": start + rng.randrange(500, 3000), "n": rng.choice([1, 3, 7])}
    got = {}
    for r in metrics.shared(df, specs).collect():
        got.setdefault(r["query"], []).append((r["labels"], r["bucket"], r["v"]))
    for q, s in specs.items():
        one = metrics.series(df, s["name"], s["start"], s["end"], s["n"], s["agg"], s["labels"], s["terms"]).where("v is not null")
        packed = F.to_json(F.struct(*(F.col(f"`{x}`").alias(x) for x in s["labels"]))) if s["labels"] else F.lit("{}")
        want = sorted(map(tuple, one.select(packed, "bucket", "v").collect()), key=repr)
        assert [(a, b, pytest.approx(v)) for a, b, v in want] == sorted(got.get(q, []), key=repr), (q, s)


def test_two_hundred_rules_in_one_scan(spark, tmp_path):
    random_points(spark).write.parquet(str(tmp_path / "p"))
    df = spark.read.parquet(str(tmp_path / "p"))
    rng = random.Random(3)
    rules = {f"r{i}": {"name": rng.choice(["req", "sent", "depth"]), "window": rng.randrange(200, 6000), "agg": rng.choice(["avg", "max", "count", "increase"]), "labels": rng.choice([[], ["service"], ["user"]])} for i in range(200)}
    samples = alerts.metric_samples(df, rules, 6000)
    plan = samples._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") <= 3  # counters and the rest read one exchange each of one scan's rows
    got = {}
    for r in samples.collect():
        got.setdefault(r["rule_id"], []).append((r["series_key"], r["value"]))
    for k in rng.sample(sorted(rules), 25):
        s = rules[k]
        want = found(alerts.metric_sample(df, s["name"], 6000, s["window"], s["agg"], s["labels"]), "series_key", "value")
        assert sorted(got.get(k, []), key=repr) == [(a, pytest.approx(v)) for a, v in want], (k, s)


def test_many_log_and_trace_rules(spark):
    rng = random.Random(6)
    rows = [(i, rng.choice([9, 17]), rng.choice(["a", "b"]), f"t{i % 9}", i, rng.randrange(1, 900), rng.choice([0, 1, 2]), rng.choice(["x", "y", None])) for i in range(300)]
    df = spark.createDataFrame(rows, "timestamp_nanos long, severity_number int, `service.name` string, trace_id string, start_time_nanos long, duration_nanos long, status_code int, tenant string").withColumn("attributes", F.create_map().cast("map<string,string>"))
    rules = {f"l{i}": {"window": 40 * i, "terms": [F.col("severity_number") == 17] if i % 2 else [], "by_service": i % 3 == 0} for i in range(1, 8)}
    rules["none"] = {"window": 100, "terms": [F.lit(False)]}
    got = found(alerts.log_samples(df, rules, 299), "rule_id", "series_key", "value")
    want = [(k, *x) for k, r in rules.items() for x in found(alerts.log_sample(df, 299, r["window"], r.get("terms", ()), r.get("by_service", False)), "series_key", "value")]
    assert got == sorted(want, key=repr)
    rules = {f"s{i}": {"window": 60 * i, "measure": m, "terms": [F.col("status_code") != 1] if i % 2 else []} for i, m in enumerate(("error_rate", "request_rate", "p50", "p90", "p99"), 1)}
    got = found(alerts.trace_samples(df, rules, 299, exact=True), "rule_id", "series_key", "value")
    want = [(k, a, float(v)) for k, r in rules.items() for a, v in found(alerts.trace_sample(df, 299, r["window"], r["measure"], r["terms"], exact=True), "series_key", "value")]
    assert got == sorted(want, key=repr)


def test_gaps_by_number_of_evaluation(spark):
    """As a frame of every evaluation for every series says; and only the first evaluation of a gap where no more is asked for."""
    rng = random.Random(9)
    samples = [(rule, key, at, float(rng.randrange(10))) for rule in ("r", "q") for key in ("a", "b", "c") for at in range(0, 60_000, 1000) if rng.random() < 0.6]
    times = [(rule, at) for rule in ("r", "q") for at in range(0, 60_000, 1000)]
    df = spark.createDataFrame(samples, "rule_id string, series_key string, at long, value double")
    rules = spark.createDataFrame([("r", "gt", 4.0, 2), ("q", "lte", 6.0, 0)], "rule_id string, op string, threshold double, for_secs long")
    evaluations = spark.createDataFrame(times, "rule_id string, at long")
    machine = alerts.state_machine(df, evaluations, rules)
    got = {(r["rule_id"], r["series_key"], r["at"]): (r["value"], r["state"], r["transition"]) for r in machine.collect()}
    value = {(r, k, at): v for r, k, at, v in samples}
    for rule, above, wait in (("r", lambda v: v > 4, 2000), ("q", lambda v: v <= 6, 0)):
        for key in "abc":
            state, since = "ok", None
            for at in range(min(at for r, k, at in value if (r, k) == (rule, key)), 60_000, 1000):
                v = value.get((rule, key, at))
                since = None if v is None or not above(v) else at if since is None else since
                new = "ok" if since is None else "triggered" if at - since >= wait else "pending"
                move = "triggered" if new == "triggered" != state else "resolved" if (new, state) == ("ok", "triggered") else "pending" if (new, state) == ("pending", "ok") else None
                assert got.pop((rule, key, at)) == (v, new, move)
                state = new
    assert not got
    few = alerts.state_machine(df, evaluations, rules, every=False)
    moves = lambda d: found(d.where("transition is not null"), "rule_id", "series_key", "at", "transition")
    assert moves(few) == moves(machine) and few.count() < machine.count()
    assert found(alerts.incidents(few), "started_at", "ended_at", "peak_value") == found(alerts.incidents(machine), "started_at", "ended_at", "peak_value")


# ---- streams -------------------------------------------------------------------------------------------------


def test_a_replayed_batch_leaves_each_row_once(spark, tmp_path):
    import pyarrow.parquet as pq

    root = str(tmp_path)
    first, second = log_rows(spark, 100), log_rows(spark, 60, first=100)
    live.put_batch(first, 0, root, "logs", partitions=2)
    # a failure after half of the files were moved in: the batch is replayed, and dealt in another way
    live.put_batch(second, 1, root, "logs", partitions=3)
    shown = [p for p in paths(f"{root}/data") if "-0000000001-" in p.name]
    for p in shown[: len(shown) // 2]:
        p.unlink()
    shown[-1].rename(shown[-1].with_name(f"_{shown[-1].name}"))
    live.put_batch(second, 1, root, "logs", partitions=2)
    live.put_batch(first, 0, root, "logs", partitions=1)
    assert sorted(r["body"] for r in spark.read.parquet(f"{root}/data").collect()) == sorted(f"b{i}" for i in range(160))
    for p in paths(f"{root}/data"):
        rows = pq.ParquetFile(p).read(columns=["service.name", "timestamp_nanos"]).to_pylist()
        assert [tuple(r.values()) for r in rows] == sorted(tuple(r.values()) for r in rows)
        assert pq.ParquetFile(p).metadata.row_group(0).column(0).compression == "ZSTD" and not p.name.startswith("_")
    live.put_batch(first.limit(0), 2, root, "logs")
    assert spark.read.parquet(f"{root}/data").count() == 160


def test_ingest_fails_between_write_and_commit(spark, tmp_path, monkeypatch):
    """The first attempt at a batch ends after its files are in the table and before the stream commits it."""
    log_rows(spark, 90).write.parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema(LOGS).parquet(str(tmp_path / "in"))
    real = live.put_batch

    def breaks(*args):
        real(*args)
        raise RuntimeError("lost the driver")

    monkeypatch.setattr(live, "put_batch", breaks)
    with pytest.raises(Exception, match="lost the driver"):
        live.ingest(stream(), lambda x: x, str(tmp_path), "logs", str(tmp_path / "check"), availableNow=True).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "data")).count() == 90
    monkeypatch.setattr(live, "put_batch", real)
    live.ingest(stream(), lambda x: x, str(tmp_path), "logs", str(tmp_path / "check"), availableNow=True).awaitTermination()
    assert sorted(r["body"] for r in spark.read.parquet(str(tmp_path / "data")).collect()) == sorted(f"b{i}" for i in range(90))


HOUR = 3_600_000_000_000


def late_files(spark, folder, batches=12):
    """A file a batch: five rows of its hour, and as many of the first hour as its number."""
    schema = "timestamp_nanos long, severity_number int"
    for k in range(batches):
        spark.createDataFrame([(k * HOUR + 1, 9)] * 5 + [(1, 9)] * k, schema).coalesce(1).write.mode("append").parquet(str(folder))
        newest = min(folder.glob("*.parquet"), key=lambda p: abs(os.path.getmtime(p) - time.time()))
        os.utime(newest, (2_000_000_000 + k, 2_000_000_000 + k))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder))


def test_late_rows_are_kept(spark, tmp_path):
    stream = late_files(spark, tmp_path / "in")
    split = lambda: live.split_late(stream, "logs", HOUR, HOUR, str(tmp_path / "s"), str(tmp_path / "c"), availableNow=True).awaitTermination()
    split()
    late = {r["batch"]: r["count"] for r in live.late_rows(spark, str(tmp_path / "s"), stream.schema).groupBy("batch").count().collect()}
    assert late == {k: k for k in range(3, 12)}  # when batch 3 comes, hour 2 was seen: the first hour ended an hour ago
    # a batch whose commit is lost is replayed, and deals its rows as before
    newest = max((tmp_path / "c" / "commits").glob("[0-9]*"), key=lambda p: int(p.name))
    newest.unlink()
    (newest.parent / f".{newest.name}.crc").unlink(missing_ok=True)
    split()
    assert live.late_rows(spark, str(tmp_path / "s"), stream.schema).count() == sum(range(3, 12))
    listener = live.LateRows()
    spark.streams.addListener(listener)
    try:
        rest = live.in_time(spark, str(tmp_path / "s"), stream.schema, maxFilesPerTrigger=1)
        query = live.continuous_log_volume(rest, "1 hour", "1 hour").writeStream.outputMode("update").format("memory").queryName("volumes").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
        query.awaitTermination()
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        assert listener.dropped[str(query.id)] == 0 and listener.batches[str(query.id)] >= 11
    finally:
        spark.streams.removeListener(listener)
    counted = spark.table("volumes").groupBy("start", "level").agg(F.max("count").alias("n")).agg(F.sum("n")).first()[0]
    assert counted + sum(range(3, 12)) == 12 * 5 + sum(range(12))  # aggregated and kept rows are the input


def test_dropped_groups_are_counted_over_all_batches(spark, tmp_path):
    """Beyond the few batches of which a query keeps the progress."""
    late, name = live.LateRows(), "spark.sql.streaming.numRecentProgressUpdates"
    spark.streams.addListener(late)
    spark.conf.set(name, "2")
    try:
        query = live.continuous_log_volume(late_files(spark, tmp_path / "in"), "1 hour", "1 hour").writeStream.outputMode("update").format("noop").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        query.awaitTermination()
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        assert late.dropped[str(query.id)] == 8 and len(query.recentProgress) <= 2  # one group in each of the batches 4 to 11: operators lag a batch behind
    finally:
        spark.streams.removeListener(late)
        spark.conf.unset(name)


# ---- stored sketches -----------------------------------------------------------------------------------------


def test_rollups_merge_to_what_the_spans_say(spark):
    from glimt.operators import apm, rollups

    rng = random.Random(12)
    rows = [(i * 7_000_000_000, rng.choice(["a", "b", None]), rng.choice(["x", "y"]), rng.choice(["t", None]), rng.choice([None, *range(1, 3_000_000_000, 7_000_001)]), rng.choice([0, 1, 2])) for i in range(4000)]
    df = spark.createDataFrame(rows, "start_time_nanos long, `service.name` string, name string, tenant string, duration_nanos long, status_code int")
    start, end = 0, 4000 * 7_000_000_000 // rollups.MINUTE_NANOS * rollups.MINUTE_NANOS
    window = (F.col("start_time_nanos") >= start) & (F.col("start_time_nanos") < end)
    minutes = rollups.span_rollup(df)
    hours = rollups.coarser(minutes, ["service", "operation", "tenant"], 60 * rollups.MINUTE_NANOS)
    counts = ("service", "operation", "count", "errors", "satisfied", "tolerating", "frustrated")
    want = found(apm.red_by_operation(df, window, limit=None, exact=True), *counts)
    assert found(rollups.red_by_operation(minutes, start, end), *counts) == want
    hour_end = end // (60 * rollups.MINUTE_NANOS) * 60 * rollups.MINUTE_NANOS
    inside = F.col("start_time_nanos") < hour_end
    assert found(rollups.red_by_operation(hours, 0, hour_end), *counts) == found(apm.red_by_operation(df, inside, limit=None, exact=True), *counts)
    assert found(rollups.red_by_service(minutes, start, end), "service", "tenant", "count", "errors") == found(apm.red_by_service(df, window, exact=True), "service", "tenant", "count", "errors")
    n = 6
    series = ("bucket", "start_nanos", "count", "errors", "satisfied")
    assert found(rollups.red_series(minutes, start, start + n * 60 * rollups.MINUTE_NANOS, n), *series) == found(apm.red_series(df, F.col("start_time_nanos") < n * 60 * rollups.MINUTE_NANOS, start, n * 60 * rollups.MINUTE_NANOS, n, exact=True), *series)
    values = sorted(r[4] for r in rows if r[4] is not None and r[0] < end)
    got = rollups.latency_percentiles(minutes, start, end).first()
    for name, p in rollups.POINTS.items():
        assert abs(sum(x <= got[name] for x in values) / len(values) - p) <= 2 * rollups.rank_error()
    assert rollups.latency_percentiles(minutes, end + 10**15, end + 10**16).first()["p50"] is None


def test_vitals_from_a_rollup(spark):
    from glimt.operators import rollups

    rows = [(i * 1_000_000_000, "app", "web_vitals.lcp", float(i), {"browser.route": "/"}) for i in range(1200)]
    df = spark.createDataFrame(rows, "timestamp_nanos long, `service.name` string, metric_name string, value double, attributes map<string,string>")
    got = rollups.vitals_summary(rollups.vital_rollup(df), 0, 1200 * 1_000_000_000).first()
    assert got["count"] == 1200 and abs(got["p75"] / 1200 - 0.75) <= 2 * rollups.rank_error()
