"""Operators on tiny tables with hand-computed results."""

import random

import pytest
from pyspark.sql import functions as F

from glimt.operators import apm, distributions, logs, metrics, traces, uptime
from glimt.sources import ingest
from glimt.streaming import live

MS = 1_000_000
SPANS = "trace_id string, span_id string, parent_span_id string, `service.name` string, name string, start_time_nanos long, end_time_nanos long, duration_nanos long, status_code int, kind int, attributes map<string,string>"


def spans(spark, rows):
    return spark.createDataFrame([(*r, {}) if len(r) == 10 else r for r in rows], SPANS)


def test_red(spark):
    rows = [("t1", "a1", "orders", "place", 10, 100, 1), ("t1", "a2", "orders", "place", 20, 200, 2), ("t2", "a3", "orders", "place", 30, 300, 1), ("t2", "a4", "orders", "list", 40, 40, 1), ("t3", "b1", "orders", "list", 50, 60, 1), ("t3", "b2", "shipping", "invoice", 60, 500, 2), ("t4", "b3", "shipping", "invoice", 70, 700, 2)]
    df = spans(spark, [(t, s, None, svc, n, at, at + d * MS, d * MS, st, 2) for t, s, svc, n, at, d, st in rows])
    got = {(r["service"], r["operation"]): r for r in apm.derived(apm.red_by_operation(df, F.lit(True), exact=True), 10).collect()}
    assert [(k, r["count"], r["errors"]) for k, r in got.items()] == [(("orders", "place"), 3, 1), (("orders", "list"), 2, 0), (("shipping", "invoice"), 2, 2)]
    pay = got["shipping", "invoice"]
    assert (pay["satisfied"], pay["tolerating"], pay["frustrated"], pay["apdex"], pay["rate"]) == (1, 1, 0, 0.75, 0.2)
    assert got["orders", "place"]["p50"] == 200 * MS


def test_trace_list_and_tree(spark):
    df = spans(spark, [
        ("t1", "r", None, "api", "GET /", 100, 200, 100, 1, 2), ("t1", "c", "r", "db", "SELECT", 110, 250, 140, 2, 3), ("t1", "d", "c", "db", "x", 105, 240, 135, 1, 3),
        ("t3", "x", "gone", "web", "part", 300, 400, None, 1, 2), ("t3", "y", "x", "web", "later", 320, 420, None, 1, 2), ("t4", "p", "q", "a", "loop", 10, 20, 10, 0, 1), ("t4", "q", "p", "a", "loop", 5, 30, 25, 0, 1), ("t5", "z", "z", "a", "self", 1, 2, 1, 0, 1)])
    got = {r["trace_id"]: r for r in traces.trace_list(df, F.col("start_time_nanos") >= 100, 0, 1000).collect()}
    assert set(got) == {"t1", "t3"}
    assert (got["t1"]["span_count"], got["t1"]["error_count"], got["t1"]["services"], got["t1"]["root_name"], got["t1"]["duration_nanos"]) == (3, 1, ["api", "db"], "GET /", 100)
    assert (got["t3"]["root_name"], got["t3"]["duration_nanos"]) == ("part", 120)
    tree = {r["span_id"]: r for r in traces.trace_tree(df).collect()}
    assert [(s, tree[s]["depth"], tree[s]["position"]) for s in "rcdxyqpz"] == [("r", 0, 0), ("c", 1, 1), ("d", 2, 2), ("x", 0, 0), ("y", 1, 1), ("q", 0, 0), ("p", 1, 1), ("z", 0, 0)]
    assert tree["r"]["subtree_has_error"] and tree["c"]["clock_skew"] and not tree["d"]["subtree_has_error"]
    assert {r["span_id"] for r in traces.critical_path(df).collect()} == set("rcdxyqpz")


def test_self_time_against_model(spark):
    rng, rows = random.Random(5), []
    for t in range(25):
        ids = [f"s{i}" for i in range(rng.randint(1, 9))]
        for i, s in enumerate(ids):
            a = rng.randint(0, 50)
            rows.append((f"t{t}", s, ids[rng.randrange(i)] if i else None, "svc", "n", a, a + rng.randint(0, 40), 0, 0, 1))
    want = {}
    for t, s, _, _, _, a, b, *_ in rows:
        covered = {x for r in rows if r[0] == t and r[2] == s for x in range(max(r[5], a), min(r[6], b))}
        want[t, s] = b - a - len(covered)
    assert {(r["trace_id"], r["span_id"]): r["self_nanos"] for r in traces.self_time(spans(spark, rows)).collect()} == want


POINTS = "metric_name string, metric_type int, temporality int, is_monotonic boolean, timestamp_nanos long, start_nanos long, value double, `service.name` string, attributes map<string,string>"
S = 1_000_000_000
T0 = 1000 * S


def test_series(spark):
    rows = [("http.requests", 1, 2, True, T0 + t * S, None, v, "a", {}) for t, v in ((0, 4.0), (10, 74.0), (30, 74.0), (35, 3.0), (40, 11.0))]
    rows += [("cpu.util", 0, None, None, T0 + t * S, None, v, s, {}) for s, t, v in (("a", 10, 10.0), ("a", 40, 30.0), ("b", 10, 5.0), ("b", 40, 7.0))]
    df = spark.createDataFrame(rows, POINTS)
    values = lambda d: [r["v"] for r in d.orderBy(*(["service"] if "service" in d.columns else []), "bucket").collect()]
    assert values(metrics.series(df, "http.requests", T0, T0 + 60 * S, 2, "increase")) == [70, 11]
    assert values(metrics.series(df, "http.requests", T0, T0 + 60 * S, 2, "rate")) == [70 / 30, 11 / 30]
    assert values(metrics.series(df, "cpu.util", T0, T0 + 60 * S, 2, "avg", ["service"])) == [10, 30, 5, 7]
    assert values(metrics.series(df, "cpu.util", T0, T0 + 60 * S, 4, "last", ["service"])) == [10, None, 30, None, 5, None, 7, None]


def test_quantiles(spark):
    def q(ranges, p):
        rows = spark.createDataFrame([([dict(zip(("lo", "hi", "c"), map(float, r), strict=True)) for r in ranges],)], "r array<struct<lo:double,hi:double,c:double>>")
        return rows.select(distributions.quantile(F.col("r"), p)).first()[0]

    inf = float("inf")
    assert q([(0, 10, 5), (10, 20, 5)], 0.5) == 10 and q([(0, 10, 4), (10, inf, 6)], 0.9) == 10 and q([(0, 10, 0)], 0.5) is None and q([(0, 10, 2), (10, 20, 2)], 1) == 20


def test_cumulative_histograms(spark):
    h = lambda n, s, c, b=(1.0, 2.0): {"count": n, "sum": s, "bucket_counts": list(c), "explicit_bounds": list(b), "min": None, "max": None}
    schema = "metric_name string, temporality int, timestamp_nanos long, start_nanos long, histogram struct<count:bigint,sum:double,bucket_counts:array<bigint>,explicit_bounds:array<double>,min:double,max:double>, attributes map<string,string>"
    rows = [("h", 2, 1, None, h(10, 10.0, (10, 0, 0)), {}), ("h", 2, 12, None, h(30, 40.0, (20, 10, 0)), {}), ("h", 2, 22, None, h(4, 6.0, (0, 4, 0)), {})]
    df = spark.createDataFrame(rows, schema)
    get = lambda agg: [r["v"] for r in distributions.histogram_series(df, "h", 0, 30, 3, agg).orderBy("bucket").collect()]
    assert get("count") == [0, 20, 4] and get("sum") == [0, 30, 6] and get("p50") == [None, 1.0, 1.5]


def test_facet_limits(spark):
    df = spark.createDataFrame([("a",), ("a",), ("b",), (None,)], "body string").withColumn("attributes", F.create_map().cast("map<string,string>"))
    assert logs.facet(df, "logs", "body", F.lit(True), 1).collect() == [("a", 2, True)]
    assert logs.facet(df, "logs", "body", F.lit(True), 5).orderBy("value").collect() == [("a", 2, False), ("b", 1, False)]
    assert logs.facet(df, "logs", "body", F.lit(True), 0).collect() == []
    with pytest.raises(ValueError):
        logs.facet(df, "logs", "body", F.lit(True), 2000)


def test_uptime_batch_and_stream_agree(spark, tmp_path):
    beats = [(f"m{m}", t, random.Random(m * 97 + t).random() > 0.5, 5, "down!") for m in range(3) for t in range(30)]
    df = spark.createDataFrame(beats, "monitor_id string, ts long, ok boolean, latency_ms long, error string")
    batch = {(r["monitor_id"], r["ts"], r["transition"]) for r in uptime.states(df, 2).where("transition is not null").collect()}
    df.write.parquet(str(tmp_path / "in"))
    stream = live.uptime_transitions(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), 2)
    stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    assert {(r["monitor_id"], r["ts"], r["transition"]) for r in spark.read.schema(stream.schema).parquet(str(tmp_path / "out")).collect()} == batch


def test_ingest_values(spark):
    raw = '{"resourceLogs":[{"resource":{"attributes":[{"key":"service.name","value":{"stringValue":"api"}},{"key":"a","value":{"stringValue":"under"}}]},"scopeLogs":[{"logRecords":[{"timeUnixNano":"0","observedTimeUnixNano":"7","severityText":"","body":{"doubleValue":2.0},"attributes":[{"key":"a","value":{"intValue":"5"}},{"key":"l","value":{"arrayValue":{"values":[{"stringValue":"x"},{"boolValue":true}]}}},{"key":"m","value":{"kvlistValue":{"values":[{"key":"k","value":{"doubleValue":1.5}}]}}}]}]}]}]}'
    row = ingest.otlp_logs(spark.createDataFrame([(raw,)], "value string")).first()
    assert (row["timestamp_nanos"], row["severity_text"], row["body"], row["service.name"], row["attributes"]) == (7, None, "2", "api", {"a": "5", "l": "[x,true]", "m": "{k=1.5}"})


def test_nested_values(spark):
    deep = '{"arrayValue":{"values":[{"arrayValue":{"values":[{"intValue":"1"},{"kvlistValue":{"values":[{"key":"k","value":{"stringValue":"v"}},{"key":"e"}]}}]}},{"bytesValue":"3q2+7w=="},{}]}}'
    raw = '{"resourceLogs":[{"scopeLogs":[{"logRecords":[{"timeUnixNano":"3","body":' + deep + ',"attributes":[{"key":"b","value":{"bytesValue":"AP8="}}]}]}]}]}'
    row = ingest.otlp_logs(spark.createDataFrame([(raw,)], "value string")).first()
    assert (row["body"], row["attributes"]) == ("[[1,{k=v,e=}],deadbeef,]", {"b": "00ff"})


def test_cumulative_exponential(spark):
    side = "struct<offset:int,bucket_counts:array<bigint>>"
    kind = f"struct<count:bigint,sum:double,scale:int,zero_count:bigint,positive:{side},negative:{side},min:double,max:double>"
    schema = f"metric_name string, metric_type int, temporality int, timestamp_nanos long, start_nanos long, exp_histogram {kind}, `service.name` string, attributes map<string,string>"
    point = lambda t, count, scale, counts, user="a": ("h", 3, 2, t, None, (count, float(count), scale, 0, (0, counts), None, None, None), "api", {"user": user})
    rows = [point(10, 10, 1, [10]), point(110, 14, 0, [14]), point(120, 20, 0, [20]), point(210, 3, 0, [3]), point(220, 5, 1, [2, 3]), point(15, 100, 0, [100], "b"), point(130, 101, 0, [101], "b")]
    df = spark.createDataFrame(rows, schema)
    series = lambda agg, **more: [r["v"] for r in distributions.exponential_series(df, "h", 0, 300, 3, agg, **more).orderBy("bucket").collect()]
    # first samples add nothing; a new scale and a fall start the series anew
    assert series("count") == [0.0, 21.0, 8.0] and series("sum") == [0.0, 21.0, 8.0]
    assert series("p50")[0] is None and 1 < series("p50")[1] < 2
    assert series("count", series_key="group")[0] == 100.0  # one series of all rows: 100 at another scale starts anew
    assert distributions.exponential_series(df.where("timestamp_nanos < 50 and attributes['user'] = 'a'"), "h", 0, 300, 3, "p50").where("v is not null").count() == 0


def test_spans_that_end_before_they_start(spark):
    df = spans(spark, [("t", "r", None, "a", "x", 100, 200, 100, 1, 2), ("t", "c", "r", "a", "y", 150, 90, 0, 1, 2)])
    tree = {r["span_id"]: r for r in traces.trace_tree(df).collect()}
    assert not tree["c"]["clock_skew"] and tree["c"]["critical"]


def test_fingerprints(spark):
    rows = spark.createDataFrame([("TypeError", "chunk 12", "app.js:4"), ("TypeError", "chunk 99", "app.js:4"), ("", "", None)], "t string, m string, f string")
    got = [r[0] for r in rows.select(ingest.fingerprint(F.col("t"), F.col("m"), F.col("f"))).collect()]
    h = 0xCBF29CE484222325
    for b in b"TypeError\x1fchunk #\x1fapp.js:4":
        h = (h ^ b) * 0x100000001B3 % (1 << 64)
    assert got[0] == got[1] == f"{h:016x}" and got[2] != got[0]
