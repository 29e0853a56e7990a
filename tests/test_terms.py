"""Filter terms against hand-computed rows: numbers, absent fields, negation, levels."""

import pytest
from pyspark.sql import functions as F

from glimt.functions import buckets, terms

ROWS = [
    (1, "api", 18, "connection timeout", "abc", {"status_code": "500", "region": "us-east-1"}), (2, "web", 10, "served in 12ms", None, {"status_code": "200"}), (3, "api", 13, "slow query", "def", {"status_code": "200", "region": "eu-west-1"}),
    (4, "worker", None, None, None, {}), (5, "api", 21, "pool timeout waiting", None, {"status_code": "abc"}), (6, "web", 9, "", "ghi", {"status_code": "503"}), (7, "api", 14, "scientific status", None, {"status_code": "5e2"}),
    (8, "web", 11, "leading zeros", None, {"status_code": "007"}), (9, "api", 16, "decimal boundary", None, {"status_code": "499.5"}), (10, "worker", 12, "padded numeric", None, {"status_code": " 500"}), (11, "worker", 12, "suffix", None, {"status_code": "500d"}), (12, "worker", 12, "nan", None, {"status_code": "NaN"}),
]


@pytest.fixture(scope="module")
def logs(spark):
    return spark.createDataFrame(ROWS, "timestamp_nanos long, `service.name` string, severity_number int, body string, trace_id string, attributes map<string,string>")


CASES = {
    "at least": (lambda d: terms.compare(d, "logs", "status_code", ">=", 500), {1, 6, 7}),
    "not at least": (lambda d: terms.negate(terms.compare(d, "logs", "status_code", ">=", 500)), {2, 3, 4, 5, 8, 9, 10, 11, 12}),
    "below": (lambda d: terms.compare(d, "logs", "status_code", "<", 500), {2, 3, 8, 9}),
    "match": (lambda d: terms.match(d, "logs", "service", ["api", "worker"]), {1, 3, 4, 5, 7, 9, 10, 11, 12}),
    "exists": (lambda d: terms.exists(d, "logs", "region"), {1, 3}),
    "absent": (lambda d: terms.negate(terms.exists(d, "logs", "region")), {2, 4, 5, 6, 7, 8, 9, 10, 11, 12}),
    "text": (lambda d: terms.free_text("logs", "timeout"), {1, 5}),
    "case": (lambda d: terms.free_text("logs", "Timeout"), set()),
    "no text": (lambda d: terms.negate(terms.free_text("logs", "timeout")), {2, 3, 4, 6, 7, 8, 9, 10, 11, 12}),
    "level": (lambda d: terms.level(["error", "fatal"]), {1, 5}),
    "info": (lambda d: terms.level(["info"]), {2, 6, 8, 10, 11, 12}),
    "not level": (lambda d: terms.negate(terms.level(["info"])), {1, 3, 4, 5, 7, 9}),
    "all": (lambda d: terms.conjunction([]), set(range(1, 13))),
    "both": (lambda d: terms.conjunction([terms.level(["warn"]), terms.compare(d, "logs", "status_code", ">", 400)]), {7, 9}),
    "base": (lambda d: terms.log_filter(d, 2, 6, ["web", "api"], ["info", "fatal"], "", []), {2, 5, 6}),
}


@pytest.mark.parametrize("name", CASES)
def test_terms(logs, name):
    term, want = CASES[name]
    assert {r[0] for r in logs.where(term(logs)).select("timestamp_nanos").collect()} == want


def test_metrics_have_no_text():
    with pytest.raises(ValueError):
        terms.free_text("metrics", "x")


def test_buckets(spark):
    start, end, n = 1_700_000_000_000_000_003, 1_700_000_100_000_000_000, 7
    ts = [start, start + 1, (start + end) // 2, end - 1, end]
    got = spark.createDataFrame([(t,) for t in ts], "t long").select("t", buckets.bucket_index(F.col("t"), start, end, n).alias("i")).collect()
    assert [r["i"] for r in got] == [min((t - start) // ((end - start) // n), n - 1) for t in ts]
    labels = spark.range(n).select(buckets.bucket_label(F.col("id"), start, end, n).alias("l")).collect()
    assert [r["l"] for r in labels] == [start + (end - start) * i // n for i in range(n)]
    assert buckets.bucket_count(0, 10_500_000_000, 1) == 11 and buckets.bucket_count(0, 5) == 200
