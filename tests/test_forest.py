"""Trace forests against a plain walk, one trace at a time; both the version of many traces a task and that of giant traces."""

import random
from itertools import groupby

import pytest
from pyspark.sql import functions as F

from glimt.functions import spread
from glimt.functions.spread import join_hot, previous, running_sum
from glimt.functions.storage import kept
from glimt.operators import forest, traces

SCHEMA = "trace_id string, span_id string, parent_span_id string, start long, end long, status_code int"
NAMES = [x.split()[0] for x in forest.SCHEMA.split(", ")]


def plain_tree(rows):
    """One trace, rows of (trace_id, span_id, parent_span_id, start, end, status_code), as a forest.

    Parents that are absent or the span itself make roots; a pure cycle starts at its earliest span.
    """
    earliest = {}
    for r in sorted(rows, key=lambda r: (r[3], r[1])):
        earliest.setdefault(r[1], r)
    rows = list(earliest.values())
    ids, parents, start, end = ([r[k] for r in rows] for k in (1, 2, 3, 4))
    bad = [r[5] == 2 for r in rows]
    at = {s: i for i, s in enumerate(ids)}
    up = [at.get(p) if p is not None and p != s else None for s, p in zip(ids, parents, strict=True)]
    children = {}
    for i, p in enumerate(up):
        children.setdefault(p, []).append(i)
    depth, order, error, skew = [-1] * len(ids), [], list(bad), [False] * len(ids)

    def walk(root):
        stack = [(root, 0)]
        while stack:
            i, d = stack.pop()
            if depth[i] >= 0:
                continue
            depth[i] = d
            order.append(i)
            stack.extend((c, d + 1) for c in reversed(children.get(i, [])))

    for i in range(len(ids)):
        if up[i] is None:
            walk(i)
    for i in range(len(ids)):  # cycles, by earliest span
        if depth[i] < 0:
            up[i] = None
            walk(i)
    for i in reversed(order):
        if up[i] is not None and error[i]:
            error[up[i]] = True
        if up[i] is not None:
            skew[i] = start[i] < start[up[i]] or end[i] > end[up[i]]
    critical, level = set(), [i for i in range(len(ids)) if up[i] is None]
    while level:  # from the root that ends last, always the child that ends last
        i = max(level, key=lambda k: (end[k], -start[k], ids[k]))
        critical.add(i)
        level = [c for c in children.get(i, []) if up[c] == i and c not in critical]
    rank = {i: k for k, i in enumerate(order)}
    zero = min(start) if start else 0
    return {"trace_id": [r[0] for r in rows], "span_id": ids, "position": [rank[i] for i in range(len(ids))], "depth": depth, "offset_nanos": [s - zero for s in start], "clock_skew": skew, "subtree_has_error": error, "critical": [i in critical for i in range(len(ids))]}


def plain(rows):
    out = []
    for _, own in groupby(sorted(rows, key=lambda r: r[0]), key=lambda r: r[0]):
        tree = plain_tree(list(own))
        out += zip(*(tree[c] for c in NAMES), strict=True)
    return sorted(out)


def random_trace(rng, name, n):
    """Roots, absent parents, spans that are their own parents, cycles with tails, repeated ids, ties in time."""
    rows = []
    for i in range(n):
        up = rng.choice([None, f"s{rng.randrange(n)}", f"s{max(0, i - 1)}", f"s{i}", "gone", f"s{rng.randrange(max(1, i))}", f"s{rng.randrange(max(1, i))}"])
        start = rng.randrange(12)
        rows.append((name, f"s{i}", up, start, start + rng.randrange(9), rng.choice([0, 1, 1, 1, 2])))
    return rows + [(name, f"s{rng.randrange(n)}", None, 20, 25, 2) for _ in range(n // 9)]


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    return [r for t in range(60) for r in random_trace(rng, f"t{t}", rng.choice([1, 2, 5, 30, 90]))]


def collected(df):
    return sorted(tuple(r) for r in df.select(*NAMES).collect())


def test_forest_of_many_traces(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    want = plain(rows)
    assert collected(df.repartition(3, "trace_id").sortWithinPartitions("trace_id").mapInArrow(forest.forests, forest.SCHEMA)) == want
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)  # traces over many batches
    try:
        assert collected(df.repartition(3, "trace_id").sortWithinPartitions("trace_id").mapInArrow(forest.forests, forest.SCHEMA)) == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_giant_forest(spark, rows):
    some = [r for r in rows if r[0] < "t2"]
    assert collected(forest.giant_forest(spark.createDataFrame(some, SCHEMA), hot_rows=10, parts=3)) == plain(some)


def test_giant_chain_and_star(spark):
    chain = [("chain", f"c{i:05}", f"c{i - 1:05}" if i else None, i, 5000 - i, 2 if i == 700 else 1) for i in range(900)]
    star = [("star", f"x{i:05}", "x00000" if i else None, i % 50, 60 + i % 70, 2 if i == 7 else 1) for i in range(1500)]
    small = [("small", "a", None, 0, 5, 1), ("small", "b", "a", 1, 9, 2)]
    df = spark.createDataFrame(chain + star + small, SCHEMA).withColumnsRenamed({"start": "start_time_nanos", "end": "end_time_nanos"}).withColumn("duration_nanos", F.lit(None).cast("long"))
    assert collected(traces.trace_tree(df, giant=500)) == plain(chain + star + small)


def test_giant_traces_are_read_once(spark):
    """However many joins follow, what the spans come from is worked out once."""
    star = [("star", f"x{i:03}", "x000" if i else None, i % 50, 60 + i % 70, 2 if i == 7 else 1) for i in range(300)]
    passed = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            passed.add(batch.num_rows)
            yield batch

    df = spark.createDataFrame(star, SCHEMA)
    assert collected(forest.giant_forest(df.mapInArrow(count, df.schema), hot_rows=100)) == plain(star)
    assert passed.value == 300


def test_giant_traces_keep_few_rows(spark, monkeypatch):
    """Leaves take no part in the rounds: all that is kept on the way comes to a few rows a span, and a mixture of deep and flat trees stays right."""
    rng = random.Random(5)
    flat = [("flat", f"r{i}", None, rng.randrange(9), 9 + rng.randrange(9), i % 3) for i in range(40)]  # no span has children
    wide = [("wide", "top", None, 0, 90, 1)] + [("wide", f"m{i}", "top", rng.randrange(30), 30 + rng.randrange(60), 1) for i in range(60)]
    wide += [("wide", f"l{i}", f"m{i % 50}", rng.randrange(50), 50 + rng.randrange(50), 2 if i % 97 == 0 else 1) for i in range(1500)]
    deep = [("deep", f"d{i}", f"d{i - 1}" if i else None, i, 500 - i, 1) for i in range(40)] + [("deep", f"e{i}", f"d{rng.randrange(40)}", rng.randrange(40), 41 + rng.randrange(9), 2 if i == 8 else 1) for i in range(300)]
    written = []

    def counted(df, name="kept"):
        out = kept(df, name)
        written.append(out.count())
        return out

    monkeypatch.setattr(forest, "kept", counted)
    monkeypatch.setattr(spread, "kept", counted)
    rows = flat + wide + deep
    for some in (flat, rows):
        written.clear()
        assert collected(forest.giant_forest(spark.createDataFrame(some, SCHEMA), hot_rows=100)) == plain(some)
    assert sum(written) < 6 * len(rows)


def test_giant_traces_alone(spark):
    """Where all traces are giants the spans are worked out twice: to count them, and to place them."""
    passed = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            passed.add(batch.num_rows)
            yield batch

    star = [("star", f"x{i:03}", "x000" if i else None, i % 50, 60 + i % 70, 2 if i == 7 else 1) for i in range(300)]
    few = [("few", "a", None, 0, 5, 1), ("few", "b", "a", 1, 9, 2)]
    for rows, times in ((star, 2), (star + few, 3)):
        passed.value = 0
        df = spark.createDataFrame(rows, SCHEMA).withColumnsRenamed({"start": "start_time_nanos", "end": "end_time_nanos"}).withColumn("duration_nanos", F.lit(None).cast("long"))
        assert collected(traces.trace_tree(df.mapInArrow(count, df.schema), giant=100)) == plain(rows)
        assert passed.value == times * len(rows)


def test_giant_traces_beside_spans_without_trace(spark):
    star = [("star", f"x{i:03}", "x000" if i else None, i % 50, 60 + i % 70, 1) for i in range(30)]
    stray = [(None, f"y{i:03}", None, i, i + 1, 1) for i in range(30)]
    df = spark.createDataFrame(star + stray, SCHEMA).withColumnsRenamed({"start": "start_time_nanos", "end": "end_time_nanos"}).withColumn("duration_nanos", F.lit(None).cast("long"))
    found = traces.trace_tree(df, giant=10).select("trace_id", "span_id").collect()
    assert sorted(r["span_id"] for r in found) == sorted(r[1] for r in star + stray)


def test_join_with_hot_keys(spark):
    left = spark.range(3000).selectExpr("id", "case when id < 2000 then 7 else id % 40 end as k")
    right = spark.range(0, 40, 2).selectExpr("id as k", "id * 10 as v").unionByName(spark.createDataFrame([(7, 70)], "k long, v long"))
    for how in ("left", "inner"):
        got = sorted(map(tuple, join_hot(left, right, ["k"], how, hot_rows=100).select("id", "k", "v").collect()), key=repr)
        assert got == sorted(map(tuple, left.join(right, "k", how).select("id", "k", "v").collect()), key=repr)


def test_running_sum_over_ranges(spark):
    df = spark.range(2000).selectExpr("id", "case when id % 10 = 0 then 'rare' else 'hot' end as k", "id % 17 as v")
    got = {r["id"]: r["s"] for r in running_sum(df, ["k"], ["id"], "v", "s", parts=9).collect()}
    total = {"rare": 0, "hot": 0}
    for i in range(2000):
        k = "rare" if i % 10 == 0 else "hot"
        assert got[i] == total[k]
        total[k] += i % 17


def test_previous_over_chunks(spark):
    rng = random.Random(2)
    rows = [(rng.choice(["a", "b", None]), rng.randrange(100), rng.choice([None, 1, 2]), i) for i in range(400)]
    df = spark.createDataFrame(rows, "k string, t long, u long, v long")
    got = {r["v"]: (r["_before"]["v"] if r["_before"] else None) for r in previous(df, [F.col("k")], ["t", "u", "v"], ["v"], F.expr("t div 7")).collect()}
    last = {}
    for k, t, u, v in sorted(rows, key=lambda r: (r[1], r[2] is not None, r[2] or 0, r[3])):
        assert got[v] == last.get(k)
        last[k] = v


def test_previous_of_short_and_long_series(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["a", "b", "b", "b", None]), rng.randrange(100), i) for i in range(400)]
    df = spark.createDataFrame(rows, "k string, t long, v long")
    last, want = {}, {}
    for k, t, v in sorted(rows, key=lambda r: r[1:]):
        want[v], last[k] = last.get(k), v
    for long_rows in (0, 150, 1000):
        found = previous(df, [F.col("k")], ["t", "v"], ["v"], F.expr("t div 7"), long_rows=long_rows)
        assert {r["v"]: (r["_before"]["v"] if r["_before"] else None) for r in found.collect()} == want
        assert ("_chunk" in found._jdf.queryExecution().executedPlan().toString()) == (long_rows < 1000)  # short series need one sort
