"""Batches and files that do not grow with the input: OTLP documents, files of streams, flushes of a tail."""

import datetime

import pytest
from glimt.plans import q_state
from glimt.plans import views as v
from glimt.sources import ingest


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Lines of 6 suppliers whose keys agree modulo 64, orders and events whose ids agree in the last two digits."""
    d = str(tmp_path_factory.mktemp("rows"))
    day = datetime.datetime(1996, 3, 1)
    lines = [(k * 100, 4 * k, 64 * (k % 6), 1, float(k % 50 + 1), 10.5 * k, 0.0, 0.0, "RAN"[k % 3], "O", day + datetime.timedelta(days=k // 6)) for k in range(240)]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp").write.parquet(f"{d}/lineitem.parquet")
    spark.createDataFrame([(k * 100, day + datetime.timedelta(days=k)) for k in range(240)], "o_orderkey long, o_orderdate timestamp").write.parquet(f"{d}/orders.parquet")
    events = [(k * 1000, datetime.datetime(2024, 1, 2) + datetime.timedelta(hours=k), 70, "error", 1.5 * k, f'{{"k": {k}}}') for k in range(240)]
    spark.createDataFrame(events, "event_id long, ts timestamp, user_id long, event_type string, value double, props string").write.parquet(f"{d}/events.parquet")
    return d


def documents(monkeypatch, spark, mapping, query, d):
    """The documents that a query hands to a mapping, as numbers of time stamps in each."""
    seen = []
    plain = getattr(ingest, mapping)
    monkeypatch.setattr(ingest, mapping, lambda raw, *more: seen.append(raw) or plain(raw, *more))
    rows = query(spark, d).collect()
    time = "startTimeUnixNano" if mapping == "otlp_traces" else "timeUnixNano"
    return [r["value"].count(f'"{time}"') for r in seen[0].collect()], rows


def test_a_document_holds_points_of_one_supplier(monkeypatch, spark, tables):
    sizes, rows = documents(monkeypatch, spark, "otlp_metrics", q_state.s5d, tables)
    assert len(rows) == sum(sizes) == 3 * 240 and max(sizes) <= 3 * q_state.BATCH_DAYS and len(sizes) >= 6


def test_documents_of_logs_are_bounded_by_ids(monkeypatch, spark, tables):
    sizes, rows = documents(monkeypatch, spark, "otlp_logs", q_state.s3, tables)
    assert len(rows) == sum(sizes) == 240 and max(sizes) <= q_state.BATCH_EVENTS // 1000


def test_documents_of_spans_are_bounded_by_orders(monkeypatch, spark, tables):
    sizes, rows = documents(monkeypatch, spark, "otlp_traces", q_state.s4, tables)
    assert len(rows) == sum(sizes) == 240 and max(sizes) <= q_state.BATCH_TRACES // 100


@pytest.mark.parametrize("mapping, raw", [("otlp_logs", q_state.raw_logs), ("otlp_traces", q_state.raw_traces)])
def test_no_record_carries_the_list_it_comes_from(spark, tables, capsys, mapping, raw):
    getattr(ingest, mapping)(raw(spark, tables)).explain()
    kept = [line.split("), [")[1].split("]")[0] for line in capsys.readouterr().out.splitlines() if "Generate explode(" in line and "), [" in line]
    assert kept and not any(c.strip().split("#")[0] in ("r", "s") for line in kept for c in line.split(","))


def files(folder):
    return [p for p in folder.rglob("*.parquet")]


def test_files_of_a_stream_grow_with_the_tasks(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(q_state, "shared_folder", lambda _, name: str(tmp_path / name))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", 16)
    try:
        stream = q_state._stream(spark, spark.range(4000))
        assert len(files(tmp_path / "stream")) == 16
        assert sorted(r["id"] for r in q_state._all(spark, stream).collect()) == list(range(4000))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_a_part_is_one_batch_of_many_files(spark, monkeypatch, tmp_path):
    """Each part, of eight files, is one batch of the query; before, it was one file that one task wrote."""
    monkeypatch.setattr(q_state, "shared_folder", lambda _, name: str(tmp_path / name))
    stream, later = q_state._batches(spark, [spark.range(k * 100, k * 100 + 100).repartition(8) for k in range(3)])
    batches = []
    for put in (None, *later):
        if put is not None:
            put()
        writing = stream.writeStream.foreachBatch(lambda batch, n: batches.append((n, sorted(r["id"] for r in batch.collect()))))
        writing.option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start().awaitTermination()
    assert batches == [(k, list(range(k * 100, k * 100 + 100))) for k in range(3)] and len(files(tmp_path / "stream")) == 24


def test_span_tail_flushes(spark, tables):
    rows = v.spans(spark, tables).where("status_code = 2").count()
    found = q_state.w1s(spark, tables).collect()
    rates = [r["matched_per_second"] for r in found if r["matched_per_second"] is not None]
    assert rows == 80 and len(rates) == 50 and set(rates) == {rows / 2.0}
