"""Structured Streaming twins: live tail, continuous volumes and RED, state machines, counters, ingest."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BooleanType, LongType, StructField, StructType

from glimt.functions.fields import quoted, signal_time
from glimt.operators.alerts import breaches
from glimt.operators.apm import _red, with_threshold
from glimt.sources import tables

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def event_time(df: DataFrame, signal: str) -> DataFrame:
    """A timestamp column ``ts`` for windows and watermarks (microseconds)."""
    return df.withColumn("ts", F.timestamp_micros(F.call_function("div", F.col(signal_time(signal)), F.lit(1000))))


def tail_batch(rows: DataFrame, where: Column, signal: str, cap: int, seconds: float) -> DataFrame:
    """Of one flush: the newest ``cap`` matching rows, oldest first, with how many matched a second where some were left out."""
    matched = rows.where(where)
    total = matched.count()  # a flush that shows all of them needs no cut, which one task would make
    newest = matched if total <= cap else matched.orderBy(F.desc(signal_time(signal)), "trace_id", "span_id").limit(cap)
    rate = F.lit(total / seconds if total > cap else None).cast("double")
    return newest.withColumn("matched_per_second", rate).orderBy(signal_time(signal), "trace_id", "span_id")


def live_tail(stream: DataFrame, where: Column, signal: str, emit: Callable[[DataFrame, int], None], checkpoint: str, cap: int = 500, seconds: float = 1.0, **trigger: Any) -> StreamingQuery:
    def flush(batch: DataFrame, number: int) -> None:
        emit(tail_batch(batch, where, signal, cap, seconds), number)

    return stream.writeStream.foreachBatch(flush).option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": f"{seconds} seconds"})).start()


def continuous_log_volume(stream: DataFrame, step: str = "1 minute", late: str = "5 minutes") -> DataFrame:
    s = F.col("severity_number")
    level = F.when(s.between(1, 8), "debug").when(s.between(13, 16), "warn").when(s.between(17, 20), "error").when(s.between(21, 24), "fatal").otherwise("info")
    return event_time(stream, "logs").withWatermark("ts", late).groupBy(F.window("ts", step), level.alias("level")).agg(F.count(F.lit(1)).alias("count")).select(F.col("window.start").alias("start"), "level", "count")


def continuous_span_volume(stream: DataFrame, step: str = "1 minute", late: str = "5 minutes") -> DataFrame:
    state = F.when(F.col("status_code") == 1, "ok").when(F.col("status_code") == 2, "error").otherwise("unset")
    return event_time(stream, "spans").withWatermark("ts", late).groupBy(F.window("ts", step), state.alias("status")).agg(F.count(F.lit(1)).alias("count")).select(F.col("window.start").alias("start"), "status", "count")


def continuous_red(stream: DataFrame, step: str = "1 minute", slide: str | None = None, late: str = "5 minutes", thresholds: DataFrame | None = None) -> DataFrame:
    """RED and Apdex per service in tumbling windows, or sliding ones."""
    rows = with_threshold(event_time(stream, "spans").withWatermark("ts", late), thresholds).where("service is not null")
    return rows.groupBy(F.window("ts", step, slide or step), "service").agg(*_red(False)).select(F.col("window.start").alias("start"), "service", "count", "errors", "p50", "p90", "p99", "satisfied", "tolerating", "frustrated")


class LateRows(StreamingQueryListener):
    """Counts, for each query of a session, what its operators dropped behind the watermark, over all its batches.

    Operators see rows after they were summed within a task; ``split_late`` counts and keeps the rows themselves. ``spark.streams.addListener(late)`` before a query starts; ``late.dropped[query.id]`` is complete when its last batch has been reported.
    """

    def __init__(self) -> None:
        self.dropped: dict[str, int] = {}
        self.batches: dict[str, int] = {}

    def onQueryStarted(self, event: Any) -> None:
        self.dropped.setdefault(str(event.id), 0)

    def onQueryProgress(self, event: Any) -> None:
        progress = event.progress
        key = str(progress.id)
        self.dropped[key] = self.dropped.get(key, 0) + sum(op.numRowsDroppedByWatermark for op in progress.stateOperators)
        self.batches[key] = max(self.batches.get(key, -1), progress.batchId)

    def onQueryIdle(self, event: Any) -> None:
        pass

    def onQueryTerminated(self, event: Any) -> None:
        pass


def split_late(stream: DataFrame, signal: str, step_nanos: int, late_nanos: int, root: str, checkpoint: str, **trigger: Any) -> StreamingQuery:
    """Deal a stream into ``root``: rows in time for their window of ``step_nanos``, and rows that come later, none of which is lost.

    A row is late if its window ended ``late_nanos`` or more before the latest time seen in earlier batches. Windowed aggregations drop rows
    by the same rule, a batch later. Batches have folders of their own, which a replay writes anew, and the latest time is kept with each, so the split
    is the same after any failure. Read on with ``in_time`` and ``late_rows``.
    """
    time = F.col(signal_time(signal))

    def flush(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        seen = None
        if number:
            before = spark.read.schema("seen long").json(f"{root}/seen/batch={number - 1}").first()
            seen = before["seen"] if before else None
        ends = (F.call_function("div", time, F.lit(step_nanos)) + 1) * step_nanos
        is_late = F.lit(False) if seen is None else F.coalesce(ends <= seen - late_nanos, F.lit(False))
        latest = Observation()
        marked = batch.observe(latest, F.max(time).alias("latest")).withColumn("late", is_late)
        marked.write.mode("overwrite").partitionBy("late").parquet(f"{root}/rows/batch={number}")
        known = [x for x in (seen, latest.get["latest"]) if x is not None]
        spark.createDataFrame([(max(known, default=None),)], "seen long").coalesce(1).write.mode("overwrite").json(f"{root}/seen/batch={number}")

    return stream.writeStream.foreachBatch(flush).option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "10 seconds"})).start()


def in_time(spark: SparkSession, root: str, schema: StructType, **options: Any) -> DataFrame:
    """The rows in time, as a stream: none of them is dropped by an aggregation with the same delay."""
    return spark.readStream.schema(schema).options(**options).parquet(f"{root}/rows/batch=*/late=false")


def late_rows(spark: SparkSession, root: str, schema: StructType) -> DataFrame:
    """The late rows so far, with the number of their batch."""
    fields = StructType([*schema.fields, StructField("batch", LongType()), StructField("late", BooleanType())])
    return spark.read.schema(fields).option("basePath", f"{root}/rows").parquet(f"{root}/rows").where("late").drop("late")


class UptimeProcessor(StatefulProcessor):
    """State of a monitor: (state, failures in a row); a row for each transition."""

    def __init__(self, retries: int) -> None:
        self.need = max(retries, 1)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("uptime", "state string, fails int")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timers: Any) -> Iterator[pd.DataFrame]:
        now, fails = self.state.get() if self.state.exists() else ("pending", 0)
        out = []
        beats = pd.concat(list(rows)).sort_values("ts", kind="stable")
        for ts, ok, error in beats[["ts", "ok", "error"]].itertuples(index=False):
            fails = 0 if ok else fails + 1
            new = "up" if ok else "down" if fails >= self.need else now
            if new != now:
                move = "went_down" if new == "down" else "recovered" if now == "down" else "went_up"
                out.append((key[0], ts, move, error if move == "went_down" else None))
            now = new
        self.state.update((now, fails))
        yield pd.DataFrame(out, columns=["monitor_id", "ts", "transition", "cause"])

    def close(self) -> None:
        pass


def uptime_transitions(beats: DataFrame, retries: int = 3) -> DataFrame:
    return beats.groupBy("monitor_id").transformWithStateInPandas(UptimeProcessor(retries), "monitor_id string, ts long, transition string, cause string", "Append", "None")


class AlertProcessor(StatefulProcessor):
    """State of a (rule, series): (state, since, last sample). A null value, or no sample for ``gone_after_ms``, means that the series is gone."""

    def __init__(self, gone_after_ms: int | None = None) -> None:
        self.gone_after = gone_after_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("alert", "state string, since long, last long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timers: Any) -> Iterator[pd.DataFrame]:
        now, since, last = self.state.get() if self.state.exists() else ("ok", 0, None)
        out = []
        if self.gone_after and last is not None:
            self.handle.deleteTimer(last + self.gone_after)
        for at, value, breach, for_ms in pd.concat(list(rows)).sort_values("at", kind="stable")[["at", "value", "breach", "for_ms"]].itertuples(index=False):
            if self.gone_after and last is not None and at - last > self.gone_after:
                out += self._gone(key, now, last + self.gone_after)
                now = "ok"
            if not breach:
                new = "ok"
            else:
                since = at if now == "ok" else since
                new = "triggered" if at - since >= for_ms else "pending"
            if new != now and (new != "ok" or now == "triggered"):
                out.append((*key, at, None if pd.isna(value) else value, "resolved" if new == "ok" else new))
            now, last = new, int(at)
        self.state.update((now, int(since), last))
        if self.gone_after and last is not None:
            self.handle.registerTimer(last + self.gone_after)
        yield self._frame(out)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        now, since, last = self.state.get()
        self.state.update(("ok", since, last))
        yield self._frame(self._gone(key, now, expiredTimerInfo.getExpiryTimeInMs()))

    def _gone(self, key: Any, now: str, at: int) -> list[tuple]:
        return [(*key, at, None, "resolved")] if now == "triggered" else []

    def _frame(self, out: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(out, columns=["rule_id", "series_key", "at", "value", "transition"])

    def close(self) -> None:
        pass


def alert_transitions(samples: DataFrame, rules: DataFrame, gone_after_ms: int | None = None, late: str = "1 hour") -> DataFrame:
    """Transitions over a stream of samples (rule_id, series_key, at, value).

    A series is gone in an evaluation that brings it with a null value; with ``gone_after_ms`` also where no sample has come for so long,
    by a timer of event time (``at``; the watermark follows ``late`` behind).
    """
    rows = samples.join(rules.select("rule_id", "op", "threshold", "for_secs"), "rule_id")
    breach = F.coalesce(breaches(F.col("value"), F.col("op"), F.col("threshold")), F.lit(False)).alias("breach")
    rows = rows.select("rule_id", "series_key", "at", "value", breach, (F.col("for_secs") * 1000).cast("long").alias("for_ms"), F.timestamp_millis("at").alias("_ts"))
    rows, mode = (rows.withWatermark("_ts", late), "EventTime") if gone_after_ms else (rows, "None")
    return rows.groupBy("rule_id", "series_key").transformWithStateInPandas(AlertProcessor(gone_after_ms), "rule_id string, series_key string, at long, value double, transition string", "Append", mode)


def span_samples(spans: DataFrame, rules: DataFrame, step: str, late: str) -> DataFrame:
    """Samples (rule_id, series_key, at, value) of a stream of raw spans: one for each window, service and tenant, once the watermark has passed it.

    ``rules``: rule_id and measure (error_rate in percent, or request_rate a second); ``at``: the window's end in milliseconds.
    """
    rows = event_time(spans, "spans").withWatermark("ts", late).where(quoted("service.name").isNotNull())
    tenant = quoted("tenant") if "tenant" in spans.columns else F.lit(None).cast("string")
    key = F.concat_ws(",", F.concat(F.lit("service="), quoted("service.name")), F.concat(F.lit("tenant="), tenant))
    red = rows.groupBy(F.window("ts", step), key.alias("series_key")).agg(F.count(F.lit(1)).alias("count"), F.count_if(F.col("status_code") == 2).alias("errors"))
    seconds = F.unix_seconds("window.end") - F.unix_seconds("window.start")
    joined = red.join(F.broadcast(rules.select("rule_id", "measure")))  # a row a rule
    value = F.when(F.col("measure") == "error_rate", F.col("errors") * 100.0 / F.col("count")).when(F.col("measure") == "request_rate", F.col("count") / seconds)
    return joined.select("rule_id", "series_key", "window", value.alias("value"))


def alerts_from_spans(spans: DataFrame, rules: DataFrame, step: str, step_ms: int, late: str) -> DataFrame:
    """Transitions of alert rules over a stream of raw spans, in one query: windowed samples, then a state for each rule and series.

    Rules: rule_id, measure, op, threshold, for_secs. A window without a span of a series resolves it, by a timer of event time.
    """
    samples = span_samples(spans, rules, step, late)
    rows = samples.join(F.broadcast(rules.select("rule_id", "op", "threshold", "for_secs")), "rule_id")  # a row a rule
    breach = F.coalesce(breaches(F.col("value"), F.col("op"), F.col("threshold")), F.lit(False)).alias("breach")
    # the time of a window carries the watermark on to the next operator
    rows = rows.select("rule_id", "series_key", F.unix_millis("window.end").alias("at"), "value", breach, (F.col("for_secs") * 1000).cast("long").alias("for_ms"), F.window_time("window").alias("_ts"))
    return rows.groupBy("rule_id", "series_key").transformWithStateInPandas(AlertProcessor(step_ms), "rule_id string, series_key string, at long, value double, transition string", "Append", "EventTime")


class CounterProcessor(StatefulProcessor):
    """State of a series: (last value, last start); a row of growth for each sample."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("counter", "value double, start long, at long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timers: Any) -> Iterator[pd.DataFrame]:
        last = self.state.get() if self.state.exists() else None
        out = []
        for at, start, value in pd.concat(list(rows)).sort_values(["timestamp_nanos", "value"], kind="stable")[["timestamp_nanos", "start_nanos", "value"]].itertuples(index=False):
            start = None if pd.isna(start) else int(start)
            if last is None:
                up = 0.0
            elif value < last[0] or (start is not None and last[1] is not None and start > last[1]):
                up = value
            else:
                up = value - last[0]
            last = (float(value), start, int(at))
            out.append((*key, at, up))
        self.state.update(last)
        yield pd.DataFrame(out, columns=["metric_name", "series", "timestamp_nanos", "increase"])

    def close(self) -> None:
        pass


def counter_increases(points: DataFrame) -> DataFrame:
    """Reset-aware growth at each sample of (metric_name, series, timestamp_nanos, start_nanos, value)."""
    rows = points.where("value is not null").select("metric_name", "series", "timestamp_nanos", "start_nanos", "value")
    return rows.groupBy("metric_name", "series").transformWithStateInPandas(CounterProcessor(), "metric_name string, series string, timestamp_nanos long, increase double", "Append", "None")


def put_batch(rows: DataFrame, number: int, root: str, signal: str, name: str = "stream", partitions: int | None = None) -> None:
    """Put a batch into the table exactly once: sorted, compressed files whose names carry the stream's name and the batch's number.

    The files are made in a folder of the batch's own, which a replay writes anew. What an attempt that broke off has already moved in is deleted
    before the files are moved, so a batch that is replayed after any failure leaves each row once. Names that begin with ``_`` are passed
    over by readers: the batch is shown by renames alone, when all of it is there.
    """
    spark, out = rows.sparkSession, f"{root}/{tables.FOLDERS[signal]}"
    staged, tag = f"{root}/_staging/{name}/{number}", f"{name}-{number:010}-"
    written = tables.writer(tables.laid_out(rows, signal, partitions), "overwrite").partitionBy("date")
    written.option(f"parquet.bloom.filter.enabled#{tables.BLOOM[signal]}", "true").parquet(staged)
    path = spark._jvm.org.apache.hadoop.fs.Path
    system = path(root).getFileSystem(spark._jsc.hadoopConfiguration())
    for pattern in (f"{out}/date=*/{tag}*", f"{out}/date=*/_{tag}*"):
        for old in system.globStatus(path(pattern)) or []:
            system.delete(old.getPath(), False)
    moved = []
    for k, made in enumerate(system.globStatus(path(f"{staged}/date=*/*.parquet")) or []):
        folder = path(f"{out}/{made.getPath().getParent().getName()}")
        system.mkdirs(folder)
        hidden = path(folder, f"_{tag}{k:05}.parquet")
        if not system.rename(made.getPath(), hidden):
            raise OSError(f"could not move {made.getPath()} into {folder}")
        moved.append((hidden, path(folder, f"{tag}{k:05}.parquet")))
    for hidden, shown in moved:
        if not system.rename(hidden, shown):
            raise OSError(f"could not show {hidden}")
    system.delete(path(staged), True)


def ingest(raw: DataFrame, mapping: Callable[[DataFrame], DataFrame], root: str, signal: str, checkpoint: str, name: str = "stream", partitions: int | None = None, **trigger: Any) -> StreamingQuery:
    """A stream of raw records through one of the ingest mappings into the partitioned table, exactly once (see ``put_batch``).

    ``name`` tells streams that write to one table apart. Files are those of ``tables.sink``; consolidation merges small ones.
    """
    def flush(batch: DataFrame, number: int) -> None:
        put_batch(mapping(batch), number, root, signal, name, partitions)

    return raw.writeStream.foreachBatch(flush).option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "10 seconds"})).start()


def by_service(stream: DataFrame, service: str) -> DataFrame:
    return stream.where(quoted("service.name") == service)
