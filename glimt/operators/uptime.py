"""Uptime from heartbeats: availability, up and down, incidents, response times, outage bands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F



def _order(*more: Column) -> Window:
    return Window.partitionBy("monitor_id").orderBy("ts", *more)


def availability(beats: DataFrame, monitors: DataFrame, since: int) -> DataFrame:
    """Per monitor: beats in the window and 100 * ok / n; 100 without any."""
    rows = beats.where(F.col("ts") >= since).groupBy("monitor_id").agg(F.count(F.lit(1)).alias("beats"), (F.count_if("ok") * 100.0 / F.count(F.lit(1))).alias("uptime_pct"))
    return monitors.select("monitor_id").join(rows, "monitor_id", "left").fillna({"beats": 0, "uptime_pct": 100.0})


def states(beats: DataFrame, retries: int = 3) -> DataFrame:
    """Per beat: the state after it (pending, up, down) and the transition it made (went_up, went_down, recovered).

    Down after max(retries, 1) failures in a row; any success is up.
    """
    need = max(retries, 1)
    ok = F.col("ok")
    runs = beats.withColumn("_run", F.count_if("ok").over(_order().rowsBetween(Window.unboundedPreceding, 0)))
    fails = F.sum((~ok).cast("int")).over(Window.partitionBy("monitor_id", "_run").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0))
    runs = runs.withColumn("_fails", fails)
    state = F.when(ok, "up").when(F.col("_fails") >= need, "down").otherwise(F.lit(None))
    known = F.last(F.col("_state"), ignorenulls=True).over(_order().rowsBetween(Window.unboundedPreceding, 0))
    runs = runs.withColumn("_state", state).withColumn("state", F.coalesce(known, F.lit("pending")))
    before = F.coalesce(F.lag("state").over(_order()), F.lit("pending"))
    runs = runs.withColumn("_before", before)
    move = F.when((F.col("state") == "down") & (F.col("_before") != "down"), "went_down").when((F.col("state") == "up") & (F.col("_before") == "down"), "recovered").when((F.col("state") == "up") & (F.col("_before") == "pending"), "went_up")
    return runs.withColumn("transition", move).drop("_run", "_fails", "_state", "_before")


def incidents(beats: DataFrame, retries: int = 3, limit: int | None = None) -> DataFrame:
    """Down periods: monitor, when it went down and recovered (null: still down), and the error that began it."""
    moves = states(beats, retries).where(F.col("transition").isin("went_down", "recovered"))
    rows = moves.withColumn("ended_at", F.lead("ts").over(_order())).where("transition = 'went_down'")
    out = rows.select("monitor_id", F.col("ts").alias("started_at"), "ended_at", F.coalesce("error", F.lit("down")).alias("cause"))
    return out if limit is None else out.orderBy(F.desc("started_at"), "monitor_id").limit(limit)


def as_alert_incidents(found: DataFrame) -> DataFrame:
    return found.select(F.concat(F.lit("uptime:"), "monitor_id").alias("rule_id"), F.lit("").alias("series_key"), "started_at", "ended_at", F.lit("critical").alias("severity"), F.col("cause").alias("summary"))


def statistics(beats: DataFrame, found: DataFrame) -> DataFrame:
    rows = beats.agg(F.count(F.lit(1)).alias("heartbeats")).withColumn("_one", F.lit(1))
    return rows.join(F.broadcast(found.agg(F.count(F.lit(1)).alias("incidents"), F.count_if(F.col("ended_at").isNull()).alias("open_incidents")).withColumn("_one", F.lit(1))), "_one").drop("_one")  # one row each


def pruned(beats: DataFrame, cutoff: int) -> DataFrame:
    """What stays of the heartbeats."""
    return beats.where(F.col("ts") >= cutoff)


def pruned_incidents(found: DataFrame, cutoff: int) -> DataFrame:
    """Open incidents stay whatever their age."""
    return found.where(F.col("ended_at").isNull() | (F.col("ended_at") >= cutoff))


def response_times(beats: DataFrame) -> DataFrame:
    """Of successful beats: min, avg, max and p95, the element floor(0.95 n) in order."""
    ok = beats.where("ok and latency_ms is not null")
    ranked = ok.withColumns({"_n": F.count(F.lit(1)).over(Window.partitionBy("monitor_id")), "_r": F.row_number().over(Window.partitionBy("monitor_id").orderBy("latency_ms", "ts")) - 1})
    p95 = F.max(F.when(F.col("_r") == F.least(F.call_function("div", F.col("_n") * 95, F.lit(100)), F.col("_n") - 1), F.col("latency_ms")))
    return ranked.groupBy("monitor_id").agg(F.min("latency_ms").alias("min_ms"), F.avg("latency_ms").alias("avg_ms"), F.max("latency_ms").alias("max_ms"), p95.alias("p95_ms"))


def outage_bands(beats: DataFrame) -> DataFrame:
    """Runs of failed beats, from half-way after the beat before to half-way before the beat after."""
    near = beats.withColumns({"_before": F.lag("ts").over(_order()), "_after": F.lead("ts").over(_order()), "_run": F.count_if("ok").over(_order().rowsBetween(Window.unboundedPreceding, 0))}).where("not ok")
    rows = near.groupBy("monitor_id", "_run").agg(F.min("ts").alias("_from"), F.max("ts").alias("_to"), F.min_by("_before", "ts").alias("_before"), F.max_by("_after", "ts").alias("_after"), F.count(F.lit(1)).alias("beats"))
    half = lambda a, b: F.call_function("div", a + b, F.lit(2))
    return rows.select("monitor_id", F.coalesce(half(F.col("_before"), F.col("_from")), F.col("_from")).alias("start"), F.coalesce(half(F.col("_to"), F.col("_after")), F.col("_to")).alias("end"), "beats")


def monitor_counts(latest: DataFrame, monitors: DataFrame) -> DataFrame:
    """One row over (monitor_id, state) and (monitor_id, enabled): up and down of the enabled, paused, total."""
    rows = monitors.join(latest, "monitor_id", "left")
    return rows.agg(F.count_if(F.col("enabled") & (F.col("state") == "up")).alias("up"), F.count_if(F.col("enabled") & (F.col("state") == "down")).alias("down"), F.count_if(~F.col("enabled")).alias("paused"), F.count(F.lit(1)).alias("total"))


def latest_states(beats: DataFrame, retries: int = 3) -> DataFrame:
    return states(beats, retries).groupBy("monitor_id").agg(F.max_by("state", "ts").alias("state"))
