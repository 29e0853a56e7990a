"""Hosts and processes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glimt.functions.fields import quoted
from glimt.functions.terms import host_pin
from glimt.operators import metrics

CPU, MEMORY, DISK, GPU = "system.cpu.utilization", "system.memory.utilization", "system.filesystem.utilization", "system.gpu.utilization"
#: Resource -> metric and the attribute it is broken down by.
RESOURCES = {
    "cpu": (CPU, "cpu"), "memory": (MEMORY, "host.name"), "disk": (DISK, "mountpoint"), "network": ("system.network.io", "direction"), "gpu": (GPU, "gpu"),
    "gpu_memory": ("system.gpu.memory.utilization", "gpu"), "gpu_temp": ("system.gpu.temperature", "gpu"), "gpu_power": ("system.gpu.power", "gpu"), "load": ("system.cpu.load_average.1m", "host.name"),
}
#: Of a process: measure -> (conventional name, factor), (own name, factor).
PROCESS = {"cpu_pct": (("process.cpu.utilization", 100.0), ("process.cpu.percent", 1.0)), "memory": (("process.memory.usage", 1.0), ("process.memory.rss", 1.0)), "fds": (("process.unix.file_descriptor.count", 1.0), ("process.open_fds", 1.0)), "threads": (("process.thread.count", 1.0), ("process.threads", 1.0))}
RESTARTS = "process.restarts"
ERROR_AT, WARNING_AT = 90.0, 80.0


def _host(points: DataFrame, where: Column) -> DataFrame:
    return points.where(where).where("value is not null").withColumn("host", quoted("host.name")).where("host is not null")


def host_list(points: DataFrame, where: Column) -> DataFrame:
    """Hosts that report CPU: average CPU and memory, last seen, and over each host's disks and GPUs the worst and mean average and their number."""
    group = F.when(F.col("metric_name") == DISK, F.col("attributes").getItem("mountpoint")).when(F.col("metric_name") == GPU, F.col("attributes").getItem("gpu"))
    rows = _host(points, where & F.col("metric_name").isin(CPU, MEMORY, DISK, GPU)).withColumn("grp", group).where(~F.col("metric_name").isin(DISK, GPU) | F.col("grp").isNotNull())
    per = rows.groupBy("host", "metric_name", "grp").agg(F.avg("value").alias("a"), F.max("timestamp_nanos").alias("t"))
    of = lambda m, c="a": F.when(F.col("metric_name") == m, F.col(c))
    out = per.groupBy("host").agg(
        F.max(of(CPU)).alias("cpu"), F.max(of(CPU, "t")).alias("last_seen"), F.max(of(MEMORY)).alias("memory"),
        *(x for name, m in (("disk", DISK), ("gpu", GPU)) for x in (F.max(of(m)).alias(f"{name}_max"), F.avg(of(m)).alias(f"{name}_mean"), F.count(of(m)).alias(f"{name}s"))))
    return out.where("cpu is not null").withColumn("has_gpu", F.col("gpus") > 0)


def host_detail(points: DataFrame, where: Column, host: str) -> DataFrame:
    """One row: average cores (whole) and memory limit, when CPU was last seen, latest OS, names of GPUs."""
    m, v = F.col("metric_name"), F.col("value")
    os_type, gpu = F.col("attributes").getItem("os.type"), F.col("attributes").getItem("gpu.name")
    return _host(points, where).where(F.col("host") == host).groupBy("host").agg(
        F.avg(F.when(m == "system.cpu.logical.count", v)).cast("long").alias("cores"), F.avg(F.when(m == "system.memory.limit", v)).alias("memory_limit"),
        F.max(F.when(m == CPU, F.col("timestamp_nanos"))).alias("last_seen"), F.max_by(os_type, F.when(os_type.isNotNull(), F.struct("timestamp_nanos", os_type.alias("o")))).alias("os_type"), F.array_sort(F.collect_set(gpu)).alias("gpu_names"))


def host_processes(points: DataFrame, where: Column, host: str, limit: int = 200) -> DataFrame:
    """Per service of a host: CPU in percent, memory, file descriptors and threads on average, most restarts; by the names the host uses."""
    names = {n: (measure, scheme, factor) for measure, pair in PROCESS.items() for scheme, (n, factor) in enumerate(pair)}
    rows = _host(points, where & F.col("metric_name").isin([*names, RESTARTS])).where((F.col("host") == host) & quoted("service.name").isNotNull())
    names[RESTARTS] = ("restarts", 2, 1.0)
    lookup = lambda k: F.element_at(F.create_map(*(F.lit(x) for n, t in names.items() for x in (n, t[k]))), F.col("metric_name"))
    per = rows.groupBy(quoted("service.name").alias("service"), lookup(0).alias("measure"), lookup(1).alias("scheme"), lookup(2).alias("factor")).agg(F.avg("value").alias("a"), F.max("value").alias("m"))
    semconv = F.max(F.when((F.col("scheme") == 0) & (F.col("measure") == "cpu_pct"), 1).otherwise(0)).over(Window.partitionBy(F.lit(0)))
    own = per.withColumn("_semconv", semconv).where((F.col("scheme") == 1 - F.col("_semconv")) | (F.col("measure") == "restarts"))
    out = own.groupBy("service").agg(*(F.max(F.when(F.col("measure") == k, F.col("a") * F.col("factor"))).alias(k) for k in PROCESS), F.max(F.when(F.col("measure") == "restarts", F.col("m"))).alias("restarts"))
    return out.orderBy(F.desc_nulls_last("cpu_pct"), "service").limit(limit)


def host_series(points: DataFrame, resource: str, host: str, start: int, end: int, n: int, agg: str = "avg") -> DataFrame:
    """A resource of a host over time, by its breakdown attribute where it has one."""
    name, label = RESOURCES[resource]
    return metrics.series(points, name, start, end, n, agg, [label] if label else [], [host_pin(host)])


def status(value: Column) -> Column:
    return F.when(value >= ERROR_AT, "error").when(value >= WARNING_AT, "warning").when(value.isNotNull(), "ok").otherwise("unknown")


def latest_rollup(found: DataFrame, label: str) -> DataFrame:
    """Of a host series by label: the worst, mean and number of the latest points, and the status of the worst."""
    last = found.where("v is not null").groupBy(quoted(label).alias("label")).agg(F.max_by("v", "t").alias("v"))
    return last.agg(F.max("v").alias("worst"), F.avg("v").alias("mean"), F.count(F.lit(1)).alias("groups")).withColumn("status", status(F.col("worst")))


def cpu_split(found: DataFrame, label: str = "cpu") -> DataFrame:
    """Series without a core, or of `total`, against those of single cores."""
    total = quoted(label).isNull() | (quoted(label) == "total")
    return found.withColumn("scope", F.when(total, "total").otherwise("core"))


def fleet_kpis(hosts: DataFrame) -> DataFrame:
    worst = F.greatest(F.coalesce("cpu", F.lit(0.0)), F.coalesce("memory", F.lit(0.0)), F.coalesce("disk_max", F.lit(0.0)))
    rows = hosts.withColumn("_s", status(worst))
    return rows.agg(F.count(F.lit(1)).alias("hosts"), F.count_if(F.col("_s") == "warning").alias("warning"), F.count_if(F.col("_s") == "error").alias("critical"), F.avg("cpu").alias("mean_cpu"), F.count_if("has_gpu").alias("gpu_hosts"))
