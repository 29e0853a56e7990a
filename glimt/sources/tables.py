"""Signal tables on storage: bounded scans, SQL, the sorted sink, consolidation of small files, retention and statistics.

A table is a folder of Parquet partitioned by ``date``, so that a time bound skips files; within files
rows are sorted, so that Parquet's statistics skip row groups.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, DataFrameWriter, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from glimt.functions.fields import quoted, signal_time
from glimt.sources import manifest

FOLDERS = {"logs": "data", "spans": "data-spans", "metrics": "data-metrics"}
SORT = {"logs": ("service.name", "timestamp_nanos"), "spans": ("service.name", "start_time_nanos"), "metrics": ("metric_name", "service.name", "host.name", "timestamp_nanos")}
BLOOM = {"spans": "trace_id", "logs": "trace_id", "metrics": "metric_name"}
DAY_NANOS = 86_400_000_000_000
TARGET_ROWS, MOST_INPUTS, MOST_GROUPS = 150_000, 32, 10_000
#: Of every file written: zstd level and rows of a row group.
ZSTD_LEVEL, GROUP_ROWS = 1, 131_072


def with_date(rows: DataFrame, signal: str) -> DataFrame:
    return rows.withColumn("date", F.date_from_unix_date(F.call_function("div", F.col(signal_time(signal)), F.lit(DAY_NANOS)).cast("int")))


def scan(spark: SparkSession, root: str, signal: str, start: int, end: int, schema: StructType | None = None) -> DataFrame:
    """Rows of [start, end]; the dates of the bound prune partitions, the bound itself is pushed to Parquet."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    df = reader.parquet(f"{root}/{FOLDERS[signal]}")
    first, last = (F.date_from_unix_date(F.lit(x // DAY_NANOS)) for x in (start, end))
    return df.where(F.col("date").between(first, last) & F.col(signal_time(signal)).between(start, end))


def sql(spark: SparkSession, text: str, tables: Mapping[str, DataFrame]) -> DataFrame:
    """Any query over the given tables, by name."""
    for name, df in tables.items():
        df.createOrReplaceTempView(name)
    return spark.sql(text)


def writer(rows: DataFrame, mode: str = "append") -> DataFrameWriter:
    options = {"compression": "zstd", "parquet.compression.codec.zstd.level": ZSTD_LEVEL, "parquet.block.row.count.limit": GROUP_ROWS}
    return rows.write.mode(mode).options(**options)


def laid_out(rows: DataFrame, signal: str, partitions: int | None = None) -> DataFrame:
    """The rows with their date, dealt by ranges of the signal's sort key and sorted."""
    keys = [quoted(k) for k in SORT[signal] if k in rows.columns]
    dated = with_date(rows, signal)
    dealt = dated.repartitionByRange(partitions, "date", *keys) if partitions else dated.repartitionByRange("date", *keys)
    return dealt.sortWithinPartitions("date", *keys)


def sink(rows: DataFrame, root: str, signal: str, mode: str = "append", partitions: int | None = None, keys: bool = True) -> str:
    """Write sorted, compressed files, a folder for each date; returns the table's folder. ``keys``: keep the manifest of attribute keys."""
    out = f"{root}/{FOLDERS[signal]}"
    written = writer(laid_out(rows, signal, partitions), mode).partitionBy("date")
    written.option(f"parquet.bloom.filter.enabled#{BLOOM[signal]}", "true").parquet(out)
    if keys and "attributes" in rows.columns:
        manifest.refresh(rows.sparkSession, out, signal)
    return out


def scanned_files(spark: SparkSession, folder: str, signal: str) -> DataFrame:
    """As ``files``, by reading the time column: for stores that only Spark's readers can open."""
    df, t = spark.read.parquet(folder), F.col(signal_time(signal))
    return df.groupBy(manifest.file_path().alias("path"), F.col("_metadata.file_size").alias("bytes"), "date").agg(F.count(F.lit(1)).alias("rows"), F.min(t).alias("min_ts"), F.max(t).alias("max_ts"))


def files(spark: SparkSession, folder: str, signal: str) -> DataFrame:
    """Per file: path, bytes, date, rows, first and last time; from footers, so that what is read does not grow with the rows."""
    return (manifest.footers if manifest.has_footers(spark, folder) else scanned_files)(spark, folder, signal)


def statistics(spark: SparkSession, folder: str, signal: str) -> DataFrame:
    """One row: file_count, total_rows, bytes, min_ts, max_ts."""
    return files(spark, folder, signal).agg(F.count(F.lit(1)).alias("file_count"), F.sum("rows").alias("total_rows"), F.sum("bytes").alias("bytes"), F.min("min_ts").alias("min_ts"), F.max("max_ts").alias("max_ts"))


def consolidation_plan(listing: DataFrame, target_rows: int = TARGET_ROWS, most_inputs: int = MOST_INPUTS) -> DataFrame:
    """Which small files of a date go together: neighbours in time, up to the row target and so many inputs; (date, grp, path, rows)."""
    small = listing.where(F.col("rows") < target_rows)
    # a group closes when it is full, so a running state over the ordered files of a date decides
    line = F.array_sort(F.collect_list(F.struct("min_ts", "path", "rows")))
    state = lambda grp, load, n, out: F.named_struct(F.lit("grp"), grp, F.lit("load"), load, F.lit("n"), n, F.lit("out"), out)

    def step(a, x):
        full = (a["load"] + x["rows"] > target_rows) | (a["n"] >= most_inputs)
        grp = F.when(full, a["grp"] + 1).otherwise(a["grp"])
        return state(grp, F.when(full, x["rows"]).otherwise(a["load"] + x["rows"]), F.when(full, 1).otherwise(a["n"] + 1), F.array_append(a["out"], grp))

    start = state(F.lit(0), F.lit(0).cast("long"), F.lit(0), F.array().cast("array<int>"))
    grouped = small.groupBy("date").agg(line.alias("line")).withColumn("grps", F.aggregate("line", start, step, lambda a: a["out"]))
    rows = grouped.select("date", F.explode(F.arrays_zip("line", "grps")).alias("x")).select("date", F.col("x.grps").alias("grp"), F.col("x.line.path").alias("path"), F.col("x.line.rows").alias("rows"))
    return rows.withColumn("inputs", F.count(F.lit(1)).over(Window.partitionBy("date", "grp"))).where("inputs > 1")


def consolidate(spark: SparkSession, folder: str, signal: str, staging: str, target_rows: int = TARGET_ROWS, most_inputs: int = MOST_INPUTS, most_groups: int = MOST_GROUPS) -> DataFrame:
    """Merge each planned group of small files into one sorted file; returns (date, files_before, files_after, rows) of the dates touched.

    Only the planned files are read and written, once, and at most ``most_groups`` groups in a run (the oldest dates first), as the driver moves
    them one by one; the next run does the rest. New files are made in ``staging``; then, group by group, the new file is moved in
    under a hidden name, the inputs are deleted, and it is shown, so a reader that lists files in between misses that group for a moment.
    After a crash a file with a hidden name holds a whole group.
    """
    listing = files(spark, folder, signal)
    whole = consolidation_plan(listing, target_rows, most_inputs)
    some = whole.select("date", "grp").distinct().orderBy("date", "grp").limit(most_groups)
    writer(whole.join(F.broadcast(some), ["date", "grp"], "left_semi"), "overwrite").parquet(f"{staging}/plan")  # at most ``most_groups`` rows
    plan = spark.read.parquet(f"{staging}/plan")
    merged = plan.groupBy("date").agg(F.count(F.lit(1)).alias("_inputs"), F.count_distinct("grp").alias("_groups"))
    before = listing.groupBy("date").agg(F.count(F.lit(1)).alias("files_before"), F.sum("rows").alias("rows"))
    report = before.join(merged, "date").select("date", "files_before", (F.col("files_before") - F.col("_inputs") + F.col("_groups")).alias("files_after"), "rows")
    done = report.collect()  # a row a date
    if not done:
        return spark.createDataFrame([], report.schema)
    df = spark.read.parquet(folder)
    keys = [quoted(k) for k in SORT[signal] if k in df.columns]
    rows = df.withColumn("_path", manifest.file_path()).join(plan.select(F.col("path").alias("_path"), F.col("grp").alias("_grp")), "_path").drop("_path")
    dealt = rows.repartition("date", "_grp").sortWithinPartitions("date", "_grp", *keys)
    writer(dealt, "overwrite").partitionBy("date", "_grp").option(f"parquet.bloom.filter.enabled#{BLOOM[signal]}", "true").parquet(f"{staging}/files")
    path = spark._jvm.org.apache.hadoop.fs.Path
    system = path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    inputs: dict[tuple[str, int], list[str]] = {}
    for r in plan.select(F.col("date").cast("string").alias("date"), "grp", "path").collect():  # names of the files that go
        inputs.setdefault((r["date"], r["grp"]), []).append(r["path"])
    became: dict[str, list[str]] = {}
    for (date, grp), old in inputs.items():
        made = [f.getPath() for f in system.listStatus(path(f"{staging}/files/date={date}/_grp={grp}")) if f.getPath().getName().endswith(".parquet")]
        # in the table first under a name that readers pass over, and only then are the inputs deleted
        hidden = [path(f"{folder}/date={date}/_{grp}-{new.getName()}") for new in made]
        if not made or not all(system.rename(new, to) for new, to in zip(made, hidden, strict=True)):
            raise OSError(f"could not move the merged files of {date}, group {grp}, into {folder}")
        for name in old:
            system.delete(path(name), False)
        for at in hidden:
            shown = path(f"{folder}/date={date}/merged{at.getName()}")
            if not system.rename(at, shown):
                raise OSError(f"could not show {at}")
            became[_file_path(system, shown)] = old
    if manifest.known(spark, folder):
        manifest.united(spark, folder, became)
    return spark.createDataFrame(done, report.schema)


def _file_path(system, path) -> str:
    """As ``manifest.file_path`` names it."""
    scheme, _, rest = system.makeQualified(path).toUri().toString().partition(":")
    return f"{scheme}:///{rest.lstrip('/')}" if scheme == "file" else f"{scheme}:{rest}"


def retention_cutoff(now_nanos: int, days: int) -> int:
    return now_nanos - days * DAY_NANOS


def retention_plan(listing: DataFrame, cutoff: int | None) -> DataFrame:
    """Files wholly older than the cutoff (None: all); those that straddle it stay."""
    return listing if cutoff is None else listing.where(F.col("max_ts") < cutoff)


def retention_report(listing: DataFrame, cutoff: int | None) -> DataFrame:
    return retention_plan(listing, cutoff).agg(F.count(F.lit(1)).alias("files_removed"), F.coalesce(F.sum("rows"), F.lit(0)).alias("rows_removed"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes_removed"))


def purge(spark: SparkSession, folder: str, signal: str, cutoff: int | None) -> DataFrame:
    """Delete the planned files through the table's own file system; returns the report."""
    listing = files(spark, folder, signal)
    report = retention_report(listing, cutoff).collect()  # one row
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for row in retention_plan(listing, cutoff).select("path").toLocalIterator():
        path = jvm.org.apache.hadoop.fs.Path(row["path"])
        path.getFileSystem(conf).delete(path, False)
    if manifest.known(spark, folder):
        manifest.refresh(spark, folder, signal)
    return spark.createDataFrame(report, "files_removed long, rows_removed long, bytes_removed long")
