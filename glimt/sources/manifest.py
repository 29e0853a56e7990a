"""What is known of a table's files without reading their rows: footers, and the attribute keys that each holds.

The manifest is a small table inside the table's folder, under a name that readers pass over: a row for each file (and metric) with its
time range and the keys of its attribute maps. The sink scans only what it has just written; consolidation unites the keys of its inputs, and
purging drops rows. Each change writes a new version as a whole, and readers take the last complete one.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Mapping, Sequence

import pyarrow as pa
import pyarrow.compute
import pyarrow.fs
import pyarrow.parquet
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glimt.functions.fields import PROMOTED, signal_time

FOLDER = "_keys"
SCHEMA = "path string, min_ts long, max_ts long, metric_name string, keys array<string>"


# ---- footers ---------------------------------------------------------------------------------------------------


def _qualified(spark: SparkSession, folder: str) -> str:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()


def has_footers(spark: SparkSession, folder: str) -> bool:
    """Whether tasks can open the folder's files by themselves; else only Spark's readers can."""
    try:
        pa.fs.FileSystem.from_uri(_qualified(spark, folder))
    except (pa.ArrowException, OSError, ImportError):
        return False
    return True


def footer(path: str, column: str) -> tuple[int, int | None, int | None]:
    """(rows, least, largest) of a file's integer column from its footer; the column itself is read only where statistics are missing."""
    system, name = pa.fs.FileSystem.from_uri(path)
    with system.open_input_file(name) as source:
        file = pa.parquet.ParquetFile(source)
        at = next(i for i in range(len(file.schema)) if file.schema.column(i).path == column)
        ends: list[int] = []
        for k in range(file.metadata.num_row_groups):
            group = file.metadata.row_group(k)
            known = group.column(at).statistics
            if known is not None and known.has_min_max:
                ends += [known.min, known.max]
            elif group.num_rows and not (known is not None and known.has_null_count and known.null_count == group.num_rows):
                found = pa.compute.min_max(file.read_row_group(k, columns=[column]).column(0)).as_py()
                ends += [x for x in found.values() if x is not None]
        return file.metadata.num_rows, min(ends, default=None), max(ends, default=None)


def file_path() -> Column:
    """The file of a row, local ones always with three slashes."""
    return F.regexp_replace(F.col("_metadata.file_path"), "^file:/+", "file:///")


def footers(spark: SparkSession, folder: str, signal: str) -> DataFrame:
    """Per file: path, bytes, date, rows, first and last time. Paths are dealt over the tasks, and no page of data is read."""
    listed = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(folder)
    date = F.col("date") if "date" in listed.columns else F.lit(None)
    # only what the listing knows; the files' content is not among the columns
    rows = listed.select(file_path().alias("path"), F.col("_metadata.file_size").alias("bytes"), date.cast("date").alias("date"))
    column = signal_time(signal)

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [footer(p, column) for p in batch.column("path").to_pylist()]
            more = [pa.array([x[k] for x in found], pa.int64()) for k in range(3)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=["path", "bytes", "date", "rows", "min_ts", "max_ts"])

    dealt = rows.repartition(spark.sparkContext.defaultParallelism, "path")
    return dealt.mapInArrow(read, "path string, bytes long, date date, rows long, min_ts long, max_ts long")


# ---- keys ------------------------------------------------------------------------------------------------------


def _versions(spark: SparkSession, folder: str) -> list[int]:
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{FOLDER}")
    system = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(path):
        return []
    names = [f.getPath().getName() for f in system.listStatus(path)]
    whole = [n for n in names if system.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{FOLDER}/{n}/_SUCCESS"))]
    return sorted(int(n.removeprefix("v")) for n in whole)


def known(spark: SparkSession, folder: str) -> bool:
    """Whether the table has a manifest."""
    return bool(_versions(spark, folder))


def keys(spark: SparkSession, folder: str) -> DataFrame:
    """The last complete version of the manifest."""
    versions = _versions(spark, folder)
    return spark.read.schema(SCHEMA).parquet(f"{folder}/{FOLDER}/v{versions[-1]}") if versions else spark.createDataFrame([], SCHEMA)


def _put(spark: SparkSession, folder: str, rows: DataFrame) -> None:
    versions = _versions(spark, folder)
    number = versions[-1] + 1 if versions else 0
    rows.coalesce(1).write.mode("overwrite").parquet(f"{folder}/{FOLDER}/v{number}")
    path = spark._jvm.org.apache.hadoop.fs.Path
    system = path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    for old in versions[:-1]:  # the last but one may still be read
        system.delete(path(f"{folder}/{FOLDER}/v{old}"), True)


def scanned_keys(rows: DataFrame, signal: str) -> DataFrame:
    """Of rows read from files: the manifest's rows, from the time and map columns alone."""
    time = F.col(signal_time(signal))
    name = F.col("metric_name") if signal == "metrics" else F.lit(None).cast("string")
    rows = rows.select(file_path().alias("path"), time.alias("t"), name.alias("metric_name"), F.explode_outer(F.map_keys("attributes")).alias("k"))
    each = rows.groupBy("path", "metric_name", "k").agg(F.min("t").alias("min_ts"), F.max("t").alias("max_ts"))
    found = each.groupBy("path", "metric_name").agg(F.min("min_ts").alias("min_ts"), F.max("max_ts").alias("max_ts"), F.array_sort(F.collect_list("k")).alias("keys"))
    return found.select("path", "min_ts", "max_ts", "metric_name", "keys")


def refresh(spark: SparkSession, folder: str, signal: str) -> None:
    """Scan the files that the manifest does not know, and forget those that are gone."""
    there = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(folder).select(file_path().alias("path"))
    before = keys(spark, folder)
    new = [r["path"] for r in there.join(before.select("path").distinct(), "path", "left_anti").collect()]  # names of the files just written
    rows = before.join(there, "path", "left_semi")
    if new:
        rows = rows.unionByName(scanned_keys(spark.read.option("basePath", folder).parquet(*new), signal))
    _put(spark, folder, rows)


def united(spark: SparkSession, folder: str, became: Mapping[str, Sequence[str]]) -> None:
    """Each file of ``became`` (new path -> paths of its inputs) has the keys of its inputs, which are gone; no data is read."""
    before = keys(spark, folder)
    moved = spark.createDataFrame([(old, new) for new, inputs in became.items() for old in inputs], "path string, _new string")
    inputs = before.join(moved, "path")
    merged = inputs.groupBy(F.col("_new").alias("path"), "metric_name").agg(F.min("min_ts").alias("min_ts"), F.max("max_ts").alias("max_ts"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("keys")))).alias("keys"))
    rest = before.join(moved, "path", "left_anti")
    _put(spark, folder, rest.unionByName(merged.select(*rest.columns)))


def field_catalog(spark: SparkSession, folder: str, start: int, end: int, columns: Sequence[str], promoted: Sequence[str] = PROMOTED) -> DataFrame:
    """Every field name with its kind: the table's columns, and the attribute keys of the files that overlap [start, end]."""
    names = [(c, "promoted" if c in promoted else "fixed") for c in columns if c not in ("attributes", "date")]
    fixed = spark.createDataFrame(names, "name string, kind string")
    found = keys(spark, folder).where((F.col("min_ts") <= end) & (F.col("max_ts") >= start)).select(F.explode("keys").alias("name")).distinct()
    return fixed.unionByName(found.where(~F.col("name").isin(list(promoted))).withColumn("kind", F.lit("attribute")))


def label_keys(spark: SparkSession, folder: str, name: str, start: int, end: int, promoted: Sequence[str] = PROMOTED) -> DataFrame:
    """Label keys of a metric: promoted ones, and the attribute keys of its points in files where those overlap [start, end]."""
    own = keys(spark, folder).where((F.col("metric_name") == name) & (F.col("min_ts") <= end) & (F.col("max_ts") >= start))
    found = own.select(F.explode("keys").alias("key")).unionByName(spark.createDataFrame([(p,) for p in promoted], "key string"))
    return found.distinct()
