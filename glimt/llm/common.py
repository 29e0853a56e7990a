"""What several operators share: the tables, stable storage, bounded samples and row identity."""

from __future__ import annotations

import tempfile
import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table. Python workers on this machine find the package where the driver found it; clusters ship it by --py-files."""
    spark.sparkContext.environment.setdefault("PYTHONPATH", str(Path(__file__).resolve().parents[2]))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """What ``spark.checkpoint.dir`` names. Only a session on one machine may go without; it gets a temporary folder."""
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir")
    if named is None and not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return (named or tempfile.mkdtemp(prefix="spark-checkpoint-")).rstrip("/")


def stable(df: DataFrame) -> DataFrame:
    """Cut the lineage: rows are kept in the shared folder of ``spark.checkpoint.dir``, so lost executors lose nothing."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """The rows written as Parquet to the shared folder and read again; unlike ``stable``, columns that are not asked for are not read."""
    folder = f"{shared_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.option("compression", "snappy").parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def forget(*frames: DataFrame) -> None:
    """Delete what ``written`` has kept for these, of which nothing is read any more."""
    for df in frames:
        spark = df.sparkSession
        for folder in {name.rpartition("/")[0] for name in df.inputFiles()}:  # one folder each, whatever the number of files
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each behind as many underscores as it takes to be no column of ``df``."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def row_keys(*columns: str) -> list[Column]:
    """128 bits of the columns' values in two longs; rows that agree in them can stand for each other."""
    values = [F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("")) for c in columns]
    return [F.xxhash64(*values), F.xxhash64(F.lit("row"), *values)]


def keep_rows(docs: DataFrame, keys: DataFrame, *columns: str) -> DataFrame:
    """The rows of ``docs`` whose ``row_keys`` of the columns are among those of ``keys`` (_k1, _k2); one of rows that agree in them."""
    a, b = fresh(docs, "_k1", "_k2")
    k1, k2 = row_keys(*columns)
    named = keys.select(F.col("_k1").alias(a), F.col("_k2").alias(b)).distinct()
    return docs.withColumns({a: k1, b: k2}).join(named, [a, b], "left_semi").dropDuplicates([a, b]).select(*map(quoted, docs.columns))


def quoted(name: str) -> Column:
    """A column by its whole name, dots included."""
    return F.col("`" + name.replace("`", "``") + "`")


def each_copy(rows: DataFrame, count: str, name: str, keys: list[str], at_once: int = 1_000) -> DataFrame:
    """``count`` rows for each row, numbered from 0 in ``name``. Those with very many are dealt over the tasks before they are made."""
    few, many = rows.where(F.col(count) <= at_once), rows.where(F.col(count) > at_once)
    first = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col(count) - 1) / at_once).cast("long")))
    many = many.withColumn("_deal", first).repartition(*keys, "_deal").withColumn("_from", F.col("_deal") * at_once)
    last = F.least(F.col("_from") + at_once, F.col(count)) - 1
    return few.withColumn(name, F.explode(F.sequence(F.lit(0).cast("long"), F.col(count) - 1))).unionByName(many.withColumn(name, F.explode(F.sequence("_from", last))).drop("_deal", "_from"))


def bounded(df: DataFrame, key: Column, bound: int, by: str | None = None) -> DataFrame:
    """About ``bound`` rows (of each value of ``by``) with the lowest hashes of ``key``: the same rows in every run.

    The rate follows from a count, so no group is ever gathered or sorted; the sample only serves to fit a model.
    """
    groups = df.groupBy(F.col(by).alias("_group")) if by else df.groupBy(F.lit(1).alias("_group"))
    rates = {r["_group"]: min(1.0, bound / r["n"]) for r in groups.agg(F.count(F.lit(1)).alias("n")).collect()}
    draw = F.pmod(F.xxhash64(key, F.lit("sample")), F.lit(1_000_000)) / F.lit(1_000_000.0)
    if not by:
        return df.where(draw < F.lit(rates.get(1, 1.0)))
    keep = F.lit(False)
    for value, rate in rates.items():
        keep = keep | (F.col(by).eqNullSafe(F.lit(value)) & (draw < F.lit(rate)))
    return df.where(keep)


def join_checked(left: DataFrame, small: DataFrame, on: str, draw: Column, limit: int = 100_000, salts: int = 64, how: str = "inner") -> DataFrame:
    """Join with a table that is usually small. It is broadcast only if it has ``limit`` rows or fewer; beyond that its rows are
    repeated for each of ``salts`` parts of ``left`` (dealt by the hash ``draw``), so that no hot key's rows meet in one task."""
    if small.limit(limit + 1).count() <= limit:
        return left.join(F.broadcast(small), on, how)
    salted = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.withColumn("_salt", F.pmod(draw, F.lit(salts)).cast("int")).join(salted, [on, "_salt"], how).drop("_salt")
