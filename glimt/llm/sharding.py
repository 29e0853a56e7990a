"""Sharding: contiguous shards of near-equal bytes whose atomic groups (equal texts) are never split.

Groups are ordered by the hash of their text and gathered into at most ``UNITS`` atomic units of
the hash space. Their sizes, a bounded array however large the corpus, are cut by the minimax
contiguous partition: a binary search over the capacity, checked greedily. Only DataFrame and SQL
functions are used.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glimt.llm.common import each_copy, quoted, stable, table

#: Atomic units for each shard; equal texts share one. A shard is off the mean by one unit at most, save where a single unit is larger.
UNITS = 1_024
#: Rows of a unit that one task numbers, about; larger units are dealt over more tasks.
SLOT_ROWS = 1_000


def _greedy(sizes: Column, capacity: Column) -> Column:
    """How many shards first-come filling needs when none may hold more than ``capacity``."""
    state = lambda n, load: F.named_struct(F.lit("n"), n, F.lit("load"), load)
    fill = lambda a, x: F.when(a["load"] + x > capacity, state(a["n"] + 1, x)).otherwise(state(a["n"], a["load"] + x))
    return F.aggregate(sizes, state(F.lit(1).cast("long"), F.lit(0).cast("long")), fill, lambda a: a["n"])


def minimax_capacity(sizes: Column, shards: int) -> Column:
    """The smallest capacity with which greedy filling needs at most ``shards`` shards."""
    total, largest = F.aggregate(sizes, F.lit(0).cast("long"), lambda a, x: a + x), F.array_max(sizes)
    low = F.greatest(largest, F.ceil(total / shards).cast("long"))
    bounds = lambda a, b: F.named_struct(F.lit("low"), a, F.lit("high"), b)

    def halve(b: Column, _: Column) -> Column:
        middle = (b["low"] + F.floor((b["high"] - b["low"]) / 2)).cast("long")
        return F.when(b["low"] >= b["high"], b).when(_greedy(sizes, middle) <= shards, bounds(b["low"], middle)).otherwise(bounds(middle + 1, b["high"]))

    # filling up to the mean plus one unit always suffices
    return F.aggregate(F.sequence(F.lit(1), F.lit(62)), bounds(low, low + largest), halve, lambda b: b["low"])


def shard(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text", units: int | None = None) -> DataFrame:
    """Per row: id, size, text_crc32, law (`bytes`), shard, slot (gapless from 0 in each shard) and grown_shard (null).

    ``units``: UNITS a shard unless given. A null text has size 1 and the checksum of the empty text, and shares a unit with empty texts.
    Repeated rows lie side by side and take a slot each. No rows: no result. Other columns are left out; ``slot`` follows unit, part
    of the unit, id and checksum.
    """
    units = units or UNITS * shards
    text = F.coalesce(quoted(text_col), F.lit(""))
    unit = F.pmod(F.xxhash64(text), F.lit(units)).cast("int")
    rows = docs.select(quoted(id_col).alias("_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), unit.alias("_unit"))
    # texts are read once; rows that are alike are counted
    same = ["_unit", "_id", "size", "text_crc32"]
    rows = stable(rows.groupBy(*same).agg(F.count(F.lit(1)).alias("_n")))
    by_unit = rows.groupBy("_unit").agg(F.sum(F.col("size") * F.col("_n")).alias("_bytes"), F.count(F.lit(1)).alias("_rows"), F.sum("_n").alias("_all"))
    line = by_unit.agg(F.array_sort(F.collect_list(F.struct("_unit", "_bytes"))).alias("_line")).where(F.size("_line") > 0)
    # walk the line once more with the capacity found; the driver sees the units where a new shard begins, shards - 1 at most
    state = lambda load, cuts, most: F.named_struct(F.lit("load"), load, F.lit("cuts"), cuts, F.lit("most"), most)

    def place(a: Column, u: Column) -> Column:
        over = a["load"] + u["_bytes"] > a["most"]
        return F.when(over, state(u["_bytes"], F.array_append(a["cuts"], u["_unit"]), a["most"])).otherwise(state(a["load"] + u["_bytes"], a["cuts"], a["most"]))

    start = state(F.lit(0).cast("long"), F.array().cast("array<int>"), minimax_capacity(F.transform("_line", lambda u: u["_bytes"]), shards))
    found = line.select(F.aggregate("_line", start, place, lambda a: a["cuts"]).alias("cuts")).first()
    number = reduce(lambda n, cut: n + (F.col("_unit") >= cut).cast("int"), found["cuts"] if found else [], F.lit(0))
    # large units are dealt by hash; each part is numbered alone, and parts follow each other within their unit, units within their shard
    height = F.greatest(F.lit(float(SLOT_ROWS)), F.sqrt("_rows") * 2)
    ahead = lambda *keys: Window.partitionBy(*keys[:1]).orderBy(*keys[1:]).rowsBetween(Window.unboundedPreceding, -1)
    before = lambda many, *keys: F.coalesce(F.sum(many).over(ahead(*keys)), F.lit(0))
    placed = by_unit.select("_unit", F.ceil(F.col("_rows") / height).cast("int").alias("_parts"), number.alias("shard"), "_all")
    placed = placed.select("_unit", "_parts", "shard", before("_all", "shard", "_unit").alias("_first"))
    # (a table of one row a unit, and no more of those than asked for)
    rows = rows.join(F.broadcast(placed), "_unit").withColumn("_part", F.pmod(F.xxhash64("_id", "size", "text_crc32"), F.col("_parts")).cast("int"))
    parts = rows.groupBy("_unit", "_part").agg(F.sum("_n").alias("_m"))
    parts = parts.select("_unit", "_part", before("_m", "_unit", "_part").alias("_before"))
    within = Window.partitionBy("_unit", "_part").orderBy("_id", "text_crc32", "size").rowsBetween(Window.unboundedPreceding, -1)
    numbered = rows.withColumn("_nth", F.coalesce(F.sum("_n").over(within), F.lit(0))).join(parts, ["_unit", "_part"])
    each = each_copy(numbered, "_n", "_i", ["_unit", "_id", "size", "text_crc32"])
    slot = F.col("_first") + F.col("_before") + F.col("_nth") + F.col("_i")
    return each.select(F.col("_id").alias(id_col), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", slot.cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents"))
