"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Each source's rows are permuted by a hash and cut into blocks of near-equal words. Its target says
how many blocks the mix takes (a second pass over the permutation where it takes more than all).
The blocks of all sources hang at the root of a binary tree over the output shards. At each node a
random order of its blocks sends the first half left and the rest right, so that the counts per
source follow the multivariate hypergeometric law, and quotas hold exactly. Every shard then holds
disjoint blocks and orders its rows by another hash. Only DataFrame and SQL functions are used.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glimt.llm.common import each_copy, fresh, join_checked, quoted, stable, table

WEIGHTS = (5.0, 2.0, 1.0)
#: Words of the mix, as a share of all words.
BUDGET = 1.5
#: No row is taken more often than this.
REPEATS = 2
SHARDS = 8
#: Rows of a source in one block, about.
BLOCK_ROWS = 500
#: Passes over the cut block of a source.
ROUNDS = 4


def size_of(text: Column) -> Column:
    """Number of `[^\\x20\\x09-\\x0D]+` in a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sources: DataFrame, weights: Sequence[float] = WEIGHTS, budget: float = BUDGET, repeats: float = REPEATS) -> DataFrame:
    """(source, source_size, rows, target) from (source, source_size, rows).

    Sources in code point order, null last, weigh ``weights`` in turn. A target stops at ``repeats`` times its source's size and
    the excess is shared anew by weight until none is above: that fixes one factor t with target = min(weight * t, cap), found
    by walking the sources in the order of cap over weight.
    """
    turn = F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")) - 1
    ranked = sources.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.pmod(turn, F.lit(len(weights))) + 1).cast("int")))
    ranked = ranked.withColumn("cap", F.col("source_size") * F.lit(float(repeats)))
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), "source")
    ranked = ranked.withColumn("rank", F.row_number().over(order))
    whole = Window.partitionBy(F.lit(0))
    ranked = ranked.withColumns({"full": F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)), "open": F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing)), "total": F.sum("source_size").over(whole) * F.lit(float(budget))})
    # the first source whose cap is above its share, and all behind it, stay open
    share = (F.col("total") - F.col("full")) / F.col("open")
    ranked = ranked.withColumn("factor", F.min(F.when(F.col("weight") * share <= F.col("cap"), F.struct("rank", share.alias("factor")))).over(whole)["factor"])
    target = F.coalesce(F.least("cap", F.col("weight") * F.col("factor")), F.col("cap"))
    return ranked.select("source", "source_size", "rows", target.alias("target"))


def identity(docs: DataFrame, first: str, second: str) -> list[Column]:
    """128 bits of a row's whole content; rows that agree in them are copies of each other."""
    plain = lambda c, kind: F.to_json(F.struct(quoted(c))) if "map<" in kind or "variant" in kind else quoted(c)
    values = [x for c, kind in docs.dtypes for x in (plain(c, kind), quoted(c).isNull())]
    return [F.xxhash64(*values).alias(first), F.xxhash64(F.lit("mix"), *values).alias(second)]


def draw(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[float] = WEIGHTS, budget: float = BUDGET, repeats: int = REPEATS, seed: int = 0) -> DataFrame:
    """(_row, _row2, _i, _id, source, size, source_size, target, _key, block, copies) for each row; rows that are alike differ in _i, from 0 on.

    All rows are taken floor(target / source size) times; the rest comes from the source's blocks in the order of the permutation.
    The block that the rest ends in is cut at a row, and the row that comes closest to closing the gap is added.
    """
    rows = docs.select(quoted(id_col).alias("_id"), quoted(source_col).cast("string").alias("source"), size_of(quoted(text_col)).alias("size"), *identity(docs, "_row", "_row2"))
    # words are counted once; these few bytes a row are read several times
    rows = stable(rows.groupBy("_row", "_row2").agg(F.first("_id").alias("_id"), F.first("source").alias("source"), F.first("size").alias("size"), F.count(F.lit(1)).alias("_n")))
    rows = each_copy(rows, "_n", "_i", ["_row", "_row2"]).drop("_n")
    rows = rows.withColumns({"_perm": F.xxhash64("_row", "_row2", "_i", F.lit(seed)), "_key": F.coalesce(F.concat(F.lit("="), "source"), F.lit(""))})
    sources = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("rows"))
    base = F.least(F.floor(F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)), F.lit(repeats)).cast("int")
    # blocks hold BLOCK_ROWS rows, and more where a source has very many, so that neither blocks nor rows of a block get out of hand
    height = F.greatest(F.lit(float(BLOCK_ROWS)), F.sqrt("rows") * 2)
    plan = targets(sources, weights, budget, repeats).withColumns({"_blocks": F.ceil(F.col("rows") / height).cast("long"), "_key": F.coalesce(F.concat(F.lit("="), "source"), F.lit("")), "_base": base})
    plan = plan.withColumn("_rest", F.greatest(F.col("target") - F.col("_base") * F.col("source_size"), F.lit(0.0)))
    rows = join_checked(rows, plan.drop("source", "rows"), "_key", F.col("_perm")).withColumn("block", F.pmod("_perm", F.col("_blocks")))
    blocks = rows.groupBy("_key", "block").agg(F.sum("size").alias("_size"), F.first("_rest").alias("_rest"))
    ahead = Window.partitionBy("_key").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("_ahead", F.coalesce(F.sum("_size").over(ahead), F.lit(0)))
    state = F.when(F.col("_ahead") + F.col("_size") <= F.col("_rest"), 2).when(F.col("_ahead") < F.col("_rest"), 1).otherwise(0)
    blocks = blocks.select("_key", "block", state.alias("_state"), (F.col("_rest") - F.col("_ahead")).alias("_gap"))
    # the one cut block of each source, row by row
    edge = rows.join(blocks.where("_state = 1").select("_key", "block", "_gap"), ["_key", "block"]).select("_key", "_row", "_row2", "_i", "_perm", F.col("size").alias("_all"), "_gap")
    whole = Window.partitionBy("_key")
    edge = edge.withColumns({"_take": F.lit(False), "_left": F.col("_gap")})
    for _ in range(ROUNDS):  # large rows first; those too large for what is left are passed over
        fits = ~F.col("_take") & (F.col("_all") <= F.col("_left"))
        upto = F.sum(F.when(fits, F.col("_all")).otherwise(0)).over(whole.orderBy(F.col("_all") * 16 <= F.col("_gap"), "_perm", "_row", "_row2", "_i").rowsBetween(Window.unboundedPreceding, 0))
        edge = edge.withColumn("_take", F.col("_take") | (fits & (upto <= F.col("_left"))))
        edge = edge.withColumn("_left", F.col("_gap") - F.coalesce(F.sum(F.when(F.col("_take"), F.col("_all"))).over(whole), F.lit(0)))
    edge = edge.withColumn("_off", F.abs(F.col("_all") - F.col("_left")))
    edge = edge.withColumn("_nearest", F.row_number().over(whole.orderBy("_take", "_off", "_perm", "_row", "_row2", "_i")) == 1)
    extra = edge.where(F.col("_take") | (F.col("_nearest") & ~F.col("_take") & (F.col("_off") < F.col("_left")))).select("_row", "_row2", "_i", F.lit(1).alias("_extra"))
    rows = rows.join(blocks.select("_key", "block", "_state"), ["_key", "block"]).join(extra, ["_row", "_row2", "_i"], "left")
    copies = F.col("_base") + F.when(F.col("_state") == 2, 1).otherwise(F.coalesce("_extra", F.lit(0)))
    return rows.select("_row", "_row2", "_i", "_id", "source", "size", "source_size", "target", "_key", "block", copies.alias("copies"))


def split(drawn: DataFrame, shards: int = SHARDS, seed: int = 0) -> DataFrame:
    """The rows of ``draw`` with ``shards``: the output shard of each of its copies, by the splitting tree."""
    blocks = drawn.groupBy("_key", "block").agg(F.max("copies").alias("_most")).where("_most > 0")
    blocks = blocks.select("_key", "block", F.explode(F.sequence(F.lit(1), F.col("_most"))).alias("_copy")).withColumn("_node", F.lit(1).cast("long"))
    for level in range(max(0, math.ceil(math.log2(shards)))):  # node k has children 2k and 2k + 1
        node = Window.partitionBy("_node")
        nth = F.row_number().over(node.orderBy(F.xxhash64("_key", "block", "_copy", F.lit(seed), F.lit(level)), "_key", "block", "_copy"))
        blocks = blocks.withColumn("_node", F.col("_node") * 2 + (nth * 2 > F.count(F.lit(1)).over(node)).cast("long"))
    leaves = blocks.groupBy("_key", "block").agg(F.array_sort(F.collect_list(F.struct("_copy", F.pmod("_node", F.lit(shards)).cast("int").alias("_shard")))).alias("_leaves"))
    placed = drawn.join(leaves, ["_key", "block"], "left")
    return placed.withColumn("shards", F.when(F.col("copies") > 0, F.transform(F.slice("_leaves", 1, F.greatest("copies", F.lit(1))), lambda x: x["_shard"])).otherwise(F.array().cast("array<int>"))).drop("_leaves")


def mix(docs: DataFrame, shards: int = SHARDS, seed: int = 0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options: object) -> DataFrame:
    """The mix itself: rows of ``docs``, all columns, once for each taken copy, with ``mix_shard`` and ``mix_order`` (random in the shard).

    Null and empty texts have size 0; of repeated rows each is dealt alone; no rows give no result; columns of ``docs`` that have the two
    new names are replaced. Texts are shuffled once.
    """
    placed = split(draw(docs, id_col, text_col, source_col, seed=seed, **options), shards, seed)
    a, b, mine, order = fresh(docs, "_row", "_row2", "_mix_shard", "_mix_order")
    placed = placed.where("copies > 0").select(F.col("_row").alias(a), F.col("_row2").alias(b), "_i", F.posexplode("shards").alias("_copy", mine))
    placed = placed.select(a, b, mine, F.xxhash64(a, b, "_i", "_copy", F.lit(seed), F.lit("order")).alias(order))
    # of rows that are alike one stands for all that are taken
    named = docs.select("*", *identity(docs, a, b)).dropDuplicates([a, b]).join(placed, [a, b])
    kept = [quoted(c) for c in docs.columns if c.lower() not in ("mix_shard", "mix_order")]
    return named.select(*kept, F.col(mine).alias("mix_shard"), F.col(order).alias("mix_order"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = split(draw(table(spark, sf_dir, "documents")))
    return placed.select(F.col("_id").alias("doc_id"), "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "source", "copies", "shards")
