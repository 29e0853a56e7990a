"""Hard-negative mining by threshold joins over an inverted index.

The index of a block keeps its dimensions in falling order of weight. Of each row it leaves out the last dimensions whose
norm, times the norm of the longest anchor, stays below the threshold: alone they lift no pair to it. Partial scores are added
up over the posting lists, and a pair is dropped where its partial score and the product of both remaining norms stay below the
threshold; what is left is scored exactly in integers. Thresholds start high and are lowered, for each anchor by itself, until
its windows are full or their lower edge is reached. Anchors meet all rows in blocks (see ``grid``).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glimt.llm.common import quoted, table, written
from glimt.llm.grid import matrix, meet, vectors

POSITIVES, NEGATIVES = 5, 5
#: Vectors as long as this take no part: all scores and their multiples stay far inside 64 bits.
LONGEST = float(1 << 21)
#: A lowered threshold is this share of the one before; below LAST of the largest possible score it falls to nothing.
LOWER, LAST = 0.8, 0.05
#: Dimensions whose posting lists are added up at once, and cells of partial scores held at once.
GROUP, CELLS = 8, 1 << 22


def whole_numbers(vectors: np.ndarray) -> np.ndarray:
    """floor(256 x) of each component, as doubles that hold whole numbers."""
    return np.floor(256 * vectors)


class SuffixNormIndex:
    """Posting lists over rows of whole numbers; those of a dimension are the first so many rows, as rows stand by how many they index."""

    def __init__(self, rows: np.ndarray) -> None:
        self.rows, self.dim = rows, rows.shape[1]
        self.by_weight = np.argsort(-(rows * rows).sum(axis=0), kind="stable")
        self.values = rows[:, self.by_weight]
        self.rest = self.remaining(self.values)  # column j: norm of the dimensions from j on

    @staticmethod
    def remaining(values: np.ndarray) -> np.ndarray:
        square = np.cumsum((values * values)[:, ::-1], axis=1)[:, ::-1]
        return np.sqrt(np.column_stack([square, np.zeros(len(values))]))

    @property
    def longest(self) -> float:
        return float(self.rest[:, 0].max(initial=0))

    def above(self, anchors: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(anchor, row, score) of all pairs whose inner product is ``least`` of the anchor or more; exact."""
        parts, step = [], max(1, CELLS // max(1, len(self.rows)))
        order = np.argsort(-least, kind="stable")  # anchors of like thresholds share an index
        for i in range(0, len(order), step):
            own = order[i : i + step]
            a, r, s = self._some(anchors[own], least[own])
            parts.append((own[a], r, s))
        return tuple(np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, np.int64),) * 3

    def _some(self, anchors: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        values = anchors[:, self.by_weight]
        rest = self.remaining(values)
        bound = rest[:, 0].max(initial=0)
        # the dimensions that each row indexes: up to where its remaining norm can no longer reach the lowest threshold
        kept = (self.rest[:, : self.dim] * bound >= least.min()).sum(axis=1)
        kept = np.minimum(-(-kept // GROUP) * GROUP, self.dim)
        order = np.argsort(-kept, kind="stable")
        kept, listed = kept[order], self.values[order]
        partial = np.zeros((len(anchors), len(order)))
        for j in range(0, self.dim, GROUP):
            count = int(np.searchsorted(-kept, -j, "left"))  # rows that index these dimensions
            if count:
                partial[:, :count] += values[:, j : j + GROUP] @ listed[:count, j : j + GROUP].T
        partial += rest[:, kept] * self.rest[order, kept] * (1 + 1e-9)  # the most that the dimensions left out can add
        a, r = np.nonzero(partial * (1 + np.sign(partial) * 1e-9) + 1 >= least[:, None])
        r = order[r]
        score = np.zeros(len(a), np.int64)
        left, right = anchors.astype(np.int64), self.rows.astype(np.int64)
        for k in range(0, len(a), 1 << 16):
            score[k : k + (1 << 16)] = (left[a[k : k + (1 << 16)]] * right[r[k : k + (1 << 16)]]).sum(axis=1)
        near = score >= least[a]
        return a[near], r[near], score[near]


def best(group: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the first ``k`` of each group, highest score first, ties by smaller id."""
    order = np.lexsort((ids, -score, group))
    own = group[order]
    return order[np.arange(len(own)) - np.searchsorted(own, own) < k]


def top_positives(index: SuffixNormIndex, ids: np.ndarray, anchors: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, row, score) of the first ``k`` rows for each anchor; ``own`` is the anchor's own row or -1."""
    most = np.sqrt((anchors * anchors).sum(axis=1)) * index.longest
    least, open_, parts = most * LOWER, np.arange(len(anchors)), []
    while len(open_):
        a, r, s = index.above(anchors[open_], least[open_])
        a = open_[a]
        other = r != own[a]
        a, r, s = a[other], r[other], s[other]
        full = (np.bincount(a, minlength=len(anchors))[open_] >= k) | np.isneginf(least[open_])
        done = open_[full]
        at = np.flatnonzero(np.isin(a, done))
        at = at[best(a[at], s[at], ids[r[at]], k)]
        parts.append((a[at], r[at], s[at]))
        open_ = open_[~full]
        lower = least[open_] * LOWER
        least[open_] = np.where(lower < LAST * most[open_], -np.inf, lower)
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, np.int64),) * 3


def window_negatives(index: SuffixNormIndex, ids: np.ndarray, allowed: np.ndarray, anchors: np.ndarray, positives: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """(anchor, which positive, row, score): the first ``k`` rows of each window [0.8 p, p] where ``allowed[anchor, row]`` (labels differ).

    ``positives``: scores by anchor; those below zero have no window, and -1 stands for none.
    """
    edge = -(-4 * positives // 5)  # the lowest whole score of each window
    wanted = positives >= 0
    lowest = np.where(wanted, edge, np.iinfo(np.int64).max).min(axis=1, initial=np.iinfo(np.int64).max)
    highest = np.where(wanted, positives, -1).max(axis=1, initial=-1)
    open_, parts = np.flatnonzero(wanted.any(axis=1)), []
    least = np.maximum(lowest, np.floor(highest * LOWER**0.25)).astype(np.float64)
    while len(open_):
        a, r, s = index.above(anchors[open_], least[open_])
        a = open_[a]
        differ = allowed[a, r]
        a, r, s = a[differ], r[differ], s[differ]
        full = np.ones(len(open_), bool)
        found = []
        for j in range(positives.shape[1]):
            p = positives[a, j]
            at = np.flatnonzero((p >= 0) & (s <= p) & (s >= edge[a, j]))
            enough = np.bincount(a[at], minlength=len(anchors))[open_] >= k
            full &= ~wanted[open_, j] | enough | (least[open_] <= edge[open_, j])
            found.append(at[best(a[at], s[at], ids[r[at]], k)])
        done = np.zeros(len(anchors), bool)
        done[open_[full]] = True
        for j, at in enumerate(found):
            at = at[done[a[at]]]
            parts.append((a[at], np.full(len(at), j), r[at], s[at]))
        open_ = open_[~full]
        least[open_] = np.maximum(lowest[open_], np.floor(least[open_] * LOWER))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, np.int64),) * 4


def _keys(rows: pa.Table) -> np.ndarray:
    return np.column_stack([rows["k1"].to_numpy(), rows["k2"].to_numpy()])


def _positives(k: int):
    def work(block: pa.Table, chunk: pa.Table) -> pa.Table:
        a = r = s = ids = np.zeros(0, np.int64)
        key = np.zeros((0, 2), np.int64)
        if len(block) and len(chunk):
            dim, ids, key = block["dim"][0].as_py(), block["id"].to_numpy(), _keys(chunk)
            at = {x: i for i, x in enumerate(map(tuple, _keys(block).tolist()))}
            own = np.array([at.get(x, -1) for x in map(tuple, key.tolist())])
            a, r, s = top_positives(SuffixNormIndex(whole_numbers(matrix(block["vec"], dim))), ids, whole_numbers(matrix(chunk["vec"], dim)), own, k)
        return pa.table({"k1": key[a, 0], "k2": key[a, 1], "positive_id": ids[r], "positive_score": s})

    return work


def _negatives(k: int, most: int):
    def work(block: pa.Table, chunk: pa.Table) -> pa.Table:
        a = j = r = s = ids = np.zeros(0, np.int64)
        key = np.zeros((0, 2), np.int64)
        if len(block) and len(chunk):
            dim, ids, key = block["dim"][0].as_py(), block["id"].to_numpy(), _keys(chunk)
            scores = np.array([x + [-1] * (most - len(x)) for x in chunk["scores"].to_pylist()], np.int64)
            index, other, parts = SuffixNormIndex(whole_numbers(matrix(block["vec"], dim))), block["label"].to_numpy(), []
            own, anchors, step = chunk["label"].to_numpy(), whole_numbers(matrix(chunk["vec"], dim)), max(1, (1 << 24) // len(block))
            for i in range(0, len(chunk), step):
                part = slice(i, i + step)
                x = window_negatives(index, ids, own[part, None] != other[None, :], anchors[part], scores[part], k)
                parts.append((x[0] + i, *x[1:]))
            a, j, r, s = (np.concatenate(x) for x in zip(*parts, strict=True))
        return pa.table({"k1": key[a, 0], "k2": key[a, 1], "at": j, "negative_id": ids[r], "negative_score": s})

    return work


def hard_negatives(df: DataFrame, anchors: DataFrame, positives: int = POSITIVES, negatives: int = NEGATIVES, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for rows of ``anchors``, which has the columns of ``df``.

    Scores are inner products of floor(256 x). An anchor's positives are the first rows of its label, the negatives of each positive the
    first rows of other labels that score from 0.8 of the positive up to it; higher scores first, ties by smaller id. Rows with a null
    id, label, vector or component, a non-finite one, or a norm of LONGEST or more take no part; empty vectors score 0; vectors of other
    lengths than the anchor's are no partners. Rows that agree in id, label and vector count once. Other columns are left out.
    """
    def proper(part: DataFrame) -> DataFrame:
        label = quoted(label_col).cast("long").alias("label")
        rows = vectors(part, id_col, vector_col, label).where(F.col("label").isNotNull() & (F.col("norm") < LONGEST))
        rows = rows.withColumns({"k1": F.xxhash64("id", "label", "v1", "v2"), "k2": F.xxhash64(F.lit("row"), "id", "label", "v1", "v2")})
        return rows.select("id", "label", "vec", "dim", "v1", "v2", "k1", "k2").dropDuplicates(["k1", "k2"])

    # of equal vectors of a label only so many of the smallest ids can be among an anchor's rows
    first = Window.partitionBy("label", "v1", "v2").orderBy("id")
    rows = written(proper(df).withColumn("_nth", F.row_number().over(first)).where(F.col("_nth") <= max(positives + 1, negatives)).drop("_nth"))
    asked = written(proper(anchors))
    near = meet(rows.select("id", "label", "vec", "dim", "v1", "k1", "k2"), asked, ["dim", "label"], _positives(positives), "k1 long, k2 long, positive_id long, positive_score long")
    best_first = Window.partitionBy("k1", "k2").orderBy(F.desc("positive_score"), "positive_id")
    near = near.withColumn("at", F.row_number().over(best_first) - 1).where(F.col("at") < positives)
    held = F.array_sort(F.collect_list(F.struct("at", "positive_id", "positive_score")))
    chosen = written(asked.join(near.groupBy("k1", "k2").agg(held.alias("_held")), ["k1", "k2"]).withColumn("scores", F.col("_held.positive_score")))
    found = meet(rows.select("id", "label", "vec", "dim", "v1"), chosen.select("id", "label", "vec", "dim", "v1", "k1", "k2", "scores"), ["dim"], _negatives(negatives, positives), "k1 long, k2 long, at long, negative_id long, negative_score long")
    rank = F.row_number().over(Window.partitionBy("k1", "k2", "at").orderBy(F.desc("negative_score"), "negative_id"))
    found = found.withColumn("rank", rank).where(F.col("rank") <= negatives).join(chosen.select("k1", "k2", F.col("id").alias("anchor_id"), "_held"), ["k1", "k2"])
    positive = F.col("_held")[F.col("at").cast("int")]
    return found.select("anchor_id", positive["positive_id"].alias("positive_id"), "rank", "negative_id", positive["positive_score"].alias("positive_score"), "negative_score")


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    rows = rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return hard_negatives(rows, rows.where(F.col("vec_id") % 100 == 0))


ORACLE = {
    "op12_hard_negatives": """
WITH taken AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same,
         CAST(list_sum(list_transform(list_zip(a.v, b.v), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM taken a JOIN taken b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
positives AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM pairs WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
SELECT anchor_id, positive_id, row_number() OVER w AS rank, n.other_id AS negative_id, positive_score, n.score AS negative_score
FROM positives JOIN pairs n USING (anchor_id)
WHERE NOT n.same AND 80 * positive_score <= 100 * n.score AND 100 * n.score <= 100 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY n.score DESC, n.other_id)
QUALIFY row_number() OVER w <= 5
"""
}
