"""Approximate nearest neighbours by a hash-prefix forest.

Each tree of a forest is a sorted array of long bit strings, the signs of a vector's products with random directions. A
query descends each tree to its longest-prefix match, then ascends all trees together, one bit at a time, and takes in
the rows whose strings share that many bits in any tree. It stops where a row as near as the worst of the neighbours held
would have been met with probability ``1 - MISS``: two strings agree in a bit with probability 1 - angle / pi, so this
follows from the level and the number of trees. The root, where all trees meet, is the exact way for queries whose ascent
would take in more rows than a pass over the block costs.

Largest inner product becomes smallest angle: rows are scaled by the largest norm of their block and lifted to the unit
sphere by one more component, queries get a zero there. Blocks hold rows of like norms, so no long vector flattens the rest.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glimt.llm.common import table, written
from glimt.llm.grid import matrix, meet, vectors

TREES, BITS, MISS = 48, 32, 0.05
#: A block is compared as a whole where the strings would give more than this share of it: a product of matrices costs so much less a pair.
ROOT_SHARE = 0.125
#: Rows that a query visits first.
HOME = 8192
#: Queries that ascend at once, and pairs scored at once.
TILE, PAIRS = 1024, 1 << 17


@cache
def directions(dim: int, trees: int, bits: int) -> np.ndarray:
    return np.random.default_rng(dim).standard_normal((trees, dim, bits)).astype(np.float32)


def strings(lifted: np.ndarray, trees: int, bits: int) -> np.ndarray:
    """The bit strings of unit vectors, one a tree, as numbers of ``bits`` bits."""
    lifted, weights = lifted.astype(np.float32), np.uint64(1) << np.arange(bits - 1, -1, -1, dtype=np.uint64)
    return np.stack([((lifted @ d) > 0) @ weights for d in directions(lifted.shape[1], trees, bits)])


def expanded(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which range, position) for all positions of the ranges."""
    size = last - first
    which = np.repeat(np.arange(len(size)), size)
    return which, np.arange(len(which)) - np.repeat(np.cumsum(size) - size, size) + first[which]


class Forest:
    """Over rows with ids; ``compared`` counts the pairs that searches have scored."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, trees: int = TREES, bits: int = BITS) -> None:
        order = np.argsort(ids, kind="stable")
        self.ids, self.rows, self.trees, self.bits, self.compared = ids[order], rows[order], trees, bits, 0
        norm = np.sqrt((self.rows * self.rows).sum(axis=1))
        self.reach = float(norm.max())
        scaled = self.rows / self.reach
        lifted = np.column_stack([scaled, np.sqrt(np.maximum(0, 1 - (scaled * scaled).sum(axis=1)))])
        own = strings(lifted, trees, bits)
        self.order = np.argsort(own, axis=1, kind="stable")
        self.sorted = np.take_along_axis(own, self.order, axis=1)

    def score(self, queries: np.ndarray, q: np.ndarray, r: np.ndarray) -> np.ndarray:
        """Inner products in doubles, added in the order of the components wherever a pair stands."""
        self.compared += len(q)
        out = np.zeros(len(q))
        for k in range(0, len(q), PAIRS):
            a, b = queries[q[k : k + PAIRS]], self.rows[r[k : k + PAIRS]]
            for d in range(a.shape[1]):
                out[k : k + PAIRS] += a[:, d] * b[:, d]
        return out

    def search(self, queries: np.ndarray, k: int, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, row, score) of the best ``k`` found for each query among those at ``floor`` or above; ties to the smaller id."""
        parts = [self._tile(queries[i : i + TILE], k, floor[i : i + TILE], i) for i in range(0, len(queries), TILE)]
        return tuple(np.concatenate(x) for x in zip(*parts, strict=True))

    def _best(self, q: np.ndarray, r: np.ndarray, s: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        order = np.lexsort((r, -s, q))  # rows stand in the order of their ids
        q, r, s = q[order], r[order], s[order]
        keep = np.arange(len(q)) - np.searchsorted(q, q) < k
        return q[keep], r[keep], s[keep]

    def _tile(self, queries: np.ndarray, k: int, floor: np.ndarray, offset: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n, m = len(self.rows), len(queries)
        norm = np.sqrt((queries * queries).sum(axis=1))
        own = strings(np.column_stack([queries / norm[:, None], np.zeros(m)]), self.trees, self.bits)
        # descend: the longest match in a tree stands next to the string's own place
        longest = np.zeros(m, np.int64)
        for t in range(self.trees):
            at = np.searchsorted(self.sorted[t], own[t])
            for near in (np.maximum(at - 1, 0), np.minimum(at, n - 1)):
                differ = self.sorted[t][near] ^ own[t]
                longest = np.maximum(longest, self.bits - np.ceil(np.log2(differ.astype(np.float64) + 1)).astype(np.int64))
        low = np.stack([np.searchsorted(self.sorted[t], own[t]) for t in range(self.trees)])
        high = low.copy()
        met, held = np.zeros(m, np.int64), (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        worst = floor.copy()
        going = norm * self.reach * (1 + 1e-9) >= floor  # else no row of this block can be near enough
        root = np.zeros(m, bool)
        for level in range(self.bits, 0, -1):
            up = np.flatnonzero(going & (longest >= level))
            if not len(up):
                continue
            shift = np.uint64(self.bits - level)
            prefix = own[:, up] >> shift << shift
            new_low = np.stack([np.searchsorted(self.sorted[t], prefix[t]) for t in range(self.trees)])
            new_high = np.stack([np.searchsorted(self.sorted[t], prefix[t] + (np.uint64(1) << shift)) for t in range(self.trees)])
            more = (new_high - new_low).sum(axis=0)
            wide = more > max(n * ROOT_SHARE, k)
            root[up[wide]], going[up[wide]] = True, False
            up, new_low, new_high, more = up[~wide], new_low[:, ~wide], new_high[:, ~wide], more[~wide]
            first = np.concatenate([new_low, high[:, up]], axis=1)
            last = np.concatenate([low[:, up], new_high], axis=1)
            tree, query = np.repeat(np.arange(self.trees), first.shape[1]), np.tile(np.concatenate([up, up]), self.trees)
            which, at = expanded(first.ravel(), last.ravel())
            pairs = np.unique(query[which] * n + self.order[tree[which], at])
            pairs = pairs[~np.isin(pairs, held[0] * n + held[1])]
            scored = self.score(queries, pairs // n, pairs % n)
            near = scored >= worst[pairs // n]
            held = self._best(*(np.concatenate(x) for x in zip(held, (pairs[near] // n, pairs[near] % n, scored[near]), strict=True)), k)
            low[:, up], high[:, up], met[up] = new_low, new_high, more
            full = np.flatnonzero(np.bincount(held[0], minlength=m) >= k)
            worst[full] = np.maximum(worst[full], held[2][np.searchsorted(held[0], full, "right") - 1])
            agree = 1 - np.arccos(np.clip(worst[up] / (norm[up] * self.reach), -1, 1)) / np.pi
            going[up[(1 - agree**level) ** self.trees <= MISS]] = False
        whole = np.flatnonzero(root | going)  # the root: every row, whatever its strings
        parts = [tuple(x[~np.isin(held[0], whole)] for x in held)]
        step = max(1, (1 << 22) // n)
        for i in range(0, len(whole), step):
            some = whole[i : i + step]
            self.compared += len(some) * n
            product = queries[some] @ self.rows.T
            least = np.partition(product, n - k, axis=1)[:, n - k] if n > k else np.full(len(some), -np.inf)
            least = np.maximum(least, floor[some]) - 1e-9 * norm[some] * self.reach
            q, r = np.nonzero(product >= least[:, None])
            scored = self.score(queries, some[q], r)
            near = scored >= floor[some[q]]
            parts.append(self._best(some[q][near], r[near], scored[near], k))
        q, r, s = (np.concatenate(x) for x in zip(*parts, strict=True))
        return q + offset, r, s


def _search(k: int):
    def work(block: pa.Table, chunk: pa.Table) -> pa.Table:
        found = (np.zeros(0, np.int64),) * 2 + (np.zeros(0),)
        own = np.zeros((0, 2), np.int64)
        ids, asked = np.zeros(0, np.int64), np.zeros((0, 2), np.int64)
        if len(block) and len(chunk):
            dim = block["dim"][0].as_py()
            forest = Forest(block["id"].to_numpy(), matrix(block["vec"], dim))
            order = np.argsort(block["id"].to_numpy(), kind="stable")
            ids, own = forest.ids, np.column_stack([block["v1"].to_numpy(), block["v2"].to_numpy()])[order]
            asked = np.column_stack([chunk["v1"].to_numpy(), chunk["v2"].to_numpy()])
            found = forest.search(matrix(chunk["vec"], dim), k, chunk["floor"].to_numpy())
        q, r, s = found
        return pa.table({"q1": asked[q, 0], "q2": asked[q, 1], "id": ids[r], "score": s, "same": (own[r] == asked[q]).all(axis=1)})

    return work


_FOUND = "q1 long, q2 long, id long, score double, same boolean"


def nearest(df: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` rows of ``df`` nearest to each row of ``queries``, largest inner product first.

    Both tables have ``id_col`` and ``vector_col``. Ties go to the smaller id. A query's own row (same id and vector) is no candidate;
    rows that agree in both count once. Rows with a null id take no part, nor do vectors that are null, zero, hold a null or
    non-finite component, or whose norm is no positive double. Vectors of another length than the query's are no candidates. Other columns are left out.
    """
    proper = (F.col("norm") > 0) & (F.col("norm") < float("inf"))
    rows = vectors(df, id_col, vector_col).where(proper).dropDuplicates(["id", "v1", "v2"])
    # of equal vectors only the k + 1 smallest ids can be among a query's k nearest
    first = Window.partitionBy("v1", "v2").orderBy("id")
    band = F.floor(F.log2("norm") + 0.5).cast("int")
    rows = written(rows.withColumn("_nth", F.row_number().over(first)).where(F.col("_nth") <= k + 1).select("id", "vec", "dim", "v1", "v2", band.alias("band")))
    asked = vectors(queries, id_col, vector_col).where(proper).dropDuplicates(["id", "v1", "v2"])
    chunk = written(asked.dropDuplicates(["v1", "v2"]).select("id", "vec", "dim", "v1", "v2"))
    bands = rows.groupBy("dim", "band").agg(F.count(F.lit(1)).alias("_n"))
    lowest = F.lit(float("-inf"))
    best = Window.partitionBy("q1", "q2").orderBy(F.desc("score"), "id", F.desc("same"))
    top = lambda found: found.withColumn("_at", F.row_number().over(best)).where(F.col("_at") <= k + 1)
    # descend in one block of the commonest norms first: the worst neighbour found there bounds all other searches
    home = bands.groupBy("dim").agg(F.max(F.struct("_n", "band"))["band"].alias("band"))
    homes = bands.join(home, ["dim", "band"]).select("dim", "band", F.ceil(F.col("_n") / HOME).alias("_homes"))
    at_home = rows.join(homes, ["dim", "band"]).withColumn("home", F.pmod(F.xxhash64("id", "v1"), "_homes")).drop("_homes")
    visitors = chunk.join(homes, "dim").withColumn("home", F.pmod(F.xxhash64("v1"), "_homes")).drop("_homes")
    near = meet(at_home, visitors.withColumn("floor", lowest), ["dim", "band", "home"], _search(k + 1), _FOUND)
    floors = top(near).where(F.col("_at") == k + 1).select(F.col("q1").alias("v1"), F.col("q2").alias("v2"), F.col("score").alias("floor"))
    everywhere = chunk.join(floors, ["v1", "v2"], "left").withColumn("floor", F.coalesce("floor", lowest)).join(bands.drop("_n"), "dim")
    found = top(meet(rows, written(everywhere), ["dim", "band"], _search(k + 1), _FOUND))
    named = asked.select(F.col("id").alias("query_id"), F.col("v1").alias("q1"), F.col("v2").alias("q2")).join(found, ["q1", "q2"])
    named = named.where(~(F.col("same") & (F.col("id") == F.col("query_id"))))
    ranked = named.withColumn("rank", F.row_number().over(Window.partitionBy("query_id", "q1", "q2").orderBy("_at")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias("vec_id"), "score")


def op11_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return nearest(rows, rows.where(F.col("vec_id") % 20 == 0))
