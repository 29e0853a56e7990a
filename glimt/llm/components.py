"""Connected components of an edge table, by alternating large-star and small-star rounds."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glimt.llm.common import stable

#: Edges that a task contracts at once.
AT_ONCE = 1 << 17


def components(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """(node, root) for every node of an edge: ``root`` is the smallest node that it can reach.

    Each round hangs every node's neighbours from the smallest of them, so long chains shrink quickly, and
    rows per node stay few (stars, never all pairs). Rounds are cut by stable storage.
    """
    pairs = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    pairs = stable(pairs)

    def mark(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    before = mark(pairs)
    for _ in range(rounds):
        if not before[0]:
            break
        # large star: larger neighbours hang from the smallest neighbour (or the node itself)
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        pairs = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: a node and its smaller neighbours hang from the smallest of them
        least = pairs.groupBy("u").agg(F.min("v").alias("m"))
        joined = pairs.join(least, "u")
        pairs = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        pairs = stable(pairs)
        after = mark(pairs)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components not settled in {rounds} rounds")
    own = pairs.groupBy("u").agg(F.min("v").alias("root"))
    return own.select(F.col("u").alias("node"), "root").unionByName(own.select(F.col("root").alias("node"), "root").distinct())


def contract(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes ascending, the smallest node that each can reach) of these edges."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:  # a group with an edge to another hangs from it or takes it in, so each round halves their number at least
        low, new = np.minimum(label[x], label[y]), label.copy()
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        while (new[new] != new).any():
            new = new[new]
        if (new == label).all():
            return nodes, nodes[label]
        label = new


def contracted(edges: DataFrame, at_once: int | None = None) -> DataFrame:
    """The rows of ``components``, kept; for an edge table that is kept already.

    Tasks first contract ``at_once`` edges each to stars, and as many tasks as that takes; only where they are several do
    rounds follow, over the stars. A round is ten jobs or so, whose plans and threads the driver holds for a while, however few edges there are.
    """
    at_once = at_once or AT_ONCE

    def stars(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def made() -> pa.RecordBatch:
            node, root = contract(*np.concatenate(held, axis=1))
            return pa.RecordBatch.from_pydict({"node": node, "root": root})

        for batch in batches:
            rows = np.stack([batch.column(c).to_numpy() for c in ("a", "b")])
            for k in range(0, rows.shape[1], at_once):
                if held and sum(x.shape[1] for x in held) + rows[:, k : k + at_once].shape[1] > at_once:
                    yield made()
                    held.clear()
                held.append(rows[:, k : k + at_once])
        if held:
            yield made()

    edges = edges.select("a", "b")
    parts = max(1, -(-edges.count() // at_once))
    found = stable(edges.coalesce(parts).mapInArrow(stars, "node long, root long"))
    return found if parts == 1 else stable(components(found.select(F.col("node").alias("a"), F.col("root").alias("b"))))
