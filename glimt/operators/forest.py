"""Traces as forests, by pointer doubling: in numpy over many traces at once, and as joins for traces beyond one task.

Every span knows its parent, then the span two levels up, then four, and so on; after as many rounds as the logarithm of the depth
each has met all that is above it. Sums and flags double with the pointers: depth, subtree sizes, errors below, and places in pre-order.
Both versions follow the same rules. Of spans with one id the earliest counts. A parent that is absent, or the span itself, makes a
root. In a cycle a span becomes a root if none above it is earlier (by start, then id). Children stand in the order of start and id, as do roots, those of cycles last.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glimt.functions.spread import join_hot, running_sum
from glimt.functions.storage import kept

SCHEMA = "trace_id string, span_id string, position long, depth long, offset_nanos long, clock_skew boolean, subtree_has_error boolean, critical boolean"
COLUMNS = ("trace_id", "span_id", "parent_span_id", "start", "end", "status_code")


def _doubled(up: np.ndarray, value: np.ndarray) -> np.ndarray:
    """The sum of ``value`` over each node and all above it."""
    value, jump = value.copy(), up
    while (at := np.flatnonzero(jump >= 0)).size:
        more = value[jump[at]]
        value[at] += more
        jump = np.where(jump >= 0, jump[jump], -1)
    return value


def _below(up: np.ndarray, value: np.ndarray) -> np.ndarray:
    """The sum of ``value`` over each node and all below it."""
    value, jump = value.astype(np.float64), up
    while (at := np.flatnonzero(jump >= 0)).size:
        value = value + np.bincount(jump[at], value[at], len(up))
        jump = np.where(jump >= 0, jump[jump], -1)
    return value.astype(np.int64)


def _ranks(traces: np.ndarray, up: np.ndarray, weight: np.ndarray, late: np.ndarray) -> np.ndarray:
    """Of each node: the summed weight of the siblings before it; roots of a trace are siblings, those that break a cycle come ``late``."""
    group = np.where(up >= 0, up, -1 - traces)
    order = np.lexsort((late, group))
    total = np.cumsum(weight[order]) - weight[order]
    edge = np.flatnonzero(np.concatenate([[True], group[order][1:] != group[order][:-1]]))
    out = np.empty(len(up), np.int64)
    out[order] = total - np.repeat(total[edge], np.diff(np.concatenate([edge, [len(up)]])))
    return out


def forest(rows: pa.Table) -> pa.RecordBatch:
    """Whole traces, in columns COLUMNS, as rows of SCHEMA."""
    n = len(rows)
    start, end, status = (rows[c].to_numpy() for c in COLUMNS[3:])
    parent = rows["parent_span_id"].to_pandas()
    codes, names = pd.factorize(pd.concat([rows["span_id"].to_pandas(), parent], ignore_index=True), sort=True)
    trace, _ = pd.factorize(rows["trace_id"].to_pandas())
    order = np.lexsort((codes[:n], start, trace))
    key = trace.astype(np.int64) * (len(names) + 1) + codes[:n]
    _, first = np.unique(key[order], return_index=True)
    order = order[np.sort(first)]
    trace, own, start, end, bad = trace[order], codes[:n][order], start[order], end[order], status[order] == 2
    above, key, n = codes[n:][order], key[order], len(order)
    by_key = np.argsort(key)
    wanted = trace.astype(np.int64) * (len(names) + 1) + above
    at = np.minimum(np.searchsorted(key[by_key], wanted), n - 1)
    up = np.where((above >= 0) & (above != own) & (key[by_key][at] == wanted), by_key[at], -1)
    # cycles: after n steps a node of a forest has left it
    jump = up
    for _ in range(n.bit_length()):
        jump = np.where(jump >= 0, jump[jump], -1)
    late = np.zeros(n, bool)
    if (cyclic := np.flatnonzero(jump >= 0)).size:
        least, jump = np.arange(n), up.copy()
        for _ in range(n.bit_length() + 1):
            least = np.where(jump >= 0, np.minimum(least, least[jump]), least)
            jump = np.where(jump >= 0, jump[jump], -1)
        late[cyclic[least[cyclic] == cyclic]] = True
        up[late] = -1
    depth = _doubled(up, (up >= 0).astype(np.int64))
    size, errors = _below(up, np.ones(n)), _below(up, bad)
    place = _doubled(up, _ranks(trace, up, size, late) + (up >= 0))
    group = np.where(up >= 0, up, -1 - trace)
    best = np.zeros(n, bool)
    last = np.lexsort((own, -start, end, group))  # the last of each group ends last
    best[last[np.concatenate([group[last][1:] != group[last][:-1], [True]])]] = True
    critical = _doubled(up, (~best).astype(np.int64)) == 0
    skew = np.zeros(n, bool)
    child = np.flatnonzero(up >= 0)
    skew[child] = (start[child] < start[up[child]]) | (end[child] > end[up[child]])
    edge = np.flatnonzero(np.concatenate([[True], trace[1:] != trace[:-1]]))
    zero = np.repeat(start[edge], np.diff(np.concatenate([edge, [n]])))
    texts = [rows[c].combine_chunks().take(pa.array(order)) for c in ("trace_id", "span_id")]
    return pa.RecordBatch.from_arrays([*texts, *map(pa.array, (place, depth, start - zero, skew, errors > 0, critical))], names=[x.split()[0] for x in SCHEMA.split(", ")])


def forests(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Traces of a partition sorted by trace id, whatever batches they come in; only the edge of each batch is looked at."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        trace = batch.column("trace_id").to_pandas().to_numpy()
        cut = np.flatnonzero(trace[1:] != trace[:-1])
        if held and held[-1].column("trace_id")[-1].as_py() != trace[0]:
            yield forest(pa.Table.from_batches(held))
            held = []
        if len(cut):
            last = int(cut[-1]) + 1
            yield forest(pa.Table.from_batches([*held, batch.slice(0, last)]))
            held = []
            batch = batch.slice(last)
        held.append(batch)
    if held:
        yield forest(pa.Table.from_batches(held))


def _climb(nodes: DataFrame, hot_rows: int, sums: Sequence[str], flags: Sequence[str] = (), rounds: int = 64) -> DataFrame | None:
    """Doubles the pointers of ``nodes`` (n, above) until all have left the forest; None if some have not after ``rounds`` (a cycle).

    The columns ``sums`` become sums over each node and all above it, ``flags`` over each and all below.
    """
    state = kept(nodes.select("n", F.col("above").alias("jump"), *sums, *flags), "climb")
    for _ in range(rounds):
        if (going := state.where("jump is not null")).isEmpty():
            return state.drop("jump")
        if flags:
            below = going.groupBy(F.col("jump").alias("n")).agg(*(F.sum(c).alias(f"_{c}") for c in flags))
            state = kept(state.join(below, "n", "left").withColumns({c: F.col(c) + F.coalesce(f"_{c}", F.lit(0)) for c in flags}).drop(*(f"_{c}" for c in flags)), "below")  # read four times
            going = state.where("jump is not null")
        target = state.select(F.col("n").alias("jump"), F.col("jump").alias("_next"), *(F.col(c).alias(f"_{c}") for c in sums))
        moved = join_hot(going, target, ["jump"], "left", hot_rows)
        moved = moved.select("n", F.col("_next").alias("jump"), *((F.col(c) + F.col(f"_{c}")).alias(c) for c in sums), *flags)
        state = kept(state.where("jump is null").unionByName(moved), "climb")
    return None


def _sizes(nodes: DataFrame, hot_rows: int) -> tuple[DataFrame, int, bool] | None:
    """(n, above, size, bad, level) with ``size`` and ``bad`` of ``nodes`` (n, above, size, bad) summed over each and all below; None if there is a cycle.

    Leaves are stripped level by level and added to what is above them, as long as that leaves at most half of the nodes; the rest, if any, is
    climbed and becomes the last level. So all levels together cost no more than a few passes over the nodes, however deep they are.
    """
    state, rows, levels = nodes, nodes.count(), []
    while rows or not levels:
        tops = state.where("above is not null").select(F.col("above").alias("n")).distinct().withColumn("_inner", F.lit(True))
        marked = kept(state.join(tops, "n", "left"), "marked")
        inner = marked.where("_inner").drop("_inner")
        if 2 * (left := inner.count()) > rows:
            break
        leaves = marked.where("_inner is null").drop("_inner")
        levels.append(leaves.withColumn("level", F.lit(len(levels))))
        below = leaves.where("above is not null").groupBy(F.col("above").alias("n")).agg(F.sum("size").alias("_size"), F.sum("bad").alias("_bad"))
        state = kept(inner.join(below, "n", "left").select("n", "above", *((F.col(c) + F.coalesce(f"_{c}", F.lit(0))).alias(c) for c in ("size", "bad"))), "inner")
        rows = left
    if rows:
        if (grown := _climb(state, hot_rows, [], ["size", "bad"], rows.bit_length() + 1)) is None:
            return None
        levels.append(state.select("n", "above").join(grown, "n").withColumn("level", F.lit(len(levels))))
    return kept(reduce(DataFrame.unionByName, levels), "sizes"), len(levels), rows > 0


def _places(steps: DataFrame, levels: int, climbed: bool, hot_rows: int) -> DataFrame:
    """(n, position, depth, astray) of ``steps`` (n, above, level and these), summed over each node and all above it: from the last level of ``_sizes`` down."""
    sums = ["position", "depth", "astray"]
    found: list[DataFrame] = []
    for level in reversed(range(levels)):
        here = steps.where(F.col("level") == level)
        if climbed and not found:
            found.append(_climb(here, hot_rows, sums))
            continue
        tops = here.where("above is null").select("n", *sums)
        if found:
            above = reduce(DataFrame.unionByName, found).select(F.col("n").alias("above"), *(F.col(c).alias(f"_{c}") for c in sums))
            met = join_hot(here.where("above is not null"), above, ["above"], "inner", hot_rows)
            tops = tops.unionByName(met.select("n", *((F.col(c) + F.col(f"_{c}")).alias(c) for c in sums)))
        found.append(kept(tops, "places"))
    return reduce(DataFrame.unionByName, found)


def giant_forest(rows: DataFrame, hot_rows: int = 100_000, parts: int | None = None) -> DataFrame:
    """As ``forest``, for traces of any size: joins, each kept in the shared folder; no task holds a whole trace.

    Spans get a number, and their parent's. Only spans that have children (``inner``) go through the rounds; all others follow from their
    parents. What is above is found by families: those of up to ``hot_rows`` spans are one window each, larger ones and roots are dealt by ranges.
    """
    one, zero = F.lit(1).cast("long"), F.lit(0).cast("long")
    # ids come first in all keys: they tell rows apart, trace ids hardly do
    read = rows.select(F.col("trace_id").alias("t"), F.col("span_id").alias("id"), F.when(F.col("parent_span_id") != F.col("span_id"), F.col("parent_span_id")).alias("up"), "start", "end", (F.col("status_code") == 2).cast("long").alias("bad"))
    read = kept(read, "read")
    named = kept(read.where("up is not null").groupBy("up", "t").agg(F.count(F.lit(1)).alias("_rows")), "named")
    first = Window.partitionBy("id", "t").orderBy("start")
    spans = read.withColumn("_before", F.lag(F.lit(True)).over(first)).where("_before is null").drop("_before")  # a row number would be sorted for twice
    spans = spans.join(named.select(F.col("up").alias("id"), "t", F.lit(True).alias("inner")), ["id", "t"], "left").withColumn("inner", F.col("inner").isNotNull())
    spans = kept(spans.withColumn("n", F.monotonically_increasing_id()), "first")
    above = spans.where("inner").select(F.col("id").alias("up"), "t", F.col("n").alias("above"), F.col("start").alias("p_start"), F.col("end").alias("p_end"))
    met = join_hot(spans.where("up is not null"), above, ["up", "t"], "left", hot_rows, named, "wide")
    skew = F.coalesce((F.col("start") < F.col("p_start")) | (F.col("end") > F.col("p_end")), F.lit(False)).alias("skew")
    columns = ["n", "t", "id", "start", "end", "bad", "inner"]
    top = spans.where("up is null").select(*columns, F.lit(None).cast("long").alias("above"), F.lit(True).alias("wide"), F.lit(False).alias("skew"))
    spans = kept(met.select(*columns, "above", (F.col("wide") | F.col("above").isNull()).alias("wide"), skew).unionByName(top).withColumn("late", F.lit(False)), "spans")
    if (sizes := _sizes(_weighed(spans), hot_rows)) is None:
        rounds = max(1, int(spans.groupBy("t").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 1)).bit_length()
        broken = _cycle_roots(spans, rounds, hot_rows).withColumn("_root", F.lit(True))
        whole = F.col("_root").isNull()
        spans = kept(spans.join(broken, "n", "left").withColumns({"above": F.when(whole, F.col("above")), "skew": F.col("skew") & whole, "wide": F.col("wide") | ~whole, "late": ~whole}).drop("_root"), "spans")
        sizes = _sizes(_weighed(spans), hot_rows)
    sized, levels, climbed = sizes
    inner = kept(spans.where("inner").drop("bad").join(sized.drop("above"), "n"), "inner")
    sized = spans.where("not inner").withColumns({"size": one, "level": F.lit(None).cast("int")}).unionByName(inner)
    # siblings before each span, and the one that ends last of each family
    wide = sized.where("wide").withColumn("_family", F.coalesce("above", F.lit(-1)))
    wide = kept(running_sum(wide, ["_family", "t"], ["late", "start", "id"], "size", "ahead", parts), "wide")
    best = F.struct("end", -F.col("start"), "id")
    last = kept(wide.groupBy("_family", "t").agg(F.max_by("n", best).alias("n")), "last")  # a row for each family of more than ``hot_rows`` spans, and for each trace's roots
    wide = wide.drop("_family").join(F.broadcast(last.select("n", F.lit(True).alias("best"))), "n", "left").withColumn("best", F.col("best").isNotNull())
    family = Window.partitionBy("above").orderBy("start", "id")
    before, all_of = family.rowsBetween(Window.unboundedPreceding, -1), family.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ranked = lambda x: x.withColumns({"ahead": F.coalesce(F.sum("size").over(before), zero), "best": best == F.max(best).over(all_of)})
    narrow = sized.where("not wide")
    # places of spans that have children, from the top; then those of all spans by their parents
    holders = inner.where("above is not null").select("above").distinct()
    step = F.when(F.col("above").isNull(), zero).otherwise(one)
    steps = ranked(narrow.join(holders, "above", "left_semi")).unionByName(wide).where("level is not null")
    steps = kept(steps.select("n", "above", "level", (F.col("ahead") + step).alias("position"), step.alias("depth"), F.when(F.col("best"), zero).otherwise(one).alias("astray")), "steps")
    places = _places(steps, levels, climbed, hot_rows)
    above = places.select(F.col("n").alias("above"), *(F.col(c).alias(f"_{c}") for c in ("position", "depth", "astray")))
    met = wide.join(F.broadcast(above.join(last.select(F.col("_family").alias("above")), "above", "left_semi")), "above", "left")
    out = ranked(narrow).join(above, "above").unionByName(met)
    zeros = spans.groupBy("t").agg(F.min("start").alias("_zero"))  # a row a giant trace, as in ``trace_tree``
    out = out.join(F.broadcast(zeros), "t")
    placed = lambda c: F.coalesce(F.col(f"_{c}") + 1, zero)
    return out.select(F.col("t").alias("trace_id"), F.col("id").alias("span_id"), (placed("position") + F.col("ahead")).alias("position"), placed("depth").alias("depth"), (F.col("start") - F.col("_zero")).alias("offset_nanos"), F.col("skew").alias("clock_skew"), (F.col("bad") > 0).alias("subtree_has_error"), (F.col("best") & (F.coalesce("_astray", zero) == 0)).alias("critical"))


def _weighed(spans: DataFrame) -> DataFrame:
    """(n, above, size, bad) of the spans that have children; the last two count each and those of its children that have none."""
    alone = spans.where("above is not null and not inner").groupBy(F.col("above").alias("n")).agg(F.count(F.lit(1)).alias("_size"), F.sum("bad").alias("_bad"))
    nodes = spans.where("inner").select("n", "above", F.lit(1).cast("long").alias("size"), "bad").join(alone, "n", "left")
    return kept(nodes.select("n", "above", *((F.col(c) + F.coalesce(f"_{c}", F.lit(0))).alias(c) for c in ("size", "bad"))), "nodes")


def _cycle_roots(spans: DataFrame, rounds: int, hot_rows: int) -> DataFrame:
    """The numbers of the spans that break cycles: in or below one, with no earlier span above."""
    least = F.struct("start", "id")
    state = kept(spans.select("n", F.col("above").alias("jump"), least.alias("own"), least.alias("least")), "cycles")
    for _ in range(rounds + 1):
        # what has left by its pointers is in no cycle and is not met by those in one
        going = state.where("jump is not null")
        target = going.select(F.col("n").alias("jump"), F.col("jump").alias("_next"), F.col("least").alias("_least"))
        moved = join_hot(going, target, ["jump"], "left", hot_rows)
        state = kept(moved.select("n", F.col("_next").alias("jump"), "own", F.least("least", "_least").alias("least")), "cycles")
    return state.where("jump is not null and own = least").select("n")
