"""Near-copies by exact Jaccard similarity of word shingles: a prefix-filtered set join.

No radius over fingerprints holds all pairs of a given similarity, so candidates come from the shingles
themselves. With the shingles of every text in one common order, two texts of similarity UP / DOWN or more share
one of their first ``n - ceil(n * UP / DOWN) + 1``. Rows of these meet by shingle. Shingles that are often among the first
of all texts come last in the order; the counts decide how many meet, never what is found. First each text
is compared with one neighbour, which connects large groups by few pairs; in the end all pairs that meet
and are not connected yet, but for those whose parity bits prove that too many shingles differ, the nearest of each
group first. Every link is confirmed by the two whole sets.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glimt.llm import simhash
from glimt.llm.common import bounded, forget, keep_rows, row_keys, stable, written
from glimt.llm.components import contracted
from glimt.llm.textbuf import NOT_SPACE, TextBuffer, chunks, mix

WORDS = 5
#: Pairs of neighbours compared for each two groups.
TRIES = 16
#: Rounds in which each group that is still apart is compared by its nearest pairs, and how many of these.
ROUNDS, NEAREST = 3, 4
#: Parities of a set, in longs: enough to tell unrelated sets of about a thousand shingles apart.
SIGNS = 8
#: Texts whose shingles are sorted at once, fewer than 2^16.
TEXTS = 1 << 15
#: Sets are picked in the map by a broadcast of up to so many keys; beyond it by a join.
BROADCAST_KEYS = 500_000
_FACTORS = [np.uint64(pow(0x9E3779B97F4A7C15, k + 1, 1 << 64)) for k in range(WORDS)]
#: The least similarity, as a fraction.
UP, DOWN = 4, 5
#: Texts of which shingles found SEEN times or more are put last, at most MOST of them.
SAMPLE_ROWS, SEEN, MOST = 20_000, 3, 200_000
#: So do those that, after this, are among the first of OFTEN texts or more, all texts counted; beyond MOST_COUNTED the most frequent ones.
OFTEN, MOST_COUNTED = 4, 1_000_000
#: Sets that a task remembers in order to pass each on once; what it forgets is told apart later.
REMEMBERED = 1 << 20


def shingles(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, hashes): the distinct shingles of text i, ascending, are ``hashes[offsets[i]:offsets[i + 1]]``.

    A text of fewer words has one shingle, of them all; one without words has none.
    """
    if len(texts) > TEXTS:
        parts = [shingles(texts[k : k + TEXTS]) for k in range(0, len(texts), TEXTS)]
        ends = np.cumsum([0, *(o[-1] for o, _ in parts)])
        return np.concatenate([[0], *(o[1:] + e for (o, _), e in zip(parts, ends, strict=False))]), np.concatenate([h for _, h in parts])
    buf = TextBuffer(texts).lower_ascii()
    starts, ends = buf.spans(NOT_SPACE[buf.data])
    own, word = buf.owner(starts), buf.hashes(starts, ends)
    words = WORDS
    last = np.searchsorted(own, np.arange(buf.n), "right")[own] if len(own) else own
    first = np.searchsorted(own, np.arange(buf.n))[own] if len(own) else own
    at = np.arange(len(own))
    at = at[(at + words <= last) | ((at == first) & (last - first < words))]
    h = np.zeros(len(at), np.uint64)
    for k in range(words):  # words are hashed well, so a sum with a factor for each place will do
        inside = at + k < last[at]
        if inside.all():
            h += word[at + k] * _FACTORS[k]
        else:
            h[inside] += word[at[inside] + k] * _FACTORS[k]
    # in order by text, then by 48 bits of the hash
    key = np.sort((own[at].astype(np.uint64) << np.uint64(48)) | (mix(h) >> np.uint64(16)))
    key = key[np.concatenate([[True], key[1:] != key[:-1]])] if len(key) else key
    own, h = (key >> np.uint64(48)).astype(np.int64), key & np.uint64((1 << 48) - 1)
    return np.searchsorted(own, np.arange(buf.n + 1)), h.view(np.int64)


def nodes(offsets: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """One key for each set: texts of equal sets are one node."""
    raw = hashes.tobytes()
    return np.array([xxhash.xxh64_intdigest(raw[8 * a : 8 * b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)], np.uint64).view(np.int64)


def _spread(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... for each count, one after the other."""
    return np.repeat(start, count) + np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)


def _firsts(seen: set[int], keys: np.ndarray) -> np.ndarray:
    """Which keys are new to this task, as far as it remembers."""
    out = []
    if len(seen) > REMEMBERED:
        seen.clear()
    for i, key in enumerate(keys.tolist()):
        if key not in seen:
            seen.add(key)
            out.append(i)
    return np.array(out, np.int64)


def sampled_shingles(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(shingles ascending, how often) of those that a sample holds in SEEN texts or more."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in chunks(batches, "_text"):
            yield pa.RecordBatch.from_pydict({"token": shingles(piece.column("_text"))[1]})

    texts = bounded(rows.select("_text"), F.col("_text"), SAMPLE_ROWS).distinct()
    found = texts.mapInArrow(run, "token long").groupBy("token").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= SEEN)
    rows = found.orderBy(F.desc("n"), "token").limit(MOST).toArrow().sort_by("token")
    return rows.column("token").to_numpy(), rows.column("n").to_numpy()


def hot_shingles(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(shingles ascending, how often) of those that come last: the sampled ones, and those still often among the first, counted over all texts.

    Shingles of a single set, however many texts have it, are not among the latter.
    """
    sampled, times = sampled_shingles(rows)
    side = F.shiftright("node", 32).cast("int")  # 32 bits tell one set from several
    found = prefixes(rows, (sampled, times)).groupBy("token").agg(F.count(F.lit(1)).alias("n"), F.min(side).alias("_a"), F.max(side).alias("_b"))
    found = written(found.where((F.col("n") >= OFTEN) & (F.col("_a") != F.col("_b"))).select("token", "n"))
    level = F.floor(F.log2("n")).cast("int")
    least, held = 63, 0
    for r in found.groupBy(level.alias("level")).count().orderBy(F.desc("level")).collect():  # 63 rows at most
        held += r["count"]
        if held > MOST_COUNTED:
            break
        least = r["level"]
    counted = found.where(level >= least).toArrow()
    forget(found)
    # a sampled shingle stands for as many texts as the sample does; where both have one, the larger count holds
    share = max(1, rows.count() // SAMPLE_ROWS)
    tokens = np.concatenate([sampled, counted.column("token").to_numpy()])
    counts = np.concatenate([times * share, counted.column("n").to_numpy()])
    order = np.lexsort((-counts, tokens))
    tokens, counts = tokens[order], counts[order]
    first = np.concatenate([[True], tokens[1:] != tokens[:-1]])[: len(tokens)]
    return tokens[first], counts[first]


def prefixes(rows: DataFrame, hot: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """(token, node, n: shingles of the text, pos: of this one in the common order) for the first shingles of each text."""
    shared = rows.sparkSession.sparkContext.broadcast(hot)  # MOST + MOST_COUNTED entries at most

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, times = shared.value
        seen: set[int] = set()
        for piece in chunks(batches, "_text"):
            offsets, h = shingles(piece.column("_text"))
            node, size = nodes(offsets, h), np.diff(offsets)
            often = np.zeros(len(h), np.int64)
            if len(known):
                near = np.minimum(np.searchsorted(known, h), len(known) - 1)
                often = np.where(known[near] == h, times[near], 0)
            # sets are ascending by hash, so a stable order by text and frequency is the common order
            text = np.repeat(np.arange(len(size)), size)
            order = np.argsort(text * (int(often.max(initial=0)) + 1) + often, kind="stable")
            use = _firsts(seen, node)
            length = np.where(size > 0, size + (-UP * size // DOWN) + 1, 0)[use]
            at = _spread(offsets[:-1][use], length)
            yield pa.RecordBatch.from_pydict({"token": h[order[at]], "node": np.repeat(node[use], length), "n": np.repeat(size[use], length).astype(np.int32), "pos": (at - np.repeat(offsets[:-1][use], length)).astype(np.int32)})

    return rows.select("_text").mapInArrow(run, "token long, node long, n int, pos int")


_MET = "token long, node long, n int, pos int, node2 long, n2 int, pos2 int"


def _met(rows: np.ndarray, prior: np.ndarray) -> pa.RecordBatch:
    kinds = [np.int64 if c.split()[1] == "long" else np.int32 for c in _MET.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(x.astype(k)) for x, k in zip([*rows, *prior], kinds, strict=True)], names=[c.split()[0] for c in _MET.split(", ")])


def meetings(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by token, n and node: those of tokens with two nodes or more, each once, and ``node2, n2, pos2``, the row before."""
    names, before, waits = ("token", "node", "n", "pos"), None, False
    for batch in batches:
        if not batch.num_rows:
            continue
        x = np.stack([batch.column(c).to_numpy() for c in names])
        if before is not None:
            x = np.concatenate([before, x], axis=1)
        fresh = np.concatenate([[True], (x[0, 1:] != x[0, :-1]) | (x[1, 1:] != x[1, :-1])])
        x = x[:, fresh]
        joined = np.concatenate([[waits], x[0, 1:] == x[0, :-1]])  # the row has one before it
        alone = ~joined & ~np.concatenate([joined[1:], [True]])
        earlier = np.concatenate([x[1:, :1] if before is None else held, x[1:, :-1]], axis=1)
        out = np.flatnonzero(~alone)
        out = out[out < x.shape[1] - 1]  # the last row waits for what follows
        prior = np.where(joined, earlier, x[1:])
        yield _met(x[:, out], prior[:, out])
        before, waits, held = x[:, -1:], bool(joined[-1]), prior[:, -1:]
    if waits:
        yield _met(before, held)


def possible(n: str, pos: str, n2: str, pos2: str) -> Column:
    """Can two sets that meet at these places be similar? No pair that is fails where it first meets."""
    n, pos, n2, pos2 = map(F.col, (n, pos, n2, pos2))
    shared = F.lit(1) + F.least(n - pos, n2 - pos2) - 1
    return (F.least(n, n2) * DOWN >= F.greatest(n, n2) * UP) & (shared * (UP + DOWN) >= (n + n2) * UP)


def parities(offsets: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """64 * SIGNS bits for each set: whether an odd number of its shingles fall on each bit.

    Where two of them differ, a shingle is in one set only, so they differ in no more bits than the sets in shingles.
    """
    out = np.zeros((len(offsets) - 1) * SIGNS, np.uint64)
    own = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    np.bitwise_xor.at(out, own * SIGNS + hashes % SIGNS, np.uint64(1) << (hashes // SIGNS % 64).astype(np.uint64))
    return out.view(np.int64).reshape(-1, SIGNS)


def apart(mark: str = "2") -> Column:
    """How many parities ``s0``, ... differ from ``s0`` with ``mark``, ..."""
    return sum((F.bit_count(F.col(f"s{k}").bitwiseXOR(F.col(f"s{k}{mark}"))) for k in range(SIGNS)), F.lit(0))


def close(n: str, n2: str, mark: str = "2") -> Column:
    """Can two sets of these sizes be similar, by their parities? No pair that is fails."""
    return apart(mark) * (UP + DOWN) <= (F.col(n) + F.col(n2)) * (DOWN - UP)


def confirm(rows: DataFrame, stand: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (a, b) of nodes whose whole sets are similar.

    ``stand``: (node, _k1, _k2, size, s0, ...) of the one row that stands for each node. Parities tell most of the others apart; for
    those left, sets are cut anew from the texts of these rows, which costs less than keeping all. Shingles are compared by 32 bits.
    """
    signs = ["size", *(f"s{k}" for k in range(SIGNS))]
    one = stand.select(F.col("node").alias("a"), *signs)
    two = stand.select(F.col("node").alias("b"), *(F.col(c).alias(f"{c}2") for c in signs))
    pairs = written(pairs.distinct().join(one, "a").join(two, "b").where(close("size", "size2")).select("a", "b"))
    wanted = stable(stand.join(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "node", "left_semi").select("_k1", "_k2"))
    if wanted.count() <= BROADCAST_KEYS:
        wanted = F.broadcast(wanted)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for piece in chunks(batches, "_text"):
            offsets, h = shingles(piece.column("_text"))
            node, size = nodes(offsets, h), np.diff(offsets)
            use = _firsts(seen, node)
            at = _spread(offsets[:-1][use], size[use])
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size[use])]), pa.int32()), pa.array((h[at] >> 16).astype(np.int32)))
            yield pa.RecordBatch.from_arrays([pa.array(node[use]), lists], names=["node", "hashes"])

    texts = rows.select("_text", "_k1", "_k2")
    sets = texts.join(wanted, ["_k1", "_k2"], "left_semi").mapInArrow(run, "node long, hashes array<int>")
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("hashes").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("hashes").alias("y")), "b")
    return both.where(F.size(F.array_intersect("x", "y")) * (UP + DOWN) >= (F.size("x") + F.size("y")) * UP).select("a", "b")


def still_apart(pairs: DataFrame, roots: DataFrame, a: str, b: str) -> DataFrame:
    """The pairs of nodes of different groups, with their groups ``root`` and ``root2``."""
    pairs = pairs.join(roots.withColumnRenamed("node", a), a, "left").withColumn("root", F.coalesce("root", a))
    other = roots.select(F.col("node").alias(b), F.col("root").alias("root2"))
    return pairs.join(other, b, "left").withColumn("root2", F.coalesce("root2", b)).where("root <> root2")


def nearest_first(rows: DataFrame, stand: DataFrame, rest: DataFrame, links: DataFrame) -> DataFrame:
    """``links`` and what connects the groups of ``rest`` (a, b, gap, root, root2), which is ``written``.

    In each round a group is compared by its NEAREST pairs of least ``gap``, and pairs of groups that are then one need no comparison.
    What is apart after the last round is compared in full, so no link between groups is lost.
    """
    for _ in range(ROUNDS):
        if rest.isEmpty():
            break
        side = lambda own: rest.select(F.col(own).alias("_own"), F.pmod(F.xxhash64("a", "b"), F.lit(NEAREST)).alias("_try"), "a", "b", "gap")  # noqa: B023, E731
        best = F.min_by(F.struct("a", "b"), F.struct("gap", "a", "b")).alias("_pair")
        picked = stable(side("root").unionByName(side("root2")).groupBy("_own", "_try").agg(best).select("_pair.*").distinct())
        links = stable(links.unionByName(confirm(rows, stand, picked)))
        untried = rest.select("a", "b", "gap").join(picked, ["a", "b"], "left_anti")
        before, rest = rest, written(still_apart(untried, contracted(links), "a", "b").select("a", "b", "gap", "root", "root2"))
        forget(before)
    links = stable(links.unionByName(confirm(rows, stand, rest.select("a", "b"))))
    forget(rest)
    return links


def fingerprint_pairs(stand: DataFrame) -> DataFrame:
    """Pairs (a, b) of nodes that the anchors of the SimHash operator link: stars over the nodes of one fingerprint, and over fingerprints."""
    head = stand.groupBy("fp").agg(F.min("node").alias("head"))
    same = stand.select("node", "fp").join(head, "fp").where("node <> head").select(F.col("head").alias("a"), F.col("node").alias("b"))
    stars = simhash.link(stand.select("fp")).select(F.col("a").alias("_a"), F.col("b").alias("_b"))
    stars = stars.join(head.select(F.col("fp").alias("_a"), F.col("head").alias("a")), "_a").join(head.select(F.col("fp").alias("_b"), F.col("head").alias("b")), "_b")
    return same.unionByName(stars.select("a", "b"))


def link(rows: DataFrame, stand: DataFrame) -> DataFrame:
    """(node, root) of all nodes with links: ``root`` is the smallest node that they reach.

    First what SimHash fingerprints link (``fingerprint_pairs``) and each node's most met neighbour are compared, then up to TRIES pairs of each two groups that are still apart, then all
    that meet and are still apart, by ``nearest_first``. The first two rounds only make the third small.
    """
    dealt = prefixes(rows, hot_shingles(rows)).repartition("token").sortWithinPartitions("token", "n", "node")
    met = written(dealt.mapInArrow(meetings, _MET))
    # neighbours need not meet where the pair first does, so only their sizes tell
    near = met.where("node <> node2").where(f"least(n, n2) * {DOWN} >= greatest(n, n2) * {UP}").groupBy("node", "node2").agg(F.count(F.lit(1)).alias("times"))
    near = written(near)
    most = near.groupBy(F.col("node").alias("a")).agg(F.max_by("node2", F.struct("times", "node2")).alias("b"))
    links = stable(confirm(rows, stand, most.unionByName(fingerprint_pairs(stand))))
    roots = contracted(links)

    groups = [F.least("root", "root2").alias("_a"), F.greatest("root", "root2").alias("_b"), F.pmod(F.xxhash64("node", "node2"), F.lit(TRIES)).alias("_try")]
    one = F.max_by(F.struct("node", "node2"), F.struct("times", "node", "node2")).alias("_pair")
    tried = still_apart(near, roots, "node", "node2").groupBy(*groups).agg(one).select(F.col("_pair.node").alias("a"), F.col("_pair.node2").alias("b"))
    links = stable(links.unionByName(confirm(rows, stand, tried)))
    forget(near)
    roots = contracted(links)

    named = written(met.select("token", "node", "n", "pos").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")))
    forget(met)
    mixed = named.groupBy("token").agg(F.min("root").alias("_a"), F.max("root").alias("_b")).where("_a <> _b").select("token")
    signs = [f"s{k}" for k in range(SIGNS)]
    whole = named
    named = written(whole.join(mixed, "token", "left_semi").join(stand.select("node", *signs), "node"))
    forget(whole)
    other = named.select("token", *(F.col(c).alias(f"{c}2") for c in ("node", "n", "pos", "root", *signs)))
    rest = named.join(other, "token").where("node < node2 and root <> root2").where(possible("n", "pos", "n2", "pos2")).where(close("n", "n2"))
    gap = (apart() / (F.col("n") + F.col("n2"))).alias("gap")
    rest = written(rest.select(F.col("node").alias("a"), F.col("node2").alias("b"), gap, "root", "root2").distinct())
    forget(named)
    return contracted(nearest_first(rows, stand, rest, links))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows, with all columns, of which one stays of each group of near-copies: the one of the smallest id (null last).

    Texts of similarity UP / DOWN or more are linked, and groups are what links reach. Rows of one id fall by 128 bits of their content;
    of rows that agree in both one stays. Texts without words (null, empty, blank) are copies of each other; columns of any name pass through.
    """
    k1, k2 = row_keys(id_col, text_col)
    rows = docs.select(F.col(id_col).alias("_id"), k1.alias("_k1"), k2.alias("_k2"), F.col(text_col).alias("_text"))
    kind = dict(rows.dtypes)["_id"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in chunks(batches, "_text"):
            offsets, h = shingles(piece.column("_text"))
            kept, bits = [piece.column(c) for c in ("_id", "_k1", "_k2")], parities(offsets, h)
            prints = pa.array(simhash.fingerprints(piece.column("_text")).view(np.int64))
            made = [pa.array(nodes(offsets, h)), pa.array(np.diff(offsets)), *(pa.array(bits[:, k]) for k in range(SIGNS)), prints]
            yield pa.RecordBatch.from_arrays([*kept, *made], names=["_id", "_k1", "_k2", "node", *signs])

    signs = ["size", *(f"s{k}" for k in range(SIGNS)), "fp"]
    prints = rows.mapInArrow(run, f"_id {kind}, _k1 long, _k2 long, node long, {' long, '.join(signs)} long")
    first = F.min(F.struct(F.col("_id").isNull().alias("none"), "_id", "_k1", "_k2")).alias("_stay")
    least = written(prints.groupBy("node").agg(first, *(F.min(c).alias(c) for c in signs)))
    stand = least.select("node", "_stay._k1", "_stay._k2", *signs)
    groups = least.join(link(rows, stand), "node", "left").groupBy(F.coalesce("root", "node").alias("root"))
    stay = groups.agg(F.min("_stay").alias("_stay")).select("_stay._k1", "_stay._k2")
    return keep_rows(docs, stay, id_col, text_col)
