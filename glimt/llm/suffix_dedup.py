"""Exact removal of repeated byte strings by a distributed, hash-compared suffix sort.

Equal strings of LENGTH bytes agree in every part, so both hold the same sampled anchor (the
smallest hash of a GRAM in the string) at the same offset. Spark counts anchors; only texts with
anchors found more than once send the bytes around them to a task per anchor value. There the
suffixes from the anchor on, and the reversed prefixes before it, are sorted by mergesort. Two are
compared through prefix polynomial hashes: a binary search finds how far they agree, so a comparison
takes a logarithmic number of probes. Bytes verify the agreement of neighbours; after a collision
the batch is sorted anew with another base. Strings that agree on both sides are repeats.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glimt.llm.common import stable, table, written
from glimt.llm.textbuf import TextBuffer, chunks

LENGTH = 400
GRAM = 64
#: Anchors found more often than this are hot: their contexts are first counted, then those of MOST different ones or fewer are
#: sorted like any other group, and wider groups are settled by counting the strings themselves, in PIECES for each context.
HOT, MOST, PIECES = 4_000, 4_000, 8
#: Up to so many hot anchors (8 bytes each) are broadcast and looked up in a scan; beyond it the texts that hold them are joined.
BROADCAST_ANCHORS = 1_000_000
#: Contexts sorted at once, about; a group is never split.
_BATCH = 4_096
#: Bytes in which anchors are picked at once.
_SLICE = 1 << 27
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)


def pick_anchors(buf: TextBuffer, length: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the grams that are the smallest (of equals the last) in any window of ``length`` bytes of a text."""
    h, chosen = buf.grams(gram), [np.zeros(0, np.int64)]
    for a in range(0, len(buf.data) - length + 1, _SLICE):
        b = min(a + _SLICE, len(buf.data) - length + 1)  # windows that start in [a, b)
        start = np.arange(a, b)
        whole = start + length <= buf.offsets[1:][buf.owner(start)]
        chosen.append(a + _smallest(h[a : b + length - gram], length - gram + 1, whole))
    chosen = np.unique(np.concatenate(chosen))
    return chosen, h[chosen]


def _smallest(h: np.ndarray, window: int, use: np.ndarray) -> np.ndarray:
    """Places of the smallest values in those windows that are in use."""
    low = np.uint64((1 << 28) - 1)
    best = (h & ~low) | (low - np.arange(len(h), dtype=np.uint64))
    width = 1
    while width * 2 <= window:
        best = np.minimum(best[: len(best) - width], best[width:])
        width *= 2
    if rest := window - width:
        best = np.minimum(best[: len(best) - rest], best[rest:])
    return np.unique((low - (best & low))[use].astype(np.int64))


class Suffixes:
    """Byte strings, one a row from column 0 on, in order within their groups."""

    def __init__(self, rows: np.ndarray, size: np.ndarray, group: np.ndarray) -> None:
        """``group`` is ascending. ``order``: rows in order; ``agree``: how many bytes each shares with the one before it (-1: another group)."""
        self.rows, self.size, self.group = rows, size, group
        for base in _BASES:
            powers = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(max(0, rows.shape[1] - 1), base | 1, np.uint64)]))[: rows.shape[1]]
            self.hashes = np.zeros((len(rows), rows.shape[1] + 1), np.uint64)
            np.cumsum((rows.astype(np.uint64) + np.uint64(1)) * powers, axis=1, out=self.hashes[:, 1:])
            self.order = self._sorted()
            if self._verified():
                break
        else:
            raise RuntimeError("four hash bases collided in one batch")
        del self.hashes

    def extension(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many leading bytes rows a and b share, by binary search over prefix hashes."""
        low, high = np.zeros(len(a), np.int64), np.minimum(self.size[a], self.size[b]).astype(np.int64)
        while (low < high).any():
            middle = (low + high + 1) // 2
            same = self.hashes[a, middle] == self.hashes[b, middle]
            low, high = np.where(same, middle, low), np.where(same, high, middle - 1)
        return low

    def before(self, a: np.ndarray, b: np.ndarray, or_equal: np.ndarray) -> np.ndarray:
        k = self.extension(a, b)
        end_a, end_b = k >= self.size[a], k >= self.size[b]
        last = max(0, self.rows.shape[1] - 1)
        less = self.rows[a, np.minimum(k, last)] < self.rows[b, np.minimum(k, last)]
        return np.where(end_a, np.where(end_b, or_equal, True), np.where(end_b, False, less))

    def _sorted(self) -> np.ndarray:
        """Bottom-up mergesort of all groups at once: each row's rank in the sibling run is its shift."""
        order = np.arange(len(self.group))
        edge = np.flatnonzero(np.concatenate([[True], self.group[1:] != self.group[:-1]]))
        count = np.diff(np.concatenate([edge, [len(order)]]))
        first, many = np.repeat(edge, count), np.repeat(count, count)
        width = 1
        while (live := np.flatnonzero(many > width)).size:
            own = live - first[live]
            run = own // width
            lo = first[live] + (run ^ 1) * width
            end = first[live] + many[live]
            has = lo < end
            live, run, lo, own, end = live[has], run[has], lo[has], own[has], end[has]
            a, b = np.zeros(len(live), np.int64), np.minimum(width, end - lo)
            right = (run & 1).astype(bool)
            while (todo := np.flatnonzero(a < b)).size:
                middle = (a[todo] + b[todo]) // 2
                smaller = self.before(order[lo[todo] + middle], order[live[todo]], right[todo])
                a[todo] = np.where(smaller, middle + 1, a[todo])
                b[todo] = np.where(smaller, b[todo], middle)
            new = order.copy()
            new[first[live] + np.minimum(run, run ^ 1) * width + (own - run * width) + a] = order[live]
            order = new
            width *= 2
        return order

    def _verified(self) -> bool:
        """Neighbours agree as far as the hashes say, and are in order, byte by byte."""
        a, b = self.order[:-1], self.order[1:]
        same = self.group[a] == self.group[b]
        agree = np.full(len(self.order), -1, np.int64)
        a, b, at = a[same], b[same], np.flatnonzero(same) + 1
        agree[at] = k = self.extension(a, b)
        columns = np.arange(self.rows.shape[1])
        for i in range(0, len(a), 1024):
            x, y, n = self.rows[a[i : i + 1024]], self.rows[b[i : i + 1024]], k[i : i + 1024]
            if not ((x == y) | (columns >= n[:, None])).all():
                return False
        self.agree = agree
        return bool(self.before(a, b, np.ones(len(a), bool)).all())


def repeated_starts(rows: list[bytes], left: np.ndarray, group: np.ndarray, many: np.ndarray, length: int) -> np.ndarray:
    """For each context (``left`` bytes, then those from the anchor on) and each j: does the string from j bytes before the anchor on repeat?

    ``many``: contexts that stand for several places.
    """
    size = np.array([len(r) for r in rows])
    right = np.minimum(size - left, length)
    data = np.frombuffer(b"".join(rows), np.uint8)
    begin = np.cumsum(size) - size
    width = int(left.max(initial=0))
    column = np.arange(length)
    ahead = np.where(column < right[:, None], data[np.minimum((begin + left)[:, None] + column, len(data) - 1)], 0).astype(np.uint8)
    column = np.arange(max(1, width))
    behind = np.where(column < left[:, None], data[np.maximum((begin + left)[:, None] - 1 - column, 0)], 0).astype(np.uint8)
    forward, backward = Suffixes(ahead, right, group), Suffixes(behind, left, group)
    out = np.zeros((len(rows), width + 1), bool)
    mine_f, mine_b = np.empty(len(rows), np.int64), np.empty(len(rows), np.int64)
    for j in range(width + 1):
        fits = np.flatnonzero((left >= j) & (right >= length - j))
        if not len(fits):
            continue
        mine_f[forward.order] = np.cumsum(forward.agree < length - j)
        mine_b[backward.order] = np.cumsum(backward.agree < j)
        key = mine_f[fits] * (len(rows) + 1) + mine_b[fits]
        order = np.argsort(key, kind="stable")
        same = key[order[1:]] == key[order[:-1]]
        out[fits[order[1:][same]], j] = True
        out[fits[order[:-1][same]], j] = True
        out[fits, j] |= many[fits] > 1
    return out


_PLACE = pa.struct([("t1", pa.int64()), ("t2", pa.int64()), ("pos", pa.int64())])
_CONTEXT = "anchor long, lead int, bytes binary, places array<struct<t1:long,t2:long,pos:long>>"
_RUN = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))
_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
_SPANS_SQL = "array<struct<start:long,end:long>>"


def _hash(data: bytes, *key: int) -> tuple[int, int]:
    """128 bits of a byte string and the numbers that go with it."""
    digest = hashlib.blake2b(data, digest_size=16, key=b"".join(k.to_bytes(8, "big", signed=True) for k in key)).digest()
    return int.from_bytes(digest[:8], "big", signed=True), int.from_bytes(digest[8:], "big", signed=True)


def _around(piece: pa.RecordBatch, reach: int, length: int) -> Iterator[tuple[int, int, int, int, int, bytes]]:
    """(t1, t2, place, anchor, bytes before it, its context) for rows (_t1, _t2, _text, _at: places and anchors)."""
    texts = piece.column("_text").cast(pa.binary())
    for i, (t1, t2, at) in enumerate(zip(*(piece.column(c).to_pylist() for c in ("_t1", "_t2", "_at")), strict=True)):
        text = texts[i].as_py()
        for p in at:
            lead = min(p["pos"], reach)
            yield t1, t2, p["pos"], p["anchor"], lead, text[p["pos"] - lead : p["pos"] + length]


def contexts(length: int, gram: int):
    """The bytes around each place, equal ones of a batch once, with the places that they stand for."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in chunks(batches, "_text"):
            found: dict[tuple[int, int, bytes], list[dict]] = {}
            for t1, t2, pos, *key in _around(piece, length - gram, length):
                found.setdefault(tuple(key), []).append({"t1": t1, "t2": t2, "pos": pos})
            if found:
                anchor, lead, data = zip(*found, strict=True)
                arrays = [pa.array(anchor, pa.int64()), pa.array(lead, pa.int32()), pa.array(data, pa.binary()), pa.array(list(found.values()), pa.list_(_PLACE))]
                yield pa.RecordBatch.from_arrays(arrays, names=["anchor", "lead", "bytes", "places"])

    return run


def in_groups(names: tuple[str, ...], work):
    """For rows sorted by the first of ``names``: ``work`` on lists of whole groups, about _BATCH rows at a time."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: tuple[list, ...] = tuple([] for _ in names)
        for batch in batches:
            for mine, name in zip(rest, names, strict=True):
                mine.extend(batch.column(name).to_pylist())
            while len(rest[0]) > _BATCH:
                edge = lambda i: rest[0][i] != rest[0][i - 1]  # noqa: B023, E731
                cut = next(filter(edge, range(_BATCH, 0, -1)), 0) or next(filter(edge, range(_BATCH, len(rest[0]))), 0)
                if not cut:
                    break
                yield from work(*(x[:cut] for x in rest))
                rest = tuple(x[cut:] for x in rest)
        if rest[0]:
            yield from work(*rest)

    return run


def _runs(data: list[bytes], lead: list[int], group: list[int], many: list[int], length: int) -> Iterator[tuple[int, int, int]]:
    """(row, a, b): the strings from a to b bytes before the row's anchor on repeat. Rows of a group are different and lie together."""
    group, many = np.array(group), np.array(many)
    size = np.unique(group, return_counts=True)
    useful = np.flatnonzero((size[1][np.searchsorted(size[0], group)] > 1) | (many > 1))
    if len(useful):
        repeat = repeated_starts([data[i] for i in useful], np.array([lead[i] for i in useful]), group[useful], many[useful], length)
        edge = np.diff(np.pad(repeat, ((0, 0), (1, 1))).astype(np.int8), axis=1)
        row, first = np.nonzero(edge == 1)
        _, last = np.nonzero(edge == -1)
        yield from zip(useful[row].tolist(), first.tolist(), (last - 1).tolist(), strict=True)


def _joined(spans: list[tuple[int, int]]) -> list[list[int]]:
    """Spans in order, those that meet as one."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def covered(length: int):
    """Work on contexts by anchor: a row (t1, t2, spans) for each text, of the runs of bytes that repeated strings cover."""

    def work(anchor: list[int], lead: list[int], data: list[bytes], places: list[list[dict]]) -> Iterator[pa.RecordBatch]:
        joint: dict[tuple[int, int, bytes], list[dict]] = {}
        for key, own in zip(zip(anchor, lead, data, strict=True), places, strict=True):
            joint.setdefault(key, []).extend(own)
        group, left, rows = zip(*joint, strict=True)
        at = list(joint.values())
        spans: dict[tuple[int, int], list[tuple[int, int]]] = {}
        for i, a, b in _runs(list(rows), list(left), list(group), [len(p) for p in at], length):
            for p in at[i]:
                spans.setdefault((p["t1"], p["t2"]), []).append((p["pos"] - b, p["pos"] - a + length))
        if spans:
            t1, t2 = zip(*spans, strict=True)
            runs = [[{"start": a, "end": b} for a, b in _joined(x)] for x in spans.values()]
            yield pa.RecordBatch.from_arrays([pa.array(t1, pa.int64()), pa.array(t2, pa.int64()), pa.array(runs, _SPANS)], names=["t1", "t2", "spans"])

    return in_groups(("anchor", "lead", "bytes", "places"), work)


def hot_contexts(length: int, gram: int, hot: Broadcast | None):
    """The bytes around each place of a hot anchor, equal ones of a text once: (anchor, c1, c2: of the context, lead, bytes, n, t1, t2, at).

    Rows have _t1, _t2, _text and, where the anchors are not given, _at.
    """

    def placed(piece: pa.RecordBatch) -> pa.RecordBatch:
        buf = TextBuffer(piece.column("_text"))
        pos, h = pick_anchors(buf, length, gram)
        known = hot.value
        use = known[np.minimum(np.searchsorted(known, h.view(np.int64)), len(known) - 1)] == h.view(np.int64)
        pos, h = pos[use], h[use].view(np.int64)
        own = buf.owner(pos)
        cuts = np.searchsorted(own, np.arange(buf.n + 1))
        pairs = pa.StructArray.from_arrays([pa.array(pos - buf.offsets[own]), pa.array(h)], ["pos", "anchor"])
        piece = piece.append_column("_at", pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pairs))
        return piece.filter(pa.array(np.diff(cuts) > 0))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in chunks(batches, "_text"):
            found: dict[tuple, list[int]] = {}
            for t1, t2, pos, *key in _around(piece if hot is None else placed(piece), length - gram, length):
                found.setdefault((t1, t2, *key), []).append(pos)
            rows = [(anchor, *_hash(data, anchor, lead), lead, data, len(at), t1, t2, at) for (t1, t2, anchor, lead, data), at in found.items()]
            if rows:
                yield _batch(rows, _HOT_SCHEMA)

    return run


_HOT_SCHEMA = pa.schema([*((c, pa.int64()) for c in ("anchor", "c1", "c2", "lead")), ("bytes", pa.binary()), *((c, pa.int64()) for c in ("n", "t1", "t2")), ("at", pa.list_(pa.int64()))])


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)


def sorted_contexts(length: int):
    """Work on different contexts by anchor: (c1, c2, runs) of those with strings that repeat."""

    def work(anchor: list[int], c1: list[int], c2: list[int], lead: list[int], data: list[bytes], n: list[int]) -> Iterator[pa.RecordBatch]:
        runs: dict[int, list[dict]] = {}
        for i, a, b in _runs(data, lead, anchor, n, length):
            runs.setdefault(i, []).append({"a": a, "b": b})
        if runs:
            yield pa.RecordBatch.from_arrays([pa.array([c1[i] for i in runs], pa.int64()), pa.array([c2[i] for i in runs], pa.int64()), pa.array(list(runs.values()), _RUN)], names=["c1", "c2", "runs"])

    return in_groups(("anchor", "c1", "c2", "lead", "bytes", "n"), work)


_PIECE_NAMES = ("c1", "c2", "n", "near", "far", "lo", "hi", "k1", "k2", "e1", "e2")


def pieces(length: int, gram: int):
    """Of contexts: their strings in PIECES by where they start. Strings that begin near .. far bytes before the anchor share the core
    (k1, k2) between; the piece (e1, e2) is the core with all that they reach. Those that begin lo .. hi bytes before it lie in the text."""
    reach = length - gram
    step = -(-(reach + 1) // PIECES)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for c1, c2, n, lead, data in zip(*(batch.column(c).to_pylist() for c in ("c1", "c2", "n", "lead", "bytes")), strict=True):
                for near in range(0, reach + 1, step):
                    far = min(near + step - 1, reach)
                    lo, hi = max(near, length - (len(data) - lead)), min(far, lead)
                    if lo > hi:
                        continue
                    core = _hash(data[lead - near : lead + length - far], near)
                    rows.append((c1, c2, n, near, far, lo, hi, *core, *_hash(data[lead - hi : lead + length - lo], near, lo, hi)))
            if rows:
                yield _batch(rows, pa.schema([(c, pa.int64()) for c in _PIECE_NAMES]))

    return run


def single_strings(length: int):
    """Of pieces with the bytes of their context: each string (e1, e2, j: bytes before the anchor, w1, w2: of the string, n)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for e1, e2, n, lo, hi, lead, data in zip(*(batch.column(c).to_pylist() for c in ("e1", "e2", "n", "lo", "hi", "lead", "bytes")), strict=True):
                rows += [(e1, e2, j, *_hash(data[lead - j : lead - j + length], j), n) for j in range(lo, hi + 1)]
            if rows:
                yield _batch(rows, pa.schema([(c, pa.int64()) for c in ("e1", "e2", "j", "w1", "w2", "n")]))

    return run


def merged_runs(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(c1, c2, runs) with runs that overlap or follow each other as one."""
    for batch in batches:
        runs = [[{"a": a, "b": b - 1} for a, b in _joined([(r["a"], r["b"] + 1) for r in own])] for own in batch.column("runs").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("c1"), batch.column("c2"), pa.array(runs, _RUN)], names=["c1", "c2", "runs"])


def placed_runs(length: int):
    """Spans of bytes (t1, t2, spans) of the runs of a context at each of a text's places of it."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = [[{"start": a, "end": b} for a, b in _joined([(p - r["b"], p - r["a"] + length) for p in at for r in runs])] for at, runs in zip(batch.column("at").to_pylist(), batch.column("runs").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("t1"), batch.column("t2"), pa.array(spans, _SPANS)], names=["t1", "t2", "spans"])

    return run


def hot_spans(found: DataFrame, length: int, gram: int) -> DataFrame:
    """(t1, t2, spans) from the rows of ``hot_contexts``. No group is whole in one task beyond MOST different contexts."""
    longs = lambda *names: ", ".join(f"{c} long" for c in names)
    run_type = "array<struct<a:long,b:long>>"
    found = written(found)
    # copies of a text are one text
    at = written(found.groupBy("anchor", "c1", "c2", "t1", "t2").agg(F.first("at").alias("at")))
    many = at.groupBy("c1", "c2").agg(F.sum(F.size("at").cast("long")).alias("n"))
    each = found.groupBy("anchor", "c1", "c2").agg(F.first("lead").alias("lead"), F.first("bytes").alias("bytes")).join(many, ["c1", "c2"])
    each = written(each)
    wide = stable(each.groupBy("anchor").agg(F.count(F.lit(1)).alias("_k")).where(F.col("_k") > MOST).select("anchor"))
    narrow = each.join(wide, "anchor", "left_anti").repartition("anchor").sortWithinPartitions("anchor")
    runs = narrow.mapInArrow(sorted_contexts(length), f"c1 long, c2 long, runs {run_type}")
    if wide.limit(1).count():
        wide_each = each.join(wide, "anchor", "left_semi")
        parts = written(wide_each.select("c1", "c2", "n", "lead", "bytes").mapInArrow(pieces(length, gram), longs(*_PIECE_NAMES)))
        kinds = parts.groupBy("k1", "k2", "e1", "e2").agg(F.sum("n").alias("n"), F.first("lo").alias("lo"), F.first("hi").alias("hi"), F.min(F.struct("c1", "c2")).alias("_one"))
        kinds = stable(kinds)
        mixed = kinds.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("_k")).where("_k > 1").select("k1", "k2")
        whole = kinds.where("n > 1").select("e1", "e2", F.array(F.struct(F.col("lo").alias("a"), F.col("hi").alias("b"))).alias("runs"))
        open_ = kinds.join(mixed, ["k1", "k2"], "left_semi").select("e1", "e2", "n", "lo", "hi", "_one.c1", "_one.c2")
        strings = open_.join(each.select("c1", "c2", "lead", "bytes"), ["c1", "c2"]).mapInArrow(single_strings(length), longs("e1", "e2", "j", "w1", "w2", "n"))
        strings = written(strings)
        twice = strings.groupBy("w1", "w2").agg(F.sum("n").alias("_n")).where("_n > 1").select("w1", "w2")
        single = strings.join(twice, ["w1", "w2"]).groupBy("e1", "e2").agg(F.collect_set(F.struct(F.col("j").alias("a"), F.col("j").alias("b"))).alias("runs"))
        of_piece = whole.unionByName(single).groupBy("e1", "e2").agg(F.flatten(F.collect_list("runs")).alias("runs"))
        of_wide = parts.select("c1", "c2", "e1", "e2").join(of_piece, ["e1", "e2"]).groupBy("c1", "c2").agg(F.flatten(F.collect_list("runs")).alias("runs"))
        runs = runs.unionByName(of_wide.mapInArrow(merged_runs, f"c1 long, c2 long, runs {run_type}"))
    return at.select("c1", "c2", "t1", "t2", "at").join(written(runs), ["c1", "c2"]).select("t1", "t2", "at", "runs").mapInArrow(placed_runs(length), f"t1 long, t2 long, spans {_SPANS_SQL}")


def _keys(id_col: str, text_col: str) -> list[Column]:
    """128 bits of the text, and 128 bits of the row."""
    text, own = F.coalesce(F.col(text_col), F.lit("")), F.coalesce(F.col(id_col).cast("string"), F.lit("\x00"))
    return [F.xxhash64(text).alias("_t1"), F.xxhash64(F.lit("t"), text).alias("_t2"), F.xxhash64(own, text).alias("_r1"), F.xxhash64(F.lit("r"), own, text).alias("_r2")]


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text", texts: bool = False) -> DataFrame:
    """Per row: id, n_bytes, n_removed, n_spans, kept_sha256 and, if ``texts``, spans (start, end) and kept (bytes).

    Every byte goes that lies in a string of ``length`` bytes which also starts elsewhere, overlaps included. Null texts are empty;
    texts shorter than ``length`` stay; repeated rows repeat each other; other columns are left out.
    """
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"), *_keys(id_col, text_col))
    kind = dict(rows.dtypes)["_id"]
    keys = ["_t1", "_t2", "_r1", "_r2"]
    # copies of a whole text are settled by their count; one row stands for the text
    alike = rows.groupBy("_t1", "_t2").agg(F.min(F.struct("_r1", "_r2")).alias("_first"), F.count(F.lit(1)).alias("_copies"))
    alike = alike.select("_t1", "_t2", "_first._r1", "_first._r2", "_copies")

    def anchor_rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in chunks(batches, "_text"):
            buf = TextBuffer(piece.column("_text"))
            pos, h = pick_anchors(buf, length, gram)
            own = buf.owner(pos)
            yield pa.RecordBatch.from_pydict({"anchor": h.view(np.int64), "_t1": piece.column("_t1").to_numpy()[own], "_t2": piece.column("_t2").to_numpy()[own], "pos": pos - buf.offsets[own]})

    found = rows.where(F.octet_length("_text") >= length).select("_text", "_t1", "_t2").mapInArrow(anchor_rows, "anchor long, _t1 long, _t2 long, pos long")
    # both sides of the join below are plain tables, so that Spark can split a hot anchor's rows
    found = stable(found)
    place = F.struct("_t1", "_t2", "pos")
    twice = found.groupBy("anchor").agg(F.min(place).alias("_a"), F.max(place).alias("_b"), F.count(F.lit(1)).alias("_n")).where("_a <> _b").select("anchor", (F.col("_n") > HOT).alias("hot"))
    twice = stable(twice)
    dealt = rows.select("_id", "_text", *keys)

    def texts_of(anchors: DataFrame) -> DataFrame:
        at = found.join(anchors, "anchor").groupBy("_t1", "_t2").agg(F.collect_set(F.struct("pos", "anchor")).alias("_at"))
        return dealt.join(at.join(alike, ["_t1", "_t2"]).select(*keys, "_at"), keys).select("_id", "_text", "_t1", "_t2", "_at")

    around = texts_of(twice.where("not hot")).mapInArrow(contexts(length, gram), _CONTEXT)
    spans = around.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(covered(length), f"t1 long, t2 long, spans {_SPANS_SQL}")
    hot = twice.where("hot").select("anchor")
    if many := hot.count():
        wanted = "anchor long, c1 long, c2 long, lead long, bytes binary, n long, t1 long, t2 long, at array<long>"
        if many <= BROADCAST_ANCHORS:
            known = docs.sparkSession.sparkContext.broadcast(np.sort(hot.toArrow().column("anchor").to_numpy()))
            places = rows.where(F.octet_length("_text") >= length).select("_text", "_t1", "_t2").mapInArrow(hot_contexts(length, gram, known), wanted)
        else:
            places = texts_of(hot).mapInArrow(hot_contexts(length, gram, None), wanted)
        spans = spans.unionByName(hot_spans(places, length, gram))
    spans = spans.groupBy(F.col("t1").alias("_t1"), F.col("t2").alias("_t2")).agg(F.flatten(F.collect_list("spans")).alias("_spans"))
    known = alike.join(spans, ["_t1", "_t2"], "left")

    def finish(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in chunks(batches, "_text"):
            names = ["_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "kept"]
            out: dict[str, list] = {k: [] for k in names[1:]}
            for text, copies, cuts in zip(piece.column("_text").cast(pa.binary()).to_pylist(), piece.column("_copies").to_pylist(), piece.column("_spans").to_pylist(), strict=True):
                if copies != 1:  # a copy of a whole text; rows that stand for no text find no count
                    runs = [[0, len(text)]] if len(text) >= length else []
                else:
                    runs = _joined([(c["start"], c["end"]) for c in cuts or ()])
                edges = [0, *(x for r in runs for x in r), len(text)]
                kept = b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)) if runs else text
                for name, value in zip(names[1:], (len(text), len(text) - len(kept), len(runs), hashlib.sha256(kept).hexdigest(), [{"start": a, "end": b} for a, b in runs], kept), strict=True):
                    out[name].append(value)
            arrays = [piece.column("_id"), *(pa.array(out[k], pa.int64()) for k in names[1:4]), pa.array(out["kept_sha256"], pa.string())]
            if texts:
                arrays += [pa.array(out["spans"], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(out["kept"], pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, names=names[: len(arrays)])

    schema = f"_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", spans array<struct<start:long,end:long>>, kept binary" * texts
    done = dealt.join(known, keys, "left").select("_id", "_text", "_copies", "_spans").mapInArrow(finish, schema)
    return done.withColumnRenamed("_id", id_col)


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))
