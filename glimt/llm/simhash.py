"""SimHash near-duplicates by anchor-point covering.

The anchors of each 32-bit half of a fingerprint are the words of a covering code: the perfect
[31, 26] Hamming code (covering radius 1) with the 32nd bit kept as it is. Fingerprints at 3 or
fewer differing bits have a half that differs in at most one bit, so they meet at an anchor: one is
at home there (its nearest anchor, within radius 1), the other visits (all anchors within radius
plus threshold, 1 + 1). Each anchor compares its visitors with its residents exactly and passes on
a spanning star for each group it finds, so groups of any size yield few rows and lose no link.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glimt.llm.common import keep_rows, row_keys, stable, table
from glimt.llm.components import components
from glimt.llm.textbuf import NOT_SPACE, TextBuffer, chunks

THRESHOLD = 3
#: The most bits at which the anchors lose no link.
REACH = 3
SHINGLE = 3
#: Fingerprints of an anchor compared at once.
_BLOCK = 2048


def fingerprints(texts: pa.Array, shingle: int = SHINGLE) -> np.ndarray:
    """64 bits a text: a bit is set if it is set in over half of the hashes of its word shingles. No words: zero."""
    buf = TextBuffer(texts).lower_ascii()
    starts, ends = buf.spans(NOT_SPACE[buf.data])
    cuts = np.searchsorted(buf.owner(starts), np.arange(buf.n + 1))
    out = np.zeros(buf.n, np.uint64)
    # words joined by single spaces: shingle k is the bytes from its first word's start to its last word's end
    size = ends - starts
    to = np.cumsum(size + 1) - 1
    joined = np.full(int(to[-1]) + 1 if len(to) else 0, 32, np.uint8)
    inside = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    joined[np.repeat(to - size, size) + inside] = buf.data[np.repeat(starts, size) + inside]
    raw, first, last = joined.tobytes(), (to - size).tolist(), to.tolist()
    digest = xxhash.xxh64_intdigest
    for i in range(buf.n):
        lo, hi = int(cuts[i]), int(cuts[i + 1])
        if lo == hi:
            continue
        if hi - lo < shingle:
            out[i] = digest(raw[first[lo] : last[hi - 1]], 42)
            continue
        h = np.array([digest(raw[a:b], 42) for a, b in zip(first[lo : hi - shingle + 1], last[lo + shingle - 1 : hi], strict=True)], np.uint64)
        ones = np.zeros(64, np.int64)
        for k in range(0, len(h), 4096):
            ones += np.unpackbits(h[k : k + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        out[i] = np.packbits((ones * 2 > len(h)).astype(np.uint8), bitorder="little").view(np.uint64)[0]
    return out


def _syndrome() -> np.ndarray:
    """Of the 31-bit Hamming code, for each byte of a word: bit k (from 0) stands at position k + 1."""
    out = np.zeros((4, 256), np.uint32)
    for part in range(4):
        for value in range(256):
            for bit in range(8):
                if value >> bit & 1 and 8 * part + bit < 31:
                    out[part, value] ^= 8 * part + bit + 1
    return out


_SYNDROME = _syndrome()


def anchors(half: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """(which rows, anchor, whether it is their home) for 32-bit words: every anchor within distance 2, with bit 31 counted too."""
    half = half.astype(np.uint32)
    s = _SYNDROME[0][half & 255] ^ _SYNDROME[1][half >> 8 & 255] ^ _SYNDROME[2][half >> 16 & 255] ^ _SYNDROME[3][half >> 24]
    bit = lambda p: np.where(p > 0, np.uint32(1) << (np.maximum(p, 1) - np.uint32(1)), np.uint32(0)).astype(np.uint32)
    rows = np.arange(len(half))
    home = half ^ bit(s)
    yield rows, home, True
    yield rows, home ^ np.uint32(1 << 31), False
    for p in range(1, 32):  # two flips at positions p < q with p ^ q equal to the syndrome
        q = s ^ np.uint32(p)
        at = np.flatnonzero((s > 0) & (q > p))
        yield at, half[at] ^ np.uint32(1 << (p - 1)) ^ bit(q[at]), False


def meeting_points(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (anchor, fp, home) of each fingerprint; the anchor's 33rd bit tells the half."""
    for batch in batches:
        fp = batch.column("fp").to_numpy().view(np.uint64)
        for k in range(0, len(fp), 50_000):
            part = fp[k : k + 50_000]
            for half in range(2):
                word = (part >> np.uint64(32 * half)) & np.uint64(0xFFFFFFFF)
                for rows, anchor, home in anchors(word):
                    yield pa.RecordBatch.from_pydict({"anchor": anchor.astype(np.int64) | (half << 32), "fp": part[rows].view(np.int64), "home": np.full(len(rows), home)})


def group_links(residents: np.ndarray, visitors: np.ndarray, threshold: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Stars over all links between residents and visitors (residents visit too): (member, smallest label) pairs.

    Smallest labels spread until nothing changes; each pass compares blocks, so memory does not grow with the group.
    """
    nodes = np.unique(np.concatenate([residents, visitors]))
    label = np.arange(len(nodes))
    at_home = np.searchsorted(nodes, residents)
    while True:
        new = label.copy()
        for i in range(0, len(at_home), _BLOCK):
            own = at_home[i : i + _BLOCK]
            for j in range(0, len(nodes), _BLOCK):
                near = np.bitwise_count(nodes[own][:, None] ^ nodes[j : j + _BLOCK][None, :]) <= threshold
                cols = np.arange(j, min(j + _BLOCK, len(nodes)))
                low = np.where(near, new[cols][None, :], len(nodes)).min(axis=1)
                new[own] = np.minimum(new[own], low)
                new[cols] = np.minimum(new[cols], np.where(near, new[own][:, None], len(nodes)).min(axis=0))
        new = new[new]
        if (new == label).all():
            break
        label = new
    moved = np.flatnonzero(label != np.arange(len(nodes)))
    return [(nodes[moved], nodes[label[moved]])] if len(moved) else []


def compare_at_anchors(threshold: int):
    """For partitions sorted by anchor: compare each anchor's rows, whatever batches they come in."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = [np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, bool)]

        def work(anchor: np.ndarray, fp: np.ndarray, home: np.ndarray) -> Iterator[pa.RecordBatch]:
            edge = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
            size = np.diff(np.concatenate([edge, [len(anchor)]]))
            residents = np.add.reduceat(home, edge, dtype=np.int64)
            a, b = [], []
            # the many anchors where two meet, at once
            two = edge[(size == 2) & (residents > 0)]
            near = np.bitwise_count(fp[two] ^ fp[two + 1]) <= threshold
            a.append(fp[two][near])
            b.append(fp[two + 1][near])
            for i in np.flatnonzero((size > 2) & (residents > 0)):
                f, h = fp[edge[i] : edge[i] + size[i]], home[edge[i] : edge[i] + size[i]]
                for x, y in group_links(np.unique(f[h]), f, threshold):
                    a.append(x)
                    b.append(y)
            yield pa.RecordBatch.from_pydict({"a": np.concatenate(a).view(np.int64), "b": np.concatenate(b).view(np.int64)})

        for batch in batches:
            got = [batch.column("anchor").to_numpy(), batch.column("fp").to_numpy().view(np.uint64), batch.column("home").to_numpy(zero_copy_only=False)]
            rows = [np.concatenate(x) for x in zip(rest, got, strict=True)]
            if not len(rows[0]):
                continue
            cut = int(np.searchsorted(rows[0], rows[0][-1]))  # the last anchor may go on
            rest = [x[cut:] for x in rows]
            if cut:
                yield from work(*(x[:cut] for x in rows))
        if len(rest[0]):
            yield from work(*rest)

    return run


def link(prints: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """(a, b) with bits as longs: links that connect what is connected, of distinct ``fp``s. The anchors are exact up to REACH bits."""
    if threshold > REACH:
        raise ValueError(f"anchors of two halves lose links at more than {REACH} bits: {threshold}")
    met = prints.select("fp").distinct().mapInArrow(meeting_points, "anchor long, fp long, home boolean")
    dealt = met.repartition("anchor").sortWithinPartitions("anchor")
    return dealt.mapInArrow(compare_at_anchors(threshold), "a long, b long")


def fingerprint_rows(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None, shingle: int = SHINGLE) -> DataFrame:
    """The rows' ``keep`` columns (by position, under any name) and the column ``_fp``."""
    names = list(keep if keep is not None else docs.columns)
    rows = docs.select(F.col(text_col).alias("_text"), *(F.col(c).alias(f"_{i}") for i, c in enumerate(names)))
    kinds = dict(rows.dtypes)

    def run(batches):
        for piece in chunks(batches, "_text"):
            yield pa.RecordBatch.from_arrays([*(piece.column(f"_{i}") for i in range(len(names))), pa.array(fingerprints(piece.column("_text"), shingle).view(np.int64))], names=[*(f"_{i}" for i in range(len(names))), "_fp"])

    out = rows.mapInArrow(run, "".join(f"_{i} {kinds[f'_{i}']}, " for i in range(len(names))) + "_fp long")
    return out.select(*(F.col(f"_{i}").alias(c) for i, c in enumerate(names)), "_fp")


def classes(docs: DataFrame, threshold: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(_id, _k1, _k2: content hash, _fp) of each row, and (_fp, _class, component_id) of each fingerprint."""
    k1, k2 = row_keys(id_col, text_col)
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), k1.alias("_k1"), k2.alias("_k2"))
    prints = stable(fingerprint_rows(rows, "_text", ["_id", "_k1", "_k2"]))
    roots = components(link(prints.select(F.col("_fp").alias("fp")), threshold))
    found = prints.groupBy("_fp").agg(F.min("_id").alias("_least"))
    found = found.join(roots, F.col("_fp") == F.col("node"), "left").withColumn("_class", F.coalesce("root", "_fp"))
    least = found.groupBy("_class").agg(F.min("_least").alias("component_id"))
    return prints, found.select("_fp", "_class").join(least, "_class").select("_fp", "_class", "component_id")


def near_duplicates(docs: DataFrame, threshold: int = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, fingerprint (16 hex digits) and component_id, the smallest id that its links reach.

    Texts without words (null, empty, blank) have fingerprint zero and are linked like any other; null ids are never smallest;
    repeated rows give repeated results; other columns are left out.
    """
    prints, named = classes(docs, threshold, id_col, text_col)
    return prints.join(named, "_fp").select(F.col("_id").alias(id_col), F.lpad(F.lower(F.hex("_fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, threshold: int = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows, with all columns, of which one stays of each group of near-duplicates: the one of the smallest id (null last).

    Rows of one id fall by 128 bits of their content; of rows that agree in both one stays. Columns of any name pass through.
    """
    prints, named = classes(docs, threshold, id_col, text_col)
    first = F.struct(F.col("_id").isNull().alias("none"), "_id", "_k1", "_k2")
    stay = prints.join(named, "_fp").groupBy("_class").agg(F.min(first).alias("_stay")).select("_stay._k1", "_stay._k2")
    return keep_rows(docs, stay, id_col, text_col)


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
