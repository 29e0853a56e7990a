"""Benchmark decontamination: a generalised suffix automaton of the normalised test items.

The automaton's words are vocabulary numbers. Texts are cut into runs of vocabulary words, and all
runs of a batch stream through it in step, as arrays, each keeping the longest suffix that matches
some item. Where that suffix is as long as a window, the window occurs and its words are hit.
"""

from __future__ import annotations

import math
from array import array
from collections import defaultdict
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glimt.llm.common import quoted, table
from glimt.llm.hashtable import HashTable
from glimt.llm.textbuf import TextBuffer, chunks

WINDOW = 10
#: Item text that one automaton holds; more items are matched in as many passes as it takes.
AUTOMATON_BYTES = 4 << 20
#: The pipeline drops a document of which at least this share of words is hit, and cuts the hit words out of others.
MAX_COVERAGE = 0.5
_STRIDE = 256

_IS_WORD = np.zeros(256, bool)
_IS_WORD[0x30:0x3A] = _IS_WORD[0x61:0x7B] = _IS_WORD[0x80:] = True


def words(buf: TextBuffer) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends, texts and hashes of `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` with A-Z lower-cased."""
    buf.lower_ascii()
    starts, ends = buf.spans(_IS_WORD[buf.data])
    return starts, ends, buf.owner(starts), buf.hashes(starts, ends)


class SuffixAutomaton:
    """All substrings of all items; a state holds the substrings that end at the same places."""

    def __init__(self, items: list[tuple[str, list[int]]], window: int) -> None:
        self.window = window
        # edges by (state, word); the words of a state are a linked list, as most states have one edge
        edges: dict[int, int] = {}
        first, word_of, following = array("q", [-1]), array("q"), array("q")
        link, longest = array("q", [-1]), array("q", [0])

        def state(length: int, up: int) -> int:
            first.append(-1)
            link.append(up)
            longest.append(length)
            return len(link) - 1

        def join(at: int, word: int, to: int) -> None:
            if (at << 32 | word) not in edges:
                word_of.append(word)
                following.append(first[at])
                first[at] = len(word_of) - 1
            edges[at << 32 | word] = to

        def split(at: int, word: int, to: int) -> int:
            """The state for the shorter substrings of ``to`` that ``at`` leads to by ``word``."""
            if longest[to] == longest[at] + 1:
                return to
            new, edge = state(longest[at] + 1, link[to]), first[to]
            while edge >= 0:
                join(new, word_of[edge], edges[to << 32 | word_of[edge]])
                edge = following[edge]
            link[to] = new
            while at >= 0 and edges.get(at << 32 | word) == to:
                edges[at << 32 | word] = new
                at = link[at]
            return new

        for _, tokens in items:
            last = 0
            for word in tokens:
                if (to := edges.get(last << 32 | word)) is not None:
                    last = split(last, word, to)
                    continue
                new, at = state(longest[last] + 1, 0), last
                while at >= 0 and (at << 32 | word) not in edges:
                    join(at, word, new)
                    at = link[at]
                if at >= 0:
                    link[new] = split(at, word, edges[at << 32 | word])
                last = new

        self.link, self.longest = np.array(link), np.array(longest)
        keys = np.fromiter(edges.keys(), np.uint64, len(edges))
        self.edges = HashTable(keys, np.fromiter(edges.values(), np.int64, len(edges)), np.int64)
        # the ancestor whose substrings include the one of exactly `window` words
        self.at_window = np.zeros(len(link), np.int64)
        for v in np.argsort(self.longest, kind="stable").tolist():
            if longest[v] >= window:
                self.at_window[v] = v if longest[link[v]] < window else self.at_window[link[v]]
        self.names = [name for name, _ in items]
        owned: set[int] = set()  # state and item in one number
        own_short: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for i, (_, tokens) in enumerate(items):
            at = 0
            for k, word in enumerate(tokens):
                at = edges[at << 32 | word]
                while longest[link[at]] >= k + 1:
                    at = link[at]
                if k + 1 >= window:
                    owned.add(int(self.at_window[at]) << 32 | i)
            if 0 < len(tokens) < window:
                own_short[at].append((len(tokens), i))
        self._owned = np.sort(np.fromiter(owned, np.int64, len(owned)))
        # short items that end wherever a state's longest substring ends
        self.short: dict[int, list[tuple[int, int]]] = {}
        for v in np.argsort(self.longest, kind="stable")[1:]:
            if both := [*own_short.get(int(v), []), *self.short.get(link[v], [])]:
                self.short[int(v)] = both
        self.has_short = np.zeros(len(link), bool)
        self.has_short[list(self.short)] = True
        self.least = min([window, *(len(t) for _, t in items if t)], default=window)

    def owners(self, state: int) -> list[str]:
        """The items that hold the window of a state."""
        a, b = np.searchsorted(self._owned, [state << 32, (state + 1) << 32])
        return [self.names[i] for i in (self._owned[a:b] & 0xFFFFFFFF).tolist()]

    def step(self, states: np.ndarray, tokens: np.ndarray) -> np.ndarray:
        """The next state, or -1."""
        row = self.edges.find((states.astype(np.uint64) << np.uint64(32)) | tokens.astype(np.uint64))
        return np.where(row >= 0, self.edges.values[row], -1) if len(self.edges.values) else row

    def stream(self, tokens: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """State and match length after each token of the runs [start, end); lengths are exact up to the window.

        Long runs are cut; each part begins ``window - 1`` tokens early, which is all that a match of a window can need.
        """
        state_at, length_at = np.zeros(len(tokens), np.int64), np.zeros(len(tokens), np.int64)
        parts = -(-(ends - starts) // _STRIDE)
        nth = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        real = np.repeat(starts, parts) + nth * _STRIDE
        begin = np.maximum(real - (self.window - 1), np.repeat(starts, parts))
        end = np.minimum(real + _STRIDE, np.repeat(ends, parts))
        order = np.argsort(begin - end, kind="stable")
        begin, end, real = begin[order], end[order], real[order]
        state, length, size = np.zeros(len(begin), np.int64), np.zeros(len(begin), np.int64), end - begin
        for t in range(int(size[0]) if len(size) else 0):
            live = int(np.searchsorted(-size, -t, "left"))
            at = begin[:live] + t
            word = tokens[at]
            s, n = state[:live], length[:live]
            to = self.step(s, word)
            lost = np.flatnonzero((to < 0) & (s > 0))
            while len(lost):
                s[lost] = self.link[s[lost]]
                n[lost] = self.longest[s[lost]]
                to[lost] = self.step(s[lost], word[lost])
                lost = lost[(to[lost] < 0) & (s[lost] > 0)]
            found = to >= 0
            state[:live] = np.where(found, to, 0)
            length[:live] = np.where(found, n + 1, 0)
            due = at >= real[:live]
            state_at[at[due]], length_at[at[due]] = state[:live][due], length[:live][due]
        return state_at, length_at


class Matcher:
    """The automaton with the vocabulary of its items."""

    def __init__(self, items: list[tuple[str, str]], window: int = WINDOW) -> None:
        buf = TextBuffer(pa.array([text for _, text in items], pa.string()))
        _, _, owner, hashes = words(buf)
        self.vocabulary = np.unique(hashes)
        self.table = HashTable(self.vocabulary, np.arange(len(self.vocabulary)), np.int64)
        numbers = self.table.find(hashes)
        cuts = np.searchsorted(owner, np.arange(len(items) + 1))
        self.automaton = SuffixAutomaton([(name, numbers[cuts[i] : cuts[i + 1]].tolist()) for i, (name, _) in enumerate(items)], window)

    def hits(self, owner: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, dict[int, set[str]]]:
        """Which words are hit, and for each text with hits the items whose windows occur."""
        a, hit, found = self.automaton, np.zeros(len(hashes) + 1, np.int64), defaultdict(set)
        numbers = self.table.find(hashes)
        known = np.concatenate([[False], numbers >= 0, [False]])
        same = np.concatenate([[False], owner[1:] == owner[:-1], [False]])  # word i and the one before it are of one text
        starts = np.flatnonzero(known[1:-1] & ~(known[:-2] & same[:-1]))
        ends = np.flatnonzero(known[1:-1] & ~(known[2:] & same[1:])) + 1
        use = ends - starts >= a.least
        state, length = a.stream(np.maximum(numbers, 0), starts[use], ends[use])
        for p in np.flatnonzero(length >= a.window):
            hit[p - a.window + 1] += 1
            hit[p + 1] -= 1
            found[int(owner[p])].update(a.owners(int(a.at_window[state[p]])))
        for p in np.flatnonzero(a.has_short[state] & (length > 0)):
            for size, item in a.short[int(state[p])]:
                if size <= length[p]:
                    hit[p - size + 1] += 1
                    hit[p + 1] -= 1
                    found[int(owner[p])].add(a.names[item])
        return np.cumsum(hit[:-1]) > 0, found


def matchers(items: DataFrame, id_col: str = "item_id", text_col: str = "text", window: int = WINDOW, limit: int = AUTOMATON_BYTES) -> list[Broadcast]:
    """One matcher for each ``limit`` bytes of items, so that none that is broadcast grows with the table.

    They are built one after the other; the driver keeps none after it is broadcast.
    """
    rows = items.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("name"), F.col(text_col).alias("text")).where("text is not null").distinct()
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, math.ceil(total / limit))
    part = F.pmod(F.xxhash64("name", "text"), F.lit(blocks))
    context = items.sparkSession.sparkContext
    return [context.broadcast(Matcher(sorted((r["name"], r["text"]) for r in rows.where(part == k).collect()), window)) for k in range(blocks)]


_FOUND = "n_words long, items array<string>, spans array<struct<first:long,end:long>>"


def passes(rows: DataFrame, found: list[Broadcast], then: Callable[[pa.RecordBatch], pa.RecordBatch] | None = None, then_schema: str = "") -> DataFrame:
    """The rows, of columns ``_text`` and others, with n_words, items (names in order) and spans of the maximal hit runs over all passes.

    Every pass looks at the whole text and adds to what the passes before it found. ``then`` turns what the last pass gives into
    columns of ``then_schema``, in the worker of that pass: a task with one pass more would hold one Python worker more.
    """
    kept = [c for c, _ in rows.dtypes]
    schema = "".join(f"{c} {kind}, " for c, kind in rows.dtypes) + _FOUND
    rows = rows.select("*", F.lit(0).cast("long").alias("n_words"), F.array().cast("array<string>").alias("items"), F.array().cast("array<struct<first:long,end:long>>").alias("spans"))

    def one_pass(shared, last):
        def run(batches):
            for piece in chunks(batches, "_text"):
                buf = TextBuffer(piece.column("_text"))
                _, _, owner, hashes = words(buf)
                hit, names = shared.value.hits(owner, hashes)
                first_word = np.searchsorted(owner, np.arange(buf.n + 1))
                items, spans = piece.column("items").to_pylist(), piece.column("spans").to_pylist()
                for i, known in enumerate(spans):  # from the passes before
                    for s in known or ():
                        hit[first_word[i] + s["first"] : first_word[i] + s["end"]] = True
                items = [sorted({*(old or ()), *names.get(i, ())}) for i, old in enumerate(items)]
                spans = [[] for _ in range(buf.n)]
                for i in set(owner[hit].tolist()):
                    own = np.concatenate([[False], hit[first_word[i] : first_word[i + 1]], [False]])
                    edge = np.flatnonzero(own[1:] != own[:-1])
                    spans[i] = [{"first": int(a), "end": int(b)} for a, b in zip(edge[::2], edge[1::2], strict=True)]
                arrays = [pa.array(np.diff(first_word)), pa.array(items, pa.list_(pa.string())), pa.array(spans, pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())])))]
                out = pa.RecordBatch.from_arrays([*(piece.column(c) for c in kept), *arrays], names=[*kept, "n_words", "items", "spans"])
                yield then(out) if last and then else out

        return run

    for k, m in enumerate(found):
        last = k == len(found) - 1
        rows = rows.mapInArrow(one_pass(m, last), then_schema if last and then else schema)
    return rows


def find(docs: DataFrame, found: list[Broadcast], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_words, n_hit, items (names in order) and spans (first word, end word) of the maximal hit runs.

    A null or empty text has no words. Repeated rows give repeated results; other columns are left out.
    """
    rows = passes(docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")), found)
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["first"])
    return rows.select(F.col("_id").alias(id_col), "n_words", n_hit.alias("n_hit"), "items", "spans")


def clean(docs: DataFrame, found: list[Broadcast], max_coverage: float = MAX_COVERAGE, text_col: str = "text") -> DataFrame:
    """The rows with all their columns, hit runs cut out of their texts; rows hit over ``max_coverage`` or more are dropped.

    A hit run goes from its first word's first byte to its last word's last; a column ``n_chars`` follows the new text.
    Coverage is judged and runs are cut once, after all passes.
    """
    names = ["_text" if c == text_col else f"_{i}" for i, c in enumerate(docs.columns)]
    rows = docs.select(*(quoted(c).alias(n) for c, n in zip(docs.columns, names, strict=True)))

    def cut(piece):
        column, spans = piece.column("_text"), piece.column("spans").to_pylist()
        marked = [i for i, s in enumerate(spans) if s]
        texts, keep = column.to_pylist(), np.ones(piece.num_rows, bool)
        if marked:
            buf = TextBuffer(column)
            raw = buf.data
            starts, ends, owner, _ = words(buf)
            first_word = np.searchsorted(owner, np.arange(buf.n + 1))
        for i in marked:
            n_hit = sum(s["end"] - s["first"] for s in spans[i])
            keep[i] = n_hit / (first_word[i + 1] - first_word[i]) < max_coverage
            at, parts = int(buf.offsets[i]), []
            for s in spans[i]:
                parts.append(raw[at : starts[first_word[i] + s["first"]]])
                at = int(ends[first_word[i] + s["end"] - 1])
            parts.append(raw[at : buf.offsets[i + 1]])
            texts[i] = np.concatenate(parts).tobytes().decode("utf-8")
        arrays = [pa.array(texts, column.type) if n == "_text" else piece.column(n) for n in names]
        return pa.RecordBatch.from_arrays(arrays, names=names).filter(pa.array(keep))

    schema = ", ".join(f"{c} {kind}" for c, kind in rows.dtypes)
    out = passes(rows, found, cut, schema)
    out = out.select(*(F.col(n).alias(c) for c, n in zip(docs.columns, names, strict=True)))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length(text_col).cast(dict(docs.dtypes)["n_chars"])).select(*map(quoted, docs.columns))
    return out


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(table(spark, sf_dir, "documents"), matchers(table(spark, sf_dir, "benchmark")))
    names = F.array_sort("items")
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", names), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))
