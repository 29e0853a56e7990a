"""Quality rules: gradient-boosted trees over document statistics.

``statistics`` reads whole texts in Arrow batches and gives exact counts; ``fit`` grows histogram
trees with monotonic constraints on a bounded labelled sample and flattens them into node arrays;
``score`` walks all rows of a batch through those arrays at once.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glimt.llm.common import bounded, table
from glimt.llm.textbuf import LEAD, NOT_SPACE, TextBuffer, mix, per_document

#: Features, and the direction in which each may move the score (0: free).
FEATURES = {
    "log_words": 0, "word_length": 0, "symbols_per_word": -1, "dup_line_share": -1, "repeat_share": -1,
    "upper_share": -1, "digit_share": 0, "punct_share": 0, "distinct_share": 0, "words_per_line": 0, "exclaim_share": -1,
}
#: Labelled rows used to fit the trees, at most about this many.
TRAIN_ROWS = 20_000
#: Share of good labelled rows that must keep their verdict.
RECALL = 0.999

_SYMBOL, _UPPER, _DIGIT, _PUNCT = (np.zeros(256, bool) for _ in range(4))
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_UPPER[65:91] = True
_DIGIT[48:58] = True
_PUNCT[[ord(c) for c in ".,;:?"]] = True


def _windows(owner: np.ndarray, words: np.ndarray, width: int) -> np.ndarray:
    """Marks each word that lies in a window of ``width`` words found twice or more in its text."""
    hit = np.zeros(len(words), bool)
    n = len(words) - width + 1
    if n <= 0:
        return hit
    key = mix(owner[:n].astype(np.uint64) + np.uint64(1))
    for k in range(width):
        key = mix(key * np.uint64(0x100000001B3) + words[k : k + n])
    at = np.flatnonzero(owner[:n] == owner[width - 1 :])
    order = at[np.argsort(key[at], kind="stable")]
    same = key[order[1:]] == key[order[:-1]]
    again = np.zeros(n + 1, np.int64)
    again[order[1:][same]] = 1
    again[order[:-1][same]] = 1
    for k in range(width):
        hit[k : k + n] |= again[:n] > 0
    return hit


def document_statistics(buf: TextBuffer) -> dict[str, np.ndarray]:
    """Exact counts per text, and the features made of them."""
    data = buf.data
    starts, ends = buf.spans(NOT_SPACE[data])
    owner = buf.owner(starts)
    n_words = buf.counts(owner)
    total = lambda marks: np.diff(np.concatenate([[0], np.cumsum(marks, dtype=np.int64)])[buf.offsets])
    word_chars = total(LEAD[data] & NOT_SPACE[data])
    n_symbols = total(_SYMBOL[data])
    words = buf.hashes(starts, ends)
    repeated = _windows(owner, words, 5)
    line_from, line_to = buf.spans(data != 10)
    if len(starts):
        nth = np.searchsorted(starts, line_from)
        full = (nth < len(starts)) & (starts[np.minimum(nth, len(starts) - 1)] < line_to)
        line_from, line_to = line_from[full], line_to[full]
    else:
        line_from = line_to = starts
    line_owner = buf.owner(line_from)
    n_lines = buf.counts(line_owner)
    key = mix(buf.hashes(line_from, line_to) + mix(line_owner.astype(np.uint64) + np.uint64(7)))
    _, first = np.unique(key, return_index=True)
    n_dup = n_lines - buf.counts(line_owner[first])
    word_key = mix(words + mix(owner.astype(np.uint64) + np.uint64(11)))
    _, first = np.unique(word_key, return_index=True)
    distinct = buf.counts(owner[first])
    n_repeat = buf.counts(owner, repeated)
    w, chars = np.maximum(n_words, 1), np.maximum(word_chars, 1)
    return {
        "n_words": n_words, "word_chars": word_chars, "n_symbols": n_symbols, "n_dup_lines": n_dup, "n_repeat_words": n_repeat,
        "features": np.column_stack([
            np.log1p(n_words), word_chars / w, n_symbols / w, n_dup / np.maximum(n_lines, 1), n_repeat / w, total(_UPPER[data]) / chars,
            total(_DIGIT[data]) / chars, total(_PUNCT[data]) / w, distinct / w, n_words / np.maximum(n_lines, 1), total(data == 33) / w,
        ]),
    }


@dataclass
class Trees:
    """Flat node arrays: node i of tree t sends a row to ``left`` or ``right`` by ``feature`` and ``cut``; leaves point to themselves."""

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    base: float
    depth: int
    threshold: float = 0.0

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for t in range(len(self.feature)):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                low = x[rows, self.feature[t][node]] <= self.cut[t][node]
                node = np.where(low, self.left[t][node], self.right[t][node])
            total += self.value[t][node]
        return 1 / (1 + np.exp(-total))


def fit_trees(x: np.ndarray, y: np.ndarray, signs: list[int], trees: int = 60, depth: int = 4, rate: float = 0.15, bins: int = 64, least: int = 20, l2: float = 1.0) -> Trees:
    """Logistic boosting on histograms. A split on a signed feature must order its two sides by the sign, and
    the values below it are bounded by their middle, so that each tree, and the sum, is monotonic there."""
    n, width = x.shape
    size = 2 ** (depth + 1) - 1
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) if n else np.zeros(0) for f in range(width)]
    binned = np.column_stack([np.searchsorted(edges[f], x[:, f], "left") for f in range(width)])
    p = min(max(y.mean() if n else 0.5, 1e-3), 1 - 1e-3)
    base = float(np.log(p / (1 - p)))
    margin, out = np.full(n, base), []
    for _ in range(trees if 0 < y.sum() < n else 0):
        q = 1 / (1 + np.exp(-margin))
        g, h = q - y, q * (1 - q)
        feature, cut, value = np.zeros(size, np.int64), np.full(size, np.inf), np.zeros(size)
        left, right = np.arange(size), np.arange(size)
        where, bounds = np.zeros(n, np.int64), {0: (-np.inf, np.inf)}
        for node in range(size):
            if node not in bounds:
                continue
            low, high = bounds[node]
            mine = where == node
            sum_g, sum_h = g[mine].sum(), h[mine].sum()
            value[node] = np.clip(-sum_g / (sum_h + l2), low, high) * rate
            if 2 * node + 2 >= size or mine.sum() < 2 * least:
                continue
            best = (1e-6, None)
            for f in range(width):
                if not len(edges[f]):
                    continue
                hist = lambda w, f=f: np.cumsum(np.bincount(binned[mine, f], w, len(edges[f]) + 1))[:-1]
                gl, hl, nl = hist(g[mine]), hist(h[mine]), hist(None)
                vl, vr = np.clip(-gl / (hl + l2), low, high), np.clip(-(sum_g - gl) / (sum_h - hl + l2), low, high)
                gain = gl**2 / (hl + l2) + (sum_g - gl) ** 2 / (sum_h - hl + l2) - sum_g**2 / (sum_h + l2)
                gain[(nl < least) | (mine.sum() - nl < least) | (signs[f] * (vr - vl) < 0)] = -1
                k = int(np.argmax(gain))
                if gain[k] > best[0]:
                    best = (gain[k], (f, k, vl[k], vr[k]))
            if best[1] is None:
                continue
            f, k, vl, vr = best[1]
            feature[node], cut[node], left[node], right[node] = f, edges[f][k], 2 * node + 1, 2 * node + 2
            middle = (vl + vr) / 2
            bounds[2 * node + 1] = (low, min(high, middle)) if signs[f] > 0 else (max(low, middle), high) if signs[f] < 0 else (low, high)
            bounds[2 * node + 2] = (max(low, middle), high) if signs[f] > 0 else (low, min(high, middle)) if signs[f] < 0 else (low, high)
            where[mine] = np.where(binned[mine, f] <= k, 2 * node + 1, 2 * node + 2)
        margin += value[where]
        out.append((feature, cut, left, right, value))
    stacked = [np.array([t[k] for t in out]) if out else np.zeros((0, size)) for k in range(5)]
    return Trees(*stacked, base, depth)


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, recall: float = RECALL, id_col: str = "doc_id", text_col: str = "text") -> Trees:
    """Fit on a bounded sample of labelled rows; the threshold keeps ``recall`` of the good rows scored out of fold.

    Rows without a label, and labels without a row, are not used; without both classes every row scores alike and none is rejected.
    """
    known = labels.select(F.col(id_col).alias("_id"), F.col("quality").cast("double").alias("_y")).where("_id is not null and _y is not null").groupBy("_id").agg(F.min("_y").alias("_y"))
    sample = F.broadcast(bounded(known, F.col("_id"), rows))  # at most about `rows` ids
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(sample, "_id")
    names = [f"f{k}" for k in range(len(FEATURES))]

    def features(piece: pa.RecordBatch) -> dict:
        x = document_statistics(TextBuffer(piece.column("_text")))["features"]
        return {"_id": piece.column("_id"), "_y": piece.column("_y")} | {c: x[:, k] for k, c in enumerate(names)}

    got = texts.mapInArrow(per_document(features, "_text"), f"_id {dict(texts.dtypes)['_id']}, _y double, " + ", ".join(f"{c} double" for c in names))
    # one row an id, so that what the driver gets is as bounded as the sample
    got = got.groupBy("_id").agg(F.min(F.struct("_y", *names)).alias("_f")).select("_id", "_f.*").orderBy("_id").toPandas()
    x, y, signs = got[names].to_numpy(float), (got["_y"].to_numpy(float) > 0).astype(float), list(FEATURES.values())
    model = fit_trees(x, y, signs)
    if 0 < y.sum() < len(y) and len(y) >= 40:
        out_of_fold = np.zeros(len(y))
        for k in range(3):
            part = np.arange(len(y)) % 3 == k
            out_of_fold[part] = fit_trees(x[~part], y[~part], signs).score(x[part])
        good = np.sort(out_of_fold[y > 0])
        model.threshold = min(float(good[int((1 - recall) * len(good))]), 0.5)
    return model


def apply(docs: DataFrame, model: Trees, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, exact counts, ``base_failed``, the trees' ``score`` and ``kept``.

    A null or empty text has no words and fails the base rule; repeated rows give repeated results; other columns are left out.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def judge(piece: pa.RecordBatch) -> dict:
        stats = document_statistics(TextBuffer(piece.column("_text")))
        failed = (stats["n_words"] < 10) | (100 * stats["n_repeat_words"] > 20 * stats["n_words"])
        score = shared.value.score(stats.pop("features"))
        return {id_col: piece.column("_id")} | stats | {"base_failed": failed, "score": score, "kept": ~failed & (score >= shared.value.threshold)}

    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    counts = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
    return rows.mapInArrow(per_document(judge, "_text"), f"`{id_col}` {dict(rows.dtypes)['_id']}, {counts}, base_failed boolean, score double, kept boolean")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return apply(docs, fit(docs, table(spark, sf_dir, "labels")))
