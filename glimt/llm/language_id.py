"""Language ID: interpolated Kneser-Ney character models, one per language, in shared sorted hash arrays.

Counting n-grams of the training rows is a Spark aggregation. The driver turns the counts of a
bounded sample into arrays of 64-bit n-gram hashes in order, each with one log-probability per
language; executors score whole texts in numpy and take the lowest length-normalised
cross-entropy. Texts that fit no language, by limits calibrated on training rows, are rejected.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glimt.llm.common import bounded, quoted, stable, table
from glimt.llm.hashtable import HashTable
from glimt.llm.textbuf import chunks

ORDER = 4
#: Training rows per language, at most about this many (whole texts).
TRAIN_ROWS = 1_500
#: Of the sampled rows, one in so many is left out of the counts to calibrate on.
CALIBRATE = 4
#: Rejected: further above the usual cross-entropy than SLACK times this quantile of the rows left out (by their length) ...
QUANTILE, SLACK = 0.99, 1.5
#: ... and this share of the way from there to what a blind guess costs.
MARGIN = 0.3
#: Cross-entropy differences are sharpened by this many characters to give a score.
SHARPNESS = 40.0
#: Bytes of text scored at once.
PIECE = 1 << 18
UNKNOWN = "und"
_TOP = 0x33480  # code points from here on count as no letters


def _letters() -> np.ndarray:
    """Code point -> its lower-case letter below 2^16 (beyond: 0xFFFF), or a blank."""
    out = np.full(_TOP + 1, 32, np.uint64)
    for c in range(_TOP):
        if (s := chr(c)).isalpha():
            low = s.lower()
            out[c] = min(ord(low) if len(low) == 1 else c, 0xFFFF)
    return out


_tables: dict[str, np.ndarray] = {}


def characters(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbols of all texts with blanks before each, where each text's scored symbols start, how many).

    Letters are lower-cased, each run of other characters becomes one blank, and a text ends with a blank.
    """
    if "letters" not in _tables:
        _tables["letters"] = _letters()
    values = [t if t is not None else "" for t in texts.to_pylist()]
    pad = ORDER - 1
    points = np.frombuffer("".join(t + "\n" for t in values).encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.cumsum([len(t) + 1 for t in values])
    symbols = _tables["letters"][np.minimum(points, _TOP)]
    keep = symbols != 32
    keep |= np.concatenate([[True], keep[:-1]])
    starts = np.concatenate([[0], ends[:-1]])
    keep[starts] = symbols[starts] != 32
    count = np.diff(np.concatenate([[0], np.cumsum(keep)])[np.concatenate([[0], ends])])
    out = np.full(int(count.sum()) + pad * len(values), 32, np.uint64)
    first = np.cumsum(count) - count + pad * np.arange(1, len(values) + 1)
    at = np.arange(int(count.sum())) + np.repeat(pad * np.arange(1, len(values) + 1), count)
    out[at] = symbols[keep]
    return out, first, count


def grams(symbols: np.ndarray, n: int) -> np.ndarray:
    """The n-gram that ends at each symbol from the ORDER-th on, 16 bits a symbol."""
    out = np.zeros(max(0, len(symbols) - ORDER + 1), np.uint64)
    for k in range(n):
        out = (out << np.uint64(16)) | symbols[ORDER - n + k : ORDER - n + k + len(out)]
    return out


@dataclass
class Model:
    languages: list[str]
    tables: list[HashTable]  # by order: log p of an n-gram's last symbol
    gammas: list[HashTable]  # by order: log of what a context leaves to the lower order
    unseen: float
    usual: np.ndarray | None = None
    limit: np.ndarray | None = None

    def log_p(self, symbols: np.ndarray, n: int = ORDER, at: np.ndarray | None = None) -> np.ndarray:
        full = grams(symbols, n)
        key = full if at is None else full[at]
        row = self.tables[n - 1].find(key)
        out = self.tables[n - 1].values[row] if len(self.tables[n - 1].values) else np.zeros((len(key), len(self.languages)), np.float32)
        miss = np.flatnonzero(row < 0)
        if len(miss):
            where = miss if at is None else at[miss]
            if n == 1:
                # no language has the symbol: what each one's smallest model leaves, evenly
                out[miss] = self.unseen + self.gammas[0].values[self.gammas[0].find(np.zeros(1, np.uint64))[0]] if len(self.gammas[0].keys) else self.unseen
                return out
            lower = self.log_p(symbols, n - 1, where)
            context = self.gammas[n - 1].find(key[miss] >> np.uint64(16))
            known = context >= 0
            lower[known] += self.gammas[n - 1].values[context[known]]
            out[miss] = lower
        return out

    def cross_entropy(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Per text: nats a symbol for each language, and the number of symbols (0: no letter)."""
        symbols, first, count = characters(texts)
        total = np.zeros((len(texts), len(self.languages)))
        some = np.flatnonzero(count > 0)
        if len(some):
            p = self.log_p(symbols).astype(np.float64)
            sums = np.vstack([np.zeros(len(self.languages)), np.cumsum(p, axis=0)])
            lo = first[some] - (ORDER - 1)
            total[some] = sums[lo + count[some]] - sums[lo]
        return -total / np.maximum(count, 1)[:, None], count

    def judge(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per text: the best language's index (-1: no letter), a score, whether it is rejected."""
        ce, count = self.cross_entropy(texts)
        best = ce.argmin(axis=1)
        low = ce[np.arange(len(ce)), best]
        score = 1 / np.exp(SHARPNESS * (low[:, None] - ce)).sum(axis=1)
        rejected = count == 0
        if self.limit is not None:
            over = low - self.usual[best]
            rejected |= (over * np.sqrt(count) > self.limit[best]) & (over > MARGIN * (-self.unseen - self.usual[best]))
        return np.where(count == 0, -1, best), np.where(count == 0, 0.0, score), rejected


def kneser_ney(languages: list[str], counts: list[tuple[np.ndarray, np.ndarray]]) -> Model:
    """``counts``: for each language its distinct 4-grams and how often each was seen."""
    width, mask = len(languages), [np.uint64((1 << (16 * n)) - 1) for n in range(ORDER)]
    level: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in range(ORDER)]
    for keys, n in counts:
        own = (keys, n.astype(np.float64))
        level[ORDER - 1].append(own)
        for k in range(ORDER - 1, 0, -1):  # a lower order counts the different symbols to the left
            short, many = np.unique(own[0] & mask[k], return_counts=True)
            own = (short, many.astype(np.float64))
            level[k - 1].append(own)
    alphabet = len(np.unique(np.concatenate([level[0][i][0] for i in range(width)]))) + 1 if width else 1
    model = Model(languages, [], [], float(-np.log(alphabet)))
    for k in range(ORDER):
        union = np.unique(np.concatenate([level[k][i][0] for i in range(width)]))
        contexts = np.unique(union >> np.uint64(16))
        p, gamma = np.zeros((len(union), width)), np.ones((len(contexts), width))
        lower = np.full((len(union), width), 1.0 / alphabet)
        if k:
            row = model.tables[k - 1].find(union & mask[k])
            lower = np.exp(model.tables[k - 1].values[row].astype(np.float64))
        for i in range(width):
            keys, n = level[k][i]
            if not len(keys):
                p[:, i] = lower[:, i]
                continue
            ones, twos = (n == 1).sum(), (n == 2).sum()
            discount = ones / (ones + 2 * twos) if ones and twos else 0.5
            own = np.searchsorted(contexts, keys >> np.uint64(16))
            total = np.bincount(own, n, len(contexts))
            kinds = np.bincount(own, minlength=len(contexts))
            seen = total > 0
            gamma[seen, i] = discount * kinds[seen] / total[seen]
            direct = np.zeros(len(union))
            direct[np.searchsorted(union, keys)] = np.maximum(n - discount, 0) / total[own]
            p[:, i] = direct + gamma[np.searchsorted(contexts, union >> np.uint64(16)), i] * lower[:, i]
        model.tables.append(HashTable(union, np.log(p)))
        model.gammas.append(HashTable(contexts, np.log(gamma)))
    return model


def fit(training: DataFrame, rows: int = TRAIN_ROWS, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model | None:
    """Fit on about ``rows`` whole texts a language; None if there is nothing to learn from."""
    known = training.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), F.col(lang_col).alias("_lang")).where("_lang is not null and _text is not null")
    aside = (F.pmod(F.xxhash64("_id", "_text", F.lit("calibrate")), F.lit(CALIBRATE)) == 0).alias("_aside")
    sample = stable(bounded(known, F.col("_id"), rows, by="_lang").select("_text", "_lang", aside))  # read twice
    # a language with too few rows to leave any out is calibrated on what it was counted on
    few = [r["_lang"] for r in sample.groupBy("_lang").agg(F.count_if("_aside").alias("n")).where("n < 20").collect()]
    counted, tried = sample.where(~F.col("_aside") | F.col("_lang").isin(few)), sample.where(F.col("_aside") | F.col("_lang").isin(few))

    def count(batches):
        for piece in chunks(batches, "_text", PIECE):
            langs = piece.column("_lang").to_numpy(zero_copy_only=False)
            for lang in sorted(set(langs)):
                symbols, _, size = characters(piece.column("_text").filter(pa.array(langs == lang)))
                if size.sum():
                    found, n = np.unique(grams(symbols, ORDER), return_counts=True)
                    found, n = found[found & np.uint64(0xFFFF) != 0], n[found & np.uint64(0xFFFF) != 0]
                    yield pa.RecordBatch.from_pydict({"lang": [lang] * len(found), "gram": found.view(np.int64), "n": n})

    found = counted.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas()
    if found.empty:
        return None
    found = found.assign(gram=found["gram"].to_numpy(np.int64).view(np.uint64)).sort_values(["lang", "gram"])
    languages = sorted(found["lang"].unique())
    model = kneser_ney(languages, [tuple(found.loc[found["lang"] == x, c].to_numpy() for c in ("gram", "n")) for x in languages])
    shared = training.sparkSession.sparkContext.broadcast(model)

    def calibrate(batches):
        for piece in chunks(batches, "_text", PIECE):
            ce, size = shared.value.cross_entropy(piece.column("_text"))
            own = np.array([languages.index(x) if x in languages else -1 for x in piece.column("_lang").to_pylist()])
            use = (own >= 0) & (size > 0)
            yield pa.RecordBatch.from_pydict({"own": own[use], "ce": ce[np.flatnonzero(use), own[use]], "size": size[use]})

    fits = tried.mapInArrow(calibrate, "own long, ce double, size long").toPandas()
    model.usual, model.limit = np.zeros(len(languages)), np.full(len(languages), np.inf)
    for i in range(len(languages)):
        own = fits[fits["own"] == i]
        model.usual[i] = np.average(own["ce"], weights=own["size"]) if len(own) else -model.unseen
        away = (own["ce"] - model.usual[i]) * np.sqrt(own["size"])
        model.limit[i] = SLACK * max(float(np.quantile(away, QUANTILE)), 3 * float(away.std(ddof=0))) if len(own) else np.inf
    return model


def held_out(id_col: Column) -> Column:
    """Rows that no training may see."""
    return F.coalesce(F.pmod(F.crc32(id_col.cast("string")), F.lit(3)) == 1, F.lit(False))


def apply(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, ``lang_pred``, ``score`` and ``rejected``.

    A text that is null or has no letter is `und`, scores 0 and is rejected; without a model every text is.
    Repeated rows give repeated results; other columns are left out.
    """
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for piece in chunks(batches, "_text", PIECE):
            best, score, rejected = judged(shared.value, piece.column("_text"))
            yield pa.RecordBatch.from_pydict({id_col: piece.column("_id"), "lang_pred": best, "score": score, "rejected": rejected})

    return rows.mapInArrow(run, f"`{id_col}` {dict(rows.dtypes)['_id']}, lang_pred string, score double, rejected boolean")


def judged(model: Model | None, texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    if model is None:
        return [UNKNOWN] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
    best, score, rejected = model.judge(texts)
    return [model.languages[i] if i >= 0 else UNKNOWN for i in best], score, rejected


def keep_identified(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """The rows, with all their columns (of any name), that are not rejected: null and letterless texts go, repeated rows go or stay alike."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = ["_text" if c == text_col else f"_{i}" for i, c in enumerate(docs.columns)]
    rows = docs.select(*(quoted(c).alias(n) for c, n in zip(docs.columns, names, strict=True)))

    def run(batches):
        for piece in chunks(batches, "_text", PIECE):
            yield piece.filter(pa.array(~judged(shared.value, piece.column("_text"))[2]))

    kept = rows.mapInArrow(run, rows.schema)
    return kept.select(*(F.col(n).alias(c) for c, n in zip(docs.columns, names, strict=True)))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = apply(docs, fit(docs.where(~held_out(F.col("doc_id")))))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")
