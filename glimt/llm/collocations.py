"""Phrase collocations by top-order marginalisation.

Only the longest windows are counted: five lead columns at each word, padded where the piece ends or where the next pair of words is
too rare to stand in any candidate (every pair inside a phrase is at least as frequent as the phrase). A ROLLUP over the window columns then
sums shorter and shorter prefixes, so that f of every phrase comes from one count of windows, and no n-gram is made for itself.

Words are 64-bit hashes of language and word; a hash that two words share is found and another seed taken. Words and pairs that may be
frequent go to the tasks as bitmaps of bounded size: what a bitmap lets through by chance is counted exactly and falls at the end.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glimt.llm.common import quoted, table, written
from glimt.llm.textbuf import TextBuffer, chunks, mix, powers

LONGEST, LEAST, TOP, SHARE = 5, 100, 2000, 100
#: Bits of a bitmap: so many a key, within these bounds.
KEY_BITS, LEAST_BITS, MOST_BITS = 32, 1 << 16, 1 << 27
#: Bytes of text worked on at once; counts of words, and of pairs or windows, that a task holds before it hands them on; rows of a batch.
PIECE, HELD_WORDS, HELD, BATCH = 1 << 19, 1 << 18, 1 << 20, 1 << 16
_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[list(b".,;:!?\n\x0b\x0c\r")] = True
_INSIDE = ~_SEPARATOR
_INSIDE[[0x20, 0x09]] = False
_ODD = np.uint64(0x9E3779B97F4A7C15)
_CHECK = 0xD6E8FEB86659FD93


class Words:
    """The words of a batch's texts in order: spans, hashes (never 0, which is the padding), and whether the next is in the same piece."""

    def __init__(self, batch: pa.RecordBatch, seed: int) -> None:
        self.buf = buf = TextBuffer(batch.column("text")).lower_ascii()
        self.starts, self.ends = buf.spans(_INSIDE[buf.data])
        owner = buf.owner(self.starts)
        lang = batch.column("lang").dictionary_encode()
        self.langs, self.lang = lang.dictionary, lang.indices.to_numpy()[owner]
        self.salt = np.array([xxhash.xxh64_intdigest(x.encode(), seed) for x in self.langs.to_pylist()], np.uint64)
        self.ids = mix(buf.hashes(self.starts, self.ends) ^ self.salt[self.lang])
        self.ids[self.ids == 0] = 1
        breaks = np.concatenate([[0], np.cumsum(_SEPARATOR[buf.data])])
        self.linked = np.zeros(len(owner), bool)
        self.linked[:-1] = (owner[1:] == owner[:-1]) & (breaks[self.starts[1:]] == breaks[self.ends[:-1]])

    def check(self, at: np.ndarray) -> np.ndarray:
        """Another hash of these words and their languages, by another polynomial, to tell words apart that share an id."""
        data = self.buf.data
        sums = np.concatenate([[np.uint64(0)], np.cumsum((data.astype(np.uint64) + np.uint64(7)) * powers(max(1, len(data)), _CHECK, 0)[: len(data)])])
        down = powers(len(data) + 1, pow(_CHECK, -1, 1 << 64), 0)
        return mix((sums[self.ends[at]] - sums[self.starts[at]]) * down[self.starts[at]]) + self.salt[self.lang[at]]

    def spelled(self, at: np.ndarray) -> tuple[pa.Array, pa.Array]:
        """Languages and texts of the words at these places."""
        size = self.ends[at] - self.starts[at]
        to = np.concatenate([[0], np.cumsum(size)])
        take = np.repeat(self.starts[at] - to[:-1], size) + np.arange(to[-1])
        text = pa.LargeStringArray.from_buffers(len(at), pa.py_buffer(to.astype(np.int64)), pa.py_buffer(self.buf.data[take]))
        return self.langs.take(pa.array(self.lang[at])), text


def pair_keys(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return mix(first * _ODD + second)


def grouped(key: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first place, sum of counts) of each different key."""
    order = np.argsort(key, kind="stable")
    edge = np.flatnonzero(np.concatenate([[True], key[order][1:] != key[order][:-1]])) if len(key) else np.zeros(0, np.int64)
    return order[edge], np.add.reduceat(count[order], edge) if len(edge) else count[:0]


def counted(batches: Iterable[pa.RecordBatch], parts: Callable[[pa.RecordBatch], pa.Table], key: Callable[[pa.Table], np.ndarray], most: int) -> Iterator[pa.RecordBatch]:
    """The tables of ``parts`` with the column ``n`` summed over rows of one key, as far as ``most`` rows held at once allow."""
    held, more, rows = None, [], 0

    def merged() -> pa.Table:
        whole = pa.concat_tables([*([held] if held is not None else []), *more]).combine_chunks()
        first, n = grouped(key(whole), whole["n"].to_numpy())
        return whole.take(pa.array(first)).set_column(whole.schema.get_field_index("n"), "n", pa.array(n))

    for batch in batches:
        for piece in chunks([batch], "text", PIECE):
            more.append(parts(piece))
            rows += len(more[-1])
            if rows >= most:
                held, more, rows = merged(), [], 0
                if len(held) >= most // 2:
                    yield from held.combine_chunks().to_batches(BATCH)
                    held = None
    if held is not None or more:
        yield from merged().combine_chunks().to_batches(BATCH)


def _texts(docs: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    return docs.select(F.coalesce(quoted(text_col), F.lit("")).alias("text"), F.coalesce(quoted(lang_col).cast("string"), F.lit("und")).alias("lang"))


def count_words(texts: DataFrame, seed: int) -> DataFrame:
    """(id, lang, word, n)."""

    def parts(piece: pa.RecordBatch) -> pa.Table:
        words = Words(piece, seed)
        at, n = grouped(pair_keys(words.ids, words.check(slice(None))), np.ones(len(words.ids), np.int64))
        lang, text = words.spelled(at)
        return pa.table({"id": words.ids[at].view(np.int64), "check": words.check(at).view(np.int64), "lang": lang.cast(pa.large_string()), "word": text, "n": n})

    def key(whole: pa.Table) -> np.ndarray:  # words that share an id stay apart
        return pair_keys(*(whole[c].to_numpy().view(np.uint64) for c in ("id", "check")))

    rows = texts.mapInArrow(lambda batches: counted(batches, parts, key, HELD_WORDS), "id long, check long, lang string, word string, n long")
    return rows.groupBy("id", "lang", "word").agg(F.sum("n").alias("n"))


class Bitmap:
    """Which keys may be among those of a table: one bit for each, so others get through by chance but none is missed."""

    def __init__(self, keys: DataFrame, column: str) -> None:
        rows = keys.count()
        self.mask = min(MOST_BITS, max(LEAST_BITS, 1 << (KEY_BITS * rows).bit_length())) - 1
        bit = F.col(column).bitwiseAND(F.lit(self.mask))
        words = keys.groupBy(F.shiftright(bit, 6).alias("word")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast({column} & 63 as int))")).alias("bits")).toArrow()
        self.bits = np.zeros((self.mask + 1) // 64, np.uint64)
        self.bits[words["word"].to_numpy()] = words["bits"].to_numpy().view(np.uint64)

    def holds(self, keys: np.ndarray) -> np.ndarray:
        at = keys & np.uint64(self.mask)
        return (self.bits[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)


def count_pairs(texts: DataFrame, seed: int, frequent) -> DataFrame:
    """(pair, n): keys of neighbouring words that may both be frequent, and how often each stands in the texts (no less)."""

    def parts(piece: pa.RecordBatch) -> pa.Table:
        words = Words(piece, seed)
        known = frequent.value.holds(words.ids)
        at = np.flatnonzero(words.linked[:-1] & known[:-1] & known[1:])
        keys = pair_keys(words.ids[at], words.ids[at + 1])
        first, n = grouped(keys, np.ones(len(keys), np.int64))
        return pa.table({"pair": keys[first].view(np.int64), "n": n})

    rows = texts.mapInArrow(lambda batches: counted(batches, parts, lambda whole: whole["pair"].to_numpy(), HELD), "pair long, n long")
    return rows.groupBy("pair").agg(F.sum("n").alias("n"))


def count_windows(texts: DataFrame, seed: int, pairs, longest: int) -> DataFrame:
    """(w1, w2, ..., n): the longest window at each word that begins a pair, padded with 0 behind the first pair that is too rare."""
    columns = [f"w{k + 1}" for k in range(longest)]

    def parts(piece: pa.RecordBatch) -> pa.Table:
        words = Words(piece, seed)
        go = words.linked.copy()
        go[:-1] &= pairs.value.holds(pair_keys(words.ids[:-1], words.ids[1:]))
        at = np.flatnonzero(go)
        lead = np.zeros((longest, len(at)), np.uint64)
        lead[0], on = words.ids[at], np.ones(len(at), bool)
        for k in range(1, longest):
            on &= go[np.minimum(at + k - 1, len(go) - 1)]
            lead[k, on] = words.ids[at[on] + k]
        found = pa.table({c: x.view(np.int64) for c, x in zip(columns, lead, strict=True)} | {"n": np.ones(len(at), np.int64)})
        first, n = grouped(key(found), found["n"].to_numpy())
        return found.take(pa.array(first)).set_column(longest, "n", pa.array(n))

    def key(whole: pa.Table) -> np.ndarray:
        """A number for each different window: of its hash, or of its place in their order should hashes collide."""
        lead = [whole[c].to_numpy().view(np.uint64) for c in columns]
        out = lead[0]
        for x in lead[1:]:
            out = pair_keys(out, x)
        _, first, own = np.unique(out, return_index=True, return_inverse=True)
        if all((x[first[own]] == x).all() for x in lead):
            return out
        return np.unique(np.column_stack(lead), axis=0, return_inverse=True)[1].ravel()

    rows = texts.mapInArrow(lambda batches: counted(batches, parts, key, HELD), "".join(f"{c} long, " for c in columns) + "n long")
    return rows.groupBy(*columns).agg(F.sum("n").alias("n"))


def phrase_counts(windows: DataFrame, longest: int, least: int) -> DataFrame:
    """(p, a): phrases of two words or more, as arrays of word ids, that begin ``least`` windows or more."""
    columns = [f"w{k + 1}" for k in range(longest)]
    summed = windows.rollup(*columns).agg(F.sum("n").alias("a"), F.grouping_id().alias("_rolled"))
    words = F.array_compact(F.array(*columns))  # what is rolled up is null
    return summed.where(F.col("a") >= least).select(words.alias("p"), "a").where((F.size("p") > 1) & ~F.array_contains("p", F.lit(0).cast("long")))


def _parts(longest: int) -> Column:
    """All runs of two words or more inside ``p`` that are shorter than it."""
    runs = [F.when(F.lit(i + k) <= F.size("p"), F.slice("p", i + 1, k)) for k in range(2, longest) for i in range(longest - k + 1)]
    return F.array_distinct(F.array_compact(F.array(*[F.when(F.size("p") > F.size(x), x) for x in runs])))


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", longest: int = LONGEST, least: int = LEAST, top: int = TOP, share: int = SHARE, seeds: Iterable[int] = range(8)) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the first ``top`` phrases of each language.

    Texts (null: empty) are lower-cased in A-Z and split at ``.,;:!?`` and line ends into pieces, those at blanks and tabs into words; a null
    language is ``und``. Phrases have 2 to ``longest`` words and stand ``least`` times or more (overlaps count). The score is floor(1000 a n / (l r))
    at the lowest-scoring cut, ties to the shorter first part. Phrases inside a longer one that is as frequent (100 times it is ``share`` times
    or more) are dropped. Ties go to the more frequent, then by bytes. Repeated rows count each; other columns are left out.
    """
    if not 2 <= longest or least < 1:
        raise ValueError("phrases have two words or more and stand once or more")
    context, texts = docs.sparkSession.sparkContext, _texts(docs, text_col, lang_col)
    for seed in seeds:
        words = written(count_words(texts, seed))
        if words.groupBy("id").count().where("count > 1").isEmpty():
            break
    else:
        raise RuntimeError("two words share a hash under every seed")
    frequent = words.where(F.col("n") >= least)
    known = context.broadcast(Bitmap(frequent, "id"))
    pairs = context.broadcast(Bitmap(written(count_pairs(texts, seed, known).where(F.col("n") >= least)), "pair"))
    found = written(phrase_counts(count_windows(texts, seed, pairs, longest), longest, least))
    known.destroy()
    total = words.groupBy("lang").agg(F.sum("n").alias("n"))
    counts = found.select(F.col("p").alias("q"), F.col("a").alias("f")).unionByName(frequent.select(F.array("id").alias("q"), F.col("n").alias("f")))
    # the words of each phrase, and the language that they share
    spelled = found.select("p", "a", F.posexplode("p").alias("at", "id")).join(frequent.select("id", "lang", "word"), "id")
    ordered = F.array_sort(F.collect_list(F.struct("at", "word")))
    named = spelled.groupBy("p", "a").agg(F.array_join(F.transform(ordered, lambda x: x["word"]), " ").alias("phrase"), F.first("lang").alias("lang"))
    inside = found.where(F.size("p") > 2).select(F.explode(_parts(longest)).alias("p"), "a").groupBy("p").agg(F.max("a").alias("_longer"))
    named = named.join(inside, "p", "left").where(F.col("_longer").isNull() | (100 * F.col("_longer") < share * F.col("a"))).join(total, "lang")
    cut = named.select("p", "a", "n", "lang", "phrase", F.explode(F.sequence(F.lit(1), F.size("p") - 1)).alias("k"))
    sides = cut.withColumns({"first": F.slice("p", F.lit(1), F.col("k")), "rest": F.slice("p", F.col("k") + 1, F.size("p") - F.col("k"))})
    sides = sides.join(counts.select(F.col("q").alias("first"), F.col("f").alias("l")), "first").join(counts.select(F.col("q").alias("rest"), F.col("f").alias("r")), "rest")
    wide = lambda c: f"cast({c} as decimal(18, 0))"
    sides = sides.withColumn("score", F.expr(f"(1000BD * {wide('a')} * {wide('n')}) div ({wide('l')} * {wide('r')})"))
    worst = F.min(F.struct("score", "k", "l", "r")).alias("_cut")
    scored = sides.groupBy("p", "lang", "phrase", "a", "n").agg(worst).select("lang", "phrase", "a", "_cut.l", "_cut.r", "n", "_cut.score")
    # the best of each part of a language, then of those few
    order = [F.desc("score"), F.desc("a"), "phrase"]
    few = scored.withColumn("_part", F.pmod(F.xxhash64("phrase"), F.lit(64)))
    few = few.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "_part").orderBy(*order))).where(F.col("rank") <= top)
    ranked = few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


ORACLE = {
    "op13_collocations": r"""
WITH pieces AS (
  SELECT doc_id, lang, unnest(string_split_regex(text, '[.,;:!?\x0A-\x0D]')) AS piece
  FROM (SELECT doc_id, coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents)),
words AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
grams AS (
  SELECT lang, k, w[i : i + k - 1] AS p
  FROM words, (SELECT unnest(range(1, 6)) AS k), LATERAL (SELECT unnest(range(1, len(w) - k + 2)) AS i)),
counts AS (SELECT lang, k, p, count(*) AS f FROM grams GROUP BY lang, k, p HAVING k = 1 OR count(*) >= 100),
totals AS (SELECT lang, sum(f) AS n FROM counts WHERE k = 1 GROUP BY lang),
phrases AS (SELECT * FROM counts WHERE k > 1),
inside AS (
  SELECT lang, p[i : i + j - 1] AS p, max(f) AS longer
  FROM phrases, (SELECT unnest(range(2, 5)) AS j), LATERAL (SELECT unnest(range(1, k - j + 2)) AS i) WHERE j < k GROUP BY ALL),
cuts AS (
  SELECT c.lang, c.p, c.f AS a, l.f AS l, r.f AS r, CAST(t.n AS BIGINT) AS n, c.cut,
         (1000::HUGEINT * c.f * CAST(t.n AS HUGEINT)) // (l.f::HUGEINT * r.f) AS score
  FROM (SELECT *, unnest(range(1, k)) AS cut FROM phrases) c JOIN totals t USING (lang)
  JOIN counts l ON l.lang = c.lang AND l.p = c.p[1 : c.cut] JOIN counts r ON r.lang = c.lang AND r.p = c.p[c.cut + 1 :]),
best AS (
  SELECT *, array_to_string(p, ' ') AS phrase FROM cuts
  QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, cut) = 1)
SELECT lang, row_number() OVER w AS rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score
FROM best LEFT JOIN inside USING (lang, p) WHERE longer IS NULL OR 100 * longer < 100 * a
WINDOW w AS (PARTITION BY lang ORDER BY score DESC, a DESC, phrase)
QUALIFY row_number() OVER w <= 2000
"""
}
