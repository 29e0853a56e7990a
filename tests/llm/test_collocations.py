"""Collocations against a plain count of all n-grams."""

import random
import re
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest

from glimt.llm import collocations

SCHEMA = "doc_id long, text string, lang string, id string, word string, n string, pair string, w1 string, p string, a string, `a.b` string"
UPPER = {c: c + 32 for c in range(65, 91)}


def table(spark, docs):
    return spark.createDataFrame([(i, t, x, *["clash"] * 8) for i, (t, x) in enumerate(docs)], SCHEMA).repartition(3)


def plain(docs, longest=5, least=100, top=2000, share=100):
    total, f = Counter(), defaultdict(Counter)
    for text, lang in docs:
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", (text or "").translate(UPPER)):
            words = re.findall("[^ \t]+", piece)
            total[lang or "und"] += len(words)
            for k in range(1, longest + 1):
                for i in range(len(words) - k + 1):
                    f[lang or "und"][tuple(words[i : i + k])] += 1
    out = []
    for lang, counts in f.items():
        found = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        scored = []
        for p, a in found.items():
            inside = any(len(q) > len(p) and 100 * b >= share * a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q, b in found.items())
            if not inside:
                cuts = [(int(Fraction(1000 * a * total[lang], counts[p[:k]] * counts[p[k:]])), k) for k in range(1, len(p))]
                s, k = min(cuts)
                scored.append((-s, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        out += [(lang, r + 1, p.decode(), -a, x, y, total[lang], -s) for r, (s, a, p, x, y) in enumerate(sorted(scored)[:top])]
    return sorted(out)


def random_docs(rng, n):
    words = ["A", "b", "ö", "Dd", "e-e", "f'", "ß"]
    out = []
    for _ in range(n):
        text = "".join(rng.choice(words) + rng.choice([" ", " ", "  ", "\t", ". ", ",", "\n"]) for _ in range(rng.randrange(60)))
        out.append((text + rng.choice(["", "one two three four five six"]), rng.choice(["en", "de", None, "und"])))
    return out


@pytest.mark.parametrize(("seed", "least", "top", "share", "longest"), [(1, 3, 2000, 100, 5), (2, 8, 5, 50, 4), (3, 2, 40, 100, 2)])
def test_collocations(spark, seed, least, top, share, longest):
    rng = random.Random(seed)
    docs = random_docs(rng, 120) + [(None, "en"), ("", None), ("   \t ", "en"), (".,;:!?", "de"), ("x " * 30_000, "en"), ("one two one two", "en"), ("one two one two", "en")]
    got = sorted(tuple(r) for r in collocations.collocations(table(spark, docs), longest=longest, least=least, top=top, share=share).collect())
    assert got == plain(docs, longest, least, top, share)


def test_collocations_of_nothing(spark):
    assert collocations.collocations(table(spark, [])).count() == 0
    assert collocations.collocations(table(spark, [(None, None), ("a b c", "en")])).count() == 0


def test_full_bitmaps_and_small_tasks_change_nothing(spark, monkeypatch):
    """Bitmaps too small for their keys let everything through; counts are handed on early."""
    docs = random_docs(random.Random(7), 80)
    for name, value in (("MOST_BITS", 64), ("LEAST_BITS", 64), ("HELD", 50), ("HELD_WORDS", 20), ("PIECE", 100)):
        monkeypatch.setattr(collocations, name, value)
    got = sorted(tuple(r) for r in collocations.collocations(table(spark, docs), least=4).collect())
    assert got == plain(docs, least=4)


def test_words_that_share_a_hash_are_noticed(spark, monkeypatch):
    docs = [("a b c a b c", "en")] * 5
    words = collocations.count_words
    monkeypatch.setattr(collocations, "count_words", lambda texts, seed: words(texts, seed).selectExpr("0L as id", "lang", "word", "n") if seed == 0 else words(texts, seed))
    assert sorted(tuple(r) for r in collocations.collocations(table(spark, docs), least=3).collect()) == plain(docs, least=3)
    with pytest.raises(RuntimeError):
        collocations.collocations(table(spark, docs), seeds=[0])


def test_windows_of_one_hash_stay_apart():
    first, n = collocations.grouped(np.array([5, 3, 5, 3, 9], np.uint64), np.array([1, 2, 3, 4, 5]))
    assert first.tolist() == [1, 0, 4] and n.tolist() == [6, 4, 5]


def test_large_products(spark):
    """Scores whose products pass 64 bits."""
    found = spark.sql("select cast((1000BD * cast(4000000000 as decimal(18,0)) * cast(90000000000000 as decimal(18,0))) div (cast(5000000000 as decimal(18,0)) * cast(7000000000 as decimal(18,0))) as long) as s").first()[0]
    assert found == 1000 * 4_000_000_000 * 90_000_000_000_000 // (5_000_000_000 * 7_000_000_000)
