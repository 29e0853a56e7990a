"""URL filters: allow and block rules, then a weighted vocabulary found by an Aho-Corasick automaton.

A rule (host, path) fits its host and all subdomains where the path starts with the rule's; the
longest wins. A URL without a rule is blocked on one strict term, or on at least ``MIN_SOFT``
different soft terms whose weights reach ``MIN_WEIGHT``. A term counts only between boundaries:
no ASCII letter or digit touches it.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glimt.llm.common import table

STRICT = ("casino", "porn", "xxx", "viagra", "pills", "spam", "adult")
SOFT = {"free": 1.0, "bets": 1.0, "win": 0.5, "ads": 1.0, "track": 1.0, "cheap": 1.0, "farm": 0.5, "bonus": 1.0, "loan": 1.0, "dating": 1.0}
MIN_SOFT, MIN_WEIGHT = 2, 1.5
RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_AFTER = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    """Lower-case host; empty for a null url or one without `://`."""
    return F.coalesce(F.translate(F.regexp_extract(url, _AFTER, 1), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _AFTER, 2), F.lit(""))


def longest_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """struct(rule, action) of the longest rule that fits, else null."""

    def fits(rule: str) -> Column:
        domain, slash, rest = rule.partition("/")
        return ((host == domain) | host.endswith("." + domain)) & path.startswith(slash + rest)

    ranked = sorted(rules, key=lambda r: (len(r[1]), r[1]))
    none = F.lit(None).cast("struct<rule:string,action:string>")
    return reduce(lambda rest, r: F.when(fits(r[1]), F.struct(F.lit(r[1]).alias("rule"), F.lit(r[0]).alias("action"))).otherwise(rest), ranked, none)


def vocabulary(terms: DataFrame, most: int = 1_000_000) -> tuple[list[str], dict[str, float]]:
    """(strict, soft) for ``filter_urls`` from a table (term, weight); a null weight makes a term strict, of repeated soft terms the largest weight counts.

    Terms are lower-cased in A-Z; null and empty ones are left out. The automaton holds them in every task, so more than ``most`` are an error.
    """
    word = F.translate("term", _UPPER, _LOWER)
    rows = terms.where(F.coalesce(F.length("term"), F.lit(0)) > 0).groupBy(word.alias("term")).agg(F.bool_or(F.col("weight").isNull()).alias("strict"), F.max(F.col("weight").cast("double")).alias("weight"))
    found = rows.limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"more than {most} terms")
    return sorted(r["term"] for r in found if r["strict"]), {r["term"]: r["weight"] for r in sorted(found) if not r["strict"]}


def automaton(strict: Sequence[str], soft: dict[str, float]) -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for term, weight in [*soft.items(), *((t, None) for t in strict)]:
        found.add_word(term, (term, weight))
    found.make_automaton()
    return found


def filter_urls(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: Sequence[tuple[str, str]] = RULES, strict: Sequence[str] = STRICT, soft: dict[str, float] = SOFT, min_soft: int = MIN_SOFT, min_weight: float = MIN_WEIGHT
) -> DataFrame:
    """Per row: id, host, path, rule (or null), verdict, strict_hits, soft_terms and soft_weight.

    A null or empty url has no host, path, rule or term and is allowed. Repeated rows give repeated results; other columns are left out.
    """
    rows = pages.select(F.col(id_col).alias("_id"), F.col(url_col).alias("_url"))
    kind = dict(rows.dtypes)["_id"]
    letters = frozenset(_UPPER + _LOWER + "0123456789")

    def run(batches):
        machine = automaton(strict, soft)
        for batch in batches:
            hits, terms, weights = [], [], []
            for url in batch.column("_url").to_pylist():
                text, strong, weak = (url or "").translate(str.maketrans(_UPPER, _LOWER)), 0, {}
                for last, (term, weight) in machine.iter(text):
                    first = last - len(term)
                    if (first >= 0 and text[first] in letters) or (last + 1 < len(text) and text[last + 1] in letters):
                        continue
                    if weight is None:
                        strong += 1
                    else:
                        weak[term] = weight
                hits.append(strong)
                terms.append(len(weak))
                weights.append(float(sum(weak.values())))
            yield pa.RecordBatch.from_pydict({"_id": batch.column("_id"), "_url": batch.column("_url"), "strict_hits": pa.array(hits, pa.int32()), "soft_terms": pa.array(terms, pa.int32()), "soft_weight": pa.array(weights, pa.float64())})

    scored = rows.mapInArrow(run, f"_id {kind}, _url string, strict_hits int, soft_terms int, soft_weight double")
    scored = scored.withColumns({"host": host_of(F.col("_url")), "path": path_of(F.col("_url"))})
    scored = scored.withColumn("_rule", longest_rule(F.col("host"), F.col("path"), rules))
    bad = (F.col("strict_hits") > 0) | ((F.col("soft_terms") >= min_soft) & (F.col("soft_weight") >= min_weight))
    verdict = F.coalesce(F.col("_rule.action"), F.when(bad, "block").otherwise("allow"))
    return scored.select(F.col("_id").alias(id_col), "host", "path", F.col("_rule.rule").alias("rule"), verdict.alias("verdict"), "strict_hits", "soft_terms", "soft_weight")


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def _oracle() -> str:
    term = lambda t: f"regexp_matches(u, '(^|[^a-z0-9]){t}([^a-z0-9]|$)')"
    fits = lambda r: f"(host = '{r.split('/')[0]}' OR ends_with(host, '.{r.split('/')[0]}')) AND starts_with(path, '/{r.split('/', 1)[1]}')"
    ranked = sorted(RULES, key=lambda r: (-len(r[1]), r[1]))
    case = lambda k: "CASE " + " ".join(f"WHEN {fits(r[1])} THEN '{r[k]}'" for r in ranked) + " END"
    soft_n = " + ".join(f"CAST({term(t)} AS INT)" for t in SOFT)
    soft_w = " + ".join(f"CAST({term(t)} AS INT) * {w}" for t, w in SOFT.items())
    strict = " OR ".join(term(t) for t in STRICT)
    return rf"""
    WITH a AS (SELECT page_id, translate(coalesce(url, ''), '{_UPPER}', '{_LOWER}') AS u, regexp_extract(coalesce(url, ''), '{_AFTER}', ['h', 'p']) AS x FROM pages),
    b AS (SELECT page_id, u, translate(x.h, '{_UPPER}', '{_LOWER}') AS host, x.p AS path FROM a),
    c AS (SELECT page_id, host, path, {case(1)} AS rule, {case(0)} AS action,
      ({strict}) OR ({soft_n} >= {MIN_SOFT} AND {soft_w} >= {MIN_WEIGHT}) AS bad FROM b)
    SELECT page_id, host, path, rule, coalesce(action, CASE WHEN bad THEN 'block' ELSE 'allow' END) AS verdict FROM c"""


ORACLE = {"op1_url_filter": _oracle()}
