"""Main text of web pages by equivalence-class template deduction.

Tokens are the tags of containers, told apart by their path, and the words that stand directly in them. For each host Spark
gathers every token's occurrence vector over the host's pages (a fingerprint that is combined in any order, so hot hosts
aggregate map-side). Words whose vector equals their container's form one equivalence class with its tags: they are the fixed
text of the template, into which containers nest by their paths. What is left in a container is a slot. Slots that hold
mostly fixed words, mostly links, or the same few texts over and over (their variability) are cut; the other slots, in the
article where there is one, are the page's text. Containers that name themselves menus, adverts and the like are cut too.
The page's main part (its first `main`, else its first `article`) and what it stands in are never cut by a name.
Hosts with too few pages use the template deduced over all hosts; others use their own alone.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glimt.llm.common import quoted, stable, table
from glimt.llm.textbuf import chunks
from glimt.llm.url_filter import host_of

#: Different pages that a container must be on to be judged.
LEAST_PAGES = 3
#: A slot is cut if at least these shares of its text are fixed words, or links, or if it has fewer different texts a page than this.
FIXED, LINKED, VARIED = 0.5, 0.5, 0.5
#: Templates up to this size are broadcast; beyond it pages and templates are joined over SALTS parts of each host.
BROADCAST_BYTES, SALTS = 16 << 20, 64
CONTAINERS = frozenset("html head body div section article main nav header footer aside form ul ol table figure dialog fieldset".split())
BLOCKS = CONTAINERS | frozenset("p h1 h2 h3 h4 h5 h6 li dl dt dd tr td th thead tbody tfoot blockquote pre hr address title caption figcaption option details summary".split())
#: Elements whose content is no text. RAW ones end nowhere but at their end tag; others without an end tag are passed over.
RAW = frozenset("script style".split())
SILENT = RAW | frozenset("noscript template svg iframe object textarea select button canvas".split())
#: Containers that are never main text, by tag or by a word of their class, id or role.
ASIDE_TAGS = frozenset("head nav header footer aside form dialog".split())
ASIDE_WORDS = frozenset("ad ads advert advertisement banner sponsor sponsored promo cookie cookies consent notice alert popup modal sidebar menu nav navbar navigation breadcrumb breadcrumbs header footer comment comments reply replies respond share social related recommended newsletter subscribe search login widget".split())
COMMENT_WORDS = frozenset("comment comments reply replies respond".split())
#: A hyphenated name is judged by its last word (`site-header`), or by its first where the last only says what holds it; not behind these first words.
HOLDERS = frozenset("area bar block body box container content footer form group head header holder inner item items left link links list main menu panel posts right row section slot stories text title top bottom unit widget wrap wrapper zone".split())
NEGATIONS = frozenset("no not non has have with without is hide hidden".split())
MAIN_TAGS = ("article", "main")
#: No part of this can match in two ways, and a tag ends before the next `<` outside of quotes, so hostile pages cost no more than others.
_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^<>]*>|<(/?)([a-zA-Z][^\s/<>]*+)((?:[^<>\"']++|\"[^\"]*+\"|'[^']*+')*+)>", re.S)
_NAMES = re.compile(r"(?:^|\s)(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_WORDS = re.compile(r"[a-z][a-z0-9]*")
_NUMBER = re.compile(r"[0-9]{3,}")
_SPACE = re.compile(r"[\x20\x09-\x0D]+")


@dataclass
class Node:
    """A container on a page. ``path`` stands for its own and all outer names; ``whole``: its own end tag closes it.

    ``aside``: it is no main text by its tag; ``called``: by its names.
    """

    path: int
    name: str
    parent: int
    aside: bool = False
    called: bool = False
    comments: bool = False  # it is called a reader's comment
    whole: bool = False
    dead: bool = False
    plain: Counter = field(default_factory=Counter)  # containers in it without names of their own


@dataclass
class Page:
    """Containers in order (the first is the page), and what happens in order: (container, text or None for a block border, in a link)."""

    nodes: list[Node]
    events: list[tuple[int, str | None, bool]]


def named_aside(names: list[str], aside: frozenset[str] = ASIDE_WORDS) -> bool:
    """Whether a class, id or role says that its container is no main text."""
    for name in " ".join(names).lower().split():
        words = _WORDS.findall(name)
        if words and words[0] not in NEGATIONS and (words[-1] in aside or (words[0] in aside and words[-1] in HOLDERS)):
            return True
    return False


def parse(page: str) -> Page:
    nodes, events, stack, open_now = [Node(0, "", -1)], [], [0], Counter()
    at, size, link, ends = 0, len(page), False, {}
    while at < size:
        found = _TAG.search(page, at)
        if found is None:
            events.append((stack[-1], page[at:], link))
            break
        if found.start() > at:
            events.append((stack[-1], page[at : found.start()], link))
        at = found.end()
        if found[2] is None:
            continue
        name, closing = found[2].lower(), bool(found[1])
        if name in SILENT:
            if not closing and not found[3].endswith("/"):
                if ends.get(name, 0) >= 0 and ends.get(name, 0) <= at:  # where the next end tag is, looked for once
                    end = re.compile(rf"</{name}[\s/>]", re.I).search(page, at)
                    ends[name] = end.start() if end else -1
                stop = page.find(">", ends[name]) if ends[name] >= 0 else -1
                if stop >= 0:
                    at = stop + 1
                elif name in RAW:
                    break
        elif name == "br":
            events.append((stack[-1], " ", link))
        elif name == "a":
            link = not closing
        elif name in CONTAINERS:
            events.append((stack[-1], None, False))
            link = False
            if not closing:
                parent = nodes[stack[-1]]
                names = ["".join(m) for m in _NAMES.findall(found[3])]
                words = sorted({_NUMBER.sub("", w) for m in names for w in _WORDS.findall(m.lower())} - {""})
                if not words:
                    parent.plain[name] += 1
                own = ".".join([name, *words]) if words else f"{name}#{parent.plain[name]}"
                path = xxhash.xxh64_intdigest(own, parent.path & 0xFFFFFFFFFFFFFFFF)
                node = Node(path - (1 << 64) if path >> 63 else path, name, stack[-1], name in ASIDE_TAGS, name not in ("html", "body") and named_aside(names), named_aside(names, COMMENT_WORDS))
                stack.append(len(nodes))
                nodes.append(node)
                open_now[name] += 1
            elif open_now[name]:
                while nodes[stack[-1]].name != name:
                    open_now[nodes[stack.pop()].name] -= 1
                nodes[stack.pop()].whole = True
                open_now[name] -= 1
        elif name in BLOCKS:
            events.append((stack[-1], None, False))
            link = False
    for k in _principal(nodes):
        nodes[k].called = False
    for node in nodes[1:]:
        node.dead = nodes[node.parent].dead or ((node.aside or node.called) and node.whole)
    return Page(nodes, events)


def _principal(nodes: list[Node]) -> list[int]:
    """The first `main` that stands in no aside by its tag and in no comments, else the first such `article`, and the containers around it."""
    off = [False]
    for node in nodes[1:]:
        off.append(off[node.parent] or ((node.aside or (node.comments and node.called)) and node.whole))
    for tag in ("main", "article"):
        if (k := next((i for i, n in enumerate(nodes) if n.name == tag and not off[i]), 0)) > 0:
            found = [k] if tag == "article" else [k, *_first_article(nodes, k)]
            while (k := nodes[k].parent) > 0:
                found.append(k)
            return found
    return []


def _first_article(nodes: list[Node], main: int) -> list[int]:
    """The first article of a main part, and the containers between them."""
    inside = {main}
    for k in range(main + 1, len(nodes)):
        if nodes[k].parent in inside:
            inside.add(k)
            if nodes[k].name == "article":
                found = [k]
                while (k := nodes[k].parent) != main:
                    found.append(k)
                return found
    return []


def slots(page: Page) -> Iterator[tuple[int, int, int, int, int, int]]:
    """(path, token, times, characters, characters in links, hash of the text) of the containers (token 0) of a page, and of their own words.

    A container that the page leaves open has no say, so a page that is cut off leaves the vectors of others alone.
    """
    own: dict[int, list] = {}
    left_open = {n.path for n in page.nodes[1:] if not n.whole}
    for n in page.nodes[1:]:
        if n.path not in left_open and n.name not in MAIN_TAGS:
            own.setdefault(n.path, [0, [], 0])[0] += 1
    for k, text, link in page.events:
        if text and (slot := own.get(page.nodes[k].path)) is not None and not text.isspace():
            slot[1].append(text)
            slot[2] += len(text) * link
    for path, (n, texts, linked) in own.items():
        words = " ".join(texts).split()
        text = " ".join(words)
        yield path, 0, n, sum(map(len, texts)), linked, xxhash.xxh64_intdigest(text) >> 1
        for word, times in Counter(words).items():
            yield path, (xxhash.xxh64_intdigest(word) >> 1) | 1, times, len(word) * times, 0, 0


def templates(pages: DataFrame) -> DataFrame:
    """(host, cut: paths of slots that hold no main text) of (host, html) for each host with such slots, and for all hosts with host null."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, nth = TaskContext.get().partitionId(), 0
        for piece in chunks(batches, "html"):
            rows: list[tuple] = []
            for host, text in zip(piece.column("host").to_pylist(), piece.column("html").to_pylist(), strict=True):
                nth += 1  # pages that are alike are told apart, so that none cancels another in a vector
                same = xxhash.xxh64_intdigest(text or "") >> 1
                rows += [(host, nth << 24 | task, same, *x) for x in slots(parse(text or ""))]
            if rows:
                columns = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), *(pa.array(c, pa.int64()) for c in columns[1:])], names=["host", "page", "same", "path", "token", "n", "chars", "linked", "text"])

    tokens = pages.mapInArrow(run, "host string, page long, same long, path long, token long, n long, chars long, linked long, text long")
    tag = F.col("token") == 0
    sums = lambda *names: [F.sum(c).alias(c) for c in names]
    by_host = tokens.groupBy("host", "path", "token").agg(
        F.bit_xor(F.xxhash64("page", "n")).alias("vector"), *sums("chars", "linked"), F.hll_sketch_agg(F.when(tag, F.col("same")), 10).alias("pages"), F.hll_sketch_agg(F.when(tag, F.col("text")), 10).alias("texts"))
    by_host = stable(by_host)
    everywhere = by_host.groupBy("path", "token").agg(F.bit_xor("vector").alias("vector"), *sums("chars", "linked"), F.hll_union_agg("pages").alias("pages"), F.hll_union_agg("texts").alias("texts"))
    seen = by_host.unionByName(everywhere.withColumn("host", F.lit(None).cast("string")))
    # equivalence classes: tokens of one vector. A class with a container's tags holds the words of it that are fixed
    tags = seen.where(tag & (F.col("chars") > 0)).withColumn("_on", F.hll_sketch_estimate("pages")).where(F.col("_on") >= LEAST_PAGES)
    key = F.coalesce(F.concat(F.lit("="), "host"), F.lit(""))
    words = seen.where(~tag).groupBy(key.alias("_host"), "path", "vector").agg(F.sum("chars").alias("_fixed"))
    joined = tags.withColumn("_host", key).join(words, ["_host", "path", "vector"], "left")
    fixed, linked = F.coalesce("_fixed", F.lit(0)) >= F.col("chars") * FIXED, F.col("linked") >= F.col("chars") * LINKED
    cut = joined.where(fixed | linked | (F.hll_sketch_estimate("texts") < F.col("_on") * VARIED))
    return cut.groupBy("host").agg(F.array_sort(F.collect_list("path")).alias("cut"))


def main_text(page: Page, cut: frozenset[int]) -> str:
    """The blocks of a page's remaining slots, one a line: of its articles, else of its main part, else of all; what asides hold is left out.

    If the template leaves nothing, the page is laid out otherwise and only asides are cut.
    """
    for template in (cut, frozenset()) if cut else (cut,):
        for part in (*MAIN_TAGS, ""):
            inside = [part == ""]
            for n in page.nodes[1:]:
                inside.append(inside[n.parent] or n.name == part)
            live = [i and not n.dead and not (n.path in template and n.name not in MAIN_TAGS) for i, n in zip(inside, page.nodes, strict=True)]
            if any(live) and (text := _blocks(page, live)):
                return text
    return ""


def _blocks(page: Page, live: list[bool]) -> str:
    blocks, current, last = [], [], 0
    for k, text, _ in page.events:
        if text is None or k != last:
            if current:
                blocks.append("".join(current))
                current = []
            last = k
        if text is not None and live[k]:
            current.append(text)
    blocks.append("".join(current))
    return "\n".join(b for b in (_SPACE.sub(" ", html.unescape(b)).strip(" ") for b in blocks) if b)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per row: id, url, text and n_chars (code points).

    A null or empty page has the empty text; a null url belongs to the host without a name; repeated rows give repeated results;
    other columns are left out. Cost is in proportion to a page's length.
    """
    rows = pages.select(quoted(id_col).alias("_id"), quoted(url_col).alias("url"), quoted(html_col).alias("html"), host_of(quoted(url_col)).alias("host"))
    kinds = dict(rows.dtypes)
    found = stable(templates(rows.select("host", "html")))
    spare = found.where("host is null").take(1)  # the one template of all hosts
    spare_cut = frozenset(spare[0]["cut"]) if spare else frozenset()
    # hosts with enough pages have a template of their own, if only an empty one
    enough = rows.where("host is not null").groupBy("host").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= LEAST_PAGES).select("host")
    own = stable(enough.join(found.where("host is not null"), "host", "left").select("host", F.coalesce("cut", F.array().cast("array<bigint>")).alias("cut")))
    bytes_of_all = own.agg(F.sum(F.size("cut") * 8 + F.octet_length("host"))).first()[0] or 0
    if bytes_of_all <= BROADCAST_BYTES:
        joined = rows.join(F.broadcast(own), "host", "left")
    else:  # every template SALTS times, so that no host's pages meet in one task
        salted = own.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = rows.withColumn("salt", F.pmod(F.xxhash64("url", "html"), F.lit(SALTS)).cast("int")).join(salted, ["host", "salt"], "left")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[tuple | None, frozenset] = {}
        for piece in chunks(batches, "html"):
            texts = []
            for page, cut in zip(piece.column("html").to_pylist(), piece.column("cut").to_pylist(), strict=True):
                key = None if cut is None else tuple(cut)
                texts.append(main_text(parse(page or ""), known.setdefault(key, spare_cut if key is None else frozenset(key))))
            yield pa.RecordBatch.from_arrays([piece.column("_id"), piece.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["_id", "url", "text", "n_chars"])

    out = joined.select("_id", "url", "html", "cut").mapInArrow(run, f"_id {kinds['_id']}, url {kinds['url']}, text string, n_chars long")
    return out.withColumnRenamed("_id", id_col)


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
