"""Secret scans: exact base patterns, and a character convolutional network over every candidate.

A candidate is a run of token characters; the network reads all of it and what surrounds it, told apart,
and takes each filter's maximum over the whole, however long. It is trained on labelled findings: all candidates
of all texts, labelled by whether a base pattern confirms them, and two ordinary words of each text. Spark deals these
into parts by hash; in each round every part trains on from the common weights in numpy, and the weights are averaged by
the parts' rows. So that the network does not merely learn the patterns again, confirmed candidates also appear without their
key word, and spelled in other alphabets; of the words some are joined to names with numbers or put in capitals, some give
way to plain numbers. Its scores are calibrated (Platt) out of fold, on counts of all. The threshold is the highest that keeps a given recall of the confirmed ones, raised where
what it lets through would be less likely a secret than not or too often none; ``recall`` then says what is kept.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glimt.llm.common import forget, table, written
from glimt.llm.textbuf import LEAD, TextBuffer, chunks

ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
KINDS = ("assign", "access", "hex", "model")
LEAST = {"assign": 6, "access": 20, "hex": 24}
#: A candidate: a run of `[A-Za-z0-9+/_.@-]` of so many characters, with a digit; of so many without one.
WITH_DIGIT, WITHOUT = 8, 16
#: Bytes of context on either side of a candidate, bytes in one row of the network's input, and what one filter spans.
BEFORE, AFTER, WIDTH, SPAN = 24, 12, 64, 5
#: Findings and bytes of a part, about; rounds of training, and how often each round goes through all findings.
PART_ROWS, PART_BYTES, ROUNDS, EPOCHS = 8_192, 1 << 22, 3, 2
#: Logits are rounded to so many decimals, so that counts of them say all there is to know.
DECIMALS = 3
RECALL = 0.98
#: The least calibrated score of a span, and the least precision out of fold of all that reach the threshold.
LEAST_SCORE, PRECISION = 0.5, 0.95

_HEX, _BODY, _LETTER, _DIGIT = (np.zeros(256, bool) for _ in range(4))
_DIGIT[48:58] = True
_LETTER[65:91] = _LETTER[97:123] = True
_HEX[48:58] = _HEX[97:103] = True
_BODY[:] = _DIGIT | _LETTER
_BODY[[ord(c) for c in "+/_.@-"]] = True


def _classes() -> np.ndarray:
    """Byte -> character class: letters by case with hex letters apart, digits, single symbols, blanks, the rest."""
    out = np.full(256, 1, np.uint8)
    for k, c in enumerate("abcdefghijklmnopqrstuvwxyz"):
        out[ord(c)] = 2 + k
    out[65:71], out[71:91], out[48:58] = 28, 29, 30
    for k, c in enumerate(" \n\"'=:+/_.,-@"):
        out[ord(c)] = 31 + k
    out[128:] = 44
    return out


#: Classes of context bytes, then the same of a candidate's own bytes; 0 is beyond the text.
CLASS, N_CLASSES = _classes(), 90
_OWN = 45


@dataclass
class Network:
    """Embedding, one convolution with ReLU, maximum over places, one logit."""

    embed: np.ndarray
    kernel: np.ndarray
    bias: np.ndarray
    out: np.ndarray
    out_bias: float = 0.0
    scale: float = 1.0
    shift: float = 0.0
    threshold: float = 1.1
    recall: float = 0.0

    def forward(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(where each filter has its maximum in a row, the maximum), rows in blocks."""
        at, top = (np.zeros((len(x), len(self.out)), kind) for kind in (np.int64, np.float32))
        for i in range(0, len(x), 512):
            e = self.embed[x[i : i + 512]]
            cols = np.concatenate([e[:, k : e.shape[1] - SPAN + 1 + k] for k in range(SPAN)], axis=2)
            h = cols @ self.kernel + self.bias
            at[i : i + 512] = h.argmax(axis=1)
            top[i : i + 512] = np.maximum(np.take_along_axis(h, at[i : i + 512, None, :], 1)[:, 0], 0)
        return at, top

    def weights(self) -> np.ndarray:
        return np.concatenate([self.embed.ravel(), self.kernel.ravel(), self.bias, self.out, [self.out_bias]]).astype(np.float64)

    def with_weights(self, w: np.ndarray) -> "Network":
        cut = np.cumsum([x.size for x in (self.embed, self.kernel, self.bias, self.out)])
        embed, kernel, bias, out, last = (x.astype(np.float32) for x in np.split(w, cut))
        return Network(embed.reshape(self.embed.shape), kernel.reshape(self.kernel.shape), bias, out, float(last[0]))

    def logits(self, found: list[tuple[bytes, bytes, bytes]]) -> np.ndarray:
        """Of candidates (before, own bytes, after): each filter's maximum is taken over all rows of a candidate."""
        out = np.zeros(len(found))
        for k in range(0, len(found), 256):
            rows, first = layout(found[k : k + 256])
            top = self.forward(rows)[1]
            out[k : k + 256] = np.maximum.reduceat(top, first) @ self.out + self.out_bias
        return np.round(out, DECIMALS)

    def probability(self, found: list[tuple[bytes, bytes, bytes]]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * self.logits(found) + self.shift, -40, 40)))


def classes_of(before: bytes, own: bytes, after: bytes) -> np.ndarray:
    """What the network reads of one candidate; SPAN zeros end it."""
    parts = [CLASS[np.frombuffer(x, np.uint8)] for x in (before, own, after)]
    return np.concatenate([parts[0], parts[1] + _OWN, parts[2], np.zeros(SPAN, np.uint8)])


def layout(found: list[tuple[bytes, bytes, bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """(rows of WIDTH classes, the first row of each candidate). Rows overlap so that every place of a filter is in one of them."""
    read = [classes_of(*x) for x in found]
    step = WIDTH - SPAN + 1
    count = np.array([max(1, -(-(len(x) - SPAN + 1) // step)) for x in read])
    rows = np.zeros((int(count.sum()), WIDTH), np.uint8)
    first = np.cumsum(count) - count
    for x, at, n in zip(read, first.tolist(), count.tolist(), strict=True):
        for k in range(n):
            part = x[k * step : k * step + WIDTH]
            rows[at + k, : len(part)] = part
    return rows, first


def untrained(filters: int = 24, width: int = 8, seed: int = 7) -> Network:
    rng = np.random.default_rng(seed)
    return Network(rng.normal(0, 0.3, (N_CLASSES, width)).astype(np.float32), rng.normal(0, 0.2, (SPAN * width, filters)).astype(np.float32), np.zeros(filters, np.float32), rng.normal(0, 0.2, filters).astype(np.float32))


def train(found: list[tuple[bytes, bytes, bytes]], y: np.ndarray, epochs: int = 8, net: Network | None = None, share: float | None = None, seed: int = 7) -> Network:
    """Adam on the weighted logistic loss, both classes counting alike; on from ``net``. ``share``: of the confirmed ones in all findings, if these are but a part.

    Only the places where filters have their maxima take part in a step, so a candidate of any length fits.
    """
    rng, net = np.random.default_rng(seed), untrained() if net is None else net.with_weights(net.weights())
    share = float(y.mean()) if share is None else share
    weight = np.where(y > 0, 0.5 / max(share, 1e-6), 0.5 / max(1 - share, 1e-6))
    rows, first = layout(found)
    count = np.diff(np.append(first, len(rows)))
    names, moments, step = ("embed", "kernel", "bias", "out"), {}, 0
    filters, width = len(net.out), net.embed.shape[1]
    for _ in range(epochs):
        order = rng.permutation(len(found))
        for k in range(0, len(order), 64):
            own = order[k : k + 64]
            n = count[own]
            start = np.cumsum(n) - n
            x = rows[np.repeat(first[own] - start, n) + np.arange(int(n.sum()))]
            at, each = net.forward(x)
            top = np.maximum.reduceat(each, start)
            logit = top @ net.out + net.out_bias
            delta = ((1 / (1 + np.exp(-np.clip(logit, -40, 40))) - y[own]) * weight[own] / len(own)).astype(np.float32)
            d_top = delta[:, None] * net.out[None, :] * (top > 0)
            # the row of each filter's maximum, the first of equal ones, and what the filter spans there
            best = np.minimum.reduceat(np.where(each == np.repeat(top, n, axis=0), np.arange(len(x))[:, None], len(x)), start)
            seen = x[best[:, :, None], at[best, np.arange(filters)][:, :, None] + np.arange(SPAN)]
            grads = {"out": top.T @ delta, "bias": d_top.sum(0), "kernel": np.einsum("bf,bfk->kf", d_top, net.embed[seen].reshape(len(own), filters, -1)), "embed": np.zeros_like(net.embed)}
            np.add.at(grads["embed"], seen, (d_top[:, :, None] * net.kernel.T[None]).reshape(len(own), filters, SPAN, width))
            step += 1
            for name in names:
                m, v = moments.get(name, (0.0, 0.0))
                m, v = 0.9 * m + 0.1 * grads[name], 0.999 * v + 0.001 * grads[name] ** 2
                moments[name] = m, v
                setattr(net, name, getattr(net, name) - (0.01 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)).astype(np.float32))
            net.out_bias -= 0.01 * float(delta.sum())
    return net


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind) in characters of the base patterns in one text, in order."""
    found = [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST["assign"]]
    found += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST["access"]]
    found += [(m.start(), m.end(), 2) for m in re.finditer(r"[0-9a-f]{24,}", text)]
    return sorted(found, key=lambda s: (s[0], s[2]))


def scan(buf: TextBuffer) -> tuple[list[list[tuple[int, int, int]]], np.ndarray, np.ndarray, np.ndarray]:
    """Base spans of each text by characters, and the candidates: text, start and end byte in the buffer."""
    spans: list[list[tuple[int, int, int]]] = [[] for _ in range(buf.n)]
    data = buf.data
    # all texts as one string; what stands between them (a zero) is in no pattern
    chars = np.concatenate([[0], np.cumsum(LEAD[data], dtype=np.int64)])
    first = chars[buf.offsets[:-1]] + np.arange(buf.n)
    whole = "\x00".join(buf.text_of(i) for i in range(buf.n))
    for kind, pattern, group in ((0, ASSIGN, 2), (1, ACCESS, 0)):
        for m in pattern.finditer(whole):
            if m.end(group) - m.start(group) >= LEAST[KINDS[kind]]:
                i = int(np.searchsorted(first, m.start(), "right")) - 1
                spans[i].append((m.start() - int(first[i]), m.end() - int(first[i]), kind))
    starts, ends = buf.spans(_HEX[data])
    long = ends - starts >= LEAST["hex"]
    for a, b in zip(starts[long], ends[long], strict=True):
        i = int(buf.owner(a))
        spans[i].append((int(chars[a] - chars[buf.offsets[i]]), int(chars[b] - chars[buf.offsets[i]]), 2))
    for own in spans:
        own.sort(key=lambda s: (s[0], s[2]))
    starts, ends = buf.spans(_BODY[data])
    digits = np.concatenate([[0], np.cumsum(_DIGIT[data], dtype=np.int64)])
    size, some = ends - starts, digits[ends] > digits[starts]
    use = (some & (size >= WITH_DIGIT)) | (size >= WITHOUT)
    starts, ends = starts[use], ends[use]
    return spans, buf.owner(starts), starts, ends


def around(buf: TextBuffer, owner: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[tuple[bytes, bytes, bytes]]:
    """Each candidate whole, with the bytes before and after it in its text."""
    first, last = np.maximum(starts - BEFORE, buf.offsets[owner]), np.minimum(ends + AFTER, buf.offsets[owner + 1])
    cut = lambda a, b: buf.data[a:b].tobytes()
    return [(cut(f, a), cut(a, b), cut(b, x)) for f, a, b, x in zip(first.tolist(), starts.tolist(), ends.tolist(), last.tolist(), strict=True)]


def _confirmed(buf: TextBuffer, spans: list[list[tuple[int, int, int]]], owner: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Whether each candidate meets a base span; its start and end by characters."""
    chars = np.concatenate([[0], np.cumsum(LEAD[buf.data], dtype=np.int64)])
    a, b = (chars[x] - chars[buf.offsets[owner]] for x in (starts, ends))
    return np.array([any(s < y and e > x for s, e, _ in spans[i]) for i, x, y in zip(owner, a, b, strict=True)], bool), a, b


_NAMES = ("before", "own", "after")


def findings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(before, own, after, kind), each once: all candidates of all texts, confirmed (1) or not (0), and of each text the first and the longest ordinary word (2)."""

    def gather(batches):
        for piece in chunks(batches, "_text"):
            buf = TextBuffer(piece.column("_text"))
            spans, owner, starts, ends = scan(buf)
            yes, _, _ = _confirmed(buf, spans, owner, starts, ends)
            a, b = buf.spans(_BODY[buf.data])
            plain = np.flatnonzero((b - a >= 6) & ~np.isin(a, starts))
            text, longest = buf.owner(a[plain]), np.lexsort((a[plain], (a - b)[plain], buf.owner(a[plain])))
            plain = np.unique(np.concatenate([plain[np.unique(text, return_index=True)[1]], plain[longest[np.unique(text[longest], return_index=True)[1]]]]))
            rows = around(buf, np.concatenate([owner, buf.owner(a[plain])]), np.concatenate([starts, a[plain]]), np.concatenate([ends, b[plain]]))
            kind = np.concatenate([np.where(yes, 1, 0), np.full(len(plain), 2)])
            yield pa.RecordBatch.from_arrays([*(pa.array([r[k] for r in rows], pa.binary()) for k in range(3)), pa.array(kind, pa.int32())], names=[*_NAMES, "kind"])

    return docs.select(F.col(text_col).alias("_text")).mapInArrow(gather, "before binary, own binary, after binary, kind int").groupBy(*_NAMES).agg(F.min("kind").alias("kind"))


def examples(part: pa.Table) -> tuple[list[tuple[bytes, bytes, bytes]], np.ndarray]:
    """What one part is trained on, with what is made of its rows; the same for the same rows in any order."""
    part = part.sort_by([(c, "ascending") for c in ("own", "before", "after")])
    rows, kind = [*zip(*(part.column(c).to_pylist() for c in _NAMES), strict=True)], part.column("kind").to_numpy()
    other, confirmed, plain = ([r for r, k in zip(rows, kind, strict=True) if k == own] for own in range(3))
    rng = np.random.default_rng(11)
    yes = confirmed + (respelled(confirmed, other + plain, rng) if other or plain else [])
    no = other + plain[::3] + joined_words(plain[1::3], rng) + look_alikes(plain[2::3], rng)  # each word is one of the three
    return yes + no, np.concatenate([np.ones(len(yes)), np.zeros(len(no))])


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Network | None:
    """Fit on the ``findings`` of all rows; None where they lack confirmed or other ones. The driver sees sums of weights and counts of logits alone."""
    found = written(findings(docs, id_col, text_col))
    size = sum((F.length(c) for c in _NAMES), F.lit(0)).cast("long")
    counts = {r["kind"]: r for r in found.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.sum(size).alias("bytes")).collect()}
    n = [counts[k]["n"] if k in counts else 0 for k in range(3)]
    if n[1] < 10 or n[0] + n[2] < 10:
        return None
    share, total = 2 * n[1] / (2 * n[1] + n[0] + n[2]), sum(r["bytes"] for r in counts.values())
    parts = max(1, -(-sum(n) // (2 * PART_ROWS)), -(-total // (2 * PART_BYTES)))  # of each of two folds
    # one finding in several surroundings is in one fold
    dealt = found.withColumns({"_fold": F.pmod(F.xxhash64("own"), F.lit(2)).cast("int"), "_part": F.pmod(F.xxhash64(*_NAMES), F.lit(parts)).cast("int")})
    context, nets = docs.sparkSession.sparkContext, [untrained() for _ in range(3)]  # the third learns from both folds, each other from the other one
    for turn in range(ROUNDS):
        shared = context.broadcast(nets)

        def learn(part: pa.Table) -> pa.Table:
            rows, y = examples(part)
            use = (1 - part.column("_fold")[0].as_py(), 2)
            made = [train(rows, y, EPOCHS, shared.value[k], share, turn).weights() * len(rows) for k in use]  # noqa: B023
            return pa.table({"net": pa.array(use, pa.int32()), "n": pa.array([len(rows)] * 2, pa.int64()), "w": pa.array([w.tolist() for w in made], pa.list_(pa.float64()))})

        each = dealt.groupBy("_fold", "_part").applyInArrow(learn, "net int, n long, w array<double>")
        # sums of decimals, which come out alike in any order
        sums = each.select("net", "n", F.posexplode("w").alias("at", "w")).groupBy("net", "at").agg(F.sum("n").alias("n"), F.sum(F.col("w").cast("decimal(28,8)")).alias("w")).collect()
        for k in range(3):
            own = sorted((r["at"], float(r["w"]) / r["n"]) for r in sums if r["net"] == k)
            nets[k] = nets[k].with_weights(np.array([w for _, w in own])) if own else nets[k]
        shared.unpersist()
    shared = context.broadcast(nets)

    def held_out(part: pa.Table) -> pa.Table:
        rows, y = examples(part)
        return pa.table({"logit": shared.value[part.column("_fold")[0].as_py()].logits(rows), "y": y})

    levels = dealt.groupBy("_fold", "_part").applyInArrow(held_out, "logit double, y double")
    levels = levels.groupBy(F.round(F.least(F.greatest("logit", F.lit(-40.0)), F.lit(40.0)), DECIMALS).alias("logit"), "y").count().orderBy("logit", "y").toArrow()
    forget(found)
    logit, y, times = (levels.column(c).to_numpy() for c in ("logit", "y", "count"))
    net = nets[2]
    net.scale, net.shift = _platt(logit, y, times)
    net.threshold, net.recall = choose_threshold(1 / (1 + np.exp(-np.clip(net.scale * logit + net.shift, -40, 40))), y, times)
    return net


def choose_threshold(p: np.ndarray, y: np.ndarray, times: np.ndarray | None = None) -> tuple[float, float]:
    """(threshold, recall kept): the highest score that keeps RECALL of the confirmed ones, but no lower than LEAST_SCORE, nor
    than where PRECISION of all above are confirmed ones. Where nothing reaches that precision, no span is added (1.1, 0.0).
    ``times``: how often each score with its label occurs."""
    times = np.ones(len(p), np.int64) if times is None else times
    order = np.argsort(-p, kind="stable")
    p, yes, all_ = p[order], np.cumsum((y * times)[order]), np.cumsum(times[order])
    last = np.append(p[1:] != p[:-1], True)  # equal scores pass together
    enough = p[(yes / all_ >= PRECISION) & last]
    if not len(enough):
        return 1.1, 0.0
    # as many confirmed ones may lie below
    below = int((1 - RECALL) * yes[-1])
    threshold = max(float(p[np.searchsorted(yes, yes[-1] - below)]), float(enough[-1]), LEAST_SCORE)
    return threshold, float((y * times)[order][p >= threshold].sum() / yes[-1])


_ALPHABETS = ("0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/")


def respelled(confirmed: list[tuple[bytes, bytes, bytes]], elsewhere: list[tuple[bytes, bytes, bytes]], rng: np.random.Generator) -> list[tuple[bytes, bytes, bytes]]:
    """The confirmed ones in the surroundings of others, without their key words; two of three of them drawn anew from another alphabet."""
    out = []
    for i, (_, own, _) in enumerate(confirmed):
        if i % 3:
            letters = _ALPHABETS[int(rng.integers(len(_ALPHABETS)))]
            own = "".join(letters[k] for k in rng.integers(len(letters), size=max(16, len(own)))).encode()
        before, _, after = elsewhere[int(rng.integers(len(elsewhere)))]
        out.append((before, own, after))
    return out


def joined_words(plain: list[tuple[bytes, bytes, bytes]], rng: np.random.Generator) -> list[tuple[bytes, bytes, bytes]]:
    """Names, paths and addresses with numbers, made of ordinary words: they look like candidates and are no secrets."""
    out = []
    for before, _, after in plain:
        words = [plain[int(k)][1] for k in rng.integers(len(plain), size=int(rng.integers(1, 5)))]
        words.insert(int(rng.integers(len(words) + 1)), str(int(rng.integers(1, 10 ** int(rng.integers(1, 9))))).encode())
        if rng.random() < 0.3:
            words = [w.title() for w in words]
        out.append((before, [b"-", b"_", b"/", b".", b""][int(rng.integers(5))].join(words), after))
    return out


def look_alikes(plain: list[tuple[bytes, bytes, bytes]], rng: np.random.Generator) -> list[tuple[bytes, bytes, bytes]]:
    """Plain numbers (whole, grouped or dated, as cards, phones and times are) and ordinary words run together in capitals: no secrets either."""
    out = []
    for k, (before, _, after) in enumerate(plain):
        digits = "".join(map(str, rng.integers(10, size=int(rng.integers(WITH_DIGIT, 25)))))
        if k % 3 == 0:
            own = digits
        elif k % 3 == 1:
            size, mark = int(rng.integers(2, 6)), "-./_"[int(rng.integers(4))]
            own = mark.join(digits[i : i + size] for i in range(0, len(digits), size))
        else:
            own = ""
            while len(own) < WITHOUT:
                own += plain[int(rng.integers(len(plain)))][1].decode("ascii", "ignore").upper() or "X"
        out.append((before, own.encode(), after))
    return out


def _platt(logit: np.ndarray, y: np.ndarray, times: np.ndarray) -> tuple[float, float]:
    """Scale and shift that make sigmoid(scale * logit + shift) the rate of confirmed ones, by damped Newton steps."""
    w, x = np.array([1.0, 0.0]), np.column_stack([logit, np.ones(len(logit))])
    yes, no = float((y * times).sum()), float(((1 - y) * times).sum())
    aim = np.where(y > 0, (yes + 1) / (yes + 2), 1 / (no + 2))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        w = w - 0.5 * np.linalg.solve((x * (times * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2), x.T @ (times * (p - aim)) + 1e-3 * (w - [1.0, 0.0]))
    return float(w[0]), float(w[1])


def find_secrets(docs: DataFrame, net: Network | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id and spans (kind, start, end, score; code points, end exclusive) in order of start, then of kind.

    Every candidate is scored; those over the threshold that no base span meets are added, and base spans carry the best score of the
    candidates in them (null: none). Null and empty texts have no spans; without a network only base spans are found; repeated rows give
    repeated results; other columns are left out.
    """
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    shared = docs.sparkSession.sparkContext.broadcast(net)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))

    def run(batches):
        for piece in chunks(batches, "_text"):
            buf = TextBuffer(piece.column("_text"))
            spans, owner, starts, ends = scan(buf)
            scores: dict[tuple[int, int, int], float] = {}
            if shared.value is not None and len(starts):
                yes, first, last = _confirmed(buf, spans, owner, starts, ends)
                p = shared.value.probability(around(buf, owner, starts, ends))
                for i, a, b, inside, score in zip(owner.tolist(), first.tolist(), last.tolist(), yes.tolist(), p.tolist(), strict=True):
                    if not inside and score >= shared.value.threshold:
                        spans[i].append((a, b, 3))
                        scores[i, a, 3] = score
                    for s, e, k in spans[i] if inside else ():
                        if s < b and e > a:
                            scores[i, s, k] = max(score, scores.get((i, s, k), 0.0))
            out = [[{"kind": KINDS[k], "start": s, "end": e, "score": scores.get((i, s, k))} for s, e, k in sorted(own, key=lambda x: (x[0], x[2]))] for i, own in enumerate(spans)]
            yield pa.RecordBatch.from_arrays([piece.column("_id"), pa.array(out, kind)], names=[id_col, "spans"])

    return rows.mapInArrow(run, f"`{id_col}` {dict(rows.dtypes)['_id']}, spans array<struct<kind:string,start:long,end:long,score:double>>")


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = find_secrets(docs, fit(docs))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("spans", lambda s: s["kind"] != KINDS[3])
    return found.select("doc_id", *(count(k).alias(f"n_{k}") for k in KINDS[:3]), F.sha2(joined(base), 256).alias("base_sha256"), joined("spans").alias("spans"), count(KINDS[3]).alias("n_model"))
