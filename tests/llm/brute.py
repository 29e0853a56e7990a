"""Plain versions of the operators, a few lines each."""

import hashlib
import re
from collections import Counter

import xxhash

LOWER = {i: i + 32 for i in range(65, 91)}
BENCH_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def repeats(texts, length):
    data = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + length] for b in data for i in range(len(b) - length + 1))
    out = []
    for b in data:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = b"\x01" * length
        kept = bytes(x for x, y in zip(b, gone, strict=True) if not y)
        out.append((len(b), sum(gone), sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1])), hashlib.sha256(kept).hexdigest()))
    return out


def contamination(texts, items, window=10):
    words = lambda t: BENCH_WORD.findall((t or "").translate(LOWER))
    windows = {}
    for name, text in items:
        w = words(text)
        for i in range(max(1, len(w) - window + 1)) if w else ():
            windows.setdefault(tuple(w[i : i + window]), set()).add(name)
    out = []
    for text in texts:
        w, hit, found = words(text), set(), set()
        for size in set(map(len, windows)):
            for i in range(len(w) - size + 1):
                if own := windows.get(tuple(w[i : i + size])):
                    hit |= set(range(i, i + size))
                    found |= own
        out.append((len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()))
    return out


def simhash(text):
    words = WORD.findall((text or "").translate(LOWER))
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).encode(), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def near_groups(ids, prints, threshold=3):
    root = list(range(len(ids)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= threshold:
                root[find(i)] = find(j)
    least = {}
    for i, x in enumerate(ids):
        if x is not None:
            least[find(i)] = min(least.get(find(i), x), x)
    return [least.get(find(i)) for i in range(len(ids))]


def statistics(text):
    text = text or ""
    words = WORD.findall(text)
    grams = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    hit = {k for i in range(len(words) - 4) if grams[tuple(words[i : i + 5])] > 1 for k in range(i, i + 5)}
    lines, seen, dup = text.split("\n"), set(), 0
    for line in lines:
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(hit)


def secrets(text):
    text = text or ""
    assign = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
    found = [(m.start(), 0, "assign", m.end()) for m in assign.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return ",".join(f"{k}:{a}:{b}" for a, _, k, b in sorted(found))


def mix_targets(sizes, weights=(5, 2, 1), share=1.5, cap=2):
    """Source -> target, by sharing the excess again until none is above its cap."""
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, open_, left = {}, set(names), share * sum(sizes.values())
    while open_:
        total = sum(weight[s] for s in open_)
        over = [s for s in open_ if left * weight[s] / total > cap * sizes[s]]
        if not over:
            return target | {s: left * weight[s] / total for s in open_}
        for s in over:
            target[s] = cap * sizes[s]
            open_.discard(s)
        left = share * sum(sizes.values()) - sum(target.values())
    return target


def smallest_capacity(sizes, shards):
    def need(cap):
        n, load = 1, 0
        for x in sizes:
            n, load = (n + 1, x) if load + x > cap else (n, load + x)
        return n

    cap = max(sizes)
    while need(cap) > shards:
        cap += 1
    return cap


def cut_slots(pages, slots):
    """Host (None: all) -> paths to cut, from (host, slots of a page) with vectors written out in full."""
    seen = {}
    for nth, (host, html) in enumerate(pages):
        for h in (host, None):
            for path, token, n, chars, linked, text in slots(html):
                s = seen.setdefault((h, path), {}).setdefault(token, {"vector": [], "chars": 0, "linked": 0, "pages": set(), "texts": set()})
                s["vector"].append((nth, n))
                s["chars"] += chars
                s["linked"] += linked
                s["pages"].add(html)
                s["texts"].add(text)
    out = {}
    for (host, path), tokens in seen.items():
        tag = tokens[0]
        fixed = sum(s["chars"] for token, s in tokens.items() if token and s["vector"] == tag["vector"])
        if tag["chars"] and len(tag["pages"]) >= 3 and (2 * fixed >= tag["chars"] or 2 * tag["linked"] >= tag["chars"] or 2 * len(tag["texts"]) < len(tag["pages"])):
            out.setdefault(host, set()).add(path)
    return out


class KneserNey:
    """One language's interpolated 4-gram model, from its 4-grams and their counts."""

    def __init__(self, grams):
        self.counts = [None, None, None, grams]
        for k in (2, 1, 0):
            self.counts[k] = Counter(g[1:] for g in self.counts[k + 1])

    def p(self, gram, alphabet):
        if not gram:
            return 1 / alphabet
        own = self.counts[len(gram) - 1]
        lower = self.p(gram[1:], alphabet)
        after = [n for g, n in own.items() if g[:-1] == gram[:-1]]
        if not after:
            return lower
        ones, twos = (sum(n == k for n in own.values()) for k in (1, 2))
        discount = ones / (ones + 2 * twos) if ones and twos else 0.5
        return max(own.get(gram, 0) - discount, 0) / sum(after) + discount * len(after) / sum(after) * lower
