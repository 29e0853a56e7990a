"""A column of texts seen as one buffer of UTF-8 bytes, cut into words and hashed with numpy.

Every Arrow-side operator of this package works on these buffers, half a megabyte at a time, so
that the memory of a task is bounded by ``CHUNK`` and by its longest single text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are worked on at once.
CHUNK = 1 << 19
_BASE = 0x9E3779B97F4A7C15 | 1
#: Primes below 2^31 and a base for each. Modulo 2^64 some strings collide for every base (Thue-Morse); modulo a prime none do.
_PRIMES = ((2147483647, 1289706101), (2147483629, 1807369081))
_powers: dict[tuple[int, int], np.ndarray] = {}


def powers(n: int, base: int, modulus: int) -> np.ndarray:
    """base^0 .. base^(n-1); a modulus of 0 stands for 2^64, others are below 2^32."""
    if len(_powers.get((base, modulus), ())) < n:
        size, p = max(n, CHUNK + 1024), np.ones(1, np.uint64)
        while len(p) < size:  # the powers known, times the next one
            step, more = np.uint64(pow(base, len(p), modulus or 1 << 64)), p[: size - len(p)]
            p = np.concatenate([p, more * step % np.uint64(modulus) if modulus else more * step])
        _powers[base, modulus] = p.astype(np.uint32) if modulus else p
    return _powers[base, modulus][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: spreads every bit over all others."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def chunks(batches: Iterable[pa.RecordBatch], column: str, limit: int = CHUNK) -> Iterator[pa.RecordBatch]:
    """The batches cut so that the texts of each piece hold about ``limit`` bytes; a longer text comes alone."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        total, first = np.concatenate([[0], np.cumsum(size, dtype=np.int64)]), 0
        while first < batch.num_rows:
            last = int(np.searchsorted(total, total[first] + limit, "right")) - 1
            last = min(max(last, first + 1), batch.num_rows)
            yield batch.slice(first, last - first)
            first = last
        pa.default_memory_pool().release_unused()  # what one batch needed is not kept while the next is read


class TextBuffer:
    """``data``: the bytes of all texts; text i is ``data[offsets[i]:offsets[i + 1]]``. A null text is empty."""

    def __init__(self, column: pa.Array) -> None:
        column = pc.fill_null(column.cast(pa.large_string()), "")
        _, offsets, data = column.buffers()
        n = len(column)
        off = np.frombuffer(offsets, np.int64, n + 1, column.offset * 8) if n else np.zeros(1, np.int64)
        raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
        self.data = raw[off[0] : off[-1]]
        self.offsets = off - off[0]
        self.n = n
        self._sums: list[np.ndarray] = []

    def text_of(self, i: int) -> str:
        return self.data[self.offsets[i] : self.offsets[i + 1]].tobytes().decode("utf-8")

    def lower_ascii(self) -> "TextBuffer":
        """The same with A-Z as a-z."""
        self.data = LOWER[self.data]
        self._sums = []
        return self

    def spans(self, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the maximal runs of bytes where ``inside`` holds; a run never leaves its text."""
        if not len(inside):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        edge = np.zeros(len(inside) + 1, bool)
        edge[self.offsets] = True
        before = np.concatenate([[False], inside[:-1]])
        after = np.concatenate([inside[1:], [False]])
        starts = np.flatnonzero(inside & (~before | edge[:-1]))
        ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
        return starts, ends

    def owner(self, positions: np.ndarray) -> np.ndarray:
        """The text that holds each byte position."""
        return np.searchsorted(self.offsets, positions, "right") - 1

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """A 64-bit hash of each byte string data[start:end], from prefix sums of a polynomial modulo two primes."""
        n = len(self.data)
        if not self._sums:
            for prime, base in _PRIMES:
                terms = (self.data.astype(np.uint64) + np.uint64(1)) * powers(max(1, n), base, prime)[:n]
                if n >= 1 << 24:  # sums of more terms could pass 2^64
                    terms %= np.uint64(prime)
                self._sums.append(np.concatenate([[np.uint64(0)], np.cumsum(terms)]))
        out = (ends - starts).astype(np.uint64)
        for (prime, base), sums in zip(_PRIMES, self._sums, strict=True):
            down = powers(n + 1, pow(base, -1, prime), prime)
            own = (sums[ends] - sums[starts]) % np.uint64(prime) * down[starts] % np.uint64(prime)
            out = mix(out ^ own << np.uint64(20))
        return out

    def grams(self, size: int) -> np.ndarray:
        """A quick 64-bit hash of the ``size`` bytes from each position on; equal hashes need not mean equal bytes."""
        n = len(self.data)
        sums = np.concatenate([[np.uint64(0)], np.cumsum((self.data.astype(np.uint64) + np.uint64(1)) * powers(max(1, n), _BASE, 0)[:n])])
        count = max(0, n - size + 1)
        return mix((sums[size : size + count] - sums[:count]) * powers(count, pow(_BASE, -1, 1 << 64), 0)[:count])

    def counts(self, owner: np.ndarray, weights: np.ndarray | None = None) -> np.ndarray:
        """Per text: how many, or the sum of integer weights."""
        out = np.bincount(owner, weights, self.n)
        return out if weights is None else np.rint(out).astype(np.int64)


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of `[^\x20\x09-\x0D]`.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
#: Bytes that begin a code point.
LEAD = (np.arange(256) & 0xC0) != 0x80


def per_document(fn: Callable[[pa.RecordBatch], dict[str, object]], column: str, limit: int = CHUNK) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function for mapInArrow that turns each piece of ``chunks`` into a batch of new columns."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in chunks(batches, column, limit):
            yield pa.RecordBatch.from_pydict(fn(piece))

    return run
