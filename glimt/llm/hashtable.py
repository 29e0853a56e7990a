"""Sorted arrays of 64-bit hashes with a value or a row of values each."""

from __future__ import annotations

import numpy as np

from glimt.llm.textbuf import mix


class HashTable:
    """Hashes in order; their leading bits say where to look for one."""

    def __init__(self, keys: np.ndarray, values: np.ndarray, dtype: type = np.float32) -> None:
        hashed = mix(keys)
        order = np.argsort(hashed)
        self.keys, self.values = hashed[order], np.ascontiguousarray(values[order], dtype)
        self.bits = np.uint64(64 - max(4, int(len(keys)).bit_length() + 1))
        bucket = (self.keys >> self.bits).astype(np.int64)
        self.first = np.searchsorted(bucket, np.arange((1 << (64 - int(self.bits))) + 1)).astype(np.int32)
        self.most = int(np.diff(self.first).max(initial=0))

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The row of each key, or -1."""
        if not len(self.keys):
            return np.full(len(keys), -1, np.int64)
        hashed = mix(keys)
        at = self.first[(hashed >> self.bits).astype(np.int64)].astype(np.int64)
        last = len(self.keys) - 1
        np.minimum(at, last, out=at)
        open_ = np.flatnonzero(self.keys[at] < hashed)
        for _ in range(self.most):
            if not len(open_):
                break
            at[open_] = np.minimum(at[open_] + 1, last)
            open_ = open_[(self.keys[at[open_]] < hashed[open_]) & (at[open_] < last)]
        at[self.keys[at] != hashed] = -1
        return at
