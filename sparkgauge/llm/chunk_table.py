"""Distinct-chunk tables: each distinct chunk is segmented once, ids are joined back by position."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterable

import numpy as np

from .common import mixed

_POWER = np.uint64(0xD1342543DE82EF95)


def dealt(lists: Iterable[list[str]], n_buckets: int) -> tuple[list[str], np.ndarray]:
    """The distinct chunks of the lists by bucket, in a bucket by first place, and how many each bucket has. A chunk's bucket
    depends on the chunk alone; `n_buckets` is a power of two, two at least."""
    words = list(dict.fromkeys(itertools.chain.from_iterable(lists)))
    n = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(n)
    codes = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.uint64)
    powers = np.cumprod(np.full(int(n.max(initial=0)), _POWER))
    at = np.arange(len(codes)) - np.repeat(ends - n, n)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed(codes + np.uint64(1)) * powers[at], dtype=np.uint64)])
    key = mixed(total[ends] - total[ends - n] + n.astype(np.uint64))
    bucket = (key >> np.uint64(65 - n_buckets.bit_length())).astype(np.int64)
    order = np.argsort(bucket, kind="stable").tolist()
    return [words[i] for i in order], np.bincount(bucket, minlength=n_buckets)


class ChunkTable:
    """The id run of each distinct chunk: `counts` ids a chunk, one run after another in `flat`."""

    def __init__(self, words: list[str], counts: np.ndarray, flat: np.ndarray):
        self.rows = dict(zip(words, range(len(words)), strict=True))
        self.starts = np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])
        self.flat = flat

    @classmethod
    def segmented(cls, words: list[str], segment: Callable[[list[str]], list[list[int]]]) -> ChunkTable:
        ids = segment(words)
        return cls(words, np.fromiter(map(len, ids), np.int64, len(ids)), np.fromiter(itertools.chain.from_iterable(ids), np.int32))

    def runs(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """How many ids each of the chunks has, and their ids one run after another."""
        rows = np.fromiter(map(self.rows.__getitem__, chunks), np.int64, len(chunks))
        start = self.starts[rows]
        n = self.starts[rows + 1] - start
        return n, self.flat[np.repeat(start - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]
