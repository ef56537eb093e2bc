"""CRCs of word n-grams by combination: each word's CRC-32 is computed once, and an n-gram's is composed from its words'
with length-shift matrices over GF(2). No n-gram is ever a string.

With c(x) the CRC of bytes x, c(xy) = Z^len(y) c(x) ^ c(y), where Z, a 32 x 32 bit matrix, moves a CRC past one zero byte. Z^n is
the product of the Z^(2^k) of n's bits, each kept as four tables of 256 values.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np

#: The reflected polynomial of CRC-32.
POLYNOMIAL = 0xEDB88320
#: Words of more bytes than this are taken by zlib, one by one; shorter ones all together, a byte at a time.
LONG_WORD = 64
#: Bytes of text handled at a time; a cut waits for the end of a word.
PIECE = 1 << 20


@cache
def byte_table() -> np.ndarray:
    """The step of a CRC by each byte value."""
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = (t >> np.uint32(1)) ^ (np.uint32(POLYNOMIAL) * (t & np.uint32(1)))
    return t


@cache
def zero_shift(k: int) -> np.ndarray:
    """Z^(2^k) as tables by byte: (4, 256)."""
    bits = np.uint32(1) << np.arange(32, dtype=np.uint32)
    image = (bits >> np.uint32(8)) ^ byte_table()[bits & np.uint32(255)] if k == 0 else _times(zero_shift(k - 1), _times(zero_shift(k - 1), bits))
    tables = np.zeros((4, 256), np.uint32)
    for bit in range(32):
        has = (np.arange(256) >> (bit % 8)) & 1 == 1
        tables[bit // 8, has] ^= image[bit]
    return tables


def _times(tables: np.ndarray, crcs: np.ndarray) -> np.ndarray:
    out = tables[0][crcs & np.uint32(255)]
    for j in (1, 2, 3):
        out ^= tables[j][(crcs >> np.uint32(8 * j)) & np.uint32(255)]
    return out


def shifted(crcs: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Each CRC moved past so many zero bytes."""
    out, k = crcs.copy(), 0
    while len(lengths) and int(lengths.max()) >> k:
        at = np.flatnonzero((lengths >> k) & 1)
        out[at] = _times(zero_shift(k), out[at])
        k += 1
    return out


def combined(left: np.ndarray, right: np.ndarray, right_lengths: np.ndarray) -> np.ndarray:
    """The CRCs of left and right strings put together."""
    return shifted(left, right_lengths) ^ right


def word_crcs(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    table, crcs = byte_table(), np.full(len(starts), 0xFFFFFFFF, np.uint32)
    order = np.argsort(-lengths, kind="stable")  # the words that have a j-th byte come first
    first, sizes, c = starts[order], lengths[order], crcs[order]
    n_long = int(np.searchsorted(-sizes, -LONG_WORD, "left"))
    for j in range(int(sizes[n_long]) if n_long < len(sizes) else 0):
        m = int(np.searchsorted(-sizes, -j, "left"))
        part = c[n_long:m]
        c[n_long:m] = (part >> np.uint32(8)) ^ table[(part ^ data[first[n_long:m] + j]) & np.uint32(255)]
    c ^= np.uint32(0xFFFFFFFF)
    for i in range(n_long):
        c[i] = zlib.crc32(data[first[i] : first[i] + sizes[i]].tobytes())
    crcs[order] = c
    return crcs


def ngram_crcs(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray, most: int, piece: int = PIECE) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """(row, crc, n) of the runs of 1 .. most words, each row's bytes being data[offsets[i]:offsets[i + 1]]; words are runs
    of bytes that is_word names. Words are joined by one space. Pieces follow each other; the last words of one are carried on."""
    at, end = int(offsets[0]), int(offsets[-1])
    crcs, lengths, rows = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)
    space = np.uint32(zlib.crc32(b" "))
    while at < end:
        to = min(at + piece, end)
        while to < end and is_word[data[to]]:  # never inside a word
            rest = ~is_word[data[to : to + 4096]]
            to += int(rest.argmax()) if rest.any() else len(rest)
        word = is_word[data[at:to]]
        new_row = np.zeros(to - at + 1, bool)
        inside = offsets[np.searchsorted(offsets, at) : np.searchsorted(offsets, to, "right")]
        new_row[inside - at] = True
        before, after = np.concatenate([[False], word[:-1]]), np.concatenate([word[1:], [False]])
        starts = np.flatnonzero(word & (~before | new_row[:-1])) + at
        ends = np.flatnonzero(word & (~after | new_row[1:])) + at + 1
        held = len(crcs)
        crcs = np.concatenate([crcs, word_crcs(data, starts, ends - starts)])
        lengths = np.concatenate([lengths, ends - starts])
        rows = np.concatenate([rows, np.searchsorted(offsets, starts, "right") - 1])
        grams = crcs
        for n in range(1, most + 1):
            if n > 1:
                grams = combined(combined(grams[:-1], np.full(len(grams) - 1, space), np.ones(len(grams) - 1, np.int64)), crcs[n - 1 :], lengths[n - 1 :]) if len(grams) else grams
            # A run is new if its last word is; it ends in the row where it starts.
            fresh = np.arange(len(grams)) + n - 1 >= held
            fresh &= rows[: len(grams)] == rows[n - 1 : n - 1 + len(grams)]
            yield rows[: len(grams)][fresh], grams[fresh], n
        keep = max(len(crcs) - most + 1, 0)
        crcs, lengths, rows = crcs[keep:], lengths[keep:], rows[keep:]
        at = to
