"""Byte-level encoding by distinct chunks: texts are cut where the tokenizer's own pretokens end, and the tokenizers
library encodes each distinct chunk once while a worker's table holds it.

Cuts are found in array steps over the UTF-8 bytes. The byte-level pattern always ends a pretoken

* where white space starts, and before the last of a run of white space that a visible character follows
  (a blank goes with what follows it, other white space stands alone);
* between a letter and a visible character that is no letter.

Both hold for ASCII white space and for letters of ASCII and Latin-1; further letters just give fewer cuts. A text with
other white space or with the string of a special token is one chunk, which the library encodes as it is. So ids are
the library's for any text. A chunk is known by two 64-bit sums of random table values for (place, byte).
"""

from __future__ import annotations

import functools
import json
import os
import re

import numpy as np
import pandas as pd

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_MARK = np.zeros(256, bool)  # visible ASCII that is no letter
_MARK[33:127] = True
_MARK &= ~_LETTER
#: First bytes of white space outside ASCII, and controls that some patterns take for white space.
_LEADS = np.zeros(256, bool)
_LEADS[[0xC2, 0xE1, 0xE2, 0xE3, 28, 29, 30, 31]] = True
# White space outside ASCII.
_WIDE = ("\x85", "\xa0", " ", "᠎", *map(chr, range(0x2000, 0x200B)), " ", " ", " ", " ", "　", "\x1c", "\x1d", "\x1e", "\x1f")
LONGEST = 256
_WORD = re.compile(rb" ?(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+")
_SUMS = [np.random.Generator(np.random.PCG64(seed)).integers(0, 1 << 64, LONGEST * 256, np.uint64) for seed in (71, 72)]


def odd_places(raw: np.ndarray, data: bytes, specials: tuple[bytes, ...]) -> list[int]:
    """A place in each stretch that the cut rules don't cover."""
    out = []
    lead = np.flatnonzero(_LEADS[raw])
    if len(lead):
        wide = {w.encode() for w in _WIDE}
        for n in (1, 2, 3):
            at = lead[lead + n <= len(raw)]
            code = np.zeros(len(at), np.int64)
            for k in range(n):
                code = code << 8 | raw[at + k]
            out += at[np.isin(code, [int.from_bytes(w, "big") for w in wide if len(w) == n])].tolist()
    for s in specials:
        at = data.find(s)
        while at >= 0:
            out.append(at)
            at = data.find(s, at + 1)
    return out


def cuts(raw: np.ndarray, offsets: np.ndarray, odd: np.ndarray) -> np.ndarray:
    """Chunk starts in the bytes of several texts; offsets are the texts' edges, odd their flags (one chunk)."""
    n = len(raw)
    space = _SPACE[raw]
    first = np.zeros(n + 1, bool)
    first[offsets] = True
    after = np.ones(n, bool)  # the next byte is white space, or there is none
    after[:-1] = space[1:]
    after |= first[1:]
    before = np.zeros(n, bool)
    before[1:] = space[:-1]
    cut = space & (~before | ~after)
    lone = space & (raw != 32)
    cut[1:] |= lone[:-1] & ~space[1:]
    letter = _LETTER[raw]
    tail = np.flatnonzero((raw & 0xC0) == 0x80)  # Latin-1 letters: C3 and a byte other than 97 and B7
    tail = tail[tail > 0]
    letter[tail[(raw[tail - 1] == 0xC3) & (raw[tail] != 0x97) & (raw[tail] != 0xB7)]] = True
    cut[1:] |= letter[:-1] & _MARK[raw[1:]]
    for k in np.flatnonzero(odd).tolist():
        cut[offsets[k] : offsets[k + 1]] = False
    cut |= first[:-1]
    return np.flatnonzero(cut)


class Encoder:
    """ids_of texts; the table holds at most `limit` chunks, of which the older half goes when it is full."""

    def __init__(self, path: str, limit: int = 1 << 21):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.limit = limit
        #: The byte-level alphabet: bytes that are no printable Latin-1 character stand for code points from 256 on.
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        self.alphabet = {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in shown)}
        spec = json.loads(self.tokenizer.to_str())
        pre = spec.get("pre_tokenizer") or {}
        #: Whether the cut rules are this tokenizer's. Of another one each text is a chunk.
        self.known = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space", True) and not spec.get("normalizer")
        self.specials = tuple(t["content"].encode() for t in spec.get("added_tokens") or [])
        self._clear()

    def _clear(self) -> None:
        self.keys, self.checks, self.rows = np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int32)
        self.starts, self.flat = np.zeros(1, np.int32), np.zeros(0, np.int32)

    def _library(self, chunks: list[str]) -> list[list[int]]:
        return [x.ids for x in self.tokenizer.encode_batch_fast(chunks, add_special_tokens=False)]

    def _segment(self, chunks: list[bytes]) -> tuple[list[int], list[int]]:
        """(ids one chunk after another, ids of each chunk). A chunk of letters is one pretoken, so the library's model
        takes it as it is, in the model's alphabet; the others go through the whole of the library."""
        tokenize, alphabet = self.tokenizer.model.tokenize, self.alphabet
        parts = [[t.id for t in tokenize(c.decode("latin-1").translate(alphabet))] if _WORD.fullmatch(c) else None for c in chunks]
        other = [k for k, p in enumerate(parts) if p is None]
        for k, ids in zip(other, self._library([chunks[k].decode() for k in other]), strict=True):
            parts[k] = ids
        return [i for p in parts for i in p], [len(p) for p in parts]

    def _add(self, keys: np.ndarray, checks: np.ndarray, chunks: list[bytes]) -> None:
        """New chunks, ascending by key."""
        flat, sizes = self._segment(chunks)
        rows = np.arange(len(self.starts) - 1, len(self.starts) - 1 + len(chunks), dtype=np.int32)
        self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(sizes, dtype=np.int32)])
        self.flat = np.concatenate([self.flat, np.array(flat, np.int32)])
        at = np.searchsorted(self.keys, keys)
        self.keys, self.checks, self.rows = np.insert(self.keys, at, keys), np.insert(self.checks, at, checks), np.insert(self.rows, at, rows)

    def _halve(self) -> None:
        half = (len(self.starts) - 1) // 2
        keep = self.rows >= half
        self.keys, self.checks, self.rows = self.keys[keep], self.checks[keep], self.rows[keep] - np.int32(half)
        self.flat, self.starts = self.flat[self.starts[half] :].copy(), self.starts[half:] - self.starts[half]

    def ids_of(self, data: bytes, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, number of ids of each) of the texts data[offsets[k] : offsets[k + 1]]."""
        n = len(offsets) - 1
        raw = np.frombuffer(data, np.uint8)
        odd = np.zeros(n, bool)
        if not len(raw):
            return np.zeros(0, np.int32), np.zeros(n, np.int64)
        if self.known:
            at = odd_places(raw, data, self.specials)
            if at:
                odd[np.searchsorted(offsets, at, side="right") - 1] = True
        else:
            odd[:] = True
        starts = cuts(raw, offsets, odd)
        sizes = np.diff(np.append(starts, len(raw)))
        owner = np.searchsorted(offsets, starts, side="right") - 1
        alone = odd[owner] | (sizes > LONGEST)
        place = np.arange(len(raw), dtype=np.int32) - np.repeat(starts.astype(np.int32), sizes)
        place &= LONGEST - 1
        place <<= 8
        place |= raw
        key, check = (np.add.reduceat(table[place], starts) for table in _SUMS)
        del place
        usual = np.flatnonzero(~alone)
        code, heads = pd.factorize(key[usual])
        head = np.empty(len(heads), np.int64)
        head[code[::-1]] = usual[::-1]
        order = np.argsort(heads)
        heads, head = heads[order], head[order]
        if len(self.keys) + len(heads) > self.limit:
            self._halve()
        found = np.searchsorted(self.keys, heads)
        known = found < len(self.keys)
        known[known] = self.keys[found[known]] == heads[known]
        miss = head[~known]
        if len(miss):
            self._add(key[miss], check[miss], [data[a : a + b] for a, b in zip(starts[miss].tolist(), sizes[miss].tolist(), strict=True)])
            found = np.searchsorted(self.keys, heads)
        rows, checks = np.empty(len(heads), np.int64), np.empty(len(heads), np.uint64)
        rows[order], checks[order] = self.rows[found], self.checks[found]
        row = np.zeros(len(starts), np.int64)
        row[usual] = rows[code]
        # Equal first sums of different chunks (never seen) are told apart by the second.
        alone[usual[checks[code] != check[usual]]] = True
        flat, edges = self.flat, self.starts
        own = np.flatnonzero(alone)
        if len(own):
            more = self._library([data[a : a + b].decode() for a, b in zip(starts[own].tolist(), sizes[own].tolist(), strict=True)])
            row[own] = len(edges) - 1 + np.arange(len(own))
            flat = np.concatenate([flat, *more])
            edges = np.concatenate([edges, edges[-1] + np.cumsum([len(x) for x in more])])
        begin = edges[row]
        count = edges[row + 1] - begin
        ends = np.cumsum(count)
        ids = flat[np.repeat(begin - (ends - count), count) + np.arange(ends[-1])]
        total = np.concatenate([[0], ends])
        edge = np.searchsorted(starts, offsets)
        return ids, np.diff(total[edge])


@functools.lru_cache(1)
def encoder(path: str) -> Encoder:
    """One for each Python worker: later tasks find the table filled."""
    return Encoder(path)
