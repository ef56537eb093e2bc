"""Suffix-array deduplication of byte stretches.

A byte goes if a WIDTH-byte string that covers it also starts in a document with a smaller doc_id. Sorting all
suffixes of the corpus would shuffle WIDTH bytes for each byte of text, so suffixes that can't repeat are left out first:

1. Every window of WIDTH bytes has an anchor: the least hash of the GRAM-byte strings in it. Equal windows have equal
   anchors. Neighbouring windows with one anchor form a segment, of at most SEGMENT windows.
2. A round (exchange.py) counts each anchor in the corpus. Windows of anchors that one segment alone has are unique.
3. The suffix at the start of each other segment is sorted, told apart over the whole segment: it stands for the segment's
   neighbouring suffixes, which are equal where it is. Segments in larger documents go as a whole; where all segments of an
   anchor are equal, nothing else is left to compare.
4. The windows of the rest, in their smallest document, are sorted one suffix each.

Both sorts go alike. Splitters sampled from the texts range-partition suffixes by their leading eight bytes; a batch sends
each distinct suffix once, as those bytes and a 64-bit hash of the segment or window. A bucket sorts by multikey quicksort
(the leading word, then only in runs of ties the next word), and compares neighbours: equal suffixes get their smallest doc_id.
A leading word that fills more than a bucket is split by the next word, and an edge is a pair of both, so a run of equal
suffixes never straddles a bucket's edge.

A batch sends each key once whatever its documents' number, so a passage in all documents is one entry a batch.

Null text: as empty, nothing goes. Under WIDTH bytes: nothing goes. Long texts: whole. Rows with the same doc_id never
remove from each other (strings must start in a smaller doc_id). Null doc_id: no order among documents, so nothing goes and nothing
goes for it. Empty table: no rows. Other columns of the table are carried through the stage unread, whatever their names.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, discard, mixed, release
from .exchange import answers_for, ask, ask_least, batches, buckets_for, by_batch, least_for, opened

WIDTH, GRAM = 50, 26
SEGMENT = WIDTH - GRAM + 1
_P = np.uint64(0xD1342543DE82EF95)
_BYTE = mixed(np.arange(1, 257, dtype=np.uint64))
_BLOCK = 1 << 17
#: Places in the texts that splitters are chosen from, at least.
PLACES = 1 << 14


def _grams(raw: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the GRAM bytes from each place, by doubling."""
    h, size, power = _BYTE[raw], 1, _P
    out, done = None, 0
    k = GRAM
    with np.errstate(over="ignore"):
        while True:
            if k & 1:
                if out is None:
                    out, done = h, size
                else:
                    n = len(h) - done
                    out = out[:n] * power + h[done : done + n]
                    done += size
            k >>= 1
            if not k:
                return mixed(out)
            n = len(h) - size
            h = h[:n] * power + h[size:]
            size, power = size * 2, power * power


def _least(h: np.ndarray, width: int) -> np.ndarray:
    """Minimum over each `width` neighbours."""
    size, out = 1, h
    while size * 2 <= width:
        out = np.minimum(out[:-size], out[size:])
        size *= 2
    rest = width - size
    return np.minimum(out[:-rest], out[rest:]) if rest else out


def segments(ids: np.ndarray, lengths: np.ndarray, body: bytes) -> tuple[np.ndarray, ...]:
    """(row of the document, first window's place in body, windows, anchor, content hash) of each segment, and
    the GRAM hashes by place."""
    raw = np.frombuffer(body, np.uint8)
    ends = np.cumsum(lengths)
    starts = ends - lengths
    if len(raw) < WIDTH:
        z = np.zeros(0, np.int64)
        return z, z, z, z.astype(np.uint64), z.astype(np.uint64), z.astype(np.uint64)
    # Filled block by block: these two are the large arrays of a batch, eight bytes a place each.
    anchor, gram = np.empty(len(raw) - WIDTH + 1, np.uint64), np.empty(len(raw) - GRAM + 1, np.uint64)
    for lo in range(0, len(anchor), _BLOCK):
        hi = min(lo + _BLOCK, len(anchor))
        h = _grams(raw[lo : hi + WIDTH - 1])
        anchor[lo:hi] = _least(h, SEGMENT)[: hi - lo]
        gram[lo : lo + len(h)] = h
    new = np.ones(len(anchor), bool)
    new[1:] = anchor[1:] != anchor[:-1]
    inner = starts[starts < len(anchor)]
    new[inner] = True
    # Windows that reach past a document's end are not windows.
    over = np.zeros(len(raw) + 1, np.int32)
    np.add.at(over, np.maximum(starts, ends - WIDTH + 1), 1)
    np.add.at(over, ends, -1)
    np.cumsum(over, out=over)
    bad = over[: len(anchor)] > 0
    del over
    new[1:] |= bad[1:] != bad[:-1]
    first = np.flatnonzero(new)
    n = np.diff(np.append(first, len(anchor)))
    good = ~bad[first]
    first, n = first[good], n[good]
    if (n > SEGMENT).any():  # periodic text: one anchor for long
        pieces = -(-n // SEGMENT)
        k = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        whole_n = np.repeat(n, pieces)
        first = np.repeat(first, pieces) + k * SEGMENT
        n = np.minimum(SEGMENT, whole_n - k * SEGMENT)
    doc = np.searchsorted(ends, first, side="right")
    last = first + n - 1
    with np.errstate(over="ignore"):
        content = mixed(gram[first] * np.uint64(3) + mixed(gram[first + WIDTH - GRAM] + np.uint64(5)) + mixed(gram[last + WIDTH - GRAM] * np.uint64(7) + n.astype(np.uint64)))
    return doc, first, n, anchor[first], content, gram


class Windows:
    """What a batch asks and learns, round by round; recomputed from its bytes in each."""

    def __init__(self, row):
        self.ids, self.lengths, self.body = opened(row)
        self.doc, self.first, self.n, self.anchor, self.content, self.gram = segments(self.ids, self.lengths, self.body)
        self.id = self.ids[self.doc] if len(self.ids) else self.doc

    def leading(self, at: np.ndarray) -> np.ndarray:
        """The leading eight bytes of the suffixes at these places, in their order."""
        raw = np.frombuffer(self.body, np.uint8)
        lead = np.zeros(len(at), np.uint64)
        for k in range(8):
            lead = (lead << np.uint64(8)) | raw[at + k].astype(np.uint64)
        return lead

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct anchors and how many (document, segment) pairs have each."""
        order = np.lexsort((self.id, self.content, self.anchor))
        a, c, d = self.anchor[order], self.content[order], self.id[order]
        new = np.ones(len(a), bool)
        new[1:] = (a[1:] != a[:-1]) | (c[1:] != c[:-1]) | (d[1:] != d[:-1])
        keys, counts = np.unique(a[new], return_counts=True)
        return keys, counts

    def hear_anchors(self, got: pd.DataFrame) -> None:
        keys = np.unique(self.anchor)
        self.anchor_count = answers_for(keys, got[got.kind == 0], dtype=np.uint32)[np.searchsorted(keys, self.anchor)].astype(np.int64)
        self.live = np.flatnonzero(self.anchor_count > 1)
        key = self.leading(self.first[self.live])
        more, doc = self.content[self.live], self.id[self.live]
        order = np.lexsort((doc, more, key))
        key, more, doc = key[order], more[order], doc[order]
        head = np.ones(len(key), bool)
        head[1:] = (key[1:] != key[:-1]) | (more[1:] != more[:-1])
        pair = head.copy()
        pair[1:] |= doc[1:] != doc[:-1]
        first = np.flatnonzero(head)
        self.entry = np.empty(len(order), np.int64)
        self.entry[order] = np.cumsum(head) - 1
        self.pairs = key[first], more[first], doc[first], (np.add.reduceat(pair, first) if len(first) else first)

    def hear_pairs(self, got: pd.DataFrame) -> None:
        least, total = least_for(got[got.kind == 1])
        least, total = least[self.entry], total[self.entry]
        own = self.id[self.live]
        self.whole = self.live[least < own]
        self.rest = self.live[(least == own) & (total != self.anchor_count[self.live])]
        n = self.n[self.rest]
        self.at = np.repeat(self.first[self.rest] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        self.at_id = np.repeat(self.id[self.rest], n)
        lead = self.leading(self.at)
        more = mixed(self.gram[self.at] * np.uint64(3) + mixed(self.gram[self.at + WIDTH - GRAM])) if len(self.at) else lead
        order = np.lexsort((self.at_id, more, lead))
        lead, more, doc = lead[order], more[order], self.at_id[order]
        head = np.ones(len(lead), bool)
        head[1:] = (lead[1:] != lead[:-1]) | (more[1:] != more[:-1])
        first = np.flatnonzero(head)
        self.suffix = np.empty(len(order), np.int64)
        self.suffix[order] = np.cumsum(head) - 1
        self.suffixes = lead[first], more[first], doc[first], np.ones(len(first), np.int64)

    def removed(self, got: pd.DataFrame) -> np.ndarray:
        """Whether each byte of the batch goes."""
        least, _ = least_for(got[got.kind == 2])
        hit = self.at[least[self.suffix] < self.at_id]
        turn = np.zeros(len(self.body) + 1, np.int32)
        np.add.at(turn, hit, 1)
        np.add.at(turn, hit + WIDTH, -1)
        np.add.at(turn, self.first[self.whole], 1)
        np.add.at(turn, self.first[self.whole] + self.n[self.whole] + WIDTH - 1, -1)
        return np.cumsum(turn, out=turn)[:-1] > 0


def _anchor_keys(row):
    return Windows(row).anchors()


def _pairs(row, got):
    w = Windows(row)
    w.hear_anchors(got)
    return w.pairs


def _suffixes(row, got):
    w = Windows(row)
    w.hear_anchors(got)
    w.hear_pairs(got)
    return w.suffixes


def splitters(table: DataFrame, buckets: int, each: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """Edges (leading word, next word) that split the suffixes about evenly, from places in some batches: PLACES at
    least, and 16 for each bucket."""

    def leads(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for row in f.itertuples():
                body = opened(row)[2]
                out += [int.from_bytes(body[int(p) : int(p) + 8].ljust(8, b"\0"), "big", signed=False) - (1 << 63) for p in np.linspace(0, max(0, len(body) - WIDTH), each)]
            yield pd.DataFrame({"lead": out}, dtype="int64")

    one_in = max(1, table.count() * each // max(PLACES, 16 * buckets))
    some = table.where(F.pmod(F.xxhash64("batch"), F.lit(one_in)) == 0)
    return edges_of(np.array(sorted(r.lead + (1 << 63) for r in some.mapInPandas(leads, "lead long").collect()), np.uint64), buckets)


def edges_of(leads: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges at even ranks of ascending leading words. Where a word holds several ranks, the next word, a hash, splits it
    at the rank's share of the word's places."""
    rank = np.unique(len(leads) * np.arange(1, buckets) // buckets) if len(leads) else np.zeros(0, np.int64)
    word = leads[rank]
    lo, hi = np.searchsorted(leads, word), np.searchsorted(leads, word, side="right")
    return word, ((rank - lo) / np.maximum(hi - lo, 1) * 2.0**64).astype(np.uint64)


def anchor_edges(n_buckets: int) -> np.ndarray:
    """Edges of buckets that anchors fill evenly.

    An anchor is the least of SEGMENT hashes, so anchors crowd at the low end: a third of them lie in the first 64th of
    the range. A hash at the share x of the range is some window's least with (1 - x)^(w - 1) * (1 + (w - 1) x), w = SEGMENT,
    whose integral, with y = 1 - x, is one less (w + 1) / 2 * y^w less (1 - w) / 2 * y^(w + 1)."""
    w, x = SEGMENT, np.linspace(0, 1, max(1 << 16, 64 * n_buckets))
    below = 1 - (w + 1) / 2 * (1 - x) ** w + (w - 1) / 2 * (1 - x) ** (w + 1)
    return (np.interp(np.arange(1, n_buckets) / n_buckets, below, x) * 2.0**64).astype(np.uint64)


def _rounds(table: DataFrame) -> list[DataFrame]:
    """The written answers of each round, by batch and kind."""
    spark = table.sparkSession
    n = buckets_for(table, 0.16)  # twice the anchors a byte: buckets of half the usual size
    rounds = [cut(ask(table, _anchor_keys, anchor_edges(n), exact=True).withColumn("kind", F.lit(0)), "anchors")]
    release(spark)
    edges = splitters(table, n)
    rounds.append(cut(ask_least(table, _pairs, edges, _known(rounds)).withColumn("kind", F.lit(1)), "pairs"))
    release(spark)
    rounds.append(cut(ask_least(table, _suffixes, edges, _known(rounds)).withColumn("kind", F.lit(2)), "suffixes"))
    release(spark)
    return rounds


def _known(rounds: list[DataFrame]) -> DataFrame:
    return functools.reduce(DataFrame.unionByName, rounds)


def _whole(text: np.ndarray, gone: np.ndarray) -> bytes:
    """What is left of a UTF-8 text without the characters of which a byte goes."""
    head = (text & 0xC0) != 0x80
    if not gone.any():
        return text.tobytes()
    first = np.flatnonzero(head)
    hit = np.logical_or.reduceat(gone, first)
    return text[~np.repeat(hit, np.diff(np.append(first, len(text))))].tobytes()


def dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row. Rows without doc_id lose nothing."""
    body = F.coalesce("text", F.lit("")).cast("binary")
    none = F.lit(0).cast("long")
    unnamed = docs.where("doc_id IS NULL").select(F.col("doc_id").cast("long"), F.octet_length(body).cast("long").alias("n_bytes"), none.alias("n_removed"), none.alias("n_spans"), F.sha2(body, 256).alias("kept_sha256"))
    return _dedup(docs, False)[0].unionByName(unnamed)


def _dedup(docs: DataFrame, with_text: bool) -> tuple[DataFrame, list[DataFrame]]:
    """dedup's rows, and the tables that they are made from."""
    table = batches(docs)
    schema = "doc_id long,n_bytes long,n_removed long,n_spans long,kept_sha256 string" + (",text_sha256 string,kept binary" if with_text else "")

    def result(row, got) -> pd.DataFrame:
        w = Windows(row)
        w.hear_anchors(got)
        w.hear_pairs(got)
        gone = w.removed(got)
        raw = np.frombuffer(w.body, np.uint8)
        out, at = [], 0
        for doc_id, n in zip(w.ids.tolist(), w.lengths.tolist(), strict=True):
            g = gone[at : at + n]
            kept = raw[at : at + n][~g].tobytes() if g.any() else w.body[at : at + n]
            spans = int(np.count_nonzero(g[1:] & ~g[:-1])) + int(n > 0 and g[0])
            line = (doc_id, n, int(g.sum()), spans, hashlib.sha256(kept).hexdigest())
            if with_text:
                line += (hashlib.sha256(w.body[at : at + n]).hexdigest(), _whole(raw[at : at + n], g))
            out.append(line)
            at += n
        return pd.DataFrame(out, columns=[x.split()[0] for x in schema.split(",")])

    rounds = _rounds(table)
    return by_batch(table, _known(rounds), result, schema), [table, *rounds]


def deduplicated(docs: DataFrame) -> DataFrame:
    """The rows with the repeated stretches cut out of their texts. A character of which a byte goes, goes. n_chars, where
    there is one, follows a changed text.

    A row's result depends on its doc_id and text alone, so those two carry it back to the row."""
    found, used = _dedup(docs, with_text=True)
    found = cut(found.where("n_removed > 0").select("doc_id", "text_sha256", "kept"), "kept")
    discard(*used)
    release(docs.sparkSession)  # the join below deals all texts out; by then the rounds' files are gone
    parts = found.groupBy(F.col("doc_id").alias("id"), F.col("text_sha256").alias("of")).agg(F.first("kept").alias("kept"))
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    rows = docs.select(F.col("doc_id").alias("k"), F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("key"), whole.alias("r"))
    both = rows.join(parts, (F.col("k") == F.col("id")) & (F.col("key") == F.col("of")), "left")
    both = both.select("r", F.decode("kept", "UTF-8").alias("new"))
    changed = F.col("new").isNotNull()
    values = {"text": F.coalesce("new", "r.text"), "n_chars": F.when(changed, F.length("new").cast("long")).otherwise(F.col("r.n_chars"))} if "n_chars" in docs.columns else {"text": F.coalesce("new", "r.text")}
    return both.select(*[values.get(c, F.col("r")[c]).alias(c) for c in docs.columns])
