"""Batches of whole texts, and a question-and-answer round over packed keys.

Operators that must know how often a 64-bit key occurs in the corpus would shuffle a row for each key. Here
a batch of documents sends its distinct keys as sorted, compressed arrays, one for each bucket of the key range,
and gets an array of answers back. A batch sends a key once however many of its documents have it, so a
key that all documents share costs one entry a batch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, mixed, pack_sorted, slices, texts, unpack_sorted, zpack, zunpack

BATCH_BYTES = 4 << 20
#: Packed keys that one bucket should get, about; buckets grow in number with the corpus.
BUCKET_KEYS = 3_000_000
BATCH = "batch long,doc_ids binary,lengths binary,body binary,n_bytes long"


def batches(docs: DataFrame) -> DataFrame:
    """Written rows of about BATCH_BYTES of text: ids (int64), UTF-8 lengths (int64), compressed bytes.
    Rows without doc_id are left out. Being written, a batch is the same for every later round."""

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        n = TaskContext.get().partitionId() << 32
        packer = zstandard.ZstdCompressor(level=3)
        ids, data, size = [], [], 0

        def done():
            body = b"".join(data)
            columns = [[n], [np.array(ids, np.int64).tobytes()], [np.array([len(x) for x in data], np.int64).tobytes()], [packer.compress(body)], [len(body)]]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.int64()), strict=True)], names=["batch", "doc_ids", "lengths", "body", "n_bytes"])

        for some, strings in slices(frames, BATCH_BYTES):
            for i, s in zip(some, strings, strict=True):
                b = s.encode("utf-8", "replace")
                if size and size + len(b) > BATCH_BYTES:
                    yield done()
                    n, ids, data, size = n + 1, [], [], 0
                ids.append(i)
                data.append(b)
                size += len(b)
        if ids:
            yield done()

    return cut(texts(docs).where(F.col("doc_id").isNotNull()).mapInArrow(run, BATCH), "batches")


def opened(row) -> tuple[np.ndarray, np.ndarray, bytes]:
    """(doc_ids, lengths, text bytes) of a batch row."""
    return np.frombuffer(row.doc_ids, np.int64), np.frombuffer(row.lengths, np.int64), zstandard.ZstdDecompressor().decompress(row.body)


def buckets_for(table: DataFrame, keys_per_byte: float) -> int:
    """A power of two, in proportion to the corpus."""
    total = table.agg(F.sum("n_bytes")).first()[0] or 0
    n = 16
    while n * BUCKET_KEYS < total * keys_per_byte:
        n *= 2
    return n


def even_edges(n_buckets: int) -> np.ndarray:
    """Edges of a power of two of buckets that spread-out keys fill evenly."""
    return np.arange(1, n_buckets, dtype=np.uint64) << np.uint64(64 - (n_buckets.bit_length() - 1))


def ask(table: DataFrame, keys_of: Callable[[object], tuple[np.ndarray, np.ndarray]], edges: np.ndarray, drop: int = 2, exact: bool = False) -> DataFrame:
    """(batch, bucket, answer) rows. keys_of(batch row) gives ascending distinct uint64 keys and how many
    documents of the batch have each; `edges` splits the keys into buckets. The answer has a uint8 for each key: 0 if one document of the corpus has it, else
    floor(log2(documents)) + 1; with exact a uint32, the number of documents. The lowest `drop` bytes of a key aren't sent: keys may seem more frequent by that,
    never less."""
    edges = edges >> np.uint64(8 * drop) << np.uint64(8 * drop)  # keys that are sent alike meet in one bucket

    def cells(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples():
                keys, counts = keys_of(row)
                cut_keys = keys >> np.uint64(8 * drop)
                new = np.concatenate([[True], cut_keys[1:] != cut_keys[:-1]]) if len(keys) else np.zeros(0, bool)
                first = np.flatnonzero(new)
                keys, counts = keys[first], (np.add.reduceat(counts, first) if len(first) else counts)
                at = np.searchsorted(keys, edges)
                out = [(int(row.batch), b, pack_sorted(k, drop), zpack(c.astype(np.uint32))) for b, (k, c) in enumerate(zip(np.split(keys, at), np.split(counts, at), strict=True)) if len(k)]
                yield pd.DataFrame(out, columns=["batch", "bucket", "keys", "counts"])

    def answer(frame: pd.DataFrame) -> pd.DataFrame:
        lists = [unpack_sorted(k, drop) for k in frame["keys"]]
        every = np.concatenate(lists)
        counts = np.concatenate([zunpack(c, np.uint32) for c in frame.counts]).astype(np.int64)
        order = np.argsort(every, kind="stable")
        s = every[order]
        first = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
        total = np.add.reduceat(counts[order], first)
        level = total.astype(np.uint32) if exact else np.where(total > 1, np.floor(np.log2(total)).astype(np.int64) + 1, 0).astype(np.uint8)
        out = np.empty(len(every), level.dtype)
        out[order] = np.repeat(level, np.diff(np.append(first, len(s))))
        ends = np.cumsum([len(x) for x in lists])
        return pd.DataFrame({"batch": frame.batch, "bucket": frame.bucket, "answer": [zpack(x) for x in np.split(out, ends[:-1])]})

    rows = table.mapInPandas(cells, "batch long,bucket long,keys binary,counts binary")
    return rows.repartition(len(edges) + 1, "bucket").groupBy("bucket").applyInPandas(answer, "batch long,bucket long,answer binary")


def answers_for(keys: np.ndarray, got: pd.DataFrame, drop: int = 2, dtype=np.uint8) -> np.ndarray:
    """The answers in the order of keys (as keys_of gave them)."""
    cut_keys = keys >> np.uint64(8 * drop)
    place = np.cumsum(np.concatenate([[True], cut_keys[1:] != cut_keys[:-1]])) - 1 if len(keys) else np.zeros(0, np.int64)
    parts = [zunpack(a, dtype) for a in got.sort_values("bucket").answer]
    return np.concatenate(parts)[place] if parts else np.zeros(0, dtype)


def edge_places(key: np.ndarray, more: np.ndarray, edges: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Where each edge (key, more) falls in entries ascending by (key, more): the first place that isn't below it."""
    at, end = np.searchsorted(key, edges[0]), np.searchsorted(key, edges[0], side="right")
    for i in np.flatnonzero((at < end) & (edges[1] > 0)).tolist():
        at[i] += np.searchsorted(more[at[i] : end[i]], edges[1][i])
    return at


def ask_least(table: DataFrame, entries_of: Callable, edges: tuple[np.ndarray, np.ndarray], answers: DataFrame | None) -> DataFrame:
    """(batch, bucket, answer) rows. entries_of(batch row, its answers so far) gives distinct entries ascending by
    (key, more): uint64 key and more, smallest doc_id and count in the batch. The answer has, for each entry, the
    smallest doc_id and the total count in the corpus (int64 each). `edges`, ascending pairs of key and more, splits
    the entries into buckets; an entry lies in one bucket, so equal entries meet there and none straddles an edge."""
    schema = "batch long,bucket long,keys binary,more binary,docs binary,counts binary"
    names = [x.split()[0] for x in schema.split(",")]

    def cells_of(row, got) -> pd.DataFrame:
        key, more, doc, count = entries_of(row, got)
        at = edge_places(key, more, edges)
        out = []
        for b, (k, m, d, c) in enumerate(zip(*(np.split(x, at) for x in (key, more, doc, count)), strict=True)):
            if len(k):
                planes = np.ascontiguousarray(d.astype("<i8").view(np.uint8).reshape(-1, 8).T)
                out.append((int(row.batch), b, pack_sorted(k), m.tobytes(), zpack(planes), zpack(c.astype(np.uint32))))
        return pd.DataFrame(out, columns=names)

    def answer(frame: pd.DataFrame) -> pd.DataFrame:
        lists = [unpack_sorted(k) for k in frame["keys"]]
        key, more = np.concatenate(lists), np.concatenate([np.frombuffer(m, np.uint64) for m in frame.more])
        doc = np.concatenate([np.ascontiguousarray(zunpack(d, np.uint8).reshape(8, -1).T).reshape(-1).view("<i8") for d in frame.docs])
        count = np.concatenate([zunpack(c, np.uint32) for c in frame.counts]).astype(np.int64)
        order = multikey(key, more)
        k, m = key[order], more[order]
        first = np.flatnonzero(np.concatenate([[True], (k[1:] != k[:-1]) | (m[1:] != m[:-1])]))
        run = np.diff(np.append(first, len(k)))
        least, total = np.empty_like(doc), np.empty_like(count)
        least[order] = np.repeat(np.minimum.reduceat(doc[order], first), run)
        total[order] = np.repeat(np.add.reduceat(count[order], first), run)
        ends = np.cumsum([len(x) for x in lists])[:-1]
        packed = [zpack(np.ascontiguousarray(np.concatenate([a, b]).view(np.uint8).reshape(-1, 8).T)) for a, b in zip(np.split(least, ends), np.split(total, ends), strict=True)]
        return pd.DataFrame({"batch": frame.batch, "bucket": frame.bucket, "answer": packed})

    if answers is None:

        def cells(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                for row in frame.itertuples():
                    yield cells_of(row, None)

        rows = table.mapInPandas(cells, schema)
    else:
        rows = by_batch(table, answers, cells_of, schema)
    return rows.repartition(len(edges[0]) + 1, "bucket").groupBy("bucket").applyInPandas(answer, "batch long,bucket long,answer binary")


def multikey(key: np.ndarray, more: np.ndarray) -> np.ndarray:
    """Order by (key, more), word by word: only runs of equal first words are sorted by the second."""
    order = np.argsort(key, kind="stable")
    k = key[order]
    same = np.zeros(len(k) + 1, bool)
    same[1:-1] = k[1:] == k[:-1]
    tied = np.flatnonzero(same[1:] | same[:-1])
    if len(tied):
        run = np.cumsum(~same[:-1])[tied]
        order[tied] = order[tied][np.lexsort((more[order[tied]], run))]
    return order


def least_for(got: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(smallest doc_id, total count) in the order of a batch's entries."""
    parts = [np.ascontiguousarray(zunpack(a, np.uint8).reshape(8, -1).T).reshape(-1).view(np.int64).reshape(2, -1) for a in got.sort_values("bucket").answer]
    both = np.concatenate(parts, axis=1) if parts else np.zeros((2, 0), np.int64)
    return both[0], both[1]


def by_batch(table: DataFrame, answers: DataFrame, work: Callable[[object, pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """work(batch row, its answers) for every batch."""

    def both(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        return pd.concat([work(row, right) for row in left.itertuples()], ignore_index=True) if len(left) else pd.DataFrame(columns=[x.split()[0] for x in schema.split(",")])

    return table.groupBy("batch").cogroup(answers.groupBy("batch")).applyInPandas(both, schema)


__all__ = ["BATCH_BYTES", "answers_for", "ask", "ask_least", "batches", "buckets_for", "by_batch", "edge_places", "even_edges", "least_for", "mixed", "opened"]
