"""Token-id output: raw id payloads in shards, with a minimal perfect hash index from keys to offsets.

Texts are encoded by the tokenizers library (byte_chunks.py); an end id follows each document. Rows are dealt by range of
(doc_id, text hash) and sorted, so the shards in order are the corpus in ascending doc_id order. A shard is two files in
the shared folder:

* `*.ids`, nothing but little-endian ids, uint16 where the vocabulary allows, else uint32;
* `*.mph`, its index: a header, the levels of a bit array (a key's slot is the rank of the first bit that it alone hashes
  to: minimal perfect), and for each slot the key's 16-bit fingerprint and the offset and count of its ids.

The manifest, a Parquet table with a row a shard, names the files and the first (doc_id, text hash) of each: the shard
edges. `TokenShards.get(doc_id)` finds the shard by its edges, the slot by hash and rank, compares the fingerprint and
reads that stretch of the payload alone. Absent keys are refused, but for one in 65,536 by chance. No keys are stored: a
key is (doc_id, n), n counting the rows of one doc_id in a shard in order of their text hash.

A shard ends at SHARD_IDS ids. One doc_id with many texts goes on in the next shard. A file is written under a name of its
task attempt, and the manifest names those of the attempt that was kept, so reruns after a lost executor do no harm.
Null doc_id: before all others. Null and empty texts: the end id only. Long texts: whole, one stretch. Repeated rows: a
stretch each. Empty table: no shards. Other columns of the table are not read.
"""

from __future__ import annotations

import bisect
import functools
import posixpath
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .byte_chunks import encoder
from .common import SLICE_BYTES, cut, mixed, shared_uri, tokenizer_path

#: Ids in a shard, and bytes of text in a range of rows (one task; larger only beyond MOST_RANGES ranges).
SHARD_IDS = 1 << 25
RANGE_BYTES, MOST_RANGES = 16 << 20, 50_000
_HEAD = struct.Struct("<4sHHqqq")
MANIFEST = "part long,k long,file string,width string,first_null boolean,first_id long,first_hash long,n_docs long,n_ids long"


def _hash(keys: np.ndarray, seed: int) -> np.ndarray:
    return mixed(keys + np.uint64((seed * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF))


def key_of(doc_id: np.ndarray, null: np.ndarray, n: np.ndarray) -> np.ndarray:
    return _hash(doc_id.astype(np.int64).view(np.uint64), 1) ^ _hash(n.astype(np.uint64) * np.uint64(2) + null.astype(np.uint64), 2)


def _mark(keys: np.ndarray) -> np.ndarray:
    return (_hash(keys, 3) >> np.uint64(48)).astype(np.uint16)


def build_index(keys: np.ndarray, gamma: float = 2.0) -> tuple[list[np.ndarray], np.ndarray]:
    """(bit arrays of the levels, slot of each key) of a minimal perfect hash of distinct keys."""
    levels, slot = [], np.zeros(len(keys), np.int64)
    left, used, seed = np.arange(len(keys)), 0, 10
    while len(left):
        m = max(8, int(len(left) * gamma))
        at = (_hash(keys[left], seed) % np.uint64(m)).astype(np.int64)
        alone = np.bincount(at, minlength=m) == 1
        rank = np.cumsum(alone) - 1
        hit = alone[at]
        slot[left[hit]] = used + rank[at[hit]]
        levels.append(alone)
        used += int(alone.sum())
        left, seed = left[~hit], seed + 1
        if seed > 200:
            raise ValueError("keys aren't distinct")
    return levels, slot


def index_bytes(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """The index file of keys whose ids lie one after another, counts ids each."""
    levels, slot = build_index(keys)
    offsets, sizes, marks = np.zeros(len(keys), "<i8"), np.zeros(len(keys), "<i8"), np.zeros(len(keys), "<u2")
    offsets[slot], sizes[slot], marks[slot] = np.cumsum(counts) - counts, counts, _mark(keys)
    lengths = np.array([len(x) for x in levels], "<i8")
    bits = np.packbits(np.concatenate([*levels, np.zeros(0, bool)]), bitorder="little")
    return _HEAD.pack(b"MPH1", 1, 0, len(keys), len(lengths), len(bits)) + lengths.tobytes() + bits.tobytes() + marks.tobytes() + offsets.tobytes() + sizes.tobytes()


class Index:
    """Slots of keys, from an index file's bytes."""

    def __init__(self, data: bytes):
        magic, _, _, n, levels, packed = _HEAD.unpack_from(data)
        if magic != b"MPH1":
            raise ValueError("not an index file")
        at = _HEAD.size
        take = lambda kind, count, size: np.frombuffer(data, kind, count, at) if count else np.zeros(0, kind)
        self.sizes = take("<i8", levels, 8)
        at += 8 * levels
        self.bits = np.unpackbits(take(np.uint8, packed, 1), count=int(self.sizes.sum()), bitorder="little").astype(bool)
        at += packed
        self.starts, self.rank = np.cumsum(self.sizes) - self.sizes, np.cumsum(self.bits) - 1
        self.marks = take("<u2", n, 2)
        at += 2 * n
        self.offsets = take("<i8", n, 8)
        at += 8 * n
        self.counts = take("<i8", n, 8)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key, -1 for those whose fingerprint isn't the stored one."""
        out, left = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for k, m in enumerate(self.sizes.tolist()):
            at = (_hash(keys[left], 10 + k) % np.uint64(m)).astype(np.int64) + self.starts[k]
            hit = self.bits[at]
            out[left[hit]] = self.rank[at[hit]]
            left = left[~hit]
        good = out >= 0
        good[good] = self.marks[out[good]] == _mark(keys[good])
        return np.where(good, out, -1)


def _order(doc_id, text_hash) -> tuple:
    """Places (doc_id, text hash) in the shards' order: null ids first."""
    return (doc_id is not None, doc_id or 0, text_hash)


class _Writer:
    """One task's shards."""

    def __init__(self, folder: str, part: int, path: str, end_id: int, width: str, shard_ids: int):
        self.fs, self.root = arrow_fs.FileSystem.from_uri(folder)
        self.part, self.k, self.end_id, self.width, self.shard_ids = part, 0, end_id, width, shard_ids
        self.encoder = encoder(path)
        self.stream, self.last, self.run = None, None, 0

    def _open(self, first: tuple) -> None:
        self.file = f"{self.part:08d}-{self.k:06d}-{uuid.uuid4().hex}"
        self.stream = self.fs.open_output_stream(posixpath.join(self.root, self.file + ".ids"))
        self.first, self.n_ids, self.last, self.run = first, 0, None, 0
        self.ids, self.nulls, self.seqs, self.counts = [], [], [], []

    def _close(self) -> tuple:
        self.stream.close()
        keys = key_of(np.array(self.ids, np.int64), np.array(self.nulls, bool), np.array(self.seqs, np.int64))
        with self.fs.open_output_stream(posixpath.join(self.root, self.file + ".mph")) as f:
            f.write(index_bytes(keys, np.array(self.counts, np.int64)))
        null, doc_id, text_hash = self.first
        out = (self.part, self.k, self.file, self.width, null, doc_id, text_hash, len(self.ids), self.n_ids)
        self.stream, self.k = None, self.k + 1
        return out

    def rows(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            text = batch.column(2)
            edges = np.frombuffer(text.buffers()[1], np.int32)[text.offset : text.offset + len(text) + 1]
            data, ids, hashes = text.buffers()[2], batch.column(0).to_pylist(), batch.column(1).to_pylist()
            lo = 0
            while lo < len(text):
                hi = max(lo + 1, int(np.searchsorted(edges, edges[lo] + SLICE_BYTES, side="right")) - 1)
                body = data[int(edges[lo]) : int(edges[hi])].to_pybytes() if data is not None else b""
                tokens, counts = self.encoder.ids_of(body, edges[lo : hi + 1].astype(np.int64) - int(edges[lo]))
                yield from self._slice(ids[lo:hi], hashes[lo:hi], tokens, counts)
                lo = hi
        if self.stream is not None:
            yield self._close()

    def _slice(self, ids: list, hashes: list, tokens: np.ndarray, counts: np.ndarray) -> Iterator[tuple]:
        ends = np.cumsum(counts)
        stretch = np.full(len(tokens) + len(ids), self.end_id, np.dtype(self.width).newbyteorder("<"))
        mine = np.ones(len(stretch), bool)
        mine[ends + np.arange(len(ids))] = False
        stretch[mine] = tokens
        written = at = 0
        for doc_id, text_hash, n in zip(ids, hashes, (counts + 1).tolist(), strict=True):
            if self.stream is not None and self.n_ids >= self.shard_ids and (doc_id, text_hash) != self.place:  # equal rows stay together
                self.stream.write(stretch[written:at].tobytes())
                written = at
                yield self._close()
            if self.stream is None:
                self._open((doc_id is None, doc_id or 0, text_hash))
            self.run = self.run + 1 if self.ids and doc_id == self.last else 0
            self.last, self.place = doc_id, (doc_id, text_hash)
            self.ids.append(doc_id or 0)
            self.nulls.append(doc_id is None)
            self.seqs.append(self.run)
            self.counts.append(n)
            self.n_ids += n
            at += n
        self.stream.write(stretch[written:at].tobytes())


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))


def write_shards(docs: DataFrame, folder: str, path: str, end_id: int = 0, shard_ids: int = SHARD_IDS, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Encode and write into folder (a URI of the shared file system); returns the manifest, also written there."""
    width = "uint16" if max(encoder(path).tokenizer.get_vocab_size() - 1, end_id) < 1 << 16 else "uint32"
    arrow_fs.FileSystem.from_uri(folder)[0].create_dir(arrow_fs.FileSystem.from_uri(folder)[1], recursive=True)
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = min(MOST_RANGES, max(1, -(-total // range_bytes)))
    dealt = _keyed(docs).repartitionByRange(parts, F.col("doc_id").asc_nulls_first(), "text_hash").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text_hash")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        kinds = {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}
        schema = pa.schema([(x.split()[0], kinds[x.split()[1]]) for x in MANIFEST.split(",")])
        for row in _Writer(folder, TaskContext.get().partitionId(), path, end_id, width, shard_ids).rows(batches):
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, schema.types, strict=True)], schema=schema)

    written = cut(dealt.mapInArrow(write, MANIFEST), "manifest")
    # Ids before a shard: sums of whole blocks of parts, then a window in a block. A block holds 1024 parts' shards.
    blocks = written.groupBy(F.floor(F.col("part") / 1024).alias("block")).agg(F.sum("n_ids").alias("n"))
    ahead = blocks.select("block", F.coalesce(F.sum("n").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("ahead"))  # at most MOST_RANGES / 1024 rows
    inside = F.coalesce(F.sum("n_ids").over(Window.partitionBy("block").orderBy("part", "k").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    manifest = written.withColumn("block", F.floor(F.col("part") / 1024)).withColumn("inside", inside).join(ahead, "block").withColumn("base", F.col("inside") + F.col("ahead")).drop("block", "inside", "ahead")
    manifest.write.mode("overwrite").parquet(f"{folder}/manifest")
    return docs.sparkSession.read.schema(manifest.schema).parquet(f"{folder}/manifest")


@functools.lru_cache(64)
def _index(folder: str, file: str) -> Index:
    fs, root = arrow_fs.FileSystem.from_uri(folder)
    with fs.open_input_file(posixpath.join(root, file + ".mph")) as f:
        return Index(f.read())


class TokenShards:
    """Keyed access to written shards. Holds a shard's edge (its first key) and file name, not its keys."""

    def __init__(self, folder: str, manifest: list):
        """manifest: rows of the table (any objects with its columns as attributes); a row a shard."""
        self.folder = folder
        self.fs, self.root = arrow_fs.FileSystem.from_uri(folder)
        self.rows = sorted(manifest, key=lambda r: (r.part, r.k))
        self.edges = [_order(None if r.first_null else r.first_id, r.first_hash) for r in self.rows]

    @classmethod
    def open(cls, spark: SparkSession, folder: str) -> TokenShards:
        return cls(folder, spark.read.parquet(f"{folder}/manifest").collect())

    def shard_of(self, doc_id, text_hash: int) -> int:
        """The last shard that starts at this place or before it; -1 before the first."""
        return bisect.bisect_right(self.edges, _order(doc_id, text_hash)) - 1

    def read(self, shard: int, slots: np.ndarray) -> list[np.ndarray]:
        """The ids at these slots. Neighbouring stretches are read at once."""
        row, index = self.rows[shard], _index(self.folder, self.rows[shard].file)
        kind = np.dtype(row.width).newbyteorder("<")
        a, n = index.offsets[slots], index.counts[slots]
        order = np.argsort(a, kind="stable")
        out: list[np.ndarray] = [np.zeros(0, kind)] * len(slots)
        with self.fs.open_input_file(posixpath.join(self.root, row.file + ".ids")) as f:
            lo = 0
            while lo < len(order):
                hi = lo + 1
                while hi < len(order) and a[order[hi]] == a[order[hi - 1]] + n[order[hi - 1]] and a[order[hi]] - a[order[lo]] < 1 << 20:
                    hi += 1
                first, last = a[order[lo]], a[order[hi - 1]] + n[order[hi - 1]]
                block = np.frombuffer(f.read_at(int(last - first) * kind.itemsize, int(first) * kind.itemsize), kind)
                for i in order[lo:hi].tolist():
                    out[i] = block[a[i] - first : a[i] - first + n[i]]
                lo = hi
        return out

    def get(self, doc_id) -> list[np.ndarray]:
        """The ids of every row of this doc_id, in order; none where the key is absent."""
        out = []
        for shard in range(max(0, self.shard_of(doc_id, -(1 << 63))), len(self.rows)):
            if self.edges[shard][:2] > _order(doc_id, 0)[:2]:
                break
            index, n = _index(self.folder, self.rows[shard].file), 0
            while (slot := index.slots(key_of(np.array([doc_id or 0]), np.array([doc_id is None]), np.array([n]))))[0] >= 0 and n < len(index.counts):
                out += self.read(shard, slot)
                n += 1
        return out


def read_shards(docs: DataFrame, folder: str, manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every row of docs, looked up by key in the shards."""
    shards = TokenShards(folder, manifest.collect())  # a row of under 200 bytes for RANGE_BYTES of text

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shard = [shards.shard_of(i, h) for i, h in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(shard, pa.int64()), batch.column(0), batch.column(1)], names=["shard", "doc_id", "text_hash"])

    asked = _keyed(docs).select("doc_id", "text_hash").mapInArrow(place, "shard long,doc_id long,text_hash long")

    def look(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, last, run = None, None, 0
        for frame in frames:
            for shard, rows in frame.groupby("shard", sort=False):
                null = rows.doc_id.isna().to_numpy()
                ids, seqs = rows.doc_id.fillna(0).to_numpy(np.int64), []
                for key in zip(null.tolist(), ids.tolist(), strict=True):
                    run = run + 1 if (shard, key) == (at, last) else 0
                    at, last = shard, key
                    seqs.append(run)
                slots = _index(folder, shards.rows[int(shard)].file).slots(key_of(ids, null, np.array(seqs, np.int64)))
                if (slots < 0).any():
                    raise ValueError("a document isn't in its shard's index")
                found, index, base = shards.read(int(shard), slots), _index(folder, shards.rows[int(shard)].file), shards.rows[int(shard)].base
                yield pd.DataFrame({
                    "doc_id": pd.array(ids, "Int64") if not null.any() else pd.array([None if z else i for z, i in zip(null.tolist(), ids.tolist(), strict=True)], "Int64"),
                    "start": index.offsets[slots] + base, "n_tokens": index.counts[slots], "ids_crc32": [zlib.crc32(x.astype("<u4").tobytes()) for x in found],
                })

    n = max(1, min(len(shards.rows), 1 << 16))
    rows = asked.repartition(n, "shard").sortWithinPartitions("shard", F.col("doc_id").asc_nulls_first(), "text_hash")
    return rows.select("shard", F.col("doc_id"), "text_hash").mapInPandas(look, "doc_id long,start long,n_tokens long,ids_crc32 long")


def token_output(docs: DataFrame, path: str | None = None, end_id: int = 0, folder: str | None = None, **sizes: int) -> DataFrame:
    """Write the shards of docs and read them back. Without a folder: a new one in the shared folder."""
    folder = folder or f"{shared_uri(docs.sparkSession)}/token-shards-{uuid.uuid4().hex}"
    manifest = write_shards(docs, folder, path or tokenizer_path("byte_bpe_50k.json"), end_id, **sizes)
    return read_shards(docs, folder, manifest)
