"""Media columns: payloads in content-defined chunks, deduplicated by digest and put together again.

A document's payload is its text in UTF-8, padded with blanks to a multiple of FRAME bytes. The stored form
("media") is a mono 8-bit PCM WAV file of it: a 44-byte header and one sample a byte. A rolling gear hash
cuts the payload where the hash of the last bytes has its top bits zero, so equal stretches give equal
chunks wherever they lie.

1. Slices of documents write the compressed bodies of their distinct chunks to pack files in the shared folder, and a row
   for each distinct payload: its key (SHA-256), its documents, and its ordered chunks (SHA-256 digest, file, place).
2. Of the places of a digest over the whole corpus, Spark's aggregation picks one. Packs are rewritten with the picked
   chunks alone, so the store holds one body for each digest, and the first packs are deleted.
3. A join on the digest gives each payload's ordered chunk list its places in the store. Chunks are read back from there
   and checked against their digests, payloads against their keys, and measured once for each key; a join on the key
   brings the values to the documents (a row for each slice and payload, not for each copy).

Bodies are never shuffled. File names are a task attempt's own, and the written tables name the kept attempt's.

Null text: as empty, one frame of blanks. Long texts: many chunks; one payload is held at a time. Repeated rows and null
ids: a row each. Empty table: no rows. Other columns of the table are not read.
"""

from __future__ import annotations

import functools
import hashlib
import posixpath
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, shared_uri, slices, texts

FRAME = 192
MIN_CHUNK, MEAN_BITS, MAX_CHUNK = 2048, 13, 32768
#: A pack file is closed after this many bytes.
PACK_BYTES = 32 << 20
RATE = 8000
_GEAR = np.random.Generator(np.random.PCG64(20240501)).integers(0, 1 << 64, 256, np.uint64)
_WINDOW = 64


def payload_of(text: str) -> bytes:
    data = text.encode("utf-8", "replace")
    return data + b" " * (-len(data) % FRAME if data else FRAME)


def gear(data: bytes) -> np.ndarray:
    """The gear hash after each byte: the sum of table values of the last 64 bytes, each shifted left by its
    distance. By doubling, in six array steps."""
    h = _GEAR[np.frombuffer(data, np.uint8)]
    size = 1
    while size < _WINDOW:
        h[size:] += h[:-size] << np.uint64(size)
        size *= 2
    return h


def cuts(data: bytes) -> list[int]:
    """End offsets of the chunks. Lengths are MIN_CHUNK to MAX_CHUNK, but for the last."""
    n = len(data)
    if n <= MIN_CHUNK:
        return [n]
    marks = np.flatnonzero(gear(data) >> np.uint64(64 - MEAN_BITS) == 0) + 1
    ends, start = [], 0
    while n - start > MIN_CHUNK:
        k = np.searchsorted(marks, start + MIN_CHUNK)
        end = min(int(marks[k]) if k < len(marks) else n, start + MAX_CHUNK, n)
        ends.append(end)
        start = end
    if start < n:
        ends.append(n)
    return ends


def media_header(n: int) -> bytes:
    """The RIFF/WAVE header of n 8-bit mono samples (an odd count would need a pad byte; FRAME is even)."""
    return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + n, b"WAVE", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8, b"data", n)


def samples_of(media: bytes) -> bytes:
    """The payload out of a stored form."""
    if media[:4] != b"RIFF" or media[8:16] != b"WAVEfmt ":
        raise ValueError("not a RIFF/WAVE file")
    n = struct.unpack("<I", media[40:44])[0]
    return media[44 : 44 + n]


def features_of(payload: bytes) -> str:
    """Mean, spread, crossings of the mid level and largest sample of 8-bit PCM, as text."""
    a = np.frombuffer(payload, np.uint8)
    centred = a.astype(np.int64) - 128
    crossings = int(np.count_nonzero(np.diff(centred >= 0)))
    return f"mean={int(centred.sum()) / len(a):.4f};rms={np.sqrt(float((centred * centred).sum()) / len(a)):.4f};zc={crossings};max={int(a.max())}"


PARTS = "key binary,doc_ids array<long>,sizes array<long>,chunks array<struct<digest:binary,file:string,at:long,size:long>>"
_PLACE = pa.struct([("digest", pa.binary()), ("file", pa.string()), ("at", pa.int64()), ("size", pa.int64())])


class Packs:
    """Pack files of one task: bodies one after another."""

    def __init__(self, folder: str, limit: int = PACK_BYTES):
        self.fs, self.root = arrow_fs.FileSystem.from_uri(folder)
        self.limit, self.stream, self.at = limit, None, 0

    def put(self, body: bytes) -> tuple[str, int, int]:
        if self.stream is not None and self.at >= self.limit:
            self.close()
        if self.stream is None:
            self.file, self.at = uuid.uuid4().hex, 0
            self.stream = self.fs.open_output_stream(posixpath.join(self.root, self.file))
        self.stream.write(body)
        self.at += len(body)
        return self.file, self.at - len(body), len(body)

    def close(self) -> None:
        if self.stream is not None:
            self.stream.close()
        self.stream = None


class Bodies:
    """Reads stored bodies; a few files are kept open."""

    def __init__(self, folder: str):
        self.fs, self.root = arrow_fs.FileSystem.from_uri(folder)
        self.opened = functools.lru_cache(32)(lambda file: self.fs.open_input_file(posixpath.join(self.root, file)))

    def get(self, file: str, at: int, size: int) -> bytes:
        return self.opened(file).read_at(size, at)


def new_folder(spark, name: str) -> str:
    folder = f"{shared_uri(spark)}/{name}-{uuid.uuid4().hex}"
    fs, root = arrow_fs.FileSystem.from_uri(folder)
    fs.create_dir(root, recursive=True)
    return folder


def drop_folder(folder: str) -> None:
    fs, root = arrow_fs.FileSystem.from_uri(folder)
    fs.delete_dir(root)


def store(docs: DataFrame, folder: str, level: int = 9) -> DataFrame:
    """A row (PARTS) for each slice and distinct payload in it; the bodies of the slice's distinct chunks are in packs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, packs, done = zstandard.ZstdCompressor(level=level), Packs(folder), []

        def rows():
            kinds = (pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(_PLACE))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), kinds, strict=True)], names=["key", "doc_ids", "sizes", "chunks"])

        for ids, strings in slices(batches):
            payloads, owners, sizes = {}, {}, {}
            for doc_id, s in zip(ids, strings, strict=True):
                payload = payload_of(s)
                key = hashlib.sha256(payload).digest()
                payloads.setdefault(key, payload)
                owners.setdefault(key, []).append(doc_id)
                sizes.setdefault(key, []).append(len(s.encode("utf-8", "replace")))
            had, done = {}, []
            for key, payload in payloads.items():
                ends, chunks = cuts(payload), []
                for a, b in zip([0, *ends[:-1]], ends, strict=True):
                    body = payload[a:b]
                    digest = key if len(ends) == 1 else hashlib.sha256(body).digest()
                    if digest not in had:
                        had[digest] = packs.put(packer.compress(body))
                    chunks.append((digest, *had[digest]))
                done.append((key, owners[key], sizes[key], [dict(zip(_PLACE.names, c, strict=True)) for c in chunks]))
            if done:
                yield rows()
        packs.close()

    return texts(docs).mapInArrow(run, PARTS)


PLACES = "digest binary,file string,at long,size long"


def compact(parts: DataFrame, folder: str, target: str) -> DataFrame:
    """(digest, file, at, size) of one body for each digest of the corpus, copied from the packs in folder to target."""
    every = parts.select(F.explode("chunks").alias("c"))
    picked = every.groupBy("c.digest").agg(F.min(F.struct("c.file", "c.at", "c.size")).alias("p")).select("digest", "p.file", "p.at", "p.size")

    def copy(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bodies, packs = Bodies(folder), Packs(target)
        for f in frames:
            out = [(d, *packs.put(bodies.get(*place))) for d, *place in zip(f.digest, f.file, f["at"].tolist(), f["size"].tolist(), strict=True)]
            yield pd.DataFrame(out, columns=[x.split()[0] for x in PLACES.split(",")])
        packs.close()

    return picked.repartition("file").sortWithinPartitions("file", "at").mapInPandas(copy, PLACES)


def measure(key: bytes, parts: list[bytes]) -> tuple:
    """What the contract asks of the stored form of these chunks, after its payload has met its digest."""
    joined = b"".join(parts)
    media = media_header(len(joined)) + joined
    payload = samples_of(media)
    sha = hashlib.sha256(payload)
    if sha.digest() != key:
        raise ValueError("a payload read back doesn't have its digest")
    return len(payload), sha.hexdigest(), zlib.crc32(payload[-16:]), len(media), hashlib.sha256(media).hexdigest(), features_of(payload)


MEASURED = "payload_bytes long,payload_sha256 string,tail_crc32 long,media_bytes long,media_sha256 string,feature string"
_NAMES = [x.split()[0] for x in MEASURED.split(",")]


def media_columns(docs: DataFrame) -> DataFrame:
    """The contract's columns of each document, computed from the stored bytes after reading them back."""
    spark = docs.sparkSession
    first, kept = new_folder(spark, "packs"), new_folder(spark, "media")
    parts = cut(store(docs, first), "payloads")
    places = cut(compact(parts, first, kept), "store")
    drop_folder(first)

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bodies, unpack = Bodies(kept), zstandard.ZstdDecompressor()
        for frame in frames:
            out = []
            for key, chunks in zip(frame.key, frame.chunks, strict=True):
                stretch = []
                for c in chunks:
                    part = unpack.decompress(bodies.get(c["file"], c["at"], c["size"]))
                    if hashlib.sha256(part).digest() != c["digest"]:
                        raise ValueError("a stored chunk doesn't have its digest")
                    stretch.append(part)
                out.append((key, *measure(key, stretch)))
            yield pd.DataFrame(out, columns=["key", *_NAMES])

    lists = parts.groupBy("key").agg(F.first(F.col("chunks.digest")).alias("digests"))
    listed = lists.select("key", F.posexplode("digests").alias("pos", "digest")).join(places, "digest")
    ordered = listed.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("pos", "digest", "file", "at", "size"))).alias("chunks"))
    found = ordered.mapInPandas(read, "key binary," + MEASURED)
    rows = parts.select("key", "doc_ids", "sizes").join(found, "key").select(F.explode(F.arrays_zip("doc_ids", "sizes")).alias("of"), *_NAMES)
    return rows.select(F.col("of.doc_ids").alias("doc_id"), F.col("of.sizes").alias("n_bytes"), *_NAMES)
