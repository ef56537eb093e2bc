"""Shared plumbing of the training-data operators: shared-folder tables, text slices, packed keys."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import cut, discard, shared_dir

__all__ = ["cut", "discard", "documents", "map_texts", "mixed", "pack_sorted", "release", "rewrite", "shared_dir", "shared_uri", "slices", "texts", "tokenizer_path", "unpack_sorted", "zpack", "zunpack"]

#: Bytes of text that a Python worker handles at a time.
SLICE_BYTES = 2 << 20


def release(spark: SparkSession) -> None:
    """Let Spark's context cleaner drop the shuffle files of rounds whose result has been written."""
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()


def shared_uri(spark: SparkSession) -> str:
    """The shared folder as a URI, for files that workers write themselves."""
    folder = shared_dir(spark)
    return folder if "://" in folder else "file://" + folder.removeprefix("file:")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def texts(docs: DataFrame) -> DataFrame:
    """doc_id and text (null: empty); whatever else the table holds is left out of the scan."""
    return docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))


def slices(batches: Iterable[pa.RecordBatch], limit: int = SLICE_BYTES) -> Iterator[tuple[list, list]]:
    """(ids, texts) lists of about `limit` characters; one longer text is a slice of its own."""
    for batch in batches:
        ids, col = batch.column(0), batch.column(1)
        lengths = np.diff(np.frombuffer(col.buffers()[1], dtype=np.int32)[col.offset : col.offset + len(col) + 1]) if len(col) else np.zeros(0, int)
        start = size = 0
        for i, n in enumerate(lengths.tolist()):
            if size and size + n > limit:
                yield ids.slice(start, i - start).to_pylist(), col.slice(start, i - start).to_pylist()
                start, size = i, 0
            size += n
        if start < len(col):
            yield ids.slice(start).to_pylist(), col.slice(start).to_pylist()


def map_texts(docs: DataFrame, rows: Callable[[], Callable[[list, list], dict]], schema: str) -> DataFrame:
    """Apply a per-slice function over (doc_id, text). `rows` is called once in each worker task and
    returns the function; that returns columns by name. No shuffle; a lost task is simply rerun."""
    names = [x.split()[0] for x in schema.split(",")]
    kinds = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_(), "binary": pa.binary()}
    arrow = pa.schema([(x.split()[0], kinds[x.split()[1]]) for x in schema.split(",")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = rows()
        for ids, strings in slices(batches):
            out = f(ids, strings)
            yield pa.RecordBatch.from_arrays([pa.array(out[n], arrow.field(n).type) for n in names], schema=arrow)

    return texts(docs).mapInArrow(run, schema)


def mixed(h: np.ndarray) -> np.ndarray:
    """A finaliser that spreads 64-bit keys (public splitmix64 constants)."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def pack_sorted(keys: np.ndarray, drop: int = 0) -> bytes:
    """Ascending uint64 keys as byte planes, compressed; the lowest `drop` bytes are left out."""
    planes = keys.astype(">u8").view(np.uint8).reshape(-1, 8)[:, : 8 - drop]
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes.T).tobytes())


def unpack_sorted(data: bytes, drop: int = 0) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(8 - drop, -1)
    planes = np.zeros((raw.shape[1], 8), np.uint8)
    planes[:, : 8 - drop] = raw.T
    return planes.reshape(-1).view(">u8").astype(np.uint64)


def zpack(a: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(a.tobytes())


def zunpack(data: bytes, dtype) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), dtype)


def tokenizer_path(name: str) -> str:
    """Where a public tokenizer's file lies; SPARKGAUGE_TOKENIZERS names another folder."""
    folder = os.environ.get("SPARKGAUGE_TOKENIZERS")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def rewrite(docs: DataFrame, start: Callable[[], Callable[[list], list]]) -> DataFrame:
    """Map whole rows by their texts (null: empty): the function gives a new text for each, or None where the
    row goes. An unchanged text (the same object) keeps its row as it is; a changed one also gets a new n_chars."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = start()
        for batch in batches:
            at = batch.schema.get_field_index("text")
            column = batch.column(at)
            pair = pa.RecordBatch.from_arrays([pa.array(range(len(batch)), pa.int64()), column.fill_null("")], names=["i", "text"])
            for places, strings in slices([pair]):
                new = f(strings)
                keep = [k for k, (i, t) in enumerate(zip(places, new, strict=True)) if t is not None]
                rows = batch.take(pa.array([places[k] for k in keep], pa.int64()))
                changed = {j: new[k] for j, k in enumerate(keep) if new[k] is not strings[k]}
                if changed:
                    columns = rows.columns
                    for name, value in (("text", lambda t: t), ("n_chars", len)):
                        c = rows.schema.get_field_index(name)
                        if c >= 0:
                            old = columns[c].to_pylist()
                            columns[c] = pa.array([value(changed[j]) if j in changed else old[j] for j in range(len(old))], columns[c].type)
                    rows = pa.RecordBatch.from_arrays(columns, schema=batch.schema)
                yield rows

    return docs.mapInArrow(run, docs.schema)
