"""Encoding and decoding with a public SentencePiece model through a distinct-chunk table of the corpus.

No piece of the model crosses from a character to a following white-space marker (checked when the
model is loaded), so BPE merges stay inside a marked word. Each distinct marked word of the corpus is
segmented once by the library itself and the ids are joined back by position:

1. A slice of texts sends its distinct words, packed, to the buckets that the words' hashes name. A word that all documents
   share costs one entry a slice.
2. A bucket segments each of its distinct words once and answers every slice with their ids.
3. A slice's texts meet its answers, look up the ids of each place, and are decoded by the library.

Texts move once, compressed, and nothing is written between the rounds; lost parts are computed again from the input. The slices
are formed twice, so `docs` must give the same rows in the same partitions each time, as a table does; else the query fails,
as slices carry a digest of their rows.

Null text: as empty. Empty text: no ids, empty decoded text. Long texts: whole. Repeated rows and null ids: a row each. Empty
table: no rows. Columns other than doc_id and text are not read, whatever their names.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunk_table import ChunkTable, dealt
from .common import slices, texts, tokenizer_path, zpack, zunpack

MARK = "▁"
#: Bytes of text in a slice, and those whose distinct words one bucket should get; buckets grow in number with the corpus.
SLICE, BUCKET = 8 << 20, 32 << 20
#: Words that the library segments in a call.
CALL = 50_000
_RUNS = re.compile(" +[^ ]*")


def chunks(text: str) -> list[str]:
    """Marked words without their first marker; the library puts that back before each."""
    text = text.replace(MARK, " ")
    if not text:
        return []
    if "  " not in text and text[0] != " " and text[-1] != " ":
        return text.split(" ")
    return [x[1:] for x in _RUNS.findall(" " + text)]


class Codec:
    def __init__(self, path: str):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=path)
        size = self.sp.vocab_size()
        for i in range(size):
            if MARK in self.sp.id_to_piece(i).lstrip(MARK):
                raise ValueError(f"piece {i} crosses a white-space marker; marked words can't be segmented apart")
        self.lone = [self.sp.piece_to_id(MARK)]
        self.decimal = [str(i) for i in range(size)]
        self.kind = np.uint16 if size <= 1 << 16 else np.uint32

    def segment(self, words: list[str]) -> list[list[int]]:
        out = []
        for lo in range(0, len(words), CALL):
            part = words[lo : lo + CALL]
            out += [ids if w else self.lone for w, ids in zip(part, self.sp.encode(part, num_threads=1), strict=True)]
        return out

    def decode(self, ids: list[int]) -> str:
        return self.sp.decode(ids) if ids else ""


@functools.lru_cache(1)
def _codec(path: str) -> Codec:
    """One for each Python worker; it holds the model only."""
    return Codec(path)


def _packed(strings: list[str]) -> tuple[bytes, bytes]:
    """Lengths in code points, and the strings in UTF-8, both compressed."""
    return zpack(np.fromiter(map(len, strings), np.uint32, len(strings))), zstandard.ZstdCompressor(level=3).compress("".join(strings).encode())


def _unpacked(lengths: bytes, body: bytes) -> list[str]:
    ends = np.cumsum(zunpack(lengths, np.uint32), dtype=np.int64).tolist()
    whole = zstandard.ZstdDecompressor().decompress(body).decode()
    return [whole[a:b] for a, b in zip([0, *ends], ends, strict=False)]


def _sliced(frames: Iterator[pa.RecordBatch], limit: int) -> Iterator[tuple[str, list, list[str]]]:
    """(name, ids, texts) of each slice of a partition."""
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    for k, (ids, strings) in enumerate(slices(frames, limit)):
        digest = hashlib.blake2b(repr(ids).encode(), digest_size=8)
        for s in strings:
            digest.update(s.encode())
        yield f"{part}:{k}:{digest.hexdigest()}", ids, strings


def _cells(frames: Iterator[pa.RecordBatch], limit: int, n_buckets: int) -> Iterator[pa.RecordBatch]:
    for name, _, strings in _sliced(frames, limit):
        words, counts = dealt(map(chunks, strings), n_buckets)
        ends = np.cumsum(counts).tolist()
        some = [(b, *_packed(words[ends[b] - n : ends[b]])) for b, n in enumerate(counts.tolist()) if n]
        columns = zip(*some, strict=True) if some else ([], [], [])
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(([name] * len(some), *columns), (pa.string(), pa.int64(), pa.binary(), pa.binary()), strict=True)], names=["slice", "bucket", "lengths", "body"])


def _rows(frames: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    for name, ids, strings in _sliced(frames, limit):
        known = np.array([i is not None for i in ids], bool)
        values = (name, np.array([i or 0 for i in ids], np.int64).tobytes(), known.tobytes(), *_packed(strings))
        yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, (pa.string(), *[pa.binary()] * 4), strict=True)], names=["slice", "ids", "known", "lengths", "body"])


def _answer(frame: pd.DataFrame, path: str) -> pd.DataFrame:
    """The ids of a bucket's words for each slice that asks."""
    codec = _codec(path)
    lists = [_unpacked(n, b) for n, b in zip(frame.lengths, frame.body, strict=True)]
    table = ChunkTable.segmented(list(dict.fromkeys(itertools.chain.from_iterable(lists))), codec.segment)
    runs = [table.runs(words) for words in lists]
    return pd.DataFrame({"slice": frame.slice, "bucket": frame.bucket, "counts": [zpack(n.astype(np.uint32)) for n, _ in runs], "pieces": [zpack(ids.astype(codec.kind)) for _, ids in runs]})


def _encoded(left: pd.DataFrame, right: pd.DataFrame, path: str, n_buckets: int, keep: bool) -> pd.DataFrame:
    """The rows of a slice, from its texts and its answers."""
    codec = _codec(path)
    if len(left) != 1:
        raise RuntimeError("docs gave other rows or partitions when they were read again; write them to a table first")
    row, got = left.iloc[0], right.sort_values("bucket")
    strings = _unpacked(row.lengths, row.body)
    parts = [chunks(s) for s in strings]
    words, counts = dealt(parts, n_buckets)
    if got.bucket.tolist() != np.flatnonzero(counts).tolist():
        raise RuntimeError("docs gave other rows or partitions when they were read again; write them to a table first")
    n = [zunpack(x, np.uint32) for x in got.counts]
    pieces = [zunpack(x, codec.kind) for x in got.pieces]
    table = ChunkTable(words, np.concatenate(n) if n else np.zeros(0, np.int64), np.concatenate(pieces) if pieces else np.zeros(0, codec.kind))
    out = {"n_tokens": [], "ids_sha256": [], "decoded_sha256": [], "ids": [], "decoded": []}
    for some in parts:
        ids = table.runs(some)[1].tolist()
        joined, back = ",".join(map(codec.decimal.__getitem__, ids)), codec.decode(ids)
        out["n_tokens"].append(len(ids))
        out["ids_sha256"].append(hashlib.sha256(joined.encode()).hexdigest())
        out["decoded_sha256"].append(hashlib.sha256(back.encode()).hexdigest())
        if keep:
            out["ids"].append(joined)
            out["decoded"].append(back)
    doc_id = pd.arrays.IntegerArray(np.frombuffer(row.ids, np.int64).copy(), ~np.frombuffer(row.known, bool))
    return pd.DataFrame({"doc_id": doc_id} | {k: v for k, v in out.items() if keep or k not in ("ids", "decoded")})


def encode_decode(docs: DataFrame, model: str | None = None, keep: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256; with keep also the ids (comma-joined) and text."""
    path = model or tokenizer_path("piece_bpe_32k.model")
    rows = texts(docs)
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n, limit = 16, SLICE
    while n * BUCKET < size:
        n *= 2
    cells = rows.mapInArrow(lambda frames: _cells(frames, limit, n), "slice string,bucket long,lengths binary,body binary")
    answers = cells.repartition(n, "bucket").groupBy("bucket").applyInPandas(lambda frame: _answer(frame, path), "slice string,bucket long,counts binary,pieces binary")
    asked = rows.mapInArrow(lambda frames: _rows(frames, limit), "slice string,ids binary,known binary,lengths binary,body binary")
    schema = "doc_id long,n_tokens long,ids_sha256 string,decoded_sha256 string" + (",ids string,decoded string" if keep else "")
    # In proportion to the corpus, so that the mean task doesn't grow with it; hashed names fill some with several slices more.
    asked, answers = (x.repartition(2 * n, "slice") for x in (asked, answers))
    return asked.groupBy("slice").cogroup(answers.groupBy("slice")).applyInPandas(lambda left, right: _encoded(left, right, path, n, keep), schema)
