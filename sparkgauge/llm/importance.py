"""Importance resampling towards a target distribution: documents whose hashed word n-grams look like the target's are
drawn more often, by a Gumbel top-k.

Features are the runs of 1 .. N words of a text, words being runs of 0-9, a-z and bytes over 127 after lower-casing A-Z alone;
a feature's bucket is its CRC-32 modulo BUCKETS (crc_ngrams.py: CRCs of n-grams are combined from those of words). Two passes over
the texts and no shuffle of them: the first counts buckets, a histogram a task, added up by bucket; the second adds up the
documents' gains. The gains are one number a bucket, so what the driver holds is BUCKETS numbers, whatever the corpus. The draw is
by rank over ranges of (score, doc_id) (ranks.py), so no task holds all rows.

Null and empty texts: no features, weight 0, never drawn (nor any other under LEAST_WORDS words). Null doc_id: its noise is that
of an empty id, and it ranks after equal scores that have one. Long texts: whole, in pieces. Ties: the smaller doc_id;
repeated rows get a rank each, those of one doc_id ordered by weight, then n_features. Empty tables: no rows; without target
texts all gains follow from counts of 0. Columns other than doc_id and text are not read; `resampled` keeps them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..ranks import row_numbers
from .common import cut, texts
from .crc_ngrams import ngram_crcs

N, BUCKETS, SEED, PERCENT, LEAST_WORDS = 2, 10_000, 7, 25, 20


def _word_bytes() -> np.ndarray:
    is_word = np.arange(256) > 0x7F
    for a, b in (("0", "9"), ("a", "z")):
        is_word[ord(a) : ord(b) + 1] = True
    return is_word


def _lower() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[ord("A") : ord("Z") + 1] += 32
    return table


class Texts:
    """A column of texts as lower-cased bytes."""

    def __init__(self, column: pa.Array):
        column = column.cast(pa.large_string())
        self.rows = len(column)
        _, offsets, data = column.buffers()
        self.offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + self.rows + 1] if self.rows else np.zeros(1, np.int64)
        self.data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)

    def features(self, n: int, buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
        """(row, bucket, words in the run), in pieces."""
        low = _lower()[self.data[: int(self.offsets[-1])]]
        for rows, crcs, k in ngram_crcs(low, self.offsets, _word_bytes(), n):
            yield rows, crcs % np.uint32(buckets), k


def bucket_counts(docs: DataFrame, n: int = N, buckets: int = BUCKETS) -> DataFrame:
    """bucket, n: the features of all texts by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, bucket, _ in Texts(batch.column(0)).features(n, buckets):
                counts += np.bincount(bucket, minlength=buckets)
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(counts[at], pa.int64())], names=["bucket", "n"])

    return docs.select(F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame, n: int = N, buckets: int = BUCKETS) -> list[int]:
    """Each bucket's floor(1000 ln of how much likelier it is in the target)."""

    def counts(frame: DataFrame) -> list[int]:
        out = [0] * buckets
        for r in bucket_counts(frame, n, buckets).collect():  # a row a bucket
            out[r["bucket"]] = r["n"]
        return out

    here, there = counts(docs), counts(target)
    all_here, all_there = sum(here), sum(there)
    return [math.floor(1000 * math.log((t + 1) * (all_here + buckets) / ((s + 1) * (all_there + buckets)))) for s, t in zip(here, there, strict=True)]


def weights(docs: DataFrame, gain: list[int], n: int = N) -> DataFrame:
    """doc_id, n_words, n_features, weight of each document."""
    schema = "doc_id long, n_words long, n_features long, weight long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = np.array(gain, np.int64)
        for batch in batches:
            column = Texts(batch.column(1))
            n_words, n_features, total = (np.zeros(column.rows, np.int64) for _ in range(3))
            for rows, bucket, k in column.features(n, len(gain)):
                many = np.bincount(rows, minlength=column.rows)
                n_words += many * (k == 1)
                n_features += many
                total += np.bincount(rows, of[bucket], column.rows).astype(np.int64)  # whole numbers far under 2 ** 53
            weight = total // np.maximum(n_features, 1)
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(x, pa.int64()) for x in (n_words, n_features, weight)]], names=["doc_id", "n_words", "n_features", "weight"])

    return texts(docs).mapInArrow(run, schema)


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """floor(1000 times a Gumbel value) that depends on the id alone."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")
    return F.floor(F.lit(-1000) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def scored(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED, n: int = N, buckets: int = BUCKETS) -> DataFrame:
    """doc_id, n_features, weight, score, rank, n_words of each document; rank (1, 2, ...) of the drawn ones."""
    rows = weights(docs, gains(docs, target, n, buckets), n)
    rows = cut(rows.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)), "scores")
    may = rows.where(F.col("n_words") >= least_words)
    drawn = percent * may.count() // 100
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("weight").desc(), F.col("n_features").desc(), F.col("n_words").desc()]
    ranked = row_numbers(may, order, name="place").withColumn("rank", F.when(F.col("place") < drawn, F.col("place") + 1))
    rest = rows.where(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long"))
    return ranked.drop("place").unionByName(rest).select("doc_id", "n_features", "weight", "score", "rank", "n_words")


def resampled(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """The drawn rows of docs. Rows with one doc_id stay or go together: they stay if one of them is drawn."""
    ids = scored(docs, target, percent, least_words, seed).where(F.col("rank").isNotNull()).select(F.col("doc_id").alias("_drawn"))
    return docs.join(ids, F.col("doc_id").cast("long").eqNullSafe(F.col("_drawn")), "left_semi")


def _sql() -> str:
    """The DuckDB twin: n-grams as strings, their CRCs byte by byte."""
    return rf"""
WITH RECURSIVE step AS (SELECT i, 0 AS k, i::BIGINT AS v FROM range(256) t(i) UNION ALL SELECT i, k + 1, xor(v >> 1, 3988292384::BIGINT * (v & 1)) FROM step WHERE k < 8),
tab AS (SELECT list(v ORDER BY i) AS tab FROM step WHERE k = 8),
src AS (SELECT 'd' AS what, row_number() OVER () AS k, doc_id, text FROM documents UNION ALL SELECT 't', -row_number() OVER (), NULL, text FROM benchmark),
w AS (SELECT what, k, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM src),
g AS (SELECT what, k, unnest(ws) AS g FROM w UNION ALL SELECT what, k, ws[i] || ' ' || ws[i + 1] FROM (SELECT what, k, ws, unnest(range(1, len(ws))) AS i FROM w WHERE len(ws) > 1)),
per AS (SELECT what, k, g, count(*) AS c FROM g GROUP BY what, k, g),
h AS (SELECT g, hex(g) AS x FROM (SELECT DISTINCT g FROM per)),
b AS (SELECT g, xor(list_reduce(list_transform(range(1, length(x), 2), lambda j: ('0x' || substr(x, j, 2))::BIGINT), lambda c, y: xor(c >> 8, tab[(xor(c, y) & 255) + 1]), 4294967295::BIGINT), 4294967295::BIGINT) % {BUCKETS} AS bucket FROM h, tab),
n AS (SELECT bucket, sum(c) FILTER (what = 'd') AS s, sum(c) FILTER (what = 't') AS t FROM per JOIN b USING (g) GROUP BY bucket),
z AS (SELECT sum(s) AS s_all, coalesce(sum(t), 0) AS t_all FROM n),
gain AS (SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * (s_all + {BUCKETS}) / ((coalesce(s, 0) + 1)::DOUBLE * (t_all + {BUCKETS}))))::BIGINT AS gain FROM n, z),
f AS (SELECT k, sum(c)::BIGINT AS n_features, floor(sum(c * gain)::DOUBLE / sum(c))::BIGINT AS weight FROM per JOIN b USING (g) JOIN gain USING (bucket) WHERE what = 'd' GROUP BY k),
r AS (SELECT k, doc_id, len(ws)::BIGINT AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight, ('0x' || substr(sha256('{SEED}:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT AS h FROM w LEFT JOIN f USING (k) WHERE what = 'd'),
q AS (SELECT *, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score, n_words >= {LEAST_WORDS} AS may FROM r),
p AS (SELECT *, row_number() OVER (PARTITION BY may ORDER BY score DESC, doc_id NULLS LAST, weight DESC, n_features DESC, n_words DESC) AS place, count(*) OVER (PARTITION BY may) AS many FROM q)
SELECT doc_id, n_features, weight, score, CASE WHEN may AND place <= {PERCENT} * many // 100 THEN place END AS rank, n_words FROM p
"""


SQL = _sql()
