"""Labelled rows for the classifiers, and the learning split of the queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: At most this many labelled documents of each label are used to fit a model; scoring covers all rows.
TRAIN_ROWS = 3000


def remainder(doc_id: Column, modulus: int) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % modulus


def _known(labels: DataFrame, label: str, learn: Column) -> DataFrame:
    """(doc_id, y) of the labelled rows for which `learn` holds, repeated and null labels or ids dropped."""
    return labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).groupBy("doc_id").agg(F.max(label).cast("int").alias("y")).where(learn)


def row_weights(labels: DataFrame, label: str, learn: Column, rows: int = TRAIN_ROWS) -> dict[int, float]:
    """How many learning rows a row of training_rows stands for, by label: all rows of the label over those in the sample."""
    return {r["y"]: max(1.0, r["count"] / rows) for r in _known(labels, label, learn).groupBy("y").count().collect()}


def training_rows(docs: DataFrame, labels: DataFrame, label: str, learn: Column, rows: int = TRAIN_ROWS) -> list[tuple[str, int]]:
    """A sample, bounded in rows, of whole texts (text, label) of the labelled rows for which `learn` holds: for each label the
    `rows` smallest by a hash of doc_id, so the sample is the same on every run. Repeated and null labels
    or ids are dropped first. An empty result means that nothing is labelled."""
    known = _known(labels, label, learn)
    picks = []
    for y in (0, 1):
        some = known.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
        picks += [(r.doc_id, y) for r in some.collect()]
    if not picks:
        return []
    chosen = docs.sparkSession.createDataFrame(picks, "doc_id long, y int")
    found = (
        docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
        .join(F.broadcast(chosen), "doc_id")  # at most 2 * rows ids
        .collect()
    )
    return [(r.text, r.y) for r in sorted(found, key=lambda r: (r.doc_id, r.text))]
