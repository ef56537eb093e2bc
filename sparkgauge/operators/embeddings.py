"""Vectors of texts from an embedding provider: each distinct text once, in batches that a request can hold."""

from __future__ import annotations

import json
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import plain as P
from ..models import FAILURES
from ..ranks import row_numbers
from ..settings import Model
from ..storage import cut
from . import vectors as V

#: Texts of a batch, and estimated tokens of a request; a batch of long texts takes several.
BATCH, MOST_TOKENS = 64, 100_000


def requests(texts: list[str], most: int = MOST_TOKENS) -> list[list[str]]:
    """The texts in order, as many to a request as fit; one that is longer goes alone."""
    out, size = [], 0
    for t in texts:
        n = P.estimate_tokens(t)
        if not out or size + n > most:
            out.append([])
            size = 0
        out[-1].append(t)
        size += n
    return out


def unit(vectors: list[list[float]]) -> list[list[float]]:
    """Vectors of length 1; zero vectors stay."""
    x = np.array(vectors, float)
    return (x / np.where((n := np.linalg.norm(x, axis=1, keepdims=True)) == 0, 1.0, n)).tolist()


def provided(rows: DataFrame, key: str, text: str, model: Model, make: Callable[[str, str], Callable]) -> DataFrame | None:
    """key, vec of every row; None if any request failed or gave vectors of several lengths: then no vector counts.

    Distinct texts are numbered by digest, so batches are the same in every run, whatever the partitions."""
    named = rows.select(key, F.coalesce(text, F.lit("")).alias("t")).withColumn("digest", F.sha2("t", 256))
    distinct = named.select("digest", "t").distinct()
    batched = row_numbers(distinct, ["digest"], name="n").withColumn("batch", F.floor(F.col("n") / BATCH))

    def call(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("digest")
        ask = make(model.provider, model.model)
        try:
            got = [v for part in requests(f.t.to_list()) for v in json.loads(ask("embed", part).text)]
            vecs = unit(got) if len(got) == len(f) else None
        except FAILURES:
            vecs = None
        return pd.DataFrame({"digest": f.digest, "vec": vecs if vecs is not None else [None] * len(f)})

    found = cut(batched.groupBy("batch").applyInPandas(call, "digest string, vec array<double>"), "provided")
    lengths = found.select(F.coalesce(F.size("vec"), F.lit(-1)).alias("n")).distinct().limit(2).collect()
    if len(lengths) != 1 or lengths[0].n < 1:
        return None
    of = found.withColumnRenamed("digest", "_d")
    return named.join(of, F.col("digest") == F.col("_d")).select(key, "vec")


def task_vectors(rows: DataFrame, key: str, text: str, model: Model, make: Callable[[str, str], Callable] | None) -> DataFrame:
    """rows with vec: the provider's vectors, or, without a provider or where it fails, hashed ones for all rows."""
    vecs = provided(rows, key, text, model, make) if make else None
    return V.with_vectors(rows, V.embedded(rows, key, text) if vecs is None else vecs, key)
