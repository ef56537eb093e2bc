"""Records of JSON array files, a file read by many tasks.

A file is cut at every `}`, which Spark's text reader does block by block, strings and all. Whether a piece begins inside a
string, and how many brackets are open there, is a running sum over the pieces before: each piece maps both ways to begin to an
end and a change of depth, chunks of pieces add theirs up, and chunks' sums are added up in order. A piece that ends outside strings at depth one
ends a record; the pieces since the one before are its text."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..ranks import row_numbers
from ..storage import cut, discard

CHUNK = 4096
_TOLD = re.compile(r'\\.|["\[\]{},]', re.DOTALL)


def scan(piece: str, inside: bool, depth: int = 0) -> tuple[bool, int, int]:
    """(whether the piece ends inside a string, its depth at the end, commas at depth one), for a piece that begins inside one or
    not, at a depth. A piece has its closing bracket, so none begins after a backslash."""
    commas = 0
    for m in _TOLD.finditer(piece):
        c = m[0]
        if c == '"':
            inside = not inside
        elif not inside:
            depth += (c in "[{") - (c in "]}")
            commas += c == "," and depth == 1
    return inside, depth, commas


def is_array(spark: SparkSession, path: str) -> bool:
    """Whether the first file's text begins with a bracket."""
    for r in spark.read.text(path, lineSep="[").select(F.regexp_replace("value", "\ufeff", "").alias("v"), F.monotonically_increasing_id().alias("i")).orderBy("i").limit(1).collect():
        return not r.v.strip()
    return False


def records(spark: SparkSession, path: str, chunk: int = CHUNK) -> DataFrame:
    """file, n (from 0), place, value of the object elements of the arrays in files under path. n counts objects, place all
    elements; values that stand before an object in its array are in its text, too (`objects` leaves them out)."""
    meta = F.col("_metadata")
    read = spark.read.text(path, lineSep="}").select("value", meta["file_path"].alias("file"), meta["file_block_start"].alias("start"), F.monotonically_increasing_id().alias("at"))
    pieces = row_numbers(read, ["start", "at"], ["file"], "n").select("file", "n", F.floor(F.col("n") / chunk).alias("chunk"), F.concat("value", F.lit("}")).alias("value"))
    pieces = cut(pieces, "pieces")

    def told(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            ends = [(*scan(v, False)[:2], *scan(v, True)[:2]) for v in f.value]
            yield pd.concat([f[["file", "n", "chunk"]], pd.DataFrame(ends, columns=["out_in", "out_d", "in_in", "in_d"], index=f.index)], axis=1)

    steps = cut(pieces.select("file", "n", "chunk", "value").mapInPandas(told, "file string, n long, chunk long, out_in boolean, out_d long, in_in boolean, in_d long"), "steps")

    def summed(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("n")
        out = []
        for inside in (False, True):
            depth = 0
            for a, b, c, d in f[["out_in", "out_d", "in_in", "in_d"]].itertuples(index=False):
                inside, depth = (c, depth + d) if inside else (a, depth + b)
            out += [inside, depth]
        return pd.DataFrame([(f.file.iloc[0], f.chunk.iloc[0], *out)], columns=["file", "chunk", "out_in", "out_d", "in_in", "in_d"])

    sums = steps.groupBy("file", "chunk").applyInPandas(summed, "file string, chunk long, out_in boolean, out_d long, in_in boolean, in_d long")

    def before(f: pd.DataFrame) -> pd.DataFrame:
        """A file's chunks in order: how each begins. A row for CHUNK pieces."""
        f = f.sort_values("chunk")
        inside, depth, out = False, 0, []
        for file, k, a, b, c, d in f[["file", "chunk", "out_in", "out_d", "in_in", "in_d"]].itertuples(index=False):
            out.append((file, k, inside, depth))
            inside, depth = (c, depth + d) if inside else (a, depth + b)
        return pd.DataFrame(out, columns=["file", "chunk", "inside", "depth"])

    begun = cut(sums.groupBy("file").applyInPandas(before, "file string, chunk long, inside boolean, depth long"), "begun")

    def ended(f: pd.DataFrame, g: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("n")
        inside, depth, done, commas, out = bool(g.inside.iloc[0]), int(g.depth.iloc[0]), 0, 0, []
        for n, value in zip(f.n, f.value, strict=True):
            inside, depth, more = scan(value, inside, depth)
            commas += more
            out.append((f.file.iloc[0], n, f.chunk.iloc[0], done, commas))
            done += depth == 1 and not inside
        return pd.DataFrame([(*x, done, commas) for x in out], columns=["file", "n", "chunk", "own", "commas", "all", "all_commas"])

    placed = cut(pieces.groupBy("file", "chunk").cogroup(begun.groupBy("file", "chunk")).applyInPandas(ended, "file string, n long, chunk long, own long, commas long, all long, all_commas long"), "placed")
    chunks = placed.groupBy("file", "chunk").agg(F.max("all").alias("all"), F.max("all_commas").alias("all_commas"))
    so_far = lambda c: F.coalesce(F.sum(c).over(Window.partitionBy("file").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ahead = chunks.select(F.col("file").alias("f"), F.col("chunk").alias("c"), so_far("all").alias("ahead"), so_far("all_commas").alias("commas_ahead"))
    numbered = placed.join(ahead, (F.col("file") == F.col("f")) & (F.col("chunk") == F.col("c"))).select(F.col("file").alias("f"), F.col("n").alias("m"), (F.col("own") + F.col("ahead")).alias("record"), (F.col("commas") + F.col("commas_ahead")).alias("place"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "value"))), lambda x: x["value"]), "")
    whole = pieces.join(numbered, (F.col("file") == F.col("f")) & (F.col("n") == F.col("m"))).groupBy("file", "record").agg(text.alias("value"), F.max("place").alias("place"))
    out = cut(whole.select("file", F.col("record").alias("n"), "place", "value"), "records")
    discard(pieces, steps, begun, placed)
    return out


def objects(value: str, n: int) -> list[dict]:
    """The objects of a record's text: one, after a bracket or a comma and any other values. What follows the last object of an
    array is none."""
    text = value.lstrip("\ufeff \t\r\n")
    body = text[1:] if text[:1] == ("," if n else "[") else text
    if "{" not in body or body.lstrip().startswith("]") and body.strip("] \t\r\n}") == "":
        return []
    return [x for x in json.loads(f"[{body}]") if isinstance(x, dict)]
