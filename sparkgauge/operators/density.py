"""Density clusters of vectors, and their labels in order of first members.

The hierarchical density method of Campello, Moulavi and Sander: core distances (to the `least`-th neighbour besides the point),
mutual reachability, its minimum spanning tree, the tree condensed to clusters of at least `least` points, and the choice of
clusters with the most excess of mass; never the cluster of all points.

All of it is joins, counts and bounded groups. Equal vectors are one point with a weight. Distances are whole multiples of a
unit (10^-9 for unit vectors), so that ties are ties; edges are in order of distance, then of their ends' first members.

Points are packed in blocks, once, as files of the shared folder; tasks read from there what they compare, so vectors are neither
shuffled nor copied.

1. Core distances by rank: a sample of rows brackets a point's distance, one pass over all blocks counts what lies below and gathers what lies
   within (products in single precision), and the few pairs too near to the rank that is sought are measured. A point whose bracket
   misses, or holds too much, is counted: distances go into 2048 bins of the range that it has left, three rounds leave one value.
2. The least edge of a point is its core distance, to the first point within it that has no greater one. These edges are in the spanning tree, and few
   points have none: the parts that the edges make are about as many as the tree has peaks of density. Of two parts, the least edge between them
   follows in one more pass, which leaves out pairs of one part and pairs that are no shorter than what is known.
   For a table of one block, or more than PARTS parts, each pair of spans of blocks, about the root of points / SPREAD spans, finds
   the spanning tree of its own points. An edge that is the longest of a cycle in a part of the graph is so in the whole, so the edges together contain the whole tree.
3. What condensing needs of the dendrogram is, for each point, the edge at which its part first has `least` points, and the edges that join two
   such parts. Edges in order are halved again and again: the left half is contracted (graph.py) to give the right half its nodes,
   parts that stay small to the end of the left half point to their root, and the two halves are independent from then on. Halves
   of CHUNK edges are finished one a group.
4. Parts of `least` points are few (at most points / least begin, and as many edges join two), 50 as `density_groups` sets `least`:
   the tree of these is walked on the driver, with sums by cluster from the executors.

Step 1 compares all distinct vectors in blocks, step 2 those of different parts: the work is quadratic in them, memory isn't.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow.parquet as pq
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..graph import roots
from ..ranks import row_numbers
from ..storage import cut, discard
from . import vectors as V

BLOCK, CHUNK = 4096, 1 << 16
#: Rows of the sample, and how many deviations of a rank in it make a bracket's half; pairs in brackets that a task gathers at a time; most parts that are compared with each other.
DRAWN, SURE, GATHERED, PARTS = 8192, 4.0, 1 << 23, 1024
#: Spans are about the root of points / SPREAD, so the edges that they leave grow with the power 1.5 of the points; pairs of a product, or measured, at a time.
SPREAD, PRODUCT = 500, 1 << 19
#: Distances are under BINS ** ROUNDS units.
BINS, ROUNDS = 2048, 3
NOISE = -1


def distances(x: np.ndarray, to: np.ndarray, unit: float) -> np.ndarray:
    """Of the rows of x to one vector, in whole units; the same either way round."""
    return np.rint(np.sqrt(((x - to) ** 2).sum(1)) / unit).astype(np.int64)


def longest_of(pts: DataFrame) -> float:
    return pts.agg(F.max(F.sqrt(F.aggregate("x", F.lit(0.0), lambda s, v: s + v * v)))).first()[0] or 0.0


def unit_of(pts: DataFrame) -> float:
    """The unit of distance: 10^-9, or the power of ten that the longest vector needs."""
    longest, unit = longest_of(pts), 1e-9
    while 2 * longest >= unit * (BINS**ROUNDS - 1):
        unit *= 10
    return unit


def points(rows: DataFrame, key: str, vec: str) -> DataFrame:
    """id (dense, by first member), x, weight, first of the distinct vectors."""
    distinct = rows.where(F.col(vec).isNotNull()).select(key, F.col(vec).cast("array<double>").alias("x")).groupBy("x").agg(F.min(key).alias("first"), F.count("*").alias("weight"))
    return cut(row_numbers(distinct, ["first"], name="id"), "points")


class Packed:
    """Points (id, x and more numbers) in files by block of ids; tasks read blocks by number."""

    def __init__(self, pts: DataFrame, block: int, *more: str) -> None:
        self.n, self.block, self.more = pts.count(), block, more
        self.blocks = -(-self.n // block)

        def pack(frame: pd.DataFrame) -> pd.DataFrame:
            frame = frame.sort_values("id")
            x = np.array(frame.x.to_list(), float)
            return pd.DataFrame([(frame.block.iloc[0], x.shape[1], *[v.tobytes() for v in (frame.id.to_numpy(), x, *[frame[c].to_numpy() for c in more])])], columns=["block", "width", *names])

        names = ["id", "x", *more]
        by = pts.select((F.col("id") / block).cast("int").alias("block"), "id", "x", *[F.col(c).cast("long").alias(c) for c in more])
        self.table = cut(by.groupBy("block").applyInPandas(pack, "block int, width int, " + ", ".join(f"{c} binary" for c in names)), "blocks", ["block"])
        self.path = self.table._sparkgauge_path

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "table"}

    def read(self, numbers) -> list[np.ndarray]:
        """id, x and the other numbers of blocks together."""
        fs, root = arrow_fs.FileSystem.from_uri(self.path)
        parts = [r for k in numbers for r in pq.read_table(f"{root}/block={k}", filesystem=fs, partitioning=None).to_pylist()]
        out = [np.frombuffer(b"".join(p[c] for p in parts), np.int64) for c in ("id", *self.more)]
        x = np.concatenate([np.frombuffer(p["x"]).reshape(-1, p["width"]) for p in parts])
        return [out[0], x, *out[1:]]


def sides(x: np.ndarray, longest: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of products in single precision, with the squared lengths as two more coordinates: a product is a squared
    distance up to `off_of`, in lengths of the longest vector."""
    u = x / longest
    square = (u * u).sum(1, keepdims=True)
    one = np.ones_like(square)
    return np.concatenate([u, square, one], 1).astype(np.float32), np.ascontiguousarray(np.concatenate([-2 * u, one, square], 1).astype(np.float32).T)


def off_of(x: np.ndarray) -> np.float32:
    return np.float32((x.shape[1] + 8) * 2.0**-21)


def _measured(many: np.ndarray, x: np.ndarray, y: np.ndarray, w: np.ndarray, low: np.ndarray, p: np.ndarray, q: np.ndarray, unit: float, width: int) -> None:
    """Count pairs (place in x, place in y) by their distances."""
    for i in range(0, len(p), PRODUCT // 8):
        a, b = p[i : i + PRODUCT // 8], q[i : i + PRODUCT // 8]
        bins = (distances(y[b], x[a], unit) - low[a]) // width
        ok = (bins >= 0) & (bins < BINS)
        np.add.at(many, (a[ok], bins[ok]), w[b[ok]])


def counted(many: np.ndarray, x: np.ndarray, y: np.ndarray, w: np.ndarray, low: np.ndarray, unit: float, width: int) -> None:
    """Add to many (rows of x by bin) the weights of y's rows by distance: whole bins of `width` units from low on."""
    longest = math.sqrt(max((x * x).sum(1).max(), (y * y).sum(1).max())) or 1.0
    off, its = off_of(x), unit / longest
    left, right = sides(x, longest)[0], sides(y, longest)[1]
    first, step, ones = width == BINS ** (ROUNDS - 1), max(1, PRODUCT // len(y)), bool((w == 1).all())
    for at in range(0, len(x), step):
        square = left[at : at + step] @ right
        rows = len(square)
        if first:
            scale = np.float32(1 / (its * width))
            nearest = np.maximum(np.sqrt(np.maximum(square - off, 0)) * scale - np.float32(1e-3), 0).astype(np.int32)
            farthest = (np.sqrt(np.maximum(square, 0) + off) * scale + np.float32(1e-3)).astype(np.int32)
            open_ = (nearest != farthest) | (farthest >= BINS)
            nearest += np.arange(rows, dtype=np.int32)[:, None] * BINS
            nearest[open_] = rows * BINS
            found = np.bincount(nearest.ravel(), None if ones else np.broadcast_to(w, square.shape).ravel(), rows * BINS + 1)[:-1]
            many[at : at + step] += found.reshape(rows, BINS).astype(np.int64)
        else:
            some = low[at : at + step, None]
            nearest, farthest = (np.maximum(some - 1, 0) * its) ** 2, ((some + BINS * width + 1) * its) ** 2
            open_ = (square >= (nearest * (1 - 1e-6)).astype(np.float32) - off) & (square <= (farthest * (1 + 1e-6)).astype(np.float32) + off)
        p, q = np.nonzero(open_)
        _measured(many, x, y, w, low, p + at, q, unit, width)


def core_by_counts(x: np.ndarray, packed: Packed, need: int, unit: float) -> np.ndarray:
    """Of each row of x, the distance within which points of weight `need` lie."""
    low, below = np.zeros((2, len(x)), np.int64)
    for width in (BINS**r for r in reversed(range(ROUNDS))):
        many = np.zeros((len(x), BINS), np.int64)
        for j in range(packed.blocks):
            _, y, w = packed.read([j])
            counted(many, x, y, w, low, unit, width)
        up_to = below[:, None] + many.cumsum(1)
        at = (up_to >= need).argmax(1)
        below = np.where(at > 0, up_to[np.arange(len(at)), at - 1], below)
        low = low + at * width
    return low


def _brackets(left: np.ndarray, drawn: np.ndarray, low: int, high: int, slack: np.float32) -> tuple[np.ndarray, np.ndarray]:
    """Squared distances of each row at two ranks of the sample, `slack` apart from them."""
    least, most = np.full((2, len(left)), [[-np.inf], [np.inf]], np.float32)
    step = max(1, PRODUCT // max(1, drawn.shape[1]))
    ranks = [k for k in (low, high) if 0 <= k < drawn.shape[1]]
    for at in range(0, len(left) if ranks else 0, step):
        found = np.partition(left[at : at + step] @ drawn, ranks, 1)
        for k, out, by in ((low, least, -slack), (high, most, slack)):
            if k in ranks:
                out[at : at + step] = found[:, k] + by
    return least, most


def core_by_rank(x: np.ndarray, packed: Packed, need: int, unit: float, longest: float, drawn: np.ndarray, low: int, high: int, most: int) -> np.ndarray:
    """As core_by_counts. drawn: columns of a sample of rows; low, high: ranks in it that bracket the one sought; a row gathers about `most` pairs at most."""
    off, left = off_of(x), sides(x, longest)[0]
    least, greatest = _brackets(left, drawn, low, high, 3 * off)
    rows, below, many, gathered = len(x), np.zeros(len(x), np.int64), np.zeros(len(x), np.int64), []
    upto = greatest.copy()
    for j in range(packed.blocks):
        ids, y, w = packed.read([j])
        right, heavy, step = sides(y, longest)[1], np.flatnonzero(w > 1), max(1, PRODUCT // len(y))
        for at in range(0, rows, step):
            square = left[at : at + step] @ right
            under = square < least[at : at + step, None]
            below[at : at + step] += np.count_nonzero(under, axis=1)
            if len(heavy):
                below[at : at + step] += (under[:, heavy] @ (w[heavy] - 1.0)).astype(np.int64)
            found = np.flatnonzero((square <= upto[at : at + step, None]) & ~under)
            p, q = np.divmod(found, len(y))
            many[at : at + step] += np.bincount(p, minlength=len(square))
            gathered.append(((p + at).astype(np.uint16), ids[q].astype(np.int32), square.ravel()[found], w[q].astype(np.int32)))
        upto[many > most] = -np.inf  # counted later
    of, ids, square, w = (np.concatenate(v) for v in zip(*gathered, strict=True))
    del gathered
    order = np.argsort(of, kind="stable")
    ids, square, w, edge = ids[order], square[order], w[order], np.concatenate([[0], many.cumsum()])
    out, still, taken = np.full(rows, -1, np.int64), np.zeros(rows, np.int64), [(np.zeros(0, np.int64),) * 3]
    for k in np.flatnonzero((many > 0) & (many <= most) & (below < need)):
        mine = slice(edge[k], edge[k + 1])
        order = np.argsort(square[mine])
        some, up_to = square[mine][order], w[mine][order].cumsum(dtype=np.int64)
        if up_to[-1] < need - below[k]:
            continue
        value = some[np.searchsorted(up_to, need - below[k])]
        # The rank sought is within off of this, so what is as far again from it is on its side whatever its error.
        if value - 2 * off < least[k] or value + 2 * off > greatest[k]:
            continue
        i, end = np.searchsorted(some, value - 2 * off), np.searchsorted(some, value + 2 * off, "right")
        still[k] = need - below[k] - (up_to[i - 1] if i else 0)
        near = order[i:end]
        taken.append((np.full(len(near), k), ids[mine][near], w[mine][near]))
    del ids, square, w, order
    of, ids, w = (np.concatenate(v) for v in zip(*taken, strict=True))
    d, order = np.zeros(len(of), np.int64), np.argsort(ids, kind="stable")
    at = np.searchsorted(ids[order], np.arange(packed.blocks + 1) * packed.block)
    for j in np.flatnonzero(np.diff(at)):
        y = packed.read([j])[1]
        for i in range(at[j], at[j + 1], PRODUCT // 8):
            some = order[i : min(at[j + 1], i + PRODUCT // 8)]
            d[some] = distances(x[of[some]], y[ids[some] - j * packed.block], unit)
    order = np.lexsort((d, of))
    up_to, done = w[order].cumsum(dtype=np.int64), np.flatnonzero(still)
    start = np.searchsorted(of[order], done)
    before = np.where(start > 0, up_to[start - 1], 0)
    out[done] = d[order[np.searchsorted(up_to, before + still[done])]]
    missed = np.flatnonzero(out < 0)
    if len(missed):
        out[missed] = core_by_counts(x[missed], packed, need, unit)
    return out


def core_distances(pts: DataFrame, least: int, unit: float, block: int = BLOCK) -> DataFrame:
    """id, x, weight, core: the distance within which `least` other rows lie (all, if there are fewer)."""
    total, longest = pts.agg(F.sum("weight")).first()[0], longest_of(pts) or 1.0
    need, packed = min(least + 1, total), Packed(pts, block, "weight")
    copies = F.floor(F.col("weight") * (DRAWN / total) + F.pmod(F.xxhash64("id"), F.lit(1 << 30)) / (1 << 30)).cast("int")
    sample = pts.select("x", copies.alias("n")).where("n > 0").toPandas()  # about DRAWN at most
    drawn = sides(np.repeat(np.array(sample.x.to_list(), float), sample.n, 0), longest)[1] if len(sample) else np.zeros((1, 0), np.float32)
    of, share = drawn.shape[1], need / total
    half = SURE * math.sqrt(of * share * (1 - share)) + 2
    low, high = math.floor(of * share - half), math.ceil(of * share + half)
    wide = max(1, math.ceil(packed.n * min(1.0, 2 * half / max(of, 1))))  # pairs that a row gathers
    most_rows = max(1, min(block, GATHERED // wide, 1 << 16))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for k in (k for frame in frames for k in frame.id):
            ids, x, _ = packed.read([k])
            for i in range(0, len(ids), step := -(-len(ids) // -(-len(ids) // most_rows))):
                part = slice(i, i + step)
                yield pd.DataFrame({"of": ids[part], "core": core_by_rank(x[part], packed, need, unit, longest, drawn, low, high, 2 * wide)})

    spark = pts.sparkSession
    found = cut(spark.range(0, packed.blocks, 1, packed.blocks).mapInPandas(run, "of long, core long"), "core")
    discard(packed.table)
    return pts.join(found, F.col("id") == F.col("of")).select("id", "x", "weight", "core")


def local_tree(ids: np.ndarray, x: np.ndarray, core: np.ndarray, unit: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, d) of the minimum spanning tree by mutual reachability under the order (d, a, b); ids ascend."""
    n = len(ids)
    bits = np.int64(max(1, math.ceil(math.log2(max(n, 2)))))
    place = np.arange(n, dtype=np.int64)
    best = np.full(n, np.iinfo(np.int64).max)  # the order of the best edge as one number: d, then its lesser and its greater end
    out, at, edges = np.zeros(n, bool), 0, []
    for _ in range(n - 1):
        out[at] = True
        d = np.maximum(np.maximum(distances(x, x[at], unit), core[at]), core)
        order = (d << 2 * bits) | (np.minimum(place, at) << bits) | np.maximum(place, at)
        best = np.where(out, np.iinfo(np.int64).max, np.minimum(best, order))
        at = int(best.argmin())
        edges.append(best[at])
    e, mask = np.array(edges, np.int64), (np.int64(1) << bits) - 1
    return ids[(e >> bits) & mask], ids[e & mask], e >> 2 * bits


def least_edges(packed: Packed, k: int, unit: float, longest: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, d): edges of block k's points whose least edge is their core distance. Of such edges the least is that to the first point."""
    ids, x, core = packed.read([k])
    left, off, its = sides(x, longest)[0], off_of(x), unit / longest
    most = (((core + 1) * its) ** 2 * (1 + 1e-6)).astype(np.float32) + off
    to, live = np.full(len(ids), -1, np.int64), np.arange(len(ids))
    for j in range(packed.blocks):
        others, y, their = packed.read([j])
        right, step = sides(y, longest)[1], max(1, PRODUCT // len(others))
        for at in range(0, len(live), step):
            some = live[at : at + step]
            may = (left[some] @ right <= most[some, None]) & (their <= core[some, None])
            if j == k:
                may[np.arange(len(some)), some] = False
            open_ = np.arange(len(some))
            while len(open_):
                q = may[open_].argmax(1)
                open_, q = open_[found := may[open_, q]], q[found]
                fits = distances(x[some[open_]], y[q], unit) <= core[some[open_]]
                to[some[open_[fits]]] = others[q[fits]]
                may[open_, q] = False
                open_ = open_[~fits]
        live = live[to[live] < 0]
        if not len(live):
            break
    has = to >= 0
    return np.minimum(ids, to)[has], np.maximum(ids, to)[has], core[has]


def edges_between(packed: Packed, k: int, parts: int, unit: float, longest: float) -> list[tuple[int, int, int]]:
    """(a, b, d): the least edges between each two parts, of those from block k to itself and the later ones. packed: points in order of their parts (core, part, of)."""
    _, x, core, part, ids = packed.read([k])
    left, off, its = sides(x, longest)[0], 2 * off_of(x), unit / longest
    best = np.full((parts, parts), np.inf)  # the squared length of the best edge, not less
    edge: dict[tuple[int, int], tuple[int, int, int]] = {}
    square = lambda v: (v * its) ** 2
    for j in range(k, packed.blocks):
        _, y, their, other, others = packed.read([j])
        if part[0] == part[-1] == other[0] == other[-1]:
            continue
        right, step = sides(y, longest)[1], max(1, PRODUCT // len(y))
        mine, his = square(core).astype(np.float32), square(their).astype(np.float32)
        starts = np.flatnonzero(np.diff(other, prepend=-1))
        for at in range(0, len(x), step):
            own = part[at : at + step]
            reach = np.maximum(np.maximum(left[at : at + step] @ right, mine[at : at + step, None]), his)
            nearest = np.minimum.reduceat(reach, starts, axis=1)  # of each row to each part of the other block
            for c in np.unique(own):
                rows = np.flatnonzero(own == c)
                for s, d in enumerate(other[starts]):
                    if c == d:
                        continue
                    pair = (min(c, d), max(c, d))
                    bound = min(float(nearest[rows, s].min()), best[pair]) + 2 * float(off)
                    close = rows[nearest[rows, s] <= bound]
                    if not len(close):
                        continue
                    end = starts[s + 1] if s + 1 < len(starts) else len(y)
                    p, q = np.nonzero(reach[close, starts[s] : end] <= bound)
                    p, q = close[p] + at, q + starts[s]
                    for i in range(0, len(p), PRODUCT // 8):
                        e, f = p[i : i + PRODUCT // 8], q[i : i + PRODUCT // 8]
                        w = np.maximum(np.maximum(distances(x[e], y[f], unit), core[e]), their[f])
                        a, b = np.minimum(ids[e], others[f]), np.maximum(ids[e], others[f])
                        o = np.lexsort((b, a, w))[0]
                        edge[pair] = min(edge.get(pair, (1 << 62,)), (int(w[o]), int(a[o]), int(b[o])))
                    best[pair] = square(edge[pair][0] + 1) * (1 + 1e-6)
    return [(a, b, d) for d, a, b in edge.values()]


def tree_edges(cored: DataFrame, unit: float, block: int = BLOCK) -> DataFrame:
    """a, b, d: edges that contain the minimum spanning tree."""
    packed, longest = Packed(cored, block, "core"), longest_of(cored) or 1.0
    if packed.blocks == 1:
        return _trees_of_spans(packed, unit)
    spark, edges = cored.sparkSession, "a long, b long, d long"

    def least(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for k in (k for frame in frames for k in frame.id):
            yield pd.DataFrame(dict(zip("abd", least_edges(packed, k, unit, longest), strict=True))).astype("int64")

    firm = cut(spark.range(0, packed.blocks, 1, packed.blocks).mapInPandas(least, edges), "least").distinct()
    root = roots(firm).select(F.col("id").alias("of"), "root")
    placed = cut(cored.join(root, F.col("id") == F.col("of"), "left").select("id", "x", "core", F.coalesce("root", "id").alias("root")), "placed")
    heads = [r.root for r in placed.select("root").distinct().limit(PARTS + 1).collect()]
    if len(heads) > PARTS:
        return _trees_of_spans(packed, unit)
    discard(packed.table)
    if len(heads) == 1:
        return firm
    numbers = spark.createDataFrame([(r, i) for i, r in enumerate(sorted(heads))], "root long, part long")
    ordered = row_numbers(placed.join(F.broadcast(numbers), "root").select("part", F.col("id").alias("of"), "x", "core"), ["part", "of"], name="id")
    by_part = Packed(cut(ordered, "ordered"), block, "core", "part", "of")

    def between(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for k in (k for frame in frames for k in frame.id):
            yield pd.DataFrame(edges_between(by_part, k, len(heads), unit, longest), columns=["a", "b", "d"]).astype("int64")

    found = cut(spark.range(0, by_part.blocks, 1, by_part.blocks).mapInPandas(between, edges), "between")
    discard(by_part.table)
    return firm.unionByName(found).distinct()


def _trees_of_spans(packed: Packed, unit: float) -> DataFrame:
    spans = max(1, min(packed.blocks, math.ceil(math.sqrt(packed.n / SPREAD))))
    edge = [packed.blocks * i // spans for i in range(spans + 1)]

    def tree(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for i, j in zip(frame.i, frame.j, strict=True):
                a, b, d = local_tree(*packed.read([*range(edge[i], edge[i + 1]), *(range(edge[j], edge[j + 1]) if i < j else ())]), unit)
                yield pd.DataFrame({"a": a, "b": b, "d": d}).astype("int64")

    pairs = packed.table.sparkSession.range(spans * spans).select((F.col("id") / spans).cast("int").alias("i"), (F.col("id") % spans).cast("int").alias("j")).where("i < j" if spans > 1 else "i = j")
    found = cut(pairs.repartition(spans * spans // 2 + 1).mapInPandas(tree, "a long, b long, d long"), "trees")
    discard(packed.table)
    return found.distinct()


FOUND = "kind string, id long, rank long, d long, leaf long, to long, other_leaf long, other_to long"


def _kruskal(least: int, n: int):
    """Finish a chunk: its nodes (id, size) and edges (rank, a, b, d). Rows of three kinds: 'fell', a node's part reaches `least`
    points at an edge; 'born', the edge that makes a part of so many out of smaller ones; 'joined', one that joins two. A part of
    so many is named by a leaf that it holds (n + rank of a birth) or, if it came so, by its node (to)."""

    def run(nodes: pd.DataFrame, edges: pd.DataFrame) -> pd.DataFrame:
        up = {i: i for i in nodes.id.tolist()}
        size = dict(zip(nodes.id.tolist(), nodes["size"].tolist(), strict=True))
        few = {i: [i] for i, s in size.items() if s < least}  # members of the parts that are small
        name = {i: (None, i) for i, s in size.items() if s >= least}
        out = []

        def top(i: int) -> int:
            while up[i] != i:
                up[i] = up[up[i]]
                i = up[i]
            return i

        for rank, a, b, d in edges.sort_values("rank")[["rank", "a", "b", "d"]].itertuples(index=False):
            p, q = top(a), top(b)
            if p == q:
                continue
            if size[p] < size[q]:
                p, q = q, p
            up[q], size[p] = p, size[p] + size[q]
            if p in name and q in name:
                out.append(("joined", None, rank, d, *name[p], *name.pop(q)))
                continue
            fallen = few.pop(q)
            if p not in name:
                few[p] += fallen
                if size[p] < least:
                    continue
                fallen, name[p] = few.pop(p), (n + rank, None)
                out.append(("born", None, rank, d, n + rank, None, None, None))
            out += [("fell", i, rank, d, *name[p], None, None) for i in fallen]
        return pd.DataFrame(out, columns=[c.split()[0] for c in FOUND.split(", ")]).astype({c.split()[0]: "Int64" for c in FOUND.split(", ")[1:]})

    return run


def big_parts(cored: DataFrame, edges: DataFrame, least: int, chunk: int = CHUNK) -> tuple[DataFrame, DataFrame]:
    """What became of each point: (id, rank, d, leaf), and the events (kind, rank, d, leaf, other_leaf) by which parts of at least
    `least` rows begin and join."""
    n = cored.count()
    ranked = cut(row_numbers(edges, ["d", "a", "b"], name="rank").select(F.lit(0).cast("long").alias("part"), "rank", "a", "b", "d"), "ranked")
    width, total = chunk, ranked.count()
    while width < total:
        width *= 2
    edges, nodes, forwards = ranked, cut(cored.select(F.lit(0).cast("long").alias("part"), "id", F.col("weight").alias("size")), "nodes"), []
    while width > chunk:
        lower = F.col("rank") % width < width // 2
        links = edges.where(lower).select(F.struct("part", F.col("a").alias("id")).alias("a"), F.struct("part", F.col("b").alias("id")).alias("b"))
        found = roots(links).select(F.col("id.part").alias("part"), F.col("id.id").alias("id"), F.col("root.id").alias("root"))
        rooted = nodes.join(found, ["part", "id"], "left").withColumn("root", F.coalesce("root", "id"))
        sizes = cut(rooted.groupBy("part", "root").agg(F.sum("size").alias("all")), "sizes")
        rooted = cut(rooted.join(sizes, ["part", "root"]), "rooted")
        forwards.append(cut(rooted.where((F.col("all") < least) & (F.col("id") != F.col("root"))).select("id", F.col("root").alias("to")), "forward"))
        ends = lambda e, c, keep: e.join(rooted.select("part", F.col("id").alias(c), *keep(c)), ["part", c])
        left = ends(edges.where(lower), "a", lambda c: [F.col("all")]).where(F.col("all") >= least).select(F.col("part") * 2, "rank", "a", "b", "d")
        moved = ends(ends(edges.where(~lower), "a", lambda c: [F.col("root").alias("root_a")]), "b", lambda c: [F.col("root").alias("root_b")]).where("root_a <> root_b")
        right = moved.select(F.col("part") * 2 + 1, "rank", F.col("root_a").alias("a"), F.col("root_b").alias("b"), "d")
        edges = cut(left.toDF("part", "rank", "a", "b", "d").unionByName(right.toDF("part", "rank", "a", "b", "d")), "ranked")
        touched = edges.select("part", F.col("a").alias("id")).unionByName(edges.select("part", F.col("b").alias("id"))).distinct()
        both = rooted.select((F.col("part") * 2).alias("part"), "id", "size").unionByName(sizes.select((F.col("part") * 2 + 1).alias("part"), F.col("root").alias("id"), F.col("all").alias("size")))
        nodes = cut(both.join(touched, ["part", "id"], "left_semi"), "nodes")
        width //= 2
    told = cut(nodes.groupBy("part").cogroup(edges.groupBy("part")).applyInPandas(_kruskal(least, n), FOUND), "told")
    none = lambda t: F.lit(None).cast(t)
    fate = told.where("kind = 'fell'").select("id", "to", "rank", "d", "leaf")
    heavy = cored.where(F.col("weight") >= least).select("id", none("long").alias("to"), F.lit(-1).cast("long").alias("rank"), F.col("core").alias("d"), F.col("id").alias("leaf"))
    fate = fate.unionByName(heavy)
    for f in forwards:
        fate = fate.unionByName(f.select("id", "to", none("long").alias("rank"), none("long").alias("d"), none("long").alias("leaf")))
    fate = _followed(cut(fate, "fate"))
    leaf_of = fate.select(F.col("id").alias("of"), F.col("leaf").alias("its"))
    joined = told.where("kind = 'joined'").join(leaf_of, F.col("to") == F.col("of"), "left").withColumn("leaf", F.coalesce("leaf", "its")).drop("of", "its")
    joined = joined.join(leaf_of, F.col("other_to") == F.col("of"), "left").withColumn("other_leaf", F.coalesce("other_leaf", "its"))
    events = joined.select("kind", "rank", "d", "leaf", "other_leaf").unionByName(told.where("kind = 'born'").select("kind", "rank", "d", "leaf", "other_leaf"))
    events = events.unionByName(heavy.select(F.lit("born").alias("kind"), "rank", "d", "leaf", none("long").alias("other_leaf")))
    return fate, cut(events, "events")


def _followed(fate: DataFrame) -> DataFrame:
    """id, rank, d, leaf with every pointer followed to its end, in doubling steps. A pointer's row takes what it lacks itself."""
    while fate.where("to IS NOT NULL").limit(1).count():
        ahead = fate.select(F.col("id").alias("of"), F.col("to").alias("next"), F.col("rank").alias("r"), F.col("d").alias("e"), F.col("leaf").alias("l"))
        step = fate.join(ahead, F.col("to") == F.col("of"), "left")
        done = cut(step.select("id", F.col("next").alias("to"), F.coalesce("rank", "r").alias("rank"), F.coalesce("d", "e").alias("d"), F.coalesce("leaf", "l").alias("leaf")), "fate")
        discard(fate)
        fate = done
    return fate.drop("to")


class Tree:
    """Clusters of the condensed tree. Cluster c has a leaf, the ranks from and up to which it lasts, a parent and children."""

    def __init__(self, events: list) -> None:
        self.since, self.until, self.parent, self.children, self.split, self.chain = [], [], [], [], [], {}
        current: dict[int, int] = {}
        held: dict[int, list[int]] = {}
        for e in sorted(events, key=lambda e: (e["rank"], e["kind"], e["leaf"])):
            c = len(self.since)
            self.since.append(e["rank"])
            self.until.append(None)
            self.parent.append(None)
            self.split.append(None)
            if e["kind"] == "born":
                self.children.append([])
                held[c] = [e["leaf"]]
            else:
                below = [current[e["leaf"]], current[e["other_leaf"]]]
                self.children.append(below)
                for b in below:
                    self.parent[b], self.until[b], self.split[b] = c, e["rank"], e["d"]
                held[c] = held.pop(below[0]) + held.pop(below[1])
            for leaf in held[c]:
                current[leaf] = c
                self.chain.setdefault(leaf, []).append(c)

    def chosen(self, weight: dict[int, float], rates: dict[int, float], unit: float) -> list[int]:
        """Each cluster's label: the topmost chosen cluster that holds it, else NOISE. weight, rates: of the rows that fell in a
        cluster, their number and their summed rates (1 / distance)."""
        born = [0.0 if d is None else rate(d, unit) for d in self.split]
        size, value, pick = [], [], []
        for c, below in enumerate(self.children):
            size.append(weight.get(c, 0) + sum(size[b] for b in below))
            mass = rates.get(c, 0.0) - weight.get(c, 0) * born[c] + sum(size[b] * (born[b] - born[c]) for b in below)
            under = sum(value[b] for b in below)
            pick.append(self.parent[c] is not None and (not below or mass >= under))
            value.append(mass if pick[-1] or not below else under)
        out = [NOISE] * len(pick)
        for c in reversed(range(len(pick))):
            up = self.parent[c]
            out[c] = out[up] if up is not None and out[up] != NOISE else c if pick[c] else NOISE
        return out


def rate(d: int, unit: float) -> float:
    return 1.0 / (d * unit) if d else 1e12


def clusters(rows: DataFrame, key: str, vec: str, least: int, block: int = BLOCK, chunk: int = CHUNK) -> DataFrame:
    """key, cluster (NOISE for rows in none). At most rows / least clusters begin: their tree is made on the driver."""
    spark = rows.sparkSession
    pts = points(rows, key, vec)
    if pts.limit(1).count() == 0:
        return rows.select(key, F.lit(NOISE).alias("cluster"))
    unit = unit_of(pts)
    cored = cut(core_distances(pts, least, unit, block), "cored")
    fate, events = big_parts(cored, tree_edges(cored, unit, block), least, chunk)
    tree = Tree(events.collect())
    lasts = [(leaf, c, tree.since[c], tree.until[c] if tree.until[c] is not None else 1 << 62) for leaf, chain in tree.chain.items() for c in chain]
    spans = spark.createDataFrame(lasts, "of long, cluster int, since long, until long")
    fell = cut(fate.join(F.broadcast(spans), (F.col("leaf") == F.col("of")) & (F.col("rank") >= F.col("since")) & (F.col("rank") < F.col("until"))).select("id", "cluster", "d"), "fell")
    how_fast = F.when(F.col("d") == 0, F.lit(1e12)).otherwise(1.0 / (F.col("d") * unit))
    sums = fell.join(pts.select(F.col("id").alias("of"), "weight"), F.col("id") == F.col("of")).groupBy("cluster").agg(F.sum("weight").alias("n"), F.sum(F.col("weight") * how_fast).alias("rates")).collect()
    labels = tree.chosen({r["cluster"]: r["n"] for r in sums}, {r["cluster"]: r["rates"] for r in sums}, unit)
    named = spark.createDataFrame(list(enumerate(labels)), "of int, label int")
    labelled = fell.join(F.broadcast(named), F.col("cluster") == F.col("of")).select(F.col("id").alias("_id"), "label")
    placed = pts.join(labelled, F.col("id") == F.col("_id"), "left").select("x", "label")
    return rows.select(key, F.col(vec).cast("array<double>").alias("_x")).join(placed, F.col("_x") == F.col("x"), "left").select(key, F.coalesce("label", F.lit(NOISE)).alias("cluster"))


def numbered(raw: DataFrame, key: str) -> DataFrame:
    """key, group_id of (key, cluster, signature): clusters numbered by their first members; after them the rows in none, one
    number for each signature."""
    none = F.col("cluster") == NOISE
    named = raw.select(key, none.cast("int").alias("late"), F.when(none, F.lit(None)).otherwise(F.col("cluster")).alias("c"), F.when(none, F.col("signature")).alias("s"))
    groups = row_numbers(named.groupBy("late", "c", "s").agg(F.min(key).alias("_first")), ["late", "_first"], name="group_id")
    of = groups.select(F.col("late").alias("_l"), F.col("c").alias("_c"), F.col("s").alias("_s"), "group_id")
    return named.join(of, (F.col("late") == F.col("_l")) & F.col("c").eqNullSafe(F.col("_c")) & F.col("s").eqNullSafe(F.col("_s"))).select(key, "group_id")


def density_groups(rows: DataFrame, key: str, text: str, vec: str) -> DataFrame:
    """key, group_id: density clusters of the vectors, rows in none by signature; groups by signature alone for under three
    rows, or where all rows are in one cluster or none. A cluster has a fiftieth of the rows at least, so fifty begin at most."""
    read = cut(V.signatures(rows, key, text, vec), "read")  # texts are read once, and vectors made once
    n = read.count()
    if n >= 3:
        raw = cut(clusters(read, key, vec, max(3, n // 50)), "clusters")
        if raw.select("cluster").distinct().limit(2).count() > 1:
            signed = read.select(F.col(key).alias("_k"), "signature")
            return numbered(raw.join(signed, F.col(key) == F.col("_k")).select(key, "cluster", "signature"), key)
    return V.numbered_signatures(read.select(key, "signature"), key).select(key, "group_id")
