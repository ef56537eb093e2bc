"""Density clusters by joins and bounded groups against a plain version on one table of distances."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkgauge.operators import density


def plain(x, least, unit=1e-9):
    """A cluster of each row, NOISE for those in none: every distance, edges in order, a tree of parts walked from the top."""
    n = len(x)
    d = np.array([density.distances(x, v, unit) for v in x])
    core = np.sort(d, axis=1)[:, min(least, n - 1)]
    reach = np.maximum(np.maximum(d, core[:, None]), core[None, :])
    up = list(range(2 * n - 1))
    size, joined = {i: 1 for i in range(n)}, []

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for w, a, b in sorted((int(reach[a, b]), a, b) for a in range(n) for b in range(a + 1, n)):
        p, q = top(a), top(b)
        if p != q:
            new = n + len(joined)
            up[p] = up[q] = new
            size[new] = size[p] + size[q]
            joined.append((p, q, w))

    def rows_of(v):
        return [v] if v < n else rows_of(joined[v - n][0]) + rows_of(joined[v - n][1])

    def walk(v, born):
        """(mass, value, {row: (cluster, how deep)}) of the cluster that starts at v; clusters are their sets of rows."""
        me, mass, below, path = frozenset(rows_of(v)), 0.0, [], v
        while True:
            a, b, w = joined[path - n]
            rate = 1.0 / (w * unit) if w else 1e12
            big = [s for s in (a, b) if size[s] >= least]
            mass += sum(size[s] for s in (a, b) if len(big) != 1 or s not in big) * (rate - born)
            if len(big) != 1:
                break
            path = big[0]
        if len(big) == 2:
            below = [walk(s, rate) for s in (a, b)]
        under = sum(value for _, value, _ in below)
        keep = bool(born) and (not below or mass >= under)
        return mass, mass if keep or not below else under, [me] if keep else [c for _, _, cs in below for c in cs]

    found = walk(2 * n - 2, 0.0)[2] if n > 1 else []
    out = np.full(n, density.NOISE)
    for k, rows in enumerate(found):
        out[sorted(rows)] = k
    return out


def shape(name):
    rnd = np.random.default_rng(11)
    blobs = np.concatenate([rnd.normal(c, 0.08, (m, 3)) for c, m in ((0.0, 30), (1.0, 24), (2.5, 16))] + [rnd.uniform(-2, 4, (14, 3))])
    if name == "blobs":
        return blobs, 5
    if name == "nested":
        return np.concatenate([rnd.normal(c, s, (m, 2)) for c, s, m in ((0.0, 0.02, 20), (0.2, 0.02, 20), (1.4, 0.03, 15), (5.0, 0.8, 25))]), 6
    if name == "duplicates":
        x = blobs[rnd.integers(0, len(blobs), 150)]
        return np.concatenate([x, np.repeat(blobs[:1], 12, 0), np.repeat(blobs[40:41], 7, 0)]), 6
    if name == "chain":
        return np.stack([np.cumsum(rnd.choice([0.01, 0.1, 0.4], 80)), np.zeros(80)], 1), 4
    return blobs * 40, 5  # long vectors


def same(a, b):
    """The same rows together, and the same ones in none."""
    pairs = {(int(p), int(q)) for p, q in zip(a, b, strict=True)}
    return len({p for p, _ in pairs}) == len(pairs) == len({q for _, q in pairs}) and all((p == density.NOISE) == (q == density.NOISE) for p, q in pairs)


def labels(spark, x, least, **sizes):
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "k long, v array<double>").repartition(3)
    got = {r.k: r.cluster for r in density.clusters(rows, "k", "v", least, **sizes).collect()}
    return [got[i] for i in range(len(x))]


@pytest.mark.parametrize("name", ["blobs", "nested", "duplicates", "chain", "long"])
def test_clusters_equal_the_plain_version(spark, name):
    x, least = shape(name)
    want = plain(x, least, 1e-9 if name != "long" else 1e-7)
    assert len(set(want.tolist())) > 2 and same(labels(spark, x, least), want)


@pytest.mark.parametrize(("name", "block", "chunk"), [("blobs", 16, 20), ("duplicates", 40, 64)])
def test_small_blocks_and_chunks_change_nothing(spark, name, block, chunk):
    x, least = shape(name)
    assert same(labels(spark, x, least, block=block, chunk=chunk), plain(x, least))


def test_core_distances_are_order_statistics(spark):
    x, least = shape("duplicates")
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "k long, v array<double>")
    got = density.core_distances(density.points(rows, "k", "v"), least, 1e-9, 30).collect()
    for r in got:
        assert r.core == np.sort(density.distances(x, np.array(r.x), 1e-9))[least]


def test_numbers_follow_first_members(spark):
    raw = spark.createDataFrame(list(zip(range(6), [7, -1, 2, 7, -1, -1], "abcdbe", strict=True)), "k long, cluster int, signature string")
    assert [r.group_id for r in density.numbered(raw, "k").orderBy("k").collect()] == [0, 2, 1, 0, 2, 3]


def test_few_rows_and_one_cluster_go_by_signature(spark):
    rows = spark.createDataFrame([(i, f"{w} {w} words", v) for i, (w, v) in enumerate([("alpha", [1.0, 0.0]), ("beta", [0.0, 1.0])])], "k long, t string, v array<double>")
    for n in (2, 1, 0):
        assert [r.group_id for r in density.density_groups(rows.limit(n), "k", "t", "v").orderBy("k").collect()] == list(range(n))
    same_vectors = spark.createDataFrame([(i, "alpha" if i % 2 else "beta", [1.0, 0.0]) for i in range(8)], "k long, t string, v array<double>")
    got = density.density_groups(same_vectors, "k", "t", "v")
    assert got.where("group_id = 0").count() == 4 and got.agg(F.max("group_id")).first()[0] == 1
    lost = spark.createDataFrame([(i, "alpha", None) for i in range(4)], "k long, t string, v array<double>")
    assert {r.group_id for r in density.density_groups(lost, "k", "t", "v").collect()} == {0}


@pytest.mark.parametrize("scale", [1.0, 1e-6, 3e20])
def test_counts_are_those_of_measured_distances(scale):
    rnd = np.random.default_rng(5)
    x, y = rnd.normal(size=(2, 300, 8))
    y[:40], y[40:80] = x[:40], x[:40] + 1e-7  # equal and nearly equal ones
    y[80:120] = x[0] + np.eye(8)[0] * np.arange(40)[:, None] * density.BINS**2 * 1e-9  # at edges of bins
    x, y, w = x * scale, y * scale, rnd.integers(1, 4, 300)
    unit = 1e-9 * max(scale, 1.0) * 4
    d = np.array([density.distances(y, v, unit) for v in x])
    low = np.zeros(300, np.int64)
    for width in (density.BINS**2, density.BINS, 1):
        got, want = np.zeros((2, 300, density.BINS), np.int64)
        density.counted(got, x, y, w, low, unit, width)
        bins = (d - low[:, None]) // width
        i, j = np.nonzero((bins >= 0) & (bins < density.BINS))
        np.add.at(want, (i, bins[i, j]), w[j])
        assert (got == want).all()
        low = low + want.argmax(1) * width


def test_vectors_are_not_copied(spark):
    """Tasks read packed blocks: neither step shuffles vectors, whatever the number of blocks."""
    x, least = shape("blobs")
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "k long, v array<double>")
    cored = density.core_distances(density.points(rows, "k", "v"), least, 1e-9, 10)
    for found in (cored, density.tree_edges(cored, 1e-9, 10)):
        assert "InPandas" not in found._jdf.queryExecution().toString()


class Blocks:
    """Packed points that lie in memory."""

    def __init__(self, block, *columns):
        self.n, self.block, self.columns = len(columns[0]), block, columns
        self.blocks = -(-self.n // block)

    def read(self, numbers):
        at = np.concatenate([np.arange(k * self.block, min((k + 1) * self.block, self.n)) for k in numbers])
        return [c[at] for c in self.columns]


@pytest.mark.parametrize("scale", [1.0, 1e-6, 3e20])
@pytest.mark.parametrize("case", ["brackets", "misses", "too many", "no sample"])
def test_core_distances_by_rank_are_those_by_counts(scale, case, monkeypatch):
    """Brackets of a sample only decide what is measured; where they miss or hold too much, points are counted."""
    rnd = np.random.default_rng(7)
    x = rnd.normal(size=(700, 6))
    x[600:650] = x[0] + rnd.normal(size=(50, 6)) * 1e-8  # nearer to each other than single precision tells
    x[650:] = x[1] + np.eye(6)[rnd.integers(0, 6, 50)] * 0.25  # equally far from a point
    x, w, need = x * scale, np.where(rnd.random(700) < 0.1, rnd.integers(1, 40, 700), 1), 60
    unit, longest = 1e-9 * max(scale, 1.0) * 8, float(np.sqrt((x * x).sum(1).max()))
    want = []
    for v in x:
        d = density.distances(x, v, unit)
        order = np.argsort(d, kind="stable")
        want.append(d[order][np.searchsorted(w[order].cumsum(), need)])
    drawn = np.repeat(x, w, 0)[::3] if case != "no sample" else x[:0]
    rank = len(drawn) * need / w.sum()
    low, high = {"misses": (5, 8), "no sample": (-2, 2)}.get(case, (int(rank - 12), int(rank + 12)))
    counts = []
    plainly = density.core_by_counts
    monkeypatch.setattr(density, "core_by_counts", lambda rows, *more: counts.append(len(rows)) or plainly(rows, *more))
    packed = Blocks(150, np.arange(700), x, w)
    right = density.sides(drawn, longest)[1]
    got = density.core_by_rank(x, packed, need, unit, longest, right, low, high, {"too many": 2, "no sample": 700}.get(case, 300))
    assert got.tolist() == want
    assert sum(counts) > 400 if case in ("misses", "too many") else sum(counts) < 80


@pytest.mark.parametrize(("name", "parts"), [("blobs", 1024), ("nested", 1024), ("duplicates", 1024), ("chain", 1024), ("nested", 1)])
def test_edges_hold_the_tree_and_few_more(spark, name, parts, monkeypatch):
    """One edge a point, and one for two parts that these leave; trees of spans only for too many parts."""
    x, least = shape(name)
    monkeypatch.setattr(density, "PARTS", parts)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "k long, v array<double>")
    cored = density.cut(density.core_distances(density.points(rows, "k", "v"), least, 1e-9, 16), "cored")
    found = {(r.a, r.b, r.d) for r in density.tree_edges(cored, 1e-9, 16).collect()}
    pts = cored.orderBy("id").collect()
    n, core = len(pts), np.array([p.core for p in pts])
    a, b, d = density.local_tree(np.arange(n), np.array([p.x for p in pts]), core, 1e-9)
    assert set(zip(a.tolist(), b.tolist(), d.tolist(), strict=True)) <= found
    assert len(found) < 2 * n


def test_a_point_takes_one_edge_however_many_blocks(spark):
    """Edges don't grow with the pairs of blocks: for a table of one dense part they are the tree's."""
    x = np.random.default_rng(3).normal(size=(2100, 2)) * 0.1
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "k long, v array<double>")
    cored = density.cut(density.core_distances(density.points(rows, "k", "v"), 300, 1e-9, 300), "cored")
    assert density.tree_edges(cored, 1e-9, 300).count() <= 2110


def test_texts_are_read_once(spark):
    """Vectors and signatures are kept from one reading, whatever reads them later."""
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def told(text):
        seen.add(1)
        return text

    x, _ = shape("blobs")
    rows = spark.createDataFrame([(i, "alpha beta beta" if i % 2 else None, v.tolist()) for i, v in enumerate(x)], "k long, t string, v array<double>").withColumn("t", told("t"))
    got = density.density_groups(rows, "k", "t", "v")
    assert got.count() == len(x) and got.select("group_id").distinct().count() > 2 and seen.value == len(x)
