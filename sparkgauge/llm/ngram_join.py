"""N-gram Jaccard join: documents whose sets of five-word shingles have a similarity of 0.75 or more.

1. Shingles are hashed to 64 bits. A question-and-answer round (exchange.py) tells each batch how many documents
   have each of its shingles. A document of n shingles, over n - ceil(0.75 n) of which occur nowhere else, can't link.
2. Of what is left, equal sets are one class. Two sets that link share a shingle among the first
   n - ceil(0.75 n) + 1 of each in the order (frequency, hash); these are the class's keys.
3. Each class is verified against two classes at most, the smallest of its keys' smallest classes and the most frequent of
   them, where the bound of step 4 allows a link. So a large group of near copies becomes one component with a few pairs a class, not all pairs.
4. Keys whose classes are still in different components join those components to a neighbourhood; classes of different
   components that share a key are always in one. A neighbourhood is searched by a count-vector R-tree: shingles are
   hashed to GROUPS groups, and a class is the point of its group counts. The sum of coordinate minima of two points (or
   of a point and a box's upper corner) bounds the overlap from above; boxes and pairs below the needed overlap are
   passed over. First each class verifies its BEST candidates of other components, then, over what is still apart, all.
   Only classes outside a neighbourhood's largest component ask. Large neighbourhoods are searched in pairs of
   blocks, so no task holds a whole one.
5. Links give components by hooking roots (graph.py).

Null and blank texts: no shingles, linked with nothing. Under five words: the whole sequence is the one shingle. Ties
and repeated rows: a row's component is that of its text, so rows of one doc_id with different texts may be in different
ones (each named by its smallest doc_id); every row is returned. Rows without
doc_id: linked with nothing, component_id null; the stage keeps them. Empty table: no rows. Long texts: whole. Other columns of
the table are carried through the stage unread, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .common import cut, discard, map_texts, mixed, release
from .components import components
from .exchange import answers_for, ask, batches, buckets_for, by_batch, even_edges, opened

WORDS, PERCENT = 5, 75
GROUPS = 256
TOP = 255
#: Classes in a block of a neighbourhood: BLOCK while that makes at most MANY blocks, then up to WIDE.
BLOCK, MANY, WIDE = 256, 16, 4096
LEAF = 16
BEST = 3
_POWER = np.uint64(0xD1342543DE82EF95)
_POWERS = np.cumprod(np.full(1 << 16, _POWER))
_BYTE = mixed(np.arange(1, 257, dtype=np.uint64))
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def shingles(lengths: np.ndarray, body: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(document, hash) of the distinct shingles of each document, by document and hash."""
    n_docs = len(lengths)
    raw = _LOWER[np.frombuffer(body, np.uint8)]
    if not len(raw):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    word = ~_SPACE[raw]
    edge = np.zeros(len(raw) + 1, bool)
    ends = np.cumsum(lengths)
    edge[ends] = True
    starts = ends - lengths
    edge[starts] = True
    first = np.flatnonzero(word & (np.concatenate([[True], ~word[:-1]]) | edge[:-1]))
    last = np.flatnonzero(word & (np.concatenate([~word[1:], [True]]) | edge[1:])) + 1
    if not len(first):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    at = np.arange(len(raw)) - np.repeat(np.concatenate([[0], first]), np.diff(np.concatenate([[0], first, [len(raw)]])))
    powers = _POWERS if at.max() < len(_POWERS) else np.cumprod(np.full(at.max() + 1, _POWER))
    codes = np.where(word, _BYTE[raw] * powers[at], np.uint64(0))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(codes, dtype=np.uint64)])
    h = mixed(total[last] - total[first] + (last - first).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    doc = np.searchsorted(ends, first, side="right")
    n_words = np.bincount(doc, minlength=n_docs)
    mult = _POWERS[1:]
    short = n_words[doc] < WORDS
    acc = h.copy()
    w = len(h)
    for k in range(1, min(WORDS, w)):
        acc[: w - k] += h[k:] * mult[k]  # wrong past a document's end; those starts are dropped below
    left = np.cumsum(n_words)[doc] - np.arange(w)
    full = left >= WORDS
    # Short documents: one hash of all their words, from the first word's place.
    heads = np.flatnonzero(short & np.concatenate([[True], doc[1:] != doc[:-1]]))
    docs_out, hash_out = doc[full], mixed(acc[full])
    if len(heads):
        value = np.array([(h[i : i + n_words[doc[i]]] * mult[: n_words[doc[i]]]).sum() + np.uint64(n_words[doc[i]]) for i in heads.tolist()], np.uint64)
        docs_out, hash_out = np.concatenate([docs_out, doc[heads]]), np.concatenate([hash_out, mixed(value)])
    order = np.lexsort((hash_out, docs_out))
    docs_out, hash_out = docs_out[order], hash_out[order]
    new = np.concatenate([[True], (docs_out[1:] != docs_out[:-1]) | (hash_out[1:] != hash_out[:-1])])
    return docs_out[new], hash_out[new]


def _batch_keys(row) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The batch's distinct shingles and their documents, counting equal sets once; and all (doc, hash)."""
    ids, lengths, body = opened(row)
    doc, h = shingles(lengths, body)
    n = np.bincount(doc, minlength=len(ids))
    end = np.cumsum(n)
    signature = np.add.reduceat(np.append(mixed(h + np.uint64(7)), np.uint64(0)), np.minimum(end - n, len(h))) if len(ids) else np.zeros(0, np.uint64)
    signature[n == 0] = 0
    _, keep = np.unique(signature, return_index=True)
    once = np.zeros(len(ids), bool)
    once[keep] = True
    keys, counts = np.unique(h[once[doc]], return_counts=True)
    return keys, counts, doc, h


def asked_keys(row) -> tuple[np.ndarray, np.ndarray]:
    keys, counts, _, _ = _batch_keys(row)
    return keys, counts


def needed(n: int) -> int:
    """The least overlap of a set of n with any set it links to."""
    return -(-PERCENT * n // 100)


def signature_of(h: np.ndarray) -> str:
    """Names a set of shingles: equal sets, one class."""
    return f"{int(mixed(h).sum()) & 0xFFFFFFFFFFFFFFFF:016x}{int(mixed(h + np.uint64(99)).sum()) & 0xFFFFFFFFFFFFFFFF:016x}"


CLASSES = "doc_id long,n long,signature string,shared binary,prefix binary,point binary"


def sift(row, got: pd.DataFrame) -> pd.DataFrame:
    """Every document of a batch; for those that may link, their signature, shingles and keys."""
    ids, lengths, _ = opened(row)
    keys, _, doc, h = _batch_keys(row)
    level = answers_for(keys, got)
    n = np.bincount(doc, minlength=len(ids))
    ends = np.cumsum(n)
    lv = level[np.searchsorted(keys, h)] if len(h) else np.zeros(0, np.uint8)
    alone = np.bincount(doc[lv == 0], minlength=len(ids))
    out = []
    for i, (doc_id, size) in enumerate(zip(ids.tolist(), n.tolist(), strict=True)):
        room = size - needed(size)
        if not size:
            out.append((doc_id, size, None, None, None, None))
            continue
        s = slice(ends[i] - size, ends[i])
        hs, ls = h[s], lv[s]
        signature = signature_of(hs)
        if alone[i] > room:  # equal sets aside, it can't link
            out.append((doc_id, size, signature, None, None, None))
            continue
        shared = hs[ls > 0]
        order = np.lexsort((shared, ls[ls > 0]))
        prefix = shared[order[: room + 1 - int(alone[i])]]
        point = np.minimum(np.bincount((hs & np.uint64(GROUPS - 1)).astype(np.int64), minlength=GROUPS), TOP).astype(np.uint8)
        out.append((doc_id, size, signature, shared.tobytes(), prefix.tobytes(), point.tobytes()))
    return pd.DataFrame(out, columns=[x.split()[0] for x in CLASSES.split(",")])


def links_enough(overlap, n, m):
    return 100 * overlap >= PERCENT * (n + m - overlap)


def bound_ok(p: np.ndarray, n: np.ndarray, q: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Whether the summed coordinate minima allow a link. Counts at the type's limit bound nothing."""
    least = np.minimum(p, q).astype(np.int64).sum(-1)
    top = np.where((p == TOP).any(-1) & (q == TOP).any(-1), np.minimum(n, m), least)
    return links_enough(np.minimum(top, np.minimum(n, m)), n, m)


class CountTree:
    """R-tree over count vectors: points sorted by size, then by group counts; LEAF to a box, boxes in levels.

    Bounds of all boxes of a level are taken in one array step; only boxes that may hold a link are opened."""

    def __init__(self, points: np.ndarray, n: np.ndarray):
        self.order = np.lexsort((*points.T[:4], n))
        self.points, self.n = points[self.order], n[self.order]
        self.levels = []
        high, low, most = self.points, self.n, self.n
        while len(high) > 1:
            at = np.arange(0, len(high), LEAF)
            high, low, most = np.maximum.reduceat(high, at), np.minimum.reduceat(low, at), np.maximum.reduceat(most, at)
            self.levels.append((high, low, most))

    def query(self, point: np.ndarray, size: int) -> np.ndarray:
        """Places of the points that may link with this one."""
        where = np.zeros(1, np.int64)
        for depth in range(len(self.levels) - 1, -1, -1):
            high, low, most = self.levels[depth]
            where = where[where < len(high)]
            h, lo, hi = high[where], low[where], most[where]
            top = np.minimum(np.minimum(h, point).astype(np.int64).sum(-1), np.minimum(hi, size))
            top = np.where((h == TOP).any(-1), np.minimum(hi, size), top)
            ok = (100 * top >= PERCENT * np.maximum(size + lo - top, size)) & (100 * hi >= PERCENT * size) & (PERCENT * lo <= 100 * size)
            where = (where[ok][:, None] * LEAF + np.arange(LEAF)).ravel()
        where = where[where < len(self.n)]
        return self.order[where[bound_ok(self.points[where], self.n[where], point, np.full(len(where), size))]]

    def closeness(self, places: np.ndarray, point: np.ndarray, size: int) -> np.ndarray:
        """The bound on the similarity of the points at `places` (as given to the tree)."""
        back = np.empty(len(self.order), np.int64)
        back[self.order] = np.arange(len(self.order))
        at = back[places]
        top = np.minimum(self.points[at], point).astype(np.int64).sum(-1)
        return top / (self.n[at] + size - top)


def _verify(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Of pairs(a, b) those that link. Pairs whose points' bound is below the needed overlap aren't compared. The set of a
    goes to each pair once; pairs meet b's set in a sorted stream."""
    left = pairs.join(sets.select(F.col("id").alias("a"), F.col("n").alias("an"), F.col("shared").alias("as_"), F.col("point").alias("ap")), "a")
    both = left.join(sets.select(F.col("id").alias("b"), F.col("n").alias("bn"), F.col("shared").alias("bs"), F.col("point").alias("bp")), "b")

    def check(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if f.empty:
                continue
            points = (np.frombuffer(b"".join(f[c]), np.uint8).reshape(len(f), GROUPS) for c in ("ap", "bp"))
            f = f[bound_ok(next(points), f.an.to_numpy(), next(points), f.bn.to_numpy())]
            last, other = None, None
            keep = []
            for b, an, x, bn, y in zip(f.b, f.an, f.as_, f.bn, f.bs, strict=True):
                if b != last:
                    last, other = b, np.frombuffer(y, np.uint64)
                mine = np.frombuffer(x, np.uint64)
                at = np.searchsorted(other, mine)
                at[at == len(other)] = 0
                keep.append(bool(len(other)) and links_enough(int((other[at] == mine).sum()), an, bn))
            yield f.loc[keep, ["a", "b"]]

    return both.select("a", "b", "an", "as_", "ap", "bn", "bs", "bp").mapInPandas(check, "a long,b long")


def classes(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, n, signature of every document with an id), (id, n, shared, prefix, point of each class)."""
    spark = docs.sparkSession
    table = batches(docs)
    answers = cut(ask(table, asked_keys, even_edges(buckets_for(table, 0.2))), "answers")
    release(spark)
    sifted = cut(by_batch(table, answers, sift, CLASSES), "sifted")
    discard(table, answers)
    release(spark)
    every = cut(sifted.select("doc_id", "n", "signature"), "every")
    may = sifted.where("prefix IS NOT NULL")
    ids = may.groupBy("signature").agg(F.min("doc_id").alias("id"))
    # A doc_id may be repeated with other text, so a class is found by signature and id.
    reps = may.join(ids.withColumnRenamed("signature", "of"), (F.col("signature") == F.col("of")) & (F.col("doc_id") == F.col("id")))
    reps = reps.groupBy("signature").agg(*[F.first(c).alias(c) for c in ("id", "n", "shared", "prefix", "point")])
    reps = cut(reps.withColumn("class", F.xxhash64("signature")), "classes")
    discard(sifted)
    return every, reps


def links(reps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(a, b) class links that connect all classes which links connect, and the labels (id, label)."""
    sets = reps.select(F.col("class").alias("id"), "n", "shared", "prefix", "point")

    def spread(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            keys = [np.frombuffer(p, np.uint64).view(np.int64) for p in f.prefix]
            sizes = [len(k) for k in keys]
            yield pd.DataFrame({"key": np.concatenate(keys) if keys else [], "id": np.repeat(f.id.to_numpy(), sizes), "n": np.repeat(f.n.to_numpy(), sizes)})

    keys = sets.select("id", "n", "prefix").mapInPandas(spread, "key long,id long,n long")
    heads = keys.groupBy("key").agg(F.min("id").alias("b"), F.count("*").alias("c")).where("c > 1").drop("c")
    keys = cut(keys.join(heads.select("key", "b"), "key").select("key", "id", "b"), "keys")
    votes = keys.where("id <> b").groupBy("id", "b").agg(F.count("*").alias("c"))
    picks = votes.groupBy("id").agg(F.min("b").alias("least"), F.max_by("b", F.struct(F.col("c"), (-F.col("b")).alias("m"))).alias("most"))
    star = picks.select(F.col("id").alias("a"), F.explode(F.array_distinct(F.array("least", "most"))).alias("b"))
    found = cut(_verify(star, sets), "star")
    label = components(sets.select("id"), found)
    placed = keys.join(label, "id").select("key", "label").distinct()
    spans = placed.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("key", "lo")
    near = cut(placed.join(spans, "key").where("label <> lo").select(F.col("label").alias("a"), F.col("lo").alias("b")).distinct(), "near")
    discard(keys)
    area = components(near.select(F.col("a").alias("id")).unionByName(near.select(F.col("b").alias("id"))), near).withColumnsRenamed({"id": "of", "label": "area"})
    members = cut(label.join(area, F.col("label") == F.col("of")).select("id", "area").join(sets.select("id", "n", "point"), "id"), "members")
    discard(near)
    for best in (BEST, None):
        pairs = cut(_search(members, label, best), "pairs")
        more = cut(_verify(pairs, sets), "more")
        discard(pairs)
        found = found.unionByName(more)
        label = _merged(label, more)
    discard(members)
    return found, label


def _merged(label: DataFrame, more: DataFrame) -> DataFrame:
    """Labels (id, label) after links (a, b) are added."""
    la, lb = (label.select(F.col("id").alias(x), F.col("label").alias("l" + x)) for x in "ab")
    between = more.join(la, "a").join(lb, "b").select(F.col("la").alias("a"), F.col("lb").alias("b")).where("a <> b").distinct()
    roots = components(label.select(F.col("label").alias("id")), between).withColumnsRenamed({"id": "l", "label": "root"})
    return cut(label.join(roots, F.col("label") == F.col("l")).select("id", F.col("root").alias("label")), "labels")


def _search(members: DataFrame, label: DataFrame, best: int | None) -> DataFrame:
    """Distinct pairs (a, b) of classes of one area, in different components, whose bound allows a link: for each class
    the `best` closest of each block, or all."""
    rows = members.join(label, "id")
    counts = rows.groupBy("area", "label").agg(F.count("*").alias("c"))
    areas = counts.groupBy("area").agg(F.max_by("label", F.struct("c", "label")).alias("main"), F.least(F.ceil(F.sum("c") / BLOCK), F.greatest(F.lit(MANY), F.ceil(F.sum("c") / WIDE))).cast("int").alias("blocks"), F.count("*").alias("k")).where("k > 1").drop("k")
    rows = rows.join(areas, "area").withColumn("block", F.pmod(F.xxhash64("id", "area"), "blocks").cast("int"))
    # Block pairs (i, j), i <= j: a block is in as many as there are blocks.
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("area", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "id", "label", "n", "point", (F.col("label") != F.col("main")).alias("asks"))

    def search(f: pd.DataFrame) -> pd.DataFrame:
        i, j = f.i.iloc[0], f.j.iloc[0]
        out = set()
        for mine, theirs in [(i, j)] if i == j else [(i, j), (j, i)]:
            those, ask = f[f.block == theirs], f[(f.block == mine) & f.asks]
            if those.empty or ask.empty:
                continue
            ids, labels = those.id.to_numpy(), those.label.to_numpy()
            tree = CountTree(np.stack([np.frombuffer(p, np.uint8) for p in those.point]), those.n.to_numpy())
            for k, of, size, p in zip(ask.id.tolist(), ask.label.tolist(), ask.n.tolist(), ask.point, strict=True):
                point = np.frombuffer(p, np.uint8)
                got = tree.query(point, size)
                got = got[labels[got] != of]
                if best and len(got) > best:
                    got = got[np.argsort(-tree.closeness(got, point, size), kind="stable")[:best]]
                out.update((min(k, x), max(k, x)) for x in ids[got].tolist())
        return pd.DataFrame(sorted(out), columns=["a", "b"], dtype="int64")

    # Without this, the deal by area would be used again, and all block pairs of a neighbourhood would be one task's.
    rows = rows.repartition("area", "i", "j")
    return rows.groupBy("area", "i", "j").applyInPandas(search, "a long,b long").distinct()


def _placed(docs: DataFrame) -> DataFrame:
    """doc_id, n, signature and component of every row with an id; the last two null where nothing can be linked."""
    every, reps = classes(docs)
    _, label = links(reps)
    named = cut(reps.select(F.col("signature").alias("of"), F.col("class").alias("id")), "named")
    discard(reps)
    first = every.where("signature IS NOT NULL").groupBy("signature").agg(F.min("doc_id").alias("first"))
    root = named.join(label, "id").select("of", "label")
    placed = first.join(root, F.col("signature") == F.col("of"), "left").select("signature", "first", "label")
    least = placed.where("label IS NOT NULL").groupBy("label").agg(F.min("first").alias("least")).withColumnRenamed("label", "l")
    component = placed.join(least, F.col("label") == F.col("l"), "left").select("signature", F.coalesce("least", "first").alias("component"))
    return every.join(component, "signature", "left").select("doc_id", "n", "signature", "component")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id of every row; the last is null where doc_id is."""

    def start():
        def rows(ids, strings):
            data = [s.encode("utf-8", "replace") for s in strings]
            doc, _ = shingles(np.array([len(b) for b in data], np.int64), b"".join(data))
            return {"doc_id": ids, "n_shingles": np.bincount(doc, minlength=len(ids)), "component_id": [None] * len(ids)}

        return rows

    # A row belongs to its text's component: a doc_id that two texts share doesn't join their components.
    named = _placed(docs).select("doc_id", F.col("n").alias("n_shingles"), F.least(F.coalesce("component", "doc_id"), "doc_id").alias("component_id"))
    return named.unionByName(map_texts(docs.where("doc_id IS NULL"), start, "doc_id long,n_shingles long,component_id long"))


@F.pandas_udf(StringType())
def _signatures(texts: pd.Series) -> pd.Series:
    out = []
    for t in texts:
        body = (t or "").encode("utf-8", "replace")
        _, h = shingles(np.array([len(body)]), body)
        out.append(signature_of(h) if len(h) else None)
    return pd.Series(out, dtype=object)


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows whose component has no smaller doc_id; of several of one doc_id and component, that with the least text.
    Rows of a repeated doc_id are told apart by their signature, which is computed again for these only. Rows without
    doc_id stay."""
    found = cut(_placed(docs), "placed")
    repeated = cut(found.groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias("again")), "repeated")
    gone = found.where("component < doc_id").select(F.col("doc_id").alias("gone")).distinct()
    whole = docs.select(F.col("doc_id").alias("k"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("r"))
    if not repeated.limit(1).count():
        return whole.join(gone, F.col("k") == F.col("gone"), "left_anti").select("r.*")
    aside = gone.unionByName(repeated.select(F.col("again").alias("gone"))).distinct()
    single = whole.join(aside, F.col("k") == F.col("gone"), "left_anti").select("r")
    kinds = found.join(repeated, found.doc_id == repeated.again).where("signature IS NOT NULL").select(F.col("doc_id").alias("id"), F.col("signature").alias("of"), "component").distinct()
    rows = whole.join(repeated, F.col("k") == F.col("again"), "left_semi").withColumn("signature", _signatures("r.text"))
    rows = rows.join(kinds, (F.col("k") == F.col("id")) & (F.col("signature") == F.col("of")), "left")
    rows = rows.where("component IS NULL OR component = k")
    rows = rows.withColumn("place", F.row_number().over(Window.partitionBy("k", "component").orderBy("r.text")))
    return single.unionByName(rows.where("component IS NULL OR place = 1").select("r")).select("r.*")
