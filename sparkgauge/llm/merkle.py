"""A Merkle manifest of a table: rows are leaves, each source has a tree of ARITY-fold runs, and the sources' roots have a tree.

Leaves get their places by range (ranks.py), a source's in order of doc_id. A tree is built by events: a node that arrives joins
its parent's partial list of indexed child digests; when the list has the arity that the tree's size gives for that parent (a
last run may be short), the parent is resolved and is an event itself, in the same task. Tasks first combine what they hold, as
on the map side of a combineByKey: leaves lie in ranges, so nearly all parents resolve there and only the two ends of each range
are left. This unresolved frontier alone is reshuffled, by its ancestor BAND levels up, and combined again, until each tree has one
node. Every resolved parent is written with its children's digests: the reverse links from which proofs are made.

Proofs go down the same bands: a block is the subtree below one node BAND levels up, at most ARITY ** BAND leaves, however
large the source. A block gets its top node's path, adds its own links, and hands each of its bottom nodes a path; the lowest
blocks hand them to their leaves, which fold their (claimed) digests up to the root. No block depends on another one of its band.

Null values: `-` in the leaf. Null source: a tree of its own, the first. Null doc_id: before all others, and `audit` changes
nothing there. Repeated rows: a leaf each; leaves with one doc_id go by digest. Empty and long texts: whole, hashed in the
JVM. Empty table: no rows, root None. Columns other than FIELDS are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..ranks import row_numbers
from .common import cut, discard

ARITY, BAND = 3, 6
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
ENDS = "tree string, level int, idx long, path binary, subroot binary"
NODES = "tree string, n long, level int, idx long, digest binary, children binary"
#: Rows of an Arrow batch that a combining task gives out.
ROWS = 4096


def leaf_digest(values: list[Column]) -> Column:
    """SHA-256 of the values, each `-` if null, else its UTF-8 byte count, a colon and itself."""
    told = [F.when(v.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(v.cast("string")).cast("string"), F.lit(":"), v.cast("string"))) for v in values]
    return F.unhex(F.sha2(F.concat(*told), 256))


def parent_digest(children: list[bytes]) -> bytes:
    return hashlib.sha256("".join(c.hex() for c in children).encode()).digest()


def height(n: int) -> int:
    h = 0
    while n > 1:
        n, h = -(-n // ARITY), h + 1
    return h


def level_size(n: int, level: int) -> int:
    return -(-n // ARITY**level)


class Combiner:
    """Partial parents of any number of trees, and what was resolved."""

    def __init__(self) -> None:
        self.partial: dict[tuple[str, int, int, int], dict[int, bytes]] = {}
        self.resolved: list[tuple] = []

    def event(self, tree: str, n: int, level: int, idx: int, digest: bytes) -> None:
        """A node's digest is known; so may its ancestors' then be."""
        while True:
            size = level_size(n, level)
            if size == 1:
                self.resolved.append((tree, n, level, idx, digest, None))  # a root has no parent to wait for
                return
            parent = idx // ARITY
            key = (tree, n, level + 1, parent)
            held = self.partial.setdefault(key, {})
            held[idx] = digest
            if len(held) < min(ARITY, size - ARITY * parent):
                return
            children = [held[i] for i in sorted(held)]
            del self.partial[key]
            level, idx, digest = level + 1, parent, parent_digest(children)
            self.resolved.append((tree, n, level, idx, digest, b"".join(children)))

    def frontier(self) -> Iterator[tuple]:
        """The nodes whose parents lack other children, as events for the next round."""
        for (tree, n, level, _), held in self.partial.items():
            for idx, digest in held.items():
                yield tree, n, level - 1, idx, digest, None


def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes (tree, n, level, idx, digest) to resolved parents (with children) and, without children, roots and the frontier."""
    kinds = pa.schema([("tree", pa.string()), ("n", pa.int64()), ("level", pa.int32()), ("idx", pa.int64()), ("digest", pa.binary()), ("children", pa.binary())])

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), kinds, strict=True)], schema=kinds)

    c = Combiner()
    for batch in batches:
        for node in zip(*[batch.column(i).to_pylist() for i in range(5)], strict=True):
            c.event(*node)
            if len(c.resolved) >= ROWS:
                yield batch_of(c.resolved)
                c.resolved.clear()
    c.resolved += c.frontier()
    for i in range(0, len(c.resolved), ROWS):
        yield batch_of(c.resolved[i : i + ROWS])


def _up(levels: Column) -> Column:
    """ARITY ** levels (at least 0), in whole numbers."""
    powers = F.array(*[F.lit(ARITY**k) for k in range(40)])
    return F.get(powers, F.greatest(levels, F.lit(0)))


def _above(level: int) -> Column:
    """The place of a node's ancestor at that level; its own place if it is as high. Places stay under 2 ** 53."""
    return F.floor(F.col("idx") / _up(F.lit(level) - F.col("level"))).cast("long")


@dataclass
class Trees:
    """links: the resolved parents with their children's digests. roots: tree, n, digest. tall: levels of the highest tree."""

    links: DataFrame
    roots: DataFrame
    tall: int


@dataclass
class Manifest:
    """The trees of the sources, their roots in order (of, idx, digest), the tree of these, and its root."""

    own: Trees
    subroots: DataFrame
    whole: Trees
    root: bytes


def grow(leaves: DataFrame, most: int) -> Trees:
    """The trees of leaves (tree, n, idx, digest), n being the tree's number of leaves and `most` the largest n."""
    tall, at = height(most), 0
    nodes = leaves.select("tree", "n", F.lit(0).alias("level"), "idx", "digest")
    written = [cut(nodes.mapInArrow(combine, NODES), "nodes")]
    while at < tall:
        at += BAND
        frontier = written[-1].where(F.col("children").isNull() & ~_is_root()).select("tree", "n", "level", "idx", "digest")
        written.append(cut(frontier.repartition("tree", _above(at)).mapInArrow(combine, NODES), "nodes"))
    every = written[0]
    for w in written[1:]:
        every = every.unionByName(w)
    links = every.where(F.col("children").isNotNull()).select("tree", "level", "idx", "children")
    return Trees(links, every.where(F.col("children").isNull() & _is_root()).select("tree", "n", "digest"), tall)


def _is_root() -> Column:
    return F.ceil(F.col("n") / _up(F.col("level"))) == 1


def _steps(links: dict[tuple[int, int], bytes], path_of: dict[tuple[int, int], bytes]) -> dict[tuple[int, int], bytes]:
    """Follow reverse links down from the nodes whose paths are known. A path is, from the node up, for each run: the node's
    place in it, how many others it has, and their digests."""
    for level, idx in sorted(links, reverse=True):
        children = [links[level, idx][i : i + 32] for i in range(0, len(links[level, idx]), 32)]
        rest = path_of.pop((level, idx))
        for k in range(len(children)):
            others = children[:k] + children[k + 1 :]
            path_of[level - 1, ARITY * idx + k] = bytes((k, len(others))) + b"".join(others) + rest
    return path_of


def fold(digest: bytes, path: bytes) -> tuple[bytes, str]:
    """The root that a leaf's digest leads to along a path, and the SHA-256 of the path's siblings."""
    at, proof = 0, hashlib.sha256()
    while at < len(path):
        k, n = path[at], path[at + 1]
        others = [path[at + 2 + 32 * i : at + 34 + 32 * i] for i in range(n)]
        proof.update("".join(o.hex() for o in others).encode())
        digest = parent_digest([*others[:k], digest, *others[k:]])
        at += 2 + 32 * n
    return digest, proof.hexdigest()


def _descend(trees: Trees, starts: DataFrame) -> DataFrame:
    """The rows that the lowest blocks need: their links and their top node's path (tree, block, level, idx, children,
    path, subroot). starts: tree, n, path (of the root), subroot."""
    bands = max(1, -(-trees.tall // BAND))
    h = F.lit(0)
    for k in range(trees.tall):
        h = h + (F.col("n") > ARITY**k).cast("int")
    tops = starts.select("tree", h.alias("level"), F.lit(0).cast("long").alias("idx"), F.lit(None).cast("binary").alias("children"), "path", "subroot")
    links = trees.links.select("*", F.lit(None).cast("binary").alias("path"), F.lit(None).cast("binary").alias("subroot"))
    handed = None
    for band in reversed(range(bands)):
        top_band = F.greatest(F.floor((F.col("level") - 1) / BAND), F.lit(0))
        rows = links.where(F.floor((F.col("level") - 1) / BAND) == band).unionByName(tops.where(top_band == band))
        if handed is not None:
            rows = rows.unionByName(handed)
        rows = rows.withColumn("block", _above(BAND * (band + 1)))
        if not band:
            return rows
        down = rows.groupBy("tree", "block").applyInArrow(_hand_down, ENDS)
        handed = cut(down, "paths").select("tree", "level", "idx", F.lit(None).cast("binary").alias("children"), "path", "subroot")
    raise AssertionError


def _paths(rows: pa.Table) -> tuple[dict[tuple[int, int], bytes], bytes]:
    links, path_of, subroot = {}, {}, b""
    for level, idx, children, path, root in zip(*[rows.column(c).to_pylist() for c in ("level", "idx", "children", "path", "subroot")], strict=True):
        if children is not None:
            links[level, idx] = children
        else:
            path_of[level, idx], subroot = path, root
    return _steps(links, path_of), subroot


def _hand_down(rows: pa.Table) -> pa.Table:
    path_of, subroot = _paths(rows)
    tree = rows.column("tree")[0].as_py()
    ends = [(tree, level, idx, path, subroot) for (level, idx), path in path_of.items()]
    kinds = pa.schema([("tree", pa.string()), ("level", pa.int32()), ("idx", pa.int64()), ("path", pa.binary()), ("subroot", pa.binary())])
    return pa.table([pa.array(c, f.type) for c, f in zip(zip(*ends, strict=True), kinds, strict=True)], schema=kinds)


RESULT = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean, place long"


def _fold_block(root: bytes):
    def run(leaves: pa.Table, rows: pa.Table) -> pa.Table:
        path_of, subroot = _paths(rows)
        out = []
        for doc_id, idx, leaf, claimed in zip(*[leaves.column(c).to_pylist() for c in ("doc_id", "idx", "digest", "claimed")], strict=True):
            folded, proof = fold(claimed, path_of[0, idx])
            out.append((doc_id, leaf.hex(), subroot.hex(), root.hex(), proof, folded.hex(), folded == root, idx))
        kinds = [pa.int64(), *[pa.string()] * 5, pa.bool_(), pa.int64()]
        names = [x.split()[0] for x in RESULT.split(", ")]
        return pa.table([pa.array(c, k) for c, k in zip(zip(*out, strict=True) if out else [[]] * len(names), kinds, strict=True)], names=names)

    return run


def place_leaves(docs: DataFrame, claims: dict[str, Column] | None = None) -> DataFrame:
    """tree, n, idx, doc_id, digest, claimed of each row; claimed is the digest with some columns replaced by `claims`. Written."""
    values = {c: F.col(c) for c in FIELDS}
    leaf, claimed = leaf_digest(list(values.values())), leaf_digest(list((values | (claims or {})).values())) if claims else None
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.concat(F.lit(":"), F.col("source").cast("string")), F.lit("-")).alias("tree"), leaf.alias("digest"), *([claimed.alias("claimed")] if claims else []))
    rows = cut(rows if claims else rows.withColumn("claimed", F.col("digest")), "leaves")
    order = [F.col("doc_id").asc_nulls_first(), F.col("digest"), F.col("claimed")]
    placed = cut(row_numbers(rows, order, ["tree"], "idx", total="n"), "placed")
    discard(rows)
    return placed


def manifest(placed: DataFrame) -> Manifest | None:
    """The manifest of placed leaves; None where there are none."""
    most = placed.agg(F.max("n")).first()[0]
    if not most:
        return None
    own = grow(placed.select("tree", "n", "idx", "digest"), most)
    roots = own.roots.select(F.col("tree").alias("of"), "digest", F.lit("").alias("tree"))
    subroots = cut(row_numbers(roots, ["of"], ["tree"], "idx", total="n"), "subroots")
    whole = grow(subroots.select("tree", "n", "idx", "digest"), subroots.count())
    return Manifest(own, subroots, whole, bytes(whole.roots.first()["digest"]))


def audit(docs: DataFrame, claims: dict[str, Column] | None = None) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified, place: each row's claimed values (columns replaced by
    `claims`) are folded with the sibling digests of the manifest of docs and compared with its root."""
    placed = place_leaves(docs, claims)
    m = manifest(placed)
    if m is None:
        return docs.sparkSession.createDataFrame([], RESULT)
    start = m.whole.roots.select("tree", "n", F.lit(b"").alias("path"), F.lit(None).cast("binary").alias("subroot"))
    ends = _descend(m.whole, start).groupBy("tree", "block").applyInArrow(_hand_down, ENDS)
    paths = ends.select(F.col("idx").alias("at"), "path").join(m.subroots.select("of", "idx", F.col("digest").alias("subroot")), F.col("idx") == F.col("at"))
    starts = cut(paths.join(m.own.roots, F.col("of") == F.col("tree")).select("tree", "n", "path", "subroot"), "starts")
    leaves = placed.withColumn("block", F.floor(F.col("idx") / ARITY**BAND).cast("long"))
    return leaves.groupBy("tree", "block").cogroup(_descend(m.own, starts).groupBy("tree", "block")).applyInArrow(_fold_block(m.root), RESULT)


def audit_line_breaks(docs: DataFrame) -> DataFrame:
    """`audit` where rows whose doc_id has an even CRC-32 claim a text without its line breaks."""
    even = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    return audit(docs, {"text": F.when(even, F.translate("text", "\n", "")).otherwise(F.col("text"))})


def _sql() -> str:
    """The DuckDB twin of `audit_line_breaks`."""
    told = lambda *cols: " || ".join(f"CASE WHEN {c} IS NULL THEN '-' ELSE octet_length(encode({c}::VARCHAR)) || ':' || {c} END" for c in cols)
    grow = lambda name, leaves: f"""{name} AS (SELECT tree, 0 AS level, idx, n, digest FROM {leaves} UNION ALL
  SELECT tree, level + 1, idx // {ARITY}, (n + {ARITY - 1}) // {ARITY}, sha256(string_agg(digest, '' ORDER BY idx)) FROM {name} WHERE n > 1 GROUP BY tree, level, idx // {ARITY}, n)"""  # noqa: E731
    sides = lambda name, nodes: f"""{name} AS (SELECT a.tree, a.level, a.idx, coalesce(string_agg(b.digest, '' ORDER BY b.idx) FILTER (b.idx < a.idx), '') AS ahead,
  coalesce(string_agg(b.digest, '' ORDER BY b.idx) FILTER (b.idx > a.idx), '') AS after FROM {nodes} a LEFT JOIN {nodes} b ON a.tree = b.tree AND a.level = b.level AND a.idx // {ARITY} = b.idx // {ARITY} WHERE a.n > 1 GROUP BY a.tree, a.level, a.idx)"""  # noqa: E731
    return f"""
WITH RECURSIVE step AS (SELECT i, 0 AS k, i::BIGINT AS v FROM range(256) t(i) UNION ALL SELECT i, k + 1, xor(v >> 1, 3988292384::BIGINT * (v & 1)) FROM step WHERE k < 8),
tab AS (SELECT list(v ORDER BY i) AS tab FROM step WHERE k = 8),
c AS (SELECT row_number() OVER () AS k, *, xor(list_reduce(list_transform(range(1, length(doc_id::VARCHAR) + 1), lambda j: ascii(substr(doc_id::VARCHAR, j, 1))::BIGINT), lambda c, y: xor(c >> 8, tab[(xor(c, y) & 255) + 1]), 4294967295::BIGINT), 4294967295::BIGINT) % 2 = 0 AS even FROM documents, tab),
h AS (SELECT k, doc_id, coalesce(':' || source, '-') AS tree, sha256({told(*FIELDS)}) AS digest, sha256({told(*FIELDS[:-1], "(CASE WHEN even THEN replace(text, chr(10), '') ELSE text END)")}) AS claimed FROM c),
l AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, digest, claimed) - 1 AS idx, count(*) OVER (PARTITION BY tree) AS n FROM h),
{grow("own", "l")},
roots AS (SELECT tree AS of, digest, '' AS tree, row_number() OVER (ORDER BY tree) - 1 AS idx, count(*) OVER () AS n FROM own WHERE n = 1),
{grow("whole", "roots")},
{sides("beside", "own")},
{sides("above", "whole")},
up AS (SELECT k, tree, 0 AS level, idx, claimed AS digest, '' AS proof FROM l UNION ALL
  SELECT k, tree, level + 1, idx // {ARITY}, sha256(ahead || digest || after), proof || ahead || after FROM up JOIN beside USING (tree, level, idx)),
reached AS (SELECT up.k, roots.idx, up.digest, proof FROM up JOIN own USING (tree, level, idx) JOIN roots ON roots.of = up.tree WHERE own.n = 1),
top AS (SELECT k, 0 AS level, idx, digest, proof FROM reached UNION ALL
  SELECT k, level + 1, idx // {ARITY}, sha256(ahead || digest || after), proof || ahead || after FROM top JOIN above USING (level, idx)),
ends AS (SELECT k, top.digest, proof, whole.digest AS root FROM top JOIN whole USING (level, idx) WHERE whole.n = 1)
SELECT l.doc_id, l.digest AS leaf, roots.digest AS subroot, root, sha256(proof) AS proof_sha256, ends.digest AS folded_root, ends.digest = root AS verified, l.idx::BIGINT AS place
FROM l JOIN ends USING (k) JOIN roots ON roots.of = l.tree
"""


SQL = _sql()
