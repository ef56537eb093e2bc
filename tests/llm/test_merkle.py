"""The Merkle manifest against a plain tree, in rounds of bands, and on awkward tables."""

import hashlib
import random
import zlib

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

pytest.importorskip("sparkgauge.llm")
from sparkgauge.llm import merkle  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, tree string, idx string, n int, level string, digest string, place int"


def table(spark, rows):
    """rows: (doc_id, source, text)."""
    return spark.createDataFrame([(i, t, None if (i or 0) % 3 else "en", s, None if t is None else len(t), "x", "y", 5, "z", "d", 1) for i, s, t in rows], SCHEMA)


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def told(values):
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def levels_of(leaves):
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([h("".join(levels[-1][i : i + 3])) for i in range(0, len(levels[-1]), 3)])
    return levels


def sides(levels, idx):
    out = []
    for level in levels[:-1]:
        first = idx // 3 * 3
        out.append((level[first:idx], level[idx + 1 : first + 3]))
        idx //= 3
    return out


def brute(rows):
    trees = {}
    for i, s, t in rows:
        values = [i, s, None if (i or 0) % 3 else "en", None if t is None else len(t), t]
        tampered = values[:4] + [t.replace("\n", "") if t is not None and i is not None and zlib.crc32(str(i).encode()) % 2 == 0 else t]
        trees.setdefault(s, []).append((-1 if i is None else i, told(values), told(tampered)))
    names = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    built = {s: levels_of([leaf for _, leaf, _ in sorted(trees[s])]) for s in names}
    whole = levels_of([built[s][-1][0] for s in names]) if names else None
    out = []
    for at, s in enumerate(names):
        for idx, (i, leaf, claimed) in enumerate(sorted(trees[s])):
            path = sides(built[s], idx) + sides(whole, at)
            folded = claimed
            for ahead, after in path:
                folded = h("".join([*ahead, folded, *after]))
            root = whole[-1][0]
            out.append((None if i < 0 else i, leaf, built[s][-1][0], root, h("".join("".join(a + b) for a, b in path)), folded, folded == root, idx))
    return sorted(out, key=str)


def got(spark, rows):
    return sorted((tuple(r) for r in merkle.audit_line_breaks(table(spark, rows)).collect()), key=str)


@pytest.mark.parametrize("band", [1, 2, 6])
def test_equals_a_plain_tree(spark, band, monkeypatch):
    monkeypatch.setattr(merkle, "BAND", band)
    rnd = random.Random(band)
    sizes = {None: 1, "": 2, "hot": 300, "é": 3, "z": 4, **{f"s{k}": rnd.randint(1, 40) for k in range(8)}}
    rows = [(i, s, f"{s}\nline {i}" if rnd.random() < 0.6 else "one line") for s, n in sizes.items() for i in rnd.sample(range(10_000), n)]
    rnd.shuffle(rows)
    want = brute(rows)
    assert got(spark, rows) == want
    assert {r[6] for r in want} == {True, False}


def test_awkward_tables(spark):
    for rows in (
        [],
        [(1, "a", "only")],
        [(1, None, None), (2, None, "")],
        [(None, "a", "x\ny"), (None, "a", "x"), (5, "a", "x\ny"), (5, "a", "x\ny"), (5, "a", "other\n")],
        [(i, "a", t) for i, t in enumerate(["", None, "\n", "é\n" * 3000, "b"])],
    ):
        assert got(spark, rows) == brute(rows)


def test_events_in_any_order_and_any_split_give_the_same_nodes():
    rnd = random.Random(2)
    leaves = [(f":{s}", n, 0, i, hashlib.sha256(f"{s}{i}".encode()).digest()) for s, n in enumerate([1, 2, 3, 4, 9, 10, 28, 100]) for i in range(n)]
    rnd.shuffle(leaves)
    whole = merkle.Combiner()
    for e in leaves:
        whole.event(*e)
    assert not whole.partial
    parts = [merkle.Combiner() for _ in range(5)]
    for k, e in enumerate(leaves):
        parts[k % 5].event(*e)
    last = merkle.Combiner()
    for p in parts:
        for *node, _ in p.frontier():
            last.event(*node)
    assert not last.partial
    assert sorted(r for p in [*parts, last] for r in p.resolved if r[5]) == sorted(r for r in whole.resolved if r[5])
    assert sorted(r[:5] for r in whole.resolved if r[5] is None) == sorted(r[:5] for p in [*parts, last] for r in p.resolved if r[5] is None)


def test_ranges_leave_only_their_ends_to_the_next_round():
    n = 3**9 + 5
    out = list(merkle.combine(iter([pa.record_batch([[":"] * 3000, [n] * 3000, [0] * 3000, list(range(7000, 10_000)), [b"x" * 32] * 3000], names=["tree", "n", "level", "idx", "digest"])])))
    rows = [r for b in out for r in b.to_pylist()]
    assert sum(r["children"] is None for r in rows) <= 2 * 2 * merkle.height(n)
    assert sum(r["children"] is not None for r in rows) > 1450


def test_fold_finds_a_changed_leaf():
    leaves = [hashlib.sha256(bytes([k])).digest() for k in range(11)]
    c = merkle.Combiner()
    for i, leaf in enumerate(leaves):
        c.event(":", 11, 0, i, leaf)
    links = {(r[2], r[3]): r[5] for r in c.resolved if r[5]}
    root = next(r[4] for r in c.resolved if r[5] is None)
    paths = merkle._steps(links, {(3, 0): b""})
    for i, leaf in enumerate(leaves):
        assert merkle.fold(leaf, paths[0, i])[0] == root
        assert merkle.fold(b"y" * 32, paths[0, i])[0] != root


def test_no_claims_verify(spark):
    out = merkle.audit(table(spark, [(i, f"s{i % 3}", "a\nb") for i in range(20)]))
    assert out.where(F.col("verified")).count() == 20
