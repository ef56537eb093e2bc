"""N-gram CRCs by combination against zlib, and the resampling against plain Python."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

pytest.importorskip("sparkgauge.llm")
from sparkgauge.llm import crc_ngrams, importance  # noqa: E402

SCHEMA = "doc_id long, text string, score double, rank string, weight int, n_words int, bucket int"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text):
    return [w.encode() for w in WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))]


def buckets_of(text, n=2, buckets=10_000):
    w = words_of(text)
    return [zlib.crc32(b" ".join(w[i : i + k])) % buckets for k in range(1, n + 1) for i in range(len(w) - k + 1)]


def table(spark, rows):
    return spark.createDataFrame([(i, t, 0.5, "r", 1, 2, 3) for i, t in rows], SCHEMA)


def brute(rows, target, percent=25, least=20):
    here, there = np.zeros(10_000, int), np.zeros(10_000, int)
    for counts, texts in ((here, [t for _, t in rows]), (there, target)):
        for t in texts:
            np.add.at(counts, np.array(buckets_of(t), int), 1)
    s_all, t_all = int(here.sum()), int(there.sum())
    gain = [math.floor(1000 * math.log((t + 1) * (s_all + 10_000) / ((s + 1) * (t_all + 10_000)))) for s, t in zip(here.tolist(), there.tolist(), strict=True)]
    out = []
    for i, t in rows:
        f = buckets_of(t)
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        u = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((u + 0.5) / 4294967296))), None, len(words_of(t))])
    may = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0, -r[2], -r[1], -r[5]))
    for k, r in enumerate(may[: percent * len(may) // 100]):
        r[4] = k + 1
    return sorted(map(tuple, out), key=str)


def got(spark, rows, target):
    t = spark.createDataFrame([(k, x) for k, x in enumerate(target)], "item_id long, text string")
    return sorted((tuple(r) for r in importance.scored(table(spark, rows), t).collect()), key=str)


@pytest.fixture(scope="module")
def pool():
    rnd = random.Random(1)
    return rnd, ["a", "bc", "É", "the", "x" * 64, "Y" * 65, "z" * 300, "Ab1", "-", "é_è", "İ", "K", "a\x00b", "7", "x\x7fy", "日本"]


def test_crcs_are_those_of_the_strings(pool):
    rnd, words = pool
    rows = ["", "abc", "abc", "w" * 70_000, "ab c " * 3000, *[" ".join(rnd.choices(words, k=rnd.randint(0, 40))) for _ in range(200)]]
    for piece in (5, 100, 1 << 20):
        for n in (1, 2, 3):
            column = importance.Texts(pa.array(["junk", *rows]).slice(1))
            out = [[] for _ in rows]
            low = importance._lower()[column.data]
            for row, crcs, _ in crc_ngrams.ngram_crcs(low, column.offsets, importance._word_bytes(), n, piece):
                for i, c in zip(row.tolist(), crcs.tolist(), strict=True):
                    out[i].append(c % 10_000)
            assert [sorted(x) for x in out] == [sorted(buckets_of(t, n)) for t in rows]


def test_shift_is_appending_zero_bytes():
    rnd = np.random.default_rng(0)
    for n in (0, 1, 2, 7, 255, 256, 4097, 1 << 20):
        left, right = rnd.bytes(11), rnd.bytes(n)
        crcs = crc_ngrams.combined(np.array([zlib.crc32(left)], np.uint32), np.array([zlib.crc32(right)], np.uint32), np.array([n]))
        assert crcs[0] == zlib.crc32(left + right)


def test_equals_plain_python(spark, pool):
    rnd, words = pool
    target = [" ".join(rnd.choices(words[:6], k=50)) for _ in range(6)] + [None, ""]
    rows = [(i, " ".join(rnd.choices(words if i % 3 else words[:6], k=rnd.choice([0, 3, 19, 20, 21, 60])))) for i in rnd.sample(range(5000), 300)]
    rows += [(rows[0][0], rows[1][1]), rows[2], rows[2], (None, rows[3][1]), (9000, None), (9001, ""), (9002, "the " * 30_000)]
    want = brute(rows, target)
    assert got(spark, rows, target) == want
    assert sum(r[4] is not None for r in want) == 25 * sum(r[5] >= 20 for r in want) // 100


def test_draws_what_looks_like_the_target(spark):
    rnd = random.Random(8)
    like, other = [f"w{k}" for k in range(40)], [f"v{k}" for k in range(40)]
    rows = [(i, " ".join(rnd.choices(like if i < 20 else other, k=40))) for i in range(80)]
    target = spark.createDataFrame([(1, " ".join(rnd.choices(like, k=4000)))], "item_id long, text string")
    docs = table(spark, rows)
    out = importance.resampled(docs, target, percent=20)
    assert out.columns == docs.columns and out.count() == 16
    assert out.where("doc_id < 20").count() >= 12


def test_empty_tables(spark):
    assert got(spark, [], ["a b c"]) == []
    assert got(spark, [(1, "word " * 30), (2, "")] * 2, []) == brute([(1, "word " * 30), (2, "")] * 2, [])
