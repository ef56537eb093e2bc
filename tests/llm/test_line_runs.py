"""Line dedup against brute force, in any order of batches, and on awkward tables."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

pytest.importorskip("sparkgauge.llm")
from sparkgauge.llm import line_runs  # noqa: E402

SCHEMA = "doc_id long, text string, n_chars int, place int, key string, batch int, last long"
UP = {ord(a): b for a, b in zip(line_runs.UPPER, line_runs.LOWER, strict=True)}


def table(spark, rows):
    return spark.createDataFrame([(i, t, len(t or ""), 7, "k", 3, 1) for i, t in rows], SCHEMA)


def key(line):
    return line.strip(line_runs.SPACE).translate(UP)


def brute(rows):
    """What `dedup` gives; rows of one id are one document."""
    holders = {}
    for i, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= 40:
                holders.setdefault(key(line), set()).add(-1 if i is None else i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(holders.get(key(x), ())) < 5 or max(holders[key(x)]) == (-1 if i is None else i)]
        out.append((i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest(), "\n".join(kept)))
    return out


def known(rows):
    return sorted(rows, key=str)


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(3)
    pool = ["".join(rnd.choice("abc ÉéKİı") for _ in range(rnd.choice([20, 39, 40, 41, 60]))) for _ in range(40)]
    out = []
    for i in range(120):
        lines = [rnd.choice([x, x.translate(UP), f" \t{x}\x0b\r", x + "\xa0"]) for x in rnd.choices(pool, k=rnd.randint(1, 8))] + ["x" * 50 + str(i)]
        out.append((i * 3, "\n".join(lines)))
    hot = "This line is in a third of all the documents, and twice in some."
    out += [(500 + i, f"{hot}\nown {i}\n{hot.upper()}") for i in range(60)]
    return out


def test_equals_brute_force(spark, rows):
    assert known(tuple(r) for r in line_runs.dedup(table(spark, rows)).collect()) == known(x[:4] for x in brute(rows))


def test_texts_keep_their_columns(spark, rows):
    docs = table(spark, rows + [(9000, None)])
    out = line_runs.deduplicated(docs)
    assert out.columns == docs.columns and out.schema["n_chars"].dataType == docs.schema["n_chars"].dataType
    assert known((r.doc_id, r.text, r.n_chars) for r in out.collect()) == known([(x[0], x[4], len(x[4])) for x in brute(rows)] + [(9000, None, 0)])


@pytest.mark.parametrize("order", ["up", "down", "mixed"])
def test_runs_agree_in_any_order_of_batches(spark, rows, order):
    lines = line_runs.line_keys(table(spark, rows)).cache()
    ids = sorted({i for i, _ in rows}, reverse=order == "down")
    if order == "mixed":
        random.Random(1).shuffle(ids)
    runs = line_runs.LineRuns(spark)
    for k in range(0, len(ids), 40):
        runs.add(lines.where(F.col("doc").isin(ids[k : k + 40])))
        levels = [level for level, _ in runs.runs]
        assert levels == sorted(set(levels), reverse=True)
    got = {(bytes(r.key), r.last) for r in runs.repeated().collect()}
    runs.close()
    want = lines.groupBy("key").agg(F.countDistinct("doc").alias("n"), F.max("doc").alias("last")).where("n >= 5")
    assert got == {(bytes(r.key), r.last) for r in want.collect()} and got


def test_a_settled_key_is_not_written_again(spark):
    line = "the same long line of words in every single document"
    docs = table(spark, [(i, line) for i in range(12)])
    lines = line_runs.line_keys(docs)
    runs = line_runs.LineRuns(spark)
    runs.add(lines.where("doc >= 6"))
    runs.add(lines.where("doc < 6"))
    assert [tuple(r)[1:] for r in runs.runs[0][1].collect()] == [(6, 11)]
    runs.add(lines.selectExpr("doc + 100 AS doc", "key"))  # larger ids do change it
    assert [tuple(r)[1:] for r in runs.repeated().select("key", "last").collect()] == [(111,)]
    runs.close()


def test_awkward_tables(spark):
    line = "a line of more than forty code points, said often"
    for rows in (
        [],
        [(None, line), (None, line), (1, line), (1, f"{line}\nx\n{line}"), (2, line), (3, line), (4, line)],
        [(1, line)] * 6,
        [(None, line)] * 6,
        [(i, t) for i, t in enumerate(["", None, "\n\n", " \n\t", line, line, line, line, line, f"{line}\n" * 3000, "é" * 40, "é" * 39])],
    ):
        docs = table(spark, rows)
        assert known(tuple(r) for r in line_runs.dedup(docs).collect()) == known(x[:4] for x in brute(rows))
        assert line_runs.deduplicated(docs).columns == docs.columns
