"""The engine's own operators: SQL twins on the smallest tables, and small cases with known results."""

import json
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from sparkgauge.functions import text as T
from sparkgauge.operators import conversations, families, pricing, scoring, vectors
import sparkgauge.plans.flow  # noqa: F401  (registers its queries)
from sparkgauge.plans.oracles import ORACLES
from sparkgauge.plans.queries import QUERIES
from sparkgauge import replies
from sparkgauge.sources import exports, lock

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in ("documents", "conversations", "events", "embeddings", "labels"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(set(ORACLES) - {"benchmark_sample", "best_per_duplicate_group"}))
def test_query_equals_its_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    rel = duck.sql(ORACLES[name])
    assert sorted(df.columns) == sorted(rel.columns)
    cols = sorted(df.columns)
    key = lambda r: tuple((v is None, str(v)) for v in r)
    want = sorted((tuple(dict(zip(rel.columns, r))[c] for c in cols) for r in rel.fetchall()), key=key)
    assert sorted((tuple(r[c] for c in cols) for r in df.collect()), key=key) == want


def test_panel(spark):
    rows = [(1, "a", 8.0, True), (1, "b", 6.0, True), (1, "c", 5.0, False), (2, "a", 5.0, False), (3, "a", 4.0, True), (3, "b", 8.0, True)]
    df = spark.createDataFrame(rows, "task long, judge string, score double, ok boolean")
    got = {r.task: (r.consensus, r.spread) for r in scoring.panel(df, "task").collect()}
    assert got == {1: (7.0, 2.0), 2: (5.0, 0.0), 3: (6.0, 4.0)}
    assert {r.task: r.consensus for r in scoring.panel(df, "task", "median").collect()}[3] == 6.0


def test_weighted_score(spark):
    df = spark.createDataFrame([(10.0, 3, "Code"), (4.0, 1, "Writing")], "score double, weight int, category string")
    r = scoring.overall(df).first()
    assert (r.raw_score, r.weighted_score) == (7.0, 8.5)
    assert {x.category: x.score for x in scoring.per_category(df).collect()} == {"Code": 10.0, "Writing": 4.0}


def _greedy(rows, target, cap, tail):
    """The sampler's rules one row at a time."""
    best = {}
    for r in sorted(rows, key=_rank):
        best.setdefault(r["dup_group"], r)
    fam = {}
    for r in sorted(best.values(), key=_rank):
        fam.setdefault(r["family_id"], []).append(r)
    target = min(target, len(rows))
    taken, counts = [], dict.fromkeys(fam, 0)

    def take(f):
        if counts[f] < cap and counts[f] < len(fam[f]):
            taken.append(fam[f][counts[f]])
            counts[f] += 1
            return 1
        return 0

    for f in sorted(fam, key=lambda f: (-fam[f][0]["family_importance"], -fam[f][0]["family_size"], f)):
        if len(taken) < target and fam[f][0]["family_size"] >= 2:
            take(f)
    quota, n = (0 if target <= 1 else max(1, int(target * tail))), 0
    for f in sorted(fam, key=lambda f: (fam[f][0]["family_size"], -fam[f][0]["family_importance"], f)):
        if len(taken) < target and n < quota and fam[f][0]["family_size"] <= 2:
            n += take(f)
    static = dict(counts)
    for r in sorted(best.values(), key=lambda r: (static[r["family_id"]], -r["family_importance"], *_rank(r))):
        if len(taken) < target and r not in taken and counts[r["family_id"]] < cap:
            taken.append(r)
            counts[r["family_id"]] += 1
    return {r["doc_id"] for r in taken}


def _rank(r):
    import hashlib

    return ({"generalizable": 0, "one_off": 2}.get(r["specificity"], 1), 0 if r["difficulty"] in ("medium", "hard") else 1, -r["dup_size"], hashlib.sha256(f"42:{r['doc_id']}".encode()).hexdigest()[:16])


@pytest.mark.parametrize("seed", range(6))
def test_sample_equals_greedy_rules(spark, seed):
    rnd = random.Random(seed)
    rows = [{"doc_id": i, "family_id": f"f{rnd.choice('AAAABBCDEFGH')}", "specificity": rnd.choice(["narrow", "generalizable", "one_off"]), "difficulty": rnd.choice(["easy", "medium", "hard"]), "dup_group": rnd.randrange(30)} for i in range(40)]
    sizes, dups = {}, {}
    for r in rows:
        sizes[r["family_id"]] = sizes.get(r["family_id"], 0) + 1
        dups[r["dup_group"]] = dups.get(r["dup_group"], 0) + 1
    for r in rows:
        r |= {"family_size": sizes[r["family_id"]], "family_importance": round(sizes[r["family_id"]] / 40, 6), "dup_size": dups[r["dup_group"]]}
    df = spark.createDataFrame(rows, "doc_id long, family_id string, specificity string, difficulty string, dup_group long, family_size long, family_importance double, dup_size long")
    for target, cap in ((5, 2), (12, 3), (200, 5)):
        assert {r.doc_id for r in families.sample(df, "doc_id", target, cap).collect()} == _greedy(rows, target, cap, 0.2)


def test_components_long_chain(spark):
    nodes = spark.range(60).withColumnRenamed("id", "k")
    pairs = spark.createDataFrame([(i, i + 1) for i in range(39)] + [(50, 55)], "a long, b long")
    got = {r.k: r.root for r in vectors.components(nodes, pairs, "k").collect()}
    assert all(got[i] == 0 for i in range(40)) and got[55] == 50 and got[45] == 45


def test_components_shuffled_chain(spark):
    order = random.Random(3).sample(range(2000), 2000)
    pairs = spark.createDataFrame(list(zip(order, order[1:])), "a long, b long")
    got = [r.root for r in vectors.components(spark.range(2000).withColumnRenamed("id", "k"), pairs, "k").collect()]
    assert got == [0] * 2000


def test_exports(spark, tmp_path):
    tree = [{"id": "t1", "title": "x", "mapping": {"b": {"message": {"create_time": 2, "author": {"role": "assistant"}, "content": {"parts": ["two"]}}}, "a": {"message": {"create_time": 1, "author": {"role": "user"}, "content": {"parts": ["one", "more"]}}}, "s": {"message": {"create_time": 0, "author": {"role": "system"}, "content": {"parts": ["no"]}}}}}]
    lists = {"conversations": [{"uuid": "l1", "name": "n", "chat_messages": [{"sender": "human", "text": "hi", "created_at": "t"}, {"sender": "assistant", "text": " "}]}]}
    (tmp_path / "tree.json").write_text(json.dumps(tree))
    (tmp_path / "list.json").write_text(json.dumps(lists))
    (tmp_path / "lines.jsonl").write_text('\n{"turns": [{"role": "customer", "text": "q"}]}\n{"id": "j", "turns": []}\n')
    got = sorted((r.conversation_id, r.turn, r.role, r.text) for name in ("tree.json", "list.json", "lines.jsonl") for r in exports.read_export(spark, f"{tmp_path}/{name}").collect())
    assert got == [("jsonl-2", 0, "user", "q"), ("l1", 0, "user", "hi"), ("t1", 0, "user", "one\nmore"), ("t1", 1, "assistant", "two")]
    for bad in (str(tmp_path), f"{tmp_path}/none.json"):  # a folder without an export file, and nothing
        with pytest.raises(FileNotFoundError):
            exports.read_export(spark, bad)
    (tmp_path / "chat.json").write_text(json.dumps([7, {"mapping": {"a": {"message": {"author": {"role": "user"}, "content": {"parts": [" ask "]}}}}}]))
    rows = exports.conversations(exports.read_export(spark, str(tmp_path), "tree")).collect()
    assert len(rows) == 1 and rows[0].conversation_id.startswith("chatgpt-1-") and rows[0].turns[0].text == "ask"
    with pytest.raises(ValueError):
        list(exports.rows_of('[{"x": 1}]', None))


def test_upsert_keeps_the_last(spark):
    old = spark.createDataFrame([("a", "x"), ("b", "y")], "conversation_id string, v string")
    new = spark.createDataFrame([("b", "p", 0), ("b", "q", 1), ("c", "r", 2)], "conversation_id string, v string, pos int")
    got = {tuple(r) for r in conversations.upsert_conversations(old, new).collect()}
    assert got == {("a", "x"), ("b", "q"), ("c", "r")}


def test_lock_is_stable(spark, tmp_path):
    df = spark.createDataFrame([(2, "b"), (1, "a")], "doc_id long, prompt string")
    a, b = (lock.lock(df, "doc_id", {"seed": 1}, str(tmp_path)) for _ in range(2))
    assert a["hash"] == b["hash"] and (a["version"], b["version"]) == (1, 2)
    assert json.loads((tmp_path / "benchmark.json").read_text())["tasks"][0]["id"] == "task-0001"


def test_reply_repair():
    assert replies.parse_json_object('x {"a": [1, 2,],} y') == {"a": [1, 2]}
    assert replies.parse_json_object("```json\n[1]\n```") == {"checklists": [1]}
    assert replies.parse_json_object('{"a": 1\n "b": 2}') == {"a": 1, "b": 2}
    with pytest.raises(ValueError):
        replies.parse_json_object("")


def test_claims_first_wins(spark):
    rows = families.annotate(spark.createDataFrame([(1, "alpha one two"), (2, "beta one two")], "doc_id long, prompt string"), "prompt")
    claims = spark.createDataFrame([(0, "Merged", "Alpha tasks"), (1, "Other", "alpha tasks")], "pos int, family string, label string")
    got = {r.label_key: r.family for r in families.canonical_map(rows, "doc_id", claims).collect()}
    assert got == {"alpha tasks": "Merged", "beta tasks": "Beta tasks"}


def test_quotes_order(spark):
    cat = pricing.builtin_catalog(spark).unionByName(pricing.catalog_rows(spark.createDataFrame([("openai/gpt-5", "0.1", "0.2"), ("gpt-5", "x", "1")], "key string, input string, output string"), "config"))
    r = pricing.quotes(spark.createDataFrame([("openai", "gpt-5")], "provider string, model string"), cat).first()
    assert (r.price_source, r.matched, r.input_per_1k) == ("config", "openai/gpt-5", 0.1)


def test_small_text_functions(spark):
    df = spark.createDataFrame([("9", "NOTHING"), ("7.9", "yes"), (None, "x" * 200)], "s string, t string")
    got = df.select(T.parse_score(F.col("s")).alias("p"), T.keeps_yes_no(F.col("t")).alias("k"), T.preview(F.col("t")).alias("v")).collect()
    assert [r.p for r in got] == [9, 5, 5] and [r.k for r in got] == [False, True, True] and len(got[2].v) == 140


def test_classes_end_at_the_words_they_need(spark):
    """Difficulty and specificity as whole counts of words give them, without counting whole texts."""
    spaces = [" ", "  ", "\n", "\t\u00a0", "\u2003", "\x1c", "\x1f\x0b", "\u0085"]
    texts = [None, "", " ", "\n\n", "a\nb\nc", "one\r\ntwo"]
    texts += [s * lead + s.join(["w\u00e9-1"] * n) + s * trail for s in spaces for n in (1, 4, 5, 7, 8, 60, 61) for lead, trail in ((0, 0), (1, 1))]
    rows = spark.createDataFrame(list(enumerate(texts)), "k long, t string")
    t, n = F.col("t"), T.word_count(F.col("t"))
    hard = (n > 60) | (F.length(t) - F.length(F.replace(t, F.lit("\n"), F.lit(""))) >= 2)
    got = rows.select(T.difficulty(t).alias("d"), T.specificity(t).alias("s"), F.when(n < 8, "easy").when(hard, "hard").otherwise("medium").alias("dd"), F.when(n < 5, "one_off").otherwise("generalizable").alias("ss"))
    assert "split(" not in rows.select(T.difficulty(t), T.specificity(t))._jdf.queryExecution().toString()
    assert all(r.d == r.dd and r.s == r.ss for r in got.collect())
