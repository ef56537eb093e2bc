"""Tables that grow by merges."""

import os

from sparkgauge import workspace
from sparkgauge.operators import families
from sparkgauge.workspace import Workspace

SCHEMA = "conversation_id string, turn int, role string, text string, ts string, model_used string, metadata_json string"


def turns(spark, ids, text, n=2):
    return spark.createDataFrame([(f"c{i}", k, "user", f"{text} {k}", None, text, None) for i in ids for k in range(n)], SCHEMA)


def files(ws):
    return {p: os.stat(p).st_mtime_ns for p in ws.root.glob("tables/turns/_bucket=*/part-*")}


def test_an_export_rewrites_only_the_buckets_it_touches(spark, tmp_path):
    ws = Workspace(spark, str(tmp_path))
    assert ws.ingest(turns(spark, range(300), "old"), "lines") == 300
    before = files(ws)
    assert len({p.parent for p in before}) > workspace.BUCKETS / 2
    assert ws.ingest(turns(spark, [7, 900], "new", 3), "list") == 2
    after = files(ws)
    assert len(before.keys() - after.keys()) <= 2 and all(after[p] == t for p, t in before.items() if p in after)
    rows = ws.table("turns")
    assert rows.columns == ["conversation_id", "turn", "role", "text", "ts"] and rows.count() == 299 * 2 + 2 * 3
    assert {r.text for r in rows.where("conversation_id = 'c7'").collect()} == {"new 0", "new 1", "new 2"}
    told = {r.conversation_id: (r.model_used, r.source_adapter) for r in ws.table("conversations").where("conversation_id IN ('c7', 'c8', 'c900')").collect()}
    assert told == {"c7": ("new", "list"), "c8": ("old", "lines"), "c900": ("new", "list")} and ws.table("conversations").count() == 301
    assert ws.ingest(turns(spark, [7, 900], "new", 3), "list") == 2 and ws.table("turns").count() == 299 * 2 + 2 * 3


def test_a_table_of_an_older_form_is_taken_over(spark, tmp_path):
    ws = Workspace(spark, str(tmp_path))
    ws.write("turns", turns(spark, range(5), "old").select("conversation_id", "turn", "role", "text"))
    ws.ingest(turns(spark, [1], "new", 1), "lines")
    assert ws.table("turns").count() == 9 and ws.table("turns").where("ts IS NULL").count() == 9 and (tmp_path / "tables/turns").exists()


def test_first_rows_of_a_hot_group(spark):
    rows = spark.range(3000).selectExpr("if(id % 3 = 0, 'hot', concat('g', id % 50)) AS g", "id", "hash(id) AS w")
    got = {tuple(r) for r in families.first_rows(rows, ["g"], [rows.w, rows.id], 4, "id").collect()}
    want = {tuple(r) for r in rows.selectExpr("*", "row_number() OVER (PARTITION BY g ORDER BY w, id) AS n").where("n <= 4").drop("n").collect()}
    assert got == want
