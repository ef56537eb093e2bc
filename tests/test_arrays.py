"""Array exports read by many tasks against the plain reader of whole files."""

import json
import random

import pytest

from sparkgauge.sources import arrays, exports


def awkward(rnd):
    return "".join(rnd.choice(['"', "\\", "{", "}", "[", "]", ",", ":", " ", "a", "é", "\n", "\\\\", '\\"', "\u2028", "😀"]) for _ in range(rnd.randint(0, 60)))


def tree(rnd, i):
    nodes = {str(k): {"message": {"create_time": rnd.random(), "author": {"role": rnd.choice(["user", "assistant", "system"])}, "content": {"parts": [awkward(rnd), f"m{k}"]}}} for k in range(rnd.randint(0, 5))}
    return {"id": rnd.choice([f"c{i}", f"c{i}", None, "same"]), "title": awkward(rnd), "mapping": nodes | {"x": {"message": None}}}


def flat(rnd, i):
    return {"uuid": f"u{i}", "name": awkward(rnd), "chat_messages": [{"sender": "human", "text": f"{awkward(rnd)} t{k}", "created_at": str(k)} for k in range(3)]}


def rows(frame):
    return sorted((tuple(r) for r in frame.collect()), key=str)


@pytest.mark.parametrize(("make", "indent", "chunk"), [(tree, None, 7), (tree, 1, arrays.CHUNK), (flat, None, 50)])
def test_equals_the_plain_reader(spark, tmp_path, monkeypatch, make, indent, chunk):
    rnd = random.Random(3)
    monkeypatch.setattr(arrays, "CHUNK", chunk)
    monkeypatch.setattr(arrays.records, "__defaults__", (chunk,))
    for k in range(2):
        text = json.dumps([make(rnd, i) for i in range(60)], indent=indent, ensure_ascii=bool(k))
        (tmp_path / f"part-{k}.json").write_text(("\ufeff" if k else "  \n") + text + "\n", encoding="utf-8")
    spark.conf.set("spark.sql.files.maxPartitionBytes", 2000)
    try:
        got = exports.read_arrays(spark, f"{tmp_path}/part-*")
        assert spark.read.text(f"{tmp_path}/part-0.json", lineSep="}").rdd.getNumPartitions() > 3
        assert rows(got) == rows(exports.read_files(spark, f"{tmp_path}/part-*"))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_scan_is_additive():
    rnd = random.Random(1)
    for _ in range(200):
        text = json.dumps([{awkward(rnd): awkward(rnd), "b": [awkward(rnd)]} for _ in range(3)])
        pieces = [p + "}" for p in text.split("}")]
        inside, depth = False, 0
        for p in pieces:
            inside, depth, _ = arrays.scan(p, inside, depth)
        assert (inside, depth) == (False, -1)  # the bracket that the last piece doesn't have


def test_odd_arrays(spark, tmp_path):
    good = {"id": "a", "mapping": {"1": {"message": {"content": "hi"}}}}
    for k, data in enumerate(([], [1, "x},", good, [good, 2], None, {"id": "b", "mapping": {}}, 3, {"mapping": good["mapping"]}], [good, {}])):
        file = tmp_path / f"odd{k}.json"
        file.write_text(json.dumps(data))
        got = rows(exports.read_export(spark, str(file), "tree"))
        assert [r[0] for r in got][:1] == (["a"] if data else []) and [r[0][:10] for r in got][1:] == (["chatgpt-7-"] if len(data) > 2 else []) and rows(exports.read_files(spark, str(file), "tree")) == got
    wrapped = tmp_path / "wrapped.json"
    wrapped.write_text(json.dumps({"conversations": [good]}))
    assert not arrays.is_array(spark, str(wrapped)) and [r[0] for r in rows(exports.read_export(spark, str(wrapped)))] == ["a"]
    (tmp_path / "broken.json").write_text('[{"id": "a", "mapping": {"1": }}]')
    with pytest.raises(Exception, match="JSONDecodeError"):
        exports.read_arrays(spark, str(tmp_path / "broken.json"), "tree").collect()


def test_the_first_form_that_fits_is_taken():
    assert exports.kind_of([{"mapping": {}, "chat_messages": []}]) == "tree" and exports.kind_of({"conversations": [{"turns": []}]}) == "tree"
    assert exports.kind_of([{"chat_messages": []}]) == exports.kind_of({"account": "claude"}) == exports.kind_of({"conversations": [{"chat_messages": []}]}) == "list"
    for bad in ([], [1], {}, [{"x": 1}]):
        with pytest.raises(ValueError):
            exports.kind_of(bad)
