"""Settings, models, and the whole flow offline: ingest, build, evaluate, report."""

import json

import numpy as np
import pytest

from sparkgauge import cli, models, reports
from sparkgauge import settings as S
from sparkgauge.operators import density, families, judging
from sparkgauge.workspace import Workspace, apply_review


@pytest.fixture(autouse=True)
def no_keys(monkeypatch):
    for name in ("OPENAI_API_KEY", "ANTHROPIC_API_KEY"):
        monkeypatch.delenv(name, raising=False)


BASE = {"providers": {"a": {"api_key_env": "X"}, "b": {}}, "judges": {"default": {"provider": "a", "model": "m"}}}


def test_settings_hold_numbers_and_refuse_the_rest():
    s = S.parse(BASE | {"sample": {"target_n": 999, "max_family_tasks": 0, "near_duplicate_threshold": 2, "long_tail_fraction": -1}, "embeddings": {"provider": "b"}})
    assert (s.sample.target_n, s.sample.max_family_tasks, s.sample.near_duplicate_threshold, s.sample.long_tail_fraction) == (200, 1, 1.0, 0.0)
    assert s.filter_model == S.Model("a", "claude-haiku-4-5-20251001") and s.judges == (S.Model("a", "m"),)
    assert s.provider("b").seconds == 3600.0 and s.provider("a").seconds is None
    wrong = [
        {"judges": {}}, {"judges": BASE["judges"] | {"scoring_aggregate": "max"}}, {"judges": BASE["judges"] | {"exclude_candidate_provider": 1}}, {"judges": BASE["judges"] | {"scoring_panel": {}}},
        {"providers": {"a": {"kind": "x"}}}, {"providers": {"a": 1}}, {"providers": {"a": {"timeout_seconds": 0}}}, {"filter": "m"}, {"filter": {"provider": "c", "model": "m"}},
        {"embeddings": {"provider": "c"}}, {"embeddings": {"backend": "x"}}, {"pricing": {"models": [{"model": "m", "input_per_1m": 1}]}}, {"pricing": {"models": [{"model": "m", "input_per_1k": -1, "output_per_1k": 1}]}}, {"pricing": {"fetch_external": "no"}},
    ]
    for change in wrong:
        with pytest.raises(S.SettingsError):
            S.parse(BASE | change)
    with pytest.raises(S.SettingsError):
        S.parse({"providers": {}})
    priced = S.parse(BASE | {"pricing": {"models": [{"model": "m", "input_per_1k": 0.001, "output_per_1m": 2}]}})
    assert (priced.prices[0].input_per_1m, priced.prices[0].output_per_1m) == (1.0, 2.0)


def test_judges_of_a_candidate():
    s = S.parse({"providers": {"a": {}, "b": {}, "openai": {}}, "judges": {"default": {"provider": "a", "model": "m"}, "scoring_panel": [{"provider": "a", "model": "x"}, {"provider": "b", "model": "y"}, {"provider": "b", "model": "y"}], "exclude_candidate_provider": True}})
    assert S.scoring_judges(s, S.Model("a", "z")) == [S.Model("b", "y")]
    assert S.scoring_judges(s, S.Model("a", "z"), ["a/q/r", "a/q/r"]) == [S.Model("a", "q/r")]
    for spec in ("a", "/m", "a/", "c/m"):
        with pytest.raises(S.SettingsError):
            S.model_of(spec, s.providers)
    one = S.parse(BASE | {"judges": BASE["judges"] | {"exclude_candidate_provider": True}})
    with pytest.raises(S.SettingsError):
        S.scoring_judges(one, S.Model("a", "z"))
    plain = S.parse({"providers": {"a": {}, "b": {}, "openai": {}}, "judges": {"default": {"provider": "a", "model": "m"}}})
    assert S.build_identity(s) == S.build_identity(plain) and sorted(S.build_identity(s)["providers"]) == ["a", "openai"]


def test_judgements_of_replies():
    j = models.judgement_of
    assert (j('{"score": "7"}')["score"], j('{"score": 8.9}')["score"], j('{"score": 40}')["score"], j('{"score": -3}')["score"]) == (7, 8, 10, 1)
    for bad in ("no", "", '{"score": "7.9"}', '{"score": null}', '{"strengths": null}', '{"score": 1e999}'):
        assert (j(bad)["score"], j(bad)["ok"]) == (5, False) and j(bad)["weaknesses"]
    s = S.parse(BASE)
    assert models.live(s) == {"b"}  # no key is set for a
    assert isinstance(models.client(S.Model("a", "m"), s, models.live(s)), models.Offline) and isinstance(models.client(S.Model("b", "m"), s, models.live(s)), models.Chat)


def test_panel_drops_failed_judges(spark):
    rows = [("t", 0, "a", 9, True), ("t", 1, "b", 5, False), ("t", 2, "c", 6, True), ("u", 0, "a", 5, False)]
    judged = spark.createDataFrame([(t, p, j, s, [], [], "", ok) for t, p, j, s, ok in rows], "task string, judge_pos int, judge string, score long, strengths array<string>, weaknesses array<string>, rationale string, ok boolean")
    got = {r.task: r for r in judging.panel_details(judged, ["task"]).collect()}
    assert (got["t"].score, got["t"].judge_spread, got["t"].judge_scores) == (7.5, 3, {"a": 9, "b": 5, "c": 6}) and [x.judge for x in got["t"].judges] == ["a", "b", "c"]
    assert (got["u"].score, got["u"].judge_spread) == (5.0, 0)


def test_annotations_of_failing_models(spark):
    rows = spark.createDataFrame([(i, f"translate letter number {i} please", 0) for i in range(10)], "id long, t string, g long")

    class Broken:
        def __call__(self, kind, payload):
            raise OSError("gone")

    got = families.annotate_with_model(rows, "id", "t", "g", Broken).collect()
    assert len(got) == 10 and not any(r.ok for r in got) and {r.family for r in got} == {"Translate language support"}


def test_density_finds_blobs(spark):
    rnd = np.random.default_rng(3)
    x = np.concatenate([rnd.normal(c, 0.05, (40, 2)) for c in ((0, 0), (4, 0), (0, 4))] + [rnd.uniform(-10, 14, (12, 2))])
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "k long, v array<double>")
    raw = np.array([r.cluster for r in density.clusters(rows, "k", "v", 5).orderBy("k").collect()])
    parts = [set(raw[i * 40 : (i + 1) * 40].tolist()) - {-1} for i in range(3)]
    assert all(len(p) == 1 for p in parts) and len(set.union(*parts)) == 3
    a, b, d = density.local_tree(np.arange(30), x[:30], np.zeros(30, np.int64), 1e-9)
    assert len(d) == 29 and len(set(a.tolist()) | set(b.tolist())) == 30 and (a < b).all()
    raw = spark.createDataFrame(list(zip(range(6), [7, -1, 2, 7, -1, -1], "abcdbe", strict=True)), "k long, cluster int, signature string")
    assert [r.group_id for r in density.numbered(raw, "k").orderBy("k").collect()] == [0, 2, 1, 0, 2, 3]


def export(folder):
    asks = ["Explain this python stack trace to me", "Find what is slow in our javascript build", "Translate the menu to French for dinner guests", "Draft an email to our landlord about heating", "thanks!", "hello",
            "Plan a garden with tomatoes and beans for spring", "Compare two phones for photos at night", "Write a short essay on rivers and trade", "Sum up the following report on harbours"]
    rows = [{"id": f"c{i}", "title": a, "mapping": {"x": {"message": {"create_time": 1, "author": {"role": "user"}, "content": {"parts": [f" {a} "]}}}, "y": {"message": {"create_time": 2, "author": {"role": "assistant"}, "content": {"parts": ["Sure."]}}}}} for i, a in enumerate(asks)]
    (folder / "conversations.json").write_text(json.dumps(rows))


def test_commands_from_export_to_report(spark, tmp_path, capsys):
    export(tmp_path)
    run = lambda *a: cli.main(["--workspace", str(tmp_path / "w"), *a], spark)
    assert run("build", "--yes") == 1 and run("init") == 0
    assert run("ingest", str(tmp_path / "nowhere")) == 1 and run("ingest", str(tmp_path)) == 0 and "imported 10" in capsys.readouterr().out
    assert run("build", "--yes") == 0
    ws = Workspace(spark, str(tmp_path / "w"))
    bench = json.loads((tmp_path / "w/benchmark.json").read_text())
    meta = bench["metadata"]
    assert meta["task_count"] == 8 and sum(meta["domain_distribution"].values()) == 8 and meta["task_family_count"] >= 1
    assert [t["id"] for t in bench["tasks"]] == [f"task-{i:04d}" for i in range(1, 9)] and all(len(t["checklist"]) == 5 and [x["role"] for x in t["turns"]] == ["user"] for t in bench["tasks"])
    assert run("build", "--yes") == 0 and '"ran": []' in capsys.readouterr().out
    assert run("build", "--yes", "--from", "7") == 0
    again = json.loads((tmp_path / "w/benchmark.json").read_text())["metadata"]
    assert (again["version"], again["benchmark_hash"]) == (2, meta["benchmark_hash"])
    assert run("eval", "--model", "anthropic/weak-1", "--yes") == 0 and run("eval", "--model", "nobody/x", "--yes") == 1
    board = reports.run_summaries(spark, f"{tmp_path}/w/runs").collect()
    assert len(board) == 1 and board[0].raw_egoscore == 3.0 and board[0].judges_label == "anthropic:claude-opus-4-8"
    assert reports.details(spark, f"{tmp_path}/w/runs").count() == 8
    assert run("report") == 0 and "task-0001" in (tmp_path / "w/report.html").read_text() and "anthropic:weak-1" in (tmp_path / "w/report.md").read_text()
    assert run("status") == 0 and run("leaderboard") == 0 and run("cost") == 0
    with pytest.raises(ValueError):
        ws.state_rows(["nope"])
    edits = spark.createDataFrame([("c0", "- one\n\n- two", 5.0)], "conversation_id string, checklist_text string, importance_delta double")
    row = apply_review(ws.table("tasks7"), edits).where("conversation_id = 'c0'").first()
    assert row.checklist == ["one", "two"] and row.importance == 1.0


def test_reports_escape_texts():
    run = {"model": "<b>", "label": "<b>", "judges_label": "—", "raw_egoscore": 7.0, "frequency_weighted_egoscore": 8.5, "run_cost_usd": None, "wall_time_seconds": None, "per_category": {"<c>": 5.0}}
    item = {"tier": "low", "task_id": "t", "model": "<b>", "shown": "3", "preview": "<script>", "prompt": "<script>", "response": "&", "judges": [], "rationale": "—"}
    text = reports.page([run], [item], "", 1)
    assert "<script>" not in text and "&lt;c&gt;" in text and "| <b> | 7.00 | 8.50 | $0.0000 | — |" in reports.markdown([run])
    assert reports.shared_judges(["x", "x"]) == "x" and reports.shared_judges(["—", "—"]) == reports.shared_judges(["x", "y"]) == ""
