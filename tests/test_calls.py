"""Live models over HTTP (a server in the test answers), paid calls kept as they arrive, runs that go on, embeddings."""

import hashlib
import json
import threading
from functools import partial
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from sparkgauge import build, calls, models
from sparkgauge import settings as S
from sparkgauge.functions import plain
from sparkgauge.operators import embeddings
from sparkgauge.workspace import Workspace


def vector(text):
    return [b - 127.5 for b in hashlib.sha256(text.encode()).digest()[:8]] if text else [0.0] * 8


class Server:
    """Speaks the two endpoints, with the offline rules as its mind. `refuse` maps a request's number to a status."""

    def __init__(self):
        self.asked, self.refuse, self.after, self.old_limit = [], {}, None, False
        outer, lock = self, threading.Lock()

        class Handler(BaseHTTPRequestHandler):
            def log_message(self, *_):
                pass

            def do_POST(self):
                body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
                with lock:
                    outer.asked.append((self.path, body, self.headers.get("Authorization")))
                    status = outer.refuse.get(len(outer.asked), 200)
                if outer.old_limit and "max_completion_tokens" in body:
                    status, said = 400, {"error": "unknown max_completion_tokens"}
                elif status == 200:
                    said = outer.embed(body) if self.path.endswith("/embeddings") else outer.chat(body)
                else:
                    said = {"error": "no"}
                data = json.dumps(said).encode()
                self.send_response(status)
                if outer.after is not None:
                    self.send_header("Retry-After", outer.after)
                self.send_header("Content-Length", str(len(data)))
                self.end_headers()
                self.wfile.write(data)

        self.http = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
        threading.Thread(target=self.http.serve_forever, daemon=True).start()
        self.url = f"http://127.0.0.1:{self.http.server_port}/v1"

    def chat(self, body):
        text = body["messages"][0]["content"]
        kind = next((k for k, ask in models.ASKS.items() if ask and text.startswith(ask)), "answer")
        payload = text.removeprefix(models.ASKS[kind]).strip()
        if kind == "filter":
            said = "YES"
        elif kind == "answer":
            said = f"A long and careful answer to: {payload}"
        else:
            said = models.Offline()(kind, json.loads(payload)).text
        return {"choices": [{"message": {"content": said}}], "usage": {"prompt_tokens": 100, "completion_tokens": 10}}

    def embed(self, body):
        rows = [{"index": i, "embedding": vector(t)} for i, t in enumerate(body["input"])]
        return {"data": rows[::-1], "usage": {"prompt_tokens": 1000}}

    def count(self, path="/v1/chat/completions"):
        return sum(p == path for p, *_ in self.asked)


@pytest.fixture
def server(monkeypatch):
    monkeypatch.setattr(models, "WAIT", 0.01)
    s = Server()
    yield s
    s.http.shutdown()


def test_chat_speaks_the_protocol(server):
    chat = models.Chat("m", server.url + "/", "k", None)
    got = chat("judge", {"task": "t", "checklist": [], "response": "words " * 40})
    assert (got.input_tokens, got.output_tokens, got.billable, got.model) == (100, 10, True, "m") and models.judgement_of(got.text)["ok"]
    path, body, key = server.asked[0]
    assert path == "/v1/chat/completions" and key == "Bearer k" and (body["model"], body["temperature"], body["max_completion_tokens"]) == ("m", 0.0, models.MOST_TOKENS)
    server.old_limit = True
    assert models.answer_of(chat("answer", "why?")).endswith("why?") and server.asked[-1][1]["max_tokens"] == models.MOST_TOKENS


def test_passing_troubles_are_tried_again_and_others_not(server):
    chat = models.Chat("m", server.url, None, 5)
    server.refuse, server.after = {1: 429, 2: 503}, "0.01"
    assert chat("answer", "x").text and len(server.asked) == 3 and server.asked[0][2] is None
    server.refuse = dict.fromkeys(range(4, 99), 500)
    with pytest.raises(models.FAILURES):
        chat("answer", "x")
    assert len(server.asked) == 3 + models.TRIES
    server.refuse = dict.fromkeys(range(1, 99), 401)
    before = len(server.asked)
    with pytest.raises(models.FAILURES):
        chat("answer", "x")
    assert len(server.asked) == before + 1
    server.refuse, server.chat = {}, lambda body: {"choices": []}
    with pytest.raises(ValueError):
        chat("answer", "x")


class Counting:
    billable = True

    def __init__(self, seen):
        self.seen = seen

    def __call__(self, kind, payload):
        self.seen.append(payload)
        if payload == "fail":
            raise OSError("gone")
        return models.Reply(f"re: {payload}", "m", 2000, 1000, True)


def test_records_stand_for_paid_calls(spark, tmp_path):
    seen = []
    log = calls.Log(str(tmp_path), "phase2", prices={("p", "m"): (0.5, 1.0)})
    make = lambda log: log.making(lambda p, m: Counting(seen))
    ask = make(log)("p", "m")
    assert ask("filter", "a").text == ask("filter", "a").text == make(log)("p", "m")("filter", "a").text == "re: a" and seen == ["a"]
    assert ask("answer", "a").billable and make(log.of("phase4"))("p", "m")("filter", "a") and make(log)("p", "n")("filter", "a") and len(seen) == 4
    for _ in range(2):
        with pytest.raises(OSError):
            ask("filter", "fail")
    assert seen[-2:] == ["fail", "fail"]
    rows = calls.records(spark, str(tmp_path))
    assert rows.count() == 4 and {tuple(r) for r in calls.ledger(rows).collect()} == {("phase2", "p:m", 2, 4000, 2000, 4.0), ("phase2", "p:n", 1, 2000, 1000, 0.0), ("phase4", "p:m", 1, 2000, 1000, 2.0)}
    late = calls.Log(str(tmp_path), "phase2", prices=log.prices, since=rows.agg(F.max("at")).first()[0] + 1e-3)
    while __import__("time").time() < late.since:
        pass
    assert make(late)("p", "m")("filter", "a") and make(late)("p", "m")("filter", "a") and len(seen) == 7
    assert calls.records(spark, str(tmp_path)).count() == 4 and not list(Path(tmp_path).glob("*/*/.*"))
    assert not isinstance(log.making(lambda p, m: models.Offline())("p", "m"), calls.Kept)
    assert calls.records(spark, str(tmp_path / "none")).count() == 0


def test_requests_hold_what_fits():
    texts = ["a b c d " * 20] * 5 + ["b " * 4000] + ["c"]
    got, size = embeddings.requests(texts, 250), plain.estimate_tokens
    assert [t for r in got for t in r] == texts and len(got) > 2
    assert all(len(r) == 1 or sum(map(size, r)) <= 250 for r in got)
    assert all(sum(map(size, r)) + size(after[0]) > 250 for r, after in zip(got, got[1:], strict=False))
    assert embeddings.requests([]) == []


def test_embeddings_of_distinct_texts(spark, server):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(["one", "three", "one", None, ""] + [f"text {k}" for k in range(150)])], "id long, t string").repartition(7)
    url = server.url
    make = lambda p, m: models.Embed(m, url, None, 5)
    got = {r.id: r.vec for r in embeddings.provided(rows, "id", "t", S.Model("p", "e"), make).collect()}
    assert len(got) == 155 and got[0] == got[2] == pytest.approx(embeddings.unit([vector("one")])[0]) and got[3] == got[4] == [0.0] * 8
    sent = [t for _, body, _ in server.asked for t in body["input"]]
    assert len(sent) == len(set(sent)) == 153 and server.count("/v1/embeddings") == 3
    server.refuse = {5: 400}
    assert embeddings.provided(rows, "id", "t", S.Model("p", "e"), make) is None
    hashed = embeddings.task_vectors(rows, "id", "t", S.Model("p", "e"), lambda p, m: models.Embed(m, "http://127.0.0.1:9/v1", None, 1))
    assert {len(r.vec) for r in hashed.collect()} == {32}
    assert embeddings.provided(rows.limit(0), "id", "t", S.Model("p", "e"), make) is None


def workspace(spark, tmp_path, server, monkeypatch):
    monkeypatch.setenv("STUB_KEY", "k")
    ws = Workspace(spark, str(tmp_path / "w"))
    ws.init()
    ws.settings_file.write_text(f"""
[providers.p]
api_key_env = "STUB_KEY"
base_url = "{server.url}"
[filter]
provider = "p"
model = "small"
[judges.default]
provider = "p"
model = "big"
[[judges.checklist_panel]]
provider = "p"
model = "big"
[[judges.checklist_panel]]
provider = "p"
model = "other"
[[judges.checklist_panel]]
provider = "p"
model = "big"
[embeddings]
provider = "p"
model = "e"
[[pricing.models]]
model = "small"
input_per_1m = 10
output_per_1m = 20
[[pricing.models]]
model = "e"
input_per_1m = 1
output_per_1m = 0
""")
    asks = ["Explain this python stack trace to me", "Translate the menu to French for dinner guests", "Draft an email to our landlord about heating", "Plan a garden with tomatoes and beans", "Compare two phones for photos", "thanks!"]
    ws.ingest(spark.createDataFrame([(f"c{i}", 0, "user", a, None, None, None) for i, a in enumerate(asks)], "conversation_id string, turn int, role string, text string, ts string, model_used string, metadata_json string"), "lines")
    return ws


def test_a_build_writes_its_costs_and_asks_nothing_twice(spark, tmp_path, server, monkeypatch):
    ws = workspace(spark, tmp_path, server, monkeypatch)
    settings = ws.settings()
    build.build(ws, settings, say=lambda _: None)
    spent = {(r.phase, r.model): r for r in calls.ledger(ws.calls()).collect()}
    assert spent["phase2", "p:small"].calls == 5 and spent["phase2", "p:small"].cost_usd == pytest.approx(5 * (0.1 * 0.01 + 0.01 * 0.02))
    assert spent["phase3", "p:e"].cost_usd == pytest.approx(0.001) and spent["phase3", "p:e"].input_tokens == 1000
    assert {p for p, _ in spent} == {"phase2", "phase3", "phase4", "phase7"} and ("phase7", "p:other") in spent
    assert sum(r.calls for r in spent.values()) == len(server.asked)
    assert ws.table("tasks7").where("size(raw_checklists) = 2").count() == 5  # a model that the panel names twice is asked once
    before = len(server.asked)
    more = spark.createDataFrame([("c9", 0, "user", "Write a short essay on rivers", None, None, None)], "conversation_id string, turn int, role string, text string, ts string, model_used string, metadata_json string")
    ws.ingest(more, "lines")
    build.build(ws, settings, say=lambda _: None)
    texts = [b["messages"][0]["content"] for p, b, _ in server.asked[before:] if "messages" in b]
    assert sum(t.startswith(models.ASKS["filter"]) for t in texts) == 1  # the new conversation's
    again = len(server.asked)
    build.build(ws, settings, 2, say=lambda _: None)
    assert sum(b["messages"][0]["content"].startswith(models.ASKS["filter"]) for p, b, _ in server.asked[again:] if "messages" in b) == 6


def test_a_stopped_evaluation_goes_on(spark, tmp_path, server, monkeypatch):
    ws = workspace(spark, tmp_path, server, monkeypatch)
    settings = ws.settings()
    build.build(ws, settings, say=lambda _: None)
    before, candidate, judges = len(server.asked), S.Model("p", "cand"), [S.Model("p", "big"), S.Model("p", "other")]
    normal = partial(build._make, settings, models.live(settings))

    class Killed(RuntimeError):
        pass

    def dying(provider, model):
        client = normal(provider, model)

        def ask(kind, payload):
            if kind == "judge" and "tomatoes" in payload["task"]:
                raise Killed  # not a call's failure: the run ends
            return client(kind, payload)

        ask.billable = True
        return ask

    with pytest.raises(Exception, match="Killed"):
        build.evaluate(ws, settings, candidate, judges, dying)
    first = len(server.asked) - before
    assert 5 <= first < 15 and not list(ws.root.glob("runs/*/*/summary.json"))
    summary = build.evaluate(ws, settings, candidate, judges)
    assert len(server.asked) - before == 15  # five answers, ten judgements, none twice
    assert len(list(ws.root.glob("runs/*/*/plan.json"))) == 1 and summary["task_count"] == 5
    assert ws.calls().where(F.col("scope").startswith("p_cand") | F.col("scope").contains("cand")).count() == 15
    build.evaluate(ws, settings, candidate, judges)  # a finished run isn't gone on with
    assert len(server.asked) - before == 30 and len(list(ws.root.glob("runs/*/*/summary.json"))) == 2


def test_catalog_files_price_calls(spark, tmp_path):
    (tmp_path / "router.json").write_text('{"data": [{"id": "p/m", "pricing": {"prompt": "0.000002", "completion": "0.000004"}}]}')
    (tmp_path / "lite.json").write_text('{"other": {"input_cost_per_token": 1e-6, "output_cost_per_token": 3e-6}}')
    base = {"providers": {"p": {"api_key_env": "X"}, "free": {}}, "judges": {"default": {"provider": "p", "model": "m"}}}
    s = S.parse(base | {"pricing": {"catalogs": [{"form": "openrouter", "path": str(tmp_path / "router.json")}, {"form": "litellm", "path": str(tmp_path / "lite.json")}], "models": [{"provider": "p", "model": "own", "input_per_1m": 1, "output_per_1m": 2}]}})
    got = build.call_prices(spark, s, [S.Model("p", "m"), S.Model("p", "other"), S.Model("p", "own"), S.Model("free", "m"), S.Model("p", "who")])
    assert got == {("p", "m"): (0.002, 0.004), ("p", "other"): (0.001, 0.003), ("p", "own"): (0.001, 0.002), ("p", "who"): (0.0, 0.0)}
    for bad in ({"form": "x", "path": "y"}, {"form": "litellm"}):
        with pytest.raises(S.SettingsError):
            S.parse(base | {"pricing": {"catalogs": [bad]}})
