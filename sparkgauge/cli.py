"""Commands over a workspace folder: python -m sparkgauge.cli [--workspace DIR] COMMAND."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from . import build as B
from . import reports
from .calls import ledger
from .operators import pricing as P
from .settings import SettingsError, model_of, scoring_judges
from .sources.exports import read_export
from .workspace import Workspace, apply_review


def _shown(lines, ws: Workspace) -> None:
    local = [p.name for p in ws.settings().providers.values() if p.keyless]
    rows = P.priced(lines, P.catalog(ws.spark, ws.settings()), local)
    rows.orderBy("line").show(100, False)
    print("Total", P.estimate_totals(rows).first().shown)


def _build_lines(ws: Workspace):
    s, tasks = ws.settings(), ws.table("conversations").count()
    sizes = ws.table("tasks3").groupBy("candidate_group_id").agg(F.count("*").alias("n")) if ws.has("tasks3") else None
    lines = P.build_estimate(ws.spark, tasks, sizes, s.sample.target_n, max(1, len(s.checklist_panel)))
    asked = {"phase2-filter": s.filter_model, "phase3-embeddings": s.embeddings}
    who = ws.spark.createDataFrame([(i, p, (m := asked.get(p, s.judge)).provider, m.model) for i, (p, *_) in enumerate(P.PHASES)], "line int, phase string, provider string, model string")
    return lines.join(F.broadcast(who), "phase")


def init(ws, args):
    print("made" if ws.init(args.force) else "settings are there already", ws.root)


def status(ws, args):
    for k, v in ws.status().items():
        print(f"{k}: {v}")


def ingest(ws, args):
    print("imported", ws.ingest(read_export(ws.spark, args.path, None if args.adapter == "auto" else args.adapter), args.adapter), "conversations")


def build(ws, args):
    if not ws.table("conversations").count():
        raise RuntimeError("no conversations: ingest an export first")
    _shown(_build_lines(ws), ws)
    if not args.dry_run and (args.yes or input("Build? [y/N] ").strip().lower() == "y"):
        print(json.dumps(B.build(ws, ws.settings(), args.start), sort_keys=True))


def review(ws, args):
    """Edits from a JSON-lines file, then a new lock."""
    edits = ws.spark.read.schema("conversation_id string, checklist_text string, importance_delta double").json(args.edits)
    ws.write("tasks7", apply_review(ws.table("tasks7"), edits))
    print(json.dumps(B.build(ws, ws.settings(), 8), sort_keys=True))


def evaluate(ws, args):
    s = ws.settings()
    candidate = model_of(args.model, s.providers)
    judges = scoring_judges(s, candidate, args.judge)
    n = ws.status()["benchmark_tasks"]
    if n is None:
        raise RuntimeError("no benchmark: build first")
    _shown(P.eval_estimate(ws.spark, n, candidate, judges), ws)
    if not args.dry_run and (args.yes or input("Evaluate? [y/N] ").strip().lower() == "y"):
        print(json.dumps(B.evaluate(ws, s, candidate, judges), sort_keys=True))


def report(ws, args):
    print(*reports.render(ws.spark, str(ws.root)))


def leaderboard(ws, args):
    reports.run_summaries(ws.spark, f"{ws.root}/runs").select("label", "raw_egoscore", "frequency_weighted_egoscore", "run_cost_usd", "judges_label").show(100, False)


def cost(ws, args):
    ledger(ws.calls()).orderBy("phase", "model").show(200, False)
    _shown(_build_lines(ws), ws)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="sparkgauge")
    p.add_argument("--workspace", default="workspace")
    sub = p.add_subparsers(dest="command", required=True)
    add = lambda name, f, *flags: [sub.add_parser(name).set_defaults(run=f), [sub.choices[name].add_argument(*a, **k) for a, k in flags]]
    dry, yes = (["--dry-run"], {"action": "store_true"}), (["--yes"], {"action": "store_true"})
    start = (["--from"], {"dest": "start", "type": int, "choices": range(2, 9)})
    add("init", init, (["--force"], {"action": "store_true"}))
    add("status", status)
    add("doctor", status)
    add("ingest", ingest, (["path"], {}), (["--adapter"], {"default": "auto", "choices": ["auto", "tree", "list", "lines"]}))
    add("build", build, dry, yes, start)
    add("refresh", lambda ws, a: build(ws, argparse.Namespace(**(vars(a) | {"start": 2}))), dry, yes)
    add("review", review, (["edits"], {}))
    add("eval", evaluate, dry, yes, (["--model"], {"required": True}), (["--judge"], {"action": "append", "default": []}))
    add("report", report)
    add("leaderboard", leaderboard)
    add("cost", cost)
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    ws = Workspace(spark or SparkSession.builder.appName("sparkgauge").getOrCreate(), args.workspace)
    try:
        args.run(ws, args)
    except (SettingsError, RuntimeError, ValueError, FileNotFoundError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
