"""Reports of evaluation runs: tables by Spark, a Markdown and a HTML page by the driver out of a row a run."""

from __future__ import annotations

import html
import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text as T
from .operators.scoring import display_labels
from .sources.exports import last_by_id
from .sources.lock import benchmark_meta

SUMMARY = "model string, judges array<string>, scoring_aggregate string, benchmark_hash string, task_count long, raw_egoscore double, frequency_weighted_egoscore double, per_category map<string,double>, run_cost_usd double, wall_time_seconds double, created_at string"
LINES = {
    "tasks": "task_id string, prompt string, checklist array<string>", "responses": "task_id string, response string", "scores": "task_id string, score double, category string",
    "rationales": "task_id string, rationale string, judge_spread double, judges array<struct<judge:string,score:double,rationale:string>>",
}
SORTS = {"score_high": [F.desc_nulls_last, "score"], "score_low": [F.asc_nulls_last, "score"], "model": [F.asc, "model"], "task": [F.asc, "task_id"]}


def run_summaries(spark: SparkSession, root: str) -> DataFrame:
    """A row a run, best weighted score first, ties by path; with its place, its label and its judges' label. Runs of older
    forms lack some fields."""
    return board(spark.read.schema(SUMMARY).option("multiLine", True).json(f"{root}/*/*/summary.json").withColumn("_path", F.regexp_replace("_metadata.file_path", "/summary\\.json$", "")))


def board(rows: DataFrame) -> DataFrame:
    """run_summaries out of summaries with their _path."""
    rows = display_labels(rows).withColumn("judges_label", T.judges_label(F.col("judges"), F.col("scoring_aggregate")))
    return rows.orderBy(F.coalesce("frequency_weighted_egoscore", F.lit(0.0)).desc(), "_path")


def details(spark: SparkSession, root: str) -> DataFrame:
    """A row for each run and task, of runs that ended: prompt, response, score as shown, tier, the judges' views, and a text
    to search in. Of lines with one task id the last counts."""
    parts = {}
    for name, schema in LINES.items():
        rows = spark.read.schema(schema).json(f"{root}/*/*/{name}.jsonl").withColumn("run", F.regexp_replace("_metadata.file_path", "/[^/]+$", "")).withColumn("_line", F.monotonically_increasing_id())
        parts[name] = rows
    return details_of(parts, spark.read.schema("model string").option("multiLine", True).json(f"{root}/*/*/summary.json").withColumn("run", F.regexp_replace("_metadata.file_path", "/[^/]+$", "")))


def details_of(lines: dict[str, DataFrame], summary: DataFrame) -> DataFrame:
    """`details` out of the runs' lines, each with its run and its place among them (_line), and (run, model) of the ended ones."""
    parts = {name: last_by_id(rows, ["run", "task_id"], "_line").drop("_line") for name, rows in lines.items()}
    rows = parts["tasks"].join(summary, "run")
    for name in ("responses", "scores", "rationales"):
        rows = rows.join(parts[name], ["run", "task_id"], "left")
    said = F.array_join(F.transform("judges", lambda j: F.coalesce(j["rationale"], F.lit(""))), " ")
    search = F.lower(F.concat_ws(" ", "model", "task_id", "prompt", F.coalesce("response", F.lit("")), F.coalesce(F.nullif(said, F.lit("")), "rationale", F.lit(""))))
    judges = F.transform(F.coalesce("judges", F.array().cast("array<struct<judge:string,score:double,rationale:string>>")), lambda j: F.struct(
        F.coalesce(j["judge"], F.lit("judge")).alias("judge"), T.score_display(j["score"]).alias("shown"), T.score_tier(j["score"]).alias("tier"), F.coalesce(F.nullif(j["rationale"], F.lit("")), F.lit("—")).alias("rationale")))
    return rows.select("run", "model", "task_id", "prompt", T.preview(F.col("prompt")).alias("preview"), "checklist", F.coalesce(F.nullif(F.col("response"), F.lit("")), F.lit("—")).alias("response"),
                       "score", T.score_display(F.col("score")).alias("shown"), F.when(F.col("score").isNotNull(), T.score_tier(F.col("score"))).alias("tier"), F.coalesce(F.nullif(F.col("rationale"), F.lit("")), F.lit("—")).alias("rationale"), judges.alias("judges"), "judge_spread", search.alias("search"))


def filtered(rows: DataFrame, text: str = "", model: str | None = None, tier: str | None = None, sort: str = "score_high") -> DataFrame:
    """What a reader of the details asks for: words anywhere, one model, one tier, an order."""
    if text.strip():
        rows = rows.where(F.col("search").contains(text.strip().lower()))
    if model:
        rows = rows.where(F.col("model") == model)
    if tier:
        rows = rows.where(F.col("tier") == tier)
    way, column = SORTS[sort]
    return rows.orderBy(way(column), "model", "task_id")


def shared_judges(labels: list[str]) -> str:
    """The one judges' label of all runs; empty where they differ or some don't say."""
    return labels[0] if len(set(labels)) == 1 and labels[0] != "—" else ""


def bar_svg(values: dict[str, float], width: int = 560) -> str:
    """Bars of scores from 0 to 10, by name."""
    if not values:
        return ""
    out, row, left = [], 26, 190
    for i, (name, value) in enumerate(sorted(values.items())):
        y, long = 8 + i * row, max(0.0, min(10.0, value)) / 10 * (width - left - 50)
        out.append(f'<text x="{left - 8}" y="{y + 14}" text-anchor="end">{html.escape(name)}</text><rect x="{left}" y="{y}" width="{long:.1f}" height="18" rx="3"/><text x="{left + long + 6:.1f}" y="{y + 14}">{value:.2f}</text>')
    return f'<svg viewBox="0 0 {width} {16 + row * len(out)}" role="img">{"".join(out)}</svg>'


def markdown(runs: list[dict]) -> str:
    lines = ["# Benchmark report", "", "| Model | Raw score | Weighted score | Cost | Judges |", "|---|---:|---:|---:|---|"]
    lines += [f"| {r['model']} | {r['raw_egoscore'] or 0:.2f} | {r['frequency_weighted_egoscore'] or 0:.2f} | ${r['run_cost_usd'] or 0:.4f} | {r['judges_label']} |" for r in runs]
    lines += ["", "## Per-category Means"]
    for r in runs:
        lines += ["", f"### {r['model']}", *(f"- {c}: {v:.2f}" for c, v in sorted((r["per_category"] or {}).items()))]
    return "\n".join(lines) + "\n"


def page(runs: list[dict], items: list[dict], digest: str, tasks: int) -> str:
    """The HTML page. All texts are escaped."""
    e = lambda x: html.escape(str(x if x is not None else ""))
    by_category: dict[str, list[float]] = {}
    for r in runs:
        for c, v in (r["per_category"] or {}).items():
            by_category.setdefault(c, []).append(v)
    shared = shared_judges([r["judges_label"] for r in runs])
    head = "".join(f"<li>{k}: <b>{e(v)}</b></li>" for k, v in (("Runs", len(runs)), ("Tasks", tasks), ("Benchmark", digest[:12]), ("Best", runs[0]["model"] if runs else "—"), ("Cost", f"${sum(r['run_cost_usd'] or 0 for r in runs):.4f}"), ("Seconds", f"{sum(r['wall_time_seconds'] or 0 for r in runs):.1f}"), *([("Judges", shared)] if shared else [])))
    board = "".join(f"<tr><td>{i}</td><td>{e(r['label'])}</td><td>{r['raw_egoscore'] or 0:.2f}</td><td>{r['frequency_weighted_egoscore'] or 0:.2f}</td><td>${r['run_cost_usd'] or 0:.4f}</td>{'' if shared else f'<td>{e(r["judges_label"])}</td>'}</tr>" for i, r in enumerate(runs, 1))
    one = lambda x: (f"<details class='{e(x['tier'])}'><summary>{e(x['task_id'])} · {e(x['model'])} · {e(x['shown'])} · {e(x['preview'])}</summary><pre>{e(x['prompt'])}</pre><pre>{e(x['response'])}</pre>"
                     + ("".join(f"<p><b>{e(j['judge'])}</b> {e(j['shown'])}: {e(j['rationale'])}</p>" for j in x["judges"]) or f"<p>{e(x['rationale'])}</p>") + "</details>")
    return ("<!doctype html><meta charset='utf-8'><title>Benchmark report</title><style>body{font:15px sans-serif;max-width:60em;margin:2em auto}pre{white-space:pre-wrap}rect{fill:#4a7}.low{color:#a33}.high{color:#173}</style>"
            f"<h1>Benchmark report</h1><ul>{head}</ul><table><tr><th>#</th><th>Model</th><th>Raw</th><th>Weighted</th><th>Cost</th>{'' if shared else '<th>Judges</th>'}</tr>{board}</table>"
            f"{bar_svg({c: sum(v) / len(v) for c, v in by_category.items()})}<h2>Answers</h2>{''.join(map(one, items))}")


def render(spark: SparkSession, folder: str) -> tuple[Path, Path]:
    """Write report.html and report.md of the runs under folder/runs. A run has at most a few hundred tasks."""
    root = Path(folder)
    runs, items = [], []
    if any(root.glob("runs/*/*/summary.json")):
        runs = [r.asDict(recursive=True) for r in run_summaries(spark, f"{folder}/runs").collect()]
        items = [r.asDict(recursive=True) for r in filtered(details(spark, f"{folder}/runs"), sort="task").collect()]
    digest, tasks = benchmark_meta(folder)
    out = root / "report.html", root / "report.md"
    out[0].write_text(page(runs, items, digest, tasks), encoding="utf-8")
    out[1].write_text(markdown(runs), encoding="utf-8")
    return out


def write_lines(path: Path, rows: list[dict]) -> None:
    path.write_text("".join(json.dumps(r, sort_keys=True, ensure_ascii=False) + "\n" for r in rows), encoding="utf-8")
