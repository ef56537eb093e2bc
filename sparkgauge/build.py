"""From conversations to a locked benchmark, and from a benchmark to scored runs.

A phase is a DataFrame step: it reads the tables before it and its result is one new `tasks` table. It is skipped while the rows it
reads, the build settings and the seed are those of its last run. What a live model was paid for is kept call by call (calls.py): a
phase that runs again over some changed rows, or after it was stopped, asks only what it has no reply to."""

from __future__ import annotations

import json
import time
from collections.abc import Callable
from datetime import UTC, datetime
from functools import partial
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import calls, reports
from .functions import text as T
from .models import FAILURES, Chat, Embed, client, live
from .operators import checklists as K
from .operators import conversations as C
from .operators import density as D
from .operators import embeddings as E
from .operators import families as A
from .operators import judging as J
from .operators import pricing as P
from .operators import scoring as S
from .operators import vectors as V
from .settings import Model, Settings, build_identity, distinct
from .sources import lock
from .storage import cut
from .workspace import Workspace

ID = "conversation_id"
PHASES = {2: "filter non-tasks", 3: "embed and group", 4: "families", 5: "importance", 6: "sample", 7: "checklists", 8: "lock"}


def _make(settings: Settings, asked: frozenset[str], provider: str, model: str, kind: type = Chat):
    return client(Model(provider, model), settings, asked, kind)


def call_prices(spark: SparkSession, settings: Settings, models: list[Model]) -> dict[tuple[str, str], tuple[float, float]]:
    """USD per 1000 tokens, in and out, of a few models, by the settings' prices, the built-in ones and the rough rules. Providers
    that need no key cost nothing."""
    paid = sorted({(m.provider, m.model) for m in models if not settings.provider(m.provider).keyless})
    if not paid:
        return {}
    found = P.quotes(spark.createDataFrame(paid, "provider string, model string"), P.catalog(spark, settings)).collect()
    return {(r.provider, r.model): (r.input_per_1k, r.output_per_1k) for r in found}


def call_log(ws: Workspace, settings: Settings, models: list[Model], scope: str = "build", since: float = 0.0) -> calls.Log:
    return calls.Log(ws.calls_folder, "", scope, call_prices(ws.spark, settings, models), since)


def filter_tasks(turns: DataFrame, keep: Callable | None = None) -> DataFrame:
    """conversation_id, first_user_text, is_task. Obvious non-tasks go by rule; `keep` (a frame function that adds a model's
    reply) is asked about the others, and what it can't answer stays."""
    first = C.first_user_text(turns.withColumnRenamed(ID, "conv_id")).withColumnRenamed("conv_id", ID)
    rows = C.task_flags(first, "first_user_text")
    if keep is None:
        return rows
    rest = keep(rows.where("is_task = 1")).withColumn("is_task", F.coalesce(T.keeps_yes_no(F.col("reply")), F.lit(True)).cast("int")).select(*rows.columns)
    return rows.where("is_task = 0").unionByName(rest)


def group(tasks: DataFrame, settings: Settings, make: Callable | None = None) -> DataFrame:
    """Adds the batching group (by density, or by signature) and the near-duplicate group, both by the texts' vectors: the embedding
    provider's where `make` gives a client for it, else hashed ones."""
    rows = cut(E.task_vectors(tasks.select(ID, "first_user_text"), ID, "first_user_text", settings.embeddings, make), "vectors")
    near = V.grouped_vectors(rows, rows, ID, settings.sample.near_duplicate_threshold).select(F.col(ID).alias("_n"), F.col("group_id").alias("near_duplicate_group_id"), F.col("group_size").alias("near_duplicate_group_size"))
    found = cut(D.density_groups(rows, ID, "first_user_text", "vec"), "groups")
    sizes = found.groupBy(F.col("group_id").alias("candidate_group_id")).agg(F.count("*").alias("candidate_group_size"))
    batch = found.select(F.col(ID).alias("_g"), F.col("group_id").alias("candidate_group_id")).join(sizes, "candidate_group_id")
    return tasks.join(batch, F.col(ID) == F.col("_g")).join(near, F.col(ID) == F.col("_n")).drop("_g", "_n")


def annotate(tasks: DataFrame, make: Callable) -> DataFrame:
    """Adds family, domain, skills, difficulty, specificity and the canonical family's id."""
    a = cut(A.annotate_with_model(tasks, ID, "first_user_text", "candidate_group_id", make).withColumnRenamed(ID, "_a"), "annotated")
    labels = cut(A.label_payload(a, "_a"), "labels")
    claims = cut(A.model_claims(labels, make), "claims") if labels.limit(2).count() > 1 else None
    names = A.canonical_map(a, "_a", claims).select("label_key", F.col("family").alias("task_family"))
    rows = a.withColumn("label_key", F.array_join(T.family_tokens(F.col("family")), " ")).join(names, "label_key", "left").withColumn("task_family", F.coalesce("task_family", "family"))
    top = A.top_values(rows, "task_family", "domain", "_a", 1).select(F.col("task_family").alias("_f"), F.get("values", F.lit(0)).alias("_domain"))
    rows = rows.join(top, F.col("task_family") == F.col("_f"), "left").withColumn("domain", F.coalesce("_domain", "domain"))
    rows = rows.withColumn("task_family_id", T.family_id(F.col("task_family"), F.col("domain"))).withColumn("category_label", F.substring("task_family", 1, 80)).withColumn("category_description", T.category_description(F.col("domain"), F.col("skills")))
    kept = rows.select("_a", "task_family_id", "task_family", "domain", "skills", "family_fit", "difficulty", "specificity", "category_label", "category_description")
    return tasks.join(kept, F.col(ID) == F.col("_a")).drop("_a")


def weigh(tasks: DataFrame) -> DataFrame:
    """Adds family size and importance."""
    rows = tasks.withColumn("family_id", A.family_key(tasks)).withColumn("family", F.col("task_family"))
    found = A.family_importance(rows, ID, "near_duplicate_group_id").select(F.col("family_id").alias("_f"), "family_size", "family_importance")
    return rows.join(found, F.col("family_id") == F.col("_f")).drop("_f", "family_id", "family").withColumn("importance", F.col("family_importance"))


def choose(tasks: DataFrame, settings: Settings) -> DataFrame:
    """Adds selected (0/1)."""
    rows = tasks.select(ID, A.family_key(tasks).alias("family_id"), "family_size", "family_importance", "specificity", "difficulty", F.col("near_duplicate_group_id").alias("dup_group"), F.col("near_duplicate_group_size").alias("dup_size"))
    s = settings.sample
    picked = A.sample(rows, ID, s.target_n, s.max_family_tasks, s.long_tail_fraction, settings.seed).select(F.col(ID).alias("_s"))
    return tasks.join(picked, F.col(ID) == F.col("_s"), "left").withColumn("selected", F.col("_s").isNotNull().cast("int")).drop("_s")


def rubrics(tasks: DataFrame, settings: Settings, make: Callable) -> DataFrame:
    """Adds the checklist of selected tasks, by the panel (or the judge alone) and the judge's merge. A model that the panel names
    twice is asked once."""
    chosen = tasks.where("selected = 1")
    items = cut(K.panel_items(chosen, ID, "first_user_text", distinct(settings.checklist_panel) or [settings.judge], make), "items")
    done = K.merged_items(chosen, items, ID, "first_user_text", settings.judge, make).select(F.col(ID).alias("_k"), "checklist")
    raw = items.groupBy(F.col(ID).alias("_r")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("judge", "items")))).alias("raw_checklists"))
    return tasks.join(done, F.col(ID) == F.col("_k"), "left").join(raw, F.col(ID) == F.col("_r"), "left").drop("_k", "_r")


def locked_rows(tasks: DataFrame, turns: DataFrame) -> DataFrame:
    """The selected tasks as the benchmark holds them: turns up to the last of the user, and defaults where a field lacks."""
    t = turns.withColumn("role", T.normalize_role(F.col("role")))
    ordered = t.groupBy(ID).agg(F.max(F.when(F.col("role") == "user", F.col("turn"))).alias("last"), F.min("turn").alias("first"), F.array_sort(F.collect_list(F.struct("turn", "role", "text", "ts"))).alias("all"))
    kept = ordered.select(F.col(ID).alias("_t"), F.transform(F.filter("all", lambda x: x["turn"] <= F.coalesce("last", "first")), lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"), x["ts"].alias("ts"))).alias("turns"))
    or_else = lambda c, d: F.coalesce(F.nullif(F.trim(F.col(c)), F.lit("")), F.lit(d)).alias(c)
    chosen = tasks.where("is_task = 1 AND selected = 1")
    lost = [r[0] for r in chosen.join(kept.select("_t"), F.col(ID) == F.col("_t"), "left_anti").select(ID).orderBy(ID).limit(3).collect()]
    if lost:
        raise RuntimeError(f"selected tasks without a conversation: {', '.join(map(str, lost))}")
    rows = chosen.join(kept, F.col(ID) == F.col("_t"))
    return rows.select(ID, "turns", F.coalesce("task_family", "category_label", F.lit("General")).alias("category"), F.coalesce("category_description", F.lit("")).alias("category_description"),
                       F.coalesce("candidate_group_id", F.lit(0)).alias("cluster_id"), F.coalesce("candidate_group_size", F.lit(1)).alias("cluster_size"), F.coalesce("family_importance", "importance", F.lit(0.0)).alias("importance"),
                       or_else("task_family_id", "general-assistance"), or_else("task_family", "General assistance"), or_else("domain", "General"), "skills", or_else("difficulty", "medium"), or_else("specificity", "generalizable"),
                       F.coalesce("checklist", F.array().cast("array<string>")).alias("checklist"))


def build(ws: Workspace, settings: Settings, start: int | None = None, say: Callable[[str], None] = print) -> dict:
    """Run the phases. Without start, those whose inputs didn't change are skipped. From `start`: earlier ones are never run, later
    ones always, and their models are asked anew."""
    turns, asked_now = ws.table("turns"), live(settings)
    log = call_log(ws, settings, [settings.filter_model, settings.embeddings, settings.judge, *settings.checklist_panel], since=0.0 if start is None else time.time())
    of = lambda phase, kind=Chat: log.of(phase).making(partial(_make, settings, asked_now, kind=kind))
    make = partial(of("phase2"), settings.filter_model.provider, settings.filter_model.model)
    judge = partial(of("phase4"), settings.judge.provider, settings.judge.model)
    embed = of("phase3", Embed) if settings.embeddings.provider in asked_now else None

    def lock_all(tasks: DataFrame) -> dict:
        got = lock.lock(locked_rows(tasks, turns), ID, build_identity(settings) | {"seed": settings.seed}, str(ws.root))
        ws.add_version(got)
        return got

    def asked(rows: DataFrame) -> DataFrame:
        def run(frames):
            ask = make()
            for f in frames:
                out = []
                for text in f.first_user_text:
                    try:
                        out.append(ask("filter", (text or "")[:2000]).text)
                    except FAILURES:  # what can't be asked stays
                        out.append(None)
                yield f.assign(reply=out)

        return rows.mapInPandas(run, ", ".join(f"`{c}` {t}" for c, t in rows.dtypes) + ", reply string")

    steps: dict[int, Callable[[DataFrame], DataFrame]] = {
        3: lambda t: group(t, settings, embed), 4: lambda t: annotate(t, judge), 5: weigh, 6: lambda t: choose(t, settings), 7: lambda t: rubrics(t, settings, of("phase7")),
    }
    ran, done = [], {}
    for phase, name in PHASES.items():
        before = ws.table(f"tasks{phase - 1}") if phase > 2 else turns
        key = ws.cache_key(phase, ws.digest(before, turns) if phase == 8 else ws.digest(before), settings)
        if start is not None and phase < start:
            if not ws.has(f"tasks{min(phase, 7)}"):
                raise RuntimeError(f"phase {phase} has no result yet: build from an earlier one")
            say(f"Phase {phase}/8 ({name}): skipped")
            continue
        if start is None and ws.cached(phase, key) is not None and (phase == 8 or ws.has(f"tasks{phase}")):
            done = ws.cached(phase, key)
            say(f"Phase {phase}/8 ({name}): unchanged")
            continue
        say(f"Phase {phase}/8 ({name})")
        if phase == 2:
            rows = ws.write("tasks2", filter_tasks(turns, asked))
            done = {"kept": rows.where("is_task = 1").count(), "dropped": rows.where("is_task = 0").count()}
        elif phase == 8:
            done = lock_all(before)
        else:
            rows = ws.write(f"tasks{phase}", steps[phase](before.where("is_task = 1")))
            done = {"rows": rows.count()}
        ran.append(phase)
        ws.remember(phase, key, done)
    ws.write("tasks", ws.table("tasks7"))
    return {"ran": ran, **done}


def open_run(folder: Path, plan: dict) -> Path:
    """The newest run in the folder that was to do the same and has no summary; else a new one, named by the time."""
    for old in sorted(folder.glob("*/plan.json"), reverse=True):
        if not (old.parent / "summary.json").exists() and json.loads(old.read_text(encoding="utf-8")) == plan:
            return old.parent
    stamp = datetime.now(UTC).strftime("%Y%m%dT%H%M%SZ")
    run = folder / stamp
    k = 1
    while run.exists():  # two runs within a second
        k += 1
        run = folder / f"{stamp}-{k}"
    run.mkdir(parents=True)
    (run / "plan.json").write_text(json.dumps(plan, sort_keys=True), encoding="utf-8")
    return run


def evaluate(ws: Workspace, settings: Settings, candidate: Model, judges: list[Model], make: Callable | None = None) -> dict:
    """Answer every task, judge every answer, write the run's files and summary, and the reports. A run that was stopped before
    its summary goes on: it is found by what it was to do, and its paid replies aren't asked for again."""
    spark, began = ws.spark, time.monotonic()
    got = lock.load_benchmark(str(ws.root), ws.latest_hash())
    name = spark.range(1).select(T.safe_name(F.lit(candidate.label))).first()[0]
    plan = {"model": candidate.label, "judges": [j.label for j in judges], "scoring_aggregate": settings.scoring_aggregate, "benchmark_hash": got["metadata"]["benchmark_hash"]}
    run = open_run(Path(ws.root) / "runs" / name, plan)
    scope = f"{name}/{run.name}"
    log = call_log(ws, settings, [candidate, *judges], scope)
    make = make or partial(_make, settings, live(settings))
    schema = "task_id string, conversation_id string, category string, cluster_size long, checklist array<string>, prompt string"
    rows = [(t["id"], t[ID], t["category"], t["cluster_size"], t["checklist"], "\n".join(f"{x['role'].upper()}: {x['text']}" for x in t["turns"])) for t in got["tasks"]]
    tasks = spark.createDataFrame(rows, schema)
    answered = cut(J.answers(tasks, "task_id", "prompt", [candidate], log.of("eval-answer").making(make)), "answers")
    full = answered.join(tasks.select(F.col("task_id").alias("_t"), "prompt", "checklist"), F.col("task_id") == F.col("_t")).drop("_t")
    judged = cut(J.judgements(full, ["task_id"], judges, log.of("eval-judge").making(make)), "judgements")
    scores = J.panel_details(judged, ["task_id"], settings.scoring_aggregate)
    scored = cut(scores.join(tasks.select("task_id", ID, "category", "cluster_size"), "task_id"), "scores")
    total = S.overall(scored.withColumn("weight", F.col("cluster_size"))).first()
    spent = ws.calls().where(F.col("scope") == scope).agg(F.coalesce(F.sum("cost_usd"), F.lit(0.0))).first()[0]
    out = [r.asDict(recursive=True) for r in scored.orderBy("task_id").collect()]  # at most 200 tasks
    reports.write_lines(run / "tasks.jsonl", [{"task_id": r[0], "prompt": r[5], "checklist": r[4]} for r in rows])
    reports.write_lines(run / "responses.jsonl", [{"task_id": r.task_id, "response": r.response} for r in answered.orderBy("task_id").collect()])
    reports.write_lines(run / "scores.jsonl", [{k: r[k] for k in ("task_id", ID, "category", "cluster_size", "score", "judge_scores", "judge_spread")} for r in out])
    reports.write_lines(run / "rationales.jsonl", [{k: r[k] for k in ("task_id", "aggregate", "judge_spread", "judges")} for r in out])
    summary = plan | {
        "task_count": len(out),
        "raw_egoscore": total.raw_score, "frequency_weighted_egoscore": total.weighted_score, "per_category": {r.category: r.score for r in S.per_category(scored).orderBy("category").collect()},
        "run_cost_usd": round(spent, 6), "wall_time_seconds": round(time.monotonic() - began, 3), "created_at": run.name,
    }
    (run / "summary.json").write_text(json.dumps(summary, indent=2, sort_keys=True) + "\n", encoding="utf-8")
    reports.render(spark, str(ws.root))
    return {"run_dir": str(run), **summary}
