"""Candidates' answers and judges' scores through model clients, in Arrow batches; roll-ups as aggregates.

`make` functions run on the workers and give a client for a (provider, model); a client is kept for the batch it serves."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..models import FAILURES, answer_of, judgement_of
from ..settings import Model

Make = Callable[[str, str], Callable]


def _models(models: list[Model]) -> Column:
    """A short array of (judge_pos, provider, model, name), for exploding: no cross join."""
    return F.array(*[F.struct(F.lit(i).alias("pos"), F.lit(m.provider).alias("provider"), F.lit(m.model).alias("model"), F.lit(m.label).alias("name")) for i, m in enumerate(models)])


def _fields(rows: DataFrame, *names: str) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name in names)


def answers(tasks: DataFrame, key: str, prompt: str, candidates: list[Model], make: Make) -> DataFrame:
    """key, model, response, input_tokens, output_tokens: every candidate's answer to every prompt. A failed call is an
    empty response, with ok false."""
    rows = tasks.select(key, F.col(prompt).alias("prompt"), F.explode(_models(candidates)).alias("m")).select(key, "prompt", "m.provider", "m.model", "m.name")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        clients: dict = {}
        for f in frames:
            out = []
            for k, text, provider, model, name in zip(f[key], f.prompt, f.provider, f.model, f.name, strict=True):
                if (provider, model) not in clients:
                    clients[provider, model] = make(provider, model)
                ask = clients[provider, model]
                try:
                    got = ask("answer", text or "")
                    out.append((k, name, answer_of(got), got.input_tokens, got.output_tokens, got.billable, True))
                except FAILURES:  # one call's failure is that row's result, counted by ok
                    out.append((k, name, "", 0, 0, False, False))
            yield pd.DataFrame(out, columns=[key, "model", "response", "input_tokens", "output_tokens", "billable", "ok"])

    return rows.mapInPandas(run, f"{_fields(rows, key)}, model string, response string, input_tokens long, output_tokens long, billable boolean, ok boolean")


def judgements(answered: DataFrame, keys: list[str], judges: list[Model], make: Make, prompt: str = "prompt", checklist: str = "checklist", response: str = "response") -> DataFrame:
    """keys, judge_pos, judge, score, strengths, weaknesses, rationale, ok: every judge's view of every response."""
    rows = answered.select(*keys, F.col(prompt).alias("prompt"), F.col(checklist).alias("checklist"), F.col(response).alias("response"), F.explode(_models(judges)).alias("m")).select(*keys, "prompt", "checklist", "response", "m")
    names = [*keys, "judge_pos", "judge", "score", "strengths", "weaknesses", "rationale", "ok", "input_tokens", "output_tokens", "billable"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        clients: dict = {}
        for f in frames:
            out = []
            for row in f.to_dict("records"):
                m = row["m"]
                at = m["provider"], m["model"]
                if at not in clients:
                    clients[at] = make(*at)
                try:
                    got = clients[at]("judge", {"task": row["prompt"], "checklist": list(row["checklist"]), "response": row["response"] or ""})
                    text, used = got.text, (got.input_tokens, got.output_tokens, got.billable)
                except FAILURES:  # a judge that can't be reached has ok false, like one that can't be read
                    text, used = None, (0, 0, False)
                j = judgement_of(text)
                out.append((*(row[k] for k in keys), m["pos"], m["name"], j["score"], j["strengths"], j["weaknesses"], j["rationale"], j["ok"], *used))
            yield pd.DataFrame(out, columns=names)

    return rows.mapInPandas(run, f"{_fields(rows, *keys)}, judge_pos int, judge string, score long, strengths array<string>, weaknesses array<string>, rationale string, ok boolean, input_tokens long, output_tokens long, billable boolean")


def panel_details(judged: DataFrame, keys: list[str], method: str = "mean") -> DataFrame:
    """keys, score (4 places), judge_spread, judge_scores, judges: one row for each response. Judges that failed are left out
    of score and spread unless all did; the map and the details, in panel order, have them all."""
    good, mid = F.when(F.col("ok"), F.col("score")), F.avg if method == "mean" else F.median
    detail = F.array_sort(F.collect_list(F.struct("judge_pos", "judge", "score", "strengths", "weaknesses", "rationale", "ok")))
    rows = judged.groupBy(*keys).agg(
        F.round(F.coalesce(mid(good), mid("score"), F.lit(5.0)), 4).alias("score"),
        F.coalesce(F.max(good) - F.min(good), F.max("score") - F.min("score")).alias("judge_spread"), detail.alias("judges"))
    return rows.withColumn("judge_scores", F.map_from_arrays("judges.judge", "judges.score")).withColumn("aggregate", F.lit(method))

