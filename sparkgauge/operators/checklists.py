"""Checklists by a panel of models, merged by one: a few tasks a call, routed by task id."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import plain as P
from ..models import FAILURES
from ..ranks import row_numbers
from ..replies import parse_json_object
from ..settings import Model
from .judging import Make

BATCH = 5
META = ("task_family", "domain", "skills", "difficulty", "specificity")
DEFAULTS = {"task_family": "General assistance", "domain": "General", "skills": ["instruction following"], "difficulty": "medium", "specificity": "generalizable"}


def batches(rows: DataFrame, key: str, size: int = BATCH) -> DataFrame:
    """Adds `batch`: consecutive rows in key order, `size` each; the same however the rows are dealt."""
    return row_numbers(rows, [key], name="_n").withColumn("batch", F.floor(F.col("_n") / size)).drop("_n")


def _routed(text: str, ids: list[str]) -> dict[str, list[str]]:
    """Items by task id out of a reply: ids that were not asked for are left out, items are cleaned, at most ten."""
    raw = parse_json_object(text).get("checklists")
    if not isinstance(raw, list):
        raise ValueError("checklists must be a list")
    got = {}
    for entry in raw:
        if isinstance(entry, dict) and str(entry.get("conversation_id") or "") in ids and isinstance(entry.get("items"), list):
            items = [s for s in (str(x).strip() for x in entry["items"]) if s][:10]
            if items:
                got[str(entry["conversation_id"])] = items
    return got


def _payload(row: dict, key: str, text: str) -> dict:
    given = {k: row.get(k) for k in META if row.get(k) is not None}
    return {"conversation_id": str(row[key]), "metadata": DEFAULTS | {k: list(v) if k == "skills" else v for k, v in given.items()}, "task": row[text] or ""}


def panel_items(tasks: DataFrame, key: str, text: str, panel: list[Model], make: Make) -> DataFrame:
    """key, panel_pos, judge, items, ok: each panel model's items of each task. A failed call, or a task left out of the
    reply, gets the default checklist."""
    kept = [c for c in tasks.columns if c in (key, text, *META)]
    rows = batches(tasks.select(*kept), key).withColumn("m", F.explode(F.array(*[F.struct(F.lit(i).alias("pos"), F.lit(m.provider).alias("provider"), F.lit(m.model).alias("model"), F.lit(m.label).alias("name")) for i, m in enumerate(panel)])))
    rows = rows.select("batch", *kept, "m.pos", "m.provider", "m.model", "m.name")

    def call(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values(key)
        tasks_ = f.to_dict("records")
        try:
            reply = make(f.provider.iloc[0], f.model.iloc[0])("checklist", [_payload(t, key, text) for t in tasks_])
            got, ok = _routed(reply.text, [str(t[key]) for t in tasks_]), True
        except FAILURES:
            got, ok = {}, False
        return pd.DataFrame({key: f[key], "panel_pos": f.pos, "judge": f.name, "items": [got.get(str(t[key])) or P.checklist(t[text] or "") for t in tasks_], "ok": ok})

    kind = tasks.schema[key].dataType.simpleString()
    return rows.groupBy("batch", "pos").applyInPandas(call, f"`{key}` {kind}, panel_pos int, judge string, items array<string>, ok boolean")


def merged_items(tasks: DataFrame, items: DataFrame, key: str, text: str, model: Model, make: Make) -> DataFrame:
    """key, checklist, ok: panel items merged by a model; where it fails, those items without repeats."""
    nested = items.groupBy(F.col(key).alias("_k")).agg(F.array_sort(F.collect_list(F.struct("panel_pos", "judge", "items"))).alias("panel"))
    kept = [c for c in tasks.columns if c in (key, text, *META)]
    rows = batches(tasks.select(*kept).join(nested, F.col(key) == F.col("_k"), "left").drop("_k"), key)

    def call(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values(key)
        tasks_ = f.to_dict("records")
        panels = [{p["judge"]: list(p["items"]) for p in t["panel"]} if t["panel"] is not None else {} for t in tasks_]
        own = [P.spelled_once((i for xs in p.values() for i in xs), 10) or P.checklist(t[text] or "") for p, t in zip(panels, tasks_, strict=True)]
        try:
            reply = make(model.provider, model.model)("merge", [_payload(t, key, text) | {"panel_items": p} for t, p in zip(tasks_, panels, strict=True)])
            got, ok = _routed(reply.text, [str(t[key]) for t in tasks_]), True
        except FAILURES:
            got, ok = {}, False
        return pd.DataFrame({key: f[key], "checklist": [P.spelled_once(got.get(str(t[key])) or o, 10) for t, o in zip(tasks_, own, strict=True)], "ok": ok})

    return rows.groupBy("batch").applyInPandas(call, f"`{key}` {tasks.schema[key].dataType.simpleString()}, checklist array<string>, ok boolean")
