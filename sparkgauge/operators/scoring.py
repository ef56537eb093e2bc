"""Checklists, judge panels, scores, leaderboards."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def checklist_items(rows: DataFrame, key: str, text: str) -> DataFrame:
    """key, pos, item: the five default items of each task."""
    last = F.concat(F.lit("Covers the main "), F.lower(T.label(F.col(text))), F.lit(" considerations"))
    return rows.select(key, F.posexplode(F.array(*[F.lit(x) for x in T.CHECKLIST], last)).alias("pos", "item"))


def merge_items(items: DataFrame, key: str, limit: int = 10) -> DataFrame:
    """Of rows (key, panel_pos, pos, item) the first of each text (case and spaces apart), at most `limit`, numbered."""
    norm = F.lower(T.collapse("item"))
    first = items.where(norm != "").groupBy(key, norm.alias("norm")).agg(F.min(F.struct("panel_pos", "pos", "item")).alias("s"))
    w = Window.partitionBy(key).orderBy("s.panel_pos", "s.pos")
    return first.withColumn("n", F.row_number().over(w)).where(F.col("n") <= limit).select(key, F.col("n").cast("long").alias("pos"), T.stripped("s.item").alias("item"))


def panel(scores: DataFrame, task: str, method: str = "mean") -> DataFrame:
    """task, consensus (4 places), spread, judges: of rows (task, judge, score, ok). Failed judges are left out unless
    all failed."""
    good = F.when(F.col("ok"), F.col("score"))
    mid = F.avg if method == "mean" else F.median
    both = scores.groupBy(task).agg(
        F.round(F.coalesce(mid(good), mid("score"), F.lit(5.0)), 4).alias("consensus"),
        F.coalesce(F.max(good) - F.min(good), F.max("score") - F.min("score")).cast("double").alias("spread"), F.count("*").alias("judges"))
    return both


def overall(scores: DataFrame, by: list[str] | None = None) -> DataFrame:
    """raw and weighted score (4 places) of rows (score, weight)."""
    w = F.greatest(F.coalesce("weight", F.lit(1)), F.lit(1))
    return scores.groupBy(*(by or [])).agg(F.coalesce(F.round(F.avg("score"), 4), F.lit(0.0)).alias("raw_score"), F.coalesce(F.round(F.sum(F.col("score") * w) / F.sum(w), 4), F.lit(0.0)).alias("weighted_score"), F.count("*").alias("n_tasks"))


def per_category(scores: DataFrame) -> DataFrame:
    c = F.when(F.coalesce(F.trim("category"), F.lit("")) == "", "General").otherwise(F.col("category"))
    return scores.groupBy(c.alias("category")).agg(F.round(F.avg("score"), 4).alias("score"), F.count("*").alias("n_tasks"))


def combined_categories(scores: DataFrame, run: str) -> DataFrame:
    """category, score: the unweighted mean over runs of their means (4 places each) in the category."""
    c = F.when(F.coalesce(F.trim("category"), F.lit("")) == "", "General").otherwise(F.col("category"))
    means = scores.groupBy(run, c.alias("category")).agg(F.round(F.avg("score"), 4).alias("s"))
    return means.groupBy("category").agg(F.round(F.avg("s"), 4).alias("score"), F.count("*").alias("n_runs"))


def report_kpis(runs: DataFrame, name: str) -> DataFrame:
    """One row: runs, models, the best run and its score, what all runs cost and took."""
    best = F.max_by(F.struct(F.col(name).alias("m"), F.col("weighted_score").alias("s")), F.struct("weighted_score", (-F.col("place")).alias("p")))
    return runs.agg(F.count("*").alias("n_runs"), F.countDistinct(name).alias("n_models"), best.alias("b"), F.round(F.sum("run_cost_usd"), 6).alias("total_cost"), F.sum("wall_time_seconds").cast("double").alias("total_wall")).select(
        "n_runs", "n_models", F.col("b.m").alias("top_model"), F.col("b.s").alias("top_score"), "total_cost", "total_wall")


def display_labels(runs: DataFrame) -> DataFrame:
    """Adds label: the model, with the run's folder (or its time) where a model has several runs."""
    several = runs.groupBy(F.col("model").alias("_m")).agg((F.count("*") > 1).alias("several"))
    tail = F.coalesce(F.nullif(F.trim(F.regexp_extract("_path", "([^/]+)/*$", 1)), F.lit("")), F.nullif(F.trim("created_at"), F.lit("")))
    label = F.when(F.col("several") & tail.isNotNull(), F.concat("model", F.lit(" · "), tail)).otherwise(F.col("model"))
    return runs.join(several, F.col("model") == F.col("_m")).withColumn("label", label).drop("_m", "several")


def leaderboard(runs: DataFrame, name: str) -> DataFrame:
    """Adds the place by weighted score; ties by name."""
    return runs.withColumn("place", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.desc("weighted_score"), name)).cast("long"))


def distribution(rows: DataFrame, column: str, kind: str) -> DataFrame:
    v = F.coalesce(F.nullif(F.trim(F.col(column).cast("string")), F.lit("")), F.lit("Unknown"))
    return rows.groupBy(v.alias("key")).agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "key", "n")
