"""Turns to tasks: first prompts, prompt text up to the last user turn, the non-task filter."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def first_user_text(turns: DataFrame) -> DataFrame:
    """conv_id, first_user_text ('' where no user turn has text)."""
    t = T.stripped("text")
    said = (T.normalize_role(F.col("role")) == "user") & (t != "")
    return turns.groupBy("conv_id").agg(F.coalesce(F.min_by(F.when(said, t), F.when(said, F.col("turn"))), F.lit("")).alias("first_user_text"))


def prompts(turns: DataFrame) -> DataFrame:
    """conv_id, prompt: 'ROLE: text' lines through the last user turn, or the first turn alone."""
    role = T.normalize_role(F.col("role"))
    line = F.concat(F.upper(role), F.lit(": "), F.col("text"))
    rows = turns.groupBy("conv_id").agg(F.max(F.when(role == "user", F.col("turn"))).alias("last"), F.min("turn").alias("first"), F.array_sort(F.collect_list(F.struct("turn", line.alias("line")))).alias("lines"))
    kept = F.filter("lines", lambda x: x["turn"] <= F.coalesce(F.col("last"), F.col("first")))
    return rows.select("conv_id", F.array_join(F.transform(kept, lambda x: x["line"]), "\n").alias("prompt"))


def task_flags(prompt_rows: DataFrame, text: str = "prompt") -> DataFrame:
    """Adds is_task (0/1): whatever isn't an obvious non-task is kept, as the offline model keeps it."""
    return prompt_rows.withColumn("is_task", (~T.obvious_nontask(F.col(text))).cast("int"))


def role_counts(turns: DataFrame) -> DataFrame:
    return turns.where(T.stripped("text") != "").groupBy(T.normalize_role(F.col("role")).alias("role")).agg(F.count("*").alias("n"))


def upsert_conversations(old: DataFrame, new: DataFrame, key: str = "conversation_id", order: str = "pos") -> DataFrame:
    """Replace rows of old by key; of rows of new with one key the last by `order` stays."""
    last = new.groupBy(key).agg(F.max_by(F.struct(*[c for c in new.columns if c != key]), order).alias("r")).select(key, "r.*").drop(order)
    return old.join(last.select(key), key, "left_anti").unionByName(last, allowMissingColumns=True)
