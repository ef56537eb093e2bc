"""Task families: annotations, canonical labels, importance, and the family-aware sample."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import plain as P
from ..functions import text as T
from ..models import FAILURES
from ..replies import parse_json_object
from ..ranks import row_numbers
from ..storage import cut


def annotate(rows: DataFrame, text: str) -> DataFrame:
    """Adds label, family, domain, family_id, difficulty, specificity as the offline annotator gives them."""
    t = F.col(text)
    out = rows.withColumn("label", T.label(t)).withColumn("family", T.family_label(t, F.col("label"))).withColumn("domain", T.domain(t))
    return out.withColumns({"family_id": T.family_id(F.col("family"), F.col("domain")), "difficulty": T.difficulty(t), "specificity": T.specificity(t)})


FITS, DIFFICULTIES, SPECIFICITIES = ("strong", "weak"), ("easy", "medium", "hard"), ("generalizable", "narrow", "one_off")
ANNOTATION = "family string, domain string, skills array<string>, family_fit string, difficulty string, specificity string, ok boolean"


def _fallback_meta(texts: list[str]) -> dict:
    """A batch's family, domain and skills out of its texts together."""
    joined = " ".join(texts)
    return {"task_family": P.family(joined, P.FALLBACK), "domain": P.domain(joined), "skills": P.skills(None, joined)}


def _annotated(raw: dict | None, text: str, meta: dict) -> tuple:
    """One task's annotation: the model's value, else the batch's, else the text's. ok: the model gave one."""
    got = raw if isinstance(raw, dict) else {}
    return (
        P.clean(got.get("task_family")) or P.clean(meta.get("task_family")) or P.family(text, P.FALLBACK), P.clean(got.get("domain")) or P.clean(meta.get("domain")) or P.domain(text),
        P.skills(got.get("skills"), text) if got else list(meta.get("skills") or P.skills(None, text)), P.controlled(got.get("family_fit"), FITS, "strong"),
        P.controlled(got.get("difficulty"), DIFFICULTIES, P.difficulty(text)), P.controlled(got.get("specificity"), SPECIFICITIES, P.specificity(text)), isinstance(raw, dict),
    )


def annotate_with_model(rows: DataFrame, key: str, text: str, group: str, make: Callable[[], Callable], batch: int = 8) -> DataFrame:
    """key, ANNOTATION: a model annotates `batch` tasks of one group a call. `make` gives the client, on the worker. A task
    that the reply leaves out gets its batch's family, domain and skills; after a failed call those come from the batch's
    texts. Null group: 0."""
    tasks = rows.select(F.col(key), F.coalesce(F.col(text), F.lit("")).alias("_text"), F.coalesce(F.col(group).cast("long"), F.lit(0)).alias("_group"))
    batched = row_numbers(tasks, [key], ["_group"], "_n").withColumn("_batch", F.floor(F.col("_n") / batch))

    def call(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values(key)
        keys, texts = [str(k) for k in f[key]], f["_text"].tolist()
        meta, by_id = _fallback_meta(texts), {}
        try:
            reply = parse_json_object(make()("annotate", [{"conversation_id": k, "task": t} for k, t in zip(keys, texts, strict=True)]).text)
            given = reply.get("annotations", [])
            if not isinstance(given, list):
                raise ValueError("annotations must be a list")
            by_id = {P.clean(x.get("conversation_id")): x for x in given if isinstance(x, dict)}
            of = reply.get("group")
            if isinstance(of, dict):
                meta = {k: P.clean(of.get(k)) or meta[k] for k in ("task_family", "domain")} | {"skills": P.skills(of.get("skills"), " ".join(texts))}
        except FAILURES:  # ok is false for all of the batch
            by_id = {}
        out = [(k, *_annotated(by_id.get(i), t, meta)) for k, i, t in zip(f[key], keys, texts, strict=True)]
        return pd.DataFrame(out, columns=[key, *[x.split()[0] for x in ANNOTATION.split(", ")]])

    return batched.groupBy("_group", "_batch").applyInPandas(call, f"`{key}` {rows.schema[key].dataType.simpleString()}, {ANNOTATION}")


#: Parts of a group that are cut to its first rows before the group is.
SALTS = 64


def first_rows(rows: DataFrame, by: list[str], order: list[Column], limit: int, salt: str) -> DataFrame:
    """The first `limit` rows of each group in `order`. A group is cut in parts by `salt` first, so that no task sorts all rows of
    one; from there on it has at most SALTS * limit."""
    part = F.pmod(F.xxhash64(salt), F.lit(SALTS))
    cut_once = rows.withColumn("_part", part).withColumn("_at", F.row_number().over(Window.partitionBy(*by, "_part").orderBy(*order))).where(F.col("_at") <= limit)
    return cut_once.withColumn("_at", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_at") <= limit).drop("_at", "_part")


def top_values(rows: DataFrame, by: str, value: str, order: str, limit: int) -> DataFrame:
    """by, values: the `limit` most frequent distinct cleaned values, of equal counts the first seen first."""
    v = T.clean_text(value)
    counts = rows.where(v != "").groupBy(by, v.alias("v")).agg(F.count("*").alias("n"), F.min(order).alias("p"))
    top = first_rows(counts, [by], [F.desc("n"), F.col("p"), F.col("v")], limit, "v")
    return top.groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "p", "v"))), lambda x: x["v"]).alias("values"))


def label_payload(annotated: DataFrame, key: str) -> DataFrame:
    """label, count, domains, skills (a model's input for the canonical map): the three most frequent domains and six skills."""
    annotated = cut(annotated.select(key, "family", "domain", "skills"), "labelled")  # read three times below, made of whole texts
    counts = annotated.groupBy(F.col("family").alias("label")).agg(F.count("*").alias("count"))
    domains = top_values(annotated, "family", "domain", key, 3).select(F.col("family").alias("l1"), F.col("values").alias("domains"))
    one = annotated.select(key, "family", F.posexplode("skills").alias("i", "skill")).withColumn("at", F.struct(key, "i"))
    skills = top_values(one, "family", "skill", "at", 6).select(F.col("family").alias("l2"), F.col("values").alias("skills"))
    none = F.array().cast("array<string>")
    joined = counts.join(domains, F.col("label") == F.col("l1"), "left").join(skills, F.col("label") == F.col("l2"), "left")
    return joined.select("label", "count", F.coalesce("domains", none).alias("domains"), F.coalesce("skills", none).alias("skills"))


def model_claims(labels: DataFrame, make: Callable[[], Callable], batch: int = 120) -> DataFrame:
    """pos, family, domain, label: a model's claims which labels belong to one family, `batch` labels a call, for
    canonical_map. One label needs no call. A failed call claims nothing, so its labels stay themselves."""
    dealt = row_numbers(labels, ["label"], name="_n").withColumn("_batch", F.floor(F.col("_n") / batch))

    def call(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("label")
        known, out = set(f.label), []
        try:
            reply = parse_json_object(make()("canonical", [{"label": a, "count": int(b), "domains": list(c), "skills": list(d)} for a, b, c, d in zip(f["label"], f["count"], f["domains"], f["skills"], strict=True)]).text)
            for x in reply.get("families", []):
                name = P.clean(x.get("task_family")) if isinstance(x, dict) else ""
                out += [(name, P.clean(x.get("domain")), s) for s in x.get("source_labels", []) if s in known] if name else []
        except FAILURES:
            out = []
        at = int(f["_batch"].iloc[0]) << 20
        return pd.DataFrame([(at + i, *x) for i, x in enumerate(out)], columns=["pos", "family", "domain", "label"])

    return dealt.groupBy("_batch").applyInPandas(call, "pos long, family string, domain string, label string")


def top_families(rows: DataFrame, key: str, limit: int = 5) -> DataFrame:
    """family, n of the largest families; of equal ones the first seen."""
    return rows.groupBy("family").agg(F.count("*").alias("n"), F.min(key).alias("_p")).orderBy(F.desc("n"), "_p").limit(limit).drop("_p")


def totals(rows: DataFrame, key: str, dup: str) -> DataFrame:
    """One row: tasks, families, raw labels, and how many near duplicates a sample passes over."""
    group = F.coalesce(F.col(dup).cast("string"), F.concat(F.lit("id:"), F.col(key).cast("string")))
    return rows.agg(F.count("*").alias("n_tasks"), F.countDistinct("family_id").alias("n_families"), F.countDistinct("family").alias("n_labels"), (F.count("*") - F.countDistinct(group)).alias("n_suppressed"))


def canonical_map(annotated: DataFrame, key: str, claims: DataFrame | None = None) -> DataFrame:
    """label_key, family: one canonical family for each normalised raw label. claims(pos, family, label) come from a
    model; the first claim of a label wins. Labels that no claim names are their own family, in the spelling that is
    most frequent (ties: more tokens, then the later text)."""
    norm = F.array_join(T.family_tokens(F.col("family")), " ")
    spelled = annotated.groupBy(norm.alias("label_key"), "family").agg(F.count("*").alias("n"))
    own = spelled.groupBy("label_key").agg(F.max_by("family", F.struct("n", F.size(T.family_tokens(F.col("family"))).alias("k"), "family")).alias("family"))
    if claims is None:
        return own
    first = claims.groupBy(F.array_join(T.family_tokens(F.col("label")), " ").alias("label_key")).agg(F.min_by("family", "pos").alias("family"))
    return first.unionByName(own.join(first.select("label_key"), "label_key", "left_anti"))


def canonical_families(annotated: DataFrame, key: str) -> DataFrame:
    """family_id, family, domain (most frequent, of ties the first seen), n_tasks, n_labels."""
    norm = F.array_join(T.family_tokens(F.col("family")), " ")
    rows = annotated.withColumn("label_key", norm)
    names = canonical_map(annotated, key).withColumnRenamed("family", "name")
    joined = rows.join(names, "label_key", "left").withColumn("name", F.coalesce("name", "family"))
    domains = joined.groupBy("name", "domain").agg(F.count("*").alias("n"), F.min(key).alias("p"))
    top = domains.groupBy("name").agg(F.max_by("domain", F.struct(F.col("n"), (-F.col("p")).alias("q"))).alias("domain"))
    sizes = joined.groupBy("name").agg(F.count("*").alias("n_tasks"), F.countDistinct("family").alias("n_labels"))
    return top.join(sizes, "name").select(T.family_id(F.col("name"), F.col("domain")).alias("family_id"), F.col("name").alias("family"), "domain", "n_tasks", "n_labels")


def distinct_skills(skills: DataFrame, key: str, limit: int = 8) -> DataFrame:
    """key, skills: of rows (key, pos, skill) the first spelling of each, in order, at most `limit`."""
    n = F.lower(T.collapse("skill"))
    first = skills.where(n != "").groupBy(key, n.alias("norm")).agg(F.min(F.struct("pos", "skill")).alias("s"))
    return first.groupBy(key).agg(F.transform(F.slice(F.array_sort(F.collect_list("s")), 1, limit), lambda s: F.substring(s["skill"], 1, 80)).alias("skills"))


def family_key(rows: DataFrame) -> Column:
    """A task's family for counting: its id, else its name, else the general one; blanks count as missing."""
    given = [F.nullif(F.trim(F.col(c)), F.lit("")) for c in ("task_family_id", "task_family") if c in rows.columns]
    return F.coalesce(*given, F.lit("General assistance"))


def weight_of(difficulty: Column) -> Column:
    d, out = F.coalesce(difficulty, F.lit("medium")), F.lit(1.0)
    for name, w in T.DIFFICULTY_WEIGHT.items():
        out = F.when(d == name, w).otherwise(out)
    return out


def family_importance(rows: DataFrame, key: str, dup: str) -> DataFrame:
    """family_id, family (modal label), family_size, diversity, family_importance in [0, 1]."""
    sizes = rows.groupBy("family_id").agg(F.count("*").alias("family_size"), F.countDistinct(F.coalesce(F.col(dup).cast("string"), F.concat(F.lit("id:"), F.col(key).cast("string")))).alias("diversity"), F.avg(weight_of(F.col("difficulty"))).alias("w"))
    labels = rows.groupBy("family_id", "family").agg(F.count("*").alias("n")).groupBy("family_id").agg(F.max_by("family", F.struct("n", "family")).alias("family"))
    scored = sizes.withColumn("raw", (0.35 * F.log1p("family_size") + 0.65 * F.log1p("diversity")) * F.col("w"))
    scored = cut(scored, "importance")
    top = scored.agg(F.max("raw").alias("top"))  # one row
    share = F.when(F.col("top") == 0, 0.0).otherwise(F.round(F.col("raw") / F.col("top"), 6))
    return scored.join(F.broadcast(top)).withColumn("family_importance", share).join(labels, "family_id").select("family_id", "family", "family_size", "diversity", "family_importance")


def rank_columns(key: str, seed: int) -> list[Column]:
    """What rows of a group are ranked by, each ascending."""
    spec = F.when(F.col("specificity") == "generalizable", 0).when(F.col("specificity") == "one_off", 2).otherwise(1)
    return [spec, F.when(F.col("difficulty").isin("medium", "hard"), 0).otherwise(1), -F.coalesce("dup_size", F.lit(1)), T.stable_tie(seed, F.col(key))]


def best_of_duplicates(rows: DataFrame, key: str, seed: int) -> DataFrame:
    """One row of each dup_group (null: a group of its own): a least row, pre-aggregated before the shuffle."""
    group = F.coalesce(F.col("dup_group").cast("string"), F.concat(F.lit("id:"), F.col(key).cast("string")))
    best = F.min_by(F.struct(*rows.columns), F.struct(*[c.alias(f"r{i}") for i, c in enumerate(rank_columns(key, seed))]))
    return rows.groupBy(group.alias("_g")).agg(best.alias("_best")).select("_best.*")


def sample(rows: DataFrame, key: str, target_n: int, cap: int = 5, long_tail: float = 0.20, seed: int = 42) -> DataFrame:
    """The family-aware sample of rows (key, family_id, family_size, family_importance, specificity, difficulty,
    dup_group, dup_size). Three passes: one row of each recurring family by importance; the long
    tail's quota from families of at most two; then the rest by how much of the family is in, up to `cap`."""
    rows = cut(rows, "tasks")  # read several times below
    target = min(target_n, rows.count())
    quota = 0 if target <= 1 or long_tail <= 0 else max(1, int(target * long_tail))
    best = cut(best_of_duplicates(rows, key, seed), "best")
    imp, size = F.coalesce("family_importance", F.lit(0.0)), F.col("family_size")
    fam = best.groupBy("family_id").agg(F.count("*").alias("n"), F.max(imp).alias("imp"), F.max(F.coalesce(size, F.lit(1))).alias("smax"), F.min(F.coalesce(size, F.lit(1))).alias("smin"), F.max(size).alias("known"))
    fam = cut(fam.withColumn("osize", F.coalesce("known", "n")), "families")
    # Each pass takes families by place over ranges of its order, so a target may be of any size.
    taken = lambda rows, order, n: cut(row_numbers(rows, order, name="_place").where(F.col("_place") < n).select("family_id"), "pass")
    first_pass = taken(fam.where(F.col("smax") >= 2).select("family_id", "imp", "osize"), [F.desc("imp"), F.desc("osize"), F.col("family_id")], target if cap > 0 else 0)
    n_first = first_pass.count()
    once = fam.join(first_pass.select(F.col("family_id").alias("of"), F.lit(1).alias("a")), F.col("family_id") == F.col("of"), "left").withColumn("a", F.coalesce("a", F.lit(0)))
    fit = once.where((F.col("smax") <= 2) & (F.col("a") < cap) & (F.col("n") > F.col("a"))).select("family_id", "smin", "imp")
    second = taken(fit, [F.col("smin"), F.desc("imp"), F.col("family_id")], max(0, min(quota, target - n_first)))
    left_over = target - n_first - second.count()
    chosen = first_pass.unionByName(second).groupBy(F.col("family_id").alias("of")).agg(F.count("*").alias("ab"))
    fam = fam.join(chosen, F.col("family_id") == F.col("of"), "left").select("family_id", F.coalesce("ab", F.lit(0)).alias("ab"))
    # A family gives at most two rows by rank (the passes above), and to the fill at most cap others by importance: its first few by
    # both orders are all that can be taken.
    ranks = rank_columns(key, seed)
    few = lambda order, n: first_rows(best, ["family_id"], order, n, key)
    heads = few(ranks, 2).unionByName(few([imp.desc(), *ranks], max(cap, 0) + 2)).dropDuplicates([key])
    j = heads.withColumn("rn", F.row_number().over(Window.partitionBy("family_id").orderBy(*ranks))).join(fam, "family_id")
    first = j.where("rn <= ab").select(key, "family_id")
    left = j.where("rn > ab").withColumn("rest", F.row_number().over(Window.partitionBy("family_id").orderBy(imp.desc(), *ranks))).where(F.col("rest") <= cap - F.col("ab"))
    order = [F.col("ab"), imp.desc(), *ranks]
    fill = row_numbers(left.select(key, "family_id", "ab", "family_importance", "specificity", "difficulty", "dup_size"), [*order, F.col(key)], name="_place").where(F.col("_place") < max(left_over, 0))
    return first.unionByName(fill.select(key, "family_id"))
