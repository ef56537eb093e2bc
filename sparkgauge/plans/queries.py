"""The registered queries over the test tables."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import models as M
from ..functions import text as T
from ..operators import conversations as C
from ..operators import families as A
from ..operators import pricing as P
from ..operators import scoring as S
from ..operators import checklists as K
from ..operators import density as D
from ..operators import judging as J
from ..operators import vectors as V
from ..settings import Model
from ..sources import exports as E
from ..storage import cut, shared_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}

#: Prompts that the generated tables lack, so that every branch of the text rules is met.
SAMPLES = (
    (-1, "Thank you!"), (-2, "  Are you there "), (-3, ""), (-4, "OK."), (-5, "Translate my letter to French please"), (-6, "Write python code for a small api that sorts names"),
    (-7, "Draft an email about the following meeting for the whole team of people today"), (-8, "foo-bar a1b x"), (-9, "a1b_c2 of things"), (-10, "Fix grammar"), (-11, "ping"), (-12, "one\ntwo\nthree lines of words for our test"),
)
MODELS = (("openai", "gpt-5-5"), ("anthropic", "claude-opus-4-8"), ("openai", "GPT-5"), ("xai", "grok-4.9"), ("gemini", "gemini-3.5-flash-x"), ("openrouter", "anthropic/claude-sonnet-4"), (None, "nobody-1"), ("anthropic", "claude-opus-4-6"))


def query(f):
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def prompts_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("prompt"))
    return docs.unionByName(spark.createDataFrame(SAMPLES, "doc_id long, prompt string"))


def tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as annotated tasks with their near-duplicate groups, family sizes and importance."""
    docs = table(spark, sf_dir, "documents")
    groups = V.near_duplicate_groups(docs, "doc_id", "text").select("doc_id", F.col("root").alias("dup_group"), F.col("group_size").alias("dup_size"))
    rows = cut(A.annotate(docs.select("doc_id", "text"), "text").drop("text").join(groups, "doc_id"), "annotated")
    return rows.join(A.family_importance(rows, "doc_id", "dup_group").select("family_id", "family_size", "family_importance"), "family_id")


@query
def first_user_text(spark, sf_dir):
    return C.first_user_text(table(spark, sf_dir, "conversations"))


@query
def conversation_prompts(spark, sf_dir):
    return C.prompts(table(spark, sf_dir, "conversations"))


@query
def role_normalised_counts(spark, sf_dir):
    return C.role_counts(table(spark, sf_dir, "conversations"))


@query
def nontask_filter(spark, sf_dir):
    return C.task_flags(prompts_of(spark, sf_dir)).select("doc_id", "is_task")


@query
def text_annotations(spark, sf_dir):
    return A.annotate(prompts_of(spark, sf_dir), "prompt").select("doc_id", "label", "family", "domain", "difficulty", "specificity")


@query
def task_class_counts(spark, sf_dir):
    """The minimal slice: first prompts, the filter, classes, counts."""
    rows = C.task_flags(C.first_user_text(table(spark, sf_dir, "conversations")), "first_user_text").where("is_task = 1")
    return A.annotate(rows, "first_user_text").groupBy("domain", "difficulty").agg(F.count("*").alias("n"))


@query
def token_signature_groups(spark, sf_dir):
    return V.signature_groups(C.first_user_text(table(spark, sf_dir, "conversations")), "conv_id", "first_user_text")


@query
def family_ids(spark, sf_dir):
    return A.annotate(prompts_of(spark, sf_dir), "prompt").select("doc_id", "family", "family_id")


@query
def hashed_embeddings(spark, sf_dir):
    return V.hashed_embeddings(table(spark, sf_dir, "documents"), "doc_id", "text").select("doc_id", "dim", F.round("v", 9).alias("v"))


@query
def near_duplicate_pairs(spark, sf_dir):
    vecs = cut(V.embedded(table(spark, sf_dir, "documents"), "doc_id", "text"), "vectors")  # read several times
    return V.cosine_pairs(vecs, "doc_id", "vec", 0.90).select("a", "b", F.round("sim", 6).alias("sim"))


@query
def near_duplicate_groups(spark, sf_dir):
    return V.near_duplicate_groups(table(spark, sf_dir, "documents"), "doc_id", "text").select("doc_id", "group_id", "group_size")


@query
def vector_neighbours(spark, sf_dir):
    return V.cosine_pairs(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 0.40).select("a", "b", F.round("sim", 6).alias("sim"))


@query
def family_importance(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    groups = V.near_duplicate_groups(docs, "doc_id", "text").select("doc_id", F.col("root").alias("dup_group"))
    rows = cut(A.annotate(docs.select("doc_id", "text"), "text").drop("text").join(groups, "doc_id"), "annotated")  # read twice
    return A.family_importance(rows, "doc_id", "dup_group")


@query
def canonical_families(spark, sf_dir):
    return A.canonical_families(A.annotate(prompts_of(spark, sf_dir), "prompt"), "doc_id")


@query
def best_per_duplicate_group(spark, sf_dir):
    return A.best_of_duplicates(tasks(spark, sf_dir), "doc_id", 42).select("doc_id", "dup_group")


@query
def benchmark_sample(spark, sf_dir):
    return A.sample(tasks(spark, sf_dir), "doc_id", 100)


@query
def checklist_items(spark, sf_dir):
    rows = prompts_of(spark, sf_dir)
    items = S.checklist_items(rows, "doc_id", "prompt")
    panel = items.withColumn("panel_pos", F.lit(0)).unionByName(items.withColumn("panel_pos", F.lit(1)).withColumn("item", F.upper("item")))
    return S.merge_items(panel, "doc_id")


@query
def benchmark_distributions(spark, sf_dir):
    rows = A.annotate(prompts_of(spark, sf_dir), "prompt")
    parts = [S.distribution(rows, c, c) for c in ("domain", "difficulty", "specificity", "family")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@query
def recorded_judge_scores(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").where(T.normalize_role(F.col("role")) == "assistant")
    return turns.select("conv_id", "turn", T.recorded_score(F.col("text")).alias("score"))


def _panel_rows(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select("user_id", F.col("event_type").alias("judge"), F.greatest(F.lit(1), F.least(F.lit(10), F.floor(F.col("value") / 49) + 1)).cast("double").alias("score"), (F.col("event_id") % 7 != 0).alias("ok"))


@query
def panel_consensus_mean(spark, sf_dir):
    return S.panel(_panel_rows(spark, sf_dir), "user_id", "mean")


@query
def panel_consensus_median(spark, sf_dir):
    return S.panel(_panel_rows(spark, sf_dir), "user_id", "median")


def _scored(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    first = C.first_user_text(turns)
    group = V.signature_groups(first, "conv_id", "first_user_text").select("conv_id", F.col("group_size").alias("weight"))
    cats = first.select("conv_id", T.label(F.col("first_user_text")).alias("category"))
    return recorded_judge_scores(spark, sf_dir).join(group, "conv_id").join(cats, "conv_id")


@query
def overall_scores(spark, sf_dir):
    return S.overall(_scored(spark, sf_dir))


@query
def per_category_scores(spark, sf_dir):
    return S.per_category(_scored(spark, sf_dir))


def _runs(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select(F.col("source").alias("model"), "doc_id", "text", T.recorded_score(F.col("text")).alias("score"), (1 + F.col("doc_id") % 3).alias("weight"))


@query
def leaderboard(spark, sf_dir):
    return S.leaderboard(S.overall(_runs(spark, sf_dir), ["model"]), "model")


@query
def run_details(spark, sf_dir):
    r = _runs(spark, sf_dir)
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("long").alias("quality"))
    return r.join(labels, "doc_id", "left").select("doc_id", "model", T.preview(F.col("text")).alias("preview"), T.score_display(F.col("score")).alias("shown"), T.score_tier(F.col("score")).alias("tier"), "quality")


@query
def cost_ledger(spark, sf_dir):
    t = table(spark, sf_dir, "conversations")
    role = T.normalize_role(F.col("role"))
    calls = t.select(role.alias("phase"), F.when(role == "user", "gpt-5").otherwise("claude-opus-4-8").alias("model"), T.estimate_tokens(F.col("text")).alias("input_tokens"), (T.estimate_tokens(F.col("text")) * 2).alias("output_tokens"))
    return P.cost_ledger(calls.join(P.builtin_catalog(spark).withColumnRenamed("key", "model").drop("source"), "model"))


def _asked(spark, sf_dir):
    """Documents as calls of models in turn: provider, model, input_tokens."""
    named = F.get(F.array(*[F.struct(F.lit(p).alias("provider"), F.lit(m).alias("model")) for p, m in MODELS]), F.pmod("doc_id", F.lit(len(MODELS))).cast("int"))
    return table(spark, sf_dir, "documents").select(named.alias("m"), T.estimate_tokens(F.col("text")).cast("long").alias("input_tokens")).select("m.provider", "m.model", "input_tokens")


def _priced(asked, catalog):
    """Each asked model's quote, with its calls and tokens."""
    used = asked.groupBy("provider", "model").agg(F.count("*").alias("calls"), F.sum("input_tokens").alias("input_tokens"))
    quoted = P.quotes(used.select("provider", "model"), catalog).withColumnsRenamed({"provider": "_p", "model": "_m"})
    return used.join(quoted, F.col("provider").eqNullSafe(F.col("_p")) & (F.col("model") == F.col("_m"))).drop("_p", "_m")


@query
def price_quotes(spark, sf_dir):
    """What the documents' calls are priced at, model by model."""
    return _priced(_asked(spark, sf_dir), P.builtin_catalog(spark))


@query
def build_estimate(spark, sf_dir):
    first = C.first_user_text(table(spark, sf_dir, "conversations"))
    sizes = V.signature_groups(first, "conv_id", "first_user_text").groupBy("group_id").agg(F.count("*").alias("n"))
    return P.build_estimate(spark, first.count(), sizes)


def _some_answers(model, kind, payload):
    reply = json.loads(model(kind, payload).text)
    reply["annotations"] = [a for a in reply["annotations"] if int(a["conversation_id"]) % 3]
    return M.Reply(json.dumps(reply), model.model, 0, 0, False)


@query
def model_annotations(spark, sf_dir):
    """The batched model call, with a model that leaves every third task out of its reply."""
    first = V.signature_groups(C.first_user_text(table(spark, sf_dir, "conversations")), "conv_id", "first_user_text").select("conv_id", "group_id")
    rows = C.first_user_text(table(spark, sf_dir, "conversations")).join(first, "conv_id")
    return A.annotate_with_model(rows, "conv_id", "first_user_text", "group_id", lambda: partial(_some_answers, M.Offline())).select("conv_id", "family", "domain", F.array_join("skills", "|").alias("skills"), "difficulty", "specificity", "ok")


def _offline(provider: str, model: str) -> M.Offline:
    return M.Offline(model)


CANDIDATES = [Model("recorded", m) for m in ("plain-1", "weak-1", "brief-1", "detailed-1")]


def _tasks_of(spark, sf_dir):
    first = C.first_user_text(table(spark, sf_dir, "conversations"))
    return first.withColumn("checklist", F.array(*[F.lit(x) for x in T.CHECKLIST]))


@query
def fallback_annotations(spark, sf_dir):
    """Family and domain as after a failed call, and as the offline model gives them."""
    rows = prompts_of(spark, sf_dir)
    of = T.label(F.col("prompt"))
    return rows.select("doc_id", T.family_label(F.col("prompt"), of, fallback=True).alias("family"), T.domain(F.col("prompt")).alias("domain"), T.domain(F.col("prompt"), offline=True).alias("offline_domain"))


@query
def task_skills(spark, sf_dir):
    """Skills from a comma text where there is one, and the category text made of them."""
    rows = prompts_of(spark, sf_dir).select("doc_id", T.domain(F.col("prompt")).alias("domain"), T.skills(F.when(F.col("doc_id") % 2 == 0, F.col("prompt")), F.col("prompt")).alias("s"))
    return rows.select("doc_id", F.array_join("s", "|").alias("skills"), T.category_description(F.col("domain"), F.col("s")).alias("description"))


@query
def candidate_answers(spark, sf_dir):
    """Every candidate's answer to every first prompt, by model calls."""
    return J.answers(_tasks_of(spark, sf_dir), "conv_id", "first_user_text", CANDIDATES, _offline).select("conv_id", "model", "response", "ok")


def _judged(spark, sf_dir):
    tasks = _tasks_of(spark, sf_dir)
    answered = J.answers(tasks, "conv_id", "first_user_text", CANDIDATES, _offline)
    rows = answered.join(tasks.select(F.col("conv_id").alias("_c"), "checklist", F.col("first_user_text").alias("prompt")), F.col("conv_id") == F.col("_c")).drop("_c")
    return J.judgements(rows, ["conv_id", "model"], [Model("recorded", "judge-a"), Model("recorded", "judge-b")], _judge)


class _Unreadable(M.Offline):
    """A judge that gives no object for every other response length, and a score of its own else."""

    def __call__(self, kind, payload):
        n = len(payload["response"])
        return M.Reply("no score" if n % 2 else json.dumps({"score": 1 + n % 13}), self.model, 0, 0, False)


def _judge(provider: str, model: str):
    return _Unreadable(model) if model == "judge-b" else M.Offline(model)


@query
def judge_panel(spark, sf_dir):
    """Two judges' scores of all answers; one can't be read for some."""
    return _judged(spark, sf_dir).select("conv_id", "model", "judge", "score", F.size("weaknesses").alias("n_weaknesses"), "ok")


@query
def panel_details(spark, sf_dir):
    rows = J.panel_details(_judged(spark, sf_dir), ["conv_id", "model"], "median")
    text = F.array_join(F.transform("judges", lambda x: F.concat(x["judge"], F.lit("="), x["score"].cast("string"))), ",")
    return rows.select("conv_id", "model", "score", F.col("judge_spread").cast("long").alias("judge_spread"), text.alias("judge_scores"))


@query
def model_checklists(spark, sf_dir):
    """Panel and merge by model calls in batches of five."""
    tasks = C.first_user_text(table(spark, sf_dir, "conversations"))
    items = cut(K.panel_items(tasks, "conv_id", "first_user_text", [Model("recorded", "a"), Model("recorded", "b")], _offline), "items")
    done = K.merged_items(tasks, items, "conv_id", "first_user_text", Model("recorded", "m"), _offline)
    return done.select("conv_id", F.array_join("checklist", "|").alias("checklist"), "ok")


def _with_skills(spark, sf_dir):
    rows = A.annotate(prompts_of(spark, sf_dir), "prompt")
    return rows.withColumn("skills", T.skills(F.lit(None).cast("string"), F.col("prompt")))


@query
def label_payload(spark, sf_dir):
    """Each raw label's count, three most frequent domains and six skills."""
    rows = A.label_payload(_with_skills(spark, sf_dir), "doc_id")
    return rows.select("label", "count", F.array_join("domains", "|").alias("domains"), F.array_join("skills", "|").alias("skills"))


@query
def model_claims(spark, sf_dir):
    """The canonical map by model calls over 120 labels each; the offline model claims each label for itself."""
    labels = A.label_payload(_with_skills(spark, sf_dir), "doc_id")
    return A.model_claims(labels, M.Offline).select("label", "family", "domain")


@query
def top_families(spark, sf_dir):
    return A.top_families(A.annotate(prompts_of(spark, sf_dir), "prompt"), "doc_id")


@query
def build_totals(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    groups = V.near_duplicate_groups(docs, "doc_id", "text").select("doc_id", F.col("root").alias("dup_group"))
    return A.totals(A.annotate(docs.select("doc_id", "text"), "text").join(groups, "doc_id"), "doc_id", "dup_group")


@query
def filter_counts(spark, sf_dir):
    rows = C.task_flags(prompts_of(spark, sf_dir))
    return rows.agg(F.count_if(F.col("is_task") == 1).alias("kept"), F.count_if(F.col("is_task") == 0).alias("dropped"))


@query
def eval_estimate(spark, sf_dir):
    """The cost of an evaluation over all prompts, line by line, with its prices."""
    n = table(spark, sf_dir, "conversations").select("conv_id").distinct().count()
    lines = P.eval_estimate(spark, n, Model("openai", "gpt-5-5"), [Model("anthropic", "claude-opus-4-8"), Model("xai", "grok-4.9"), Model("local", "llama")])
    return P.priced(lines, P.builtin_catalog(spark), ["local"])


@query
def estimate_totals(spark, sf_dir):
    return P.estimate_totals(eval_estimate(spark, sf_dir))


@query
def catalog_quotes(spark, sf_dir):
    """Quotes out of two external catalogs and prices in the settings, all made of the documents: a model for each source, a provider
    for each language. One catalog lacks a price for some sources, the other has an unreadable one for others."""
    docs = table(spark, sf_dir, "documents").select(F.col("lang").alias("provider"), F.col("source").alias("model"), T.estimate_tokens(F.col("text")).cast("long").alias("input_tokens"))
    sources = docs.groupBy("model").agg(F.count("*").alias("n")).withColumn("k", F.regexp_extract("model", "[0-9]+", 0).cast("int"))
    item = F.struct(F.concat(F.lit("fr/"), "model").alias("id"), F.struct(F.when(F.col("k") % 4 == 1, "n/a").otherwise(F.concat("n", F.lit("e-6"))).alias("prompt"), F.concat("k", F.lit("e-6")).alias("completion")).alias("pricing"))
    router = sources.groupBy((F.col("k") % 3).alias("part")).agg(F.to_json(F.struct(F.collect_list(item).alias("data"))).alias("value"))
    costs = F.struct(F.concat("n", F.lit("e-7")).alias("input_cost_per_token"), F.when(F.col("k") % 3 > 0, F.concat("k", F.lit("e-7"))).alias("output_cost_per_token"))
    lite = sources.groupBy((F.col("k") % 2).alias("part")).agg(F.to_json(F.map_from_entries(F.collect_list(F.struct(F.upper("model"), costs)))).alias("value"))
    own = P.override_rows(spark, [("de", "src4", 1.0, 2.0), (None, "Src-5", 3.0, 4.0)])
    return _priced(docs, P.openrouter_rows(router).unionByName(P.litellm_rows(lite)).unionByName(own).unionByName(P.builtin_catalog(spark)))


@query
def report_kpis(spark, sf_dir):
    return S.report_kpis(leaderboard(spark, sf_dir).withColumn("run_cost_usd", F.col("n_tasks") / 100).withColumn("wall_time_seconds", F.col("n_tasks") * 2), "model")


@query
def combined_categories(spark, sf_dir):
    """Each category's mean over runs of the runs' means."""
    rows = _runs(spark, sf_dir).join(table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("category")), "doc_id")
    return S.combined_categories(rows, "model")


@query
def export_shapes(spark, sf_dir):
    """Conversations written out in the three export forms, with nested and blank contents, and read again."""
    t = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("c"), "turn", "role", "text")
    nest = lambda item: t.groupBy("c").agg(F.array_sort(F.collect_list(F.struct("turn", item.alias("x")))).alias("l")).select("c", F.transform("l", lambda v: v["x"]).alias("l"))
    parts = F.struct(F.struct(F.col("turn").cast("double").alias("create_time"), F.struct("role").alias("author"), F.struct(F.array(F.lit(""), F.concat(F.lit("  "), "text", F.lit("\n"))).alias("parts")).alias("content")).alias("message"))
    tree = nest(parts).select(F.to_json(F.struct(F.col("c").alias("id"), F.map_from_arrays(F.transform("l", lambda v, i: i.cast("string")), "l").alias("mapping"))).alias("value"))
    flat = nest(F.struct(F.col("role").alias("sender"), F.col("text"))).select(F.to_json(F.struct(F.col("c").alias("uuid"), F.col("l").alias("chat_messages"))).alias("value"))
    lines = nest(F.struct("role", "text")).select(F.to_json(F.struct(F.col("c").alias("id"), F.col("l").alias("turns"))).alias("value"))
    found = []
    for name, rows in (("tree", tree), ("list", flat), ("lines", lines)):
        folder = f"{shared_dir(spark)}/export-{name}-{uuid.uuid4().hex}"
        # An array export is one document a file; here one for each partition of records.
        docs = rows if name == "lines" else rows.groupBy(F.pmod(F.xxhash64("value"), F.lit(4))).agg(F.concat(F.lit("["), F.array_join(F.collect_list("value"), ","), F.lit("]")).alias("value")).select("value")
        if name != "lines":
            docs = docs.repartition(4, F.xxhash64("value"))
            docs = docs.select(F.concat("value", F.lit("")).alias("value"))
            docs.write.option("maxRecordsPerFile", 1).text(folder)
            turns = E.read_arrays(spark, f"{folder}/part-*")
        else:
            docs.write.text(folder)
            turns = E.read_lines(spark, f"{folder}/part-*")
        found.append(turns.select(F.lit(name).alias("form"), "conversation_id", "turn", "role", F.sha2("text", 256).alias("digest")))
    return found[0].unionByName(found[1]).unionByName(found[2])


@query
def density_clusters(spark, sf_dir):
    """Density clusters of the documents' hashed vectors; noise by the signature of the text."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return D.density_groups(V.with_vectors(docs, V.embedded(docs, "doc_id", "text"), "doc_id"), "doc_id", "text", "vec")
