"""Queries over the steps of a build and the artifacts of runs, fed by the test tables; each has its SQL twin below."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import build as B
from .. import calls, reports
from ..functions import text as T
from ..operators import conversations as C
from ..operators import families as A
from ..ranks import row_numbers
from ..storage import shared_dir
from ..workspace import apply_review
from .oracles import DOCS, FIRST, ORACLES, ROLE, annotated, collapse, estimate, nontask, norm, score, tokens
from .queries import query, table


def _written(rows: DataFrame, schema: str, by: str | None = None) -> DataFrame:
    """Rows as JSON lines of the shared folder, read again with a reader's schema."""
    spark, folder = rows.sparkSession, f"{shared_dir(rows.sparkSession)}/lines-{uuid.uuid4().hex}"
    rows.write.partitionBy(*([by] if by else [])).json(folder)
    return spark.read.schema(schema + (f", {by} string" if by else "")).json(folder)


def _turns(spark, sf_dir) -> DataFrame:
    t = table(spark, sf_dir, "conversations")
    return t.select(F.col("conv_id").cast("string").alias("conversation_id"), F.col("turn").cast("int").alias("turn"), "role", "text", F.lit(None).cast("string").alias("ts"))


@query
def model_filter(spark, sf_dir):
    """Non-tasks by rule, the others by a model's reply; what it can't answer stays."""
    n = F.length("first_user_text")
    asked = lambda rows: rows.withColumn("reply", F.when(n % 3 == 0, " no, small talk").when(n % 3 == 1, "YES"))
    return B.filter_tasks(_turns(spark, sf_dir), asked).select("conversation_id", "is_task")


@query
def replaced_conversations(spark, sf_dir):
    """Conversations merged with a later export that repeats some: of repeated ones the last counts."""
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("conversation_id"), F.col("turn").alias("pos"), "role", F.length("text").cast("long").alias("n"))
    return C.upsert_conversations(rows.where("pos = 0").drop("pos"), rows.where("conversation_id % 2 = 0 AND pos < 4 OR conversation_id % 5 = 1 AND pos = 1"))


@query
def first_claims(spark, sf_dir):
    """The canonical family of each label, where a model claims some for another's: the first claim counts, unclaimed labels keep
    their most frequent spelling."""
    rows = A.annotate(table(spark, sf_dir, "documents").select("doc_id", "text"), "text")
    claims = rows.where("doc_id % 3 = 0").select(F.col("doc_id").alias("pos"), F.concat(F.lit("Joined "), F.col("doc_id") % 5).alias("family"), F.col("domain"), F.col("family").alias("label"))
    return A.canonical_map(rows, "doc_id", claims)


@query
def skill_union(spark, sf_dir):
    """The first spelling of each word of a document's first line, at most eight."""
    words = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split(F.get(F.split("text", "\n"), F.lit(0)), " ")).alias("pos", "skill"))
    return A.distinct_skills(words, "doc_id").select("doc_id", F.array_join("skills", "|").alias("skills"))


@query
def weighed_tasks(spark, sf_dir):
    """Family sizes and importance of tasks of which some lack a family's id, or its name, too."""
    rows = A.annotate(table(spark, sf_dir, "documents").select("doc_id", "text"), "text")
    lost = lambda c, k: F.when(F.col("doc_id") % k == 0, F.lit(" ")).otherwise(F.col(c))
    tasks = rows.select(F.col("doc_id").alias("conversation_id"), lost("family_id", 3).alias("task_family_id"), lost("family", 9).alias("task_family"), "difficulty", (F.col("doc_id") % 700).alias("near_duplicate_group_id"))
    return B.weigh(tasks).select("conversation_id", "family_size", "family_importance")


@query
def locked_tasks(spark, sf_dir):
    """The selected tasks as a benchmark holds them, numbered in order: turns up to the user's last, defaults where a field lacks."""
    turns = _turns(spark, sf_dir)
    n = F.col("conversation_id").cast("int")
    blank, null = F.lit("  "), F.lit(None)
    tasks = turns.select("conversation_id").distinct().select(
        "conversation_id", F.lit(1).alias("is_task"), (n % 3 < 2).cast("int").alias("selected"), F.when(n % 2 == 0, "Family A").otherwise(blank).alias("task_family"), F.when(n % 4 == 0, "id-a").otherwise(null.cast("string")).alias("task_family_id"),
        F.lit("Label").alias("category_label"), null.cast("string").alias("category_description"), F.when(n % 5 > 0, n).cast("long").alias("candidate_group_id"), null.cast("long").alias("candidate_group_size"), null.cast("double").alias("importance"),
        F.when(n % 7 > 0, n / 1000).alias("family_importance"), null.cast("string").alias("domain"), F.array(F.lit("s")).alias("skills"), blank.alias("difficulty"), F.lit("narrow").alias("specificity"), null.cast("array<string>").alias("checklist"))
    rows = B.locked_rows(tasks, turns).withColumn("n_turns", F.size("turns").cast("long")).withColumn("said", F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "\n"), 256))
    numbered = row_numbers(rows.drop("turns", "skills"), ["conversation_id"], name="i").withColumn("id", F.format_string("task-%04d", F.col("i") + 1))
    return numbered.select("id", "conversation_id", "category", "category_description", "cluster_id", "cluster_size", "importance", "task_family_id", "task_family", "domain", "difficulty", "specificity", F.size("checklist").cast("long").alias("n_items"), "n_turns", "said")


@query
def reviewed_tasks(spark, sf_dir):
    """Checklists and importance after edits: lines of a text as items, importance held to 0 .. 1."""
    docs = table(spark, sf_dir, "documents")
    tasks = docs.select(F.col("doc_id").alias("conversation_id"), F.array(F.lit("kept")).alias("checklist"), (F.col("doc_id") % 10 / 10).alias("importance"), F.lit(0.5).alias("family_importance"))
    edits = docs.where("doc_id % 4 > 0").select(F.col("doc_id").alias("conversation_id"), F.when(F.col("doc_id") % 4 < 3, F.concat(F.lit("- first -\n\n"), "text")).alias("checklist_text"), F.when(F.col("doc_id") % 4 > 1, F.col("doc_id") % 7 / 4 - 0.75).alias("importance_delta"))
    return apply_review(tasks, edits).select("conversation_id", F.size("checklist").cast("long").alias("n_items"), F.sha2(F.array_join("checklist", "\n"), 256).alias("items"), "importance")


@query
def call_ledger(spark, sf_dir):
    """Records of paid calls, a file each as workers leave them, added up by phase and model."""
    docs = table(spark, sf_dir, "documents")
    tokens = T.estimate_tokens(F.col("text")).cast("long")
    rows = docs.select(F.col("lang").alias("folder"), (F.col("doc_id") % 4).alias("part"), F.sha2(F.col("doc_id").cast("string"), 256).alias("call_id"), F.col("lang").alias("phase"), F.lit("build").alias("scope"), F.lit("filter").alias("kind"), F.lit("p").alias("provider"),
                       F.col("source").alias("model"), tokens.alias("input_tokens"), F.lit(2).alias("output_tokens"), F.when(F.col("doc_id") % 5 > 0, tokens * 0.001).alias("cost_usd"), F.lit(1.5).alias("at"), F.col("text").alias("reply"))
    where = f"{shared_dir(spark)}/calls-{uuid.uuid4().hex}"
    rows.write.partitionBy("folder", "part").json(where)
    return calls.ledger(calls.records(spark, where))


def _runs(spark, sf_dir) -> dict[str, DataFrame]:
    """Each source as a run over its documents: the lines that a run writes, some tasks twice, some without an answer or a score."""
    docs = table(spark, sf_dir, "documents").select(F.col("source").alias("run"), F.col("doc_id").cast("string").alias("task_id"), "doc_id", "text", T.recorded_score(F.col("text")).cast("double").alias("score"))
    twice = docs.withColumn("_line", F.explode(F.when(F.col("doc_id") % 4 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).withColumn("score", F.col("score") - F.col("_line") / 2)
    judges = F.when(F.col("doc_id") % 3 == 0, F.array(F.struct(F.lit("j").alias("judge"), F.col("score"), F.concat(F.lit("because of "), F.col("doc_id") % 10, F.lit("-"), F.col("_line").cast("string")).alias("rationale"))))
    rows = {
        "tasks": docs.select("run", "task_id", F.lit(0).alias("_line"), F.col("text").alias("prompt"), F.array(F.lit("c")).alias("checklist")),
        "responses": twice.where("doc_id % 6 > 0").select("run", "task_id", "_line", F.when(F.col("doc_id") % 7 > 0, F.concat(F.col("_line").cast("string"), F.lit(": "), "text")).alias("response")),
        "scores": twice.where("doc_id % 5 > 0").select("run", "task_id", "_line", "score", F.lit("c").alias("category")),
        "rationales": twice.select("run", "task_id", "_line", F.when(F.col("doc_id") % 3 == 1, "as one").alias("rationale"), F.lit(0.0).alias("judge_spread"), judges.alias("judges")),
    }
    return {name: _written(r, reports.LINES[name] + ", _line int", "run") for name, r in rows.items()}


@query
def searched_details(spark, sf_dir):
    """A row for each task of the runs that ended, joined out of their lines, as a reader who looks for words finds them."""
    ended = table(spark, sf_dir, "documents").where("source <> 'src3'").select(F.col("source").alias("run"), F.concat(F.lit("m-"), "source").alias("model")).distinct()
    rows = reports.filtered(reports.details_of(_runs(spark, sf_dir), _written(ended, "model string, run string")), "The", sort="score_low")
    told = F.array_join(F.transform("judges", lambda j: F.concat_ws("/", j["judge"], j["shown"], j["tier"], j["rationale"])), ",")
    return rows.select("run", "model", "task_id", F.sha2("response", 256).alias("response"), "shown", "tier", "rationale", told.alias("judges"), "preview")


@query
def run_board(spark, sf_dir):
    """Summaries of runs, older forms among them, with the labels and places of a leaderboard."""
    docs = table(spark, sf_dir, "documents").select("source", "lang", T.recorded_score(F.col("text")).alias("score"))
    per = docs.groupBy("source", "lang").agg(F.round(F.avg("score"), 4).alias("raw_egoscore"), F.count("*").alias("task_count"))
    k = F.regexp_extract("source", "[0-9]+", 0).cast("int")
    rows = per.select(F.concat(F.lit("m"), (k % 12).cast("string")).alias("model"), F.when(k % 3 > 0, F.transform(F.sequence(F.lit(1), k % 3), lambda i: F.concat(F.lit("j"), i.cast("string")))).alias("judges"), F.when(k % 2 == 0, "median").alias("scoring_aggregate"),
                      "task_count", "raw_egoscore", F.when(F.col("lang") != "es", F.col("raw_egoscore")).alias("frequency_weighted_egoscore"), F.lit("t").alias("created_at"), F.concat(F.lit("/runs/"), "source", F.lit("/"), "lang").alias("_path"))
    board = reports.board(_written(rows, reports.SUMMARY + ", _path string"))
    ranked = row_numbers(board.withColumn("_w", F.coalesce("frequency_weighted_egoscore", F.lit(0.0))), [F.desc("_w"), F.col("_path")], name="place")
    return ranked.select("label", "judges_label", "task_count", "raw_egoscore", "place", F.col("_path").alias("path"))


_ITEMS = "list_filter(list_transform(string_split('- first -' || chr(10) || chr(10) || text, chr(10)), lambda x: regexp_replace(trim(x), '^[- ]+|[- ]+$', '', 'g')), lambda x: x <> '')"
_PREVIEW = f"CASE WHEN {collapse('text')} = '' THEN '—' WHEN length({collapse('text')}) <= 140 THEN {collapse('text')} ELSE rtrim(substr({collapse('text')}, 1, 139)) || '…' END"
_SHOWN = "CASE WHEN s = floor(s) THEN s::BIGINT::VARCHAR ELSE printf('%.2f', s) END"
_TIER = "CASE WHEN s >= 8 THEN 'high' WHEN s >= 4 THEN 'mid' ELSE 'low' END"
_ANNOTATED = f"{DOCS}, {annotated('src', 'doc_id')}"

ORACLES |= {
    "model_filter": f"""WITH {FIRST}, f AS (SELECT conv_id AS doc_id, prompt FROM fut), n AS ({nontask('f')})
SELECT n.doc_id::VARCHAR AS conversation_id, CASE WHEN is_task = 0 OR length(prompt) % 3 = 0 THEN 0 ELSE 1 END AS is_task FROM n JOIN f USING (doc_id)""",
    "replaced_conversations": """WITH new AS (SELECT conv_id, arg_max(role, turn) AS role, arg_max(length(text), turn) AS n FROM conversations WHERE conv_id % 2 = 0 AND turn < 4 OR conv_id % 5 = 1 AND turn = 1 GROUP BY conv_id)
SELECT conv_id AS conversation_id, role, n::BIGINT AS n FROM new UNION ALL SELECT conv_id, role, length(text)::BIGINT FROM conversations WHERE turn = 0 AND conv_id NOT IN (SELECT conv_id FROM new)""",
    "first_claims": f"""WITH {_ANNOTATED}, k AS (SELECT *, {norm('family')} AS label_key FROM ann), sp AS (SELECT label_key, family, count(*) AS n FROM k GROUP BY ALL),
own AS (SELECT label_key, arg_max(family, (n, len({tokens('family', 1)}), family)) AS family FROM sp GROUP BY label_key), f AS (SELECT label_key, arg_min('Joined ' || (doc_id % 5), doc_id) AS family FROM k WHERE doc_id % 3 = 0 GROUP BY label_key)
SELECT label_key, family FROM f UNION ALL SELECT label_key, family FROM own WHERE label_key NOT IN (SELECT label_key FROM f)""",
    "skill_union": f"""WITH l AS (SELECT doc_id, string_split(string_split(text, chr(10))[1], ' ') AS ws FROM documents), w AS (SELECT doc_id, unnest(ws) AS skill, generate_subscripts(ws, 1) AS pos FROM l),
n AS (SELECT doc_id, norm, arg_min(skill, pos) AS skill, min(pos) AS pos FROM (SELECT *, lower({collapse('skill')}) AS norm FROM w) WHERE norm <> '' GROUP BY doc_id, norm),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS k FROM n) SELECT doc_id, string_agg(substr(skill, 1, 80), '|' ORDER BY pos) AS skills FROM r WHERE k <= 8 GROUP BY doc_id""",
    "weighed_tasks": f"""WITH {_ANNOTATED}, t AS (SELECT doc_id, difficulty, CASE WHEN doc_id % 3 > 0 THEN family_id WHEN doc_id % 9 > 0 THEN family ELSE 'General assistance' END AS k, doc_id % 700 AS dup FROM ann),
f AS (SELECT k, count(*) AS family_size, (0.35 * ln(1 + count(*)) + 0.65 * ln(1 + count(DISTINCT dup))) * avg(CASE difficulty WHEN 'easy' THEN 0.9::DOUBLE WHEN 'medium' THEN 1.05::DOUBLE WHEN 'hard' THEN 1.1::DOUBLE ELSE 1 END) AS raw FROM t GROUP BY k)
SELECT doc_id AS conversation_id, family_size, round(raw / (SELECT max(raw) FROM f), 6) AS family_importance FROM t JOIN f USING (k)""",
    "locked_tasks": f"""WITH r AS (SELECT conv_id, turn, {ROLE} AS role, text FROM conversations), e AS (SELECT *, coalesce(max(CASE WHEN role = 'user' THEN turn END) OVER w, min(turn) OVER w) AS last FROM r WINDOW w AS (PARTITION BY conv_id)),
t AS (SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || ':' || text, chr(10) ORDER BY turn)) AS said FROM e WHERE turn <= last AND conv_id % 3 < 2 GROUP BY conv_id)
SELECT printf('task-%04d', row_number() OVER (ORDER BY conv_id::VARCHAR)) AS id, conv_id::VARCHAR AS conversation_id, CASE WHEN conv_id % 2 = 0 THEN 'Family A' ELSE '  ' END AS category, '' AS category_description,
CASE WHEN conv_id % 5 > 0 THEN conv_id ELSE 0 END AS cluster_id, 1::BIGINT AS cluster_size, CASE WHEN conv_id % 7 > 0 THEN conv_id / 1000 ELSE 0 END AS importance, CASE WHEN conv_id % 4 = 0 THEN 'id-a' ELSE 'general-assistance' END AS task_family_id,
CASE WHEN conv_id % 2 = 0 THEN 'Family A' ELSE 'General assistance' END AS task_family, 'General' AS domain, 'medium' AS difficulty, 'narrow' AS specificity, 0::BIGINT AS n_items, n_turns, said FROM t""",
    "reviewed_tasks": f"""WITH t AS (SELECT doc_id, CASE WHEN doc_id % 4 IN (1, 2) THEN {_ITEMS} ELSE ['kept'] END AS items, doc_id % 10 / 10 AS importance FROM documents)
SELECT doc_id AS conversation_id, len(items)::BIGINT AS n_items, sha256(array_to_string(items, chr(10))) AS items, CASE WHEN doc_id % 4 > 1 THEN round(least(1, greatest(0, importance + doc_id % 7 / 4 - 0.75::DOUBLE)), 6) ELSE importance END AS importance FROM t""",
    "call_ledger": f"""SELECT lang AS phase, 'p:' || source AS model, count(*) AS calls, sum({estimate('text')})::BIGINT AS input_tokens, (2 * count(*))::BIGINT AS output_tokens,
round(sum(CASE WHEN doc_id % 5 > 0 THEN {estimate('text')} * 0.001::DOUBLE ELSE 0 END), 6) AS cost_usd FROM documents GROUP BY ALL""",
    "searched_details": f"""WITH b AS (SELECT doc_id, source AS run, 'm-' || source AS model, doc_id::VARCHAR AS task_id, text, (doc_id % 4 = 0)::INT AS line, {score('text')}::DOUBLE AS whole FROM documents WHERE source <> 'src3'),
c AS (SELECT *, whole - line / 2 AS s, CASE WHEN doc_id % 6 > 0 AND doc_id % 7 > 0 THEN line || ': ' || text END AS answer, CASE WHEN doc_id % 3 = 0 THEN 'because of ' || (doc_id % 10) || '-' || line END AS why, CASE WHEN doc_id % 3 = 1 THEN 'as one' END AS one FROM b)
SELECT run, model, task_id, sha256(coalesce(answer, '—')) AS response, CASE WHEN doc_id % 5 > 0 THEN {_SHOWN} ELSE '—' END AS shown, CASE WHEN doc_id % 5 > 0 THEN {_TIER} END AS tier, coalesce(one, '—') AS rationale,
CASE WHEN doc_id % 3 = 0 THEN 'j/' || {_SHOWN} || '/' || {_TIER} || '/' || why ELSE '' END AS judges, {_PREVIEW} AS preview FROM c WHERE contains(lower(concat_ws(' ', model, task_id, text, coalesce(answer, ''), coalesce(why, one, ''))), 'the')""",
    "run_board": f"""WITH d AS (SELECT source, lang, regexp_extract(source, '[0-9]+')::INT AS k, round(avg({score('text')}), 4) AS raw_egoscore, count(*) AS task_count FROM documents GROUP BY ALL)
SELECT 'm' || k % 12 || ' · ' || lang AS label, CASE k % 3 WHEN 0 THEN '—' WHEN 1 THEN 'j1' ELSE 'j1, j2 · ' || CASE WHEN k % 2 = 0 THEN 'median' ELSE 'mean' END END AS judges_label, task_count, raw_egoscore,
row_number() OVER (ORDER BY CASE WHEN lang <> 'es' THEN raw_egoscore ELSE 0 END DESC, '/runs/' || source || '/' || lang) - 1 AS place, '/runs/' || source || '/' || lang AS path FROM d""",
}
