"""SQL twins of the registered queries, for DuckDB."""

from __future__ import annotations

from ..functions import text as T
from ..operators.pricing import PRICES
from .density_sql import density_sql
from .queries import SAMPLES


def _quote(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _in(values) -> str:
    return "(" + ", ".join(_quote(v) for v in values) + ")"


def _has(low: str, terms) -> str:
    return "(" + " OR ".join(f"contains({low}, {_quote(t)})" for t in terms) + ")"


ROLE = "CASE WHEN lower(coalesce(role, 'user')) IN ('assistant', 'bot', 'ai') THEN 'assistant' WHEN lower(role) IN ('system', 'tool') THEN lower(role) ELSE 'user' END"
STRIP = r"regexp_replace(text, '^\s+|\s+$', '', 'g')"


def collapse(t: str) -> str:
    return rf"trim(regexp_replace(coalesce({t}, ''), '\s+', ' ', 'g'))"


def words(t: str) -> str:
    return f"(CASE WHEN {collapse(t)} = '' THEN 0 ELSE len(string_split({collapse(t)}, ' ')) END)"


def tokens(t: str, least: int, stop=()) -> str:
    out = f"list_transform(regexp_extract_all({t}, '[a-zA-Z][a-zA-Z0-9_+-]{{{least},}}'), lambda x: lower(x))"
    return f"list_filter({out}, lambda x: x NOT IN {_in(stop)})" if stop else out


def estimate(t: str) -> str:
    return f"(CASE WHEN {words(t)} = 0 THEN 0 ELSE greatest(1, floor({words(t)} * 1.35)::BIGINT + 1) END)"


_SAMPLE_ROWS = ", ".join(f"({i}, '{t.replace(chr(39), chr(39) * 2)}')" for i, t in SAMPLES)
PROMPTS = f"prompts AS (SELECT doc_id, text AS prompt FROM documents UNION ALL SELECT * FROM (VALUES {_SAMPLE_ROWS}) v(doc_id, prompt))"
FIRST = f"fut AS (SELECT conv_id, coalesce(arg_min(t, turn) FILTER (WHERE r = 'user' AND t <> ''), '') AS prompt FROM (SELECT conv_id, turn, {ROLE} AS r, {STRIP} AS t FROM conversations) GROUP BY conv_id)"


def annotated(source: str, key: str, name: str = "ann") -> str:
    low = "lower(prompt)"
    return f"""{name}0 AS (SELECT *, ({tokens('prompt', 2, T.LABEL_STOP)})[1] AS w FROM {source}),
{name}1 AS (SELECT *, CASE WHEN w IS NULL THEN 'General' ELSE array_to_string(list_transform(regexp_extract_all(replace(w, '_', ' '), '[a-z]+|[^a-z]+'), lambda x: upper(x[1]) || x[2:]), '') END AS label FROM {name}0),
{name}2 AS (SELECT *, CASE WHEN {_has(low, ('translate', 'french', 'spanish'))} THEN label || ' language support' WHEN {_has(low, ('code', 'python', 'javascript', 'api'))} THEN label || ' software help'
  WHEN {_has(low, ('email', 'rewrite', 'draft'))} THEN label || ' writing help' WHEN label <> 'General' THEN label || ' tasks' ELSE 'General assistance' END AS family,
  CASE WHEN {_has(low, T.LANGUAGE_TERMS)} THEN 'Language learning' WHEN {_has(low, T.CODE_TERMS)} THEN 'Software engineering' WHEN {_has(low, T.WRITING_TERMS)} THEN 'Writing' ELSE 'General' END AS domain,
  CASE WHEN {words('prompt')} < 8 THEN 'easy' WHEN {words('prompt')} > 60 OR length(prompt) - length(replace(prompt, chr(10), '')) >= 2 THEN 'hard' ELSE 'medium' END AS difficulty,
  CASE WHEN {_has(low, T.NARROW_TERMS)} THEN 'narrow' WHEN {words('prompt')} < 5 THEN 'one_off' ELSE 'generalizable' END AS specificity FROM {name}1),
{name} AS (SELECT *, {family_id('family', 'domain')} AS family_id FROM {name}2)"""


def norm(t: str) -> str:
    return f"array_to_string({tokens(t, 1)}, ' ')"


def family_id(family: str, domain: str) -> str:
    slug = f"array_to_string(({tokens(family, 1)})[1:8], '-')"
    return f"(CASE WHEN {slug} = '' THEN 'general-assistance' ELSE {slug} END || '-' || substr(sha256({norm(domain)} || chr(10) || {norm(family)}), 1, 8))"


EMB = f"""tok AS (SELECT doc_id, unnest({tokens('text', 2, T.SIGNATURE_STOP)}) AS t FROM documents),
hs AS (SELECT doc_id, ('0x' || substr(sha256(t), 1, 2))::INT % 32 AS dim, CASE WHEN ('0x' || substr(sha256(t), 3, 2))::INT % 2 = 0 THEN 1 ELSE -1 END AS s FROM tok),
sm AS (SELECT doc_id, dim, sum(s)::DOUBLE AS s FROM hs GROUP BY ALL),
emb AS (SELECT sm.doc_id, dim, s / sqrt(q) AS v FROM sm JOIN (SELECT doc_id, sum(s * s) AS q FROM sm GROUP BY doc_id) n USING (doc_id) WHERE s <> 0)"""
PAIRS = f"{EMB}, pairs AS (SELECT x.doc_id AS a, y.doc_id AS b, round(sum(x.v * y.v), 9) AS sim FROM emb x JOIN emb y ON x.dim = y.dim AND x.doc_id < y.doc_id GROUP BY ALL HAVING round(sum(x.v * y.v), 9) >= 0.9)"
GROUPS = f"""{PAIRS}, reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM reach r JOIN (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs) e ON r.b = e.a),
roots AS (SELECT a AS doc_id, min(b) AS root FROM reach GROUP BY a), sizes AS (SELECT root, count(*) AS group_size, dense_rank() OVER (ORDER BY root) - 1 AS group_id FROM roots GROUP BY root),
grp AS (SELECT doc_id, root, group_id, group_size FROM roots JOIN sizes USING (root))"""
DOCS = "src AS (SELECT doc_id, text AS prompt FROM documents)"
IMPORTANCE = f"""{GROUPS}, {DOCS}, {annotated('src', 'doc_id')},
fam AS (SELECT family_id, count(*) AS family_size, count(DISTINCT root) AS diversity, avg(CASE difficulty WHEN 'easy' THEN 0.9::DOUBLE WHEN 'medium' THEN 1.05::DOUBLE WHEN 'hard' THEN 1.1::DOUBLE ELSE 1 END) AS w FROM ann JOIN grp USING (doc_id) GROUP BY family_id),
raw AS (SELECT *, (0.35::DOUBLE * ln(1 + family_size) + 0.65::DOUBLE * ln(1 + diversity)) * w AS raw FROM fam),
imp AS (SELECT family_id, family_size, diversity, CASE WHEN max(raw) OVER () = 0 THEN 0 ELSE round(raw / max(raw) OVER (), 6) END AS family_importance FROM raw)"""
_RANK = "CASE specificity WHEN 'generalizable' THEN 0 WHEN 'one_off' THEN 2 ELSE 1 END, CASE WHEN difficulty IN ('medium', 'hard') THEN 0 ELSE 1 END, group_size DESC, substr(sha256('42:' || doc_id), 1, 16)"
BEST = f"""{IMPORTANCE}, tasks AS (SELECT ann.*, root, group_size, family_size, family_importance FROM ann JOIN grp USING (doc_id) JOIN imp USING (family_id)),
best AS (SELECT * FROM tasks QUALIFY row_number() OVER (PARTITION BY root ORDER BY {_RANK}) = 1)"""
def signed(source: str, key: str) -> str:
    """sig(key, signature, group_id, group_size) of source(key, prompt)."""
    return f"""st AS (SELECT {key}, unnest(ts) AS t, generate_subscripts(ts, 1) AS p FROM (SELECT {key}, {tokens('prompt', 2, T.SIGNATURE_STOP)} AS ts FROM {source})),
sc AS (SELECT {key}, t, count(*) AS n, min(p) AS p FROM st GROUP BY ALL), sg AS (SELECT f.{key}, coalesce(s, 'general') AS signature FROM {source} f LEFT JOIN (SELECT {key}, arg_max(t, (n, -p)) AS s FROM sc GROUP BY {key}) USING ({key})),
sig AS (SELECT {key}, signature, dense_rank() OVER (ORDER BY m) - 1 AS group_id, group_size FROM (SELECT *, min({key}) OVER (PARTITION BY signature) AS m, count(*) OVER (PARTITION BY signature) AS group_size FROM sg))"""


SIG = f"{FIRST}, {signed('fut', 'conv_id')}"


def score(t: str) -> str:
    base = f"least(10, greatest(1, 5 + least(4, {words(t)} // 35)))"
    return f"(CASE WHEN contains(lower({t}), 'i don''t know') OR contains(lower({t}), 'cannot') THEN greatest(3, {base} - 2) ELSE {base} END)::BIGINT"


PANEL = "p AS (SELECT user_id, greatest(1, least(10, floor(value / 49) + 1))::DOUBLE AS score, event_id % 7 <> 0 AS ok FROM events)"
TOKENS = f"(CASE WHEN coalesce(text, '') = '' THEN 0 ELSE greatest(1, floor({words('text')} * 1.35::DOUBLE) + 1) END)::BIGINT"
SCORED = f"{SIG}, lab AS (SELECT conv_id, label FROM (WITH {annotated('fut', 'conv_id')} SELECT * FROM ann)), scored AS (SELECT conv_id, {score('text')} AS score, group_size AS weight, label AS category FROM conversations JOIN sig USING (conv_id) JOIN lab USING (conv_id) WHERE {ROLE} = 'assistant')"
_PRICE_ROWS = ", ".join(f"('{k}', {a}::DOUBLE, {b}::DOUBLE)" for k, (a, b) in PRICES.items())


def _panel(mid: str) -> str:
    good = "FILTER (WHERE ok)"
    return f"WITH {PANEL} SELECT user_id, round(coalesce({mid}(score) {good}, {mid}(score)), 4) AS consensus, coalesce(max(score) {good} - min(score) {good}, max(score) - min(score)) AS spread, count(*) AS judges FROM p GROUP BY user_id"


def _overall(by: str, source: str) -> str:
    cols = f"{by}, " if by else ""
    group = f" GROUP BY {by}" if by else ""
    return f"SELECT {cols}round(avg(score), 4) AS raw_score, round(sum(score * greatest(weight, 1)) / sum(greatest(weight, 1)), 4) AS weighted_score, count(*) AS n_tasks FROM {source}{group}"


RUNS = f"runs AS (SELECT source AS model, doc_id, text, {score('text')} AS score, 1 + doc_id % 3 AS weight FROM documents)"
_DIST = " UNION ALL ".join(f"SELECT '{c}' AS kind, coalesce(nullif(trim({c}), ''), 'Unknown') AS key, count(*) AS n FROM ann GROUP BY ALL" for c in ("domain", "difficulty", "specificity", "family"))
_LABEL_ITEMS = ", ".join(_quote(x) for x in T.CHECKLIST)

def nontask(source: str) -> str:
    """doc_id, is_task of source(doc_id, prompt)."""
    bare = rf"trim(regexp_replace(lower({collapse('prompt')}), '[^\p{{L}}\p{{N}}_\s'']', '', 'g'))"
    return f"SELECT doc_id, CASE WHEN coalesce(prompt, '') = '' OR p IN {_in(T.ACKS)} OR regexp_matches(p, '{T.PING}') THEN 0 ELSE 1 END AS is_task FROM (SELECT *, {bare} AS p FROM {source})"


ORACLES: dict[str, str] = {
    "first_user_text": f"WITH {FIRST} SELECT conv_id, prompt AS first_user_text FROM fut",
    "conversation_prompts": f"WITH r AS (SELECT *, {ROLE} AS r FROM conversations), c AS (SELECT *, coalesce(max(CASE WHEN r = 'user' THEN turn END) OVER (PARTITION BY conv_id), min(turn) OVER (PARTITION BY conv_id)) AS last FROM r) SELECT conv_id, string_agg(upper(r) || ': ' || text, chr(10) ORDER BY turn) AS prompt FROM c WHERE turn <= last GROUP BY conv_id",
    "role_normalised_counts": f"SELECT {ROLE} AS role, count(*) AS n FROM conversations WHERE {STRIP} <> '' GROUP BY 1",
    "nontask_filter": f"WITH {PROMPTS} {nontask('prompts')}",
    "text_annotations": f"WITH {PROMPTS}, {annotated('prompts', 'doc_id')} SELECT doc_id, label, family, domain, difficulty, specificity FROM ann",
    "task_class_counts": f"WITH {FIRST}, {annotated('fut', 'conv_id')} SELECT domain, difficulty, count(*) AS n FROM ann WHERE prompt <> '' GROUP BY ALL",
    "token_signature_groups": f"WITH {SIG} SELECT * FROM sig",
    "family_ids": f"WITH {PROMPTS}, {annotated('prompts', 'doc_id')} SELECT doc_id, family, family_id FROM ann",
    "hashed_embeddings": f"WITH {EMB} SELECT doc_id, dim, round(v, 9) AS v FROM emb",
    "near_duplicate_pairs": f"WITH {PAIRS} SELECT a, b, round(sim, 6) AS sim FROM pairs",
    "near_duplicate_groups": f"WITH RECURSIVE {GROUPS} SELECT doc_id, group_id, group_size FROM grp",
    "vector_neighbours": "WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings), n AS (SELECT vec_id, list_transform(v, lambda x: x / sqrt(list_inner_product(v, v))) AS v FROM e) SELECT x.vec_id AS a, y.vec_id AS b, round(list_inner_product(x.v, y.v), 6) AS sim FROM n x JOIN n y ON x.vec_id < y.vec_id WHERE round(list_inner_product(x.v, y.v), 9) >= 0.4",
    "family_importance": f"WITH RECURSIVE {IMPORTANCE}, nm AS (SELECT family_id, arg_max(family, (n, family)) AS family FROM (SELECT family_id, family, count(*) AS n FROM ann GROUP BY ALL) GROUP BY family_id) SELECT family_id, family, family_size, diversity, family_importance FROM imp JOIN nm USING (family_id)",
    "canonical_families": f"""WITH {PROMPTS}, {annotated('prompts', 'doc_id')}, k AS (SELECT *, {norm('family')} AS label_key FROM ann), sp AS (SELECT label_key, family, count(*) AS n FROM k GROUP BY ALL),
nm AS (SELECT label_key, arg_max(family, (n, len({tokens('family', 1)}), family)) AS name FROM sp GROUP BY label_key), j AS (SELECT * FROM k JOIN nm USING (label_key)),
d AS (SELECT name, arg_max(domain, (n, -p)) AS domain FROM (SELECT name, domain, count(*) AS n, min(doc_id) AS p FROM j GROUP BY ALL) GROUP BY name), s AS (SELECT name, count(*) AS n_tasks, count(DISTINCT family) AS n_labels FROM j GROUP BY name)
SELECT {family_id('name', 'domain')} AS family_id, name AS family, domain, n_tasks, n_labels FROM d JOIN s USING (name)""",
    "best_per_duplicate_group": f"WITH RECURSIVE {BEST} SELECT doc_id, root AS dup_group FROM best",
    "benchmark_sample": f"""WITH RECURSIVE {BEST}, tg AS (SELECT least(100, count(*)) AS target FROM tasks), b AS (SELECT *, row_number() OVER (PARTITION BY family_id ORDER BY {_RANK}) AS rn FROM best),
f0 AS (SELECT family_id, count(*) AS n, max(family_importance) AS imp, max(family_size) AS smax, min(family_size) AS smin FROM b GROUP BY family_id),
f1 AS (SELECT *, (smax >= 2 AND row_number() OVER (PARTITION BY smax >= 2 ORDER BY imp DESC, smax DESC, family_id) <= target)::INT AS a FROM f0, tg),
f2 AS (SELECT *, sum(a) OVER () AS sa, smax <= 2 AND a < 5 AND n > a AS fit FROM f1),
f3 AS (SELECT *, (fit AND row_number() OVER (PARTITION BY fit ORDER BY smin, imp DESC, family_id) <= least(CASE WHEN target <= 1 THEN 0 ELSE greatest(1, floor(target * 0.2)) END, target - sa))::INT AS bb FROM f2),
f4 AS (SELECT family_id, a + bb AS ab, sa + sum(bb) OVER () AS sab, target FROM f3),
j AS (SELECT b.*, ab, sab, target FROM b JOIN f4 USING (family_id)),
r AS (SELECT *, row_number() OVER (PARTITION BY family_id ORDER BY family_importance DESC, {_RANK}) AS rest FROM j WHERE rn > ab),
g AS (SELECT *, row_number() OVER (ORDER BY ab, family_importance DESC, {_RANK}) AS pos FROM r WHERE rest <= 5 - ab)
SELECT doc_id, family_id FROM j WHERE rn <= ab UNION ALL SELECT doc_id, family_id FROM g WHERE pos <= target - sab""",
    "checklist_items": f"""WITH {PROMPTS}, {annotated('prompts', 'doc_id')}, i AS (SELECT doc_id, list_value({_LABEL_ITEMS}, 'Covers the main ' || lower(label) || ' considerations') AS items FROM ann)
SELECT doc_id, generate_subscripts(items, 1)::BIGINT AS pos, unnest(items) AS item FROM i""",
    "benchmark_distributions": f"WITH {PROMPTS}, {annotated('prompts', 'doc_id')} {_DIST}",
    "recorded_judge_scores": f"SELECT conv_id, turn, {score('text')} AS score FROM conversations WHERE {ROLE} = 'assistant'",
    "panel_consensus_mean": _panel("avg"),
    "panel_consensus_median": _panel("median"),
    "overall_scores": f"WITH {SCORED} {_overall('', 'scored')}",
    "per_category_scores": f"WITH {SCORED} SELECT category, round(avg(score), 4) AS score, count(*) AS n_tasks FROM scored GROUP BY category",
    "leaderboard": f"WITH {RUNS}, o AS ({_overall('model', 'runs')}) SELECT *, row_number() OVER (ORDER BY weighted_score DESC, model) AS place FROM o",
    "run_details": f"WITH {RUNS} SELECT doc_id, model, CASE WHEN {collapse('text')} = '' THEN '—' WHEN length({collapse('text')}) <= 140 THEN {collapse('text')} ELSE rtrim(substr({collapse('text')}, 1, 139)) || '…' END AS preview, score::VARCHAR AS shown, CASE WHEN score >= 8 THEN 'high' WHEN score >= 4 THEN 'mid' ELSE 'low' END AS tier, quality::BIGINT AS quality FROM runs LEFT JOIN labels USING (doc_id)",
    "cost_ledger": f"""WITH pr AS (SELECT * FROM (VALUES {_PRICE_ROWS}) v(model, pi, po)), c AS (SELECT {ROLE} AS phase, CASE WHEN {ROLE} = 'user' THEN 'gpt-5' ELSE 'claude-opus-4-8' END AS model, {TOKENS} AS i FROM conversations)
SELECT phase, model, sum(i)::BIGINT AS input_tokens, sum(2 * i)::BIGINT AS output_tokens, round(sum(i / 1000 * pi + 2 * i / 1000 * po), 6) AS cost_usd FROM c JOIN pr USING (model) GROUP BY ALL""",
    "price_quotes": f"""WITH q AS (SELECT row_number() OVER () - 1 AS pos, * FROM (VALUES ('openai', 'gpt-5-5', 'normalized', 'builtin', 'gpt-5.5', 0.005::DOUBLE, 0.03::DOUBLE), ('anthropic', 'claude-opus-4-8', 'exact', 'builtin', 'claude-opus-4-8', 0.005, 0.025), ('openai', 'GPT-5', 'exact', 'builtin', 'gpt-5', 0.005, 0.015),
('xai', 'grok-4.9', 'rough', 'family', 'grok-4.x', 0.00125, 0.0025), ('gemini', 'gemini-3.5-flash-x', 'rough', 'family', 'gemini-3.5-flash', 0.0015, 0.009), ('openrouter', 'anthropic/claude-sonnet-4', 'exact', 'builtin', 'claude-sonnet-4', 0.003, 0.015),
(NULL, 'nobody-1', 'unknown', 'unknown', NULL, 0.0, 0.0), ('anthropic', 'claude-opus-4-6', 'rough', 'family', 'claude-opus-4.x', 0.005, 0.025)) v(provider, model, confidence, price_source, matched, input_per_1k, output_per_1k)),
c AS (SELECT doc_id % 8 AS pos, count(*) AS calls, sum({estimate('text')})::BIGINT AS input_tokens FROM documents GROUP BY ALL) SELECT q.* EXCLUDE (pos), calls, input_tokens FROM q JOIN c USING (pos)""",
    "build_estimate": f"""WITH {SIG}, t AS (SELECT count(*) AS n FROM fut), g AS (SELECT sum(ceil(c / 8.0))::BIGINT AS b FROM (SELECT count(*) AS c FROM sig GROUP BY group_id)), l AS (SELECT n, b, ceil(n / 120.0)::BIGINT * (n > 1)::BIGINT AS k, ceil(least(100, n) / 5.0)::BIGINT AS q FROM t, g)
SELECT 'phase2-filter' AS phase, n AS calls, n * 60 AS input_tokens, n AS output_tokens FROM l UNION ALL SELECT 'phase3-embeddings', (n > 0)::BIGINT, n * 100, 0 FROM l UNION ALL SELECT 'phase4-annotate', b, b * 950, b * 650 FROM l
UNION ALL SELECT 'phase4-canonical', k, k * 1200, k * 700 FROM l UNION ALL SELECT 'phase7-checklist', q, q * 1800, q * 700 FROM l UNION ALL SELECT 'phase7-merge', q, q * 2200, q * 650 FROM l""",
    "model_annotations": f"""WITH {SIG}, b AS (SELECT conv_id, prompt, group_id, (row_number() OVER (PARTITION BY group_id ORDER BY conv_id) - 1) // 8 AS bt FROM fut JOIN sig USING (conv_id)),
j AS (SELECT group_id, bt, string_agg(prompt, ' ' ORDER BY conv_id) AS prompt FROM b GROUP BY ALL), {annotated('j', 'bt', 'gm')}, {annotated('fut', 'conv_id')}
SELECT conv_id, CASE WHEN conv_id % 3 = 0 THEN gm.family ELSE ann.family END AS family, CASE WHEN conv_id % 3 = 0 THEN gm.domain ELSE ann.domain END AS domain,
lower(CASE WHEN conv_id % 3 = 0 THEN gm.label ELSE ann.label END) || ' reasoning|instruction following|clear explanation' AS skills, ann.difficulty, ann.specificity, conv_id % 3 <> 0 AS ok FROM ann JOIN b USING (conv_id) JOIN gm USING (group_id, bt)""",
}


def _first_words(t: str) -> str:
    return f"array_to_string((string_split({collapse(t)}, ' '))[1:80], ' ')"


_DETAIL = _quote((T.DETAIL * 4).strip())
ANSWERS = f"""ans AS (SELECT conv_id, model, trim(CASE model WHEN 'recorded:weak-1' THEN 'I don''t know.' WHEN 'recorded:brief-1' THEN 'Short answer: ' || {_first_words('prompt')}
WHEN 'recorded:detailed-1' THEN 'Here is a detailed answer to your request: ' || {_first_words('prompt')} || chr(10) || chr(10) || {_DETAIL} ELSE 'Here is a focused answer to your request: ' || {_first_words('prompt')} END) AS response
FROM fut, (VALUES ('recorded:plain-1'), ('recorded:weak-1'), ('recorded:brief-1'), ('recorded:detailed-1')) m(model))"""
JUDGED = f"""{ANSWERS}, jd AS (SELECT conv_id, model, 'recorded:judge-a' AS judge, {score('response')} AS score, CASE WHEN {score('response')} >= 8 THEN 0 ELSE 1 END AS n_weaknesses, true AS ok FROM ans
UNION ALL SELECT conv_id, model, 'recorded:judge-b', CASE WHEN length(response) % 2 = 1 THEN 5 ELSE least(10, 1 + length(response) % 13) END, (length(response) % 2)::INT, length(response) % 2 = 0 FROM ans)"""
_SKILLS = f"""sk AS (SELECT doc_id, prompt, label, domain, CASE WHEN doc_id % 2 = 0 THEN list_filter(list_transform(string_split(prompt, ','), lambda x: substr({collapse('x')}, 1, 200)), lambda x: x <> '') ELSE [lower(label) || ' reasoning', 'instruction following'] END AS c FROM ann),
sl AS (SELECT *, list_transform(c, lambda x: lower(x)) AS low FROM sk), so AS (SELECT *, list_transform((list_filter(c, lambda x, i: list_position(low, lower(x)) = i))[1:8], lambda x: substr(x, 1, 80)) AS o FROM sl),
sd AS (SELECT doc_id, domain, CASE WHEN len(o) = 0 THEN ['instruction following'] ELSE o END AS s FROM so)"""
LABELS = f"""{PROMPTS}, {annotated('prompts', 'doc_id')}, lc AS (SELECT family AS label, count(*) AS count FROM ann GROUP BY ALL),
ld AS (SELECT family AS label, string_agg(domain, '|' ORDER BY n DESC, p) FILTER (WHERE k <= 3) AS domains FROM (SELECT *, row_number() OVER (PARTITION BY family ORDER BY n DESC, p) AS k FROM (SELECT family, domain, count(*) AS n, min(doc_id) AS p FROM ann GROUP BY ALL)) GROUP BY ALL),
ls AS (SELECT family AS label, string_agg(skill, '|' ORDER BY n DESC, p) FILTER (WHERE k <= 6) AS skills FROM (SELECT *, row_number() OVER (PARTITION BY family ORDER BY n DESC, p) AS k FROM (SELECT family, skill, count(*) AS n, min(doc_id * 10 + i) AS p
  FROM (SELECT doc_id, family, unnest([lower(label) || ' reasoning', 'instruction following']) AS skill, unnest([0, 1]) AS i FROM ann) GROUP BY family, skill)) GROUP BY ALL),
lp AS (SELECT label, count, domains, skills FROM lc JOIN ld USING (label) JOIN ls USING (label))"""
_LOW = "lower(prompt)"
EVAL = f"""n AS (SELECT count(DISTINCT conv_id) AS n FROM conversations), ev AS (SELECT line::INT AS line, phase, provider, model, n AS calls, n * i AS input_tokens, n * o AS output_tokens, confidence, round(n * i / 1000 * pi + n * o / 1000 * po, 6) AS cost_usd
FROM n, (VALUES (0, 'answer', 'openai', 'gpt-5-5', 900, 700, 'normalized', 0.005::DOUBLE, 0.03::DOUBLE), (1, 'judge', 'anthropic', 'claude-opus-4-8', 1100, 180, 'exact', 0.005, 0.025), (2, 'judge', 'xai', 'grok-4.9', 1100, 180, 'rough', 0.00125, 0.0025), (3, 'judge', 'local', 'llama', 1100, 180, 'local', 0, 0)) v(line, phase, provider, model, i, o, confidence, pi, po)),
el AS (SELECT *, CASE WHEN confidence IN ('normalized', 'rough') THEN '≈' ELSE '' END || '$' || printf('%.2f', cost_usd) AS cost_label FROM ev)"""
BOARD = f"{RUNS}, o AS ({_overall('model', 'runs')}), board AS (SELECT *, row_number() OVER (ORDER BY weighted_score DESC, model) AS place FROM o)"

ORACLES |= {
    "fallback_annotations": f"""WITH {PROMPTS}, {annotated('prompts', 'doc_id')} SELECT doc_id, CASE WHEN label = 'General' THEN 'General assistance' WHEN {_has(_LOW, ('translate', 'french', 'spanish'))} THEN label || ' language support' WHEN {_has(_LOW, ('code', 'python', 'javascript'))} THEN label || ' software help' ELSE label || ' tasks' END AS family,
domain, CASE WHEN domain = 'Writing' AND NOT {_has(_LOW, ('email', 'essay', 'rewrite', 'draft'))} THEN 'General' ELSE domain END AS offline_domain FROM ann""",
    "task_skills": f"WITH {PROMPTS}, {annotated('prompts', 'doc_id')}, {_SKILLS} SELECT doc_id, array_to_string(s, '|') AS skills, substr(domain || '; skills: ' || array_to_string(s[1:4], ', '), 1, 500) AS description FROM sd",
    "candidate_answers": f"WITH {FIRST}, {ANSWERS} SELECT conv_id, model, response, true AS ok FROM ans",
    "judge_panel": f"WITH {FIRST}, {JUDGED} SELECT conv_id, model, judge, score, n_weaknesses, ok FROM jd",
    "panel_details": f"WITH {FIRST}, {JUDGED} SELECT conv_id, model, round(coalesce(median(score) FILTER (WHERE ok), median(score)), 4)::DOUBLE AS score, coalesce(max(score) FILTER (WHERE ok) - min(score) FILTER (WHERE ok), max(score) - min(score))::BIGINT AS judge_spread, string_agg(judge || '=' || score, ',' ORDER BY judge) AS judge_scores FROM jd GROUP BY ALL",
    "model_checklists": f"WITH {FIRST}, {annotated('fut', 'conv_id')} SELECT conv_id, array_to_string(list_value({_LABEL_ITEMS}, 'Covers the main ' || lower(label) || ' considerations'), '|') AS checklist, true AS ok FROM ann",
    "label_payload": f"WITH {LABELS} SELECT * FROM lp",
    "model_claims": f"WITH {LABELS} SELECT label, label AS family, string_split(domains, '|')[1] AS domain FROM lp",
    "top_families": f"WITH {PROMPTS}, {annotated('prompts', 'doc_id')} SELECT family, count(*) AS n FROM ann GROUP BY family ORDER BY n DESC, min(doc_id) LIMIT 5",
    "build_totals": f"WITH RECURSIVE {GROUPS}, {DOCS}, {annotated('src', 'doc_id')} SELECT count(*) AS n_tasks, count(DISTINCT family_id) AS n_families, count(DISTINCT family) AS n_labels, count(*) - count(DISTINCT root) AS n_suppressed FROM ann JOIN grp USING (doc_id)",
    "filter_counts": f"SELECT count(*) FILTER (WHERE is_task = 1) AS kept, count(*) FILTER (WHERE is_task = 0) AS dropped FROM ({ORACLES['nontask_filter']})",
    "eval_estimate": f"WITH {EVAL} SELECT * FROM el",
    "estimate_totals": f"WITH {EVAL} SELECT round(sum(cost_usd), 6) AS cost_usd, false AS any_unknown, true AS any_approximate, '≈$' || printf('%.2f', round(sum(cost_usd), 6)) AS shown FROM el",
    "catalog_quotes": f"""WITH c AS (SELECT lang AS provider, source AS model, regexp_extract(source, '[0-9]+')::INT AS k, count(*) AS calls, sum({estimate('text')})::BIGINT AS input_tokens FROM documents GROUP BY ALL),
j AS (SELECT *, sum(calls) OVER (PARTITION BY model) AS n FROM c),
h AS (SELECT *, CASE WHEN model = 'src4' AND provider = 'de' THEN 'own' WHEN k % 3 > 0 THEN 'lite' WHEN provider = 'fr' AND k % 4 <> 1 THEN 'router' ELSE 'none' END AS how FROM j)
SELECT provider, model, calls, input_tokens, CASE WHEN how = 'none' THEN 'unknown' ELSE 'exact' END AS confidence, CASE how WHEN 'own' THEN 'config' WHEN 'lite' THEN 'litellm' WHEN 'router' THEN 'openrouter' ELSE 'unknown' END AS price_source,
CASE how WHEN 'own' THEN 'de/src4' WHEN 'lite' THEN model WHEN 'router' THEN 'fr/' || model END AS matched,
CASE how WHEN 'own' THEN 0.001 WHEN 'lite' THEN (n || 'e-7')::DOUBLE * 1000 WHEN 'router' THEN (n || 'e-6')::DOUBLE * 1000 ELSE 0 END AS input_per_1k,
CASE how WHEN 'own' THEN 0.002 WHEN 'lite' THEN (k || 'e-7')::DOUBLE * 1000 WHEN 'router' THEN (k || 'e-6')::DOUBLE * 1000 ELSE 0 END AS output_per_1k FROM h""",
    "report_kpis": f"WITH {BOARD} SELECT count(*) AS n_runs, count(DISTINCT model) AS n_models, arg_min(model, place) AS top_model, arg_min(weighted_score, place) AS top_score, round(sum(n_tasks / 100), 6) AS total_cost, sum(n_tasks * 2)::DOUBLE AS total_wall FROM board",
    "combined_categories": f"WITH {RUNS}, m AS (SELECT model, lang AS category, round(avg(score), 4) AS s FROM runs JOIN (SELECT doc_id, lang FROM documents) USING (doc_id) GROUP BY ALL) SELECT category, round(avg(s), 4) AS score, count(*) AS n_runs FROM m GROUP BY category",
}

ORACLES["export_shapes"] = f"""WITH t AS (SELECT conv_id::VARCHAR AS conversation_id, turn, {ROLE} AS role, {STRIP} AS text FROM conversations WHERE {STRIP} <> ''),
a AS (SELECT 'tree' AS form, * FROM t WHERE role <> 'system' UNION ALL SELECT 'list', * FROM t UNION ALL SELECT 'lines', * FROM t)
SELECT form, conversation_id, (row_number() OVER (PARTITION BY form, conversation_id ORDER BY turn) - 1)::INT AS turn, role, sha256(text) AS digest FROM a"""
ORACLES["density_clusters"] = density_sql(EMB, f"{DOCS}, {signed('src', 'doc_id')}")
