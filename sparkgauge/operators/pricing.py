"""Price lookup, cost ledger, build estimates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..settings import Model, Settings

# USD per 1000 tokens (input, output).
PRICES = {
    "claude-opus-4-8": (0.005, 0.025),
    "claude-opus-4-7": (0.005, 0.025),
    "claude-sonnet-4": (0.003, 0.015),
    "claude-haiku-4-5-20251001": (0.001, 0.005),
    "gpt-5.5": (0.005, 0.030),
    "gpt-5.4": (0.0025, 0.015),
    "gpt-5.4-mini": (0.00075, 0.0045),
    "gpt-5": (0.005, 0.015),
    "gpt-4.1": (0.002, 0.008),
    "gemini-3.1-pro-preview": (0.002, 0.012),
    "grok-4.3": (0.00125, 0.0025),
    "text-embedding-3-small": (0.00002, 0.0),
}
# Rough prices; provider names, id prefix, family name, prices.
ROUGH = (
    (("anthropic",), "claude-", r"^claude-opus-4\.[5-9]", "claude-opus-4.x", 0.005, 0.025),
    (("anthropic",), "claude-", r"^claude-sonnet-4", "claude-sonnet-4.x", 0.003, 0.015),
    (("anthropic",), "claude-", r"^claude-haiku-4", "claude-haiku-4.x", 0.001, 0.005),
    (("openai",), "gpt-", r"^gpt-5\.5", "gpt-5.5", 0.005, 0.030),
    (("openai",), "gpt-", r"^gpt-5\.4-mini", "gpt-5.4-mini", 0.00075, 0.0045),
    (("openai",), "gpt-", r"^gpt-5\.4", "gpt-5.4", 0.0025, 0.015),
    (("google", "gemini", "vertex_ai"), "gemini-", r"^gemini-3\.1-pro", "gemini-3.1-pro", 0.002, 0.012),
    (("google", "gemini", "vertex_ai"), "gemini-", r"^gemini-3\.5-flash", "gemini-3.5-flash", 0.0015, 0.009),
    (("xai", "x-ai"), "grok-", r"^grok-4", "grok-4.x", 0.00125, 0.0025),
)
# Fixed values.
ALIASES = {"xai": ["xai", "x-ai"], "x-ai": ["x-ai", "xai"], "google": ["google", "gemini", "vertex_ai"], "gemini": ["gemini", "google", "vertex_ai"], "vertex_ai": ["vertex_ai", "google", "gemini"]}
# Tokens in and out of a call (or a task) of each phase.
EVAL_TOKENS = {"answer": (900, 700), "judge": (1100, 180)}
PHASES = (("phase2-filter", 60, 1), ("phase3-embeddings", 100, 0), ("phase4-annotate", 950, 650), ("phase4-canonical", 1200, 700), ("phase7-checklist", 1800, 700), ("phase7-merge", 2200, 650))


def builtin_catalog(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("builtin", k, a, b) for k, (a, b) in PRICES.items()], "source string, key string, input_per_1k double, output_per_1k double")


def catalog_rows(frame: DataFrame, source: str) -> DataFrame:
    """A catalog table from (key, input, output) rows; those without both prices are left out."""
    a, b = F.col("input").try_cast("double"), F.col("output").try_cast("double")
    return frame.where(a.isNotNull() & b.isNotNull()).select(F.lit(source).alias("source"), F.lower("key").alias("key"), a.alias("input_per_1k"), b.alias("output_per_1k"))


def override_rows(spark: SparkSession, prices: list[tuple[str | None, str, float, float]]) -> DataFrame:
    """Catalog rows of the settings' (provider, model, USD per million in, out). One of a provider counts for that provider
    (and its other names) alone."""
    rows = spark.createDataFrame([(p, m, float(a), float(b)) for p, m, a, b in prices], "provider string, model string, a double, b double")
    m, p = F.lower(F.trim("model")), F.lower(F.trim("provider"))
    ids = F.array_distinct(F.array(m, T.normalize_model_id(m)))
    named = F.flatten(F.transform(aliases(p), lambda n: F.transform(ids, lambda x: F.concat(n, F.lit("/"), x))))
    return rows.select(F.lit("config").alias("source"), F.explode(F.when(p.isNull(), ids).otherwise(named)).alias("key"), (F.col("a") / 1000).alias("input_per_1k"), (F.col("b") / 1000).alias("output_per_1k"))


def catalog(spark: SparkSession, settings: Settings) -> DataFrame:
    """The settings' own prices, those of the catalog files that they name, and the built-in ones."""
    rows = override_rows(spark, [(p.provider, p.model, p.input_per_1m, p.output_per_1m) for p in settings.prices])
    for form, path in settings.price_files:
        rows = rows.unionByName(CATALOG_FORMS[form](spark.read.text(path, wholetext=True)))
    return rows.unionByName(builtin_catalog(spark))


def openrouter_rows(catalog: DataFrame) -> DataFrame:
    """Catalog rows of JSON texts (value) with a `data` list of models; prices are USD a token."""
    item = "struct<id:string,canonical_slug:string,pricing:struct<prompt:string,completion:string>>"
    rows = catalog.select(F.explode(F.from_json("value", f"struct<data:array<{item}>>")["data"]).alias("i"))
    rows = rows.select(F.explode(F.array_distinct(F.array("i.id", "i.canonical_slug"))).alias("key"), F.col("i.pricing.prompt").try_cast("double").alias("input"), F.col("i.pricing.completion").try_cast("double").alias("output"))
    return catalog_rows(rows.where("key <> ''").withColumns({"input": F.col("input") * 1000, "output": F.col("output") * 1000}), "openrouter")


def litellm_rows(catalog: DataFrame) -> DataFrame:
    """Catalog rows of JSON texts (value), an object by model; prices are USD a token."""
    item = "struct<input_cost_per_token:string,output_cost_per_token:string>"
    rows = catalog.select(F.explode(F.from_json("value", f"map<string,{item}>")).alias("key", "i")).where("key <> 'sample_spec'")
    rows = rows.select("key", (F.col("i.input_cost_per_token").try_cast("double") * 1000).alias("input"), (F.col("i.output_cost_per_token").try_cast("double") * 1000).alias("output"))
    return catalog_rows(rows, "litellm")


#: Catalog files by form.
CATALOG_FORMS = {"openrouter": openrouter_rows, "litellm": litellm_rows}


def aliases(provider: Column) -> Column:
    """The names that a provider goes by, its own first."""
    out = F.when(provider.isNull(), F.array().cast("array<string>")).otherwise(F.array(provider))
    for k, v in ALIASES.items():
        out = F.when(provider == k, F.array(*[F.lit(x) for x in v])).otherwise(out)
    return out


def quotes(models: DataFrame, catalog: DataFrame) -> DataFrame:
    """provider, model, confidence, price_source, matched, input_per_1k, output_per_1k of (provider, model) rows.

    Candidate keys in order: exact ones, then normalised; within each, sources by priority; then key order."""
    m = F.trim("model")
    bare = F.when(m.contains("/"), F.expr("substring(trim(model), instr(trim(model), '/') + 1)")).otherwise(m)
    p = F.lower(F.trim("provider"))
    names = aliases(p)
    norm_raw, norm_bare = T.normalize_model_id(m), T.normalize_model_id(bare)
    prefixed = lambda x, y: F.flatten(F.transform(names, lambda n: F.array(F.concat(n, F.lit("/"), x), F.concat(n, F.lit("/"), y))))
    exact = F.concat(F.array(m, bare), prefixed(m, bare))
    near = F.concat(F.array(norm_raw, norm_bare), prefixed(norm_raw, norm_bare))
    rows = models.select("provider", "model", F.explode(F.array(F.struct(F.lit(0).alias("g"), exact.alias("ks")), F.struct(F.lit(1).alias("g"), near.alias("ks")))).alias("c"))
    rows = rows.select("provider", "model", F.col("c.g").alias("g"), F.posexplode("c.ks").alias("pos", "k")).withColumn("k", F.lower("k"))
    rank = F.when(F.col("source") == "config", 0).when(F.col("source") == "builtin", 3)
    openrouter = F.col("provider") == "openrouter"
    rank = rank.when(F.col("source") == "openrouter", F.when(openrouter, 1).otherwise(2)).otherwise(F.when(openrouter, 2).otherwise(1))
    hits = rows.join(catalog, rows.k == catalog.key)
    best = hits.groupBy("provider", "model").agg(F.min_by(F.struct("g", "source", "key", "input_per_1k", "output_per_1k"), F.struct(F.col("g"), rank.alias("r"), F.col("pos"))).alias("h"))
    rough = F.lit(None).cast("struct<n:string,a:double,b:double>")
    for provs, prefix, pattern, name, a, b in reversed(ROUGH):
        here = (F.coalesce(p, F.lit("")).isin(*provs) | norm_bare.startswith(prefix)) & norm_bare.rlike(pattern)
        rough = F.when(here, F.struct(F.lit(name).alias("n"), F.lit(a).alias("a"), F.lit(b).alias("b"))).otherwise(rough)
    keyed = models.withColumn("rough", rough).join(best.select(F.col("provider").alias("_p"), F.col("model").alias("_m"), "h"), F.col("provider").eqNullSafe(F.col("_p")) & (F.col("model") == F.col("_m")), "left")
    hit = F.col("h").isNotNull()
    return keyed.select(
        "provider", "model", F.when(hit, F.when(F.col("h.g") == 0, "exact").otherwise("normalized")).when(F.col("rough").isNotNull(), "rough").otherwise("unknown").alias("confidence"),
        F.when(hit, F.col("h.source")).when(F.col("rough").isNotNull(), "family").otherwise("unknown").alias("price_source"), F.coalesce("h.key", "rough.n").alias("matched"),
        F.coalesce("h.input_per_1k", "rough.a", F.lit(0.0)).alias("input_per_1k"), F.coalesce("h.output_per_1k", "rough.b", F.lit(0.0)).alias("output_per_1k"),
    )


def cost_ledger(calls: DataFrame) -> DataFrame:
    """phase, model totals of (phase, model, input_tokens, output_tokens, input_per_1k, output_per_1k) rows."""
    cost = F.col("input_tokens") / 1000 * F.col("input_per_1k") + F.col("output_tokens") / 1000 * F.col("output_per_1k")
    return calls.groupBy("phase", "model").agg(F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"), F.round(F.sum(cost), 6).alias("cost_usd"))


def build_estimate(spark: SparkSession, tasks: int, group_sizes: DataFrame | None, target: int = 100, panel: int = 1) -> DataFrame:
    """phase, calls, input_tokens, output_tokens of a build over `tasks` prompts."""
    ceil = lambda n, d: -(-n // d)
    batches = ceil(tasks, 8) if group_sizes is None else (group_sizes.agg(F.sum(F.ceil(F.col("n") / 8))).first()[0] or 0)
    lists = ceil(min(target, tasks), 5)
    calls = {"phase2-filter": (tasks, tasks), "phase3-embeddings": (1 if tasks else 0, tasks), "phase4-annotate": (batches, batches), "phase4-canonical": ((ceil(tasks, 120) if tasks > 1 else 0),) * 2, "phase7-checklist": (lists * panel,) * 2, "phase7-merge": (lists,) * 2}
    return spark.createDataFrame([(n, int(calls[n][0]), int(calls[n][1] * i), int(calls[n][1] * o)) for n, i, o in PHASES], "phase string, calls long, input_tokens long, output_tokens long")


def eval_estimate(spark: SparkSession, tasks: int, candidate: Model, judges: list[Model]) -> DataFrame:
    """line, phase, provider, model, calls, input_tokens, output_tokens: the candidate's answers, then each judge."""
    asked = [("answer", candidate), *(("judge", j) for j in judges)]
    rows = [(i, phase, m.provider, m.model, tasks, tasks * EVAL_TOKENS[phase][0], tasks * EVAL_TOKENS[phase][1]) for i, (phase, m) in enumerate(asked)]
    return spark.createDataFrame(rows, "line int, phase string, provider string, model string, calls long, input_tokens long, output_tokens long")


def priced(lines: DataFrame, catalog: DataFrame, local: list[str] = ()) -> DataFrame:
    """Estimate lines with confidence, cost_usd and cost_label. Models of `local` providers cost nothing."""
    q = quotes(lines.select("provider", "model").distinct(), catalog).select(F.col("provider").alias("_p"), F.col("model").alias("_m"), "confidence", "input_per_1k", "output_per_1k")
    free = F.col("provider").isin(*local) if local else F.lit(False)
    rows = lines.join(q, F.col("provider").eqNullSafe(F.col("_p")) & (F.col("model") == F.col("_m")), "left")
    cost = F.when(free, 0.0).otherwise(F.round(F.col("input_tokens") / 1000 * F.col("input_per_1k") + F.col("output_tokens") / 1000 * F.col("output_per_1k"), 6))
    rows = rows.withColumn("confidence", F.when(free, "local").otherwise(F.col("confidence"))).withColumn("cost_usd", cost)
    return rows.select("line", "phase", "provider", "model", "calls", "input_tokens", "output_tokens", "confidence", "cost_usd", T.cost_label(F.col("cost_usd"), F.col("confidence")).alias("cost_label"))


def estimate_totals(lines: DataFrame) -> DataFrame:
    """One row: known cost, whether any price is unknown or approximate, and the total as it is shown."""
    rows = lines.agg(F.coalesce(F.round(F.sum("cost_usd"), 6), F.lit(0.0)).alias("cost_usd"), F.coalesce(F.bool_or(F.col("confidence") == "unknown"), F.lit(False)).alias("any_unknown"), F.coalesce(F.bool_or(F.col("confidence").isin("normalized", "rough")), F.lit(False)).alias("any_approximate"))
    shown = F.concat(F.when(F.col("any_approximate"), "≈$").otherwise("$"), F.format_string("%.2f", "cost_usd"), F.when(F.col("any_unknown"), " + unknown").otherwise(""))
    return rows.withColumn("shown", shown)
