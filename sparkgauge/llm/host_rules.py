"""Quality rules by host: documents' failures of each rule are counted for each source, the rates are shrunk with an
empirical beta prior, and the host verdicts are joined back to the documents. DataFrame functions only.

Four rules: `few` (under MIN_WORDS words), `repeat` (over half of the words in three-word windows that occur twice or more
in the text), `lines` (DUP_LINES or more repeated lines) and `symbols` (over SYMBOL_PERCENT symbols in a hundred characters of
words). The first two are the base: who fails one goes, whatever the host.

A host's rate for a rule is (failures + a) / (documents + a + b); a and b are fitted to all hosts by moments, for each rule
apart (see `prior`). Two verdicts come back to the documents:

* a host is bad if, for some rule, its rate less two posterior deviations is over REJECT and over TIMES the corpus's rate;
  all its documents go;
* a document that fails `lines` or `symbols` goes, unless its host's rate for that rule is under LENIENT times the
  corpus's: where a rule nearly never fails, one failure says little about a document.

Null and empty texts: no words, base_failed. Null source: a host of its own. Long texts: whole, sorted within
their row. Repeated rows and null ids: a row each, counted each. Empty table: no rows. Columns of the table other than
doc_id, text and source are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

SPACE = " \t\n\x0b\x0c\r"
MIN_WORDS = 50
DUP_LINES, SYMBOL_PERCENT = 3, 2
REJECT, TIMES, LENIENT = 0.5, 3.0, 0.5
RULES = ("few", "repeat", "lines", "symbols")
EXTRA = ("lines", "symbols")


def features(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string").alias("host"), text.alias("t"))
    spaced = F.translate("t", SPACE[1:], " " * 5)
    blank = F.length("t") - F.length(F.translate("t", SPACE, ""))
    symbols = F.length("t") - F.length(F.translate("t", "#*$%&|<>", ""))
    lines = F.filter(F.split("t", "\n"), lambda x: F.trim(F.translate(x, "\t\x0b\x0c\r", "    ")) != "")
    rows = rows.select(
        "doc_id", "host", (F.length("t") - blank).cast("long").alias("word_chars"), symbols.cast("long").alias("n_symbols"),
        F.filter(F.split(spaced, " +"), lambda w: w != "").alias("w"), lines.alias("l"),
    )
    rows = rows.select(
        "doc_id", "host", "word_chars", "n_symbols", F.size("w").cast("long").alias("n_words"), (F.size("l") - F.size(F.array_distinct("l"))).cast("long").alias("n_dup_lines"),
        # Two shifted copies zip with the words: window i has words i, i + 1, i + 2.
        F.when(F.size("w") < 3, F.array().cast("array<struct<h:bigint,i:int>>")).otherwise(_windows(F.col("w"))).alias("h"),
    )
    # Equal windows are neighbours after sorting by (hash, place).
    rows = rows.withColumn("h", F.array_sort("h"))
    again = F.filter(
        F.transform("h", lambda x, k: F.when((F.get("h", k - 1)["h"] == x["h"]) | (F.get("h", k + 1)["h"] == x["h"]), x["i"])),
        lambda i: i.isNotNull(),
    )
    rows = rows.withColumn("p", F.array_sort(again)).drop("h")
    # Window places p, ascending, cover three words each; a window adds no more than the distance to the next.
    covered = F.aggregate(
        F.transform("p", lambda x, k: F.least(F.lit(3), F.coalesce(F.get("p", k + 1) - x, F.lit(3)))), F.lit(0).cast("long"), lambda s, x: s + x
    )
    return rows.select("doc_id", "host", "n_words", "word_chars", "n_symbols", "n_dup_lines", F.when(F.size("p") > 0, covered).otherwise(F.lit(0)).cast("long").alias("n_repeat_words"))


def _windows(w: Column) -> Column:
    """Structs (hash of three neighbouring words, place)."""
    hashes = F.transform(w, lambda x: F.xxhash64(x))
    return F.transform(
        F.slice(F.arrays_zip(hashes.alias("a"), F.slice(hashes, F.lit(2), F.size(w)).alias("b"), F.slice(hashes, F.lit(3), F.size(w)).alias("c")), F.lit(1), F.greatest(F.size(w) - 2, F.lit(1))),
        lambda z, k: F.struct(F.xxhash64(z["a"], z["b"], z["c"]).alias("h"), k.alias("i")),
    )


def failures() -> dict[str, Column]:
    """Whether a document fails each rule."""
    return {
        "few": F.col("n_words") < MIN_WORDS, "repeat": 100 * F.col("n_repeat_words") > 50 * F.col("n_words"),
        "lines": F.col("n_dup_lines") >= DUP_LINES, "symbols": 100 * F.col("n_symbols") > SYMBOL_PERCENT * F.col("word_chars"),
    }


def prior(failed: float, n: float, squares: float, hosts: int) -> tuple[float, float]:
    """Beta prior of a host's failure rate by moments over all hosts, each with its share of documents. `squares` is the
    sum of failures ** 2 / documents over the hosts.

    mean m = failures / documents; v = the weighted variance of the hosts' rates, less the part that counting
    explains. a + b = m (1 - m) / v - 1, held to 1 .. 1e6 (without spread: 1e6, so all hosts get the mean)."""
    if not n:
        return 0.5, 0.5
    m = failed / n
    spread = squares / n - m * m - m * (1 - m) * hosts / n
    size = min(1e6, max(1.0, m * (1 - m) / spread - 1)) if spread > 1e-12 else 1e6
    return max(m * size, 1e-6), max((1 - m) * size, 1e-6)


def host_verdicts(base: DataFrame) -> DataFrame:
    """host, n, bad, and for each rule its shrunk rate and whether it counts there. base: a row a document with host and RULES."""
    hosts = base.groupBy("host").agg(F.count("*").alias("n"), *[F.sum(F.col(r).cast("long")).alias(r) for r in RULES])
    sums = hosts.agg(F.sum("n").alias("n"), F.count("*").alias("k"), *[f(r) for r in RULES for f in (lambda r: F.sum(r).alias(r), lambda r: F.sum(F.col(r) * F.col(r) / F.col("n")).alias("q_" + r))]).first()
    rates, bad, counts = {}, F.lit(False), {}
    for r in RULES:
        a, b = prior(sums[r] or 0, sums["n"] or 0, sums["q_" + r] or 0.0, sums["k"])
        mean = (sums[r] or 0) / (sums["n"] or 1)
        rate = (F.col(r) + a) / (F.col("n") + a + b)
        bad = bad | (rate - 2 * F.sqrt(rate * (1 - rate) / (F.col("n") + a + b + 1)) > max(REJECT, TIMES * mean))
        rates["rate_" + r], counts["counts_" + r] = rate, rate >= LENIENT * mean
    return hosts.select("host", "n", bad.alias("bad"), *[c.alias(k) for k, c in (rates | counts).items()])


def host_quality(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept."""
    base = cut(features(docs).withColumns(failures()), "rules")
    verdicts = host_verdicts(base).withColumnRenamed("host", "of")
    failed = F.col("few") | F.col("repeat")
    extra = F.lit(False)
    for r in EXTRA:
        extra = extra | (F.col(r) & F.col("counts_" + r))
    return base.join(verdicts, F.col("host").eqNullSafe(F.col("of")), "left").select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & ~F.col("bad") & ~extra).alias("kept")
    )


def _sql() -> str:
    """The DuckDB twin."""
    per = lambda f, join=", ": join.join(f.replace("@", r) for r in RULES)
    return rf"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT k, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d),
win AS (SELECT k, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g FROM (SELECT k, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) > 2)),
rep AS (SELECT k, i FROM (SELECT k, i, count(*) OVER (PARTITION BY k, g) AS c FROM win) WHERE c > 1),
cov AS (SELECT k, count(*) AS n FROM (SELECT DISTINCT k, i + j AS p FROM rep, (VALUES (0), (1), (2)) v(j)) GROUP BY k),
f AS (
  SELECT d.k, doc_id, source, len(ws)::BIGINT AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
    (len(ln) - len(list_distinct(ln)))::BIGINT AS n_dup_lines, coalesce(cov.n, 0)::BIGINT AS n_repeat_words
  FROM (SELECT *, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ln FROM d) d JOIN w USING (k) LEFT JOIN cov USING (k)),
b AS (SELECT *, n_words < {MIN_WORDS} AS few, 100 * n_repeat_words > 50 * n_words AS repeat, n_dup_lines >= {DUP_LINES} AS lines, 100 * n_symbols > {SYMBOL_PERCENT} * word_chars AS symbols FROM f),
h AS (SELECT source, count(*)::DOUBLE AS n, {per("sum(@::INT)::DOUBLE AS @")} FROM b GROUP BY source),
m AS (SELECT count(*) AS hosts, sum(n) AS total, {per("sum(@) / sum(n) AS m_@, sum(@ * @ / n) / sum(n) AS q_@")} FROM h),
z AS (SELECT *, {per("q_@ - m_@ * m_@ - m_@ * (1 - m_@) * hosts / total AS v_@")} FROM m),
p AS (SELECT *, {per("CASE WHEN v_@ > 1e-12 THEN least(1e6, greatest(1.0, m_@ * (1 - m_@) / v_@ - 1)) ELSE 1e6 END AS s_@")} FROM z),
r AS (SELECT source, n, {per("m_@, (@ + greatest(m_@ * s_@, 1e-6)) / (n + greatest(m_@ * s_@, 1e-6) + greatest((1 - m_@) * s_@, 1e-6)) AS r_@, n + greatest(m_@ * s_@, 1e-6) + greatest((1 - m_@) * s_@, 1e-6) + 1 AS w_@")} FROM h, p),
v AS (SELECT source, {per(f"r_@ - 2 * sqrt(r_@ * (1 - r_@) / w_@) > greatest({REJECT}, {TIMES} * m_@)", " OR ")} AS bad, {per(f"r_@ >= {LENIENT} * m_@ AS c_@")} FROM r)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, few OR repeat AS base_failed, NOT (few OR repeat) AND NOT bad AND NOT ({" OR ".join(f"{x} AND c_{x}" for x in EXTRA)}) AS kept
FROM b JOIN v ON b.source IS NOT DISTINCT FROM v.source
"""


SQL = _sql()
