"""Line deduplication with levelled sorted runs of line hashes. DataFrame functions only.

A line's key is the line stripped of white space at both ends, A-Z lower-cased. A key of MIN_CHARS code points that
DOCS documents hold loses all its lines but those in the largest doc_id that holds it.

`LineRuns` keeps what is known of the keys as runs: tables of (key, n, last), bucketed and sorted by key, where n counts
documents and last is their largest doc_id. Documents come in batches. A batch counts its own keys, merge-anti-joins the runs
(a key goes where a run alone has DOCS documents of it and a last at least as large: nothing could change for it) and adds what
is left as a new run of level 0. Two runs of a level are compacted into one of the next by a full outer merge join, so a key
is rewritten a logarithmic number of times, and a line that a third of all documents share costs a row a batch until a run has
settled it. As the runs are bucketed alike, neither the anti-joins nor compaction shuffle them; a batch alone is shuffled,
after counting on the map side. The order of batches doesn't matter to the result; `dedup` deals documents in descending
doc_id, which settles keys soonest.

Keys are compared by their MD5 (128 bits). A document is a doc_id: rows that share one count once and all keep or lose a
line. Null doc_id: one document, smaller than all others. Null and empty text: one empty line, kept. Long texts: whole; a row's
dropped lines are listed by place, once each. Repeated rows: a row each. Empty table: no rows. Other columns aren't read by
`dedup` and stay as they are in `deduplicated` (a changed text gets a new n_chars where there is such a column).
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, discard, shared_dir

MIN_CHARS, DOCS = 40, 5
BATCHES = 8
SPACE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Stands for a null doc_id.
NO_ID = -(2**63)


def key_of(line: Column) -> Column:
    """The line stripped and with A-Z lower-cased; lines of ASCII alone take the faster function."""
    bare = F.btrim(line, F.lit(SPACE))
    return F.when(F.length(bare) == F.octet_length(bare), F.lower(bare)).otherwise(F.translate(bare, UPPER, LOWER))


def line_keys(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """doc, digest (of the text, so that rows of one doc_id are told apart), place, key of each line that is long enough."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(_doc().alias("doc"), F.xxhash64(text).alias("digest"), F.posexplode(F.split(text, "\n")).alias("place", "line"))
    long_enough = F.length(F.btrim("line", F.lit(SPACE))) >= min_chars
    return rows.where(long_enough).select("doc", "digest", "place", F.unhex(F.md5(key_of(F.col("line")))).alias("key"))


def _doc() -> Column:
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))


class LineRuns:
    """What is known of line keys after some batches."""

    def __init__(self, spark: SparkSession, docs: int = DOCS):
        self.spark, self.docs = spark, docs
        #: Joins on key shuffle to as many partitions as runs have buckets.
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        #: (level, run), the oldest and highest level first; levels differ.
        self.runs: list[tuple[int, DataFrame]] = []

    def add(self, lines: DataFrame) -> None:
        """Take a batch's lines (doc, key). No document may be in two batches."""
        own = lines.groupBy("key").agg(F.countDistinct("doc").alias("n"), F.max("doc").alias("last"))
        for _, run in self.runs:
            known = run.select(F.col("key").alias("run_key"), F.col("n").alias("run_n"), F.col("last").alias("run_last"))
            settled = (F.col("run_n") >= self.docs) & (F.col("run_last") >= F.col("last"))
            own = own.join(known, (F.col("key") == F.col("run_key")) & settled, "left_anti")
        self.runs.append((0, self._write(own)))
        while len(self.runs) > 1 and self.runs[-1][0] == self.runs[-2][0]:
            self._compact()

    def repeated(self) -> DataFrame:
        """key, last of the keys that enough documents hold."""
        while len(self.runs) > 1:
            self._compact()
        return self.runs[0][1].where(F.col("n") >= self.docs).select("key", "last")

    def close(self) -> None:
        for _, run in self.runs:
            self._drop(run)
        self.runs.clear()

    def _compact(self) -> None:
        """Merge the two newest runs."""
        (level, old), (_, new) = self.runs[-2:]
        newer = new.select(F.col("key").alias("new_key"), F.col("n").alias("new_n"), F.col("last").alias("new_last"))
        n = F.coalesce("n", F.lit(0)) + F.coalesce("new_n", F.lit(0))
        both = old.join(newer, F.col("key") == F.col("new_key"), "full").select(F.coalesce("key", "new_key").alias("key"), n.alias("n"), F.greatest("last", "new_last").alias("last"))
        self.runs[-2:] = [(level + 1, self._write(both))]
        self._drop(old)
        self._drop(new)

    def _write(self, rows: DataFrame) -> DataFrame:
        name = f"sparkgauge_run_{uuid.uuid4().hex}"
        path = f"{shared_dir(self.spark)}/{name}"
        rows.write.bucketBy(self.buckets, "key").sortBy("key").option("path", path).option("compression", "zstd").saveAsTable(name)
        run = self.spark.table(name)
        run._sparkgauge_path, run._sparkgauge_name = path, name
        return run

    def _drop(self, run: DataFrame) -> None:
        self.spark.sql(f"DROP TABLE {run._sparkgauge_name}")
        discard(run)


def dropped_lines(docs: DataFrame, min_chars: int = MIN_CHARS, least: int = DOCS, batches: int = BATCHES) -> DataFrame:
    """doc, digest, places: the places (from 0) of the lines that a text loses. A written table."""
    spark = docs.sparkSession
    cuts = docs.agg(F.percentile_approx(_doc(), [i / batches for i in range(batches - 1, 0, -1)], 10_000).alias("at")).first()["at"] or []
    batch = F.lit(0)
    for edge in cuts:  # descending
        batch = batch + (F.col("doc") <= edge).cast("int")
    lines = cut(line_keys(docs, min_chars).withColumn("batch", batch), "lines", by=["batch"])
    runs = LineRuns(spark, least)
    for b in range(len(cuts) + 1):
        runs.add(lines.where(F.col("batch") == b))
    repeated = cut(runs.repeated(), "repeated")
    runs.close()
    gone = lines.join(repeated, "key").where("doc < last")
    places = cut(gone.groupBy("doc", "digest").agg(F.collect_set("place").alias("places")), "places")
    discard(lines, repeated)
    return places


def _kept(docs: DataFrame, places: DataFrame) -> DataFrame:
    """docs with _places (null: none). A merge join at every size: places grow with the corpus, and texts move once."""
    text = F.coalesce("text", F.lit(""))
    told = places.select(F.col("doc").alias("_of"), F.col("digest").alias("_digest"), F.col("places").alias("_places"))
    return docs.join(told.hint("merge"), (_doc() == F.col("_of")) & (F.xxhash64(text) == F.col("_digest")), "left")


def _rest() -> Column:
    """The text without the lines at _places. The split lines are bound once, as a lambda's variable."""
    lines = F.split(F.coalesce("text", F.lit("")), "\n")
    left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("_places"))
    return F.array_join(F.get(F.transform(F.array(lines), lambda all_: F.transform(left, lambda i: F.get(all_, i))), 0), "\n")


def dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256 of each document."""
    text = F.coalesce("text", F.lit(""))
    rows = _kept(docs.select(F.col("doc_id").cast("long"), text.alias("text")), dropped_lines(docs))
    kept = F.when(F.col("_places").isNull(), F.col("text")).otherwise(_rest())
    return rows.select("doc_id", F.size(F.split("text", "\n")).cast("long").alias("n_lines"), F.coalesce(F.size("_places"), F.lit(0)).cast("long").alias("n_dropped"), F.sha2(kept, 256).alias("kept_sha256"))


def deduplicated(docs: DataFrame) -> DataFrame:
    """docs without the lines that go; a text that loses none stays as it is."""
    rows = _kept(docs, dropped_lines(docs)).withColumn("_rest", F.when(F.col("_places").isNotNull(), _rest()))
    changed = {"text": F.coalesce("_rest", "text")}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.coalesce(F.length("_rest").cast(docs.schema["n_chars"].dataType), "n_chars")
    return rows.select(*[changed.get(c, F.col(c)).alias(c) for c in docs.columns])


#: The DuckDB twin of `dedup`.
SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT k, doc_id, unnest(ls) AS line, unnest(range(1, len(ls) + 1)) AS place FROM d),
x AS (SELECT *, translate(regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''), '{UPPER}', '{LOWER}') AS key FROM l),
r AS (SELECT key, max(doc_id) AS last FROM x WHERE length(key) >= {MIN_CHARS} GROUP BY key HAVING count(DISTINCT doc_id) >= {DOCS}),
m AS (SELECT x.k, x.doc_id, x.line, x.place, coalesce(x.doc_id < r.last, false) AS gone FROM x LEFT JOIN r USING (key))
SELECT doc_id, count(*)::BIGINT AS n_lines, sum(gone::INT)::BIGINT AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY k, doc_id
"""
