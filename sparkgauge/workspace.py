"""A workspace folder: tables as Parquet; small records as JSON. What grows by exports is kept in buckets by conversation, of which an
export rewrites those it touches; a phase's result is a new folder that the catalog then points to."""

from __future__ import annotations

import json
import shutil
import uuid
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import settings as S
from .calls import records
from .sources.lock import benchmark_meta, content_hash
from .storage import cut

CONVERSATIONS = "conversation_id string, model_used string, metadata_json string, source_adapter string"
TURNS = "conversation_id string, turn int, role string, text string, ts string"
#: Folders that a table which grows by merges has, and the column that names a row's.
BUCKETS, BUCKET = 64, "_bucket"
EMPTY = {"conversations": CONVERSATIONS, "turns": TURNS}


class Workspace:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.root = spark, Path(folder)
        self.settings_file, self.records = self.root / "settings.toml", self.root / "records.json"

    def init(self, force: bool = False) -> bool:
        """Make the folder and its settings; False where settings are there already."""
        self.root.mkdir(parents=True, exist_ok=True)
        if self.settings_file.exists() and not force:
            return False
        self.settings_file.write_text(S.DEFAULT.lstrip(), encoding="utf-8")
        return True

    def settings(self) -> S.Settings:
        return S.load(self.settings_file)

    def _records(self) -> dict[str, Any]:
        return json.loads(self.records.read_text(encoding="utf-8")) if self.records.exists() else {"tables": {}, "cache": {}, "versions": []}

    def _record(self, change) -> None:
        got = self._records()
        change(got)
        self.root.mkdir(parents=True, exist_ok=True)
        self.records.with_suffix(".new").write_text(json.dumps(got, indent=1, sort_keys=True), encoding="utf-8")
        self.records.with_suffix(".new").replace(self.records)

    def _stored(self, name: str) -> DataFrame | None:
        where = self._records()["tables"].get(name)
        return self.spark.read.option("mergeSchema", True).parquet(str(self.root / where)) if where else None

    def table(self, name: str) -> DataFrame:
        found = self._stored(name)
        if found is not None:
            return found.drop(BUCKET)
        if name in EMPTY:
            return self.spark.createDataFrame([], EMPTY[name])
        raise KeyError(f"no table '{name}' yet")

    def has(self, name: str) -> bool:
        return name in self._records()["tables"]

    def write(self, name: str, rows: DataFrame) -> DataFrame:
        """Replace a table. Readers of the old one are done by then, so it goes."""
        old, new = self._records()["tables"].get(name), f"tables/{name}-{uuid.uuid4().hex[:12]}"
        rows.write.parquet(str(self.root / new))
        self._record(lambda r: r["tables"].update({name: new}))
        if old:
            shutil.rmtree(self.root / old, ignore_errors=True)
        return self.table(name)

    def merge(self, name: str, rows: DataFrame, key: str) -> None:
        """Put rows into a bucketed table: a key's rows replace all that the table has of it. Only buckets that a key of rows is in are
        read and written; the others' files stay. Doing it again gives the same table."""
        bucketed = lambda t: t.withColumn(BUCKET, F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int"))
        new = cut(bucketed(rows), "new")
        old, where = self._stored(name), f"tables/{name}"
        if old is not None:
            whole = BUCKET not in old.columns  # of an older form: all buckets are written
            touched = [r[0] for r in new.select(BUCKET).distinct().collect()]  # at most BUCKETS
            mine = bucketed(old) if whole else old.where(F.col(BUCKET).isin(touched))
            new = cut(mine.join(new.select(key).distinct(), key, "left_anti").unionByName(new, allowMissingColumns=True), "merged")
        new.hint("rebalance", BUCKET).write.partitionBy(BUCKET).mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(str(self.root / where))
        self._record(lambda r: r["tables"].update({name: where}))

    def ingest(self, turns: DataFrame, adapter: str) -> int:
        """Add an export's turns: a conversation that is there already is replaced with all its turns. Returns how many came."""
        turns = cut(turns, "turns")
        new = turns.groupBy("conversation_id").agg(F.first("model_used").alias("model_used"), F.first("metadata_json").alias("metadata_json")).withColumn("source_adapter", F.lit(adapter))
        self.merge("turns", turns.select(*[x.split()[0] for x in TURNS.split(", ")]), "conversation_id")
        self.merge("conversations", new, "conversation_id")
        return new.count()

    def state_rows(self, columns: list[str]) -> DataFrame:
        """These columns of the tasks, in id order."""
        tasks = self.table("tasks")
        unknown = set(columns) - set(tasks.columns)
        if unknown:
            raise ValueError(f"unknown task columns: {sorted(unknown)}")
        return tasks.select(*columns).orderBy("conversation_id")

    @property
    def calls_folder(self) -> str:
        return str(self.root / "calls")

    def calls(self) -> DataFrame:
        """A row for each paid call of builds and evaluations."""
        return records(self.spark, self.calls_folder)

    def digest(self, *tables: DataFrame) -> str:
        """Of the tables' rows, whatever their order."""
        parts = []
        for t in tables:
            h = F.xxhash64(*[F.col(c).cast("string") if dict(t.dtypes)[c].startswith("map") else F.to_json(F.struct(c)) for c in t.columns])
            r = t.agg(F.count("*").alias("n"), F.coalesce(F.sum(h.cast("decimal(38,0)")), F.lit(0)).cast("string").alias("s"), F.bit_xor(h).alias("x")).first()
            parts.append([t.columns, r.n, r.s, r.x])
        return content_hash(parts)

    def cache_key(self, phase: int, digest: str, settings: S.Settings) -> str:
        return content_hash({"phase": phase, "input": digest, "config": S.build_identity(settings), "seed": settings.seed})

    def cached(self, phase: int, key: str | None = None) -> dict | None:
        """The phase's latest output; with a key, only if it is that key's."""
        got = self._records()["cache"].get(str(phase))
        return got["output"] if got and key in (None, got["key"]) else None

    def remember(self, phase: int, key: str, output: dict) -> None:
        self._record(lambda r: r["cache"].update({str(phase): {"key": key, "output": output}}))
        (self.root / "cache").mkdir(exist_ok=True)
        (self.root / "cache" / f"phase{phase}.json").write_text(json.dumps({"cache_key": key, "output": output}, sort_keys=True, indent=1), encoding="utf-8")

    def add_version(self, version: dict) -> None:
        self._record(lambda r: r["versions"].append(version))

    def latest_hash(self) -> str | None:
        return max(self._records()["versions"], key=lambda v: v["version"], default={"hash": None})["hash"]

    def status(self) -> dict:
        """What is there, and what to do next."""
        try:
            state = "ok" if self.settings_file.exists() and self.settings() else "missing"
        except (S.SettingsError, ValueError) as e:
            state = f"invalid: {e}"
        conversations = self.table("conversations").count() if self.has("conversations") else 0
        digest, tasks = benchmark_meta(str(self.root))
        runs = len(list(self.root.glob("runs/*/*/summary.json")))
        ladder = ((state == "missing", "init"), (state.startswith("invalid"), "mend settings.toml, then status"), (not conversations, "ingest <export>"), (not digest, "build"), (not runs, "eval --model <provider/model>"))
        return {"settings": state, "conversations": conversations, "benchmark_tasks": tasks if digest else None, "runs": runs, "next": next((what for on, what in ladder if on), "leaderboard, or open report.html")}


def apply_review(tasks: DataFrame, edits: DataFrame) -> DataFrame:
    """Tasks after edits (conversation_id, checklist_text, importance_delta; null: no change): lines of the text are items, bullets
    taken off and blanks left out; importance moves in [0, 1]."""
    items = F.filter(F.transform(F.split("checklist_text", "\n"), lambda x: F.regexp_replace(F.trim(x), "^[- ]+|[- ]+$", "")), lambda x: x != "")
    e = edits.select(F.col("conversation_id").alias("_c"), F.when(F.col("checklist_text").isNotNull(), items).alias("_items"), "importance_delta")
    moved = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce("importance", "family_importance", F.lit(0.0)) + F.col("importance_delta")))
    joined = tasks.join(e, F.col("conversation_id") == F.col("_c"), "left")
    return joined.withColumn("checklist", F.coalesce("_items", "checklist")).withColumn("importance", F.when(F.col("importance_delta").isNull(), F.col("importance")).otherwise(F.round(moved, 6))).drop("_c", "_items", "importance_delta")
