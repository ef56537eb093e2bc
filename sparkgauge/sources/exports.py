"""Chat exports to conversations and turns; run artifacts to tables."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..ranks import row_numbers
from ..storage import cut
from . import arrays

TURNS = "conversation_id string, turn int, role string, text string, ts string, model_used string, metadata_json string"
_COLUMNS = [x.split()[0] for x in TURNS.split(", ")]
EXPORT_NAMES = ("conversations.json", "chat.json", "messages.json")


def content_text(content: Any) -> str:
    """Text of a message's content: a string, a list of parts, or an object with text, parts or content."""
    if content is None:
        return ""
    if isinstance(content, str):
        return content
    if isinstance(content, list):
        return "\n".join(t for t in map(content_text, content) if t).strip()
    if isinstance(content, dict):
        for k in ("text", "parts", "content"):
            if k in content:
                return content_text(content[k])
    return str(content)


def role_of(role: Any) -> str:
    if isinstance(role, dict):
        role = role.get("role")
    r = str(role or "user").lower()
    return "assistant" if r in ("assistant", "bot", "ai") else r if r in ("system", "tool") else "user"


def _turn(role: Any, content: Any, ts: Any) -> tuple[str, str, str | None] | None:
    t = content_text(content).strip()
    return (role_of(role), t, None if ts is None else str(ts)) if t else None


def _tree_turns(record: dict) -> list:
    nodes = [n for n in record["mapping"].values() if isinstance(n, dict) and n.get("message")]
    keyed = [(n["message"].get("create_time") or n.get("create_time") or 0, _turn((n["message"].get("author") or {}), n["message"].get("content"), n["message"].get("create_time"))) for n in nodes]
    return [t for _, t in sorted(keyed, key=lambda x: x[0]) if t and t[0] != "system"]


def turns_of(record: dict, kind: str) -> tuple[list, Any, Any, dict]:
    """(turns, id, model, metadata) of one record."""
    first = lambda d, *ks: next((d[k] for k in ks if d.get(k)), None)
    if kind == "tree":
        turns = _tree_turns(record) if isinstance(record.get("mapping"), dict) else [t for x in first(record, "turns", "messages") or [] if (t := _turn(first(x, "role", "author"), first(x, "content", "text", "message"), x.get("ts")))]
        return turns, first(record, "id", "conversation_id"), first(record, "model", "default_model_slug"), {"title": record.get("title")}
    if kind == "list":
        turns = [t for x in first(record, "chat_messages", "messages") or [] if (t := _turn(first(x, "sender", "role"), first(x, "text", "content"), first(x, "created_at", "updated_at")))]
        return turns, first(record, "uuid", "id"), record.get("model"), {"name": record.get("name")}
    turns = [t for x in record.get("turns") or [] if (t := _turn(x.get("role"), first(x, "text", "content"), x.get("ts")))]
    return turns, record.get("id"), record.get("model_used"), record.get("metadata") or {}


#: What ids of records without one begin with, by kind.
ID_PREFIX = {"tree": "chatgpt", "list": "claude", "lines": "jsonl"}


def kind_of(data: Any) -> str:
    """The kind of a parsed export, by its first record, or by itself where it is one: tree before list. Records wrapped in an
    object are a tree's, unless the first has a list's messages."""
    wrapped = isinstance(data, dict) and "conversations" in data
    records = data["conversations"] if wrapped else data
    record = (records[0] if records else {}) if isinstance(records, list) else records
    if isinstance(record, dict) and "mapping" in record:
        return "tree"
    if isinstance(record, dict) and ("chat_messages" in record or record.get("account") == "claude"):
        return "list"
    if wrapped:
        return "tree"
    raise ValueError("no export form matches this file")


def _named(record: dict, n: int, kind: str) -> tuple[str, list] | None:
    """(id, rows) of a record with turns. Without an id: prefix, the record's number and a hash of its turns; of lines the
    line's number."""
    turns, key, model, meta = turns_of(record, kind)
    if not turns:
        return None
    if not key:
        lines = "\n".join(f"{r}:{t}" for r, t, _ in turns)
        key = f"{ID_PREFIX[kind]}-{n}" if kind == "lines" else f"{ID_PREFIX[kind]}-{n}-{hashlib.sha256(lines.encode()).hexdigest()[:12]}"
    return str(key), [(str(key), i, r, t, ts, model, json.dumps(meta, sort_keys=True)) for i, (r, t, ts) in enumerate(turns)]


def rows_of(raw: str, kind: str | None) -> Iterator[tuple]:
    """Turn rows of one whole array file. Of records with one id the last counts."""
    data = json.loads(raw)
    kind = kind or kind_of(data)
    records = data.get("conversations", [data]) if isinstance(data, dict) else data
    last = dict(x for n, record in enumerate(records) if isinstance(record, dict) and (x := _named(record, n, kind)))
    for rows in last.values():
        yield from rows


def export_file(spark: SparkSession, path: str) -> str:
    """The file to read: the path, or in a folder the first of EXPORT_NAMES."""
    here = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = here.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(here):
        raise FileNotFoundError(path)
    if not fs.getFileStatus(here).isDirectory():
        return path
    for name in EXPORT_NAMES:
        if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(here, name)):
            return f"{path.rstrip('/')}/{name}"
    raise FileNotFoundError(f"{path} holds none of {', '.join(EXPORT_NAMES)}")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Turn rows of files with one JSON object a line, read side by side. Lines are numbered within their file, blank ones too; of
    records with one id in a file the last counts. A malformed line is an error."""
    meta = F.col("_metadata")
    lines = spark.read.text(path).select("value", meta["file_path"].alias("file"), meta["file_block_start"].alias("start"), F.monotonically_increasing_id().alias("at"))
    numbered = row_numbers(lines, ["start", "at"], ["file"], "line").where(F.trim("value") != "")

    def parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            found = [(file, n, *row) for value, file, n in zip(f.value, f.file, f.line, strict=True) if (x := _named(json.loads(value), n + 1, "lines")) for row in x[1]]
            yield pd.DataFrame(found, columns=["file", "line", *_COLUMNS])

    return _last(cut(numbered.select("value", "file", "line").mapInPandas(parse, f"file string, line long, {TURNS}"), "lines"))


def read_arrays(spark: SparkSession, path: str, kind: str | None = None) -> DataFrame:
    """Turn rows of all files under path that hold an array of records; many tasks read a file (arrays.py). Of records with one
    id in a file the last counts. The form is that of the first record."""
    found = arrays.records(spark, path)
    if kind is None:
        first = found.where("n = 0").orderBy("file").limit(1).collect()
        kind = kind_of([x for r in first for x in arrays.objects(r.value, 0)][:1])

    def parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(file, n, *row) for file, n, place, value in zip(f.file, f.n, f.place, f.value, strict=True) for record in arrays.objects(value, n) if (x := _named(record, place, kind)) for row in x[1]]
            yield pd.DataFrame(rows, columns=["file", "line", *_COLUMNS])

    return _last(cut(found.mapInPandas(parse, f"file string, line long, {TURNS}"), "turns"))


def _last(rows: DataFrame) -> DataFrame:
    """Turn rows of each conversation's last record in its file."""
    last = rows.groupBy("file", "conversation_id").agg(F.max("line").alias("line"))
    return rows.join(last, ["file", "conversation_id", "line"]).select(*_COLUMNS)


def read_files(spark: SparkSession, path: str, kind: str | None = None) -> DataFrame:
    """Turn rows of all exports under path that are one object each, a file a task."""
    files = spark.read.format("binaryFile").load(path).select("content")

    def parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for content in f.content:
                yield pd.DataFrame(list(rows_of(bytes(content).decode("utf-8-sig"), kind)), columns=_COLUMNS)

    return files.mapInPandas(parse, TURNS)


def read_export(spark: SparkSession, path: str, kind: str | None = None) -> DataFrame:
    """Turn rows of an export: 'tree' (mapping or flat turns), 'list' (chat_messages), 'lines' (one object a line, the default of
    files named .jsonl), or None for the form of the first record. A folder stands for the export file in it."""
    file = export_file(spark, path)
    kind = kind or ("lines" if file.endswith(".jsonl") else None)
    if kind == "lines":
        return read_lines(spark, file)
    return read_arrays(spark, file, kind) if arrays.is_array(spark, file) else read_files(spark, file, kind)


def conversations(turns: DataFrame) -> DataFrame:
    """Nested rows: one for each conversation with its ordered turns."""
    return turns.groupBy("conversation_id").agg(F.first("model_used").alias("model_used"), F.first("metadata_json").alias("metadata_json"), F.array_sort(F.collect_list(F.struct("turn", "role", "text", "ts"))).alias("turns"))


def last_by_id(lines: DataFrame, key: str | list[str], order: str) -> DataFrame:
    """JSON lines by id; of repeated ids the last line."""
    w = Window.partitionBy(key).orderBy(F.desc(order))
    return lines.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")

