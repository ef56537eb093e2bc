"""Paid calls, kept as they arrive: the ledger of costs, and what a restart needn't ask again.

A call's id is a digest of what it is for (scope), its phase, model and payload. A worker writes a call's record the moment
its reply is there: one file, named by the id, put in place by a rename. So a retried task, a second copy of one, or a run
that is started again finds the record and doesn't pay twice; two copies that did ask leave one record. A changed text, model or
prompt has another id and is asked. Records from before `since` don't count: such calls are asked again, once, and the newer
record takes the older one's place.

Records of a folder are read as a table (`records`). Offline models are free and leave none. A failed call leaves none, so it is
asked again next time. Workers need the folder: a workspace lies on a mount that all share."""

from __future__ import annotations

import hashlib
import json
import os
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .models import Reply

RECORD = "call_id string, phase string, scope string, kind string, provider string, model string, input_tokens long, output_tokens long, cost_usd double, at double"
#: Subfolders by the id's first letters, so that none grows too wide.
PREFIX = 2


@dataclass(frozen=True)
class Log:
    """Where a phase's calls are kept. prices: USD per 1000 tokens, in and out, of each (provider, model); others count as 0."""

    folder: str
    phase: str
    scope: str = "build"
    prices: dict[tuple[str, str], tuple[float, float]] = field(default_factory=dict)
    since: float = 0.0

    def of(self, phase: str) -> Log:
        return replace(self, phase=phase)

    def making(self, make: Callable[[str, str], Callable]) -> Callable[[str, str], Callable]:
        """A maker of clients whose paid calls are kept. Runs on the workers."""
        return _Maker(self, make)

    def place(self, call_id: str) -> Path:
        return Path(self.folder) / self.phase / call_id[:PREFIX] / f"{call_id}.json"

    def cost(self, provider: str, model: str, input_tokens: int, output_tokens: int) -> float:
        a, b = self.prices.get((provider, model), (0.0, 0.0))
        return input_tokens / 1000 * a + output_tokens / 1000 * b


@dataclass(frozen=True)
class _Maker:
    log: Log
    make: Callable[[str, str], Callable]

    def __call__(self, provider: str, model: str) -> Callable:
        client = self.make(provider, model)
        return Kept(self.log, provider, model, client) if getattr(client, "billable", False) else client


class Kept:
    """A client that looks for a call's record first, and leaves one for each call that it pays."""

    billable = True

    def __init__(self, log: Log, provider: str, model: str, client: Callable):
        self.log, self.provider, self.model, self.client = log, provider, model, client

    def __call__(self, kind: str, payload: Any) -> Reply:
        told = json.dumps([self.log.scope, self.log.phase, kind, self.provider, self.model, payload], ensure_ascii=False, sort_keys=True)
        call_id = hashlib.sha256(told.encode()).hexdigest()
        file = self.log.place(call_id)
        got = self._kept(file)
        if got is None:
            reply = self.client(kind, payload)
            got = {
                "call_id": call_id, "phase": self.log.phase, "scope": self.log.scope, "kind": kind, "provider": self.provider, "model": self.model, "input_tokens": reply.input_tokens,
                "output_tokens": reply.output_tokens, "cost_usd": self.log.cost(self.provider, self.model, reply.input_tokens, reply.output_tokens), "at": time.time(), "reply": reply.text,
            }
            file.parent.mkdir(parents=True, exist_ok=True)
            part = file.parent / f".{call_id}-{uuid.uuid4().hex}"
            part.write_text(json.dumps(got, ensure_ascii=False), encoding="utf-8")
            os.replace(part, file)
        return Reply(got["reply"], got["model"], got["input_tokens"], got["output_tokens"], True)

    def _kept(self, file: Path) -> dict | None:
        try:
            got = json.loads(file.read_text(encoding="utf-8"))
        except (FileNotFoundError, ValueError):
            return None
        return got if got["at"] >= self.log.since else None


def records(spark: SparkSession, folder: str) -> DataFrame:
    """A row for each paid call."""
    files = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/*/*/*.json")
    if not files.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(files):
        return spark.createDataFrame([], RECORD)
    return spark.read.schema(RECORD).json(f"{folder}/*/*/*.json").withColumn("cost_usd", F.coalesce("cost_usd", F.lit(0.0)))


def ledger(calls: DataFrame) -> DataFrame:
    """calls, tokens and cost by phase and model."""
    named = F.concat_ws(":", "provider", "model")
    return calls.groupBy("phase", named.alias("model")).agg(F.count("*").alias("calls"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"), F.round(F.sum("cost_usd"), 6).alias("cost_usd"))
