"""The locked benchmark: canonical JSON, content hash, versioned files. At most a few hundred tasks, on the driver."""

from __future__ import annotations

import hashlib
import json
from collections import Counter
from datetime import UTC, datetime
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame


def canonical_json(value: Any) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def content_hash(value: Any) -> str:
    return hashlib.sha256(canonical_json(value).encode()).hexdigest()


def lock(selected: DataFrame, key: str, config: dict, folder: str, limit: int = 200) -> dict:
    """Write benchmark.json and benchmark_v{N}.json of the selected tasks, numbered in key order. Over `limit` tasks: an
    error, as the settings hold a sample to that many."""
    rows = [r.asDict(recursive=True) for r in selected.orderBy(key).limit(limit + 1).collect()]
    if len(rows) > limit:
        raise ValueError(f"over {limit} tasks are selected")
    tasks = [{"id": f"task-{i:04d}", **r} for i, r in enumerate(rows, 1)]
    digest = content_hash({"tasks": tasks, "config": config})
    out = Path(folder)
    out.mkdir(parents=True, exist_ok=True)
    version = 1 + max([int(p.stem.split("_v")[1]) for p in out.glob("benchmark_v*.json")], default=0)
    count = lambda c: dict(sorted(Counter(str(t.get(c) or "Unknown") for t in tasks).items()))
    meta = {"version": version, "benchmark_hash": digest, "task_count": len(tasks), "task_family_count": len({t.get("task_family_id") for t in tasks}), "config": config}
    meta |= {name: count(c) for name, c in (("domain_distribution", "domain"), ("family_distribution", "task_family"), ("difficulty_distribution", "difficulty"), ("specificity_distribution", "specificity"))}
    meta["generated_at"] = datetime.now(UTC).isoformat(timespec="seconds")
    text = json.dumps({"metadata": meta, "tasks": tasks}, indent=2, sort_keys=True, ensure_ascii=False) + "\n"
    for name in ("benchmark.json", f"benchmark_v{version}.json"):
        (out / name).write_text(text, encoding="utf-8")
    return {"version": version, "hash": digest, "task_count": len(tasks), "path": str(out / f"benchmark_v{version}.json")}


def load_benchmark(folder: str, expected: str | None = None) -> dict:
    """The locked benchmark; checked against the latest version's hash where there is one."""
    file = Path(folder) / "benchmark.json"
    if not file.exists():
        raise RuntimeError("no benchmark.json: build first")
    got = json.loads(file.read_text(encoding="utf-8"))
    missing = [k for k in ("metadata", "tasks") if k not in got] + [k for t in got.get("tasks", []) for k in ("id", "turns", "checklist") if k not in t]
    if missing:
        raise ValueError(f"benchmark.json lacks {sorted(set(missing))}")
    if expected and got["metadata"].get("benchmark_hash") != expected:
        raise RuntimeError("benchmark.json isn't the latest locked version")
    return got


def benchmark_meta(folder: str) -> tuple[str, int]:
    """(hash, task count); ('', 0) where there is no readable benchmark."""
    try:
        got = json.loads((Path(folder) / "benchmark.json").read_text(encoding="utf-8"))
    except (OSError, ValueError):
        return "", 0
    meta = got.get("metadata", {})
    return str(meta.get("benchmark_hash", "")), int(meta.get("task_count", len(got.get("tasks", []))))
