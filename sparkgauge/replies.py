"""Objects out of models' replies."""

from __future__ import annotations

import json
from collections.abc import Iterator


def _scan(text: str) -> Iterator[tuple[int, str, bool]]:
    """(place, character, whether it lies in a string) of a JSON-like text; the closing quote lies in it too."""
    inside = escaped = False
    for i, c in enumerate(text):
        was = inside
        if inside:
            if escaped:
                escaped = False
            elif c == "\\":
                escaped = True
            elif c == '"':
                inside = False
        elif c == '"':
            inside = True
        yield i, c, was


def balanced(text: str) -> Iterator[str]:
    """Stretches from an opening bracket to the one that closes it, outermost first, left to right."""
    at = 0
    while at < len(text):
        start = min((p for p in (text.find("{", at), text.find("[", at)) if p >= 0), default=-1)
        if start < 0:
            return
        depth, end = 0, -1
        for i, c, inside in _scan(text[start:]):
            if not inside and c in "{[":
                depth += 1
            elif not inside and c in "}]":
                depth -= 1
                if not depth:
                    end = start + i + 1
                    break
        if end > 0:
            yield text[start:end]
        at = end if end > 0 else start + 1


def mended(text: str) -> str:
    """Without commas before closing brackets, and with those that lack between two values. Strings stay as they are."""
    out: list[str] = []
    last = ""  # the last character outside white space
    gap = False
    quoted = False
    for _, c, inside in _scan(text):
        if inside:
            out.append(c)
            last, gap, quoted = c, False, True
            continue
        if c.isspace():
            gap = True
            out.append(c)
            continue
        if c in "}]" and last == ",":
            k = max(i for i, x in enumerate(out) if x == ",")
            del out[k]
        starts = c in '"{['
        if starts and gap and (last in '"}]' or last.isalnum()) and (quoted or last != '"'):
            out.append(",")
        out.append(c)
        last, gap = c, False
    return "".join(out)


def parse_json_object(text: str) -> dict:
    """The first stretch of a reply that is an object, as it is or mended; a list stands for its `checklists`."""
    if not text.strip():
        raise ValueError("the reply is empty")
    for stretch in (text.strip(), *balanced(text)):
        for attempt in (stretch, mended(stretch)):
            try:
                got = json.loads(attempt)
            except ValueError:
                continue
            if isinstance(got, dict):
                return got
            if isinstance(got, list):
                return {"checklists": got}
    raise ValueError("no JSON object in the reply")
