"""Quality classifier: a linear-chain conditional random field labels every line good or bad.

Features of a line are shares and counts of its bytes and words, and those of the lines before and
after it. A document's lines all take its label in training. A document's score is the mean of its lines'
forward-backward marginals for "good", weighted by their length. Lines are split at line feeds; lines
without a word are left out.

Null, empty and blank texts: no lines, score EMPTY_SCORE. Long texts: whole. Repeated rows: a row each.
Null ids: a row each, not held out, never learnt from. Empty table: no rows. Columns other than doc_id and text are not read (by
the stage: kept as they are). Without labelled rows every score is 0.5.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_texts, rewrite
from .labelled import remainder, training_rows

EMPTY_SCORE = 0.0
THRESHOLD = 0.3

_CLASS = np.zeros(256, np.uint8)
_CLASS[[32, 9, 10, 11, 12, 13]] = 1
for _c in range(256):
    if 65 <= _c <= 90:
        _CLASS[_c] = 2
    elif 48 <= _c <= 57:
        _CLASS[_c] = 3
    elif 97 <= _c <= 122:
        _CLASS[_c] = 4
    elif _c >= 128:
        _CLASS[_c] = 5
for _c in b".,;:?'\"-()":
    _CLASS[_c] = 6
for _c in b"!":
    _CLASS[_c] = 7
for _c in b"|#*$%&<>=_{}[]\\/~^@+":
    _CLASS[_c] = 8
N_OWN = 13
_POWER = np.uint64(0x9E3779B97F4A7C15)
_POWERS = np.cumprod(np.full(4096, _POWER))


def line_features(strings: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features, length, document) of each line with a word, over the texts in order."""
    data = b"\n".join(s.encode("utf-8", "replace") for s in strings) + b"\n"
    counts = np.array([s.count("\n") + 1 for s in strings])
    raw = np.frombuffer(data, np.uint8)
    kind = _CLASS[raw]
    ends = np.flatnonzero(raw == 10)
    starts = np.concatenate([[0], ends[:-1] + 1])
    doc = np.repeat(np.arange(len(strings)), counts)
    word = kind != 1
    first = np.flatnonzero(word & np.concatenate([[True], ~word[:-1]]))  # words never cross a line feed
    last = np.flatnonzero(word & np.concatenate([~word[1:], [True]])) + 1
    n_words = np.searchsorted(first, ends) - np.searchsorted(first, starts)
    keep = n_words > 0
    starts, ends, doc, n_words = starts[keep], ends[keep], doc[keep], n_words[keep]
    if not len(starts):
        return np.zeros((0, 3 * N_OWN)), np.zeros(0), doc
    size = (ends - starts).astype(float)
    shares = []
    for k in (1, 2, 3, 5, 6, 7, 8):
        total = np.concatenate([[0], np.cumsum(kind == k, dtype=np.int64)])
        shares.append((total[ends] - total[starts]) / size)
    at = np.concatenate([np.arange(len(raw)) - np.repeat(first, np.diff(np.append(first, len(raw))))]) if first[0] == 0 else None
    if at is None:
        lead = first[0]
        at = np.concatenate([np.zeros(lead, np.int64), np.arange(lead, len(raw)) - np.repeat(first, np.diff(np.append(first, len(raw))))])
    powers = _POWERS if at.max() < len(_POWERS) else np.cumprod(np.full(at.max() + 1, _POWER))
    codes = np.where(word, (raw.astype(np.uint64) + np.uint64(1)) * powers[at], np.uint64(0))
    total = np.concatenate([[np.uint64(0)], np.cumsum(codes, dtype=np.uint64)])
    h = total[last] - total[first]
    same = np.concatenate([[False], h[1:] == h[:-1]])
    row = np.searchsorted(ends, first)  # the line of each word
    same &= np.concatenate([[False], row[1:] == row[:-1]])
    repeats = np.concatenate([[0], np.cumsum(same)])
    w0 = np.searchsorted(first, starts)
    pairs = (repeats[w0 + n_words] - repeats[w0]) / n_words
    order = np.lexsort((h, row))
    news = np.concatenate([[True], (h[order][1:] != h[order][:-1]) | (row[order][1:] != row[order][:-1])])
    distinct = np.bincount(row[order][news], minlength=len(starts)) / n_words
    full = ((raw[ends - 1] == 46) | (raw[ends - 1] == 33) | (raw[ends - 1] == 63)).astype(float)
    own = np.stack([np.ones_like(size), *shares, pairs, distinct, np.log1p(n_words) / 5, np.minimum(size / n_words, 40) / 10, full], axis=1)
    before, after = np.zeros_like(own), np.zeros_like(own)
    inner = doc[1:] == doc[:-1]
    before[1:][inner] = own[:-1][inner]
    after[:-1][inner] = own[1:][inner]
    return np.concatenate([own, before, after], axis=1), size, doc


def marginals(energy: np.ndarray, move: np.ndarray, doc: np.ndarray, with_pairs: bool = False):
    """P(good) of each line by forward-backward over each document's lines; energy is that of "good"
    over "bad". Documents run side by side, step by step. With pairs also the expected steps and log Z."""
    if not len(doc):
        return (np.zeros(0), np.zeros((2, 2)), 0.0) if with_pairs else np.zeros(0)
    new = np.concatenate([[True], doc[1:] != doc[:-1]])
    start = np.flatnonzero(new)
    n = np.diff(np.append(start, len(doc)))
    order = np.argsort(-n, kind="stable")
    start, n = start[order], n[order]
    e = np.stack([np.zeros_like(energy), energy], axis=1)
    a, b = e.copy(), np.zeros_like(e)
    for t in range(1, n[0]):
        rows = start[: np.searchsorted(-n, -t)] + t
        a[rows] = e[rows] + np.logaddexp(a[rows - 1, :1] + move[0], a[rows - 1, 1:] + move[1])
    for t in range(n[0] - 1, 0, -1):
        rows = start[: np.searchsorted(-n, -t)] + t
        s = e[rows] + b[rows]
        b[rows - 1] = np.logaddexp(move[:, 0] + s[:, :1], move[:, 1] + s[:, 1:])
    z = np.zeros(len(doc))
    ends = start + n - 1
    log_z = np.logaddexp(a[ends, 0], a[ends, 1])
    z[np.repeat(start - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(len(doc))] = np.repeat(log_z, n)
    p = np.exp(np.minimum(a[:, 1] + b[:, 1] - z, 0.0))
    if not with_pairs:
        return p
    t = np.flatnonzero(~new)
    s = e[t] + b[t]
    steps = np.exp(a[t - 1][:, :, None] + move[None] + s[:, None, :] - z[t][:, None, None]).sum(0)
    return p, steps, log_z.sum()


def train(rows: list[tuple[str, int]], steps: int = 150, decay: float = 1e-4) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(weights, scale, transitions) by Adam on the penalised conditional log-likelihood; each label weighs
    the same. Starts at zero and has no random part."""
    if not rows or len({y for _, y in rows}) < 2:
        return np.zeros(3 * N_OWN), np.ones(3 * N_OWN), np.zeros((2, 2))
    parts = [line_features([t for t, _ in rows[lo : lo + 200]]) for lo in range(0, len(rows), 200)]  # bytes of 200 texts at a time
    x = np.concatenate([p[0] for p in parts])
    doc = np.concatenate([p[2] + 200 * k for k, p in enumerate(parts)])
    del parts
    y = np.array([v for _, v in rows])
    label = y[doc]
    scale = x.std(0) + 1e-3
    x = x / scale
    per_doc = 1 / np.bincount(doc, minlength=len(rows))[doc]
    weight = per_doc * np.where(label == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum()))
    inner = np.flatnonzero(doc[1:] == doc[:-1]) + 1
    w, move = np.zeros(x.shape[1]), np.zeros((2, 2))
    m1, m2 = np.zeros(len(w) + 4), np.zeros(len(w) + 4)
    seen = np.zeros((2, 2))
    np.add.at(seen, (label[inner - 1], label[inner]), 1)
    for k in range(1, steps + 1):
        p, pairs, _ = marginals(x @ w, move, doc, with_pairs=True)
        g = np.concatenate([x.T @ ((label - p) * weight) * 10 - decay * w, ((seen - pairs) / max(1, len(inner)) - 0.02 * move).ravel()])
        m1, m2 = 0.9 * m1 + 0.1 * g, 0.99 * m2 + 0.01 * g * g
        step = 0.1 * (m1 / (1 - 0.9**k)) / (np.sqrt(m2 / (1 - 0.99**k)) + 1e-6)
        w += step[:-4]
        move += step[-4:].reshape(2, 2)
    return w, scale, move


def scores(strings: list[str], model: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
    w, scale, move = model
    x, size, doc = line_features(strings)
    p = marginals((x / scale) @ w, move, doc)
    total = np.bincount(doc, weights=size, minlength=len(strings))
    good = np.bincount(doc, weights=size * p, minlength=len(strings))
    return np.where(total > 0, good / np.maximum(total, 1), EMPTY_SCORE).clip(0, 1)


def fit(docs: DataFrame, labels: DataFrame, learn: Column) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return train(training_rows(docs, labels, "quality", learn))


def score(docs: DataFrame, model) -> DataFrame:
    """doc_id, score, predicted of every row; a map over whole texts without a shuffle."""

    def start():
        def rows(ids, strings):
            s = scores(strings, model)
            return {"doc_id": ids, "score": s, "predicted": (s >= THRESHOLD).astype(np.int32)}

        return rows

    return map_texts(docs, start, "doc_id long,score double,predicted int")


def classify(docs: DataFrame, labels: DataFrame, modulus: int = 5, held: int = 0) -> DataFrame:
    """doc_id, held_out, score, predicted; rows whose crc32 remainder is `held` are not learnt from."""
    model = fit(docs, labels, remainder(F.col("doc_id"), modulus) != held)
    return score(docs, model).select("doc_id", F.coalesce(remainder(F.col("doc_id"), modulus) == held, F.lit(False)).alias("held_out"), "score", "predicted")


def keep_good(docs: DataFrame, model) -> DataFrame:
    """The rows whose document the model accepts, with all their columns."""

    def start():
        def keep(strings):
            return [t if s >= THRESHOLD else None for t, s in zip(strings, scores(strings, model), strict=True)]

        return keep

    return rewrite(docs, start)
