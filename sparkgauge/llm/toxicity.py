"""Toxicity: a support vector machine over a gap-weighted subsequence kernel with Nyström landmarks.

The kernel of two words sums, over the four-letter subsequences they share (a word's start counts as a
letter), decay ** (span in either), spans of at most SPAN letters; gaps and inserted letters lower it but don't break it. Landmarks are
words that mark toxic documents and words of clean ones; the machine is linear in the landmark
features K(word, landmarks) K_mm^-1/2. As the kernel is a dot product of subsequence counts, the trained
sum over landmarks folds into one weight for each subsequence, which scores a word in a few array steps.
A document's score is a logistic curve of its highest word margin, fitted on the learning rows.

Words are lower-cased runs of letters; marks and digits inside a run are skipped ("id-i0t" -> "idit"), and
runs of single letters are joined. Null and empty texts: lowest score. Long texts: whole. Repeated rows: a row
each. Null ids: a row each, not held out, never learnt from. Empty table: no rows. Columns other than doc_id and text are not read (by
the stage: kept as they are). Without labelled rows every score is 0.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_texts
from .labelled import TRAIN_ROWS, remainder, row_weights, training_rows

DECAY, SPAN = 0.6, 6
THRESHOLD = 0.3
LANDMARKS = 192
GAPS = [(a, b, c) for c in range(3, SPAN) for b in range(2, c) for a in range(1, b)]
_SPACED = re.compile(r"(?<!\S)\S(?: \S){2,}(?!\S)")
_STRIP = re.compile(r"[\W\d_]+")
CODES = 1 << 18


def words_of(text: str) -> set[str]:
    text = text.lower()
    out = set(text.split())
    for m in _SPACED.finditer(text):
        out.add(m[0].replace(" ", ""))
    return out


def letters(words: list[str]) -> list[str]:
    return [w if w.isalpha() else _STRIP.sub("", w) for w in words]


def subsequences(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(word, code, weight) of every four-letter subsequence, and each word's length scale. Codes are
    hashed to CODES values."""
    n = np.array([len(w) + 1 for w in words], np.int64)
    points = np.frombuffer(("`" + "`".join(words)).encode("utf-32-le"), np.uint32) if words else np.zeros(0, np.uint32)
    small = points - np.uint32(96)
    code = np.where(small < 27, small, 27 + points % 37).astype(np.int64)
    owner = np.repeat(np.arange(len(words)), n)
    end = np.cumsum(n)[owner] if len(words) else owner
    at = np.arange(len(code))
    parts = []
    norm = np.zeros(len(words))
    for a, b, c in GAPS:
        i = np.flatnonzero(at + c < end)
        weight = DECAY ** (c + 1)
        key = code[i] << 18 | code[i + a] << 12 | code[i + b] << 6 | code[i + c]
        parts.append((owner[i], (key * 2654435761 & 0xFFFFFFFF) >> 14, np.full(len(i), weight)))
        norm += np.maximum(n - c, 0) * weight**2
    who, what, weight = (np.concatenate(x) for x in zip(*parts, strict=True))
    return who, what, weight, np.sqrt(np.maximum(norm, 1e-9))


def margins(words: list[str], table: np.ndarray, bias: float) -> np.ndarray:
    """The machine's value for each word, in slices of bounded size."""
    if len(words) > 20_000:
        return np.concatenate([margins(words[lo : lo + 20_000], table, bias) for lo in range(0, len(words), 20_000)])
    who, what, weight, norm = subsequences(letters(words))
    return np.bincount(who, weights=weight * table[what], minlength=len(words)) / norm + bias


def _vectors(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    who, what, weight, norm = subsequences(letters(words))
    return who, what, weight / norm[who]


def _kernel(words: list[str], landmarks: list[str]) -> np.ndarray:
    """K(words, landmarks) through the subsequences of the landmarks."""
    lw, lc, lv = _vectors(landmarks)
    used, inverse = np.unique(lc, return_inverse=True)
    dense = np.zeros((len(used), len(landmarks)), np.float32)
    np.add.at(dense, (inverse, lw), lv.astype(np.float32))
    who, what, weight = _vectors(words)
    slot = np.searchsorted(used, what).clip(0, len(used) - 1)
    hit = used[slot] == what
    who, slot, weight = who[hit], slot[hit], weight[hit].astype(np.float32)
    out = np.zeros((len(words), len(landmarks)), np.float32)
    for lo in range(0, len(who), 200_000):
        w = who[lo : lo + 200_000]
        part = dense[slot[lo : lo + 200_000]] * weight[lo : lo + 200_000, None]
        order = np.argsort(w, kind="stable")
        first = np.flatnonzero(np.concatenate([[True], w[order][1:] != w[order][:-1]]))
        out[w[order][first]] += np.add.reduceat(part[order], first, axis=0)
    return out


def _svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, c: float = 100.0, steps: int = 25) -> np.ndarray:
    """Squared-hinge linear machine by Newton steps; the last column of x is the bias."""
    w = np.zeros(x.shape[1])
    ridge = np.eye(x.shape[1])
    ridge[-1, -1] = 1e-3
    for _ in range(steps):
        gap = 1 - y * (x @ w)
        on = gap > 0
        xo = x[on] * weight[on, None]
        grad = ridge @ w - c * xo.T @ (y[on] * gap[on])
        step = np.linalg.solve(ridge + c * xo.T @ x[on], grad)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def train(rows: list[tuple[str, int]], landmarks: int = LANDMARKS, weights: dict[int, float] | None = None) -> tuple[np.ndarray, float, float, float]:
    """(weight of each subsequence, bias, slope, offset). Deterministic. `weights`: the learning rows that a row of each
    label stands for in the curve, so that its prior is theirs and not the sample's."""
    empty = np.zeros(CODES), 0.0, 0.0, -30.0
    sets = [({x for x in letters(sorted(words_of(t))) if len(x) > 2}, y) for t, y in rows]
    bad, good = Counter(), Counter()
    seen = set()  # of the documents of a label with the same words one counts
    for s, y in sets:
        key = y, hashlib.blake2b(" ".join(sorted(s)).encode(), digest_size=16).digest()
        if key not in seen:
            seen.add(key)
            (bad if y else good).update(s)
    n_bad, n_good = sum(y for _, y in rows), sum(1 - y for _, y in rows)
    if not n_bad or not n_good:
        return empty
    marks = sorted((w for w in bad if bad[w] >= 3 and good[w] / n_good < 0.02 * bad[w] / n_bad), key=lambda w: (-bad[w], w))
    if not marks:
        return empty
    clean = sorted(good, key=lambda w: (-good[w], w))
    rare = [w for w in clean if good[w] <= 2]
    train_clean = clean[:3000] + rare[:: max(1, len(rare) // 4000)]
    chosen = marks[: landmarks * 2 // 3]
    chosen += [w for w in clean[:: max(1, len(clean) // (landmarks - len(chosen)))] if w not in chosen][: landmarks - len(chosen)]
    kmm = _kernel(chosen, chosen).astype(float)
    val, vec = np.linalg.eigh((kmm + kmm.T) / 2)
    keep = val > 1e-6 * val[-1]
    root = vec[:, keep] / np.sqrt(val[keep])
    table, bias = np.zeros(CODES), 0.0
    share = np.minimum([bad[w] for w in marks], 30.0)
    for _ in range(3):
        xs = marks + train_clean
        x = _kernel(xs, chosen).astype(float) @ root
        y = np.array([1.0] * len(marks) + [-1.0] * len(train_clean))
        common = np.minimum([1.0 + good[w] for w in train_clean], 30.0)
        weight = np.concatenate([share / share.sum(), common / common.sum()]) * len(xs) / 2
        w = _svm(np.concatenate([x, np.ones((len(xs), 1))], axis=1), y, weight)
        beta, bias = root @ w[:-1], float(w[-1])
        who, what, value = _vectors(chosen)
        table = np.bincount(what, weights=value * beta[who], minlength=CODES)
        every = sorted(good)
        m = margins(every, table, bias)
        hard = [every[i] for i in np.argsort(-m, kind="stable")[:1500] if m[i] > -1 and every[i] not in bad or m[i] > 0]
        train_clean = sorted({*train_clean, *hard} - set(marks))
    top = np.array([margins(sorted(s), table, bias).max() if s else -5.0 for s, _ in sets])
    y = np.array([v for _, v in sets], float)
    slope, offset = 1.0, 0.0
    weight = np.array([(weights or {}).get(v, 1.0) for _, v in sets])
    weight /= weight.sum()
    for _ in range(50):  # Newton steps of a two-parameter logistic curve, with a small ridge
        p = 1 / (1 + np.exp(-np.clip(slope * top + offset, -30, 30)))
        d, h = weight * (p - y), weight * p * (1 - p)
        g = np.array([(d * top).sum() + 1e-3 * slope, d.sum()])
        hess = np.array([[(h * top * top).sum() + 1e-3, (h * top).sum()], [(h * top).sum(), h.sum() + 1e-6]])
        step = np.linalg.solve(hess, g)
        slope, offset = slope - step[0].clip(-2, 2), offset - step[1].clip(-2, 2)
    return table, bias, float(slope), float(offset)


class Scorer:
    """Margins of words, each distinct one computed once while the table has room."""

    def __init__(self, model, limit: int = 1_000_000):
        self.table, self.bias, self.slope, self.offset = model
        self.limit, self.known = limit, {}

    def scores(self, strings: list[str]) -> list[float]:
        sets = [words_of(s) for s in strings]
        new = set().union(*sets).difference(self.known) if sets else set()
        if len(self.known) + len(new) > self.limit:
            self.known = {}
            new = set().union(*sets)
        order = list(new)
        for lo in range(0, len(order), 20_000):
            part = order[lo : lo + 20_000]
            self.known.update(zip(part, margins(part, self.table, self.bias).tolist(), strict=True))
        top = np.array([max(map(self.known.__getitem__, s), default=-5.0) for s in sets])
        return 1 / (1 + np.exp(-np.clip(self.slope * np.maximum(top, -5.0) + self.offset, -30, 30)))


def fit(docs: DataFrame, labels: DataFrame, learn: Column, rows: int = TRAIN_ROWS):
    return train(training_rows(docs, labels, "toxic", learn, rows), weights=row_weights(labels, "toxic", learn, rows))


def score(docs: DataFrame, model) -> DataFrame:
    """doc_id, score, predicted of every row; a map over whole texts without a shuffle."""

    def start():
        scorer = Scorer(model)

        def rows(ids, strings):
            s = scorer.scores(strings)
            return {"doc_id": ids, "score": s, "predicted": (s >= THRESHOLD).astype(np.int32)}

        return rows

    return map_texts(docs, start, "doc_id long,score double,predicted int")


def classify(docs: DataFrame, labels: DataFrame, modulus: int = 4, held: int = 2) -> DataFrame:
    """doc_id, held_out, score, predicted; rows whose crc32 remainder is `held` are not learnt from."""
    model = fit(docs, labels, remainder(F.col("doc_id"), modulus) != held)
    return score(docs, model).select("doc_id", F.coalesce(remainder(F.col("doc_id"), modulus) == held, F.lit(False)).alias("held_out"), "score", "predicted")
