"""The whole pipeline against a plain version of its five stages."""

import random
from collections import Counter

import numpy as np
import pytest

pytest.importorskip("sparkgauge.llm")
import corpus_pipeline  # noqa: E402
from sparkgauge.llm import line_quality, packing, pii  # noqa: E402
from test_operators import brute_components  # noqa: E402


def fixture():
    """(texts, quality labels): clean documents, near copies, shared passages, personal data, and junk."""
    rnd = random.Random(9)
    words = ["".join(rnd.choice("abcdefghijklmnop") for _ in range(rnd.randint(3, 8))) for _ in range(400)]

    def sentence(n):
        return " ".join(rnd.choices(words, k=n)).capitalize() + "."

    clean = [sentence(rnd.randint(30, 60)) for _ in range(14)]
    copies = [clean[0], clean[1] + " Again.", clean[2] + " More."]
    passage = sentence(20)
    shared = [f"{sentence(25)} {passage} {sentence(25)}" for _ in range(3)]
    private = [f"{sentence(30)} Write to some.one@mail.example.com today.", f"{sentence(30)} password=36fdea71d793cf922e"]
    junk = ["\n".join("|".join(rnd.choices(["BUY!!", "$$$", "CLICK", "###", "0000"], k=6)) for _ in range(6)) for _ in range(8)]
    return [*clean, *copies, *shared, *private, *junk], [1] * 22 + [0] * 8


def plain(texts, labels):
    model = line_quality.train(list(zip(texts, labels, strict=True)))
    kept = [(i, t) for i, t in enumerate(texts) if line_quality.scores([t], model)[0] >= line_quality.THRESHOLD]
    stages = {"quality": dict(kept)}
    roots = brute_components([t for _, t in kept])
    kept = [x for k, x in enumerate(kept) if roots[k][1] == k]
    stages["near_duplicates"] = dict(kept)
    first, out = {}, []
    for i, t in kept:
        for p in range(len(t) - 49):
            first.setdefault(t[p : p + 50], i)
    for i, t in kept:
        gone = np.zeros(len(t), bool)
        for p in range(len(t) - 49):
            if first[t[p : p + 50]] < i:
                gone[p : p + 50] = True
        out.append((i, "".join(c for c, g in zip(t, gone, strict=True) if not g)))
    stages["repeated_passages"] = dict(out)
    tagger = pii.Tagger(pii.train())
    out = [(i, pii.redact(t, pii.base_spans(t) + tagger.spans([t])[0])) for i, t in out]
    stages["private_data"] = dict(out)
    sizes = {i: len(t.split()) for i, t in out}
    counts = Counter(sizes.values())
    ends = packing.best_boundaries(sorted(counts), [counts[n] for n in sorted(counts)], packing.BUCKETS)
    rows, used = set(), Counter()
    for i, n in sorted(sizes.items()):
        b = sum(e < n for e in ends)
        room = max(packing.BUDGET // ends[b], 1)
        rows.add((i, n, b, ends[b], used[b] // room, used[b] % room, ends[b] - n))
        used[b] += 1
    return stages, rows


def test_pipeline_equals_plain_version(spark, tmp_path, monkeypatch):
    texts, labels = fixture()
    spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, y, 0) for i, y in enumerate(labels)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got, write = {}, corpus_pipeline.cut
    monkeypatch.setattr(corpus_pipeline, "cut", lambda df, name: got.setdefault(name, write(df, name)))
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    stages, want = plain(texts, labels)
    for name, expected in stages.items():
        found = got[name].select("doc_id", "text").collect()
        assert len(found) == len(expected) and {r.doc_id: r.text for r in found} == expected, name
    assert len(rows) == len(want) and {tuple(r) for r in rows} == want
    assert set(stages["quality"]) == set(range(22)) and len(stages["near_duplicates"]) == 19
    assert any("[email]" in t for t in stages["private_data"].values()) and stages["repeated_passages"] != stages["near_duplicates"]
