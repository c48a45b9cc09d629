import random
import re
import zlib

import numpy as np
import pytest

from ledgerlens.llm import toxicity as t


def embedding(model, word):
    """A word's embedding, gram by gram."""
    raw = b"<" + word.encode() + b">"
    mix = lambda h: ((h * 0x9E3779B97F4A7C15) % 2**64 >> 40) % len(model.table)
    rows = [mix(zlib.crc32(raw))]
    for n in t.GRAMS:
        for i in range(len(raw) - n + 1):
            h = n
            for b in raw[i : i + n]:
                h = ((h * 1099511628211) % 2**64) ^ b
            rows.append(mix(h))
    return sum(model.table[r].astype(np.float64) for r in rows) / np.sqrt(len(rows))


def brute(model, text):
    """The score by the definition: every filter at every place of the whole text."""
    dim = model.table.shape[1]
    words = [embedding(model, w) for w in map(str.lower, re.findall(r"\w+", text or ""))]
    places = max(len(words), 1)
    words += [np.zeros(dim)] * (places + model.widest)
    top = []
    for f in model.filters:
        values = [sum(words[i + k] @ f[k] for k in range(len(f))) for i in range(places)]
        top.append(np.max(values, axis=0))
    hidden = np.maximum(np.concatenate(top) + model.bias, 0)
    return float(hidden @ model.out + model.shift)


def random_model(seed=1):
    rng = np.random.default_rng(seed)
    return t.Model(rng.normal(0, 1, (512, 4)).astype(np.float32), [rng.normal(0, 1, (k, 4, 3)).astype(np.float32) for k in (1, 2, 3)], rng.normal(0, 1, 9).astype(np.float32), rng.normal(0, 1, 9).astype(np.float32), 0.3)


def texts(seed, n):
    rng = random.Random(seed)
    words = ["a", "Be", "cat", "straße", "ÉCOLE", "日本語", "under_score", "w1", "😀", "--"]
    return [None, "", " .,", "one"] + [" ".join(rng.choice(words) for _ in range(rng.randint(0, 40))) for _ in range(n)]


@pytest.mark.parametrize("chunk", [3, 7, 64, 1 << 17])
def test_scores(chunk):
    model, some = random_model(), texts(2, 60)
    some.append("word " * 200 + "Cat straße a " + "be " * 300)
    got = t.raw_scores(model, some, chunk)
    assert np.allclose(got, [brute(model, x) for x in some], atol=1e-4)
    assert len(t.raw_scores(model, [])) == 0


def corpus(n=1_500):
    rng = random.Random(5)
    stems = {"en": ["grumph", "blarg"], "de": ["schnurz"], None: ["zork"]}
    rows, labels = [], []
    for i in range(n):
        lang = rng.choice(["en", "en", "de", None])
        words = ["".join(rng.choice(["ta", "no", "ri", "el", "um"]) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(3, 80))]
        toxic = rng.random() < 0.25
        if toxic:
            words.insert(rng.randrange(len(words)), rng.choice(stems[lang]) + rng.choice(["", "ta", "um", "rino"]))
        rows.append((i, " ".join(words), lang))
        if i % 10:
            labels.append((i, 1, int(toxic)))
    truth = {r[0]: int(any(s in r[1] for ss in stems.values() for s in ss)) for r in rows}
    return rows, labels, truth


def test_learns(spark):
    rows, labels, truth = corpus()
    labels += [(3, 1, 1 - dict((a, c) for a, _, c in labels)[3]), (None, 1, 1), (5_000, 1, 1), (4, None, None)]
    docs = spark.createDataFrame([(*r, 0.5) for r in rows], "doc_id long, text string, lang string, score double")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = t.fit(docs, marks, buckets=1 << 12)
    out = {r.doc_id: r for r in t.score(docs, model).collect()}
    assert len(out) == len(rows)
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and r.predicted == int(r.score >= 0.5) and 0 <= r.score <= 1 for i, r in out.items())
    held = [i for i, r in out.items() if r.held_out]
    assert np.mean([out[i].predicted == truth[i] for i in held]) > 0.95
    assert np.mean([out[i].flagged == bool(truth[i]) for i in held]) > 0.95
    again = t.score(docs.repartition(5), t.fit(docs.repartition(3), marks, buckets=1 << 12)).collect()
    assert {r.doc_id: round(r.score, 5) for r in again} == {i: round(r.score, 5) for i, r in out.items()}
    # labels of held-out rows change nothing
    flipped = spark.createDataFrame([(i, q, (1 - x if i is not None and x is not None and zlib.crc32(str(i).encode()) % 5 == 0 else x)) for i, q, x in labels], "doc_id long, quality int, toxic int")
    assert np.array_equal(t.fit(docs, flipped, buckets=1 << 12).table, model.table)


def test_edges(spark):
    docs = spark.createDataFrame([("x", None, None, 1), (None, "", "en", 2), ("x", "a b", "de", 3), ("x", "a b", "de", 3)], "doc_id string, text string, lang string, flagged int")
    none = spark.createDataFrame([], "doc_id string, toxic int")
    model = t.fit(docs, none)
    out = t.score(docs, model).collect()
    assert len(out) == 4 and {r.predicted for r in out} == {0} and [r.held_out for r in out if r.doc_id is None] == [False]
    assert t.score(docs.limit(0), model).count() == 0
    one = spark.createDataFrame([("x", 1)], "doc_id string, toxic int")
    assert t.fit(docs, one).level == pytest.approx(t.fit(docs, one).level)


def test_threshold():
    p, y = np.array([0.1, 0.2, 0.6, 0.9]), np.array([0, 0, 1, 1])
    assert t._threshold(p, y, np.ones(4)) == pytest.approx(0.4)
    slope, level = t._calibrated(np.array([-2.0, -1, 1, 2]), y, np.ones(4))
    assert slope > 0 and abs(level) < 0.2
