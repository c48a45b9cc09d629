import hashlib
import random
from collections import Counter
from functools import reduce

import pytest
from pyspark.sql import DataFrame

from ledgerlens.llm.substring_dedup import FingerprintIndex, dedup


def brute(rows, window):
    split = [(i, (t or "").encode().split()) for i, t in rows]
    seen = Counter(tuple(w[k : k + window]) for _, w in split for k in range(len(w) - window + 1))
    out = []
    for doc_id, w in split:
        gone = set()
        for k in range(len(w) - window + 1):
            if seen[tuple(w[k : k + window])] > 1:
                gone |= set(range(k, k + window))
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((doc_id, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def corpus(seed, window):
    r = random.Random(seed)
    say = lambda n, v=2000: [f"w{r.randrange(v)}é" for _ in range(n)]
    passages = [say(r.randrange(window // 2, 3 * window)) for _ in range(8)]
    rows = []
    for i in range(150):
        w = say(r.randrange(0, 60))
        for _ in range(r.randrange(3)):
            p = list(r.choice(passages))
            if r.random() < 0.5 and p:
                p[r.randrange(len(p))] = "edit"
            if r.random() < 0.5:
                p = p[r.randrange(len(p)) :]
            w += p + say(r.randrange(0, 15))
        rows.append((i, r.choice([" ", "\n", "\t  "]).join(w)))
    rows += [(200 + k, rows[k * 7][1]) for k in range(9)] + [(3, rows[3][1]), (5, "other text of five"), (None, rows[9][1]), (None, rows[10][1]), (400, None), (401, ""), (402, " \n")]
    rows += [(403, "a " * 300), (404, "a b " * 200), (405, " ".join(say(9000, 3)))]
    return rows


@pytest.mark.parametrize("seed,window,gram", [(1, 35, 8), (2, 10, 4)])
def test_against_brute_force(spark, seed, window, gram):
    rows = corpus(seed, window)
    df = spark.createDataFrame([(*x, "clash") for x in rows], "doc_id long, text string, spans string")
    got = sorted((tuple(r)[:4] for r in dedup(df, window, gram).collect()), key=str)
    assert got == brute(rows, window)


def test_kept_text_and_empty(spark):
    p = " ".join(f"x{i}" for i in range(40))
    df = spark.createDataFrame([(1, "head " + p), (2, p + " tail")], "doc_id long, text string")
    assert sorted(r.kept_text for r in dedup(df).collect()) == ["head", "tail"]
    assert dedup(df.limit(0)).count() == 0


def test_index_compacts_and_opens_again(spark):
    batch = lambda k: spark.createDataFrame([(k, 1), (7, k % 2), (8, 3), (20 + k // 2, 5)] + [(30, 1)] * (k == 3), "fp long, block long")
    index = FingerprintIndex(spark, fan_out=2, buckets=3)
    for k in range(5):
        index.append(batch(k))
        if k == 2:
            index = FingerprintIndex.opened(spark, index.root)
    assert [len(x) for x in index.levels] == [1, 0, 1]
    at_once = FingerprintIndex(spark)
    at_once.append(reduce(DataFrame.union, map(batch, range(5))))
    want = sorted((r.fp, r.mixed) for r in at_once.repeated().collect())
    assert sorted((r.fp, r.mixed) for r in index.repeated().collect()) == want == [(7, True), (8, False), (20, False), (21, False)]
    names = [x for level in index.levels for x in level]
    plan = spark.table(names[0]).hint("merge").join(spark.table(names[1]), "fp")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan
    index.drop()
    assert not any(spark.catalog.tableExists(x) for x in names)


def test_texts_of_equal_short_hash(spark):
    # "0000348d..." and "55 99 11..." have one 32-bit hash, whatever follows
    passage = " ".join(f"w{k}" for k in range(40))
    rows = [(None, f"{own} {passage} the end") for own in ("0000348d", "55 99 11")]
    got = dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.n_words, r.n_removed, r.kept_text) for r in got) == [(43, 42, "0000348d"), (45, 42, "55 99 11")]
