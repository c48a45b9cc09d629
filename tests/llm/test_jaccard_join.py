import random
import re
import time

import numpy as np
import pytest

from ledgerlens.llm import jaccard_join as j
from ledgerlens.llm.hashing import Powers

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, size, percent):
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOW))
        sets.append({tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            i = len(sets[a] & sets[b])
            if i and 100 * i >= percent * (len(sets[a]) + len(sets[b]) - i):
                root[find(a)] = find(b)
    low = {}
    for k, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            low[find(k)] = min(low.get(find(k), doc_id), doc_id)
    return sorted([(rows[k][0], len(sets[k]), low.get(find(k))) for k in range(len(rows))], key=str), len({find(k) for k in range(len(rows))})


def corpus(seed):
    r = random.Random(seed)
    say = lambda n, v=900: [f"W{r.randrange(v)}é" for _ in range(n)]
    passage = say(60)
    rows = []
    for base in range(14):
        words = say(r.choice([3, 6, 8, 12, 20, 40, 90, 200, 400]))
        for _ in range(r.randrange(1, 12)):
            w = list(words)
            for _ in range(r.randrange(0, 1 + max(1, len(w) // 25))):
                k = r.randrange(len(w))
                w[k : k + 1] = r.choice([[], ["new%d" % r.randrange(999)], [w[k].lower(), "x"]])
            rows.append((len(rows), " ".join(w)))
    chain = say(120)
    for k in range(25):  # each is near the next, the ends are not
        rows.append((len(rows), " ".join(chain[k : k + 90])))
    for _ in range(40):
        rows.append((len(rows), " ".join(say(r.randrange(5, 60)) + passage)))
    rows += [(900, None), (901, ""), (902, " \n"), (903, "a"), (904, "A"), (905, "a b"), (906, "a b c d"), (907, "a b c d e"), (3, rows[3][1]), (3, "another text of three"), (None, rows[8][1]), (None, "only null ids"), (None, "Only null ids")]
    rows += [(910, "z " * 5000), (911, "z z z z z z")]
    return rows


@pytest.mark.parametrize("seed,size,percent", [(1, 4, 85), (2, 5, 80)])
def test_against_brute_force(spark, seed, size, percent):
    rows = corpus(seed)
    df = spark.createDataFrame([(*x, "clash") for x in rows], "doc_id long, text string, row string").repartition(4)
    out = j.join(df, size, percent).collect()
    want, n = brute(rows, size, percent)
    assert sorted([(r.doc_id, r.n_shingles, r.component_id) for r in out], key=str) == want
    assert sum(r["first"] for r in out) == n


def test_similar_sets_share_a_key():
    r = np.random.default_rng(5)
    for percent in (75, 80, 85, 90):
        for _ in range(400):
            s = int(r.integers(6, 400))
            a = r.integers(0, 1 << 63, s, dtype=np.uint64) * np.uint64(2)
            cut, add = r.integers(0, max(1, s // 5) + 1, 2)
            b = np.concatenate([a[cut:], r.integers(0, 1 << 63, add, dtype=np.uint64) * np.uint64(2)])
            a, b = np.unique(a), np.unique(b)
            i = len(np.intersect1d(a, b))
            if 100 * i >= percent * (len(a) + len(b) - i) and len(a) + len(b) > 2 * i:
                assert set(j.keys_of(a, percent).tolist()) & set(j.keys_of(b, percent).tolist())


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert j.join(df).count() == 0
    assert len(j.shingles("A b", 4, Powers(0))) == 1


@pytest.mark.parametrize("hot,sent", [(2, 1 << 20), (5, 0)])
def test_hot_keys(spark, hot, sent, monkeypatch):
    monkeypatch.setattr(j, "HOT", hot)
    monkeypatch.setattr(j, "BUCKETS", sent)
    rows = corpus(7)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted([(r.doc_id, r.n_shingles, r.component_id) for r in j.join(df, 4, 85).collect()], key=str)
    assert got == brute(rows, 4, 85)[0]


def test_frequent_ngrams_are_searched_for():
    r = np.random.default_rng(3)
    held = np.sort(r.integers(-(1 << 63), (1 << 63) - 1, 1 << 20))
    began = time.process_time()
    for _ in range(1_000):  # a pass over held for each set would take more than ten seconds
        u = np.sort(np.concatenate([r.integers(-(1 << 63), (1 << 63) - 1, 300), held[r.integers(0, len(held), 100)]]))
        assert j.not_in(u, held).sum() == 300
    assert time.process_time() - began < 5
    few = np.array([-5, 0, 7])
    assert j.not_in(np.array([-9, -5, 0, 3, 7, 8]), few).tolist() == [True, False, False, True, False, True]
    assert j.not_in(few, few[:0]).all() and not len(j.not_in(few[:0], few))


def test_pairs_by_blocks(spark, monkeypatch):
    r = np.random.default_rng(4)
    rows, key = [], 0
    for key, (n, nodes) in enumerate([(60, 9), (64, 40), (500, 33), (9000, 6)]):  # sets about 64 have sketches of 128 and of 256 bits
        base = r.integers(0, 1 << 62, n, dtype=np.uint64)
        for node in range(nodes):
            u = base.copy()
            u[r.choice(n, int(r.integers(0, n // 8)), replace=False)] += np.uint64(1 << 62)
            u = np.unique(np.concatenate([u, r.integers(0, 1 << 63, int(r.integers(0, n // 10)), dtype=np.uint64)]))
            rows.append((key, 1000 * key + node, 1000 * key + node // 3, len(u), j.sketch(u).tolist(), nodes))
    rooted = spark.createDataFrame(rows, "key long, node long, root long, n long, sketch array<long>, held long")

    def odd(a, b):  # bits in which two sketches differ, after folding
        x, y = sorted((np.array(a), np.array(b)), key=len)
        y = y if len(x) == len(y) else y[: len(x)] ^ y[len(x) :]
        return int(np.bitwise_count((x ^ y).view(np.uint64)).sum())

    want = sorted(
        (b[1], a[1], b[2], a[2])
        for x, a in enumerate(rows)
        for b in rows[x + 1 :]
        if a[0] == b[0] and a[2] != b[2] and 100 * min(a[3], b[3]) >= 85 * max(a[3], b[3]) and odd(a[4], b[4]) * 185 <= (a[3] + b[3]) * 15
    )
    assert len(want) > 50
    for block in (4, 64):
        monkeypatch.setattr(j, "BLOCK", block)
        assert sorted(map(tuple, j._cross(rooted, 85).select("node", "leader", "_r", "_s").collect())) == want


def test_texts_of_equal_short_hash(spark):
    # "0000348d..." and "55 99 11..." have one 32-bit hash, whatever follows
    a, b = (f"{own} s1 s2 s3 s4 s5 s6 s7 s8" for own in ("0000348d", "55 99 11"))
    rows = [(None, a), (None, b), (3, f"{a} e"), (4, f"{b} e")]
    got = j.join(spark.createDataFrame(rows, "doc_id long, text string"), size=4, percent=85).collect()
    assert sorted((r.doc_id or 0, r.n_shingles, r.component_id) for r in got) == [(0, 6, 3), (0, 8, 4), (3, 7, 3), (4, 9, 4)]
    left = j.one_each(spark.createDataFrame([(None, a), (None, b), (None, b)], "doc_id long, text string"), size=4, percent=85)
    assert sorted(r.text for r in left.collect()) == [a, b]
