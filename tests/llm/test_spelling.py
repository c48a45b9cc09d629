import random
import re
import zlib
from collections import Counter

from ledgerlens.llm import spelling as s


def vocabulary(rows, least=3, min_chars=5, one_in=97):
    n = Counter()
    for id_, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if id_ is None else id_}:{run}".encode())
            if one_in and h % one_in == 0:
                i = h % len(run)
                run = run[:i] + run[i + 1 :]
            if len(run) >= min_chars:
                n[run] += 1
    return {w: c for w, c in n.items() if c >= least}


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(rows, times=2, **options):
    n = vocabulary(rows, **options)
    form, count = {}, {}
    for w in n:
        others = [v for v in n if near(w, v)]
        count[w] = len(others)
        best = min(others, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= times * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n[w], count[w], n.get(form[w])))
    return sorted(out)


def found(spark, rows, **options):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, word string, n int")
    return sorted(tuple(r) for r in s.group(df, **options).collect())


def corpus(seed, n):
    rng = random.Random(seed)
    base = ["haven", "havens", "Raven", "ravens", "maven", "heaven", "éclair", "eclair", "ÉCLAIR", "straße", "strasse", "abcde", "abcdef", "aaaaa", "aaaaaa", "aaaaaaa", "shor", "naïve×naive", "ÿÿÿÿÿ"]
    rows = []
    for i in range(n):
        words = []
        for _ in range(rng.randint(0, 60)):
            w = rng.choice(base)
            if rng.random() < 0.2:
                k = rng.randrange(len(w))
                w = w[:k] + rng.choice(["", rng.choice("abeén"), w[k] + "s"]) + w[k + 1 :]
            words.append(w + rng.choice([" ", "-", "1", "\n", ", ", "日", "_"]))
        rows.append((rng.choice([i, i, i, None]), rng.choice(["".join(words)] * 6 + [None, ""])))
    return rows + rows[:7]


def test_brute(spark):
    rows = corpus(3, 400)
    got = found(spark, rows)
    assert got == brute(rows)
    assert len(got) > 200
    assert found(spark, rows, one_in=None, least=2) == brute(rows, one_in=None, least=2)
    assert found(spark, rows, times=3, min_chars=6, least=1) == brute(rows, times=3, min_chars=6, least=1)


def test_edges(spark):
    assert found(spark, []) == [] and found(spark, [(1, None), (None, ""), (2, "abcd 12345")]) == []
    rows = [(1, "Wanders wander " * 20_000), (None, "wonder wonder wonder")]
    assert found(spark, rows) == brute(rows)


def test_chain(spark):
    words = {"aaaaaaaaa" + "b" * i: 3 * 2 ** (10 - i) for i in range(10)}
    rows = [(7, " ".join([w] * n)) for w, n in words.items()]
    got = found(spark, rows, one_in=None)
    assert got == brute(rows, one_in=None) and {r[2] for r in got} == {"aaaaaaaaa"}


def test_no_pairs(spark):
    letters = [chr(c) for c in range(ord("a"), ord("z") + 1)] + [chr(c) for c in range(0xE0, 0x100)]
    rows = [(1, " ".join(f"wor{c}s" for c in letters for _ in range(3)))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    words = s.vocabulary(df, one_in=None).cache()
    assert words.count() == len(letters)
    assert s.replaced(words).count() == len(letters) and s.shifted(words).count() == 0
