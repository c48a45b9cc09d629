import random
import re
from collections import Counter

from ledgerlens.llm import phrases as p


def brute(rows, max_n=3, least=10, percent=50, top=2_000):
    f, n = {}, Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for m in range(1, max_n + 1):
                for i in range(len(words) - m + 1):
                    f.setdefault(lang, Counter())[tuple(words[i : i + m])] += 1
    out = []
    for lang, counts in f.items():
        kept = []
        cand = {w: a for w, a in counts.items() if len(w) > 1 and a >= least}
        for w, a in cand.items():
            if any(len(v) > len(w) and any(v[i : i + len(w)] == w for i in range(len(v))) and 100 * b >= percent * a for v, b in cand.items()):
                continue
            score, k = min((1_000_000 * a * a // (counts[w[:k]] * counts[w[k:]]), k) for k in range(1, len(w)))
            kept.append((-score, -a, " ".join(w).encode(), counts[w[:k]], counts[w[k:]]))
        for rank, (s, a, w, left, r) in enumerate(sorted(kept)[:top], 1):
            out.append((lang, rank, w.decode(), -a, left, r, n[lang], -s))
    return sorted(out)


def found(spark, rows, **options):
    df = spark.createDataFrame([(i, lang, text, "x", 1) for i, (lang, text) in enumerate(rows)], "doc_id long, lang string, text string, phrase string, words int")
    return sorted(tuple(r) for r in p.mine(df, **options).collect())


def corpus(seed, n):
    rng = random.Random(seed)
    words = ["a", "B", "ü", "Ü", "the", "x\xa0y", "c-d", "日本", "𝔘", "q'"]
    rows = []
    for _ in range(n):
        text = "".join(rng.choice(words) + rng.choice([" ", " ", "  ", "\t", " ", ", ", ".", "\n", "\x0b", "; "]) for _ in range(rng.randint(0, 60)))
        rows.append((rng.choice(["en", "de", None, ""]), rng.choice([text, text, text, None, "", " \t.,"])))
    return rows + rows[:10]


def test_brute(spark):
    rows = corpus(1, 900)
    got = found(spark, rows)
    assert got == brute(rows) and len(got) > 50, len(got)
    for options in ({"max_n": 4, "least": 3, "percent": 80}, {"max_n": 2, "least": 2}, {"top": 5}, {"max_n": 5, "least": 4, "top": 7}):
        assert found(spark, rows, **options) == brute(rows, **options)


def test_edges(spark):
    assert found(spark, []) == [] and found(spark, [("en", None), (None, ""), ("en", "a b c " * 3)]) == []
    long = [("en", "One two three. " * 20_000), ("en", "one two " * 30_000)]
    assert found(spark, long) == brute(long)


def test_exact_beyond_64_bits(spark):
    big = 10**9 + 7
    counts = spark.createDataFrame([("en", "a", 1, 3 * big), ("en", "b", 1, big + 2), ("en", "a b", 2, big), ("en", "a b b", 3, big - 5), ("en", "b b", 2, big - 1)], "lang string, phrase string, words int, f long")
    got = {r.phrase: (r.l, r.r, r.score) for r in p.scored(counts, 10).collect()}
    score = lambda a, l, r: 1_000_000 * a * a // (l * r)
    assert got["a b"] == (3 * big, big + 2, score(big, 3 * big, big + 2))
    assert got["a b b"] == min([(3 * big, big - 1, score(big - 5, 3 * big, big - 1)), (big, big + 2, score(big - 5, big, big + 2))], key=lambda x: x[2])


def test_hot_language(spark):
    rows = [("en", " ".join(f"w{i} v{i}," for i in range(j % 7, 3_000))) for j in range(12)]
    got = found(spark, rows)
    assert got == brute(rows) and len(got) == 2_000
