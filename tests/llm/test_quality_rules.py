import re
from collections import Counter

from ledgerlens.llm import quality_rules as q

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    seen, hit = Counter(windows), set()
    for i, w in enumerate(windows):
        if seen[w] > 1:
            hit |= set(range(i, i + 5))
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit)


TEXTS = [
    None, "", " \n\t", "one", "a b c d e a b c d e", "x x x x x x x x x x x x", "l1 a\nl1 a\n\n \nl1 a\r\nb\xa0c ü#*$ <|>",
    "a b c d e f g h i j " * 3 + "k", "é\x0bf\x0cg 日本 😀😀", " ".join(f"w{i}" for i in range(50)), "p q r s t u p q r s t u v w x y p q r s t", "w " * 30_000,
]


def test_statistics(spark):
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(TEXTS)] + [(3, "one", ""), (None, "n n", "")], "doc_id long, text string, n_words string")
    got = sorted(((-1 if r.doc_id is None else r.doc_id), *(r[c] for c in q.STATS)) for r in q.statistics(df).collect())
    want = sorted([(i, *brute(t)) for i, t in enumerate(TEXTS)] + [(3, *brute("one")), (-1, *brute("n n"))])
    assert got == want
    assert q.statistics(df.limit(0)).count() == 0


def corpus(spark, n=900):
    rows, labels = [], []
    for i in range(n):
        words = [f"w{(i * 31 + j * j) % 977}" for j in range(20 + i % 50)]
        bad = i % 5 == 0
        if bad:
            words = [w + "###" for w in words] if i % 2 else [w.upper() + "!!" for w in words]
        rows.append((i, " ".join(words)))
        labels.append((i, int(not bad), 0))
    labels += [(0, 1, 0), (1, None, 0), (None, 1, 0), (10_000, 0, 0)]
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_learns_and_applies(spark):
    docs, labels = corpus(spark)
    rules = q.fit(docs, labels)
    assert 1 <= len(rules) <= 4 and all(1 <= len(r) <= 3 for r in rules)
    out = {r.doc_id: r for r in q.apply(docs, rules).collect()}
    wrong = [i for i in out if out[i].kept == (i % 5 == 0)]
    assert len(wrong) <= 9
    assert rules == q.fit(docs.repartition(5), labels)
    assert "PythonUDF" not in q.apply(docs, rules)._jdf.queryExecution().toString()


def test_no_labels(spark):
    docs, labels = corpus(spark, 20)
    assert q.fit(docs, labels.limit(0)) == []
    assert all(r.kept for r in q.apply(docs.where("doc_id % 5 > 0"), []).collect())
    assert q.fit(docs.limit(0), labels) == []


def test_filters_stay_above(spark):
    df = spark.createDataFrame([(1, "a b c d e f g h i j k", "x"), (2, "x " * 20_000, "y"), (3, None, "z")], "doc_id long, text string, kept string")
    rows = q.apply(df, [], row_col="row").where("kept").select("row.*").collect()
    assert [(r.doc_id, r.kept) for r in rows] == [(1, "x")]
