import random

import test_decontamination
import test_jaccard_join
import test_line_dedup
import test_mixing
import test_quality_rules

import corpus_pipeline as p
from ledgerlens.llm import quality_rules


def corpus():
    r = random.Random(8)
    say = lambda n: " ".join(f"w{r.randrange(3000)}" for _ in range(n))
    items = [(k, say(r.randrange(12, 30))) for k in range(6)]
    line = "a common line that many documents hold " + say(3)
    rows = []
    for k in range(260):
        text = "\n".join(say(r.randrange(8, 40)) for _ in range(r.randrange(1, 4)))
        if k % 9 == 0:
            text += "\n" + line + r.choice(["", "x", "!"])
        if k % 5 == 0:
            text = " ".join(w + "###" for w in text.split(" "))
        if k % 13 == 0:
            text += " " + items[k % 6][1]
        if k % 7 == 0 and rows:
            w = rows[-1][1].split(" ")
            w[len(w) // 2] = "changedword"
            text = " ".join(w)
        rows.append((k, text, "en", f"s{k % 3}" if k % 17 else None, len(text)))
    rows += [(300, None, "en", "s0", None), (301, "", None, None, 0), (5, rows[5][1], "en", "s2", 3), (None, say(30), "en", "s1", 1)]
    labels = [(k, int(k % 5 > 0), 0) for k in range(260)]
    return rows, items, labels


def test_stages_against_brute_force(spark, tmp_path):
    rows, items, labels = corpus()
    d = str(tmp_path)
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    docs = spark.read.parquet(f"{d}/documents.parquet")
    states = [docs]
    for k, (_, stage) in enumerate(p.STAGES):
        stage(spark, states[-1], d).coalesce(1).write.parquet(f"{d}/stage{k}")
        states.append(spark.read.parquet(f"{d}/stage{k}"))
        if k < 4:
            assert states[-1].columns == list(p.COLUMNS)
    had = [[tuple(x) for x in s.collect()] for s in states]
    key = lambda rows: sorted(((x[0], x[1]) for x in rows), key=str)

    rules = quality_rules.fit(docs, spark.read.parquet(f"{d}/labels.parquet"))
    assert rules
    stats = {i: test_quality_rules.brute(x[1]) for i, x in enumerate(had[0])}
    base = [x for i, x in enumerate(had[0]) if stats[i][0] >= 10 and 100 * stats[i][4] <= 20 * stats[i][0]]
    assert set(key(had[1])) <= set(key(base))
    good, junk = (sum(("###" in (x[1] or "")) == j for x in base) for j in (False, True))
    assert sum("###" in x[1] for x in had[1]) <= 0.5 * junk and sum("###" not in x[1] for x in had[1]) >= 0.98 * good

    lines = test_line_dedup.brute([x[:2] for x in had[1]], 2, 10)
    left = sorted([(i, h) for i, n, same, near, h in lines if n > same + near], key=str)
    import hashlib

    assert sorted([(x[0], hashlib.sha256(x[1].encode()).hexdigest()) for x in had[2]], key=str) == left

    found, groups = test_jaccard_join.brute([x[:2] for x in had[2]], 5, 80)
    assert len(had[3]) == groups and set(key(had[3])) <= set(key(had[2]))
    lows = {c for _, _, c in found}
    assert {x[0] for x in had[3]} == lows

    dirty = {(x[0], x[1]) for x, y in zip(sorted(had[3], key=str), [None] * len(had[3])) if test_decontamination.brute([x[:2]], items)[0][5]}
    assert dirty and set(key(had[4])) == set(key(had[3])) - dirty

    sizes = {}
    for x in had[4]:
        sizes[x[3]] = sizes.get(x[3], 0) + len(x[1].split())
    want = test_mixing.brute_targets(sizes)
    for s in sizes:
        assert abs(sum(x[5] for x in had[5] if x[1] == s) - want[s]) <= 4 * 64
    assert p.run(spark, d).count() == len(had[5])


def test_empty(spark, tmp_path):
    d = str(tmp_path)
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    assert p.run(spark, d).count() == 0
