import random

from ledgerlens.operators import paths, relational


def corpus(n, seed=1):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        depth = rng.randint(0, 6)
        p = rng.choice(["/", "c:/", "", "http://h/"]) + "/".join(rng.choice(["a", "B", "aa", "é", "a b", "b-"]) for _ in range(depth))
        rows.append((i, rng.choice([p, p, p + "/", p.upper(), None if i % 50 == 0 else p])))
    return rows


def plain(rows):
    fold = lambda p: p.lower().rstrip("/") + "/"
    known = [(k, fold(p)) for k, p in rows if p is not None]
    least = {}
    for k, p in known:
        least[p] = min(k, least.get(p, k))
    out = []
    for k, p in known:
        above = [q for q in least if p != q and p.startswith(q) and q != "http:/"]
        out.append((k, least[p], least[max(above, key=len)] if above else None))
    return sorted(out, key=str)


def test_nested(spark):
    rows = corpus(400) + [(500, "http://"), (501, "C:"), (502, "/")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "k long, p string, place string")
    for n in (1, 3, 7):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        try:
            got = sorted((tuple(r) for r in paths.nested(df.repartition(3), "k", "p").collect()), key=str)
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", 4)
        assert got == plain(rows)
    assert any(o is None for *_, o in got) and any(s != k for k, s, _ in got)


def test_pairs_follow(spark):
    rows = [(i, p) for i, p in enumerate(["/a", "/A/", "/a/b", "/a/b/c", "/ab", "/x/y", "/X/Y/z", "/a/b/c/d/", "/q"])]
    df = spark.createDataFrame(rows, "k long, p string")
    nested = paths.nested(df, "k", "p")
    groups = {r.k: r.same for r in nested.collect()}
    held = {(r.outer, r.inner) for r in paths.holding(nested).collect()}
    want = {tuple(r) for r in relational.overlapping_paths(df, "k", "p").collect()}
    got = {(a, b) for a in groups for b in groups if (groups[a], groups[b]) in held or (groups[a] == groups[b] and a < b)}
    assert got == want


def test_edges(spark):
    df = spark.createDataFrame([], "k long, p string")
    assert paths.nested(df, "k", "p").count() == 0 and paths.holding(paths.nested(df, "k", "p")).count() == 0
    same = spark.range(3_000).selectExpr("id as k", "'/One/place' as p")
    got = paths.nested(same, "k", "p")
    assert got.count() == 3_000 and got.select("same", "outer").distinct().collect() == [(0, None)]
    deep = spark.createDataFrame([(i, "/d" * i) for i in range(1, 60)], "k long, p string")
    assert sorted((r.k, r.outer) for r in paths.nested(deep, "k", "p").collect()) == [(i, i - 1 if i > 1 else None) for i in range(1, 60)]
