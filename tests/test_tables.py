import random

from ledgerlens.operators import cascade, digests
from ledgerlens.operators.cascade import Reference


def plain_delete(tables, keys, references, roots):
    gone = {t: set(ks) for t, ks in roots.items()}
    while True:
        before = sum(map(len, gone.values()))
        for r in references:
            if r.on_delete == "CASCADE":
                gone.setdefault(r.child, set()).update(row[keys[r.child]] for row in tables[r.child] if row[r.column] is not None and row[r.column] in gone.get(r.parent, ()) and row[keys[r.child]] is not None)
        if sum(map(len, gone.values())) == before:
            break
    out = {}
    for t, rows in tables.items():
        kept = []
        for row in rows:
            if row[keys[t]] in roots.get(t, ()) or any(r.child == t and r.on_delete == "CASCADE" and row[r.column] is not None and row[r.column] in gone.get(r.parent, ()) for r in references):
                continue
            row = dict(row)
            for r in references:
                if r.child == t and r.on_delete == "SET NULL" and row[r.column] in gone.get(r.parent, ()):
                    row[r.column] = None
            kept.append(row)
        out[t] = kept
    return out


SCHEMAS = {"profile": "id long, boss long, key string", "video": "id long, profile long, asset long", "asset": "id long, profile long", "result": "id long, asset long, next long"}
KEYS = dict.fromkeys(SCHEMAS, "id")
REFERENCES = [Reference("profile", "boss", "profile"), Reference("asset", "profile", "profile"), Reference("video", "profile", "profile"), Reference("video", "asset", "asset", "SET NULL"), Reference("result", "asset", "asset"), Reference("result", "next", "result")]


def tables(seed):
    rng = random.Random(seed)
    pick = lambda n: rng.choice([None, *range(n)])
    return {
        "profile": [{"id": i, "boss": pick(30) if i % 3 else None, "key": "k"} for i in range(30)],
        "video": [{"id": i, "profile": pick(30), "asset": pick(50)} for i in range(80)],
        "asset": [{"id": i, "profile": pick(40)} for i in range(50)] + [{"id": None, "profile": 1}, {"id": None, "profile": None}],
        "result": [{"id": i, "asset": pick(50), "next": (i + 1) % 90 if i > 60 else pick(90)} for i in range(90)],
    }


def test_cascade(spark):
    for seed, root in ((1, [1, 7]), (2, [3]), (3, [29, 999, None])):
        data = tables(seed)
        frames = {t: spark.createDataFrame([tuple(r.values()) for r in rows], SCHEMAS[t]) for t, rows in data.items()}
        out = cascade.delete(frames, KEYS, REFERENCES, {"profile": spark.createDataFrame([(k,) for k in root], "key long")})
        want = plain_delete(data, KEYS, REFERENCES, {"profile": [k for k in root if k is not None]})
        for t in data:
            assert sorted(map(str, (tuple(r) for r in out.tables[t].collect()))) == sorted(str(tuple(r.values())) for r in want[t]), t
        counts = {r.table: (r.kept, r.deleted) for r in out.counts.collect()}
        assert counts == {t: (len(want[t]), len(data[t]) - len(want[t])) for t in data}
    assert counts["profile"][1] > 0


def test_cascade_cycle(spark):
    ring = spark.createDataFrame([(i, (i + 1) % 6) for i in range(6)] + [(10, None)], "id long, next long")
    out = cascade.delete({"ring": ring}, {"ring": "id"}, [Reference("ring", "next", "ring")], {"ring": spark.createDataFrame([(2,)], "key long")})
    assert [r.id for r in out.tables["ring"].collect()] == [10]
    none = cascade.delete({"ring": ring}, {"ring": "id"}, [Reference("ring", "next", "ring")], {"ring": spark.createDataFrame([], "key long")})
    assert none.tables["ring"].count() == 7 and none.counts.collect()[0].deleted == 0


def test_set_difference(spark):
    a = spark.range(5_000).selectExpr("id as k", "cast(id % 7 as string) as `b.c`", "id as side")
    b = a.where("k <> 17 and k <> 4000").unionByName(spark.createDataFrame([(9_999, None, 0), (None, None, 1)], "k long, `b.c` string, side long"))
    got = sorted((tuple(r) for r in digests.set_difference(a, b, ["k"]).collect()), key=str)
    assert got == sorted([(17, "only_expected"), (4_000, "only_expected"), (9_999, "only_actual"), (None, "only_actual")], key=str)
    assert digests.set_difference(a, a.unionByName(a.limit(9)), ["k", "b.c"]).count() == 0
    assert digests.set_difference(a.limit(0), a.limit(0), ["k"]).count() == 0
    assert digests.set_difference(a.limit(0), a, ["k"]).count() == 5_000
    leaves = digests.differing(digests.digests(a, ["k"], ["k"]), digests.digests(b, ["k"], ["k"]))
    assert leaves.count() == 4
    assert digests.differing(digests.digests(a, ["k"]), digests.digests(a.repartition(7), ["k"])).count() == 0


def test_changes(spark):
    old = spark.createDataFrame([(1, "a", None), (2, "b", 1.5), (3, None, 2.0), (4, "d", 0.0), (5, "e", 1.0), (5, "e", 1.0), (None, "n", 1.0)], "k long, _row string, x double")
    new = spark.createDataFrame([(None, "a", 1), (1.5, "b", 2), (2.5, None, 3), (1.0, "e", 5), (7.0, "z", 8), (1.0, None, None)], "x double, _row string, k long")
    got = {r.k: r.kind for r in digests.changes(old, new, "k").collect()}
    assert got == {3: "changed", 4: "removed", 5: "changed", 8: "added", None: "changed"}
    assert digests.changes(old, old, "k", known=(digests.digests(old, ["k"]), None)).count() == 0
    swapped = spark.createDataFrame([(1, None, "a")], "k long, p string, q string")
    assert digests.changes(swapped, swapped.selectExpr("k", "q as p", "p as q"), "k").collect()[0].kind == "changed"
