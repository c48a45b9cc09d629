import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from ledgerlens.llm.mixing import GOLDEN_STEP, POINTS, mix, schedule, source_targets


def brute_targets(sizes, weights=(1, 2, 3), cap=3):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, open_, out = float(sum(sizes.values())), set(names), {}
    while open_:
        share = {s: left * w[s] / sum(w[x] for x in open_) for s in open_}
        above = {s for s in open_ if share[s] > cap * sizes[s]}
        if not above:
            return out | share
        for s in above:
            out[s] = float(cap * sizes[s])
            left -= out[s]
        open_ -= above
    return out


CASES = [{"a": 100, "b": 10, "c": 5}, {"a": 1000, "b": 1, "c": 1, None: 50}, {"x": 7}, {"a": 0, "b": 10}, {"a": 0, "b": 0}, {"a": 5, "b": 5, "c": 400, "d": 2, "e": 90}]


@pytest.mark.parametrize("sizes", CASES)
def test_targets(spark, sizes):
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r.source: r.target for r in source_targets(df, (1, 2, 3), 3).collect()}
    want = brute_targets(sizes)
    assert got.keys() == want.keys()
    for s in want:
        assert got[s] == pytest.approx(want[s])


def test_schedule(spark):
    shares = spark.createDataFrame([("a", 0.2), ("b", 0.5), (None, 0.3)], "source string, slot_share double")
    rows = [(r.source, r.rank) for r in schedule(spark, shares, 1000, chunk_slots=64).collect()]
    want, seen = [], defaultdict(int)
    for i in range(1000):
        p = i * GOLDEN_STEP % POINTS / POINTS
        s = "a" if p < 0.2 else "b" if p < 0.7 else None
        want.append((s, seen[s]))
        seen[s] += 1
    assert sorted(rows, key=str) == sorted(want, key=str)
    assert abs(seen["a"] - 200) <= 3 and abs(seen["b"] - 500) <= 3


def docs(spark):
    rows = [(i, "w " * (5 + i % 90), f"s{i % 4}" if i % 7 else None, "clash") for i in range(400)]
    rows += [(400, None, "s0", ""), (401, "", None, ""), (402, "big " * 5000, "s1", ""), (None, "a b", "s2", ""), (3, "w " * 8, "s3", "")]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, taken string")


def test_mix(spark):
    df = docs(spark)
    rows = mix(df, docs_per_chunk=16).collect()
    assert len(rows) == df.count()
    sizes, taken = defaultdict(int), defaultdict(int)
    for r in rows:
        assert 0 <= r.taken <= 3 * r.size
        sizes[r.source] += r.size
        taken[r.source] += r.taken
    want = brute_targets(sizes)
    for r in rows:
        assert r.source_size == sizes[r.source]
        assert r.target == pytest.approx(want[r.source])
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 4 * 64
    again = mix(df.repartition(7), docs_per_chunk=16).collect()
    assert sorted(map(str, again)) == sorted(map(str, rows))


def brute_taken(spark, rows, chunk_docs, block=64, cap=3, seed=7):
    """taken of each row by walking streams, blocks and slots one by one; only the hash of the shuffle is Spark's."""
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    mark = F.xxhash64("text")
    hashed = [(r.doc_id, r.text, r.source, r.mark, r.place) for r in df.select("*", mark.alias("mark"), F.xxhash64("doc_id", F.lit(seed), mark).alias("place")).collect()]
    by = defaultdict(list)
    for d, text, source, m, place in hashed:
        by[source].append((d, len(re.findall(r"[^\x20\x09-\x0D]+", text or "")), m, place))
    sizes = {s: sum(x[1] for x in v) for s, v in by.items()}
    targets = brute_targets(sizes)
    names = sorted(by, key=lambda s: (s is None, s or ""))
    blocks = {s: -(-sizes[s] // block) for s in names}
    slots = {s: targets[s] / sizes[s] * blocks[s] if sizes[s] else 0.0 for s in names}
    total = sum(slots.values())
    edges, upto = [], 0.0
    for s in names:
        upto += slots[s] / max(total, 1e-9)
        edges.append(round(upto * POINTS))
    edges[-1] = POINTS
    times, seen = defaultdict(int), defaultdict(int)
    for i in range(round(total)):
        p = i % POINTS * GOLDEN_STEP % POINTS
        s = names[next(k for k, e in enumerate(edges) if p < e)]
        if seen[s] < blocks[s] * cap:
            times[s, seen[s] % blocks[s]] += 1
        seen[s] += 1
    out = []
    for s in names:
        chunks = -(-len(by[s]) // chunk_docs)
        offset = 0
        for d, size, *_ in sorted(by[s], key=lambda x: (x[3] % chunks, x[3], x[0] is not None, x[0], x[2])):
            words = range(offset, offset + size)
            out.append((d, s, size, sum(times[s, w // block] for w in words)))
            offset += size
    return sorted(out, key=str)


def test_taken(spark):
    rows = [(i if i % 3 else None, " ".join(f"w{i}" for _ in range(i * 7 % 90)), [None, "a", "b", "c"][i % 4] if i % 5 else "hot") for i in range(300)]
    rows += [(1, None, "a"), (2, "", None), (2, "x " * 900, "c"), (2, "y " * 900, "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = sorted(((r.doc_id, r.source, r.size, r.taken) for r in mix(df, docs_per_chunk=16).collect()), key=str)
    assert got == brute_taken(spark, rows, 16)


def test_rows_without_ids_spread(spark):
    rows = spark.range(6_000).select(F.when(F.col("id") % 3 > 0, F.col("id")).alias("doc_id"), F.concat(F.lit("t "), F.col("id").cast("string")).alias("text"), F.lit("s").alias("source"))
    place = F.pmod(F.xxhash64("doc_id", F.lit(7), F.xxhash64("text")), F.lit(6))
    assert max(r["count"] for r in rows.groupBy(place).count().collect()) < 1_300
    out = mix(rows, docs_per_chunk=1_000)
    assert out.count() == 6_000 and out.agg(F.sum("taken")).first()[0] == pytest.approx(12_000, abs=256)


def test_empty(spark):
    assert mix(docs(spark).limit(0)).count() == 0
    assert [r.taken for r in mix(docs(spark).where("doc_id = 400")).collect()] == [0]
