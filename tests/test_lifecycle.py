import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import lifecycle as lc
from ledgerlens.streaming import lifecycle as stream

T0 = datetime(2024, 1, 1)
STATES = [s for s in lc.JOB.states if s] + [None, "Paused"]
SCHEMA = "job long, ts timestamp, id long, state string, before int, kind string"


def updates(seed, n, jobs=6):
    rng = random.Random(seed)
    weights = [4, 8, 0.3, 0.3, 0.2, 0.2, 1, 1]
    rows, at = [], T0
    for i in range(n):
        at += timedelta(seconds=rng.choice([0, 1, 30, 200, 500]), microseconds=rng.choice([0, 1, 999_999]))
        rows.append((rng.choice([*range(jobs), None]), at, i, rng.choices(STATES, weights)[0], 7, "x"))
    return rows


def plain(rows, gap, until=None):
    """Endings and updates that do not count, job by job; and the illegal transitions without any gap."""
    until = max((r[1] for r in rows), default=None) if until is None else until
    out, illegal = [], []
    for job in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == job), key=lambda r: (r[1], r[2]))
        now = ""
        for r in own:
            if r[3] not in lc.JOB.moves.get(now, ()):
                illegal.append((r[2], now))
            else:
                now = r[3]
        now, last, ended = "", None, False
        for r in own:
            ok = not ended and r[3] in lc.JOB.moves.get(now, ())
            if not ended and last is not None and r[1] > last + gap:
                out.append((job, last + gap, "Interrupted"))
                ended = True
            if ended:
                out.append((job, r[1], "late"))
            elif not ok:
                out.append((job, r[1], "illegal"))
            else:
                now, last = r[3], r[1]
                ended = now in lc.JOB.terminal
                if ended:
                    out.append((job, r[1], now))
        if not ended and last is not None and until > last + gap:
            out.append((job, last + gap, "Interrupted"))
    key = lambda x: (x[0] is None, *map(str, x))
    return sorted(out, key=key), sorted(illegal)


def found(df):
    return sorted(map(tuple, df.collect()), key=lambda x: (x[0] is None, *map(str, x)))


@pytest.mark.parametrize("chunk", [None, "date_trunc('hour', ts)", "floor(unix_timestamp(ts) / 600)"])
def test_walks(spark, chunk):
    chunk = chunk and F.expr(chunk)
    rows = updates(1, 300)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    ends, illegal = plain(rows, timedelta(minutes=30))
    got = lc.illegal_transitions(df, ["job"], ["ts", "id"], "state", chunk=chunk)
    assert got.columns == ["job", "ts", "id", "state", "kind", "before"]
    assert sorted((r.id, r.before) for r in got.collect()) == illegal and len(illegal) > 50
    assert found(lc.endings(df, ["job"], "ts", ["id"], "state", "30 MINUTES", chunk=chunk)) == ends
    assert {k for _, _, k in ends} >= {"Interrupted", "late", "illegal"}


def test_edges(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert lc.endings(empty, ["job"], "ts", ["id"], "state", "1 HOUR").count() == 0
    assert lc.illegal_transitions(empty, ["job"], ["ts", "id"], "state").count() == 0
    same = [(1, T0, 1, "Failed", 0, "")] * 3 + [(2, T0, 1, "Running", 0, "")] * 2 + [(3, T0, 5, None, 0, "")]
    df = spark.createDataFrame(same, SCHEMA)
    until = F.lit(T0 + timedelta(hours=2))
    assert found(lc.endings(df, ["job"], "ts", ["id"], "state", "1 HOUR", until=until)) == plain(same, timedelta(hours=1), T0 + timedelta(hours=2))[0]


def test_one_hot_job(spark):
    rows = [(1, T0 + timedelta(seconds=i), i, "Running" if i % 7 else "Queued", 0, "") for i in range(20_000)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = lc.illegal_transitions(df, ["job"], ["ts", "id"], "state", chunk=F.date_trunc("hour", "ts"))
    assert got.count() == len([i for i in range(1, 20_000) if i % 7 == 0])
    spread = lc.walked(df, ["job"], ["ts", "id"], "state", chunk=F.date_trunc("hour", "ts")).select("place.chunk").distinct().count()
    assert spread == 6


def test_rows_are_shuffled_once(spark):
    rows = spark.createDataFrame(updates(3, 400), SCHEMA)
    keep = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for large tables
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = lc.endings(rows, ["job"], "ts", ["id"], "state", "30 MINUTES", chunk=F.expr("date_trunc('hour', ts)"))._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in keep.items():
            spark.conf.set(k, v)
    lines = [x for x in plan.split("\n") if "Exchange" in x]
    made = [x for x in lines if "Reused" not in x and "Broadcast" not in x]
    # rows by chunk, chunks by job, what holds at their beginning by chunk, and the greatest time; jobs have no row of their own
    assert len(made) == 4 and sum("REPARTITION_BY_COL" in x for x in made) == 1 and sum("SinglePartition" in x for x in made) == 1
    assert plan.count("ArrowEvalPython") == 1 and "MapInArrow" not in plan


def test_other_kinds_of_times_and_names(spark):
    rows = updates(5, 200)
    want, _ = plain(rows, timedelta(minutes=30))
    df = spark.createDataFrame(rows, SCHEMA).withColumnsRenamed({"id": "entry", "state": "over", "job": "now"})
    assert found(lc.endings(df, ["now"], "ts", ["entry"], "over", "30 MINUTES", chunk=F.expr("date_trunc('hour', ts)"))) == want
    got = lc.walked(df.withColumn("_number", F.lit(1)), ["now"], ["ts", "entry"], "over")
    assert got.columns == ["now", "ts", "entry", "over", "kind", "_number", "before", "legal", "place"] and got.count() == 200
    plain_time = df.withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    assert found(lc.endings(plain_time, ["now"], "ts", ["entry"], "over", "30 MINUTES")) == want
    days = spark.createDataFrame([(1, "2024-01-01", "Running"), (1, "2024-01-02", "Running"), (1, "2024-01-09", "Running"), (2, "2024-01-09", "Failed"), (2, "2024-01-09", "Queued")], "j int, d string, s string").select("j", F.col("d").cast("date").alias("d"), "s")
    got = lc.endings(days, ["j"], "d", [], "s", "1 DAY", chunk=F.expr("date_trunc('week', d)"))
    assert sorted((r.j, str(r.d)[:10], r.kind) for r in got.collect()) == [(1, "2024-01-03", "Interrupted"), (1, "2024-01-09", "late"), (2, "2024-01-09", "Failed"), (2, "2024-01-09", "late")]


def test_readiness_after(spark):
    ended = spark.createDataFrame([(1, True), (1, False), (2, False), (3, True), (None, True), (4, None)], "p long, media boolean")
    rows = spark.createDataFrame([(1, "Validated"), (1, "Prepared"), (2, "Validated"), (9, "Validated")], "p long, state string")
    rows = rows.select("p", "state", F.lit(True).alias("linked"), F.lit(True).alias("r"), F.lit(False).alias("o"), F.lit(False).alias("f"))
    got = lc.readiness_after(ended, rows, "p", F.col("media"), state="state", linked="linked", has_result="r", observed="o", observation_failed="f")
    assert found(got) == [(1, "MediaValidated"), (2, "Draft"), (3, "Draft"), (4, "Draft")]


def test_stream_restarts(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = [r for r in updates(2, 160, jobs=4)]
    rng = random.Random(4)
    shuffled = [r for lo in range(0, 160, 20) for r in rng.sample(rows[lo : lo + 20], 20)]  # out of order within the lateness
    end = (99, max(r[1] for r in rows) + timedelta(days=2), 10_000, "Completed", 0, "")
    seen = []
    for part in (shuffled[:60], shuffled[60:120], shuffled[120:] + [end]):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        source = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        out = stream.endings(source, "job", "ts", "id", "state", gap_seconds=1_800, lateness="2 hours")
        query = out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "at")).trigger(availableNow=True).start()
        assert query.awaitTermination(300)
        seen.append(spark.read.schema(out.schema).parquet(str(tmp_path / "out")).count())
    got = found(spark.read.parquet(str(tmp_path / "out")))
    want = plain(rows + [end], timedelta(minutes=30))[0]
    assert got == [w for w in want if w[0] != 99]
    assert 0 < seen[1] < seen[2]
