"""Callers' columns that have the names of internal ones, null and repeated keys."""

import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import quality, readiness, records, relational


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_clashing_names(spark):
    children = spark.createDataFrame([(1, 1, "a"), (2, 9, "b"), (3, None, "c")], "id long, parent long, _p string")
    parents = spark.createDataFrame([(1, "x"), (1, "y")], "key long, _p string")
    assert rows_of(relational.set_null_cascade(children, parents, "parent", "key")) == [(1, 1, "a"), (2, None, "b"), (3, None, "c")]
    rows = spark.createDataFrame([(1, None, 5, True), (2, "old", 6, False), (None, "n", 7, True)], "id long, failure string, _k int, _ok boolean")
    after, n = relational.exists_update(rows, spark.createDataFrame([(1,), (1,)], "id long"), "id", "failure", F.when(F.col("id") == 2, "new"))
    assert rows_of(after) == [(1, None, 5, True), (2, "new", 6, False), (None, "n", 7, True)] and n.collect()[0].affected == 2
    results = spark.createDataFrame([(1, "h", 0, 0), (2, "h", 0, 0), (None, "h", 0, 0)], "id long, sha string, _k int, _asset int")
    assets = spark.createDataFrame([(1, "h")], "id long, own string")
    assert rows_of(records.for_asset(results, assets, "id", {"sha": "own"})) == [(2, "unknown_asset"), (None, "unknown_asset")]
    named = spark.createDataFrame([(1, 1, "x", "y"), (2, 1, "x", "y"), (None, 1, "x", "y")], "grp long, owner long, _g string, _o string")
    assert rows_of(records.outside_group(named, spark.createDataFrame([(1, 1)], "g long, o long"), "grp", "owner", "g", "o")) == [(2, 1, "x", "y")]
    picks = spark.createDataFrame([(1, "s", "t"), (None, "s", "t")], "link long, _asset string, _observed string")
    media = spark.createDataFrame([(1, "Prepared")], "id long, state string")
    got = readiness.chained(picks, media, media.select("id"), media.select("id").limit(0), "link", "id")
    assert rows_of(got.select("link", "_asset", "state", "has_result", "observed")) == [(1, "s", "Prepared", True, None), (None, "s", None, None, None)]
    events = spark.createDataFrame([("j", 1, "end", 0, 0), ("j", 2, "run", 0, 0), (None, 1, "end", 0, 0), (None, 3, "run", 0, 0)], "job string, at int, state string, _by int, _first int")
    assert rows_of(quality.after_terminal(events, "job", ["at"], "state", ("end",)).select("job", "at", "_by")) == [("j", 2, 0), (None, 3, 0)]
    texts = spark.createDataFrame([(1, "A", 1), (2, "a", 2), (3, None, 3), (4, None, 4)], "id long, t string, _v int")
    assert rows_of(quality.repeated(texts, F.lower("t"))) == [(1, "A", 1), (2, "a", 2)]


def test_looked_up(spark):
    rows = spark.createDataFrame([(1, 0), (2, 0), (None, 0)], "id long, _n int")
    build = spark.createDataFrame([(1, "a", 5), (3, "c", 6)], "id long, name string, _b int")
    assert rows_of(relational.looked_up(rows, build, "id")) == [(1, 0, "a", 5), (2, 0, None, None), (None, 0, None, None)]
    for bad in (build.unionByName(build.limit(1)), build.unionByName(build.limit(1).withColumn("id", F.lit(None).cast("long")))):
        with pytest.raises(Exception, match="not unique"):
            relational.looked_up(rows, bad, "id").select("id").collect()
    with pytest.raises(ValueError, match="name"):
        relational.looked_up(rows.withColumn("name", F.lit(1)), build, "id")


def test_null_keys_stay_out(spark):
    new = spark.createDataFrame([(None, 1), (None, 1), (5, 1), (6, None), (6, None), (7, 9), (1, 1)], "id long, parent long")
    old = spark.createDataFrame([(1, 1)], "id long, parent long")
    parents = spark.createDataFrame([(1,)], "key long")
    faults = rows_of(relational.insert_faults(new, old, "id", parents, "parent", "key"))
    assert faults == [(1, "taken"), (6, "given_twice"), (7, "no_parent"), (None, "null_key")]
    assert rows_of(relational.inserted(new, old, "id", parents, "parent", "key")) == [(1, 1), (5, 1)]


def test_updates(spark):
    rows = spark.createDataFrame([(1, 5), (2, None), (2, None)], "id long, x long")
    after, n = relational.guarded_update(rows, F.col("x") > 1, x=F.col("id") + F.col("x"))
    assert rows_of(after) == [(1, 6), (2, None), (2, None)] and n.collect()[0].affected == 1
    kids = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (None, "d")], "p long, v string")
    fresh = spark.createDataFrame([(1, "z"), (None, "y")], "p long, v string")
    assert rows_of(relational.replace_children(kids, fresh, "p")) == [(1, "z"), (2, "c"), (None, "d"), (None, "y")]
    assert rows_of(relational.latest(spark.createDataFrame([(1, 1, "a"), (1, 2, None), (None, 1, "n")], "k long, at int, v string"), ["k"], ["at"], "v")) == [(1, None), (None, "n")]
    assert rows_of(relational.pending(rows.unionByName(rows.limit(1).withColumn("id", F.lit(None).cast("long"))), kids.select(F.col("p").alias("id")), "id").select("id")) == [(None,)]
