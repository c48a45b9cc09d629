import hashlib
import json
import os
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlens.sources import documents, folders, wave


def riff(values, before=b"", after=b""):
    data = np.asarray(values, "<i2").tobytes()
    body = b"WAVE" + b"fmt " + struct.pack("<I", 16) + struct.pack("<HHIIHH", *wave.FORMAT) + before + b"data" + struct.pack("<I", len(data)) + data + after
    return b"RIFF" + struct.pack("<I", len(body)) + body


def test_wave_ranges(spark, tmp_path):
    good = riff([1, -2, 3])
    files = {"long": riff(np.arange(200_000) % 1000 - 500), "short": good, "none": riff([]), "list": riff([7], before=b"LIST" + struct.pack("<I", 3) + b"abc\0", after=b"junk" + struct.pack("<I", 0)), "cut": good[:-1], "text": b"not a wave", "empty": b"", "stereo": good.replace(struct.pack("<HH", 1, 1), struct.pack("<HH", 1, 2), 1), "early": b"RIFF" + struct.pack("<I", 12) + b"WAVEdata" + struct.pack("<I", 0)}
    for name, content in files.items():
        (tmp_path / f"{name}.wav").write_bytes(content)
    want = {tuple(r) for r in wave.read(spark, f"{tmp_path}/*.wav").collect()}
    for size in (1 << 20, 50_001):
        got = wave.ranged(spark, f"{tmp_path}/*.wav", range_bytes=size)
        rows = got.collect()
        assert {tuple(r) for r in rows} == want and len(rows) == len(want)
    assert got.rdd.getNumPartitions() >= 9  # the long file alone has eight ranges


def test_bundles(spark, tmp_path):
    def bundle(name, files, subfolder=False):
        at = tmp_path / name
        at.mkdir()
        for f, content in files.items():
            (at / f).write_bytes(content)
        if subfolder:
            (at / "more").mkdir()
        return str(at)

    right = {"a.mp4": b"x" * 3_000_000, "b.json": b"{}"}
    rows = []
    expect = lambda at, files: [(at, n, len(c), hashlib.sha256(c).hexdigest()) for n, c in files.items()]
    cases = {
        "right": (right, {}, "Verified"),
        "extra": ({**right, "c": b"1"}, {}, "IntegrityMismatch"),
        "part": ({**right, "c.PART": b"1"}, {}, "IntegrityMismatch"),
        "missing": ({"b.json": b"{}"}, {}, "IntegrityMismatch"),
        "length": ({**right, "b.json": b"{ }"}, {}, "IntegrityMismatch"),
        "hash": ({**right, "b.json": b"[]"}, {}, "IntegrityMismatch"),
        "folder": (right, {"subfolder": True}, "IntegrityMismatch"),
    }
    want = {}
    for name, (files, options, state) in cases.items():
        at = bundle(name, files, **options)
        rows += expect(at, right)
        want[at] = state
    gone = str(tmp_path / "gone")
    rows += expect(gone, right)
    want[gone] = "IntegrityMismatch"
    odd = bundle("odd", right)
    rows += [(odd, n, size, sha.upper()) for _, n, size, sha in expect(odd, right)]
    want[odd] = "IntegrityMismatch"
    rows += [(None, "a", 1, "b"), rows[0]]
    df = spark.createDataFrame(rows, "folder string, name string, length long, sha256 string")
    assert {r.folder: r.state for r in folders.bundle_states(df).collect()} == want
    assert folders.bundle_states(df.limit(0)).count() == 0
    if os.getuid():
        locked = bundle("locked", right)
        os.chmod(f"{locked}/b.json", 0)
        one = spark.createDataFrame(expect(locked, right), df.schema)
        assert folders.bundle_states(one).collect()[0].state == "OperationalFailure"


def test_unreadable(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "f").write_bytes(b"abc")
    df = spark.createDataFrame([(str(tmp_path / "f"), 1), (str(tmp_path / "none"), 2), (str(tmp_path / "d"), 3), (None, 4), (f"file:{tmp_path}/f", 5)], "p string, sha256 int")
    got = {r.p: (r.sha256, r.n_read) for r in folders.hashed(df, "p").collect()}
    sha = hashlib.sha256(b"abc").hexdigest()
    assert got == {str(tmp_path / "f"): (sha, 3), f"file:{tmp_path}/f": (sha, 3), str(tmp_path / "none"): (None, None), str(tmp_path / "d"): (None, None), None: (None, None)}
    listed = folders.entries(spark.createDataFrame([(str(tmp_path),), (str(tmp_path / "f"),), (None,), (str(tmp_path),)], "at string"), "at").collect()
    assert sorted((r.name, r.length, r.is_directory) for r in listed) == [("d", None, True), ("f", 3, False)]


def test_documents(spark, tmp_path):
    documents.register(spark)
    at = str(tmp_path / "out")
    save = lambda df: df.write.format(documents.FORMAT).mode("append").option("name", "id").save(at)
    rows = spark.createDataFrame([("a", 1, None, [1, 2]), ("b-1", 2, "é", [])], "id string, item_count long, last_error string, codes array<long>")
    save(rows.repartition(2))
    assert sorted(os.listdir(at)) == ["a.json", "b-1.json"]
    assert (tmp_path / "out/a.json").read_text() == json.dumps({"itemCount": 1, "lastError": None, "codes": [1, 2]}, indent=2)
    save(rows.withColumn("item_count", F.lit(9)).limit(1))
    assert json.loads((tmp_path / "out/a.json").read_text())["itemCount"] == 9
    kept = sorted((f, (tmp_path / "out" / f).read_text()) for f in os.listdir(at))
    for bad in (rows.withColumn("id", F.lit("same")), rows.withColumn("id", F.lit("../x")), rows.withColumn("id", F.when(F.col("id") == "a", "c")), rows.withColumn("item_count", F.expr("if(id = 'a', 1, raise_error('no'))"))):
        with pytest.raises(Exception):
            save(bad.repartition(2))
        assert sorted((f, (tmp_path / "out" / f).read_text()) for f in os.listdir(at)) == kept
    save(rows.limit(0))
    assert len(os.listdir(at)) == 2


def test_retried_task(tmp_path):
    """A first attempt that vanished leaves its parts; the commit of the second leaves one file a document."""
    from pyspark.sql import Row

    w = documents.DocumentWriter(str(tmp_path), "name")
    w.write(iter([Row(name="a", x=1)]))
    w.commit([w.write(iter([Row(name="a", x=2), Row(name="b", x=3)]))])
    assert sorted(os.listdir(tmp_path)) == ["a.json", "b.json"] and json.loads((tmp_path / "a.json").read_text()) == {"x": 2}
