import hashlib
import os

import pytest
from pyspark.sql import functions as F

from ledgerlens.llm import warc

ROWS = (
    [(i, f"http://h/{i % 3} a\n", f"<p>{i % 7}</p>" * (3 + 20 * (i % 2)), "clash") for i in range(60)]
    + [(100, None, None, ""), (101, "u", "", ""), (102, "u", "ü" * 50, ""), (103, "v", "ü" * 50, ""), (104, "w", "x" * 99, ""), (105, "w", "x" * 99, "")]
    + [(None, "n", "y" * 200, ""), (None, "n", "y" * 200, ""), (None, "n", "ü" * 50, ""), (7, "http://h/7", "<p>0</p>" * 23, ""), (7, "http://h/7", "<p>0</p>" * 23, ""), (200, "l", "<b>" * 300_000, "")]
)


def frame(spark, rows=ROWS):
    return spark.createDataFrame(rows, "page_id long, url string, html string, digest string")


def brute(rows):
    """Rows in key order; the first of a payload is the response."""
    out, first, firsts = [], {}, {}
    for page_id, _, html, _ in rows:
        b = (html or "").encode()
        d = hashlib.sha256(b).hexdigest()
        if page_id is not None and len(b) >= 100:
            firsts[d] = min(firsts.get(d, page_id), page_id)
    for page_id, _, html, _ in rows:
        b = (html or "").encode()
        d = hashlib.sha256(b).hexdigest()
        f = firsts.get(d)
        revisit = f is not None and (page_id != f or first.get(d))
        if page_id == f:
            first[d] = True
        out.append((page_id, len(b), d, "revisit" if revisit else "response", f if revisit else None))
    return sorted(out, key=str)


def files(path):
    return {n: hashlib.sha256(open(f"{path}/{n}", "rb").read()).hexdigest() for n in os.listdir(path) if n.endswith(".warc.gz")}


def test_round_trip(spark, tmp_path):
    a, b = str(tmp_path / "a"), str(tmp_path / "b")
    manifest = warc.write(frame(spark), a, shard_bytes=2000, roll_bytes=700)
    rows = warc.read(spark, a).collect()
    assert sorted((tuple(r[k] for k in ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")) for r in rows), key=str) == brute(ROWS)
    html = {(r.page_id, r.payload_digest): r.html for r in rows if r.record_type == "response"}
    for page_id, _, text, _ in ROWS:
        d = hashlib.sha256((text or "").encode()).hexdigest()
        if (page_id, d) in html:
            assert html[page_id, d] == (text or "")
    assert manifest.agg({"records": "sum"}).first()[0] == len(ROWS)
    assert {r.final: r.sha256 for r in manifest.collect()} == files(a)
    assert not [n for n in os.listdir(a) if n.startswith("_temporary")]
    warc.write(frame(spark, ROWS[::-1]).repartition(5), b, shard_bytes=2000, roll_bytes=700)
    assert files(a) == files(b) and len(files(a)) > 3


@pytest.mark.parametrize("ids", [[*range(1, 400), 10**15], [None] * 400, [-(2**63), *([5] * 398), 2**63 - 1]])
def test_shards_are_even(spark, tmp_path, ids):
    rows = [(p, "u", f"<p>{k}</p>" + "x" * (900 + k % 7), "") for k, p in enumerate(ids)]
    a, b = str(tmp_path / "a"), str(tmp_path / "b")
    manifest = warc.write(frame(spark, rows), a, shard_bytes=20 * 1400, roll_bytes=1 << 20)
    sizes = [r["n"] for r in manifest.groupBy("shard").agg(F.sum("records").alias("n")).collect()]
    assert sum(sizes) == 400 and len(sizes) >= 20 and max(sizes) <= 22
    assert sorted(r.payload_digest for r in warc.read(spark, a).collect()) == sorted(hashlib.sha256(r[2].encode()).hexdigest() for r in rows)
    warc.write(frame(spark, rows[::-1]).repartition(7), b, shard_bytes=20 * 1400, roll_bytes=1 << 20)
    assert files(a) == files(b) and not os.path.exists(f"{a}/_temporary")


def test_shard_names_by_scheme():
    path = warc._open("file:///tmp/x")[1]
    assert path == warc._open("/tmp/x")[1] == "/tmp/x"


def test_empty(spark, tmp_path):
    warc.write(frame(spark).limit(0), str(tmp_path / "e"))
    assert warc.read(spark, str(tmp_path / "e")).count() == 0


def test_damage():
    record = warc.record_bytes(1, "u", b"payload", hashlib.sha256(b"payload").hexdigest(), None, False, "d")
    assert warc.parse(record)[6] == "payload"
    with pytest.raises(ValueError):
        warc.parse(record.replace(b"payload\r", b"paxload\r"))
