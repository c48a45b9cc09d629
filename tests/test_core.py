"""Fixed cases of functions, sources and operators."""

import hashlib
import json
import math
import random
import struct

import pytest
from pyspark.sql import functions as F

from ledgerlens.functions import text as t
from ledgerlens.functions import timeline
from ledgerlens.operators import dedup, draft, quality, readiness, reconcile, relational, sequence
from ledgerlens.plans import scalars
from ledgerlens.sources import journal, probe, wave
from ledgerlens.streaming import heartbeat

GOLDEN = [-32768, -1, 0, 1, 32767, 1, -1, 0, -32768, 32767]


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(f(F.col("v"))).first()[0]


@pytest.mark.parametrize(
    "f,value,want",
    [
        (t.safe_name, "  My Clip (1).mp4 ", "my-clip-1-mp4"), (t.safe_name, "***", "recording"), (t.safe_name, None, "recording"), (t.safe_name, "a" * 60, "a" * 48), (t.safe_name, "a" * 47 + "-b" * 5, "a" * 47 + "-b"),
        (t.file_stem, "C:\\x\\a.b.mp4", "a.b"), (t.file_stem, "/x/.hidden", ".hidden"), (t.file_stem, "plain", "plain"),
        (t.short_id, "0123-4567-89ab-cdef", "0123456789ab"),
        (t.is_sha256, "a" * 64, True), (t.is_sha256, "a" * 64 + "\n", False), (t.is_sha256, "A" * 64, False), (t.is_sha256, None, False),
        (t.canonical_integer, "-12", "-12"), (t.canonical_integer, "+1", None), (t.canonical_integer, "007", None), (t.canonical_integer, "0", "0"),
        (t.relative_path, "a\\b//c", "a/b/c"), (t.relative_path, "/a", None), (t.relative_path, "a/../b", None), (t.relative_path, "a/b.", None), (t.relative_path, "C:/a", None),
        (lambda c: t.path_under(c, "Media"), "media/x", "Media/x"), (lambda c: t.path_under(c, "Media"), "other/x", None),
        (t.sanitized_error, " a\x00b\x85 ", "a b"), (t.sanitized_error, " \n", None), (t.sanitized_error, "x" * 3000, "x" * 2048),
        (lambda c: t.public_failure(c, "failed"), "see file:x", "failed"), (lambda c: t.public_failure(c, "failed"), "plain", "plain"), (lambda c: t.public_failure(c, "failed"), "{raw}", "failed"),
        (t.group_name_ok, "Unassigned", False), (t.group_name_ok, "Group 1", True), (t.group_name_ok, " x", False),
        (lambda c: t.version_matches(c, "8.1"), "8.1-static", True), (lambda c: t.version_matches(c, "8.1"), "8.12", False), (lambda c: t.version_matches(c, "8.1"), "8.1", True),
        (lambda c: t.csv_has(c, "mp4"), "mov, MP4 ,m4a", True), (lambda c: t.csv_has(c, "mp4"), "mov", False),
        (timeline.seconds_to_us, "1.25", 1_250_000), (timeline.seconds_to_us, "0.0000005", 1), (timeline.seconds_to_us, "0", None), (timeline.seconds_to_us, "x", None),
    ],
)
def test_text(spark, f, value, want):
    assert one(spark, value, f) == want


def test_numbers(spark):
    assert one(spark, 10, timeline.samples_to_us, "long") == 625
    assert one(spark, 1536, t.format_bytes, "long") == "1.5 KiB" and one(spark, 1023, t.format_bytes, "long") == "1,023 B"
    assert one(spark, -3_723_004_999, timeline.format_timeline, "long") == "-01:02:03.004"
    assert one(spark, "30000/1001", lambda c: timeline.rational(c)["num"]) == 30000 and one(spark, "1/0", timeline.rational) is None
    assert tuple(one(spark, 1 << 62, lambda c: timeline.reduced(c, F.lit(6 << 40).cast("long")), "long")) == ((1 << 62) // (1 << 41), 3)
    assert one(spark, 1 << 62, lambda c: timeline.mapped_time(c, c, c), "long") == timeline.MAX_LONG
    assert one(spark, "a", lambda c: t.tagged_hash(n=c)) != one(spark, "a", lambda c: t.tagged_hash(m=c))


def chunk(name, body):
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) & 1)


def wav(samples, extra=b"", fmt=(1, 1, 16000, 32000, 2, 16), skew=0):
    body = b"WAVE" + extra + chunk(b"fmt ", struct.pack("<HHIIHH", *fmt)) + chunk(b"data", struct.pack(f"<{len(samples)}h", *samples))
    return b"RIFF" + struct.pack("<I", len(body) + skew) + body


def test_wave_and_facts(spark, tmp_path):
    files = {"golden": wav(GOLDEN), "zeros": wav([0] * 8), "odd": wav([-2, 2, 0, -3, 3], chunk(b"junk", b"abc")), "bad": wav([1], skew=-1), "rate": wav([1], fmt=(1, 1, 8000, 16000, 2, 16))}
    for name, content in files.items():
        (tmp_path / f"{name}.wav").write_bytes(content)
    rows = wave.read(spark, str(tmp_path / "*.wav")).withColumn("name", t.file_stem(F.col("path")))
    assert {r.name for r in rows.where("problem is not null").collect()} == {"bad", "rate"}
    facts = sequence.facts(rows.where("problem is null"), ["name"], ["sample_idx"], "sample")
    got = {r.name: r for r in facts.collect()}
    g = got["golden"]
    assert (g.n, g.duration_us, g.minimum, g.maximum, g.peak, g.positive, g.negative, g.zero, g.full_high, g.full_low, g.crossings, g.total, g.total_squares) == (10, 625, -32768, 32767, 32768, 4, 4, 2, 2, 2, 2, "-2", "4294836230")
    assert (got["zeros"].duration_us, got["zeros"].zero, got["zeros"].total) == (500, 8, "0")
    assert (got["odd"].crossings, got["odd"].total, got["odd"].total_squares) == (2, "0", "26")
    assert sequence.violations(facts).count() == 0
    wrong = facts.withColumn("peak", F.col("peak") + 1).where("name = 'golden'")
    assert {r.rule for r in sequence.violations(wrong).collect()} == {"peak_is_largest_magnitude"}


def document(**change):
    video = {"index": 0, "codec_type": "video", "codec_name": "h264", "width": 1920, "height": 1080, "avg_frame_rate": "30/1", "r_frame_rate": "30/1", "disposition": {"default": 1}}
    audio = {"index": 1, "codec_type": "audio", "codec_name": "aac", "sample_rate": "48000", "channels": 2, "disposition": {"default": 1}}
    doc = {"format": {"format_name": "mov,mp4", "duration": "1.25", "tags": {"major_brand": "isom"}}, "streams": [video | change.get("video", {}), audio | change.get("audio", {})]}
    doc["format"] |= change.get("format", {})
    doc["streams"] = [s for s in doc["streams"] if s["codec_type"] not in change.get("without", ())] + [{**(video if "width" in s else audio), **s} for s in change.get("more", [])]
    return json.dumps(doc)


@pytest.mark.parametrize(
    "doc,want",
    [
        (document(), "Accepted"), ("nope", "ProbeOutputMalformed"), (document(format={"format_name": "mov"}), "UnsupportedContainer"), (document(format={"duration": "0"}), "InvalidDuration"),
        (document(format={"tags": {"major_brand": "qt  "}}), "UnsupportedContainer"), (document(format={"tags": {"major_brand": "3gp4"}}), "UnsupportedContainer"), (document(without=["video"]), "MissingVideoStream"), (document(without=["audio"]), "MissingAudioStream"),
        (document(video={"width": 0}), "InvalidVideoStream"), (document(more=[{"index": 2, "width": 0, "disposition": {"default": 0}}]), "InvalidVideoStream"),
        (document(video={"disposition": {"default": 0}}, more=[{"index": 2, "width": 640, "disposition": {"default": 0}}]), "AmbiguousVideoStreams"),
        (document(audio={"disposition": {"default": 0}}, more=[{"index": 2, "channels": 1, "disposition": {"default": 0}}]), "AmbiguousAudioStreams"), (document(audio={"sample_rate": "0"}), "InvalidAudioStream"), (document(audio={"index": 0}), "ProbeOutputMalformed"),
    ],
)
def test_probe(spark, doc, want):
    assert one(spark, doc, probe.verdict) == want


def test_logs(spark):
    log = "out_time_us=5\nprogress=continue\nout_time_us=1250000\nprogress=end\n"
    assert one(spark, log, probe.completed_us) == 1_250_000 and one(spark, log[:40], probe.completed_us) is None
    assert tuple(one(spark, "x VFR:0.1 (1/9)\nVFR:0.25 (3/9)", probe.frame_variation)) == (0.25, 3, 9)
    assert tuple(one(spark, "none", probe.frame_variation)) == (None, 0, 0)
    assert one(spark, "Peak level dB: -1.5\nPeak level dB: -inf", lambda c: probe.last_metric(c, "Peak level dB")) == -1.5
    frames = json.dumps({"frames": [{"stream_index": 0, "pts_time": "9"}, {"stream_index": 1, "best_effort_timestamp_time": "0.500000"}]})
    assert one(spark, frames, lambda c: probe.first_time_us(c, F.lit(1))) == 500_000


def test_readiness_order(spark):
    rows = [("a", "IntegrityFailed", False, None), ("a", None, False, None), ("b", None, False, None), ("c", "Validated", True, None), ("c", "Prepared", True, True), ("d", "Prepared", True, True), ("e", "Prepared", True, None), ("f", "ValidationFailed", True, None)]
    df = spark.createDataFrame(rows, "p string, state string, linked boolean, result boolean").withColumns({"seen": F.col("result"), "failed": F.lit(None).cast("boolean")})
    got = {r.p: r.r for r in readiness.rollup(df, ["p"], "state", "linked", "result", "seen", "failed").select("p", readiness.decision().alias("r")).collect()}
    assert got == {"a": "MediaIntegrityFailed", "b": "Draft", "c": "MediaValidated", "d": "AudioObserved", "e": "Inconsistent", "f": "MediaValidationFailed"}


def test_groups_and_reconcile(spark):
    rows = spark.createDataFrame([("x", "g1"), ("x", "g2"), ("y", None), ("z", "g1"), ("x", "g1")], "asset string, grp string")
    assert [(r.asset, r.labels) for r in dedup.conflicts(rows, "asset", "grp").collect()] == [("x", ["g1", "g2"])]
    cases = {(True, True, False): "completed", (True, False, True): "rolled_forward", (False, True, False): "rolled_back", (False, False, True): "cleared", (True, True, True): "warning", (None, None, None): "cleared"}
    df = spark.createDataFrame(list(cases), "c boolean, p boolean, s boolean")
    assert all(r.o == cases[r.c, r.p, r.s] for r in df.withColumn("o", reconcile.outcome(F.col("c"), F.col("p"), F.col("s"))).collect())
    paths = spark.createDataFrame([(1, "C:/a"), (2, "c:/A/b/"), (3, "c:/ab"), (4, "C:/A/"), (5, None)], "k int, p string")
    assert sorted(tuple(r) for r in relational.overlapping_paths(paths, "k", "p").collect()) == [(1, 2), (1, 4), (4, 2)]
    jobs = spark.createDataFrame([(1, None, "e"), (2, "r", None), (3, "r", "e")], "k int, result string, failure string")
    assert sorted(r.k for r in quality.violations(jobs, "k", {"xor": quality.exactly_one(F.col("result"), F.col("failure"))}).collect()) == [3]


def test_heartbeat_stream(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.sql("select 1L as user_id, timestamp'2024-01-01 00:00:00' + make_interval(0,0,0,0,0,m,0) as ts from values (0),(1),(30),(200) as t(m)").write.parquet(src)
    stream = spark.readStream.schema("user_id long, ts timestamp").parquet(src)
    q = heartbeat.sessions(stream).writeStream.outputMode("append").format("memory").queryName("beats").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r.beats for r in spark.table("beats").collect()) == [1, 2]


def test_lookup_fails_on_a_repeated_key(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c")], "k long, v string")
    build = spark.createDataFrame([(1, "x"), (3, "y")], "k long, w string")
    assert sorted((r.v, r.w) for r in relational.looked_up(rows, build, "k").collect()) == [("a", "x"), ("b", None), ("c", None)]
    with pytest.raises(Exception, match="not unique"):
        relational.looked_up(rows, build.union(build), "k").collect()
    assert relational.looked_up(rows.limit(0), build, "k").count() == 0


def test_inserts_and_exists_update(spark):
    old = spark.createDataFrame([(1, 10)], "k long, p long")
    new = spark.createDataFrame([(1, 10), (2, 10), (2, 10), (3, 99), (4, None), (5, 11)], "k long, p long")
    parents = spark.createDataFrame([(10,), (11,)], "p_id long")
    assert sorted(tuple(r) for r in relational.insert_faults(new, old, "k", parents, "p", "p_id").collect()) == [(1, "taken"), (2, "given_twice"), (3, "no_parent")]
    assert sorted(tuple(r) for r in relational.inserted(new, old, "k", parents, "p", "p_id").collect()) == [(1, 10), (4, None), (5, 11)]
    rows = spark.createDataFrame([(1, "f", None), (2, "f", None), (3, None, "g"), (4, None, "g")], "k long, failure string, new string")
    after, n = relational.exists_update(rows, spark.createDataFrame([(1,), (1,), (3,)], "k long"), "k", "failure", F.col("new"))
    assert sorted((r.k, r.failure) for r in after.collect()) == [(1, None), (2, "f"), (3, None), (4, "g")] and n.first().affected == 2


def test_chunked_facts_equal_whole_ones(spark):
    values = [3, -1, 0, -2, None, 5, -5, 5, 0, 0, 7, -32768, 32767, None, None, 1]
    df = spark.createDataFrame([(k % 2, k, v) for k, v in enumerate(values * 2)], "g long, k long, x int")
    whole = sorted(tuple(r) for r in sequence.facts(df, ["g"], ["k"], "x").collect())
    for size in (1, 3, 7):
        assert sorted(tuple(r) for r in sequence.facts(df, ["g"], ["k"], "x", chunk=F.floor(F.col("k") / size)).collect()) == whole
    assert sequence.facts(df.limit(0), ["g"], ["k"], "x").count() == 0


def test_first_seen_labels_of_repeats(spark):
    df = spark.createDataFrame([("a", 3, "x"), ("a", 1, "y"), ("a", 2, "x"), ("a", 4, " "), ("b", 1, None)], "k string, o long, l string")
    assert {r.k: r.labels for r in dedup.first_seen_labels(df, "k", "l", ["o"], "none").collect()} == {"a": ["y", "x", "none"], "b": ["none"]}


def test_record_texts(spark):
    df = spark.createDataFrame([("/data/x",), ("/",), ("C:\\",), ("C:\\w",), ("\\\\host\\share\\",), ("rel/x",), (" ",), (None,)], "c string")
    assert [r[0] for r in df.select(t.workspace_problem(F.col("c"))).collect()] == [None, "a root", "a root", None, "a root", "not absolute", "select a folder", "select a folder"]
    banner = "tool version 7.1 Copyright\nbuilt with gcc 13\nconfiguration: --a --b\n"
    row = spark.createDataFrame([(banner, "a\U0001F600")], "b string, e string")
    assert row.select(t.banner_value(F.col("b"), "built with"), t.banner_value(F.col("b"), "nothing")).first() == ("gcc 13", None)
    assert row.select(t.tagged_hash(e=F.col("e"))).first()[0] == hashlib.sha256("e=3:a\U0001F600\n".encode()).hexdigest()
    low = spark.createDataFrame([(-(1 << 63),)], "us long")
    assert low.select(timeline.format_timeline(F.col("us"))).first()[0] == "-2562047788:00:54.775"


def test_draft_issues_on_empty_tables(spark):
    drafts = spark.createDataFrame([(1, "n", "/w/x", None, "m.vwpkg"), (2, None, "/w/y", " ", None)], "draft long, name string, workspace string, staging string, package string")
    items = spark.createDataFrame([], "draft long, item long, path string, archived boolean, found boolean, grp string")
    groups = spark.createDataFrame([], "draft long, grp_item long, grp string, grp_name string")
    assert sorted((r.draft, r.code) for r in draft.issues(drafts, items, groups).collect()) == [(2, "Input.Required"), (2, "ProfileName.Required")]


def _histories(spark):
    r = random.Random(5)
    rows = [(r.choice(["a", "a", "b", None]), None if r.random() < 0.05 else r.randrange(90), k, r.choice([None, 1, 2, 3, 4])) for k in range(300)]
    rows.append(("one", 5, 300, None))
    return rows, spark.createDataFrame([(*x, "clash") for x in rows], "job string, at int, id int, size int, previous string")


@pytest.mark.parametrize("width", [None, 1, 7, 50])
def test_histories_in_chunks(spark, width):
    rows, df = _histories(spark)
    chunk = None if width is None else F.floor(F.col("at") / width)
    falls, progress = [], []
    for job in {x[0] for x in rows}:
        own, total = sorted((x for x in rows if x[0] == job), key=lambda x: (-1 if x[1] is None else x[1], x[2])), None
        for k, x in enumerate(own):
            if k and x[3] is not None and own[k - 1][3] is not None and x[3] < own[k - 1][3]:
                falls.append((x[2], str(own[k - 1][3])))
            total = total if x[3] is None else (total or 0) + x[3]
            progress.append((x[2], k + 1, len(own), total))
    got = relational.regressions(df, ["job"], ["at", "id"], "size", chunk)
    assert sorted((x.id, str(x.previous)) for x in got.collect()) == sorted(falls)
    got = relational.running_progress(df, ["job"], ["at", "id"], "size", chunk)
    assert sorted((x.id, x.done, x.total, x.cumulative) for x in got.collect()) == sorted(progress)
    assert relational.regressions(df.limit(0), ["job"], ["at", "id"], "size", chunk).count() == 0
    assert relational.running_progress(df.limit(0), ["job"], ["at", "id"], "size", chunk).count() == 0


def test_after_terminal_of_null_jobs(spark):
    rows, df = _histories(spark)
    place = lambda x: (-1 if x[1] is None else x[1], x[2])
    want = [x[2] for x in rows if any(y[0] == x[0] and y[3] in (3, 4) and place(y) < place(x) for y in rows)]
    got = quality.after_terminal(df, "job", ["at", "id"], "size", (3, 4))
    assert got.columns == df.columns and sorted(x.id for x in got.collect()) == sorted(want)


def test_journals(spark, tmp_path):
    files = {"a/one.json": '{"state": "moved", "n": 3, "more": [1]}', "a/two.json": '{"state": "moved"', "b/one.json": " ", "b/none.json": "", "b/two.json": '{"n": "three"}', "b/three.json": "[1]", "c/one.json": '\n{"n": null}\n', "c/note.txt": "{}"}
    for name, text in files.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text)
    rows = journal.journals(spark, f"file://{tmp_path}", "state string, n long").collect()
    got = {x.job + "/" + x.path.split("/")[-1]: x for x in rows}
    assert set(got) == {x for x in files if x.endswith("json") and files[x]}
    assert sorted(k for k, x in got.items() if x.readable) == ["a/one.json", "c/one.json"]
    assert tuple(got["a/one.json"].document) == ("moved", 3) and tuple(got["c/one.json"].document) == (None, None)
    assert all((x.document is None) != x.readable for x in rows)
    (tmp_path / "empty").mkdir()
    assert journal.journals(spark, f"file://{tmp_path}/empty", "n long").count() == 0


def test_documents_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, "é\n", None), (None, "", 2)], "order_key long, name string, last_seen_us long")
    journal.write_documents(df, f"file://{tmp_path}/out")
    lines = sorted(x.value for x in spark.read.text(f"file://{tmp_path}/out").collect())
    assert [json.loads(x) for x in lines] == [{"orderKey": 1, "name": "é\n", "lastSeenUs": None}, {"orderKey": None, "name": "", "lastSeenUs": 2}]


def test_active_rows(spark):
    df = spark.createDataFrame([(1, True, 1), (2, False, 1), (3, None, 1), (4, None, None), (5, True, None)], "id int, archived boolean, asset int")
    assert [sorted(x.id for x in relational.active(df, "archived", "asset", k).collect()) for k in (True, False)] == [[2, 3], [4]]


def test_fractions_are_reduced_once_and_whole(spark, tmp_path):
    fib = [1, 1]
    while fib[-1] + fib[-2] < 1 << 63:
        fib.append(fib[-1] + fib[-2])  # neighbours take the most steps
    pairs = [p for a, b in zip(fib, fib[1:]) for p in ((a, b), (b, a), (-a, b))] + [(6, 4), (0, 5), (5, 0), ((1 << 63) - 1, 7), ((1 << 63) - 1, (1 << 63) - 1), (1, (1 << 63) - 1), (1 << 62, 6 << 40)]
    df = spark.createDataFrame([*pairs, (None, 5), (5, None), (None, None), (0, None)], "a long, b long")
    got = df.select("a", "b", timeline.reduced(F.col("a"), F.col("b")).alias("r"), timeline.greatest_divisor(F.col("a"), F.col("b")).alias("g")).collect()
    known = [r for r in got if r.a is not None and r.b is not None]
    assert len(known) == len(pairs) and all(r.g == math.gcd(r.a, r.b) and (r.r.num * r.g, r.r.den * r.g) == (r.a, r.b) for r in known)
    assert all((r.r.num, r.r.den, r.g) == (None, None, None) for r in got if r.a is None or r.b is None)
    spark.createDataFrame([(6, 4), (6, 4), (9, 3), (0, 3), (None, 3)], "l_orderkey long, l_partkey long").write.parquet(str(tmp_path / "lineitem.parquet"))
    query = scalars.rational_reduced(spark, str(tmp_path))
    assert sorted(map(tuple, query.collect())) == [(6, 4, 3, 2), (9, 3, 3, 1)]
    assert query._jdf.queryExecution().optimizedPlan().toString().count("aggregate(") == 1
