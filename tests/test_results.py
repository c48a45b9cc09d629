import json

from pyspark.sql import functions as F

from ledgerlens.operators import ordering, quality, results
from ledgerlens.plans import results as plans
from ledgerlens.sources import probe


def row(fields, **other):
    value = {c: "ok" for c in fields.texts + fields.optional} | {c: "0a" * 32 for c in fields.hashes} | {c: 1 for c in fields.positive + fields.not_negative} | {c: True for c in fields.true} | {c: "NotAssessed" for c in fields.left_open} | {c: 5 for c in fields.required}
    return value | other


def schema(fields):
    kinds = [("string", fields.texts + fields.optional + fields.hashes + fields.left_open), ("long", fields.positive + fields.not_negative + fields.required), ("boolean", fields.true)]
    return {c: kind for kind, names in kinds for c in names}


def broken(spark, fields, *rows):
    names = schema(fields)
    df = spark.createDataFrame([(i, *[r[c] for c in names]) for i, r in enumerate(rows)], "id long, " + ", ".join(f"{c} {k}" for c, k in names.items()))
    return sorted((r.id, r.rule) for r in quality.violations(df, "id", fields.rules()).collect())


def test_every_field(spark):
    for fields in (results.VALIDATION, results.PREPROCESSING, results.SNAPSHOT):
        good = row(fields)
        needed = [c for c in schema(fields) if c not in fields.optional]
        rows = [good] + [row(fields, **{c: None}) for c in needed] + [row(fields, **{c: None}) for c in fields.optional]
        found = broken(spark, fields, *rows)
        assert [(i, rule.split(":")[1]) for i, rule in found] == [(i + 1, c) for i, c in enumerate(needed)]
    assert len(results.VALIDATION.hashes) == 5 and len(results.PREPROCESSING.hashes) == 9 and len(results.PREPROCESSING.positive) == 19


def test_prepared_and_snapshots(spark):
    path = "Media/a/b/original.mp4"
    at = "Media/a/b/Prepared/v1_0a0a0a0a0a0a"
    made = {c: f"{at}/{leaf}" for c, leaf in results.ARTIFACTS.items()}
    assets = spark.createDataFrame([(1, "s", 9, path), (2, "s", 9, "Media/original.mp4"), (3, None, None, None)], "media_asset_id long, sha256 string, byte_length long, path string")
    names = ["media_asset_id", "source_sha256", "source_bytes", "preprocessing_contract_sha256", *made]
    rows = [(1, "s", 9, "0a" * 32, *made.values()), (1, "S", 8, "0a" * 32, *list(made.values())[:3], None), (4, "s", 9, "0a" * 32, *made.values()), (None, "s", 9, "0a" * 32, *made.values())]
    df = spark.createDataFrame(rows, "media_asset_id long, source_sha256 string, source_bytes long, preprocessing_contract_sha256 string, " + ", ".join(f"{c} string" for c in made))
    assert df.columns == names
    found = sorted((str(r.media_asset_id), r.rule) for r in results.of_asset(df, assets).collect())
    assert found == [("1", "differs:source_bytes"), ("1", "differs:source_sha256"), ("1", "path:manifest_path"), ("4", "unknown_asset"), ("None", "unknown_asset")]
    other = results.of_asset(df.limit(1).selectExpr("2L as media_asset_id", *names[1:]), assets)
    assert {r.rule for r in other.collect()} == {"path:source", *(f"path:{c}" for c in made)}
    assert results.of_asset(df.limit(0), assets).count() == 0

    frozen = spark.createDataFrame([(1, "h", 1, 2, 3, 4, None, "c"), (2, "h", 1, 2, 3, 4, 5, "c")], "media_asset_id long, " + ", ".join(f"{c} {'string' if c.endswith('sha256') else 'long'}" for c in results.FROZEN))
    taken = frozen.selectExpr("media_asset_id * 10 as job_id", "*").unionByName(frozen.limit(1).selectExpr("7L as job_id", "99L as media_asset_id", *results.FROZEN))
    assert [(r.job_id, r.rule) for r in results.of_prepared(taken, frozen).collect()] == [(7, "unknown_result")]
    late = taken.where("job_id = 20").selectExpr("job_id", "media_asset_id", *[f"if('{c}' in ('analysis_audio_bytes'), null, {c}) as {c}" for c in results.FROZEN])
    assert [r.rule for r in results.of_prepared(late, frozen).collect()] == ["differs:analysis_audio_bytes"]


NAMES = ["Zebra", "éclair", "Eclair", "apple", "Äpfel", "ÉCLAIR", "zebra", "b c", "bc", None, "Apple"]


def test_orders(spark):
    df = spark.createDataFrame([(i, n, "x") for i, n in enumerate(NAMES)], "k long, name string, __n string")
    got = [r.name for r in ordering.ordered(df, ["name"], last=["k"]).collect()]
    assert got == [None, "Äpfel", "apple", "Apple", "b c", "bc", "Eclair", "éclair", "ÉCLAIR", "Zebra", "zebra"]
    assert [r.name for r in ordering.ordered(df, ["name"], ordering.BINARY).collect()] == [None, *sorted(n for n in NAMES if n)]
    places = {r.name: r.place for r in ordering.numbered(df.na.drop(), [], ["name"], ["k"], "place").collect()}
    assert places["Äpfel"] == 1 and places["zebra"] == 10
    same = lambda collation: sorted(r.k for r in ordering.repeated(df.drop("__n"), "name", collation).collect())
    assert same(ordering.BINARY) == [] and same(ordering.NOCASE) == [0, 3, 6, 10]
    assert same(ordering.CULTURE) == [0, 1, 3, 5, 6, 10] and same(ordering.LOOSE) == [0, 1, 2, 3, 5, 6, 10]
    other = spark.createDataFrame([("ECLAIR",), (None,), ("bC",)], "o string")
    pairs = lambda collation: sorted((r.name, r.o) for r in ordering.matched(df, other, "name", "o", collation).collect())
    assert pairs(ordering.BINARY) == [] and pairs(ordering.NOCASE) == [("Eclair", "ECLAIR"), ("bc", "bC")]
    assert len(pairs(ordering.LOOSE)) == 4


def test_profile_faults(spark):
    profiles = spark.createDataFrame([(1, "n", "w", "Draft"), (2, " ", None, "Draft"), (None, "n", "w", "r")], "profile long, display_name string, workspace_root string, readiness string")
    groups = spark.createDataFrame([(1, 7, "G"), (1, 8, "g"), (2, 7, "Unassigned"), (2, None, "x"), (2, None, "y")], "profile long, grp long, name string")
    videos = spark.createDataFrame([(1, 1, "p", "", "T", 0, 7), (1, 1, "p", "", "T", 0, None), (2, 1, "p", "", "T", 0, 8), (2, None, None, None, "X", -1, None)], "profile long, video long, file_path string, date_label string, condition string, sort_order int, grp long")
    found = sorted((str(r.profile), r.part, str(r.item), r.rule) for r in results.profile_faults(profiles, groups, videos, ("T",)).collect())
    assert found == sorted([
        ("2", "profile", "2", "display_name"), ("2", "profile", "2", "workspace_root"), ("None", "profile", "None", "id"),
        ("1", "group", "7", "unique_name"), ("1", "group", "8", "unique_name"), ("2", "group", "7", "name"), ("2", "group", "None", "id"), ("2", "group", "None", "id"),
        ("1", "video", "1", "unique_id"), ("1", "video", "1", "unique_id"), ("2", "video", "1", "group_of_profile"),
        *[("2", "video", "None", rule) for rule in ("id", "file_path", "date_label", "condition", "sort_order")],
    ])
    assert results.profile_faults(profiles.limit(0), groups.limit(0), videos.limit(0), ("T",)).count() == 0


def test_probe_documents_are_parsed_once(spark, tmp_path):
    spark.createDataFrame([(k, k % 40) for k in range(1, 200)], "o_orderkey long, o_custkey long").write.parquet(str(tmp_path / "orders.parquet"))
    df = plans.stream_selection(spark, str(tmp_path))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json(") == 1 and plan.count("RLIKE(") == 2  # the two rates of a video
    assert df.where("verdict = 'Accepted'").count() > 0


def test_verdict_of_columns(spark):
    video = lambda i, **other: {"index": i, "codec_type": "video", "codec_name": "h264", "width": 64, "height": 64, "avg_frame_rate": "30/1", "disposition": {"default": 1}} | other
    audio = {"index": 9, "codec_type": "audio", "codec_name": "aac", "sample_rate": "48000", "channels": 2}
    rate = lambda avg, real=None: [video(0, avg_frame_rate=avg, r_frame_rate=real), audio]
    lists = [[video(0), audio], [audio], [video(0), video(1), audio], [video(0), video(1, disposition=None), audio], [video(0, disposition={"default": 1, "attached_pic": 1}), audio], [None], [None, video(0), audio], None, [], [video(0), video(0)]]
    lists += [rate("0/0"), rate("0/0", "25/1"), rate("1000/1"), rate("1001/1"), rate(None, "007/2"), rate("1/2\n"), rate(" 1/2"), rate("1/2/3"), rate("1" * 19 + "/1"), rate("9" * 18 + "/" + "9" * 18)]
    docs = [json.dumps({"format": {"format_name": "mp4", "duration": "1"}, "streams": x}) for x in lists] + [None, "", "[]", '{"streams": []}', '{"format": 1}']
    df = spark.createDataFrame(list(enumerate(docs)), "id int, json string")
    kinds = ("video", "audio")
    rows = df.select("id", "json", probe.parsed(F.col("json")).alias("doc"))
    streams = F.col("doc")["streams"]
    rows = rows.select("*", *[probe.real(streams, k).alias(f"{k}s") for k in kinds]).select("*", *[probe.selected(streams, k, F.col(f"{k}s")).alias(k) for k in kinds])
    rows = rows.select("id", probe.verdict(F.col("json"), F.col("doc"), F.col("video"), F.col("audio")).alias("verdict"), "video.problem", "video.stream.index").orderBy("id").collect()
    assert [r.verdict for r in rows] == [r.verdict for r in df.select("id", probe.verdict(F.col("json")).alias("verdict")).orderBy("id").collect()]
    bad, missing, malformed = "InvalidVideoStream", "MissingVideoStream", "ProbeOutputMalformed"
    assert [r.verdict for r in rows] == ["Accepted", missing, "AmbiguousVideoStreams", "Accepted", missing, malformed, malformed, malformed, missing, malformed, bad, "Accepted", "Accepted", bad, "Accepted", bad, bad, bad, bad, "Accepted", *[malformed] * 5]
    assert [r["index"] for r in rows[:4]] == [0, None, None, 0] and rows[7].problem == "AmbiguousVideoStreams"
