"""Stored results with every field, documents of a probe with their streams, and orders by collation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlens.operators import draft, ordering, quality, results
from ledgerlens.plans.registry import Registry, table
from ledgerlens.sources import probe

R = Registry()
QUERIES, ORACLE_SQL = R.queries, R.sql

_HEX = "concat(md5(CAST(o_orderkey AS STRING)), md5(CAST(o_custkey AS STRING)))"


def _columns(fields: results.Fields) -> tuple[dict[str, str], dict[str, str]]:
    """SQL of a value for each field, and of when its rule is broken: each has a divisor of its own, which breaks it."""
    values, broken = {}, {}
    kinds = [("text", fields.texts + fields.optional), ("hash", fields.hashes), ("positive", fields.positive), ("not_negative", fields.not_negative), ("true", fields.true), ("open", fields.left_open), ("required", fields.required)]
    d = 40
    for kind, names in kinds:
        for c in names:
            d += 1
            k = f"o_orderkey % {d}"
            values[c] = {
                "text": f"CASE WHEN {k} = 0 THEN '  ' WHEN {k} = 1 THEN NULL WHEN {k} = 2 THEN repeat('x', 4097) ELSE o_orderpriority END",
                "hash": f"CASE WHEN {k} = 0 THEN upper({_HEX}) WHEN {k} = 1 THEN NULL WHEN {k} = 2 THEN substr({_HEX}, 2) ELSE {_HEX} END",
                "positive": f"CASE WHEN {k} = 0 THEN 0 WHEN {k} = 1 THEN NULL WHEN {k} = 2 THEN -1 ELSE o_custkey END",
                "not_negative": f"CASE WHEN {k} = 0 THEN -1 WHEN {k} = 1 THEN NULL ELSE {k} - 2 END",
                "true": f"CASE WHEN {k} = 0 THEN false WHEN {k} > 1 THEN true END",
                "open": f"CASE WHEN {k} = 0 THEN 'Good' WHEN {k} > 1 THEN 'NotAssessed' END",
                "required": f"CASE WHEN {k} > 1 THEN o_orderkey END",
            }[kind]
            bad = {"text": f"{k} < 3", "hash": f"({k} < 3 AND NOT ({k} = 0 AND upper({_HEX}) = {_HEX}))", "positive": f"({k} < 3 OR o_custkey <= 0)", "not_negative": f"{k} < 2", "true": f"{k} < 2", "open": f"{k} < 2", "required": f"{k} < 2"}[kind]
            if c in fields.optional:
                bad = f"{k} IN (0, 2)"
            broken[f"{kind}:{c}"] = bad
    return values, broken


def _query(fields: results.Fields) -> str:
    return " UNION ALL ".join(f"SELECT o_orderkey AS id, '{rule}' AS rule FROM orders WHERE {bad}" for rule, bad in _columns(fields)[1].items())


def _violations(spark, sf_dir, fields):
    rows = table(spark, sf_dir, "orders").selectExpr("o_orderkey AS id", *[f"{e} AS {c}" for c, e in _columns(fields)[0].items()])
    return quality.violations(rows, "id", fields.rules())


@R.query(_query(results.VALIDATION))
def whole_validation_result(spark, sf_dir):
    return _violations(spark, sf_dir, results.VALIDATION)


@R.query(_query(results.PREPROCESSING))
def whole_preprocessing_result(spark, sf_dir):
    return _violations(spark, sf_dir, results.PREPROCESSING)


@R.query(_query(results.SNAPSHOT))
def whole_snapshot(spark, sf_dir):
    return _violations(spark, sf_dir, results.SNAPSHOT)


_DIR = "'Media/a' || o_custkey"
_PREPARED = f"{_DIR} || '/Prepared/v1_' || substr(md5(CAST(o_orderkey AS VARCHAR)), 1, 12) || '/'"


@R.query("SELECT o_orderkey AS id, rule FROM (" + " UNION ALL ".join([
    "SELECT o_orderkey, o_orderkey % 13 = 0 AS gone, 'unknown_asset' AS rule, o_orderkey % 13 = 0 AS bad FROM orders",
    "SELECT o_orderkey, o_orderkey % 13 = 0, 'differs:source_sha256', o_orderkey % 7 = 0 FROM orders",
    "SELECT o_orderkey, o_orderkey % 13 = 0, 'differs:source_bytes', o_orderkey % 11 = 0 FROM orders",
    "SELECT o_orderkey, o_orderkey % 13 = 0, 'path:source', o_orderkey % 17 = 0 OR o_orderkey % 19 = 0 FROM orders",
    *[f"SELECT o_orderkey, o_orderkey % 13 = 0, 'path:{c}', o_orderkey % {d} = 0 OR o_orderkey % 17 = 0 OR o_orderkey % 19 = 0 FROM orders" for c, d in zip(results.ARTIFACTS, (23, 29, 31, 37))],
]) + ") WHERE bad AND (rule = 'unknown_asset' OR NOT gone)")
def result_of_asset(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("media_asset_id"), "o_custkey")
    key = F.col("media_asset_id")
    contract = F.md5(key.cast("string"))
    folder = F.concat(F.lit("Media/a"), F.col("o_custkey").cast("string"))
    source = F.when(key % 17 == 0, "Media/original.mp4").when(key % 19 == 0, F.concat(folder, F.lit("//original.mp4"))).otherwise(F.concat(folder, F.lit("/original.mp4")))
    assets = orders.where("media_asset_id % 13 > 0").select("media_asset_id", F.md5(F.col("o_custkey").cast("string")).alias("sha256"), (F.col("o_custkey") * 7).alias("byte_length"), source.alias("path"))
    made = {c: F.when(key % d == 0, F.concat(folder, F.lit("/Prepared/"), F.lit(leaf))).otherwise(F.concat(folder, F.lit("/Prepared/v1_"), F.substring(contract, 1, 12), F.lit("/"), F.lit(leaf))) for (c, leaf), d in zip(results.ARTIFACTS.items(), (23, 29, 31, 37))}
    sha = F.when(key % 7 == 0, F.upper(F.md5(F.concat(F.lit("x"), F.col("o_custkey").cast("string"))))).otherwise(F.md5(F.col("o_custkey").cast("string")))
    prepared = orders.select("media_asset_id", contract.alias("preprocessing_contract_sha256"), sha.alias("source_sha256"), (F.col("o_custkey") * 7 + F.when(key % 11 == 0, 1).otherwise(0)).alias("source_bytes"), *[v.alias(c) for c, v in made.items()])
    return results.of_asset(prepared, assets).withColumnRenamed("media_asset_id", "id")


@R.query("SELECT l_orderkey AS job_id, o_orderkey IS NULL AS unknown, count(*) AS n FROM lineitem LEFT JOIN (SELECT * FROM orders WHERE o_orderkey % 9 > 0) ON o_orderkey = l_orderkey, (VALUES (1), (2), (3), (4), (5), (6), (7)) v(f) WHERE CASE WHEN o_orderkey IS NULL THEN f = 1 ELSE f = l_linenumber AND l_partkey % 5 = 0 END GROUP BY 1, 2")
def snapshot_join(spark, sf_dir):
    """Line n of an order differs from the order's prepared result in field n where its part says so."""
    base = lambda key: {c: F.md5(F.concat(key.cast("string"), F.lit(c))) if c.endswith("sha256") else key + i for i, c in enumerate(results.FROZEN)}
    prepared = table(spark, sf_dir, "orders").where("o_orderkey % 9 > 0").select(F.col("o_orderkey").alias("media_asset_id"), *[v.alias(c) for c, v in base(F.col("o_orderkey")).items()])
    off = lambda i: (F.col("l_linenumber") == i + 1) & (F.col("l_partkey") % 5 == 0)
    other = lambda v, c: F.upper(F.concat(v, F.lit("x"))) if c.endswith("sha256") else -v - 1
    snapshots = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("job_id"), F.col("l_orderkey").alias("media_asset_id"), *[F.when(off(i), other(v, c)).otherwise(v).alias(c) for i, (c, v) in enumerate(base(F.col("l_orderkey")).items())])
    found = results.of_prepared(snapshots, prepared)
    return found.groupBy("job_id", (F.col("rule") == "unknown_result").alias("unknown")).agg(F.count("*").alias("n"))


@R.query("""WITH d AS (SELECT o_orderkey AS k, o_custkey AS c, o_orderkey % 4 AS nv, o_custkey % 3 AS na, (o_orderkey % 3 = 0)::INT AS v1, (o_orderkey % 5 = 0)::INT AS v2, (o_custkey % 2 = 0)::INT AS a1, (o_orderkey % 7 = 0)::INT AS a2 FROM orders),
    p AS (SELECT *, CASE WHEN nv = 0 THEN 'MissingVideoStream' WHEN k % 11 < 3 THEN 'InvalidVideoStream' WHEN nv > 1 AND v1 + v2 <> 1 THEN 'AmbiguousVideoStreams' END AS video,
          CASE WHEN na = 0 THEN 'MissingAudioStream' WHEN c % 13 < 2 THEN 'InvalidAudioStream' WHEN na > 1 AND a1 + a2 <> 1 THEN 'AmbiguousAudioStreams' END AS audio FROM d)
    SELECT k AS o_orderkey, CASE WHEN k % 29 = 0 THEN 'ProbeOutputMalformed' WHEN k % 31 = 0 THEN 'UnsupportedContainer' WHEN k % 37 = 0 THEN 'InvalidDuration' ELSE coalesce(video, audio, 'Accepted') END AS verdict,
           CASE WHEN k % 29 > 0 AND video IS NULL THEN CASE WHEN nv > 1 AND v2 = 1 THEN 3 ELSE 1 END END AS video_index, CASE WHEN k % 29 > 0 AND audio IS NULL THEN CASE WHEN na > 1 AND a2 = 1 THEN 22050 ELSE 48000 END END AS audio_rate FROM p""")
def stream_selection(spark, sf_dir):
    """Documents of a probe with a cover picture, up to two videos and two audio streams, each kind of failure in some."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    text = lambda v: v.cast("string")
    flag = lambda cond: F.when(cond, "1").otherwise("0")
    video = lambda i, default: F.concat(F.lit(f'{{"index":{i},"codec_type":"video","codec_name":"h264","width":'), F.when(k % 11 == 0, "0").when(k % 11 == 1, "32769").otherwise("640"), F.lit(',"height":360,"avg_frame_rate":"'), F.when(k % 11 == 2, "0/0").otherwise("30000/1001"), F.lit('","r_frame_rate":"0/0","disposition":{"default":'), default, F.lit("}}"))
    audio = lambda i, rate, default: F.concat(F.lit(f'{{"index":{i},"codec_type":"audio","codec_name":"aac","sample_rate":"'), F.when(c % 13 == 0, "0").otherwise(rate), F.lit('","channels":'), F.when(c % 13 == 1, "65").otherwise("2"), F.lit(',"disposition":{"default":'), default, F.lit("}}"))
    cover = F.lit('{"index":0,"codec_type":"video","codec_name":"png","width":0,"height":0,"disposition":{"default":1,"attached_pic":1}}')
    nv, na = k % 4, c % 3
    streams = F.array_compact(F.array(cover, F.when(nv > 0, video(1, flag(k % 3 == 0))), F.when(nv > 1, video(3, flag(k % 5 == 0))), F.when(na > 0, audio(5, "48000", flag(c % 2 == 0))), F.when(na > 1, audio(7, "22050", flag(k % 7 == 0)))))
    # a document is malformed where it has no streams, an index twice, or none
    listed = F.when(k % 58 == 0, F.lit("")).when(k % 29 == 0, F.concat(F.lit(',"streams":['), cover, F.lit(","), cover, F.lit("]"))).otherwise(F.concat(F.lit(',"streams":['), F.array_join(streams, ","), F.lit("]")))
    form = F.concat(F.lit('{"format":{"format_name":"'), F.when(k % 31 == 0, "matroska").otherwise("mov,mp4,m4a"), F.lit('","duration":"'), F.when(k % 37 == 0, "nan").otherwise(F.concat(text(c), F.lit(".5"))), F.lit('"}'), listed, F.lit("}"))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", form.alias("json"))
    # a select for each step: what a later one uses more than once is evaluated once a row
    rows = rows.select("o_orderkey", "json", probe.parsed(F.col("json")).alias("doc"))
    doc, streams = F.col("doc"), F.col("doc")["streams"]
    rows = rows.select("o_orderkey", "json", "doc", *[probe.real(streams, kind).alias(f"{kind}s") for kind in ("video", "audio")])
    rows = rows.select("o_orderkey", "json", "doc", *[probe.selected(streams, kind, F.col(f"{kind}s")).alias(kind) for kind in ("video", "audio")])
    sound = F.col("o_orderkey") % 29 > 0
    chosen = lambda kind: F.when(sound, F.col(kind)["stream"])
    return rows.select("o_orderkey", probe.verdict(F.col("json"), doc, F.col("video"), F.col("audio")).alias("verdict"), chosen("video")["index"].alias("video_index"), chosen("audio")["sample_rate"].cast("int").alias("audio_rate"))


@R.query("SELECT p_partkey, row_number() OVER (PARTITION BY p_size ORDER BY lower(p_name), p_partkey) AS place FROM part")
def culture_order(spark, sf_dir):
    name = F.when(F.col("p_partkey") % 2 == 0, F.initcap("p_name")).otherwise(F.col("p_name"))
    rows = table(spark, sf_dir, "part").select("p_partkey", "p_size", name.alias("name"))
    return ordering.numbered(rows, ["p_size"], ["name"], ["p_partkey"], "place").select("p_partkey", F.col("place").cast("long").alias("place"))


@R.query("WITH p AS (SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN upper(p_brand || p_type) ELSE p_brand || p_type END || p_size AS t FROM part) SELECT p_partkey FROM (SELECT p_partkey, count(*) OVER (PARTITION BY lower(t)) AS n FROM p) WHERE n > 1")
def collated_repeats(spark, sf_dir):
    both = F.concat("p_brand", "p_type")
    rows = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.when(F.col("p_partkey") % 2 == 0, F.upper(both)).otherwise(both), F.col("p_size").cast("string")).alias("t"))
    return ordering.repeated(rows, "t", ordering.NOCASE).select("p_partkey")


_PATH = "CASE WHEN c_custkey % 17 = 0 THEN '/v/n' || chr(0) || '.mp4' WHEN c_custkey % 5 = 0 THEN '/v/./n' || c_nationkey || '.MP4' WHEN c_custkey % 5 = 1 THEN '/v/x/../n' || c_nationkey || '.mp4' WHEN c_custkey % 5 = 2 THEN '/../v//n' || c_nationkey || '.mp4' ELSE '/v/n' || c_nationkey || '.mp4' END"


@R.query("""WITH i AS (SELECT c_custkey % 400 AS draft, c_custkey AS item, c_nationkey AS n, c_custkey % 17 = 0 AS bad FROM customer), r AS (SELECT *, row_number() OVER (PARTITION BY draft, n, bad ORDER BY item) AS nth FROM i)
    SELECT draft, item, 'TrainingVideo.InvalidPath' AS code FROM r WHERE bad UNION ALL SELECT draft, item, 'TrainingVideo.Duplicate' FROM r WHERE NOT bad AND nth > 1
    UNION ALL SELECT s_suppkey, 0, 'ImportedPackage.NotFound' FROM supplier WHERE s_suppkey % 3 = 1""")
def draft_paths(spark, sf_dir):
    drafts = table(spark, sf_dir, "supplier").selectExpr("s_suppkey AS draft", "s_name AS name", "'/data/x' AS workspace", "CAST(NULL AS STRING) AS staging", "CASE WHEN s_suppkey % 3 > 0 THEN 'm.VWPKG' END AS package", "s_suppkey % 3 = 2 AS package_found")
    items = table(spark, sf_dir, "customer").selectExpr("c_custkey % 400 AS draft", "c_custkey AS item", f"{_PATH} AS path", "false AS archived", "true AS found", "CAST(NULL AS STRING) AS grp")
    groups = items.limit(0).selectExpr("draft", "item AS grp_item", "grp", "grp AS grp_name")
    return draft.issues(drafts, items, groups, require_input=False).select("draft", "item", "code")


_VIDEO = {"profile": "l_orderkey % 1000", "video": "CASE WHEN l_orderkey % 41 = 0 THEN NULL ELSE l_orderkey * 10 + l_linenumber % 5 END", "file_path": "CASE WHEN l_partkey % 37 = 0 THEN ' ' ELSE 'v' END", "date_label": "CASE WHEN l_partkey % 31 = 0 THEN NULL ELSE '2024' END", "condition": "l_returnflag", "sort_order": "l_linenumber - 2", "grp": "CASE WHEN l_suppkey % 4 > 0 THEN l_suppkey END"}
_OLD = {"profile": "s_suppkey % 1000", "grp": "CASE WHEN s_suppkey % 9 = 0 THEN NULL ELSE s_suppkey END", "name": "CASE s_suppkey % 5 WHEN 0 THEN 'UNASSIGNED' WHEN 1 THEN s_name || ' ' WHEN 2 THEN 'same' ELSE s_name END"}
_NEW = {"profile": "s_suppkey % 1000", "grp": "CASE WHEN s_suppkey % 7 = 0 THEN s_suppkey ELSE s_suppkey + 100000 END", "name": "CASE WHEN s_suppkey % 5 = 2 THEN 'SAME' ELSE 'g' || s_suppkey END"}
_PROFILE = {"profile": "c_custkey", "display_name": "CASE WHEN c_custkey % 11 = 0 THEN '' ELSE c_name END", "workspace_root": "CASE WHEN c_custkey % 13 = 0 THEN NULL ELSE 'w' END", "readiness": "CASE WHEN c_custkey % 17 = 0 THEN '  ' ELSE c_mktsegment END"}
_list = lambda columns: [f"{e} AS {c}" for c, e in columns.items()]
_from = lambda columns, name: f"SELECT {', '.join(_list(columns))} FROM {name}"


@R.query(f"""WITH p AS ({_from(_PROFILE, 'customer')}), g AS ({_from(_OLD, 'supplier')} UNION ALL {_from(_NEW, 'supplier')}), v AS ({_from(_VIDEO, 'lineitem')}),
    gc AS (SELECT *, grp IS NOT NULL AND count(*) OVER (PARTITION BY profile, grp) > 1 AS twice, count(*) OVER (PARTITION BY profile, lower(name)) > 1 AS named FROM g),
    vc AS (SELECT *, video IS NOT NULL AND count(*) OVER (PARTITION BY profile, video) > 1 AS twice, grp IS NOT NULL AND NOT EXISTS (SELECT 1 FROM g WHERE g.profile = v.profile AND g.grp = v.grp) AS strange FROM v),
    f AS (SELECT 'profile' AS part, profile AS item, unnest(['display_name', 'workspace_root', 'readiness']) AS rule, unnest([trim(display_name) = '', workspace_root IS NULL, trim(readiness) = '']) AS bad FROM p
          UNION ALL SELECT 'group', grp, unnest(['id', 'name', 'unique_id', 'unique_name']), unnest([grp IS NULL, lower(name) = 'unassigned' OR trim(name) <> name, twice, named]) FROM gc
          UNION ALL SELECT 'video', video, unnest(['id', 'file_path', 'date_label', 'condition', 'sort_order', 'unique_id', 'group_of_profile']), unnest([video IS NULL, trim(file_path) = '', date_label IS NULL, condition NOT IN ('A', 'N'), sort_order < 0, twice, strange]) FROM vc)
    SELECT part, rule, count(*) AS n, sum(coalesce(item, 0))::BIGINT AS items FROM f WHERE bad GROUP BY 1, 2""")
def whole_profile(spark, sf_dir):
    read = lambda columns, name: table(spark, sf_dir, name).selectExpr(*_list(columns))
    groups = read(_OLD, "supplier").union(read(_NEW, "supplier"))
    found = results.profile_faults(read(_PROFILE, "customer"), groups, read(_VIDEO, "lineitem"), ("A", "N"))
    return found.groupBy("part", "rule").agg(F.count("*").alias("n"), F.sum(F.coalesce(F.col("item").cast("long"), F.lit(0))).alias("items"))
