"""Validators, lookups and record expressions over rows derived from the test tables; derived columns are such that rules break.

Derived expressions are written once, in SQL that Spark and DuckDB read alike; the rules are written twice.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlens.functions import text as t
from ledgerlens.functions import timeline
from ledgerlens.operators import draft, quality, readiness, reconcile, records, relational, sequence
from ledgerlens.plans.registry import Registry, table
from ledgerlens.sources import catalog as source
from ledgerlens.sources import journal, probe

R = Registry()
QUERIES, ORACLE_SQL = R.queries, R.sql


def _derived(spark, sf_dir, name, columns):
    return table(spark, sf_dir, name).selectExpr(*[f"{e} AS {c}" for c, e in columns.items()])


def _sql(name, columns):
    return f"(SELECT {', '.join(f'{e} AS {c}' for c, e in columns.items())} FROM {name})"


def _rules_sql(key, source, rules):
    """SQL of one row for each rule that is not true."""
    return " UNION ALL ".join(f"SELECT {key}, '{name}' AS rule FROM {source} WHERE NOT coalesce({ok}, false)" for name, ok in rules.items())


_LINK = "CASE WHEN l_orderkey % 97 = 0 THEN NULL ELSE l_partkey END"
_STATE = "CASE p_partkey % 60 WHEN 0 THEN 'IntegrityFailed' WHEN 1 THEN 'AwaitingProbe' WHEN 2 THEN 'ValidationFailed' WHEN 3 THEN 'PreprocessingFailed' WHEN 4 THEN 'Validated' ELSE 'Prepared' END"
_PREPARED, _OBSERVED = "p_partkey % 60 > 4 AND p_partkey % 53 <> 0 OR p_partkey % 60 = 4 AND p_partkey % 9 = 0", "p_partkey % 60 > 4 AND p_partkey % 11 <> 0 OR p_partkey % 60 = 2 AND p_partkey % 5 = 2"
_FAILED = "p_partkey % 11 = 0 AND p_partkey % 2 = 0 OR p_partkey % 71 = 0"


@R.query(f"""
    WITH a AS (SELECT p_partkey, {_STATE} AS state, {_FAILED} AS failed FROM part), p AS (SELECT p_partkey FROM part WHERE {_PREPARED}), o AS (SELECT p_partkey FROM part WHERE {_OBSERVED}),
    v AS (SELECT l_orderkey, {_LINK} AS link FROM lineitem WHERE NOT (l_linestatus = 'F' AND l_returnflag = 'A')),
    c AS (SELECT l_orderkey, count(*) AS n, count_if(link IS NULL) AS unlinked, count_if(state = 'IntegrityFailed') AS integrity, count_if(state = 'AwaitingProbe') AS awaiting, count_if(state = 'ValidationFailed') AS invalid,
          count_if(state = 'PreprocessingFailed') AS unprepared, count_if(state = 'Validated') AS validated, count_if(state = 'Prepared') AS prepared, count_if(state = 'Prepared' AND p.p_partkey IS NOT NULL) AS results,
          count_if(state <> 'Prepared' AND p.p_partkey IS NOT NULL) AS odd_results, count_if(failed) AS failed, count_if(state = 'Prepared' AND o.p_partkey IS NOT NULL) AS observed,
          count_if(state <> 'Prepared' AND o.p_partkey IS NOT NULL) AS odd_observed, count_if(failed AND o.p_partkey IS NOT NULL) AS conflicts
          FROM v LEFT JOIN a ON a.p_partkey = link LEFT JOIN p ON p.p_partkey = a.p_partkey LEFT JOIN o ON o.p_partkey = a.p_partkey GROUP BY l_orderkey)
    SELECT l_orderkey, n AS active, unlinked, odd_results AS unexpected_prepared, odd_observed AS unexpected_observed, conflicts AS conflicting,
           CASE WHEN integrity > 0 THEN 'MediaIntegrityFailed' WHEN unlinked > 0 THEN 'Draft' WHEN awaiting > 0 THEN 'MediaIngestedAwaitingProbe' WHEN invalid > 0 THEN 'MediaValidationFailed' WHEN unprepared > 0 THEN 'MediaPreprocessingFailed'
                WHEN validated > 0 AND validated + prepared = n THEN 'MediaValidated' WHEN prepared = n AND results = n AND odd_results = 0 THEN
                CASE WHEN odd_observed > 0 OR conflicts > 0 THEN 'Inconsistent' WHEN failed > 0 THEN 'AudioObservationFailed' WHEN observed = n THEN 'AudioObserved' ELSE 'MediaPrepared' END ELSE 'Inconsistent' END AS readiness FROM c""")
def readiness_chain(spark, sf_dir):
    videos = table(spark, sf_dir, "lineitem").select("l_orderkey", F.expr(_LINK).alias("link"), F.expr("l_linestatus = 'F' AND l_returnflag = 'A'").alias("archived"))
    part = table(spark, sf_dir, "part").select("p_partkey")
    assets = part.select("p_partkey", F.expr(_STATE).alias("state"), F.expr(_FAILED).alias("failed"))
    rows = readiness.chained(readiness.active(videos, "archived"), assets, part.where(_PREPARED), part.where(_OBSERVED), "link", "p_partkey").withColumn("linked", F.col("link").isNotNull())
    out = readiness.rollup(rows, ["l_orderkey"], "state", "linked", "has_result", "observed", "failed").withColumn("readiness", readiness.decision())
    return out.select("l_orderkey", "active", "unlinked", "unexpected_prepared", "unexpected_observed", "conflicting", "readiness")


_HEX = "concat(md5(CAST(o_orderkey AS STRING)), md5(CAST(o_custkey AS STRING)))"
_BAD_HEX = f"CASE WHEN o_orderkey % 31 = 0 THEN upper({_HEX}) WHEN o_orderkey % 37 = 0 THEN substr({_HEX}, 2) WHEN o_orderkey % 41 = 0 THEN NULL ELSE {_HEX} END"
_TEXT = "CASE WHEN o_orderkey % 23 = 0 THEN '  ' WHEN o_orderkey % 29 = 0 THEN repeat('x', 4097) WHEN o_orderkey % 43 = 0 THEN NULL ELSE o_orderpriority END"
_RESULT = {"id": "o_orderkey", "container": _TEXT, "codec": "o_orderstatus", "stream": "o_orderkey % 19 - 1", "width": "o_custkey % 17", "duration_us": "o_orderkey % 13 * 1000000", "decoded": "o_orderstatus <> 'P'", "tool_sha": _BAD_HEX, "contract_sha": _HEX, "made_at": "CASE WHEN o_orderkey % 47 = 0 THEN NULL ELSE o_orderdate END"}
_SHA_OK = "regexp_matches({0}, '^[0-9a-f]{{64}}$')"


@R.query(_rules_sql("id", _sql("orders", _RESULT), {
    "text:container": "trim(container) <> '' AND length(container) <= 4096", "text:codec": "trim(codec) <> ''", "hash:tool_sha": _SHA_OK.format("tool_sha"), "hash:contract_sha": _SHA_OK.format("contract_sha"),
    "positive:width": "width > 0", "positive:duration_us": "duration_us > 0", "not_negative:stream": "stream >= 0", "decoded": "decoded", "required:made_at": "made_at IS NOT NULL"}))
def dq_validation_result(spark, sf_dir):
    rules = records.provenance(["container", "codec"], ["tool_sha", "contract_sha"], ["width", "duration_us"], ["stream"]) | {"decoded": F.col("decoded")} | records.required("made_at")
    return quality.violations(_derived(spark, sf_dir, "orders", _RESULT), "id", rules)


_PREP = {"id": "o_orderkey", "version": _TEXT, "source_bytes": "o_custkey % 11", "proxy_bytes": "o_orderkey % 7 - 1", "samples": "o_orderkey % 101", "source_sha": _BAD_HEX, "quality_state": "CASE WHEN o_orderkey % 53 = 0 THEN 'Good' ELSE 'NotAssessed' END", "model_state": "CASE WHEN o_orderkey % 59 = 0 THEN NULL ELSE 'NotAssessed' END", "made_at": "CASE WHEN o_orderkey % 61 = 0 THEN NULL ELSE o_orderdate END"}


@R.query(_rules_sql("id", _sql("orders", _PREP), {
    "text:version": "trim(version) <> '' AND length(version) <= 4096", "hash:source_sha": _SHA_OK.format("source_sha"), "positive:source_bytes": "source_bytes > 0", "positive:proxy_bytes": "proxy_bytes > 0", "positive:samples": "samples > 0",
    "open:quality_state": "quality_state = 'NotAssessed'", "open:model_state": "model_state = 'NotAssessed'", "required:made_at": "made_at IS NOT NULL"}))
def dq_preprocessing_result(spark, sf_dir):
    rules = records.provenance(["version"], ["source_sha"], ["source_bytes", "proxy_bytes", "samples"]) | records.not_assessed("quality_state", "model_state") | records.required("made_at")
    return quality.violations(_derived(spark, sf_dir, "orders", _PREP), "id", rules)


_ASSET = {"id": "p_partkey", "state": _STATE, "probe": "CASE WHEN p_partkey % 60 IN (0, 2) OR p_partkey % 67 = 0 THEN 'p' END", "prep": "CASE WHEN p_partkey % 60 = 3 OR p_partkey % 73 = 0 THEN 'q' END", "seen": "CASE WHEN p_partkey % 10 = 3 THEN 's' END"}


@R.query(_rules_sql("id", _sql("part", _ASSET), {
    "probe_failure_matches_state": "(state IN ('ValidationFailed', 'IntegrityFailed')) = (probe IS NOT NULL)", "preprocessing_failure_matches_state": "(state = 'PreprocessingFailed') = (prep IS NOT NULL) AND (probe IS NULL OR prep IS NULL)",
    "observation_failure_only_prepared": "seen IS NULL OR state = 'Prepared'"}))
def dq_asset_state(spark, sf_dir):
    return quality.violations(_derived(spark, sf_dir, "part", _ASSET), "id", records.asset_state("state", "probe", "prep", "seen"))


_OUTCOME = {"id": "o_orderkey", "result": "CASE WHEN o_orderkey % 4 > 0 THEN o_totalprice END", "failure": "CASE WHEN o_orderkey % 4 = 0 AND o_orderkey % 12 > 0 OR o_orderkey % 17 = 0 THEN 'f' END", "state": "CASE WHEN o_orderstatus = 'F' THEN 'Failed' ELSE 'Done' END"}


@R.query(_rules_sql("id", _sql("orders", _OUTCOME), {"result_xor_failure": "(result IS NULL) <> (failure IS NULL)", "state_matches_outcome": "CASE WHEN result IS NOT NULL THEN state = 'Done' ELSE state = 'Failed' END"}))
def dq_result_xor_failure(spark, sf_dir):
    return quality.violations(_derived(spark, sf_dir, "orders", _OUTCOME), "id", records.outcome("result", "failure", "state", "Done", "Failed"))


@R.query("""SELECT l_orderkey AS id, 'unknown_asset' AS rule FROM lineitem LEFT JOIN (SELECT * FROM orders WHERE o_orderkey % 9 > 0) ON o_orderkey = l_orderkey WHERE o_orderkey IS NULL
    UNION ALL SELECT l_orderkey, 'differs:sha' FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_orderkey % 9 > 0 AND md5(CAST(o_custkey AS VARCHAR)) <> md5(CAST(CASE WHEN l_linenumber = 3 THEN 0 ELSE o_custkey END AS VARCHAR))
    UNION ALL SELECT l_orderkey, 'differs:bytes' FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_orderkey % 9 > 0 AND (o_orderkey % 25 = l_linenumber)""")
def dq_result_for_asset(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), "o_custkey")
    made = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), "l_linenumber").join(orders, "id", "left")
    sha = F.md5(F.when(F.col("l_linenumber") == 3, 0).otherwise(F.col("o_custkey")).cast("string"))
    results = made.select("id", sha.alias("sha"), F.when(F.col("id") % 25 == F.col("l_linenumber"), -1).otherwise(F.col("id")).alias("bytes"))
    assets = orders.where("id % 9 > 0").select("id", F.md5(F.col("o_custkey").cast("string")).alias("sha"), F.col("id").alias("bytes"))
    return records.for_asset(results, assets, "id", {"sha": "sha", "bytes": "bytes"})


_JOB = {"id": "o_orderkey", "created": "o_orderkey % 100", "made_at": "o_orderkey % 100 + o_custkey % 50 - 2", "completed": "CASE WHEN o_orderstatus <> 'O' THEN o_orderkey % 100 + 40 END", "updated": "o_orderkey % 100 + o_custkey % 45"}


@R.query(_rules_sql("id", _sql("orders", _JOB), {"after_creation": "made_at >= created", "before_completion": "completed IS NULL OR made_at <= completed", "completion_after_update": "completed IS NULL OR completed >= updated"}))
def dq_time_within_job(spark, sf_dir):
    return quality.violations(_derived(spark, sf_dir, "orders", _JOB), "id", records.within_job("created", "made_at", "completed", "updated"))


_PROGRESS = {"id": "o_orderkey", "done": "o_orderkey % 9 - 1", "total": "o_custkey % 9"}


@R.query(_rules_sql("id", _sql("orders", _PROGRESS), {"progress": "done >= 0 AND done <= total"}))
def dq_progress(spark, sf_dir):
    return quality.violations(_derived(spark, sf_dir, "orders", _PROGRESS), "id", {"progress": quality.progress_ok(F.col("done"), F.col("total"))})


@R.query("SELECT c_custkey FROM customer LEFT JOIN supplier ON s_suppkey = c_custkey % 120 AND s_nationkey % 5 = c_nationkey % 5 WHERE c_custkey % 7 > 0 AND s_suppkey IS NULL")
def dq_group_membership(spark, sf_dir):
    videos = table(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_custkey") % 7 > 0, F.col("c_custkey") % 120).alias("grp"), (F.col("c_nationkey") % 5).alias("owner"))
    groups = table(spark, sf_dir, "supplier").select("s_suppkey", (F.col("s_nationkey") % 5).alias("owner_of"))
    return records.outside_group(videos, groups, "grp", "owner", "s_suppkey", "owner_of").select("c_custkey")


_PROFILE = {"id": "c_custkey", "name": "CASE WHEN c_custkey % 31 = 0 THEN ' ' ELSE c_name END", "condition": "c_mktsegment", "place": "c_nationkey - 1", "grp": "CASE WHEN c_custkey % 3 = 0 THEN 'Unassigned' WHEN c_custkey % 5 = 0 THEN ' x' ELSE c_name END"}


@R.query(_rules_sql("id", _sql("customer", _PROFILE), {"text:name": "trim(name) <> '' AND length(name) <= 4096", "condition": "condition IN ('BUILDING', 'FURNITURE')", "not_negative:place": "place >= 0",
    "group_name": "trim(grp) <> '' AND length(grp) <= 200 AND trim(grp) = grp AND lower(grp) <> 'unassigned'"}) + """
    UNION ALL SELECT id, 'unique_group' FROM (SELECT c_custkey AS id, count(*) OVER (PARTITION BY lower(c_mktsegment), c_nationkey) AS n FROM customer) WHERE n > 1""")
def dq_profile(spark, sf_dir):
    rows = _derived(spark, sf_dir, "customer", _PROFILE)
    rules = records.provenance(["name"], not_negative=["place"]) | {"condition": F.col("condition").isin("BUILDING", "FURNITURE"), "group_name": t.group_name_ok(F.col("grp"))}
    named = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.concat_ws("|", F.lower("c_mktsegment"), F.col("c_nationkey").cast("string")).alias("k"))
    return quality.violations(rows, "id", rules).unionByName(quality.repeated(named, F.col("k")).select("id", F.lit("unique_group").alias("rule")))


_FACTS = {"id": "o_orderkey", "n": "o_orderkey % 50", "duration_us": "o_orderkey % 50 * 10", "minimum": "CAST(o_custkey % 9 - 6 AS INT)", "maximum": "CAST(o_custkey % 7 - 1 AS INT)", "peak": "greatest(abs(o_custkey % 9 - 6), abs(o_custkey % 7 - 1)) + CASE WHEN o_orderkey % 13 = 0 THEN 1 ELSE 0 END",
    "positive": "o_orderkey % 20", "negative": "o_orderkey % 50 - o_orderkey % 20 - 2", "zero": "CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE 2 END", "full_high": "CASE WHEN o_orderkey % 17 = 0 THEN 1 ELSE 0 END", "full_low": "CASE WHEN o_orderkey % 19 = 0 THEN 1 ELSE 0 END", "crossings": "o_custkey % 55",
    "total": "CAST(o_custkey % 200 - 100 AS STRING)", "total_squares": "CAST(o_custkey % 900 AS STRING)"}


@R.query(_rules_sql("id", _sql("orders", _FACTS), {
    "geometry_positive": "n > 0 AND duration_us > 0", "extremes_ordered": "minimum BETWEEN -32768 AND maximum AND maximum <= 32767", "counts_not_negative": "positive >= 0 AND negative >= 0 AND zero >= 0 AND full_high >= 0 AND full_low >= 0 AND crossings >= 0",
    "zero_matches_extremes": "CASE WHEN zero > 0 THEN minimum <= 0 AND maximum >= 0 ELSE minimum <> 0 AND maximum <> 0 END", "peak_is_largest_magnitude": "peak = greatest(abs(minimum), abs(maximum))", "signs_sum_to_count": "positive + negative + zero = n",
    "positive_matches_maximum": "(positive = 0) = (maximum <= 0)", "negative_matches_minimum": "(negative = 0) = (minimum >= 0)", "full_high_within_positive": "full_high <= positive AND (full_high > 0) = (maximum = 32767)", "full_low_within_negative": "full_low <= negative AND (full_low > 0) = (minimum = -32768)",
    "crossings_below_count": "crossings < n", "total_between_extremes": "CAST(total AS BIGINT) BETWEEN minimum * n AND maximum * n", "squares_between_peaks": "CAST(total_squares AS BIGINT) BETWEEN peak * peak AND peak * peak * n"}))
def dq_audio_facts(spark, sf_dir):
    return sequence.violations(_derived(spark, sf_dir, "orders", _FACTS)).select("id", "rule")


@R.query("""SELECT l_orderkey, l_linenumber FROM lineitem JOIN orders ON o_orderkey = l_orderkey
    WHERE (CASE WHEN l_partkey % 6 = 0 THEN NULL ELSE l_suppkey % 2 END) IS DISTINCT FROM (CASE WHEN o_custkey % 5 = 0 THEN NULL ELSE o_custkey % 2 END)""")
def dq_snapshot_match(spark, sf_dir):
    results = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.expr("CASE WHEN l_partkey % 6 = 0 THEN NULL ELSE l_suppkey % 2 END").alias("a"))
    frozen = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.expr("CASE WHEN o_custkey % 5 = 0 THEN NULL ELSE o_custkey % 2 END").alias("b"))
    rows = results.join(frozen, "l_orderkey")
    return rows.where(~quality.snapshot_matches(rows, {"a": "b"})).select("l_orderkey", "l_linenumber")


_DRAFT = {"draft": "s_suppkey", "name": "CASE WHEN s_suppkey % 4 = 0 THEN ' ' ELSE s_name END", "workspace": "CASE s_suppkey % 5 WHEN 0 THEN '/' WHEN 1 THEN 'data/x' WHEN 2 THEN NULL ELSE '/data/x' END", "staging": "CASE WHEN s_suppkey % 6 = 0 THEN 'C:' WHEN s_suppkey % 6 = 1 THEN 'C:/in' END", "package": "CASE s_suppkey % 7 WHEN 0 THEN 'a.zip' WHEN 1 THEN 'm.vwpkg' END"}
_ITEM = {"draft": "c_custkey % 110", "item": "c_custkey", "path": "CASE WHEN c_custkey % 13 = 0 THEN '' WHEN c_custkey % 11 = 0 THEN '/v/a.avi' ELSE concat('/v/', CASE WHEN c_custkey % 2 = 0 THEN 'A' ELSE 'a' END, CAST(c_nationkey AS STRING), '.Mp4') END",
    "archived": "c_custkey % 110 % 9 = 0", "found": "c_custkey % 10 > 0", "grp": "CASE WHEN c_nationkey > 3 THEN CAST(c_nationkey AS STRING) END"}
_GROUP = {"draft": "s_suppkey", "grp_item": "n_nationkey", "grp": "CASE WHEN n_nationkey % 12 = 5 THEN NULL WHEN n_nationkey > 20 THEN '7' ELSE CAST(n_nationkey AS STRING) END", "grp_name": "CASE n_nationkey % 6 WHEN 0 THEN '' WHEN 1 THEN 'UNASSIGNED' WHEN 2 THEN ' n' WHEN 3 THEN 'Same' WHEN 4 THEN concat('N', CAST(n_nationkey AS STRING)) ELSE CASE WHEN n_nationkey = 5 THEN 'same' ELSE n_name END END"}
_GROUP_FROM = "supplier JOIN nation ON n_nationkey % 10 = s_suppkey % 10 OR n_nationkey % 10 = (s_suppkey + 3) % 10"


@R.query(f"""
    WITH d AS {_sql('supplier', _DRAFT)}, i AS {_sql('customer', _ITEM)}, g AS {_sql(_GROUP_FROM, _GROUP)},
    k AS (SELECT *, CASE WHEN trim(path) = '' THEN 'TrainingVideo.PathRequired' WHEN lower(path) NOT LIKE '%.mp4' THEN 'TrainingVideo.Mp4Required' END AS kind FROM i),
    r AS (SELECT *, row_number() OVER (PARTITION BY draft, lower(path), kind IS NULL ORDER BY item) AS nth FROM k),
    b AS (SELECT *, CASE WHEN trim(grp_name) = '' THEN 'RecordingDependencyGroup.NameRequired' WHEN lower(grp_name) = 'unassigned' THEN 'RecordingDependencyGroup.NameReserved' WHEN trim(grp_name) <> grp_name THEN 'RecordingDependencyGroup.NameInvalid' END AS bad FROM g),
    h AS (SELECT *, row_number() OVER (PARTITION BY draft, lower(grp_name), bad IS NULL ORDER BY grp_item) AS nth_name, row_number() OVER (PARTITION BY draft, grp ORDER BY grp_item) AS nth_id FROM b)
    SELECT draft, 0 AS item, 'ProfileName.Required' AS code FROM d WHERE trim(name) = '' UNION ALL SELECT draft, 0, 'Workspace.Invalid' FROM d WHERE workspace IS NULL OR workspace IN ('/', 'data/x')
    UNION ALL SELECT draft, 0, 'Downloadstaging.Invalid' FROM d WHERE staging = 'C:' UNION ALL SELECT draft, 0, 'ImportedPackage.Extension' FROM d WHERE package = 'a.zip'
    UNION ALL SELECT draft, item, kind FROM r WHERE kind IS NOT NULL UNION ALL SELECT draft, item, 'TrainingVideo.NotFound' FROM r WHERE kind IS NULL AND NOT archived AND NOT found
    UNION ALL SELECT draft, item, 'TrainingVideo.Duplicate' FROM r WHERE kind IS NULL AND nth > 1
    UNION ALL SELECT draft, grp_item, 'RecordingDependencyGroup.IdRequired' FROM h WHERE grp IS NULL UNION ALL SELECT draft, grp_item, 'RecordingDependencyGroup.DuplicateId' FROM h WHERE grp IS NOT NULL AND nth_id > 1
    UNION ALL SELECT draft, grp_item, bad FROM h WHERE bad IS NOT NULL UNION ALL SELECT draft, grp_item, 'RecordingDependencyGroup.DuplicateName' FROM h WHERE bad IS NULL AND nth_name > 1
    UNION ALL SELECT draft, item, 'TrainingVideo.RecordingDependencyGroupUnknown' FROM i WHERE grp IS NOT NULL AND NOT EXISTS (SELECT 1 FROM g WHERE g.draft = i.draft AND g.grp = i.grp)
    UNION ALL SELECT draft, 0, 'Input.Required' FROM d WHERE package IS NULL AND NOT EXISTS (SELECT 1 FROM i WHERE i.draft = d.draft AND NOT archived)""")
def dq_draft_issues(spark, sf_dir):
    nations = table(spark, sf_dir, "nation").withColumn("_d", F.explode(F.array(F.col("n_nationkey") % 10, (F.col("n_nationkey") + 7) % 10)))
    groups = table(spark, sf_dir, "supplier").join(F.broadcast(nations), F.col("s_suppkey") % 10 == F.col("_d"))
    groups = groups.selectExpr(*[f"{e} AS {c}" for c, e in _GROUP.items()])
    return draft.issues(_derived(spark, sf_dir, "supplier", _DRAFT), _derived(spark, sf_dir, "customer", _ITEM), groups).select("draft", "item", "code")


_REQUEST = {"id": "CASE WHEN c_custkey % 50 = 0 THEN NULL WHEN c_custkey % 20 = 1 THEN c_custkey - 1 ELSE c_custkey END", "path": "CASE c_custkey % 6 WHEN 0 THEN 'v/a.mp4' WHEN 1 THEN '/v/a.MOV' ELSE concat('C:/', c_name, '.MP4') END", "size": "CASE WHEN c_custkey % 9 = 0 THEN NULL ELSE c_custkey % 8 END"}


@R.query(f"WITH q AS (SELECT *, count(*) OVER (PARTITION BY id) AS n FROM {_sql('customer', _REQUEST)}) " + _rules_sql("id", "q", {"unique_id": "id IS NOT NULL AND n = 1", "absolute": "path LIKE '/%' OR path LIKE 'C:/%'", "mp4": "lower(path) LIKE '%.mp4'", "exists": "size IS NOT NULL", "not_empty": "size IS NULL OR size > 0"}))
def dq_stage_request(spark, sf_dir):
    return draft.stage_requests(_derived(spark, sf_dir, "customer", _REQUEST), "id", "path", "size")


@R.query("SELECT l_orderkey, l_linenumber, p_name FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_returnflag = 'N'")
def bridge_join(spark, sf_dir):
    bridge = table(spark, sf_dir, "lineitem").where("l_returnflag = 'N'").select("l_orderkey", "l_linenumber", "l_partkey")
    return relational.bridged(table(spark, sf_dir, "part").select("p_partkey", "p_name"), bridge, "p_partkey", "l_partkey").select("l_orderkey", "l_linenumber", "p_name")


@R.query("SELECT l_orderkey, l_linenumber, o_custkey FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_orderpriority = '1-URGENT'")
def result_join(spark, sf_dir):
    assets = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey", "o_orderpriority")
    rows = relational.results_of(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber"), assets, "l_orderkey", F.col("o_orderpriority") == "1-URGENT")
    return rows.select("l_orderkey", "l_linenumber", "o_custkey")


_ENTRY = {"id": "o_orderkey", "archived": "CASE WHEN o_orderkey % 5 > 0 THEN o_orderstatus = 'P' END", "asset": "CASE WHEN o_custkey % 7 > 0 THEN o_custkey END"}


@R.query(f"SELECT id, asset IS NOT NULL AS linked FROM {_sql('orders', _ENTRY)} WHERE NOT coalesce(archived, false)")
def active_rows(spark, sf_dir):
    rows = _derived(spark, sf_dir, "orders", _ENTRY)
    parts = [relational.active(rows, "archived", "asset", linked).select("id", F.lit(linked).alias("linked")) for linked in (True, False)]
    return parts[0].unionByName(parts[1])


@R.query('''SELECT '{"orderKey":' || o_orderkey || ',"orderStatus":"' || o_orderstatus || '","assetKey":' || CASE WHEN o_custkey % 7 > 0 THEN CAST(o_custkey AS VARCHAR) ELSE 'null' END || '}' AS value FROM orders''')
def json_documents(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").selectExpr("o_orderkey AS order_key", "o_orderstatus AS order_status", "CASE WHEN o_custkey % 7 > 0 THEN o_custkey END AS asset_key")
    return journal.as_documents(rows)


@R.query("SELECT c_custkey, n_name FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey + 3")
def unique_lookup(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select("c_custkey", (F.col("c_nationkey") + 3).alias("n_nationkey"))
    return relational.looked_up(rows, table(spark, sf_dir, "nation").select("n_nationkey", "n_name"), "n_nationkey").select("c_custkey", "n_name")


_PROPOSED = "CASE WHEN p_partkey % 3 = 0 THEN 'new' END"


@R.query(f"""SELECT p_partkey, CASE WHEN ({_PROPOSED} IS NULL) = (k IS NOT NULL) THEN {_PROPOSED} ELSE old END AS failure
    FROM (SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'old' END AS old, k FROM part LEFT JOIN (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_quantity > 48) ON k = p_partkey)""")
def exists_update(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_partkey") % 2 == 0, "old").alias("failure"))
    results = table(spark, sf_dir, "lineitem").where("l_quantity > 48").select(F.col("l_partkey").alias("p_partkey"))
    return relational.exists_update(rows, results, "p_partkey", "failure", F.expr(_PROPOSED))[0]


@R.query("""WITH n AS (SELECT o_orderkey % 9000 AS k, o_custkey + 20 AS c FROM orders WHERE o_orderkey % 2 = 0), o AS (SELECT o_orderkey AS k FROM orders WHERE o_orderkey % 10 = 0)
    SELECT k, 'given_twice' AS rule FROM n GROUP BY k HAVING count(*) > 1 UNION ALL SELECT DISTINCT k, 'taken' FROM n SEMI JOIN o USING (k) UNION ALL SELECT k, 'no_parent' FROM n WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = c)""")
def insert_faults(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    new = orders.where("o_orderkey % 2 = 0").select((F.col("o_orderkey") % 9000).alias("k"), (F.col("o_custkey") + 20).alias("c"))
    old = orders.where("o_orderkey % 10 = 0").select(F.col("o_orderkey").alias("k"))
    return relational.insert_faults(new, old, "k", table(spark, sf_dir, "customer"), "c", "c_custkey")


@R.query("SELECT p_partkey, min(p_partkey) OVER (PARTITION BY lower(n)) AS first_of_name FROM (SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN upper(p_name) ELSE p_name END AS n FROM part)")
def secondary_lookup(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_partkey", F.lower(F.when(F.col("p_partkey") % 2 == 0, F.upper("p_name")).otherwise(F.col("p_name"))).alias("n"))
    return rows.join(rows.groupBy("n").agg(F.min("p_partkey").alias("first_of_name")), "n").select("p_partkey", "first_of_name")


@R.query("SELECT o_custkey, arg_min(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey, count(*) > 1 AS more FROM orders GROUP BY o_custkey")
def top_first(spark, sf_dir):
    return relational.first_and_more(table(spark, sf_dir, "orders"), "o_custkey", ["o_orderdate", "o_orderkey"], "o_orderkey")


@R.query("SELECT l_orderkey, min(l_linenumber) AS first_order, count(*) AS n FROM lineitem GROUP BY 1")
def min_group_order(spark, sf_dir):
    return relational.groups_by_least(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_linenumber")


_NAMED = "CASE WHEN s_suppkey % 2 = 0 THEN upper(s_name) ELSE lower(s_name) END"


@R.query(f"SELECT s_nationkey, string_agg(CAST(s_suppkey AS VARCHAR), ',' ORDER BY lower(n), s_suppkey) AS ids, string_agg(CAST(s_suppkey AS VARCHAR), ',' ORDER BY s_suppkey DESC) AS reverse_ids FROM (SELECT *, {_NAMED} AS n FROM supplier) GROUP BY 1")
def nocase_order(spark, sf_dir):
    rows = table(spark, sf_dir, "supplier").select("s_nationkey", "s_suppkey", F.lower(F.expr(_NAMED)).alias("n"))
    ids = F.collect_list(F.struct("n", "s_suppkey"))
    names = lambda a: F.array_join(F.transform(a, lambda x: x["s_suppkey"].cast("string")), ",")
    return rows.groupBy("s_nationkey").agg(names(F.array_sort(ids)).alias("ids"), F.array_join(F.transform(F.reverse(F.array_sort(F.collect_list("s_suppkey"))), lambda x: x.cast("string")), ",").alias("reverse_ids"))


@R.query("""SELECT p_partkey, regexp_replace(lower(p_type), '[^a-z0-9]+', '-', 'g') || '_' || CASE WHEN p_partkey % 4 = 0 THEN 'media' ELSE regexp_replace(p_name, ' +', '-', 'g') END || '_' || left(md5(p_name), 12) AS dir,
    'Processing/20240102T030405678900' || '0Z_local-media_' || left(md5(p_name), 12) AS job, 'w/' || p_partkey || '/Prepared/v1_' || left(md5(p_type), 12) || '/proxy.mp4' AS prepared FROM part""")
def record_paths(spark, sf_dir):
    source_name = F.when(F.col("p_partkey") % 4 != 0, F.concat("p_name", F.lit(".mp4")))
    at = F.lit("2024-01-02 03:04:05.6789").cast("timestamp_ntz")
    prepared = t.prepared_path(F.concat(F.lit("w/"), F.col("p_partkey").cast("string")), F.md5("p_type"), F.lit("proxy.mp4"))
    return table(spark, sf_dir, "part").select("p_partkey", t.asset_dir(F.col("p_type"), source_name, F.md5("p_name")).alias("dir"), t.job_path(F.md5("p_name"), at).alias("job"), prepared.alias("prepared"))


_READY = "CASE o_custkey % 5 WHEN 0 THEN 'MediaPrepared' WHEN 1 THEN 'ValidatingMedia' WHEN 2 THEN NULL WHEN 3 THEN 'AudioObserved' ELSE 'MediaIntegrityFailed' END"


@R.query(f"""SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 'Queued' WHEN 'F' THEN 'Finished' ELSE o_orderstatus END AS shown, coalesce(r = 'MediaPrepared' OR (r IS NULL OR r = 'AudioObserved') AND p > 0, false) AS can_process,
    o_orderkey % 3 = 0 AS codec_missing, CASE WHEN o_orderkey % 4 = 0 THEN 'mp42' END AS brand, least(o_orderkey, o_custkey) AS origin, CASE WHEN o_orderkey % 5 > 0 THEN greatest(o_orderkey % 100, o_custkey % 100) END AS mapped
    FROM (SELECT *, {_READY} AS r, o_orderkey % 2 AS p FROM orders) q""")
def record_expressions(spark, sf_dir):
    key = F.col("o_orderkey")
    log = F.when(key % 3 == 0, "x UNKNOWN Decoder y").when(key % 3 == 1, "decoder fine")
    brand = F.when(key % 4 == 0, "mp42").when(key % 4 == 1, "mp4").when(key % 4 == 2, "mp4\u00e9")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", t.shown(F.col("o_orderstatus"), {"O": "Queued", "F": "Finished"}).alias("shown"), t.can_process(F.expr(_READY), key % 2).alias("can_process"), t.codec_missing(log).alias("codec_missing"), t.major_brand(brand).alias("brand"),
        timeline.origin_us(key, F.col("o_custkey")).alias("origin"), timeline.mapped_duration_us(F.when(key % 5 > 0, key % 100), F.col("o_custkey") % 100).alias("mapped"))


@R.query("""SELECT l_orderkey, CASE WHEN bool_or(l_partkey % 31 = 0) THEN 'OperationalFailure' WHEN bool_or(l_partkey % 7 = 0 OR l_suppkey % 29 = 0 OR l_partkey % 37 = 0) THEN 'IntegrityMismatch' ELSE 'Verified' END AS state
    FROM (SELECT DISTINCT l_orderkey, l_linenumber, min(l_partkey) OVER w AS l_partkey, min(l_suppkey) OVER w AS l_suppkey FROM lineitem WINDOW w AS (PARTITION BY l_orderkey, l_linenumber)) GROUP BY l_orderkey""")
def bundle_verify(spark, sf_dir):
    files = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("p"), F.min("l_suppkey").alias("s"))
    named = lambda odd: F.concat(F.col("l_linenumber").cast("string"), F.when(odd, ".part").otherwise(".bin")).alias("file")
    expected = files.select("l_orderkey", named(F.lit(False)), F.col("p").alias("size"), F.md5(F.col("s").cast("string")).alias("sha"))
    actual = files.select("l_orderkey", named(F.col("p") % 37 == 0), (F.col("p") + F.when(F.col("p") % 7 == 0, 1).otherwise(0)).alias("size"), F.when(F.col("p") % 31 != 0, F.md5(F.when(F.col("s") % 29 == 0, "x").otherwise(F.col("s").cast("string")))).alias("sha"))
    return records.bundle_state(expected, actual, "l_orderkey", "file", "size", "sha")


_PROBED = {"id": "o_orderkey", "fmt": "CASE WHEN o_orderkey % 11 = 0 THEN 'avi' ELSE 'mov,MP4' END", "w": "600 + o_custkey % 700", "rate": "CASE WHEN o_orderkey % 5 = 0 THEN '25/1' ELSE '30/1' END", "ch": "1 + o_orderkey % 2", "more": "o_orderkey % 7 = 0"}
_PROBE_SCHEMA = "format struct<format_name: string>, streams array<struct<codec_type: string, codec_name: string, pix_fmt: string, width: int, height: int, avg_frame_rate: string, sample_rate: string, channels: int, time_base: string, duration_ts: bigint>>"


@R.query(f"SELECT id, fmt <> 'avi' AND w <= 1280 AND w % 2 = 0 AND rate = '30/1' AND ch = 2 AND NOT more AS proxy_ok, fmt <> 'avi' AND ch = 1 AND NOT more AS audio_ok FROM {_sql('orders', _PROBED)}")
def frozen_contracts(spark, sf_dir):
    rows = _derived(spark, sf_dir, "orders", _PROBED)
    extra = F.when(F.col("more"), ',{"codec_type":"audio"}').otherwise("")
    video = F.concat(F.lit('{"codec_type":"video","codec_name":"mpeg4","pix_fmt":"yuv420p","width":'), F.col("w").cast("string"), F.lit(',"height":720,"avg_frame_rate":"'), F.col("rate"), F.lit('"}'))
    sound = F.concat(F.lit('{"codec_type":"audio","codec_name":"aac","sample_rate":"48000","channels":'), F.col("ch").cast("string"), F.lit("}"))
    proxy = F.concat(F.lit('{"format":{"format_name":"'), F.col("fmt"), F.lit('"},"streams":['), video, F.lit(","), sound, extra, F.lit("]}"))
    audio = F.concat(F.lit('{"format":{"format_name":"'), F.when(F.col("fmt") == "avi", "avi").otherwise("wav"), F.lit('"},"streams":[{"codec_type":"audio","codec_name":"pcm_s16le","sample_rate":"16000","time_base":"1/16000","duration_ts":5,"channels":'), F.col("ch").cast("string"), F.lit("}"), extra, F.lit("]}"))
    return rows.select("id", records.frozen_proxy(F.from_json(proxy, _PROBE_SCHEMA)).alias("proxy_ok"), records.frozen_audio(F.from_json(audio, _PROBE_SCHEMA)).alias("audio_ok"))


_LOCATOR = {"id": "CASE WHEN o_orderkey % 9 = 0 THEN 'no uuid' ELSE concat('00000000-0000-4000-8000-', lpad(CAST(o_orderkey AS STRING), 12, '0')) END", "added": "CASE WHEN o_orderkey % 7 = 0 THEN '2024-13-01' ELSE '2024-01-01' END", "state": "o_orderstatus"}


@R.query("SELECT count_if(o_orderkey % 9 = 0 OR o_orderkey % 7 = 0 OR o_orderstatus = 'P') AS invalid FROM orders")
def catalog_scan(spark, sf_dir):
    return source.scanned(_derived(spark, sf_dir, "orders", _LOCATOR), "id", "added", "state", ("F", "O"))[1]


@R.query("SELECT id, array_to_string(list_filter([CASE WHEN NOT decoded THEN 'decoded' END, CASE WHEN made_at IS NULL THEN 'made_at' END, CASE WHEN NOT width > 0 THEN 'width' END], lambda x: x IS NOT NULL), ',') AS broken FROM " + _sql("orders", _RESULT))
def validated_decode(spark, sf_dir):
    rules = {"width": F.col("width") > 0, "decoded": F.col("decoded"), "made_at": F.col("made_at").isNotNull()}
    return source.decoded(_derived(spark, sf_dir, "orders", _RESULT), "id", rules).select("id", F.array_join("broken", ",").alias("broken"))


@R.query(r"""SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE 'a/' || p_partkey || '/b' END AS path, replace(p_name, ' ', ' / ') AS error, p_partkey % 3 = 0 AS has_mp4, CASE WHEN p_partkey % 2 = 0 THEN CAST(p_partkey AS VARCHAR) END AS whole,
    CASE WHEN p_size > 0 THEN CAST(p_size AS BIGINT) * 1500000 END AS us, CASE WHEN p_partkey % 4 > 0 THEN p_partkey % 4 END AS num, p_partkey % 6 < 2 AS version_ok, CAST(p_partkey % 1000 AS VARCHAR) || ' B' AS bytes FROM part""")
def text_expressions(spark, sf_dir):
    key = F.col("p_partkey")
    own = key.cast("string")
    path = F.when(key % 5 == 0, F.concat(F.lit("a/../"), own)).otherwise(F.concat(F.lit("a\\"), own, F.lit("//b")))
    version = F.when(key % 6 == 0, "v1").when(key % 6 == 1, "v1-beta").otherwise("v10")
    return table(spark, sf_dir, "part").select(
        "p_partkey", t.relative_path(path).alias("path"), t.sanitized_error(F.concat(F.lit("\t"), F.replace("p_name", F.lit(" "), F.lit("\n/\r")), F.lit(" \n"))).alias("error"), t.csv_has(F.when(key % 3 == 0, "mov, MP4").otherwise("mov,mp4x"), "mp4").alias("has_mp4"),
        t.canonical_integer(F.when(key % 2 == 0, own).otherwise(F.concat(F.lit("0"), own, F.lit("1")))).alias("whole"), timeline.seconds_to_us(F.concat((F.col("p_size") + F.floor(F.col("p_size") / 2)).cast("string"), F.when(F.col("p_size") % 2 == 1, ".5").otherwise(""))).alias("us"),
        timeline.rational(F.concat((key % 4).cast("string"), F.lit("/7")))["num"].alias("num"), t.version_matches(version, "v1").alias("version_ok"), t.format_bytes(key % 1000).alias("bytes"))


@R.query(r"""SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'ProbeOutputMalformed' WHEN o_orderkey % 3 = 1 THEN 'UnsupportedContainer' ELSE 'InvalidDuration' END AS verdict, CASE WHEN o_orderkey % 2 = 0 THEN o_custkey END AS done_us, CAST(o_custkey % 10 AS DOUBLE) AS metric FROM orders""")
def probe_documents(spark, sf_dir):
    key, cust = F.col("o_orderkey"), F.col("o_custkey").cast("string")
    json = F.when(key % 3 == 0, '{"format":').when(key % 3 == 1, '{"format":{"format_name":"avi"},"streams":[]}').otherwise('{"format":{"format_name":"mov,mp4","duration":"-1"},"streams":[]}')
    log = F.concat(F.lit("out_time_us=5\nprogress=continue\nout_time_us="), cust, F.when(key % 2 == 0, "\nprogress=end\n").otherwise("\nprogress=continue\n"))
    loud = F.concat(F.lit("mean: 3\nmean: nan\nmean: "), (F.col("o_custkey") % 10).cast("string"), F.lit("\n"))
    return table(spark, sf_dir, "orders").select("o_orderkey", probe.verdict(json).alias("verdict"), probe.completed_us(log).alias("done_us"), probe.last_metric(loud, "mean").alias("metric"))


@R.query("SELECT item_id, sha256(text) AS sha FROM benchmark")
def content_hash(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", F.sha2("text", 256).alias("sha"))


@R.query("""SELECT CASE WHEN c AND p AND NOT s THEN 'completed' WHEN c AND NOT p AND s THEN 'rolled_forward' WHEN NOT c AND p AND NOT s THEN 'rolled_back' WHEN NOT c AND NOT p THEN 'cleared' ELSE 'warning' END AS outcome, count(*) AS n
    FROM (SELECT o_orderkey % 2 = 0 AS c, o_orderkey % 3 = 0 AS p, o_custkey % 5 = 0 AS s FROM orders) GROUP BY 1""")
def reconcile_outcomes(spark, sf_dir):
    rows = table(spark, sf_dir, "orders")
    return reconcile.counts(rows, F.col("o_orderkey") % 2 == 0, F.col("o_orderkey") % 3 == 0, F.when(F.col("o_custkey") % 5 == 0, True))
