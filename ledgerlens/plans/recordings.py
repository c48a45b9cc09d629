"""Catalogue queries: documents stand for recordings, sources for profiles, labels for results of a stage."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlens.operators import dedup, readiness, relational, reconcile
from ledgerlens.plans.registry import Registry, table

R = Registry()
QUERIES, ORACLE_SQL = R.queries, R.sql

_STATE_SQL = "CASE WHEN l.doc_id IS NULL THEN CASE WHEN d.n_chars < 30 THEN 'AwaitingProbe' ELSE 'Validated' END WHEN l.toxic = 1 AND l.quality = 0 AND d.n_chars > 20000 THEN 'IntegrityFailed' ELSE 'Prepared' END"


@R.query(f"""
    WITH s AS (SELECT d.source, d.lang, {_STATE_SQL} AS state, l.doc_id IS NOT NULL AS has_result, l.quality = 1 AS observed, l.quality = 0 AS failed FROM documents d LEFT JOIN labels l USING (doc_id)),
    c AS (SELECT source, lang, count(*) AS active, count_if(state = 'AwaitingProbe') AS awaiting, count_if(state = 'IntegrityFailed') AS integrity, count_if(state = 'Validated') AS validated,
          count_if(state = 'Prepared') AS prepared, count_if(state = 'Prepared' AND has_result) AS results, count_if(coalesce(observed, false)) AS observed, count_if(coalesce(failed, false)) AS failed FROM s GROUP BY source, lang)
    SELECT source, lang, active, prepared, observed, CASE WHEN integrity > 0 THEN 'MediaIntegrityFailed' WHEN awaiting > 0 THEN 'MediaIngestedAwaitingProbe' WHEN validated > 0 AND validated + prepared = active THEN 'MediaValidated'
           WHEN prepared = active AND results = active THEN CASE WHEN failed > 0 THEN 'AudioObservationFailed' WHEN observed = active THEN 'AudioObserved' ELSE 'MediaPrepared' END ELSE 'Inconsistent' END AS readiness FROM c""")
def readiness_rollup(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    rows = docs.select("doc_id", "source", "lang", "n_chars").join(labels, "doc_id", "left")
    has = F.col("quality").isNotNull()
    bad = (F.col("toxic") == 1) & (F.col("quality") == 0) & (F.col("n_chars") > 20000)
    state = F.when(~has, F.when(F.col("n_chars") < 30, "AwaitingProbe").otherwise("Validated")).when(bad, "IntegrityFailed").otherwise("Prepared")
    rows = rows.select("source", "lang", state.alias("state"), F.lit(True).alias("linked"), has.alias("has_result"), (F.col("quality") == 1).alias("observed"), (F.col("quality") == 0).alias("failed"))
    out = readiness.rollup(rows, ["source", "lang"], "state", "linked", "has_result", "observed", "failed").withColumn("readiness", readiness.decision())
    return out.select("source", "lang", "active", F.col("n_Prepared").alias("prepared"), "observed", "readiness")


@R.query("SELECT sha256(text) AS content_hash, min(doc_id) AS first_key, count(*) AS copies, count(DISTINCT source) AS labels FROM documents GROUP BY 1")
def content_dedup(spark, sf_dir):
    return dedup.content_groups(table(spark, sf_dir, "documents"), "text", "doc_id", "source")


@R.query("SELECT sha256(text) AS content_hash, string_agg(DISTINCT source, ',' ORDER BY source) AS labels FROM documents GROUP BY 1 HAVING count(DISTINCT source) > 1")
def condition_conflict(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select(F.sha2("text", 256).alias("content_hash"), "source")
    return dedup.conflicts(rows, "content_hash", "source").select("content_hash", F.array_join("labels", ",").alias("labels"))


@R.query("""SELECT count(DISTINCT source) AS assigned_groups, count_if(source IS NULL) AS unassigned,
    (SELECT count(*) FROM (SELECT sha256(text) FROM documents GROUP BY 1 HAVING count(DISTINCT source) > 1)) AS conflicts FROM documents""")
def group_summary(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select(F.sha2("text", 256).alias("asset"), F.col("source").alias("grp"))
    per = rows.groupBy("asset").agg(F.countDistinct("grp").alias("groups"))
    return rows.agg(F.countDistinct("grp").alias("assigned_groups"), F.count_if(F.col("grp").isNull()).alias("unassigned")).join(F.broadcast(per.agg(F.count_if(F.col("groups") > 1).alias("conflicts"))))  # one row each


@R.query("SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def pending_anti(spark, sf_dir):
    return relational.pending(table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels"), "doc_id")


@R.query("""SELECT doc_id, 'only_expected' AS side FROM (SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels)
    UNION ALL SELECT doc_id, 'only_actual' FROM (SELECT doc_id FROM labels EXCEPT SELECT doc_id FROM documents)""")
def snapshot_set_equality(spark, sf_dir):
    return relational.set_difference(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ["doc_id"])


@R.query("SELECT DISTINCT p_partkey, p_name FROM part JOIN lineitem ON l_partkey = p_partkey WHERE l_returnflag = 'R'")
def active_distinct_join(spark, sf_dir):
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey"), "p_name")
    returned = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_partkey").alias("p_partkey"))
    return relational.linked(parts, returned, "p_partkey")


@R.query("""SELECT CASE WHEN labelled AND copies = 1 THEN 'completed' WHEN labelled THEN 'warning' WHEN copies = 1 THEN 'rolled_back' ELSE 'warning' END AS outcome, count(*) AS n
    FROM (SELECT l.doc_id IS NOT NULL AS labelled, count(*) OVER (PARTITION BY d.text) AS copies FROM documents d LEFT JOIN labels l USING (doc_id)) GROUP BY 1""")
def reconcile_matrix(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("h"))
    copies = docs.groupBy("h").agg(F.count("*").alias("copies"))
    rows = docs.join(copies, "h").join(table(spark, sf_dir, "labels").select("doc_id", F.lit(True).alias("labelled")), "doc_id", "left")
    return reconcile.counts(rows, F.col("labelled"), F.lit(True), F.col("copies") > 1)


@R.query("""SELECT o_custkey, string_agg(o_orderpriority, ',' ORDER BY f) AS labels FROM
    (SELECT o_custkey, o_orderpriority, min(rn) AS f FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn FROM orders) GROUP BY 1, 2) GROUP BY 1""")
def ordered_labels(spark, sf_dir):
    rows = dedup.first_seen_labels(table(spark, sf_dir, "orders"), "o_custkey", "o_orderpriority", ["o_orderdate", "o_orderkey"], "none")
    return rows.select("o_custkey", F.array_join("labels", ",").alias("labels"))


@R.query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def duplicate_keys(spark, sf_dir):
    return dedup.duplicates(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


@R.query("SELECT source, count(*) AS total, count_if(lang = 'en') AS english, count_if(n_chars < 500) AS short_ones, count_if(l.doc_id IS NULL) AS pending FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY source")
def profile_counts(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars").join(table(spark, sf_dir, "labels").select("doc_id", F.lit(True).alias("done")), "doc_id", "left")
    return rows.groupBy("source").agg(F.count("*").alias("total"), F.count_if(F.col("lang") == "en").alias("english"), F.count_if(F.col("n_chars") < 500).alias("short_ones"), F.count_if(F.col("done").isNull()).alias("pending"))
