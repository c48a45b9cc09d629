"""Scalar expressions over parts, pages and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlens.functions import text as t
from ledgerlens.functions import timeline
from ledgerlens.operators import paths, relational
from ledgerlens.plans.registry import Registry, table

R = Registry()
QUERIES, ORACLE_SQL = R.queries, R.sql


@R.query("""SELECT p_partkey, CASE WHEN n = '' THEN 'recording' ELSE n END AS name FROM (SELECT p_partkey, regexp_replace(CASE WHEN substr(w, 48, 1) = '-' THEN substr(w, 1, 49) ELSE substr(w, 1, 48) END, '-+$', '') AS n
    FROM (SELECT p_partkey, regexp_replace(regexp_replace(lower(trim(p_name || ' / ' || p_type)), '[^a-z0-9]+', '-', 'g'), '^-', '') AS w FROM part))""")
def safe_name(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", t.safe_name(F.concat_ws(" / ", "p_name", "p_type")).alias("name"))


@R.query(r"SELECT page_id, CASE WHEN regexp_matches(leaf, '^.+\.[^.]*$') THEN regexp_replace(leaf, '\.[^.]*$', '') ELSE leaf END AS stem FROM (SELECT page_id, regexp_extract(url, '([^/\\]*)$', 1) AS leaf FROM pages)")
def file_stem(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", t.file_stem(F.col("url")).alias("stem"))


@R.query("SELECT page_id, strlen(html) AS n, sha256(concat_ws(chr(10), 'v1', url, CAST(strlen(html) AS VARCHAR))) AS contract, left(replace(sha256(html), '-', ''), 12) AS short FROM pages")
def contract_hash(spark, sf_dir):
    n = F.octet_length("html")
    return table(spark, sf_dir, "pages").select("page_id", n.cast("long").alias("n"), t.contract_hash(F.lit("v1"), F.col("url"), n.cast("string")).alias("contract"), t.short_id(F.sha2("html", 256)).alias("short"))


@R.query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_k(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").try_cast("long").alias("k"))


@R.query("""SELECT event_id, CASE WHEN us < 0 THEN '-' ELSE '' END || printf('%02d:%02d:%02d.%03d', ms // 3600000, ms // 60000 % 60, ms // 1000 % 60, ms % 1000) AS shown
    FROM (SELECT event_id, us, abs(us) // 1000 AS ms FROM (SELECT event_id, (event_id * 7919 - 30000000) * 1237 AS us FROM events))""")
def format_timeline(spark, sf_dir):
    us = (F.col("event_id") * 7919 - 30_000_000) * 1237
    return table(spark, sf_dir, "events").select("event_id", timeline.format_timeline(us).alias("shown"))


@R.query("SELECT event_id, 5000 + greatest(0, least(event_id * 13 - 900, 60000)) AS source_us FROM events")
def affine_time(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", timeline.mapped_time(F.col("event_id") * 13 - 900, F.lit(60_000).cast("long"), F.lit(5_000).cast("long")).alias("source_us"))


@R.query("SELECT o_orderkey, CAST(round(o_orderkey * 1000000 / 16000.0) AS BIGINT) AS us FROM orders")
def samples_to_us(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", timeline.samples_to_us(F.col("o_orderkey")).alias("us"))


@R.query("SELECT l_orderkey, l_partkey, l_orderkey // gcd(l_orderkey, l_partkey) AS num, l_partkey // gcd(l_orderkey, l_partkey) AS den FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem WHERE l_orderkey > 0 AND l_partkey > 0)")
def rational_reduced(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").where("l_orderkey > 0 and l_partkey > 0").select("l_orderkey", "l_partkey").distinct()
    rows = rows.select("l_orderkey", "l_partkey", timeline.reduced(F.col("l_orderkey"), F.col("l_partkey")).alias("r"))
    return rows.select("l_orderkey", "l_partkey", "r.num", "r.den")


@R.query("""WITH p AS (SELECT page_id, rtrim(lower(CASE WHEN page_id % 5 = 0 THEN regexp_extract(url, '^[^/]*//[^/]*/[^/]*') ELSE url END), '/') AS u FROM pages)
    SELECT a.page_id AS outer_id, b.page_id AS inner_id FROM p a JOIN p b ON a.page_id <> b.page_id AND starts_with(b.u || '/', a.u || '/') AND (a.u <> b.u OR a.page_id < b.page_id)""")
def prefix_overlap(spark, sf_dir):
    root = F.when(F.col("page_id") % 5 == 0, F.regexp_extract("url", "^[^/]*//[^/]*/[^/]*", 0)).otherwise(F.col("url"))
    rows = table(spark, sf_dir, "pages").select("page_id", root.alias("path"))
    return relational.overlapping_paths(rows, "page_id", "path").select(F.col("outer").alias("outer_id"), F.col("inner").alias("inner_id"))


@R.query("""WITH p AS (SELECT page_id, rtrim(lower(CASE WHEN page_id % 5 = 0 THEN regexp_extract(url, '^[^/]*//[^/]*/[^/]*') ELSE url END), '/') || '/' AS u FROM pages),
    g AS (SELECT u, min(page_id) AS same FROM p WHERE u IS NOT NULL GROUP BY u),
    o AS (SELECT b.u, arg_max(a.same, length(a.u)) AS outer_id FROM g a JOIN g b ON a.u <> b.u AND starts_with(b.u, a.u) GROUP BY b.u)
    SELECT page_id, same AS same_id, outer_id FROM p JOIN g USING (u) LEFT JOIN o USING (u)""")
def nested_paths(spark, sf_dir):
    root = F.when(F.col("page_id") % 5 == 0, F.regexp_extract("url", "^[^/]*//[^/]*/[^/]*", 0)).otherwise(F.col("url"))
    rows = table(spark, sf_dir, "pages").select("page_id", root.alias("path"))
    return paths.nested(rows, "page_id", "path").select("page_id", F.col("same").alias("same_id"), F.col("outer").alias("outer_id"))


@R.query("SELECT p_partkey, CASE WHEN regexp_matches(h, '^[0-9a-f]{64}$') THEN 1 ELSE 0 END AS ok FROM (SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN upper(sha256(p_name)) ELSE sha256(p_name) END AS h FROM part)")
def is_sha256(spark, sf_dir):
    h = F.when(F.col("p_partkey") % 3 == 0, F.upper(F.sha2("p_name", 256))).otherwise(F.sha2("p_name", 256))
    return table(spark, sf_dir, "part").select("p_partkey", t.is_sha256(h).cast("int").alias("ok"))
