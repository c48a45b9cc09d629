"""Whole tables: deletes along references, and comparisons by digests."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlens.operators import cascade, digests
from ledgerlens.operators.cascade import SET_NULL, Reference
from ledgerlens.plans.registry import Registry, table

R = Registry()
QUERIES, ORACLE_SQL = R.queries, R.sql

_TABLES = {"region": ["r_regionkey", "r_name"], "nation": ["n_nationkey", "n_regionkey"], "customer": ["c_custkey", "c_nationkey"], "supplier": ["s_suppkey", "s_nationkey"], "orders": ["o_orderkey", "o_custkey"], "lineitem": ["l_linenumber", "l_orderkey", "l_suppkey"]}
_REFERENCES = [
    Reference("nation", "n_regionkey", "region"),
    Reference("customer", "c_nationkey", "nation"),
    Reference("supplier", "s_nationkey", "nation", SET_NULL),
    Reference("orders", "o_custkey", "customer"),
    Reference("lineitem", "l_orderkey", "orders"),
]


@R.query("""WITH r AS (SELECT r_regionkey FROM region WHERE r_name = 'ASIA'), n AS (SELECT n_nationkey FROM nation WHERE n_regionkey IN (FROM r)), c AS (SELECT c_custkey FROM customer WHERE c_nationkey IN (FROM n)),
    o AS (SELECT o_orderkey FROM orders WHERE o_custkey IN (FROM c)), l AS (SELECT l_orderkey FROM lineitem WHERE l_orderkey IN (FROM o)), s AS (SELECT s_suppkey FROM supplier WHERE s_nationkey IN (FROM n)),
    k AS (SELECT 'region' AS name, (SELECT count(*) FROM region) AS n, (SELECT count(*) FROM r) AS deleted, 0::BIGINT AS nulled UNION ALL SELECT 'nation', (SELECT count(*) FROM nation), (SELECT count(*) FROM n), 0
          UNION ALL SELECT 'customer', (SELECT count(*) FROM customer), (SELECT count(*) FROM c), 0 UNION ALL SELECT 'orders', (SELECT count(*) FROM orders), (SELECT count(*) FROM o), 0
          UNION ALL SELECT 'lineitem', (SELECT count(*) FROM lineitem), (SELECT count(*) FROM l), 0 UNION ALL SELECT 'supplier', (SELECT count(*) FROM supplier), 0, (SELECT count(*) FROM s))
    SELECT name, n - deleted AS kept, deleted, nulled FROM k""")
def cascade_chain(spark, sf_dir):
    tables = {t: table(spark, sf_dir, t).select(*columns) for t, columns in _TABLES.items()}
    roots = {"region": tables["region"].where("r_name = 'ASIA'").select(F.col("r_regionkey").alias("key"))}
    out = cascade.delete(tables, {t: columns[0] for t, columns in _TABLES.items()}, _REFERENCES, roots)
    return out.counts.withColumnRenamed("table", "name")


@R.query("""SELECT k, 'only_expected' AS side FROM (SELECT c_custkey AS k FROM customer WHERE c_mktsegment <> 'BUILDING' EXCEPT SELECT o_custkey FROM orders WHERE o_orderpriority LIKE '1%')
    UNION ALL SELECT k, 'only_actual' FROM (SELECT o_custkey AS k FROM orders WHERE o_orderpriority LIKE '1%' EXCEPT SELECT c_custkey FROM customer WHERE c_mktsegment <> 'BUILDING')""")
def set_digests(spark, sf_dir):
    expected = table(spark, sf_dir, "customer").where("c_mktsegment <> 'BUILDING'").select(F.col("c_custkey").alias("k"))
    return digests.set_difference(expected, table(spark, sf_dir, "orders").where("o_orderpriority LIKE '1%'").select(F.col("o_custkey").alias("k")), ["k"])


@R.query("""SELECT o_orderkey, CASE WHEN o_orderkey % 97 = 0 THEN 'removed' ELSE 'changed' END AS kind FROM orders WHERE o_orderkey % 97 = 0 OR (o_orderstatus = 'O' AND o_totalprice > 250000)
    UNION ALL SELECT o_orderkey + 1000000000000, 'added' FROM orders WHERE o_orderkey % 89 = 0""")
def immutable_digests(spark, sf_dir):
    old = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    status = F.when((F.col("o_orderstatus") == "O") & (F.col("o_totalprice") > 250000), "P").otherwise(F.col("o_orderstatus"))
    new = old.where("o_orderkey % 97 <> 0").withColumn("o_orderstatus", status)
    new = new.unionByName(old.where("o_orderkey % 89 = 0").withColumn("o_orderkey", F.col("o_orderkey") + 1_000_000_000_000))
    return digests.changes(old, new, "o_orderkey")
