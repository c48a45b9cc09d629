"""Job history, sample facts, updates and data-quality queries over events, orders and lineitems."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ledgerlens.operators import quality, relational, sequence
from ledgerlens.plans.registry import Registry, table

R = Registry()
QUERIES, ORACLE_SQL = R.queries, R.sql

_SAMPLE = "CAST(round(value * 100) AS INTEGER) - 3500"


def _samples(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_type", "user_id", "ts", "event_id", (F.round(F.col("value") * 100).cast("int") - 3500).alias("sample"))
    return rows


@R.query(f"""
    WITH s AS (SELECT event_type, {_SAMPLE} AS x, lag({_SAMPLE}) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS p FROM events)
    SELECT event_type, count(x) AS n, CAST(round(count(x) * 1000000 / 16000.0) AS BIGINT) AS duration_us, min(x) AS minimum, max(x) AS maximum, CAST(max(abs(x)) AS BIGINT) AS peak, count_if(x > 0) AS positive, count_if(x < 0) AS negative,
           count_if(x = 0) AS zero, count_if(x = 32767) AS full_high, count_if(x = -32768) AS full_low, count_if(sign(p) * sign(x) < 0) AS crossings,
           CAST(sum(CAST(x AS HUGEINT)) AS VARCHAR) AS total, CAST(sum(CAST(x AS HUGEINT) * x) AS VARCHAR) AS total_squares FROM s GROUP BY event_type""")
def pcm_facts(spark, sf_dir):
    return sequence.facts(_samples(spark, sf_dir), ["event_type"], ["ts", "event_id"], "sample", chunk=F.date_trunc("hour", "ts"))


@R.query(f"SELECT user_id, count_if(sign(p) * sign(x) < 0) AS crossings FROM (SELECT user_id, {_SAMPLE} AS x, lag({_SAMPLE}) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events) GROUP BY user_id")
def sign_crossing(spark, sf_dir):
    return sequence.facts(_samples(spark, sf_dir), ["user_id"], ["ts", "event_id"], "sample", chunk=F.date_trunc("day", "ts")).select("user_id", "crossings")


@R.query(f"""WITH s AS (SELECT user_id, {_SAMPLE} AS x, lag({_SAMPLE}) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events),
    f AS (SELECT user_id, count(x) AS n, min(x) AS lo, max(x) AS hi, count_if(x > 0) AS pos, count_if(x < 0) AS neg, count_if(x = 0) AS zero, count_if(sign(p) * sign(x) < 0) AS crossings, sum(x) AS total, sum(x * x) AS squares FROM s GROUP BY 1)
    SELECT count_if(NOT (lo >= -32768 AND lo <= hi AND hi <= 32767 AND pos + neg + zero = n AND (pos = 0) = (hi <= 0) AND (neg = 0) = (lo >= 0) AND crossings < n AND total BETWEEN lo * n AND hi * n
           AND squares BETWEEN greatest(lo * lo, hi * hi) AND greatest(lo * lo, hi * hi) * n)) AS broken, count(*) AS sequences FROM f""")
def dq_sample_facts(spark, sf_dir):
    rows = sequence.facts(_samples(spark, sf_dir), ["user_id"], ["ts", "event_id"], "sample", chunk=F.date_trunc("day", "ts"))
    broken = sequence.violations(rows).groupBy("user_id").agg(F.count("*").alias("b"))
    return rows.join(broken, "user_id", "left").agg(F.count("b").alias("broken"), F.count("*").alias("sequences"))


@R.query("SELECT event_id, user_id, value, p AS previous FROM (SELECT *, lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events) WHERE value < p")
def monotonic_check(spark, sf_dir):
    return relational.regressions(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], "value", chunk=F.date_trunc("day", "ts")).select("event_id", "user_id", "value", "previous")


@R.query("SELECT user_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1")
def latest_state(spark, sf_dir):
    return relational.latest(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], "event_type")


@R.query("SELECT user_id, count(*) AS beats FROM events GROUP BY user_id HAVING max(ts) < (SELECT max(ts) FROM events) - INTERVAL 2 DAY")
def stale_active(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    newest = events.agg(F.max("ts").alias("newest"))  # one row
    last = events.groupBy("user_id").agg(F.count("*").alias("beats"), F.max("ts").alias("last"))
    return last.join(F.broadcast(newest), F.col("last") < F.col("newest") - F.expr("INTERVAL 2 DAYS"), "left_semi").select("user_id", "beats")


@R.query("SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS place FROM orders")
def history_desc(spark, sf_dir):
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey"))
    return table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.row_number().over(w).cast("long").alias("place"))


@R.query("SELECT c_custkey, count(*) AS open_jobs FROM customer JOIN orders ON o_custkey = c_custkey WHERE o_orderstatus IN ('O', 'P') GROUP BY 1 HAVING count(*) > 1")
def active_count_probe(spark, sf_dir):
    jobs = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderstatus")
    many = quality.several_active(jobs, "c_custkey", "o_orderstatus", ("O", "P"))
    return many.join(table(spark, sf_dir, "customer").select("c_custkey"), "c_custkey", "left_semi").select("c_custkey", F.col("active_jobs").alias("open_jobs"))


@R.query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' AND o_totalprice > 200000 THEN 'P' ELSE o_orderstatus END AS o_orderstatus FROM orders")
def guarded_update(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    after, _ = relational.guarded_update(rows, (F.col("o_orderstatus") == "O") & (F.col("o_totalprice") > 200000), o_orderstatus=F.lit("P"))
    return after.select("o_orderkey", "o_orderstatus")


@R.query("SELECT count_if(o_orderstatus = 'O' AND o_totalprice > 200000) AS affected FROM orders")
def guarded_update_count(spark, sf_dir):
    rows = table(spark, sf_dir, "orders")
    return relational.guarded_update(rows, (F.col("o_orderstatus") == "O") & (F.col("o_totalprice") > 200000), o_orderstatus=F.lit("P"))[1]


@R.query("SELECT l_orderkey, count(*) AS n FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey AND o_orderstatus = 'F') GROUP BY 1")
def cascade_delete(spark, sf_dir):
    gone = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey").join(gone, "l_orderkey", "left_anti").groupBy("l_orderkey").agg(F.count("*").alias("n"))


@R.query("SELECT o_orderkey, CASE WHEN c_custkey IS NOT NULL THEN o_custkey END AS o_custkey FROM orders LEFT JOIN (SELECT c_custkey FROM customer WHERE c_mktsegment <> 'BUILDING') c ON c_custkey = o_custkey")
def set_null_cascade(spark, sf_dir):
    kept = table(spark, sf_dir, "customer").where("c_mktsegment <> 'BUILDING'")
    return relational.set_null_cascade(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), kept, "o_custkey", "c_custkey")


@R.query("""SELECT o_custkey, o_orderkey, o_totalprice FROM orders WHERE o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority LIKE '1%')
    UNION ALL SELECT o_custkey, o_orderkey, o_totalprice FROM orders WHERE o_orderpriority LIKE '1%'""")
def replace_children(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice", "o_orderpriority")
    new = orders.where("o_orderpriority LIKE '1%'").drop("o_orderpriority")
    return relational.replace_children(orders.drop("o_orderpriority"), new, "o_custkey")


@R.query("SELECT c_custkey, 'name' AS rule FROM customer WHERE NOT (trim(c_name) <> '' AND length(c_name) <= 200) UNION ALL SELECT c_custkey, 'balance' FROM customer WHERE NOT (c_acctbal >= 0) UNION ALL SELECT c_custkey, 'segment' FROM customer WHERE c_mktsegment NOT IN ('BUILDING', 'MACHINERY', 'AUTOMOBILE')")
def draft_rules(spark, sf_dir):
    rules = {"name": (F.trim("c_name") != "") & (F.length("c_name") <= 200), "balance": F.col("c_acctbal") >= 0, "segment": F.col("c_mktsegment").isin("BUILDING", "MACHINERY", "AUTOMOBILE")}
    return quality.violations(table(spark, sf_dir, "customer"), "c_custkey", rules)


@R.query("SELECT p_partkey FROM (SELECT p_partkey, count(*) OVER (PARTITION BY lower(p_name)) AS n FROM part) WHERE n > 1")
def unique_ci(spark, sf_dir):
    return quality.repeated(table(spark, sf_dir, "part").select("p_partkey", "p_name"), F.lower("p_name")).select("p_partkey")


@R.query("SELECT o_orderkey, o_custkey, row_number() OVER w AS done, count(*) OVER (PARTITION BY o_custkey) AS total, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) OVER w AS BIGINT) AS cumulative FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING)")
def item_progress(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").withColumn("cents", F.round(F.col("o_totalprice") * 100).cast("long"))
    out = relational.running_progress(rows, ["o_custkey"], ["o_orderdate", "o_orderkey"], "cents", chunk=F.date_trunc("month", "o_orderdate"))
    return out.select("o_orderkey", "o_custkey", F.col("done").cast("long").alias("done"), "total", "cumulative")


@R.query("SELECT event_id FROM (SELECT event_id, (ts, event_id) AS k, min(CASE WHEN event_type = 'purchase' THEN (ts, event_id) END) OVER (PARTITION BY user_id) AS f FROM events) WHERE k > f")
def late_ignored(spark, sf_dir):
    return quality.after_terminal(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "event_type", ("purchase",)).select("event_id")


@R.query("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O' AND o_totalprice > 200000")
def immutable_changes(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    after, _ = relational.guarded_update(rows, (F.col("o_orderstatus") == "O") & (F.col("o_totalprice") > 200000), o_orderstatus=F.lit("P"))
    return relational.changed_immutable(rows, after, "o_orderkey")


@R.query("""SELECT kind, name, row_number() OVER (ORDER BY kind, id) - 1 AS ordinal FROM
    (SELECT 0 AS kind, c_custkey AS id, c_name AS name FROM customer UNION ALL SELECT 1, s_suppkey, s_name FROM supplier)""")
def concat_ordinal(spark, sf_dir):
    both = table(spark, sf_dir, "customer").select(F.lit(0).alias("kind"), F.col("c_custkey").alias("id"), F.col("c_name").alias("name")).unionByName(table(spark, sf_dir, "supplier").select(F.lit(1).alias("kind"), F.col("s_suppkey").alias("id"), F.col("s_name").alias("name")))
    # running numbers in two levels: offsets of key ranges, then places within a range
    span = both.withColumn("part", F.floor(F.col("id") / 4096))
    before = Window.orderBy("kind", "part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = span.groupBy("kind", "part").agg(F.count("*").alias("n")).select("kind", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    place = F.row_number().over(Window.partitionBy("kind", "part").orderBy("id")) - 1
    return span.withColumn("place", place).join(offsets, ["kind", "part"]).select("kind", "name", (F.col("offset") + F.col("place")).alias("ordinal"))


@R.query("SELECT o_custkey, coalesce(max(CASE WHEN o_orderstatus = 'F' THEN o_orderkey END), 0) AS last_done FROM orders GROUP BY 1")
def max_default(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.coalesce(F.max(F.when(F.col("o_orderstatus") == "F", F.col("o_orderkey"))), F.lit(0)).alias("last_done"))


@R.query("SELECT o_custkey, string_agg(DISTINCT o_orderpriority, ',' ORDER BY o_orderpriority) AS codes FROM orders WHERE o_orderstatus <> 'F' GROUP BY 1")
def failure_codes(spark, sf_dir):
    return table(spark, sf_dir, "orders").where("o_orderstatus <> 'F'").groupBy("o_custkey").agg(F.array_join(F.array_sort(F.collect_set("o_orderpriority")), ",").alias("codes"))


@R.query("SELECT l_suppkey, CAST(sum(CAST(round(l_quantity) AS BIGINT)) AS BIGINT) AS total FROM lineitem GROUP BY 1")
def checked_sum(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.sum(F.round("l_quantity").cast("long")).alias("total"))


@R.query("SELECT DISTINCT o_orderpriority, o_orderstatus FROM orders")
def distinct_conditions(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderpriority", "o_orderstatus").distinct()


@R.query("SELECT o_custkey, bool_or(o_orderstatus = 'P') AS any_partial, bool_and(o_orderstatus = 'F') AS all_done FROM orders GROUP BY 1")
def any_all(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.bool_or(F.col("o_orderstatus") == "P").alias("any_partial"), F.bool_and(F.col("o_orderstatus") == "F").alias("all_done"))
