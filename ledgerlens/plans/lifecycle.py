"""Histories of jobs: events stand for updates of processing jobs, users for jobs and profiles, orders for selections."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlens.operators import lifecycle
from ledgerlens.plans.registry import Registry, table

R = Registry()
QUERIES, ORACLE_SQL = R.queries, R.sql

_STATES = {"signup": "Queued", "click": "Running", "view": "Running", "purchase": "Completed", "error": "Failed"}
_STATE_SQL = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _STATES.items()) + " END"


def _updates(spark, sf_dir, **other):
    state = F.element_at(F.create_map(*[F.lit(x) for kv in {**_STATES, **other}.items() for x in kv]), F.col("event_type"))
    return table(spark, sf_dir, "events").select("event_id", "user_id", "ts", state.alias("state"))


@R.query(f"""
    WITH u AS (SELECT event_id, user_id, date_trunc('day', ts) AS d, ts, {_STATE_SQL} AS state FROM events),
    r AS (SELECT *, last_value(CASE WHEN state IN ('Completed', 'Failed') THEN state END IGNORE NULLS) OVER w AS any_done, first_value(CASE WHEN state IN ('Completed', 'Failed') THEN state END IGNORE NULLS) OVER w AS done,
          count_if(state = 'Running') OVER w AS ran, count(*) OVER w AS n FROM u WINDOW w AS (PARTITION BY user_id, d ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
    SELECT event_id, user_id, state, coalesce(done, 'Running') AS before FROM r WHERE done IS NOT NULL OR (state = 'Queued' AND ran > 0)""")
def job_transitions(spark, sf_dir):
    rows = _updates(spark, sf_dir).withColumn("day", F.date_trunc("day", "ts"))
    found = lifecycle.illegal_transitions(rows, ["user_id", "day"], ["ts", "event_id"], "state", chunk=F.date_trunc("hour", "ts"))
    return found.select("event_id", "user_id", "state", "before")


_ENDINGS_SQL = """
    u AS (SELECT user_id, ts, event_id, CASE event_type WHEN 'signup' THEN 0 WHEN 'purchase' THEN 2 ELSE 1 END AS rank FROM events),
    r AS (SELECT *, coalesce(count_if(rank = 2) OVER w, 0) = 0 AND NOT (rank = 0 AND coalesce(count_if(rank = 1) OVER w, 0) > 0) AS legal, coalesce(count_if(rank = 2) OVER w, 0) = 0 AS alive FROM u
          WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    p AS (SELECT *, max(CASE WHEN legal THEN ts END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM r),
    s AS (SELECT *, alive AND coalesce(ts > prev + INTERVAL 1 DAY, false) AS stopped FROM p),
    e AS (SELECT user_id, min((ts, event_id)) AS k, arg_min(stopped, (ts, event_id)) AS stopped, arg_min(CASE WHEN stopped THEN prev + INTERVAL 1 DAY ELSE ts END, (ts, event_id)) AS fin
          FROM s WHERE stopped OR (legal AND rank = 2) GROUP BY user_id),
    l AS (SELECT user_id, max(ts) FILTER (legal) AS last FROM s GROUP BY user_id),
    closed AS (SELECT user_id, fin AS ts, CASE WHEN stopped THEN 'Interrupted' ELSE 'Completed' END AS kind FROM e
               UNION ALL SELECT user_id, last + INTERVAL 1 DAY, 'Interrupted' FROM l WHERE user_id NOT IN (SELECT user_id FROM e) AND last + INTERVAL 1 DAY < (SELECT max(ts) FROM events))"""


def _job_endings(spark, sf_dir):
    rows = _updates(spark, sf_dir, error="Running")
    return lifecycle.endings(rows, ["user_id"], "ts", ["event_id"], "state", gap="1 DAY", chunk=F.date_trunc("day", "ts"))


@R.query(f"""WITH {_ENDINGS_SQL}
    SELECT user_id, ts, kind FROM closed
    UNION ALL SELECT s.user_id, s.ts, CASE WHEN e.user_id IS NOT NULL AND ((s.ts, s.event_id) > e.k OR ((s.ts, s.event_id) = e.k AND e.stopped)) THEN 'late' ELSE 'illegal' END
    FROM s LEFT JOIN e USING (user_id) WHERE NOT legal OR (e.user_id IS NOT NULL AND ((s.ts, s.event_id) > e.k OR ((s.ts, s.event_id) = e.k AND e.stopped)))""")
def job_endings(spark, sf_dir):
    return _job_endings(spark, sf_dir)


@R.query(f"""WITH {_ENDINGS_SQL},
    o AS (SELECT o_custkey, count(*) AS active, count_if(o_orderstatus = 'P') AS awaiting, count_if(o_orderstatus = 'O') AS validated, count_if(o_orderstatus = 'F') AS prepared, count_if(o_orderstatus = 'F' AND o_totalprice > 0) AS results,
          count_if(o_orderpriority LIKE '1%' AND o_orderstatus <> 'F') AS odd, count_if(o_orderpriority LIKE '1%') AS observed FROM orders GROUP BY 1)
    SELECT user_id, CASE WHEN user_id % 3 = 0 OR o_custkey IS NULL THEN 'Draft' WHEN awaiting > 0 THEN 'MediaIngestedAwaitingProbe' WHEN validated > 0 AND validated + prepared = active THEN 'MediaValidated'
           WHEN prepared = active AND results = active THEN CASE WHEN odd > 0 THEN 'Inconsistent' WHEN observed = active THEN 'AudioObserved' ELSE 'MediaPrepared' END ELSE 'Inconsistent' END AS readiness
    FROM closed LEFT JOIN o ON o_custkey = user_id WHERE kind = 'Interrupted'""")
def recovered_readiness(spark, sf_dir):
    state = F.when(F.col("o_orderstatus") == "P", "AwaitingProbe").when(F.col("o_orderstatus") == "O", "Validated").otherwise("Prepared")
    first = F.col("o_orderpriority").startswith("1")
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("user_id"), state.alias("state"), F.lit(True).alias("linked"), ((F.col("o_orderstatus") == "F") & (F.col("o_totalprice") > 0)).alias("has_result"), first.alias("observed"), F.lit(False).alias("failed"))
    ended = _job_endings(spark, sf_dir).where(F.col("kind") == lifecycle.INTERRUPTED)
    return lifecycle.readiness_after(ended, rows, "user_id", F.col("user_id") % 3 != 0, state="state", linked="linked", has_result="has_result", observed="observed", observation_failed="failed")
