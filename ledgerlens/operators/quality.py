"""Declarative data-quality rules: rows in, one row per broken rule out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.operators.names import fresh


def violations(rows: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """key, rule for each rule that is false or unknown."""
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]))
    return rows.select(key, F.explode(broken).alias("rule"))


def repeated(rows: DataFrame, value: Column) -> DataFrame:
    """Rows whose value, already folded, occurs more than once. Counts first and joins after, so a hot value spreads."""
    v = fresh("_v", rows)
    keyed = rows.withColumn(v, value)
    many = keyed.groupBy(v).agg(F.count("*").alias("_n")).where(F.col(v).isNotNull() & (F.col("_n") > 1)).select(v)
    return keyed.join(many, v, "left_semi").drop(v)


def several_active(jobs: DataFrame, by: str, state: str, active: tuple[str, ...] = ("Queued", "Running")) -> DataFrame:
    return jobs.where(F.col(state).isin(*active)).groupBy(by).agg(F.count("*").alias("active_jobs")).where("active_jobs > 1")


def exactly_one(result: Column, failure: Column) -> Column:
    return result.isNotNull() != failure.isNotNull()


def progress_ok(done: Column, total: Column) -> Column:
    return (done >= 0) & (done <= total)


def snapshot_matches(rows: DataFrame, pairs: dict[str, str]) -> Column:
    """Null-safe equality of every pair of columns."""
    out = F.lit(True)
    for a, b in pairs.items():
        out = out & F.col(a).eqNullSafe(F.col(b))
    return out


def after_terminal(events: DataFrame, by: str, order: list[str], state: str, terminal: tuple[str, ...]) -> DataFrame:
    """Events that come later than the first terminal one of their job; they are to be ignored.

    Null jobs are one job; a null state is not terminal; events equal in order to the terminal one are not later. One row
    a job is joined, so that the events of a hot job spread over tasks.
    """
    job, start = fresh("_by", events), fresh("_first", events)
    first = events.where(F.col(state).isin(*terminal)).groupBy(F.col(by).alias(job)).agg(F.min(F.struct(*order)).alias(start))
    return events.join(first, F.col(by).eqNullSafe(F.col(job))).where(F.struct(*order) > F.col(start)).drop(job, start)
