"""Crash reconciliation: what each journal left behind, decided from three facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def outcome(committed: Column, published: Column, staged: Column) -> Column:
    """committed: the store knows the result; published, staged: its folder is at the final or the staging place."""
    c, p, s = (F.coalesce(x, F.lit(False)) for x in (committed, published, staged))
    return F.when(c & p & ~s, "completed").when(c & ~p & s, "rolled_forward").when(~c & p & ~s, "rolled_back").when(~c & ~p, "cleared").otherwise("warning")


def counts(journals: DataFrame, committed: Column, published: Column, staged: Column) -> DataFrame:
    return journals.groupBy(outcome(committed, published, staged).alias("outcome")).agg(F.count("*").alias("n"))
