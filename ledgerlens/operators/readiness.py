"""Readiness of a catalogue: one conditional roll-up over a left-join chain, then one ordered decision."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.operators.names import fresh

STATES = ("IntegrityFailed", "AwaitingProbe", "ValidationFailed", "PreprocessingFailed", "Validated", "Prepared")


def rollup(selections: DataFrame, by: list[str], state: str, linked: str, has_result: str, observed: str, observation_failed: str) -> DataFrame:
    """Counts per group over active selections, each already joined 1:1 with its asset and results; nulls count as no.

    unexpected_*: results of an asset that is known and not Prepared. conflicting: both observed and failed.
    """
    yes = lambda c: F.coalesce(c, F.lit(False))
    counts = [F.count_if(yes(F.col(state) == s)).alias(f"n_{s}") for s in STATES]
    return selections.groupBy(*by).agg(
        F.count("*").alias("active"),
        F.count_if(~yes(F.col(linked))).alias("unlinked"),
        *counts,
        F.count_if(yes(F.col(state) == "Prepared") & yes(F.col(has_result))).alias("prepared_results"),
        F.count_if(yes(F.col(state) != "Prepared") & yes(F.col(has_result))).alias("unexpected_prepared"),
        F.count_if(yes(F.col(state) == "Prepared") & yes(F.col(observed))).alias("observed"),
        F.count_if(yes(F.col(state) != "Prepared") & yes(F.col(observed))).alias("unexpected_observed"),
        F.count_if(yes(F.col(observed)) & yes(F.col(observation_failed))).alias("conflicting"),
        F.count_if(yes(F.col(observation_failed))).alias("observation_failed"),
    )


def decision() -> Column:
    """The first rule that holds names the readiness; integrity outranks all, Inconsistent is the last resort."""
    n = lambda s: F.col(f"n_{s}")
    return (
        F.when(n("IntegrityFailed") > 0, "MediaIntegrityFailed")
        .when((F.col("active") == 0) | (F.col("unlinked") > 0), "Draft")
        .when(n("AwaitingProbe") > 0, "MediaIngestedAwaitingProbe")
        .when(n("ValidationFailed") > 0, "MediaValidationFailed")
        .when(n("PreprocessingFailed") > 0, "MediaPreprocessingFailed")
        .when((n("Validated") > 0) & (n("Validated") + n("Prepared") == F.col("active")), "MediaValidated")
        .when(
            (n("Prepared") == F.col("active")) & (F.col("prepared_results") == F.col("active")) & (F.col("unexpected_prepared") == 0),
            F.when(F.col("unexpected_observed") + F.col("conflicting") > 0, "Inconsistent").when(F.col("observation_failed") > 0, "AudioObservationFailed").when(F.col("observed") == F.col("active"), "AudioObserved").otherwise("MediaPrepared"),
        )
        .otherwise("Inconsistent")
    )


def active(selections: DataFrame, archived: str) -> DataFrame:
    """Selections that are not archived; a null mark counts as not."""
    return selections.where(~F.coalesce(F.col(archived), F.lit(False)))


def chained(selections: DataFrame, assets: DataFrame, prepared: DataFrame, observed: DataFrame, link: str, key: str) -> DataFrame:
    """Selections with their asset (left, by link), whether it has a prepared result and whether an observation.

    The three right sides have one row a key at most, so the count of selections stays.
    """
    asset, ready, seen = (fresh(n, selections, assets) for n in ("_asset", "_has_result", "_observed"))
    own = assets.withColumnRenamed(key, asset)
    mark = lambda d, k, n: d.select(F.col(key).alias(k), F.lit(True).alias(n))
    rows = selections.join(own, F.col(link) == F.col(asset), "left")
    rows = rows.join(mark(prepared, ready, "has_result"), F.col(asset) == F.col(ready), "left").join(mark(observed, seen, "observed"), F.col(asset) == F.col(seen), "left")
    return rows.drop(asset, ready, seen)
