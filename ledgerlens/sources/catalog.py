"""Catalogue rows as text: those that do not parse are set apart and counted, never fail the scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def locators(rows: DataFrame, id_: str, added: str, state: str, states: tuple[str, ...]) -> DataFrame:
    """rows with valid: the id is a UUID, the time parses and the state is known (in its own case). Nulls are not valid."""
    uuid = F.col(id_).rlike(r"^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}\z")
    ok: Column = uuid & F.try_to_timestamp(added).isNotNull() & F.col(state).isin(*states)
    return rows.withColumn("valid", F.coalesce(ok, F.lit(False)))


def scanned(rows: DataFrame, id_: str, added: str, state: str, states: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """(valid rows, one row with the invalid count)."""
    marked = locators(rows, id_, added, state, states)
    return marked.where("valid").drop("valid"), marked.agg(F.count_if(~F.col("valid")).alias("invalid"))


def decoded(rows: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """rows with broken, the sorted names of the rules they break; rows without any decode cleanly."""
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in sorted(rules.items())]))
    return rows.select(key, broken.alias("broken"))
