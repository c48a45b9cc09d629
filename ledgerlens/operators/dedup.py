"""Content-hash dedup, conflicts and dependency groups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def content_groups(rows: DataFrame, content: str, key: str, label: str) -> DataFrame:
    """Per content hash: the smallest key, how many rows, how many labels."""
    return rows.groupBy(F.sha2(F.col(content), 256).alias("content_hash")).agg(F.min(key).alias("first_key"), F.count("*").alias("copies"), F.countDistinct(label).alias("labels"))


def conflicts(rows: DataFrame, key: str, label: str) -> DataFrame:
    """Keys under more than one label, with the sorted distinct labels."""
    seen = rows.where(F.col(label).isNotNull()).groupBy(key).agg(F.array_sort(F.collect_set(label)).alias("labels"))
    return seen.where(F.size("labels") > 1)


def duplicates(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def first_seen_labels(rows: DataFrame, by: str, label: str, order: list[str], blank: str) -> DataFrame:
    """Distinct labels per key in the order of their first row; blank or missing ones under the given name."""
    named = F.when(F.trim(F.col(label)) != "", F.col(label)).otherwise(F.lit(blank))
    firsts = rows.groupBy(by, named.alias("_l")).agg(F.min(F.struct(*order)).alias("_at"))  # one row a label before any list
    return firsts.groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct("_at", "_l"))), lambda x: x["_l"]).alias("labels"))
