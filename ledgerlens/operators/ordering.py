"""Order, equality and joins by a collation, in place of folded copies of text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Binary; ASCII letters alike; a reader's order with case ignored, and with accents ignored too.
BINARY, NOCASE, CULTURE, LOOSE = "UTF8_BINARY", "NOCASE", "UNICODE_CI", "UNICODE_CI_AI"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def by(c: Column, collation: str) -> Column:
    """A text that is ordered, grouped and compared by the collation; NOCASE folds A-Z and nothing else."""
    return F.translate(c, UPPER, LOWER) if collation == NOCASE else F.collate(c, collation)


def ordered(rows: DataFrame, texts: list[str], collation: str = CULTURE, last: list[str] | None = None) -> DataFrame:
    """rows in the order of the texts, one after the other, then of last; nulls first. Sorted by range over tasks."""
    return rows.orderBy(*[by(F.col(c), collation) for c in texts], *(last or []))


def numbered(rows: DataFrame, within: list[str], texts: list[str], last: list[str], name: str, collation: str = CULTURE) -> DataFrame:
    """rows with their place (from 1) in the collation's order within each group; last must make the order total."""
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*within).orderBy(*[by(F.col(c), collation) for c in texts], *last)))


def repeated(rows: DataFrame, text: str, collation: str) -> DataFrame:
    """Rows whose text occurs more than once by the collation; nulls never. Counts first, so that a hot text spreads."""
    own = rows.withColumn("__text", by(F.col(text), collation))
    many = own.where("__text is not null").groupBy("__text").agg(F.count("*").alias("__n")).where("__n > 1").select(F.col("__text").alias("__many"))
    return own.join(many, F.col("__text") == F.col("__many"), "left_semi").drop("__text")


def matched(rows: DataFrame, others: DataFrame, text: str, other_text: str, collation: str) -> DataFrame:
    """Inner join of two tables on texts that the collation holds equal; nulls match nothing."""
    return rows.join(others, by(F.col(text), collation) == by(F.col(other_text), collation))
