"""Exact integer facts over ordered samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.functions.timeline import samples_to_us

FULL_LOW, FULL_HIGH = -32768, 32767


def facts(samples: DataFrame, by: list[str], order: list[str], sample: str, rate: int = 16_000, chunk: Column | None = None) -> DataFrame:
    """Counts, extremes, crossings and exact sums per sequence; sums as text of whole decimals.

    A crossing is two directly adjacent samples of opposite sign; a zero between them cancels it. A null sample is
    counted nowhere and takes part in no crossing; a sequence of nulls has null extremes and sums of 0; an empty table
    gives no rows. Rows equal in order stand side by side in any order. chunk is an expression that never falls along
    the order: a long sequence is then sorted chunk by chunk, and only the ends of chunks meet in one task.
    """
    x = F.col(sample)
    exact = x.cast("decimal(10,0)")
    opposite = lambda a, b: F.coalesce(F.signum(a) * F.signum(b) < 0, F.lit(False))
    rows = samples.withColumn("_chunk", F.lit(0) if chunk is None else chunk)
    rows = rows.withColumn("_cross", opposite(F.lag(sample).over(Window.partitionBy(*by, "_chunk").orderBy(*order)), x))
    parts = rows.groupBy(*by, "_chunk").agg(
        F.count(sample).alias("n"),
        F.min(x).alias("minimum"),
        F.max(x).alias("maximum"),
        F.max(F.abs(x.cast("long"))).alias("peak"),
        F.count_if(x > 0).alias("positive"),
        F.count_if(x < 0).alias("negative"),
        F.count_if(x == 0).alias("zero"),
        F.count_if(x == FULL_HIGH).alias("full_high"),
        F.count_if(x == FULL_LOW).alias("full_low"),
        F.count_if("_cross").alias("crossings"),
        F.sum(exact).cast("decimal(38,0)").alias("total"),
        F.sum((exact * exact).cast("decimal(28,0)")).cast("decimal(38,0)").alias("total_squares"),
        F.min_by(x, F.struct(*order)).alias("_first"),
        F.max_by(x, F.struct(*order)).alias("_last"),
    )
    border = opposite(F.lag("_last").over(Window.partitionBy(*by).orderBy("_chunk")), F.col("_first"))
    summed = lambda c: F.sum(c).cast("long").alias(c)
    whole = lambda c: F.coalesce(F.sum(c).cast("decimal(38,0)"), F.lit(0)).cast("string").alias(c)
    return parts.withColumn("crossings", F.col("crossings") + border.cast("long")).groupBy(*by).agg(
        summed("n"), samples_to_us(F.sum("n"), rate).alias("duration_us"), F.min("minimum").alias("minimum"), F.max("maximum").alias("maximum"), F.max("peak").alias("peak"),
        *map(summed, ("positive", "negative", "zero", "full_high", "full_low", "crossings")), whole("total"), whole("total_squares"),
    )


def violations(rows: DataFrame) -> DataFrame:
    """Facts with the names of the algebraic rules they break, as rows (all columns, rule)."""
    total, squares = F.col("total").cast("decimal(38,0)"), F.col("total_squares").cast("decimal(38,0)")
    big = lambda c: F.col(c).cast("decimal(19,0)")
    rules = {
        "geometry_positive": (F.col("n") > 0) & (F.col("duration_us") > 0),
        "extremes_ordered": (F.col("minimum") >= FULL_LOW) & (F.col("minimum") <= F.col("maximum")) & (F.col("maximum") <= FULL_HIGH),
        "counts_not_negative": F.least("positive", "negative", "zero", "full_high", "full_low", "crossings") >= 0,
        "zero_matches_extremes": F.when(F.col("zero") > 0, (F.col("minimum") <= 0) & (F.col("maximum") >= 0)).otherwise((F.col("minimum") != 0) & (F.col("maximum") != 0)),
        "peak_is_largest_magnitude": F.col("peak") == F.greatest(F.abs(F.col("minimum").cast("long")), F.abs(F.col("maximum").cast("long"))),
        "signs_sum_to_count": F.col("positive") + F.col("negative") + F.col("zero") == F.col("n"),
        "positive_matches_maximum": (F.col("positive") == 0) == (F.col("maximum") <= 0),
        "negative_matches_minimum": (F.col("negative") == 0) == (F.col("minimum") >= 0),
        "full_high_within_positive": (F.col("full_high") <= F.col("positive")) & ((F.col("full_high") > 0) == (F.col("maximum") == FULL_HIGH)),
        "full_low_within_negative": (F.col("full_low") <= F.col("negative")) & ((F.col("full_low") > 0) == (F.col("minimum") == FULL_LOW)),
        "crossings_below_count": F.col("crossings") < F.col("n"),
        "total_between_extremes": (big("minimum") * big("n") <= total) & (total <= big("maximum") * big("n")),
        "squares_between_peaks": (big("peak") * big("peak") <= squares) & (squares <= big("peak") * big("peak") * F.col("n").cast("decimal(10,0)")),
    }
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]))
    return rows.withColumn("rule", F.explode(broken))
