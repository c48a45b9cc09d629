"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of anything but ASCII white space (fixed by the contracts).
WORD_GAP = r"[\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder name below spark.checkpoint.dir, which the driver and all executors share.

    Local runs that name none get a temporary folder for the session; on a cluster it must be named, since executors
    do not see each other's disks.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="ledgerlens-")
        spark.conf.set("spark.checkpoint.dir", base)
    path = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _made.append(path)
    return path


#: Folders given out by shared_dir and not removed yet.
_made: list[str] = []


def removed(spark: SparkSession, paths: list[str]) -> None:
    """Delete folders in the shared store; those that are gone already are passed over."""
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
        if path in _made:
            _made.remove(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Removes the intermediate tables written inside when it ends; what is still needed must be outside them by then."""
    before = len(_made)
    try:
        yield
    finally:
        removed(spark, _made[before:])


def mark_of(text: Column, id_: Column) -> Column:
    """16 bytes that tell rows of one id, or of none, apart by their text: two 64-bit hashes of different seeds."""
    half = lambda seed: F.lpad(F.hex(F.xxhash64(F.lit(seed), text, id_.isNull())), 16, "0")
    return F.unhex(F.concat(half(1), half(2)))


#: Rows of an Arrow batch, where the session leaves Spark's default: texts may be long, and a batch is held several times over.
BATCH_KEY, BATCH_DEFAULT, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", "10000", "1000"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder, read again: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = shared_dir(spark, name)
    if spark.conf.get(BATCH_KEY) == BATCH_DEFAULT:
        spark.conf.set(BATCH_KEY, BATCH_ROWS)  # once a session, so that parallel stages do not undo each other's setting
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Numbers that a pre-filter broadcasts at most.
BUCKETS = 1 << 20


def screened(rows: DataFrame, keys: list[str], other: DataFrame, how: str = "left_semi") -> DataFrame:
    """rows whose keys may be (left_semi) or surely are not (left_anti) in other, which is a written table.

    Compares hashes of the keys, taken modulo BUCKETS where other has more of them, so at most BUCKETS numbers are
    broadcast. An exact join may follow; it then shuffles few rows.
    """
    mark = F.xxhash64(*keys)
    marks = other.select(mark.alias("_mark")).distinct()
    if marks.limit(BUCKETS + 1).count() > BUCKETS:
        mark = F.pmod(mark, F.lit(BUCKETS))
        marks = other.select(mark.alias("_mark")).distinct()
    return rows.withColumn("_m", mark).join(F.broadcast(marks), F.col("_m") == F.col("_mark"), how).drop("_m")


def words_of(text: Column) -> Column:
    """Array of the words of a text by ASCII white space; empty for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), WORD_GAP, -1), lambda w: w != "")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
