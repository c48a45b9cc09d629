"""Journals of jobs, one small JSON document a file, and documents written as JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def journals(spark: SparkSession, root: str, schema: str) -> DataFrame:
    """path, job (the file's folder), readable, and document (of the schema) of each *.json file below root.

    A file that is blank, no JSON object, or of other types is not readable and has a null document; it never fails the
    scan. Fields it lacks are null, other fields are passed over. Files of no bytes give no row, as in all of Spark's file
    sources; a root without such files gives no rows.
    """
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").text(root, wholetext=True)
    files = files.select(F.col("_metadata.file_path").alias("path"), F.col("value"))
    read = F.from_json("value", f"{schema}, _corrupt string", {"columnNameOfCorruptRecord": "_corrupt"})
    rows = files.withColumn("_read", read).withColumn("readable", F.col("value").rlike(r"^\s*\{") & F.col("_read").isNotNull() & F.col("_read._corrupt").isNull())
    job = F.element_at(F.split("path", "/"), -2)
    return rows.select("path", job.alias("job"), F.coalesce("readable", F.lit(False)).alias("readable"), F.when(F.col("readable"), F.col("_read").dropFields("_corrupt")).alias("document"))


def camel_case(name: str) -> str:
    first, *rest = name.split("_")
    return first + "".join(x[:1].upper() + x[1:] for x in rest)


def as_documents(rows: DataFrame) -> DataFrame:
    """value: each row as one JSON object with names in camelCase; nulls are written."""
    return rows.select(F.to_json(F.struct(*[F.col(c).alias(camel_case(c)) for c in rows.columns]), {"ignoreNullFields": "false"}).alias("value"))


def write_documents(rows: DataFrame, path: str) -> None:
    """One document a line; Spark's committer writes under temporary names and renames. Fails if path exists."""
    as_documents(rows).write.mode("error").text(path)
