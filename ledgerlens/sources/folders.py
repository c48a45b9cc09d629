"""What folders hold: entries with their lengths, hashes of whole files by blocks, and the state of prepared bundles."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlens.functions.text import is_sha256
from ledgerlens.sources.files import opened

BLOCK = 1 << 20


def _tasks(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def entries(folders: DataFrame, folder: str) -> DataFrame:
    """folder, name, path, length, is_directory, problem: a row an entry, directly below each distinct folder.

    Subfolders have no length. A folder that is not there, or is none, has no row; one that cannot be listed has one row
    with its problem. Null folders are left out. Folders spread over tasks; the entries of one are listed by one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in b.column(0).to_pylist():
                rows: list[tuple] = []
                try:
                    store, path = opened(at)
                    if store.get_file_info(path).type == fs.FileType.Directory:
                        for e in store.get_file_info(fs.FileSelector(path)):
                            down = e.type == fs.FileType.Directory
                            rows.append((at, e.base_name, f"{at.rstrip('/')}/{e.base_name}", None if down else e.size, down, None))
                except OSError as wrong:
                    rows = [(at, None, None, None, None, f"{type(wrong).__name__}")]
                for lo in range(0, len(rows), 10_000):
                    part = list(zip(*rows[lo : lo + 10_000]))
                    kinds = (pa.string(), pa.string(), pa.string(), pa.int64(), pa.bool_(), pa.string())
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(part, kinds)], ["folder", "name", "path", "length", "is_directory", "problem"])

    names = folders.select(F.col(folder).cast("string").alias("folder")).where("folder is not null").distinct()
    return names.repartition(_tasks(folders), "folder").mapInArrow(run, "folder string, name string, path string, length long, is_directory boolean, problem string")


def hashed(files: DataFrame, path: str) -> DataFrame:
    """files with sha256 (lower-case hex) and n_read: read by blocks, so that memory holds one block whatever the length.

    A file that cannot be read, or a null path, has nulls. Files are dealt out over tasks, however few bytes their rows have.
    Columns of these two names are replaced.
    """
    files = files.drop("sha256", "n_read")
    schema = T.StructType([*files.schema, T.StructField("sha256", T.StringType()), T.StructField("n_read", T.LongType())])
    at = files.columns.index(path)

    def digest(p: str | None) -> tuple[str | None, int | None]:
        if p is None:
            return None, None
        try:
            store, inner = opened(p)
            h, n = hashlib.sha256(), 0
            with store.open_input_stream(inner, compression=None) as f:
                while block := f.read(BLOCK):
                    h.update(block)
                    n += len(block)
            return h.hexdigest(), n
        except OSError:
            return None, None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [digest(p) for p in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.int64())], schema.names)

    return files.repartition(_tasks(files)).mapInArrow(run, schema)


def bundle_states(expected: DataFrame) -> DataFrame:
    """folder, state of every folder in expected (folder, name, length, sha256: the files that it must hold).

    Verified: exactly these files, each of its length and hash. OperationalFailure: the folder, or a file that may be right,
    could not be read. IntegrityMismatch: all else; a subfolder, a file that is still .part, one too many or missing, a
    length or hash that differs, and an expectation that is itself invalid (no hash in lower-case hex, no length above 0).
    Only files of the right name and length are read. Null folders are left out; repeated expectations are one.
    """
    want = expected.select("folder", F.col("name").alias("_name"), F.col("length").alias("_length"), F.col("sha256").alias("_sha")).where("folder is not null").distinct()
    found = entries(expected, "folder").withColumnRenamed("folder", "_folder")
    both = want.join(found, (F.col("folder") == F.col("_folder")) & (F.col("_name") == F.col("name")) & F.col("problem").isNull(), "full")
    both = both.withColumn("folder", F.coalesce("folder", "_folder"))
    valid = F.coalesce(is_sha256(F.col("_sha")) & (F.col("_length") > 0), F.lit(False))
    may = valid & F.coalesce(~F.col("is_directory") & (F.col("length") == F.col("_length")) & ~F.lower("name").endswith(".part"), F.lit(False))
    read = hashed(both.where(may).select("folder", "path", "_sha"), "path")
    read = read.select("folder", F.when(F.col("sha256").isNull(), "unread").when(F.col("sha256") == F.col("_sha"), "same").otherwise("other").alias("is"))
    rest = both.where(~may).select("folder", F.when(F.col("problem").isNotNull(), "unread").otherwise("other").alias("is"))
    state = F.when(F.bool_or(F.col("is") == "unread"), "OperationalFailure").when(F.bool_and(F.col("is") == "same"), "Verified").otherwise("IntegrityMismatch")
    return read.unionByName(rest).groupBy("folder").agg(state.alias("state"))
