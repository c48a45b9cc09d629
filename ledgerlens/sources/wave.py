"""RIFF/WAVE source: exact chunk walk and samples as rows."""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.operators.stored import stored
from ledgerlens.sources.files import opened

#: tag, channels, samples a second, bytes a second, block size, bits a sample (fixed by the analysis format).
FORMAT = (1, 1, 16_000, 32_000, 2, 16)
BLOCK = 1 << 16


def layout(read: Callable[[int, int], bytes], length: int) -> tuple[int, int]:
    """Where the data chunk of a well-formed file of FORMAT begins, and its bytes; ValueError says what is wrong otherwise.

    read gives the bytes from a place on; only headers of chunks are read.
    """
    head = read(0, 12)
    if len(head) < 12 or head[:4] != b"RIFF" or head[8:12] != b"WAVE":
        raise ValueError("not a RIFF/WAVE file")
    if struct.unpack_from("<I", head, 4)[0] + 8 != length:
        raise ValueError("RIFF length differs from the file")
    at, known, data = 12, False, None
    while at < length:
        if at + 8 > length:
            raise ValueError("chunk header is cut off")
        head = read(at, 8)
        name, size = head[:4], struct.unpack_from("<I", head, 4)[0]
        body, at = at + 8, at + 8 + size + (size & 1)
        if at > length:
            raise ValueError("chunk is cut off")
        if name == b"fmt ":
            if known or data is not None or size < 16 or struct.unpack_from("<HHIIHH", read(body, 16)) != FORMAT:
                raise ValueError("format chunk is repeated, late or of another format")
            known = True
        elif name == b"data":
            if not known or data is not None or size % 2:
                raise ValueError("data chunk is early, repeated or odd")
            data = (body, size)
    if data is None:
        raise ValueError("no data chunk")
    return data


def sample_bytes(content: bytes) -> memoryview:
    """The data chunk of a whole file, as layout() finds it."""
    at, size = layout(lambda k, n: content[k : k + n], len(content))
    return memoryview(content)[at : at + size]


def samples(files: DataFrame) -> DataFrame:
    """path, sample_idx, sample, problem of binaryFile rows (path, content).

    A file that is not well-formed gives one row with its problem; samples leave in blocks, so memory holds one file.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content")):
                problem, values = None, np.zeros(0, "<i2")
                try:
                    values = np.frombuffer(sample_bytes(content.as_py() or b""), "<i2")
                except ValueError as wrong:
                    problem = str(wrong)
                if problem:
                    yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([None], pa.int64()), pa.array([None], pa.int32()), pa.array([problem])], names=["path", "sample_idx", "sample", "problem"])
                for k in range(0, len(values), BLOCK):
                    part = values[k : k + BLOCK]
                    n = len(part)
                    yield pa.RecordBatch.from_arrays([pa.array([path] * n), pa.array(np.arange(k, k + n)), pa.array(part.astype(np.int32)), pa.nulls(n, pa.string())], names=["path", "sample_idx", "sample", "problem"])

    return files.select("path", "content").mapInArrow(run, "path string, sample_idx long, sample int, problem string")


def read(spark: SparkSession, pattern: str) -> DataFrame:
    return samples(spark.read.format("binaryFile").load(pattern))


def ranges(files: DataFrame, range_bytes: int) -> DataFrame:
    """path, at, bytes, first (number of the first sample), problem of files (path, length): a row a byte range of samples.

    Only headers are read. A malformed or unreadable file has one row with its problem, one without samples none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = []
            for path, length in zip(b.column("path").to_pylist(), b.column("length").to_pylist()):
                try:
                    store, inner = opened(path)
                    with store.open_input_file(inner) as f:
                        at, size = layout(lambda k, n: f.read_at(n, k), length)
                    found.append((path, at, size, None))
                except (ValueError, OSError) as wrong:
                    found.append((path, None, None, str(wrong) if isinstance(wrong, ValueError) else type(wrong).__name__))
            if found:
                kinds = (pa.string(), pa.int64(), pa.int64(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found), kinds)], ["path", "data", "size", "problem"])

    step = max(2, range_bytes - range_bytes % 2)
    heads = files.select("path", "length").mapInArrow(run, "path string, data long, size long, problem string")
    starts = F.when(F.col("problem").isNotNull(), F.array(F.lit(0).cast("long"))).when(F.col("size") > 0, F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(step).cast("long"))).otherwise(F.array().cast("array<bigint>"))
    rows = heads.select("path", "data", "size", "problem", F.explode(starts).alias("start"))
    return rows.select("path", (F.col("data") + F.col("start")).alias("at"), F.least(F.lit(step), F.col("size") - F.col("start")).alias("bytes"), (F.col("start") / 2).cast("long").alias("first"), "problem")


def ranged(spark: SparkSession, pattern: str, range_bytes: int = 32 << 20, most_tasks: int = 100_000) -> DataFrame:
    """path, sample_idx, sample, problem as read() gives them, but by byte ranges: a long file spreads over many tasks.

    Files are listed without their content, their headers read once, and each range is a task of its own (beyond most_tasks
    they share tasks); memory holds one block. Files of any length that the format can have are read, 2 GB and more too.
    """
    files = spark.read.format("binaryFile").load(pattern).select("path", "length")
    cut = stored(ranges(files, range_bytes), "wave-ranges")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["path", "sample_idx", "sample", "problem"]
        for b in batches:
            for r in b.to_pylist():
                if r["problem"] is not None:
                    yield pa.RecordBatch.from_arrays([pa.array([r["path"]]), pa.array([None], pa.int64()), pa.array([None], pa.int32()), pa.array([r["problem"]])], names)
                    continue
                store, inner = opened(r["path"])
                with store.open_input_file(inner) as f:
                    for k in range(0, r["bytes"], 2 * BLOCK):
                        part = np.frombuffer(f.read_at(min(2 * BLOCK, r["bytes"] - k), r["at"] + k), "<i2")
                        first = r["first"] + k // 2
                        yield pa.RecordBatch.from_arrays([pa.array([r["path"]] * len(part)), pa.array(np.arange(first, first + len(part))), pa.array(part.astype(np.int32)), pa.nulls(len(part), pa.string())], names)

    return cut.repartition(max(1, min(most_tasks, cut.count()))).mapInArrow(run, "path string, sample_idx long, sample int, problem string")
