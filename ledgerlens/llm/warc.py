"""Deterministic sharded WARC writer and reader.

Records are ordered by (page_id, payload digest). Running sums of bytes over that order, in two levels, cut it into
shards of equal size, whatever the ids are; a page finds its shard by bisection in the first keys of the shards. Pages
are shuffled once, by shard, and sorted by key within it. A task streams its records through gzip, one member per
record with a fixed time stamp, and rolls to a new file when the compressed size reaches the limit. Files are written
under temporary names that hold the attempt; a Spark-committed manifest names the attempt that counts, and a second
job gives its files their final names. What lost attempts leave goes with the temporary folder at the end.
"""

from __future__ import annotations

import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerlens.llm.common import shared_dir, written

#: Record ids are name-based on this namespace, so equal records have equal ids in every run.
NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
MANIFEST = "shard long, roll int, temp string, final string, records long, bytes long, sha256 string"
RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, html string"
SAFE = {c: f"%{c:02X}" for c in [*range(0x21), 0x7F]}
TEMPORARY = "_temporary"
#: About what the heads of a record take, so that small payloads fill a shard too.
HEAD_BYTES = 512


def _open(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path; Hadoop's names of the S3 scheme stand for the plain one."""
    scheme, gap, rest = path.partition("://")
    return fs.FileSystem.from_uri("s3" + gap + rest if gap and scheme in ("s3a", "s3n") else path)


def _record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, f'{page_id}:{digest}')}>"


def record_bytes(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool, date: str) -> bytes:
    """One WARC record. A revisit keeps the HTTP head and the digest and length of the full payload, without the payload."""
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block += b"" if revisit else payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {_record_id(page_id, digest)}",
        f"WARC-Date: {date}",
        "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}",
        f"X-Payload-Length: {len(payload)}",
    ]
    if url is not None:
        head.append(f"WARC-Target-URI: {url.translate(SAFE)}")
    if page_id is not None:
        head.append(f"X-Page-Id: {page_id}")
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_record_id(refers_to, digest)}", f"X-Refers-To-Page-Id: {refers_to}"]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


class _Roller:
    """The open file of a shard; closes it and starts the next when it has reached roll_bytes."""

    def __init__(self, out_dir: str, roll_bytes: int):
        self._fs, self._dir = _open(out_dir)
        self._most, self._attempt = roll_bytes, uuid.uuid4().hex
        self._file, self.done, self._shard, self._roll = None, [], None, 0

    def add(self, shard: int, record: bytes) -> None:
        if shard != self._shard:
            self.close()
            self._shard, self._roll = shard, 0
        if self._file is None:
            self._final = f"shard-{shard:06d}-{self._roll:05d}.warc.gz"
            self._temp = f"{TEMPORARY}/{self._attempt}-{self._final}"
            self._file = self._fs.open_output_stream(f"{self._dir}/{self._temp}", compression=None)
            self._hash, self._bytes, self._records = hashlib.sha256(), 0, 0
        packer = zlib.compressobj(6, zlib.DEFLATED, 31)
        data = packer.compress(record) + packer.flush()
        self._file.write(data)
        self._hash.update(data)
        self._bytes += len(data)
        self._records += 1
        if self._bytes >= self._most:
            self.close()
            self._roll += 1

    def close(self) -> None:
        if self._file is not None:
            self._file.close()
            self._file = None
            self.done.append((self._shard, self._roll, self._temp, self._final, self._records, self._bytes, self._hash.hexdigest()))


def _keys(facts: DataFrame) -> DataFrame:
    """A row per (page_id, digest), written: n, weight (bytes of all its rows), copies, and part, which rises with the key."""
    keys = facts.groupBy("page_id", "digest").agg(F.first("n").alias("n"), F.sum(F.col("n") + HEAD_BYTES).alias("weight"), F.count("*").alias("copies"))
    return written(keys.repartitionByRange("page_id", "digest").withColumn("part", F.spark_partition_id()), "warc-keys")


def _borders(keys: DataFrame, shard_bytes: int) -> list[list]:
    """The least (page_id, digest) of each shard, in order. A shard holds the keys whose running weight begins in one span
    of shard_bytes. There are as many as spans, so the list grows with the number of shards, not of pages."""
    before = lambda w: F.coalesce(F.sum("weight").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = keys.groupBy("part").agg(F.sum("weight").alias("weight"))
    parts = parts.select("part", before(Window.orderBy("part")).alias("offset"))  # a row per partition
    at = F.floor((F.col("offset") + before(Window.partitionBy("part").orderBy("page_id", "digest"))) / F.lit(shard_bytes))
    placed = keys.join(F.broadcast(parts), "part").select(at.alias("at"), F.struct("page_id", "digest").alias("key"))
    firsts = placed.groupBy("at").agg(F.min("key").alias("key"))
    return [[r["key"]["page_id"], r["key"]["digest"]] for r in sorted(firsts.collect(), key=lambda r: r["at"])]


def _shard(borders: list[list], page_id: Column, digest: Column) -> Column:
    """Index of the last border that is not above the key, by bisection; null ids sort first."""
    held = json.dumps([{"page_id": p, "digest": d} for p, d in borders])
    held, key = F.from_json(F.lit(held), "array<struct<page_id: bigint, digest: string>>"), F.struct(page_id.alias("page_id"), digest.alias("digest"))
    steps = F.array(*(F.lit(1 << k) for k in reversed(range(len(borders).bit_length()))), F.lit(0))
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get(held, at + step) <= key, at + step).otherwise(at))


def write(pages: DataFrame, out_dir: str, shard_bytes: int = 1 << 30, roll_bytes: int = 1 << 28, least_revisit: int = 100, date: str = "2000-01-01T00:00:00Z") -> DataFrame:
    """Write page_id, url, html (UTF-8 payload, null: empty) as WARC files in out_dir; return the manifest.

    Of records with equal payloads of at least least_revisit bytes the one with the smallest page_id is the response,
    the others revisit it; rows equal in page_id and payload follow their first as revisits, in one shard. A null page_id
    sorts before all, by digest, and is never referred to: a payload that only has null ids stays a response each time.
    page_id is read as a long. The archive depends on the rows alone: reruns, other partitionings and retried tasks give
    equal bytes. White space and control characters in a URL are percent-encoded. An empty table gives an empty manifest.
    Other columns are not read.
    """
    spark = pages.sparkSession
    text = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), text.alias("html"))
    digest = F.sha2(F.col("html"), 256)
    keys = _keys(rows.select("page_id", digest.alias("digest"), F.octet_length("html").cast("long").alias("n")))
    borders = _borders(keys, shard_bytes)
    shards = max(1, len(borders))

    known = keys.where(F.col("n") >= least_revisit)
    first = known.groupBy("digest").agg(F.min("page_id").alias("first_id"), F.sum("copies").alias("copies")).where("copies > 1 and first_id is not null")
    later = known.select("page_id", "digest").join(first.drop("copies"), "digest").where("not page_id <=> first_id")
    both = rows.select("page_id", digest.alias("digest"), F.lit(None).cast("long").alias("first_id"), "url", "html").unionByName(
        later.select("page_id", "digest", "first_id", F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("html"))
    )
    both = both.select(_shard(borders, F.col("page_id"), F.col("digest")).alias("shard"), "*")
    both = both.repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "page_id", "digest", F.col("first_id").desc_nulls_last(), F.col("url").asc_nulls_first())

    files, base = _open(out_dir)
    files.create_dir(f"{base}/{TEMPORARY}", recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, hint, before = _Roller(out_dir, roll_bytes), (None, None, None), None
        for batch in batches:
            for shard, page_id, digest, first_id, url, html in zip(*(c for c in batch.columns)):
                page_id, digest, html = page_id.as_py(), digest.as_py(), html.as_py()
                if html is None:  # says that the next pages of this id and digest revisit first_id
                    hint = (page_id, digest, first_id.as_py())
                    continue
                payload = html.encode()
                refers = hint[2] if hint[:2] == (page_id, digest) else None
                if refers is None and before == (page_id, digest) and page_id is not None and len(payload) >= least_revisit:
                    refers = page_id
                before = (page_id, digest)
                out.add(shard.as_py(), record_bytes(page_id, url.as_py(), payload, digest, refers, refers is not None, date))
        out.close()
        if out.done:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out.done)], names=["shard", "roll", "temp", "final", "records", "bytes", "sha256"]).cast(pa.schema([("shard", pa.int64()), ("roll", pa.int32()), ("temp", pa.string()), ("final", pa.string()), ("records", pa.int64()), ("bytes", pa.int64()), ("sha256", pa.string())]))

    staged = f"{out_dir}/_staged"
    both.mapInArrow(run, MANIFEST).write.parquet(staged)  # Spark commits one attempt of each task

    def publish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = _open(out_dir)
        for batch in batches:
            for temp, final in zip(batch.column("temp").to_pylist(), batch.column("final").to_pylist()):
                if files.get_file_info(f"{base}/{temp}").type == fs.FileType.File:  # else an earlier attempt has moved it
                    files.move(f"{base}/{temp}", f"{base}/{final}")
            yield batch

    manifest = f"{out_dir}/_manifest"
    spark.read.schema(MANIFEST).parquet(staged).mapInArrow(publish, MANIFEST).write.parquet(manifest)
    files.delete_dir(f"{base}/{TEMPORARY}")
    return spark.read.schema(MANIFEST).parquet(manifest)


def members(stream, chunk: int = 1 << 20) -> Iterator[bytes]:
    """The gzip members of a file, one at a time."""
    rest = b""
    while True:
        rest = rest or stream.read(chunk)
        if not rest:
            return
        unpacker, parts = zlib.decompressobj(31), []
        while not unpacker.eof:
            if not rest and not (rest := stream.read(chunk)):
                raise ValueError("a record is cut off")
            parts.append(unpacker.decompress(rest))
            rest = unpacker.unused_data
        yield b"".join(parts)


def parse(record: bytes) -> tuple:
    """A row of RECORD from the bytes of one record; raises where a digest does not match."""
    head, _, body = record.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    block = body[: int(fields["Content-Length"])]
    if lines[0] != "WARC/1.1" or body[len(block) :] != b"\r\n\r\n" or fields["WARC-Block-Digest"] != f"sha256:{hashlib.sha256(block).hexdigest()}":
        raise ValueError(f"damaged record {fields.get('WARC-Record-ID')}")
    kind, digest = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha256:")
    html, length = None, int(fields["X-Payload-Length"])
    if kind == "response":
        payload = block.partition(b"\r\n\r\n")[2]
        if hashlib.sha256(payload).hexdigest() != digest or len(payload) != length:
            raise ValueError(f"damaged payload {fields['WARC-Record-ID']}")
        html = payload.decode()
    number = lambda k: int(fields[k]) if k in fields else None
    return number("X-Page-Id"), fields.get("WARC-Target-URI"), length, digest, kind, number("X-Refers-To-Page-Id"), html


def read(spark: SparkSession, out_dir: str, with_html: bool = True, batch_rows: int = 256) -> DataFrame:
    """The records of the archives that the manifest in out_dir names, as RECORD; html is null for revisits."""

    names = [f.split(" ")[0] for f in RECORD.split(", ")]
    kinds = pa.schema([(n, pa.string() if k == "string" else pa.int64()) for n, k in (f.split(" ") for f in RECORD.split(", "))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = _open(out_dir)
        for batch in batches:
            for name in batch.column("final").to_pylist():
                rows: list[tuple] = []
                with files.open_input_stream(f"{base}/{name}", compression=None) as stream:
                    for record in members(stream):
                        row = parse(record)
                        rows.append(row if with_html else (*row[:-1], None))
                        if len(rows) >= batch_rows:
                            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds.types)], names=names)
                            rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds.types)], names=names)

    manifest = spark.read.schema(MANIFEST).parquet(f"{out_dir}/_manifest")
    files = manifest.select("final")
    files = files.repartition(max(1, files.count()))  # a file a task, which executors deal among themselves
    return files.mapInArrow(run, RECORD)


def round_trip(pages: DataFrame, **options) -> DataFrame:
    """Write the pages to a fresh shared folder and read the archives back, without the payloads."""
    out_dir = shared_dir(pages.sparkSession, "warc")
    write(pages, out_dir, **options)
    return read(pages.sparkSession, out_dir, with_html=False).drop("html")
