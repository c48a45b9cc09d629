"""Substring dedup on a log-structured index of window fingerprints.

A window is a run of window_words words. Each window is filed under its anchor: the gram with the smallest hash in it
(the first, on ties), so equal windows have equal anchors at equal places. Neighbouring windows of one anchor form a
block, and a text has only about one block per (window_words - gram) / 2 words. The texts come in batches. Each becomes
one sorted immutable run of fingerprints with their counts, is merge-joined with the runs of the batches before it, and
what repeats within it or over them is noted as its hits; runs of a level are compacted into one of the next when they
are fan_out. Of all batches' hits, verified once:

* a fingerprint that occurs once has only windows that occur once;
* where all blocks of a fingerprint are equal, all their windows repeat;
* else equal blocks repeat whole, and the windows of one copy of each differing block are verified one by one.

Hot passages therefore cost one row per occurrence, never pairs.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.llm.common import mark_of, removed, shared_dir, written
from ledgerlens.llm.hashing import Powers, Rolling, word_hashes

#: Doc buckets that a semi-join broadcasts at most, to leave out texts without work before they are shuffled.
BUCKETS = 1 << 20
#: Fingerprints of a bucket of the index, before equal ones are counted.
BUCKET_ROWS = 2_000_000
BLOCK_SCHEMA = "id long, mark binary, doc_id long, n_words long, sha string, fps array<long>, blocks array<long>, starts array<int>, lens array<int>"


def _signed(v: np.ndarray) -> np.ndarray:
    return v.astype(np.uint64).view(np.int64)


def blocks_of(words: list[bytes], window: int, gram: int, powers: tuple[Powers, Powers]) -> tuple[np.ndarray, ...]:
    """Fingerprint, block hash, first word and length in words of each block."""
    n, width = len(words), window - gram + 1
    if n < window:
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.int32),) * 2
    h = word_hashes(words)
    at = np.arange(n - gram + 1)
    grams = Rolling(h, powers[0]).ranges(at, at + gram)
    anchors = np.lib.stride_tricks.sliding_window_view(grams, width).argmin(axis=1) + np.arange(n - window + 1)
    first = np.flatnonzero(np.concatenate([[True], anchors[1:] != anchors[:-1]]))
    end = np.concatenate([first[1:], [len(anchors)]]) - 1 + window
    own = anchors[first]
    with np.errstate(over="ignore"):
        block = Rolling(h, powers[1]).ranges(first, end) * np.uint64(31) + (own - first).astype(np.uint64)
    return _signed(grams[own]), _signed(block), first.astype(np.int32), (end - first).astype(np.int32)


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id and mark name a row's id and text: rows equal in both have equal results."""
    return docs.select(
        F.coalesce(F.col(id_col), F.lit(-1)).cast("long").alias("id"), mark_of(F.col(text_col), F.col(id_col)).alias("mark"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")
    )


def document_blocks(docs: DataFrame, window: int, gram: int) -> DataFrame:
    """BLOCK_SCHEMA, a row per row of docs (as _keyed gives them)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = (Powers(0), Powers(1))
        for batch in batches:
            n_words, shas, found = [], [], []
            for text in batch.column(3):
                words = (text.as_py() or "").encode().split()
                n_words.append(len(words))
                shas.append(hashlib.sha256(b" ".join(words)).hexdigest())
                found.append(blocks_of(words, window, gram, powers))
            lists = [pa.array([x[k] for x in found], pa.list_(pa.int64() if k < 2 else pa.int32())) for k in range(4)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(n_words, pa.int64()), pa.array(shas, pa.string()), *lists], names=[f.split(" ")[0] for f in BLOCK_SCHEMA.split(", ")])

    return docs.mapInArrow(run, BLOCK_SCHEMA)


class FingerprintIndex:
    """Immutable runs of (fp, n, low, high), one row a fingerprint: its occurrences, least and greatest block hash.

    Runs are bucketed and sorted by fp, in one number of buckets, so that a batch meets a run in a merge join without a
    shuffle. levels[k] lists the runs of about fan_out**k batches; compaction drops the runs it replaces. A manifest of
    each version is written below root, from which opened() goes on. One writer at a time.
    """

    RUN = "fp long, n long, low long, high long"
    HIT = "fp long, mixed boolean"

    def __init__(self, spark: SparkSession, fan_out: int = 4, buckets: int = 8, root: str = ""):
        self._spark, self._fan_out, self._buckets = spark, fan_out, buckets
        self.root = root or shared_dir(spark, "fingerprint-index")
        self.levels: list[list[str]] = []
        self.hits: list[str] = []
        self._version = 0

    @classmethod
    def opened(cls, spark: SparkSession, root: str) -> FingerprintIndex:
        """The index below root as its last manifest has it."""
        last = spark.read.schema("version int, fan_out int, buckets int, levels array<array<string>>, hits array<string>").json(f"{root}/manifest/*").orderBy(F.desc("version")).first()
        index = cls(spark, last["fan_out"], last["buckets"], root)
        index.levels, index.hits, index._version = [list(x) for x in last["levels"]], list(last["hits"]), last["version"]
        for name in (x for level in index.levels for x in level):
            spark.sql(f"CREATE TABLE IF NOT EXISTS {name} (fp BIGINT, n BIGINT, low BIGINT, high BIGINT) USING parquet CLUSTERED BY (fp) SORTED BY (fp) INTO {index._buckets} BUCKETS LOCATION '{root}/{name}'")
        return index

    def _write(self, counts: DataFrame, level: int) -> str:
        name = f"fingerprint_run_{uuid.uuid4().hex}"
        # dealt out as the buckets are, so that each is one file
        counts.repartition(self._buckets, "fp").write.format("parquet").bucketBy(self._buckets, "fp").sortBy("fp").option("path", f"{self.root}/{name}").saveAsTable(name)
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(name)
        return name

    def _drop(self, names: list[str]) -> None:
        for name in names:
            self._spark.sql(f"DROP TABLE IF EXISTS {name}")
        removed(self._spark, [f"{self.root}/{name}" for name in names])

    def append(self, blocks: DataFrame) -> None:
        """Add a batch of (fp, block) rows: as one sorted run, merge-joined with each run before it; then compact what is due."""
        before = [x for level in self.levels for x in level]
        run = self._spark.table(self._write(blocks.groupBy("fp").agg(F.count("*").alias("n"), F.min("block").alias("low"), F.max("block").alias("high")), 0))
        met = run.where("n > 1").select("fp", (F.col("low") != F.col("high")).alias("mixed"))
        for name in before:
            old = self._spark.table(name).select("fp", F.col("low").alias("old_low"), F.col("high").alias("old_high"))
            both = run.hint("merge").join(old, "fp")
            met = met.unionByName(both.select("fp", (F.least("low", "old_low") != F.greatest("high", "old_high")).alias("mixed")))
        self.hits.append(f"{self.root}/hits-{uuid.uuid4().hex}")
        met.groupBy("fp").agg(F.bool_or("mixed").alias("mixed")).write.parquet(self.hits[-1])
        gone, level = [], 0
        while level < len(self.levels) and len(self.levels[level]) >= self._fan_out:
            due, self.levels[level] = self.levels[level], []
            runs = reduce(DataFrame.unionByName, map(self._spark.table, due))
            self._write(runs.groupBy("fp").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high")), level + 1)
            gone, level = gone + due, level + 1
        self._version += 1
        state = [(self._version, self._fan_out, self._buckets, self.levels, self.hits)]
        state = self._spark.createDataFrame(state, "version int, fan_out int, buckets int, levels array<array<string>>, hits array<string>")
        state.coalesce(1).write.json(f"{self.root}/manifest/{self._version}")
        self._drop(gone)  # only now, so that the last manifest always names what is there

    def repeated(self) -> DataFrame:
        """fp, mixed of each fingerprint with two occurrences or more over all batches; mixed: its blocks differ."""
        hits = self._spark.read.schema(self.HIT).parquet(*self.hits) if self.hits else self._spark.createDataFrame([], self.HIT)
        return hits.groupBy("fp").agg(F.bool_or("mixed").alias("mixed"))

    def drop(self) -> None:
        """Remove the index from the catalog and the store."""
        self._drop([x for level in self.levels for x in level])
        removed(self._spark, [self.root])
        self.levels, self.hits = [], []


def _with_work(docs: DataFrame, work: DataFrame) -> DataFrame:
    """docs (id, mark, ...) whose bucket has a row in work; at most BUCKETS numbers are broadcast."""
    bucket = F.pmod(F.xxhash64("id", "mark"), F.lit(BUCKETS))
    buckets = work.select(bucket.alias("_bucket")).distinct()
    return docs.withColumn("_b", bucket).join(F.broadcast(buckets), F.col("_b") == F.col("_bucket"), "left_semi").drop("_b")


def _windows(rows: DataFrame, window: int) -> DataFrame:
    """fp, hash, id, mark, start, single of every window in the blocks listed with a text."""
    schema = "fp long, hash long, id long, mark binary, start int, single boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers(1)
        for batch in batches:
            for id_, mark, text, blocks in zip(*(batch.column(c).to_pylist() for c in ("id", "mark", "text", "blocks"))):
                rolling = Rolling(word_hashes((text or "").encode().split()), powers)
                counts = np.array([b["len"] - window + 1 for b in blocks])
                spread = lambda k, kind, blocks=blocks, counts=counts: np.repeat(np.array([b[k] for b in blocks], kind), counts)
                start = spread("start", np.int64) + np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
                hashes = _signed(rolling.ranges(start, start + window))
                n = len(start)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(spread("fp", np.int64)), pa.array(hashes), pa.array(np.full(n, id_)), pa.array([mark] * n, pa.binary()), pa.array(start.astype(np.int32)), pa.array(spread("single", bool))],
                    names=["fp", "hash", "id", "mark", "start", "single"],
                )

    return rows.mapInArrow(run, schema)


def _kept(rows: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, kept (the words left) of texts with the spans to remove."""
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for doc_id, text, spans in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "spans"))):
                words = (text or "").encode().split()
                edges = np.zeros(len(words) + 1, np.int64)
                for s in spans or ():
                    edges[s["start"]] += 1
                    edges[s["end"]] -= 1
                stay = np.cumsum(edges[:-1]) == 0
                kept = b" ".join([w for w, k in zip(words, stay.tolist()) if k])
                out.append((doc_id, len(words), len(words) - int(stay.sum()), hashlib.sha256(kept).hexdigest(), kept.decode()))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"])

    return rows.select("doc_id", "text", "spans").mapInArrow(run, schema)


def repeated_spans(docs: DataFrame, window: int = 35, gram: int = 8, batches: int = 5, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(document table, id/mark/spans): where windows repeat, as (start, end) words from 0; only texts that have any."""
    spark = docs.sparkSession
    texts = _keyed(docs, id_col, text_col)
    table = written(document_blocks(texts, window, gram), "blocks")
    blocks = table.select("id", "mark", F.inline(F.arrays_zip("fps", "blocks", "starts", "lens"))).select("id", "mark", F.col("fps").alias("fp"), F.col("blocks").alias("block"), F.col("starts").alias("start"), F.col("lens").alias("len"))
    size = table.agg(F.coalesce(F.sum(F.size("fps")), F.lit(0)).alias("n")).first()["n"]
    index = FingerprintIndex(spark, buckets=min(max(8, size // BUCKET_ROWS), 100_000))
    for k in range(batches):
        index.append(blocks.where(F.pmod(F.xxhash64("id", "mark"), F.lit(batches)) == k).select("fp", "block"))
    repeated = written(index.repeated(), "repeated")  # on its own, so that a hot fingerprint can be split in the join
    index.drop()
    met = written(blocks.join(repeated, "fp"), "blocks-met")

    mixed = met.where("mixed")
    kinds = written(mixed.groupBy("fp", "block").agg(F.count("*").alias("n"), F.min(F.struct("id", "mark", "start", "len")).alias("at")), "block-kinds")
    again = mixed.join(kinds.where("n > 1").select("fp", "block"), ["fp", "block"], "left_semi")
    whole = met.where("not mixed").unionByName(again).select("id", "mark", "start", (F.col("start") + F.col("len")).alias("end"))

    asked = kinds.select("at.id", "at.mark", F.struct("fp", "at.start", "at.len", (F.col("n") == 1).alias("single")).alias("b")).groupBy("id", "mark").agg(F.collect_list("b").alias("blocks"))
    asked = written(asked, "blocks-asked")
    one = texts.select("id", "mark", "text")
    # rows equal in id and text would give the same windows again: one of them speaks for all
    rows = _with_work(one, asked).join(asked, ["id", "mark"]).dropDuplicates(["id", "mark"])
    windows = written(_windows(rows, window), "windows")
    twice = windows.groupBy("fp", "hash").agg(F.count("*").alias("n")).where("n > 1").select("fp", "hash")
    parts = windows.where("single").join(twice, ["fp", "hash"], "left_semi").select("id", "mark", "start", (F.col("start") + window).alias("end"))

    spans = whole.unionByName(parts).groupBy("id", "mark").agg(F.collect_set(F.struct("start", "end")).alias("spans"))
    return table, written(spans, "spans")


def dedup(docs: DataFrame, window: int = 35, gram: int = 8, batches: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: doc_id, n_words, n_removed, kept_sha256, kept_text (null where nothing goes).

    A word goes if a window over it has a word sequence that also starts elsewhere, in the same text or another; windows
    are judged on the input. Rows equal in id and text are elsewhere to each other, so at window words or more they
    lose all words. Null and empty texts have no words and the SHA-256 of nothing. A text shorter than a window keeps
    everything. Anchors are compared by 64 bits and blocks or windows by 64 others. Other columns are not read.
    """
    table, spans = repeated_spans(docs, window, gram, batches, id_col, text_col)
    texts = _keyed(docs, id_col, text_col)
    changed = _kept(_with_work(texts, spans).join(spans, ["id", "mark"]))
    same = table.join(spans, ["id", "mark"], "left_anti").select("doc_id", "n_words", F.lit(0).cast("long").alias("n_removed"), F.col("sha").alias("kept_sha256"), F.lit(None).cast("string").alias("kept_text"))
    return changed.unionByName(same)
