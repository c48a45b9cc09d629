"""Chat formatting: roles of transcript lines by a hidden Markov model, and canonical rendering of the turns.

A transcript is a sequence of pieces (id, order, text) of one line or more. Each line shows a speaker marker or none,
whether a blank line stands before it, its length and whether it asks. The roles are hidden states; their start,
transition (apart for lines that open something and lines that go on) and feature probabilities are counted over all
labelled pieces. The best path is found by Viterbi in the (max, +) algebra: pieces form chunks by position, each chunk is
multiplied into one matrix by itself, the matrices of a transcript give the roles at its chunk borders, and chunks are
then decoded apart between these. So one transcript of any length is spread over many tasks.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.llm.common import written

ROLES = ("system", "user", "assistant")
#: Names by which transcripts mark speakers (fixed values), by the class of marker they show.
MARKERS = {"system": 1, "instructions": 1, "user": 2, "human": 2, "customer": 2, "q": 2, "question": 2, "assistant": 3, "ai": 3, "bot": 3, "agent": 3, "a": 3, "answer": 3}
_MARKER = re.compile(r"\s*(?:[#*>\[<|]+\s*)?([A-Za-z][\w ]{0,24}?)\s*(?:[\]>|*]*\s*[:>]|[\]|*]+|\s-)(?:\s+|$)")
SIZES = (5, 4, 6, 2)  # values of: marker (none, three classes, unknown name), break before, length, question
PIECES = 256
#: Copies of a repeated piece that one row expands to at a time.
COPIES = 1 << 12
#: Characters by which pieces of one order are sorted before their digests are.
HEAD = 64
FOLDS = 2
#: Lines of each role with its own markers that are taken as seen before any are counted.
PRIOR = 8


def features(line: str, after_blank: bool) -> tuple[tuple[int, int, int, int], str]:
    """Feature values of a line, and the line without its known marker."""
    marker = 0
    if m := _MARKER.match(line):
        marker = MARKERS.get(m[1].lower(), 4)
        if marker != 4:
            line = line[m.end() :]
    breaks = 2 * (marker not in (0, 4)) + after_blank
    return (marker, breaks, min(5, len(line).bit_length() // 2), int("?" in line)), line


def lines_of(text: str | None) -> Iterator[tuple[tuple[int, int, int, int], str]]:
    """Lines that are not blank, of one piece; before its first line only a blank line of its own counts."""
    blank = False
    for line in (text or "").split("\n"):
        if not line.strip():
            blank = True
            continue
        yield features(line.rstrip("\r"), blank)
        blank = False


@dataclass
class Model:
    start: np.ndarray  # role
    move: np.ndarray  # goes on or opens, from role, to role
    shows: list[np.ndarray]  # per feature: role, value

    def scores(self, values: list[tuple[int, int, int, int]]) -> np.ndarray:
        v = np.array(values, np.int64).reshape(-1, len(SIZES))
        return sum(table[:, v[:, k]].T for k, table in enumerate(self.shows))

    def steps(self, values: list[tuple[int, int, int, int]]) -> np.ndarray:
        """line, from role, to role."""
        opens = np.array([int(v[1] > 0) for v in values])
        return self.move[opens] + self.scores(values)[:, None, :]


def fit(pieces: DataFrame, id_col: str = "conv_id", order_col: str = "turn", role_col: str = "role", text_col: str = "text") -> Model:
    """Counts over all labelled pieces, plus one, plus PRIOR for each role's own markers; pieces of other or null roles
    are not counted. Without labelled pieces markers alone tell the roles.

    The role before a piece is that of the piece of the order before it, of several the first by name.
    """
    rows = pieces.select(F.col(id_col).alias("id"), F.col(order_col).cast("long").alias("at"), F.lower(F.col(role_col)).alias("role"), F.col(text_col).alias("text")).where(F.col("role").isin(*ROLES))
    before = rows.groupBy(F.col("id").alias("_id"), (F.col("at") + 1).alias("_at")).agg(F.min("role").alias("last"))
    rows = rows.join(before, F.col("id").eqNullSafe(F.col("_id")) & (F.col("at") == F.col("_at")), "left").select("role", "last", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, int] = {}
        for batch in batches:
            for role, last, text in zip(*(c.to_pylist() for c in batch.columns)):
                r = ROLES.index(role)
                for k, (values, _) in enumerate(lines_of(text)):
                    source = r if k else ROLES.index(last) if last else -1
                    for key in ((-1, source, int(values[1] > 0), r), *((f, v, 0, r) for f, v in enumerate(values))):
                        held[key] = held.get(key, 0) + 1
        keys = list(held)
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in keys], pa.int32()) for k in range(4)] + [pa.array([held[x] for x in keys], pa.int64())], names=["kind", "x", "y", "role", "n"])

    counts = rows.mapInArrow(run, "kind int, x int, y int, role int, n long").groupBy("kind", "x", "y", "role").agg(F.sum("n").alias("n")).collect()  # as many as there are parameters
    s = len(ROLES)
    start, move, shows = np.ones(s), np.ones((2, s, s)), [np.ones((s, n)) for n in SIZES]
    shows[0][range(s), range(1, s + 1)] += PRIOR
    for c in counts:
        if c["kind"] >= 0:
            shows[c["kind"]][c["role"], c["x"]] += c["n"]
        elif c["x"] < 0:
            start[c["role"]] += c["n"]
        else:
            move[c["y"], c["x"], c["role"]] += c["n"]
    # a move's share is among all lines after a role, opening or not, so that opening is part of what is seen
    return Model(np.log(start / start.sum()), np.log(move / move.sum(axis=(0, 2), keepdims=True)), [np.log(t / t.sum(axis=1, keepdims=True)) for t in shows])


def product(steps: np.ndarray) -> np.ndarray:
    """(max, +) product of the steps of a chunk, halving the chain each round."""
    while len(steps) > 1:
        odd = steps[-1:] if len(steps) % 2 else steps[:0]
        left, right = steps[: len(steps) // 2 * 2 : 2], steps[1 : len(steps) // 2 * 2 : 2]
        steps = np.concatenate([(left[:, :, :, None] + right[:, None, :, :]).max(axis=2), odd])
    return steps[0]


def decode(steps: np.ndarray, first: np.ndarray, last: int | None = None) -> list[int]:
    """Best roles of a chunk; first: score of each role before it (or of each role at its first line: see start)."""
    best, back = first, []
    for step in steps:
        through = best[:, None] + step
        back.append(through.argmax(axis=0))
        best = through.max(axis=0)
    role = int(best.argmax()) if last is None else last
    out = []
    for b in reversed(back):
        out.append(role)
        role = int(b[role])
    return out[::-1]


def _start(model: Model, values: list[tuple[int, int, int, int]]) -> np.ndarray:
    """Steps of a chunk that opens a transcript: whatever the role before, its first line has the start scores."""
    steps = model.steps(values)
    steps[0] = model.start + model.scores(values[:1])[0]
    return steps


def _placed(pieces: DataFrame, key: str) -> DataFrame:
    """Pieces (id, at, text) with their position among those of their id, for groups of any size and any number of ties.

    Equal rows are counted, then spread out again, so that all rows differ and a range sort splits whatever is frequent.
    A sorted partition is numbered by id; ids that go on over partitions (two for each of these at most) get an offset.
    """
    rows = pieces.groupBy("id", "at", "text").agg(F.count("*").alias("n"))
    rows = rows.select("id", "at", "text", "n", F.explode(F.expr(f"sequence(0L, n - 1, {COPIES}L)")).alias("from"))
    rows = rows.select("id", "at", "text", F.explode(F.sequence("from", F.least(F.col("n"), F.col("from") + COPIES) - 1)).alias("copy"))
    order = ["id", "at", F.substring("text", 1, HEAD), F.sha2("text", 256), "copy"]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("id", "text")

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, n = TaskContext.get().partitionId(), None, -1
        for batch in batches:
            ranks = []
            for id_ in batch.column("id").to_pylist():
                n, held = (n + 1 if id_ == held else 0), id_
                ranks.append(n)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([part] * len(ranks), pa.int32()), pa.array(ranks, pa.int64())], names=["id", "text", "part", "rank"])

    rows = written(rows.mapInArrow(number, f"id {key}, text string, part int, rank long"), "chat-pieces")
    sizes = rows.groupBy("id", "part").agg(F.count("*").alias("n"))
    by_id = Window.partitionBy("id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(F.col("id").alias("_id"), F.col("part").alias("_part"), F.sum("n").over(by_id).alias("offset")).where("offset is not null")
    rows = rows.join(F.broadcast(offsets), F.col("id").eqNullSafe(F.col("_id")) & (F.col("part") == F.col("_part")), "left")
    return rows.select("id", (F.col("rank") + F.coalesce("offset", F.lit(0))).alias("position"), "text")


def parse(pieces: DataFrame, model: Model, id_col: str = "conv_id", order_col: str = "turn", text_col: str = "text") -> DataFrame:
    """Per chunk of a transcript: id, chunk, n_lines, roles (of its turns, comma-joined), n_turns, rendered.

    Turns start where the role changes or a known marker stands. rendered holds <|role|>, the lines without markers and
    <|end|> for each turn; a turn that goes on over a border has its head in the chunk before and its end in the chunk
    after. Rendered chunks joined in order give the transcript. A chunk holds PIECES pieces, whatever their orders are.
    Equal pieces all count. Of pieces that share id and order the smaller text comes first, by HEAD characters and then
    by digest; a null order comes before all. Null ids are one transcript. Texts without lines add nothing; transcripts
    without lines give no row. Other columns are not read.
    """
    key = pieces.schema[id_col].dataType.simpleString()
    rows = pieces.select(F.col(id_col).alias("id"), F.col(order_col).cast("long").alias("at"), F.col(text_col).alias("text")).where(F.trim(F.translate("text", "\t\n\x0b\x0c\r", "")) != "")
    rows = _placed(rows, key).withColumn("chunk", F.floor(F.col("position") / PIECES)).groupBy("id", "chunk").agg(F.array_sort(F.collect_list(F.struct("position", "text"))).alias("parts"))
    rows = written(rows.select("id", "chunk", F.transform("parts", lambda p: p["text"]).alias("parts")), "chat-chunks")
    first = rows.groupBy("id").agg(F.min("chunk").alias("first"), F.max("chunk").alias("last"))
    rows = rows.join(first.select(F.col("id").alias("_id"), "first", "last"), F.col("id").eqNullSafe(F.col("_id"))).drop("_id")

    def read(parts: list[str]) -> tuple[list, list]:
        both = [x for p in parts for x in lines_of(p)]
        return [v for v, _ in both], [t for _, t in both]

    def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for chunk, parts, first in zip(*(batch.column(c).to_pylist() for c in ("chunk", "parts", "first"))):
                values, _ = read(parts)
                out.append(product(_start(model, values) if chunk == first else model.steps(values)).ravel().tolist())
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("chunk"), pa.array(out, pa.list_(pa.float64()))], names=["id", "chunk", "matrix"])

    def borders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Roles at the ends of the chunks of transcripts with several."""
        s = len(ROLES)
        for batch in batches:
            chunks, ends = [], []
            for held in batch.column("held").to_pylist():
                chunks.append([x["chunk"] for x in held])
                ends.append(decode(np.array([x["matrix"] for x in held]).reshape(-1, s, s), np.zeros(s)))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(chunks, pa.list_(pa.int64())), pa.array(ends, pa.list_(pa.int32()))], names=["id", "chunks", "ends"])

    long = rows.where("first < last")
    held = long.select("id", "chunk", "parts", "first").mapInArrow(matrices, f"id {key}, chunk long, matrix array<double>")
    held = held.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("chunk", "matrix"))).alias("held"))  # a few numbers per chunk
    ends = held.mapInArrow(borders, f"id {key}, chunks array<long>, ends array<int>")
    ends = ends.select("id", F.explode(F.arrays_zip("chunks", "ends", F.concat(F.array(F.lit(-1)), F.slice("ends", 1, F.size("ends") - 1)).alias("before"))).alias("x"))
    ends = ends.select(F.col("id").alias("_id"), F.col("x.chunks").alias("_chunk"), F.col("x.ends").alias("end"), F.col("x.before").alias("before"))
    rows = rows.join(ends, F.col("id").eqNullSafe(F.col("_id")) & (F.col("chunk") == F.col("_chunk")), "left")

    def render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for chunk, parts, first, last, end, before in zip(*(batch.column(c).to_pylist() for c in ("chunk", "parts", "first", "last", "end", "before"))):
                values, texts = read(parts)
                opens = chunk == first
                entry = np.zeros(len(ROLES)) if opens else np.where(np.arange(len(ROLES)) == before, 0.0, -np.inf)
                roles = decode(_start(model, values) if opens else model.steps(values), entry, end)
                done, turns, role = [], [], None if opens else before
                for r, v, t in zip(roles, values, texts):
                    if r != role or v[0] in (1, 2, 3):
                        done.append(("" if role is None else "<|end|>\n") + f"<|{ROLES[r]}|>\n")
                        turns.append(ROLES[r])
                        role = r
                    done.append(t + "\n")
                out.append((chunk, len(values), ",".join(turns), len(turns), "".join(done) + ("<|end|>\n" if chunk == last else "")))
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), *(pa.array(c, k) for c, k in zip(zip(*out), kinds))], names=["id", "chunk", "n_lines", "roles", "n_turns", "rendered"])

    rows = rows.select("id", "chunk", "parts", "first", "last", "end", "before")
    return rows.mapInArrow(render, f"id {key}, chunk long, n_lines long, roles string, n_turns long, rendered string")


def as_transcript(turns: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """conv_id, turn, text and the columns to carry of labelled turns as raw transcripts write them: four styles of markers by conversation, one
    of them none but a blank line, and every ninth marker missing."""
    user = F.element_at(F.array(*map(F.lit, ("User: ", "Human - ", "Q: "))), F.col("_s") + 1)
    other = F.element_at(F.array(*map(F.lit, ("Assistant: ", "AI - ", "A: "))), F.col("_s") + 1)
    mark = F.when(F.col("role") == "user", user).when(F.col("role") == "system", F.lit("[system] ")).otherwise(other)
    styled = turns.withColumn("_s", F.pmod(F.xxhash64("conv_id"), F.lit(4)).cast("int"))
    lost = (F.col("_s") == 3) | (F.pmod(F.xxhash64("conv_id", "turn"), F.lit(9)) == 0)
    return styled.select("conv_id", "turn", F.concat(F.lit("\n"), F.when(lost, F.lit("")).otherwise(mark), F.coalesce("text", F.lit(""))).alias("text"), *carry)


def format_chats(turns: DataFrame) -> DataFrame:
    """Per conversation: conv_id, n_lines, n_turns, roles, rendered_sha256 (over the chunks' digests, in order).

    Conversations fall into FOLDS by a hash of their ids; each is decoded by a model of the other folds' labels. All rows
    are decoded, repeated ones too, and all labelled ones counted. Null ids are one conversation.
    """
    raw = as_transcript(turns, ("role",)).withColumn("_fold", F.pmod(F.xxhash64(F.lit(1), "conv_id"), F.lit(FOLDS)))
    halves = [parse(raw.where(F.col("_fold") == k), fit(raw.where(F.col("_fold") != k))) for k in range(FOLDS)]
    parts = reduce(DataFrame.unionByName, halves)
    whole = parts.groupBy(F.col("id").alias("conv_id")).agg(
        F.sum("n_lines").alias("n_lines"), F.sum("n_turns").alias("n_turns"), F.array_sort(F.collect_list(F.struct("chunk", "roles", F.sha2("rendered", 256).alias("sha")))).alias("parts")
    )
    joined = lambda f, gap: F.array_join(F.transform("parts", lambda p: p[f]), gap)
    return whole.select("conv_id", "n_lines", "n_turns", joined("roles", ",").alias("roles"), F.sha2(joined("sha", ","), 256).alias("rendered_sha256"))
