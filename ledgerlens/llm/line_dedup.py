"""Line dedup by a segment-partition edit join.

Two lines are near if their edit distance is at most t: one edit for every chars_per_edit characters of the shorter line,
max_edits at most (lines too short for an edit are near only if equal). A line is cut into t + 1 even segments; of two
near lines the longer holds a segment of the shorter unchanged, at a place that its index and the lengths bound. Each
distinct line files its own segments under (length, index, content) and probes, for every shorter length in reach, the
few substrings at which such a segment can stand (only shifted ones for its own length, where unshifted segments meet in
the index). Groups of one key hold the candidates. What is left of two near lines without the segment they share is as
near as they are, so large groups (a common beginning, say) are divided by the same partition of these rests, twice.
Groups are cut into blocks whose pairs of blocks are compared in separate tasks, with length and character counts first
and a banded bit-parallel edit distance after; of what is near, only spanning links leave a task. Classes are the
components of near and equal lines; the first line of each class, in the order of doc_id, row and line, stays.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm import components
from ledgerlens.llm.common import mark_of, screened, written

#: Lines of a block; a task holds two blocks of a group.
BLOCK = 256
#: Filings of a key beyond which its group is divided by second and third segments, DIVISIONS times at most.
LARGE = 4096
DIVISIONS = 2
BLANKS = " \t\n\x0b\x0c\r"


def segments(length: int, parts: int) -> list[tuple[int, int]]:
    """(start, size) of the even segments of a line; the last ones are longer by one where it does not divide."""
    size, longer = divmod(length, parts)
    out, at = [], 0
    for i in range(parts):
        n = size + (i >= parts - longer)
        out.append((at, n))
        at += n
    return out


def allowed(length: int, edits: int, per_edit: int) -> int:
    """Edits up to which a line of this length is near to one of its length or more."""
    return min(edits, length // per_edit)


def filed(line: str, edits: int, per_edit: int) -> list[tuple[int, int, str]]:
    """(length, index, content) of a line's own segments."""
    t = allowed(len(line), edits, per_edit)
    return [(len(line), i, line[a : a + n]) for i, (a, n) in enumerate(segments(len(line), t + 1))] if t else []


def stands(length: int, longer: int, t: int) -> Iterator[tuple[int, int, int, int]]:
    """(index, own start, start, size) of the substrings of a line of longer characters at which a segment of one of length can stand."""
    d = longer - length
    for i, (a, n) in enumerate(segments(length, t + 1)):
        for at in range(max(a - i, a + d - (t - i), 0), min(a + i, a + d + t - i, longer - n) + 1):
            yield i, a, at, n


def probes(line: str, edits: int, per_edit: int) -> list[tuple[int, int, str]]:
    """What a line looks up: substrings at which a segment of a line of its length or less can stand in it."""
    out = []
    for length in range(max(per_edit, len(line) - edits), len(line) + 1):
        d, t = len(line) - length, allowed(length, edits, per_edit)
        if d <= t:
            out += [(length, i, line[at : at + n]) for i, a, at, n in stands(length, len(line), t) if d or at != a]
    return out


def _key(label: str) -> int:
    """A filing's key as tables hold it, without the lowest bit."""
    h = xxhash.xxh3_64_intdigest(label)
    return (h - (1 << 64) if h >> 63 else h) >> 1


def rests(key: int, line: str, edits: int, per_edit: int) -> set[tuple[bool, int, int, str]]:
    """(own, length, edits, rest) of each way in which a line files (own) or probes a key: what is left of the line without
    the segment, and the length that is left of a line of the key's length."""
    out = set()
    for length in range(max(per_edit, len(line) - edits), len(line) + 1):
        t = allowed(length, edits, per_edit)
        if t and len(line) - length <= t:
            for i, a, at, n in stands(length, len(line), t):
                if _key(f"{length},{i},{line[at : at + n]}") == key:
                    out.add((length == len(line) and at == a, length - n, t, line[:at] + line[at + n :]))
    return out


def divided(key: int, own: bool, length: int, t: int, rest: str) -> Iterator[tuple[int, bool, int, int, str]]:
    """(key, own, length, edits, rest) by the segments of a rest, each below its key."""
    for i, a, at, n in stands(length, len(rest), t):
        yield _key(f"{key},{i},{rest[at : at + n]}"), own and at == a, length - n, t, rest[:at] + rest[at + n :]


def within(a: str, b: str, edits: int) -> bool:
    """Edit distance at most edits, on a diagonal band of bit vectors (one column of the band per character of b)."""
    if abs(len(a) - len(b)) > edits:
        return False
    i, n = 0, min(len(a), len(b))
    while i < n and a[i] == b[i]:
        i += 1
    a, b = a[i:], b[i:]
    j = 0
    while j < min(len(a), len(b)) and a[-1 - j] == b[-1 - j]:
        j += 1
    a, b = (a[: len(a) - j], b[: len(b) - j]) if j else (a, b)
    if not a or not b:
        return max(len(a), len(b)) <= edits
    # reach[e]: bit k set where the cell k - edits off the diagonal is reached with e errors
    band = (1 << (2 * edits + 1)) - 1
    places: dict[str, int] = {}
    for k, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << (k + edits)
    grow = lambda r: [x & band for x in r]
    reach = [0] * (edits + 1)
    reach[0] = 1 << edits
    for e in range(1, edits + 1):
        reach[e] = (reach[e - 1] | reach[e - 1] << 1) & band  # characters of a left out before b starts
    for k, c in enumerate(b):
        same = places.get(c, 0) >> k & band  # bit d: a[k + d - edits] equals b[k]
        now = [reach[0] & same]
        for e in range(1, edits + 1):
            kept = reach[e] & same | reach[e - 1] | reach[e - 1] >> 1  # equal, replaced, inserted
            now.append(kept | now[e - 1] << 1)  # left out
        reach = grow(now)
    end = len(a) - len(b) + edits
    return 0 <= end <= 2 * edits and bool(reach[edits] >> end & 1)


def _line_hash(line: str) -> int:
    return xxhash.xxh3_64_intdigest(line.encode()) - (1 << 63)


def _keyed(docs: DataFrame, id_col: str, text_col: str, carry: list[str] = []) -> DataFrame:  # noqa: B006
    return docs.select(
        *carry,
        F.coalesce(F.col(id_col), F.lit(-1)).cast("long").alias("id"), mark_of(F.col(text_col), F.col(id_col)).alias("mark"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")
    )


def document_lines(docs: DataFrame, edits: int, per_edit: int, carry: list[str]) -> DataFrame:
    """The columns to carry, row, id, mark, doc_id, sha (of the text), lines (hash of each stripped line, null for blank ones), keys (hashed,
    all of a text) and key_lines (the line of each key)."""
    names = ["row", "id", "mark", "doc_id", "sha", "lines", "keys", "key_lines", *carry]
    schema = ", ".join(["row long, id long, mark binary, doc_id long, sha string, lines array<long>, keys array<long>, key_lines array<long>", *(f"{c} {docs.schema[c].dataType.simpleString()}" for c in carry)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_64_intdigest
        seen: set[int] = set()  # lines filed by this task already: only saves repeated rows
        for batch in batches:
            cols: list[list] = [[], [], [], []]
            for text in batch.column(4):
                text = text.as_py() or ""
                hashes, keys, owners = [], [], []
                for line in text.split("\n"):
                    line = line.strip(BLANKS)
                    if not line:
                        hashes.append(None)
                        continue
                    h = _line_hash(line)
                    hashes.append(h)
                    if len(line) >= per_edit and h not in seen:
                        if len(seen) >= 500_000:
                            seen.clear()
                        seen.add(h)
                        # the lowest bit tells filed segments (1) from probes (0)
                        own = [digest(f"{n},{i},{s}") | 1 for n, i, s in filed(line, edits, per_edit)]
                        own += [(digest(f"{n},{i},{s}") | 1) - 1 for n, i, s in probes(line, edits, per_edit)]
                        keys += own
                        owners += [h] * len(own)
                for col, v in zip(cols, (hashlib.sha256(text.encode()).hexdigest(), hashes, np.array(keys, np.uint64).view(np.int64), np.array(owners, np.int64))):
                    col.append(v)
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(4)), pa.array(cols[0]), pa.array(cols[1], longs), pa.array(cols[2], longs), pa.array(cols[3], longs), *(batch.column(c) for c in carry)], names=names)

    rows = docs.withColumn("row", F.monotonically_increasing_id())
    return rows.select("row", "id", "mark", "doc_id", "text", *carry).mapInArrow(run, schema)


def _texts_of(texts: DataFrame, asked: DataFrame) -> DataFrame:
    """line (hash), content of each asked line; asked: id, mark, line."""
    asked = written(asked.groupBy("id", "mark").agg(F.collect_set("line").alias("asked")), "asked")
    rows = screened(texts.select("id", "mark", "text"), ["id", "mark"], asked).join(asked, ["id", "mark"]).dropDuplicates(["id", "mark"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[int, str] = {}
            for text, wanted in zip(batch.column("text").to_pylist(), batch.column("asked").to_pylist()):
                wanted = set(wanted)
                for line in (text or "").split("\n"):
                    line = line.strip(BLANKS)
                    if line and (h := _line_hash(line)) in wanted:
                        out[h] = line
            yield pa.RecordBatch.from_arrays([pa.array(list(out), pa.int64()), pa.array(list(out.values()), pa.string())], names=["line", "content"])

    return rows.select("text", "asked").mapInArrow(run, "line long, content string").dropDuplicates(["line"])


def near_in(lines: list[tuple[int, int, str]], edits: int, per_edit: int) -> list[tuple[int, int]]:
    """Spanning links among lines (hash, block, content): near pairs, first by length and character counts."""
    if len(lines) < 2:
        return []
    lengths = np.array([len(x[2]) for x in lines])
    bags = np.array([np.bincount(np.frombuffer(x[2].encode("utf-32-le"), np.uint32) % 61, minlength=61) for x in lines], np.int32)
    root = list(range(len(lines)))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    out = []
    for k in range(1, len(lines)):
        most = np.minimum(edits, np.minimum(lengths[:k], lengths[k]) // per_edit)
        close = (np.abs(lengths[:k] - lengths[k]) <= most) & (np.abs(bags[:k] - bags[k]).sum(axis=1) <= 2 * most)
        for m in np.flatnonzero(close):
            if find(int(m)) != find(k) and within(lines[k][2], lines[m][2], int(most[m])):
                root[find(k)] = find(int(m))
                out.append((lines[k][0], lines[m][0]))
    return out


def _links(groups: DataFrame, edits: int, per_edit: int) -> DataFrame:
    """a, b of near lines in groups of (key, i, j, line, content); rows of a group are compared in one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush() -> pa.RecordBatch:
            links = near_in(held, edits, per_edit)
            return pa.RecordBatch.from_arrays([pa.array([x for x, _ in links], pa.int64()), pa.array([y for _, y in links], pa.int64())], names=["a", "b"])

        held, last = [], None
        for batch in batches:
            for key, i, j, line, content in zip(*(batch.column(c).to_pylist() for c in ("key", "i", "j", "line", "content"))):
                if (key, i, j) != last:
                    if len(held) > 1:
                        yield flush()
                    held, last = [], (key, i, j)
                held.append((line, 0, content))
        if len(held) > 1:
            yield flush()

    return groups.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "line").mapInArrow(run, "a long, b long")


REST_SCHEMA = "key long, line long, own boolean, length int, edits int, rest string"


def _rests(members: DataFrame, edits: int, per_edit: int) -> DataFrame:
    """REST_SCHEMA of members (key, line, content)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(k, h, *x) for k, h, line in zip(*(batch.column(c).to_pylist() for c in ("key", "line", "content"))) for x in sorted(rests(k, line, edits, per_edit))]
            yield _rest_batch(rows)

    return members.select("key", "line", "content").mapInArrow(run, REST_SCHEMA)


def _divided(rows: DataFrame) -> DataFrame:
    """REST_SCHEMA of the keys below those of rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _rest_batch([(key, h, own, *x) for k, h, *row in zip(*(c.to_pylist() for c in batch.columns)) for key, own, *x in divided(k, *row)])

    return rows.mapInArrow(run, REST_SCHEMA)


def _rest_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.bool_(), pa.int32(), pa.int32(), pa.string()]
    columns = list(zip(*rows)) or [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["key", "line", "own", "length", "edits", "rest"])


def _small_groups(members: DataFrame, contents: DataFrame, edits: int, per_edit: int) -> DataFrame:
    """key, line, n (filings of the key) of members, with the groups of more than LARGE filings divided."""
    groups, large = members.where(F.col("n") <= LARGE), members.where(F.col("n") > LARGE)
    if large.isEmpty():
        return members
    rows = _rests(large.join(contents, "line"), edits, per_edit)
    for _ in range(DIVISIONS):
        rows = written(_divided(rows).distinct(), "line-rests")
        counts = rows.groupBy("key").agg(F.min("line").alias("low"), F.max("line").alias("high"), F.bool_or("own").alias("own"), F.count("*").alias("n")).where("low < high and own")
        counts = written(counts.select("key", "n"), "line-rest-groups")
        rows = screened(rows, ["key"], counts).join(counts, "key")
        groups = groups.unionByName(rows.where(F.col("n") <= LARGE).select("key", "line", "n").distinct())
        large = rows.where(F.col("n") > LARGE)
        rows = large.drop("n").select("key", "line", "own", "length", "edits", "rest")
        if counts.where(F.col("n") > LARGE).isEmpty():
            return groups
    return groups.unionByName(large.select("key", "line", "n").distinct())


def near_lines(table: DataFrame, texts: DataFrame, edits: int, per_edit: int) -> DataFrame:
    """node, root of every line that is not the smallest hash of its class of near lines."""
    keys = table.select(F.inline(F.arrays_zip("keys", "key_lines"))).select(F.shiftright("keys", 1).alias("key"), F.col("keys").bitwiseAND(F.lit(1)).alias("own"), F.col("key_lines").alias("line"))
    groups = keys.groupBy("key").agg(F.min("line").alias("low"), F.max("line").alias("high"), F.max("own").alias("own"), F.count("*").alias("n")).where("low < high and own = 1")
    groups = written(groups.select("key", "n"), "line-groups")
    members = screened(keys, ["key"], groups).join(groups, "key").groupBy("key", "line").agg(F.max("n").alias("n"))
    members = written(members, "line-members")
    at = table.select("id", "mark", F.explode(F.array_distinct("key_lines")).alias("line"))
    wanted = written(members.select("line").distinct(), "lines-wanted")
    asked = screened(at, ["line"], wanted).join(wanted, "line", "left_semi").groupBy("line").agg(F.min(F.struct("id", "mark")).alias("at")).select("line", "at.id", "at.mark")
    contents = written(_texts_of(texts, asked), "line-texts")
    members = _small_groups(members, contents, edits, per_edit)
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("line"), blocks).cast("int")
    # a line goes to every pair of blocks that holds its own
    spread = members.select("key", "line", own.alias("x"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("y"))
    spread = spread.select("key", F.least("x", "y").alias("i"), F.greatest("x", "y").alias("j"), "line")
    return components.roots(written(_links(spread.join(contents, "line"), edits, per_edit).distinct(), "line-links"))


def dedup(docs: DataFrame, max_edits: int = 2, chars_per_edit: int = 10, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = (), whole_text: bool = False) -> DataFrame:
    """Per row of docs: doc_id, n_lines (not blank), n_equal and n_near (removed ones), kept_sha256, kept_text (null
    where nothing goes, but for whole_text), row and the columns to carry (named unlike these).

    Lines are compared without the ASCII white space around them. A removed line leaves the text with its line break;
    blank lines stay. Of each class of equal and near lines the first stays, by doc_id (null first), row and place;
    n_near counts removed lines that differ from the one that stays. Equality is that of
    64-bit hashes. Null texts have no lines. Rows equal in id and text are documents of their own, of which
    the first keeps its lines. Very long lines are compared whole. Other columns are not read.
    """
    carry = list(carry)
    texts = _keyed(docs, id_col, text_col)
    table = written(document_lines(_keyed(docs, id_col, text_col, carry), max_edits, chars_per_edit, carry), "lines")
    roots = near_lines(table, texts, max_edits, chars_per_edit)
    found = table.select("row", "id", F.posexplode("lines").alias("at", "line")).where("line is not null")
    found = found.join(roots, F.col("line") == F.col("node"), "left").select("row", "id", "at", "line", F.coalesce("root", "line").alias("class"))
    first = found.groupBy("class").agg(F.min(F.struct("id", "row", "at", "line")).alias("first"), F.count("*").alias("n")).where("n > 1")
    first = written(first.select("class", "first"), "line-firsts")
    gone = found.join(first, "class").where((F.col("row") != F.col("first.row")) | (F.col("at") != F.col("first.at")))
    gone = written(gone.groupBy("row").agg(F.collect_list("at").alias("gone"), F.count_if(F.col("line") == F.col("first.line")).alias("n_equal"), F.count_if(F.col("line") != F.col("first.line")).alias("n_near")), "lines-gone")

    facts = table.select("row", "id", "mark", "doc_id", "sha", F.size(F.array_compact("lines")).cast("long").alias("n_lines"), *carry).join(gone, "row", "left")
    none = F.lit(0).cast("long")
    if whole_text:
        facts = facts.withColumns({"gone": F.coalesce("gone", F.array().cast("array<int>")), "n_equal": F.coalesce("n_equal", none), "n_near": F.coalesce("n_near", none)})
    same = facts.where("gone is null").select("doc_id", "n_lines", none.alias("n_equal"), none.alias("n_near"), F.col("sha").alias("kept_sha256"), F.lit(None).cast("string").alias("kept_text"), "row", *carry)
    changed = written(facts.where("gone is not null").drop("sha"), "lines-changed")
    rows = screened(texts.select("id", "mark", "text"), ["id", "mark"], changed).dropDuplicates(["id", "mark"]).join(changed, ["id", "mark"])
    names = ["doc_id", "n_lines", "n_equal", "n_near", "kept_sha256", "kept_text", "row", *carry]
    schema = ", ".join(["doc_id long, n_lines long, n_equal long, n_near long, kept_sha256 string, kept_text string, row long", *(f"{c} {docs.schema[c].dataType.simpleString()}" for c in carry)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = []
            for text, out in zip(batch.column("text").to_pylist(), batch.column("gone").to_pylist()):
                out = set(out)
                kept.append("\n".join([x for k, x in enumerate((text or "").split("\n")) if k not in out]))
            shas = [hashlib.sha256(x.encode()).hexdigest() for x in kept]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "n_lines", "n_equal", "n_near")), pa.array(shas), pa.array(kept, pa.string()), batch.column("row"), *(batch.column(c) for c in carry)], names=names)

    return rows.select("doc_id", "n_lines", "n_equal", "n_near", "text", "gone", "row", *carry).mapInArrow(run, schema).unionByName(same)
