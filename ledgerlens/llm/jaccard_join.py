"""N-gram Jaccard join by vertical partitioning.

The global order of n-grams is the order of their 64-bit hashes. It is cut into ranges, the fragments, and every set
into its segments by fragment. Uses of the fragments:

* Candidates. With m fragments, two sets whose symmetric difference is at most d agree in at least m - d segments.
  Sets of about one size are cut into the same m, so that a segment holds a few n-grams, and each set is filed under
  the first d + 1 of its segments that hold two n-grams or more. A pair over the threshold meets in one of them: before
  its first equal such segment each side has at most d unequal ones. A set where small segments are too many for this
  count is filed under all of its segments.
* Frequent n-grams. Where more than HOT sets meet under a key, they mostly share a passage. The n-grams of these sets
  are counted, and each set is filed anew under the first d + 1 of those that at most HOT of them hold: two similar sets
  of which one has more than d of these share one there. Sets that are frequent n-grams but for d stay under their hot
  keys, among themselves.
* Filters. Before two sets are compared, their sizes and the parities of their n-grams by bucket, which bound the number
  of n-grams that only one of them has, must allow the threshold.
* Overlaps. Per pair, the common n-grams of each fragment are counted apart and summed.

Equal sets are one node. In a group of nodes filed together, all are paired with one leader (the one that meets most
others over all its keys), never with each other;
pairs that components already join are not compared. Only groups that still hold several components afterwards have
their remaining cross pairs compared, so no link between components is lost, and copies cost one comparison each.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm import components
from ledgerlens.llm.common import BUCKETS, mark_of, screened, written
from ledgerlens.llm.hashing import Powers, Rolling, mixed, word_hashes

#: Fragments for counting overlaps, and bytes kept of an n-gram's hash below the fragment's bits.
FRAGMENTS, KEPT_BYTES = 16, 6
#: Nodes under one key beyond which they are filed anew without frequent n-grams, and nodes of a block of those that stay.
HOT, BLOCK = 16, 32
SET_SCHEMA = "row long, id long, mark binary, doc_id long, n_shingles long, sig binary, keys array<long>, sketch array<long>"


def shingles(text: str | None, size: int, powers: Powers) -> np.ndarray:
    """Sorted distinct hashes of the word n-grams; of the whole sequence if it is shorter."""
    words = (text or "").encode().lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return np.zeros(0, np.uint64)
    at = np.arange(max(1, len(words) - size + 1))
    return np.unique(Rolling(word_hashes(words), powers).ranges(at, np.minimum(at + size, len(words))))


@lru_cache(maxsize=None)
def _classes(percent: int, reach: int) -> list[int]:
    """Least sizes of the size classes, up to beyond reach; below the first, only equal sets are similar."""
    least = -(-percent // (100 - percent))
    out = [least]
    while out[-1] <= reach:
        out.append(max(out[-1] + 1, out[-1] * 3 // 2, out[-1] * 100 // percent + 2))
    return out


def _filed(u: np.ndarray, m: int, d: int, salt: int) -> np.ndarray:
    """Keys of the segments under which a set is filed."""
    fragment = ((u >> np.uint64(32)) * np.uint64(m)) >> np.uint64(32)
    count = np.bincount(fragment.astype(np.int64), minlength=m)
    sums = np.zeros(m, np.uint64)
    with np.errstate(over="ignore"):
        np.add.at(sums, fragment.astype(np.int64), mixed(u))
        good = np.flatnonzero(count >= 2)
        if m - d - (m - len(good)) > 0:
            chosen = good[: d + 1]
        elif m - d - int((count == 0).sum()) > 0:
            chosen = np.flatnonzero(count)
        else:
            chosen = np.arange(m)
        place = (chosen + (salt << 40)).astype(np.uint64)
        return mixed(sums[chosen] + mixed(place) + count[chosen].astype(np.uint64)).view(np.int64)


def keys_of(u: np.ndarray, percent: int) -> np.ndarray:
    """Candidate keys of a set: in its size class and, if it can be the larger side there, in the class below."""
    s, rest = len(u), 100 - percent
    if s * rest // percent == 0:
        return np.zeros(0, np.int64)
    edges = _classes(percent, 1 << max(20, s.bit_length()))
    k = int(np.searchsorted(edges, s, side="right")) - 1
    fragments = lambda k: max(-(-5 * ((edges[k + 1] - 1) * rest // percent) // 4), (edges[k + 1] - 1) * rest // percent + 2)
    keys = [_filed(u, fragments(k), s * rest // percent, k)]
    if k and s * percent <= 100 * (edges[k] - 1):
        keys.append(_filed(u, fragments(k - 1), (s + edges[k] - 1) * rest // (100 + percent), k - 1))
    return np.concatenate(keys)


def sketch(u: np.ndarray) -> np.ndarray:
    """Parity of the number of n-grams in each of 128 to 8,192 buckets (a power of two, twice the set's size or more if
    that fits), 64 to a long. Buckets are the lowest bits, so that halves of a sketch fold by exclusive or."""
    bits = 1 << min(max((2 * len(u)).bit_length(), 7), 13)
    odd = np.bincount((u & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8")


def may_link(a: str, a_sketch: str, b: str, b_sketch: str, percent: int) -> Column:
    """Length filter on two set sizes, and parity filter: each n-gram that only one of the sets has turns one bit, so the
    sketches differ in no more bits than the sets in n-grams. Sizes that pass the first differ by one folding at most."""
    n, m, x, y = F.col(a), F.col(b), F.col(a_sketch), F.col(b_sketch)
    half = F.least(F.size(x), F.size(y))
    fold = lambda s: F.when(F.size(s) == half, s).otherwise(F.zip_with(F.slice(s, F.lit(1), half), F.slice(s, half + 1, half), lambda v, w: v.bitwiseXOR(w)))
    gap = F.aggregate(F.zip_with(fold(x), fold(y), lambda v, w: F.bit_count(v.bitwiseXOR(w))), F.lit(0), lambda total, v: total + v)
    return (100 * F.least(n, m) >= percent * F.greatest(n, m)) & (gap * (100 + percent) <= (n + m) * (100 - percent))


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(
        F.coalesce(F.col(id_col), F.lit(-1)).cast("long").alias("id"), mark_of(F.col(text_col), F.col(id_col)).alias("mark"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")
    )


def document_sets(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """SET_SCHEMA, one row per row; sig is null for texts without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers(0)
        for batch in batches:
            n, sigs, keys, sketches = [], [], [], []
            for text in batch.column(4):
                u = shingles(text.as_py(), size, powers)
                n.append(len(u))
                sigs.append(xxhash.xxh3_128_digest(u.tobytes()) if len(u) else None)
                keys.append(keys_of(u, percent))
                sketches.append(sketch(u))
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(4)), pa.array(n, pa.int64()), pa.array(sigs, pa.binary()), pa.array(keys, pa.list_(pa.int64())), pa.array(sketches, pa.list_(pa.int64()))], names=[f.split(" ")[0] for f in SET_SCHEMA.split(", ")])

    rows = docs.withColumn("row", F.monotonically_increasing_id())
    return rows.select("row", "id", "mark", "doc_id", "text").mapInArrow(run, SET_SCHEMA)


def _without(rows: DataFrame, gone: DataFrame) -> DataFrame:
    """rows whose row number is not in gone; only those that may be in it are shuffled."""
    return screened(rows, ["row"], gone, "left_anti").unionByName(screened(rows, ["row"], gone).join(gone.select("row"), "row", "left_anti"))


def _segments(rows: DataFrame, size: int) -> DataFrame:
    """fragment, leader, node, n, part for a text's own role as leader (node null) and for each leader it is compared with."""
    schema = "fragment int, leader long, node long, n int, part binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers(0)
        shift = np.uint64(64 - FRAGMENTS.bit_length() + 1)
        low = np.uint64(64 - FRAGMENTS.bit_length() + 1 - 8 * KEPT_BYTES)
        for batch in batches:
            out: list[tuple] = []
            weight = 0
            for row, text, leaders, leads in zip(*(batch.column(c).to_pylist() for c in ("row", "text", "leaders", "leads"))):
                u = shingles(text, size, powers)
                ends = np.searchsorted((u >> shift).astype(np.int64), np.arange(FRAGMENTS + 1))
                packed = np.ascontiguousarray((u >> low).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :KEPT_BYTES]).tobytes()
                parts = [packed[KEPT_BYTES * a : KEPT_BYTES * b] for a, b in zip(ends[:-1], ends[1:])]
                for leader, node in [*((x, row) for x in leaders or ()), *([(row, None)] if leads else ())]:
                    out += [(f, leader, node, len(u), part) for f, part in enumerate(parts)]
                    weight += len(packed)
                    if len(out) > 20_000 or weight > 8 << 20:  # one node may have many leaders, and one text be very long
                        yield _packed(out)
                        out, weight = [], 0
            if out:
                yield _packed(out)

    def _packed(out: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=["fragment", "leader", "node", "n", "part"])

    return rows.mapInArrow(run, schema)


def _overlaps(joined: DataFrame) -> DataFrame:
    """leader, node, n, leader_n, common of each pair of segments."""
    schema = "leader long, node long, n int, leader_n int, common int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, set()
        for batch in batches:
            common = []
            for a, b in zip(batch.column("part").to_pylist(), batch.column("leader_part").to_pylist()):
                if b != last:
                    last, held = b, {b[i : i + KEPT_BYTES] for i in range(0, len(b), KEPT_BYTES)}
                common.append(sum(a[i : i + KEPT_BYTES] in held for i in range(0, len(a), KEPT_BYTES)))
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("leader", "node", "n", "leader_n")] + [pa.array(common, pa.int32())], names=["leader", "node", "n", "leader_n", "common"])

    return joined.select("leader", "node", "n", "leader_n", "part", "leader_part").mapInArrow(run, schema)


def _texts_at(texts: DataFrame, places: DataFrame) -> DataFrame:
    """places (id, mark, row, ...; a written table) with their text; only texts that may be there are shuffled."""
    return screened(texts, ["id", "mark"], places).join(places, ["id", "mark"]).dropDuplicates(["id", "mark", "row"])  # rows equal in id and text


def not_in(u: np.ndarray, held: np.ndarray) -> np.ndarray:
    """Which of u are not in held, which is sorted. Each is searched for, so that the time hardly grows with held."""
    if not len(held):
        return np.ones(len(u), bool)
    return held[np.minimum(np.searchsorted(held, u), len(held) - 1)] != u


def _filed_anew(texts: DataFrame, hot: DataFrame, size: int, percent: int) -> DataFrame:
    """node, keys, short: the first d + 1 rare n-grams of the nodes in hot (row, id, mark); short: there are no more than
    d, so that a similar node may share none. Up to BUCKETS frequent n-grams are sent to the tasks, more are joined."""

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers(0)
        for batch in batches:
            for row, text in zip(batch.column("row").to_pylist(), batch.column("text").to_pylist()):
                u = np.sort(shingles(text, size, powers).view(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array([row]), pa.array([u], pa.list_(pa.int64())), pa.array([len(u) * (100 - percent) // percent], pa.int32())], names=["node", "grams", "d"])

    held = written(_texts_at(texts, hot).select("row", "text").mapInArrow(grams, "node long, grams array<long>, d int"), "hot-grams")
    often = held.select(F.explode("grams").alias("gram")).groupBy("gram").agg(F.count("*").alias("n")).where(F.col("n") > HOT)
    often = written(often.select("gram"), "frequent-grams")
    if often.limit(BUCKETS + 1).count() > BUCKETS:
        rare = held.select("node", F.explode("grams").alias("gram")).join(often, "gram", "left_anti").groupBy("node").agg(F.sort_array(F.collect_list("gram")).alias("rare"))
        rows = held.select("node", "d").join(rare, "node", "left").withColumn("rare", F.coalesce("rare", F.array().cast("array<long>")))
        return rows.select("node", F.slice("rare", F.lit(1), F.col("d") + 1).alias("keys"), (F.size("rare") <= F.col("d")).alias("short"))
    sent = texts.sparkSession.sparkContext.broadcast(np.sort(often.toArrow().column("gram").to_numpy()))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grams, ds = batch.column("grams"), batch.column("d").to_pylist()
            ends, u = grams.offsets.to_numpy(), grams.values.to_numpy()
            rare = not_in(u, sent.value)
            rares = [u[a:b][rare[a:b]] for a, b in zip(ends[:-1], ends[1:])]
            lists = pa.array([r[: d + 1] for r, d in zip(rares, ds)], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column("node"), lists, pa.array([len(r) <= d for r, d in zip(rares, ds)])], names=["node", "keys", "short"])

    return held.mapInArrow(keep, "node long, keys array<long>, short boolean")


class _Verifier:
    """Compares pairs of nodes (row numbers of sets) on their texts."""

    def __init__(self, texts: DataFrame, sets: DataFrame, size: int, percent: int):
        self._texts = texts.select("id", "mark", "text")
        self._places = sets.select("row", "id", "mark")
        self._sizes = sets.select("row", "n_shingles", "sketch")
        self._size, self._percent = size, percent

    def linked(self, pairs: DataFrame) -> DataFrame:
        """a, b of the pairs (node, leader) over the threshold."""
        p = self._percent
        n = lambda c: self._sizes.select(F.col("row").alias(c), F.col("n_shingles").alias(f"_{c}"), F.col("sketch").alias(f"_{c}_s"))
        pairs = pairs.select("node", "leader").join(n("node"), "node").join(n("leader"), "leader")
        pairs = written(pairs.where(may_link("_node", "_node_s", "_leader", "_leader_s", p)).select("node", "leader"), "pairs")
        roles = pairs.select(F.col("node").alias("row"), F.col("leader").alias("x")).union(pairs.select(F.col("leader"), F.lit(None).cast("long")).distinct())
        roles = roles.groupBy("row").agg(F.collect_list("x").alias("leaders"), F.bool_or(F.col("x").isNull()).alias("leads"))
        roles = written(roles.join(self._places, "row").select("row", "id", "mark", "leaders", "leads"), "roles")
        rows = _texts_at(self._texts, roles)
        parts = _segments(rows.select("row", "text", "leaders", "leads"), self._size)
        parts = written(parts, "segments")
        lead = parts.where("node is null").select("fragment", "leader", F.col("n").alias("leader_n"), F.col("part").alias("leader_part"))
        joined = parts.where("node is not null").join(lead, ["fragment", "leader"])
        sums = _overlaps(joined).groupBy("leader", "node").agg(F.sum("common").alias("i"), F.max("n").alias("n"), F.max("leader_n").alias("m"))
        return written(sums.where(100 * F.col("i") >= p * (F.col("n") + F.col("m") - F.col("i"))).select(F.col("node").alias("a"), F.col("leader").alias("b")), "links")


def _block_pairs(blocks: DataFrame, percent: int) -> DataFrame:
    """node, leader, _r, _s of the pairs of different components that may_link lets pass, from pairs of blocks of one key
    (one, two: arrays of node, root, n, sketch; same: both are one block). All pairs of two blocks are tried at once."""

    def sides(column: pa.ListArray) -> Iterator[dict[int, tuple[np.ndarray, ...]]]:
        """For each block, by length of the sketch: node, root, n, sketch."""
        ends, rows = column.offsets.to_numpy(), column.values
        node, root, n, lists = (rows.field(k) for k in range(4))
        node, root, n, at, longs = node.to_numpy(), root.to_numpy(), n.to_numpy(), lists.offsets.to_numpy(), lists.values.to_numpy().view(np.uint64)
        for a, b in zip(ends[:-1], ends[1:]):
            length = np.diff(at[a : b + 1])
            found = {}
            for k in np.unique(length):
                here = a + np.flatnonzero(length == k)
                found[int(k)] = (node[here], root[here], n[here], longs[at[here][:, None] + np.arange(k)])
            yield found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [np.zeros((4, 0), np.int64)]
            for one, two, same in zip(sides(batch.column("one")), sides(batch.column("two")), batch.column("same").to_pylist()):
                for (k, (node, root, n, x)), (m, (leader, top, size, y)) in ((a, b) for a in one.items() for b in two.items()):
                    if max(k, m) > 2 * min(k, m):  # sizes that may link differ by one folding at most
                        continue
                    x, y = (s if s.shape[1] == min(k, m) else s[:, : min(k, m)] ^ s[:, min(k, m) :] for s in (x, y))
                    gap = np.bitwise_count(x[:, None] ^ y[None]).sum(2, dtype=np.int64)
                    p, q = n[:, None], size[None]
                    near = (100 * np.minimum(p, q) >= percent * np.maximum(p, q)) & (gap * (100 + percent) <= (p + q) * (100 - percent)) & (root[:, None] != top[None])
                    i, j = np.nonzero(near & (node[:, None] > leader[None]) if same else near)
                    turned = node[i] < leader[j]
                    out.append(np.where(turned, np.stack([leader[j], node[i], top[j], root[i]]), np.stack([node[i], leader[j], root[i], top[j]])))
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in np.concatenate(out, axis=1)], names=["node", "leader", "_r", "_s"])

    return blocks.mapInArrow(run, "node long, leader long, _r long, _s long")


def _cross(rooted: DataFrame, percent: int) -> DataFrame:
    """node, leader, _r, _s of the pairs under one key that are in different components and that may_link lets pass. rooted
    has key, node, root, n, sketch, held (nodes under the key). Keys of more than BLOCK nodes are cut into blocks."""
    few = rooted.where(F.col("held") <= BLOCK)
    other = few.select("key", F.col("node").alias("leader"), F.col("root").alias("_s"), F.col("n").alias("m"), F.col("sketch").alias("m_sketch"))
    few = few.join(other, "key").where((F.col("node") > F.col("leader")) & (F.col("root") != F.col("_s")) & may_link("n", "sketch", "m", "m_sketch", percent))
    many = rooted.where(F.col("held") > BLOCK).withColumn("block", F.pmod(F.xxhash64("node"), F.ceil(F.col("held") / BLOCK)))
    many = written(many.groupBy("key", "block").agg(F.collect_list(F.struct("node", "root", "n", "sketch")).alias("one")), "blocks")
    pairs = many.join(many.select("key", F.col("block").alias("other"), F.col("one").alias("two")), "key").where("block <= other")
    pairs = _block_pairs(pairs.select("one", "two", (F.col("block") == F.col("other")).alias("same")), percent)
    return few.select("node", "leader", F.col("root").alias("_r"), "_s").unionByName(pairs)


def _met(filed: DataFrame) -> DataFrame:
    """key, node, n of filed nodes that meet others; n: nodes under the key."""
    groups = filed.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high"), F.count("*").alias("n")).where("low < high")
    groups = written(groups.select("key", "n"), "groups")  # on its own, so that a hot key can be split in the join
    return written(filed.join(groups, "key"), "met")


def one_each(docs: DataFrame, size: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay when one document of each component does: the one with the smallest id."""
    found = join(docs, size, percent, id_col, text_col)
    gone = written(found.where(~F.col("first")).select("id", "mark"), "gone")
    stay = found.where("first").select("id", "mark")
    keyed = docs.withColumn("_row", F.struct(*[F.col(f"`{c}`") for c in docs.columns])).select("_row", F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").alias("_text"))
    keyed = keyed.select("_row", F.coalesce(F.col("_id"), F.lit(-1)).cast("long").alias("id"), mark_of(F.col("_text"), F.col("_id")).alias("mark"))
    # only rows that may go are shuffled; of rows equal in id and text at most one is the first
    near = screened(keyed, ["id", "mark"], gone).join(stay, ["id", "mark"], "left_semi").dropDuplicates(["id", "mark"])
    return screened(keyed, ["id", "mark"], gone, "left_anti").select("_row.*").unionByName(near.select("_row.*"))


def join(docs: DataFrame, size: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: doc_id, n_shingles, component_id, first (one row of each component has it true), id and mark
    (of _keyed).

    Rows link when 100 * intersection >= percent * union of their sets of size-word shingles, lower-cased A-Z; percent
    is from 70 to 99. Fewer words make one shingle; null texts and texts without words have none and link with nothing.
    component_id is the smallest doc_id reachable, null if there is none but null. Rows that repeat an id are
    documents of their own. The very long are compared whole, fragment by fragment. An empty table gives an empty one.
    Hashes have 64 bits, of which a comparison uses 52. Other columns are not read.
    """
    texts = _keyed(docs, id_col, text_col)
    sets = written(document_sets(texts, size, percent), "sets")
    nodes = written(sets.where("sig is not null").groupBy("sig").agg(F.min("row").alias("node"), F.min("doc_id").alias("low"), F.count("*").alias("copies")), "nodes")
    copies = sets.select("row", "sig").join(nodes.where("copies > 1").select("sig", "node"), "sig").where("row <> node")
    copies = written(copies.select("row"), "copies")
    filed = _without(sets.select("row", "keys"), copies).select(F.explode("keys").alias("key"), F.col("row").alias("node"))
    met = _met(filed)
    hot = written(met.where(F.col("n") > HOT).select(F.col("node").alias("row")).distinct().join(sets.select("row", "id", "mark", "n_shingles"), "row"), "hot")
    anew = written(_filed_anew(texts.select("id", "mark", "text"), hot, size, percent), "filed-anew")
    rare = _met(anew.select(F.explode("keys").alias("key"), "node"))
    common = _met(met.where(F.col("n") > HOT).select("key", "node").join(anew.where("short").select("node"), "node", "left_semi"))
    met = written(met.where(F.col("n") <= HOT).unionByName(rare).unionByName(common), "met")
    degree = written(met.groupBy("node").agg(F.sum("n").alias("degree")), "degrees")
    leaders = met.select("key", "node").join(degree, "node").groupBy("key").agg(F.max(F.struct("degree", (-F.col("node")).alias("minus"))).alias("x"))
    met = written(met.select("key", "node").join(written(leaders.select("key", (-F.col("x.minus")).alias("leader")), "group-leaders"), "key"), "met-leaders")

    verify = _Verifier(texts, sets, size, percent)
    pairs = written(met.where("node <> leader").groupBy("node", "leader").agg(F.count("*").alias("shared")), "leaders")
    best = written(pairs.groupBy("node").agg(F.max_by("leader", F.struct("shared", -F.col("leader"))).alias("leader")), "best")
    labels = components.merged(docs.sparkSession.createDataFrame([], "node long, root long"), verify.linked(best))

    def across(p: DataFrame) -> DataFrame:
        """Pairs whose nodes are in different components, with their roots."""
        p = p.join(labels.select(F.col("node"), F.col("root").alias("_r")), "node", "left").join(labels.select(F.col("node").alias("leader"), F.col("root").alias("_s")), "leader", "left")
        return p.withColumn("_r", F.coalesce("_r", "node")).withColumn("_s", F.coalesce("_s", "leader")).where("_r <> _s")

    labels = components.merged(labels, verify.linked(across(pairs.join(best, ["node", "leader"], "left_anti"))))

    # Groups that still hold several components: their cross pairs, but for those with the leader.
    rooted = met.join(labels, "node", "left").withColumn("root", F.coalesce("root", "node"))
    split = written(rooted.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("held")).where("low < high").select("key", "held"), "split-keys")
    size_of = sets.select(F.col("row").alias("node"), F.col("n_shingles").alias("n"), "sketch")
    rooted = written(rooted.where("node <> leader").join(split, "key").join(size_of, "node").select("key", "node", "root", "n", "sketch", "held"), "split-groups")
    cross = written(_cross(rooted, percent).groupBy("node", "leader").agg(F.min("_r").alias("_r"), F.min("_s").alias("_s")), "cross")
    one = cross.groupBy(F.least("_r", "_s").alias("x"), F.greatest("_r", "_s").alias("y")).agg(F.min(F.struct("node", "leader")).alias("p")).select("p.node", "p.leader")
    one = written(one, "cross-first")
    labels = components.merged(labels, verify.linked(one))
    labels = components.merged(labels, verify.linked(across(cross.select("node", "leader").join(one, ["node", "leader"], "left_anti"))))

    named = nodes.join(labels, "node", "left").withColumn("root", F.coalesce("root", "node"))
    lows = named.groupBy("root").agg(F.min("low").alias("component_id"), F.min("node").alias("first_node"))
    named = named.join(lows, "root").select("sig", "node", "component_id", "low", "first_node")
    firsts = sets.where("sig is not null").select("sig", "doc_id", "row").join(named, "sig").where("doc_id <=> component_id").groupBy("first_node").agg(F.min("row").alias("first_row"))
    named = written(named.join(firsts, "first_node").select("sig", "component_id", "first_row"), "components")
    out = sets.select("row", "id", "mark", "doc_id", "n_shingles", "sig").join(named, "sig", "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("sig").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), (F.col("sig").isNull() | (F.col("row") == F.col("first_row"))).alias("first"), "id", "mark")
