"""Mixing sources to target weights along a low-discrepancy source schedule.

Slot i of the mix is the point frac(i * golden ratio); mapped through the cumulative slot shares it names a source.
Slots are ranked per source. Each source's documents, in a seeded shuffled order, form one stream of tokens that is
cut into equal-token blocks; slot of rank r takes block r modulo the number of blocks, so every further pass over a
source repeats it whole. Both ranks and stream offsets come from two-level prefix sums (small chunk totals first, then
windows within a chunk), so that a source with a third of all rows is spread over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerlens.llm.common import words_of, written

#: 2**64 / golden ratio, as the additive step of the point sequence in 2**-32 units (fixed value).
GOLDEN_STEP = 2654435769
POINTS = 1 << 32
#: Equal cells of the unit interval on which points meet the sources' intervals.
CELLS = 1 << 12


def source_targets(sizes: DataFrame, weights: tuple[int, ...], repeat_cap: int) -> DataFrame:
    """source, source_size -> with weight and target; one row per source.

    Sources by code point, null last, take the weights in turn. Targets share the sum of all sizes by weight; none
    exceeds repeat_cap times its source's size, and the excess is shared again by weight until none is above.
    This is water filling: in the order of cap / weight, sources are capped while the level that the rest would get
    lies above theirs. The windows run over one row per source.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    whole = Window.partitionBy()
    turn = (F.row_number().over(order) - 1) % len(weights)
    weighted = sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), turn + 1).cast("double")).withColumn("cap", F.col("source_size") * F.lit(float(repeat_cap)))
    by_level = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    levels = (
        weighted.withColumn("total", F.sum(F.col("source_size")).over(whole).cast("double"))
        .withColumn("capped", F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        .withColumn("open_weight", F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("level", (F.col("total") - F.col("capped")) / F.col("open_weight"))
        .withColumn("fits", F.col("level") * F.col("weight") <= F.col("cap"))
    )
    final = F.min(F.when(F.col("fits"), F.struct(F.col("cap") / F.col("weight"), F.col("source").isNull(), F.col("source"), F.col("level")))).over(whole)["level"]
    return levels.withColumn("target", F.least(F.col("cap"), F.coalesce(final * F.col("weight"), F.col("cap")))).select("source", "source_size", "weight", "target")


def _prefix_sums(df: DataFrame, keys: list[str], chunk: str, value: str, order: list[Column], out: str) -> DataFrame:
    """Exclusive running sum of value per keys in the order (chunk, order), by chunk totals and windows in a chunk."""
    totals = df.groupBy(*keys, chunk).agg(F.sum(value).alias("_total"))
    before = Window.partitionBy(*keys).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.withColumn("_before", F.coalesce(F.sum("_total").over(before), F.lit(0))).drop("_total")
    on = [df[k].eqNullSafe(totals[k]) for k in keys] + [df[chunk] == totals[chunk]]
    joined = df.join(totals, on).drop(*[totals[k] for k in [*keys, chunk]])
    inner = Window.partitionBy(*keys, chunk).orderBy(*order)
    own = F.sum(value).over(inner.rowsBetween(Window.unboundedPreceding, -1))
    return joined.withColumn(out, F.col("_before") + F.coalesce(own, F.lit(0))).drop("_before")


def schedule(spark: SparkSession, shares: DataFrame, slots: int, chunk_slots: int = 1 << 14) -> DataFrame:
    """source and rank of every slot. shares: source, slot_share (they sum to about 1); one row per source."""
    upto = Window.orderBy(F.col("source").asc_nulls_last())
    edges = shares.withColumn("to", F.round(F.sum("slot_share").over(upto) * F.lit(float(POINTS))).cast("long"))
    edges = edges.withColumn("from", F.coalesce(F.lag("to").over(upto), F.lit(0)))
    last = F.lead("to").over(upto).isNull()
    edges = edges.withColumn("to", F.when(last, F.lit(POINTS)).otherwise(F.col("to"))).select("source", "from", "to")
    cell = POINTS // CELLS
    cells = F.sequence(F.floor(F.col("from") / cell), F.floor((F.col("to") - 1) / cell))
    edges = edges.where("from < to").withColumn("cell", F.explode(cells))
    points = spark.range(slots).withColumn("point", (F.col("id") % POINTS) * GOLDEN_STEP % POINTS)
    points = points.withColumn("cell", F.floor(F.col("point") / cell))
    named = points.join(edges, "cell").where((F.col("from") <= F.col("point")) & (F.col("point") < F.col("to"))).select("id", "source")
    return named.withColumn("chunk", F.floor(F.col("id") / chunk_slots)).withColumn("one", F.lit(1)).transform(lambda d: _prefix_sums(d, ["source"], "chunk", "one", [F.col("id")], "rank")).select("source", "rank")


def mix(
    docs: DataFrame,
    weights: tuple[int, ...] = (1, 2, 3),
    repeat_cap: int = 3,
    block_tokens: int = 64,
    seed: int = 7,
    docs_per_chunk: int = 4096,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """Per document: id, source, size, source_size, target, taken.

    size counts words (null text: 0). taken counts the words the mix takes from the document, passes added up; no
    document is taken more than repeat_cap times. A source's slots number its target over its mean block, so taken
    words come within about a block or two of the target. Documents without words take part with size 0. A null
    source is a source of its own. Rows that repeat an id are separate documents; rows equal in id and text are
    interchangeable, and stand in one chunk of the stream. The order depends on ids and texts only, so reruns agree. An empty table gives an empty one.
    Other input columns are not read.
    """
    spark = docs.sparkSession
    size = F.size(words_of(F.col("_text"))).cast("long")
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), F.col(text_col).alias("_text"))
    base = base.select("doc_id", "source", size.alias("size"), F.xxhash64("_text").alias("mark"))
    # rows of one id, or of none, are told apart by their text, so that they spread over chunks
    base = base.withColumn("place", F.xxhash64("doc_id", F.lit(seed), "mark"))
    base = written(base, "mix-sizes")

    sizes = base.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("source_docs"))
    targets = source_targets(sizes.select("source", "source_size"), weights, repeat_cap)
    targets = targets.join(sizes.select(F.col("source").alias("_s"), "source_docs"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    blocks = F.ceil(F.col("source_size") / block_tokens)
    targets = targets.withColumn("blocks", blocks).withColumn("slots", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size") * blocks).otherwise(0.0))
    targets = written(targets, "mix-targets")
    total = targets.agg(F.coalesce(F.sum("slots"), F.lit(0.0)).alias("n")).first()["n"]
    slots = round(total)

    # Streams: shuffled documents of a source, each with its offset.
    facts = targets.select(F.col("source").alias("_s"), "source_size", "source_docs", "target", "blocks")
    placed = base.join(facts, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    chunks = F.ceil(F.col("source_docs") / docs_per_chunk)
    placed = placed.withColumn("chunk", F.pmod("place", chunks))
    placed = _prefix_sums(placed, ["source"], "chunk", "size", [F.col("place"), F.col("doc_id"), F.col("mark")], "offset")
    placed = written(placed.select("doc_id", "source", "size", "source_size", "target", "offset"), "mix-stream")

    # Blocks: how often the schedule takes each.
    plan = schedule(spark, targets.select("source", (F.col("slots") / F.lit(max(total, 1e-9))).alias("slot_share")), slots)
    of = targets.select(F.col("source").alias("_s"), "blocks")
    taken = plan.join(of, F.col("source").eqNullSafe(F.col("_s"))).where(F.col("rank") < F.col("blocks") * repeat_cap)
    taken = taken.groupBy("source", (F.col("rank") % F.col("blocks")).alias("block")).agg(F.count("*").alias("times"))

    first, last = F.floor(F.col("offset") / block_tokens), F.floor((F.col("offset") + F.col("size") - 1) / block_tokens)
    parts = placed.where("size > 0").withColumn("block", F.explode(F.sequence(first, last)))
    start, end = F.col("block") * block_tokens, (F.col("block") + 1) * block_tokens
    parts = parts.select("doc_id", F.col("source").alias("_s"), "offset", F.col("block").alias("_b"), (F.least(end, F.col("offset") + F.col("size")) - F.greatest(start, F.col("offset"))).alias("part"))
    got = parts.join(taken, F.col("_s").eqNullSafe(F.col("source")) & (F.col("_b") == F.col("block")))
    got = got.groupBy(F.col("_s").alias("g_source"), F.col("offset").alias("g_offset")).agg(F.sum(F.col("part") * F.col("times")).alias("taken"))

    out = placed.join(got, F.col("source").eqNullSafe(F.col("g_source")) & (F.col("offset") == F.col("g_offset")) & (F.col("size") > 0), "left")
    return out.select("doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))
