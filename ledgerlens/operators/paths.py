"""Paths inside other paths: groups of equal paths, and for each the nearest one that holds it.

Slash-ended and sorted, a path is followed at once by what it holds, so one sweep with a stack finds the nearest outer path
of each. Paths are sorted by range over tasks; each task sweeps its own range and leaves its last stack, and what a range
gets from those before it is worked out from these stacks alone. Nothing is exploded and no pair is made.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.operators.stored import stored

#: A scheme alone is no place, so it holds nothing.
_SCHEME = re.compile(r"[A-Za-z][A-Za-z0-9+.-]+:/*")


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """place, member, outer of a sorted range, and a last row with first place and stack for the ranges after it."""
    stack: list[str] = []
    first, part = None, None
    for b in batches:
        if not b.num_rows:
            continue
        places = b.column(0).to_pylist()
        if first is None:
            first, part = places[0], b.column(1)[0].as_py()
        outer = []
        for p in places:
            while stack and not p.startswith(stack[-1]):
                stack.pop()
            outer.append(stack[-1] if stack else None)
            if not _SCHEME.fullmatch(p):
                stack.append(p)
        n = b.num_rows
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(outer, pa.string()), pa.nulls(n, pa.list_(pa.string()))], ["place", "part", "outer", "stack"])
    if first is not None:
        yield pa.RecordBatch.from_arrays([pa.array([first]), pa.array([part], pa.int32()), pa.nulls(1, pa.string()), pa.array([stack], pa.list_(pa.string()))], ["place", "part", "outer", "stack"])


def nearest(places: DataFrame) -> DataFrame:
    """place, outer (null if none) of every distinct slash-ended place."""
    ranged = places.select("place").distinct().repartitionByRange("place").sortWithinPartitions("place")
    ranged = ranged.select("place", F.spark_partition_id().alias("part"))
    # stored, as ranges are cut by a sample: rows and borders must come from one cut
    swept = stored(ranged.mapInArrow(_sweep, "place string, part int, outer string, stack array<string>"), "nested-paths")
    entries, held = [], []  # a row a range, each with one stack: as deep as paths are
    for r in sorted(swept.where("stack is not null").select("part", "place", "stack").collect(), key=lambda r: r["place"]):
        held = [p for p in held if r["place"].startswith(p)]
        entries += [(r["part"], p) for p in held]
        held = held + list(r["stack"])
    rows = swept.where("stack is null").select("place", "part", "outer")
    if entries:
        # a range's first path is held by all of these, and so they hold one another; the longest that fits is nearest
        known = places.sparkSession.createDataFrame(entries, "part int, held string").groupBy("part").agg(F.sort_array(F.collect_list("held"), asc=False).alias("held"))
        rows = rows.join(F.broadcast(known), "part", "left")  # ranges times depth
        fits = F.get(F.filter("held", lambda h: F.startswith("place", h)), 0)
        rows = rows.withColumn("outer", F.coalesce("outer", fits))
    return rows.select("place", "outer")


def nested(paths: DataFrame, key: str, path: str) -> DataFrame:
    """key, same (the least key of an equal path) and outer (that of the nearest path which holds it, or null).

    Paths are equal, and hold others, without regard to case and to slashes at their end; a scheme alone holds nothing.
    Null paths are left out; repeated rows stay; a null key is no one's same or outer unless its path has no other. Equal
    paths of any number are told by one row each; an empty table gives no rows. Other columns are not read.
    """
    rows = paths.select(F.col(key).alias("_key"), F.concat(F.rtrim(F.lower(F.col(path)), F.lit("/")), F.lit("/")).alias("_place")).where("_place is not null")
    names = rows.groupBy(F.col("_place").alias("place")).agg(F.min("_key").alias("same"))
    named = nearest(names).join(names, "place")
    above = names.select(F.col("place").alias("outer"), F.col("same").alias("_outer"))
    known = named.join(above, "outer", "left").select(F.col("place").alias("_of"), "same", F.col("_outer").alias("outer"))
    return rows.join(known, F.col("_place") == F.col("_of")).select(F.col("_key").alias(key), "same", "outer")


def holding(nested_rows: DataFrame, max_depth: int = 64) -> DataFrame:
    """outer, inner of all groups where one holds the other: every pair that follows from the nearest ones.

    Each round climbs one level; as many rounds as paths are deep, and only groups that still have an outer one go on.
    """
    links = stored(nested_rows.where("outer is not null").select(F.col("same").alias("inner"), "outer").distinct(), "links")
    up = links.select(F.col("inner").alias("_at"), F.col("outer").alias("_next"))
    out = now = links
    for _ in range(max_depth):
        now = stored(now.join(up, F.col("outer") == F.col("_at")).select("inner", F.col("_next").alias("outer")), "links")
        if now.isEmpty():
            return out.select("outer", "inner")
        out = out.unionByName(now)
    raise ValueError(f"paths are nested more than {max_depth} deep")
