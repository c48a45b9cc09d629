"""Joins, set comparisons, guarded updates and histories over any tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from ledgerlens.functions.text import ancestors
from ledgerlens.operators.names import fresh


def pending(items: DataFrame, results: DataFrame, key: str) -> DataFrame:
    """Items that still lack a result; items of a null key always do. Repeated items stay, results may repeat."""
    return items.join(results.select(key).distinct(), key, "left_anti")


def linked(items: DataFrame, selections: DataFrame, key: str) -> DataFrame:
    """Items that a selection refers to, once each: a semi join needs no distinct. Null keys refer to nothing."""
    return items.join(selections.select(key), key, "left_semi")


def set_difference(expected: DataFrame, actual: DataFrame, keys: list[str]) -> DataFrame:
    """keys with side: only_expected or only_actual; empty if the key sets are equal."""
    a, b = expected.select(*keys).distinct(), actual.select(*keys).distinct()
    return a.join(b, keys, "left_anti").withColumn("side", F.lit("only_expected")).unionByName(b.join(a, keys, "left_anti").withColumn("side", F.lit("only_actual")))


def set_null_cascade(children: DataFrame, parents: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """Children with their reference set to null where the parent is gone.

    A null reference stays null; parents may repeat; all children stay, in number and in their other columns.
    """
    p = fresh("_p", children)
    known = parents.select(F.col(parent_key).alias(p)).distinct()
    rows = children.join(known, F.col(child_key) == F.col(p), "left")
    return rows.withColumn(child_key, F.when(F.col(p).isNotNull(), F.col(child_key))).drop(p)


def guarded_update(rows: DataFrame, guard: Column, **changes: Column) -> tuple[DataFrame, DataFrame]:
    """(rows after, one row with the affected count): values change only where the guard is true, not where it is unknown.

    New values may use the old ones of all columns. Repeated rows each count; an empty table affects none.
    """
    ok = F.coalesce(guard, F.lit(False))
    after = rows.withColumns({c: F.when(ok, v).otherwise(F.col(c)) for c, v in changes.items()})
    return after, rows.agg(F.count_if(ok).alias("affected"))


def replace_children(old: DataFrame, new: DataFrame, parent: str) -> DataFrame:
    """All children of the parents in new come from new, the others stay.

    Old children of a null parent stay; new ones of a null parent are added. Repeated rows stay repeated.
    """
    return old.join(new.select(parent).distinct(), parent, "left_anti").unionByName(new)


def latest(events: DataFrame, by: list[str], order: list[str], value: str) -> DataFrame:
    """Last value per key in the order given, without a sort.

    Null keys are one key, a null last value is the value; of rows equal in order any may be taken.
    """
    return events.groupBy(*by).agg(F.max_by(value, F.struct(*order)).alias(value))


def _along(by: list[str]) -> WindowSpec:
    """The chunks of a key in their order."""
    return Window.partitionBy(*[F.col("_at")[c] for c in by]).orderBy(F.col("_at")["_chunk"])


def regressions(events: DataFrame, by: list[str], order: list[str], value: str, chunk: Column | None = None) -> DataFrame:
    """Rows whose value is below the one before it, with that as previous.

    Null keys are one key; a null value, or one after a null, is no regression; rows equal in order stand side by side
    in any order; an empty table gives no rows. A column previous is replaced. chunk is an expression that never falls
    along the order: a long key is then sorted chunk by chunk in separate tasks, and only the last rows of chunks meet.
    """
    rows = events.withColumn("_at", F.struct(*by, (F.lit(0) if chunk is None else chunk).alias("_chunk")))
    # values in structs: a null struct is no row before, a null inside it a row with a null
    before = F.lag(F.struct(value)).over(Window.partitionBy("_at").orderBy(*order))
    last = rows.groupBy("_at").agg(F.max_by(F.struct(value), F.struct(*order)).alias("_last"))
    borders = last.select("_at", F.lag("_last").over(_along(by)).alias("_border"))
    out = rows.withColumn("_before", before).join(borders, "_at").withColumn("previous", F.coalesce("_before", "_border")[value])
    return out.where(F.col(value) < F.col("previous")).drop("_at", "_before", "_border")


def running_progress(items: DataFrame, by: list[str], order: list[str], size: str, chunk: Column | None = None) -> DataFrame:
    """done of total items, and the cumulative size, per key.

    Null keys are one key; a null size adds nothing, and the sum is null before the first one that is not; rows equal in
    order are numbered in any order. Columns of these three names are replaced. chunk is as in regressions.
    """
    rows = items.withColumn("_at", F.struct(*by, (F.lit(0) if chunk is None else chunk).alias("_chunk")))
    w = Window.partitionBy("_at").orderBy(*order)
    sums = rows.groupBy("_at").agg(F.count("*").alias("_n"), F.sum(size).alias("_sum"))
    ahead, whole = _along(by).rowsBetween(Window.unboundedPreceding, -1), _along(by).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    sums = sums.select("_at", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_done"), F.sum("_n").over(whole).alias("_total"), F.sum("_sum").over(ahead).alias("_size"))
    out = rows.withColumns({"_place": F.row_number().over(w), "_own": F.sum(size).over(w.rowsBetween(Window.unboundedPreceding, 0))}).join(sums, "_at")
    out = out.withColumns({"done": F.col("_done") + F.col("_place"), "total": F.col("_total"), "cumulative": F.coalesce(F.col("_size") + F.col("_own"), "_size", "_own")})
    return out.drop("_at", "_place", "_own", "_done", "_total", "_size")


def overlapping_paths(paths: DataFrame, key: str, path: str) -> DataFrame:
    """Pairs (outer, inner) where one path, case folded, equals or holds the other: an equi-join on exploded ancestors."""
    folded = paths.select(F.col(key).alias("k"), F.lower(F.col(path)).alias("p")).where("p is not null")
    own = folded.select(F.col("k").alias("outer"), F.concat(F.rtrim("p", F.lit("/")), F.lit("/")).alias("a"), F.col("p").alias("op"))
    inner = folded.select(F.col("k").alias("inner"), F.explode(ancestors(F.col("p"))).alias("a"), F.col("p").alias("ip"))
    pairs = own.join(inner, "a").where(F.col("outer") != F.col("inner"))
    same = F.rtrim("op", F.lit("/")) == F.rtrim("ip", F.lit("/"))
    return pairs.where(~same | (F.col("outer") < F.col("inner"))).select("outer", "inner")


def changed_immutable(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Keys whose row differs between two versions of a table that must not change.

    Only keys that both have, and no null ones (digests.changes() reports all); nulls in other columns equal nulls; a key
    that repeats is compared row by row with all of the other version.
    """
    pack = lambda d, n: d.select(F.col(key), F.struct(*sorted(c for c in d.columns if c != key)).alias(n))
    return pack(old, "a").join(pack(new, "b"), key).where(~F.col("a").eqNullSafe(F.col("b"))).select(key)


def bridged(children: DataFrame, bridge: DataFrame, child_key: str, bridge_child: str) -> DataFrame:
    """Children with the rows of a bridge table that name them; a bridge row that names none is left out."""
    return bridge.join(children, F.col(bridge_child) == F.col(child_key), "inner")


def active(rows: DataFrame, archived: str, asset: str, linked: bool = True) -> DataFrame:
    """Rows that are not archived (null: not) and have an asset, or with linked=False have none yet."""
    has = F.col(asset).isNotNull()
    return rows.where(~F.coalesce(F.col(archived), F.lit(False)) & (has if linked else ~has))


def results_of(results: DataFrame, assets: DataFrame, key: str, owned: Column) -> DataFrame:
    """Results with the other columns of the assets that the condition selects; results of null keys or other assets go.

    The condition is over assets alone, so it reaches their scan before the join.
    """
    return results.join(assets.where(owned), key)


def looked_up(rows: DataFrame, build: DataFrame, key: str, how: str = "left") -> DataFrame:
    """rows joined with a table whose key must be unique: a key it has twice, or has as null, fails the job.

    The check stands in the key that is joined, so it holds whatever columns are read; the build side is grouped for the
    join, so it is read once. Rows of a null key find nothing. A looked-up column may not have the name of one of rows.
    """
    rest = [c for c in build.columns if c != key]
    both = [c for c in rest if c in rows.columns]
    if both:
        raise ValueError(f"both sides have {', '.join(both)}")
    k, n, b = fresh("_k", rows, build), fresh("_n", build), fresh("_b", rows, build)
    once = build.groupBy(F.col(key).alias(k)).agg(F.count("*").alias(n), F.first(F.struct(F.lit(0).alias(n), *rest)).alias(b))
    wrong = F.raise_error(F.format_string("key %s is not unique", F.coalesce(F.col(k).cast("string"), F.lit("null"))))
    once = once.select(F.when((F.col(n) > 1) | F.col(k).isNull(), wrong.cast(build.schema[key].dataType)).otherwise(F.col(k)).alias(k), b)
    return rows.join(once, F.col(key) == F.col(k), how).select(*rows.columns, *[F.col(b)[c].alias(c) for c in rest])


def exists_update(rows: DataFrame, results: DataFrame, key: str, failure: str, proposed: Column) -> tuple[DataFrame, DataFrame]:
    """(rows after, affected count): the proposed failure is taken where it is null and a result exists, or is not null
    and none does; other rows keep theirs. Rows of a null key have no result; results may repeat."""
    k, ok = fresh("_k", rows), fresh("_ok", rows)
    known = results.select(F.col(key).alias(k)).distinct()
    joined = rows.join(known, F.col(key) == F.col(k), "left").withColumn(ok, proposed.isNull() == F.col(k).isNotNull())
    after = joined.withColumn(failure, F.when(F.col(ok), proposed).otherwise(F.col(failure)))
    return after.drop(k, ok), joined.agg(F.count_if(ok).alias("affected"))


def insert_faults(new: DataFrame, old: DataFrame, key: str, parents: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """key, rule of rows that cannot be added: no key, a key given twice or taken already, or a parent (not null) that is
    not there. Null keys are one row of rule null_key; each other fault is one row a key and rule, or a row for no_parent."""
    none = new.where(F.col(key).isNull()).select(key, F.lit("null_key").alias("rule")).distinct()
    given = new.where(F.col(key).isNotNull())
    n, p = fresh("_n", new), fresh("_p", new)
    twice = given.groupBy(key).agg(F.count("*").alias(n)).where(F.col(n) > 1).select(key, F.lit("given_twice").alias("rule"))
    taken = given.select(key).distinct().join(old.select(key), key, "left_semi").select(key, F.lit("taken").alias("rule"))
    known = parents.select(F.col(parent_key).alias(p))
    orphan = given.where(F.col(child_key).isNotNull()).join(known, F.col(child_key) == F.col(p), "left_anti").select(key, F.lit("no_parent").alias("rule"))
    return none.unionByName(twice).unionByName(taken).unionByName(orphan)


def inserted(new: DataFrame, old: DataFrame, key: str, parents: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """old and the new rows without faults; no row of a null key gets in."""
    bad = insert_faults(new, old, key, parents, child_key, parent_key).select(key)
    return old.unionByName(new.where(F.col(key).isNotNull()).join(bad, key, "left_anti").select(*old.columns))


def first_and_more(rows: DataFrame, by: str, order: list[str], value: str) -> DataFrame:
    """by, the value of the first row in the order, and whether there are more; null keys are one key."""
    return rows.groupBy(by).agg(F.min_by(value, F.struct(*order)).alias(value), (F.count("*") > 1).alias("more"))


def groups_by_least(rows: DataFrame, by: str, order: str) -> DataFrame:
    """by, its least order, n: groups in the order of their first member, then of their key."""
    return rows.groupBy(by).agg(F.min(order).alias("first_order"), F.count("*").alias("n")).orderBy("first_order", by)
