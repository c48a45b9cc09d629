"""Comparison of large tables by digests: only the parts whose digests differ are joined.

Rows fall into leaves by a hash of their key. A leaf's digest is the number of its rows and the sums of two independent
64-bit hashes, in halves that cannot overflow below 2^31 rows a leaf; sums do not depend on order, so partial ones are made
before anything moves, and a branch is the sum of its leaves. Equal tables shuffle nothing but these sums.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Leaves of a branch, and branches: at most so many times so many rows of digests.
FAN = 128
SUMS = ("n", "a_low", "a_high", "b_low", "b_high")


def _leaf(keys: list[str]) -> Column:
    return F.pmod(F.xxhash64(F.lit(3), *_told(keys)), F.lit(FAN * FAN)).cast("int")


def _told(columns: list[str]) -> list[Column]:
    """Columns with their null marks, which a hash of values alone would pass over."""
    return [x for c in columns for x in (F.col(f"`{c}`").isNull(), F.col(f"`{c}`"))]


def digests(rows: DataFrame, keys: list[str], columns: list[str] | None = None) -> DataFrame:
    """branch, leaf and SUMS over the columns named (all for None). Can be stored and compared with a later version."""
    columns = sorted(rows.columns if columns is None else columns)
    a, b = (F.xxhash64(F.lit(seed), *_told(columns)) for seed in (1, 2))
    low, high = (lambda h: h.bitwiseAND(F.lit(0xFFFFFFFF))), (lambda h: F.shiftrightunsigned(h, 32))
    hashed = rows.select(_leaf(keys).alias("leaf"), a.alias("a"), b.alias("b"))
    sums = [F.count("*").alias("n")] + [F.sum(f(F.col(h))).alias(f"{h}_{name}") for h in ("a", "b") for name, f in (("low", low), ("high", high))]
    return hashed.groupBy("leaf").agg(*sums).select(F.floor(F.col("leaf") / FAN).cast("int").alias("branch"), "leaf", *SUMS)


def _unequal(a: DataFrame, b: DataFrame, by: str) -> DataFrame:
    other = b.select(F.col(by).alias("_by"), F.struct(*SUMS).alias("_b"))
    mine = a.select(by, F.struct(*SUMS).alias("_a"))
    return mine.join(other, F.col(by) == F.col("_by"), "full").where(~F.col("_a").eqNullSafe(F.col("_b"))).select(F.coalesce(by, "_by").alias(by))


def differing(a: DataFrame, b: DataFrame) -> DataFrame:
    """leaf of every leaf whose digests differ: branches are compared first, then the leaves of those that differ."""
    branch = lambda d: d.groupBy("branch").agg(*[F.sum(c).alias(c) for c in SUMS])
    branches = _unequal(branch(a), branch(b), "branch")
    below = lambda d: d.join(F.broadcast(branches), "branch", "left_semi")  # noqa: E731  at most FAN rows
    return _unequal(below(a), below(b), "leaf")


def _parts(a: DataFrame, b: DataFrame, keys: list[str], columns: list[str] | None, known: tuple[DataFrame | None, DataFrame | None]) -> tuple[DataFrame, DataFrame]:
    """The rows of both in leaves that differ; each is read again for them, and filtered before any shuffle."""
    of = [k if k is not None else digests(d, keys, columns) for k, d in zip(known, (a, b))]
    leaves = F.broadcast(differing(*of).select(F.col("leaf").alias("_leaf")))  # at most FAN * FAN rows
    return tuple(d.join(leaves, _leaf(keys) == F.col("_leaf"), "left_semi") for d in (a, b))


def set_difference(expected: DataFrame, actual: DataFrame, keys: list[str], known: tuple[DataFrame | None, DataFrame | None] = (None, None)) -> DataFrame:
    """keys with side: only_expected or only_actual; empty if the sets of keys are equal.

    Null keys are keys like others, repeated ones count once: if they repeat otherwise on the two sides, their leaf is
    joined and found equal. An empty side makes all of the other differ. known takes digests of the keys made earlier.
    """
    only = [F.col(f"`{k}`") for k in keys]
    a, b = _parts(expected.select(*only), actual.select(*only), keys, list(keys), known)
    a, b = a.distinct(), b.distinct()
    same = lambda x, y: [F.col(f"x.`{k}`").eqNullSafe(F.col(f"y.`{k}`")) for k in keys]
    lacks = lambda x, y: x.alias("x").join(y.alias("y"), same(x, y), "left_anti")
    return lacks(a, b).withColumn("side", F.lit("only_expected")).unionByName(lacks(b, a).withColumn("side", F.lit("only_actual")))


def changes(old: DataFrame, new: DataFrame, key: str, known: tuple[DataFrame | None, DataFrame | None] = (None, None)) -> DataFrame:
    """key, kind (added, removed or changed) between two versions of a table that must not change.

    Columns are compared by name, without regard to their order; nulls equal nulls. A key that repeats is changed where the
    rows that carry it differ as a whole (in number, or in any row); null keys are one key. Map columns cannot be compared.
    """
    columns = sorted(old.columns)
    if sorted(new.columns) != columns:
        raise ValueError("the two versions have different columns")
    a, b = _parts(old, new, [key], columns, known)
    rest = F.struct(*[F.col(f"`{c}`") for c in columns]).alias("_row")
    both = a.select(F.col(f"`{key}`").alias("_key"), rest, F.lit(1).alias("_s")).unionByName(b.select(F.col(f"`{key}`").alias("_key"), rest, F.lit(-1).alias("_s")))
    rows = both.groupBy("_key", "_row").agg(F.sum("_s").alias("_sum"), F.count_if(F.col("_s") > 0).alias("_old"), F.count_if(F.col("_s") < 0).alias("_new"))
    per = rows.groupBy("_key").agg(F.max(F.col("_sum") != 0).alias("_off"), F.sum("_old").alias("_old"), F.sum("_new").alias("_new")).where("_off")
    kind = F.when(F.col("_old") == 0, "added").when(F.col("_new") == 0, "removed").otherwise("changed")
    return per.select(F.col("_key").alias(key), kind.alias("kind"))
