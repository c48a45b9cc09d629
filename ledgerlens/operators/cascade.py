"""Deletes that follow references through a graph of tables, to a fixpoint."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.operators.stored import stored

CASCADE, SET_NULL = "CASCADE", "SET NULL"


@dataclass(frozen=True)
class Reference:
    """child.column names parent's key; when that goes, the child's row goes too (CASCADE) or forgets it (SET NULL)."""

    child: str
    column: str
    parent: str
    on_delete: str = CASCADE


@dataclass(frozen=True)
class Deleted:
    """Tables after a delete, keys that went by table, and table, kept, deleted, nulled as counts."""

    tables: dict[str, DataFrame]
    gone: dict[str, DataFrame]
    counts: DataFrame


def _without(rows: DataFrame, column: str, gone: DataFrame, how: str) -> DataFrame:
    return rows.join(gone.select(F.col("key").alias("__gone_key")), F.col(f"`{column}`") == F.col("__gone_key"), how)


def delete(tables: dict[str, DataFrame], keys: dict[str, str], references: list[Reference], roots: dict[str, DataFrame]) -> Deleted:
    """Delete the roots (DataFrames with a column key, by table) and all that references demand.

    Each round joins only the keys that went in the round before with the tables that refer to them, and keeps those that had
    not gone yet: chains of any length, references of a table to itself and cycles all end, after as many rounds as the
    longest chain has links. Keys are unique; a key that repeats is gone with any of its rows. A null reference refers to
    nothing, a null key is referred to by nothing, but rows of null keys go with their parents. Rows in which a row that
    stays refers to a missing key are left as they are. A table may hold any column names but __gone_key.
    """
    for r in references:
        if r.on_delete not in (CASCADE, SET_NULL):
            raise ValueError(f"on_delete is {CASCADE} or {SET_NULL}, not {r.on_delete}")
    follow = [r for r in references if r.on_delete == CASCADE]
    fresh = {t: stored(k.where("key is not null").select("key").distinct(), f"gone-{t}") for t, k in roots.items()}
    gone = {t: [k] for t, k in fresh.items()}
    all_gone = lambda t: gone[t][0] if len(gone[t]) == 1 else gone[t][0].unionByName(_rest(gone[t][1:]))

    while fresh:
        found: dict[str, list[DataFrame]] = {}
        for r in follow:
            if r.parent in fresh:
                hit = _without(tables[r.child], r.column, fresh[r.parent], "left_semi").select(F.col(f"`{keys[r.child]}`").alias("key"))
                found.setdefault(r.child, []).append(hit.where("key is not null"))
        fresh = {}
        for t, hits in found.items():
            new = _rest(hits).distinct()
            if t in gone:
                new = new.join(all_gone(t).select(F.col("key").alias("__gone_key")), F.col("key") == F.col("__gone_key"), "left_anti")
            new = stored(new, f"gone-{t}")
            if not new.isEmpty():
                fresh[t] = new
                gone.setdefault(t, []).append(new)

    after, counts = {}, []
    for t, rows in tables.items():
        kept = rows
        if t in roots:
            kept = _without(kept, keys[t], gone[t][0], "left_anti")
        for r in follow:
            if r.child == t and r.parent in gone:
                kept = _without(kept, r.column, all_gone(r.parent), "left_anti")
        nulled = F.lit(False)
        for r in references:
            if r.child == t and r.on_delete == SET_NULL and r.parent in gone:
                lost = f"__lost_{r.column}"
                marks = all_gone(r.parent).select(F.col("key").alias("__gone_key"), F.lit(True).alias(lost))
                kept = kept.join(marks, F.col(f"`{r.column}`") == F.col("__gone_key"), "left").drop("__gone_key")
                nulled = nulled | F.coalesce(F.col(lost), F.lit(False))
                kept = kept.withColumn(r.column, F.when(F.col(lost).isNull(), F.col(f"`{r.column}`")))
        marked = kept.withColumn("__nulled", nulled)
        counts.append(rows.agg(F.count("*").alias("__all")).join(F.broadcast(marked.agg(F.count("*").alias("kept"), F.count_if("__nulled").alias("nulled")))).select(F.lit(t).alias("table"), "kept", (F.col("__all") - F.col("kept")).alias("deleted"), "nulled"))  # one row each
        after[t] = kept.select(*[f"`{c}`" for c in rows.columns])
    return Deleted(after, {t: all_gone(t) for t in gone}, _rest(counts))


def _rest(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
