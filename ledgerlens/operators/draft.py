"""Ordered issues of drafts: each an (id, place, code) row. Places order the issues of one draft; items follow in their order."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.functions.text import canonical_path, group_name_ok, workspace_problem

#: Places of the kinds of issue within a draft.
NAME, WORKSPACE, STAGING, ITEMS, GROUPS, MEMBERS, PACKAGE, INPUT = range(8)


def _blank(c: Column) -> Column:
    return c.isNull() | (F.trim(c) == "")


def _issues(rows: DataFrame, by: str, place: int, order: Column, *codes: Column) -> DataFrame:
    """One row for each code that is not null."""
    found = rows.select(F.col(by), F.lit(place).alias("place"), order.cast("long").alias("item"), F.posexplode(F.array_compact(F.array(*codes))).alias("nth", "code"))
    return found.select(by, "place", "item", "nth", "code")


def _repeats(rows: DataFrame, keys: list[str], order: str, counts: Column) -> DataFrame:
    """rows with _again: an earlier row of those counted has the same keys. Grouped first, so that a hot key spreads."""
    first = rows.where(counts).groupBy(*keys).agg(F.min(order).alias("_first"))
    return rows.join(first, keys, "left").withColumn("_again", counts & (F.col(order) > F.col("_first"))).drop("_first")


def issues(drafts: DataFrame, items: DataFrame, groups: DataFrame, by: str = "draft", check_sources: bool = True, require_input: bool = True) -> DataFrame:
    """by, place, item, nth, code in the order of reading a draft.

    drafts: by (unique), name, workspace, staging, package. items: by, item (order, unique in a draft), path, archived,
    found, grp. groups: by, grp_item (order), grp, grp_name. Null and blank texts count as missing; of repeated paths or
    names, in any case, all but the first are issues; paths are equal if their canonical forms are. A path that is no .mp4,
    or that no file can have, is judged no further. check_sources asks whether files are there: items by found, packages by a
    column package_found of drafts, where it has one (null: not found). require_input asks for an active item or a package.
    """
    d = drafts
    staging = workspace_problem(F.col("staging"))
    whole = [
        _issues(d, by, NAME, F.lit(0), F.when(_blank(F.col("name")), "ProfileName.Required")),
        _issues(d, by, WORKSPACE, F.lit(0), F.when(workspace_problem(F.col("workspace")).isNotNull(), "Workspace.Invalid")),
        _issues(d, by, STAGING, F.lit(0), F.when(~_blank(F.col("staging")) & staging.isNotNull(), "Downloadstaging.Invalid")),
        _issues(d, by, PACKAGE, F.lit(0), F.when(~_blank(F.col("package")) & ~F.lower("package").endswith(".vwpkg"), "ImportedPackage.Extension")),
    ]
    if check_sources and "package_found" in d.columns:
        absent = ~_blank(F.col("package")) & F.lower("package").endswith(".vwpkg") & ~F.coalesce(F.col("package_found"), F.lit(False))
        whole.append(_issues(d, by, PACKAGE, F.lit(0), F.when(absent, "ImportedPackage.NotFound")))
    path = F.col("path")
    kind = F.when(_blank(path), "TrainingVideo.PathRequired").when(~F.lower(path).endswith(".mp4"), "TrainingVideo.Mp4Required").when(canonical_path(path).isNull(), "TrainingVideo.InvalidPath")
    rows = _repeats(items.withColumns({"_kind": kind, "_fold": F.lower(canonical_path(path))}), [by, "_fold"], "item", F.col("_kind").isNull())
    missing = F.when(F.col("_kind").isNull() & ~F.col("archived") & ~F.col("found") & F.lit(check_sources), "TrainingVideo.NotFound")
    each = _issues(rows, by, ITEMS, F.col("item"), F.col("_kind"), missing, F.when(F.col("_again"), "TrainingVideo.Duplicate"))

    name = F.col("grp_name")
    bad = F.when(_blank(name), "RecordingDependencyGroup.NameRequired").when(F.lower(name) == "unassigned", "RecordingDependencyGroup.NameReserved").when(~group_name_ok(name), "RecordingDependencyGroup.NameInvalid")
    named = _repeats(groups.withColumns({"_bad": bad, "_fold": F.lower(name)}), [by, "_fold"], "grp_item", F.col("_bad").isNull()).withColumnRenamed("_again", "_name_again")
    named = _repeats(named, [by, "grp"], "grp_item", F.col("grp").isNotNull())
    id_code = F.when(F.col("grp").isNull(), "RecordingDependencyGroup.IdRequired").when(F.col("_again"), "RecordingDependencyGroup.DuplicateId")
    of_groups = _issues(named, by, GROUPS, F.col("grp_item"), id_code, F.col("_bad"), F.when(F.col("_name_again"), "RecordingDependencyGroup.DuplicateName"))
    strangers = items.where("grp is not null").join(groups.select(by, "grp"), [by, "grp"], "left_anti")
    members = _issues(strangers, by, MEMBERS, F.col("item"), F.lit("TrainingVideo.RecordingDependencyGroupUnknown"))
    active = items.where(~F.col("archived")).select(by)
    unfed = _issues(d.where(_blank(F.col("package"))).join(active, by, "left_anti"), by, INPUT, F.lit(0), F.lit("Input.Required"))
    return reduce(DataFrame.unionByName, [*whole, each, of_groups, members, *([unfed] if require_input else [])])


def stage_requests(requests: DataFrame, key: str, path: str, size: str) -> DataFrame:
    """key, rule of requests to stage files: unique ids, absolute .mp4 paths of files that exist (size not null) and are not empty."""
    p, n = F.col(path), F.col(size)
    rows = requests.withColumn("_n", F.count("*").over(Window.partitionBy(key)))
    absolute = p.rlike(r"^(/|[A-Za-z]:[\\/]|\\\\)")
    rules = {"unique_id": F.col(key).isNotNull() & (F.col("_n") == 1), "absolute": absolute, "mp4": F.lower(p).endswith(".mp4"), "exists": n.isNotNull(), "not_empty": n.isNull() | (n > 0)}
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]))
    return rows.select(key, F.explode(broken).alias("rule"))
