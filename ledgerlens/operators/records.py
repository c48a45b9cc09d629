"""Rules of stored records, as columns by name for quality.violations: a rule that is false or unknown is broken.

A null in a required column breaks its rule; rows that repeat are judged one by one; an empty table breaks nothing.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions.text import bounded_text, is_sha256, relative_path
from ledgerlens.operators.names import fresh
from ledgerlens.operators.quality import exactly_one

PROBE_FAILED = ("ValidationFailed", "IntegrityFailed")
NOT_ASSESSED = "NotAssessed"
LOW, HIGH = -(1 << 15), (1 << 15) - 1


def provenance(texts: Iterable[str] = (), hashes: Iterable[str] = (), positive: Iterable[str] = (), not_negative: Iterable[str] = (), longest: int = 4096) -> dict[str, Column]:
    """One rule a column: bounded printable text, lower-case SHA-256, above zero, zero or above."""
    return (
        {f"text:{c}": bounded_text(F.col(c), longest) for c in texts}
        | {f"hash:{c}": is_sha256(F.col(c)) for c in hashes}
        | {f"positive:{c}": F.col(c) > 0 for c in positive}
        | {f"not_negative:{c}": F.col(c) >= 0 for c in not_negative}
    )


def not_assessed(*states: str) -> dict[str, Column]:
    """States that a stage must leave open."""
    return {f"open:{c}": F.col(c) == NOT_ASSESSED for c in states}


def required(*columns: str) -> dict[str, Column]:
    return {f"required:{c}": F.col(c).isNotNull() for c in columns}


def asset_state(state: str, probe_failure: str, preprocessing_failure: str, observation_failure: str) -> dict[str, Column]:
    """Each failure text stands exactly with the states it belongs to."""
    s, probe, prep, seen = (F.col(c) for c in (state, probe_failure, preprocessing_failure, observation_failure))
    return {
        "probe_failure_matches_state": s.isin(*PROBE_FAILED) == probe.isNotNull(),
        "preprocessing_failure_matches_state": ((s == "PreprocessingFailed") == prep.isNotNull()) & ~(probe.isNotNull() & prep.isNotNull()),
        "observation_failure_only_prepared": seen.isNull() | (s == "Prepared"),
    }


def outcome(result: str, failure: str, state: str, done: str, failed: str) -> dict[str, Column]:
    """Exactly one of result and failure, and the state that goes with it."""
    r, f = F.col(result), F.col(failure)
    return {"result_xor_failure": exactly_one(r, f), "state_matches_outcome": F.when(r.isNotNull(), F.col(state) == done).otherwise(F.col(state) == failed)}


def within_job(created: str, at: str, completed: str, updated: str) -> dict[str, Column]:
    """The result falls between creation and completion of its job (open while not completed), completion not before the last update."""
    end = F.col(completed)
    return {"after_creation": F.col(at) >= F.col(created), "before_completion": end.isNull() | (F.col(at) <= end), "completion_after_update": end.isNull() | (end >= F.col(updated))}


def for_asset(results: DataFrame, assets: DataFrame, key: str, pairs: dict[str, str]) -> DataFrame:
    """key, rule of results without asset (unknown_asset) or with a column (of results) unlike its pair (of assets, whose
    key is unique). A null key has no asset."""
    k, asset = fresh("_k", results), fresh("_asset", results)
    known = assets.select(F.col(key).alias(k), F.struct(*[F.col(b).alias(a) for a, b in pairs.items()]).alias(asset))
    rows = results.join(known, F.col(key) == F.col(k), "left")
    rules = F.when(F.col(k).isNull(), F.array(F.lit("unknown_asset"))).otherwise(F.array_compact(F.array(*[F.when(~F.col(a).eqNullSafe(F.col(asset)[a]), F.lit(f"differs:{a}")) for a in pairs])))
    return rows.select(key, F.explode(rules).alias("rule"))


def outside_group(rows: DataFrame, groups: DataFrame, group: str, owner: str, group_key: str, group_owner: str) -> DataFrame:
    """Rows that name a group which their own owner does not have; a null group is none."""
    g, o = fresh("_g", rows), fresh("_o", rows)
    known = groups.select(F.col(group_key).alias(g), F.col(group_owner).alias(o))
    return rows.where(F.col(group).isNotNull()).join(known, (F.col(group) == F.col(g)) & (F.col(owner) == F.col(o)), "left_anti")


def frozen_proxy(probe: Column, longest_side: tuple[int, int] = (1280, 720), rate: int = 30, audio_rate: int = 48_000, channels: int = 2) -> Column:
    """A parsed probe (format, streams) describes the frozen proxy: one video and one audio stream, all values fixed."""
    of = lambda kind: F.filter(probe["streams"], lambda s: s["codec_type"] == kind)
    v, a = F.get(of("video"), F.lit(0)), F.get(of("audio"), F.lit(0))
    w, h = v["width"], v["height"]
    sides = (w > 0) & (h > 0) & (w <= longest_side[0]) & (h <= longest_side[1]) & (w % 2 == 0) & (h % 2 == 0)
    ok = _format_has(probe, "mp4") & (F.size(of("video")) == 1) & (F.size(of("audio")) == 1) & sides & (v["codec_name"] == "mpeg4") & (v["pix_fmt"] == "yuv420p")
    return F.coalesce(ok & (v["avg_frame_rate"] == f"{rate}/1") & (a["codec_name"] == "aac") & (a["sample_rate"] == str(audio_rate)) & (a["channels"] == channels), F.lit(False))


def frozen_audio(probe: Column, rate: int = 16_000, channels: int = 1) -> Column:
    """A parsed probe describes the frozen analysis audio: no video, one stream of 16-bit samples on its own time base."""
    a = F.get(probe["streams"], F.lit(0))
    only = (F.size(probe["streams"]) == 1) & (a["codec_type"] == "audio")
    ok = _format_has(probe, "wav") & only & (a["codec_name"] == "pcm_s16le") & (a["sample_rate"] == str(rate)) & (a["channels"] == channels) & (a["time_base"] == f"1/{rate}") & (a["duration_ts"] > 0)
    return F.coalesce(ok, F.lit(False))


def _format_has(probe: Column, name: str) -> Column:
    return F.array_contains(F.split(F.lower(probe["format"]["format_name"]), ",", -1), name)


def bundle_state(expected: DataFrame, actual: DataFrame, by: str, name: str, size: str, digest: str) -> DataFrame:
    """by, state of each bundle: Verified when its files are exactly those expected, with their sizes and digests;
    OperationalFailure where a file that is there could not be read (null digest); else IntegrityMismatch."""
    pack = lambda d, n: d.select(by, name, F.struct(size, digest).alias(n))
    both = pack(expected, "_e").join(pack(actual, "_a"), [by, name], "full_outer")
    unread = F.col("_a").isNotNull() & F.col(f"_a.{digest}").isNull()
    same = F.col("_e").eqNullSafe(F.col("_a"))
    state = F.when(F.bool_or(unread), "OperationalFailure").when(F.bool_and(same), "Verified").otherwise("IntegrityMismatch")
    return both.groupBy(by).agg(state.alias("state"))


def stored_path_ok(c: Column) -> Column:
    """Stored text is already in its normal form."""
    return F.coalesce(relative_path(c) == c, F.lit(False))
