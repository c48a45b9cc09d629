"""Every field that a stored result or snapshot must have right, and what ties it to the asset that it is of."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions.text import bounded_text, group_name_ok, prepared_path, relative_path
from ledgerlens.operators import quality, records


@dataclass(frozen=True)
class Fields:
    """Columns by what they must be; an optional text may be null."""

    texts: tuple[str, ...] = ()
    optional: tuple[str, ...] = ()
    hashes: tuple[str, ...] = ()
    positive: tuple[str, ...] = ()
    not_negative: tuple[str, ...] = ()
    true: tuple[str, ...] = ()
    left_open: tuple[str, ...] = ()
    required: tuple[str, ...] = ()

    def rules(self) -> dict[str, Column]:
        """For quality.violations: a rule that is false or unknown is broken."""
        return (
            records.provenance(self.texts, self.hashes, self.positive, self.not_negative)
            | {f"text:{c}": F.col(c).isNull() | bounded_text(F.col(c), 4096) for c in self.optional}
            | {f"true:{c}": F.col(c) for c in self.true}
            | records.not_assessed(*self.left_open)
            | records.required(*self.required)
        )


# The fields of stored results, in their order.
VALIDATION = Fields(
    texts=tuple("container_format video_codec audio_codec ffprobe_version ffprobe_compiler_identifier ffprobe_configuration ffmpeg_version ffmpeg_compiler_identifier ffmpeg_configuration".split()),
    optional=("container_major_brand",),
    hashes=tuple("ffprobe_configuration_sha256 ffprobe_executable_sha256 ffmpeg_configuration_sha256 ffmpeg_executable_sha256 validation_contract_sha256".split()),
    positive=tuple("width height audio_sample_rate_hz audio_channel_count duration_us frame_rate_numerator frame_rate_denominator decoded_duration_us".split()),
    not_negative=("video_stream_index", "audio_stream_index"),
    true=("decode_completed",),
    required=("media_asset_id", "validated_at"),
)
PREPROCESSING = Fields(
    texts=tuple("preprocessing_contract_version proxy_container_format proxy_video_codec proxy_pixel_format proxy_audio_codec analysis_audio_codec ffmpeg_version ffmpeg_compiler_identifier".split()),
    hashes=tuple("source_sha256 preprocessing_contract_sha256 proxy_sha256 analysis_audio_sha256 timestamp_map_sha256 manifest_sha256 ffmpeg_configuration_sha256 ffmpeg_executable_sha256 media_validation_contract_sha256".split()),
    positive=tuple("source_bytes proxy_bytes analysis_audio_bytes timestamp_map_bytes manifest_bytes proxy_width proxy_height proxy_frame_rate_numerator proxy_frame_rate_denominator proxy_audio_sample_rate_hz proxy_audio_channel_count proxy_duration_us analysis_audio_sample_rate_hz analysis_audio_channel_count analysis_audio_sample_count analysis_audio_duration_us mapped_duration_us video_map_entry_count audio_map_segment_count".split()),
    left_open=("media_quality_state", "model_applicability_state"),
    required=("media_asset_id", "preprocessed_at"),
)
SNAPSHOT = Fields(
    texts=("observation_contract_version",),
    hashes=("analysis_audio_sha256", "preprocessing_contract_sha256", "observation_contract_sha256"),
    positive=tuple("analysis_audio_bytes analysis_audio_sample_rate_hz analysis_audio_channel_count analysis_audio_sample_count analysis_audio_duration_us".split()),
    required=("job_id", "media_asset_id"),
)
#: What a snapshot shares with the prepared result that it was taken of.
FROZEN = tuple("analysis_audio_sha256 analysis_audio_bytes analysis_audio_sample_rate_hz analysis_audio_channel_count analysis_audio_sample_count analysis_audio_duration_us preprocessing_contract_sha256".split())
#: Files of a prepared asset, by the column that names each.
ARTIFACTS = {"proxy_path": "proxy.mp4", "analysis_audio_path": "audio.wav", "timestamp_map_path": "timestamp-map.json", "manifest_path": "preprocessing-manifest.json"}


def path_rules(source: Column, contract: Column) -> dict[str, Column]:
    """The source path is canonical and in a folder of its own below Media; each artifact has exactly its derived path."""
    canonical = (relative_path(source) == source) & source.rlike(r"^Media/[^/]+(/[^/]+)*/[^/]+$")
    folder = F.regexp_extract(source, r"^(.*)/[^/]*$", 1)
    return {"path:source": canonical} | {f"path:{c}": F.col(c) == prepared_path(folder, contract, F.lit(leaf)) for c, leaf in ARTIFACTS.items()}


def of_asset(prepared: DataFrame, assets: DataFrame) -> DataFrame:
    """media_asset_id, rule of prepared results against their assets (media_asset_id, sha256, byte_length, path).

    unknown_asset where there is none (a null id has none); differs:source_sha256 and differs:source_bytes; path rules of
    path_rules(). Asset ids are unique; results that repeat are judged one by one.
    """
    known = assets.select(F.col("media_asset_id").alias("__of"), F.struct("sha256", "byte_length", "path").alias("__asset"))
    rows = prepared.join(known, F.col("media_asset_id") == F.col("__of"), "left")
    asset = F.col("__asset")
    rules = {"differs:source_sha256": F.col("source_sha256") == asset["sha256"], "differs:source_bytes": F.col("source_bytes") == asset["byte_length"]} | path_rules(asset["path"], F.col("preprocessing_contract_sha256"))
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]))
    return rows.select("media_asset_id", F.explode(F.when(asset.isNull(), F.array(F.lit("unknown_asset"))).otherwise(broken)).alias("rule"))


def of_prepared(snapshots: DataFrame, prepared: DataFrame) -> DataFrame:
    """job_id, media_asset_id, rule of snapshots that no longer match the prepared result of their asset.

    unknown_result where there is none, else differs:<column> of FROZEN, nulls equal to nulls. Results are unique by asset.
    """
    known = prepared.select(F.col("media_asset_id").alias("__of"), F.struct(*FROZEN).alias("__was"))
    rows = snapshots.join(known, F.col("media_asset_id") == F.col("__of"), "left")
    broken = F.array_compact(F.array(*[F.when(~F.col(c).eqNullSafe(F.col("__was")[c]), F.lit(f"differs:{c}")) for c in FROZEN]))
    return rows.select("job_id", "media_asset_id", F.explode(F.when(F.col("__was").isNull(), F.array(F.lit("unknown_result"))).otherwise(broken)).alias("rule"))


def profile_faults(profiles: DataFrame, groups: DataFrame, videos: DataFrame, conditions: tuple[str, ...]) -> DataFrame:
    """profile, part (profile, group or video), item (its id as text), rule of all that a stored profile must have right.

    profiles: profile, display_name, workspace_root, readiness. groups: profile, grp, name. videos: profile, video, file_path,
    date_label, condition, sort_order, grp. Ids and texts are required; group ids, group names (in any case) and video ids are
    unique within their profile, all that repeat are faults; a video's group (null: none) is one of its own profile. Counts of
    what repeats are joined back, so that one hot name spreads. Rows of a null profile are judged as one profile's.
    """
    full = lambda c: F.col(c).isNotNull() & (F.trim(c) != "")

    def marked(rows: DataFrame, part: str, item: str, rules: dict[str, Column]) -> DataFrame:
        broken = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]))
        return rows.select("profile", F.lit(part).alias("part"), F.col(item).cast("string").alias("item"), F.explode(broken).alias("rule"))

    def repeats(rows: DataFrame, part: str, item: str, value: Column, rule: str) -> DataFrame:
        pair = F.when(value.isNotNull(), F.struct(F.col("profile").alias("p"), value.alias("v")))
        return quality.repeated(rows, pair).select("profile", F.lit(part).alias("part"), F.col(item).cast("string").alias("item"), F.lit(rule).alias("rule"))

    own = groups.select(F.col("profile").alias("__p"), F.col("grp").alias("__g")).distinct()
    strangers = videos.where(F.col("grp").isNotNull()).join(own, F.col("profile").eqNullSafe(F.col("__p")) & (F.col("grp") == F.col("__g")), "left_anti")
    return (
        marked(profiles, "profile", "profile", {"id": F.col("profile").isNotNull(), "display_name": full("display_name"), "workspace_root": full("workspace_root"), "readiness": full("readiness")})
        .unionByName(marked(groups, "group", "grp", {"id": F.col("grp").isNotNull(), "name": group_name_ok(F.col("name"))}))
        .unionByName(repeats(groups, "group", "grp", F.col("grp").cast("string"), "unique_id"))
        .unionByName(repeats(groups, "group", "grp", F.lower("name"), "unique_name"))
        .unionByName(marked(videos, "video", "video", {"id": F.col("video").isNotNull(), "file_path": full("file_path"), "date_label": F.col("date_label").isNotNull(), "condition": F.col("condition").isin(*conditions), "sort_order": F.col("sort_order") >= 0}))
        .unionByName(repeats(videos, "video", "video", F.col("video").cast("string"), "unique_id"))
        .unionByName(strangers.select("profile", F.lit("video").alias("part"), F.col("video").cast("string").alias("item"), F.lit("group_of_profile").alias("rule")))
    )
