"""Probe documents and tool logs as columns: container and stream checks, first time stamps, progress and metrics."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerlens.functions.text import csv_has
from ledgerlens.functions.timeline import rational, seconds_to_us

PROBE = """format STRUCT<format_name: STRING, duration: STRING, tags: STRUCT<major_brand: STRING>>,
streams ARRAY<STRUCT<index: INT, codec_type: STRING, codec_name: STRING, width: INT, height: INT, avg_frame_rate: STRING, r_frame_rate: STRING,
sample_rate: STRING, channels: INT, disposition: STRUCT<default: INT, attached_pic: INT>>>"""
FRAMES = "frames ARRAY<STRUCT<stream_index: INT, best_effort_timestamp_time: STRING, pts_time: STRING>>"


def parsed(json: Column) -> Column:
    return F.from_json(json, PROBE)


def _rate(s: Column) -> Column:
    return F.coalesce(rational(s["avg_frame_rate"]), rational(s["r_frame_rate"]))


def _video_ok(s: Column) -> Column:
    area = s["width"].cast("long") * s["height"].cast("long")
    return F.coalesce(s["codec_name"].isNotNull() & s["width"].between(1, 32768) & s["height"].between(1, 32768) & (area <= 268_435_456), F.lit(False))


def _rate_ok(rate: Column) -> Column:
    return F.coalesce(rate["num"] / rate["den"] <= 1000, F.lit(False))  # both are positive


def _audio_ok(s: Column) -> Column:
    rate = s["sample_rate"].try_cast("int")
    return F.coalesce(s["codec_name"].isNotNull() & rate.between(1, 768_000) & s["channels"].between(1, 64), F.lit(False))


def real(streams: Column, kind: str) -> Column:
    """The streams of a kind that are no attached pictures."""
    return F.filter(streams, lambda s: (s["codec_type"] == kind) & (F.coalesce(s["disposition"]["attached_pic"], F.lit(0)) == 0))


def selected(streams: Column, kind: str, among: Column | None = None) -> Column:
    """struct stream, problem: the only sane stream of a kind, or the only default one of several.

    among is what real() gives for streams, from a caller that has it as a column.
    """
    among = real(streams, kind) if among is None else among
    default = F.filter(among, lambda s: F.coalesce(s["disposition"]["default"], F.lit(0)) == 1)
    name = kind.capitalize()
    # rates are read once into a list, not once for each comparison
    sane = F.forall(among, _video_ok) & F.forall(F.transform(among, _rate), _rate_ok) if kind == "video" else F.forall(among, _audio_ok)
    found = lambda streams: F.struct(F.get(streams, F.lit(0)).alias("stream"), F.lit(None).cast("string").alias("problem"))
    failed = lambda problem: F.struct(F.lit(None).alias("stream"), F.lit(problem).alias("problem"))
    return (
        F.when(F.size(among) == 0, failed(f"Missing{name}Stream"))
        .when(~sane, failed(f"Invalid{name}Stream"))
        .when(F.size(among) == 1, found(among))
        .when(F.size(default) == 1, found(default))
        .otherwise(failed(f"Ambiguous{name}Streams"))
    )


def verdict(json: Column, doc: Column | None = None, video: Column | None = None, audio: Column | None = None) -> Column:
    """Accepted, or the first failure: malformed, container, duration, video, audio.

    doc, video and audio are what parsed() and selected() give for json: a caller that has them as columns of an earlier
    select passes them on, so that each is evaluated once a row.
    """
    doc = parsed(json) if doc is None else doc
    streams = doc["streams"]
    video = selected(streams, "video") if video is None else video
    audio = selected(streams, "audio") if audio is None else audio
    index = streams["index"]
    malformed = doc["format"].isNull() | streams.isNull() | F.exists(index, lambda i: i.isNull() | (i < 0)) | (F.size(F.array_distinct(index)) != F.size(index))
    brand = F.lower(doc["format"]["tags"]["major_brand"])
    other = F.coalesce(brand.startswith("qt") | brand.startswith("3gp") | brand.startswith("3g2"), F.lit(False))
    return F.coalesce(
        F.when(F.coalesce(malformed, F.lit(True)), "ProbeOutputMalformed")
        .when(~csv_has(doc["format"]["format_name"], "mp4") | other, "UnsupportedContainer")
        .when(seconds_to_us(doc["format"]["duration"]).isNull(), "InvalidDuration"),
        video["problem"],
        audio["problem"],
        F.lit("Accepted"),
    )


def first_time_us(json: Column, stream: Column) -> Column:
    """Microseconds of the first decoded frame of a stream."""
    frames = F.filter(F.from_json(json, FRAMES)["frames"], lambda f: f["stream_index"] == stream)
    first = F.get(frames, F.lit(0))
    return F.round(F.coalesce(first["best_effort_timestamp_time"].try_cast("decimal(28,9)"), first["pts_time"].try_cast("decimal(28,9)")) * 1_000_000, 0).cast("long")


def last_value(log: Column, name: str) -> Column:
    """Value of the last name=value line of a progress log."""
    return F.try_element_at(F.regexp_extract_all(log, F.lit(rf"(?m)^{name}=([^\r\n]*)"), F.lit(1)), F.lit(-1))


def completed_us(log: Column) -> Column:
    """Last out_time_us of a log whose last progress is end; else null."""
    return F.when(F.trim(last_value(log, "progress")) == "end", F.trim(last_value(log, "out_time_us")).try_cast("long"))


def frame_variation(log: Column) -> Column:
    """struct ratio, variable, constant of the last VFR line; zeros without one, null ratio where it is not finite."""
    last = F.try_element_at(F.regexp_extract_all(log, F.lit(r"(VFR:\S+ \(\d+/\d+\))"), F.lit(1)), F.lit(-1))
    part = lambda k: F.regexp_extract(last, r"VFR:(\S+) \((\d+)/(\d+)\)", k)
    ratio = part(1).try_cast("double")
    count = lambda k: F.coalesce(part(k).try_cast("long"), F.lit(0))
    return F.struct(F.when(~F.isnan(ratio) & (F.abs(ratio) < float("inf")), ratio).alias("ratio"), count(2).alias("variable"), count(3).alias("constant"))


def last_metric(log: Column, marker: str) -> Column:
    """Last finite number behind a marker in a log."""
    values = F.transform(F.regexp_extract_all(log, F.lit(rf"\Q{marker}\E\s*:?\s*(\S+)"), F.lit(1)), lambda v: v.try_cast("double"))
    return F.try_element_at(F.filter(values, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))), F.lit(-1))
