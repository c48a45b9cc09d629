"""String, path and format expressions. Each takes and returns columns; nothing here runs Python per row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_fold(c: Column) -> Column:
    """Folds A-Z only, as a case-blind index that knows ASCII would; use lower() where all letters fold."""
    return F.translate(c, UPPER, LOWER)


def is_sha256(c: Column) -> Column:
    return F.coalesce(c.rlike(r"^[0-9a-f]{64}\z"), F.lit(False))


def canonical_integer(c: Column) -> Column:
    """Integers in their one canonical form, of at most 64 characters; anything else is null."""
    return F.when(c.rlike(r"^(0|-?[1-9][0-9]*)\z") & (F.length(c) <= 64), c)


def safe_name(c: Column, fallback: str = "recording") -> Column:
    """Lower-case letters and digits, other runs as one dash, at most 48 characters (49 where the 48th follows a dash)."""
    runs = F.regexp_replace(ascii_fold(F.trim(c)), r"[^a-z0-9]+", "-")
    whole = F.regexp_replace(runs, r"^-", "")
    # the count stops once 48 are written; a dash at place 48 is written with the letter behind it
    cut = F.when(F.substring(whole, 48, 1) == "-", F.substring(whole, 1, 49)).otherwise(F.substring(whole, 1, 48))
    named = F.regexp_replace(cut, r"-+$", "")
    return F.when(F.coalesce(F.length(named), F.lit(0)) == 0, F.lit(fallback)).otherwise(named)


def file_stem(c: Column) -> Column:
    """Name after the last slash of either kind, without its last extension unless the dot comes first."""
    leaf = F.regexp_extract(c, r"([^/\\]*)\z", 1)
    return F.when(leaf.rlike(r"^.+\.[^.]*\z"), F.regexp_replace(leaf, r"\.[^.]*\z", "")).otherwise(leaf)


def short_id(c: Column) -> Column:
    return F.substring(F.replace(c, F.lit("-"), F.lit("")), 1, 12)


def relative_path(c: Column, longest: int = 1024) -> Column:
    """Slash-joined relative path; null where it is rooted, climbs, has untrimmed or dotted ends, or is too long."""
    slashed = F.translate(c, "\\", "/")
    parts = F.filter(F.split(slashed, "/", -1), lambda p: p != "")
    bad = F.exists(parts, lambda p: p.isin(".", "..") | (F.trim(p) != p) | p.endswith(".") | p.rlike(r'[<>:"|?*\p{Cc}]'))
    rooted = slashed.startswith("/") | slashed.rlike(r"^[A-Za-z]:")
    joined = F.array_join(parts, "/")
    return F.when(~(rooted | bad) & (F.size(parts) > 0) & (F.length(joined) <= longest), joined)


def path_under(c: Column, root: str) -> Column:
    """A relative path whose first part equals root in any case, with root's own case; else null."""
    path = relative_path(c)
    head = F.substring_index(path, "/", 1)
    rest = F.substring(path, len(root) + 1, 1 << 20)
    return F.when((F.lower(head) == root.lower()) & (F.length(path) > len(root) + 1), F.concat(F.lit(root), rest))


def ancestors(c: Column) -> Column:
    """Every slash-ended prefix of a path, and the path itself slash-ended; a scheme alone is no place, so those of a URL start at its host."""
    parts = F.split(F.rtrim(c, F.lit("/")), "/", -1)
    first = F.when(c.rlike(r"^[A-Za-z][A-Za-z0-9+.-]+://[^/]"), 3).otherwise(1)
    return F.transform(F.sequence(first, F.size(parts)), lambda n: F.concat(F.array_join(F.slice(parts, F.lit(1), n), "/"), F.lit("/")))


def sanitized_error(c: Column, longest: int = 2048) -> Column:
    """Control characters as spaces, trimmed before and after the cut; blank is null."""
    flat = F.trim(F.regexp_replace(c, r"\p{Cc}", " "))
    return F.nullif(F.rtrim(F.substring(flat, 1, longest)), F.lit(""))


def public_failure(c: Column, generic: str) -> Column:
    """A failure text fit to show, or the generic one where it is long, raw or names paths."""
    raw = (F.length(c) > 512) | c.rlike(r"[\p{Cc}{}\[\]\\/]") | F.lower(c).contains("file:")
    return F.when(c.isNull() | (F.trim(c) == ""), F.lit(None)).when(raw, F.lit(generic)).otherwise(F.trim(c))


def bounded_text(c: Column, longest: int) -> Column:
    return F.coalesce((F.trim(c) != "") & (F.length(c) <= longest) & ~c.rlike(r"\p{Cc}"), F.lit(False))


def group_name_ok(c: Column) -> Column:
    return bounded_text(c, 200) & (F.trim(c) == c) & (F.lower(c) != "unassigned")


def version_matches(c: Column, version: str) -> Column:
    """Equal, or the version followed by something that is not a letter or digit."""
    return F.coalesce((c == version) | (c.startswith(version) & ~F.substring(c, len(version) + 1, 1).rlike(r"^[\p{L}\p{N}]")), F.lit(False))


def csv_has(c: Column, token: str) -> Column:
    return F.coalesce(F.array_contains(F.transform(F.split(c, ",", -1), lambda t: F.lower(F.trim(t))), token.lower()), F.lit(False))


def format_bytes(c: Column) -> Column:
    """Whole bytes under 1,024, else one decimal of the largest unit up to TiB."""
    out = F.concat(F.format_number(c, 0), F.lit(" B"))
    for power, unit in enumerate(("KiB", "MiB", "GiB", "TiB"), 1):
        out = F.when(c >= 1024**power, F.concat(F.format_number(c / F.lit(float(1024**power)), 1), F.lit(f" {unit}"))).otherwise(out)
    return out


def contract_hash(*fields: Column) -> Column:
    """SHA-256 of the fields as lines."""
    return F.sha2(F.concat_ws("\n", *fields), 256)


def tagged_hash(**fields: Column) -> Column:
    """SHA-256 of name=length:value lines, lengths in UTF-16 units, so that no two field lists run together."""
    units = lambda c: F.floor(F.octet_length(F.encode(c, "UTF-16BE")) / 2).cast("string")
    lines = [F.concat(F.lit(f"{n}="), units(c), F.lit(":"), c, F.lit("\n")) for n, c in fields.items()]
    return F.sha2(F.concat(*lines), 256)


def canonical_path(c: Column) -> Column:
    """The path without . and .. and empty parts, slash-joined behind its root (/, a drive or a share); null where it holds a
    NUL character. What climbs above a root stays at it; a relative path keeps the .. that it begins with."""
    slashed = F.translate(c, "\\", "/")
    root = F.regexp_extract(slashed, r"^(//[^/]+/[^/]+|[A-Za-z]:(?=/|$)|(?=/))", 1)
    rooted = (root != "") | slashed.startswith("/")
    parts = F.filter(F.split(F.substring(slashed, F.length(root) + 1, F.length(slashed)), "/", -1), lambda p: ~p.isin("", "."))
    up = lambda a: F.size(a) > F.when(F.coalesce(F.get(a, F.size(a) - 1) == "..", F.lit(False)), F.size(a)).otherwise(0)
    step = lambda a, p: F.when(p != "..", F.concat(a, F.array(p))).when(up(a), F.slice(a, 1, F.size(a) - 1)).when(rooted, a).otherwise(F.concat(a, F.array(p)))
    joined = F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/")
    return F.when(~F.contains(c, F.lit("\0")), F.concat(root, F.when(rooted, "/").otherwise(""), joined))


def workspace_problem(c: Column) -> Column:
    """Why a folder cannot hold a workspace, or null: blank, not absolute, or the root of a drive, share or file system."""
    path = F.trim(c)
    root = path.rlike(r"^(/+|[A-Za-z]:[\\/]*|[\\/]{2}[^\\/]+[\\/]+[^\\/]+[\\/]*)\z")
    return F.when(c.isNull() | (path == ""), "select a folder").when(~path.rlike(r"^(/|[A-Za-z]:[\\/]|\\\\)"), "not absolute").when(root, "a root")


def asset_dir(label: Column, source: Column, id_: Column) -> Column:
    """label_source_shortid, each part a safe name."""
    stem = F.when(source.isNull() | (F.trim(source) == ""), "media").otherwise(file_stem(source))
    return F.concat_ws("_", safe_name(label, "recording"), safe_name(stem, "media"), short_id(id_))


def job_path(id_: Column, created: Column) -> Column:
    """Processing/<UTC time to 100 ns>_local-media_<short id>; the session's time zone must be UTC. The seventh digit is 0."""
    return F.concat(F.lit("Processing/"), F.date_format(created, "yyyyMMdd'T'HHmmssSSSSSS"), F.lit("0Z_local-media_"), short_id(id_))


def prepared_path(directory: Column, contract: Column, leaf: Column) -> Column:
    """<directory>/Prepared/v1_<first 12 of the contract hash>/<leaf>"""
    return F.concat_ws("/", directory, F.lit("Prepared"), F.concat(F.lit("v1_"), F.substring(contract, 1, 12)), leaf)


#: Phrases by which a decoder says that it lacks a codec.
NO_CODEC = ("decoder not found", "no decoder found", "unknown decoder", "unsupported codec", "decoding requested, but no decoder")


def codec_missing(log: Column) -> Column:
    """A log names a missing decoder, in any case; null is none."""
    return F.coalesce(F.lower(log).rlike("|".join(NO_CODEC)), F.lit(False))


def shown(c: Column, names: dict[str, str]) -> Column:
    """Display text of a state; one that is not named stays as it is."""
    out = c
    for value, name in names.items():
        out = F.when(c == value, name).otherwise(out)
    return out


#: States of readiness in which a job runs or a repair is due, and those that a job can go on from.
BUSY = ("IngestingMedia", "ValidatingMedia", "PreprocessingMedia", "ExtractingAudioObservations", "MediaIntegrityFailed")
RESUMABLE = ("MediaIngestedAwaitingProbe", "MediaValidationFailed", "MediaValidated", "MediaPreprocessingFailed", "MediaPrepared", "AudioObservationFailed")


def can_process(readiness: Column, pending: Column) -> Column:
    """No job runs, no repair is due, and something is pending or can go on; a null readiness is no state, a null count is 0."""
    state = F.coalesce(readiness, F.lit(""))
    return ~state.isin(*BUSY) & ((F.coalesce(pending, F.lit(0)) > 0) | state.isin(*RESUMABLE))


def major_brand(c: Column) -> Column:
    """Exactly four printable ASCII characters, else null."""
    return F.when(c.rlike(r"^[ -~]{4}\z"), c)


def banner_value(log: Column, prefix: str) -> Column:
    """Rest of the first line of a tool's banner with this prefix, trimmed; null without one."""
    return F.nullif(F.trim(F.regexp_extract(log, rf"(?m)^\Q{prefix}\E[ \t]*([^\r\n]*)", 1)), F.lit(""))
