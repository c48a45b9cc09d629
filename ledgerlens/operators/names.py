"""Names for internal columns."""

from __future__ import annotations

from pyspark.sql import DataFrame


def fresh(stem: str, *frames: DataFrame) -> str:
    """The stem, with as many underscores behind it as make it no column of any of the frames (case ignored)."""
    taken = {c.lower() for f in frames for c in f.columns}
    while stem.lower() in taken:
        stem += "_"
    return stem
