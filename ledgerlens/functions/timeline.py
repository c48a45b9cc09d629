"""Exact time and ratio expressions over whole microseconds."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_LONG = (1 << 63) - 1


def samples_to_us(n: Column, rate: int = 16_000) -> Column:
    """Half away from zero."""
    return F.round(n.cast("decimal(20,0)") * F.lit(1_000_000).cast("decimal(7,0)") / F.lit(rate).cast("decimal(6,0)"), 0).cast("long")


def seconds_to_us(text: Column) -> Column:
    """Decimal seconds as microseconds, half away from zero; null unless positive."""
    us = F.round(text.try_cast("decimal(28,9)") * F.lit(1_000_000).cast("decimal(7,0)"), 0).try_cast("long")
    return F.when(us > 0, us)


def rational(text: Column) -> Column:
    """struct num, den of digits/digits, both positive; else null."""
    positive = text.rlike(r"^(?=[0-9]{1,18}/[0-9]{1,18}\z)0*[1-9][0-9]*/0*[1-9]")  # one match; the parts need none of their own
    part = lambda k: F.substring_index(text, "/", k).try_cast("long")
    return F.when(positive, F.struct(part(1).alias("num"), part(-1).alias("den")))


def greatest_divisor(a: Column, b: Column, steps: int = 92, then: Callable[[Column], Column] = lambda g: g) -> Column:
    """Euclid in a bounded number of steps: 92 suffice for any two longs. Gives what then makes of the divisor."""
    a, b = F.abs(a), F.abs(b)

    def two(s: Column, _: Column) -> Column:
        rest = F.try_mod(s["a"], s["b"])
        return F.when(s["b"] == 0, s).otherwise(F.struct(F.when(rest == 0, s["b"]).otherwise(rest).alias("a"), F.coalesce(F.try_mod(s["b"], rest), F.lit(0)).alias("b")))

    # Lame: two numbers take 2 + 1.4405 log2 of the smaller one steps at most; no logarithm (zero, null) leaves all of them
    pairs = F.least((F.floor(F.log2(F.least(a, b)) * 0.7203) + 2).cast("int"), F.lit((steps + 1) // 2))
    return F.aggregate(F.sequence(F.lit(1), pairs), F.struct(a.alias("a"), b.alias("b")), two, lambda s: then(s["a"]))


def _whole(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def reduced(num: Column, den: Column) -> Column:
    """struct num, den without their greatest divisor, found once a row."""
    return greatest_divisor(num, den, then=lambda g: F.struct(_whole(num, g).alias("num"), _whole(den, g).alias("den")))


def mapped_time(target: Column, duration: Column, origin: Column) -> Column:
    """Target clamped to 0..duration, plus origin; stays at the largest long instead of overflowing."""
    inside = F.greatest(F.lit(0).cast("long"), F.least(target, duration))
    return F.coalesce(F.try_add(origin, inside), F.lit(MAX_LONG))


def format_timeline(us: Column) -> Column:
    """Signed HH:MM:SS.mmm, hours unbounded, cut to milliseconds."""
    ms = F.floor(F.abs(us.cast("decimal(20,0)")) / F.lit(1000)).cast("long")  # the smallest long has no positive one
    part = lambda unit, base: F.floor(ms / unit) % base if base else F.floor(ms / unit)
    text = F.format_string("%02d:%02d:%02d.%03d", part(3_600_000, 0), part(60_000, 60), part(1_000, 60), ms % 1000)
    return F.concat(F.when(us < 0, F.lit("-")).otherwise(F.lit("")), text)


def origin_us(video: Column, audio: Column) -> Column:
    """The earlier of the first times of two streams; null if either is unknown."""
    return F.when(video.isNotNull() & audio.isNotNull(), F.least(video, audio))


def mapped_duration_us(proxy: Column, audio: Column) -> Column:
    """The longer of two durations; null if either is unknown."""
    return F.when(proxy.isNotNull() & audio.isNotNull(), F.greatest(proxy, audio))
