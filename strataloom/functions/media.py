"""Rates, times, names and colours as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..params import NTSC_RATES

CLIP_NAME = r"^(\d+) (CLIP|LONG) (\d+) - (.+?)\.mp4$"
VIDEO_URL = r"^https?://(?:www\.)?[^/]+/([^/?#]+)/videos?/([0-9a-fA-F-]{36})"


def rational(text: Column) -> Column:
    """num/den as a double."""
    parts = F.split(text, "/")
    return F.try_divide(F.get(parts, F.lit(0)).cast("double"), F.coalesce(F.get(parts, F.lit(1)).cast("double"), F.lit(1.0)))


def rate_class(fps: Column) -> tuple[Column, Column]:
    """Timebase and whether the rate is an NTSC one (within 0.01)."""
    base, ntsc = F.bround(fps).cast("long"), F.lit(False)
    for rate, timebase in reversed(NTSC_RATES):
        near = F.abs(fps - rate) < 0.01
        base, ntsc = F.when(near, F.lit(timebase).cast("long")).otherwise(base), F.when(near, F.lit(True)).otherwise(ntsc)
    return base, ntsc


def clip_name(name: Column) -> dict[str, Column]:
    """rank, kind, score and title of a ranked clip's file name; null for other names."""
    ok = name.rlike(CLIP_NAME)
    part = lambda k: F.when(ok, F.regexp_extract(name, CLIP_NAME, k))
    return {"rank": part(1).cast("int"), "kind": part(2), "score": part(3).cast("int"), "title": F.replace(part(4), F.lit("-"), F.lit(" "))}


def video_url(url: Column) -> dict[str, Column]:
    """handle and uuid of a video URL, and the milliseconds of a version-7 uuid (null for others)."""
    part = lambda k: F.nullif(F.regexp_extract(url, VIDEO_URL, k), F.lit(""))
    return {"handle": part(1), "uuid": part(2), "created_ms": uuid7_millis(part(2))}


def uuid7_millis(uuid: Column) -> Column:
    digits = F.lower(F.replace(uuid, F.lit("-"), F.lit("")))
    return F.when((F.length(digits) == 32) & (F.substring(digits, 13, 1) == "7"), F.conv(F.substring(digits, 1, 12), 16, 10).cast("long"))


def iso_millis(text: Column) -> Column:
    """Epoch milliseconds of an ISO-8601 time; one without a zone is UTC (the session's zone should be UTC)."""
    return F.unix_millis(F.coalesce(F.try_to_timestamp(F.trim(text)), F.try_to_timestamp(F.substring(F.trim(text), 1, 19), F.lit("yyyy-MM-dd HH:mm:ss"))))


def luminance(colour: Column) -> Column:
    """Relative luminance, 0 to 1, of #RGB or #RRGGBB."""
    h = F.replace(colour, F.lit("#"), F.lit(""))
    full = F.when(F.length(h) == 3, F.regexp_replace(h, "(.)", "$1$1")).otherwise(h)
    channel = lambda k: F.conv(F.substring(full, k, 2), 16, 10).cast("int") / 255
    return 0.2126 * channel(1) + 0.7152 * channel(3) + 0.0722 * channel(5)


def chip_size(text: Column, width: Column, height: Column) -> Column:
    base = F.least(width, height) * 0.076
    return F.when(F.length(text) > 10, base * (F.lit(10) / F.length(text))).otherwise(base)


def headline_size(text: Column, width: Column, height: Column) -> Column:
    size = F.least(width, height) * 0.1026
    estimate = F.length(text) * size * 0.62 + size * 0.8
    return F.when(estimate > width * 0.87, size * (width * 0.87 / estimate)).otherwise(size)


def even_down(x: Column) -> Column:
    return x - F.pmod(x, F.lit(2))


def density(n: Column, speech: Column, seconds: Column, full_rate: float = 3.2) -> Column:
    """45 points for the rate of words (to 1.3 of full_rate) and 45 for the share of speech."""
    return F.least(n / seconds / full_rate, F.lit(1.3)) * 45 + F.least(speech / seconds, F.lit(1.0)) * 45


def start_frame(seconds: Column, fps) -> Column:
    return F.floor(seconds * fps).cast("long")


def end_frame(seconds: Column, fps) -> Column:
    return F.ceil(seconds * fps).cast("long")


def nearest_frame(seconds: Column, fps) -> Column:
    """Half to even."""
    return F.bround(seconds * fps).cast("long")


def flipped_box(box: Column, width: Column, height: Column) -> Column:
    """A box of shares with y from the bottom, as pixels from the top."""
    return F.struct((box["x"] * width).alias("x"), ((1 - box["y"] - box["h"]) * height).alias("y"), (box["w"] * width).alias("w"), (box["h"] * height).alias("h"), box["conf"].alias("conf"))
