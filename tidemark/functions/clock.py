"""Cue times: text to milliseconds and back, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TIMESTAMP = r"^(?:(\d+):)?(\d+):(\d+)[,.](\d+)$"


def to_ms(text: Column) -> Column:
    """`[H:]M:S,fff` to milliseconds; null where the text is no time."""
    part = lambda i: F.coalesce(F.nullif(F.regexp_extract(F.trim(text), TIMESTAMP, i), F.lit("")).cast("long"), F.lit(0).cast("long"))
    return F.when(F.trim(text).rlike(TIMESTAMP), ((part(1) * 60 + part(2)) * 60 + part(3)) * 1000 + part(4))


def ass_to_ms(text: Column) -> Column:
    """`H:M:S.cc` to milliseconds, whole centiseconds."""
    part = lambda i: F.regexp_extract(F.trim(text), r"^(\d+):(\d+):(\d+)\.(\d+)", i).try_cast("long")
    return ((part(1) * 60 + part(2)) * 60 + part(3)) * 1000 + part(4) * 10


def to_whole_ms(ts: Column) -> Column:
    """A timestamp at the nearest whole millisecond, halves away from 1970."""
    moved = F.unix_micros(ts) + F.when(F.unix_micros(ts) < 0, -500).otherwise(500)
    return F.timestamp_micros(moved - moved % 1000)


def _hms(seconds: Column) -> tuple[Column, Column, Column]:
    return F.floor(seconds / 3600), F.floor(seconds % 3600 / 60), seconds % 60


def _two(x: Column) -> Column:
    """At least two digits; lpad alone would cut longer numbers."""
    return F.when(x < 10, F.concat(F.lit("0"), x.cast("string"))).otherwise(x.cast("string"))


def srt_time(ms: Column) -> Column:
    clamped = F.greatest(F.lit(0), ms).cast("long")
    h, m, s = _hms(F.floor(clamped / 1000))
    return F.concat(_two(h), F.lit(":"), _two(m), F.lit(":"), _two(s), F.lit(","), F.lpad((clamped % 1000).cast("string"), 3, "0"))


def vtt_time(ms: Column) -> Column:
    return F.replace(srt_time(ms), F.lit(","), F.lit("."))


def ass_time(ms: Column) -> Column:
    centis = F.floor((F.greatest(F.lit(0), ms).cast("long") + 5) / 10)
    h, m, s = _hms(F.floor(centis / 100))
    return F.concat(h.cast("string"), F.lit(":"), _two(m), F.lit(":"), _two(s), F.lit("."), F.lpad((centis % 100).cast("string"), 2, "0"))
