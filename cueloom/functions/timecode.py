"""Seconds to text and back; all functions take and give columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def _clock(seconds: Column, mark: str) -> Column:
    ms = F.greatest(F.lit(0).cast("long"), F.rint(seconds * 1000).cast("long"))
    s = F.floor(ms / 1000)
    return F.format_string(f"%02d:%02d:%02d{mark}%03d", F.floor(s / 3600), F.floor(s / 60) % 60, s % 60, ms % 1000)


def srt_time(seconds: Column) -> Column:
    """HH:MM:SS,mmm, rounded half to even, never negative; hours may take more digits."""
    return _clock(seconds, ",")


def vtt_time(seconds: Column) -> Column:
    """HH:MM:SS.mmm."""
    return _clock(seconds, ".")


def lrc_time(seconds: Column) -> Column:
    """[mm:ss.xx], minutes unbounded."""
    cs = F.rint(F.greatest(F.lit(0.0), seconds) * 100).cast("long")
    return F.format_string("[%02d:%02d.%02d]", F.floor(cs / 6000), F.floor(cs / 100) % 60, cs % 100)


def human_time(seconds: Column) -> Column:
    """mm:ss.s, or h:mm:ss.s from an hour on."""
    s = F.greatest(F.lit(0.0), seconds)
    minutes = F.floor(s / 60).cast("long")
    tenths = F.rint((s - minutes * 60) * 10).cast("long")
    rest = F.format_string("%02d:%02d.%d", minutes % 60, F.floor(tenths / 10), tenths % 10)
    return F.when(minutes >= 60, F.concat(F.floor(minutes / 60).cast("string"), F.lit(":"), rest)).otherwise(rest)


CLOCK = r"^(\d{2}):(\d{2}):(\d{2})[,.](\d{3})"


def parse_clock(text: Column) -> Column:
    """Seconds of a leading HH:MM:SS,mmm; null if there is none. What follows is ignored."""
    part = lambda i: F.regexp_extract(text, CLOCK, i).cast("double")
    return F.when(text.rlike(CLOCK), part(1) * 3600.0 + part(2) * 60.0 + part(3) + part(4) / 1000.0)


def chunk_stem(index: Column, start: Column, end: Column) -> Column:
    """File stem of a window: its number and bounds in a fixed format."""
    ms = lambda x: F.rint(x * 1000).cast("long")
    fixed = lambda x: F.format_string("%d.%03d", F.floor(ms(x) / 1000), ms(x) % 1000)
    return F.concat(F.format_string("chunk-%05d-", index.cast("long")), fixed(start), F.lit("-"), fixed(end))
