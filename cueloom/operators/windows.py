"""Interval and window planning. Inputs are keyed by ``media_id``; all shuffles are on that key.

Sequential rules that no window frame can say (bin packing) are one pass over a
media's sorted intervals, on Arrow batches; everything else is window functions
and generators, with frames that only grow.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.functions import arrow_udf

from ..functions import text as T


@dataclass(frozen=True)
class SpeechPlan:
    padding: float = 0.25
    chunk: float = 120.0
    hard_chunk: float = 240.0
    silence: float = 8.0
    short: float = 180.0


TILE, OVERLAP = 30.0, 1.0


def merged_intervals(speech: DataFrame, media: DataFrame, padding: float = 0.25) -> DataFrame:
    """Padded, clamped to the media's duration and merged where they overlap or touch.

    ``speech`` has media_id, start, end; ``media`` has media_id and duration. Intervals without length go.
    """
    clamped = speech.where(F.col("end") > F.col("start")).join(media.select("media_id", "duration"), "media_id")
    clamped = clamped.select("media_id", F.greatest(F.lit(0.0), F.col("start") - padding).alias("start"), F.least("duration", F.col("end") + padding).alias("end"))
    before = Window.partitionBy("media_id").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("media_id").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, 0)
    opens = F.coalesce(F.col("start") > F.max("end").over(before), F.lit(True)).cast("int")
    runs = clamped.withColumn("opens", opens).withColumn("run", F.sum("opens").over(upto))
    return runs.groupBy("media_id", "run").agg(F.min("start").alias("start"), F.max("end").alias("end")).select("media_id", "start", "end")


def split_interval(start: Column, end: Column, most: float) -> Column:
    """Array of (start, end): parts of at most ``most``, the last the shortest; one part if ``most`` is not positive."""
    if most <= 0:
        return F.array(F.struct(start.alias("start"), end.alias("end")))
    count = F.ceil((end - start) / most).cast("int")
    part = lambda i: F.struct((start + i * most).alias("start"), F.least(end, start + (i + 1) * most).alias("end"))
    return F.when(count > 0, F.transform(F.sequence(F.lit(0), count - 1), part)).otherwise(F.array().cast("array<struct<start:double,end:double>>"))


def split_intervals(intervals: DataFrame, most: float) -> DataFrame:
    """media_id, start, end of the parts."""
    return intervals.select("media_id", F.inline(split_interval(F.col("start"), F.col("end"), most)))


def _numbered(rows: DataFrame) -> DataFrame:
    """Windows with positive length, rounded to milliseconds and numbered from 1 in each media."""
    order = Window.partitionBy("media_id").orderBy("start", "end")
    kept = rows.where(F.col("end") > F.col("start"))
    return kept.select("media_id", F.row_number().over(order).alias("window_index"), F.round("start", 3).alias("start"), F.round("end", 3).alias("end"))


def packed(parts: Iterable[tuple[float, float]], plan: SpeechPlan) -> Iterator[tuple[float, float]]:
    """Sorted parts -> windows: a part joins the open window unless it is too far away or makes it too long."""
    most, start, end = min(plan.chunk, plan.hard_chunk), None, None
    for a, b in parts:
        if start is not None and (a - end > plan.silence or b - start > most):
            yield start, end
            start = None
        start, end = (a, b) if start is None else (start, max(end, b))
    if start is not None:
        yield start, end


def _packer(plan: SpeechPlan):
    @arrow_udf("array<struct<start:double,end:double>>")
    def windows(column: pa.Array) -> pa.Array:
        made = ([{"start": a, "end": b} for a, b in packed(((p["start"], p["end"]) for p in parts), plan)] for parts in column.to_pylist())
        return pa.array(made, column.type)

    return windows


def packed_windows(speech: DataFrame, media: DataFrame, plan: SpeechPlan = SpeechPlan()) -> DataFrame:
    """Greedy packing of speech into windows; media without speech are split by the hard limit."""
    parts = split_intervals(merged_intervals(speech, media, plan.padding), plan.hard_chunk)
    listed = parts.groupBy("media_id").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("parts"))
    folded = listed.select("media_id", _packer(plan)("parts").alias("windows"))
    silent = split_intervals(media.join(listed, "media_id", "left_anti").select("media_id", F.lit(0.0).alias("start"), F.col("duration").alias("end")), plan.hard_chunk)
    return _numbered(folded.select("media_id", F.inline("windows")).unionByName(silent))


def planned_windows(speech: DataFrame, media: DataFrame, detect: bool = True, plan: SpeechPlan = SpeechPlan()) -> DataFrame:
    """One window over short media, or over all if ``detect`` is off; packed windows for the others."""
    short = F.col("duration") <= plan.short if detect else F.lit(True)
    whole = media.where(short).select("media_id", F.lit(1).alias("window_index"), F.lit(0.0).alias("start"), F.greatest(F.lit(0.0), "duration").alias("end"))
    return whole.unionByName(packed_windows(speech, media.where(~short), plan)) if detect else whole


def fixed_tiles(media: DataFrame, size: float = TILE, overlap: float = OVERLAP) -> DataFrame:
    """Overlapping tiles; the last is cut at the end. No duration gives one empty window."""
    overlap = min(max(0.0, overlap), max(0.0, size - 0.001))
    step = size - overlap
    # A tile starts wherever the one before has not reached the end.
    count = F.when(F.col("duration") <= size, 1).otherwise(F.ceil((F.col("duration") - size) / step).cast("int") + 1)
    tile = lambda i: F.struct((i + 1).alias("window_index"), F.round(i * step, 3).alias("start"), F.round(F.greatest(F.lit(0.0), F.least(F.col("duration"), i * step + size)), 3).alias("end"))
    return media.select("media_id", F.inline(F.transform(F.sequence(F.lit(0), count - 1), tile)))


def without_overlap_tokens(tokens: DataFrame, windows: DataFrame) -> DataFrame:
    """Tokens (window-local times) on the media's clock; of what overlapping windows both heard, the later one's copy stays."""
    order = Window.partitionBy("media_id").orderBy("window_index")
    ahead = windows.select("media_id", "window_index", F.col("start").alias("at"), F.col("end").alias("until"), F.lead("start").over(order).alias("next"))
    heard = tokens.where((T.strip(F.col("text")) != "") & (F.col("end") >= F.col("start"))).join(ahead, ["media_id", "window_index"])
    shifted = heard.withColumn("start", F.col("start") + F.col("at")).withColumn("end", F.col("end") + F.col("at"))
    doubled = (F.col("next") < F.col("until") - 1e-9) & (F.col("start") >= F.col("next") - 1e-9)
    return shifted.where(~F.coalesce(doubled, F.lit(False))).select("media_id", "window_index", "pos", "text", "start", "end")


def refine_windows(lines: DataFrame, media: DataFrame, padding: float = 0.5) -> DataFrame:
    """A line's span and its padding, up to the middle between it and its neighbours; its span if nothing is left."""
    order = Window.partitionBy("media_id").orderBy("line_no")
    rows = lines.join(media.select("media_id", "duration"), "media_id").select(
        "media_id", "line_no", "start", "end",
        F.coalesce((F.lag("end").over(order) + F.col("start")) / 2, F.lit(0.0)).alias("low"),
        F.coalesce((F.col("end") + F.lead("start").over(order)) / 2, F.col("duration")).alias("high"),
    )
    a, b = F.greatest("low", F.col("start") - padding), F.least("high", F.col("end") + padding)
    return rows.select("media_id", "line_no", F.round(F.when(b > a, a).otherwise(F.col("start")), 3).alias("start"), F.round(F.when(b > a, b).otherwise(F.col("end")), 3).alias("end"))


def gap_sessions(rows: DataFrame, keys: list[str], order: list[str], breaks: Column | None = None, gap: float = 0.65) -> DataFrame:
    """``rows`` with group_id from 1: a new group after a pause of ``gap`` or more, or after a row where ``breaks`` holds."""
    by = Window.partitionBy(*keys).orderBy(*order)
    pause = F.greatest(F.lit(0.0), F.col("start") - F.lag("end").over(by))
    opens = F.coalesce(pause >= gap, F.lit(False))
    if breaks is not None:
        opens = opens | F.coalesce(F.lag(breaks).over(by), F.lit(False))
    flagged = rows.withColumn("opens", opens.cast("int"))
    return flagged.withColumn("group_id", (F.sum("opens").over(by.rowsBetween(Window.unboundedPreceding, 0)) + 1).cast("int")).drop("opens")


def nearest_boundaries(offsets: DataFrame, boundaries: DataFrame, keys: list[str]) -> DataFrame:
    """Each offset's nearest boundary, the smaller on ties; of offsets at one boundary the first stays.

    ``offsets`` has keys and at; ``boundaries`` keys, boundary and position. An as-of join from both sides: the
    last boundary at or before an offset and the first after it, by one sort of their union, so nothing is multiplied.
    """
    none = F.lit(None)
    both = offsets.select(*keys, F.col("at").alias("x"), F.lit(1).alias("ask"), none.cast("long").alias("b"), none.cast("int").alias("p")).unionByName(
        boundaries.select(*keys, F.col("boundary").alias("x"), F.lit(0).alias("ask"), F.col("boundary").cast("long").alias("b"), F.col("position").cast("int").alias("p"))
    )
    # Of boundaries at one place the first, with the smallest position, is known from both sides.
    by = Window.partitionBy(*keys).orderBy("x", "ask", "p")
    opens = (F.col("ask") == 0) & ~F.coalesce(F.lag("x").over(by) == F.col("x"), F.lit(False))
    both = both.withColumn("known", F.when(opens, F.struct("b", "p")))
    named = ", ".join(f"`{k}`" for k in keys)
    low, high = F.last("known", True).over(by.rowsBetween(Window.unboundedPreceding, 0)), F.expr(f"lead(known) ignore nulls over (partition by {named} order by x, ask, p)")
    asked = both.select(*keys, "x", "ask", low.alias("low"), high.alias("high")).where("ask = 1")
    nearer = F.when(F.col("low").isNull(), F.col("high")).when(F.col("high").isNull(), F.col("low")).when(F.col("x") - F.col("low.b") <= F.col("high.b") - F.col("x"), F.col("low")).otherwise(F.col("high"))
    found = asked.select(*keys, F.col("x").alias("at"), nearer.alias("n")).where("n is not null")
    return found.groupBy(*keys, F.col("n.p").alias("position")).agg(F.min("at").alias("at"))


def proportional_times(offsets: DataFrame, tokens: DataFrame, keys: list[str]) -> DataFrame:
    """Time of each character offset within its token; tokens have keys, pos, length, start and end.

    An offset belongs to the first token whose running length reaches it; found by one sort, not a range join.
    """
    running = Window.partitionBy(*keys).orderBy("pos")
    ends = tokens.withColumn("upto", F.sum("length").over(running)).withColumn("before", F.col("upto") - F.col("length"))
    firsts = ends.groupBy(*keys, "upto").agg(F.min_by(F.struct("before", "length", "start", "end"), "pos").alias("token"))
    none = F.lit(None).cast(firsts.schema["token"].dataType)
    both = offsets.select(*keys, F.col("at").cast("long").alias("x"), F.lit(1).alias("ask"), none.alias("token")).unionByName(firsts.select(*keys, F.col("upto").cast("long").alias("x"), F.lit(0).alias("ask"), "token"))
    back = Window.partitionBy(*keys).orderBy(F.col("x").desc(), "ask").rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("t", F.last("token", True).over(back)).where("ask = 1 and t is not null")
    ratio = F.when(F.col("t.length") > 0, (F.col("x") - F.col("t.before")) / F.col("t.length")).otherwise(0.5)
    return found.select(*keys, F.col("x").alias("at"), (F.col("t.start") + ratio * (F.col("t.end") - F.col("t.start"))).alias("time"))


def apply_boundary_times(cues: DataFrame, times: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Cues whose boundary with the next has a time: it ends the one and starts the other. ``times`` has keys (media_id by default), id (of the first) and time."""
    keys = keys or ["media_id"]
    order = Window.partitionBy(*keys).orderBy("id")
    joined = cues.join(times.select(*keys, "id", "time"), [*keys, "id"], "left")
    last = F.lead("id").over(order).isNull()
    return joined.select(*keys, "id", "text", F.coalesce(F.lag("time").over(order), F.col("start")).alias("start"), F.when(last, F.col("end")).otherwise(F.coalesce("time", "end")).alias("end"))
