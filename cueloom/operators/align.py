"""Character alignment of lines to timed tokens: texts joined per media, aligned in blocks, and brought back to lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.functions import arrow_udf

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from ..functions import text as T
from ..shared import shared_table
from . import anchors, overlaps, tokens as tok
from .align_matrix import aligned, band_for  # noqa: F401
from .spans import finished_spans


def character_places(ref: Column, heard: Column) -> Column:
    """For each character of ``ref`` its place in ``heard``, -1 where it stands against a gap; null if either is null."""

    @arrow_udf("array<int>")
    def places(a: pa.Array, b: pa.Array) -> pa.Array:
        pairs = list(zip(a.to_pylist(), b.to_pylist()))
        found = anchors.aligned_pairs([(x or "", y or "") for x, y in pairs])
        sizes = [len(p) for p in found]
        made = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *sizes]), pa.int32()), pa.array(np.concatenate([*found, []]), pa.int32()))
        return pc.if_else(pc.and_(a.is_valid(), b.is_valid()), made, pa.scalar(None, made.type))

    return places(ref.cast("string"), heard.cast("string"))


def joined_texts(lines: DataFrame, tokens: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(texts: media_id, ref, heard; lines: media_id, line_no, first, last; words: media_id, start, end, first, last).

    The texts are all lines and all words of a media without what alignment ignores, joined; first and last are places
    in them, last is exclusive. Words stand in time order, then by pos.
    """
    left = lines.select("media_id", "line_no", T.for_alignment(F.col("text"), F.col("language")).alias("bare"))
    named = lines.groupBy("media_id").agg(F.first("language", True).alias("language"))
    right = tokens.join(named, "media_id").select("media_id", "pos", "start", "end", T.for_alignment(F.col("text"), F.col("language")).alias("bare"))
    left, right = shared_table(left), shared_table(right)

    def placed(rows: DataFrame, *order: str) -> DataFrame:
        last = F.sum(F.length("bare")).over(Window.partitionBy("media_id").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
        return rows.withColumn("last", last).withColumn("first", F.col("last") - F.length("bare")).drop("bare")

    def text(rows: DataFrame, name: str, *order: str) -> DataFrame:
        listed = F.array_sort(F.collect_list(F.struct(*order, "bare")))
        return rows.groupBy("media_id").agg(F.array_join(F.transform(listed, lambda x: x["bare"]), "").alias(name))

    by = "start", "end", "pos"
    texts = text(left, "ref", "line_no").join(text(right, "heard", *by), "media_id", "left").na.fill("", ["heard"])
    return texts, placed(left, "line_no"), placed(right, *by).drop("pos")


def matched_lines(lines: DataFrame, tokens: DataFrame, **blocks) -> DataFrame:
    """media_id, line_no, start, end: each line's first and last matched token; null without one.

    ``lines`` has media_id, line_no, text and language; ``tokens`` media_id, text, start, end in time order by pos.
    A line's first matched character gives its start, its last one its end: matches ascend in both texts. Runs meet
    lines and words where they overlap; ``blocks`` are the options of ``anchors.blocks_of``.
    """
    texts, places, words = joined_texts(lines, tokens)
    runs = shared_table(anchors.matched_runs(anchors.blocks_of(shared_table(texts), **blocks)))
    met = overlaps.overlapping(places, runs.withColumn("stop", F.col("i") + F.col("n")), ("first", "last"), ("i", "stop"), ["media_id"])
    bounds = met.select("media_id", "line_no", (F.greatest("first", "i") - F.col("i") + F.col("j")).alias("a"), (F.least("last", "stop") - F.col("i") + F.col("j") - 1).alias("b"))
    bounds = bounds.groupBy("media_id", "line_no").agg(F.min("a").alias("a"), F.max("b").alias("b"))
    ends = bounds.select("media_id", "line_no", F.inline(F.array(F.struct(F.lit("a").alias("side"), F.col("a").alias("at")), F.struct(F.lit("b").alias("side"), F.col("b").alias("at")))))
    found = overlaps.overlapping(ends.withColumn("upto", F.col("at") + 1), words, ("at", "upto"), ("first", "last"), ["media_id"])
    times = found.groupBy("media_id", "line_no").agg(F.max(F.when(F.col("side") == "a", F.col("start"))).alias("start"), F.max(F.when(F.col("side") == "b", F.col("end"))).alias("end"))
    return places.select("media_id", "line_no").join(times, ["media_id", "line_no"], "left")


class AlignmentError(ValueError):
    pass


def matched_spans(lines: DataFrame, tokens: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(spans of all lines; media_id of the media of which no line matches).

    Isolated tokens are left out unless they are all a media has or alone match.
    """
    spans = shared_table(matched_lines(lines, tok.connected_tokens(tokens)))
    none = lambda df: df.groupBy("media_id").agg(F.count("start").alias("n")).where("n = 0").select("media_id")
    lost = shared_table(none(spans))
    if not lost.take(1):
        return spans, lost
    again = shared_table(matched_lines(lines.join(lost, "media_id", "left_semi"), tokens.join(lost, "media_id", "left_semi")))
    return spans.join(lost, "media_id", "left_anti").unionByName(again), none(again)


def _finished(spans: DataFrame, media: DataFrame) -> DataFrame:
    return finished_spans(spans, media).select("media_id", "line_no", F.round("start", 3).alias("start"), F.round("end", 3).alias("end"))


UNMATCHED = "no heard word matches a line; check the language or the media"


def aligned_lines(lines: DataFrame, tokens: DataFrame, media: DataFrame, strict: bool = False) -> DataFrame:
    """Finished spans of all lines. Media of which no line matches get filled spans, or are an error if ``strict``."""
    spans, lost = matched_spans(lines, tokens)
    if strict and (none := lost.take(1)):
        raise AlignmentError(f"{none[0][0]}: {UNMATCHED}")
    return _finished(spans, media)


def alignable_lines(lines: DataFrame, tokens: DataFrame, media: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(finished spans of the media of which some line matches; media_id and reason of the others)."""
    spans, lost = matched_spans(lines, tokens)
    return _finished(spans.join(lost, "media_id", "left_anti"), media), lost.select("media_id", F.lit(UNMATCHED).alias("reason"))


def outer_spans(tokens: DataFrame) -> DataFrame:
    """media_id, line_no, start of the first and end of the last of a line's tokens with text and length."""
    return tok.refinable_tokens(tokens).groupBy("media_id", "line_no").agg(F.min_by("start", "pos").alias("start"), F.max_by("end", "pos").alias("end"))


def refined_lines(rough: DataFrame, again: DataFrame, media: DataFrame) -> DataFrame:
    """Rough spans replaced by those of a second pass over each line's own window, clamped to the media, where these have a length."""
    new = again.join(media.select("media_id", "duration"), "media_id").select("media_id", "line_no", F.greatest(F.lit(0.0), "start").alias("s"), F.least("duration", "end").alias("e"))
    good = F.coalesce(F.col("e") > F.col("s"), F.lit(False))
    return rough.join(new, ["media_id", "line_no"], "left").select("media_id", "line_no", F.when(good, F.col("s")).otherwise(F.col("start")).alias("start"), F.when(good, F.col("e")).otherwise(F.col("end")).alias("end"))
