"""Token filters, groups and joins."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.functions import arrow_udf

from ..functions import text as T

ISOLATED = 3.0


def kept_tokens(tokens: DataFrame) -> DataFrame:
    """Tokens with text and no negative length."""
    return tokens.where((T.strip(F.col("text")) != "") & (F.col("end") >= F.col("start")))


def clean_tokens(tokens: DataFrame, keys: list[str]) -> DataFrame:
    """Tokens with text and no negative length, numbered from 1 by (start, end) and their old position."""
    return kept_tokens(tokens).withColumn("atom_id", F.row_number().over(Window.partitionBy(*keys).orderBy("start", "end", "pos")))


def _near(tokens: DataFrame, gap: float) -> DataFrame:
    """``tokens`` with near: whether a neighbour is within ``gap`` seconds."""
    order = Window.partitionBy("media_id").orderBy("start", "end", "pos")
    near = lambda pause: F.coalesce(pause <= gap, F.lit(False))
    return tokens.withColumn("near", near(F.col("start") - F.lag("end").over(order)) | near(F.lead("start").over(order) - F.col("end")))


def connected_tokens(tokens: DataFrame, gap: float = ISOLATED) -> DataFrame:
    """Without tokens that have no neighbour within ``gap`` seconds; the first and last have one side less."""
    return _near(tokens, gap).where("near").drop("near")


def connected_or_all(tokens: DataFrame, gap: float = ISOLATED) -> DataFrame:
    """connected_tokens, but all tokens of media that would lose every one. One sort: a media's flags are looked at in its order."""
    some = F.max("near").over(Window.partitionBy("media_id"))
    return _near(tokens, gap).withColumn("some", some).where("near or not some").drop("near", "some")


def refinable_tokens(tokens: DataFrame) -> DataFrame:
    """Tokens with text and positive length."""
    return tokens.where((T.strip(F.col("text")) != "") & (F.col("end") > F.col("start")))


def spoken_chunks(chunks: DataFrame) -> DataFrame:
    return chunks.where(T.strip(F.coalesce("text", F.lit(""))) != "")


def ordered_texts(pos: str = "pos", text: str = "text") -> Column:
    """Aggregate: a group's texts in order of ``pos``."""
    return F.sort_array(F.collect_list(F.struct(F.col(pos).alias("p"), F.col(text).alias("t"))))["t"]


def cues_of_groups(grouped: DataFrame, keys: list[str]) -> DataFrame:
    """One cue a group: first start, last end, joined text, ids from 1 over the groups that are left."""
    made = grouped.groupBy(*keys, "group_id").agg(F.min_by("start", "pos").alias("start"), F.max_by("end", "pos").alias("end"), ordered_texts().alias("parts"))
    cues = made.select(*keys, "group_id", "start", "end", T.join_parts(F.col("parts")).alias("text")).where((F.col("text") != "") & (F.col("end") > F.col("start")))
    return cues.withColumn("id", F.row_number().over(Window.partitionBy(*keys).orderBy("group_id")))


def group_metrics(grouped: DataFrame, keys: list[str], language: Column) -> DataFrame:
    """Text, duration (0.001 at least), length and characters a second of each group."""
    made = grouped.groupBy(*keys, "group_id").agg(F.min_by("start", "pos").alias("start"), F.max_by("end", "pos").alias("end"), ordered_texts().alias("parts"))
    rows = made.withColumn("text", T.join_parts(F.col("parts"))).withColumn("duration", F.greatest(F.lit(0.001), F.col("end") - F.col("start")))
    return rows.withColumn("length", T.measure(F.col("text"), language)).withColumn("cps", F.col("length") / F.col("duration")).select(*keys, "group_id", "text", "duration", "length", "cps")


def shifted(tokens: Column, offset: Column) -> Column:
    """An array of (text, start, end) moved by ``offset`` seconds."""
    return F.transform(tokens, lambda t: F.struct(t["text"].alias("text"), (t["start"] + offset).alias("start"), (t["end"] + offset).alias("end")))


def first_language(windows: DataFrame) -> DataFrame:
    """The first language that any window of a media names."""
    return windows.where("language is not null").groupBy("media_id").agg(F.min_by("language", "window_index").alias("language"))


def cue_counters(cues: DataFrame, limits: T.Limits = T.Limits()) -> DataFrame:
    """Per media: cues that proofreading changed, that last too long, and that have no translation."""
    changed = F.coalesce("proofread", "text") != F.col("text")
    return cues.groupBy("media_id").agg(
        F.count_if(changed).alias("corrected"), F.count_if(F.col("end") - F.col("start") > limits.max_duration).alias("long"), F.count_if(F.col("translation").isNull()).alias("untranslated")
    )


def line_counters(spans: DataFrame) -> DataFrame:
    """Per media: lines, and those that were matched to speech."""
    return spans.groupBy("media_id").agg(F.count("*").alias("lines"), F.count("start").alias("matched"))


def group_counters(grouped: DataFrame, keys: list[str], language: Column, limits: T.Limits = T.Limits()) -> DataFrame:
    """Per key: groups of the soft search, and those over a limit."""
    rows = group_metrics(grouped, keys, language)
    return rows.groupBy(*keys).agg(F.count("*").alias("segments"), F.count_if(T.overlong(F.col("duration"), F.col("length"), language, limits)).alias("overlong"))


def running_offsets(tokens: DataFrame, keys: list[str]) -> DataFrame:
    """``tokens`` (keys, pos, text) with length, before (characters of those in front) and total."""
    rows = tokens.withColumn("length", F.length("text"))
    whole = Window.partitionBy(*keys)
    upto = F.sum("length").over(whole.orderBy("pos"))
    return rows.withColumns({"before": upto - F.col("length"), "total": F.sum("length").over(whole)})


SPAN = "struct<start:int,length:int>"


def places(words: list[str], context: str) -> list[dict | None]:
    """Each word's leftmost place in ``context`` after the word before, or None."""
    at, out = 0, []
    for w in words:
        found = context.find(w, at) if w else -1
        out.append({"start": found, "length": len(w)} if found >= 0 else None)
        at = found + len(w) if found >= 0 else at
    return out


def context_spans(words: Column, context: Column) -> Column:
    """Array of (start, length), 0-based: each word's leftmost place in ``context`` after the word before; nulls where there is none.

    Both are content_only texts. An empty word has no place and does not move the cursor. One pass on Arrow batches: a
    fold of columns would copy its list for each word.
    """

    @arrow_udf(f"array<{SPAN}>")
    def spans(words: pa.Array, context: pa.Array) -> pa.Array:
        found = [None if w is None or c is None else places(w, c) for w, c in zip(words.to_pylist(), context.to_pylist())]
        return pa.array(found, pa.list_(pa.struct([("start", pa.int32()), ("length", pa.int32())])))

    return spans(words, context)


def patched(cues: DataFrame, patches: DataFrame, column: str) -> DataFrame:
    """Cues with ``column`` from the patch of the same media_id and id; null where there is none."""
    return cues.drop(column).join(patches.select("media_id", "id", F.col("text").alias(column)), ["media_id", "id"], "left")


def numbered_batches(rows: DataFrame, keys: list[str], order: str, size: int) -> DataFrame:
    """batch_id from 0 for runs of ``size`` rows; one batch if the size is not positive."""
    at = F.row_number().over(Window.partitionBy(*keys).orderBy(order)) - 1
    return rows.withColumn("batch_id", F.floor(at / size).cast("int") if size > 0 else F.lit(0))
