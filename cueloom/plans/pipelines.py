"""The three end-to-end plans, as compositions of the operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..operators import align, artifacts as A, model_cues, providers, replies, segment, tokens as tok, windows as W
from ..operators.store import Store
from ..shared import shared_table
from ..sources import timed_text


def media_tokens(processed: DataFrame) -> DataFrame:
    """Long tokens on the media's clock of processed windows (media_id, window_index, start, tokens)."""
    moved = processed.select("media_id", "window_index", tok.shifted(F.col("tokens"), F.col("start")).alias("tokens"))
    return moved.select("media_id", "window_index", F.posexplode("tokens").alias("pos", "t")).select("media_id", "window_index", "pos", "t.text", "t.start", "t.end")


def transcripts(windows: DataFrame, hear: Callable, held: DataFrame | None = None, model_id: str = "") -> tuple[DataFrame, DataFrame | None]:
    """(windows with transcript and language, the artifacts that are new). Only windows that the store lacks are transcribed.

    ``windows`` has media_id, window_index, start, end and, if a language is asked for, hint.
    """
    asked = windows if "hint" in windows.columns else windows.withColumn("hint", F.lit(None).cast("string"))
    columns = "media_id", "window_index", "start", "end", "transcript", "language"
    if held is None:
        return shared_table(providers.transcribed(asked, hear).withColumnRenamed("spoken", "language").select(*columns)), None
    found = shared_table(A.with_asr(asked, held, model_id))
    said = F.from_json("payload", "text string, language string")
    hits = found.where("payload is not null").withColumn("said", said).select(*columns[:4], F.col("said.text").alias("transcript"), F.col("said.language").alias("language"))
    new = shared_table(providers.transcribed(found.where("payload is null").drop("payload"), hear))
    payload = F.to_json(F.struct(F.col("transcript").alias("text"), F.col("spoken").alias("language")))
    rows = _artifacts(new, "asr", model_id, F.col("hint"), F.lit(None).cast("string"), payload)
    return hits.unionByName(new.withColumnRenamed("spoken", "language").select(*columns)), rows


def placed_words(heard: DataFrame, place: Callable, held: DataFrame | None = None, model_id: str = "") -> tuple[DataFrame, DataFrame | None]:
    """(media_id, window_index, tokens; the artifacts that are new). An empty result is one too."""
    if held is None:
        return shared_table(providers.force_aligned(heard, place)), None
    found = shared_table(A.with_alignment(heard, held, model_id))
    hits = found.where("payload is not null").select("media_id", "window_index", F.from_json("payload", providers.TOKENS).alias("tokens"))
    missing = found.where("payload is null").drop("payload")
    new = shared_table(providers.force_aligned(missing, place))
    rows = _artifacts(missing.join(new, ["media_id", "window_index"]), "alignment", model_id, F.col("language"), F.sha1("transcript"), F.to_json("tokens"))
    return hits.unionByName(new), rows


#: Windows with their transcripts that a task sorts, about.
SORTED = 50_000


def placed_cues(heard: DataFrame, place: Callable, mode: str = "hard") -> DataFrame:
    """The numbered cues of windows with transcripts: placed words go from the aligner to the search within a task and are not written.

    Windows are dealt in the order of their media, so a task counts the cues of its stretch. Cues are written once, as the
    aligner is not to be asked again where they are used twice; only counts are shuffled after that.
    """
    if mode not in segment.MODES:
        raise ValueError(f"unknown mode: {mode}")
    keys = ["media_id", "window_index"]
    rows = heard.where("media_id is not null").select(
        *keys, "start", (F.col("end") - F.col("start")).alias("seconds"), "transcript", F.coalesce("language", F.lit("English")).alias("language"), F.col("language").alias("named"),
    )
    tasks = max(providers.TASKS * heard.sparkSession.sparkContext.defaultParallelism, heard.count() // SORTED)
    dealt = rows.repartitionByRange(tasks, *keys).sortWithinPartitions(*keys)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told = (pa.RecordBatch.from_arrays([p[c] for c in (*keys, "start", "named", "transcript", "tokens")], [*keys, "start", "language", "context", "tokens"]) for p in providers.with_tokens(parts, place()))
        yield from segment.counted(segment.cues_of_lists(told, keys, mode))

    cues = dealt.mapInArrow(run, "media_id string, id int, start double, end double, text string")
    return segment.renumbered(shared_table(cues.withColumn("task", F.spark_partition_id())))


def _artifacts(rows: DataFrame, kind: str, model_id: str, language: Column, sha1: Column, payload: Column) -> DataFrame:
    now = F.unix_micros(F.current_timestamp())
    return rows.select(
        "media_id", "window_index", "start", "end", F.lit(A.VERSION).alias("version"), F.lit(model_id).alias("model_id"), now.alias("mtime"), F.lit(kind).alias("kind"),
        language.alias("language"), sha1.alias("transcript_sha1"), payload.alias("payload"),
    )


def subtitles(
    speech: DataFrame, media: DataFrame, hear: Callable, place: Callable, mode: str = "hard", ask: Callable | None = None,
    store: str | None = None, models: tuple[str, str] = ("", ""), most_media: int = A.MOST_MEDIA, splitter=None,
) -> DataFrame:
    """Media to cues: plan windows, transcribe, place words, put punctuation back, segment, number.

    ``hear``, ``place`` and ``ask`` are provider loaders. What they return is written once and read again, of placed
    words the cues where nothing else needs them; with a ``store`` (a folder) it is kept there for later runs, for the windows that are planned now and the latest
    ``most_media`` media. Modes: none (a cue a window), soft, hard, hybrid and llm, which need ``ask``.
    """
    if mode in ("hybrid", "llm") and ask is None:
        raise ValueError(f"{mode} needs a model")
    windows, keys = shared_table(W.planned_windows(speech, media)), ["media_id", "window_index"]
    kept = Store(speech.sparkSession, store) if store else None
    held = kept.read() if kept else None
    heard, said_anew = transcripts(windows, hear, held, models[0])
    made = [said_anew]
    if mode == "none":
        cues = segment.transcript_cues(heard.withColumnRenamed("transcript", "text"))
    elif mode in segment.MODES and not (kept or splitter):
        cues = placed_cues(heard, place, mode)
    else:
        placed, placed_anew = placed_words(heard, place, held, models[1])
        made.append(placed_anew)
        listed = placed.join(heard.select(*keys, "start", "language", F.col("transcript").alias("context")), keys)
        if mode in ("llm", "hybrid") or splitter:
            words, said = media_tokens(listed), listed.select(*keys, "context")
            marked = segment.with_context_punctuation(words, said, keys).withColumn("pos", F.col("atom_id"))
            named = marked.join(heard.select(*keys, "language"), keys).drop("atom_id")
        if mode == "llm":
            cues, _ = model_cues.model_cues(named, said.withColumn("must_split", F.lit(False)), ask, keys)
        elif mode == "hybrid":
            cues, _ = model_cues.hybrid_cues(named, ask, keys, splitter=splitter)
        elif splitter:
            cues = segment.segmented(named, keys, mode, splitter=splitter)
        else:
            cues = segment.segmented_lists(listed, keys, mode)
        order = F.row_number().over(W.Window.partitionBy("media_id").orderBy("window_index", "id"))
        cues = cues.select("media_id", order.alias("id"), "start", "end", "text")
    if kept:
        cues = shared_table(cues)
        kept.upsert(reduce(DataFrame.unionByName, made))
        kept.retain(windows, media, most_media)
    return cues


def timed_where_possible(files: DataFrame, words: DataFrame, windows: DataFrame, media: DataFrame, place: Callable | None = None) -> tuple[DataFrame, DataFrame]:
    """Untimed text files and heard words (window-local) to (timed lines: media_id, id, start, end, text; errors: media_id, reason).

    With ``place``, each line is aligned again within its own window, and that span taken where it has a length.
    Media of which no line can be matched, and those without a duration, are errors and have no lines.
    """
    _, lines = timed_text.untimed_lines(files)
    unusable = F.coalesce(F.col("duration") <= 0, F.lit(True))
    timeless = media.where(unusable).select("media_id", F.lit("no usable duration").alias("reason"))
    media, lines = media.where(~unusable), shared_table(lines.join(timeless, "media_id", "left_anti"))
    heard = W.without_overlap_tokens(words, windows)
    order = W.Window.partitionBy("media_id").orderBy("start", "end", "window_index", "pos")
    heard = heard.withColumn("pos", F.row_number().over(order))
    timed, lost = align.alignable_lines(lines.withColumn("language", F.lit(None).cast("string")), heard, media)
    timed = shared_table(timed)
    if place is not None:
        own = W.refine_windows(timed, media)
        parts = own.join(lines, ["media_id", "line_no"]).select("media_id", F.col("line_no").cast("int").alias("window_index"), "start", "end", F.col("text").alias("transcript"), F.lit(None).cast("string").alias("language"))
        parts = shared_table(parts)
        again = media_tokens(shared_table(providers.force_aligned(parts, place, strict=False)).join(parts.select("media_id", "window_index", "start"), ["media_id", "window_index"]))
        timed = align.refined_lines(timed, align.outer_spans(again.withColumnRenamed("window_index", "line_no")), media)
    found = timed.join(lines, ["media_id", "line_no"]).select("media_id", F.col("line_no").alias("id"), F.round("start", 3).alias("start"), F.round("end", 3).alias("end"), "text")
    return found, timeless.unionByName(lost)


def aligned_subtitles(files: DataFrame, words: DataFrame, windows: DataFrame, media: DataFrame, place: Callable | None = None) -> DataFrame:
    """The lines of ``timed_where_possible``; any error of a media is one of the whole."""
    found, errors = timed_where_possible(files, words, windows, media, place)
    if bad := errors.orderBy("media_id").take(1):
        raise align.AlignmentError(f"{bad[0][0]}: {bad[0][1]}")
    return found


def edited_where_valid(cues: DataFrame, ask: Callable, kind: str, size: int = 40) -> tuple[DataFrame, DataFrame]:
    """(cues with proofread or translation texts from a model, batch by batch; errors: media_id, batch_id, reason).

    A batch whose request fails, or whose reply is not valid, leaves its cues as they are.
    """
    batches = tok.numbered_batches(cues, ["media_id"], "id", size)
    asked = batches.groupBy("media_id", "batch_id").agg(F.array_sort(F.collect_list(F.struct(F.col("id").alias("i"), F.col("text").alias("t")))).alias("items"))
    prompts = asked.select("media_id", "batch_id", F.transform("items", lambda x: x["i"]).alias("ids"), F.concat(F.lit(f"{kind} as JSON, keeping every i: "), F.to_json("items")).alias("prompt"))
    said = shared_table(providers.replied(prompts, ask))
    rows = shared_table(replies.checked(said.where("error is null"), kind))
    failed = said.where("error is not null").select("media_id", "batch_id", F.concat(F.lit("request error: "), "error").alias("reason"))
    errors = failed.unionByName(rows.where("not valid").select("media_id", "batch_id", F.lit("the reply is not valid").alias("reason")))
    return tok.patched(cues, replies.accepted(rows), "translation" if kind == "translate" else "proofread"), errors


def edited(cues: DataFrame, ask: Callable, kind: str, size: int = 40) -> DataFrame:
    """The cues of ``edited_where_valid``; any error of a batch is one of the whole."""
    done, errors = edited_where_valid(cues, ask, kind, size)
    if bad := errors.orderBy("media_id", "batch_id").take(1):
        failed = RuntimeError if bad[0]["reason"].startswith("request error") else ValueError
        raise failed(f"{kind}: {bad[0]['reason']}, batch {bad[0]['batch_id']} of {bad[0]['media_id']}")
    return done
