"""Artifact store: lookups, upserts and retention as joins over one table.

An artifact row has media_id, window_index, start, end, kind (asr or alignment),
version, model_id, language, transcript_sha1, payload and mtime. ``store`` keeps
such rows on disk.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.timecode import chunk_stem

VERSION = 1
KEY = ["media_id", "window_index"]
MOST_MEDIA = 12


def _stem(table: str) -> Column:
    return chunk_stem(F.col(f"{table}.window_index"), F.col(f"{table}.start"), F.col(f"{table}.end"))


def with_asr(windows: DataFrame, artifacts: DataFrame, model_id: str) -> DataFrame:
    """Windows (media_id, window_index, start, end, hint) with payload and found language; null payload is a miss.

    A hit has the window's bounds, this version, the model and the same hint, null included.
    """
    held = artifacts.where((F.col("kind") == "asr") & (F.col("version") == VERSION) & (F.col("model_id") == model_id))
    w, a = windows.alias("w"), held.alias("a")
    same = (F.col("w.media_id") == F.col("a.media_id")) & (_stem("w") == _stem("a")) & F.col("w.hint").eqNullSafe(F.col("a.language"))
    return w.join(a, same, "left").select("w.*", F.col("a.payload").alias("payload"))


def with_alignment(windows: DataFrame, artifacts: DataFrame, model_id: str) -> DataFrame:
    """Windows (…, transcript, language) with payload; the transcript's SHA-1 and the language must be the same."""
    held = artifacts.where((F.col("kind") == "alignment") & (F.col("version") == VERSION) & (F.col("model_id") == model_id))
    w, a = windows.alias("w"), held.alias("a")
    same = (F.col("w.media_id") == F.col("a.media_id")) & (_stem("w") == _stem("a")) & F.col("w.language").eqNullSafe(F.col("a.language")) & (F.sha1("w.transcript") == F.col("a.transcript_sha1"))
    return w.join(a, same, "left").select("w.*", F.col("a.payload").alias("payload"))


def upserted(artifacts: DataFrame, new: DataFrame) -> DataFrame:
    """``artifacts`` with the rows of ``new`` in their place; another ASR text for a window removes its alignment."""
    by = [*KEY, "kind"]
    changed = artifacts.where("kind = 'asr'").select(*KEY, F.col("payload").alias("old")).join(new.where("kind = 'asr'").select(*KEY, "payload"), KEY).where(~F.col("old").eqNullSafe(F.col("payload")))
    stale = changed.select(*KEY, F.lit("alignment").alias("kind"))
    kept = artifacts.join(new.select(*by).unionByName(stale).distinct(), by, "left_anti")
    return kept.unionByName(new)


def active_only(artifacts: DataFrame, active: DataFrame) -> DataFrame:
    """Without artifacts of planned media whose window is no longer planned; other media are left alone."""
    a, w = artifacts.alias("a"), active.alias("w")
    planned = artifacts.join(active.select("media_id").distinct(), "media_id", "left_semi").alias("a")
    current = planned.join(w, (F.col("a.media_id") == F.col("w.media_id")) & (_stem("a") == _stem("w")), "left_semi")
    return a.join(active.select("media_id").distinct(), "media_id", "left_anti").select("a.*").unionByName(current.select("a.*"))


def evicted(artifacts: DataFrame, keep: DataFrame, most: int = MOST_MEDIA) -> DataFrame:
    """media_id of the oldest media (then the smaller id) beyond ``most``, never one of ``keep``; none if ``most`` is not positive.

    Ranking is over media, one row each after a partial maximum. What is sorted out is the few that stay, a top-k of
    ``most`` at most, not the excess, which grows with the store.
    """
    ages = artifacts.groupBy("media_id").agg(F.max("mtime").alias("mtime"))
    if most <= 0:
        return ages.select("media_id").limit(0)
    kept = ages.join(keep.select("media_id").distinct(), "media_id", "left_semi")
    others = ages.join(keep.select("media_id").distinct(), "media_id", "left_anti")
    newest = others.orderBy(F.desc_nulls_last("mtime"), F.desc("media_id")).limit(max(0, most - kept.count()))
    return others.join(newest.select("media_id"), "media_id", "left_anti").select("media_id")


def retained(artifacts: DataFrame, keep: DataFrame, most: int = MOST_MEDIA) -> DataFrame:
    return artifacts.join(evicted(artifacts, keep, most), "media_id", "left_anti")


def latest(artifacts: DataFrame) -> DataFrame:
    """The newest row of each window and kind."""
    newest = Window.partitionBy(*KEY, "kind").orderBy(F.col("mtime").desc(), "payload")
    return artifacts.withColumn("n", F.row_number().over(newest)).where("n = 1").drop("n")


def newest_payloads(artifacts: DataFrame) -> DataFrame:
    """media_id, kind, payload, mtime of the newest row of each media and kind; of equally new ones the least payload, as in ``latest``."""
    return artifacts.groupBy("media_id", "kind").agg(F.min_by("payload", F.struct(-F.col("mtime"), F.col("payload"))).alias("payload"), F.max("mtime").alias("mtime"))


SCHEMA = "window_index int, start double, end double, version int, model_id string, mtime long, kind string, language string, transcript_sha1 string, payload string, media_id string"
