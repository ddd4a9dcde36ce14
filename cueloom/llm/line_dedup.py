"""Line dedup over overlapping windows of three lines, with SQL functions only.

Lines are what stands between line feeds. Three consecutive lines are a window,
known by two 64-bit hashes with different arguments. Windows that occur more
than once anywhere are found by one aggregation with map-side sums; every
occurrence but the first, by (doc_id, hash of the whole text, position), is later. The positions that
later windows cover are merged, and their lines removed, so a repeated passage
of three lines or more goes as a whole, wherever its windows overlap, and stays
where it came first.

The aggregate is written before the join, so that a window with a third of all
rows is dealt to many tasks.

Null texts have no lines and stay null. Texts of fewer than three lines stay as
they are. A null doc_id comes before all others. Rows with the same doc_id and
text are one document: they keep or lose the same lines. Rows with the same doc_id
and different texts are different documents, in the order of the texts' hashes.
An empty table gives an empty result. Other columns are ignored, whatever their
names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import shared_table

WIDTH = 3


def _window(lines: Column, i: Column) -> Column:
    a, b, c = (F.get(lines, i + k) for k in range(WIDTH))
    return F.struct(i.alias("pos"), F.xxhash64(a, b, c).alias("h1"), F.xxhash64(F.lit("#"), c, a, F.lit("#"), b).alias("h2"))


def _lines(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("version"), F.split(text, "\n", -1).alias("lines"))


def later_windows(docs: DataFrame) -> DataFrame:
    """doc_id, version (hash of the text) and covered: the positions of lines that repeat an earlier passage."""
    windows = (
        _lines(docs)
        .where(F.size("lines") >= WIDTH)
        .select("doc_id", "version", F.inline(F.transform(F.sequence(F.lit(0), F.size("lines") - WIDTH), lambda i: _window(F.col("lines"), i))))
    )
    repeated = shared_table(
        windows.groupBy("h1", "h2").agg(F.count("*").alias("times"), F.min(F.struct("doc_id", "version", "pos")).alias("first")).where("times > 1").select("h1", "h2", "first")
    )
    later = windows.join(repeated, ["h1", "h2"]).where(~F.struct("doc_id", "version", "pos").eqNullSafe(F.col("first")))
    spread = F.flatten(F.transform(F.collect_set("pos"), lambda p: F.sequence(p, p + WIDTH - 1)))
    return later.groupBy("doc_id", "version").agg(F.array_sort(F.array_distinct(spread)).alias("covered"))


def without_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, text without the lines of later windows, n_lines, n_removed and removed (positions), per row."""
    rows, marks = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), later_windows(docs).toDF("_doc", "_version", "covered")
    joined = rows.withColumn("version", F.xxhash64("text")).join(marks, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("version") == F.col("_version")), "left")
    lines = F.split("text", "\n", -1)
    cut = joined.select("doc_id", "text", F.coalesce("covered", F.array().cast("array<int>")).alias("removed"), F.when(F.col("covered").isNotNull(), lines).alias("lines"))
    stay = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "removed")
    return cut.select(
        "doc_id",
        F.when(F.col("lines").isNull(), F.col("text")).otherwise(F.array_join(F.transform(stay, lambda i: F.get("lines", i)), "\n")).alias("text"),
        F.when(F.col("text").isNull(), 0).otherwise(F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1).cast("long").alias("n_lines"),
        F.size("removed").cast("long").alias("n_removed"),
        "removed",
    )


def line_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_removed, and removed positions and sha256 of the text that stays, per row."""
    return without_repeats(docs).select(
        "doc_id", "n_lines", "n_removed", F.array_join(F.col("removed").cast("array<string>"), ",").alias("removed"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256")
    )
