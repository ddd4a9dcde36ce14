"""Gap filling and finishing of line spans: window functions only.

A media's lines are one ordered run. What comes before a line is a frame from the
run's start, what comes after it the same frame in descending order: frames that
only grow cost one pass, those that shrink would be computed again for each row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def filled_spans(lines: DataFrame) -> DataFrame:
    """media_id, line_no, start, end with nulls (and spans without length) placed between their neighbours.

    Between two anchors the run is spread evenly, each up to a second long; after the last one every half second
    for a second; before the first one half seconds back, not below 0; without anchors 0 to 1.
    """
    order = Window.partitionBy("media_id").orderBy("line_no")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy("media_id").orderBy(F.col("line_no").desc()).rowsBetween(Window.unboundedPreceding, -1)
    good = F.col("end") > F.col("start")
    rows = lines.select("media_id", "line_no", F.when(good, F.col("start")).alias("s"), F.when(good, F.col("end")).alias("e"))
    rows = rows.select(
        "*",
        F.last("e", True).over(before).alias("prev_end"),
        F.last("s", True).over(after).alias("next_start"),
        F.row_number().over(order).alias("rn"),
    )
    known_before = F.coalesce(F.max(F.when(F.col("s").isNotNull(), F.col("rn"))).over(before), F.lit(0))
    known_after = F.coalesce(F.last(F.when(F.col("s").isNotNull(), F.col("rn")), True).over(after), F.max("rn").over(Window.partitionBy("media_id")) + 1)
    rows = rows.withColumn("k", F.col("rn") - known_before).withColumn("left", known_after - F.col("rn")).withColumn("n", F.col("k") + F.col("left") - 1)
    step = (F.col("next_start") - F.col("prev_end")) / (F.col("n") + 1)
    both, only_prev, only_next = F.col("prev_end").isNotNull() & F.col("next_start").isNotNull(), F.col("prev_end").isNotNull(), F.col("next_start").isNotNull()
    start = (
        F.when(F.col("s").isNotNull(), F.col("s"))
        .when(both, F.col("prev_end") + step * F.col("k"))
        .when(only_prev, F.col("prev_end") + 0.5 * F.col("k"))
        .when(only_next, F.greatest(F.lit(0.0), F.col("next_start") - 0.5 * F.col("left")))
        .otherwise(0.0)
    )
    rows = rows.withColumn("start", start)
    end = (
        F.when(F.col("s").isNotNull(), F.col("e"))
        .when(both, F.col("start") + F.greatest(F.lit(0.0), F.least(step, F.lit(1.0))))
        .when(only_prev, F.col("start") + 1.0)
        .when(only_next, F.col("start") + 0.5)
        .otherwise(1.0)
    )
    return rows.select("media_id", "line_no", "start", end.alias("end"))


def _positive(start: Column, end: Column) -> Column:
    return F.when(end <= start, F.least("duration", start + 0.5)).otherwise(end)


def finished_spans(lines: DataFrame, media: DataFrame) -> DataFrame:
    """filled_spans with starts that never go back, within the media, not overlapping, each with a length where there is room."""
    order = Window.partitionBy("media_id").orderBy("line_no")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    rows = filled_spans(lines).join(media.select("media_id", "duration"), "media_id")
    rows = rows.withColumn("start", F.max("start").over(upto))
    rows = rows.withColumn("start", F.when(F.col("start") >= F.col("duration"), F.greatest(F.lit(0.0), F.col("duration") - 0.5)).otherwise(F.col("start")))
    rows = rows.withColumn("end", _positive(F.col("start"), F.least("end", "duration")))
    rows = rows.withColumn("high", F.max("start").over(upto))
    moved = F.col("high") > F.col("start")
    rows = rows.withColumn("end", F.when(moved, _positive(F.col("high"), F.col("end"))).otherwise(F.col("end"))).withColumn("start", F.col("high"))
    rows = rows.withColumn("end", F.least("end", F.coalesce(F.lead("start").over(order), F.col("end"))))
    return rows.select("media_id", "line_no", "start", _positive(F.col("start"), F.col("end")).alias("end"))
