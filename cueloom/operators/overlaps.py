"""Joins of intervals that overlap, by bins of time.

Intervals are half open and have a length. Each is copied to the bins that it
covers; a pair meets in all bins that both cover and is kept only in the one
where the later of the two begins, so it comes once. Bins are as wide as nine of
ten intervals are long. Longer ones go by levels, each with bins SPREAD times as
wide as the one below: an interval lies on the first level where it covers
SPREAD + 1 bins at most, and meets shorter ones on its own level. So the copies of
an interval are bounded, and the pairs that are looked at are those of a bin.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

SPREAD = 8
#: Share of intervals that are no longer than a bin of the first level.
SHARE = 0.9


def bin_levels(left: DataFrame, right: DataFrame, share: float = SHARE) -> tuple[float, int]:
    """(width of the first level's bins, number of levels) for rows with _from and _to."""
    lengths = left.select((F.col("_to") - F.col("_from")).alias("n")).unionAll(right.select((F.col("_to") - F.col("_from")).alias("n")))
    width, longest = lengths.agg(F.percentile_approx("n", share), F.max("n")).first()
    if not width:
        return 1.0, 1
    levels = 1
    while longest > width * float(SPREAD) ** levels:
        levels += 1
    return float(width), levels


def overlapping(left: DataFrame, right: DataFrame, left_ends: tuple[str, str], right_ends: tuple[str, str], keys: list[str], share: float = SHARE) -> DataFrame:
    """Pairs of rows with the same ``keys`` whose intervals share a moment: the keys, then the other columns of both.

    Rows with a null key or end, and intervals without length, have no pairs. Apart from the keys, names must differ.
    """

    def named(df: DataFrame, ends: tuple[str, str]) -> DataFrame:
        start, end = (F.col(c).cast("double") for c in ends)
        return df.withColumn("_from", start).withColumn("_to", end).where("_to > _from")

    left, right = named(left, left_ends), named(right, right_ends)
    width, levels = bin_levels(left, right, share)
    wide = lambda level: F.lit(width) * F.pow(F.lit(float(SPREAD)), level)
    bin_of = lambda at, level: F.floor(at / wide(level))
    own = sum(((F.col("_to") - F.col("_from")) > width * float(SPREAD) ** k).cast("int") for k in range(1, levels)) + F.lit(0)

    def dealt(df: DataFrame, side: str, first: Column, last: Column) -> DataFrame:
        """A copy of each row for each bin that it covers on the levels from ``first`` to ``last``."""
        rows = df.withColumn("_own", own).withColumn("_level", F.explode(F.when(first <= last, F.sequence(first, last))))
        rows = rows.withColumn("_bin", F.explode(F.sequence(bin_of(F.col("_from"), F.col("_level")), bin_of(F.col("_to"), F.col("_level")))))
        return rows.drop("_own").withColumnsRenamed({"_from": f"_{side}_from", "_to": f"_{side}_to"})

    def met(a: DataFrame, b: DataFrame) -> DataFrame:
        later = F.greatest("_l_from", "_r_from")
        return a.join(b, [*keys, "_level", "_bin"]).where((F.least("_l_to", "_r_to") > later) & (F.col("_bin") == bin_of(later, F.col("_level"))))

    at, top = F.col("_own"), F.lit(levels - 1)
    # The longer of two, or the left one of two on the same level, meets what comes up from below.
    pairs = met(dealt(left, "l", at, at), dealt(right, "r", at, top))
    if levels > 1:
        pairs = pairs.unionByName(met(dealt(left, "l", at + 1, top), dealt(right, "r", at, at)))
    return pairs.drop("_level", "_bin", "_l_from", "_l_to", "_r_from", "_r_to")
