"""Cues by a language model, and the hybrid of it with the local search.

A chunk (a key's tokens) becomes a prompt, its reply delimiters, the delimiters
groups. Whatever goes wrong leaves the chunk as one group, with the reason. All
chunks are rows of one plan: the provider is called on Arrow batches, and order
is restored by the keys.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window, functions as F

from ..functions import text as T
from ..shared import shared_table
from . import providers, segment as S, tokens as tok
from .windows import apply_boundary_times

NO_SPLIT = "no usable split"


def model_cues(tokens: DataFrame, chunks: DataFrame, ask: Callable, keys: list[str], concurrency: int = 2, retries: int = 2) -> tuple[DataFrame, DataFrame]:
    """(cues: keys, id, start, end, text; report: keys, reason, null where the reply was used).

    ``tokens`` has keys, pos, text, start and end; ``chunks`` keys, context (or null) and must_split. A request error,
    an invalid reply, and one without a split where there must be one, give one group a chunk.
    """
    atoms = shared_table(S.with_context_punctuation(tokens, chunks, keys))
    source = atoms.groupBy(*keys).agg(T.join_parts(tok.ordered_texts("atom_id")).alias("source"), F.max("atom_id").cast("int").alias("last"))
    asked = chunks.join(source, keys).select(*keys, "must_split", "last", "source", T.prompt(F.col("source"), F.col("context"), F.col("must_split")).alias("prompt"))
    said = shared_table(providers.replied(asked, ask, concurrency, retries).drop("prompt").withColumnRenamed("error", "failure"))
    parsed = S.parsed_replies(said.where("failure is null"), atoms, keys)
    reason = (
        F.when(F.col("failure").isNotNull(), F.concat(F.lit("request error: "), "failure"))
        .when(F.col("error").isNotNull(), F.concat(F.lit("invalid output: "), "error"))
        .when(F.col("must_split") & (F.size("ends") == 1), F.lit(f"invalid output: {NO_SPLIT}"))
    )
    judged = shared_table(said.drop("source").join(parsed, keys, "left").withColumn("reason", reason))
    good = F.col("reason").isNull()
    ends = judged.select(*keys, F.explode(F.when(good, F.col("ends")).otherwise(F.array("last"))).alias("atom_id"), F.lit(1).alias("cut"))
    before = Window.partitionBy(*keys).orderBy("atom_id").rowsBetween(Window.unboundedPreceding, -1)
    grouped = atoms.join(ends, [*keys, "atom_id"], "left").withColumn("group_id", (F.coalesce(F.sum("cut").over(before), F.lit(0)) + 1).cast("int"))
    cues = tok.cues_of_groups(grouped.withColumn("pos", F.col("atom_id")), keys)
    times = judged.where(good & F.col("times").isNotNull()).select(*keys, F.posexplode("times").alias("k", "time")).select(*keys, (F.col("k") + 1).alias("id"), "time")
    return apply_boundary_times(cues, times, keys).select(*keys, "id", "start", "end", "text"), judged.select(*keys, "reason")


def hybrid_cues(tokens: DataFrame, ask: Callable, keys: list[str], limits: T.Limits = T.Limits(), concurrency: int = 2, retries: int = 2, splitter=None) -> tuple[DataFrame, DataFrame]:
    """(cues; report: keys, group_id, reason) of soft groups, of which the overlong go to the model, which must split them.

    What the model leaves as it is is split by the hard search. ``tokens`` has keys, pos, text, start, end and language.
    """
    soft = shared_table(S.grouped_tokens(tokens.withColumn("language", S.named_language(keys, "pos")), keys, "soft", limits, splitter))
    named = shared_table(tokens.withColumn("language", S.named_language(keys, "pos")).select(*keys, "language").distinct())
    rows = soft.join(named, keys)
    by = [*keys, "group_id"]
    made = rows.groupBy(*by, "language").agg(F.min_by("start", "pos").alias("start"), F.max_by("end", "pos").alias("end"), tok.ordered_texts().alias("parts"))
    made = made.select(*by, "language", "start", "end", T.join_parts(F.col("parts")).alias("text")).where((F.col("text") != "") & (F.col("end") > F.col("start")))
    overlong = T.overlong(F.greatest(F.lit(0.001), F.col("end") - F.col("start")), T.measure(F.col("text"), F.col("language")), F.col("language"), limits)
    groups = shared_table(made.select(*by, "start", "end", "text", overlong.alias("overlong")))
    long = shared_table(rows.join(groups.where("overlong").select(*by), by, "left_semi"))
    part = long.withColumnRenamed("group_id", "part")
    sub = [*keys, "part"]
    chunks = groups.where("overlong").select(*keys, F.col("group_id").alias("part"), F.col("text").alias("context"), F.lit(True).alias("must_split"))
    new, report = model_cues(part, chunks, ask, sub, concurrency, retries)
    hard = S.segmented(part, sub, "hard", limits, splitter)
    back = lambda df: df.withColumnRenamed("part", "group_id")
    return S.chosen_cues(groups, back(new), back(hard), keys), back(report)
