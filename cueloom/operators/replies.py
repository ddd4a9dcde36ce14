"""Validation of models' JSON replies, with JSON functions only.

Types are looked at before values are read: a number as text is no id, and a
numeric text is no text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text as T

ITEM = "array<struct<i:long,t:string>>"


def _items(reply: Column) -> Column:
    """The reply's list as JSON text: the reply itself or its ``items``; null for anything else."""
    body = T.json_part(reply)
    inner = F.get_json_object(body, "$.items")
    return F.when(body.startswith("["), body).when(body.startswith("{") & inner.startswith("["), inner)


def _well_typed(items: Column) -> Column:
    """Every item is an object with a whole number ``i`` and a text ``t``."""
    each = F.try_variant_get(F.try_parse_json(items), "$", "array<variant>")
    good = lambda v: F.coalesce(
        F.schema_of_variant(F.try_variant_get(v, "$.i", "variant")).isin("BIGINT") & F.schema_of_variant(F.try_variant_get(v, "$.t", "variant")).isin("STRING"), F.lit(False)
    )
    return F.forall(each, good)


def checked(replies: DataFrame, kind: str) -> DataFrame:
    """media_id, batch_id, got (the items) and valid, per batch; a batch is rejected as a whole.

    ``replies`` has media_id, batch_id, reply and ids (those of the batch). For ``proofread`` the ids must be of the
    batch and unique, for ``translate`` they must be the batch's in its order.
    """
    ids, got = F.col("ids").cast("array<long>"), F.transform("got", lambda x: x["i"])
    rules = {"translate": got == ids, "proofread": (F.size(F.array_except(got, ids)) == 0) & (F.size(F.array_distinct(got)) == F.size(got))}
    if kind not in rules:
        raise ValueError(f"unknown kind: {kind}")
    rows = replies.withColumn("items", _items(F.col("reply")))
    typed = F.col("items").isNotNull() & F.coalesce(_well_typed(F.col("items")), F.lit(False))
    rows = rows.withColumn("got", F.when(typed, F.from_json("items", ITEM)))
    return rows.select("media_id", "batch_id", "got", F.coalesce(F.col("got").isNotNull() & rules[kind], F.lit(False)).alias("valid"))


def accepted(rows: DataFrame) -> DataFrame:
    """media_id, batch_id, id and text of the valid batches of ``checked``."""
    items = rows.where("valid").select("media_id", "batch_id", F.inline("got"))
    return items.select("media_id", "batch_id", F.col("i").alias("id"), T.strip(F.col("t")).alias("text"))


def corrections(replies: DataFrame) -> DataFrame:
    """Valid proofreading replies: media_id, batch_id, id, text."""
    return accepted(checked(replies, "proofread"))


def translations(replies: DataFrame) -> DataFrame:
    """Valid translation replies: media_id, batch_id, id, text."""
    return accepted(checked(replies, "translate"))


def timed_items(items: DataFrame) -> DataFrame:
    """text, start and end of JSON items that name them in one of their known ways; an item without one is an error."""
    field = lambda *names: F.coalesce(*[F.get_json_object("item", f"$.{n}") for n in names])
    filled = lambda *names: F.coalesce(*[F.nullif(F.get_json_object("item", f"$.{n}"), F.lit("")) for n in names])
    rows = items.withColumns({"text": filled("text", "word", "token"), "start": field("start", "start_time").cast("double"), "end": field("end", "end_time").cast("double")})
    missing = F.col("text").isNull() | F.col("start").isNull() | F.col("end").isNull()
    return rows.withColumn("text", F.when(missing, F.raise_error(F.concat(F.lit("invalid timed item: "), "item"))).otherwise(F.col("text"))).drop("item")
