"""Exact dedup by skew-safe combining.

Texts are equal when they are identical without ASCII white space. Three
stages, each of which compares whole normalised texts and not just digests:

1. every input partition combines its own copies, before anything is shuffled;
2. the survivors meet by (digest, salt, text), the salt being the partition's;
3. the winners of the salts meet by (digest, text).

A digest with a third of all rows so reaches stage 2 as one row a partition.
Documents find their group by digest. Should one digest hold several texts,
its documents, and only those, are joined by the whole text too. All of it is
columns, so Spark's aggregates bound the memory and spill.

Nulls count as empty text. Rows with equal text and length go to the smallest
doc_id; a null doc_id sorts after all others. Repeated rows count each. An
empty table gives an empty result. Other columns are ignored, whatever their
names; ``drop_copies`` returns them.
"""

from __future__ import annotations

from collections.abc import Callable
from decimal import Decimal

from pyspark.sql import Column, DataFrame, functions as F

from .common import shared_table

WHITE = " \t\n\v\f\r"
SALTS = 64
NO_ID = (1 << 63) - 1


def normalised(text: Column) -> Column:
    for c in WHITE:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def sha256_hex(norm: Column) -> Column:
    return F.sha2(norm, 256)


def keyed(docs: DataFrame, digest: Callable[[Column], Column]) -> DataFrame:
    """doc_id, text_sha256, norm and chars (of the text as it came) per row."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), normalised(text).alias("norm"), F.length(text).cast("long").alias("chars"))
    return rows.select("doc_id", digest(F.col("norm")).alias("text_sha256"), "norm", "chars")


def _merged(df: DataFrame, *keys: str) -> DataFrame:
    rank = F.col("chars").cast("decimal(38,0)") * F.lit(Decimal(1 << 64)) - F.coalesce("keep_id", F.lit(NO_ID)).cast("decimal(20,0)")
    return df.groupBy(*keys).agg(F.max_by("keep_id", rank.cast("decimal(38,0)")).alias("keep_id"), F.max("chars").alias("chars"), F.sum("members").alias("members"))


def combine(rows: DataFrame) -> DataFrame:
    """Groups of equal texts of ``keyed`` rows: text_sha256, norm, keep_id, group_size."""
    salted = rows.select("text_sha256", F.pmod(F.spark_partition_id(), F.lit(SALTS)).alias("salt"), "norm", F.col("doc_id").alias("keep_id"), "chars", F.lit(1).cast("long").alias("members"))
    # The partial aggregate of the first grouping is stage 1.
    by_salt = _merged(salted, "text_sha256", "salt", "norm")
    return _merged(by_salt, "text_sha256", "norm").select("text_sha256", "norm", "keep_id", F.col("members").alias("group_size"))


def exact_groups(docs: DataFrame, digest: Callable[[Column], Column] = sha256_hex) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256."""
    rows = keyed(docs, digest)
    found = shared_table(combine(rows).drop("norm"))
    clash = shared_table(found.groupBy("text_sha256").count().where("count > 1").select("text_sha256"))
    easy, joined = rows.drop("norm", "chars"), []
    if clash.take(1):
        whole = combine(rows).join(clash, "text_sha256", "left_semi")
        joined = [rows.drop("chars").join(clash, "text_sha256", "left_semi").join(whole, ["text_sha256", "norm"]).drop("norm")]
        easy = easy.join(clash, "text_sha256", "left_anti")
    out = easy.join(found, "text_sha256")
    for part in joined:
        out = out.unionByName(part)
    return out.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def drop_copies(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with its columns: one of each group of equal texts.

    Where several rows of a group have the doc_id that stays, one of those with the most code points does: the one that
    comes first by a hash of all its columns.
    """
    groups = shared_table(exact_groups(docs).where("kept").select("doc_id", "text_sha256"))
    repeated = shared_table(groups.groupBy("doc_id", "text_sha256").count().where("count > 1").select("doc_id", "text_sha256"))
    names = [f"_c{i}" for i in range(len(docs.columns))]
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    rows = docs.select(*[docs[c].alias(n) for c, n in zip(docs.columns, names)], docs["doc_id"].cast("long").alias("_id"), sha256_hex(normalised(text)).alias("_sha"), F.length(text).alias("_chars"))

    def meets(keys: DataFrame) -> Column:
        return F.col("_id").eqNullSafe(keys["doc_id"]) & (F.col("_sha") == keys["text_sha256"])

    kept = rows.join(groups, meets(groups), "left_semi")
    if repeated.take(1):
        several = kept.join(repeated, meets(repeated), "left_semi")
        order = F.struct(-F.col("_chars"), F.xxhash64(*names), F.xxhash64(F.lit("#"), *names))
        one = several.groupBy("_id", "_sha").agg(F.min_by(F.struct(*names), order).alias("row")).select("row.*")
        return kept.join(repeated, meets(repeated), "left_anti").select(*names).unionByName(one).toDF(*docs.columns)
    return kept.select(*names).toDF(*docs.columns)
