"""Training-data pipeline: each stage reads what its predecessor kept, from Parquet.

All stages but the last return the columns of ``documents``, whatever others there
are and however they are named; the last returns the token ids of the documents
that are left. SQL can express neither the language model nor the tokenizer, so
ORACLE_SQL is None and the tests hold the pipeline against a brute-force version.

Null and empty texts have no language and go with the first stage. Rows of a null
doc_id are documents of their own; of repeated rows and equal texts one stays.
Texts may be of any length. An empty table passes through as an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from cueloom.llm import decontaminate, exact_dedup, language_id, near_dedup, pieces
from cueloom.llm.common import shared_table, table

ORACLE_SQL = None


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts without letters and near ties of languages; junk with letters stays."""
    return language_id.drop_unidentified(docs)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of texts that are equal without white space: the longest, then of the smallest doc_id."""
    return exact_dedup.drop_copies(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest doc_id of each component linked by five-word shingles at a similarity of 0.8.

    Different texts of one doc_id are one document: they stay or go together.
    """
    return near_dedup.drop_near_copies(docs, k=5, percent=80)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a ten-word window of the benchmark, or a whole item of fewer words."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The piece ids that the model's own library gives each document that is left: doc_id, n_pieces, ids, lossless.

    The public model is of the BPE kind: by="merges" walks the words' trie with the states of its merges.
    """
    return pieces.encoded(docs, by="merges").select("doc_id", F.size("ids").cast("long").alias("n_pieces"), "ids", "lossless")


STAGES = [
    ("language_id", known_language),
    ("exact_dedup", exact_copies),
    ("near_dedup", near_copies),
    ("decontamination", benchmark_leaks),
    ("sentencepiece", token_ids),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = shared_table(docs)
    return docs
