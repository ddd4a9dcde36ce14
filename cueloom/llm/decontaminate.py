"""Benchmark decontamination by winnowing.

Words are runs of digits, letters and non-ASCII characters, A-Z lower-cased. A
window is 10 consecutive words of an item, or the whole item if it has fewer.

1. Fingerprints are the minima of 6 consecutive 5-gram hashes, so every run of
   10 words that a document and an item share holds one that both have
   selected: none is missed. Items of fewer words have one, of all their words.
2. Fingerprints of documents meet those of the benchmark in a join. Before it,
   documents drop what a bit table of the benchmark's fingerprints rules out.
   The table has 2 ** TABLE_BITS bits whatever the benchmark's size; a large
   benchmark fills it, and more goes through to the join.
3. Hits are extended: all windows around them meet the benchmark's windows, word
   by word, in a second join. A span of hit words is the union of its windows,
   the same as the longest shared runs of 10 words or more.

The benchmark's side of both joins has one row a key, so no join multiplies rows
and a frequent passage is dealt to many tasks. Items of a window are one list,
and lists are united once for each set of lists that occurs, not once for each
document. What is looked up belongs to a text, known by its sha256: copies are
looked up once.

Null and empty texts have no words. Items with a null item_id hit words but are
not listed. Repeated rows are judged one by one. An empty table gives an empty
result, an empty benchmark hits nothing. Other columns pass through or are
ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.functions import arrow_udf

from .common import SLICE, WordHashes, byte_list, gram_hashes, limit_batches, shared_table, trimmed, worker_state

WINDOW = 10
GRAM = 5
SPAN = WINDOW - GRAM + 1
#: Bits of the table that tells most foreign fingerprints at once: four megabytes, sent to each executor.
TABLE_BITS = 25
PRINT = "struct<m: int, h: bigint, p: int>"

FOLD = bytes(
    c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256)
)


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(FOLD).split() if text else []


def selected(grams: np.ndarray) -> np.ndarray:
    """Mask of the grams that are the minimum of a window of SPAN grams."""
    mask = np.zeros(len(grams), bool)
    count = len(grams) - SPAN + 1
    if count <= 0:
        return mask
    low = grams[:count].copy()
    for s in range(1, SPAN):
        np.minimum(low, grams[s : s + count], out=low)
    for s in range(SPAN):
        mask[s : s + count] |= grams[s : s + count] == low
    return mask


def _item_prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Items -> fingerprints (m, h): m is the size of their windows."""
    hashes = WordHashes()
    for batch in batches:
        for text in byte_list(batch.column(0)):
            words = hashes.array(words_of(text))
            m = min(len(words), WINDOW)
            if m:
                grams = gram_hashes(words, GRAM if m == WINDOW else m)
                found = np.unique(grams[selected(grams)] if m == WINDOW else grams).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), m, np.int32)), pa.array(found)], names=["m", "h"])


def _item_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Items -> their distinct windows (m, gram, item_id)."""
    for batch in batches:
        for item_id, text in zip(batch.column(0).to_pylist(), byte_list(batch.column(1))):
            words = words_of(text)
            m = min(len(words), WINDOW)
            if m:
                grams = list({b" ".join(words[p : p + m]) for p in range(len(words) - m + 1)})
                yield pa.RecordBatch.from_arrays(
                    [pa.array([m] * len(grams), pa.int32()), pa.array(grams, pa.binary()).cast(pa.string()), pa.array([item_id] * len(grams), pa.string())], names=["m", "gram", "item_id"]
                )


class Scan:
    """Counts words and finds fingerprints that may be the benchmark's."""

    def __init__(self, table: bytes, short: list[int]):
        self.table, self.short = np.frombuffer(table, np.uint8), short
        self.shift, self.hashes = np.uint64(64 - (8 * len(table)).bit_length() + 1), WordHashes()

    def known(self, prints: np.ndarray) -> np.ndarray:
        at = prints >> self.shift
        return (self.table[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 > 0

    def read(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        """(words of each text, fingerprints of each, [m, h, p] of all)."""
        split = [words_of(x) for x in texts]
        sizes = np.fromiter(map(len, split), np.int64, len(split))
        words = self.hashes.array([w for x in split for w in x])
        text_of, ends = np.repeat(np.arange(len(split)), sizes), np.cumsum(sizes)
        found = []
        for m in [WINDOW, *self.short]:
            k = GRAM if m == WINDOW else m
            grams = gram_hashes(words, k)
            whole = np.arange(k, k + len(grams)) <= ends[text_of[: len(grams)]]
            if m == WINDOW:
                grams[~whole] = np.uint64(2**64 - 1)
                whole &= selected(grams)
            at = np.flatnonzero(whole)
            at = at[self.known(grams[at])]
            found.append((np.full(len(at), m, np.int32), grams[at].view(np.int64), at))
        m, h, at = map(np.concatenate, zip(*found))
        order = np.argsort(at, kind="stable")
        m, h, at = m[order], h[order], at[order]
        owner = text_of[at]
        return sizes, np.bincount(owner, minlength=len(split)), [m, h, (at - (ends - sizes)[owner]).astype(np.int32)]


def scanned(docs: DataFrame, prints: DataFrame) -> Column:
    """A column of structs (n_words, prints) of the column ``text``, which alone is sent to Python."""
    bits = prints.select(F.shiftrightunsigned("h", 64 - TABLE_BITS).alias("bit"))
    # bitmap_bit_position counts from 0 within buckets of 32,768 bits, which count from 1 for the bits from 1 on.
    parts = bits.groupBy(F.bitmap_bucket_number(F.col("bit") + 1).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(F.col("bit") + 1)).alias("bits"))
    table = bytearray(1 << (TABLE_BITS - 3))
    for bucket, own in parts.collect():  # at most 2 ** (TABLE_BITS - 15) rows of 4 KB
        table[(bucket - 1) * len(own) : bucket * len(own)] = own
    short = sorted(r[0] for r in prints.select("m").distinct().collect() if r[0] < WINDOW)
    spark = docs.sparkSession
    sent, name = spark.sparkContext.broadcast((bytes(table), short)), hashlib.sha256(bytes(table) + bytes(short)).hexdigest()

    @arrow_udf(f"struct<n_words: bigint, prints: array<{PRINT}>>")
    def scan(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = worker_state(("benchmark", name), lambda: Scan(*sent.value))
        for column in columns:
            parts = [own.read(byte_list(column.slice(at, SLICE))) for at in range(0, len(column), SLICE)] or [own.read([])]
            counts, sizes = (np.concatenate([x[k] for x in parts]) for k in (0, 1))
            m, h, p = (pa.array(np.concatenate([x[2][k] for x in parts])) for k in range(3))
            lists = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32), pa.StructArray.from_arrays([m, h, p], names=["m", "h", "p"]))
            yield pa.StructArray.from_arrays([pa.array(counts, pa.int64()), lists], names=["n_words", "prints"])

    return scan(F.col("text").cast("string"))


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts with their hit fingerprints -> the windows around them (text_id, m, p, gram)."""
    for batch in batches:
        for row in range(batch.num_rows):
            words = words_of(byte_list(batch.column(1).slice(row, 1))[0])
            starts = set()
            for hit in batch.column(2)[row].as_py():
                m, p = hit["m"], hit["p"]
                starts.update((m, s) for s in (range(max(0, p - SPAN + 1), min(p, len(words) - m) + 1) if m == WINDOW else (p,)))
            starts = sorted(starts)
            for at in range(0, len(starts), 10_000):
                part = starts[at : at + 10_000]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([batch.column(0)[row].as_py()] * len(part), pa.string()),
                        pa.array([m for m, _ in part], pa.int32()),
                        pa.array([s for _, s in part], pa.int32()),
                        pa.array([b" ".join(words[s : s + m]) for m, s in part], pa.binary()).cast(pa.string()),
                    ],
                    names=["text_id", "m", "p", "gram"],
                )


def merge_spans(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Union of half-open ranges, ascending, apart from each other."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _spans(places: Column) -> Column:
    @arrow_udf("array<array<int>>")
    def spans(column: pa.Array) -> pa.Array:
        return pa.array([merge_spans([(x["p"], x["p"] + x["m"]) for x in row]) for row in column.to_pylist()], pa.list_(pa.list_(pa.int32())))

    return spans(places)


def _prints(benchmark: DataFrame) -> DataFrame:
    limit_batches(benchmark.sparkSession)
    return shared_table(_items(benchmark).select("text").mapInArrow(trimmed(_item_prints), "m int, h long").distinct())


def _items(benchmark: DataFrame) -> DataFrame:
    return benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null")


def hit_texts(candidates: DataFrame, prints: DataFrame, benchmark: DataFrame) -> DataFrame:
    """text_id, spans and items of the texts with a window; candidates: text_id, text, prints, in any number of copies."""
    places = candidates.select("text_id", F.inline("prints")).distinct().join(prints, ["m", "h"])
    hits = places.groupBy("text_id").agg(F.collect_list(F.struct("m", "p")).alias("hits"))
    texts = candidates.select("text_id", "text").dropDuplicates(["text_id"])
    around = texts.join(hits, "text_id").mapInArrow(trimmed(_windows), "text_id string, m int, p int, gram string")
    windows = _items(benchmark).mapInArrow(trimmed(_item_windows), "m int, gram string, item_id string")
    lists = windows.groupBy("m", "gram").agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    lists = shared_table(lists.withColumn("list_id", F.sha2(F.to_json("items"), 256)))
    found = shared_table(around.join(lists.drop("items"), ["m", "gram"]).select("text_id", "m", "p", "list_id"))
    per_text = shared_table(
        found.groupBy("text_id")
        .agg(F.collect_list(F.struct("p", "m")).alias("at"), F.array_sort(F.collect_set("list_id")).alias("lists"))
        .select("text_id", _spans(F.col("at")).alias("spans"), "lists", F.sha2(F.array_join("lists", ","), 256).alias("lists_id"))
    )
    # Each set of lists is united once, however many texts have it, and each of its items is one row before they are listed.
    sets = per_text.groupBy("lists_id").agg(F.first("lists").alias("lists")).select("lists_id", F.explode("lists").alias("list_id"))
    items = lists.groupBy("list_id").agg(F.first("items").alias("items")).select("list_id", F.explode("items").alias("item"))
    each = sets.join(items, "list_id").select("lists_id", "item").distinct()
    united = each.groupBy("lists_id").agg(F.array_sort(F.collect_list("item")).alias("items"))
    # Windows of items without an id hit and have no item to name.
    named = F.coalesce("items", F.array().cast("array<string>")).alias("items")
    return per_text.join(united, "lists_id", "left").select("text_id", "spans", named)


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_words, spans (hit word ranges, half-open) and items (ids of items with a window that occurs), per row."""
    prints = _prints(benchmark)
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).withColumn("found", scanned(docs, prints))
    maybe = F.size("found.prints") > 0
    rows = shared_table(
        rows.select("doc_id", "found.n_words", F.when(maybe, F.col("found.prints")).alias("prints"), F.when(maybe, F.col("text")).alias("text"), F.when(maybe, F.sha2("text", 256)).alias("text_id"))
    )
    candidates = rows.where("text_id is not null")
    hit = shared_table(hit_texts(candidates.select("text_id", "text", "prints"), prints, benchmark)).withColumnRenamed("text_id", "hit_id")
    none = F.array().cast("array<array<int>>").alias("spans"), F.array().cast("array<string>").alias("items")
    judged = candidates.join(hit, F.col("text_id") == F.col("hit_id"), "left")
    judged = judged.select("doc_id", "n_words", F.coalesce("spans", none[0]).alias("spans"), F.coalesce("items", none[1]).alias("items"))
    return rows.where("text_id is null").select("doc_id", "n_words", *none).unionByName(judged)


def contamination_report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated per row of ``docs``."""
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s[1] - s[0])
    return contamination(docs, benchmark).select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` without a benchmark window, with its columns."""
    prints = _prints(benchmark)
    # Behind explode the scan is one column; a condition on it alone would be pushed below and scan all texts twice.
    rows = docs.select(F.col("text").cast("string").alias("text")).withColumn("found", scanned(docs, prints)).select("text", F.explode(F.array("found.prints")).alias("prints"))
    candidates = shared_table(rows.where(F.size("prints") > 0).select(F.sha2("text", 256).alias("text_id"), "text", "prints"))
    hit = shared_table(hit_texts(candidates, prints, benchmark).select(F.col("text_id").alias("_hit")))
    names = [f"_c{i}" for i in range(len(docs.columns))]
    text_id = F.sha2(F.col(names[docs.columns.index("text")]).cast("string"), 256)
    kept = docs.toDF(*names).withColumn("_id", text_id).join(hit, F.col("_id") == F.col("_hit"), "left_anti")
    return kept.select(*names).toDF(*docs.columns)
