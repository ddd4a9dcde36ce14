"""Source divergence audit by term-block dense matrices.

Terms are runs of ASCII letters and of all characters above ASCII, A-Z
lower-cased. Each language keeps the terms that at least LEAST_DOCS of its rows
hold. Every (lang, source) group and every language give each kept term a share
``1 + floor(10**9 * (count + 5) / (N + 5 * V))``, in integers throughout.

* Counting: each task counts the terms of its rows per group, in bounded
  dictionaries, and passes sums on; Spark adds them up.
* Tiles: a language's kept terms are dealt into blocks of about TERMS by a hash,
  its groups into parts of about GROUPS. A tile is one block with two parts: a
  dense int64 group-by-term matrix of shares. All pairs of groups in it are
  compared by broadcasting, slice by slice, which gives a partial pair matrix;
  the largest excesses over the language's share go to a heap per group.
* A task adds up the matrices and merges the heaps of its tiles of the same
  groups; Spark adds and ranks what the tasks return.

So a hot language or source is cut by terms and by groups: no task holds more
than one tile, one pair matrix of two parts and TOP entries a group. The report
has a row for each ordered pair of sources of a language, which is its purpose.

Null lang, source and text count as ''. Rows of one doc_id are documents of
their own. A group without terms has N = 0 and the share of an unseen term for
all; a language without kept terms has pair values of 0 and no terms. Ties of
value go by item, bytewise. Texts may be of any length: they are counted in
pieces. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import heapq
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from .common import byte_list, limit_batches, shared_table

LEAST_DOCS, UNIT, SMOOTHING, TOP = 30, 1_000_000_000, 5, 50
#: Terms of a block and groups of a part, about.
TERMS, GROUPS = 256, 128
#: Differences that are held at once.
CELLS = 1 << 21
#: Counts that a task holds before it passes them on, bytes of a text that are split at once, rows of a batch it returns.
HELD, PIECE, ROWS = 200_000, 4 << 20, 20_000
#: Languages up to which their sizes are broadcast, and not joined.
MOST_SENT = 100_000

LOWERED = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def pieces_of(data: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, some at a time."""
    at = 0
    while at < len(data):
        end = len(data)
        if end - at > PIECE:
            found = data.find(b" ", at + PIECE)
            end = found if found >= 0 else end
        yield data[at:end].split()
        at = end


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, text) -> (lang, source, term, n, docs); one row without a term for each group seen."""
    held: dict = defaultdict(lambda: (Counter(), Counter()))

    def flushed() -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, docs) in held.items():
            terms: list = [None, *n]
            for at in range(0, len(terms), ROWS):
                part = terms[at : at + ROWS]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([lang] * len(part), pa.string()),
                        pa.array([source] * len(part), pa.string()),
                        pa.array(part, pa.binary()).cast(pa.string()),
                        pa.array([n[t] for t in part], pa.int64()),
                        pa.array([docs[t] for t in part], pa.int64()),
                    ],
                    names=["lang", "source", "term", "n", "docs"],
                )
        held.clear()

    for batch in batches:
        for lang, source, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), byte_list(batch.column(2))):
            n, docs = held[lang, source]
            own: set = set()
            for terms in pieces_of((data or b"").translate(LOWERED)):
                n.update(terms)
                own.update(terms)
            docs.update(own)
            if len(own) > HELD:
                yield from flushed()
        if sum(len(n) for n, _ in held.values()) > HELD:
            yield from flushed()
    yield from flushed()


def shares(counts: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """1 + floor(UNIT * (count + SMOOTHING) / whole), three digits at a time: exact for wholes up to 9e15."""
    value, left = np.divmod(counts + SMOOTHING, whole)
    for _ in range(3):
        digits, left = np.divmod(left * 1000, whole)
        value = value * 1000 + digits
    return value + 1


def pair_sums(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sum over the columns of |a's row - b's row| for all pairs of rows."""
    out = np.zeros((len(a), len(b)), np.int64)
    step = max(1, CELLS // max(1, len(a) * len(b)))
    for at in range(0, a.shape[1], step):
        out += np.abs(a[:, None, at : at + step] - b[None, :, at : at + step]).sum(axis=2)
    return out


class Tile:
    """Pair sums and heaps of two parts of a language's groups, over the blocks that a task has of them."""

    def __init__(self, lang: str, i: int, j: int, heads: pa.RecordBatch):
        self.lang, self.diagonal = lang, i == j
        self.sources = heads["source"]
        part = heads["part"].to_numpy()
        self.rows, self.columns = np.flatnonzero(part == i), np.flatnonzero(part == j)
        self.whole = heads["n"].to_numpy()[:, None]
        self.lang_whole = heads["total"].to_numpy()[0]
        self.sums = np.zeros((len(self.rows), len(self.columns)), np.int64)
        self.heaps: list[list] = [[] for _ in range(len(part))]

    def add(self, cells: pa.RecordBatch) -> None:
        """One block: rows of source, term, n and total, ascending by term."""
        encoded = cells["term"].dictionary_encode()
        at, terms = encoded.indices.to_numpy(), encoded.dictionary.to_pylist()
        who = pc.index_in(cells["source"], value_set=self.sources).to_numpy()
        counts, totals = np.zeros((len(self.sources), len(terms)), np.int64), np.zeros(len(terms), np.int64)
        counts[who, at], totals[at] = cells["n"].to_numpy(), cells["total"].to_numpy()
        p = shares(counts, self.whole)
        self.sums += pair_sums(p[self.rows], p[self.columns])
        if self.diagonal:
            more = np.where(counts > 0, p - shares(totals, self.lang_whole), 0)
            for g, row in enumerate(more):
                found = np.flatnonzero(row > 0)
                best = found[np.argsort(-row[found], kind="stable")[:TOP]].tolist()
                self.heaps[g] = heapq.nsmallest(TOP, self.heaps[g] + [(-int(row[t]), terms[t]) for t in best])

    def found(self) -> Iterator[pa.RecordBatch]:
        names = self.sources.to_pylist()
        if self.diagonal:
            a, b = np.triu_indices(len(names), 1)
            values = self.sums[a, b]
        else:
            a, b = np.repeat(self.rows, len(self.columns)), np.tile(self.columns, len(self.rows))
            values = self.sums.ravel()
        pairs = zip([names[x] for x in a.tolist()], ["pair"] * len(a), [names[x] for x in b.tolist()], values.tolist())
        rows = [*pairs, *((names[g], "term", term, -value) for g, heap in enumerate(self.heaps) for value, term in heap)]
        for at in range(0, len(rows), ROWS):
            source, part, item, value = zip(*rows[at : at + ROWS])
            yield pa.RecordBatch.from_arrays([pa.array([self.lang] * len(source), pa.string()), pa.array(source, pa.string()), pa.array(part), pa.array(item, pa.string()), pa.array(value, pa.int64())], names=["lang", "source", "part", "item", "value"])


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """(lang, i, j, block) and all its rows, for rows that are sorted by these."""
    key, kept = None, []
    for batch in batches:
        if not batch.num_rows:
            continue
        codes = [batch["lang"].dictionary_encode().indices.to_numpy(), *(batch[c].to_numpy() for c in ("i", "j", "block"))]
        cuts = np.flatnonzero(np.any([x[1:] != x[:-1] for x in codes], axis=0)) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows]):
            part = batch.slice(a, b - a)
            own = tuple(part[c][0].as_py() for c in ("lang", "i", "j", "block"))
            if own != key and kept:
                yield key, pa.Table.from_batches(kept).combine_chunks().to_batches()[0]
                kept = []
            key = own
            kept.append(part)
    if kept:
        yield key, pa.Table.from_batches(kept).combine_chunks().to_batches()[0]


def _tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    tile, of = None, None
    for (lang, i, j, _), rows in _runs(batches):
        heads = rows["term"].null_count
        if of != (lang, i, j):
            if tile:
                yield from tile.found()
            tile, of = Tile(lang, i, j, rows.slice(0, heads)), (lang, i, j)
        if rows.num_rows > heads:
            tile.add(rows.slice(heads))
    if tile:
        yield from tile.found()


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences) and docs (rows with it); a row with a null term for each group."""
    limit_batches(docs.sparkSession)
    rows = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    found = rows.mapInArrow(_count, "lang string, source string, term string, n long, docs long")
    return found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def tile_rows(counts: DataFrame, terms: int = TERMS, groups: int = GROUPS) -> DataFrame:
    """The rows of all tiles: first a tile's groups (null term; n and total are the divisors of the group and the language), then its cells."""
    of_term = Window.partitionBy("lang", "term")
    kept = counts.where("term is not null").select("lang", "source", "term", "n", F.sum("docs").over(of_term).alias("docs"), F.sum("n").over(of_term).alias("total"), (F.col("source") == F.min("source").over(of_term)).alias("first"))
    kept = shared_table(kept.where(F.col("docs") >= LEAST_DOCS).drop("docs"))
    sizes = kept.groupBy("lang", "source").agg(F.sum("n").alias("n"), F.sum(F.col("first").cast("long")).alias("v"))
    sizes = shared_table(counts.where("term is null").select("lang", "source").join(sizes, ["lang", "source"], "left"))
    langs = sizes.groupBy("lang").agg(F.count("*").alias("sources"), F.coalesce(F.sum("n"), F.lit(0)).alias("lang_n"), F.coalesce(F.sum("v"), F.lit(0)).alias("v"))
    blocks, parts = F.greatest(F.lit(1), F.ceil(F.col("v") / terms)), F.greatest(F.lit(1), F.ceil(F.col("sources") / groups))
    langs = shared_table(langs.select("lang", "lang_n", "v", blocks.alias("blocks"), parts.alias("parts")))
    langs = F.broadcast(langs) if langs.count() <= MOST_SENT else langs

    smooth = F.lit(SMOOTHING) * F.col("v")
    part = F.pmod(F.xxhash64("source"), F.col("parts")).cast("int").alias("part")
    heads = sizes.drop("v").join(langs, "lang").select("lang", part, "parts", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), F.lit(None).cast("string").alias("term"), "source", (F.coalesce("n", F.lit(0)) + smooth).alias("n"), (F.col("lang_n") + smooth).alias("total"))
    cells = kept.join(langs, "lang").select("lang", part, "parts", F.pmod(F.xxhash64("term"), F.col("blocks")).alias("block"), "term", "source", "n", "total")
    rows = heads.unionByName(cells).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts").cast("int") - 1)))
    return rows.select("lang", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "block", "term", "source", "part", "n", "total")


def divergence(docs: DataFrame, terms: int = TERMS, groups: int = GROUPS) -> DataFrame:
    """lang, source, part, item, value, rank: each source's distance to the language's others, and the terms it has too many of.

    ``terms`` and ``groups`` are the sides of a tile; they change no value.
    """
    rows = tile_rows(shared_table(term_counts(docs)), terms, groups)
    key = ["lang", "i", "j", "block"]
    found = rows.repartition(*key).sortWithinPartitions(*key, F.col("term").asc_nulls_first(), "source").mapInArrow(_tiles, "lang string, source string, part string, item string, value long")
    ways = F.when(F.col("part") == "pair", F.array(F.struct("source", "item"), F.struct(F.col("item").alias("source"), F.col("source").alias("item")))).otherwise(F.array(F.struct("source", "item")))
    summed = found.select("lang", "part", "value", F.explode(ways).alias("x")).groupBy("lang", F.col("x.source").alias("source"), "part", F.col("x.item").alias("item")).agg(F.sum("value").alias("value"))
    ranked = summed.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")))
    return ranked.where((F.col("part") == "pair") | (F.col("rank") <= TOP)).select("lang", "source", "part", "item", "value", "rank")
