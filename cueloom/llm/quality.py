"""Quality classifier: a generalised additive model with pairwise interactions.

A text is described by a few numbers that its characters, words and lines give
(``NAMES``). Each number is cut into bins at quantiles of the training rows. The
model is a table per number and, for the PAIRS pairs of numbers that explain most
of what is left, a table over their coarse bins. The tables are learned by
cyclic boosting: round after round each one in turn gets a shallow tree over its
bins, fitted to the gradients and shrunk by RATE. A score is the logistic
function of a base and one cell of each table, looked up for many texts at once.

Training reads SAMPLE_ROWS documents in expectation, chosen by a hash over all
labelled ones, which is all that reaches the driver: NAMES numbers each. Scores
see the text alone and all of it; texts of more than PIECE bytes go piece by
piece, words and lines being compared within windows of fixed length.

Several labels of one doc_id count as their mean, repeated rows once. Labels
other than 0 and 1, and null ids, are not learned from. A null text counts as
empty; an empty text is a text with all numbers 0. Without labels the score is
0.5 for all. An empty table gives an empty result. Other columns are ignored,
whatever their names.
"""

from __future__ import annotations

import itertools
import operator
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.functions import arrow_udf

from .common import SLICE, byte_list, limit_batches, shared_table

SAMPLE_ROWS = 20_000
HASHES = 1_000_000_000
BINS, COARSE, ROUNDS, PAIR_ROUNDS, PAIRS, RATE = 32, 8, 300, 150, 10, 0.08
#: Cuts of a tree over one number's bins; least curvature of a leaf and the pull of leaves to 0.
CUTS, LEAST, PULL = 2, 2.0, 1.0
#: Words and lines that are compared with each other, bytes of a text that are split at once.
WORDS, LINES, PIECE = 200, 50, 4 << 20

NAMES = (
    "log_bytes", "upper", "digits", "spaces", "stops", "commas", "symbols", "top_symbol", "high_bytes", "top_byte", "entropy",
    "word_mean", "word_spread", "longest_word", "short_words", "repeated_neighbours", "distinct_words", "distinct_neighbours", "words_a_line", "distinct_lines", "open_lines",
)

CODES = np.arange(256)
UPPER, LOWER = (CODES >= 65) & (CODES <= 90), (CODES >= 97) & (CODES <= 122)
DIGIT, SPACE, HIGH = (CODES >= 48) & (CODES <= 57), np.isin(CODES, list(b" \t\n\v\f\r")), CODES >= 128
STOP, COMMA = np.isin(CODES, list(b".!?")), np.isin(CODES, list(b",;:"))
SYMBOL = (CODES > 32) & (CODES < 127) & ~(UPPER | LOWER | DIGIT | STOP | COMMA)
MARK = (CODES > 32) & (CODES < 127) & ~(UPPER | LOWER | DIGIT)


def _pieces(data: bytes) -> Iterator[bytes]:
    at = 0
    while at < len(data):
        end = len(data)
        if end - at > PIECE:
            # Cut at white space where there is some nearby, else within a word.
            found = data.find(b" ", at + PIECE, at + 2 * PIECE)
            end = found if found >= 0 else at + PIECE
        yield data[at:end]
        at = end


def features(data: bytes) -> list[float]:
    """The numbers of ``NAMES`` for a text in UTF-8."""
    if not data:
        return [0.0] * len(NAMES)
    counts = np.zeros(256, np.int64)
    n_words = n_lines = letters = squares = longest = short = same = distinct = pairs = kinds = open_lines = 0
    for piece in _pieces(data):
        counts += np.bincount(np.frombuffer(piece, np.uint8), minlength=256)
        words = piece.split()
        if words:
            sizes = np.fromiter(map(len, words), np.int64, len(words))
            n_words, letters, squares = n_words + len(words), letters + int(sizes.sum()), squares + int((sizes * sizes).sum())
            longest, short = max(longest, int(sizes.max())), short + int((sizes <= 2).sum())
            same += sum(map(operator.eq, words, itertools.islice(words, 1, None)))
            for at in range(0, len(words), WORDS):
                window = words[at : at + WORDS]
                distinct += len(set(window))
                pairs += len(set(zip(window, window[1:])))
        lines = [x for x in piece.split(b"\n") if x]
        n_lines += len(lines)
        open_lines += sum(x[-1:] not in b".!?" for x in lines)
        kinds += sum(len(set(lines[at : at + LINES])) for at in range(0, len(lines), LINES))
    size, of_words, of_lines = len(data), max(1, n_words), max(1, n_lines)
    share, mean = counts / size, letters / of_words
    found = share[share > 0]
    ascii_letters = counts[UPPER].sum() + counts[LOWER].sum()
    return [
        float(x)
        for x in (
            np.log1p(size), counts[UPPER].sum() / max(1, ascii_letters), share[DIGIT].sum(), share[SPACE].sum(), share[STOP].sum(), share[COMMA].sum(), share[SYMBOL].sum(), share[MARK].max(),
            share[HIGH].sum(), np.where(SPACE, 0, share).max(), -(found * np.log2(found)).sum(),
            mean, np.sqrt(max(0.0, squares / of_words - mean * mean)), np.log1p(longest), short / of_words, same / of_words, distinct / of_words, pairs / of_words,
            np.log1p(n_words / of_lines), kinds / of_lines, open_lines / of_lines,
        )
    ]


def matrix(texts: list[bytes | None]) -> np.ndarray:
    return np.array([features(x or b"") for x in texts]).reshape(len(texts), len(NAMES))


class Additive:
    """A base, a table per number and tables per pair of numbers."""

    def __init__(self, base: float, edges: list[np.ndarray]):
        self.base, self.edges = base, edges
        self.coarse = [e[:: max(1, -(-len(e) // (COARSE - 1)))] for e in edges]
        self.tables = [np.zeros(len(e) + 1) for e in edges]
        self.pairs: list[tuple[int, int]] = []
        self.grids: list[np.ndarray] = []

    def bins(self, x: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
        return tuple([np.searchsorted(e, x[:, k], "right") for k, e in enumerate(each)] for each in (self.edges, self.coarse))

    def margins(self, x: np.ndarray) -> np.ndarray:
        fine, coarse = self.bins(x)
        out = np.full(len(x), self.base)
        for table, at in zip(self.tables, fine):
            out += table[at]
        for (i, j), grid in zip(self.pairs, self.grids):
            out += grid[coarse[i], coarse[j]]
        return out

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margins(x), -50, 50)))


def _best_cut(g: np.ndarray, h: np.ndarray) -> tuple[float, int]:
    """(gain, place) of the best cut of a run of bins by gradients and curvatures; gain 0 if none is allowed."""
    left_g, left_h = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    if not len(left_g):
        return 0.0, 0
    all_g, all_h = g.sum(), h.sum()
    right_g, right_h = all_g - left_g, all_h - left_h
    gain = left_g**2 / (left_h + PULL) + right_g**2 / (right_h + PULL) - all_g**2 / (all_h + PULL)
    gain[(left_h < LEAST) | (right_h < LEAST)] = 0
    k = int(gain.argmax())
    return float(gain[k]), k + 1


def tree(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Values of a tree with up to CUTS cuts over bins: each time the cut that gains most."""
    leaves = [(0, len(g))]
    for _ in range(CUTS):
        (gain, cut), (a, b) = max(((_best_cut(g[a:b], h[a:b]), (a, b)) for a, b in leaves), key=lambda x: x[0][0])
        if gain <= 0:
            break
        leaves = [x for x in leaves if x != (a, b)] + [(a, a + cut), (a + cut, b)]
    out = np.zeros(len(g))
    for a, b in leaves:
        out[a:b] = g[a:b].sum() / (h[a:b].sum() + PULL)
    return out


def grid_tree(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """(gain, values) of the best tree that cuts one axis of a grid and then each half along the other."""
    best, out = -1.0, np.zeros_like(g)
    for axis in (0, 1):
        a, b = (g, h) if axis == 0 else (g.T, h.T)
        for cut in range(1, len(a)):
            gain, halves = 0.0, []
            for part in (slice(0, cut), slice(cut, None)):
                own_g, own_h = a[part].sum(0), b[part].sum(0)
                more, at = _best_cut(own_g, own_h)
                gain += more + own_g.sum() ** 2 / (own_h.sum() + PULL)
                halves.append((part, at if more > 0 else 0, own_g, own_h))
            if gain > best:
                best, found = gain, np.zeros_like(a)
                for part, at, own_g, own_h in halves:
                    for side in (slice(0, at), slice(at, None)):
                        found[part, side] = own_g[side].sum() / (own_h[side].sum() + PULL) if own_h[side].size else 0
                out = found if axis == 0 else found.T
    return best - g.sum() ** 2 / (h.sum() + PULL), out


def learned(x: np.ndarray, y: np.ndarray) -> Additive:
    """The model of training rows ``x`` with labels ``y`` between 0 and 1."""
    ones = float(y.sum())
    base = float(np.log((ones + 1) / (len(y) - ones + 1)))
    edges = [np.unique(np.quantile(x[:, k], np.arange(1, BINS) / BINS)) if len(x) else np.empty(0) for k in range(len(NAMES))]
    model = Additive(base, edges)
    if not 0 < ones < len(y):
        return model
    fine, coarse = model.bins(x)
    margin = np.full(len(x), base)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-margin))
        return y - p, p * (1 - p)

    for _ in range(ROUNDS):
        for table, at in zip(model.tables, fine):
            g, h = slopes()
            step = RATE * tree(np.bincount(at, g, len(table)), np.bincount(at, h, len(table)))
            table += step
            margin += step[at]

    def grid(i: int, j: int, values: np.ndarray) -> np.ndarray:
        shape = len(model.coarse[i]) + 1, len(model.coarse[j]) + 1
        return np.bincount(coarse[i] * shape[1] + coarse[j], values, shape[0] * shape[1]).reshape(shape)

    g, h = slopes()
    gains = sorted((-grid_tree(grid(i, j, g), grid(i, j, h))[0], i, j) for i, j in itertools.combinations(range(len(NAMES)), 2))
    model.pairs = [(i, j) for gain, i, j in gains[:PAIRS] if gain < 0]
    model.grids = [np.zeros((len(model.coarse[i]) + 1, len(model.coarse[j]) + 1)) for i, j in model.pairs]
    for _ in range(PAIR_ROUNDS):
        for (i, j), table in zip(model.pairs, model.grids):
            g, h = slopes()
            step = RATE * grid_tree(grid(i, j, g), grid(i, j, h))[1]
            table += step
            margin += step[coarse[i], coarse[j]]
    return model


def described(text: Column) -> Column:
    """A column of the numbers of ``NAMES``."""

    @arrow_udf("array<double>")
    def read(texts: pa.Array) -> pa.Array:
        rows = matrix(byte_list(texts))
        return pa.ListArray.from_arrays(np.arange(0, rows.size + 1, len(NAMES), dtype=np.int32), rows.ravel())

    return read(text)


def fit(labelled: DataFrame, docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Additive:
    """The model of ``docs`` (doc_id, text) with ``labelled`` (doc_id, quality): of ``sample_rows`` documents in expectation, or all there are."""
    limit_batches(docs.sparkSession)
    labels = labelled.where("doc_id is not null and quality in (0, 1)").groupBy(F.col("doc_id").cast("long").alias("_label_id")).agg(F.avg("quality").alias("_y"))
    labels = shared_table(labels)

    def sampled(df: DataFrame, rows: int, *keys: str) -> DataFrame:
        return df if rows <= sample_rows else df.where(F.pmod(F.xxhash64(*keys), F.lit(HASHES)) < int(sample_rows / rows * HASHES))

    # One row a label id, sample_rows in expectation, whatever the tables' sizes.
    some = F.broadcast(sampled(labels, labels.count(), "_label_id"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).join(some, F.col("doc_id") == F.col("_label_id"))
    # More rows than ids where a doc_id is repeated; equal rows count once.
    rows = sampled(rows, rows.count(), "text", "doc_id")
    found = rows.select("doc_id", "_y", described(F.col("text")).alias("x")).distinct().orderBy("doc_id", "x").toArrow()
    x = found["x"].combine_chunks()
    return learned(x.flatten().to_numpy(zero_copy_only=False).reshape(-1, len(NAMES)), found["_y"].to_numpy())


def scored(spark: SparkSession, model: Additive, text: Column) -> Column:
    """A column of scores for ``text``, which alone is sent to Python."""
    limit_batches(spark)
    sent = spark.sparkContext.broadcast(model)

    @arrow_udf("double")
    def read(texts: pa.Array) -> pa.Array:
        parts = [sent.value.scores(matrix(byte_list(texts.slice(at, SLICE)))) for at in range(0, len(texts), SLICE)]
        return pa.array(np.concatenate([np.empty(0), *parts]))

    return read(text.cast("string"))


def held_out(doc_id: str = "doc_id") -> Column:
    """True for the third of documents, by crc32 of the id as text, whose labels are not learned."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(False))


def quality(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """doc_id, held_out, score, predicted per row of ``docs``; learned from the labels of those that are not held out."""
    model = fit(labels.where(~held_out()).select("doc_id", "quality"), docs.select("doc_id", "text"), **options)
    found = docs.select("doc_id", held_out().alias("held_out"), scored(docs.sparkSession, model, F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("score"))
    return found.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
