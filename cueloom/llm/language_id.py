"""Language identification by segmentation-marginalised unigrams.

The vocabulary is a fixed public one. Each language has a probability for each
piece. A word's probability in a language is the sum over all its segmentations
into pieces, by the forward algorithm; a text's is the product over its words.
The probabilities are fitted by expectation maximisation: the expected counts of
pieces over all segmentations of the training words, then their shares.

Words are runs of letters (Unicode's categories L), lower-cased, marked at their
start. Letters outside the vocabulary have the same small probability
everywhere. Many words of up to SHORT letters go through the sums together, in
chunks of bounded size; longer ones one by one in logarithms, with no more than
the last positions in memory. Both sum over all segmentations of the whole word.

A language's probabilities are one number for all pieces it was not seen with
and a list of the others, so the model grows with what its training words hold
and not with languages times pieces.

Training reads the word counts of a bounded sample, chosen by a hash of doc_id
over the whole table: SAMPLE_ROWS labelled rows in expectation, of each language
as many, or all it has where that is less, and never under LEAST_ROWS. So a rare
language is learned however large the table is. Rows with a null
doc_id, text or lang are not learned from. Predictions see the text alone. A
text that is null or has no letter is ``und`` with score 0, as is every text if
nothing could be learned. Ties go to the first language in order. Repeated rows
are judged one by one and count each in training; an empty table gives an empty
result. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
import uuid
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.functions import arrow_udf

from .common import SLICE, limit_batches, mix64, shared_table, worker_state
from .pools import gather, sums

SAMPLE_ROWS = 12_000
#: Training rows of each language that has them, even if SAMPLE_ROWS is exceeded by that.
LEAST_ROWS = 100
HASHES = 1_000_000_000
ROUNDS = 3
#: Letters of the words that are summed together; others one by one.
SHORT = 40
SMOOTHING = 0.1
FLOOR = 1e-7
#: Numbers that a worker holds at once: remembered scores, states of the sums, and the whole table of a model if it has no more.
CELLS = 1_000_000
#: Words at most that a worker remembers the scores of.
KNOWN = 150_000
#: Languages up to which their shares are broadcast, and not joined.
MOST_SENT = 100_000
#: Words that a task counts before it passes the sums on.
HELD_WORDS = 200_000
#: Units of a count, and of a logarithm: sums of whole numbers are the same in any order.
COUNT_UNIT, LOG_UNIT = 1 << 20, 1 << 28
MARK = "▁"
BASE = np.uint64(0x9E3779B97F4A7C15)
SLOT_BITS = 18

WORDS = regex.compile(r"\p{L}+")
NOT_ASCII_LETTER = bytes(c if 0x61 <= c <= 0x7A else 0x20 for c in range(256))


def words_of(text: str) -> list[str]:
    text = text.lower()
    if text.isascii():
        return text.encode().translate(NOT_ASCII_LETTER).decode().split()
    return WORDS.findall(text)


def public_pieces(path: str | None = None) -> list[str]:
    """The usable pieces of the vocabulary: letters, marked or not, lower-cased, in order of their ids."""
    import public_tokenizers
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path or public_tokenizers.path("piece_bpe_32k.model"))
    found = (model.id_to_piece(i).lower() for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_byte(i) or model.is_unknown(i)))
    return list(dict.fromkeys(p for p in found if regex.fullmatch(rf"{MARK}?\p{{L}}*", p) and p))


class Segmenter:
    """All segmentations of many words at once; columns of ``table`` are languages."""

    def __init__(self, pieces: list[str]):
        self.size, self.longest = len(pieces), max(map(len, pieces))
        self.powers = self._powers()
        keys = np.array([self._key(p) for p in pieces], np.uint64)
        # Open addressing by rounds: piece numbers, and the key that must be found there.
        self.slot_key = np.zeros(1 << SLOT_BITS, np.uint64)
        self.slot_piece = np.full(1 << SLOT_BITS, self.size, np.int32)
        self.probes = 0
        left = np.arange(self.size)
        while len(left):
            at = self._slot(keys[left], self.probes)
            free = self.slot_piece[at] == self.size
            first = np.zeros(len(left), bool)
            first[np.unique(at, return_index=True)[1]] = True
            put = free & first
            self.slot_key[at[put]], self.slot_piece[at[put]] = keys[left[put]], left[put]
            left = left[~put]
            self.probes += 1

    @staticmethod
    def _powers() -> np.ndarray:
        out = np.ones(SHORT + 2, np.uint64)
        for i in range(1, len(out)):
            out[i] = int(out[i - 1]) * int(BASE) & 2**64 - 1
        return out

    def _key(self, piece: str) -> int:
        h = 0
        for c in piece:
            h = (h * int(BASE) + ord(c)) & (2**64 - 1)
        return h

    @staticmethod
    def _slot(keys: np.ndarray, probe: int) -> np.ndarray:
        return (mix64(keys + np.uint64(probe)) >> np.uint64(64 - SLOT_BITS)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Piece numbers of keys; ``size`` for those of no piece. Only keys at a slot of another's are tried again."""
        at = self._slot(keys, 0)
        out = self.slot_piece[at]
        wrong = np.flatnonzero((out < self.size) & (self.slot_key[at] != keys))
        for probe in range(1, self.probes + 1):
            if not len(wrong):
                break
            at = self._slot(keys[wrong], probe)
            out[wrong] = self.slot_piece[at]
            wrong = wrong[(out[wrong] < self.size) & (self.slot_key[at] != keys[wrong])]
        return out

    def spans(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, Iterator[tuple[int, int, np.ndarray]]]:
        """(order: word numbers, longest first; their lengths with the mark; (start, end, pieces) by end).

        The pieces of (start, end) are those of the first words of the order, as far as they reach to end.
        """
        sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
        order = np.argsort(-sizes, kind="stable")
        sizes = sizes[order]
        most = int(sizes[0])
        codes = np.zeros((len(words), most), np.uint32)
        codes[np.arange(most) < sizes[:, None]] = _codes("".join([MARK + words[i] for i in order]))

        def pairs() -> Iterator[tuple[int, int, np.ndarray]]:
            prefix = np.zeros((most + 1, len(words)), np.uint64)
            for j in range(1, most + 1):
                n = int(np.searchsorted(-sizes, -j, "right"))
                prefix[j, :n] = prefix[j - 1, :n] * BASE + codes[:n, j - 1]
                for i in range(max(0, j - self.longest), j):
                    yield i, j, self.find(prefix[j, :n] - prefix[i, :n] * self.powers[j - i])

        return order, sizes, pairs()

    def blocks(self, word: str, step: int) -> Iterator[tuple[int, np.ndarray]]:
        """(first end, pieces) of a long word: row k has the pieces of k + 1 characters at each of up to ``step`` ends."""
        codes = _codes(MARK + word).astype(np.uint64)
        for first in range(1, len(codes) + 1, step):
            ends = np.arange(first, min(first + step, len(codes) + 1))
            keys, out = np.zeros(len(ends), np.uint64), np.full((self.longest, len(ends)), self.size, np.int32)
            for k in range(self.longest):
                at = np.flatnonzero(ends > k)
                keys[at] += codes[ends[at] - k - 1] * self.powers[k]
                out[k, at] = self.find(keys[at])
            yield first, out

    def scores(self, model: Model, words: list[str]) -> np.ndarray:
        """(words, languages) log probabilities."""
        out = np.empty((len(words), len(model.langs)))
        order = sorted((i for i in range(len(words)) if len(words[i]) <= SHORT), key=lambda i: len(words[i]))
        at = 0
        while at < len(order):
            # As many as their states allow, of about one length.
            end = at + max(1, CELLS // ((len(words[order[at]]) + 8) * max(1, len(model.langs))))
            chunk = order[at:end]
            out[chunk] = self._together(model, [words[i] for i in chunk])
            at = end
        for i, word in enumerate(words):
            if len(word) > SHORT:
                out[i] = self._alone(model, word)
        return out

    def _together(self, model: Model, words: list[str]) -> np.ndarray:
        order, sizes, pairs = self.spans(words)
        out, kept = np.empty((len(words), len(model.langs))), self.longest + 1
        # Only the last positions are held; a word's state is read where it ends.
        alpha = np.zeros((kept, len(words), len(model.langs)))
        alpha[0], now = 1.0, 0
        ends = np.searchsorted(-sizes, -np.arange(int(sizes[0]) + 2), "right")
        for i, j, found in pairs:
            if j != now:
                alpha[j % kept], now = 0.0, j
            p = model.rows(found)
            if j - i == 1:
                p[found == self.size] = FLOOR
            alpha[j % kept, : len(found)] += alpha[i % kept, : len(found)] * p
            if i == j - 1:
                over = slice(ends[j + 1], ends[j])
                out[order[over]] = np.log(np.maximum(alpha[j % kept, over], 1e-300))
        return out

    def _alone(self, model: Model, word: str) -> np.ndarray:
        last = np.full((self.longest, len(model.langs)), -np.inf)  # row k: k + 1 positions back
        last[0] = 0.0
        for _, found in self.blocks(word, max(1, CELLS // (self.longest * len(model.langs)))):
            p = model.rows(found)
            p[0, found[0] == self.size] = FLOOR
            with np.errstate(divide="ignore"):
                p = np.log(p)
            for j in range(found.shape[1]):
                own = last + p[:, j]
                most = own.max(axis=0)
                last = np.roll(last, 1, axis=0)
                last[0] = most + np.log(np.exp(own - most).sum(axis=0))
        return last[0]

    def expected(self, model: Model, words: list[str], counts: np.ndarray, langs: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(pieces, languages, expected counts) over all segmentations; word w is langs[w]'s, counts[w] times."""
        order = sorted((i for i in range(len(words)) if len(words[i]) <= SHORT), key=lambda i: len(words[i]))
        for at in range(0, len(order), 2000):
            chunk = np.array(order[at : at + 2000])
            yield self._expected_together(model, [words[i] for i in chunk], counts[chunk], langs[chunk])
        for i, word in enumerate(words):
            if len(word) > SHORT:
                yield from self._expected_alone(model, word, counts[i], langs[i])

    def _expected_together(self, model: Model, words: list[str], counts: np.ndarray, langs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        order, sizes, pairs = self.spans(words)
        lang, every = langs[order], np.arange(len(words))
        alpha = np.zeros((int(sizes[0]) + 1, len(words)))
        beta = np.zeros_like(alpha)
        alpha[0] = beta[sizes, every] = 1.0
        chances = []
        for i, j, found in pairs:
            p = model.cells(found, lang[: len(found)])
            if j - i == 1:
                p[found == self.size] = FLOOR
            chances.append((i, j, found, p))
            alpha[j, : len(found)] += alpha[i, : len(found)] * p
        for i, j, found, p in reversed(chances):
            beta[i, : len(found)] += p * beta[j, : len(found)]
        scale = counts[order] / np.maximum(alpha[sizes, every], 1e-300)
        cells = []
        for i, j, found, p in chances:
            n = len(found)
            there = np.flatnonzero(found < self.size)
            cells.append((found[there].astype(np.int64), lang[there], (alpha[i, :n] * p * beta[j, :n] * scale[:n])[there]))
        return tuple(map(np.concatenate, zip(*cells)))

    def _expected_alone(self, model: Model, word: str, count: float, lang: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """The same in logarithms, block by block; the states are two numbers a letter."""
        size, step = len(word) + 1, 1 << 14
        alpha, beta = (np.full(size + 1 + self.longest, -np.inf) for _ in "ab")  # alpha has ``longest`` places in front, beta behind
        alpha[self.longest] = beta[size] = 0.0

        def chances(found: np.ndarray) -> np.ndarray:
            p = model.cells(found, np.full(found.shape, lang))
            p[0, found[0] == self.size] = FLOOR
            with np.errstate(divide="ignore"):
                return np.log(p)

        def total(x: np.ndarray) -> float:
            most = x.max()
            return most + math.log(np.exp(x - most).sum()) if most > -np.inf else -np.inf

        blocks = list(self.blocks(word, step))
        for first, found in blocks:
            p = chances(found)
            for j in range(found.shape[1]):
                end = first + j
                alpha[self.longest + end] = total(alpha[end : end + self.longest][::-1] + p[:, j])
        whole = alpha[self.longest + size]
        for first, found in reversed(blocks):
            p = chances(found)
            for j in range(found.shape[1] - 1, -1, -1):
                end = first + j
                # From each start that leads here; what ends later has been added to beta[end] before.
                into = beta[end] + p[:, j]
                starts = np.arange(end - 1, end - 1 - self.longest, -1)
                ok = (starts >= 0) & (into > -np.inf)
                beta[starts[ok]] = np.logaddexp(beta[starts[ok]], into[ok])
        for first, found in blocks:
            p, ends = chances(found), first + np.arange(found.shape[1])
            starts = self.longest + ends - 1 - np.arange(self.longest)[:, None]
            weight = np.exp(alpha[starts] + p + beta[ends] - whole) * count
            there = found < self.size
            yield found[there].astype(np.int64), np.full(int(there.sum()), lang), weight[there]


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of a part of the rows; what is held stays of bounded size."""
    counts: dict[str, Counter] = {}

    def flush() -> Iterator[pa.RecordBatch]:
        for lang, own in counts.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(own)), pa.array(list(own)), pa.array(list(own.values()), pa.int64())], names=["lang", "word", "n"])
        counts.clear()

    for batch in batches:
        for at in range(0, batch.num_rows, SLICE):
            part = batch.slice(at, SLICE)
            for lang, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                counts.setdefault(lang, Counter()).update(words_of(text))
            if sum(map(len, counts.values())) > HELD_WORDS:
                yield from flush()
    yield from flush()


class Model:
    """Piece probabilities: ``base`` of each language, and what single pieces have beyond, sorted by piece.

    ``rows`` and ``cells`` give the probabilities of piece numbers; the number behind the last piece, for what is none,
    has 0.
    """

    def __init__(self, pieces: list[str], langs: list[str], base: np.ndarray, piece: np.ndarray, lang: np.ndarray, more: np.ndarray):
        order = np.lexsort((lang, piece))
        self.pieces, self.langs, self.base = pieces, langs, base
        self.lang, self.more = lang[order].astype(np.int32), more[order]
        self.starts = np.searchsorted(piece[order], np.arange(len(pieces) + 2))
        self.name = uuid.uuid4().hex

    def _dense(self, numbers: np.ndarray) -> np.ndarray:
        out = np.tile(self.base, (len(numbers), 1))
        out[numbers == len(self.pieces)] = 0.0
        sizes = self.starts[numbers + 1] - self.starts[numbers]
        at, _ = gather(np.arange(len(self.lang)), self.starts[numbers], sizes)
        out[np.repeat(np.arange(len(numbers)), sizes), self.lang[at]] += self.more[at]
        return out

    def rows(self, found: np.ndarray) -> np.ndarray:
        """(*found, languages)."""
        if (len(self.pieces) + 1) * len(self.langs) <= CELLS:
            if not hasattr(self, "table"):
                self.table = self._dense(np.arange(len(self.pieces) + 1))
            return self.table[found]
        numbers, place = np.unique(found, return_inverse=True)
        return self._dense(numbers)[place.reshape(found.shape)]

    def cells(self, found: np.ndarray, langs: np.ndarray) -> np.ndarray:
        """The probability of each piece in the language beside it."""
        if not hasattr(self, "keys"):
            self.keys = np.repeat(np.arange(len(self.pieces) + 1), np.diff(self.starts)) * len(self.langs) + self.lang
        out = np.where(found == len(self.pieces), 0.0, self.base[langs])
        if len(self.keys):
            wanted = found.astype(np.int64) * len(self.langs) + langs
            at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
            out += np.where(self.keys[at] == wanted, self.more[at], 0.0)
        return out

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("table", "keys")}


def rows_each(counts: dict[str, int], sample_rows: int) -> float:
    """How many rows of each language to use at most, so that ``sample_rows`` are used in all; LEAST_ROWS or more."""
    left = float(sample_rows)
    for k, n in enumerate(sorted(counts.values())):
        each = left / (len(counts) - k)
        if n > each:
            return max(each, LEAST_ROWS)
        left -= n
    return math.inf


def fit(labelled: DataFrame, sample_rows: int = SAMPLE_ROWS, rounds: int = ROUNDS, vocabulary: str | None = None) -> Model:
    """Fit on (doc_id, text, lang); all languages of the table are learned, from ``sample_rows`` rows in expectation, LEAST_ROWS of each or more."""
    spark = labelled.sparkSession
    limit_batches(spark)
    rows = labelled.where("doc_id is not null and text is not null and lang is not null").select("doc_id", F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    counts = dict(rows.groupBy("lang").count().collect())
    langs, pieces = sorted(counts), public_pieces(vocabulary)
    none = np.empty(0, np.int64)
    model = Model(pieces, langs, np.full(len(langs), 1 / len(pieces)), none, none, np.empty(0))
    if not langs:
        return model
    each = rows_each(counts, sample_rows)
    shares = [(lang, int(each / n * HASHES) + 1) for lang, n in counts.items() if n > each]
    if shares:
        share = spark.createDataFrame(shares, "lang string, share long")
        share = F.broadcast(share) if len(shares) <= MOST_SENT else share
        rows = rows.join(share, "lang", "left").where(F.pmod(F.xxhash64("doc_id"), F.lit(HASHES)) < F.coalesce("share", F.lit(HASHES)))
    words = shared_table(rows.select("lang", "text").mapInArrow(_count_words, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")))
    for _ in range(rounds):
        piece, lang, n = _expect(words, model)
        sums_each = np.bincount(lang, n, len(langs)) / COUNT_UNIT + SMOOTHING * len(pieces)
        n = n / COUNT_UNIT
        model = Model(pieces, langs, SMOOTHING / sums_each, piece, lang, n / sums_each[lang])
    return model


def _expect(words: DataFrame, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One E step: (pieces, languages, expected counts in COUNT_UNITs); as many as pieces occur in a language's sample."""
    sent, vocabulary = words.sparkSession.sparkContext.broadcast(model), zlib.crc32("\n".join(model.pieces).encode())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        segmenter = worker_state(("segmenter", vocabulary), lambda: Segmenter(m.pieces))
        number = {x: i for i, x in enumerate(m.langs)}
        for batch in batches:
            lang = np.array([number[x] for x in batch.column(0).to_pylist()], np.int64)
            for piece, language, n in segmenter.expected(m, batch.column(1).to_pylist(), batch.column(2).to_numpy().astype(float), lang):
                cells, place = np.unique(piece * len(m.langs) + language, return_inverse=True)
                whole = np.bincount(place, np.rint(n * COUNT_UNIT), len(cells)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(cells // len(m.langs)), pa.array(cells % len(m.langs)), pa.array(whole)], names=["piece", "lang", "n"])

    found = words.mapInArrow(run, "piece long, lang long, n long").groupBy("piece", "lang").agg(F.sum("n").alias("n")).toArrow()
    return tuple(found[c].to_numpy() for c in ("piece", "lang", "n"))


class Reader:
    """Languages of texts; remembers the scores of words."""

    def __init__(self, model: Model):
        self.model, self.segmenter, self.known = model, Segmenter(model.pieces), {}
        self.most = min(KNOWN, max(1000, CELLS // max(1, len(model.langs))))
        self.held = np.empty((self.most, len(model.langs)), np.int64)

    def _scores(self, words: list[str]) -> np.ndarray:
        return np.rint(self.segmenter.scores(self.model, words) * LOG_UNIT).astype(np.int64)

    def values(self, words: list[str]) -> np.ndarray:
        """(words, languages) log probabilities in LOG_UNITs."""
        new = list(set(words).difference(self.known))
        if len(self.known) + len(new) > self.most:
            self.known.clear()
            new = list(set(words))
        if len(new) > self.most:
            rows, order = self._scores(new), {w: i for i, w in enumerate(new)}
            return rows[np.fromiter(map(order.__getitem__, words), np.int64, len(words))]
        first = len(self.known)
        self.held[first : first + len(new)] = self._scores(new)
        self.known.update(zip(new, range(first, first + len(new))))
        return self.held[np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))]

    def read(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        lists = [words_of(x) if x else [] for x in texts]
        flat, totals = [w for x in lists for w in x], np.zeros((len(lists), len(self.model.langs)), np.int64)
        numbers = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
        step = max(1000, 2 * self.most)
        for at in range(0, len(flat) if self.model.langs else 0, step):
            own = numbers[at : at + step]
            first, last = int(own[0]), int(own[-1]) + 1
            totals[first:last] += sums(self.values(flat[at : at + step]), np.bincount(own - first, minlength=last - first))
        names, scores = [], []
        for words, row in zip(lists, totals / LOG_UNIT):
            known = bool(words) and bool(self.model.langs)
            best = int(row.argmax()) if known else 0
            names.append(self.model.langs[best] if known else "und")
            scores.append(min(1.0, 1 / math.fsum(np.exp(row - row[best]))) if known else 0.0)
        return names, scores


def predicted(spark: SparkSession, model: Model, text: Column) -> Column:
    """A column of structs (lang_pred, score) for ``text``, which alone is sent to Python."""
    limit_batches(spark)
    sent, name = spark.sparkContext.broadcast(model), model.name

    @arrow_udf("struct<lang_pred: string, score: double>")
    def read(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        reader = worker_state(("languages", name), lambda: Reader(sent.value))
        for column in columns:
            names, scores = [], []
            for at in range(0, len(column), SLICE):
                more = reader.read(column.slice(at, SLICE).to_pylist())
                names += more[0]
                scores += more[1]
            yield pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["lang_pred", "score"])

    return read(text.cast("string"))


def held_out(doc_id="doc_id"):
    """True for the fifth of documents, by crc32 of the id as text, that nothing is learned from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(False))


def identify(docs: DataFrame, **options) -> DataFrame:
    """doc_id, held_out, lang_pred, score per row of ``docs``; learned from its rows that are not held out."""
    model = fit(docs.where(~held_out()), **options)
    found = docs.select("doc_id", held_out().alias("held_out"), predicted(docs.sparkSession, model, F.col("text")).alias("found"))
    return found.select("doc_id", "held_out", "found.lang_pred", "found.score")


def drop_unidentified(docs: DataFrame, least: float = 0.5, **options) -> DataFrame:
    """The rows of ``docs`` whose language is known with a score of ``least`` or more, with its columns.

    The score is the posterior over all words of a text, near 1 for any text of more than a few words. So only texts
    without letters and near ties are dropped; long junk and texts in languages that were not learned stay.
    """
    model = fit(docs.where(~held_out()), **options)
    names = [f"_c{i}" for i in range(len(docs.columns))]
    found = docs.toDF(*names).withColumn("_found", predicted(docs.sparkSession, model, F.col(names[docs.columns.index("text")])))
    return found.where((F.col("_found.lang_pred") != "und") & (F.col("_found.score") >= least)).select(*names).toDF(*docs.columns)
