"""SentencePiece encoding and decoding by shared-prefix Viterbi over a trie.

A text becomes marked words: spaces turn into marks, one mark is put in front,
and a word starts where a mark follows anything else. No piece of the public
vocabulary has a mark behind another character, so words are encoded alone.

A word's encoding is the segmentation into pieces of the largest sum of the
model's scores. The distinct words of a slice are sorted, which is a depth-first
walk of their trie: forward scores, one a prefix, are computed where the trie
branches off and reused by all words with that prefix. At each prefix, of equal
sums the one with the longest last piece wins. A character outside the
vocabulary scores UNKNOWN less than the worst piece and becomes its bytes.

The public model is of the BPE kind, whose library applies merges by rank instead
of searching the best sum. With ``by="merges"`` the same walk gives the library's
ids: the state at a prefix is then the last piece of its one encoding, and a
piece may follow it exactly if BPE, given both side by side, leaves them as they
are.

Decoding joins the pieces' bytes, turns marks into spaces and drops the first.
The text comes back exactly unless it has a mark of its own; ``lossless`` says so.

Null texts count as empty and give no pieces. Very long words are walked once, in
time of their length. Repeated rows are encoded each; an empty table gives an
empty result. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import limit_batches, worker_state
from .pools import Pool, gather

MARK = "▁"
SLICE = 128
#: Words, and pairs of pieces, that a worker remembers.
CACHE, PAIRS = 250_000, 400_000
UNKNOWN = 10
WORD = re.compile(r" *[^ ]+| +")


class Codec:
    """A SentencePiece model, read from its public file; ``by`` is scores or merges."""

    def __init__(self, path: str | None = None, by: str = "scores"):
        import public_tokenizers
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path or public_tokenizers.path("piece_bpe_32k.model"))
        self.ids: dict[str, int] = {}
        self.byte_ids = [0] * 256
        shown = []
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte_ids[int(piece[3:5], 16)] = i
                shown.append(bytes([int(piece[3:5], 16)]))
            elif model.is_control(i) or model.is_unknown(i):
                shown.append(b"")
            else:
                self.ids[piece] = i
                shown.append(piece.replace(MARK, " ").encode())
        self.shown = np.frombuffer(b"".join(shown), np.uint8)
        self.shown_sizes = np.array([len(x) for x in shown], np.int64)
        self.shown_starts = np.cumsum(self.shown_sizes) - self.shown_sizes
        scores = {i: model.get_score(i) for i in self.ids.values()}
        self.unknown = min(scores.values()) - UNKNOWN
        self.matcher = ahocorasick.Automaton()
        for piece, i in self.ids.items():
            self.matcher.add_word(piece, (i, len(piece), scores[i]))
        for c in set("".join(self.ids)).difference(self.ids) if by == "scores" else ():
            self.matcher.add_word(c, (-1, 1, self.unknown))
        self.matcher.make_automaton()  # gives the pieces that end at a place, the longest first
        self.encode_words = {"scores": self.best_sums, "merges": self.by_merges}[by]
        self.rank = {i: -model.get_score(i) for i in self.ids.values()}
        self.texts = {i: p for p, i in self.ids.items()}
        self.splits: dict[int, tuple[int, int] | None] = {}
        self.stays: dict[int, bool] = {}
        self.pool = Pool(np.int32, CACHE)

    def split(self, piece: int) -> tuple[int, int] | None:
        """The two pieces whose merge makes ``piece``; None for one that no merge makes."""
        if piece not in self.splits:
            parts = [self.ids[c] for c in self.texts[piece] if c in self.ids]
            if len(parts) == len(self.texts[piece]):
                while len(parts) > 2:
                    best = min(((self.rank[m], k, m) for k in range(len(parts) - 1) if (m := self.ids.get(self.texts[parts[k]] + self.texts[parts[k + 1]])) is not None), default=None)
                    if best is None:
                        break
                    parts[best[1] : best[1] + 2] = [best[2]]
            self.splits[piece] = tuple(parts) if len(parts) == 2 else None
        return self.splits[piece]

    def fits(self, p: int, t: int) -> bool:
        """Whether BPE leaves the encoding p, t of their joined text as it is.

        Undo the merges on both sides of the seam, latest first: if at any moment a merge across the seam
        would have come before the one undone last, BPE had made it.
        """
        if len(self.stays) > PAIRS:
            self.stays.clear()
        a, b, bound, on_left = p, t, float("inf"), True
        while True:
            across = self.ids.get(self.texts[a] + self.texts[b])
            # On a tie the leftmost merge comes first: one across the seam precedes one on its right, not one on its left.
            if across is not None and (self.rank[across] < bound or (self.rank[across] == bound and not on_left)):
                out = False
                break
            left, right = self.split(a), self.split(b)
            if left is None and right is None:
                out = True
                break
            undo_left = right is None or (left is not None and self.rank[a] > self.rank[b])
            if undo_left:
                bound, on_left, a = self.rank[a], True, left[1]
            else:
                bound, on_left, b = self.rank[b], False, right[0]
        self.stays[p << 20 | t] = out
        return out

    def best_sums(self, words: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Sorted words, sizes and ids of their encodings, by a depth-first walk of their trie."""
        words = sorted(words)
        matches, unknown = self.matcher.iter, self.unknown
        best: list[float] = [0.0]  # the largest sum at each prefix
        last: list[int] = [-1]  # its last piece; -1 for a character's bytes
        back: list[int] = [0]
        previous = ""
        sizes, flat = [], []
        for word in words:
            shared, most = 0, min(len(word), len(previous))
            while shared < most and word[shared] == previous[shared]:
                shared += 1
            end = shared + 1  # the first prefix without a score
            del best[end:], last[end:], back[end:]
            for at, (piece, length, score) in matches(word):
                if at < shared:
                    continue
                while end <= at:  # characters of no piece
                    best.append(best[-1] + unknown)
                    last.append(-1)
                    back.append(end - 1)
                    end += 1
                start = at + 1 - length
                score += best[start]
                if end == at + 1:
                    best.append(score)
                    last.append(piece)
                    back.append(start)
                    end += 1
                elif score > best[-1]:
                    best[-1], last[-1], back[-1] = score, piece, start
            while end <= len(word):
                best.append(best[-1] + unknown)
                last.append(-1)
                back.append(end - 1)
                end += 1
            previous = word
            out = self.trace(word, last, back)
            sizes.append(len(out))
            flat += out
        return words, np.array(sizes, np.int64), np.array(flat, np.int32)

    def trace(self, word: str, last: list[int], back: list[int]) -> list[int]:
        """The ids on the way back from the word's end."""
        out, end = [], len(word)
        while end:
            start = back[end]
            if last[end] == -1:
                out += [self.byte_ids[x] for x in reversed(word[start:end].encode("utf-8", "replace"))]
            else:
                out.append(last[end])
            end = start
        out.reverse()
        return out

    def by_merges(self, words: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Sorted words, sizes and ids of the library's encodings, by the same walk."""
        words = sorted(words)
        fits, known, matches = self.fits, self.stays.get, self.matcher.iter
        last: list[int] = [-1]  # the last piece at each prefix; -1 at the start and behind bytes
        back: list[int] = [0]
        previous = ""
        sizes, flat = [], []
        for word in words:
            shared, most = 0, min(len(word), len(previous))
            while shared < most and word[shared] == previous[shared]:
                shared += 1
            del last[shared + 1 :], back[shared + 1 :]
            end = shared + 1  # the first prefix without a state
            for at, (piece, length, _) in matches(word):
                if at + 1 < end:
                    continue
                while end <= at:  # characters of no piece
                    last.append(-1)
                    back.append(end - 1)
                    end += 1
                before = last[at + 1 - length]
                if before != -1:
                    stay = known(before << 20 | piece)
                    if not (fits(before, piece) if stay is None else stay):
                        continue
                last.append(piece)
                back.append(at + 1 - length)
                end += 1
            while end <= len(word):
                last.append(-1)
                back.append(end - 1)
                end += 1
            previous = word
            out = self.trace(word, last, back)
            sizes.append(len(out))
            flat += out
        return words, np.array(sizes, np.int64), np.array(flat, np.int32)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after the other, size of each)."""
        lists = []
        for text in texts:
            if not text:
                lists.append([])
            elif "  " in text or text[0] == " " or text[-1] == " " or MARK in text:
                text = text.replace(MARK, " ")
                lists.append([w.replace(" ", MARK) for w in WORD.findall(" " + text)])
            else:
                lists.append([MARK + w for w in text.split(" ")])
        flat = [w for x in lists for w in x]
        ids, sizes = self.pool.gather(self.pool.resolve(flat, lambda new: self.pool.add(*self.encode_words(new))))
        ends = np.concatenate([[0], np.cumsum(sizes)])
        bounds = np.cumsum([0, *map(len, lists)])
        return ids, np.diff(ends[bounds])

    def decode(self, ids: np.ndarray, sizes: np.ndarray) -> list[bytes]:
        shown, lengths = gather(self.shown, self.shown_starts[ids], self.shown_sizes[ids])
        ends = np.concatenate([[0], np.cumsum(lengths)])[np.concatenate([[0], np.cumsum(sizes)])]
        whole = shown.tobytes()
        return [whole[a + (whole[a : a + 1] == b" ") : b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]


def worker_codec(path: str | None, by: str) -> Codec:
    return worker_state(("pieces", path, by), lambda: Codec(path, by))


def encoded(docs: DataFrame, path: str | None = None, by: str = "scores") -> DataFrame:
    """doc_id, ids (array of piece ids) and lossless (whether decoding them gives the text), per row."""
    limit_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = worker_codec(path, by)
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                texts = [x or "" for x in batch.column(1).slice(at, SLICE).to_pylist()]
                ids, sizes = codec.encode(texts)
                same = [a == b.encode() for a, b in zip(codec.decode(ids, sizes), texts)]
                arrays = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32), ids)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, SLICE), arrays, pa.array(same, pa.bool_())], names=["doc_id", "ids", "lossless"])

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, ids array<int>, lossless boolean")


def decoded(rows: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and text of rows of doc_id and ids; null ids give a null text."""
    limit_batches(rows.sparkSession)
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = worker_codec(path, "scores")
        for batch in batches:
            lists = batch.column(1)
            sizes = np.array([len(x) if x is not None else 0 for x in lists.to_pylist()], np.int64)
            texts = codec.decode(lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64), sizes)
            texts = [None if gone else x.decode("utf-8", "replace") for x, gone in zip(texts, lists.is_null().to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return rows.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, text string")


def piece_report(docs: DataFrame, path: str | None = None, by: str = "scores") -> DataFrame:
    """doc_id, n_pieces, pieces_crc32 (ids as little-endian 32-bit numbers), text_sha256 (of the decoded text), lossless."""
    limit_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = worker_codec(path, by)
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                texts = [x or "" for x in batch.column(1).slice(at, SLICE).to_pylist()]
                ids, sizes = codec.encode(texts)
                back = codec.decode(ids, sizes)
                ends, stored = np.concatenate([[0], np.cumsum(sizes)]).tolist(), ids.astype("<i4")
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(at, SLICE),
                        pa.array(sizes, pa.int64()),
                        pa.array([zlib.crc32(stored[a:b].tobytes()) for a, b in zip(ends[:-1], ends[1:])], pa.int64()),
                        pa.array([hashlib.sha256(x).hexdigest() for x in back]),
                        pa.array([a == b.encode() for a, b in zip(back, texts)], pa.bool_()),
                    ],
                    names=["doc_id", "n_pieces", "pieces_crc32", "text_sha256", "lossless"],
                )

    # One pass encodes and decodes: two in a row would be two Python workers a task.
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, n_pieces long, pieces_crc32 long, text_sha256 string, lossless boolean")
