"""Token ids in ORC files.

Documents are range-partitioned by doc_id and sorted, so the files ascend, and
each is written by one task with the ids as a list of integers (ORC's run-length
encoding), row indexes, and a Bloom filter on doc_id: readers take stripes in
parallel and skip by id. Each row also has its range's number and its offset in
it, so the global offset of a document needs no more than the ranges' totals.

Texts get the ids that the tokenizers library gives them. Its pre-tokenisation
never goes over a single space, nor from a word over a stop, so each distinct
word with the space before it is encoded once, by the library, and remembered,
by two 64-bit hashes: one finds it, the other tells it from a word of the same
first hash, whose text is then cut and looked up by its characters. Texts with a
string of the vocabulary's special tokens, or with characters that Python's
classes see in another way than the library's pattern, go to the library whole.

A document is its ids and one end id. Null texts have the end id alone. Rows of
a null doc_id come first; rows of one doc_id are ordered by a hash of their text,
then the text; repeated rows are written each. Other columns are ignored. An
empty table writes empty files.
"""

from __future__ import annotations

import re
import sys
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .common import limit_batches, mix64, odd_constants, removed_at_exit, shared_dir, worker_state
from .pools import HashedPool, Pool, gather

END_ID = 0
SLICE = 128
CACHE, PIECES = 1_500_000, 100_000
VOCABULARY = "byte_bpe_50k.json"
STORED = "doc_id long, ids array<int>, n_ids int, range_id int, range_start long"
#: Ranges at most, so that their totals, which are broadcast, are of two megabytes at most. At 100 TB one holds a gigabyte.
MOST_RANGES = 100_000


#: The library's pattern in the terms of ``re``; the same on texts without ODD characters.
PIECE = re.compile(r"'(?:[stmd]|re|ve|ll)| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")


#: Bytes as kinds: a word's, a stop, white space, other. Two bytes of these kinds in a row let no cut at a stop be seen.
KINDS = bytes(0x2E if c in b".," else 0x20 if c == 0x20 or 9 <= c <= 13 or 28 <= c <= 31 else 0x61 if c >= 0x80 or chr(c).isalnum() else 0x21 for c in range(256))
UNCLEAR = (b"  ", b" .", b"..", b"!.")
CUTS = np.array([k in (0x20, 0x2E) for k in KINDS])
SPACES, ODD_SPACES = (np.isin(np.arange(256), list(x)) for x in (b" \t\n\v\f\r", range(28, 32)))
#: Bytes of a unit that is looked up by its hash; texts with longer ones are cut into pieces.
LONGEST = 64
FACTORS, CHECKS = odd_constants(7, LONGEST + 1), odd_constants(11, LONGEST + 1)


def odd_characters() -> frozenset[str]:
    """Numbers that are no decimal digits, and separators that only Python takes for white space."""
    every = map(chr, range(sys.maxunicode + 1))
    return frozenset(c for c in every if unicodedata.category(c) in ("No", "Nl") or c.isspace() and unicodedata.category(c) == "Cc" and c not in "\t\n\v\f\r")


class Encoder:
    def __init__(self, path: str | None = None):
        import public_tokenizers
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path or public_tokenizers.path(VOCABULARY))
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        if hasattr(self.tokenizer.model, "_resize_cache"):
            self.tokenizer.model._resize_cache(0)  # each unit comes once
        self.odd, self.letters = odd_characters(), set()
        self.pool, self.hashed = Pool(np.int32, PIECES), HashedPool(np.int32, CACHE)
        #: A second hash of each remembered unit, by slot.
        self.checks = np.zeros(1 << self.hashed.bits, np.uint64)
        # Bytes that each id stands for: its characters, one a byte.
        self.width = np.zeros(self.tokenizer.get_vocab_size() + 1, np.int64)
        for token, i in self.tokenizer.get_vocab().items():
            self.width[i] = len(token)

    def encode_joined(self, joined: str, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(sizes, ids) of units that stand one after the other in ``joined``, each from white space on; ``ends`` counts bytes."""
        ids = np.array(self.tokenizer.encode_batch_fast([joined], add_special_tokens=False)[0].ids, np.int32)
        return np.diff(np.searchsorted(np.cumsum(self.width[ids]), ends) + 1, prepend=0), ids

    def encode_alone(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = [x.ids for x in self.tokenizer.encode_batch_fast(units, add_special_tokens=False)]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        return sizes, np.fromiter((i for x in found for i in x), np.int32, int(sizes.sum()))

    def encode_units(self, units: list[str]) -> tuple[list[int], np.ndarray, np.ndarray]:
        """(order, sizes, ids) of distinct units: most go as one text, cut where their bytes end, others alone.

        ``order`` has the numbers of the units that ``sizes`` and ``ids`` follow; those with odd characters are left out.
        """
        bad = set() if self.odd.isdisjoint(set("".join(units))) else {k for k, p in enumerate(units) if not self.odd.isdisjoint(p)}
        joined = [k for k, p in enumerate(units) if len(p) > 1 and p[0] == " " and not p[1].isspace() and k not in bad]
        chosen = set(joined) | bad
        alone = [k for k in range(len(units)) if k not in chosen]
        parts = []
        if joined:
            parts.append(self.encode_joined("".join([units[k] for k in joined]), np.cumsum([len(units[k].encode()) for k in joined])))
        if alone:
            parts.append(self.encode_alone([units[k] for k in alone]))
        return joined + alone, *self._after_each_other(parts)

    @staticmethod
    def _after_each_other(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        return np.concatenate([x for x, _ in parts] or [np.empty(0, np.int64)]), np.concatenate([x for _, x in parts] or [np.empty(0, np.int32)])

    def encode_cuts(self, whole: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(order, sizes, ids) of distinct units of clear texts, given by where they are in ``whole``.

        A unit is cut at each white space, so what has more than one byte and starts with it ends in something else,
        and goes in one text with the others of its kind.
        """
        first = whole[starts]
        joined = np.flatnonzero(SPACES[first] & (lengths > 1))
        alone = np.flatnonzero(~(SPACES[first] & (lengths > 1)) & ~ODD_SPACES[first])
        parts = []
        if len(joined):
            said, sizes = gather(whole, starts[joined], lengths[joined])
            parts.append(self.encode_joined(said.tobytes().decode(), np.cumsum(sizes)))
        if len(alone):
            parts.append(self.encode_alone([whole[a : a + n].tobytes().decode() for a, n in zip(starts[alone].tolist(), lengths[alone].tolist())]))
        return np.concatenate([joined, alone]), *self._after_each_other(parts)

    def clear(self, text: str, data: bytes) -> bool:
        """Whether every stop and white space of the text follows a word, so that units can be cut there."""
        kinds = data.translate(KINDS)
        if not data or kinds[:1] == b"." or any(x in kinds for x in UNCLEAR) or any(x in text for x in self.special):
            return False
        if not text.isascii():
            new = set(text).difference(self.letters)
            self.letters.update(c for c in new if c.isascii() or c.isalpha())
            return self.letters.issuperset(new)
        return True

    def encode_clear(self, data: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, number of ids of each text, mask of the texts that must go elsewhere). Units are cut and looked up as arrays."""
        sizes = np.fromiter(map(len, data), np.int64, len(data))
        whole = np.frombuffer(b"".join(data), np.uint8)
        ends = np.cumsum(sizes)
        cut = CUTS[whole]
        cut[ends - sizes] = True
        starts = np.flatnonzero(cut)
        lengths = np.diff(starts, append=len(whole))
        text_of = np.searchsorted(ends, starts, "right")
        within = np.arange(len(whole)) - np.repeat(starts, lengths)
        long = lengths > LONGEST
        keys = mix64(np.add.reduceat((whole + np.uint64(1)) * FACTORS[np.minimum(within, LONGEST)], starts) + lengths.astype(np.uint64)) | np.uint64(1)
        checks = np.add.reduceat((whole + np.uint64(1)) * CHECKS[np.minimum(within, LONGEST)], starts)
        slots = self.hashed.find(keys)
        for attempt in range(2):
            new, first = np.unique(keys[(slots == -1) & ~long], return_index=True)
            first = np.flatnonzero((slots == -1) & ~long)[first]
            if self.hashed.count + len(new) > self.hashed.limit and not attempt:
                self.hashed.clear()
                slots = np.full(len(keys), -1, np.int32)
                continue
            break
        if len(new):
            order, found, ids = self.encode_cuts(whole, starts[first], lengths[first])
            self.checks[self.hashed.count : self.hashed.count + len(order)] = checks[first[order]]
            self.hashed.add(new[order], found, ids)
            gone = np.flatnonzero(slots == -1)
            slots[gone] = self.hashed.find(keys[gone])
        # A unit whose key is another's is told by its check; its text goes elsewhere.
        slots[(slots >= 0) & (self.checks[np.maximum(slots, 0)] != checks)] = -2
        bad = np.zeros(len(data), bool)
        bad[text_of[(slots < 0) | long]] = True
        good = ~bad[text_of]
        ids, counts = self.hashed.runs.gather(slots[good].astype(np.int64))
        return ids, np.bincount(text_of[good], counts, len(data)).astype(np.int64), bad

    def encode_pieces(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids of each text) by the library's own pieces; texts with special or odd strings go whole."""
        lists = [PIECE.findall(x) for x in texts]
        bounds = np.cumsum([0, *map(len, lists)])

        def learn(new: list[str]) -> None:
            order, sizes, ids = self.encode_units(new)
            self.pool.add([new[k] for k in order], sizes, ids)

        slots = self.pool.resolve([p for x in lists for p in x], learn)
        odd = np.unique(np.searchsorted(bounds, np.flatnonzero(slots < 0), "right") - 1).tolist()
        runs = []
        for k, text in enumerate(texts):
            if k in odd or any(s in text for s in self.special):
                runs.append(np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.int32))
            else:
                runs.append(self.pool.gather(slots[bounds[k] : bounds[k + 1]])[0])
        return np.concatenate(runs), np.array(list(map(len, runs)), np.int64)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after the other, number of ids of each), without end ids."""
        data = [x.encode() for x in texts]
        clear = np.array([self.clear(x, d) for x, d in zip(texts, data)], bool)
        counts, parts = np.zeros(len(texts), np.int64), []
        place = np.zeros(len(texts), np.int64)
        if clear.any():
            which = np.flatnonzero(clear)
            ids, own, bad = self.encode_clear([data[k] for k in which])
            counts[which], parts = own, [ids]
            place[which] = np.cumsum(own) - own
            clear[which[bad]] = False
        if not clear.all():
            which = np.flatnonzero(~clear)
            ids, own = self.encode_pieces([texts[k] for k in which])
            counts[which] = own
            place[which] = sum(map(len, parts)) + np.cumsum(own) - own
            parts.append(ids)
        return gather(np.concatenate(parts), place, counts)


def _writer(path: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_state(("tokens", path), lambda: Encoder(path))
        range_id, start = TaskContext.get().partitionId(), 0
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                texts = [x or "" for x in batch.column(1).slice(at, SLICE).to_pylist()]
                ids, counts = encoder.encode(texts)
                ends = np.cumsum(counts)
                ids = np.insert(ids, ends, END_ID)
                ends = np.concatenate([[0], ends + np.arange(1, len(ends) + 1)])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(at, SLICE),
                        pa.ListArray.from_arrays(ends.astype(np.int32), ids.astype(np.int32)),
                        pa.array(np.diff(ends).astype(np.int32)),
                        pa.array(np.full(len(texts), range_id, np.int32)),
                        pa.array(start + ends[:-1]),
                    ],
                    names=["doc_id", "ids", "n_ids", "range_id", "range_start"],
                )
                start += int(ends[-1])

    return run


def write_tokens(docs: DataFrame, out: str, tokenizer: str | None = None, ranges: int | None = None) -> None:
    """Write doc_id, ids, n_ids, range_id and range_start as ORC under ``out``, ascending by doc_id over the files' ranges.

    There are as many ranges as splits of the input, at least one a shuffle partition, MOST_RANGES at most. Rows of one
    doc_id are dealt and ordered by their texts, so a doc_id of very many rows is no single range, and a task that runs
    again writes the same offsets.
    """
    limit_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    if ranges is None:
        ranges = min(MOST_RANGES, max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), rows.rdd.getNumPartitions()))
    keys = "doc_id", F.xxhash64("text")
    dealt = rows.repartitionByRange(ranges, *keys).sortWithinPartitions(*keys, "text")
    (
        dealt.mapInArrow(_writer(tokenizer), STORED)
        .write.option("orc.bloom.filter.columns", "doc_id")
        .option("orc.bloom.filter.fpp", "0.01")
        .option("orc.create.index", "true")
        .option("orc.row.index.stride", "10000")
        .orc(out)
    )


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it) and ids, from the files."""
    rows = spark.read.schema(STORED).orc(path)
    totals = rows.groupBy("range_id").agg(F.sum("n_ids").alias("total"))
    # One row a range, MOST_RANGES at most.
    before = totals.select("range_id", (F.sum("total").over(Window.orderBy("range_id")) - F.col("total")).alias("before"))
    return rows.join(F.broadcast(before), "range_id").select("doc_id", (F.col("before") + F.col("range_start")).alias("start"), "ids")


def token_report(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 (of the ids as little-endian unsigned 32-bit integers), read from the files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            ids, ends = lists.values.to_numpy().astype("<u4"), lists.offsets.to_numpy()
            crc = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.diff(ends).astype(np.int64)), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return read_tokens(spark, path).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def stored_report(docs: DataFrame) -> DataFrame:
    """Write ``docs`` to the shared folder and report what the files say."""
    path = shared_dir(docs.sparkSession)
    write_tokens(docs, path)
    removed_at_exit(docs.sparkSession, path)
    return token_report(docs.sparkSession, path)
