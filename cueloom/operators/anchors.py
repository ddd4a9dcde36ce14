"""Long alignments in pieces: anchors that both texts share once, a chain of them, blocks between.

A media whose matrix has more than FULL_CELLS cells is not aligned in one piece.
Runs of GRAM characters that each of its two texts holds exactly once are found
by sorting their hashes where the two texts are; the longest chain of them that ascends in both
texts is taken, and the texts are cut within anchors of the chain, into blocks of
about BLOCK characters. Blocks are aligned in parallel, each in linear memory: a
block without anchors of any size is halved where the best scores from both ends
meet, until its parts have FULL_CELLS cells or fewer.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from . import align_matrix
from .align_matrix import GAP, MATCH, MISMATCH, aligned

GRAM, BLOCK = 16, 1500
#: Cells up to which a block is aligned exactly, in linear memory; beyond that in a corridor.
LINEAR_CELLS = 4_000_000_000
#: Blocks that a task aligns side by side, and rows of a frame that it gives.
BLOCKS = 512


def last_scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Best scores of all of ``a`` against each prefix of ``b``, one row at a time."""
    slope = GAP * np.arange(len(b) + 1, dtype=np.int64)
    row = slope.copy()
    for c in a:
        best = row + GAP
        np.maximum(best[1:], row[:-1] + np.where(b == c, MATCH, MISMATCH), out=best[1:])
        row = np.maximum.accumulate(best - slope) + slope
    return row


def aligned_in_halves(ref: str, heard: str) -> np.ndarray:
    """An alignment of the same score as the whole matrix's, with memory for FULL_CELLS of its cells and a few rows."""
    n, m = len(ref), len(heard)
    if n * m <= align_matrix.FULL_CELLS or n < 2 or n * m > LINEAR_CELLS:
        return aligned(ref, heard)
    a, b = (np.frombuffer(x.encode("utf-32-le"), np.uint32) for x in (ref, heard))
    half = n // 2
    cut = int((last_scores(a[:half], b) + last_scores(a[half:][::-1], b[::-1])[::-1]).argmax())
    right = aligned_in_halves(ref[half:], heard[cut:])
    return np.concatenate([aligned_in_halves(ref[:half], heard[:cut]), np.where(right >= 0, right + cut, -1)])


def aligned_pairs(pairs: list[tuple[str, str]]) -> list[np.ndarray]:
    """An alignment of each pair with the whole matrix's score: in a band, all side by side, or else in halves. Equal pairs are aligned once."""
    numbers: dict[tuple[str, str], int] = {}
    which = [numbers.setdefault(p, len(numbers)) for p in pairs]
    found = [aligned_in_halves(*p) if places is None else places for p, places in zip(numbers, align_matrix.aligned_many(list(numbers)))]
    return [found[k] for k in which]


def longest_chain(i: list[int], j: list[int]) -> list[int]:
    """Numbers of the longest run of pairs that ascends in both; pairs come ascending by ``i``, all of them distinct."""
    ends, numbers, before = [], [], [-1] * len(i)
    for k, x in enumerate(j):
        at = bisect_left(ends, x)
        if at == len(ends):
            ends.append(x)
            numbers.append(k)
        else:
            ends[at], numbers[at] = x, k
        before[k] = numbers[at - 1] if at else -1
    out, k = [], numbers[-1] if numbers else -1
    while k >= 0:
        out.append(k)
        k = before[k]
    return out[::-1]


def cuts(pairs: list[tuple[int, int]], n: int, m: int, gram: int, block: int) -> list[tuple[int, int]]:
    """Where to cut texts of ``n`` and ``m`` characters: the ends of blocks, the last one the texts' own."""
    pairs = sorted(pairs)
    out, last = [], 0
    for k in longest_chain([p[0] for p in pairs], [p[1] for p in pairs]):
        i, j = pairs[k][0] + gram // 2, pairs[k][1] + gram // 2
        if i - last >= block and n - i >= gram:
            out.append((i, j))
            last = i
    return [*out, (n, m)]


def once(text: str, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, ascending; places) of the runs of ``gram`` characters that ``text`` holds exactly once."""
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)
    hashes = np.zeros(max(0, len(text) - gram + 1), np.uint64)
    for k in range(gram):
        hashes = hashes * np.uint64(0x9E3779B97F4A7C15) + codes[k : k + len(hashes)]
        hashes ^= hashes >> np.uint64(29)
    found, places, n = np.unique(hashes, return_index=True, return_counts=True)
    return found[n == 1], places[n == 1]


def anchored(ref: str, heard: str, gram: int = GRAM) -> list[tuple[int, int]]:
    """Places in ``ref`` and ``heard``, ascending, of every run of ``gram`` characters that each holds once."""
    (a, i), (b, j) = once(ref, gram), once(heard, gram)
    _, x, y = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    i, j = i[x], j[y]
    order = np.argsort(i)
    return [(p, q) for p, q in zip(i[order].tolist(), j[order].tolist()) if ref[p : p + gram] == heard[q : q + gram]]


def blocks_of(texts: DataFrame, gram: int = GRAM, block: int = BLOCK, full_cells: int | None = None) -> DataFrame:
    """media_id, ref_at, heard_at, ref, heard: the blocks of ``texts`` (media_id, ref, heard), a media of few cells as one."""
    long = F.length("ref").cast("long") * F.length("heard") > (align_matrix.FULL_CELLS if full_cells is None else full_cells)
    kind = texts.schema["media_id"].dataType.simpleString()

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for media_id, ref, heard in zip(part["media_id"], part["ref"], part["heard"]):
                ends = cuts(anchored(ref, heard, gram), len(ref), len(heard), gram, block)
                for at in range(0, len(ends), BLOCKS):
                    rows = list(zip([(0, 0), *ends][at:], ends[at : at + BLOCKS]))
                    yield pd.DataFrame({"media_id": media_id, "ref_at": [a[0] for a, _ in rows], "heard_at": [a[1] for a, _ in rows], "ref": [ref[a[0] : b[0]] for a, b in rows], "heard": [heard[a[1] : b[1]] for a, b in rows]})

    schema = f"media_id {kind}, ref_at int, heard_at int, ref string, heard string"
    parts = texts.where(long).select("media_id", "ref", "heard").mapInPandas(run, schema)
    return texts.where(~long).select("media_id", F.lit(0).alias("ref_at"), F.lit(0).alias("heard_at"), "ref", "heard").unionByName(parts)


def matched_runs(blocks: DataFrame) -> DataFrame:
    """media_id, i, j, n: runs of ``n`` characters of ref from ``i`` on that stand against those of heard from ``j`` on."""
    kind = blocks.schema["media_id"].dataType.simpleString()

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for at in range(0, len(part), BLOCKS):
                some = part.iloc[at : at + BLOCKS]
                found = aligned_pairs(list(zip(some["ref"], some["heard"])))
                block, i = np.repeat(np.arange(len(some)), [len(p) for p in found]), np.concatenate([np.arange(len(p)) for p in found])
                j = np.concatenate(found)
                block, i, j = block[j >= 0], i[j >= 0], j[j >= 0]
                first = np.flatnonzero(np.concatenate([[True], (np.diff(block) != 0) | (np.diff(i) != 1) | (np.diff(j) != 1)])) if len(i) else i
                own = some.iloc[block[first]]
                yield pd.DataFrame({"media_id": own["media_id"].to_numpy(), "i": i[first] + own["ref_at"].to_numpy(), "j": j[first] + own["heard_at"].to_numpy(), "n": np.diff(np.append(first, len(i)))})

    dealt = blocks.repartition("media_id", "ref_at")
    return dealt.mapInPandas(run, f"media_id {kind}, i int, j int, n int")
