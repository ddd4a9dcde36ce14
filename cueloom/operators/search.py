"""The search for readable cues, over all runs of an Arrow batch at once.

Tokens of many runs stand behind each other; ``opens`` are the places where runs begin. What a cut needs to know of a
word is found once for each distinct one. A level of the search looks at every place of all pieces that are still too
long, as a few vector operations: lengths and times of any piece come from prefix sums and the tokens at its ends.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from ..functions import text as T

LANGUAGES = ("en", "ja", "zh")


@lru_cache(50_000)
def features(text: str) -> tuple[float, ...]:
    """Of a word: its length in en and in ja or zh; whether it takes no space behind it, before it, ends and begins with
    a digit, has kana or Han characters; the score of a cut behind its mark, and of one before it in en."""
    word = text.strip(T.SPACES)
    parts, stop = word.split(), word.rstrip(T.CLOSERS)[-1:]
    first = re.match("[a-z']+", word.lower())
    return (
        len(" ".join(parts)), len("".join(parts)), *T.joins(word),
        bool(re.search("[぀-ヿ]", word)), bool(re.search("[㐀-鿿]", word)), 100.0 if stop and stop in T.MAJOR else 80.0 if stop and stop in T.SOFT else 0.0, 45.0 if first and first[0] in T.BREAK_BEFORE else 0.0,
    )


def named(name: str | None) -> int:
    """The number of the language that a name says, else -1."""
    name = (name or "").strip(T.SPACES).lower()
    return next((k for k, starts in ((1, T.JA), (2, T.ZH), (0, T.EN)) if name.startswith(starts)), -1)


def first_named(languages: pa.Array, opens: np.ndarray) -> np.ndarray:
    """``named`` of the first name in each run."""
    said = np.flatnonzero(languages.is_valid().to_numpy(zero_copy_only=False))
    at = np.searchsorted(said, opens)
    has = at < len(said)
    has[has] = said[at[has]] < np.append(opens[1:], len(languages))[has]
    out = np.full(len(opens), -1)
    out[has] = list(map(named, languages.take(pa.array(said[at[has]])).to_pylist()))
    return out


class Runs:
    """Clean tokens of runs, in order: ``words`` with the number ``at`` of each token's, ``start`` and ``end`` of each, where runs open and what their languages are (-1: told by the words)."""

    def __init__(self, words: list[str], at: np.ndarray, start: np.ndarray, end: np.ndarray, opens: np.ndarray, language: np.ndarray, limits: T.Limits = T.Limits()):
        self.start, self.end, self.opens, self.limits, self.n = start, end, opens, limits, len(start)
        self.run = np.repeat(np.arange(len(opens)), np.diff(np.append(opens, self.n)))
        spread, packed, behind, before, ends, begins, kana, han, marks, breaks = np.array(list(map(features, words)), float).reshape(-1, 10).T[:, at]
        if self.n and (language < 0).any():
            told = np.where(np.maximum.reduceat(kana, opens) > 0, 1, np.where(np.maximum.reduceat(han, opens) > 0, 2, 0))
            language = np.where(language < 0, told, language)
        dense = (language > 0)[self.run]
        # Whether a space stands before a word, and whether it counts.
        self.spaced = np.zeros(self.n, bool)
        self.spaced[1:] = (behind[:-1] + before[1:] + ends[:-1] * begins[1:]) == 0
        self.spaced[opens] = False
        own, glue = np.where(dense, packed, spread).astype(np.int64), (self.spaced & ~dense).astype(np.int64)
        self.sums, self.glue = np.concatenate([[0], np.cumsum(own + glue)]), np.append(glue, 0)
        chars, top = dict(limits.chars), dict(limits.cps)
        self.chars = np.array([max(1, limits.max_lines) * chars[x] for x in LANGUAGES])[language]
        self.top = np.array([top[x] for x in LANGUAGES], float)[language]
        # The score of a cut before each token.
        self.major, self.pause = marks == 100.0, np.zeros(self.n)
        self.pause[1:] = np.maximum(0.0, start[1:] - end[:-1])
        self.cuts = np.maximum(np.where(self.pause >= limits.pause, 70.0 + np.minimum(self.pause, 1.5) * 5.0, 0.0), np.where(dense, 0.0, breaks))
        self.cuts[1:] = np.maximum(self.cuts[1:], marks[:-1])

    def length(self, a, b):
        return self.sums[b] - self.sums[a] - self.glue[a]

    def duration(self, a, b):
        return np.maximum(0.001, self.end[b - 1] - self.start[a])

    def sentences(self) -> np.ndarray:
        """Where groups open: with a run, behind a major mark and after a pause."""
        opens = self.pause >= self.limits.pause
        opens[1:] |= self.major[:-1]
        opens[self.opens] = True
        return np.flatnonzero(opens)

    def split(self, opens: np.ndarray, weak: bool) -> np.ndarray:
        """Where pieces open after groups are cut while they are too long."""
        most, least = self.limits.max_duration, self.limits.min_duration
        a, b, done = opens, np.append(opens[1:], self.n), []
        excess = lambda x, top, floor: np.where(x > top, x / np.maximum(top, floor) - 1.0, 0.0)
        while len(a):
            long = (b - a > 1) & ((self.duration(a, b) > most) | (self.length(a, b) > self.chars[self.run[a]]))
            done.append(a[~long])
            a, b = a[long], b[long]
            if not len(a):
                break
            size = b - a - 1
            first = np.cumsum(size) - size
            k = np.repeat(np.arange(len(a)), size)
            at = np.arange(len(k)) - first[k] + a[k] + 1
            of, to, chars, top = a[k], b[k], self.chars[self.run[a]][k], self.top[self.run[a]][k]
            base = self.cuts[at]
            left_l, right_l = self.length(of, at), self.sums[to] - self.sums[at] - self.glue[at]
            left_d, right_d = self.duration(of, at), self.duration(at, to)
            short = sum(np.where(d < least, (least - d) / max(least, 0.001) * 35.0, 0.0) for d in (left_d, right_d))
            balance = np.abs(left_l / np.maximum(self.length(of, to), 1) - 0.5) * 30.0
            over = [excess(d, most, 0.001) + excess(n, chars, 1) + excess(n / d, top, 0.001) for d, n in ((left_d, left_l), (right_d, right_l))]
            score = base + np.where(base <= 0, 1.0, 0.0) - balance - short - 25.0 * (over[0] + over[1])
            hard = (self.duration(a, b) > most * 1.10) | (self.length(a, b) > self.chars[self.run[a]]) if weak else np.zeros(len(a), bool)
            score = np.where((base > 0) | hard[k], score, -np.inf)
            best = np.maximum.reduceat(score, first)
            hits = np.flatnonzero((score == best[k]) | np.isnan(score))
            cut = at[hits[np.diff(k[hits], prepend=-1) != 0]]
            found = best != -np.inf
            done.append(a[~found])
            a, b, cut = a[found], b[found], cut[found]
            a, b = np.concatenate([a, cut]), np.concatenate([cut, b])
        return np.sort(np.concatenate([*done, np.zeros(0, np.int64)])).astype(np.int64)

    def merge(self, opens: np.ndarray) -> np.ndarray:
        """Where pieces open after short ones are joined with the next, else with the one before, where the limits allow."""
        if not len(opens):
            return opens
        most, least = self.limits.max_duration, self.limits.min_duration
        a, b, run = opens, np.append(opens[1:], self.n), self.run[opens]
        short = self.duration(a, b) < least
        firsts = np.flatnonzero(np.diff(run, prepend=-1))
        ends = np.append(firsts[1:], len(a))
        kept = np.ones(len(a), bool)
        for i in np.flatnonzero(np.logical_or.reduceat(short, firsts) & (ends - firsts > 1)):
            lo, hi = int(firsts[i]), int(ends[i])
            s, e, is_short = self.start[a[lo:hi]].tolist(), self.end[b[lo:hi] - 1].tolist(), short[lo:hi].tolist()
            before, upto, chars = (self.sums[a[lo:hi]] + self.glue[a[lo:hi]]).tolist(), self.sums[b[lo:hi]].tolist(), int(self.chars[run[lo]])
            fits = lambda x, y: max(0.001, e[y] - s[x]) <= most and upto[y] - before[x] <= chars  # noqa: B023, E731
            k, last, size = 0, None, hi - lo
            while k < size:
                this = k
                k += 1
                if is_short[this]:
                    if k < size and fits(this, k):
                        kept[lo + k] = False
                        k += 1
                    elif last is not None and fits(last, this):
                        kept[lo + this] = False
                        continue
                last = this
        return opens[kept]

    def groups(self, mode: str, opens: np.ndarray | None = None) -> np.ndarray:
        """Where the groups of a mode open; ``opens`` are those of sentences, if known."""
        opens = self.sentences() if opens is None else opens
        return opens if mode == "none" else self.merge(self.split(opens, mode == "hard"))

    def numbers(self, opens: np.ndarray) -> np.ndarray:
        """The number of each token's group in its run, from 1."""
        marks = np.zeros(self.n, np.int64)
        marks[opens] = 1
        marks = np.cumsum(marks)
        return (marks - marks[self.opens][self.run] + 1).astype(np.int32)

    def cues(self, opens: np.ndarray) -> tuple[np.ndarray, ...]:
        """(number among the groups, run, id, start, end) of groups that have a length; ids from 1 in each run."""
        start, end = self.start[opens], self.end[np.append(opens[1:], self.n) - 1] if len(opens) else self.end[:0]
        kept = np.flatnonzero((end > start) | (np.isnan(end) & ~np.isnan(start)))
        run = self.run[opens][kept]
        firsts = np.flatnonzero(np.diff(run, prepend=-1))
        ids = np.arange(len(run)) - np.repeat(firsts, np.diff(np.append(firsts, len(run)))) + 1
        return kept, run, ids.astype(np.int32), start[kept], end[kept]

    def joined(self, texts: pa.Array, opens: np.ndarray) -> pa.Array:
        """The text of each group; ``texts`` are the tokens'."""
        spaced = self.spaced.copy()
        spaced[opens] = False
        pieces = pc.binary_join_element_wise(pc.if_else(pa.array(spaced), " ", ""), pc.utf8_trim(texts, T.SPACES), "")
        return pc.binary_join(pa.ListArray.from_arrays(pa.array(np.append(opens, self.n), pa.int32()), pieces), "")


def runs_of(texts: pa.Array, start: np.ndarray, end: np.ndarray, languages: pa.Array, opens: np.ndarray, limits: T.Limits) -> Runs:
    """The runs of an Arrow batch; ``languages`` has a name or null for each token."""
    coded = texts.dictionary_encode()
    return Runs(coded.dictionary.to_pylist(), coded.indices.to_numpy(), start, end, opens, first_named(languages, opens), limits)


def clean(texts: pa.Array, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Flags of tokens with text and no negative length."""
    return pc.fill_null(pc.not_equal(pc.utf8_trim(texts, T.SPACES), ""), False).to_numpy(zero_copy_only=False) & ((end >= start) | np.isnan(end))


def edges(table: pa.Table | pa.RecordBatch, keys: list[str]) -> np.ndarray:
    """Rows that open a run of equal keys."""
    codes = [(table[k].combine_chunks() if isinstance(table, pa.Table) else table[k]).dictionary_encode().indices.fill_null(-1).to_numpy() for k in keys]
    return np.flatnonzero(np.concatenate([[True], np.logical_or.reduce([c[1:] != c[:-1] for c in codes])])[: table.num_rows])


def whole_runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables of whole runs of sorted batches, a batch or so each."""
    rest: list[pa.Table] = []
    for batch in batches:
        part = pa.Table.from_batches([batch])
        if not part.num_rows:
            continue
        opens = edges(part, keys)
        if rest and all(rest[-1][k][-1].as_py() == part[k][0].as_py() for k in keys):
            opens = opens[1:]
        if not len(opens):
            rest.append(part)
            continue
        if rest or opens[-1]:
            yield pa.concat_tables([*rest, part.slice(0, int(opens[-1]))]).combine_chunks()
        rest = [part.slice(int(opens[-1]))]
    if rest:
        yield pa.concat_tables(rest).combine_chunks()
