"""A sentence splitter that learns abbreviations and sentence starters from the corpus.

One pass over all texts counts, per word type, how often it stands with and
without a full stop, and which words with one it follows. Two likelihood ratios
tell from these counts

* abbreviations: words that the full stop belongs to far more often than to words
  at large; short ones, and those with full stops inside, score higher;
* starters: words that follow full stops of words that are no abbreviations far more often than chance.

The default splitter's cut behind an abbreviation is undone, unless a starter
follows. A cut before a lower-case letter is undone behind any full stop. The
model is the MOST best abbreviations and as many starters, whatever the corpus's
size; counting covers every row.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text as T
from ..shared import shared_table

MOST = 2000
#: Scores from which a word counts as an abbreviation or a starter, and the rate of full stops behind one.
ABBREVIATION, STARTER, RATE = 0.3, 30.0, 0.99
#: Rows with a word that are needed to say anything of it.
LEAST = 3
WORD = r"[\p{L}\p{N}]+(?:\.[\p{L}\p{N}]+)*"


def _log_likelihood(k: Column, n: Column, p: Column) -> Column:
    """Of ``k`` hits in ``n`` with probability ``p``."""
    safe = F.least(F.greatest(p, F.lit(1e-12)), F.lit(1 - 1e-12))
    return k * F.log(safe) + (n - k) * F.log(1 - safe)


@dataclass(frozen=True)
class Model:
    abbreviations: tuple[str, ...] = ()
    starters: tuple[str, ...] = ()


def word_pairs(texts: DataFrame, text: str = "text") -> DataFrame:
    """word, before (the word in front of it if a full stop stands between them, else null), n, stops (times with a full stop behind it).

    Words are lower-cased, of all rows; null texts have none.
    """
    stop = lambda w: F.endswith(w, F.lit("."))
    bare = lambda w: F.lower(F.regexp_replace(w, r"\.$", ""))

    def pairs(said: Column) -> Column:
        def pair(w: Column, k: Column) -> Column:
            before = F.get(said, k - 1)
            return F.struct(bare(w).alias("word"), F.when(stop(before), bare(before)).alias("before"), stop(w).alias("stop"))

        return F.transform(said, pair)

    # The list is bound to a lambda's variable, or it would be made again for each of its elements.
    found = F.get(F.transform(F.array(F.regexp_extract_all(text, F.lit(rf"{WORD}\.?"), F.lit(0))), pairs), 0)
    return texts.select(F.inline(found)).groupBy("word", "before").agg(F.count("*").alias("n"), F.count_if("stop").alias("stops"))


def counted(pairs: DataFrame, abbreviations: tuple[str, ...] = ()) -> DataFrame:
    """word, n, stops, after (times behind a full stop of a word that is no abbreviation)."""
    ended = F.col("before").isNotNull() & ~F.col("before").isin(*abbreviations) if abbreviations else F.col("before").isNotNull()
    return pairs.groupBy("word").agg(F.sum("n").alias("n"), F.sum("stops").alias("stops"), F.sum(F.when(ended, F.col("n")).otherwise(0)).alias("after"))


def learned(texts: DataFrame, text: str = "text", most: int = MOST) -> Model:
    """The model of all rows of ``texts``; null texts say nothing."""
    pairs = shared_table(word_pairs(texts, text))
    words, stops = pairs.agg(F.sum("n"), F.sum("stops")).first()
    base = F.lit((stops or 0) / (words or 1))
    letters = F.length(F.regexp_replace("word", r"\.", "")).cast("double")
    inner = F.length(F.regexp_replace("word", r"[^.]", ""))
    ratio = 2 * (_log_likelihood(F.col("stops"), F.col("n"), F.lit(RATE)) - _log_likelihood(F.col("stops"), F.col("n"), base))
    # Each time without a full stop costs as much as the word is long.
    shorts = ratio * F.exp(-letters) * (inner + 1) * F.pow(letters, -(F.col("n") - F.col("stops")).cast("double"))
    found = _best(counted(pairs).where("stops > 0"), shorts, ABBREVIATION, most)

    counts = counted(pairs, found)
    base = F.lit((counts.agg(F.sum("after")).first()[0] or 0) / (words or 1))
    share = F.col("after") / F.col("n")
    openers = 2 * (_log_likelihood(F.col("after"), F.col("n"), share) - _log_likelihood(F.col("after"), F.col("n"), base))
    return Model(found, _best(counts.where(share > base), openers, STARTER, most))


def _best(counts: DataFrame, score: Column, least: float, most: int) -> tuple[str, ...]:
    """The words of the ``most`` highest scores from ``least`` on, by score and then in order."""
    rows = counts.where((F.col("n") >= LEAST) & F.col("word").rlike(r"\p{L}")).select("word", score.alias("score")).where(F.col("score") >= least)
    return tuple(r[0] for r in rows.orderBy(F.desc("score"), "word").limit(most).collect())


def splitter(model: Model) -> Callable[[Column], Column]:
    """A splitter for ``segment.split_groups`` and the plans: the default's sentences, with the model's cuts undone."""
    listed = lambda words: F.array(*map(F.lit, words)).cast("array<string>")
    shorts, starters = listed(model.abbreviations), listed(model.starters)

    def split(text: Column) -> Column:
        def joined(parts: Column) -> Column:
            def separated(part: Column, k: Column) -> Column:
                before = F.get(parts, k - 1)
                stop = before.rlike(r"[^.]\.$")
                short = F.array_contains(shorts, F.lower(F.regexp_extract(before, rf"({WORD})\.$", 1)))
                first = F.regexp_extract(part, rf"^\P{{L}}*?({WORD})", 1)
                on = stop & (part.rlike(r"^\p{Ll}") | (short & ~F.array_contains(starters, F.lower(first))))
                return F.when(k == 0, part).otherwise(F.concat(F.when(on, " ").otherwise("\u0000"), part))

            return F.array_join(F.transform(parts, separated), "")

        # The list is bound to a lambda's variable, or it would be made again for each of its elements.
        whole = F.get(F.transform(F.array(T.sentences(text)), joined), 0)
        return F.filter(F.split(whole, "\u0000", -1), lambda s: s != "")

    return split
