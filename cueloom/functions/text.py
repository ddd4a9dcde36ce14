"""Text functions on columns: joining, normalising, measuring and scoring."""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, functions as F
from pyspark.sql.functions import arrow_udf

# Character sets, languages and words that results depend on.
TRAILING = ",.;:!?，。；：！？、)]}）】」』"
LEADING = "([{（【「『"
WIDE_STOPS = "，。；：！？、"
ATTACHABLE = ",.;:!?，。；：！？、)]}）】」』\"'”’"
MAJOR = ".!?。！？"
SOFT = ",;:，；：、"
CLOSERS = "\"'”’)]}）】」』"
LINE_STOPS = ",.;:!?，。；：！？、"
IDEOGRAPHS = "㐀-鿿぀-ヿ가-힯"
BREAK_BEFORE = "and as because but for if in nor of on or so that to when while with yet".split()
JA, ZH, EN = ("ja", "japanese", "日本"), ("zh", "chinese", "mandarin", "中文", "汉", "漢"), ("en", "english")
SPACE = r"(?U)[\s\x1c-\x1f]"
SPACES = "".join(c for c in map(chr, range(0x3001)) if c.isspace())


@dataclass(frozen=True)
class Limits:
    """Limits of readable cues; a language other than ja and zh counts as en."""

    min_duration: float = 0.833
    max_duration: float = 7.0
    max_lines: int = 2
    chars: tuple[tuple[str, int], ...] = (("ja", 13), ("zh", 16), ("en", 42))
    cps: tuple[tuple[str, float], ...] = (("ja", 4.0), ("zh", 9.0), ("en", 20.0))
    pause: float = 0.65

    def total_chars(self, language: Column) -> Column:
        lines, by = max(1, self.max_lines), dict(self.chars)
        return F.when(language == "ja", lines * by["ja"]).when(language == "zh", lines * by["zh"]).otherwise(lines * by["en"])

    def top_cps(self, language: Column) -> Column:
        by = dict(self.cps)
        return F.when(language == "ja", by["ja"]).when(language == "zh", by["zh"]).otherwise(by["en"])


def char_class(chars: str) -> str:
    """A regular expression for one of the characters."""
    return "[" + "".join("\\" + c if c.isascii() else c for c in chars) + "]"


def strip(text: Column) -> Column:
    """Without white space at either end."""
    return F.btrim(text, F.lit(SPACES))


def squeeze(text: Column) -> Column:
    """Words joined by single spaces."""
    return strip(F.regexp_replace(text, rf"(?:{SPACE})+", " "))


def without_spaces(text: Column, delimiter: bool = False) -> Column:
    """All white space removed, and the pipe delimiter if ``delimiter``."""
    return F.regexp_replace(text, r"(?U)[\s\x1c-\x1f|]" if delimiter else SPACE, "")


def content_only(text: Column) -> Column:
    """ASCII letters and digits, ideographs, kana and hangul, lower-cased."""
    return F.lower(F.regexp_replace(text, f"[^0-9A-Za-z{IDEOGRAPHS}]", ""))


def nfkc(text: Column) -> Column:
    """Compatibility composition. Spark has no normal forms, and Arrow's kernel does not compose: a batch goes to Python's in one call.

    ASCII texts are normal already and are left as they are.
    """

    @arrow_udf("string")
    def normal(column: pa.Array) -> pa.Array:
        odd = pc.fill_null(pc.invert(pc.string_is_ascii(column)), False)
        texts = column.filter(odd).to_pylist()
        if not texts:
            return column
        made = unicodedata.normalize("NFKC", "\0".join(texts)).split("\0")  # nothing composes with U+0000
        if len(made) != len(texts):
            made = [unicodedata.normalize("NFKC", x) for x in texts]
        return pc.replace_with_mask(column, odd, pa.array(made, column.type))

    return normal(text)


KATAKANA = "".join(map(chr, range(0x30A1, 0x30F7)))


def for_alignment(text: Column, language: Column | None = None) -> Column:
    """NFKC, lower case, letters and digits only; katakana as hiragana where the language is Japanese."""
    plain = F.regexp_replace(F.lower(nfkc(text)), r"[^\p{L}\p{N}]", "")
    if language is None:
        return plain
    hiragana = "".join(chr(ord(c) - 0x60) for c in KATAKANA)
    return F.when(F.lower(F.coalesce(language, F.lit(""))).rlike("^j[ap]"), F.translate(plain, KATAKANA, hiragana)).otherwise(plain)


def _ideograph(char: Column) -> Column:
    return char.between("㐀", "鿿") | char.between("぀", "ヿ") | char.between("가", "힯")


def _digit(char: Column) -> Column:
    return F.when(char < "\x80", F.contains(F.lit("0123456789"), char)).otherwise(char.rlike(r"^[\p{Nd}²³¹⁰⁴-⁹₀-₉]$"))


def needs_space(left: Column, right: Column) -> Column:
    """Whether a space stands between two neighbouring characters of joined parts. Each is one character."""
    tight = F.contains(F.lit(LEADING + WIDE_STOPS + "'"), left) | F.contains(F.lit(TRAILING + "'"), right) | _ideograph(left) | _ideograph(right)
    return ~(tight | (_digit(left) & _digit(right)))


def _wide(char: str) -> bool:
    return "㐀" <= char <= "鿿" or "぀" <= char <= "ヿ" or "가" <= char <= "힯"


def _figure(char: str) -> bool:
    return char in "0123456789" if char < "\x80" else unicodedata.category(char) == "Nd" or char in "²³¹⁰⁴⁵⁶⁷⁸⁹₀₁₂₃₄₅₆₇₈₉"


@lru_cache(50_000)
def joins(word: str) -> tuple[bool, bool, bool, bool]:
    """needs_space for whole words: whether none stands behind it, none before it, and whether it ends and begins with a digit."""
    head, tail = word[0], word[-1]
    return tail in LEADING + WIDE_STOPS + "'" or _wide(tail), head in TRAILING + "'" or _wide(head), _figure(tail), _figure(head)


def join_parts(parts: Column) -> Column:
    """One text of an array of parts: stripped, empty ones skipped, spaces where needs_space says so. All parts of a batch at once."""

    @arrow_udf("string")
    def joined(lists: pa.Array) -> pa.Array:
        row = np.repeat(np.arange(len(lists)), pc.fill_null(pc.list_value_length(lists), 0).to_numpy())
        words = pc.utf8_trim(lists.flatten(), SPACES)
        kept = np.flatnonzero(pc.fill_null(pc.not_equal(words, ""), False).to_numpy(zero_copy_only=False))
        row, words = row[kept], words.take(pa.array(kept))
        coded = words.dictionary_encode()
        behind, before, ends, begins = np.array(list(map(joins, coded.dictionary.to_pylist())), bool).reshape(-1, 4).T[:, coded.indices.to_numpy()]
        spaced = np.zeros(len(words), bool)
        spaced[1:] = ~(behind[:-1] | before[1:] | (ends[:-1] & begins[1:])) & (row[1:] == row[:-1])
        pieces = pc.binary_join_element_wise(pc.if_else(pa.array(spaced), " ", ""), words, "")
        texts = pc.binary_join(pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(len(lists) + 1)), pa.int32()), pieces), "")
        return pc.if_else(lists.is_valid(), texts, pa.scalar(None, pa.string()))

    return joined(parts)


def append_missing(text: Column, trailing: Column) -> Column:
    """``text`` with what of ``trailing`` it does not end with yet: leading characters that it has already are skipped."""
    rest = F.aggregate(
        F.filter(F.split(trailing, ""), lambda c: c != ""),
        F.struct(F.lit(True).alias("skipping"), F.lit("").alias("left")),
        lambda acc, c: F.struct(
            (acc["skipping"] & F.endswith(F.rtrim(text), c)).alias("skipping"),
            F.when(acc["skipping"] & F.endswith(F.rtrim(text), c), acc["left"]).otherwise(F.concat(acc["left"], c)).alias("left"),
        ),
    )["left"]
    return F.when((rest != "") & ~F.endswith(F.rtrim(text), rest), F.concat(text, rest)).otherwise(text)


def language_of(named: Column, text: Column) -> Column:
    """ja, zh or en: by the name's start, else kana, else Han characters, else en."""
    name = F.lower(strip(F.coalesce(named, F.lit(""))))
    starts = lambda words: name.rlike("^(" + "|".join(words) + ")")
    return (
        F.when(starts(JA), "ja").when(starts(ZH), "zh").when(starts(EN), "en").when(text.rlike("[぀-ヿ]"), "ja").when(text.rlike("[㐀-鿿]"), "zh").otherwise("en")
    )


def measure(text: Column, language: Column) -> Column:
    """Characters that are no white space in ja and zh, else characters with white space collapsed."""
    return F.when(language.isin("ja", "zh"), F.length(without_spaces(text))).otherwise(F.length(squeeze(text)))


def _ends_with(text: Column, marks: str) -> Column:
    return F.regexp_replace(strip(text), f"{char_class(CLOSERS)}+$", "").rlike(f"{char_class(marks)}$")


def major_boundary(text: Column) -> Column:
    return _ends_with(text, MAJOR)


def soft_boundary(text: Column) -> Column:
    return _ends_with(text, SOFT)


def break_before(text: Column) -> Column:
    return F.regexp_extract(F.lower(strip(text)), "^[a-z']+", 0).isin(BREAK_BEFORE)


def boundary_score(left: Column, right: Column, left_end: Column, right_start: Column, language: Column, limits: Limits = Limits()) -> Column:
    """How good a cut between two tokens is; the best of the rules that hold, 0 if none does."""
    pause = F.greatest(F.lit(0.0), right_start - left_end)
    return F.greatest(
        F.when(major_boundary(left), 100.0).when(soft_boundary(left), 80.0).otherwise(0.0),
        F.when(pause >= limits.pause, 70.0 + F.least(pause, F.lit(1.5)) * 5.0).otherwise(0.0),
        F.when((language == "en") & break_before(right), 45.0).otherwise(0.0),
    )


def short_penalty(duration: Column, limits: Limits = Limits()) -> Column:
    """35 times the relative shortfall under the least duration."""
    least = limits.min_duration
    return F.when(duration < least, (F.lit(least) - duration) / F.lit(max(least, 0.001)) * 35.0).otherwise(0.0)


def overflow(duration: Column, length: Column, cps: Column, language: Column, limits: Limits = Limits()) -> Column:
    """Relative excess of duration, length and reading speed, summed."""
    chars, top = limits.total_chars(language), limits.top_cps(language)
    return (
        F.when(duration > limits.max_duration, duration / F.lit(max(limits.max_duration, 0.001)) - 1.0).otherwise(0.0)
        + F.when(length > chars, length / F.greatest(chars, F.lit(1)) - 1.0).otherwise(0.0)
        + F.when(cps > top, cps / F.greatest(top, F.lit(0.001)) - 1.0).otherwise(0.0)
    )


def overlong(duration: Column, length: Column, language: Column, limits: Limits = Limits(), slack: float = 1.0) -> Column:
    """Over a limit; ``slack`` 1.1 gives the hard variant, which stretches the duration alone."""
    return (duration > limits.max_duration * slack) | (length > limits.total_chars(language))


def text_by_mode(mode: str, text: Column, proofread: Column, translation: Column) -> Column:
    """What a cue shows in a mode; an empty string counts as missing."""
    base = F.coalesce(F.nullif(proofread, F.lit("")), text)
    other = F.coalesce(translation, F.lit(""))
    modes = {"original": text, "proofread": base, "translation": other, "bilingual": F.when(other == "", base).otherwise(F.concat(base, F.lit("\n"), other))}
    if mode not in modes:
        raise ValueError(f"unknown mode: {mode}")
    return modes[mode]


def without_line_stops(text: Column) -> Column:
    """Each line without the punctuation at its end."""
    lines = F.split(F.regexp_replace(text, r"\r\n|[\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]", "\n"), "\n", -1)
    trimmed = F.array_join(F.transform(lines, lambda x: F.regexp_replace(x, f"{char_class(LINE_STOPS)}+$", "")), "\n")
    return F.regexp_replace(trimmed, "\n$", "")


def without_fence(reply: Column) -> Column:
    """A model's reply without the code fence around it."""
    plain = strip(reply)
    opened = F.regexp_replace(plain, "^```[^\n]*(\n|$)", "")
    return F.when(plain.startswith("```"), strip(F.regexp_replace(opened, "(^|\n)```[^\n]*$", ""))).otherwise(plain)


def json_part(reply: Column) -> Column:
    """JSON text of a reply: the reply itself, else from its first to its last bracket, else null."""
    plain = without_fence(reply)
    span = F.regexp_extract(plain, r"(?s)[\[{].*[\]}]", 0)
    return F.when(F.try_parse_json(plain).isNotNull(), plain).when(F.try_parse_json(span).isNotNull(), span)


def sentences(text: Column) -> Column:
    """Array of the sentences of a text: cut behind terminal marks and the closers that follow, before white space or a wide character."""
    after = f"{char_class(MAJOR)}+{char_class(CLOSERS)}*"
    wide = f"[。！？]{char_class(CLOSERS)}*"
    marked = F.regexp_replace(F.regexp_replace(text, f"({after})(?={SPACE})", "$1\u0000"), f"({wide})(?=[^\u0000\\s。！？{''.join(chr(92) + c for c in CLOSERS)}])", "$1\u0000")
    return F.filter(F.transform(F.split(marked, "\u0000", -1), strip), lambda x: x != "")


def prompt(text: Column, context: Column, must_split: Column) -> Column:
    """Instructions for a model that puts delimiters into a text."""
    return F.concat_ws(
        "\n",
        F.lit("Put the character | wherever a new subtitle should begin. Change nothing else."),
        F.when(must_split, F.lit("The text is too long for one subtitle: use the delimiter at least once.")),
        F.when(F.coalesce(context, F.lit("")) != "", F.concat(F.lit("Context: "), context)),
        F.concat(F.lit("Text: "), text),
    )


def media_id(path: Column, mtime: Column, size: Column) -> Column:
    """Sixteen hexadecimal digits that name a file by path, time and size."""
    return F.substring(F.sha1(F.concat_ws("|", path, mtime.cast("string"), size.cast("string"))), 1, 16)
