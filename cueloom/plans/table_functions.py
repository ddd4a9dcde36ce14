"""Table functions for SQL: a partition of rows in, cues or windows out.

    select * from readable_cues(table(tokens) partition by (media_id, window_index) order by (pos), 'hard')
    select * from packed_windows(table(parts) partition by media_id order by start)

``register`` makes them known to a session. Columns of the table that a function
does not read are its partition's keys and come back with each row; null in all
other columns that it reads leaves a row out. A partition's rows go to one call
and are held there, as they are in the DataFrame operators of the same kind.
"""

from __future__ import annotations

from collections.abc import Iterator
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import AnalyzeArgument, AnalyzeResult, udtf
from pyspark.sql.types import DoubleType, IntegerType, StringType, StructField, StructType

from ..functions import text as T
from ..operators.search import Runs, named
from ..operators.windows import SpeechPlan, packed

LIMITS = T.Limits()
MODES = ("none", "soft", "hard")


def _schema(table: AnalyzeArgument, reads: set[str], optional: set[str], *out: StructField) -> StructType:
    if not table.isTable:
        raise ValueError("the first argument must be a table")
    names = set(table.dataType.names)
    if lost := reads - names:
        raise ValueError(f"the table needs the columns {sorted(lost)}")
    return StructType([*(f for f in table.dataType.fields if f.name not in reads | optional), *out])


class ReadableCues:
    """Tokens (pos, text, start, end, and language if there is one) to cues (id, start, end, text): modes none, soft and hard.

    A row is a token, or has lists of them: a call a row is most of the cost, so a table of a row a window is far quicker.
    """

    READS, MAY_READ = {"pos", "text", "start", "end"}, {"language"}

    @staticmethod
    def analyze(tokens: AnalyzeArgument, mode: AnalyzeArgument | None = None) -> AnalyzeResult:
        if mode is not None and mode.value not in MODES:
            raise ValueError(f"unknown mode: {mode.value}")
        out = StructField("id", IntegerType()), StructField("start", DoubleType()), StructField("end", DoubleType()), StructField("text", StringType())
        return AnalyzeResult(_schema(tokens, ReadableCues.READS, ReadableCues.MAY_READ, *out))

    def __init__(self):
        self.rows, self.keys, self.mode, self.columns = [], (), "hard", None

    def eval(self, tokens: Row, mode: str = "hard") -> None:
        if self.columns is None:
            names = list(tokens.__fields__)
            self.mode, self.keys = mode, tuple(v for k, v in zip(names, tokens) if k not in self.READS | self.MAY_READ)
            self.columns = itemgetter(*(names.index(k) for k in ("start", "end", "pos", "text")), names.index("language") if "language" in names else names.index("text"))
            self.named = "language" in names
        row = self.columns(tuple(tokens))
        for token in zip(*(c if isinstance(c, list) else [c] * len(row[3]) for c in row)) if isinstance(row[3], list) else [row]:
            if token[0] is not None and token[1] is not None and token[1] >= token[0] and token[3] and token[3].strip(T.SPACES):
                self.rows.append(token)

    def terminate(self) -> Iterator[tuple]:
        if not self.rows:
            return
        self.rows.sort(key=itemgetter(0, 1, 2))
        start, end, _, texts, languages = zip(*self.rows)
        language = named(next((x for x in languages if x is not None), None)) if self.named else -1
        runs = Runs(texts, np.arange(len(texts)), np.array(start, float), np.array(end, float), np.zeros(1, np.int64), np.array([language]), LIMITS)
        opens = runs.groups(self.mode)
        pieces = [f" {w}" if spaced else w for w, spaced in zip((t.strip(T.SPACES) for t in texts), runs.spaced.tolist())]
        bounds = [*opens.tolist(), len(pieces)]
        for group, _, *cue in zip(*(column.tolist() for column in runs.cues(opens))):
            yield (*self.keys, *cue, "".join(pieces[bounds[group] : bounds[group + 1]]).lstrip(" "))


class PackedWindows:
    """Parts of speech (start, end), apart from each other and none too long, to numbered windows (window_index, start, end)."""

    READS = {"start", "end"}

    @staticmethod
    def analyze(parts: AnalyzeArgument) -> AnalyzeResult:
        out = StructField("window_index", IntegerType()), StructField("start", DoubleType()), StructField("end", DoubleType())
        return AnalyzeResult(_schema(parts, PackedWindows.READS, set(), *out))

    def __init__(self):
        self.parts, self.keys = [], ()

    def eval(self, parts: Row) -> None:
        row = parts.asDict()
        self.keys = tuple(v for k, v in row.items() if k not in self.READS)
        if row["start"] is not None and row["end"] is not None:
            self.parts.append((row["start"], row["end"]))

    def terminate(self) -> Iterator[tuple]:
        found = [(a, b) for a, b in packed(sorted(self.parts), SpeechPlan()) if b > a]
        for k, (a, b) in enumerate(found, 1):
            yield (*self.keys, k, round(a, 3), round(b, 3))


def register(spark: SparkSession) -> None:
    spark.udtf.register("readable_cues", udtf(ReadableCues))
    spark.udtf.register("packed_windows", udtf(PackedWindows))
