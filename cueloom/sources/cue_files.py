"""SRT, VTT and LRC as formats: ``spark.read.format("srt")`` and ``df.write.format("srt")`` after ``register(spark)``.

A folder's files are dealt to tasks by their sizes. A file is one media, named by
its name without the suffix; conditions on media_id (=, in, starts with) choose
files before any is opened. Read rows are

* srt, vtt: media_id, id, start, end, text of each cue with text;
* lrc: media_id, at (place in the file), tag, start, text: a tag line as it is, or a line without its
  timestamps and the first of these in seconds, null if it has none.

With the option ``mode`` at ``permissive`` a file that does not read is one row
with the reason in a further column ``error``; otherwise it fails the query.

Written are such rows, all of a media in one task and in order; ``write_cues``
deals and sorts cues that way. Each file is written whole to a folder of its own
attempt and gets its name when all tasks are done, so that a task which fails or
runs again leaves no part of a file. Options: ``suffix`` is what stands before
the format's own in names (``.original`` gives ``m.original.srt``).

Paths are local or URIs of file systems that Arrow knows (file, hdfs, s3, gs).
Files that begin with a dot or an underscore are not read.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, StringStartsWith, WriterCommitMessage

from ..functions import text as T

# What the formats' lines look like.
CLOCK = re.compile(r"(\d{2}):(\d{2}):(\d{2})[,.](\d{3})", re.ASCII)
SRT_TIMING = re.compile(r"\d\d:\d\d:\d\d[,.]\d\d\d\s+-->\s+\d\d:\d\d:\d\d[,.]\d\d\d", re.ASCII)
VTT_TIMING = re.compile(r"((?:\d{2,}:)?\d\d:\d\d\.\d{3})[ \t]+-->[ \t]+((?:\d{2,}:)?\d\d:\d\d\.\d{3})(?:[ \t]|$)", re.ASCII)
LRC_TAG = re.compile(r"\[[A-Za-z]+:.*\]")
LRC_TIME = re.compile(r"\[(\d{1,3}):(\d{1,2}(?:[.:]\d{1,3})?)\]", re.ASCII)
WORD_TIME = re.compile(r"<\d{1,3}:\d{1,2}(?:[.:]\d{1,3})?>", re.ASCII)

CUES = "media_id string, id int, start double, end double, text string"
LINES = "media_id string, at int, tag boolean, start double, text string"
#: Bytes of a task, and what opening a file counts; rows of a batch that a task gives; renames side by side.
TASK_BYTES, OPEN_BYTES, ROWS, RENAMES = 32 << 20, 1 << 18, 5000, 16


def normal_text(data: bytes) -> str:
    return re.sub(r"\r\n?", "\n", data.decode("utf-8", "replace").removeprefix("\ufeff"))


def _blocks(content: str) -> Iterator[tuple[int, list[str]]]:
    body = content.strip("\n")
    return ((k, block.split("\n")) for k, block in enumerate(re.split(r"\n{2,}", body), 1))


def _srt_seconds(text: str) -> float:
    found = CLOCK.match(text.strip(T.SPACES))
    if not found:
        raise ValueError("timing line does not read")
    h, m, s, ms = map(float, found.groups())
    return h * 3600.0 + m * 60.0 + s + ms / 1000.0


def srt_cues(content: str) -> list[tuple]:
    """(id, start, end, text) of a file's cues with text. The id is an integer first line, else the block's number; a double one is an error."""
    seen, out = set(), []
    for number, lines in _blocks(content):
        at = next((k for k, line in enumerate(lines) if SRT_TIMING.search(line)), None)
        if at is None:
            continue
        first = lines[0].strip(T.SPACES)
        own = int(first) if at and first.isdecimal() else number
        times = lines[at].split("-->")
        if len(times) != 2:
            raise ValueError("timing line does not read")
        start, end = map(_srt_seconds, times)
        if own in seen:
            raise ValueError(f"duplicate cue id: {own}")
        seen.add(own)
        text = "\n".join(lines[at + 1 :]).strip(T.SPACES)
        out += [(own, start, end, text)] * bool(text)
    return out


def vtt_cues(content: str) -> list[tuple]:
    """(id, start, end, text) of a file's cues with text, by number; notes, styles and regions are skipped."""
    if not re.match(r"WEBVTT(?:[ \t\n]|$)", content):
        raise ValueError("not a WEBVTT file")
    out, number = [], 0
    for _, lines in _blocks(content):
        at = next((k for k, line in enumerate(lines[:2]) if VTT_TIMING.match(line)), None)
        if at is None:
            continue
        number += 1
        start, end = (sum(float(x) * 60.0**k for k, x in enumerate(reversed(t.split(":")))) for t in VTT_TIMING.match(lines[at]).groups())
        text = "\n".join(lines[at + 1 :]).strip(T.SPACES)
        out += [(number, start, end, text)] * bool(text)
    return out


def lrc_lines(content: str) -> list[tuple]:
    """(at, tag, start, text) of a file's lines that are not blank."""
    out = []
    for at, line in enumerate(x.strip(T.SPACES) for x in content.split("\n")):
        if LRC_TAG.fullmatch(line):
            out.append((at, True, None, line))
            continue
        time = LRC_TIME.search(line)
        text = WORD_TIME.sub("", LRC_TIME.sub("", line)).strip(T.SPACES)
        out += [(at, False, float(time[1]) * 60.0 + float(time[2].replace(":", ".")) if time else None, text)] * bool(text)
    return out


def file_system(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if re.match(r"[a-z][a-z0-9+.-]*:/", path) else (fs.LocalFileSystem(), path)


@dataclass
class Files(InputPartition):
    """(media_id, path) of a task's files."""

    files: list[tuple[str, str]]


class CueReader(DataSourceReader):
    def __init__(self, path: str, suffix: str, parse: Callable[[str], list[tuple]], schema: pa.Schema, permissive: bool):
        self.path, self.suffix, self.parse, self.schema, self.permissive = path, suffix, parse, schema, permissive
        self.chosen: list[Callable[[str], bool]] = []

    def pushFilters(self, filters: list[Filter]):
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("media_id",):
                self.chosen.append(f.value.__eq__)
            elif isinstance(f, In) and f.attribute == ("media_id",):
                self.chosen.append(set(f.value).__contains__)
            elif isinstance(f, StringStartsWith) and f.attribute == ("media_id",):
                self.chosen.append(lambda name, start=f.value: name.startswith(start))
            else:
                yield f

    def listed(self) -> list[tuple[int, str, str]]:
        """(size, media_id, path) of the files to read."""
        system, base = file_system(self.path)
        info = system.get_file_info(base)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        found = [info] if info.is_file else system.get_file_info(fs.FileSelector(base, recursive=False))
        named = ((f.size, f.base_name[: -len(self.suffix)], f.path) for f in found if f.is_file and f.base_name.lower().endswith(self.suffix) and f.base_name[0] not in "._")
        return [x for x in named if all(f(x[1]) for f in self.chosen)]

    def partitions(self) -> list[Files]:
        tasks, used = [Files([])], 0
        for size, media_id, path in sorted(self.listed(), reverse=True):
            if tasks[-1].files and used + size > TASK_BYTES:
                tasks.append(Files([]))
                used = 0
            tasks[-1].files.append((media_id, path))
            used += size + OPEN_BYTES
        return tasks

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        system, _ = file_system(self.path)
        width, rows = len(self.schema) - 1 - self.permissive, []
        for media_id, path in partition.files:
            try:
                with system.open_input_stream(path) as f:
                    found = self.parse(normal_text(f.read()))
                rows += [(media_id, *x, *[None] * self.permissive) for x in found]
            except ValueError as e:
                if not self.permissive:
                    raise ValueError(f"{path}: {e}") from e
                rows.append((media_id, *[None] * width, str(e)))
            while len(rows) >= ROWS:
                yield self._batch(rows[:ROWS])
                del rows[:ROWS]
        if rows:
            yield self._batch(rows)

    def _batch(self, rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), self.schema)], schema=self.schema)


def _clock(seconds: float, mark: str) -> str:
    ms = max(0, round(seconds * 1000))
    return f"{ms // 3600000:02d}:{ms // 60000 % 60:02d}:{ms // 1000 % 60:02d}{mark}{ms % 1000:03d}"


def _srt_text(number: int, row: dict) -> str:
    return f"{number}\n{_clock(row['start'], ',')} --> {_clock(row['end'], ',')}\n{row['text']}\n"


def _vtt_text(number: int, row: dict) -> str:
    return f"{_clock(row['start'], '.')} --> {_clock(row['end'], '.')}\n{row['text']}\n"


def _lrc_text(number: int, row: dict) -> str:
    cs = max(0, round((row["start"] or 0.0) * 100))
    time = "" if row["tag"] or row["start"] is None else f"[{cs // 6000:02d}:{cs // 100 % 60:02d}.{cs % 100:02d}]"
    return f"{time}{row['text']}\n"


@dataclass
class Written(WriterCommitMessage):
    """(path in the attempt's folder, name) of the files that a task has written."""

    files: list[tuple[str, str]] = field(default_factory=list)


class CueWriter(DataSourceArrowWriter):
    def __init__(self, path: str, suffix: str, overwrite: bool, head: str, between: str, order: str, show: Callable[[int, dict], str], skips: bool):
        self.path, self.suffix, self.overwrite = path, suffix, overwrite
        self.head, self.between, self.order, self.show, self.skips = head, between, order, show, skips
        self.staging = f"_staging-{uuid.uuid4().hex}"

    def _at(self, *parts: str) -> tuple[fs.FileSystem, str]:
        system, base = file_system(self.path)
        return system, "/".join([base.rstrip("/"), *parts])

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        """Numbers count all rows of a media; cues without text are left out of the file but keep their number."""
        system, folder = self._at(self.staging, uuid.uuid4().hex)
        done, now, out, number, shown, last = Written(), None, None, 0, 0, None
        closed: set[str] = set()
        try:
            for row in (r for batch in iterator for r in batch.to_pylist()):
                if out is None or row["media_id"] != now:
                    if out is not None:
                        out.close()
                        closed.add(now)
                    now, number, shown, last = row["media_id"], 0, 0, None
                    if not now or "/" in now or now in closed:
                        raise ValueError(f"rows of a media stand apart; write_cues sorts them: {now}" if now in closed else f"no file can have the name of media_id {now!r}")
                    if not done.files:
                        system.create_dir(folder, recursive=True)
                    done.files.append((f"{folder}/{len(done.files)}", f"{now}{self.suffix}"))
                    out = system.open_output_stream(done.files[-1][0])
                    out.write(self.head.encode())
                if last is not None and row[self.order] < last:
                    raise ValueError(f"rows of {now} are not in order; write_cues sorts them")
                last, number = row[self.order], number + 1
                if row["text"] or not self.skips:
                    out.write(((self.between if shown else "") + self.show(number, row)).encode())
                    shown += 1
        except BaseException:
            if out is not None:
                out.close()
            if done.files:
                system.delete_dir(folder)
            raise
        if out is not None:
            out.close()
        return done

    def commit(self, messages: list) -> None:
        system, base = self._at()
        files = [x for m in messages if m for x in m.files]
        names = [name for _, name in files]
        if len(set(names)) < len(names):
            self.abort(messages)
            raise ValueError("rows of a media were in several tasks; write_cues keeps them together")
        system.create_dir(base, recursive=True)
        with ThreadPoolExecutor(RENAMES) as pool:
            list(pool.map(lambda x: system.move(x[0], f"{base}/{x[1]}"), files))
            if self.overwrite:
                old = [f.path for f in system.get_file_info(fs.FileSelector(base, recursive=False)) if f.is_file and f.base_name.endswith(self.suffix) and f.base_name not in set(names)]
                list(pool.map(system.delete_file, old))
        self._clean()

    def abort(self, messages: list) -> None:
        self._clean()

    def _clean(self) -> None:
        system, staging = self._at(self.staging)
        if system.get_file_info(staging).type != fs.FileType.NotFound:
            system.delete_dir(staging)


class CueFiles(DataSource):
    """What the formats share; the subclasses say how a file looks."""

    kind, columns, order = "", CUES, "id"
    parse: Callable[[str], list[tuple]]
    #: Text before the rows and between them, and whether rows without text are left out.
    head, between, skips = "", "", True
    show: Callable[[int, dict], str]

    @classmethod
    def name(cls) -> str:
        return cls.kind

    def _permissive(self) -> bool:
        mode = self.options.get("mode", "failfast").lower()
        if mode not in ("failfast", "permissive"):
            raise ValueError(f"unknown mode: {mode}")
        return mode == "permissive"

    def schema(self) -> str:
        return self.columns + ", error string" * self._permissive()

    def reader(self, schema) -> CueReader:
        kinds = {"string": pa.string(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_()}
        arrow = pa.schema([(f.name, kinds[f.dataType.simpleString()]) for f in schema])
        return CueReader(self.options["path"], f".{self.kind}", type(self).parse, arrow, self._permissive())

    def writer(self, schema, overwrite: bool) -> CueWriter:
        wanted = {c.split()[0] for c in self.columns.split(", ")}
        if lost := wanted - set(schema.names):
            raise ValueError(f"{self.kind} needs the columns {sorted(lost)}")
        return CueWriter(self.options["path"], f"{self.options.get('suffix', '')}.{self.kind}", overwrite, self.head, self.between, self.order, type(self).show, self.skips)


class Srt(CueFiles):
    kind, between, parse, show = "srt", "\n", staticmethod(srt_cues), staticmethod(_srt_text)


class Vtt(CueFiles):
    kind, head, between, parse, show = "vtt", "WEBVTT\n\n", "\n", staticmethod(vtt_cues), staticmethod(_vtt_text)


class Lrc(CueFiles):
    kind, columns, order, skips, parse, show = "lrc", LINES, "at", False, staticmethod(lrc_lines), staticmethod(_lrc_text)


def register(spark: SparkSession) -> None:
    """Make the formats known to a session, and let it pass conditions on to them."""
    for kind in (Srt, Vtt, Lrc):
        spark.dataSource.register(kind)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def read_cues(spark: SparkSession, path: str, kind: str = "srt", mode: str = "failfast") -> DataFrame:
    register(spark)
    return spark.read.format(kind).option("mode", mode).load(path)


def write_cues(cues: DataFrame, path: str, kind: str = "srt", show: str = "original", strip_stops: bool = False, suffix: str = "", save: str = "append") -> None:
    """A file a media of cues (media_id, id, start, end, text, and what ``show`` needs), in parallel. ``save`` overwrite removes other files of the kind."""
    register(cues.sparkSession)
    none = F.lit(None).cast("string")
    of = [F.col(c) if c in cues.columns else none for c in ("text", "proofread", "translation")]
    text = T.text_by_mode(show, *of)
    rows = cues.select("media_id", F.col("id").cast("int").alias("id"), F.col("start").cast("double").alias("start"), F.col("end").cast("double").alias("end"), (T.without_line_stops(text) if strip_stops else text).alias("text"))
    if kind == "lrc":
        rows = rows.select("media_id", F.col("id").alias("at"), F.lit(False).alias("tag"), "start", "text")
    write_rows(rows, path, kind, suffix, save)


def write_rows(rows: DataFrame, path: str, kind: str, suffix: str = "", save: str = "append") -> None:
    """A file a media of rows as the format reads them."""
    register(rows.sparkSession)
    order = "at" if kind == "lrc" else "id"
    rows.repartition("media_id").sortWithinPartitions("media_id", order).write.format(kind).option("suffix", suffix).mode(save).save(path)
