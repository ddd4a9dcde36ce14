"""Rendering of cues: one file's text per media and mode, with SQL functions."""

from __future__ import annotations

from functools import reduce
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions import text as T
from ..functions.timecode import lrc_time, srt_time, vtt_time

FORMATS = ("srt", "vtt", "json")
MODES = ("original", "proofread", "translation", "bilingual")


def _shown(cues: DataFrame, mode: str, strip_stops: bool) -> DataFrame:
    text = T.text_by_mode(mode, F.col("text"), F.col("proofread"), F.col("translation"))
    number = F.row_number().over(Window.partitionBy("media_id").orderBy("id"))
    return cues.withColumn("shown", T.without_line_stops(text) if strip_stops else text).withColumn("number", number)


def _joined(rows: DataFrame, piece: Column, between: str, keep: Column | None = None) -> DataFrame:
    """One ordered text per media; ``keep`` drops pieces without dropping media."""
    kept = piece if keep is None else F.when(keep, piece)
    listed = rows.groupBy("media_id").agg(F.array_sort(F.collect_list(F.struct("number", kept.alias("piece")))).alias("pieces"))
    return listed.select("media_id", F.array_join(F.filter(F.transform("pieces", lambda x: x["piece"]), lambda p: p.isNotNull()), between).alias("body"))


def render_srt(cues: DataFrame, mode: str = "original", strip_stops: bool = False) -> DataFrame:
    """media_id, content. Numbers are places in the whole input, so cues without text leave gaps."""
    rows = _shown(cues, mode, strip_stops)
    block = F.concat_ws("\n", F.col("number").cast("string"), F.concat(srt_time(F.col("start")), F.lit(" --> "), srt_time(F.col("end"))), F.col("shown"))
    return _joined(rows, block, "\n\n", F.col("shown") != "").select("media_id", F.when(F.col("body") == "", "").otherwise(F.concat("body", F.lit("\n"))).alias("content"))


def render_vtt(cues: DataFrame, mode: str = "original", strip_stops: bool = False) -> DataFrame:
    rows = _shown(cues, mode, strip_stops)
    block = F.concat_ws("\n", F.concat(vtt_time(F.col("start")), F.lit(" --> "), vtt_time(F.col("end"))), F.col("shown"), F.lit(""))
    return _joined(rows, block, "\n", F.col("shown") != "").select("media_id", F.concat(F.lit("WEBVTT\n\n"), F.col("body")).alias("content"))


def render_lrc(cues: DataFrame, metadata: DataFrame | None = None, strip_stops: bool = False) -> DataFrame:
    """Metadata lines (media_id, at, line) first, then each cue's start and text."""
    rows = _shown(cues.withColumn("proofread", F.lit(None).cast("string")).withColumn("translation", F.lit(None).cast("string")), "original", strip_stops)
    body = _joined(rows, F.concat(lrc_time(F.col("start")), F.col("shown")), "\n")
    if metadata is not None:
        listed = metadata.groupBy("media_id").agg(F.array_sort(F.collect_list(F.struct("at", "line"))).alias("tags"))
        body = body.join(listed, "media_id", "left").select("media_id", F.concat_ws("\n", F.array_join(F.transform("tags", lambda t: t["line"]), "\n"), "body").alias("body"))
    return body.select("media_id", F.concat("body", F.lit("\n")).alias("content"))


def _json_value(value: Column) -> Column:
    """A value as JSON text; null for null."""
    return F.when(value.isNotNull(), F.regexp_extract(F.to_json(F.struct(value.alias("v"))), r"(?s)^\{\"v\":(.*)\}$", 1))


def render_json(cues: DataFrame, mode: str = "original", strip_stops: bool = False) -> DataFrame:
    """A JSON list per media, indented by two. original and bilingual give whole records without nulls; the others id, times and text.

    ``original`` keeps its punctuation whatever strip_stops says; bilingual strips all three texts.
    """
    trim = (lambda c: T.without_line_stops(F.col(c))) if strip_stops and mode == "bilingual" else F.col
    record = {"id": F.col("id"), "start": F.round("start", 3), "end": F.round("end", 3)}
    if mode in ("original", "bilingual"):
        record |= {c: trim(c) for c in ("text", "translation", "proofread")}
    else:
        shown = T.text_by_mode(mode, F.col("text"), F.col("proofread"), F.col("translation"))
        record["text"] = T.without_line_stops(shown) if strip_stops else shown
    fields = F.array_join(F.array(*[F.concat(F.lit(f'    "{name}": '), _json_value(value)) for name, value in record.items()]), ",\n")
    rows = cues.withColumn("number", F.row_number().over(Window.partitionBy("media_id").orderBy("id")))
    return _joined(rows, F.concat(F.lit("  {\n"), fields, F.lit("\n  }")), ",\n").select("media_id", F.concat(F.lit("[\n"), "body", F.lit("\n]\n")).alias("content"))


def rendered(cues: DataFrame, kind: str, mode: str = "original", strip_stops: bool = False) -> DataFrame:
    """Rendering by format name; an unknown one is an error."""
    kinds = {"srt": render_srt, "vtt": render_vtt, "json": render_json}
    kind = kind.lower().lstrip(".")
    if kind == "lrc":
        return render_lrc(cues, strip_stops=strip_stops)
    if kind not in kinds:
        raise ValueError(f"unknown format: {kind}")
    return kinds[kind](cues, mode, strip_stops)


def _modes(proofread: bool, translation: bool, bilingual: bool) -> list[str]:
    return ["original", *["proofread"] * proofread, *["translation"] * translation, *["bilingual"] * bilingual]


def _formats(formats: list[str]) -> list[str]:
    wanted = list(dict.fromkeys(f.lower().lstrip(".") for f in formats))
    if bad := [f for f in wanted if f not in FORMATS]:
        raise ValueError(f"unknown format: {bad[0]}")
    return wanted


def output_matrix(spark: SparkSession, media: DataFrame, formats: list[str], proofread: bool = False, translation: bool = False, bilingual: bool = False) -> DataFrame:
    """media_id, position, name of every file to write: formats in order without repeats, then the modes asked for."""
    pairs = [(f, m) for f in _formats(formats) for m in _modes(proofread, translation, bilingual)]
    files = F.array(*[F.struct(F.lit(i).alias("position"), F.lit(f"{m}.{f}").alias("suffix")) for i, (f, m) in enumerate(pairs)])
    return media.select("media_id", F.inline(files)).select("media_id", "position", F.concat("media_id", F.lit("."), F.col("suffix")).alias("name"))


def output_set(cues: DataFrame, formats: list[str], proofread: bool = False, translation: bool = False, bilingual: bool = False, strip_stops: bool = False) -> DataFrame:
    """name, content of every file of the output matrix, over all media at once."""
    made = [
        rendered(cues, f, m, strip_stops).select(F.concat("media_id", F.lit(f".{m}.{f}")).alias("name"), "content") for f in _formats(formats) for m in _modes(proofread, translation, bilingual)
    ]
    return reduce(DataFrame.unionByName, made)


def write_texts(rows: DataFrame, path: str, key: str = "media_id") -> None:
    """Write (key, content) as text files, one folder a key, in parallel; contents end with a line feed."""
    plain = rows.where("content <> ''").select(key, F.regexp_replace("content", r"\n\z", "").alias("content"))
    plain.write.mode("overwrite").partitionBy(key).text(path)


def write_file(content: str, path: str | Path) -> Path:
    """A single file on the driver, in UTF-8, with its folders."""
    path = Path(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(content, encoding="utf-8", newline="")
    return path


def write_subtitles(cues: DataFrame, path: str | Path, mode: str = "original", strip_stops: bool = False, metadata: list[str] | None = None) -> Path:
    """The cues of one media as the file that the extension names: srt, vtt, json or lrc, the last with metadata lines."""
    kind = Path(path).suffix.lower().lstrip(".")
    if kind not in (*FORMATS, "lrc"):
        raise ValueError(f"unknown format: {kind or path}")
    found = rendered(cues, kind, mode, strip_stops).take(2)
    if len(found) > 1:
        raise ValueError("the cues are of several media; write_texts writes those")
    content = found[0]["content"] if found else {"vtt": "WEBVTT\n\n", "json": "[]\n"}.get(kind, "")
    return write_file("".join(f"{line}\n" for line in (metadata or []) if kind == "lrc") + content, path)


def write_output_set(cues: DataFrame, folder: str | Path, stem: str, formats: list[str], **options) -> list[Path]:
    """The files of one media's output matrix, ``stem`` for its name, in their order."""
    strip = options.pop("strip_stops", False)
    modes = _modes(options.pop("proofread", False), options.pop("translation", False), options.pop("bilingual", False))
    return [write_subtitles(cues, Path(folder) / f"{stem}.{m}.{f}", m, strip) for f in _formats(formats) for m in modes]


def subtitle_names(source: str, out: str | None = None, out_dir: str | None = None, formats: list[str] | None = None, translation: bool = False, bilingual: bool = False) -> list[tuple[Path, str]]:
    """(file, mode) that a run over media writes: ``out`` alone (with a bilingual file beside it), or the output matrix beside the source."""
    if out and formats:
        raise ValueError("out and formats exclude each other")
    bilingual = translation and bilingual
    if out:
        path = Path(out)
        return [(path, "translation" if translation else "original"), *[(beside(path), "bilingual")] * bilingual]
    folder = Path(out_dir) if out_dir else Path(source).parent
    return [(folder / f"{Path(source).stem}.{m}.{f}", m) for f in _formats(formats or ["srt"]) for m in _modes(translation, translation, bilingual)]


def timed_names(text: str, out: str | None = None, formats: list[str] | None = None) -> list[Path]:
    """Files that a run over a text writes: ``out`` alone, or the text's name with ``.timed`` and each format once, lrc by default."""
    if out and formats:
        raise ValueError("out and formats exclude each other")
    return [Path(out)] if out else [Path(text).with_suffix(f".timed.{f}") for f in dict.fromkeys(formats or ["lrc"])]


def edited_name(source: str, what: str, out: str | None = None) -> Path:
    """The file that proofreading or translating a subtitle file writes: ``out``, or the source's name with ``what``."""
    return Path(out) if out else Path(source).parent / f"{Path(source).stem}.{what}.srt"


def beside(path: str | Path) -> Path:
    """The bilingual file beside another."""
    return Path(path).parent / f"{Path(path).stem}.bilingual{Path(path).suffix}"
