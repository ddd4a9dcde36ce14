"""Media files: listing, identity, WAV samples, and external tools as providers."""

from __future__ import annotations

import hashlib
import io
import subprocess
import wave
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.text import media_id


def list_media(spark: SparkSession, path: str) -> DataFrame:
    """path, mtime (microseconds, all that Spark has), size and media_id of the files under ``path``; contents are not read.

    ``file_id`` names a local file by nanoseconds.
    """
    rows = spark.read.format("binaryFile").load(path).select("path", F.unix_micros("modificationTime").alias("mtime"), F.col("length").alias("size"))
    return rows.withColumn("media_id", media_id(F.col("path"), F.col("mtime"), F.col("size")))


def file_id(path: str | Path) -> str:
    """Sixteen hexadecimal digits of a local file's resolved path, time in nanoseconds and size."""
    found = Path(path).resolve()
    said = found.stat()
    return hashlib.sha1(f"{found}|{said.st_mtime_ns}|{said.st_size}".encode()).hexdigest()[:16]


def cached_media_id(name):
    """The identity in a cached file's name: its sixteen hexadecimal digits."""
    return F.nullif(F.regexp_extract(name, "([0-9a-f]{16})", 1), F.lit(""))


def mono_samples(content: bytes, rate: int = 16_000) -> np.ndarray:
    """Samples of a PCM WAV as 32-bit floats, channels averaged; another rate is an error."""
    with wave.open(io.BytesIO(content)) as f:
        if f.getframerate() != rate:
            raise ValueError(f"sample rate {f.getframerate()}, not {rate}")
        kind = {1: np.uint8, 2: "<i2", 4: "<i4"}[f.getsampwidth()]
        data = np.frombuffer(f.readframes(f.getnframes()), kind).astype(np.float32)
        data = (data - 128) / 128 if f.getsampwidth() == 1 else data / float(1 << (8 * f.getsampwidth() - 1))
        return data.reshape(-1, f.getnchannels()).mean(axis=1) if len(data) else np.empty(0, np.float32)


def loud_ranges(samples: np.ndarray, rate: int = 16_000, frame: float = 0.03, level: float = 0.01, least_speech: float = 0.25, least_silence: float = 0.6) -> list[tuple[float, float]]:
    """Speech by energy: a deterministic stand-in for a neural detector."""
    size = int(rate * frame)
    count = len(samples) // size
    loud = np.sqrt((samples[: count * size].reshape(count, size) ** 2).mean(axis=1)) > level if count else np.zeros(0, bool)
    edges = np.flatnonzero(np.diff(np.concatenate([[0], loud.astype(np.int8), [0]])))
    ranges: list[tuple[float, float]] = []
    for a, b in zip(edges[::2] * frame, edges[1::2] * frame):
        if ranges and a - ranges[-1][1] < least_silence:
            ranges[-1] = (ranges[-1][0], float(b))
        else:
            ranges.append((float(a), float(b)))
    return [r for r in ranges if r[1] - r[0] >= least_speech]


def detect_speech(files: DataFrame, detector: Callable[[np.ndarray], list[tuple[float, float]]] = loud_ranges, rate: int = 16_000, padding: float = 0.0) -> DataFrame:
    """media_id, start, end of speech in WAV files (media_id, content), each ``padding`` longer on either side within its file.

    Neighbours whose padding would overlap meet in the middle; planning pads again.
    """

    def padded(found: list[tuple[float, float]], length: float) -> list[tuple[float, float]]:
        pauses = [(b[0] - a[1]) / 2 for a, b in zip(found, found[1:])]
        before, after = [min(padding, x) for x in [padding, *pauses]], [min(padding, x) for x in [*pauses, padding]]
        return [(max(0.0, a - x), min(length, b + y)) for (a, b), x, y in zip(found, before, after)]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            heard = [(m, mono_samples(c, rate)) for m, c in zip(part["media_id"], part["content"])]
            rows = [(m, a, b) for m, samples in heard for a, b in padded(detector(samples), len(samples) / rate)]
            yield pd.DataFrame(rows, columns=["media_id", "start", "end"])

    return files.select("media_id", "content").mapInPandas(run, "media_id string, start double, end double")


def cut_window(content: bytes, start: float, end: float) -> bytes:
    """The WAV of [start, end) of a WAV."""
    out = io.BytesIO()
    with wave.open(io.BytesIO(content)) as f, wave.open(out, "wb") as g:
        g.setparams(f.getparams())
        f.setpos(min(f.getnframes(), int(start * f.getframerate())))
        g.writeframes(f.readframes(max(0, int(end * f.getframerate()) - f.tell())))
    return out.getvalue()


def window_name(index: int, start: float, end: float) -> str:
    """The file name of a window's audio; the columns' form is ``timecode.chunk_stem``."""
    return f"chunk-{index:05d}-{start:.3f}-{end:.3f}.wav"


def window_files(files: DataFrame, windows: DataFrame) -> DataFrame:
    """media_id, window_index, name and content of each window (media_id, window_index, start, end) of WAV files (media_id, content).

    A file is cut where it is, into all its windows, so its content is not copied for each of them.
    """
    listed = windows.groupBy("media_id").agg(F.array_sort(F.collect_list(F.struct("window_index", "start", "end"))).alias("windows"))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for m, content, own in zip(part["media_id"], part["content"], part["windows"]):
                for w in own:
                    name = window_name(w["window_index"], w["start"], w["end"])
                    yield pd.DataFrame([(m, w["window_index"], name, cut_window(content, w["start"], w["end"]))], columns=["media_id", "window_index", "name", "content"])

    return files.select("media_id", "content").join(listed, "media_id").mapInPandas(run, "media_id string, window_index int, name string, content binary")


def run_tool(command: list[str]) -> str:
    """A command's output; a missing tool or a failure is a RuntimeError with its words."""
    try:
        done = subprocess.run(command, capture_output=True, text=True)
    except FileNotFoundError as e:
        raise RuntimeError(f"{command[0]} is not installed") from e
    if done.returncode:
        raise RuntimeError(f"{command[0]} failed: {done.stderr.strip()}")
    return done.stdout


def probe_duration(path: str, run: Callable[[list[str]], str] = run_tool) -> float:
    """Seconds that ffprobe reports."""
    said = run(["ffprobe", "-v", "error", "-show_entries", "format=duration", "-of", "default=nokey=1:noprint_wrappers=1", path]).strip()
    try:
        return float(said)
    except ValueError as e:
        raise RuntimeError(f"no duration for {path}: {said!r}") from e


def to_wav(path: str, folder: str, rate: int = 16_000, overwrite: bool = False, run: Callable[[list[str]], str] = run_tool) -> str:
    """A mono PCM file of ``path`` in ``folder``, named by the source's identity; one that is there is kept unless ``overwrite``."""
    out = Path(folder) / f"{file_id(path)}.16k-mono.wav"
    if overwrite or not out.exists():
        out.parent.mkdir(parents=True, exist_ok=True)
        run(["ffmpeg", "-hide_banner", "-loglevel", "error", "-y", "-i", path, "-vn", "-ac", "1", "-ar", str(rate), "-c:a", "pcm_s16le", str(out)])
    return str(out)
