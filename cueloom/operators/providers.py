"""External models as providers: loaded once per Python worker, called on Arrow batches.

Whatever a provider returns should be written before it is used twice, or a
recomputed stage would call it again.
"""

from __future__ import annotations

import contextlib
import itertools
import json
import re
import time
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from ..shared import removed_at_exit, shared_dir, shared_table

#: Windows whose tokens are held at once as a batch.
CALLS = 500
#: Tasks for each core that rows are dealt to for a model.
TASKS = 2
TOKENS = "array<struct<text:string,start:double,end:double>>"


def transcribed(windows: DataFrame, load: Callable[[], Callable[[dict], tuple[str, str | None]]]) -> DataFrame:
    """Windows with transcript and language; ``load`` gives a function of a window's row."""
    columns = windows.columns

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for part in parts:
            said = [model(row) for row in part.to_dict("records")]
            yield part.assign(transcript=[s[0] for s in said], spoken=[s[1] for s in said])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in windows.schema)
    # A row takes a model far longer than its few bytes say: rows are dealt to all cores, whatever their size.
    dealt = windows.select(*columns).repartition(TASKS * windows.sparkSession.sparkContext.defaultParallelism, "media_id", "window_index")
    return dealt.mapInPandas(run, f"{schema}, transcript string, spoken string")


def force_aligned(chunks: DataFrame, load: Callable[[], Callable[[str, float, str], list[tuple[str, float, float]]]], strict: bool = True) -> DataFrame:
    """media_id, window_index, tokens of chunks (transcript, start, end, language): empty for a blank transcript; English by default.

    A failure is an error, or gives no tokens if not ``strict``.
    """
    rows = chunks.select("media_id", "window_index", "transcript", (F.col("end") - F.col("start")).alias("seconds"), F.coalesce("language", F.lit("English")).alias("language"))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in with_tokens(parts, load(), strict):
            yield part.select(["media_id", "window_index", "tokens"])

    return rows.mapInArrow(run, f"media_id string, window_index int, tokens {TOKENS}")


def with_tokens(parts: Iterator[pa.RecordBatch], model: Callable[[str, float, str], list[tuple[str, float, float]]], strict: bool = True) -> Iterator[pa.RecordBatch]:
    """Batches (transcript, seconds, language and others) with the tokens that ``model`` places, ``CALLS`` rows each."""

    def words(text: str | None, seconds: float, language: str) -> list[tuple[str, float, float]]:
        try:
            return list(model(text, seconds, language)) if (text or "").strip() else []
        except Exception:
            if strict:
                raise
            return []

    for part in parts:
        for at in range(0, part.num_rows, CALLS):
            some = part.slice(at, CALLS)
            found = [words(*x) for x in zip(*(some[name].to_pylist() for name in ("transcript", "seconds", "language")))]
            columns = list(zip(*itertools.chain.from_iterable(found))) or [(), (), ()]
            struct = pa.StructArray.from_arrays([pa.array(c, kind) for c, kind in zip(columns, (pa.string(), pa.float64(), pa.float64()))], ["text", "start", "end"])
            tokens = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, found)]), pa.int32()), struct)
            yield pa.RecordBatch.from_arrays([*some.columns, tokens], [*some.schema.names, "tokens"])


def evenly_spoken(text: str, seconds: float, language: str) -> list[tuple[str, float, float]]:
    """A deterministic aligner for tests: words share the time by their length."""
    words = text.split()
    ends = list(itertools.accumulate(map(len, words), initial=0))
    total = ends[-1] or 1
    times = [round(at / total * seconds, 3) for at in ends]
    return list(zip(words, times, times[1:]))


class ReplyError(RuntimeError):
    """``final`` errors are not tried again."""

    def __init__(self, message: str, final: bool = False):
        super().__init__(message)
        self.final = final


def with_retries(call: Callable[[str], str], prompt: str, retries: int = 2, wait: Callable[[float], None] = time.sleep) -> str:
    """The reply, after up to ``retries`` more tries with growing pauses of 8 seconds at most."""
    for attempt in range(retries + 1):
        try:
            return call(prompt)
        except Exception as e:
            if attempt == retries or getattr(e, "final", False):
                raise
            wait(min(2.0**attempt, 8.0))
    raise AssertionError


def final_status(code: int) -> bool:
    """Whether an HTTP status will not change by asking again."""
    return 400 <= code < 500 and code != 429


#: Prompts of a batch that is asked side by side and then noted.
ASKED = 64


class Ledger:
    """Replies that a task has had, in the shared folder: an attempt that runs again asks only for the others."""

    def __init__(self, path: str, task: int):
        self.system, base = fs.FileSystem.from_uri(path) if re.match(r"[a-z][a-z0-9+.-]*:/", path) else (fs.LocalFileSystem(), path)
        self.folder = f"{base}/{task}"

    def known(self) -> dict[str, list]:
        """Prompt -> (reply, error) of what other attempts have noted; errors are not among them, they are asked again."""
        out: dict[str, list] = {}
        for info in self.system.get_file_info(fs.FileSelector(self.folder, allow_not_found=True)):
            with self.system.open_input_stream(info.path) as f:
                data = f.read()
            # A note that was cut off is none.
            with contextlib.suppress(ValueError):
                out |= {p: [reply, None] for p, reply in json.loads(data)}
        return out

    def note(self, replies: list[tuple[str, str]]) -> None:
        self.system.create_dir(self.folder, recursive=True)
        with self.system.open_output_stream(f"{self.folder}/{uuid.uuid4().hex}.json") as f:
            f.write(json.dumps(replies).encode())


def replied(prompts: DataFrame, load: Callable[[], Callable[[str], str]], concurrency: int = 2, retries: int = 2, tasks: int | None = None) -> DataFrame:
    """``prompts`` with reply and error; no more than ``concurrency`` requests are under way at any time, in the whole cluster.

    They are asked by ``tasks`` tasks (as many as ``concurrency``, if not said), each with its share of the requests.
    Prompts are written first: which task has which is the same when one runs again, and that one finds the replies
    it has had.
    """
    concurrency = max(1, concurrency)
    tasks = max(1, min(concurrency, tasks or concurrency))
    ledger = shared_dir(prompts.sparkSession)
    removed_at_exit(prompts.sparkSession, ledger)
    own = F.pmod(F.xxhash64("prompt", *[c for c in prompts.columns if c != "prompt"]), F.lit(tasks)).cast("int")
    dealt = shared_table(prompts.withColumn("_task", own)).repartitionById(tasks, F.col("_task"))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task = TaskContext.get().partitionId()
        model, notes = load(), Ledger(ledger, task)
        known = notes.known() if TaskContext.get().attemptNumber() else {}

        def one(prompt: str) -> tuple[str | None, str | None]:
            try:
                return with_retries(model, prompt, retries), None
            except Exception as e:
                return None, f"{type(e).__name__}: {e}".removesuffix(": ")

        # Task k of n has the k-th share of the requests; the shares add up to all of them.
        with ThreadPoolExecutor((concurrency - task + tasks - 1) // tasks) as pool:
            for whole in parts:
                for at in range(0, len(whole), ASKED):
                    part = whole.iloc[at : at + ASKED].drop(columns="_task")
                    new = [p for p in dict.fromkeys(part["prompt"]) if p not in known]
                    said = dict(zip(new, pool.map(one, new)))
                    if good := [(p, r) for p, (r, _) in said.items() if r is not None]:
                        notes.note(good)
                    said |= {p: known[p] for p in part["prompt"] if p in known}
                    yield part.assign(reply=[said[p][0] for p in part["prompt"]], error=[said[p][1] for p in part["prompt"]])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in prompts.schema)
    return dealt.mapInPandas(run, f"{schema}, reply string, error string")
