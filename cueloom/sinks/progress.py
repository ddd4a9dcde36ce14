"""Progress as text: what plans report, and how a console and a stream's listener show it."""

from __future__ import annotations

import re
import sys
from collections.abc import Callable
from typing import TextIO

from pyspark.sql.streaming import StreamingQueryListener

COUNTED = re.compile(r"^(?P<what>.*?)[: ]+(?P<done>\d+)/(?P<all>\d+)(?:: (?P<note>.*))?$")


def read_message(message: str) -> tuple[str, int | None, int | None, str]:
    """(what, done, all, note) of a message like ``refining line 3/10`` or ``segmentation 2/5: fallback (...)``."""
    m = COUNTED.match(message.strip())
    return (m["what"], int(m["done"]), int(m["all"]), m["note"] or "") if m else (message.strip(), None, None, "")


class Console:
    """A callable that prints messages, and counted ones of one kind over each other on a terminal."""

    def __init__(self, out: TextIO | None = None, width: int = 20):
        self.out, self.width, self.open = out or sys.stderr, width, ""

    def __call__(self, message: str) -> None:
        what, done, total, note = read_message(message)
        if total:
            full = self.width * min(done, total) // total
            message = f"{what} [{'#' * full}{'.' * (self.width - full)}] {done}/{total}" + f" {note}" * bool(note)
        again = bool(total) and self.open == what and self.out.isatty()
        self.out.write(("\r" if again else "\n" if self.open and self.out.isatty() else "") + message + ("" if total and self.out.isatty() else "\n"))
        self.open = what if total and done < total else ""
        self.out.flush()


class StreamProgress(StreamingQueryListener):
    """Reports each micro-batch of a session's streams: ``spark.streams.addListener(StreamProgress(Console()))``."""

    def __init__(self, report: Callable[[str], None]):
        self.report = report

    def onQueryStarted(self, event) -> None:
        self.report(f"stream {event.name or event.id}: started")

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self.report(f"stream {p.name or p.id}: batch {p.batchId}, {p.numInputRows} rows")

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.report(f"stream {event.id}: " + (f"failed: {event.exception}" if event.exception else "ended"))
