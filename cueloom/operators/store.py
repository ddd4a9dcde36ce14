"""The artifact store on disk: snapshots of buckets, each published by one rename.

Rows are dealt into buckets by a hash of media_id. A change reads and writes the
buckets of the rows that it concerns, into a folder of its own, and then
publishes a manifest: the snapshot's number, the folder of every bucket, and the
last batch of each stream that has been taken in. Publishing fails if the number
is taken; the change is then made again on top of the newer snapshot. Readers get
the files of one manifest and are not disturbed by later ones. A writer that dies
leaves files that no manifest names; ``vacuum`` removes them.

Nothing in a manifest grows with the store: it has a line a bucket.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..shared import shared_table
from . import artifacts as A

BUCKETS, TRIES = 64, 8


class Conflict(RuntimeError):
    """Another writer has published the same number."""


@dataclass(frozen=True)
class Snapshot:
    number: int = 0
    buckets: int = BUCKETS
    #: Bucket -> folder of its rows, relative to the store; buckets without rows are not named.
    folders: dict[str, str] = field(default_factory=dict)
    #: Stream -> last batch that has been taken in.
    batches: dict[str, int] = field(default_factory=dict)


class Store:
    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets
        self._hadoop = spark._jvm.org.apache.hadoop.fs
        self._files = self._hadoop.Path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, *parts: str):
        return self._hadoop.Path("/".join([self.path, *parts]))

    def numbers(self) -> list[int]:
        """Numbers of the published snapshots, ascending."""
        folder = self._at("snapshots")
        found = self._files.listStatus(folder) if self._files.exists(folder) else []
        return sorted(int(f.getPath().getName()[:-5]) for f in found if f.getPath().getName().endswith(".json"))

    def snapshot(self, number: int | None = None) -> Snapshot:
        """A snapshot's manifest, the latest by default; an empty one where there is none yet."""
        known = self.numbers()
        if not known and number is None:
            return Snapshot(buckets=self.buckets)
        stream = self._files.open(self._at("snapshots", f"{known[-1] if number is None else number:012d}.json"))
        try:
            return Snapshot(**json.loads(bytes(stream.readAllBytes()).decode()))
        finally:
            stream.close()

    def read(self, snapshot: Snapshot | None = None, buckets: list[int] | None = None) -> DataFrame:
        """The rows of a snapshot, the latest by default; of some of its buckets only, if so asked."""
        now = self.snapshot() if snapshot is None else snapshot
        folders = [f"{self.path}/{f}" for b, f in now.folders.items() if buckets is None or int(b) in buckets]
        return self.spark.read.schema(A.SCHEMA).parquet(*folders) if folders else self.spark.createDataFrame([], A.SCHEMA)

    def _bucketed(self, rows: DataFrame, buckets: int) -> DataFrame:
        return rows.withColumn("bucket", F.pmod(F.xxhash64(F.col("media_id").cast("string")), F.lit(buckets)).cast("int"))

    def _touched(self, rows: DataFrame, buckets: int) -> list[int]:
        return [r[0] for r in self._bucketed(rows.select("media_id"), buckets).select("bucket").distinct().collect()]

    def publish(self, snapshot: Snapshot) -> None:
        """Give the snapshot its number, or raise Conflict if that is taken. The manifest is written whole before it has its name."""
        draft, final = self._at("drafts", uuid.uuid4().hex), self._at("snapshots", f"{snapshot.number:012d}.json")
        stream = self._files.create(draft, False)
        stream.write(bytearray(json.dumps(asdict(snapshot)).encode()))
        stream.close()
        self._files.mkdirs(self._at("snapshots"))
        context = self._hadoop.FileContext.getFileContext(self._files.getUri(), self.spark._jsc.hadoopConfiguration())
        none = self.spark.sparkContext._gateway.new_array(self.spark._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(draft, final, none)
        except Exception as e:
            self._files.delete(draft, False)
            if self._files.exists(final):
                raise Conflict(f"snapshot {snapshot.number} is there already") from e
            raise

    def _changed(self, change: Callable[[Snapshot], tuple[list[int], DataFrame] | None], stream: str | None = None, batch: int | None = None) -> Snapshot:
        """Publish what ``change`` makes of the latest snapshot: the buckets it replaces and their rows. None leaves it as it is."""
        for _ in range(TRIES):
            now = self.snapshot()
            if stream is not None and now.batches.get(stream, -1) >= batch:
                return now
            made = change(now)
            batches = now.batches if stream is None else now.batches | {stream: batch}
            if made is None and batches == now.batches:
                return now
            folders = dict(now.folders)
            if made is not None:
                touched, rows = made
                folder = f"data/{uuid.uuid4().hex}"
                # Bucket by bucket, in a task or more each; what is empty has no folder and is not named.
                self._bucketed(rows, now.buckets).repartition("bucket").write.partitionBy("bucket").parquet(f"{self.path}/{folder}")
                written = {f.getPath().getName().removeprefix("bucket=") for f in self._files.listStatus(self._at(folder)) if f.isDirectory()}
                folders = {b: f for b, f in folders.items() if int(b) not in touched} | {b: f"{folder}/bucket={b}" for b in written}
            new = Snapshot(now.number + 1, now.buckets, folders, batches)
            try:
                self.publish(new)
                return new
            except Conflict:
                continue
        raise Conflict(f"{TRIES} other writers were faster")

    def upsert(self, new: DataFrame, stream: str | None = None, batch: int | None = None) -> Snapshot:
        """Take in new rows, the latest of each window and kind; those of a stream's batch once, however often it comes."""
        new = shared_table(A.latest(new.select(*self.spark.createDataFrame([], A.SCHEMA).columns)))

        def change(now: Snapshot):
            touched = self._touched(new, now.buckets)
            return (touched, A.upserted(self.read(now, touched), new)) if touched else None

        return self._changed(change, stream, batch)

    def retain(self, active: DataFrame, keep: DataFrame, most: int = A.MOST_MEDIA) -> Snapshot:
        """Drop what is no longer planned of planned media, and the oldest media beyond ``most``, never one of ``keep``."""
        active, keep = shared_table(active), shared_table(keep.select("media_id"))

        def change(now: Snapshot):
            held = self.read(now)
            left = A.retained(A.active_only(held, active), keep, most)
            gone = held.select(*A.KEY, "kind").join(left.select(*A.KEY, "kind"), [*A.KEY, "kind"], "left_anti")
            touched = self._touched(gone, now.buckets)
            if not touched:
                return None
            evicted = shared_table(A.evicted(A.active_only(held, active), keep, most))
            return touched, A.active_only(self.read(now, touched), active).join(evicted, "media_id", "left_anti")

        return self._changed(change)

    def sink(self, stream: str) -> Callable[[DataFrame, int], None]:
        """What ``writeStream.foreachBatch`` calls: a batch that is repeated after a failure changes nothing."""
        return lambda rows, batch: self.upsert(rows, stream, batch) and None

    def vacuum(self, keep: int = 2) -> None:
        """Forget all but the last ``keep`` snapshots, with the files that none of these names. For times without writers."""
        known = self.numbers()
        for number in known[:-keep]:
            self._files.delete(self._at("snapshots", f"{number:012d}.json"), False)
        named = {f for n in known[-keep:] for f in self.snapshot(n).folders.values()}
        data = self._at("data")
        for folder in self._files.listStatus(data) if self._files.exists(data) else []:
            for bucket in self._files.listStatus(folder.getPath()):
                if f"data/{folder.getPath().getName()}/{bucket.getPath().getName()}" not in named:
                    self._files.delete(bucket.getPath(), True)
            if not self._files.listStatus(folder.getPath()):
                self._files.delete(folder.getPath(), True)
        self._files.delete(self._at("drafts"), True)
