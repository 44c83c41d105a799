"""Logs on disk: Parquet segments below a folder, named in a manifest, and backups of them.

A commit writes a segment for each model and then one manifest entry that names them all; readers see the segments that
manifest entries name, so what no entry names does not exist. An entry is a file with the commit's number for a name.
It is moved into place only where no file has that name, which is the commit point: of two writers that saw the same last
commit one comes first, and the other is told that it was Overtaken and nothing of its is seen.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Every so many commits an entry repeats the rows of all others that still count.
FOLD = 100
MANIFEST = "commit long, epoch long, model string, path string, low long, high long"


class Overtaken(Exception):
    """Another writer made the commit of this number."""


@dataclass(frozen=True)
class Head:
    """The store as of a commit: number is the last one, rows are the manifest's entries up to it in the current epochs."""

    spark: SparkSession
    number: int
    rows: tuple

    def segments(self, model: str) -> list:
        mine = [r for r in self.rows if r.model == model]
        top = self.epoch(model)
        return [r for r in mine if r.epoch == top]

    def epoch(self, model: str) -> int:
        return max((r.epoch for r in self.rows if r.model == model), default=0)

    def watermark(self, model: str) -> int:
        return max((r.high for r in self.segments(model)), default=0)

    def log(self, model: str, schema) -> DataFrame:
        """The committed log; _seq ranges let a snapshot skip whole files by their statistics."""
        paths = [r.path for r in self.segments(model)]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)


class Store:
    """Logs of several models in a folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _entries(self) -> dict[int, str]:
        """Commit number -> file, from a listing of names alone."""
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/_manifest")
        fs = p.getFileSystem(self.spark._jsc.hadoopConfiguration())
        found = [x.getPath() for x in fs.listStatus(p)] if fs.exists(p) else []
        return {int(x.getName().removesuffix(".json")): x.toString() for x in found if x.getName().endswith(".json")}

    def head(self) -> Head:
        """As of now. Read are the entries since the last one that repeats all others' current rows, less than FOLD + 1.

        What comes to the driver is a row for each commit and model since the model's last compaction.
        """
        entries = self._entries()
        number = max(entries, default=0)
        paths = [entries[n] for n in sorted(entries) if number - number % FOLD <= n <= number]
        if not paths:
            return Head(self.spark, 0, ())
        rows = self.spark.read.schema(MANIFEST).json(paths)
        now = rows.groupBy("model").agg(F.max("epoch").alias("epoch"))
        return Head(self.spark, number, tuple(rows.join(now, ["model", "epoch"]).orderBy("commit").collect()))

    def segments(self, model: str) -> list:
        """Manifest rows of the model's current epoch, a row for each commit since its compaction."""
        return self.head().segments(model)

    def log(self, model: str, schema) -> DataFrame:
        return self.head().log(model, schema)

    def watermark(self, model: str) -> int:
        return self.head().watermark(model)

    def commit(self, versions: dict[str, DataFrame], head: Head | None = None, epochs: dict[str, int] | None = None) -> int:
        """Append all of versions (model -> rows with _seq) or nothing; the number of the commit.

        head is what the writer saw, by default the store as of now. Versions begin at their log's watermark there, or at 0
        in a new epoch, or they are refused. Overtaken if there has been another commit since.
        """
        head, rows = head or self.head(), []
        try:
            return self._commit(versions, head, epochs or {}, rows)
        except (ValueError, Overtaken):
            for r in rows:
                _delete(self.spark, r["path"])
            raise

    def _commit(self, versions: dict[str, DataFrame], head: Head, epochs: dict[str, int], rows: list[dict]) -> int:
        for model, df in sorted(versions.items()):
            path, epoch = f"{self.folder}/{model}/{uuid.uuid4().hex}", epochs.get(model, head.epoch(model))
            rows.append({"commit": head.number + 1, "epoch": epoch, "model": model, "path": path})
            df.write.parquet(path)
            ends = self.spark.read.parquet(path).agg(F.min("_seq").alias("low"), F.max("_seq").alias("high")).first()
            start = head.watermark(model) if epoch == head.epoch(model) else 0
            if ends.low not in (None, start):
                raise ValueError(f"versions of {model} begin at {ends.low}, its log ends before {start}")
            rows[-1] |= {"low": start, "high": start if ends.high is None else ends.high + 1}
        self._enter(head, rows)
        return head.number + 1

    def _enter(self, head: Head, rows: list[dict]) -> None:
        """The next entry's file, written aside and then moved to its name if that is free."""
        number = head.number + 1
        if number % FOLD == 0:
            moved = {r["model"]: r["epoch"] for r in rows}
            rows = [r.asDict() for r in head.rows if moved.get(r.model, r.epoch) == r.epoch] + rows
        text = "".join(json.dumps(r) + "\n" for r in rows)
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        aside, place = (jvm.org.apache.hadoop.fs.Path(x) for x in (f"{self.folder}/_aside/{uuid.uuid4().hex}", f"{self.folder}/_manifest/{number:020d}.json"))
        fs = place.getFileSystem(conf)
        aside, place = fs.makeQualified(aside), fs.makeQualified(place)
        out = fs.create(aside, False)
        out.write(bytearray(text.encode()))
        out.close()
        fs.mkdirs(place.getParent())
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(place.toUri(), conf)
        options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
        try:
            context.rename(aside, place, options)
        except Exception as e:
            if "FileAlreadyExists" not in str(e) and not fs.exists(place):
                raise
            fs.delete(aside, False)
            raise Overtaken(f"commit {number} has been made by another writer") from None

    def rebase(self, model: str, rows: DataFrame, head: Head, start: int) -> int:
        """rows in place of the model's log as of head, under a new epoch whose first number is start and whose watermark stays."""
        path = f"{self.folder}/{model}/{uuid.uuid4().hex}"
        rows.write.parquet(path)
        entry = {"commit": head.number + 1, "epoch": head.epoch(model) + 1, "model": model, "path": path, "low": start, "high": head.watermark(model)}
        self._enter(head, [entry])
        return head.number + 1

    def compact(self, model: str, schema, keys: list[str], between: Callable[[], None] = lambda: None) -> int:
        """Rewrite a log as its live rows under a new epoch; earlier watermarks end with the old one.

        A commit that others make meanwhile is not lost: the compaction is overtaken and begins again. between is called
        after the log was read, for tests.
        """
        from ..operators.views import compact

        while True:
            head = self.head()
            rows = compact(head.log(model, schema), keys)
            between()
            try:
                return self.commit({model: rows}, head, {model: head.epoch(model) + 1})
            except Overtaken:
                continue


    def maintain(self, model: str, schema, keys: list[str], soft: int | None = None, busy: bool = False) -> str:
        """Compacts a log by its dead rows: now, deferred (which waits while the store is busy) or none."""
        from ..operators import views

        stats = views.statistics(self.log(model, schema), keys).first()
        due = views.compaction_due(stats.dead_rows, soft or views.SOFT_DEAD)
        if due == "now" or (due == "deferred" and not busy):
            self.compact(model, schema, keys)
        return due


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


class Lagging(Exception):
    """A reader asks for events that retention has dropped: it must begin again from a snapshot."""


class FeedStore:
    """A durable feed: events by offset in segments, appended, read on from any retained offset, and pruned."""

    def __init__(self, spark: SparkSession, folder: str, schema):
        self.spark, self.schema, self.store = spark, schema, Store(spark, folder)

    def append(self, events: DataFrame) -> int:
        """events (offset, ...) follow on the last; the watermark is the last offset."""
        self.store.commit({"feed": events.withColumn("_seq", F.col("offset") - 1)})
        return self.watermark()

    def watermark(self) -> int:
        return self.store.watermark("feed")

    def earliest(self) -> int:
        """The first offset that is still there."""
        return min((r.low for r in self.store.segments("feed")), default=0) + 1

    def read_from(self, after: int, most: int | None = None) -> DataFrame:
        if after + 1 < self.earliest():
            raise Lagging(f"events up to {self.earliest() - 1} are gone; {after + 1} was asked for")
        return read_from(self.store.log("feed", self.schema), after, most)

    def catch_up_from(self, after: int, most: int | None = None) -> tuple[DataFrame, int]:
        """(events after that offset, boundary): a reader applies them, then of the live stream only offsets beyond the boundary."""
        boundary = self.watermark()
        return self.read_from(after, most).filter(F.col("offset") <= boundary), boundary

    def prune_through(self, through: int) -> None:
        """Drops every event up to that offset. What stays of a segment that it cuts is written anew; the files that no entry names any more go."""
        head = self.store.head()
        old = head.segments("feed")
        through = min(through, head.watermark("feed"))
        rest = prune_through(head.log("feed", self.schema), through).withColumn("_seq", F.col("offset") - 1)
        self.store.rebase("feed", rest, head, through)
        for r in old:
            _delete(self.spark, r.path)


def backup(log: DataFrame, folder: str, high: int, low: int = 0) -> None:
    """The versions low <= _seq < high: a full backup from 0, an increment from an earlier one's high."""
    log.filter((F.col("_seq") >= low) & (F.col("_seq") < high)).write.parquet(f"{folder.rstrip('/')}/{low:020d}-{high:020d}")


def restore(spark: SparkSession, folder: str, chain: list[tuple[int, int]], schema) -> DataFrame:
    """The log of a full backup and its increments; a gap in the chain is an error."""
    at = 0
    for low, high in chain:
        if low != at:
            raise ValueError(f"the chain has nothing from {at} to {low}")
        at = high
    return spark.read.schema(schema).parquet(*[f"{folder.rstrip('/')}/{low:020d}-{high:020d}" for low, high in chain])


def read_from(feed: DataFrame, after: int, most: int | None = None) -> DataFrame:
    """Events of offset > after in order, at most so many."""
    out = feed.filter(F.col("offset") > after).orderBy("offset")
    return out if most is None else out.limit(most)


def prune_through(feed: DataFrame, through: int) -> DataFrame:
    """What retention leaves: events of offset > through."""
    return feed.filter(F.col("offset") > through)
