"""Indexes kept current by Structured Streaming: each micro-batch of file events is one incremental run."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.sources import store

LEAST_MS, MOST_MS = 250, 3_600_000
#: Seconds from one safety scan to the next.
SAFETY_SECONDS = 300


def interval(milliseconds: int) -> str:
    """A trigger's interval; raises ValueError beyond 250 ms to one hour."""
    if not LEAST_MS <= milliseconds <= MOST_MS:
        raise ValueError(f"an interval is {LEAST_MS} to {MOST_MS} ms")
    return f"{milliseconds} milliseconds"


def _told(observer: Callable[[dict], None] | None, event: dict) -> None:
    if observer is not None:
        try:
            observer(event)
        except Exception:  # an observer must not stop the watch
            pass


def watch(events: DataFrame, run: Callable[[DataFrame], object], checkpoint: str, *, milliseconds: int = 500, observer: Callable[[dict], None] | None = None, once: bool = False) -> StreamingQuery:
    """Calls ``run`` with the events of each micro-batch, one run at a time; events that come meanwhile wait for the next, so a burst is one run.

    ``observer`` gets {run, ok, error} after each; what it raises is ignored, and so is a failed
    run: the next one starts from the index as it is. ``once`` takes what is there and ends.
    """

    def step(batch: DataFrame, number: int) -> None:
        event = {"run": number, "ok": True, "error": None}
        try:
            if batch.isEmpty():
                return
            run(batch)
        except Exception as e:  # a later run repairs it
            event |= {"ok": False, "error": str(e)}
        _told(observer, event)

    writer = events.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=interval(milliseconds))).start()


class Pending:
    """Paths whose run failed, in a table that outlives the watch; a null path stands for all files."""

    def __init__(self, spark, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def parts(self) -> list[str]:
        return store.children(self.spark, self.folder)

    def paths(self, parts: list[str]) -> DataFrame:
        if not parts:
            return self.spark.createDataFrame([], "path string")
        return self.spark.read.schema("path string").parquet(*[f"{self.folder}/{p}" for p in parts])

    def add(self, paths: DataFrame) -> None:
        paths.select("path").distinct().write.parquet(f"{self.folder}/{uuid.uuid4().hex}")

    def done(self, parts: list[str]) -> None:
        for p in parts:
            store.remove(self.spark, f"{self.folder}/{p}")


def watch_files(events: DataFrame, run: Callable[[DataFrame | None], object], folder: str, *, milliseconds: int = 500, safety_seconds: int = SAFETY_SECONDS, observer: Callable[[dict], None] | None = None, once: bool = False) -> StreamingQuery:
    """Keeps an index current: ``run(None)`` scans all files, ``run(paths)`` takes up some (path).

    It begins with a scan. Then each micro-batch of ``events`` (path) is a run of their paths, and
    every ``safety_seconds``, by a rate source beside the events, there is a scan of all, so that
    lost events do no harm. The paths of a failed run are kept in ``folder``, as is a failed scan,
    and the next run takes them up with its own, after a restart too; they are given up only once a
    run with them has succeeded. A run that was cut off is repeated, so ``run`` must bear that.

    ``observer`` gets {run, ok, error, scan, retried} after each run, and what it raises is
    ignored. ``once`` takes what is there and ends.
    """
    spark, pending = events.sparkSession, Pending(events.sparkSession, f"{folder.rstrip('/')}/pending")

    def attempt(paths: DataFrame, number: int) -> None:
        parts = pending.parts()
        every = paths.select("path").union(pending.paths(parts)).distinct()
        scan = not every.where("path IS NULL").isEmpty()
        event = {"run": number, "ok": True, "error": None, "scan": scan, "retried": len(parts)}
        try:
            run(None if scan else every)
        except Exception as e:
            event |= {"ok": False, "error": str(e)}
            pending.add(spark.createDataFrame([(None,)], "path string") if scan else every)
        pending.done(parts)  # what failed is in the new part
        _told(observer, event)

    def step(batch: DataFrame, number: int) -> None:
        if not batch.isEmpty():
            attempt(batch, number + 1)

    # Seconds since the start; the first is the beginning's own scan.
    ticks = spark.readStream.format("rate").option("rowsPerSecond", 1).load().where((F.col("value") > 0) & (F.col("value") % safety_seconds == 0))
    both = events.select("path").where("path IS NOT NULL").union(ticks.select(F.lit(None).cast("string").alias("path")))
    attempt(spark.createDataFrame([(None,)], "path string"), 0)
    writer = both.writeStream.foreachBatch(step).option("checkpointLocation", f"{folder.rstrip('/')}/checkpoint")
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=interval(milliseconds))).start()


def kept_up(start: Callable[[], StreamingQuery], stop: threading.Event, *, seconds: float = 1.0, observer: Callable[[dict], None] | None = None) -> int:
    """Starts a watch and, whenever its stream fails, starts it anew after ``seconds``, until ``stop`` is set or it ends by itself; returns how often it was started."""
    starts = 0
    while not stop.is_set():
        starts += 1
        try:
            query = start()
            while not query.awaitTermination(0.2) and not stop.is_set():
                pass
            query.stop()
            return starts
        except Exception as e:  # events come again from the checkpoint
            _told(observer, {"start": starts, "ok": False, "error": str(e)})
            stop.wait(seconds)
    return starts
