"""Bursts of events: a window opens at an event and takes all that follow within its width; the next event opens another."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def coalesce_bursts(events: DataFrame, width_seconds: int, *, key_col: str = "user_id", time_col: str = "ts") -> DataFrame:
    """(key, started, n): each burst of a key, by its first event, and its events.

    Bursts follow from each other, so events are taken in order of time; equal times are counted
    together before that, and a task holds one burst. After a gap of the width or more a burst
    must begin, so a key is cut there and its pieces run apart: times are put in cells of the
    width, and of each cell only the first and last time are compared with the cell before it.
    Null keys are one key, null times are left out.
    """
    own = events.where(events[time_col].isNotNull()).groupBy(events[key_col].alias("k"), events[time_col].cast("timestamp").alias("t")).agg(F.count("*").alias("n"))
    width = width_seconds * 1_000_000
    own = own.select("k", F.unix_micros("t").alias("t"), "n").withColumn("cell", F.floor(F.col("t") / width))
    cells = own.groupBy("k", "cell").agg(F.min("t").alias("first"), F.max("t").alias("last"))
    before = cells.select(F.col("k").alias("bk"), (F.col("cell") + 1).alias("bc"), "last").withColumnRenamed("last", "before")
    cut = F.when(F.col("before").isNull() | (F.col("first") - F.col("before") >= width), 1).otherwise(0)
    cells = cells.join(before, cells["k"].eqNullSafe(before["bk"]) & (cells["cell"] == before["bc"]), "left")
    pieces = cells.select(F.col("k").alias("pk"), F.col("cell").alias("pc"), F.sum(cut).over(Window.partitionBy("k").orderBy("cell")).alias("piece"))
    own = own.join(pieces, own["k"].eqNullSafe(pieces["pk"]) & (own["cell"] == pieces["pc"]))
    own = own.select("k", "piece", "t", "n").repartition("k", "piece").sortWithinPartitions("k", "piece", "t")

    def fold(batches):
        import pyarrow as pa

        key, start, total = None, None, 0
        for batch in batches:
            out = []
            for k, piece, t, n in zip(*(c.to_pylist() for c in batch.columns)):
                if start is None or (k, piece) != key or t >= start + width:
                    if start is not None:
                        out.append((key[0], start, total))
                    key, start, total = (k, piece), t, 0
                total += n
            yield rows(pa, batch.schema, out)
        if start is not None:
            yield rows(pa, batch.schema, [(key[0], start, total)])

    def rows(pa, schema, out):
        columns = list(zip(*out)) or [(), (), ()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (schema.field(0).type, pa.int64(), pa.int64()))], names=["k", "t", "n"])

    kind = events.schema[key_col].dataType.simpleString()
    bursts = own.mapInArrow(fold, f"k {kind}, t long, n long")
    return bursts.select(F.col("k").alias(key_col), F.timestamp_micros("t").cast("timestamp_ntz").alias("started"), "n")
