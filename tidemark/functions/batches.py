"""Sizes of Arrow batches."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Rows of an Arrow batch at most: rows hold whole texts, and a worker has a batch in memory at once.
BATCH_ROWS = 1000


def short_batches(spark: SparkSession) -> None:
    """From now on Arrow batches of this session have BATCH_ROWS rows at most."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))
