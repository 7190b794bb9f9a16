"""What changed between two states of an index, and which results still hold."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def diff(previous: DataFrame, current: DataFrame, *, path_col: str = "path", hash_col: str = "hash") -> DataFrame:
    """(path, status): unchanged, changed, new or deleted, by equal hashes. Null paths are never equal."""
    old = previous.select(F.col(path_col).alias("old"), F.col(hash_col).alias("old_hash"))
    now = current.select(F.col(path_col).alias("now"), F.col(hash_col).alias("now_hash"))
    both = old.join(now, F.col("old") == F.col("now"), "full_outer")
    status = F.when(F.col("old").isNull(), "new").when(F.col("now").isNull(), "deleted").when(F.col("old_hash").eqNullSafe(F.col("now_hash")), "unchanged").otherwise("changed")
    return both.select(F.coalesce("now", "old").alias(path_col), status.alias("status"))


def stale(old_ids: DataFrame, new_ids: DataFrame, id_col: str = "id") -> DataFrame:
    """Ids of the old state that the new one hasn't."""
    return old_ids.select(id_col).join(new_ids.select(id_col), id_col, "left_anti")


def fresh(hits: DataFrame, current: DataFrame, keys: list[str]) -> DataFrame:
    """The hits whose ``keys`` (path, hash and source, say) the current state has; the others must not be shown."""
    return hits.join(current.select(*keys), keys, "left_semi")


def upsert(stored: DataFrame, rows: DataFrame, id_col: str = "id", at_col: str | None = None) -> DataFrame:
    """``stored`` with ``rows`` in place of those of the same ids.

    Of rows with one id the last by ``at_col`` counts, an increasing number or time of writing;
    without it the one with the greatest hash of its columns does. Rows without id are never equal and all stay.
    """
    rest = [F.col(f"`{c}`") for c in rows.columns if c != id_col]
    order = F.struct(*([F.col(at_col)] if at_col else []), F.xxhash64(*rest))
    last = rows.where(F.col(id_col).isNotNull()).groupBy(id_col).agg(F.max_by(F.struct(F.lit(0).alias("_one"), *rest), order).alias("_last"))
    kept = last.select(id_col, "_last.*").unionByName(rows.where(F.col(id_col).isNull()).withColumn("_one", F.lit(0))).select(*[c for c in rows.columns if c != at_col or c in stored.columns])
    return stored.join(rows.select(id_col), id_col, "left_anti").unionByName(kept)


def run_totals(changes: DataFrame, sample: int = 100) -> DataFrame:
    """One row: files by status, and up to ``sample`` of the changed ones' paths, the least ones."""
    count = lambda s: F.count(F.when(F.col("status") == s, 1)).alias(s)
    totals = changes.agg(F.count("*").alias("seen"), *[count(s) for s in ("unchanged", "changed", "new", "deleted")])
    paths = changes.where("status = 'changed'").orderBy("path").limit(sample).agg(F.sort_array(F.collect_list("path")).alias("sample"))
    return totals.crossJoin(paths)  # a row each
