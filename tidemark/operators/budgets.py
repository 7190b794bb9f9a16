"""Bounded selections: what fits in so many bytes, in order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Files of a graph's input: bytes of one and of all, and how many of each kind.
FILE_BYTES, INPUT_BYTES = 2 << 20, 64 << 20
INPUT_FILES = {"source": 2000, "auxiliary": 256}


def prefix_within(rows: DataFrame, order: list, size_col: str, budget: int, most: int, *, used: DataFrame | None = None) -> DataFrame:
    """The longest prefix of ``rows`` by ``order`` whose sizes sum to ``budget`` or less, of the first ``most`` rows.

    ``order`` leaves no ties but among equal rows. Tasks keep their first ``most`` rows, so that
    many at most are summed up in one; null sizes count as none. ``used``, a row of one number,
    is taken off the budget.
    """
    first = rows.orderBy(*order).limit(most)
    so_far = F.sum(F.coalesce(F.col(size_col), F.lit(0))).over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    summed = first.withColumn("_sum", so_far)
    if used is None:
        return summed.where(F.col("_sum") <= budget).drop("_sum")
    one = used.toDF("_used")
    return summed.crossJoin(F.broadcast(one)).where(F.col("_sum") + F.col("_used") <= budget).drop("_sum", "_used")  # one row


def graph_inputs(files: DataFrame, budget: int = INPUT_BYTES, file_bytes: int = FILE_BYTES, most: dict[str, int] | None = None) -> DataFrame:
    """(path, kind, size): which ``files`` (path, kind, size) a graph is made of.

    Of each kind the first by path of those up to ``file_bytes``, so many; then, by path, each
    that still fits in ``budget``: one that doesn't is passed over and takes nothing. Whether a
    file fits depends on all before it, so the few files that are left are taken one by one.
    """
    most = INPUT_FILES if most is None else most
    fits = files.select("path", "kind", F.col("size").cast("long").alias("size")).where((F.col("size") <= file_bytes) & F.col("path").isNotNull())
    some = None
    for kind, n in most.items():
        own = fits.where(F.col("kind") == kind).orderBy("path", "size").limit(n)
        some = own if some is None else some.union(own)
    one = F.struct("path", "kind", "size")
    all_of = some.agg(F.sort_array(F.collect_list(one)).alias("all"))  # 2,256 rows by default
    start = F.struct(F.lit(0).cast("long").alias("total"), F.filter("all", lambda x: F.lit(False)).alias("kept"))
    step = lambda held, x: F.when(held["total"] + x["size"] > budget, held).otherwise(F.struct((held["total"] + x["size"]).alias("total"), F.concat(held["kept"], F.array(x)).alias("kept")))
    return all_of.select(F.explode(F.aggregate("all", start, step)["kept"]).alias("x")).select("x.*")
