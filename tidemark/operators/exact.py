"""Literal search and bounded reads over a table of files (path, text)."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import lines

MOST_LINE, MOST_QUERY, MOST_RESULTS, MOST_READ = 2000, 2048, 200, 400


def checked(query: str, limit: int) -> None:
    """Raises ValueError for a query that is blank, too long or has a NUL, and for a limit out of 1 to 200."""
    if not query.strip() or len(query) > MOST_QUERY or "\0" in query:
        raise ValueError(f"a query has 1 to {MOST_QUERY} characters, not all blank, and no NUL")
    if not 1 <= limit <= MOST_RESULTS:
        raise ValueError(f"a limit is 1 to {MOST_RESULTS}")


def content_matches(files: DataFrame, query: str, *, path_col: str = "path", text_col: str = "text") -> DataFrame:
    """(path, line, text): every line that holds ``query``, its text without what ends it, at most 2000 characters. Null texts have no lines.

    Texts without the query are turned away before they are split.
    """
    own = files.where(F.contains(files[text_col], F.lit(query)) if "\n" not in query else F.lit(False))
    each = own.select(own[path_col].alias("path"), F.posexplode(lines(own[text_col])).alias("i", "text"))
    hits = each.where(F.contains("text", F.lit(query)))
    return hits.select("path", (F.col("i") + 1).alias("line"), F.substring("text", 1, MOST_LINE).alias("text"))


def path_matches(files: DataFrame, query: str, *, path_col: str = "path") -> DataFrame:
    """(path): the files whose path holds ``query``."""
    return files.where(F.contains(files[path_col], F.lit(query))).select(files[path_col].alias("path"))


def first_matches(matches: DataFrame, limit: int) -> DataFrame:
    """The first ``limit`` matches by path and line, and one more if there are more: the caller sees by it that results are cut."""
    return matches.orderBy("path", "line").limit(limit + 1)


def bounded_read(files: DataFrame, start: int = 1, end: int | None = None, *, path_col: str = "path", text_col: str = "text") -> DataFrame:
    """(path, line_start, line_end, total_lines, text): lines ``start`` to ``end`` of each file, by default 200 and at most 400, cut at 200,000 characters.

    Files that end before ``start`` give no row, nor do null texts.
    """
    end = start + 199 if end is None else end
    if not 1 <= start <= end or end - start >= MOST_READ:
        raise ValueError(f"read 1 to {MOST_READ} lines from line 1 on")
    own = files.select(files[path_col].alias("path"), lines(files[text_col]).alias("all")).where(F.size("all") >= start)
    total = F.size("all")
    part = F.array_join(F.slice("all", start, end - start + 1), "\n")
    return own.select("path", F.lit(start).alias("line_start"), F.least(F.lit(end), total).alias("line_end"), total.alias("total_lines"), F.substring(part, 1, 200_000).alias("text"))


#: What makes a query one for paths, a slash or one of these ends.
PATH_QUERY = r"(?i)[/\\]|\.(?:asset|asmdef|asmref|cs|jsonc?|md|toml|txt|uss|uxml|ya?ml)$"
#: Ranges that are read at first, and how many times as many at each further step.
FIRST_RANGES, MORE_RANGES = 1, 4


def asks_for_paths(query: str) -> bool:
    return re.search(PATH_QUERY, query) is not None


def target_rank(path, targets: list[str]) -> F.Column:
    """The place in ``targets``, a few folders in order, of the first that holds a path; after all if none does."""
    p, out = F.col(path) if isinstance(path, str) else path, F.lit(len(targets))
    for i in reversed(range(len(targets))):
        folder = targets[i].replace("\\", "/").strip("/")
        out = F.when(F.lit(True) if folder in ("", ".") else (p == folder) | F.startswith(p, F.lit(f"{folder}/")), i).otherwise(out)
    return out


def in_ranges(files: DataFrame, targets: list[str], most: int | None = None) -> DataFrame:
    """``files`` with ``target`` and ``part``: sorted by target and path into consecutive ranges, as many as their bytes ask for, or ``most``. Write them by ``part`` and a search reads only the ranges that it comes to."""
    order = [F.col("target"), F.col("path")]
    ranked = files.withColumn("target", target_rank("path", targets))
    dealt = ranked.repartitionByRange(*order) if most is None else ranked.repartitionByRange(most, *order)
    return dealt.sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())


def ordered_matches(files: DataFrame, parts: list[int], query: str, limit: int) -> DataFrame:
    """(target, path, line, text): the first ``limit`` matches, and one more if there are, by target, path and line, in ``files`` stored by ``part``.

    A query that looks like a path is looked for in paths only, without a line, its backslashes as
    slashes. Ranges are read in order, one at first and then more at a time, until there are
    enough: a frequent query reads little, a rare one all, in few steps. The answer, of 201 rows
    at most, is a local table.
    """
    paths = asks_for_paths(query)
    found, done, step = [], 0, FIRST_RANGES
    schema = "target int, path string, line int, text string"
    while done < len(parts) and len(found) <= limit:
        own = files.where(F.col("part").isin(parts[done : done + step]))
        if paths:
            hits = own.where(F.contains("path", F.lit(query.replace("\\", "/")))).select("target", "path", F.lit(None).cast("int").alias("line"), F.col("path").alias("text"))
        else:
            hits = content_matches(own.select(F.struct("target", "path").alias("path"), "text"), query).select("path.*", "line", "text")
        found += hits.orderBy("target", "path", "line").limit(limit + 1 - len(found)).collect()
        done, step = done + step, step * MORE_RANGES
    return files.sparkSession.createDataFrame(found, schema)
