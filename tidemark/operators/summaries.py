"""Summaries of a graph by folders: which module holds which node and edge, stored as locators that are checked again before they are shown."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.text import joined_hash
from tidemark.operators import hierarchy
from tidemark.operators.graph import EDGE_CAP, NODE_CAP, last_line

#: A locator's own columns, and those that an edge has besides.
SOURCE, EDGE = ["path", "line_start", "line_end", "file_hash"], ["relation", "from_id", "to_id"]


def locators(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(kind, id, path, line_start, line_end, file_hash, relation, from_id, to_id): where nodes and edges lie, the first of each by id as many as a stored graph has, an id once.

    Nodes without a path, lines in order or a hash have no place. An edge's id is a hash of its
    relation, ends and evidence.
    """
    none = [F.lit(None).cast("string").alias(c) for c in EDGE]
    n = nodes.select(F.lit("node").alias("kind"), F.col("id").cast("string").alias("id"), *SOURCE, *none)
    last = F.col(last_line(edges))
    own = joined_hash("relation", "from_id", "to_id", "ev_path", "ev_line", last, "file_hash")
    e = edges.select(F.lit("edge").alias("kind"), own.alias("id"), F.col("ev_path").alias("path"), F.col("ev_line").alias("line_start"), last.alias("line_end"), "file_hash", *[F.col(c).cast("string").alias(c) for c in EDGE])

    def first(rows, most):
        placed = rows.where("path IS NOT NULL AND file_hash IS NOT NULL AND line_end >= line_start AND id IS NOT NULL")
        rest = [c for c in rows.columns if c != "id"]
        return placed.groupBy("id").agg(F.min(F.struct(*rest)).alias("x")).orderBy("id").limit(most).select("x.kind", "id", *[f"x.{c}" for c in rest[1:]])

    return first(n, NODE_CAP).union(first(e, EDGE_CAP))


def summary(nodes: DataFrame, edges: DataFrame, roots: list[str], budget: int = hierarchy.SUMMARY_BYTES) -> tuple[DataFrame, DataFrame]:
    """(modules, members): the tree of folders of a graph's locators, and each locator with its ``module``, as many as fit in ``budget`` bytes."""
    found = locators(nodes, edges)
    modules = hierarchy.tree(found, roots)
    return modules, within_budget(hierarchy.placed(found, modules, roots), modules, budget)


def _bytes(*columns) -> F.Column:
    return F.octet_length(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}))


def budget_bytes(members: DataFrame, modules: DataFrame) -> DataFrame:
    """``members`` with ``total``: the bytes of the modules as JSON, with all members up to this one, by module, kind and id.

    A module is an object of its id, parent_id, kind and path, and lists of its nodes, edges and
    sources. Sources are the different places of its members, so a place costs bytes where it
    first occurs in a module, and later members there cost only their own. Members are 70,000 at
    most, so their bytes are summed in one task.
    """
    empty = _bytes("id", "parent_id", "kind", "path", *[F.array().cast("array<string>").alias(x) for x in ("nodes", "edges", "sources")])
    frame = modules.agg((F.sum(empty) + F.count("*") - 1 + len('{"modules":[]}')).alias("_frame"))
    place = [F.col(c) for c in SOURCE]
    own = F.when(F.col("kind") == "node", _bytes("id", *place)).otherwise(_bytes("id", *EDGE, F.struct(*place).alias("evidence")))
    order = ["kind", "id"]
    nth = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    comma = F.when(nth("module", "kind") > 1, 1).otherwise(0)
    source = F.when(nth("module", *SOURCE) == 1, _bytes(*place) + F.when(nth("module") > 1, 1).otherwise(0)).otherwise(0)
    so_far = F.sum("_own").over(Window.orderBy("module", *order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    sized = members.withColumn("_own", own + comma + source).withColumn("_sum", so_far)
    return sized.crossJoin(F.broadcast(frame)).withColumn("total", F.col("_sum") + F.col("_frame")).drop("_own", "_sum", "_frame")  # one row


def within_budget(members: DataFrame, modules: DataFrame, budget: int = hierarchy.SUMMARY_BYTES) -> DataFrame:
    """The longest prefix of ``members`` by module, kind and id that with all ``modules`` takes ``budget`` bytes at most."""
    return budget_bytes(members, modules).where(F.col("total") <= budget).drop("total")


def held(members: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The members whose locator, all of it, a node or edge of ``nodes`` and ``edges`` still has; these are fresh ones, say those that a search has reached.

    A member that is only named alike, or lies elsewhere by now, goes; so does an edge one of whose ends isn't in ``nodes``.
    """
    now = locators(nodes, edges)
    same = [members[c].eqNullSafe(now[c]) for c in ("kind", *SOURCE, *EDGE)]
    on = members["id"] == now["id"]
    for c in same:
        on = on & c
    own = members.join(now, on, "left_semi")
    ends = nodes.select(F.col("id").cast("string").alias("_end"))
    both = own.where("kind = 'edge'").join(ends.withColumnRenamed("_end", "from_id"), "from_id", "left_semi").join(ends.withColumnRenamed("_end", "to_id"), "to_id", "left_semi")
    return own.where("kind = 'node'").unionByName(both)


def member_totals(members: DataFrame) -> dict:
    """How many nodes, edges and different sources a summary has; a source counts once in a module."""
    sources = F.count_distinct("module", *SOURCE).alias("sources")
    return members.agg(F.count(F.when(F.col("kind") == "node", 1)).alias("nodes"), F.count(F.when(F.col("kind") == "edge", 1)).alias("edges"), sources).first().asDict()


def stale_places(members: DataFrame, files: DataFrame) -> DataFrame:
    """The different places of members that no file of ``files`` (path, file_hash, n_lines) has any more."""
    f = files.select(F.col("path").alias("_path"), F.col("file_hash").alias("_hash"), F.col("n_lines").alias("_n"))
    places = members.select(*SOURCE).distinct()
    return places.join(f, (places["path"] == f["_path"]) & (places["file_hash"] == f["_hash"]) & (places["line_end"] <= f["_n"]), "left_anti")
