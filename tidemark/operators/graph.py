"""A graph of symbols as two tables, nodes (id, path, line_start, line_end ...) and edges (from_id, to_id, relation ...)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.text import excerpt, joined_hash, position_score, ranges_overlap
from tidemark.operators.budgets import prefix_within

HOPS, DECAY, MOST_NODES = 2, 0.72, 400
NODE_CAP, EDGE_CAP = 20_000, 50_000
#: Hits that seed a walk, lines of a node and of an edge that are shown, bytes of a stored shard.
MOST_SEEDS, NODE_LINES, EDGE_LINES, SHARD_BYTES = 64, 60, 20, 24 << 20
#: Lengths of a stored graph's texts, and what a file's hash looks like.
LENGTHS, HASH = {"name": 1024, "full_name": 4096, "signature": 8192, "path": 4096, "relation": 128}, "^[a-f0-9]{64}$"


def with_node_id(nodes: DataFrame) -> DataFrame:
    """``nodes`` (language, full_name, signature, path, line_start, line_end) with ``id``; name and kind don't enter it."""
    return nodes.withColumn("id", joined_hash("language", "full_name", "signature", "path", "line_start", "line_end"))


def with_edge_id(edges: DataFrame) -> DataFrame:
    return edges.withColumn("id", joined_hash("language", "relation", "from_id", "to_id", "ev_path", "ev_line_start", "ev_line_end", "ev_file_hash"))


def first_edges(edges: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One edge for each value of ``keys``, the first by ``order``, all columns; counted before rows are shuffled, so a frequent key costs a row a task."""
    rest = [c for c in edges.columns if c not in keys]
    best = F.min_by(F.struct(*rest), F.struct(*order)).alias("first")
    return edges.groupBy(*keys).agg(best).select(*keys, "first.*").select(*edges.columns)


def capped(nodes: DataFrame, edges: DataFrame, order: list[str], cap: int = NODE_CAP, edge_cap: int = EDGE_CAP) -> tuple[DataFrame, DataFrame]:
    """The first ``cap`` nodes by ``order`` and id, and the first edges between them, by ends; a shard of a stored graph has no more."""
    kept = nodes.orderBy(*order, "id").limit(cap)
    ends = kept.select("id")
    inside = edges.join(ends.withColumnRenamed("id", "from_id"), "from_id", "left_semi").join(ends.withColumnRenamed("id", "to_id"), "to_id", "left_semi")
    return kept, inside.orderBy("from_id", "to_id").limit(edge_cap)


def seed_nodes(seeds: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, score): the nodes whose lines overlap those of a seed (path, line_start, line_end, score) on the same path, with the best score."""
    s = seeds.select("path", F.col("line_start").alias("s0"), F.col("line_end").alias("s1"), "score")
    both = s.join(nodes.select("path", F.col("line_start").alias("n0"), F.col("line_end").alias("n1"), F.col("id").alias("node")), "path")
    return both.where(ranges_overlap("s0", "s1", "n0", "n1")).groupBy("node").agg(F.max("score").alias("score"))


def expand(seeds: DataFrame, edges: DataFrame, hops: int = HOPS, decay: float = DECAY) -> DataFrame:
    """(node, score, hop): the best score that a walk of up to ``hops`` edges, either way, brings from a seed (node, score), each edge keeping ``decay`` of it; ``hop`` is the least length that does.

    Each hop is one join with the edges, and scores are reduced to one for each node before the next.
    """
    ends = edges.select(F.col("from_id").alias("node"), F.col("to_id").alias("next")).union(edges.select("to_id", "from_id"))
    front = seeds.groupBy("node").agg(F.max("score").alias("score"))
    found = front.withColumn("hop", F.lit(0))
    for hop in range(1, hops + 1):
        front = front.join(ends, "node").groupBy(F.col("next").alias("node")).agg((F.max("score") * decay).alias("score"))
        found = found.union(front.withColumn("hop", F.lit(hop)))
    best = F.max(F.struct("score", (-F.col("hop")).alias("back")))
    return found.groupBy("node").agg(best.alias("b")).select("node", "b.score", (-F.col("b.back")).alias("hop"))


def merge_candidates(semantic: DataFrame, graph: DataFrame, limit: int) -> DataFrame:
    """Both tables (path, line_start, line_end, score, kind) as one, best first, a place once; ``limit`` and one more."""
    order = [F.col("score").desc(), F.col("path"), F.col("line_start")]
    both = semantic.unionByName(graph)
    one = both.withColumn("_n", F.row_number().over(Window.partitionBy("path", "line_start", "line_end").orderBy(*order, "kind"))).where("_n = 1").drop("_n")
    return one.orderBy(*order, "line_end").limit(limit + 1)


def trace(edges: DataFrame, symbol, direction: str, limit: int) -> DataFrame:
    """Edges that lead to the symbol (callers; any other direction but callees) or from it, by their evidence, ``limit`` and one more."""
    side = {"callers": "to_id", "callees": "from_id"}[direction] if direction in ("callers", "callees") else "from_id"
    own = edges.where(F.col(side) == F.lit(symbol))
    if direction not in ("callers", "callees"):
        own = own.where(F.col("relation") == direction)
    return own.orderBy("ev_path", "ev_line", "relation", "from_id", "to_id").limit(limit + 1)


def match_symbols(nodes: DataFrame, query: str) -> DataFrame:
    """Nodes that a name means: with a bracket those of that signature, with a dot those of that full name, or, where there are none, those that end in it after a dot; else those of that simple name.

    One pass ranks nodes and keeps the best rank: only the nodes that match at all are looked at again.
    """
    if "(" in query or "." in query:
        own = F.col("signature" if "(" in query else "full_name")
        rank = F.when(own == query, 0).when(own.endswith(f".{query}"), 1)
        found = nodes.withColumn("_rank", rank).where("_rank IS NOT NULL")
        return found.withColumn("_best", F.min("_rank").over(Window.partitionBy())).where("_rank = _best").drop("_rank", "_best")
    return nodes.where(F.col("name") == query)


def _too_long(name: str, most: int) -> F.Column:
    return F.col(name).isNull() | ~F.length(name).between(1, most)


def violations(nodes: DataFrame, edges: DataFrame, allowed: DataFrame | None = None) -> DataFrame:
    """(kind, id, path, rule): what keeps nodes and edges from being stored, a row for each rule that one breaks.

    A node without a path has no lines and no hash. Others, and all edges, lie in a file of
    ``allowed`` (path; all files if None), at lines in order from 1 on, with a SHA-256 of the file.
    Names and relations have lengths from 1 on; ids and ends aren't null. An edge's id is its two
    ends. Rows are told by one join with the allowed paths, each path once.
    """
    known = None if allowed is None else allowed.select(F.col("path").alias("_known")).where("_known IS NOT NULL").distinct()

    def broken(rows: DataFrame, kind: str, path: str, start: str, end: str, ident, rules: dict) -> DataFrame:
        lies = F.col(path).isNotNull()
        inside = rows.withColumn("_known", F.col(path)) if known is None else rows.join(known, rows[path] == known["_known"], "left")
        at, to, file_hash = F.col(start), F.col(end), F.col("file_hash")
        in_order = F.coalesce((at >= 1) & (to >= at), F.lit(False))
        every = {
            "allowed path": lies & F.col("_known").isNull(), "lines": lies & ~in_order, "hash": lies & ~F.coalesce(file_hash.rlike(HASH), F.lit(False)),
            "length of path": lies & ~F.length(path).between(1, LENGTHS["path"]), **rules,
        }
        told = F.filter(F.array(*[F.when(c, F.lit(rule)) for rule, c in every.items()]), lambda x: x.isNotNull())
        return inside.select(F.lit(kind).alias("kind"), ident.alias("id"), F.col(path).alias("path"), F.explode(told).alias("rule"))

    rules = {"id": F.col("id").isNull(), "no path": F.col("path").isNull() & (F.col("line_start").isNotNull() | F.col("line_end").isNotNull() | F.col("file_hash").isNotNull())}
    rules |= {f"length of {c}": _too_long(c, LENGTHS[c]) for c in ("name", "full_name", "signature") if c in nodes.columns}
    found = broken(nodes, "node", "path", "line_start", "line_end", F.col("id").cast("string"), rules)
    rules = {"ends": F.col("from_id").isNull() | F.col("to_id").isNull(), "path": F.col("ev_path").isNull(), "length of relation": _too_long("relation", LENGTHS["relation"])}
    ends = F.concat_ws(" ", F.coalesce(F.col("from_id").cast("string"), F.lit("")), F.coalesce(F.col("to_id").cast("string"), F.lit("")))
    return found.union(broken(edges, "edge", "ev_path", "ev_line", last_line(edges), ends, rules))


def last_line(edges: DataFrame) -> str:
    return "ev_line_end" if "ev_line_end" in edges.columns else "ev_line"


def shard(nodes: DataFrame, edges: DataFrame, order: list[str], node_bytes: str, edge_bytes: str, budget: int = SHARD_BYTES, cap: int = NODE_CAP, edge_cap: int = EDGE_CAP) -> tuple[DataFrame, DataFrame]:
    """``capped`` nodes and edges that fit in ``budget`` bytes together: nodes go first, by id, and edges, by ends, into what they leave. The columns named say a row's bytes."""
    nodes, edges = capped(nodes, edges, order, cap, edge_cap)
    used = nodes.agg(F.coalesce(F.sum(node_bytes), F.lit(0)).alias("_used"))
    kept = prefix_within(nodes, ["id"], node_bytes, budget, cap)
    return kept, prefix_within(edges, ["from_id", "to_id"], edge_bytes, budget, edge_cap, used=used)


def within_shard(nodes: DataFrame, edges: DataFrame, size: str, budget: int = SHARD_BYTES, cap: int = NODE_CAP, edge_cap: int = EDGE_CAP) -> tuple[DataFrame, DataFrame]:
    """What a stored graph of one language keeps: the first nodes by id, an id once, the first edges by ends, relation and evidence, and of these the prefixes that fit in ``budget`` bytes, nodes first. The column ``size`` says a row's bytes."""
    nodes = nodes.dropDuplicates(["id"])
    kept = prefix_within(nodes, ["id"], size, budget, cap)
    used = kept.agg(F.coalesce(F.sum(size), F.lit(0)).alias("_used"))
    keys = ["from_id", "to_id", "relation", "ev_path", "ev_line"]
    return kept, prefix_within(edges.dropDuplicates(keys), keys, size, budget, edge_cap, used=used)


def totals(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(language, nodes, edges): how many of each a graph has."""
    count = lambda own, other, x: x.groupBy("language").agg(F.count("*").alias(own)).withColumn(other, F.lit(0).cast("long"))
    both = count("nodes", "edges", nodes).unionByName(count("edges", "nodes", edges))
    return both.groupBy("language").agg(F.sum("nodes").alias("nodes"), F.sum("edges").alias("edges"))


def _held(rows: DataFrame, files: DataFrame, path: str, line: str) -> DataFrame:
    f = files.select(F.col("path").alias("_path"), F.col("file_hash").alias("_hash"), F.col("n_lines").alias("_n"))
    return rows.join(f, (rows[path] == f["_path"]) & (rows["file_hash"] == f["_hash"]) & (rows[line] <= f["_n"]), "left_semi")


def told_fresh(rows: DataFrame, files: DataFrame, path: str, line: str, name: str) -> DataFrame:
    """``rows`` with a boolean ``name``: whether their file is as it was and as long as they reach. ``files`` (path, file_hash, n_lines) have a path once."""
    f = files.select(F.col("path").alias("_path"), F.col("file_hash").alias("_hash"), F.col("n_lines").alias("_n"))
    same = (rows[path] == f["_path"]) & (rows["file_hash"] == f["_hash"]) & (rows[line] <= f["_n"])
    return rows.join(f, same, "left").withColumn(name, F.col("_path").isNotNull()).drop("_path", "_hash", "_n")


def fresh_nodes(nodes: DataFrame, files: DataFrame) -> DataFrame:
    """The nodes whose file is as it was and as long as they reach; ``files`` (path, file_hash, n_lines) are the current ones. Nodes without path, hash or end go."""
    return _held(nodes, files, "path", "line_end")


def fresh_edges(edges: DataFrame, files: DataFrame, nodes: DataFrame) -> DataFrame:
    """The edges whose evidence still holds and whose ends are both in ``nodes``."""
    ends = nodes.select("id")
    own = _held(edges, files, "ev_path", last_line(edges))
    return own.join(ends.withColumnRenamed("id", "from_id"), "from_id", "left_semi").join(ends.withColumnRenamed("id", "to_id"), "to_id", "left_semi").select(*edges.columns)


def with_excerpts(rows: DataFrame, files: DataFrame, path: str, start: str, end: str, most: int) -> DataFrame:
    """``rows`` with ``text``, their first ``most`` lines in ``files`` (path, text)."""
    f = files.select(F.col("path").alias("_path"), F.col("text").alias("_text"))
    return rows.join(f, rows[path] == f["_path"]).withColumn("text", excerpt("_text", start, end, most)).drop("_path", "_text")


def seed_scores(hits: DataFrame, order: list, most: int = MOST_SEEDS) -> DataFrame:
    """The first ``most`` hits (path, line_start, line_end, score) by ``order``, those without a score scored by their rank."""
    first = hits.orderBy(*order).limit(most)
    ranked = first.withColumn("_rank", F.row_number().over(Window.orderBy(*order)))  # ``most`` rows
    return ranked.withColumn("score", position_score("score", "_rank")).drop("_rank")
