"""Queries over the driver's tables, and DuckDB SQL for the same rows.

Tables stand in for what the engine keeps: ``documents`` for files, ``embeddings`` for vectors,
``pages`` for paths and assets, ``lineitem`` for edges and for what commits changed, ``events`` for
file events, ``conversations`` for queries and notes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import routing, text
from tidemark.operators import budgets, bursts, chunking, exact, graph, hierarchy, retrieval, snapshots
from tidemark.plans import stored
from tidemark.sources import files as sources
from tidemark.sources import globs

PHRASE = "of the"
#: Globs of what a project leaves out.
EXCLUDES = ["**/{fr,de}/[1-4]*", "blog.*/**", "/m.*/*/?", "es/"]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _files(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), "text")


def exact_content(spark, sf_dir):
    return exact.content_matches(_files(spark, sf_dir), PHRASE)


def exact_topk(spark, sf_dir):
    return exact.first_matches(exact_content(spark, sf_dir), 50)


def path_match(spark, sf_dir):
    return exact.path_matches(_table(spark, sf_dir, "pages"), "/en/", path_col="url").select(F.col("path").alias("url"))


def content_hash(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", text.content_hash("text").alias("hash"))


def bounded_read(spark, sf_dir):
    return exact.bounded_read(_files(spark, sf_dir), 3, 12)


def chunk_pack(spark, sf_dir):
    out = chunking.chunk_files(_table(spark, sf_dir, "documents"), path_col="doc_id")
    return out.select(F.col("path").cast("long").alias("doc_id"), "ordinal", "line_start", "line_end", F.length("text").alias("n_chars"), text.content_hash("text").alias("hash"))


def _found(spark, sf_dir, rests, k):
    """(query, vec_id, score, label): the ``k`` vectors nearest to each whose id has one of the ``rests`` by 100."""
    v = _table(spark, sf_dir, "embeddings")
    hits = retrieval.nearest_of_each(v, v.where((F.col("vec_id") % 100).isin(*rests)), k, id_col="vec_id")
    return hits.join(v.select("vec_id", "label"), "vec_id")


def _first_labels(hits):
    """One hit for each label of a query, and its rank among these."""
    order = [F.col("score").desc(), F.col("vec_id")]
    one = hits.withColumn("_n", F.row_number().over(Window.partitionBy("query", "label").orderBy(*order))).where("_n = 1").drop("_n")
    return one.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(*order)))


def vector_topk_each(spark, sf_dir):
    return _found(spark, sf_dir, [0], 20).select("query", "vec_id", F.round("score", 6).alias("score"))


def vector_dedup_each(spark, sf_dir):
    hits = _first_labels(_found(spark, sf_dir, [0], retrieval.overfetch(20)))
    return hits.select("query", "label", "vec_id", "rank", F.round("score", 6).alias("score"))


def rrf_fuse_each(spark, sf_dir):
    """Each query's list of labels fused with that of the vector after it."""
    ranked = _first_labels(_found(spark, sf_dir, [0, 1], 160)).withColumn("list", (F.col("query") % 100).cast("int"))
    ranked = ranked.withColumn("query", F.col("query") - F.col("list"))
    fused = ranked.groupBy("query", "label").agg(F.sum(1.0 / (retrieval.RANK_OFFSET + F.col("rank"))).alias("score"), F.min(F.struct("list", "rank")).alias("first"))
    return fused.select("query", "label", F.round("score", 9).alias("score"), "first.list", "first.rank")


def _states(spark, sf_dir):
    """Labelled documents as they were indexed, and all documents now, with runs of white space made one space."""
    docs = _table(spark, sf_dir, "documents")
    old = docs.join(_table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_semi").select("doc_id", "text")
    now = docs.select("doc_id", F.regexp_replace("text", r"[\n ]+", " ").alias("text"))
    return old, now


def index_diff(spark, sf_dir):
    old, now = (x.select("doc_id", text.content_hash("text").alias("hash")) for x in _states(spark, sf_dir))
    return snapshots.diff(old, now, path_col="doc_id")


def run_totals(spark, sf_dir):
    out = snapshots.run_totals(index_diff(spark, sf_dir).withColumnRenamed("doc_id", "path"))
    return out.select("seen", "unchanged", "changed", "new", "deleted", F.array_join("sample", ",").alias("sample"))


def _line_ids(docs):
    each = docs.select("doc_id", F.posexplode(text.lines("text")).alias("i", "line"))
    return each.select(text.joined_hash("doc_id", F.col("i") + 1, "line").alias("id"))


def stale_ids(spark, sf_dir):
    old, now = _states(spark, sf_dir)
    return snapshots.stale(_line_ids(old), _line_ids(now))


def fresh_hits(spark, sf_dir):
    old, now = (x.select("doc_id", text.content_hash("text").alias("hash")) for x in _states(spark, sf_dir))
    return snapshots.fresh(old, now, ["doc_id", "hash"])


def _edges(spark, sf_dir):
    """Suppliers' parts by return flag as edges with evidence."""
    return _table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("s"), F.col("l_suppkey")).alias("from_id"), F.concat(F.lit("p"), F.col("l_partkey")).alias("to_id"), F.col("l_returnflag").alias("relation"),
        F.col("l_orderkey").alias("ev_path"), F.col("l_linenumber").alias("ev_line"),
    )


def edge_dedup(spark, sf_dir):
    return graph.first_edges(_edges(spark, sf_dir), ["from_id", "to_id", "relation"], ["ev_path", "ev_line"])


def node_cap(spark, sf_dir):
    """The nodes with the most edges, and the edges between them."""
    pairs = _edges(spark, sf_dir).select("from_id", "to_id").distinct()
    nodes = pairs.select(F.explode(F.array("from_id", "to_id")).alias("id")).groupBy("id").agg(F.count("*").alias("degree"))
    return graph.capped(nodes, pairs, [F.col("degree").desc()])[1]


def callers(spark, sf_dir):
    return graph.trace(_edges(spark, sf_dir), "p7", "callers", 100)


def callees(spark, sf_dir):
    return graph.trace(_edges(spark, sf_dir), "s3", "callees", 200)


def seed_overlap(spark, sf_dir):
    """Chunks that hold the phrase are seeds; lines that hold another one are symbols of two lines."""
    docs = _table(spark, sf_dir, "documents")
    seeds = chunking.chunk_files(docs, path_col="doc_id").where(F.contains("text", F.lit(PHRASE))).withColumn("score", 1.0 / (F.lit(60) + F.col("ordinal")))
    each = docs.select(F.col("doc_id").cast("string").alias("path"), F.posexplode(text.lines("text")).alias("i", "line")).where(F.contains("line", F.lit("tion")))
    nodes = each.select("path", (F.col("i") + 1).alias("line_start"), (F.col("i") + 2).alias("line_end"), F.concat_ws(":", "path", F.col("i") + 1).alias("id"))
    return graph.seed_nodes(seeds, nodes).select("node", F.round("score", 9).alias("score"))


def _order_graph(spark, sf_dir):
    top = _table(spark, sf_dir, "orders").orderBy(F.col("o_totalprice").desc(), "o_orderkey").limit(64)
    seeds = top.select(F.concat(F.lit("o"), F.col("o_orderkey")).alias("node"), (F.col("o_totalprice") / 1e6).alias("score"))
    edges = _table(spark, sf_dir, "lineitem").select(F.concat(F.lit("o"), F.col("l_orderkey")).alias("from_id"), F.concat(F.lit("p"), F.col("l_partkey")).alias("to_id"))
    return seeds, edges.distinct()


def expand_2hop(spark, sf_dir):
    return graph.expand(*_order_graph(spark, sf_dir)).select("node", F.round("score", 9).alias("score"), "hop")


def graphrag_merge(spark, sf_dir):
    """Expanded nodes and what is nearest to any query vector as one list of places."""
    place = lambda x, path, score, kind: x.select(path.alias("path"), F.lit(1).alias("line_start"), F.lit(2).alias("line_end"), F.round(score, 6).alias("score"), F.lit(kind).alias("kind"))
    found = place(graph.expand(*_order_graph(spark, sf_dir)), F.col("node"), F.col("score"), "graph")
    near = place(vector_topk_each(spark, sf_dir).groupBy("vec_id").agg(F.max("score").alias("score")), F.concat(F.lit("v"), F.col("vec_id")), F.col("score"), "semantic")
    return graph.merge_candidates(near, found, 50)


def hierarchy_modules(spark, sf_dir):
    paths = _table(spark, sf_dir, "pages").select(F.regexp_replace(F.regexp_replace("url", "^https?://", ""), "[?#].*$", "").alias("path"))
    return hierarchy.modules(paths)


def cochange(spark, sf_dir):
    files = _table(spark, sf_dir, "lineitem").join(_table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    files = files.select(F.col("l_orderkey").alias("commit"), F.col("l_partkey").alias("path"), F.col("o_orderdate").alias("changed_at"))
    return hierarchy.cochange(files, 7).select("path", "count", "last_changed_at", F.array_join("commits", ",").alias("commits"))


def link_extract(spark, sf_dir):
    links = F.regexp_extract_all("html", F.lit('href="([^"]*)"'), 1)
    return _table(spark, sf_dir, "pages").select("page_id", F.posexplode(links).alias("ordinal", "link"))


def _queries(spark, sf_dir):
    said = _table(spark, sf_dir, "conversations").select(F.concat_ws("-", F.lit("c"), "conv_id", "turn").alias("id"), "text")
    return said.union(_table(spark, sf_dir, "benchmark").select(F.concat_ws("-", F.lit("b"), "item_id"), "text"))


def route_query(spark, sf_dir):
    return _queries(spark, sf_dir).select("id", routing.route("text").alias("r")).select("id", "r.*")


def identifiers(spark, sf_dir):
    return _queries(spark, sf_dir).select("id", routing.identifiers("text").alias("identifiers"))


def coalesce_bursts(spark, sf_dir):
    return bursts.coalesce_bursts(_table(spark, sf_dir, "events"), 6 * 3600)


#: Folders of pages that are roots of the tree.
ROOTS = [".", "www.cheap-pills.example.com", "www.cheap-pills.example.com/en"]


def _page_paths(spark, sf_dir, *more):
    return _table(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("id"), F.regexp_replace(F.regexp_replace("url", "^https?://", ""), "[?#].*$", "").alias("path"), *more)


def _members(spark, sf_dir):
    """Pages as nodes and, those in English, as evidence of edges, in the tree of their paths."""
    pages = _page_paths(spark, sf_dir, F.contains("html", F.lit('lang="en"')).alias("english"))
    modules = hierarchy.tree(pages, ROOTS)
    return modules, hierarchy.members(pages, pages.where("english"), modules, ROOTS)


def module_tree(spark, sf_dir):
    return hierarchy.tree(_page_paths(spark, sf_dir), ROOTS)


def module_ancestors(spark, sf_dir):
    return hierarchy.ancestors(module_tree(spark, sf_dir))


def module_members(spark, sf_dir):
    return _members(spark, sf_dir)[1].select("module", "kind", "id")


def module_counts(spark, sf_dir):
    return hierarchy.member_counts(_members(spark, sf_dir)[1])


def summary_bytes(spark, sf_dir):
    """Members of modules that fit in 8 KiB."""
    held = _members(spark, sf_dir)[1].withColumn("size", F.octet_length(F.concat("module", "kind", "id", "path")))
    return hierarchy.within_bytes(held, "size", 8192).select("module", "kind", "id")


def summary_shown(spark, sf_dir):
    """The modules that an answer with all members shows."""
    return hierarchy.shown(*_members(spark, sf_dir))


def assembly_names(spark, sf_dir):
    """Pages under the folders of English pages."""
    pages = _page_paths(spark, sf_dir, F.contains("html", F.lit('lang="en"')).alias("english"))
    stated = pages.where("english").select(text.parent_directory("path").alias("directory"), F.concat(F.lit("A"), "id").alias("name"))
    return hierarchy.assembly_of(pages.select("id", "path"), stated)


def byte_budget(spark, sf_dir):
    """Edges of a shard of 256 KiB."""
    pairs = _edges(spark, sf_dir).select("from_id", "to_id").distinct()
    nodes = pairs.select(F.explode(F.array("from_id", "to_id")).alias("id")).groupBy("id").agg(F.count("*").alias("degree"))
    edges = pairs.withColumn("bytes", F.octet_length("from_id") + F.octet_length("to_id"))
    own, kept = graph.shard(nodes.withColumn("bytes", F.octet_length("id")), edges, [F.col("degree").desc()], "bytes", "bytes", 256 << 10)
    return kept.select("from_id", "to_id").union(own.select("id", F.lit(None)))


def greedy_budget(spark, sf_dir):
    """Documents as files of two kinds, taken by path while they fit in 1 MiB."""
    docs = _table(spark, sf_dir, "documents")
    files = docs.select(F.col("doc_id").cast("string").alias("path"), F.when(F.col("lang") == "en", "source").otherwise("auxiliary").alias("kind"), F.octet_length("text").alias("size"))
    return budgets.graph_inputs(files, 1 << 20)


def graph_totals(spark, sf_dir):
    edges = _edges(spark, sf_dir).withColumnRenamed("relation", "language")
    return graph.totals(edges.select("language", F.col("to_id").alias("id")).distinct(), edges)


def _rewritten(spark, sf_dir):
    """Documents as they were, as files, and as they are, where a phrase has changed."""
    docs = _files(spark, sf_dir).where("text IS NOT NULL")
    files = lambda t: docs.select(F.col("path").cast("string").alias("path"), t.alias("text")).select("path", "text", text.content_hash("text").alias("file_hash"), F.size(text.lines("text")).alias("n_lines"))
    return files(F.col("text")), files(F.regexp_replace("text", PHRASE, "of a"))


def _marked(old):
    each = old.select("path", "file_hash", "n_lines", F.posexplode(text.lines("text")).alias("i", "line")).where(F.contains("line", F.lit("tion")))
    return each.select("path", "file_hash", "n_lines", (F.col("i") + 1).alias("line_start"), F.concat_ws(":", "path", F.col("i") + 1).alias("id"))


def fresh_trace(spark, sf_dir):
    """Edges between neighbouring lines that hold a syllable, in documents that are as they were, with what lies there."""
    old, now = _rewritten(spark, sf_dir)
    marked = _marked(old)
    after = Window.partitionBy("path").orderBy("line_start")
    edges = marked.select(F.col("id").alias("from_id"), F.lead("id").over(after).alias("to_id"), F.col("path").alias("ev_path"), F.col("line_start").alias("ev_line"), F.lead("line_start").over(after).alias("ev_line_end"), "file_hash")
    nodes = graph.fresh_nodes(marked.withColumn("line_end", F.col("line_start")), now)
    held = graph.fresh_edges(edges.where("to_id IS NOT NULL"), now, nodes)
    return graph.with_excerpts(held, now, "ev_path", "ev_line", "ev_line_end", graph.EDGE_LINES).select("from_id", "to_id", "ev_path", "ev_line", text.content_hash("text").alias("hash"))


def node_excerpts(spark, sf_dir):
    """From the first line with a syllable to the end of each document that is as it was."""
    old, now = _rewritten(spark, sf_dir)
    nodes = _marked(old).groupBy("path", "file_hash", F.col("n_lines").alias("line_end")).agg(F.min("line_start").alias("line_start"))
    shown = graph.with_excerpts(graph.fresh_nodes(nodes, now), now, "path", "line_start", "line_end", graph.NODE_LINES)
    return shown.select("path", "line_start", "line_end", text.content_hash("text").alias("hash"))


def seeds_capped(spark, sf_dir):
    """The first hits are seeds, those without a score by their rank; symbols as in ``seed_overlap``."""
    docs = _table(spark, sf_dir, "documents")
    hits = chunking.chunk_files(docs, path_col="doc_id").where(F.contains("text", F.lit(PHRASE))).withColumn("score", F.when(F.col("ordinal") > 0, 1.0 / F.col("ordinal")))
    seeds = graph.seed_scores(hits.select("path", "ordinal", "line_start", "line_end", "score"), ["path", "ordinal"])
    each = docs.select(F.col("doc_id").cast("string").alias("path"), F.posexplode(text.lines("text")).alias("i", "line")).where(F.contains("line", F.lit("tion")))
    nodes = each.select("path", (F.col("i") + 1).alias("line_start"), (F.col("i") + 2).alias("line_end"), F.concat_ws(":", "path", F.col("i") + 1).alias("id"))
    return graph.seed_nodes(seeds, nodes).select("node", F.round("score", 9).alias("score"))


def symbol_match(spark, sf_dir):
    """Parts as symbols, and what a simple name, a full name's end and a signature's end mean."""
    full = F.concat_ws(".", "p_brand", "p_type", "p_name")
    nodes = _table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("name"), full.alias("full_name"), F.concat(full, F.lit("("), "p_size", F.lit(")")).alias("signature"))
    found = [graph.match_symbols(nodes, q).select(F.lit(q).alias("query"), "p_partkey") for q in ("small ring", "ECONOMY.small ring", "ECONOMY.small ring(11)")]
    return found[0].union(found[1]).union(found[2])


def upsert(spark, sf_dir):
    old, now = _states(spark, sf_dir)
    return snapshots.upsert(old, now.where(F.contains("text", F.lit(PHRASE))), "doc_id").select("doc_id", text.content_hash("text").alias("hash"))


def _page_assets(spark, sf_dir):
    links = F.regexp_extract_all("html", F.lit('href="([^"]*)"'), 1)
    own = _table(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("id"), links.alias("links")).where(F.size("links") > 0)
    line = lambda x: F.concat(F.lit("guid: "), F.md5(x.cast("binary")))
    assets = own.select(F.concat(F.lit("a/"), "id", F.lit(".prefab")).alias("path"), F.array_join(F.transform("links", line), "\n").alias("text"))
    meta = own.select(F.concat(F.lit("m/"), "id", F.lit(".asset.meta")), line(F.get("links", F.lit(0))))
    return own, assets.union(meta)


def asset_links(spark, sf_dir):
    """Pages as assets whose links are references by id; each page's first link is the id of an asset of its own."""
    return sources.asset_references(_page_assets(spark, sf_dir)[1])


def asset_dependencies(spark, sf_dir):
    """Assets as in ``asset_links``, of which each depends on that of the next page, if there is one."""
    own, assets = _page_assets(spark, sf_dir)
    asset = lambda x: F.concat(F.lit("a/"), x.cast("string"), F.lit(".prefab"))
    return sources.asset_references(assets, own.select(asset(F.col("id")).alias("path"), asset(F.col("id").cast("long") + 1).alias("target")))


def classify_paths(spark, sf_dir):
    """Pages' paths by source, as text files or not, and whether two kinds of globs turn them away."""
    paths = _page_paths(spark, sf_dir).select("id", F.concat("path", F.when(F.col("path").endswith("/"), "index.md").otherwise("")).alias("path"))
    own = sources.classified(paths, ["."], ["www.cheap-pills.example.com", "blog.tionsh.example.net/en"])
    return own.select("id", "source", text.is_text_file("path").alias("is_text"), F.col("path").rlike(sources.glob_pattern("**/en/*")).alias("excluded"), F.col("path").rlike(sources.ignore_pattern("fr/")).alias("ignored"))


def excluded_paths(spark, sf_dir):
    """Whether globs with classes, braces and folders turn a page's path away, in either dialect."""
    return _page_paths(spark, sf_dir).select("id", globs.excluded("path", EXCLUDES).alias("excluded"))


def semantic_only(spark, sf_dir):
    """Documents as files of which some code isn't embedded."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("lang") == "en", "code").otherwise("document").alias("source"), F.concat_ws("/", F.col("source").alias("s"), F.col("doc_id")).alias("path"))
    return sources.semantic_files(docs, ["src1/**", "**/*7"]).select("doc_id", "source")


def notes_union(spark, sf_dir):
    """Documents and conversations' turns, as notes, as one table of files."""
    notes = _table(spark, sf_dir, "conversations").select(F.col("role").alias("project_slug"), F.concat_ws("-", "conv_id", "turn").alias("label"), "text")
    files = _table(spark, sf_dir, "documents").select(F.lit("code").alias("source"), F.col("doc_id").cast("string").alias("path"), "text")
    return files.unionByName(sources.notes_as_files(notes)).select("source", "path", text.content_hash("text").alias("hash"))


def project_match(spark, sf_dir):
    """Pages whose folder, in capitals and with backslashes, no other page has."""
    folders = _page_paths(spark, sf_dir).select("id", F.upper(F.replace(text.parent_directory("path"), F.lit("/"), F.lit("\\"))).alias("path"))
    return sources.matching_projects(folders).select("id", "key")


def path_terms(spark, sf_dir):
    return _page_paths(spark, sf_dir).where(text.path_has_term("path", F.lit("Blog x EN/1 pills"))).select("id")


def chunk_sections(spark, sf_dir):
    """Documents as Markdown in which lines with the phrase are headings."""
    heading = lambda x: F.when(F.contains(x, F.lit(PHRASE)), F.concat(F.lit("# "), x)).otherwise(x)
    docs = _table(spark, sf_dir, "documents").select("doc_id", F.concat("doc_id", F.lit(".md")).alias("path"), F.array_join(F.transform(text.lines("text"), heading), "\n").alias("text"))
    return chunking.chunk_files(docs).select("path", "ordinal", "line_start", "line_end", text.content_hash("text").alias("hash"))


QUERIES = {
    "exact_content": exact_content, "exact_topk": exact_topk, "path_match": path_match, "content_hash": content_hash, "bounded_read": bounded_read, "chunk_pack": chunk_pack,
    "index_diff": index_diff, "run_totals": run_totals, "stale_ids": stale_ids,
    "fresh_hits": fresh_hits, "edge_dedup": edge_dedup, "node_cap": node_cap, "callers": callers, "callees": callees, "seed_overlap": seed_overlap, "expand_2hop": expand_2hop,
    "graphrag_merge": graphrag_merge, "hierarchy": hierarchy_modules, "cochange": cochange, "link_extract": link_extract, "route_query": route_query,
    "identifiers": identifiers, "coalesce_bursts": coalesce_bursts, "vector_topk_each": vector_topk_each, "vector_dedup_each": vector_dedup_each, "rrf_fuse_each": rrf_fuse_each,
    "module_tree": module_tree, "module_ancestors": module_ancestors, "module_members": module_members, "module_counts": module_counts, "summary_bytes": summary_bytes,
    "summary_shown": summary_shown, "assembly_names": assembly_names, "byte_budget": byte_budget, "greedy_budget": greedy_budget, "graph_totals": graph_totals, "fresh_trace": fresh_trace,
    "node_excerpts": node_excerpts, "seeds_capped": seeds_capped, "symbol_match": symbol_match, "upsert": upsert, "asset_links": asset_links, "asset_dependencies": asset_dependencies, "classify_paths": classify_paths, "excluded_paths": excluded_paths,
    "semantic_only": semantic_only, "notes_union": notes_union, "project_match": project_match, "path_terms": path_terms, "chunk_sections": chunk_sections,
}

LINES = "SELECT doc_id, CAST(unnest(range(1, len(string_split(text, chr(10))) + 1)) AS INTEGER) AS line, unnest(string_split(text, chr(10))) AS text FROM documents WHERE text IS NOT NULL"
CONTENT = f"SELECT doc_id AS path, line, substr(text, 1, 2000) AS text FROM ({LINES}) WHERE contains(text, '{PHRASE}')"
STATES = r"""
    o AS (SELECT doc_id, text FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)),
    n AS (SELECT doc_id, regexp_replace(text, '[\n ]+', ' ', 'g') AS text FROM documents)
"""
DIFF = f"""
    WITH {STATES}
    SELECT coalesce(n.doc_id, o.doc_id) AS doc_id,
           CASE WHEN o.doc_id IS NULL THEN 'new' WHEN n.doc_id IS NULL THEN 'deleted' WHEN o.text IS NOT DISTINCT FROM n.text THEN 'unchanged' ELSE 'changed' END AS status
    FROM o FULL OUTER JOIN n ON n.doc_id = o.doc_id
"""
LINE_IDS = "SELECT sha256(doc_id || chr(0) || line || chr(0) || text) AS id FROM (SELECT doc_id, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line, unnest(string_split(text, chr(10))) AS text FROM {})"
# Lines of a file are folded one after the other: where the open chunk begins and how long it is.
CHUNKS = f"""
    WITH RECURSIVE l AS MATERIALIZED (
        SELECT doc_id, line, text, length(text) AS k FROM ({LINES})
    ), t AS MATERIALIZED (
        SELECT doc_id, max(line) AS n FROM l GROUP BY doc_id
    ), z AS MATERIALIZED (
        SELECT l.doc_id, CASE WHEN l.text = '' AND t.n > 1 THEN t.n - 1 ELSE t.n END AS n FROM t JOIN l ON l.doc_id = t.doc_id AND l.line = t.n
    ), w AS MATERIALIZED (
        SELECT l.*, sum(k + 1) OVER (PARTITION BY l.doc_id) - 1 AS size FROM l JOIN z ON z.doc_id = l.doc_id AND l.line <= z.n
    ), f AS (
        SELECT doc_id, line, k > 1600 AS cut, CASE WHEN k > 1600 THEN line + 1 ELSE line END AS open_at, CASE WHEN k > 1600 THEN 0 ELSE k END AS held, line AS first FROM w WHERE size > 1600 AND line = 1
        UNION ALL
        SELECT w.doc_id, w.line, w.k > 1600, CASE WHEN w.k > 1600 THEN w.line + 1 WHEN f.held > 0 AND f.held + 1 + w.k > 1600 THEN w.line ELSE f.open_at END,
               CASE WHEN w.k > 1600 THEN 0 WHEN f.held > 0 AND f.held + 1 + w.k > 1600 THEN w.k WHEN f.held > 0 THEN f.held + 1 + w.k ELSE w.k END,
               CASE WHEN w.k > 1600 OR f.held > 0 AND f.held + 1 + w.k > 1600 THEN w.line ELSE f.open_at END
        FROM f JOIN w ON w.doc_id = f.doc_id AND w.line = f.line + 1
    ), p AS (
        SELECT doc_id, 1 AS a, max(line) AS b, 0 AS o, string_agg(text, chr(10) ORDER BY line) AS text FROM w WHERE size <= 1600 GROUP BY doc_id
        UNION ALL
        SELECT f.doc_id, min(f.line), max(f.line), 0, string_agg(w.text, chr(10) ORDER BY f.line) FROM f JOIN w ON w.doc_id = f.doc_id AND w.line = f.line WHERE NOT f.cut GROUP BY f.doc_id, f.first
        UNION ALL
        SELECT doc_id, line, line, unnest(range(0, CAST(ceil(k / 1600) AS BIGINT))), substr(text, 1 + 1600 * unnest(range(0, CAST(ceil(k / 1600) AS BIGINT))), 1600) FROM w WHERE k > 1600 AND size > 1600
    ), c AS (
        SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY a, o) - 1 AS INTEGER) AS ordinal, CAST(a AS INTEGER) AS line_start, CAST(b AS INTEGER) AS line_end, text FROM p WHERE trim(text, chr(10) || chr(9) || ' ') <> ''
    )
"""
# What is nearest to each of many vectors.
NEAR_EACH = """
    SELECT * FROM (
        SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, vec_id) AS place FROM (
            SELECT q.vec_id AS query, e.vec_id, e.label, list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])) AS score FROM embeddings e, embeddings q WHERE q.vec_id % 100 IN ({})
        )
    ) WHERE place <= {}
"""
FIRST_EACH = "SELECT query, label, vec_id, score, row_number() OVER (PARTITION BY query ORDER BY score DESC, vec_id) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query, label ORDER BY score DESC, vec_id) AS n FROM ({})) WHERE n = 1"
EDGES = "SELECT 's' || l_suppkey AS from_id, 'p' || l_partkey AS to_id, l_returnflag AS relation, l_orderkey AS ev_path, l_linenumber AS ev_line FROM lineitem"
EXPAND = """
    WITH e AS (
        SELECT DISTINCT 'o' || l_orderkey AS a, 'p' || l_partkey AS b FROM lineitem
    ), b AS (
        SELECT a, b FROM e UNION ALL SELECT b, a FROM e
    ), h0 AS (
        SELECT 'o' || o_orderkey AS node, o_totalprice / 1e6 AS score FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 64
    ), h1 AS (
        SELECT b.b AS node, max(score) * 0.72::DOUBLE AS score FROM h0 JOIN b ON b.a = node GROUP BY 1
    ), h2 AS (
        SELECT b.b AS node, max(score) * 0.72::DOUBLE AS score FROM h1 JOIN b ON b.a = node GROUP BY 1
    ), x AS (
        SELECT *, 0 AS hop FROM h0 UNION ALL SELECT *, 1 FROM h1 UNION ALL SELECT *, 2 FROM h2
    ), y AS (
        SELECT *, row_number() OVER (PARTITION BY node ORDER BY score DESC, hop) AS n FROM x
    )
"""
PATHS = '''SELECT CAST(page_id AS VARCHAR) AS id, regexp_replace(regexp_replace(url, '^https?://', ''), '[?#].*$', '') AS path, contains(html, 'lang="en"') AS english FROM pages'''
PARENT = "CASE WHEN regexp_replace({0}, '(^|/)[^/]*$', '') = '' THEN '.' ELSE regexp_replace({0}, '(^|/)[^/]*$', '') END"
TREE = f"""
    WITH RECURSIVE paths AS MATERIALIZED (
        SELECT id, path, english, {PARENT.format('path')} AS folder,
               CASE WHEN starts_with(path, 'www.cheap-pills.example.com/en/') THEN 'www.cheap-pills.example.com/en' WHEN starts_with(path, 'www.cheap-pills.example.com/') THEN 'www.cheap-pills.example.com' ELSE '.' END AS root
        FROM ({PATHS})
    ), steps AS MATERIALIZED (
        SELECT DISTINCT folder, root, array_to_string(string_split(folder, '/')[1:i], '/') AS step
        FROM (SELECT DISTINCT folder, root, CASE WHEN root = '.' THEN 0 ELSE len(string_split(root, '/')) END AS depth FROM paths WHERE folder <> '.'), LATERAL (SELECT unnest(range(depth + 1, len(string_split(folder, '/')) + 1)) AS i)
    ), folders AS MATERIALIZED (
        SELECT DISTINCT step AS path, root FROM steps WHERE step NOT IN ('www.cheap-pills.example.com', 'www.cheap-pills.example.com/en') ORDER BY path LIMIT 2044
    ), modules AS MATERIALIZED (
        SELECT * FROM (VALUES ('project', NULL, 'project', NULL), ('root:.', 'project', 'code_root', '.'), ('root:www.cheap-pills.example.com', 'root:.', 'code_root', 'www.cheap-pills.example.com'),
            ('root:www.cheap-pills.example.com/en', 'root:www.cheap-pills.example.com', 'code_root', 'www.cheap-pills.example.com/en')) t(id, parent_id, kind, path)
        UNION ALL
        SELECT 'directory:' || path, CASE WHEN {PARENT.format('path')} IN (root, '.') THEN 'root:' || root ELSE 'directory:' || {PARENT.format('path')} END, 'directory', path FROM folders
    ), deepest AS (
        SELECT folder, root, max(step) AS step FROM steps WHERE step IN (SELECT path FROM folders) GROUP BY ALL
    ), items AS (
        (SELECT 'node' AS kind, id, path, folder, root FROM paths ORDER BY id LIMIT 20000) UNION ALL (SELECT 'edge', id, path, folder, root FROM paths WHERE english ORDER BY id LIMIT 50000)
    ), members AS MATERIALIZED (
        SELECT coalesce('directory:' || step, 'root:' || i.root) AS module, kind, id, i.path FROM items i LEFT JOIN deepest d ON d.folder = i.folder AND d.root = i.root
    ), up AS (
        SELECT id, id AS ancestor, 0 AS steps FROM modules
        UNION ALL SELECT up.id, m.parent_id, up.steps + 1 FROM up JOIN modules m ON m.id = up.ancestor WHERE m.parent_id IS NOT NULL
    )
"""
SECTIONS = r"""
    WITH RECURSIVE l AS MATERIALIZED (
        SELECT doc_id, line, text, length(text) AS k FROM (SELECT doc_id, line, CASE WHEN contains(text, 'PHRASE') THEN '# ' || text ELSE text END AS text FROM (LINES))
    ), t AS MATERIALIZED (
        SELECT doc_id, max(line) AS n FROM l GROUP BY doc_id
    ), z AS MATERIALIZED (
        SELECT l.doc_id, CASE WHEN l.text = '' AND t.n > 1 THEN t.n - 1 ELSE t.n END AS n FROM t JOIN l ON l.doc_id = t.doc_id AND l.line = t.n
    ), w AS MATERIALIZED (
        SELECT l.*, CAST(sum(CASE WHEN line > 1 AND regexp_matches(text, '^#{1,6}\s+\S') THEN 1 ELSE 0 END) OVER (PARTITION BY l.doc_id ORDER BY line) AS BIGINT) AS s FROM l JOIN z ON z.doc_id = l.doc_id AND l.line <= z.n
    ), y AS MATERIALIZED (
        SELECT doc_id, s, min(line) AS a, max(line) AS b, CAST(sum(k + 1) - 1 AS BIGINT) AS size FROM w GROUP BY doc_id, s
    ), g AS (
        SELECT doc_id, s, a, b, size FROM y WHERE s = 0
        UNION ALL
        SELECT y.doc_id, y.s, CASE WHEN y.size <= 1600 AND g.size + 1 + y.size <= 1200 THEN g.a ELSE y.a END, y.b, CASE WHEN y.size <= 1600 AND g.size + 1 + y.size <= 1200 THEN g.size + 1 + y.size ELSE y.size END
        FROM g JOIN y ON y.doc_id = g.doc_id AND y.s = g.s + 1
    ), r AS MATERIALIZED (
        SELECT doc_id, a, max(b) AS b, max(size) AS size FROM g GROUP BY doc_id, a
    ), v AS MATERIALIZED (
        SELECT w.doc_id, w.line, w.text, w.k, r.a, r.size FROM w JOIN r ON r.doc_id = w.doc_id AND w.line BETWEEN r.a AND r.b
    ), f AS (
        SELECT doc_id, a, line, k > 1600 AS cut, CASE WHEN k > 1600 THEN line + 1 ELSE line END AS open_at, CASE WHEN k > 1600 THEN 0 ELSE k END AS held, line AS first FROM v WHERE size > 1600 AND line = a
        UNION ALL
        SELECT v.doc_id, v.a, v.line, v.k > 1600, CASE WHEN v.k > 1600 THEN v.line + 1 WHEN f.held > 0 AND f.held + 1 + v.k > 1600 THEN v.line ELSE f.open_at END,
               CASE WHEN v.k > 1600 THEN 0 WHEN f.held > 0 AND f.held + 1 + v.k > 1600 THEN v.k WHEN f.held > 0 THEN f.held + 1 + v.k ELSE v.k END,
               CASE WHEN v.k > 1600 OR f.held > 0 AND f.held + 1 + v.k > 1600 THEN v.line ELSE f.open_at END
        FROM f JOIN v ON v.doc_id = f.doc_id AND v.a = f.a AND v.line = f.line + 1
    ), p AS (
        SELECT doc_id, a, max(line) AS b, 0 AS o, string_agg(text, chr(10) ORDER BY line) AS text FROM v WHERE size <= 1600 GROUP BY doc_id, a
        UNION ALL
        SELECT f.doc_id, min(f.line), max(f.line), 0, string_agg(v.text, chr(10) ORDER BY f.line) FROM f JOIN v ON v.doc_id = f.doc_id AND v.line = f.line WHERE NOT f.cut GROUP BY f.doc_id, f.a, f.first
        UNION ALL
        SELECT doc_id, line, line, unnest(range(0, CAST(ceil(k / 1600) AS BIGINT))), substr(text, 1 + 1600 * unnest(range(0, CAST(ceil(k / 1600) AS BIGINT))), 1600) FROM v WHERE k > 1600 AND size > 1600
    )
    SELECT doc_id || '.md' AS path, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY a, o) - 1 AS INTEGER) AS ordinal, CAST(a AS INTEGER) AS line_start, CAST(b AS INTEGER) AS line_end, sha256(text) AS hash
    FROM p WHERE trim(text, chr(10) || chr(9) || ' ') <> ''
""".replace("PHRASE", PHRASE).replace("LINES", LINES)
MARKED = f"WITH m AS (SELECT doc_id, line FROM ({LINES}) WHERE contains(text, 'tion')), d AS (SELECT doc_id, string_split(text, chr(10)) AS a FROM documents WHERE NOT contains(text, '{PHRASE}'))"
EXCERPT = r"sha256(substr(regexp_replace(array_to_string(a[{0}:{1}], chr(10)), '^\s+|\s+$', '', 'g'), 1, 2000))"
DEGREES = f"e AS (SELECT DISTINCT from_id, to_id FROM ({EDGES})), k AS (SELECT id FROM (SELECT from_id AS id FROM e UNION ALL SELECT to_id FROM e) GROUP BY id ORDER BY count(*) DESC, id LIMIT 20000)"
SAID = "SELECT 'c-' || conv_id || '-' || turn AS id, text FROM conversations UNION ALL SELECT 'b-' || item_id, text FROM benchmark"

ORACLES: dict[str, str] = {
    "exact_content": CONTENT,
    "exact_topk": f"{CONTENT} ORDER BY path, line LIMIT 51",
    "path_match": "SELECT url FROM pages WHERE contains(url, '/en/')",
    "content_hash": "SELECT doc_id, sha256(text) AS hash FROM documents",
    "bounded_read": """
        WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS a FROM documents)
        SELECT doc_id AS path, 3 AS line_start, CAST(least(12, len(a)) AS INTEGER) AS line_end, CAST(len(a) AS INTEGER) AS total_lines, substr(array_to_string(a[3:12], chr(10)), 1, 200000) AS text FROM l WHERE len(a) >= 3
    """,
    "chunk_pack": f"{CHUNKS} SELECT doc_id, ordinal, line_start, line_end, CAST(length(text) AS INTEGER) AS n_chars, sha256(text) AS hash FROM c",
    "vector_topk_each": f"SELECT query, vec_id, round(score, 6) AS score FROM ({NEAR_EACH.format('0', 20)})",
    "vector_dedup_each": f"SELECT query, label, vec_id, CAST(rank AS INTEGER) AS rank, round(score, 6) AS score FROM ({FIRST_EACH.format(NEAR_EACH.format('0', 160))})",
    "rrf_fuse_each": f"""
        WITH r AS (SELECT query - query % 100 AS query, label, query % 100 AS list, rank FROM ({FIRST_EACH.format(NEAR_EACH.format('0, 1', 160))}))
        SELECT query, label, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score, CAST(min(list) AS INTEGER) AS list, CAST(arg_min(rank, list) AS INTEGER) AS rank FROM r GROUP BY query, label
    """,
    "index_diff": DIFF,
    "run_totals": f"""
        WITH d AS ({DIFF})
        SELECT count(*) AS seen, count(*) FILTER (status = 'unchanged') AS unchanged, count(*) FILTER (status = 'changed') AS changed, count(*) FILTER (status = 'new') AS "new", count(*) FILTER (status = 'deleted') AS deleted,
               (SELECT coalesce(string_agg(doc_id, ',' ORDER BY doc_id), '') FROM (SELECT doc_id FROM d WHERE status = 'changed' ORDER BY doc_id LIMIT 100)) AS sample
        FROM d
    """,
    "stale_ids": f"WITH {STATES} SELECT id FROM ({LINE_IDS.format('o')}) WHERE id NOT IN ({LINE_IDS.format('n')})",
    "fresh_hits": f"WITH {STATES} SELECT o.doc_id, sha256(o.text) AS hash FROM o WHERE EXISTS (SELECT 1 FROM n WHERE n.doc_id = o.doc_id AND n.text = o.text)",
    "edge_dedup": f"SELECT from_id, to_id, relation, ev_path, ev_line FROM (SELECT *, row_number() OVER (PARTITION BY from_id, to_id, relation ORDER BY ev_path, ev_line) AS n FROM ({EDGES})) WHERE n = 1",
    "node_cap": f"""
        WITH e AS (SELECT DISTINCT from_id, to_id FROM ({EDGES})), k AS (SELECT id FROM (SELECT from_id AS id FROM e UNION ALL SELECT to_id FROM e) GROUP BY id ORDER BY count(*) DESC, id LIMIT 20000)
        SELECT from_id, to_id FROM e WHERE from_id IN (FROM k) AND to_id IN (FROM k) ORDER BY from_id, to_id LIMIT 50000
    """,
    "callers": f"SELECT * FROM ({EDGES}) WHERE to_id = 'p7' ORDER BY ev_path, ev_line, relation, from_id, to_id LIMIT 101",
    "callees": f"SELECT * FROM ({EDGES}) WHERE from_id = 's3' ORDER BY ev_path, ev_line, relation, from_id, to_id LIMIT 201",
    "seed_overlap": f"""
        {CHUNKS}, s AS (SELECT doc_id, line_start, line_end, 1.0::DOUBLE / (60 + ordinal) AS score FROM c WHERE contains(text, '{PHRASE}')), m AS (SELECT doc_id, line FROM ({LINES}) WHERE contains(text, 'tion'))
        SELECT m.doc_id || ':' || line AS node, round(max(score), 9) AS score FROM m JOIN s ON s.doc_id = m.doc_id AND line_start <= line + 1 AND line <= line_end GROUP BY 1
    """,
    "expand_2hop": f"{EXPAND} SELECT node, round(score, 9) AS score, hop FROM y WHERE n = 1",
    "graphrag_merge": f"""
        {EXPAND}, z AS (
            SELECT node AS path, round(score, 6) AS score, 'graph' AS kind FROM y WHERE n = 1 UNION ALL SELECT 'v' || vec_id, round(score, 6), 'semantic' FROM (SELECT vec_id, max(score) AS score FROM ({NEAR_EACH.format('0', 20)}) GROUP BY vec_id)
        )
        SELECT path, 1 AS line_start, 2 AS line_end, score, kind FROM z ORDER BY score DESC, path LIMIT 51
    """,
    "hierarchy": r"""
        WITH p AS (
            SELECT regexp_replace(regexp_replace(regexp_replace(url, '^https?://', ''), '[?#].*$', ''), '(^|/)[^/]*$', '') AS dir FROM pages
        ), d AS (
            SELECT CASE WHEN dir = '' THEN '.' ELSE dir END AS dir, count(*) AS n FROM p GROUP BY 1
        ), a AS (
            SELECT dir, n, CASE WHEN dir = '.' THEN 0 ELSE len(string_split(dir, '/')) END AS depth FROM d
        ), s AS (
            SELECT dir, n, i, array_to_string(string_split(dir, '/')[1:i], '/') AS above FROM a, LATERAL (SELECT unnest(range(1, depth + 1)) AS i)
        ), k AS (
            SELECT DISTINCT above AS id FROM s ORDER BY id LIMIT 2047
        ), m AS (
            SELECT dir, any_value(n) AS n, arg_max(above, i) AS id FROM s WHERE above IN (FROM k) GROUP BY dir
            UNION ALL SELECT dir, n, '.' FROM a WHERE dir NOT IN (SELECT dir FROM s WHERE above IN (FROM k))
        ), c AS (
            SELECT id, sum(n) AS n FROM m GROUP BY id
        )
        SELECT k.id, CASE WHEN k.id = '.' THEN NULL WHEN contains(k.id, '/') THEN regexp_replace(k.id, '/[^/]*$', '') ELSE '.' END AS parent_id, CAST(coalesce(c.n, 0) AS BIGINT) AS n
        FROM (FROM k UNION ALL SELECT '.') k LEFT JOIN c ON c.id = k.id
    """,
    "cochange": """
        WITH f AS (SELECT DISTINCT l_orderkey AS c, l_partkey AS path, o_orderdate AS t FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
        SELECT path, count(*) AS count, max(t) AS last_changed_at, array_to_string(list(c ORDER BY t DESC, c DESC)[1:5], ',') AS commits
        FROM f WHERE path <> 7 AND c IN (SELECT c FROM f WHERE path = 7) GROUP BY path ORDER BY count DESC, last_changed_at DESC, path LIMIT 50
    """,
    "link_extract": """
        WITH p AS (SELECT page_id, regexp_extract_all(html, 'href="([^"]*)"', 1) AS a FROM pages)
        SELECT page_id, CAST(unnest(range(0, len(a))) AS INTEGER) AS ordinal, unnest(a) AS link FROM p
    """,
    # The router's patterns again, so this SQL checks how they are applied, not the patterns themselves.
    "route_query": f"""
        WITH q AS (SELECT id, regexp_replace(coalesce(text, ''), '^\\s+|\\s+$', '', 'g') AS t FROM ({SAID})), s AS (
            SELECT id, t, regexp_matches(t, '(?i)호출|상속|구현|이어지|연결|참조|의존|생성하|발행자|구독|call(er|ee| graph)|who calls|inherit|implement|references?|depends?') AS structural,
                   coalesce(nullif(trim(regexp_extract(t, '["''`]([^"''`\\r\\n]*[\\\\/][^"''`\\r\\n]*\\.[A-Za-z0-9]+)["''`]', 1)), ''),
                            nullif(trim(regexp_extract(t, '([A-Za-z]:[\\\\/])?([^\\\\/\\s"''<>|?*]+[\\\\/])+[^\\\\/\\s"''<>|?*]+\\.[A-Za-z0-9]+')), ''),
                            nullif(trim(regexp_extract(t, '(?i)\\b[A-Za-z0-9_@()\\-]+\\.(asmdef|asmref|asset|cs|js|jsx|meta|prefab|ts|tsx|unity)\\b')), ''),
                            list_filter(regexp_extract_all(t, '[A-Za-z_]\\w*(\\.[A-Za-z_]\\w*)+(\\([^()\\r\\n]{{0,256}}\\))?|[A-Za-z_]\\w*\\([^()\\r\\n]{{0,256}}\\)|[A-Z][A-Za-z0-9_]{{2,}}'),
                                        lambda x: contains(x, '.') OR contains(x, '(') OR lower(x) NOT IN ('call', 'caller', 'callers', 'callee', 'callees', 'interface', 'where', 'which'))[1]) AS symbol
            FROM q
        )
        SELECT id, CASE WHEN structural AND symbol IS NOT NULL THEN 'graph'
                        WHEN regexp_matches(t, '(?i)(^|[\\\\/])[\\w .@()\\-]+\\.[A-Za-z0-9]+($|\\s)|\\.(cs|asmdef|json|ya?ml|md|asset)\\b')
                          OR regexp_matches(t, '(?i)\\b(CS\\d{{4}}|0x[0-9a-f]+|[A-Za-z_]\\w*(Exception|Error))\\b|오류|에러')
                          OR regexp_matches(t, '^[A-Za-z_]\\w*(\\.[A-Za-z_]\\w*)*(\\([^()\\r\\n]{{0,256}}\\))?$') THEN 'exact' ELSE 'semantic' END AS route,
               CASE WHEN structural THEN symbol END AS symbol,
               CASE WHEN structural AND symbol IS NOT NULL THEN CASE
                    WHEN regexp_matches(t, '(?i)호출자|누가\\s*호출|(무엇|뭐|누가|어디서).{{0,40}}(참조|의존)|에\\s*(참조|의존)하는|callers?|who calls|what\\s+references?|who\\s+depends?\\s+on') THEN 'callers'
                    WHEN regexp_matches(t, '(?i)상속|inherits?|base\\s+type|derived\\s+type') THEN 'inherits'
                    WHEN regexp_matches(t, '(?i)구현|implements?|interface') THEN 'implements' ELSE 'callees' END END AS direction
        FROM s
    """.replace("\\\\", "\\"),
    "identifiers": f"""
        WITH q AS (SELECT id, text, list_filter(regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_.]*'), lambda x: length(x) >= 2) AS a FROM ({SAID})), t AS (
            SELECT id, unnest(a) AS x, unnest(range(0, len(a))) AS i FROM q
        ), f AS (
            SELECT id, min(i) AS i, arg_min(x, i) AS x FROM t GROUP BY id, lower(x)
        ), r AS (
            SELECT id, x, i, row_number() OVER (PARTITION BY id ORDER BY i) AS n FROM f
        ), j AS (
            SELECT id, substr(string_agg(x, ' ' ORDER BY i), 1, 512) AS v FROM r WHERE n <= 8 GROUP BY id
        )
        SELECT q.id, CASE WHEN strlen(text) > length(text) THEN v END AS identifiers FROM q LEFT JOIN j ON j.id = q.id
    """,
    "module_tree": f"{TREE} SELECT id, parent_id, kind, path FROM modules",
    "module_ancestors": f"{TREE} SELECT id, ancestor, steps FROM up",
    "module_members": f"{TREE} SELECT module, kind, id FROM members",
    "module_counts": f"{TREE} SELECT module, count(*) FILTER (kind = 'node') AS nodes, count(*) FILTER (kind = 'edge') AS edges, count(DISTINCT path) AS sources FROM members GROUP BY module",
    "summary_bytes": f"{TREE} SELECT module, kind, id FROM (SELECT *, sum(octet_length(encode(module || kind || id || path))) OVER (ORDER BY module, kind, id, path ROWS UNBOUNDED PRECEDING) AS n FROM members) WHERE n <= 8192",
    "summary_shown": f"""
        {TREE}, places AS (
            SELECT id AS module, row_number() OVER (ORDER BY parent_id IS NOT NULL, coalesce(path, ''), id) AS place FROM modules
        ), edges AS (
            SELECT m.module FROM members m JOIN places p ON p.module = m.module WHERE kind = 'edge' ORDER BY place, id LIMIT 1000
        ), counted AS (
            SELECT module, count(*) FILTER (kind = 'node') AS nodes, count(*) FILTER (kind = 'edge') AS edges FROM (SELECT module, kind FROM members WHERE kind = 'node' UNION ALL SELECT module, 'edge' FROM edges) GROUP BY module
        ), chains AS MATERIALIZED (
            SELECT row_number() OVER (ORDER BY any_value(p.place)) AS n, list(ancestor) AS chain FROM counted c JOIN places p ON p.module = c.module JOIN up ON up.id = c.module GROUP BY c.module
        ), fold AS (
            SELECT CAST(0 AS BIGINT) AS n, CAST([] AS VARCHAR[]) AS kept
            UNION ALL
            SELECT chains.n, CASE WHEN len(list_distinct(list_concat(kept, chain))) <= 64 THEN list_distinct(list_concat(kept, chain)) ELSE kept END FROM fold JOIN chains ON chains.n = fold.n + 1
        ), chosen AS (
            SELECT unnest(arg_max(kept, n)) AS id FROM fold
        )
        SELECT chosen.id, coalesce(nodes, 0) AS nodes, coalesce(edges, 0) AS edges FROM chosen LEFT JOIN counted ON module = chosen.id
    """,
    "assembly_names": f"""
        WITH p AS (SELECT id, path, english, {PARENT.format('path')} AS folder FROM ({PATHS})), d AS (SELECT folder, min('A' || id) AS name FROM p WHERE english GROUP BY folder), f AS (SELECT DISTINCT folder FROM p), b AS (
            SELECT f.folder, arg_max(d.name, CASE WHEN d.folder = '.' THEN 0 ELSE length(d.folder) END) AS name FROM f JOIN d ON d.folder = '.' OR f.folder = d.folder OR starts_with(f.folder, d.folder || '/') GROUP BY f.folder
        )
        SELECT id, path, coalesce(name, CASE WHEN list_contains(string_split(lower(path), '/'), 'editor') THEN 'Assembly-CSharp-Editor' ELSE 'Assembly-CSharp' END) AS assembly FROM p LEFT JOIN b ON b.folder = p.folder
    """,
    "byte_budget": f"""
        WITH {DEGREES}, n AS (
            SELECT id, sum(strlen(id)) OVER (ORDER BY id ROWS UNBOUNDED PRECEDING) AS upto FROM k
        ), i AS (
            SELECT from_id, to_id FROM e WHERE from_id IN (SELECT id FROM k) AND to_id IN (SELECT id FROM k) ORDER BY from_id, to_id LIMIT 50000
        ), j AS (
            SELECT *, sum(strlen(from_id) + strlen(to_id)) OVER (ORDER BY from_id, to_id ROWS UNBOUNDED PRECEDING) AS upto FROM i
        )
        SELECT from_id, to_id FROM j WHERE upto + (SELECT max(upto) FROM n) <= 262144 UNION ALL SELECT id, NULL FROM n WHERE upto <= 262144
    """,
    "greedy_budget": """
        WITH RECURSIVE d AS (
            SELECT CAST(doc_id AS VARCHAR) AS path, CASE WHEN lang = 'en' THEN 'source' ELSE 'auxiliary' END AS kind, CAST(strlen(text) AS BIGINT) AS size FROM documents WHERE strlen(text) <= 2097152
        ), r AS MATERIALIZED (
            SELECT *, row_number() OVER (ORDER BY path) AS n FROM ((SELECT * FROM d WHERE kind = 'source' ORDER BY path LIMIT 2000) UNION ALL (SELECT * FROM d WHERE kind = 'auxiliary' ORDER BY path LIMIT 256))
        ), f AS (
            SELECT CAST(0 AS BIGINT) AS n, CAST(0 AS BIGINT) AS total, false AS took
            UNION ALL SELECT r.n, CASE WHEN total + size <= 1048576 THEN total + size ELSE total END, total + size <= 1048576 FROM f JOIN r ON r.n = f.n + 1
        )
        SELECT path, kind, size FROM r JOIN f ON f.n = r.n WHERE took
    """,
    "graph_totals": f"SELECT relation AS language, count(DISTINCT to_id) AS nodes, count(*) AS edges FROM ({EDGES}) GROUP BY relation",
    "fresh_trace": f"""
        {MARKED}, x AS (SELECT doc_id, line, lead(line) OVER (PARTITION BY doc_id ORDER BY line) AS after FROM m)
        SELECT x.doc_id || ':' || line AS from_id, x.doc_id || ':' || after AS to_id, CAST(x.doc_id AS VARCHAR) AS ev_path, line AS ev_line, {EXCERPT.format('line', 'least(after, line + 19)')} AS hash FROM x JOIN d ON d.doc_id = x.doc_id WHERE after IS NOT NULL
    """,
    "node_excerpts": f"""
        {MARKED}, x AS (SELECT doc_id, min(line) AS line FROM m GROUP BY doc_id)
        SELECT CAST(x.doc_id AS VARCHAR) AS path, line AS line_start, CAST(len(a) AS INTEGER) AS line_end, {EXCERPT.format('line', 'least(len(a), line + 59)')} AS hash FROM x JOIN d ON d.doc_id = x.doc_id
    """,
    "seeds_capped": f"""
        {CHUNKS}, h AS (
            SELECT doc_id, line_start, line_end, ordinal, row_number() OVER (ORDER BY CAST(doc_id AS VARCHAR), ordinal) AS rank FROM c WHERE contains(text, '{PHRASE}')
        ), s AS (
            SELECT doc_id, line_start, line_end, greatest(0.001, CASE WHEN ordinal > 0 THEN 1.0::DOUBLE / ordinal ELSE 1.0::DOUBLE / (60 + rank) END) AS score FROM h WHERE rank <= 64
        ), m AS (SELECT doc_id, line FROM ({LINES}) WHERE contains(text, 'tion'))
        SELECT m.doc_id || ':' || line AS node, round(max(score), 9) AS score FROM m JOIN s ON s.doc_id = m.doc_id AND line_start <= line + 1 AND line <= line_end GROUP BY 1
    """,
    "symbol_match": """
        WITH n AS (SELECT p_partkey, p_name AS name, p_brand || '.' || p_type || '.' || p_name AS full_name, p_brand || '.' || p_type || '.' || p_name || '(' || p_size || ')' AS signature FROM part)
        SELECT 'small ring' AS query, p_partkey FROM n WHERE name = 'small ring'
        UNION ALL SELECT 'ECONOMY.small ring', p_partkey FROM n WHERE full_name = 'ECONOMY.small ring' OR ends_with(full_name, '.ECONOMY.small ring')
        UNION ALL SELECT 'ECONOMY.small ring(11)', p_partkey FROM n WHERE signature = 'ECONOMY.small ring(11)' OR ends_with(signature, '.ECONOMY.small ring(11)')
    """,
    "upsert": f"""
        WITH {STATES}, c AS (SELECT * FROM n WHERE contains(text, '{PHRASE}'))
        SELECT doc_id, sha256(text) AS hash FROM o WHERE doc_id NOT IN (SELECT doc_id FROM c) UNION ALL SELECT doc_id, sha256(text) FROM c
    """,
    "asset_links": """
        WITH p AS (SELECT page_id, regexp_extract_all(html, 'href="([^"]*)"', 1) AS a FROM pages), t AS (SELECT md5(a[1]) AS guid, min('m/' || page_id || '.asset') AS target FROM p WHERE len(a) > 0 GROUP BY 1), r AS (
            SELECT page_id, CAST(unnest(range(1, len(a) + 1)) AS INTEGER) AS line, md5(unnest(a)) AS guid FROM p
        )
        SELECT 'a/' || page_id || '.prefab' AS from_id, coalesce(target, 'unresolved:' || r.guid) AS to_id, 'references' AS relation, 'a/' || page_id || '.prefab' AS ev_path, line AS ev_line FROM r LEFT JOIN t ON t.guid = r.guid
    """,
    "asset_dependencies": """
        WITH p AS (SELECT page_id, regexp_extract_all(html, 'href="([^"]*)"', 1) AS a FROM pages), t AS (SELECT md5(a[1]) AS guid, min('m/' || page_id || '.asset') AS target FROM p WHERE len(a) > 0 GROUP BY 1), r AS (
            SELECT page_id, CAST(unnest(range(1, len(a) + 1)) AS INTEGER) AS line, md5(unnest(a)) AS guid FROM p
        )
        SELECT 'a/' || page_id || '.prefab' AS from_id, coalesce(target, 'unresolved:' || r.guid) AS to_id, 'references' AS relation, 'a/' || page_id || '.prefab' AS ev_path, line AS ev_line FROM r LEFT JOIN t ON t.guid = r.guid
        UNION SELECT 'a/' || page_id || '.prefab', CASE WHEN page_id + 1 IN (SELECT page_id FROM p WHERE len(a) > 0) THEN '' ELSE 'unresolved:' END || 'a/' || (page_id + 1) || '.prefab', 'asset_database_dependency', 'a/' || page_id || '.prefab', 1
        FROM p WHERE len(a) > 0
    """,
    "classify_paths": f"""
        WITH p AS (SELECT id, CASE WHEN ends_with(path, '/') THEN path || 'index.md' ELSE path END AS path FROM ({PATHS}))
        SELECT id, CASE WHEN starts_with(path, 'www.cheap-pills.example.com/') OR starts_with(path, 'blog.tionsh.example.net/en/') OR path IN ('www.cheap-pills.example.com', 'blog.tionsh.example.net/en') THEN 'document' ELSE 'code' END AS source,
               ends_with(path, '.md') AS is_text, regexp_matches(path, '^(.*/)?en/[^/]*$') AS excluded, regexp_matches(path, '^(.*/)?fr/.*$') AS ignored FROM p
    """,
    "excluded_paths": f"SELECT id, regexp_matches(path, '^([^/]+/)*(fr|de)/[1-4][^/]*(/.*)?$') OR regexp_matches(path, '^blog[.][^/]*/.+$') OR regexp_matches(path, '^m[.][^/]*/[^/]+/[^/](/.*)?$') OR regexp_matches(path, '^(.*/)?es/.*$') AS excluded FROM ({PATHS})",
    "semantic_only": "SELECT doc_id, CASE WHEN lang = 'en' THEN 'code' ELSE 'document' END AS source FROM documents WHERE lang <> 'en' OR NOT (source = 'src1' OR doc_id % 10 = 7)",
    "notes_union": """
        SELECT 'code' AS source, CAST(doc_id AS VARCHAR) AS path, sha256(text) AS hash FROM documents
        UNION ALL SELECT 'document', '@handoff/' || role || '/' || conv_id || '-' || turn || '.md', sha256(text) FROM conversations
    """,
    "project_match": f"SELECT any_value(id) AS id, lower(folder) AS key FROM (SELECT id, {PARENT.format('path')} AS folder FROM ({PATHS})) GROUP BY lower(folder) HAVING count(*) = 1",
    "path_terms": f"SELECT id FROM ({PATHS}) WHERE contains(lower(path), 'blog') OR contains(lower(path), 'en/1') OR contains(lower(path), 'pills')",
    "chunk_sections": SECTIONS,
    "coalesce_bursts": """
        WITH RECURSIVE e AS MATERIALIZED (SELECT user_id, ts FROM events), b AS (
            SELECT user_id, min(ts) AS started FROM e GROUP BY user_id
            UNION ALL SELECT e.user_id, min(e.ts) FROM b JOIN e ON e.user_id = b.user_id AND e.ts >= b.started + INTERVAL 6 HOUR GROUP BY e.user_id
        )
        SELECT b.user_id, b.started, count(*) AS n FROM b JOIN e ON e.user_id = b.user_id AND e.ts >= b.started AND e.ts < b.started + INTERVAL 6 HOUR GROUP BY ALL
    """,
}

QUERIES |= stored.QUERIES
ORACLES |= stored.ORACLES
