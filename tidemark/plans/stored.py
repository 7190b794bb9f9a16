"""Queries on what the engine stores: summaries, their budgets and locators, checks of graphs, ranges of files, last writes; and DuckDB SQL for the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import text
from tidemark.operators import exact, graph, hierarchy, snapshots, summaries
from tidemark.sources import store

PHRASE, MARK = "of the", "tion"
#: Folders in the order in which a search shows them, and bytes of a summary.
TARGETS, BUDGET = ["src3", "src1/en", "src1"], 1 << 20


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _documents(spark, sf_dir):
    """Documents as files in folders by source and language."""
    return _table(spark, sf_dir, "documents").select(F.concat_ws("/", "source", "lang", "doc_id").alias("path"), "doc_id", "lang", "text").where("text IS NOT NULL")


def _graph(files):
    """Lines that hold a syllable as symbols, and an edge from each to the next of its file."""
    each = files.select("path", "doc_id", text.content_hash("text").alias("file_hash"), F.posexplode(text.lines("text")).alias("i", "line")).where(F.contains("line", F.lit(MARK)))
    nodes = each.select(F.concat_ws(":", "doc_id", F.col("i") + 1).alias("id"), "path", (F.col("i") + 1).alias("line_start"), (F.col("i") + 1).alias("line_end"), "file_hash", "doc_id", "line")
    after = Window.partitionBy("path").orderBy("line_start")
    edges = nodes.select(F.col("id").alias("from_id"), F.lead("id").over(after).alias("to_id"), F.lit("next").alias("relation"), F.col("path").alias("ev_path"), F.col("line_start").alias("ev_line"), F.lead("line_start").over(after).alias("ev_line_end"), "file_hash")
    return nodes, edges.where("to_id IS NOT NULL")


def _placed(spark, sf_dir):
    found = summaries.locators(*_graph(_documents(spark, sf_dir)))
    modules = hierarchy.tree(found, ["."])
    return modules, hierarchy.placed(found, modules, ["."])


def summary_locators(spark, sf_dir):
    return _placed(spark, sf_dir)[1].select("module", "kind", "id", "path", "line_start", "line_end")


def summary_stale(spark, sf_dir):
    """The locators that are still right after a phrase has changed in the documents."""
    files = _documents(spark, sf_dir)
    now = files.withColumn("text", F.regexp_replace("text", PHRASE, "of a"))
    return summaries.held(_placed(spark, sf_dir)[1], *_graph(now)).select("module", "kind", "id")


def summary_budget_exact(spark, sf_dir):
    modules, members = _placed(spark, sf_dir)
    return summaries.budget_bytes(members, modules).where(F.col("total") <= BUDGET).select("module", "kind", "id", "total")


def graph_violations(spark, sf_dir):
    """The graph with rows made wrong by their document's number; English documents are allowed."""
    files = _documents(spark, sf_dir)
    nodes, edges = _graph(files)
    wrong = lambda n, k: F.col("doc_id") % n == k
    nodes = nodes.select(
        F.when(~wrong(11, 3), F.col("id")).alias("id"), F.substring("line", 1, 1100).alias("name"), F.when(~wrong(7, 0), F.col("path")).alias("path"), "line_start",
        F.when(wrong(5, 1), F.col("line_end") - 1).otherwise(F.col("line_end")).alias("line_end"), F.when(wrong(3, 0), F.substring("file_hash", 1, 60)).otherwise(F.col("file_hash")).alias("file_hash"),
    )
    edges = edges.withColumn("relation", F.when(F.col("ev_line") % 4 > 0, F.col("relation")))
    return graph.violations(nodes, edges, files.where("lang = 'en'"))


def exact_ordered(spark, sf_dir):
    """The first lines with the phrase by folder, in files stored in ranges."""
    folder = store.new_folder(spark, "ranges")
    exact.in_ranges(_documents(spark, sf_dir).select("path", "text"), TARGETS).write.partitionBy("part").parquet(folder)
    files = spark.read.parquet(folder)
    parts = [r[0] for r in files.select("part").distinct().orderBy("part").collect()]
    found = exact.ordered_matches(files, parts, PHRASE, 200)
    store.remove(spark, folder)
    return found.select("target", "path", "line", text.content_hash("text").alias("hash"))


def symbol_exact_first(spark, sf_dir):
    """Parts as symbols, every tenth without its brand: whole names come before ends."""
    full = F.concat_ws(".", F.when(F.col("p_partkey") % 10 > 0, F.col("p_brand")), "p_type", "p_name")
    nodes = _table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("name"), full.alias("full_name"), F.concat(full, F.lit("("), "p_size", F.lit(")")).alias("signature"))
    out = None
    for query in ("ECONOMY.small ring", "ECONOMY.small ring(11)", "Brand#1.ECONOMY.small ring", "PROMO.large ring"):
        own = graph.match_symbols(nodes, query).select(F.lit(query).alias("query"), "p_partkey")
        out = own if out is None else out.union(own)
    return out


def upsert_last(spark, sf_dir):
    """Customers, those with orders replaced by their last one."""
    stored = _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("what"))
    rows = _table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id"), F.concat_ws("-", "o_orderkey", "o_orderdate").alias("what"), F.col("o_orderkey").alias("at"))
    return snapshots.upsert(stored, rows, at_col="at")


QUERIES = {
    "summary_locators": summary_locators, "summary_stale": summary_stale, "summary_budget_exact": summary_budget_exact, "graph_violations": graph_violations,
    "exact_ordered": exact_ordered, "symbol_exact_first": symbol_exact_first, "upsert_last": upsert_last,
}

_FILES = "SELECT source || '/' || lang || '/' || doc_id AS path, doc_id, lang, {} AS text FROM documents WHERE text IS NOT NULL"


def _sql(name: str, body: str) -> str:
    """Tables {name}_n and {name}_e: nodes and edges of the files that a query gives."""
    return f"""
        {name}_f AS MATERIALIZED (SELECT *, sha256(text) AS hash FROM ({body})),
        {name}_l AS (SELECT path, doc_id, hash, CAST(unnest(range(1, len(string_split(text, chr(10))) + 1)) AS INTEGER) AS line, unnest(string_split(text, chr(10))) AS t FROM {name}_f),
        {name}_n AS MATERIALIZED (SELECT doc_id || ':' || line AS id, path, line, hash, doc_id, t FROM {name}_l WHERE contains(t, '{MARK}')),
        {name}_x AS (SELECT id AS a, lead(id) OVER w AS b, path, line, lead(line) OVER w AS last, hash, doc_id FROM {name}_n WINDOW w AS (PARTITION BY path ORDER BY line)),
        {name}_e AS MATERIALIZED (SELECT *, sha256('next' || chr(0) || a || chr(0) || b || chr(0) || path || chr(0) || line || chr(0) || last || chr(0) || hash) AS id FROM {name}_x WHERE b IS NOT NULL)
    """


_MEMBERS = f"""
    WITH {_sql('o', _FILES.format('text'))}, m AS MATERIALIZED (
        SELECT 'directory:' || regexp_replace(path, '/[^/]*$', '') AS module, * FROM (
            (SELECT 'node' AS kind, id, path, line AS line_start, line AS line_end, hash, NULL AS a, NULL AS b FROM o_n ORDER BY id LIMIT 20000)
            UNION ALL (SELECT 'edge', id, path, line, last, hash, a, b FROM o_e ORDER BY id LIMIT 50000)
        )
    )
"""

ORACLES = {
    "summary_locators": f"{_MEMBERS} SELECT module, kind, id, path, line_start, line_end FROM m",
    "summary_stale": f"""
        {_MEMBERS}, {_sql('c', _FILES.format(f"replace(text, '{PHRASE}', 'of a')"))}, u AS (
            SELECT 'node' AS kind, id, path, line AS line_start, line AS line_end, hash FROM c_n UNION ALL SELECT 'edge', id, path, line, last, hash FROM c_e
        )
        SELECT module, kind, id FROM m WHERE (kind, id, path, line_start, line_end, hash) IN (SELECT kind, id, path, line_start, line_end, hash FROM u)
    """,
    "summary_budget_exact": f"""
        {_MEMBERS}, d AS (
            SELECT DISTINCT unnest([NULL, path[:strpos(path, '/') - 1], regexp_replace(path, '/[^/]*$', '')]) AS path FROM m
        ), modules AS (
            SELECT 'project' AS id, NULL AS parent_id, 'project' AS kind, NULL AS path UNION ALL SELECT 'root:.', 'project', 'code_root', '.'
            UNION ALL SELECT 'directory:' || path, CASE WHEN contains(path, '/') THEN 'directory:' || regexp_replace(path, '/.*$', '') ELSE 'root:.' END, 'directory', path FROM d WHERE path IS NOT NULL
        ), frame AS (
            SELECT sum(strlen(to_json({{'id': id, 'parent_id': parent_id, 'kind': kind, 'path': path, 'nodes': [], 'edges': [], 'sources': []}}))) + count(*) - 1 + strlen('{{"modules":[]}}') AS n FROM modules
        ), s AS (
            SELECT module, kind, id, strlen(to_json({{'path': path, 'line_start': line_start, 'line_end': line_end, 'file_hash': hash}})) AS place,
                   CASE WHEN kind = 'node' THEN strlen(to_json({{'id': id, 'path': path, 'line_start': line_start, 'line_end': line_end, 'file_hash': hash}}))
                        ELSE strlen(to_json({{'id': id, 'relation': 'next', 'from_id': a, 'to_id': b, 'evidence': {{'path': path, 'line_start': line_start, 'line_end': line_end, 'file_hash': hash}}}})) END AS own,
                   row_number() OVER (PARTITION BY module, kind ORDER BY id) AS of_kind, row_number() OVER (PARTITION BY module ORDER BY kind, id) AS of_module,
                   row_number() OVER (PARTITION BY module, path, line_start, line_end, hash ORDER BY kind, id) AS of_place FROM m
        ), t AS (
            SELECT module, kind, id, sum(own + CASE WHEN of_kind > 1 THEN 1 ELSE 0 END + CASE WHEN of_place > 1 THEN 0 WHEN of_module > 1 THEN place + 1 ELSE place END) OVER (ORDER BY module, kind, id ROWS UNBOUNDED PRECEDING) AS n FROM s
        )
        SELECT module, kind, t.id, CAST(t.n + frame.n AS BIGINT) AS total FROM t, frame WHERE t.n + frame.n <= {BUDGET}
    """,
    "graph_violations": f"""
        WITH {_sql('o', _FILES.format('text'))}, n AS (
            SELECT CASE WHEN doc_id % 11 <> 3 THEN id END AS id, CASE WHEN doc_id % 7 <> 0 THEN path END AS path, line, doc_id % 5 <> 1 AS in_order, doc_id % 3 <> 0 AS whole, length(t) AS k, path LIKE '%/en/%' AS allowed FROM o_n
        ), e AS (SELECT a || ' ' || b AS id, path, line, path LIKE '%/en/%' AS allowed FROM o_e)
        SELECT 'node' AS kind, id, path, 'allowed path' AS rule FROM n WHERE path IS NOT NULL AND NOT allowed
        UNION ALL SELECT 'node', id, path, 'lines' FROM n WHERE path IS NOT NULL AND NOT in_order
        UNION ALL SELECT 'node', id, path, 'hash' FROM n WHERE path IS NOT NULL AND NOT whole
        UNION ALL SELECT 'node', id, path, 'id' FROM n WHERE id IS NULL
        UNION ALL SELECT 'node', id, path, 'no path' FROM n WHERE path IS NULL
        UNION ALL SELECT 'node', id, path, 'length of name' FROM n WHERE k > 1024
        UNION ALL SELECT 'edge', id, path, 'allowed path' FROM e WHERE NOT allowed
        UNION ALL SELECT 'edge', id, path, 'length of relation' FROM e WHERE line % 4 = 0
    """,
    "exact_ordered": f"""
        WITH f AS ({_FILES.format('text')}), t AS (
            SELECT path, CASE WHEN starts_with(path, 'src3/') THEN 0 WHEN starts_with(path, 'src1/en/') THEN 1 WHEN starts_with(path, 'src1/') THEN 2 ELSE 3 END AS target, string_split(text, chr(10)) AS a FROM f
        ), l AS (SELECT target, path, CAST(unnest(range(1, len(a) + 1)) AS INTEGER) AS line, unnest(a) AS text FROM t)
        SELECT target, path, line, sha256(substr(text, 1, 2000)) AS hash FROM l WHERE contains(text, '{PHRASE}') ORDER BY target, path, line LIMIT 201
    """,
    "symbol_exact_first": """
        WITH n AS (
            SELECT p_partkey, CASE WHEN p_partkey % 10 > 0 THEN p_brand || '.' ELSE '' END || p_type || '.' || p_name AS full_name, CASE WHEN p_partkey % 10 > 0 THEN p_brand || '.' ELSE '' END || p_type || '.' || p_name || '(' || p_size || ')' AS signature FROM part
        ), q AS (SELECT unnest(['ECONOMY.small ring', 'ECONOMY.small ring(11)', 'Brand#1.ECONOMY.small ring', 'PROMO.large ring']) AS query), r AS (
            SELECT query, p_partkey, CASE WHEN contains(query, '(') THEN signature ELSE full_name END = query AS whole FROM q, n WHERE ends_with('.' || CASE WHEN contains(query, '(') THEN signature ELSE full_name END, '.' || query)
        )
        SELECT query, p_partkey FROM r WHERE whole OR query NOT IN (SELECT query FROM r WHERE whole)
    """,
    "upsert_last": """
        SELECT c_custkey AS id, c_name AS what FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)
        UNION ALL SELECT o_custkey, arg_max(o_orderkey || '-' || o_orderdate, o_orderkey) FROM orders GROUP BY o_custkey
    """,
}
