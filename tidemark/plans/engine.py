"""The engine that users call: an index in a folder of snapshots, and searches, reads, traces and impact over it.

A snapshot is two tables, files and chunks, that nothing changes once they are written; a numbered
commit, created last and whole, puts it in force. So a run that fails leaves the one before in
force, readers never see half of one, and of two runs at once both get a number. Graphs and the
summaries made of them are kept alike, under commits of their own, so they outlive runs; what no
longer holds of them is told by hashes.
"""

from __future__ import annotations

import datetime
import uuid
from typing import NamedTuple

from pyspark.sql import DataFrame, Observation, Row, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import routing
from tidemark.functions.text import content_hash, joined_hash, lines, path_has_term
from tidemark.operators import budgets, exact, graph, hierarchy, retrieval, snapshots, summaries
from tidemark.operators.chunking import chunk_files
from tidemark.operators.embedding import Embedder, HashingEmbedder, with_embeddings
from tidemark.sources import store
from tidemark.sources.extensions import GraphSource, HistorySource, ParquetVectors, VectorStore
from tidemark.sources.files import notes_as_files, semantic_files

RUNS = "run long, folder string, model string, at string, seen long, unchanged long, changed long, new long, deleted long"
GRAPHS = "graph long, folder string, at string, truncated boolean, fingerprint string"
SUMMARIES = "summary long, folder string, at string, graph long, fingerprint string, truncated boolean"
MODULES = "id string, parent_id string, kind string, path string, nodes long, edges long"
VERSION = "chunks-1"
#: Reasons to skip a file that are counted by name, and languages of a graph.
SKIPS, MOST_LANGUAGES = ("too_large", "binary", "undecodable"), 32


class Totals(dict):
    """Files of a run by status. ``counts`` says what else the run saw: files skipped, by reason, and read by another encoding; chunks in all, embedded, taken over and deleted."""

    counts: dict


class Answer(NamedTuple):
    """``places`` (path, line_start, line_end, score, kind, text), ``modules`` (id, parent_id, kind, path, nodes, edges) that hold what was reached, and ``counts``: hits, nodes, edges and members that no longer hold, and edges without an end. Both tables are local, of 201 and 64 rows at most."""

    places: DataFrame
    modules: DataFrame
    counts: dict


def _now_text() -> str:
    return datetime.datetime.now(datetime.timezone.utc).isoformat(timespec="milliseconds")


class Engine:
    """``folder`` must be where driver and executors both reach it; ``vectors`` is where chunks are kept, there by default."""

    def __init__(self, spark: SparkSession, folder: str, embedder: Embedder | None = None, vectors: VectorStore | None = None):
        self.spark, self.folder, self.embedder = spark, folder.rstrip("/"), embedder or HashingEmbedder()
        self.vectors = vectors or ParquetVectors(spark, f"{self.folder}/data")
        self.model = f"{VERSION}-{type(self.embedder).__name__}-{self.embedder.dimension}"
        self._logs = {name: store.Log(spark, f"{self.folder}/{name}", schema) for name, schema in (("runs", RUNS), ("graphs", GRAPHS), ("summaries", SUMMARIES))}
        self._checked: set[str] = set()

    # Snapshots

    def runs(self) -> DataFrame:
        """All runs, none if there were none."""
        return self._logs["runs"].table()

    def graphs(self) -> DataFrame:
        """All graphs that were saved."""
        return self._logs["graphs"].table()

    def current(self) -> dict | None:
        """What was committed of the last run, or None."""
        return self._logs["runs"].last()

    def _loaded(self, commit: dict, name: str, deep: bool) -> DataFrame:
        """A table of a commit; the rows of one are digested once, as it doesn't change."""
        folder = f"{self.folder}/data/{commit['folder']}"
        out = store.loaded(self.spark, folder, name, commit["tables"][name], deep and f"{folder}/{name}" not in self._checked)
        self._checked.add(f"{folder}/{name}")
        return out

    def table(self, name: str) -> DataFrame:
        """files or chunks of the last run, nodes or edges of the last graph, modules or members of its summary; raises ValueError if there is none, Damaged if its files are not those that were committed."""
        kind = {"nodes": "graphs", "edges": "graphs", "modules": "summaries", "members": "summaries"}.get(name, "runs")
        commit = self._logs[kind].last()
        if commit is None:
            raise ValueError("nothing is indexed yet" if kind == "runs" else "no graph is saved yet")
        if name == "chunks":
            return self.vectors.load(commit["folder"], commit["tables"]["chunks"])
        return self._loaded(commit, name, kind != "runs")  # graphs are small enough to be read twice

    def verify(self) -> None:
        """Reads all rows of all tables in force; raises Damaged if one isn't what was committed."""
        for kind in self._logs:
            commit = self._logs[kind].last()
            for name, said in (commit or {"tables": {}})["tables"].items():
                if name != "chunks":
                    store.loaded(self.spark, f"{self.folder}/data/{commit['folder']}", name, said, True)
                elif store.digest(self.table("chunks")) != (said["rows"], said["digest"]):
                    raise store.Damaged("chunks are not those that were committed")

    def clean(self, seconds: int = 7 * 24 * 3600) -> list[str]:
        """Deletes tables that are not in force and have not changed for so many seconds; a query that began before may still read younger ones."""
        keep = {commit["folder"] for log in self._logs.values() if (commit := log.last())}
        return sorted({*store.forget(self.spark, f"{self.folder}/data", keep, seconds), *self.vectors.forget(keep, seconds)})

    def index(self, files: DataFrame, rebuild: bool = False, *, targets: list[str] | None = None, graph_only: list[str] = (), notes: DataFrame | None = None) -> Totals:
        """A run over ``files`` (source, path, text): only new and changed files are chunked and embedded, others' chunks are taken over. Returns the run's totals.

        Another model or way of chunking than the last run's means that all are. Rows without path
        or text are left out; of repeated paths the one with the least hash counts. Code whose path
        fits one of the globs ``graph_only`` is not embedded. ``notes`` (project_slug, label, text)
        are indexed as documents. ``targets``, folders in order, say what exact search shows first.
        """
        last = self.current()
        compatible = not rebuild and last is not None and last["model"] == self.model
        read, written = Observation(), Observation()
        skip = F.col("skip_reason") if "skip_reason" in files.columns else F.lit(None).cast("string")
        encoding = F.col("encoding") if "encoding" in files.columns else F.lit(None).cast("string")
        count = lambda c: F.count(F.when(c, 1))
        seen = files.select("source", "path", "text", skip.alias("skip"), encoding.alias("encoding"))
        if notes is not None:
            seen = seen.unionByName(notes_as_files(notes), allowMissingColumns=True)
        known = [count(F.col("skip") == r).alias(r) for r in SKIPS]
        seen = seen.observe(read, *known, count((F.col("text").isNull() | F.col("path").isNull()) & ~F.coalesce(F.col("skip").isin(*SKIPS), F.lit(False))).alias("empty"), count(F.col("text").isNotNull() & (F.col("encoding") != "utf-8")).alias("other_encoding"))
        now = seen.where("path IS NOT NULL AND text IS NOT NULL").select("source", "path", content_hash("text").alias("hash"), "text")
        now = now.groupBy("path").agg(F.min_by(F.struct("source", "hash", "text"), "hash").alias("f")).select("f.source", "path", "f.hash", "f.text")
        folder = uuid.uuid4().hex
        tables = {"files": store.stored(exact.in_ranges(now, list(targets or [])), f"{self.folder}/data/{folder}", "files", ("part",))}
        now = store.loaded(self.spark, f"{self.folder}/data/{folder}", "files", tables["files"])
        embedded = semantic_files(now, list(graph_only))
        old = self.table("files").select("path", "hash") if compatible else now.select("path", "hash").limit(0)
        changes = snapshots.diff(old, now.select("path", "hash"))
        taken = embedded.limit(0).select("path", "source", F.col("hash").alias("file_hash"))
        if compatible and last.get("graph_only") == list(graph_only):
            kept = changes.where("status = 'unchanged'").select("path")
            taken = embedded.join(kept, "path", "left_semi").select("path", "source", F.col("hash").alias("file_hash"))
        fresh = embedded.join(taken.select("path"), "path", "left_anti")
        pieces = chunk_files(fresh).join(fresh.select("path", "source", F.col("hash").alias("file_hash")), "path")
        pieces = pieces.withColumn("id", joined_hash(F.lit(self.model), "path", "file_hash", "ordinal", "line_start", "text"))
        chunks = with_embeddings(pieces, self.embedder).withColumn("_new", F.lit(True))
        if compatible:
            chunks = self.table("chunks").join(taken, ["path", "source", "file_hash"], "left_semi").withColumn("_new", F.lit(False)).unionByName(chunks)
        chunks = chunks.observe(written, F.count("*").alias("chunks"), count(F.col("_new")).alias("embedded")).drop("_new")
        tables["chunks"] = self.vectors.save(folder, chunks, self.embedder.dimension)
        totals = Totals(snapshots.run_totals(changes).drop("sample").first().asDict())
        before = last["tables"]["chunks"]["rows"] if last else 0
        skipped, wrote = read.get, written.get
        taken_over = wrote["chunks"] - wrote["embedded"]
        totals.counts = {f"skipped_{r}": skipped[r] for r in (*SKIPS, "empty")} | {"other_encoding": skipped["other_encoding"], "chunks": wrote["chunks"], "embedded": wrote["embedded"], "taken_over": taken_over, "chunks_deleted": before - taken_over}
        run = self._logs["runs"].add({"folder": folder, "model": self.model, "at": _now_text(), "targets": list(targets or []), "graph_only": list(graph_only), **totals, "counts": totals.counts, "tables": tables}, "run")
        out = Totals({"run": run, **totals})
        out.counts = totals.counts
        return out

    # Graphs

    def build_graph(self, source: GraphSource, roots: list[str] = (".",)) -> dict:
        """The graph that ``source`` makes of the indexed code, the files that fit in its budget; saved as the current one."""
        if (why := source.available()) is not None:
            raise ValueError(f"no {source.language} graph: {why}")
        files = self.table("files").where("source = 'code'")
        chosen = budgets.graph_inputs(files.select("path", F.lit("source").alias("kind"), F.octet_length("text").alias("size")))
        own = files.join(chosen.select("path"), "path", "left_semi")
        nodes, edges = source.graph(own)
        return self.save_graph(*(x.withColumn("language", F.lit(source.language)) for x in (nodes, edges)), roots=roots)

    def save_graph(self, nodes: DataFrame, edges: DataFrame, *, roots: list[str] = (".",), files: DataFrame | None = None) -> dict:
        """Nodes (id, name, full_name, signature, path, line_start, line_end, file_hash) and edges (from_id, to_id, relation, ev_path, ev_line, file_hash) as the current graph, and its summary by the folders below ``roots``. Returns the graph's commit.

        Raises ValueError for rows that break a rule of ``graph.violations``; files in which they
        may lie are the code of ``files`` (source, path), of the index if None. Of each language,
        if both tables have that column, as much is kept as a shard holds: nodes by id, then edges
        by their ends; without both ends an edge stays and is passed over by searches.
        """
        current = self.current() if files is None else None
        allowed = files if files is not None else self.table("files") if current else None
        bad = graph.violations(nodes, edges, None if allowed is None else allowed.where("source = 'code'")).limit(5).collect()
        if bad:
            raise ValueError("a graph can't be stored: " + "; ".join(f"{r['kind']} {r['id']} in {r['path']}: {r['rule']}" for r in bad))
        nodes, edges, cut = self._shards(nodes, edges)
        folder = uuid.uuid4().hex
        path = f"{self.folder}/data/{folder}"
        tables = {"nodes": store.stored(nodes, path, "nodes"), "edges": store.stored(edges, path, "edges")}
        truncated = cut is not None and (cut[0] > tables["nodes"]["rows"] or cut[1] > tables["edges"]["rows"])
        fingerprint = f"{tables['nodes']['digest'][:32]}{tables['edges']['digest'][:32]}"
        said = {"folder": folder, "at": _now_text(), "truncated": truncated, "fingerprint": fingerprint, "tables": tables}
        number = self._logs["graphs"].add(said, "graph")
        self._save_summary(number, fingerprint, truncated, list(roots))
        return {"graph": number, **said}

    @staticmethod
    def _shards(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame, tuple[int, int]]:
        """What fits of each language, and how many rows there were."""
        by = "language" in nodes.columns and "language" in edges.columns
        names = sorted(r[0] for r in nodes.where("language IS NOT NULL").select("language").distinct().limit(MOST_LANGUAGES + 1).collect()) if by else [None]
        if len(names) > MOST_LANGUAGES:
            raise ValueError(f"a graph has at most {MOST_LANGUAGES} languages")
        size = lambda x: x.withColumn("_bytes", F.octet_length(F.to_json(F.struct(*x.columns))))
        kept = []
        for name in names:
            own = [x if name is None else x.where(F.col("language") == name) for x in (nodes, edges)]
            kept.append(graph.within_shard(size(own[0]), size(own[1]), "_bytes"))
        n, e = (kept[0][i] for i in (0, 1))
        for more in kept[1:]:
            n, e = n.unionByName(more[0]), e.unionByName(more[1])
        return n.drop("_bytes"), e.drop("_bytes"), (nodes.count(), edges.count())

    def _save_summary(self, number: int, fingerprint: str, cut: bool, roots: list[str]) -> None:
        nodes, edges = self.table("nodes"), self.table("edges")
        modules, members = summaries.summary(nodes, edges, roots)
        folder = uuid.uuid4().hex
        path = f"{self.folder}/data/{folder}"
        tables = {"modules": store.stored(modules, path, "modules"), "members": store.stored(members, path, "members")}
        counts = summaries.member_totals(self.spark.read.parquet(f"{path}/members"))
        truncated = cut or tables["members"]["rows"] < summaries.locators(nodes, edges).count() or tables["modules"]["rows"] >= hierarchy.MOST_MODULES
        self._logs["summaries"].add({"folder": folder, "at": _now_text(), "graph": number, "fingerprint": fingerprint, "truncated": truncated, "counts": counts, "tables": tables}, "summary")

    def summary(self) -> tuple[DataFrame, DataFrame] | None:
        """(modules, members) of the current graph; None if there are none, or only those of another graph."""
        commit, of = self._logs["summaries"].last(), self._logs["graphs"].last()
        if commit is None or of is None or commit["fingerprint"] != of["fingerprint"]:
            return None
        modules, members = self._loaded(commit, "modules", True), self._loaded(commit, "members", True)
        if f"counts of {commit['folder']}" not in self._checked and summaries.member_totals(members) != commit["counts"]:
            raise store.Damaged("the members of a summary are not as many as were committed")
        self._checked.add(f"counts of {commit['folder']}")
        return modules, members

    # Queries; each returns a DataFrame with one row more than ``limit`` if results are cut.
    # ``now``, the files (source, path, text) as they are, tells which hits still hold; without it the indexed files do.

    def _now(self, now: DataFrame | None) -> DataFrame:
        files = self.table("files") if now is None else now.where("path IS NOT NULL AND text IS NOT NULL").select("source", "path", "text", content_hash("text").alias("hash"))
        return files.select("source", "path", F.col("hash").alias("file_hash"), F.size(lines("text")).alias("n_lines"), "text")

    @staticmethod
    def _source(scope: str) -> str | None:
        return None if scope == "all" else "document" if scope == "documents" else scope

    def exact(self, query: str, scope: str = "all", limit: int = 50) -> DataFrame:
        """(path, line, text) of the lines that hold ``query``, or, if it looks like a path, of the paths that do, without a line; by the run's targets, then path. Files are read in that order, and no more of them than it takes."""
        exact.checked(query, limit)
        files, source = self.table("files"), self._source(scope)
        parts = [r[0] for r in files.select("part").distinct().orderBy("part").collect()]  # a row for each stored range
        return exact.ordered_matches(files if source is None else files.where(F.col("source") == source), parts, query, limit).select("path", "line", "text")

    def _near(self, commit: dict, query: str, source: str | None, limit: int, now: DataFrame | None) -> tuple[list[Row], int]:
        """The nearest chunks to a query in files that are still the same, 200 at most, and how many are not."""
        rows = self.vectors.nearest(commit["folder"], commit["tables"]["chunks"], self.embedder.embed([query])[0].tolist(), retrieval.overfetch(limit), source).collect()
        if now is None or not rows:
            return rows, 0
        paths = sorted({r["path"] for r in rows})
        same = now.where(F.col("path").isin(paths) & F.col("text").isNotNull()).select("path", "source", content_hash("text").alias("hash"))
        held = {tuple(r) for r in same.collect()}  # 200 paths at most
        fresh = [r for r in rows if (r["path"], r["source"], r["file_hash"]) in held]
        return fresh, len(rows) - len(fresh)

    def _semantic(self, query: str, scope: str, limit: int, now: DataFrame | None) -> tuple[DataFrame, int]:
        exact.checked(query, limit)
        commit = self.current()
        if commit is None:
            raise ValueError("nothing is indexed yet")
        source, best = self._source(scope), [F.col("score").desc(), F.col("id")]
        schema = "id string, path string, source string, file_hash string, line_start int, line_end int, score double"
        local = lambda rows: self.spark.createDataFrame([tuple(r) for r in rows], schema)
        rows, stale = self._near(commit, query, source, limit, now)
        found = [retrieval.first_of_each(local(rows), "path", *best)]
        names = None if query.isascii() else self.spark.range(1).select(routing.identifiers(F.lit(query))).first()[0]
        if names and names.lower() != query.lower():
            more, stale_more = self._near(commit, names, source, limit, now)
            second = retrieval.first_of_each(local(more).where(path_has_term("path", F.lit(names))), "path", *best)
            found, stale, rows = found + [second], stale + stale_more, rows + more
        if len(found) == 2 and found[1].isEmpty():  # local rows
            found.pop()
        if len(found) == 1:
            hits = found[0].orderBy(F.col("score").desc(), "path")
        else:
            both = found[0].drop("score", "rank").withColumn("list", F.lit(0)).union(found[1].drop("score", "rank").withColumn("list", F.lit(1)))
            hits = both.join(retrieval.fuse(found, "path"), ["path", "list"]).orderBy(F.col("score").desc(), "list", "rank", "path")
        first = hits.limit(limit + 1).select("id", "path", "line_start", "line_end", "score", "source").collect()
        texts = self.table("chunks").where(F.col("id").isin([r["id"] for r in first])).select("id", "text")
        ranked = self.spark.createDataFrame([(i, *r) for i, r in enumerate(first)], "n int, id string, path string, line_start int, line_end int, score double, source string")
        out = ranked.join(texts, "id").dropDuplicates(["n"]).orderBy("n").select("path", "line_start", "line_end", "text", "score", "source")
        return self.spark.createDataFrame(out.collect(), out.schema), stale

    def semantic(self, query: str, scope: str = "all", limit: int = 50, now: DataFrame | None = None) -> DataFrame:
        """(path, line_start, line_end, text, score, source): the nearest chunks, one for each path, of files that are still the same.

        Chunks are ranked by their vectors alone; only what comes first, 200 at most, is held
        against the files and given its text. A query with other than ASCII that has names in it is
        also asked by these alone; hits whose path holds one of them make a second list, and the
        lists are fused by their ranks.
        """
        return self._semantic(query, scope, limit, now)[0]

    def graph_answer(self, query: str, scope: str = "all", limit: int = 50, now: DataFrame | None = None) -> Answer:
        """Semantic hits, and places in the graph near them: of the nodes that overlap the lines of the first code hits, what is up to two edges away, in files that are still the same; the modules that hold those; and what no longer held.

        Nodes and edges are held against the files once and counted by that same job.
        """
        hits, stale_hits = self._semantic(query, scope, min(200, max(4 * limit, 32)), now)
        near = hits.select("path", "line_start", "line_end", F.greatest(F.lit(0.001), "score").alias("score"), F.lit("semantic").alias("kind"))
        folder = f"{self.folder}/scratch/{uuid.uuid4().hex}"

        def kept(table: DataFrame, name: str) -> DataFrame:
            table.write.parquet(f"{folder}/{name}")
            return self.spark.read.schema(table.schema).parquet(f"{folder}/{name}")

        try:
            modules, counts = self.spark.createDataFrame([], MODULES), {"stale_hits": stale_hits, "stale_nodes": 0, "stale_edges": 0, "dangling_edges": 0, "stale_members": 0}
            places = None
            if self._logs["graphs"].last() is not None:
                all_nodes, all_edges = self.table("nodes"), self.table("edges")
                named = all_nodes.select("path").union(all_edges.select("ev_path")).where("path IS NOT NULL").distinct()
                files = self._now(now).where("source = 'code'").join(named, "path", "left_semi").select("path", "file_hash", "n_lines")
                files = kept(files, "files")  # a row for each file of the graph
                nodes, edges, seen = self._observed(all_nodes, all_edges, files, kept)
                counts |= seen
                seeds = graph.seed_scores(hits.where("source = 'code'").select("path", "line_start", "line_end", "score"), [F.col("score").desc(), F.col("path"), F.col("line_start")])
                reached = graph.expand(graph.seed_nodes(seeds, nodes), edges).orderBy(F.col("score").desc(), "node").limit(graph.MOST_NODES)
                reached = self.spark.createDataFrame(reached.collect(), reached.schema)  # 400 rows
                last = F.least("line_end", F.col("line_start") + graph.NODE_LINES - 1).alias("line_end")
                places = reached.where("hop > 0").join(nodes, F.col("node") == F.col("id")).select("path", "line_start", last, "score", F.lit("graph").alias("kind"))
                modules, counts["stale_members"] = self._modules(reached, nodes, edges, files, kept)
            merged = graph.merge_candidates(near, near.limit(0) if places is None else places, limit)
            merged = self.spark.createDataFrame(merged.collect(), merged.schema)
            texts = self._now(now).where(F.col("path").isin([r["path"] for r in merged.select("path").distinct().collect()]))
            shown = graph.with_excerpts(merged, texts, "path", "line_start", "line_end", graph.NODE_LINES)
            shown = shown.orderBy(F.col("score").desc(), "path", "line_start", "line_end")
            return Answer(self.spark.createDataFrame(shown.collect(), shown.schema), modules, counts)
        finally:
            store.remove(self.spark, folder)

    @staticmethod
    def _observed(nodes: DataFrame, edges: DataFrame, files: DataFrame, kept) -> tuple[DataFrame, DataFrame, dict]:
        """Nodes and edges that still hold, and counts of the others, observed as these are written."""
        of_nodes, of_edges = Observation(), Observation()
        count = lambda c: F.count(F.when(c, 1))
        known = graph.told_fresh(nodes, files, "path", "line_end", "_fresh")
        known = known.observe(of_nodes, count(~F.col("_fresh") & F.col("path").isNotNull()).alias("stale_nodes"))
        fresh = kept(known.where("_fresh").drop("_fresh"), "nodes")
        told = graph.told_fresh(edges, files, "ev_path", graph.last_line(edges), "_fresh")
        ends = nodes.select("id").distinct().withColumn("_known", F.lit(True)).join(fresh.select("id", F.lit(True).alias("_held")).distinct(), "id", "left")
        for side in ("from_id", "to_id"):
            told = told.join(ends.withColumnsRenamed({"id": side, "_known": f"_known_{side}", "_held": f"_held_{side}"}), side, "left")
        missing = F.col("_known_from_id").isNull() | F.col("_known_to_id").isNull()
        holds = F.col("_fresh") & F.col("_held_from_id").isNotNull() & F.col("_held_to_id").isNotNull()
        told = told.observe(of_edges, count(missing).alias("dangling_edges"), count(~missing & ~holds).alias("stale_edges"))
        held = kept(told.where(holds).select(*edges.columns), "edges")
        return fresh, held, {**of_nodes.get, **of_edges.get}

    def _modules(self, reached: DataFrame, nodes: DataFrame, edges: DataFrame, files: DataFrame, kept) -> tuple[DataFrame, int]:
        """The modules of what was reached, held against the summary's own locators, and how many of the summary's members no longer hold."""
        known, of_members = self.summary(), Observation()
        if known is None:
            return self.spark.createDataFrame([], MODULES), 0
        modules, members = known
        told = graph.told_fresh(members, files, "path", "line_end", "_fresh").observe(of_members, F.count(F.when(~F.col("_fresh"), 1)).alias("stale_members"))
        members = kept(told.where("_fresh").drop("_fresh"), "members")
        own = nodes.join(reached.select(F.col("node").alias("id")), "id", "left_semi")
        ends = reached.select(F.col("node").alias("_end"), "hop")
        walked = edges.join(ends.withColumnsRenamed({"_end": "from_id", "hop": "_from"}), "from_id").join(ends.withColumnsRenamed({"_end": "to_id", "hop": "_to"}), "to_id")
        walked = walked.where(F.least("_from", "_to") < graph.HOPS).select(*edges.columns)
        shown = hierarchy.shown(modules, summaries.held(members, own, walked))
        out = shown.join(modules.select("id", "parent_id", "kind", "path"), "id").select("id", "parent_id", "kind", "path", "nodes", "edges").orderBy("path", "id")
        return self.spark.createDataFrame(out.collect(), MODULES), of_members.get["stale_members"]  # 64 rows

    def graph_search(self, query: str, scope: str = "all", limit: int = 50, now: DataFrame | None = None) -> DataFrame:
        """The ``places`` of ``graph_answer``, which has modules and counts besides."""
        return self.graph_answer(query, scope, limit, now).places

    def search(self, query: str, mode: str = "auto", scope: str = "all", limit: int = 50) -> tuple[str, DataFrame]:
        """The mode that answered (exact, graph or semantic) and its rows. "auto" goes by the query's text, and by meaning where the first way finds nothing."""
        exact.checked(query, limit)
        symbol = direction = None
        chosen = mode
        if mode == "auto":
            chosen, symbol, direction = self.spark.range(1).select(routing.route(F.lit(query), scope).alias("r")).first()["r"]
        if chosen == "exact":
            out = self.exact(query, scope, limit)
        elif chosen == "graph":
            out = self.trace(symbol or query, direction or "callees", limit)
        else:
            return chosen, self.semantic(query, scope, limit)
        if mode == "auto" and out.isEmpty():
            return "semantic", self.semantic(query, scope, limit)
        return chosen, out

    def read(self, path: str, start: int = 1, end: int | None = None) -> DataFrame:
        """The lines of one file; no row if there is no such file, or it ends before."""
        return exact.bounded_read(self.table("files").where(F.col("path") == path), start, end)

    def trace(self, symbol: str, direction: str = "callees", limit: int = 50, now: DataFrame | None = None, language: str | None = None) -> DataFrame:
        """Stored edges from or to the symbol; raises if a name means several full names. With ``now`` only edges that still hold at both ends and where they were seen, with the ``text`` of that place. ``language`` keeps to the nodes of one, if the graph says which."""
        nodes = self.table("nodes")
        nodes = nodes if language is None or "language" not in nodes.columns else nodes.where(F.col("language") == language)
        matched = graph.match_symbols(nodes, symbol)
        names = [r["full_name"] for r in matched.select("full_name").distinct().limit(11).collect()]
        if len(names) > 1:
            raise ValueError(f"{symbol} means several symbols: {', '.join(sorted(names)[:10])}")
        side = "to_id" if direction == "callers" else "from_id"
        edges = self.table("edges").join(matched.select(F.col("id").alias(side)), side, "left_semi")
        if direction in ("inherits", "implements"):
            edges = edges.where(F.col("relation") == direction)
        if now is not None:
            files = self._now(now).where("source = 'code'")
            edges = graph.fresh_edges(edges, files, graph.fresh_nodes(self.table("nodes"), files))
        order = ["ev_path", "ev_line", "relation", "from_id", "to_id"]
        edges = edges.orderBy(*order).limit(limit + 1)
        if now is None:
            return edges
        return graph.with_excerpts(edges, files, "ev_path", "ev_line", graph.last_line(edges), graph.EDGE_LINES).orderBy(*order)

    def impact(self, history: HistorySource | DataFrame, target: str, limit: int = 50) -> DataFrame:
        """What changed with ``target``, by a table (commit, path, changed_at) or a source of one; one row more than ``limit`` if it is cut."""
        if isinstance(history, HistorySource):
            if (why := history.available()) is not None:
                raise ValueError(f"no history: {why}")
            history = history.changes()
        return hierarchy.cochange(history, target, limit + 1)

    def modules(self) -> DataFrame:
        return hierarchy.modules(self.table("files"))

    def status(self, files: DataFrame) -> DataFrame:
        """One row: the last run, how ``files`` (path, text) differ from it, and whether there are a graph and a summary and all that they say of files still holds (absent, stale or ready)."""
        run = self.current()
        now = files.where("path IS NOT NULL AND text IS NOT NULL").select("path", content_hash("text").alias("hash"))
        old = self.table("files").select("path", "hash") if run else now.limit(0)
        state = snapshots.run_totals(snapshots.diff(old, now)).drop("sample")
        stale = F.col("changed") + F.col("new") + F.col("deleted") > 0
        of = self._logs["graphs"].last()
        graph_status, summary_status = "absent", "absent"
        if of is not None:
            places = self.table("nodes").select("path", "file_hash").union(self.table("edges").select("ev_path", "file_hash")).where("path IS NOT NULL").distinct()
            gone = places.join(now.withColumnRenamed("hash", "file_hash"), ["path", "file_hash"], "left_anti")
            graph_status = "ready" if gone.isEmpty() else "stale"
            summary_status = "absent" if self._logs["summaries"].last() is None else graph_status if self.summary() is not None else "stale"
        known = [F.lit(run["run"] if run else None).cast("long").alias("run"), F.when(F.lit(run is None), "unavailable").when(stale, "degraded").otherwise("ready").alias("status")]
        return state.select(*known, "*", F.lit(of["graph"] if of else None).cast("long").alias("graph"), F.lit(graph_status).alias("graph_status"), F.lit(summary_status).alias("summary_status"))
