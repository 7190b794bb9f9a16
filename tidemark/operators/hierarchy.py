"""Folders as a tree of modules, each file with its deepest folder, and change history."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.text import nearest_root, parent_directory
from tidemark.operators.budgets import prefix_within
from tidemark.operators.graph import EDGE_CAP, NODE_CAP

MOST_MODULES = 2048
#: Modules and edges of an answer, and bytes of a stored summary.
SHOWN_MODULES, SHOWN_EDGES, SUMMARY_BYTES = 64, 1000, (12 << 20) - (128 << 10)
#: Assemblies of files that no definition covers, the first for those in an Editor folder.
ASSEMBLIES = ("Assembly-CSharp-Editor", "Assembly-CSharp")


def modules(items: DataFrame, most: int = MOST_MODULES, *, path_col: str = "path") -> DataFrame:
    """(id, parent_id, path, n): the root ".", every folder above an item, the first ``most`` by path, and how many items are right in it.

    Items of folders beyond ``most`` count in the nearest folder above that is kept. Counts are
    summed for each folder before anything else, so items are shuffled once.
    """
    own = items.select(parent_directory(items[path_col]).alias("path")).groupBy("path").agg(F.count("*").alias("n"))
    parts = F.split("path", "/")
    above = F.when(F.col("path") == ".", F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/")))
    chain = own.select("path", "n", above.alias("above"))
    kept = chain.select(F.explode("above").alias("dir")).distinct().orderBy("dir").limit(most - 1)
    steps = chain.select("path", "n", F.explode(F.concat(F.array(F.lit(".")), "above")).alias("dir"))
    inside = steps.join(kept.union(kept.sparkSession.createDataFrame([(".",)], "dir string")), "dir")
    depth = lambda c: F.when(c == ".", 0).otherwise(F.size(F.split(c, "/")))
    deepest = inside.groupBy("path", "n").agg(F.max_by("dir", depth(F.col("dir"))).alias("dir"))
    counts = deepest.groupBy("dir").agg(F.sum("n").alias("n"))
    all_dirs = kept.union(kept.sparkSession.createDataFrame([(".",)], "dir string"))
    out = all_dirs.join(counts, "dir", "left")
    parent = F.when(F.col("dir") == ".", None).otherwise(parent_directory("dir"))
    return out.select(F.col("dir").alias("id"), parent.alias("parent_id"), F.coalesce("n", F.lit(0)).alias("n"))


def cochange(commit_files: DataFrame, target, limit: int = 50, sample: int = 5) -> DataFrame:
    """(path, count, last_changed_at, commits): what changed in the commits (commit, path, changed_at) that touch ``target``: in how many, when last, and the newest ``sample`` of them.

    By count, then date, then path; the target itself isn't listed. Only commits of the target are joined.
    """
    touched = commit_files.where(F.col("path") == F.lit(target)).select("commit").distinct()
    others = commit_files.where(F.col("path") != F.lit(target)).join(touched, "commit", "left_semi").select("commit", "path", "changed_at").distinct()
    order = [F.col("count").desc(), F.col("last_changed_at").desc(), F.col("path")]
    found = others.groupBy("path").agg(F.count("*").alias("count"), F.max("changed_at").alias("last_changed_at")).orderBy(*order).limit(limit)
    # Only ``sample`` commits of each listed path are ever collected.
    newest = Window.partitionBy("path").orderBy(F.col("changed_at").desc(), F.col("commit").desc())
    first = others.join(found.select("path"), "path", "left_semi").withColumn("n", F.row_number().over(newest)).where(F.col("n") <= sample)
    commits = first.groupBy("path").agg(F.transform(F.sort_array(F.collect_list(F.struct("n", "commit"))), lambda x: x["commit"]).alias("commits"))
    return found.join(commits, "path").orderBy(*order)


def _between(folder: str, root: str) -> F.Column:
    """The folders from just below ``root`` down to ``folder``; none if they are the same."""
    parts, depth = F.split(folder, "/"), F.when(F.col(root) == ".", 0).otherwise(F.size(F.split(root, "/")))
    below = (F.col(folder) != ".") & (F.size(parts) > depth)
    steps = F.transform(F.sequence(depth + 1, F.greatest(F.size(parts), depth + 1)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    return F.when(below, steps).otherwise(F.array().cast("array<string>"))


def _folders(items: DataFrame, roots: list[str]) -> DataFrame:
    return items.select(parent_directory(items["path"]).alias("folder"), nearest_root(items["path"], roots).alias("root")).where("folder IS NOT NULL AND root IS NOT NULL").distinct()


def tree(items: DataFrame, roots: list[str], most: int = MOST_MODULES) -> DataFrame:
    """(id, parent_id, kind, path): the project, its few code ``roots``, and the folders between a root and an item (path), the first by path, ``most`` modules in all.

    A root within another is its child. A folder comes after those above it, so a kept one's
    parents are kept. Items in no root make no module.
    """
    roots = sorted({*roots})
    parent = lambda r: max((x for x in roots if x != r and (x == "." or r.startswith(f"{x}/"))), key=lambda x: (x != ".", len(x)), default=None)
    top = [("project", None, "project", None)] + [(f"root:{r}", "project" if parent(r) is None else f"root:{parent(r)}", "code_root", r) for r in roots]
    fixed = items.sparkSession.createDataFrame(top, "id string, parent_id string, kind string, path string")
    inside = _folders(items, roots).select("root", F.explode(_between("folder", "root")).alias("path")).distinct()
    kept = inside.where(~F.col("path").isin(roots)).orderBy("path").limit(max(0, most - 1 - len(roots)))
    above = parent_directory("path")
    up = F.when((above == F.col("root")) | (above == "."), F.concat(F.lit("root:"), "root")).otherwise(F.concat(F.lit("directory:"), above))
    return fixed.union(kept.select(F.concat(F.lit("directory:"), "path"), up, F.lit("directory"), "path"))


def placed(items: DataFrame, modules: DataFrame, roots: list[str]) -> DataFrame:
    """``items`` (path, ...) with ``module``, the id of the deepest one that holds them. Folders are matched once, however many items they have."""
    own = _folders(items, roots)
    known = modules.where("kind = 'directory'").select(F.col("path").alias("step"))
    deepest = own.select("folder", "root", F.explode(_between("folder", "root")).alias("step")).join(known, "step").groupBy("folder", "root").agg(F.max("step").alias("step"))
    place = own.join(deepest, ["folder", "root"], "left").select(F.col("folder").alias("_folder"), F.col("root").alias("_root"), F.coalesce(F.concat(F.lit("directory:"), "step"), F.concat(F.lit("root:"), "root")).alias("module"))
    keyed = items.withColumn("_f", parent_directory(items["path"])).withColumn("_r", nearest_root(items["path"], roots))
    return keyed.join(place, (F.col("_f") == F.col("_folder")) & (F.col("_r") == F.col("_root"))).select(*items.columns, "module")


def members(nodes: DataFrame, edges: DataFrame, modules: DataFrame, roots: list[str]) -> DataFrame:
    """(module, kind, id, path): the first nodes and edges (id, path) by id, as many as a stored graph has, in their modules."""
    first = lambda x, kind, n: x.select(F.lit(kind).alias("kind"), "id", "path").orderBy("id", "path").limit(n)
    return placed(first(nodes, "node", NODE_CAP).union(first(edges, "edge", EDGE_CAP)), modules, roots).select("module", "kind", "id", "path")


def member_counts(held: DataFrame) -> DataFrame:
    """(module, nodes, edges, sources) of ``members``; sources are different paths."""
    count = lambda kind: F.count(F.when(F.col("kind") == kind, 1)).alias(f"{kind}s")
    return held.groupBy("module").agg(count("node"), count("edge"), F.count_distinct("path").alias("sources"))


def within_bytes(held: DataFrame, size_col: str, budget: int = SUMMARY_BYTES) -> DataFrame:
    """The members that fit in a summary, by module, kind and id."""
    return prefix_within(held, ["module", "kind", "id", "path"], size_col, budget, NODE_CAP + EDGE_CAP)


def ancestors(modules: DataFrame) -> DataFrame:
    """(id, ancestor, steps): each module with itself and all above it; a circle is walked once. For stored trees, of MOST_MODULES modules at most."""
    return modules.sparkSession.sql(
        """
        WITH RECURSIVE up AS (
            SELECT id, id AS ancestor, 0 AS steps, array(id) AS seen FROM {modules}
            UNION ALL
            SELECT up.id, m.parent_id, up.steps + 1, array_append(up.seen, m.parent_id)
            FROM up JOIN {modules} m ON m.id = up.ancestor WHERE m.parent_id IS NOT NULL AND NOT array_contains(up.seen, m.parent_id)
        )
        SELECT id, ancestor, steps FROM up
        """,
        modules=modules,
    )


def shown(modules: DataFrame, held: DataFrame, most: int = SHOWN_MODULES, most_edges: int = SHOWN_EDGES) -> DataFrame:
    """(id, nodes, edges): the modules that an answer shows, of ``held`` (module, kind, id), the members that are still the same.

    Of the edges the first ``most_edges`` by module and id count. A module with members comes with
    all above it, which show none of their own; by path, one whose whole chain doesn't fit in
    ``most`` modules any more is passed over.
    """
    place = F.struct((F.col("parent_id").isNotNull()).alias("below"), F.coalesce("path", F.lit("")).alias("path"), "id")
    order = modules.select(F.col("id").alias("module"), place.alias("place"))
    edges = held.where("kind = 'edge'").join(order, "module").orderBy("place", "id").limit(most_edges).select("module", "kind")
    counted = held.where("kind = 'node'").select("module", "kind").union(edges).groupBy("module").agg(F.count(F.when(F.col("kind") == "node", 1)).alias("nodes"), F.count(F.when(F.col("kind") == "edge", 1)).alias("edges"))
    chains = counted.join(ancestors(modules).withColumnRenamed("id", "module"), "module").groupBy("module").agg(F.collect_list("ancestor").alias("chain"))
    rows = chains.join(order, "module").agg(F.sort_array(F.collect_list(F.struct("place", "chain"))).alias("all"))  # as many as there are modules
    step = lambda kept, x: F.when(F.size(F.array_union(kept, x["chain"])) <= most, F.array_union(kept, x["chain"])).otherwise(kept)
    chosen = rows.select(F.explode(F.aggregate("all", F.array().cast("array<string>"), step)).alias("id"))
    return chosen.join(counted.withColumnRenamed("module", "id"), "id", "left").select("id", F.coalesce("nodes", F.lit(0)).alias("nodes"), F.coalesce("edges", F.lit(0)).alias("edges"))


def assembly_of(files: DataFrame, definitions: DataFrame) -> DataFrame:
    """``files`` (path, ...) with ``assembly``: the name in the nearest of ``definitions`` (directory, name) at or above a file, else one of two by whether an Editor folder holds it."""
    own = files.select(parent_directory("path").alias("folder")).where("folder IS NOT NULL").distinct().withColumn("root", F.lit("."))
    named = definitions.groupBy(F.col("directory").alias("step")).agg(F.min("name").alias("name"))
    steps = own.select("folder", F.explode(F.concat(F.array(F.lit(".")), _between("folder", "root"))).alias("step"))
    depth = F.when(F.col("step") == ".", 0).otherwise(F.size(F.split("step", "/")))
    nearest = steps.join(named, "step").groupBy("folder").agg(F.max_by("name", depth).alias("_name")).withColumnRenamed("folder", "_folder")
    keyed = files.withColumn("_f", parent_directory("path"))
    other = F.when(F.exists(F.split("path", "/"), lambda x: F.lower(x) == "editor"), ASSEMBLIES[0]).otherwise(ASSEMBLIES[1])
    return keyed.join(nearest, F.col("_f") == F.col("_folder"), "left").select(*files.columns, F.coalesce("_name", other).alias("assembly"))
