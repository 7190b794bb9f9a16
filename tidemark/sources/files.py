"""Files, Markdown notes and asset references as tables."""

from __future__ import annotations

import posixpath
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.text import META_GUID, asset_kind, content_hash, extension, guids, is_text_file, lines, parent_directory, project_key, trimmed
from tidemark.sources import store
from tidemark.sources.frontmatter import mapping
from tidemark.sources.globs import excluded, glob_pattern, ignore_pattern  # noqa: F401

# Fixed value: the first heading of a note.
HEADING = r"(?m)^#\s+(.+?)\s*#*\s*$"
# The file that registers a project's folder of notes, and the names of such folders and of their notes.
MARKER, PROJECT_SLUG, LABEL = ".project-path", "[a-z0-9]+(?:-[a-z0-9]+)*", "[a-z0-9]+(?:_[a-z0-9]+)*"
#: Bytes of a file that is read, and files of a project.
MOST_BYTES, MOST_FILES = 2 << 20, 100_000


def target_folders(code: list[str], documents: list[str] = ()) -> list[str]:
    """Folders of code, then of documents, as an exact search goes through them; raises ValueError for one outside of the project."""
    out = []
    for folder in (*code, *documents):
        own = folder.replace("\\", "/")
        depth = 0
        for part in own.split("/"):
            depth += 0 if part in ("", ".") else -1 if part == ".." else 1
            if depth < 0:
                break
        if depth < 0 or own.startswith("/") or re.match("[A-Za-z]:", own):
            raise ValueError(f"{folder} is not inside of the project")
        out.append(posixpath.normpath(own))
    return list(dict.fromkeys(out))


def semantic_files(files: DataFrame, globs: list[str]) -> DataFrame:
    """``files`` (source, path, ...) that are embedded: code whose path fits one of ``globs`` isn't, documents always are. Graphs are made of all."""
    for glob in globs:
        files = files.where((F.col("source") != "code") | ~F.col("path").rlike(glob_pattern(glob)))
    return files


def notes_as_files(notes: DataFrame) -> DataFrame:
    """(source, path, text): notes (project_slug, label, text) as documents under paths of their own, to be indexed beside a project's files."""
    return notes.select(F.lit("document").alias("source"), F.concat(F.lit("@handoff/"), "project_slug", F.lit("/"), "label", F.lit(".md")).alias("path"), "text")


def matching_projects(projects: DataFrame, path_col: str = "path") -> DataFrame:
    """The projects that alone have their path, slashes and case apart, with ``key``; a path that several have names none."""
    own = projects.withColumn("key", project_key(projects[path_col]))
    single = own.groupBy("key").agg(F.count("*").alias("_n")).where("_n = 1").select("key")
    return own.join(single, "key", "left_semi").select(*own.columns)


def classified(files: DataFrame, code: list[str], documents: list[str]) -> DataFrame:
    """``files`` with ``source``, code or document, by the folders that hold them; those in none go. A folder of documents within one of code holds documents."""
    inside = lambda folders: F.lit(False) if not folders else F.concat(F.lit("/"), F.col("path")).rlike("^(?:" + "|".join(r"/.*" if f.strip("/") in ("", ".") else rf"/{re.escape(f.strip('/'))}(?:/.*)?$" for f in folders) + ")")
    return files.withColumn("source", F.when(inside(documents), "document").when(inside(code), "code")).where("source IS NOT NULL")


def scan(spark: SparkSession, root: str, *, code: list[str], documents: list[str] = (), excludes: list[str] = (), most: int = MOST_FILES) -> DataFrame:
    """(source, path, hash, length, encoding, text, skip_reason) of the text files under ``root``, without those that a glob of ``excludes`` turns away, as of the configuration or of an ignore file.

    Text is UTF-8, else the extended Korean code page; files over 2 MiB, with NUL bytes or in
    neither encoding have a reason and no text. Contents of larger files are never read. Folders
    that aren't there hold nothing; ones outside of ``root``, and more than ``most`` files, raise
    ValueError. Files are counted by their names alone, and no further than that.
    """
    code, documents = target_folders(list(code)), target_folders(list(documents))
    prefix = root.rstrip("/") + "/"
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    prefix = prefix.removeprefix("file://")
    relative = F.substr(F.col("path"), F.position(F.lit(prefix), F.col("path")) + F.lit(len(prefix)))
    small, large = raw.where(F.col("length") <= MOST_BYTES), raw.where(F.col("length") > MOST_BYTES)
    raw = small.select(relative.alias("path"), "length", "content").union(large.select(relative, "length", F.lit(None).cast("binary"))).where(is_text_file("path"))
    own = classified(raw.where(~excluded("path", list(excludes))), code, documents)
    if own.select("path").limit(most + 1).count() > most:
        raise ValueError(f"the project has more than {most} files")
    fits = F.col("length") <= MOST_BYTES
    content = F.when(fits, F.col("content"))
    utf8 = F.when(F.is_valid_utf8(content.cast("string")), content.cast("string"))

    @F.pandas_udf("string")
    def korean(raw):
        import pandas as pd

        def text(x):
            try:
                return None if x is None else bytes(x).decode("cp949", "strict")
            except UnicodeDecodeError:
                return None

        return pd.Series([text(x) for x in raw], dtype=object)

    nul = F.position(F.lit(b"\0"), content) > 0
    other = F.when(utf8.isNull() & ~nul, content)
    own = own.select("source", "path", F.when(fits, content_hash("content")).alias("hash"), "length", utf8.alias("utf8"), nul.alias("nul"), korean(other).alias("korean"))
    text = F.when(~F.col("nul"), F.coalesce("utf8", "korean"))
    reason = F.when(F.col("length") > MOST_BYTES, "too_large").when(F.col("nul"), "binary").when(text.isNull(), "undecodable")
    return own.select("source", "path", "hash", "length", F.when(text.isNotNull(), F.when(F.col("utf8").isNotNull(), "utf-8").otherwise("euc-kr")).alias("encoding"), text.alias("text"), reason.alias("skip_reason"))


def markdown_metadata(notes: DataFrame, *, label_col: str = "label", text_col: str = "text") -> DataFrame:
    """``notes`` with ``title`` (a string of the front matter, else the first heading, else the label) and ``date`` (a string of the form YYYY-MM-DD of the front matter, or null).

    Front matter stands between two lines ``---``, the first of them the text's first line; what
    isn't a mapping is passed over. Only these lines are parsed, and only where there are any.
    """
    text = F.regexp_replace(F.regexp_replace(F.col(text_col), "^\ufeff", ""), "\r\n?", "\n")
    front = F.nullif(F.regexp_extract(text, r"\A---\n((?s:.+?))\n---(?:\n|\z)", 1), F.lit(""))

    @F.pandas_udf("struct<title string, date string>")
    def parsed(raw):
        import pandas as pd

        found = [mapping(x) if isinstance(x, str) else {} for x in raw]
        return pd.DataFrame({k: pd.Series([x.get(k) for x in found], dtype=object) for k in ("title", "date")})

    own = notes.withColumn("_front", front).withColumn("_own", parsed("_front"))
    heading = F.nullif(F.trim(F.regexp_extract(text, HEADING, 1)), F.lit(""))
    title, date = F.nullif(trimmed(F.col("_own.title")), F.lit("")), F.col("_own.date")
    return own.withColumn("title", F.coalesce(title, heading, F.col(label_col))).withColumn("date", F.when(date.rlike(r"^\d{4}-\d{2}-\d{2}\z"), date)).drop("_front", "_own")


def registered_projects(spark: SparkSession, root: str) -> DataFrame:
    """(project_slug, project_path, key): the folders in ``root`` that a marker file registers for the project whose path it holds, by slug.

    Folders without a marker, with one that is empty or holds NUL, or with other names are none.
    Spark's readers pass over names with a dot in front, so markers are read by name, one for each folder.
    """
    found = []
    for name in store.folders(spark, root):
        text = store.small_text(spark, f"{root.rstrip('/')}/{name}/{MARKER}") if re.fullmatch(PROJECT_SLUG, name) else None
        if text is not None and text.strip() and "\0" not in text:
            found.append((name, text.strip()))
    rows = spark.createDataFrame(found, "project_slug string, project_path string")
    return rows.withColumn("key", project_key("project_path"))


def handoffs(spark: SparkSession, root: str, projects: DataFrame | None = None) -> DataFrame:
    """(project_slug, label, document_id, title, date, modified_at, path, text) of the Markdown notes in the project folders under ``root``, newest first.

    With ``projects`` (project_slug, project_path), as ``registered_projects`` gives them, only notes
    that lie in these folders themselves and have the name of a note, with ``project_path``.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.[mM][dD]").load(root)
    own = raw.select(F.regexp_extract("path", "([^/]+)/[^/]+$", 1).alias("project_slug"), F.regexp_extract("path", r"(?i)([^/]+)\.md$", 1).alias("label"), F.col("modificationTime").alias("modified_at"), "path", F.col("content").cast("string").alias("text"))
    if projects is not None:
        inside = F.regexp_replace("path", "^[a-zA-Z0-9]+:/+", "/").rlike("^" + re.escape(re.sub("^[a-zA-Z0-9]+:/+", "/", root.rstrip("/"))) + "/[^/]+/[^/]+$")
        own = own.where(inside & F.col("label").rlike(f"^{LABEL}$")).join(projects.select("project_slug", "project_path"), "project_slug")
    own = markdown_metadata(own).withColumn("document_id", F.concat_ws("/", "project_slug", "label"))
    return own.orderBy(F.coalesce("date", F.lit("")).desc(), F.col("modified_at").desc(), "label")


def asset_references(assets: DataFrame, dependencies: DataFrame | None = None) -> DataFrame:
    """Edges (from_id, to_id, relation, ev_path, ev_line) from assets (path, text) to those that their lines name by id.

    A .meta file states the id of the file beside it. An id that none states is an unresolved target.
    ``dependencies`` (path, target) of an editor's own database, paths of assets both, are edges of
    another relation, seen in line 1; those of other files than ``assets`` are passed over.
    """
    meta = assets.where(extension("path") == ".meta")
    named = meta.select(F.lower(F.regexp_extract("text", META_GUID, 1)).alias("guid"), F.regexp_replace("path", r"(?i)\.meta$", "").alias("target")).where("guid <> ''")
    named = named.groupBy("guid").agg(F.min("target").alias("target"))
    each = assets.where(extension("path") != ".meta").select("path", F.posexplode(lines("text")).alias("i", "line"))
    found = each.select("path", (F.col("i") + 1).alias("line"), F.explode(guids("line")).alias("guid"))
    joined = found.join(named, "guid", "left")
    target = F.coalesce("target", F.concat(F.lit("unresolved:"), "guid"))
    edges = joined.select(F.col("path").alias("from_id"), target.alias("to_id"), F.lit("references").alias("relation"), F.col("path").alias("ev_path"), F.col("line").alias("ev_line"))
    if dependencies is not None:
        known = assets.select("path").distinct()
        own = dependencies.where("target IS NOT NULL").select("path", "target").join(known, "path", "left_semi").join(known.withColumnsRenamed({"path": "_known"}), F.col("target") == F.col("_known"), "left")
        target = F.coalesce("_known", F.concat(F.lit("unresolved:"), "target"))
        edges = edges.union(own.select("path", target, F.lit("asset_database_dependency"), "path", F.lit(1)))
    return edges.distinct()


def match_assets(assets: DataFrame, symbol: str) -> DataFrame:
    """(id): the assets (path, text) that ``symbol`` means, in any case: a path, a file's name without extension, or the id that a .meta file states, which means the file beside it too."""
    wanted = symbol.replace("\\", "/").lower()
    name = F.regexp_replace(F.regexp_extract("path", "[^/]*$", 0), r"(?<=.)\.[^.]*$", "")
    meta = extension("path") == ".meta"
    fits = (F.lower("path") == wanted) | (F.lower(name) == wanted) | (meta & (F.lower(F.regexp_extract("text", META_GUID, 1)) == wanted))
    ids = F.when(meta, F.array("path", F.regexp_replace("path", r"(?i)\.meta$", ""))).otherwise(F.array("path"))
    return assets.where(fits).select(F.explode(ids).alias("id")).distinct()


def asset_trace(assets: DataFrame, edges: DataFrame, symbol: str, direction: str = "callees", limit: int = 50) -> DataFrame:
    """The ``edges`` from (callees) or to (callers) the assets that ``symbol`` means, by their evidence, ``limit`` and one more; raises ValueError if it means none."""
    found = match_assets(assets, symbol)
    if found.isEmpty():
        raise ValueError(f"{symbol} is no asset")
    side = "to_id" if direction == "callers" else "from_id"
    own = edges.join(found.withColumnRenamed("id", side), side, "left_semi").select(*edges.columns)
    return own.orderBy("ev_path", "ev_line", "relation", "from_id", "to_id").limit(limit + 1)


def asset_nodes(assets: DataFrame) -> DataFrame:
    return assets.select(F.col("path").alias("id"), F.regexp_extract("path", "[^/]*$", 0).alias("name"), asset_kind("path").alias("kind"), parent_directory("path").alias("folder"), content_hash("text").alias("file_hash"))
