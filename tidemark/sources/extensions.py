"""What a user may plug in: where vectors are kept, what makes a graph, and where history comes from."""

from __future__ import annotations

from abc import ABC, abstractmethod

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import retrieval, snapshots
from tidemark.sources import files as sources
from tidemark.sources import store


class VectorStore(ABC):
    """Versions of a table of chunks (id, path, source, file_hash, line_start, line_end, text, embedding, ...), each under a name; a version doesn't change once it is saved."""

    @abstractmethod
    def save(self, version: str, chunks: DataFrame, dimension: int) -> dict:
        """Keeps ``chunks`` and returns what a commit says of them; raises ValueError if a vector has another dimension."""

    @abstractmethod
    def load(self, version: str, said: dict) -> DataFrame:
        """The chunks of a version; raises Damaged if they are not what was said."""

    @abstractmethod
    def forget(self, keep: set[str], seconds: int) -> list[str]:
        """Deletes versions that aren't in ``keep`` and are older, and returns their names."""

    def upsert(self, version: str, said: dict, rows: DataFrame, new: str) -> dict:
        """A version ``new`` from another, in which ``rows`` replace those of their ids."""
        return self.save(new, snapshots.upsert(self.load(version, said), rows), said["dimension"])

    def delete(self, version: str, said: dict, ids: DataFrame, new: str) -> dict:
        """A version ``new`` from another, without the ids (id)."""
        return self.save(new, self.load(version, said).join(ids.select("id"), "id", "left_anti"), said["dimension"])

    def nearest(self, version: str, said: dict, query: list[float], k: int, source: str | None = None) -> DataFrame:
        """(id, path, source, file_hash, line_start, line_end, score): the ``k`` chunks nearest to a vector. Only vectors and places are read, and no vector is shuffled."""
        if len(query) != said["dimension"]:
            raise ValueError(f"the query has {len(query)} dimensions, the vectors {said['dimension']}")
        own = self.load(version, said)
        own = own if source is None else own.where(F.col("source") == source)
        place = ["id", "path", "source", "file_hash", "line_start", "line_end"]
        return retrieval.nearest(own.select(*place, "embedding"), query, k).select(*place, "score")


class ParquetVectors(VectorStore):
    """Versions as folders of Parquet files."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def save(self, version: str, chunks: DataFrame, dimension: int) -> dict:
        said = store.stored(chunks, f"{self.folder}/{version}", "chunks")
        wrong = self.spark.read.parquet(f"{self.folder}/{version}/chunks").where(F.size("embedding") != dimension).limit(1).count()
        if wrong:
            raise ValueError(f"a vector has not {dimension} dimensions")
        return {**said, "dimension": dimension}

    def load(self, version: str, said: dict) -> DataFrame:
        return store.loaded(self.spark, f"{self.folder}/{version}", "chunks", said)

    def forget(self, keep: set[str], seconds: int) -> list[str]:
        return store.forget(self.spark, self.folder, keep, seconds)


class GraphSource(ABC):
    """Something that reads a graph out of files, a compiler say."""

    #: What its nodes are told apart by.
    language: str

    def available(self) -> str | None:
        """Why it can't be used now; None if it can."""
        return None

    @abstractmethod
    def graph(self, files: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Nodes (id, name, full_name, signature, path, line_start, line_end, file_hash) and edges (from_id, to_id, relation, ev_path, ev_line, file_hash) of files (source, path, hash, text)."""


class AssetGraph(GraphSource):
    """Which assets refer to which, by the ids that their lines name; targets that none states stay out."""

    language = "asset"

    def graph(self, files: DataFrame) -> tuple[DataFrame, DataFrame]:
        own = files.where("text IS NOT NULL").select("path", "text")
        named = sources.asset_nodes(own)
        last = own.select("path", F.size(F.split(F.regexp_replace("text", "\r\n?", "\n"), "\n", -1)).alias("line_end"))
        nodes = named.join(last, named["id"] == last["path"]).select("id", "name", F.col("id").alias("full_name"), F.col("id").alias("signature"), "path", F.lit(1).alias("line_start"), "line_end", "file_hash")
        hashes = named.select(F.col("id").alias("_path"), "file_hash")
        edges = sources.asset_references(own).where(~F.col("to_id").startswith("unresolved:"))
        return nodes, edges.join(hashes, edges["ev_path"] == hashes["_path"]).drop("_path")


class HistorySource(ABC):
    """Something that knows which files changed together."""

    def available(self) -> str | None:
        return None

    @abstractmethod
    def changes(self) -> DataFrame:
        """(commit, path, changed_at): a row for each file of each commit."""


class ChangeTable(HistorySource):
    """History as a table of changes."""

    def __init__(self, rows: DataFrame):
        self.rows = rows

    def changes(self) -> DataFrame:
        return self.rows.select("commit", "path", "changed_at")
