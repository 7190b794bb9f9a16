"""Tables in folders, put in force by numbered commits that say what each table holds.

A commit is one small JSON file that is created whole or not at all, and never replaced: of
writers that race for a number one gets it, the others take the next. It names its tables with
their rows, a digest of these that no order changes, and a digest of the names and lengths of
their files. So a table is told from one that lost, gained or changed a file.
"""

from __future__ import annotations

import hashlib
import json
import os
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of a commit.
MOST_COMMIT = 512 << 10


class Damaged(ValueError):
    """A stored table is not what its commit says."""


def _path(spark: SparkSession, path: str):
    out = spark._jvm.org.apache.hadoop.fs.Path(path)
    return out, out.getFileSystem(spark._jsc.hadoopConfiguration())


def row_digest(table: DataFrame) -> list:
    """The columns of an aggregation that digests a table: rows, and sums of two hashes of each row, in any order."""
    # A hash passes over nulls, so it gets which columns are null besides.
    nulls = F.concat(F.lit(""), *[F.when(F.col(f"`{c}`").isNull(), "0").otherwise("1") for c in table.columns])
    own = [F.xxhash64(F.lit(seed), nulls, *[F.col(f"`{c}`") for c in table.columns]).cast("decimal(38,0)") for seed in (1, 2)]
    return [F.count("*").alias("rows"), *[F.coalesce(F.sum(h), F.lit(0)).cast("string").alias(f"h{i}") for i, h in enumerate(own)]]


def digest(table: DataFrame) -> tuple[int, str]:
    """How many rows a table has, and a digest that equal tables share whatever their order and files."""
    row = table.agg(*row_digest(table)).first()
    kinds = json.dumps([(f.name, f.dataType.simpleString()) for f in table.schema])
    return row["rows"], hashlib.sha256(f"{kinds}\n{row['h0']}\n{row['h1']}".encode()).hexdigest()


def files_digest(spark: SparkSession, folder: str) -> tuple[int, str]:
    """How many data files a folder has, and a digest of their names and lengths."""
    path, fs = _path(spark, folder)
    own, each = [], fs.listFiles(path, True) if fs.exists(path) else None
    while each is not None and each.hasNext():
        x = each.next()
        if not x.getPath().getName().startswith(("_", ".")):
            own.append(f"{x.getPath().getParent().getName()}/{x.getPath().getName()} {x.getLen()}\n")
    return len(own), hashlib.sha256("".join(sorted(own)).encode()).hexdigest()


def stored(table: DataFrame, folder: str, name: str, by: tuple[str, ...] = ()) -> dict:
    """Writes ``table`` to a folder of its own, in folders by the columns ``by`` if there are any, and returns its entry for a commit."""
    (table.write.partitionBy(*by) if by else table.write).parquet(f"{folder}/{name}")
    return entry(table.sparkSession, folder, name)


def entry(spark: SparkSession, folder: str, name: str) -> dict:
    rows, content = digest(spark.read.parquet(f"{folder}/{name}"))
    files, listing = files_digest(spark, f"{folder}/{name}")
    return {"rows": rows, "digest": content, "files": files, "listing": listing}


def loaded(spark: SparkSession, folder: str, name: str, said: dict, deep: bool = False) -> DataFrame:
    """The table ``name`` of a commit's folder; raises Damaged if files are missing, more or of other lengths, and if ``deep``, which reads all rows, if contents differ."""
    if files_digest(spark, f"{folder}/{name}") != (said["files"], said["listing"]):
        raise Damaged(f"files of {name} in {folder} are not those that were committed")
    out = spark.read.parquet(f"{folder}/{name}")
    if deep and digest(out) != (said["rows"], said["digest"]):
        raise Damaged(f"rows of {name} in {folder} are not those that were committed")
    return out


def create_new(spark: SparkSession, path: str, text: str) -> bool:
    """Creates a file with all its text, or returns False if there is one already; of those who race for it one wins."""
    target, fs = _path(spark, path)
    fs.mkdirs(target.getParent())
    aside = spark._jvm.org.apache.hadoop.fs.Path(target.getParent(), f".{uuid.uuid4().hex}")
    if fs.getScheme() == "file":  # where renaming replaces, linking does not
        own, wanted = aside.toUri().getPath(), target.toUri().getPath()
        with open(own, "w", encoding="utf-8") as f:
            f.write(text)
        try:
            os.link(own, wanted)
        except FileExistsError:
            return False
        finally:
            os.unlink(own)
        return True
    out = fs.create(aside, True)
    out.write(bytearray(text.encode()))
    out.close()
    options = spark._jvm.org.apache.hadoop.fs.Options.Rename
    none = spark.sparkContext._gateway.new_array(options, 1)
    none[0] = options.NONE
    try:
        spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration()).rename(aside, target, none)
    except Exception as e:
        fs.delete(aside, False)
        if "FileAlreadyExists" in str(e):
            return False
        raise
    return True


def new_folder(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share, ``spark.checkpoint.dir``; where that is unset and all run on one machine, as in tests, in one of our own."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        shared = f"file://{tempfile.mkdtemp(prefix='spark-')}"
        spark.conf.set("spark.checkpoint.dir", shared)
    return f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"


class Log:
    """The commits of one kind under a folder, numbered from 1."""

    def __init__(self, spark: SparkSession, folder: str, schema: str):
        self.spark, self.folder, self.schema = spark, folder, schema

    def numbers(self) -> list[int]:
        path, fs = _path(self.spark, self.folder)
        names = [x.getPath().getName() for x in fs.listStatus(path)] if fs.exists(path) else []
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def _file(self, number: int) -> str:
        return f"{self.folder}/{number:010d}.json"

    def read(self, number: int) -> dict:
        path, fs = _path(self.spark, self._file(number))
        if fs.getFileStatus(path).getLen() > MOST_COMMIT:
            raise Damaged(f"commit {path} has more than {MOST_COMMIT} bytes")
        stream = fs.open(path)
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        try:
            return json.loads(text)
        except ValueError as e:
            raise Damaged(f"commit {path} can't be read") from e

    def last(self) -> dict | None:
        """The commit in force."""
        numbers = self.numbers()
        return self.read(numbers[-1]) if numbers else None

    def add(self, value: dict, number: str) -> int:
        """Puts ``value`` in force under the next number that is free, which it carries as ``number``."""
        n = max(self.numbers(), default=0) + 1
        while not create_new(self.spark, self._file(n), json.dumps({number: n, **value}, sort_keys=True)):
            n += 1
        return n

    def table(self) -> DataFrame:
        """All commits as rows, without what is said about tables."""
        if not self.numbers():
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).json(f"{self.folder}/*.json")


def children(spark: SparkSession, folder: str) -> list[str]:
    """The names of what lies in a folder, none if there is no such folder; without those of unfinished tables."""
    path, fs = _path(spark, folder)
    own = [x.getPath() for x in (fs.listStatus(path) if fs.exists(path) else [])]
    return sorted(x.getName() for x in own if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(x, "_SUCCESS")))


def folders(spark: SparkSession, folder: str) -> list[str]:
    """The names of the folders in a folder, none if there is no such folder."""
    path, fs = _path(spark, folder)
    return sorted(x.getPath().getName() for x in (fs.listStatus(path) if fs.exists(path) else []) if x.isDirectory())


def small_text(spark: SparkSession, path: str) -> str | None:
    """The text of a file of MOST_COMMIT bytes at most; None if there is none, or a longer one."""
    own, fs = _path(spark, path)
    if not fs.exists(own) or not fs.getFileStatus(own).isFile() or fs.getFileStatus(own).getLen() > MOST_COMMIT:
        return None
    stream = fs.open(own)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def remove(spark: SparkSession, folder: str) -> None:
    path, fs = _path(spark, folder)
    fs.delete(path, True)


def forget(spark: SparkSession, folder: str, keep: set[str], seconds: int) -> list[str]:
    """Deletes what lies in ``folder`` under names that aren't in ``keep`` and has not been changed for so many seconds; returns the names."""
    path, fs = _path(spark, folder)
    old = [x.getPath() for x in (fs.listStatus(path) if fs.exists(path) else []) if x.getPath().getName() not in keep and x.getModificationTime() <= (time.time() - seconds) * 1000]
    return sorted(x.getName() for x in old if fs.delete(x, True))
