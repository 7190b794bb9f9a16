"""What a similarity join leaves on disk while it goes on."""

import os

from pyspark.sql import functions as F

from tidemark.llm.common import release, shared_dir, staged
from tidemark.llm.lines import line_groups, named_lines


def shuffled(spark) -> set[str]:
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {x for i in range(files.size()) if (x := files.apply(i).getName()).startswith("shuffle")}


def test_shuffle_files_go_when_a_table_is_staged(spark):
    before = shuffled(spark)
    rows = spark.range(10_000).groupBy((F.col("id") % 100).alias("k")).agg(F.count("*").alias("n"))
    out = staged(rows, "rows")
    assert shuffled(spark) <= before
    assert {r["n"] for r in out.collect()} == {100} and out.count() == rows.count() == 100
    release(out)


def test_blocks_go_when_buckets_are_known(spark):
    """Blocks take more room than all else; of the tables that a wide comparison stages none of them stays."""
    text = ["All rights reserved by the owners of it", "all rights reserved by the owner of it", "quite another line of text, this one"]
    docs = spark.createDataFrame([*enumerate(text)], "doc_id long, text string")
    named = named_lines(docs, 1, wide=True).select("id", "h", F.explode(F.arrays_zip("lines", "nodes")).alias("x"))
    nodes = staged(named.groupBy(F.col("x.nodes").alias("node")).agg(F.min(F.struct("id", "h")).alias("first"), F.count("*").alias("n")), "nodes")
    held = lambda: {x for x in os.listdir(shared_dir(spark).removeprefix("file://")) if x.startswith("blocks-")}
    before = held()
    groups = line_groups(docs, nodes, 80, "text", wide=True).collect()
    assert len(groups) == 2 and len({bytes(r["component"]) for r in groups}) == 1
    assert held() == before
