"""Document fingerprints of closed syncmers, in DataFrame functions only.

A text's tokens are its runs of non-space, in lower case. A k-mer of tokens is an anchor when, of
the hashes of its inner s-mers, the least stands at one of its edges. Whether it is one depends on
the k-mer alone, so an edit changes only the anchors that touch it, and what two texts share
gives both the same anchors, in the same order.
"""

from __future__ import annotations

import itertools
import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import release, staged

#: Tokens of an anchor and of its inner s-mers (pairs); two of seven k-mers are anchors.
K = 8


def let(value, body) -> F.Column:
    """``body`` of ``value``, which is computed once however often the body names it."""
    return F.transform(F.array(value), body)[0]


def tokens(text) -> F.Column:
    return F.array_remove(F.split(F.lower(text), r"\s+"), "")


def anchors(text, k: int = K) -> F.Column:
    """array<bigint>: the 32-bit hashes of a text's anchors in order. Fewer than k tokens are one anchor; none, no anchor.

    Of k to k + 4 tokens, many texts have no closed syncmer: their least k-mer is their anchor, so that only texts without tokens have none.
    """
    inner = k - 1  # pairs in a k-mer

    def of_pairs(pairs):
        def name(i):
            return F.shiftrightunsigned(F.xxhash64(*[F.get(pairs, i + j) for j in (*range(0, inner - 1, 2), inner - 1)]), 32)

        def anchor(first, i):
            edge = F.least(first, F.get(pairs, i + inner - 1))
            middle = F.least(*[F.get(pairs, i + j) for j in range(1, inner - 1)])
            return F.when(edge <= middle, name(i))

        starts = F.slice(pairs, 1, F.size(pairs) - (inner - 1))
        found = F.filter(F.transform(starts, anchor), lambda x: x.isNotNull())
        return let(found, lambda x: F.when(F.size(x) > 0, x).otherwise(F.array(F.array_min(F.transform(starts, lambda _, i: name(i))))))

    def of_hashes(h):
        n = F.size(h)
        pairs = F.transform(F.slice(h, 1, n - 1), lambda x, i: F.xxhash64(x, F.get(h, i + 1)))
        short = F.when(n > 0, F.array(F.shiftrightunsigned(F.xxhash64(h), 32))).otherwise(F.array().cast("array<bigint>"))
        return F.when(n < k, short).otherwise(let(pairs, of_pairs))

    return let(F.transform(tokens(text), lambda x: F.xxhash64(x)), of_hashes)


def fingerprint(hashes) -> F.Column:
    """Anchors as one string, eight lower-case hexadecimal digits each."""
    return F.lower(F.array_join(F.transform(hashes, lambda x: F.lpad(F.hex(x), 8, "0")), ""))


def likeness(x, y) -> F.Column:
    """Positional likeness, 0 to 1: of the different anchors of both, the share that both have, less one for each break in their order; 1 of two without anchors.

    The anchors that both have stand in some order in each text, by where they are first. Two that
    follow each other in both orders match in position. A passage that was moved breaks the order at
    its ends, a text in another order breaks it everywhere, what was put in or left out does not.
    """

    def linked(shared):
        return F.transform(F.slice(shared, 1, F.greatest(F.size(shared) - 1, F.lit(0))), lambda a, i: F.xxhash64(a, F.get(shared, i + 1)))

    def of_shared(s):
        n = F.size(s["x"])
        kept = F.size(F.array_intersect(linked(s["x"]), linked(s["y"])))
        union = F.size(F.array_distinct(x)) + F.size(F.array_distinct(y)) - n
        return F.when(union == 0, F.lit(1.0)).when(n == 0, F.lit(0.0)).otherwise((kept + 1) / union)

    return let(F.struct(F.array_intersect(x, y).alias("x"), F.array_intersect(y, x).alias("y")), of_shared)


#: Ranges of documents for each shuffle partition at least, bytes of text in one, about, and ranges in all: the driver holds two keys of each.
RANGES, RANGE_BYTES, MOST_RANGES = 4, 256 << 20, 32_768


@dataclass
class Ranges:
    """Where rows by (id, r, salt) are cut into ranges, and which documents stand at a range's beginning."""

    #: The least (id, r, salt) of each range, ascending.
    bounds: list[tuple]
    #: (range, 0, id, r) of the document before a range's first one (before the first: the last of all), (range, 1, id, r) of the first one.
    heads: list[tuple]


def ranges(rows: DataFrame) -> Ranges:
    """Ranges of about equally many of ``rows`` (id, r, salt, size in bytes): a document is the rows that share id and r, and may fill several."""
    spark = rows.sparkSession
    keys = staged(rows, "keys")
    held = keys.agg(F.sum("size")).first()[0] or 0
    parts = min(MOST_RANGES, max(RANGES * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-held // RANGE_BYTES)))
    cut = staged(keys.repartitionByRange(parts, "id", "r", "salt").withColumn("part", F.spark_partition_id()), "ranges")
    own = F.struct("id", "r")
    ends = cut.groupBy("part").agg(F.min(F.struct("id", "r", "salt")).alias("least"), F.max(own).alias("last"))
    other = cut.join(ends.select("part", "last"), "part").where(own < F.col("last")).groupBy("part").agg(F.max(own).alias("before"))
    found = sorted(ends.join(other, "part", "left").collect(), key=lambda x: x["part"])  # MOST_RANGES at most
    release(keys, cut)
    heads = []
    for p, row in enumerate(found):
        first = row["least"][:2]
        behind = (tuple(x) for q in itertools.chain(range(p - 1, -1, -1), range(len(found) - 1, p - 1, -1)) for x in (found[q]["last"], found[q]["before"]) if x is not None)
        heads += [(p, 0, *next((x for x in behind if x != tuple(first)), first)), (p, 1, *first)]
    return Ranges([tuple(x["least"]) for x in found], heads)


def range_of(bounds: list[tuple], key, kind: str) -> F.Column:
    """The number of the last of ``bounds`` that isn't greater than ``key`` (0 if all are), by halving."""
    low = F.from_json(F.lit(json.dumps([dict(zip(("id", "r", "salt"), x)) for x in bounds])), f"array<struct<id:{kind},r:bigint,salt:bigint>>")
    steps = [1 << i for i in reversed(range(max(1, len(bounds)).bit_length()))]
    return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), lambda at, step: F.when(F.get(low, at + step) <= key, at + step).otherwise(at))


def fingerprint_edits(docs: DataFrame, k: int = K, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: its id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text has the last floor(n_chars / 2) code points replaced by the first as many of
    the next document. Null texts are empty. Rows with equal id and text are one document, given
    as often as they occur; rows with equal ids and other texts are in order of a hash of the
    text; a null id comes last. A single document is its own next one.

    Texts are shuffled once, to ranges of ids, in which a row finds its follower; each range is
    given the document before it.
    """
    spark, kind = docs.sparkSession, docs.schema[id_col].dataType.simpleString()
    texts = docs.select(docs[id_col].alias("id"), F.coalesce(docs[text_col], F.lit("")).alias("text")).withColumn("r", F.bitwise_not(F.xxhash64("text")))
    salt = F.pmod(F.monotonically_increasing_id(), F.lit(997)).alias("salt")
    cut = ranges(texts.select("id", "r", salt, F.octet_length("text").cast("long").alias("size")))
    heads = spark.createDataFrame(cut.heads, f"part int, at int, id {kind}, r long")
    heads = texts.join(F.broadcast(heads), texts.id.eqNullSafe(heads.id) & (texts.r == heads.r)).select("part", "at", texts.id, "text", texts.r).dropDuplicates(["part", "at"])
    part = range_of(cut.bounds, F.struct("id", "r", "salt"), kind)
    rows = texts.select("*", salt).select(part.alias("part"), F.lit(1).alias("at"), "id", "text", "r", F.lit(True).alias("own")).unionByName(heads.withColumn("own", F.lit(False)))

    # By ascending id, the next document is the last one with another key.
    over = Window.partitionBy("part").orderBy("at", "id", "r")
    so_far = over.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    key = F.struct("at", "id", "r")
    rows = rows.withColumn("starts", F.lag(key).over(over) != key)
    rows = rows.withColumn("lagged", F.when(F.col("starts"), F.lag("text").over(over))).withColumn("next", F.last("lagged", ignorenulls=True).over(so_far)).drop("lagged")
    rows = rows.withColumn("anchors", anchors("text", k))
    rows = rows.withColumn("lagged", F.when(F.col("starts"), F.lag("anchors").over(over))).withColumn("next_anchors", F.last("lagged", ignorenulls=True).over(so_far))
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - half), F.substring("next", F.lit(1), half))
    out = rows.where("own").select("id", n.cast("long").alias("n_chars"), edited.alias("edited"), F.col("anchors").alias("own"), "next_anchors")
    out = out.select("*", anchors("edited", k).alias("other"))
    return out.select(
        F.col("id").alias(id_col), "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), fingerprint("own").alias("fingerprint"),
        fingerprint("other").alias("edited_fingerprint"), likeness("own", "other").alias("near_edited"), likeness("own", "next_anchors").alias("near_next"),
    )
