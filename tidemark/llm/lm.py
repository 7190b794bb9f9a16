"""Language-model scoring by cross-entropy difference.

A target and a background corpus give two models over one vocabulary, each a mean, in logarithms,
of a unigram and a bigram model with additive smoothing. Background counts are scaled to the
target's number of words, so that smoothing weighs alike in both. A text is scored by models of
the other half of both corpora, so none is scored by what it taught, and exact copies, which share
a half, aren't either. Its score is what a word costs the background model more than the target's.

A text's loss is a sum over its n-grams of functions of their counts alone. So n-grams go to
buckets by hash, a row for each lot of texts and bucket with the places of its n-grams; a bucket
counts its own and returns each text's part of the sum, and n-grams are shuffled once. N-grams
that make up a 20,000th of all words are few; their counts go to the tasks, and their places are
never shuffled.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import staged
from tidemark.llm.decontamination import SEPARATORS
from tidemark.llm.kernels import byte_table, chunks, cut_points, mix, packed, unpacked, words

#: Words of a lot of whole texts, about; a bucket has n-grams of four times as many.
LOT = 1_000_000
#: An n-gram with this share of all words, or more, is hot: at most so many of each order are.
HOT = 20_000
#: What each count is raised by, and the bigram model's weight.
ALPHA, WEIGHT = 0.1, 0.5
END = np.uint64(0xA24BAED4963EE407)
ORDER = np.uint64(1)


def ngram_keys(h: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each word of texts of n words: a key of the word, and one of the word with its follower or the text's end. The last bit tells them apart."""
    after = np.empty_like(h)
    after[:-1] = h[1:]
    after[np.cumsum(n)[n > 0] - 1] = END
    return mix(h) & ~ORDER, mix(h * np.uint64(0x9E3779B97F4A7C15) + mix(after)) | ORDER


@dataclass
class Sizes:
    """What both models share: words of vocabulary with the end, and for each half the words of target and background."""

    vocabulary: int
    target: np.ndarray
    background: np.ndarray

    def parts(self, key: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """(2 halves, 2 models, n): what an n-gram adds to a text's log-probability, for a text in each half; ``counts`` are (halves of target and background, n)."""
        out = np.empty((2, 2, len(key)))
        two = (key & ORDER).astype(bool)
        for half in (0, 1):
            other = 1 - half
            own = float(self.target[other])
            scale = own / self.background[other] if self.background[other] else 0.0
            for model, c in enumerate((counts[other].astype(float), counts[2 + other] * scale)):
                single = (1 - WEIGHT) * np.log((c + ALPHA) / (own + ALPHA * self.vocabulary)) - WEIGHT * np.log(c + ALPHA * self.vocabulary)
                out[half, model] = np.where(two, WEIGHT * np.log(c + ALPHA), single)
        return out


def _lots(batches):
    """Lots of whole texts, from columns id, half and text: ids, halves, words per text, keys (words', then bigrams') with the text of each, and a digest of the texts in their order."""
    import pyarrow as pa
    import xxhash

    def lot(held):
        ids = pa.concat_arrays([x[0] for x in held])
        half, n, h = (np.concatenate([x[i] for x in held]) for i in (1, 2, 3))
        doc = np.repeat(np.arange(len(n), dtype=np.uint32), n)
        digest = xxhash.xxh64(n.tobytes() + h.tobytes()).intdigest() >> 1
        return ids, half, n, np.concatenate(ngram_keys(h, n)), np.concatenate([doc, doc]), digest

    table, held, total = byte_table(SEPARATORS), [], 0
    for batch in batches:
        for row, data, starts, ends in chunks(batch.column(2)):
            h, _, _, n = words(data, starts, ends, table)
            rows = slice(row, row + len(n))
            held.append((batch.column(0)[rows], batch.column(1).to_numpy(zero_copy_only=False)[rows].astype(np.int64), n, h))
            total += len(h)
            if total >= LOT:
                yield lot(held)
                held, total = [], 0
    if held:
        yield lot(held)


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, half (by the MD5 of the text, so equal texts share one) and text."""
    text = F.coalesce(docs[text_col], F.lit(""))
    return docs.select(docs[id_col].alias("id"), (F.substring(F.md5(text.cast("binary")), 1, 1) >= "8").cast("int").alias("half"), text.alias("text"))


def _seen(batches):
    """(key, n) of each lot: of all words, and of bigrams that are frequent in it."""
    import pyarrow as pa

    for _, _, n, key, *_ in _lots(batches):
        key, count = np.unique(key, return_counts=True)
        keep = ((key & ORDER) == 0) | (count * 2 * HOT >= n.sum())
        yield pa.RecordBatch.from_arrays([pa.array(key[keep].view(np.int64)), pa.array(count[keep])], names=["key", "n"])


def _hot_counts(hot: np.ndarray, part: int):
    """Counts of hot keys, and under key -1 of all words, for each half."""

    def count(batches):
        import pyarrow as pa

        total = np.zeros((len(hot) + 1, 2), dtype=np.int64)
        for _, half, n, key, doc, _ in _lots(batches):
            at, found = _among(hot, key)
            total += np.bincount(np.append(at[found] * 2 + half[doc[found]], np.repeat(len(hot) * 2 + half, n)), minlength=total.size).reshape(total.shape)
        keys = np.append(hot.view(np.int64), np.int64(-1))
        for half in (0, 1):
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.full(len(keys), part + half, dtype=np.int32)), pa.array(total[:, half])], names=["key", "part", "n"])

    return count


def _among(sorted_keys: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each key would stand among the sorted ones, and whether it is there."""
    if not len(sorted_keys):
        return np.zeros(len(key), dtype=np.int64), np.zeros(len(key), dtype=bool)
    at = np.minimum(np.searchsorted(sorted_keys, key), len(sorted_keys) - 1)
    return at, sorted_keys[at] == key


PLACES = "bucket int, lot long, first long, keys binary, counts binary, docs binary, digest long"


def _places(hot: np.ndarray, buckets: int, with_docs: bool):
    """A row for each lot and bucket: its different keys that aren't hot, in which texts each occurs, and the lot's digest.

    Texts are numbered with those of half 0 first; ``first`` has how many these are and how many
    texts there are. ``counts`` has a bit for each text in ``docs``: whether another key begins.
    Without texts, ``counts`` has each key's number in either half, and ``first`` is -1.
    """

    def place(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        bounds = cut_points(buckets)
        for number, (_, half, n, key, doc, digest) in enumerate(_lots(batches)):
            rank = np.empty(len(half), dtype=np.uint32)
            rank[np.argsort(half, kind="stable")] = np.arange(len(half), dtype=np.uint32)
            cold = ~_among(hot, key)[1]
            key, doc = key[cold], rank[doc[cold]]
            order = np.argsort(key, kind="stable")
            key, doc = key[order], doc[order]
            first = np.flatnonzero(np.append(True, key[1:] != key[:-1])[: len(key)])
            own, end = key[first], np.append(first[1:], len(key))
            zeros = int((half == 0).sum())
            cuts = np.concatenate([[0], np.searchsorted(own, bounds), [len(own)]])
            rows = np.flatnonzero(np.diff(cuts))
            at = np.append(first, len(key))[cuts]
            columns = [[packed(own[cuts[b] : cuts[b + 1]]) for b in rows]]
            if with_docs:
                begins = np.zeros(len(key), dtype=bool)
                begins[first] = True
                doc = doc.astype(np.uint16 if len(half) <= 1 << 16 else np.uint32)
                columns += [[np.packbits(begins[at[b] : at[b + 1]]).tobytes() for b in rows], [doc[at[b] : at[b + 1]].tobytes() for b in rows]]
            else:
                low = np.concatenate([[0], np.cumsum(doc < zeros)])
                low = low[end] - low[first]
                counts = np.stack([low, end - first - low]).astype(np.uint32)
                columns += [[counts[:, cuts[b] : cuts[b + 1]].tobytes() for b in rows], [b""] * len(rows)]
            lot = pa.array(np.full(len(rows), (task << 32) + number, dtype=np.int64))
            texts = pa.array(np.full(len(rows), (zeros << 32) + len(half) if with_docs else -1, dtype=np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(rows.astype(np.int32)), lot, texts, *(pa.array(x, pa.binary()) for x in columns), pa.array(np.full(len(rows), digest, dtype=np.int64))], names=["bucket", "lot", "first", "keys", "counts", "docs", "digest"])

    return place


SUMS = "lot long, digest long, docs binary, sums binary"


def _bucket_sums(sizes: Sizes):
    """For the rows of PLACES of one bucket: what the bucket's n-grams add to the log-probabilities of each lot's texts."""

    def of_bucket(rows):
        import pyarrow as pa

        keys = [unpacked(r[3]) for r in rows]
        unique, inverse = np.unique(np.concatenate(keys), return_inverse=True)
        ends = np.cumsum([len(k) for k in keys])
        counts = np.zeros((4, len(unique)))

        def entries(r, own):
            zeros, texts = r[2] >> 32, r[2] & (1 << 32) - 1
            doc = np.frombuffer(r[5], dtype=np.uint16 if texts <= 1 << 16 else np.uint32)
            begins = np.unpackbits(np.frombuffer(r[4], dtype=np.uint8), count=len(doc))
            return own[np.cumsum(begins, dtype=np.int64) - 1], doc, doc >= zeros, texts

        for r, end, k in zip(rows, ends, keys):
            own = inverse[end - len(k) : end]
            if r[2] < 0:
                counts[:2, own] += np.frombuffer(r[4], dtype=np.uint32).reshape(2, -1)
            else:
                own, _, half, _ = entries(r, own)
                counts[2:] += np.bincount(own * 2 + half, minlength=2 * len(unique)).reshape(-1, 2).T
        parts = sizes.parts(unique, counts)
        out = []
        for r, end, k in zip(rows, ends, keys):
            if r[2] >= 0:
                own, doc, half, texts = entries(r, inverse[end - len(k) : end])
                seen = np.flatnonzero(np.bincount(doc, minlength=texts))
                sums = [np.bincount(doc, weights=parts[half.astype(np.int64), model, own], minlength=texts)[seen] for model in (0, 1)]
                out.append((r[1], r[6], seen.astype(np.uint32).tobytes(), np.stack(sums).tobytes()))
        columns = list(zip(*out)) or [()] * 4
        kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, kinds)], names=["lot", "digest", "docs", "sums"])

    def run(batches):
        rows = [row for batch in batches for row in zip(*(x.to_pylist() for x in batch.columns))]  # one bucket's
        if rows:
            yield of_bucket(rows)

    return run


def _lot_heads(hot: np.ndarray, hot_parts: np.ndarray):
    """A row for each lot: its digest, its texts' ids and words, and what hot n-grams add to their log-probabilities, numbered as by ``_places``."""

    def head(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        for number, (ids, half, n, key, doc, digest) in enumerate(_lots(batches)):
            at, found = _among(hot, key)
            at, doc = at[found], doc[found]
            sums = [np.bincount(doc, weights=hot_parts[half[doc], model, at], minlength=len(half)) for model in (0, 1)]
            order = np.argsort(half, kind="stable")
            whole = lambda x: pa.ListArray.from_arrays(pa.array([0, len(half)], pa.int32()), x)
            yield pa.RecordBatch.from_arrays([pa.array([(task << 32) + number]), pa.array([digest]), pa.array([None], pa.binary()), pa.array([np.stack(sums)[:, order].tobytes()], pa.binary()), whole(ids.take(pa.array(order))), whole(pa.array(n[order]))], names=["lot", "digest", "docs", "sums", "ids", "n"])

    return head


def _lot_totals(batches):
    """The rows of each lot, its head first, as a row for each text."""
    import pyarrow as pa

    def out(head, total):
        return pa.RecordBatch.from_arrays([head[0], head[1], *(pa.array(x) for x in total)], names=["id", "n_tokens", "target", "background"])

    lot = head = total = said = None
    for batch in batches:
        for i in range(len(batch)):
            own, digest, docs = (batch.column(c)[i].as_py() for c in range(3))
            sums = np.frombuffer(batch.column(3)[i].as_py()).reshape(2, -1)
            if docs is None:
                if head is not None:
                    yield out(head, total)
                lot, said, head, total = own, digest, (batch.column(4)[i].values, batch.column(5)[i].values), sums.copy()
            elif (own, digest) == (lot, said):
                total[:, np.frombuffer(docs, dtype=np.uint32)] += sums
            else:
                raise ValueError("the texts came in another order when they were read again; give a stored table")
    if head is not None:
        yield out(head, total)


def cross_entropy_difference(docs: DataFrame, target: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", target_text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: its id, n_tokens, target_loss, background_loss (nats a word), score (their difference; higher: more like the target).

    ``docs`` is the background corpus, ``target`` the texts of the target corpus, which may be
    among ``docs``; both are read several times, so they should be stored tables. Words are runs
    of letters, digits and non-ASCII, A-Z as a-z, told apart by 64-bit hashes. Null and empty texts
    teach nothing and have 0 everywhere. Rows are taken as they come: repeated rows count and are
    scored as often, null ids stay. Without target words both losses are equal.
    Lots of texts have digests, so texts that come in another order at a later reading raise an error.
    """
    own = _texts(docs, id_col, text_col)
    taught = target.select(target[target_text_col].alias("text"))
    taught = _texts(taught.withColumn("id", F.lit(0).cast("int")), "id", "text")
    seen = own.mapInArrow(_seen, "key long, n long").union(taught.mapInArrow(_seen, "key long, n long"))
    seen = staged(seen.groupBy("key").agg(F.sum("n").alias("n")), "seen")
    single = F.col("key").bitwiseAND(1) == 0
    vocabulary, total = seen.where(single).agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    hot = seen.where(F.col("n") * HOT >= F.lit(total)).select("key").collect()  # HOT of each order at most
    hot = np.sort(np.array([r["key"] for r in hot], dtype=np.int64).view(np.uint64))
    parts = "key long, part int, n long"
    counted = taught.mapInArrow(_hot_counts(hot, 0), parts).union(own.mapInArrow(_hot_counts(hot, 2), parts)).groupBy("key", "part").agg(F.sum("n").alias("n"))
    place = {int(k): i for i, k in enumerate([*hot.view(np.int64).tolist(), -1])}
    counts = np.zeros((4, len(hot) + 1), dtype=np.int64)
    for r in counted.collect():  # 8 * HOT + 4 at most
        counts[r["part"], place[r["key"]]] = r["n"]
    sizes = Sizes(vocabulary + 1, counts[:2, -1], counts[2:, -1])
    hot_parts = sizes.parts(hot, counts[:, :-1])

    buckets = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), total // (4 * LOT))
    places = own.mapInArrow(_places(hot, buckets, True), PLACES).union(taught.mapInArrow(_places(hot, buckets, False), PLACES))
    sums = places.repartitionById(buckets, "bucket").mapInArrow(_bucket_sums(sizes), SUMS)
    kind = docs.schema[id_col].dataType
    heads = own.mapInArrow(_lot_heads(hot, hot_parts), T.StructType([*T._parse_datatype_string(SUMS).fields, T.StructField("ids", T.ArrayType(kind)), T.StructField("n", T.ArrayType(T.LongType()))]))
    rows = heads.unionByName(sums, allowMissingColumns=True)
    rows = rows.repartition("lot").sortWithinPartitions("lot", F.col("docs").isNotNull())
    totals = rows.mapInArrow(_lot_totals, T.StructType([T.StructField("id", kind)]).add("n_tokens", "long").add("target", "double").add("background", "double"))
    loss = lambda x: F.when(F.col("n_tokens") > 0, -F.col(x) / F.col("n_tokens")).otherwise(0.0)
    scored = totals.select(F.col("id").alias(id_col), "n_tokens", loss("target").alias("target_loss"), loss("background").alias("background_loss"))
    return scored.withColumn("score", F.col("background_loss") - F.col("target_loss"))
