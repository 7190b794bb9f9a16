"""Web archives: written as one gzip stream a file, then normalised to a member a record with an offset index.

Files are written and read through pyarrow's file systems, in the folder that all machines share.
A task names its files by its attempt; only those that the committed tables list are ever read, so
a task that runs again, or twice at once, does no harm.
"""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import new_folder, staged
from tidemark.llm.links import in_filter, row_filter

#: Uncompressed bytes after which a task begins another archive.
ARCHIVE_BYTES = 256 << 20
#: Payloads from this size on are written once.
REVISIT_BYTES = 1000
BLOCK = 1 << 20

HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX = "archive string, offset long, length long, record_id string, record_type string, target_uri string"


def file_system(uri: str):
    """The pyarrow file system of a URI or plain path, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def record_bytes(headers: dict[str, str], block: bytes) -> bytes:
    """A WARC/1.1 record; line ends in header values become %0D and %0A."""
    lines = [f"{k}: {v}".replace("\r", "%0D").replace("\n", "%0A") for k, v in headers.items() if v is not None]
    return "\r\n".join(["WARC/1.1", *lines, f"Content-Length: {len(block)}", "", ""]).encode() + block + b"\r\n\r\n"


def parse_record(record: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and block of one record."""
    head, _, rest = record.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"no WARC record: {lines[0][:40]!r}")
    headers = dict(x.split(": ", 1) for x in lines[1:] if ": " in x)
    return headers, rest[: int(headers["Content-Length"])]


def records(blocks):
    """Whole records from the gzip stream in ``blocks`` of bytes: of one member, or of many. Inflated once, a block at a time."""
    inflate = zlib.decompressobj(31)
    held, need = bytearray(), 0
    for block in blocks:
        while block:
            held += inflate.decompress(block)
            block = inflate.unused_data
            if inflate.eof:
                inflate = zlib.decompressobj(31)
        at = 0
        while True:
            if not need:
                end = held.find(b"\r\n\r\n", at)
                if end < 0:
                    break
                size = next(int(x[15:]) for x in held[at:end].split(b"\r\n") if x[:15].lower() == b"content-length:")
                need = end + 4 + size + 4 - at
            if len(held) - at < need:
                break
            yield bytes(held[at : at + need])
            at, need = at + need, 0
        del held[:at]
    if held:
        raise EOFError("the archive ends within a record")


def _blocks(uri: str):
    fs, path = file_system(uri)
    with fs.open_input_stream(path, compression=None) as f:
        while block := f.read(BLOCK):
            yield block


def write_monolithic(pages: DataFrame, folder: str, *, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", level: int = 1) -> DataFrame:
    """Archives of all rows, each file one gzip stream; returns (archive, records) for each file.

    A null payload is an empty one. Of equal payloads of ``REVISIT_BYTES`` or more, the row with
    the largest id is the response and rows with smaller or no id are revisits of it; rows that
    share the largest id are all responses. Ids and digests meet by digest, without payloads; a
    payload is shuffled only if its digest occurs twice, by id and digest, so equal ones spread.
    """
    own = pages.select(pages[id_col].cast("string").alias("id"), pages[id_col].alias("key"), pages[url_col].alias("url"), F.coalesce(pages[payload_col], F.lit("")).alias("payload"))
    own = own.withColumn("digest", F.sha1(F.col("payload").cast("binary")))
    light = own.where(F.octet_length("payload") >= REVISIT_BYTES).select("key", "digest")
    twice = staged(light.groupBy("digest").agg(F.max("key").alias("first"), F.count("*").alias("n")).where("n > 1 AND first IS NOT NULL").drop("n"), "twice")
    likely = in_filter(pages.sparkSession.sparkContext.broadcast(row_filter(twice.select(F.xxhash64("digest")))))(F.xxhash64("digest"))
    revisits = light.where(likely).join(twice, "digest").where("key IS NULL OR key < first")
    revisits = revisits.select(F.col("key").alias("_key"), F.col("digest").alias("_digest"), F.col("first").cast("string").alias("first")).distinct()
    columns = ["id", "url", "payload", "digest", "first"]
    typed = own.where(likely).join(revisits, F.col("key").eqNullSafe(F.col("_key")) & (F.col("digest") == F.col("_digest")), "left").select(*columns)
    typed = typed.union(own.where(~likely).withColumn("first", F.lit(None).cast("string")).select(*columns))

    def write(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        fs, base = file_system(folder)
        fs.create_dir(base, recursive=True)
        done, out, size = [], None, 0
        for batch in batches:
            for row in range(len(batch)):
                page, url, payload, digest, first = (batch.column(i)[row].as_py() for i in range(5))
                if out is None:
                    name = f"{folder}/{TaskContext.get().taskAttemptId()}-{len(done)}.warc.gz"
                    done.append([name, 0])
                    out, press = fs.open_output_stream(file_system(name)[1], compression=None), zlib.compressobj(level, zlib.DEFLATED, 31)
                data = payload.encode("utf-8")
                headers = {"WARC-Type": "revisit" if first is not None else "response", "WARC-Record-ID": f"<urn:page:{page if page is not None else ''}>", "WARC-Date": "1970-01-01T00:00:00Z", "WARC-Target-URI": url, "Content-Type": "application/http; msgtype=response", "WARC-Payload-Digest": f"sha1:{digest}"}
                if first is not None:
                    headers |= {"WARC-Profile": PROFILE, "WARC-Refers-To": f"<urn:page:{first}>", "X-Payload-Bytes": str(len(data))}
                record = record_bytes(headers, HTTP_HEAD + (b"" if first is not None else data))
                out.write(press.compress(record))
                done[-1][1] += 1
                size += len(record)
                if size >= ARCHIVE_BYTES:
                    out.write(press.flush())
                    out.close()
                    out, size = None, 0
        if out is not None:
            out.write(press.flush())
            out.close()
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in done], pa.string()), pa.array([n for _, n in done], pa.int64())], names=["archive", "records"])

    return staged(typed.mapInArrow(write, "archive string, records long"), "archives")


def normalise(archives: DataFrame, folder: str, *, archive_col: str = "archive", level: int = 6) -> DataFrame:
    """Each archive rewritten in ``folder`` with a gzip member for each record, beside it ``.idx``; returns the index.

    The index has, for each record, archive, offset and length of its member, record_id,
    record_type and target_uri; the sidecar file has the same without the archive, tab-separated.
    Archives of one gzip stream and of many members are read alike, as a stream: a task holds one
    record. An archive that ends within a record raises EOFError.
    """
    paths = archives.select(archives[archive_col].alias("path")).where("path IS NOT NULL").distinct()
    parts = max(1, archives.count())

    def rewrite(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        fs, base = file_system(folder)
        fs.create_dir(base, recursive=True)
        for batch in batches:
            for path in batch.column(0).to_pylist():
                name = f"{folder}/{path.rpartition('/')[2].removesuffix('.warc.gz')}-{TaskContext.get().taskAttemptId()}.warc.gz"
                target, rows, at = file_system(name)[1], [], 0
                with fs.open_output_stream(target, compression=None) as out, fs.open_output_stream(f"{target}.idx", compression=None) as index:
                    for record in records(_blocks(path)):
                        headers = parse_record(record)[0]
                        press = zlib.compressobj(level, zlib.DEFLATED, 31)
                        member = press.compress(record) + press.flush()
                        out.write(member)
                        row = (at, len(member), headers.get("WARC-Record-ID"), headers.get("WARC-Type"), headers.get("WARC-Target-URI"))
                        index.write(("\t".join("" if x is None else str(x).replace("\t", "%09") for x in row) + "\n").encode())
                        rows.append((name, *row))
                        at += len(member)
                        if len(rows) >= 5000:
                            yield _index_batch(pa, rows)
                            rows = []
                yield _index_batch(pa, rows)

    return staged(paths.repartition(parts).mapInArrow(rewrite, INDEX), "index")


def _index_batch(pa, rows):
    columns = list(zip(*rows)) or [()] * 6
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, kinds)], names=["archive", "offset", "length", "record_id", "record_type", "target_uri"])


READ = "record_id string, record_type string, target_uri string, refers_to string, payload_bytes long, payload_digest string"


def read_records(index: DataFrame, *, with_payload: bool = False) -> DataFrame:
    """Each indexed record read by its offset: record_id, record_type, target_uri, refers_to, payload_bytes, payload_digest, and payload if asked for.

    A response's length and SHA-1 (lower-case hex) are taken from the payload as it is read; a
    revisit has those that it states of the payload that it refers to, and a null payload. A
    digest that differs from the stated one raises ValueError.
    """

    def read(batches):
        import hashlib

        import pyarrow as pa

        for batch in batches:
            rows, name, f = [], None, None
            for archive, offset, length in sorted(zip(*(batch.column(i).to_pylist() for i in range(3)))):
                if archive != name:
                    fs, path = file_system(archive)
                    name, f = archive, fs.open_input_file(path)
                f.seek(offset)
                headers, block = parse_record(zlib.decompress(f.read(length), 31))
                payload = block.partition(b"\r\n\r\n")[2]
                stated = headers["WARC-Payload-Digest"].removeprefix("sha1:")
                kind = headers["WARC-Type"]
                digest, size = (stated, int(headers["X-Payload-Bytes"])) if kind == "revisit" else (hashlib.sha1(payload).hexdigest(), len(payload))
                if digest != stated:
                    raise ValueError(f"{headers['WARC-Record-ID']} in {archive} has another digest than it states")
                rows.append((headers["WARC-Record-ID"], kind, headers.get("WARC-Target-URI"), headers.get("WARC-Refers-To"), size, digest, None if kind == "revisit" else payload))
            columns = list(zip(*rows)) or [()] * 7
            kinds = [pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]
            names = ["record_id", "record_type", "target_uri", "refers_to", "payload_bytes", "payload_digest", "payload"]
            n = 7 if with_payload else 6
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, kinds)][:n], names=names[:n])

    return index.select("archive", "offset", "length").mapInArrow(read, READ + (", payload binary" if with_payload else ""))


def page_of(record_id: str) -> F.Column:
    """The page id, as a string, in a record id that ``write_monolithic`` made; null for a page without one."""
    return F.nullif(F.regexp_extract(record_id, "^<urn:page:(.*)>$", 1), F.lit(""))


def archive_pages(pages: DataFrame, *, id_col: str = "page_id", **how) -> DataFrame:
    """``pages`` written, normalised and read back: page_id, payload_bytes, payload_digest, record_type, refers_to, a row for each row of ``pages``."""
    folder = new_folder(pages.sparkSession, "warc")
    index = normalise(write_monolithic(pages, f"{folder}/raw", id_col=id_col, **how), f"{folder}/members")
    kind = pages.schema[id_col].dataType
    return read_records(index).select(page_of("record_id").cast(kind).alias(id_col), "payload_bytes", "payload_digest", "record_type", page_of("refers_to").cast(kind).alias("refers_to"))
