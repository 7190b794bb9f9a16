import gzip
import hashlib
import random
import zlib

import pytest

from tidemark.llm.common import new_folder
from tidemark.llm.warc import _blocks, archive_pages, file_system, normalise, parse_record, read_records, record_bytes, records, write_monolithic

SCHEMA = "page_id long, url string, html string, digest string, payload string"


def brute(rows):
    out = []
    for page, _, html, *_ in rows:
        data = (html or "").encode()
        same = [p for p, _, h, *_ in rows if h == html and p is not None] if len(data) >= 1000 else []
        first = max(same, default=None)
        revisit = first is not None and (page is None or page < first)
        out.append((page, len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response", first if revisit else None))
    return sorted(out, key=repr)


def test_round_trip(spark):
    rng = random.Random(1)
    long = ["é" * 500, "x" * 999, "<p>\r\n\r\nWARC/1.1\r\n</p>" * 90, "y" * 300_000]
    rows = [(rng.choice([None, *range(30)]), rng.choice([None, "http://a/b\r\nX: y", "http://c/\tü"]), rng.choice([None, "", "short", *long]), "d", "p") for _ in range(80)]
    pages = spark.createDataFrame(rows, SCHEMA)
    assert sorted(map(tuple, archive_pages(pages).collect()), key=repr) == brute(rows)
    assert archive_pages(pages.limit(0)).collect() == []


def test_files(spark):
    rows = [(i, f"http://h/{i}", f"page {i} " * 300, "", "") for i in range(20)] + [(20, None, "page 3 " * 300, "", "")]
    folder = new_folder(spark, "t")
    raw = write_monolithic(spark.createDataFrame(rows, SCHEMA).coalesce(1), f"{folder}/raw")
    path = raw.collect()[0]["archive"]
    data = open(file_system(path)[1], "rb").read()
    one = zlib.decompressobj(31)
    whole = one.decompress(data)
    assert one.eof and not one.unused_data
    index = normalise(raw, f"{folder}/m")
    places = sorted(map(tuple, index.select("archive", "offset", "length", "record_id").collect()))
    out = open(file_system(places[0][0])[1], "rb").read()
    assert gzip.decompress(out) == whole and sum(x[2] for x in places) == len(out)
    sidecar = open(file_system(places[0][0])[1] + ".idx").read().splitlines()
    assert [x.split("\t")[:3] for x in sidecar] == [[str(a), str(b), c] for _, a, b, c in places]
    for _, a, n, name in places:
        assert parse_record(gzip.decompress(out[a : a + n]))[0]["WARC-Record-ID"] == name
    again = normalise(index.select("archive"), f"{folder}/again")
    assert read_records(again, with_payload=True).where("record_type = 'response'").count() == 20
    assert {bytes(r["payload"]).decode() for r in read_records(index, with_payload=True).collect() if r["payload"]} == {r[2] for r in rows}


def test_cut_archive_raises():
    data = gzip.compress(record_bytes({"WARC-Type": "response"}, b"abc") * 2)
    assert len(list(records([data[:9], data[9:]]))) == 2
    with pytest.raises(EOFError):
        list(records([gzip.compress(record_bytes({"A": "b"}, b"abc")[:-3])]))
    assert list(records(iter([]))) == [] and callable(_blocks)
