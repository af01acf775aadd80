import base64
import gzip
import hashlib
import zlib

import pytest

from storyloom.llm import warc
from storyloom.llm.catalog import REGISTRY
from tests.llm.conftest import messy, same_as_sql

SCHEMA = "page_id bigint, url string, html string"


def digest(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


def archived(spark, tmp_path, rows, **options):
    df = messy(spark, rows, SCHEMA)
    return sorted((tuple(r) for r in warc.archive_pages(df, f"file://{tmp_path}/out", **options).collect()), key=repr)


def test_query_agrees_with_sql(spark):
    assert same_as_sql(spark, REGISTRY["op6_warc"]) == 50


def test_edges(spark, tmp_path):
    rows = [
        (1, "http://a/", "same é"), (2, None, "same é"), (3, "http://c/\r\nX: y", "own"), (4, "", None), (5, "u", ""), (None, "n", "same é"),
        (6, "u", "\r\n\r\n"), (7, "u", "ends\r\n"), (8, "u", "\nWARC/1.0\r\n\r\n\0\0\x1f"), (9, "u", "x" * 3_000_000), (10, "u", "null id twin"), (11, "u", "\r"),
        (12, "u", "\n\n\n"), (13, "u", "twice"), (13, "v", "twice"), (None, "u", "lone"),
    ]
    got = archived(spark, tmp_path, rows)
    assert len(got) == len(rows)
    short = [r[:5] for r in got]
    for key, _, text in rows:
        group = [k for k, _, t in rows if (t or "") == (text or "")]
        top = max((k for k in group if k is not None), default=None)
        again = top is not None and key != top
        want = (key, len((text or "").encode()), digest(text), "revisit" if again else "response", top if again else None)
        assert want in short, want


def test_index_finds_every_member(spark, tmp_path):
    rows = [(i, f"http://h/{i}", f"page {i % 7} " * (i + 1)) for i in range(40)] + [(99, "u", None)]
    for key, size, sha, kind, _, file, offset, length in archived(spark, tmp_path, rows):
        with open(file.removeprefix("file:"), "rb") as handle:
            handle.seek(offset)
            member = handle.read(length)
        inflate = zlib.decompressobj(31)
        record = inflate.decompress(member)
        assert inflate.eof and not inflate.unused_data
        assert f"<urn:page:{key}>".encode() in record and record.startswith(b"WARC/1.0\r\n") and record.endswith(b"\r\n\r\n")
        assert f"sha1:{sha}".encode() in record and (kind == "revisit" or len(record) > size)
    assert file.endswith(".warc.gz")


def test_small_payloads_stay_responses(spark, tmp_path):
    rows = [(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcd"), (4, "u", "abcd")]
    assert [r[3] for r in archived(spark, tmp_path, rows, least_bytes=3)] == ["response", "response", "revisit", "response"]


def test_string_identifiers(spark, tmp_path):
    df = spark.createDataFrame([("a+b c/é", "t"), ("z>", "t")], "k string, body string")
    got = warc.archive_pages(df, f"file://{tmp_path}/out", "k", "body", None).select("k", "refers_to").collect()
    assert sorted((r.k, r.refers_to) for r in got) == [("a+b c/é", "z>"), ("z>", None)]


def test_empty_table(spark, tmp_path):
    assert archived(spark, tmp_path, []) == []


def foreign(text):
    block = text.encode()
    head = f"WARC/1.1\r\nwarc-type: resource\r\nWARC-Record-ID: <urn:uuid:{digest(text)}>\r\nContent-Length: {len(block)}"
    return head.encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def test_foreign_streams(spark, tmp_path):
    """Archives of another writer: one stream or some members for a file, records that hold line ends of every kind."""
    folder = tmp_path / "in"
    folder.mkdir()
    texts = [["one\r\n\r\ntwo", "", "\r\n"], ["x\n" * 50_000, "tail\r\n\r\n"], ["big " * 5_000_000]]
    for k, held in enumerate(texts):
        data = b"".join(map(foreign, held))
        (folder / f"{k}.warc.gz").write_bytes(gzip.compress(data[:100]) + gzip.compress(data[100:]))
    index = warc.normalise(spark, f"file://{folder}", f"file://{tmp_path}/out").collect()
    assert sorted((r.payload_bytes, r.payload_digest) for r in index) == sorted((len(t), digest(t)) for held in texts for t in held)
    largest = max(index, key=lambda r: r.payload_bytes)
    data = open(largest.file.removeprefix("file:"), "rb").read()[largest.offset : largest.offset + largest.length]
    assert gzip.decompress(data) == foreign(texts[2][0])


def test_a_cut_stream_stops_the_job(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "cut.warc.gz").write_bytes(gzip.compress(foreign("some text that is cut off")[:-20]))
    with pytest.raises(Exception, match="cut.warc.gz"):
        warc.normalise(spark, f"file://{folder}", f"file://{tmp_path}/out")
