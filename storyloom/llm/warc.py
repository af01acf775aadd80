"""WARC archives: writing, normalising monolithic gzip files, indexing and reading back.

``write_archives`` makes one gzip stream for each file, as many writers do. ``normalise`` inflates each such stream once,
from front to end in one task, and writes every record as a gzip member of its own; then it reads the new files as they are
and writes a sidecar index with the offset and length of every member, so one record can be fetched with one ranged read.
All files are read and written by Spark's text source with a separator that gives back the exact bytes, so any file system
Spark knows will do, tasks may be repeated, and no task holds more than one record and one batch.

Of records with equal payloads that with the largest identifier is the response, the others refer to it as revisits without a
body; payloads below ``least_bytes`` are always responses.

Defined results: a null payload is empty; a null identifier counts as smaller than any; rows that share the largest identifier
and the payload are all responses; a null address is left out; no rows give archives without records. A stream that ends inside
a record, or holds something else, stops the job with the file's name.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from storyloom.llm.common import ready, text_or_empty, type_of

# Fixed values of the format.
VERSION = b"WARC/1.0"
REVISIT = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
CAPTURED = "1970-01-01T00:00:00Z"
END = b"\r\n\r\n"

INDEX = T.StructType(
    [
        T.StructField(name, T.LongType() if name in ("offset", "length", "payload_bytes") else T.StringType())
        for name in ("file", "offset", "length", "record_id", "record_type", "uri", "payload_digest", "payload_bytes", "refers_to")
    ]
)


def record_id(key) -> str:
    return "<urn:page:>" if key is None else f"<urn:page:{quote(str(key), safe='')}>"


def make_record(key, uri: str | None, payload: bytes, refers_to=None, revisit: bool = False) -> bytes:
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = [f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(key)}", f"WARC-Date: {CAPTURED}"]
    if uri is not None:
        head.append("WARC-Target-URI: " + "".join(quote(c) if c < " " else c for c in uri))
    if revisit:
        head += [f"WARC-Refers-To: {record_id(refers_to)}", f"WARC-Profile: {REVISIT}"]
    head += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return VERSION + b"\r\n" + "\r\n".join(head).encode() + END + block + END


def parse_head(head: bytes) -> dict[str, str]:
    lines = head.split(b"\r\n")
    if not lines[0].startswith(b"WARC/"):
        raise ValueError(f"not a record: {lines[0][:40]!r}")
    pairs = (line.decode().partition(":") for line in lines[1:])
    return {name.strip().lower(): value.strip() for name, _, value in pairs}


class RecordStream:
    """Cuts a stream of bytes, fed in pieces, into whole records."""

    def __init__(self):
        self.pieces: list[bytes] = []
        self.have, self.need = 0, 0

    def feed(self, piece: bytes) -> Iterator[bytes]:
        self.pieces.append(piece)
        self.have += len(piece)
        while self.have and self.have >= self.need:
            data = self.pieces[0] if len(self.pieces) == 1 else b"".join(self.pieces)
            at = data.find(END)
            size = at + 4 + int(parse_head(data[:at])["content-length"]) + 4 if at >= 0 else 0
            if at < 0 or len(data) < size:
                # Do not look again before the record can be whole, or the head has grown.
                self.pieces, self.need = [data], size or len(data) + 1
                return
            yield data[:size]
            self.pieces, self.have, self.need = [data[size:]], len(data) - size, 0

    def finish(self) -> Iterator[bytes]:
        """The last record, whose closing separator the line reader may have taken away."""
        left = b"".join(self.pieces)
        if left.strip(b"\r\n"):
            closed = left.rstrip(b"\r\n") if left.find(END) < 0 else left
            at = closed.find(END)
            size = at + 8 + int(parse_head(closed[:at])["content-length"]) if at >= 0 else -1
            if not 0 <= size - len(left) <= 4:
                raise ValueError(f"stream ends inside a record of {size} bytes after {len(left)}")
            yield left + END[len(left) - size :] if size > len(left) else left


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("_id", "_uri", "_text", "_keep", "_revisit")]
        made = [make_record(k, u, t.encode(), keep, again) for k, u, t, keep, again in zip(*columns)]
        # The writer puts the last byte of every record back as its separator.
        yield pa.RecordBatch.from_arrays([pa.array([m[:-1] for m in made], pa.binary())], names=["bytes"])


def write_archives(
    pages: DataFrame, folder: str, id_col: str = "page_id", text_col: str = "html", uri_col: str | None = "url", least_bytes: int = 0
) -> None:
    """One WARC record for each row, in files of one gzip stream each."""
    ready(pages.sparkSession)
    uri = F.col(f"`{uri_col}`").cast("string") if uri_col else F.lit(None).cast("string")
    source = pages.select(F.col(f"`{id_col}`").alias("_id"), uri.alias("_uri"), text_or_empty(text_col).alias("_text"))
    keyed = source.withColumn("_sha", F.unhex(F.sha2("_text", 256)))
    # Identifiers and digests alone decide; payloads are not moved for it.
    large = keyed.filter(F.octet_length("_text") >= least_bytes).select("_id", "_sha")
    groups = large.groupBy("_sha").agg(F.max("_id").alias("_keep"), F.count(F.lit(1)).alias("_n")).filter("_n > 1 AND _keep IS NOT NULL")
    again = large.join(groups.select("_sha", "_keep"), "_sha").filter(~F.col("_id").eqNullSafe(F.col("_keep")))
    again = again.select(F.col("_id").alias("_key"), F.col("_sha").alias("_same"), "_keep").distinct()
    joined = keyed.join(again, F.col("_id").eqNullSafe(F.col("_key")) & (F.col("_sha") == F.col("_same")), "left")
    rows = joined.select("_id", "_uri", "_text", "_keep", F.col("_same").isNotNull().alias("_revisit"))
    lines = rows.mapInArrow(_records, "bytes binary").select(F.col("bytes").cast("string").alias("value"))
    lines.write.option("lineSep", "\n").option("compression", "gzip").text(folder)


def _lines(spark: SparkSession, folder: str) -> DataFrame:
    """The inflated bytes between line feeds, in the order of each file; a gzip stream is not divided between tasks."""
    lines = spark.read.option("lineSep", "\n").text(folder)
    return lines.select(F.col("_metadata.file_path").alias("file"), F.col("value").cast("binary").alias("value"))


def _by_file(batches: Iterator[pa.RecordBatch], separator: bytes) -> Iterator[tuple[str | None, bytes]]:
    """Runs of lines of one file, with their separators; a None at the end.

    The lines of a file follow one another, so a batch that begins and ends with one file holds no other.
    """
    for batch in batches:
        if not batch.num_rows:
            continue
        files, values = batch.column("file"), batch.column("value").to_pylist()
        if files[0] == files[-1]:
            yield files[0].as_py(), separator.join(values) + separator
            continue
        files, low = files.to_pylist(), 0
        for k in range(1, len(files) + 1):
            if k == len(files) or files[k] != files[low]:
                yield files[low], separator.join(values[low:k]) + separator
                low = k
    yield None, b""


def _member(record: bytes) -> bytes:
    """The record as a gzip member whose last byte is zero.

    The last byte of a member is the highest of its 32-bit length, zero below 16 MiB; a larger record is followed by an
    empty member, which adds nothing to the stream.
    """
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    made = pack.compress(record) + pack.flush()
    if made[-1]:
        empty = zlib.compressobj(6, zlib.DEFLATED, 31)
        made += empty.flush()
    return made


def _rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows(members: list[bytes]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([m[:-1] for m in members], pa.binary())], names=["bytes"])

    now, stream, members, held = None, RecordStream(), [], 0
    for file, data in _by_file(batches, b"\n"):
        if file != now:
            try:
                members += map(_member, stream.finish())
            except ValueError as error:
                raise ValueError(f"{now}: {error}") from error
            now, stream = file, RecordStream()
        try:
            for record in stream.feed(data):
                members.append(_member(record))
                held += len(members[-1])
                if held > 1 << 22:
                    yield rows(members)
                    members, held = [], 0
        except (ValueError, KeyError) as error:
            raise ValueError(f"{now}: {error}") from error
    if members:
        yield rows(members)


def entry_of(record: bytes) -> dict:
    """What the index says about a record; digest and size are those of the payload itself where there is one."""
    at = record.find(END)
    head, block = parse_head(record[:at]), record[at + 4 : -4]
    http, _, payload = block.partition(END)
    kind = head["warc-type"]
    if kind == "revisit":
        fields = dict(line.lower().split(b":", 1) for line in http.split(b"\r\n")[1:])
        size, digest = int(fields[b"content-length"]), head["warc-payload-digest"].partition(":")[2]
    else:
        payload = payload if http.startswith(b"HTTP/") else block
        size, digest = len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode()
        if head.get("warc-payload-digest", f"sha1:{digest}") != f"sha1:{digest}":
            raise ValueError(f"payload of {head['warc-record-id']} does not match its digest")
    return {
        "record_id": head["warc-record-id"], "record_type": kind, "uri": head.get("warc-target-uri"), "payload_digest": digest,
        "payload_bytes": size, "refers_to": head.get("warc-refers-to"),
    }


class MemberStream:
    """Inflates a file of gzip members, fed in pieces, and tells where each lies."""

    def __init__(self):
        self.offset = self.start = 0
        self.inflate, self.out = zlib.decompressobj(31), []

    def feed(self, data: bytes) -> Iterator[tuple[int, int, bytes]]:
        while data:
            self.out.append(self.inflate.decompress(data))
            left = self.inflate.unused_data
            self.offset += len(data) - len(left)
            data = left
            if self.inflate.eof:
                yield self.start, self.offset - self.start, b"".join(self.out)
                self.start, self.inflate, self.out = self.offset, zlib.decompressobj(31), []


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows(entries: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([e[n] for e in entries], t) for n, t in kinds], names=INDEX.names)

    kinds = [(f.name, pa.int64() if f.dataType.typeName() == "long" else pa.string()) for f in INDEX.fields]
    now, stream, entries = None, MemberStream(), []
    for file, data in _by_file(batches, b"\0"):
        if file != now:
            if stream.offset != stream.start:
                raise ValueError(f"{now}: ends inside a member")
            now, stream = file, MemberStream()
        _add_entries(entries, now, stream.feed(data))
        if len(entries) > 10_000:
            # The last entry may still grow by an empty member.
            yield rows(entries[:-1])
            entries = entries[-1:]
    if entries:
        yield rows(entries)


def _add_entries(entries: list[dict], file: str, members: Iterator[tuple[int, int, bytes]]) -> None:
    for offset, length, record in members:
        if record:
            entries.append({"file": file, "offset": offset, "length": length, **entry_of(record)})
        else:
            entries[-1]["length"] += length


def _whole_files(spark: SparkSession, folder: str) -> DataFrame:
    """The raw bytes of files between zero bytes.

    A codec that hands bytes through stands in for the file suffix: as with any codec of that kind, Spark does not divide
    such a file between tasks.
    """
    options = {
        "lineSep": "\0",
        "io.compression.codecs": "org.apache.hadoop.io.compress.PassthroughCodec",
        "io.compress.passthrough.extension": ".txt",
    }
    lines = spark.read.options(**options).text(folder)
    return lines.select(F.col("_metadata.file_path").alias("file"), F.col("value").cast("binary").alias("value"))


def _rename(spark: SparkSession, folder: str, target: str) -> None:
    """Move the finished files, which is a change of names only."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(folder).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    fs.mkdirs(path(target))
    for status in fs.listStatus(path(folder)):
        name = status.getPath().getName()
        if name.endswith(".txt"):
            fs.rename(status.getPath(), path(f"{target}/{name.removesuffix('.txt')}.warc.gz"))
    fs.delete(path(folder), True)


def normalise(spark: SparkSession, source: str, target: str) -> DataFrame:
    """Rewrite the gzip WARC files of a folder with one member for each record; the index of what was written.

    Files go to ``target/archives`` as ``*.warc.gz``, the index to ``target/index``.
    """
    ready(spark)
    members = _lines(spark, source).mapInArrow(_rewrite, "bytes binary").select(F.col("bytes").cast("string").alias("value"))
    plain = f"{target}/plain"
    members.write.option("lineSep", "\0").option("compression", "none").text(plain)
    final = F.regexp_replace("file", r"/plain/([^/]*)\.txt$", r"/archives/$1.warc.gz")
    _whole_files(spark, plain).mapInArrow(_index, INDEX).withColumn("file", final).write.parquet(f"{target}/index")
    _rename(spark, plain, f"{target}/archives")
    return spark.read.schema(INDEX).parquet(f"{target}/index")


def archive_pages(
    pages: DataFrame, target: str, id_col: str = "page_id", text_col: str = "html", uri_col: str | None = "url", least_bytes: int = 0
) -> DataFrame:
    """Write, normalise and read back: one row for each record with the identifiers as they were."""
    spark = pages.sparkSession
    write_archives(pages, f"{target}/streams", id_col, text_col, uri_col, least_bytes)
    index = normalise(spark, f"{target}/streams", target)
    kind = type_of(pages, id_col)
    key = lambda c: F.url_decode(F.regexp_replace(F.regexp_replace(c, "^<urn:page:|>$", ""), r"\+", "%2B"))
    name = lambda c: F.when(key(c) != "", key(c)).cast(kind)
    return index.select(
        name("record_id").alias(id_col), "payload_bytes", "payload_digest", "record_type", name("refers_to").alias("refers_to"),
        "file", "offset", "length",
    )
