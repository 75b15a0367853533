"""WARC archives with a two-level capture index.

Archives are gzip-compressed WARC 1.1 files, one member a record. Their records are found through an index: lines keyed
by the URL with its host reversed, in sorted order, packed into compressed blocks; a sparse directory holds each block's
first key. A lookup binary-searches the directory, then one block, and reads only the byte ranges found there.

Spark's text sink writes the archives, so they go to any store that Spark writes to. It ends each row with a separator;
a gzip member ends with its payload's length modulo 2^32, whose last byte is 0 below 16 MB, so that byte is the separator.
Ranges are read by seeking, through Arrow's file systems. Of a store that those don't know, Spark reads the files that hold
wanted ranges, each at once; a file ends with the record that takes it over FILE_BYTES.
"""

from __future__ import annotations

import bisect
import gzip
import hashlib
import re
import zlib
from collections.abc import Callable, Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fitting, partitions, save

SMALL = 100
#: Compressed bytes after which a writer begins a new file; rows of the directory that go to all tasks, and their bytes.
FILE_BYTES, MOST_DIRECTORY, DIRECTORY_BYTES = 32_000_000, 50_000, 16_000_000
#: Keys that are searched for in a block at once; ranges no further apart than this are read together, up to so many bytes.
BLOCK_KEYS, GAP, READ_BYTES = 5_000, 1 << 16, 1 << 23
MEMBER = 1 << 24
ID = "urn:x-page:"


def url_key(url: str | None) -> str:
    """scheme://user@www.Example.com:80/a?b#c -> com,example,www:80)/a?b. Null and unparsable URLs: themselves, null as empty."""
    try:
        parts = urlsplit(url or "")
        host, port = parts.hostname or "", parts.port
    except ValueError:
        return url or ""
    if not host:
        return url or ""
    return f"{','.join(reversed(host.split('.')))}{f':{port}' if port else ''}){parts.path or '/'}{f'?{parts.query}' if parts.query else ''}"


def members(data: bytes, level: int) -> bytes:
    """data as gzip, in members that each hold less than 16 MB."""
    return b"".join(gzip.compress(data[i : i + MEMBER - 1], level, mtime=0) for i in range(0, max(1, len(data)), MEMBER - 1))


def escaped(url: str | None) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "")


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers: int | None, revisit: bool) -> bytes:
    kind = "revisit" if revisit else "response"
    head = [f"WARC-Type: {kind}", f"WARC-Record-ID: <{ID}{'' if page_id is None else page_id}>", f"WARC-Target-URI: {escaped(url)}", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: sha256:{digest}", f"X-Payload-Length: {len(payload)}"]
    if revisit:
        head += [f"WARC-Refers-To: <{ID}{refers}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    body = http if revisit else http + payload
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    return "\r\n".join(["WARC/1.1", *head, "", ""]).encode() + body + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and payload of one uncompressed record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    body = rest[: int(fields["Content-Length"])]
    return fields, body.partition(b"\r\n\r\n")[2]


def revisits(pages: DataFrame) -> DataFrame:
    """digest, first: payload digests of at least SMALL bytes that more than one page has, and their smallest page_id."""
    seen = pages.where(F.col("bytes") >= SMALL).groupBy("digest").agg(F.count("*").alias("n"), F.min("page_id").alias("first"))
    return seen.where("n > 1").drop("n")


def write_archives(pages: DataFrame, path: str, level: int = 3) -> None:
    """A record for each row of pages(page_id, url, html), in .gz files under path.

    The payload is html in UTF-8, a null one empty. Of the rows with equal payloads of SMALL bytes or more, that with the
    smallest page_id (nulls last) is a response, all others are revisits of it; rows that repeat that page_id are
    responses too. Other columns are not read.
    """
    rows = pages.select(pages["page_id"].cast("long").alias("page_id"), pages["url"].cast("string").alias("url"), F.coalesce(pages["html"].cast("string"), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    first = revisits(rows.select("page_id", "digest", F.octet_length("payload").alias("bytes")))
    rows = rows.join(fitting(first), "digest", "left").withColumn("revisit", F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file = size = 0
        for batch in batches:
            out, files = [], []
            for row in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "payload", "digest", "first", "revisit")), strict=True):
                data = members(record(*row), level)
                if not data.endswith(b"\0"):
                    raise ValueError("a gzip member doesn't end with a zero byte")
                out.append(data[:-1])
                files.append(file)
                size += len(data)
                if size >= FILE_BYTES:
                    file, size = file + 1, 0
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary()), pa.array(files, pa.int32())], ["record", "file"])

    done = rows.mapInArrow(run, "record binary, file int")
    done.select(F.col("record").cast("string").alias("value"), "file").write.option("lineSep", "\0").partitionBy("file").text(path)


def scan(spark: SparkSession, path: str) -> DataFrame:
    """key, file, at, length, page_id, kind: a row for each record of the archives under path, read from front to end.

    A folder without archives gives no rows. A record that is cut off raises.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows = [(url_key(f["WARC-Target-URI"]), name, at, n, f["WARC-Record-ID"][len(ID) + 1 : -1], f["WARC-Type"]) for f, at, n in records(content.as_buffer())]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)] if rows else [pa.array([], t) for t in (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())], ["key", "file", "at", "length", "page_id", "kind"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")
    return files.mapInArrow(run, "key string, file string, at long, length long, page_id string, kind string")


def records(content) -> Iterator[tuple[dict[str, str], int, int]]:
    """Headers, offset and length of each record of an archive's bytes."""
    view, at, start, data = memoryview(content), 0, 0, b""
    while at < len(view):
        unzip, n = zlib.decompressobj(31), at
        while not unzip.eof and n < len(view):
            data += unzip.decompress(view[n : n + (1 << 16)])
            n = min(len(view), n + (1 << 16)) - len(unzip.unused_data)
        if not unzip.eof:
            raise ValueError("a record is cut off")
        at = n
        head, _, rest = data.partition(b"\r\n\r\n")
        fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
        if len(rest) < int(fields["Content-Length"]) + 4:
            continue  # the record goes on in the next member
        yield fields, start, at - start
        start, data = at, b""


def build_index(spark: SparkSession, path: str, block_lines: int = 1000) -> DataFrame:
    """first, last, lines, block: sorted index lines of the archives under path, block_lines to a compressed block.

    A line is key, file, offset and length, tab-separated; the rows without their block are the sparse directory. Records
    with equal keys (repeated URLs, null ones too) have a line each. No records give no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[str, str]] = []
        for batch in batches:
            held += zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
            while len(held) >= block_lines:
                yield pack(held[:block_lines])
                held = held[block_lines:]
        if held:
            yield pack(held)

    def pack(lines: list[tuple[str, str]]) -> pa.RecordBatch:
        block = zlib.compress("\n".join(x for _, x in lines).encode())
        return pa.RecordBatch.from_arrays([pa.array([x]) for x in (lines[0][0], lines[-1][0], len(lines), block)], ["first", "last", "lines", "block"])

    lines = scan(spark, path).select("key", F.concat_ws("\t", "key", "file", "at", "length").alias("line"))
    return lines.repartitionByRange(partitions(lines), "key", "line").sortWithinPartitions("key", "line").mapInArrow(run, "first string, last string, lines long, block binary")


def unpack(index: DataFrame) -> DataFrame:
    """key, file, at, length: all lines of the index's blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in batch.column(0).to_pylist():
                cols = list(zip(*(x.split("\t") for x in zlib.decompress(block).decode().split("\n")), strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(cols[0]), pa.array(cols[1]), pa.array(map(int, cols[2]), pa.int64()), pa.array(map(int, cols[3]), pa.int64())], ["key", "file", "at", "length"])

    return index.select("block").mapInArrow(run, "key string, file string, at long, length long")


def lookup(index: DataFrame, urls: DataFrame) -> DataFrame:
    """url, key, file, at, length: the captures of urls(url), by two binary searches.

    Repeated URLs are looked up once; a null one is a URL like others. URLs without a capture give no rows, and empty
    tables none. Other columns are not read. The directory goes to all tasks while it is small; beyond, keys meet the
    unpacked lines in a join.
    """

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(u, url_key(escaped(u))) for u in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([u for u, _ in found], pa.string()), pa.array([k for _, k in found], pa.string())], ["url", "key"])

    wanted = urls.select(urls["url"].cast("string").alias("url")).distinct().mapInArrow(keyed, "url string, key string")
    blocks = index.withColumn("id", F.xxhash64("first", "last", "block"))
    rows, size = index.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("first") + F.octet_length("last")), F.lit(0))).first()
    if rows > MOST_DIRECTORY or size > DIRECTORY_BYTES:
        return wanted.join(unpack(index), "key").select("url", "key", "file", "at", "length")
    # The directory: at most MOST_DIRECTORY rows and DIRECTORY_BYTES, just counted.
    directory = sorted(map(tuple, blocks.select("first", "last", "id").distinct().collect()))
    shared = index.sparkSession.sparkContext.broadcast(directory)

    def to_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        directory = shared.value
        lasts = [x[1] for x in directory]
        for batch in batches:
            out = []
            for url, key in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                n = bisect.bisect_left(lasts, key)
                while n < len(directory) and directory[n][0] <= key:
                    out.append((url, key, directory[n][2]))
                    n += 1
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate((pa.string(), pa.string(), pa.int64()))], ["url", "key", "id"])

    def search(asked: pa.Table, there: pa.Table) -> pa.Table:
        out = []
        for block in there["block"].to_pylist()[:1]:
            lines = zlib.decompress(block).decode().split("\n")
            for url, key in zip(asked["url"].to_pylist(), asked["key"].to_pylist(), strict=True):
                n = bisect.bisect_left(lines, key + "\t")
                while n < len(lines) and lines[n].startswith(key + "\t"):
                    _, file, at, length = lines[n].split("\t")
                    out.append((url, key, file, int(at), int(length)))
                    n += 1
        return pa.table([pa.array([x[i] for x in out], t) for i, t in enumerate((pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64()))], ["url", "key", "file", "at", "length"])

    hits = save(wanted.mapInArrow(to_blocks, "url string, key string, id long"), "hits")
    parts = fitting(hits.groupBy("id").agg(F.ceil(F.count("*") / BLOCK_KEYS).cast("int").alias("parts")))
    asked = hits.join(parts, "id").withColumn("part", F.pmod(F.xxhash64("key"), F.col("parts")).cast("int")).drop("parts")
    there = blocks.join(parts, "id").select("id", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)), "block").toDF("at_id", "at_part", "block")
    return asked.groupBy("id", "part").cogroup(there.groupBy("at_id", "at_part")).applyInArrow(search, "url string, key string, file string, at long, length long")


def opened(uri: str):
    """An archive to read ranges of, by Arrow's file systems: s3a: as s3:."""
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem().open_input_file("/" + uri.removeprefix("file:").lstrip("/"))
    system, path = fs.FileSystem.from_uri(re.sub("^s3[an]:", "s3:", uri))
    return system.open_input_file(path)


def seekable(uri: str) -> bool:
    try:
        opened(uri).close()
    except (OSError, ValueError, NotImplementedError):
        return False
    return True


def spans_of(read_at: Callable[[int, int], bytes], spans: list[tuple[int, int]]) -> Iterator[bytes]:
    """The bytes of each (at, length) of spans, in ascending order, by read_at(length, at); neighbours are read together."""
    k = 0
    while k < len(spans):
        start, end, n = spans[k][0], sum(spans[k]), k + 1
        while n < len(spans) and spans[n][0] <= end + GAP and sum(spans[n]) - start <= READ_BYTES:
            end, n = max(end, sum(spans[n])), n + 1
        data = memoryview(read_at(end - start, start))
        yield from (data[at - start : at - start + length] for at, length in spans[k:n])
        k = n


def read_ranges(spark: SparkSession, path: str, ranges: DataFrame, payload: bool = True) -> DataFrame:
    """The records at ranges(file, at, length) of the archives under path.

    page_id and refers_to long, url, kind; digest and bytes, taken from a response's payload as it was read and from a
    revisit's headers; and the payload, if asked for. Ranges are tables read once, so save what takes long to compute;
    repeated ranges give their record as often. No ranges give no rows.
    """
    wanted = ranges.groupBy("file").agg(F.sort_array(F.collect_list(F.struct("at", "length"))).alias("ranges"))  # of one file, so few
    names = ["page_id", "refers_to", "url", "kind", "digest", "bytes", "payload"][: 7 if payload else 6]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.binary()]
    number = lambda uri: int(x) if (x := uri[len(ID) + 1 : -1]) else None

    def rows_of(read_at: Callable[[int, int], bytes], ranges: list[dict]) -> Iterator[pa.RecordBatch]:
        rows = []
        for data in spans_of(read_at, [(r["at"], r["length"]) for r in ranges]):
            f, body = parse(gzip.decompress(data))
            response = f["WARC-Type"] == "response"
            digest = hashlib.sha256(body).hexdigest() if response else f["WARC-Payload-Digest"].removeprefix("sha256:")
            rows.append((number(f["WARC-Record-ID"]), number(f.get("WARC-Refers-To", f"<{ID}>")), f["WARC-Target-URI"], f["WARC-Type"], digest, len(body) if response else int(f["X-Payload-Length"]), body))
            if len(rows) == 256:
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], types[i]) for i in range(len(names))], names)
                rows = []
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], types[i]) for i in range(len(names))], names)

    def seek(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, spans in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with opened(file) as archive:
                    yield from rows_of(archive.read_at, spans)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content, spans in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                view = memoryview(content.as_buffer())
                yield from rows_of(lambda n, at: view[at : at + n], spans)  # noqa: B023

    schema = "page_id long, refers_to long, url string, kind string, digest string, bytes long" + ", payload binary" * payload
    one = ranges.select("file").first()
    if one is None or seekable(one[0]):
        return wanted.repartition(partitions(ranges)).mapInArrow(seek, schema)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")
    return files.join(fitting(wanted), files["path"] == wanted["file"]).select("content", "ranges").mapInArrow(cut, schema)
