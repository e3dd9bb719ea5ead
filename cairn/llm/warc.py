"""WARC archives: a Python data source with header predicates, and a writer of deduplicated records."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from datetime import UTC, datetime

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual, StringStartsWith, WriterCommitMessage

from cairn.llm.common import in_batches

#: Payloads smaller than this are never replaced by a reference.
SMALLEST = 100
#: Bytes at which a task of the writer starts another file.
FILE_BYTES = 256 << 20
#: Bytes of records that a task of the reader hands over at once.
BATCH_BYTES = 4 << 20
DATE = "2024-01-01T00:00:00Z"
SCHEMA = (
    "record_id string, warc_type string, target_uri string, warc_date string, content_type string, content_length long, payload_digest string, "
    "payload_length long, refers_to string, payload binary"
)
#: Columns that the headers alone give, and the header of each.
HEADERS = {
    "record_id": "warc-record-id", "warc_type": "warc-type", "target_uri": "warc-target-uri", "warc_date": "warc-date", "content_type": "content-type",
    "content_length": "content-length", "payload_digest": "warc-payload-digest", "payload_length": "x-payload-length", "refers_to": "warc-refers-to",
}


def filesystem(path: str):
    """The file system of a path or URI and the path in it."""
    if "://" in path or path.startswith("file:"):
        return pyarrow.fs.FileSystem.from_uri(path if "://" in path else "file://" + path[5:])
    return pyarrow.fs.LocalFileSystem(), path


# Records -----------------------------------------------------------------------------------------


def record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    head = "WARC/1.0\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + f"Content-Length: {len(block)}\r\n\r\n"
    return head.encode() + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    """A record as a gzip member of its own; an extra field 'sl' tells both its lengths, so that readers can skip it."""
    packer = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = packer.compress(data) + packer.flush()
    extra_size = 4 + 8
    total = 10 + 2 + extra_size + len(body) + 8
    extra = b"sl" + (8).to_bytes(2, "little") + total.to_bytes(4, "little") + (len(data) & 0xFFFFFFFF).to_bytes(4, "little")
    tail = zlib.crc32(data).to_bytes(4, "little") + (len(data) & 0xFFFFFFFF).to_bytes(4, "little")
    return b"\x1f\x8b\x08\x04\x00\x00\x00\x00\x00\xff" + extra_size.to_bytes(2, "little") + extra + body + tail


def clean_header(value: str) -> str:
    """A header value on one line."""
    return "".join(c if c >= " " and c != "\x7f" else f"%{ord(c):02X}" for c in value)


def response(record_id: str, uri: str | None, payload: bytes, digest: str) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    return record(_fields("response", record_id, uri, digest, len(payload)), http + payload)


def revisit(record_id: str, uri: str | None, digest: str, length: int, refers_to: str) -> bytes:
    more = [("WARC-Refers-To", f"<{refers_to}>"), ("WARC-Profile", "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest")]
    return record(_fields("revisit", record_id, uri, digest, length) + more, b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n")


def _fields(kind: str, record_id: str, uri: str | None, digest: str, length: int) -> list[tuple[str, str]]:
    fields = [("WARC-Type", kind), ("WARC-Record-ID", f"<{record_id}>"), ("WARC-Date", DATE), ("Content-Type", "application/http; msgtype=response")]
    if uri is not None:
        fields.append(("WARC-Target-URI", clean_header(uri)))
    return [*fields, ("WARC-Payload-Digest", f"sha256:{digest}"), ("X-Payload-Length", str(length))]


# Reading -----------------------------------------------------------------------------------------


def headers_of(data: bytes) -> tuple[dict[str, str], int]:
    """The header fields by lower-case name, and where the block begins."""
    end = data.index(b"\r\n\r\n")
    lines = data[:end].decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {}
    for line in lines[1:]:
        name, _, value = line.partition(":")
        fields[name.strip().lower()] = value.strip()
    return fields, end + 4


class Buffered:
    """Forward reading with skips; holds a chunk at a time."""

    def __init__(self, source, size: int, chunk: int = 1 << 20) -> None:
        self.source, self.size, self.chunk, self.held, self.at = source, size, chunk, b"", 0

    def peek(self, n: int, start: int = 0) -> bytes:
        """The ``n`` bytes from ``start`` on, counted from here; fewer at the end. They stay unread."""
        if self.at + start + n > len(self.held):
            parts = [self.held[self.at :]]
            there = len(parts[0])
            while there < start + n:
                got = self.source.read(max(self.chunk, start + n - there))
                if not got:
                    break
                parts.append(got)
                there += len(got)
            self.held, self.at = b"".join(parts), 0
        return self.held[self.at + start : self.at + start + n]

    def skip(self, n: int) -> None:
        if self.at + n <= len(self.held):
            self.at += n
        else:
            self.source.seek(self.source.tell() + self.at + n - len(self.held))
            self.held, self.at = b"", 0


def records(source, size: int, wanted) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields, block) of the records whose fields pass ``wanted``; of others no block is decoded."""
    data = Buffered(source, size)
    while True:
        head = data.peek(2)
        if not head:
            return
        if head[:2] == b"\x1f\x8b":
            yield from _zipped(data, wanted)
        else:
            yield from _plain(data, wanted)


def _plain(data: Buffered, wanted):
    n = 4096
    while b"\r\n\r\n" not in (seen := data.peek(n)):
        if len(seen) < n:
            if seen.strip():
                raise ValueError("a WARC record ends inside its headers")
            data.skip(len(seen))
            return
        n *= 4
    fields, start = headers_of(seen)
    length = int(fields.get("content-length", 0))
    if wanted(fields):
        block = data.peek(length, start)
        if len(block) < length:
            raise ValueError("a WARC record is cut off")
        yield fields, block
    data.skip(start + length + 4)


def _zipped(data: Buffered, wanted):
    seen = data.peek(64)
    skip = 0
    if seen[3] & 4:
        size, at = int.from_bytes(seen[10:12], "little"), 12
        seen = data.peek(12 + size)
        while at + 4 <= 12 + size:
            field = int.from_bytes(seen[at + 2 : at + 4], "little")
            if seen[at : at + 2] == b"sl" and field == 8:
                skip = int.from_bytes(seen[at + 4 : at + 8], "little")
            at += 4 + field
    unpack, out, used = zlib.decompressobj(31), b"", 0
    # headers first: a little at a time, until the blank line
    while b"\r\n\r\n" not in out and not unpack.eof:
        part = data.peek(512, used)
        if not part:
            raise ValueError("a gzip member is cut off")
        out += unpack.decompress(part)
        used += len(part) - len(unpack.unused_data)
    fields, start = headers_of(out)
    if skip and not wanted(fields):
        data.skip(skip)
        return
    parts = [out]
    while not unpack.eof:
        part = data.peek(1 << 16, used)
        if not part:
            raise ValueError("a gzip member is cut off")
        parts.append(unpack.decompress(part))
        used += len(part) - len(unpack.unused_data)
    if wanted(fields):
        out = b"".join(parts)
        yield fields, out[start : start + int(fields.get("content-length", 0))]
    data.skip(used)


def payload_of(fields: dict[str, str], block: bytes) -> bytes:
    if fields.get("content-type", "").startswith("application/http"):
        head, gap, body = block.partition(b"\r\n\r\n")
        return body if gap else b""
    return block


def value_of(column: str, fields: dict[str, str]):
    text = fields.get(HEADERS[column])
    if text is None:
        return None
    if column in ("record_id", "refers_to"):
        return text.strip("<>")
    if column in ("content_length", "payload_length"):
        return int(text)
    return text


class File(InputPartition):
    def __init__(self, path: str, size: int) -> None:
        self.path, self.size = path, size


_TESTS = {
    EqualTo: lambda x, v: x == v,
    In: lambda x, v: x in v,
    GreaterThan: lambda x, v: x > v,
    GreaterThanOrEqual: lambda x, v: x >= v,
    LessThan: lambda x, v: x < v,
    LessThanOrEqual: lambda x, v: x <= v,
    StringStartsWith: lambda x, v: x.startswith(v),
}


class WarcReader(DataSourceReader):
    """A partition per archive file; predicates on header columns are tested before a block is decoded."""

    def __init__(self, options, schema) -> None:
        self.options, self.schema, self.tests = options, schema, []

    def pushFilters(self, filters):
        for f in filters:
            column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if column in HEADERS and isinstance(f, IsNotNull):
                self.tests.append((column, lambda x, v: True, None))
            elif column in HEADERS and type(f) in _TESTS:
                self.tests.append((column, _TESTS[type(f)], f.value))
            else:
                yield f

    def partitions(self):
        fs, path = filesystem(self.options["path"])
        info = fs.get_file_info(path)
        if info.type == pyarrow.fs.FileType.File:
            found = [info]
        else:
            found = fs.get_file_info(pyarrow.fs.FileSelector(path, recursive=True))
        names = [x for x in found if x.type == pyarrow.fs.FileType.File and x.base_name.endswith((".warc", ".warc.gz")) and not x.base_name.startswith(("_", "."))]
        return [File(x.path, x.size) for x in sorted(names, key=lambda x: (-x.size, x.path))]

    def read(self, partition):
        if partition is None:
            return
        names, tests = self.schema.fieldNames(), self.tests
        decode = "payload" in names and self.options.get("payload", "true").lower() != "false"

        def wanted(fields):
            for column, test, value in tests:
                x = value_of(column, fields)
                if x is None or not test(x, value):
                    return False
            return True

        types = {"payload": pa.binary(), "content_length": pa.int64(), "payload_length": pa.int64()}
        kinds = [types.get(n, pa.string()) for n in names]

        def batch(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

        fs, _ = filesystem(self.options["path"])
        with fs.open_input_file(partition.path) as source:
            rows, held = [], 0
            for fields, block in records(source, partition.size, wanted):
                payload = payload_of(fields, block) if decode and fields.get("warc-type") != "revisit" else None
                rows.append([payload if n == "payload" else value_of(n, fields) for n in names])
                held += len(payload or b"") + 500
                if held >= BATCH_BYTES:
                    yield batch(rows)
                    rows, held = [], 0
            if rows:
                yield batch(rows)


class WarcWriter(DataSourceArrowWriter):
    """Writes rows (record_id, warc_type, target_uri, payload, payload_digest, payload_length, refers_to), a gzip member each.

    Tasks write to a hidden name. On commit the driver renames the files of the tasks that count and deletes what failed
    or repeated ones have left so far; what a late one still writes stays hidden and is never read.
    """

    def __init__(self, options, overwrite: bool) -> None:
        self.options, self.overwrite = options, overwrite
        self.tag = hashlib.md5(f"{options['path']}{datetime.now(UTC).isoformat()}".encode()).hexdigest()[:12]

    def write(self, batches):
        import os

        from pyspark import TaskContext

        context = TaskContext.get()
        fs, path = filesystem(self.options["path"])
        fs.create_dir(path, recursive=True)
        limit = int(self.options.get("fileBytes", FILE_BYTES))
        names, out, size = [], None, 0
        for batch in batches:
            columns = {n: batch.column(n) for n in batch.schema.names}
            for i in range(batch.num_rows):
                row = {n: c[i].as_py() for n, c in columns.items()}
                if out is None or size >= limit:
                    if out is not None:
                        out.close()
                    part = context.partitionId() if context else 0
                    names.append(f"{self.tag}-{part:05d}-{context.taskAttemptId() if context else os.getpid()}-{len(names):04d}.warc.gz")
                    out, size = fs.open_output_stream(f"{path}/_{names[-1]}", compression=None), 0
                if row["warc_type"] == "revisit":
                    data = revisit(row["record_id"], row["target_uri"], row["payload_digest"], row["payload_length"], row["refers_to"])
                else:
                    data = response(row["record_id"], row["target_uri"], row["payload"] or b"", row["payload_digest"])
                packed = member(data)
                out.write(packed)
                size += len(packed)
        if out is not None:
            out.close()
        return Written(names)

    def commit(self, messages):
        fs, path = filesystem(self.options["path"])
        fs.create_dir(path, recursive=True)
        if self.overwrite:
            for x in fs.get_file_info(pyarrow.fs.FileSelector(path)):
                if x.type == pyarrow.fs.FileType.File and not x.base_name.startswith("_"):
                    fs.delete_file(x.path)
        for m in messages:
            for name in m.names if m else ():
                fs.move(f"{path}/_{name}", f"{path}/{name}")
        self._sweep(fs, path)

    def abort(self, messages):
        fs, path = filesystem(self.options["path"])
        fs.create_dir(path, recursive=True)
        self._sweep(fs, path)

    def _sweep(self, fs, path: str) -> None:
        """Deletes this job's hidden files."""
        for x in fs.get_file_info(pyarrow.fs.FileSelector(path)):
            if x.type == pyarrow.fs.FileType.File and x.base_name.startswith(f"_{self.tag}-"):
                fs.delete_file(x.path)


class Written(WriterCommitMessage):
    def __init__(self, names: list[str]) -> None:
        self.names = names


class WarcSource(DataSource):
    """``spark.read.format("warc").load(path)`` and ``df.write.format("warc").save(path)``."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema):
        return WarcReader(dict(self.options), schema)

    def writer(self, schema, overwrite):
        return WarcWriter(dict(self.options), overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WarcSource)
    # predicates reach Python sources only if this is on
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


# Pages -------------------------------------------------------------------------------------------


def page_urn(page_id):
    return F.concat(F.lit("urn:x-page:"), F.coalesce(page_id.cast("string"), F.lit("")))


def page_of(urn):
    """The page id in a record's id; null for a null id."""
    return F.expr("try_cast(substring({}, 12) as bigint)".format(urn))


def records_of(pages: DataFrame, *, smallest: int = SMALLEST) -> DataFrame:
    """The records to write for (page_id, url, html): the first page of each payload whole, others as revisits of it.

    Of pages with equal payloads of at least ``smallest`` bytes, the one with the least page_id (null last)
    is a response and the others revisit it; rows that repeat that very page_id are responses too, and an id
    that repeats with other payloads is judged for each. Only digests are grouped, summed up before the
    shuffle. The payloads move once, to the revisits' ids and digests, and are not sorted: the short side
    of the join is the one that is hashed, and adaptive execution splits an id with very many rows.
    """
    body = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    slim = pages.select("page_id", F.octet_length(body).alias("n"), F.sha2(body, 256).alias("digest")).where(F.col("n") >= smallest)
    first = slim.groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("k")).where("k > 1 and first is not null")
    later = slim.select("page_id", "digest").distinct().join(first, "digest").where(~F.col("page_id").eqNullSafe(F.col("first")))
    later = later.select(F.col("page_id").alias("_id"), F.col("digest").alias("_digest"), "first")
    rows = pages.select("page_id", F.col("url").cast("string").alias("url"), body.alias("body"), F.sha2(body, 256).alias("digest"))
    joined = rows.join(later.hint("shuffle_hash"), F.col("page_id").eqNullSafe(F.col("_id")) & (F.col("digest") == F.col("_digest")), "left")
    return joined.select(page_urn(F.col("page_id")).alias("record_id"), "url", "body", "digest", "first")


def archive(pages: DataFrame, path: str, *, smallest: int = SMALLEST) -> None:
    """Writes a WARC record per row of ``pages`` to archives under ``path``.

    A null html is an empty payload; a null url has no target URI; control characters in a url are
    percent-encoded; ids repeat where rows do; an empty table writes no archive. Other columns are not
    read. A page id that repeats with different payloads has a record for each.
    """
    register(pages.sparkSession)
    rows = records_of(in_batches(pages), smallest=smallest)
    revisits = F.col("first").isNotNull()
    out = rows.select(
        "record_id",
        F.when(revisits, "revisit").otherwise("response").alias("warc_type"),
        F.col("url").alias("target_uri"),
        F.when(~revisits, F.col("body")).alias("payload"),
        F.col("digest").alias("payload_digest"),
        F.octet_length("body").cast("long").alias("payload_length"),
        page_urn(F.col("first")).alias("refers_to"),
    )
    out.write.format("warc").mode("append").save(path)


def read(spark: SparkSession, path: str, *, payload: bool = True) -> DataFrame:
    register(spark)
    return spark.read.format("warc").option("payload", str(payload).lower()).load(path)


def inventory(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of all page records under ``path``.

    Responses are read whole and their payloads measured and digested again; of revisits the headers tell both.
    """
    whole = F.col("warc_type") == "response"
    rows = read(spark, path).where(F.col("warc_type").isin("response", "revisit"))
    return rows.select(
        page_of("record_id").alias("page_id"),
        F.when(whole, F.octet_length("payload").cast("long")).otherwise(F.col("payload_length")).alias("payload_bytes"),
        F.when(whole, F.sha2("payload", 256)).otherwise(F.expr("substring(payload_digest, 8)")).alias("payload_digest"),
        F.col("warc_type").alias("record_type"),
        page_of("refers_to").alias("refers_to"),
    )
