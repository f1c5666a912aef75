"""WARC files as a Spark data source, and pages written to and read from them.

Reading plans partitions of whole files. A record's headers are inflated first; records that
the pushed predicates on type or headers refuse, and payloads nobody asked for, are skipped without
being decoded: files written here carry the skip lengths of the format's annex in the
gzip header of each record, so skipping is a seek. Files of other writers, plain or compressed by
record, are read as well.

Files are reached by URI through pyarrow's file systems, in the driver and in tasks alike.
"""

from __future__ import annotations

import io
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from datetime import UTC, datetime
from urllib.parse import unquote, urlsplit

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualNullSafe,
    EqualTo,
    Filter,
    In,
    InputPartition,
    IsNotNull,
    StringStartsWith,
    WriterCommitMessage,
)

from tillbook.llm.common import scratch_path, ship_package, written

SCHEMA = (
    "record_type string, record_id string, target_uri string, refers_to string, payload_digest string, "
    "payload_length long, headers map<string,string>, payload binary"
)
#: Columns that are WARC headers; others are in the map by their name in the file.
_HEADER_OF = {
    "record_type": "WARC-Type",
    "record_id": "WARC-Record-ID",
    "target_uri": "WARC-Target-URI",
    "refers_to": "WARC-Refers-To",
    "payload_digest": "WARC-Payload-Digest",
}
#: Bytes of files that one partition reads, unless a single file is larger; bytes after which a writer begins a file.
PARTITION_BYTES, FILE_BYTES = 64 << 20, 256 << 20
#: Bytes of payload after which a reader hands over a batch.
_BATCH_BYTES, _BATCH_ROWS = 8 << 20, 2000
#: Fixed values of the formats.
_VERSION = b"WARC/1.1\r\n"
_REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_GZIP_HEAD = b"\x1f\x8b\x08\x04\0\0\0\0\0\xff"  # deflate, with an extra field
_SKIP_FIELD = struct.Struct("<H2sHII")  # size of the field; its name, size, packed and plain length


def open_folder(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a URI or a local path."""
    parts = urlsplit(uri)
    if parts.scheme in ("", "file"):
        return fs.LocalFileSystem(), unquote(parts.path) if parts.scheme else uri
    return fs.FileSystem.from_uri(uri)


def _qualified(spark: SparkSession, path: str) -> str:
    """The URI of a path, so that one without a scheme is in the cluster's own file system."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return system.makeQualified(place).toUri().toString()


def packed(record: bytes) -> bytes:
    """The record as a gzip member that says its own length."""
    deflate = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = deflate.compress(record) + deflate.flush()
    size = len(_GZIP_HEAD) + _SKIP_FIELD.size + len(body) + 8
    extra = _SKIP_FIELD.pack(_SKIP_FIELD.size - 2, b"sl", 8, size, len(record) & 0xFFFFFFFF)
    return _GZIP_HEAD + extra + body + struct.pack("<II", zlib.crc32(record), len(record) & 0xFFFFFFFF)


def _safe(value: str) -> str:
    """A header value without control characters, which would end the header."""
    return "".join(f"%{ord(c):02X}" if ord(c) < 32 or ord(c) == 127 else c for c in value)


def record_bytes(row: dict, date: str) -> bytes:
    """A record of a row of ``SCHEMA``: an HTTP response, or for a revisit its head alone."""
    payload = row["payload"] or b""
    length = row["payload_length"] if row["payload_length"] is not None else len(payload)
    revisit = row["record_type"] == "revisit"
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode()
    block += b"" if revisit else payload
    headers = [(_HEADER_OF[name], row[name]) for name in _HEADER_OF]
    headers += [("WARC-Date", date), ("WARC-Profile", _REVISIT_PROFILE if revisit else None)]
    headers += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    headers += list(row["headers"] or ())
    head = "".join(f"{name}: {_safe(value)}\r\n" for name, value in headers if value is not None)
    return _VERSION + head.encode() + b"\r\n" + block + b"\r\n\r\n"


class WarcDataSource(DataSource):
    """Format ``warc``.

    Options: path; payload=false leaves payloads null; header.NAME=VALUE reads only records with
    this header, of any name; partition_bytes; file_bytes.
    """

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return WarcReader(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return WarcWriter(self.options)


@dataclass
class _Files(InputPartition):
    paths: list[str]


class WarcReader(DataSourceReader):
    def __init__(self, options):
        self.folder = options["path"]
        self.payload = options.get("payload", "true").lower() != "false"
        self.partition_bytes = int(options.get("partition_bytes", PARTITION_BYTES))
        self.tests: list[tuple[str, str, tuple]] = [
            (name.lower().removeprefix("header."), "in", (value,))
            for name, value in options.items()
            if name.lower().startswith("header.")
        ]

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Predicates on the columns that are headers are tested on them; others are left to Spark."""
        for test in filters:
            column = getattr(test, "attribute", ())
            header = _HEADER_OF.get(column[0]) if len(column) == 1 else None
            kinds = {EqualTo: "in", EqualNullSafe: "in", In: "in", StringStartsWith: "starts", IsNotNull: "there"}
            kind = kinds.get(type(test))
            values = test.value if isinstance(test, In) else (getattr(test, "value", None),)
            if header is None or kind is None or (kind != "there" and any(v is None for v in values)):
                yield test
            else:
                self.tests.append((header.lower(), kind, tuple(values)))

    def partitions(self) -> list[InputPartition]:
        system, path = open_folder(self.folder)
        kind = system.get_file_info(path)
        files = [kind] if kind.is_file else system.get_file_info(fs.FileSelector(path, recursive=True))
        plan: list[_Files] = []
        room = 0
        for file in sorted((f for f in files if f.is_file and f.base_name[0] not in "._"), key=lambda f: f.path):
            if file.size > room:
                plan.append(_Files([]))
                room = self.partition_bytes
            plan[-1].paths.append(file.path)
            room -= file.size
        return plan or [_Files([])]

    def wanted(self, headers: dict[str, str]) -> bool:
        low = {name.lower(): value for name, value in headers.items()}

        def holds(header: str, kind: str, values: tuple) -> bool:
            value = low.get(header)
            if value is None or kind == "there":
                return value is not None
            return value in values if kind == "in" else value.startswith(values[0])

        return all(holds(*test) for test in self.tests)

    def read(self, partition: _Files) -> Iterator[pa.RecordBatch]:
        system, _ = open_folder(self.folder)
        names = [field.name for field in _arrow_schema()]
        rows: list[tuple] = []
        size = 0
        for path in partition.paths:
            with system.open_input_file(path) as file:
                for headers, length, payload in records(file, self.wanted, self.payload):
                    columns = {c: headers.get(h) for c, h in _HEADER_OF.items()}
                    columns |= {"payload_length": length, "headers": list(headers.items()), "payload": payload}
                    rows.append(tuple(columns[n] for n in names))
                    size += len(payload or b"")
                    if size >= _BATCH_BYTES or len(rows) >= _BATCH_ROWS:
                        yield _batch(rows)
                        rows, size = [], 0
        yield _batch(rows)


def _arrow_schema() -> pa.Schema:
    text = pa.string()
    kinds = {"payload_length": pa.int64(), "headers": pa.map_(text, text), "payload": pa.binary()}
    names = [part.split()[0] for part in SCHEMA.replace("map<string,string>", "map").split(",")]
    return pa.schema([(name, kinds.get(name, text)) for name in names])


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    schema = _arrow_schema()
    columns = zip(*rows, strict=True) if rows else ([] for _ in schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _fields(head: bytes) -> dict[str, str]:
    """Names and values of header lines; the first line, which holds the version or status, is left out."""
    lines = (line.partition(":") for line in head.decode("utf-8", "replace").split("\r\n")[1:])
    return {name: value.strip() for name, found, value in lines if found}


class _Inflated:
    """Reads a gzip member from where the file stands, as far as it is asked for."""

    def __init__(self, file, start: bytes = b""):
        self.file, self.inflate, self.data = file, zlib.decompressobj(31), b""
        self.more(start)

    def more(self, raw: bytes | None = None) -> bool:
        raw = self.file.read(1 << 13) if raw is None else raw
        self.data += self.inflate.decompress(raw) if raw else b""
        return bool(raw) and not self.inflate.eof

    def until(self, size: int) -> bytes:
        parts, got = [self.data], len(self.data)
        while got < size and not self.inflate.eof and (raw := self.file.read(1 << 16)):
            parts.append(self.inflate.decompress(raw))
            got += len(parts[-1])
        self.data = b"".join(parts)
        return self.data[:size]

    def unused(self) -> int:
        """Bytes that were read beyond the member, which is first read to its end."""
        while not self.inflate.eof and (raw := self.file.read(1 << 16)):
            self.inflate.decompress(raw)
        return len(self.inflate.unused_data)


class _Plain:
    """The same for a record that isn't compressed."""

    def __init__(self, file):
        self.file, self.data = file, b""

    def more(self) -> bool:
        raw = self.file.read(1 << 13)
        self.data += raw
        return bool(raw)

    def until(self, size: int) -> bytes:
        if len(self.data) < size:
            self.data += self.file.read(size - len(self.data))
        return self.data[:size]


def records(
    file, wanted: Callable[[dict], bool], with_payload: bool
) -> Iterator[tuple[dict[str, str], int | None, bytes | None]]:
    """(headers, payload length, payload) of each wanted record of an open file.

    The length is what the HTTP head says, which for a revisit is that of the payload it refers
    to, or else the size of the block.
    """
    file = io.BufferedReader(file, 1 << 20)
    at = 0
    while True:
        file.seek(at)
        start = file.read(len(_GZIP_HEAD) + _SKIP_FIELD.size)
        if not start.strip(b"\r\n\0"):
            if len(start) < len(_GZIP_HEAD) + _SKIP_FIELD.size:
                return
            at += len(start)
            continue
        skip = None
        file.seek(at)
        if start[:2] == b"\x1f\x8b":
            if start[:4] == _GZIP_HEAD[:4] and start[12:14] == b"sl":
                skip = _SKIP_FIELD.unpack_from(start, len(_GZIP_HEAD))[3]
            record: _Inflated | _Plain = _Inflated(file)
        else:
            blanks = len(start) - len(start.lstrip(b"\r\n"))
            at += blanks
            file.seek(at)
            record = _Plain(file)
        while b"\r\n\r\n" not in record.data and record.more():
            pass
        head, found, _ = record.data.partition(b"\r\n\r\n")
        if not found:
            raise ValueError(f"no WARC record at byte {at}")
        headers = _fields(head)
        begin, size = len(head) + 4, int(headers.get("Content-Length", 0))
        if wanted(headers):
            yield (headers, *_payload(record, headers, begin, size, with_payload))
        if skip is None and isinstance(record, _Inflated):
            skip = -record.unused()
            at = file.tell() + skip
        else:
            at += skip if skip is not None else begin + size + 4


def _payload(record, headers: dict, begin: int, size: int, with_payload: bool) -> tuple[int | None, bytes | None]:
    http = headers.get("Content-Type", "").startswith("application/http")
    head, length = b"", size
    if http:
        while b"\r\n\r\n" not in record.data[begin : begin + size] and len(record.data) < begin + size and record.more():
            pass
        block = record.data[begin : begin + size]
        head = block[: block.find(b"\r\n\r\n") + 4] if b"\r\n\r\n" in block else block
        fields = {name.lower(): value for name, value in _fields(head).items()}
        said = fields.get("content-length", "")
        length = int(said) if said.isdigit() else size - len(head)
    if not with_payload or headers.get("WARC-Type") == "revisit":
        return length, None
    return length, record.until(begin + size)[begin + len(head) :]


@dataclass
class _Written(WriterCommitMessage):
    paths: list[str]


class WarcWriter(DataSourceArrowWriter):
    """Each task writes hidden files; those of the tasks that count are renamed when all are done."""

    def __init__(self, options):
        self.folder = options["path"]
        self.file_bytes = int(options.get("file_bytes", FILE_BYTES))
        self.date = options.get("date") or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Written:
        system, folder = open_folder(self.folder)
        system.create_dir(folder, recursive=True)
        paths: list[str] = []
        out, room = None, 0
        for batch in iterator:
            for row in batch.to_pylist():
                if room <= 0:
                    if out:
                        out.close()
                    paths.append(f"{folder}/_{uuid.uuid4().hex}.warc.gz")
                    out, room = system.open_output_stream(paths[-1], compression=None), self.file_bytes
                record = packed(record_bytes(row, self.date))
                out.write(record)
                room -= len(record)
        if out:
            out.close()
        return _Written(paths)

    def commit(self, messages: list[_Written | None]) -> None:
        system, _ = open_folder(self.folder)
        for path in (p for message in messages if message for p in message.paths):
            folder, _, name = path.rpartition("/")
            system.move(path, f"{folder}/{name[1:]}")

    def abort(self, messages: list[_Written | None]) -> None:
        system, _ = open_folder(self.folder)
        for path in (p for message in messages if message for p in message.paths):
            system.delete_file(path)


def use(spark: SparkSession) -> None:
    """Register the format and let Spark push predicates down to it."""
    ship_package(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcDataSource)


def base32(digest: Column) -> Column:
    """Upper-case base32 of the 40 hexadecimal digits of a SHA-1: five digits make four."""
    digits = [
        F.lpad(F.conv(F.substring(digest, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)
    ]
    return F.translate(F.concat(*digits), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def page_records(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """A row of ``SCHEMA`` for each page (page_id, url, html).

    Of pages with equal payloads of at least ``least_bytes`` bytes, that with the largest page_id is the
    response and the others are revisits, which carry no payload; smaller ones are all responses.
    A null html is an empty payload, a null url no header. A page without id is a
    revisit of one with an id, and a response if there is none; rows that repeat the
    response's id and payload are responses too. Other columns are not looked at.

    A payload that very many pages share is folded before its shuffle; pages move once, unless the table of
    shared payloads is small enough for Spark to broadcast. That table is written first, so that the join is one
    of two tables, which the adaptive skew join splits at a payload that many pages share.
    """
    body = F.coalesce("html", F.lit("")).cast("binary")
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        body.alias("body"),
        F.sha1(body).alias("digest"),
        F.octet_length(body).cast("long").alias("size"),
    )
    shared = (
        rows.where(F.col("size") >= least_bytes)
        .groupBy("digest", "size")
        .agg(F.max("page_id").alias("keeper"), F.count("*").alias("n"))
        .where("n > 1 AND keeper IS NOT NULL")
        .drop("n")
    )
    joined = rows.join(written(shared, "shared"), ["digest", "size"], "left")
    revisit = F.col("keeper").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("keeper"))
    identifier = F.format_string("<urn:page:%s>", F.coalesce(F.col("page_id").cast("string"), F.concat(F.lit("none:"), F.md5(F.concat_ws(" ", "digest", "url")))))
    return joined.select(
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        identifier.alias("record_id"),
        F.col("url").alias("target_uri"),
        F.when(revisit, F.format_string("<urn:page:%s>", F.col("keeper").cast("string"))).alias("refers_to"),
        F.concat(F.lit("sha1:"), base32(F.col("digest"))).alias("payload_digest"),
        F.col("size").alias("payload_length"),
        F.when(F.col("page_id").isNotNull(), F.create_map(F.lit("X-Page-ID"), F.col("page_id").cast("string"))).alias("headers"),
        F.when(~revisit, F.col("body")).alias("payload"),
    )


def write(rows: DataFrame, path: str) -> None:
    """Rows of ``SCHEMA`` as WARC files of gzip members; a folder that is there gets more files."""
    use(rows.sparkSession)
    rows.write.format("warc").mode("append").save(_qualified(rows.sparkSession, path))


def read(spark: SparkSession, path: str, payload: bool = True, headers: dict[str, str] | None = None) -> DataFrame:
    """The records of the WARC files at ``path`` that have these headers, lazily."""
    use(spark)
    chosen = {f"header.{name}": value for name, value in (headers or {}).items()}
    reader = spark.read.format("warc").options(payload=str(payload).lower(), **chosen)
    return reader.load(_qualified(spark, path))


def round_trip(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of pages written to archives and read back.

    Of responses, length and digest are those of the payload that was read; of revisits, those
    of the record's heads.
    """
    spark = pages.sparkSession
    path = scratch_path(spark, "warc")
    write(page_records(pages, least_bytes), path)
    rows = read(spark, path).where(F.col("record_type").isin("response", "revisit"))
    said = F.substring_index("payload_digest", ":", -1)
    number = F.regexp_extract("refers_to", r"^<urn:page:(-?\d+)>$", 1)
    return rows.select(
        F.try_element_at("headers", F.lit("X-Page-ID")).cast("long").alias("page_id"),
        F.coalesce(F.octet_length("payload"), "payload_length").cast("long").alias("payload_bytes"),
        F.coalesce(base32(F.sha1("payload")), said).alias("payload_digest"),
        "record_type",
        F.when(number != "", number).cast("long").alias("refers_to"),
    )
