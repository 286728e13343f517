"""WARC archives as a Spark data source, with payload dedup by revisit records."""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualTo,
    Filter,
    In,
    InputPartition,
    WriterCommitMessage,
)

from loam.llm.common import bitmap_of, probed
from loam.session import discard, new_path, written

READ_SCHEMA = (
    "record_type string, record_id string, target_uri string, date string, payload_digest string, "
    "refers_to string, payload_bytes long, payload binary"
)
#: Fixed names and values of the format, and where columns come from.
VERSION = b"WARC/1.0\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
HEADERS = {
    "record_type": "warc-type",
    "record_id": "warc-record-id",
    "target_uri": "warc-target-uri",
    "date": "warc-date",
    "payload_digest": "warc-payload-digest",
    "refers_to": "warc-refers-to",
}
#: An extra field of a gzip member: its name, "sl" for skip lengths, and its length.
_LENGTHS = b"sl\x08\0"
#: Bytes that are read at once, and that are inflated at once while only headers are wanted.
_BLOCK, _PIECE = 1 << 20, 1 << 12


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


class Files(InputPartition):
    """Archives that one task reads."""

    def __init__(self, paths: tuple[str, ...]):
        super().__init__(paths)
        self.paths = paths


def _filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri}" if uri.startswith("/") else uri)


class _Stream:
    """Bytes of an archive, plain or in gzip members, with reads that can pass over what nobody wants.

    A member that states its length (see :func:`_packed`) is left by a seek, without inflating the rest of it.
    """

    def __init__(self, raw, packed: bool):
        self.raw, self.packed = raw, packed
        self.input, self.at = b"", 0  # as read; from ``at`` on not yet decoded
        self.buffer, self.place = b"", 0  # decoded; from ``place`` on not yet given out
        self.inflater = None
        self.end = self.size = self.given = 0  # of the member: where it ends, how long it is unpacked, how much of that is out

    def _fill(self, least: int = 1) -> bool:
        while len(self.input) - self.at < least and (more := self.raw.read(_BLOCK)):
            self.input, self.at = self.input[self.at :] + more, 0
        return len(self.input) - self.at >= least

    def _member(self) -> bool:
        """Opens the next member."""
        if not self._fill():
            return False
        start = self.raw.tell() - len(self.input) + self.at
        self.end = self.size = 0
        if self._fill(12) and self.input[self.at + 3] & 4:
            extra = int.from_bytes(self.input[self.at + 10 : self.at + 12], "little")
            if self._fill(12 + extra):
                field = self.input[self.at + 12 : self.at + 12 + extra]
                if field[:4] == _LENGTHS and len(field) == 12:
                    packed, self.size = struct.unpack("<II", field[4:])
                    self.end = start + packed
        self.inflater, self.given = zlib.decompressobj(31), self.place - len(self.buffer)
        return True

    def _more(self, want: int = _PIECE) -> bytes:
        if not self.packed:
            out = self.input[self.at :] if self._fill() else b""
            self.at = len(self.input)
            return out
        while self.inflater is not None or self._member():
            self._fill()
            piece = self.input[self.at : self.at + max(_PIECE, min(want, _BLOCK))]
            out = self.inflater.decompress(piece, max(_PIECE, want))
            done = self.inflater.eof
            self.at += len(piece) - len(self.inflater.unused_data if done else self.inflater.unconsumed_tail)
            if done:
                self.inflater = None
            if out or not (piece or done):
                return out
        return b""

    def _extend(self, want: int = _PIECE) -> bool:
        more = self._more(want)
        self.buffer, self.place = self.buffer[self.place :] + more, 0
        return bool(more)

    def _give(self, end: int) -> bytes:
        out = self.buffer[self.place : end]
        self.place = end
        self.given += len(out)
        return out

    def line(self) -> bytes:
        seen = self.place
        while (end := self.buffer.find(b"\n", seen)) < 0:
            have = len(self.buffer) - self.place
            if not self._extend():
                return self._give(len(self.buffer))
            seen = have
        return self._give(end + 1)

    def take(self, n: int) -> bytes:
        parts = [self._give(min(len(self.buffer), self.place + n))]
        left = n - len(parts[0])
        while left:
            if not self._extend(left):
                raise ValueError("an archive ends within a record")
            parts.append(self._give(min(len(self.buffer), left)))
            left -= len(parts[-1])
        return b"".join(parts)

    def skip(self, n: int) -> None:
        """Passes over n bytes without keeping them; by a seek where the place of their end is known."""
        passed = len(self._give(min(len(self.buffer), self.place + n)))
        n -= passed
        if not n:
            return
        if not self.packed:
            return self._seek(self.raw.tell() - len(self.input) + self.at + n)
        if self.inflater is not None and self.end and self.given + n <= self.size <= self.given + n + 4:  # nothing else in this member
            self.inflater = None
            return self._seek(self.end)
        while n:
            if not self._extend(n):
                raise ValueError("an archive ends within a record")
            n -= len(self._give(min(len(self.buffer), n)))

    def _seek(self, to: int) -> None:
        start = self.raw.tell() - len(self.input)
        self.buffer, self.place = b"", 0
        if start <= to <= start + len(self.input):
            self.at = to - start
        else:
            self.raw.seek(to)
            self.input, self.at = b"", 0


def _packed(data: bytes, level: int) -> bytes:
    """A gzip member that states its packed and unpacked length in an extra field, where both fit 32 bits."""
    packer = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = packer.compress(data) + packer.flush()
    end = struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)
    if max(len(data), len(body)) >= (1 << 32) - 64:
        return b"\x1f\x8b\x08\0\0\0\0\0\0\xff" + body + end
    head = b"\x1f\x8b\x08\x04\0\0\0\0\0\xff\x0c\0" + _LENGTHS
    return head + struct.pack("<II", len(head) + 8 + len(body) + 8, len(data)) + body + end


def _headers(stream: _Stream) -> dict[str, str]:
    found: dict[str, str] = {}
    while (line := stream.line()) not in (b"\r\n", b"\n", b""):
        name, _, value = line.decode("utf-8", "replace").partition(":")
        found[name.strip().lower()] = value.strip()
    return found


def records(stream: _Stream, wanted: dict[str, frozenset], payloads: bool) -> Iterator[tuple]:
    """Rows of READ_SCHEMA. Headers come first; the block of an unwanted record is skipped undecoded."""
    while line := stream.line():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no record where one should begin: {line[:40]!r}")
        head = _headers(stream)
        length = int(head.get("content-length", 0))
        row = [head.get(name) for name in HEADERS.values()]
        if row[4]:
            row[4] = row[4].rpartition(":")[2]
        if any(value not in wanted[c] for c, value in zip(HEADERS, row) if c in wanted):
            stream.skip(length)
            continue
        payload = None
        if head.get("content-type", "").startswith("application/http"):
            at, first = 0, stream.line()
            at += len(first)
            size = 0
            while at < length and (line := stream.line()).strip():
                at += len(line)
                name, _, value = line.partition(b":")
                if name.strip().lower() == b"content-length":
                    size = int(value)
            at += len(line) if at < length else 0
            rest = length - at
            size = rest if row[0] != "revisit" else size
        else:
            rest = size = length
        if payloads and row[0] != "revisit":
            payload = stream.take(rest)
        else:
            stream.skip(rest)
        yield (*row, size, payload)


class WarcReader(DataSourceReader):
    """Reads ``path``; equality and IN predicates on header columns are decided from the headers."""

    def __init__(self, options: dict):
        self.path = options["path"]
        self.payloads = str(options.get("payloads", "true")).lower() == "true"
        self.split_bytes = int(options.get("splitbytes", 64 << 20))
        self.wanted: dict[str, frozenset] = {}
        if types := options.get("recordtypes"):
            self.wanted["record_type"] = frozenset(types.split(","))

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            column = f.attribute[0] if isinstance(f, (EqualTo, In)) and len(f.attribute) == 1 else None
            if column not in HEADERS:
                yield f
                continue
            values = frozenset(f.value if isinstance(f, In) else [f.value])
            self.wanted[column] = self.wanted.get(column, values) & values

    def partitions(self) -> Sequence[InputPartition]:
        """Archives in order of name, small ones together."""
        fs, path = _filesystem(self.path)
        info = fs.get_file_info(path)
        found = fs.get_file_info(pafs.FileSelector(path, recursive=True)) if info.type == pafs.FileType.Directory else [info]
        out, group, size = [], [], 0
        for f in sorted(found, key=lambda f: f.path):
            if f.type != pafs.FileType.File or not f.path.endswith((".warc", ".warc.gz")):
                continue
            if group and size + f.size > self.split_bytes:
                out.append(Files(tuple(group)))
                group, size = [], 0
            group.append(f.path)
            size += f.size
        return [*out, Files(tuple(group))] if group or not out else out

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        fs, _ = _filesystem(self.path)
        schema = pa.schema([(c, pa.string()) for c in HEADERS] + [("payload_bytes", pa.int64()), ("payload", pa.binary())])
        for path in partition.paths:
            with fs.open_input_file(path) as raw:
                rows, size = [], 0
                for row in records(_Stream(raw, path.endswith(".gz")), self.wanted, self.payloads):
                    rows.append(row)
                    size += len(row[-1] or b"") + 256
                    if size > 8 << 20:
                        yield _batch(rows, schema)
                        rows, size = [], 0
                if rows:
                    yield _batch(rows, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


@dataclass
class Archives(WriterCommitMessage):
    paths: tuple[str, ...]


class WarcWriter(DataSourceArrowWriter):
    """Writes rows of READ_SCHEMA as gzip members; ``payload_bytes`` counts where there is no payload, and digests may be hexadecimal.

    Each file begins with a ``warcinfo`` record, and a task begins a new file after ``fileBytes``, so
    that no reader's task has more than that. A task writes under names of its own attempt, which
    the commit renames, so what a lost executor left behind is never read.
    """

    def __init__(self, options: dict):
        self.path = options["path"]
        self.level = int(options.get("level", 4))
        self.file_bytes = int(options.get("filebytes", 256 << 20))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Archives:
        fs, path = _filesystem(self.path)
        fs.create_dir(path, recursive=True)
        names: list[str] = []
        out, size = None, 0
        for batch in iterator:
            for row in batch.to_pylist():
                if out is None or size > self.file_bytes:
                    if out is not None:
                        out.close()
                    names.append(f"{path}/{uuid.uuid4().hex}.warc.gz.part")
                    out, size = fs.open_output_stream(names[-1]), 0
                    out.write(self._info(row["date"]))
                member = self.member(row)
                out.write(member)
                size += len(member)
        if out is not None:
            out.close()
        return Archives(tuple(names))

    def _record(self, head: list[tuple[str, str | None]], block: bytes) -> bytes:
        lines = "".join(f"{k}: {' '.join(v.split())}\r\n" for k, v in [*head, ("Content-Length", str(len(block)))] if v is not None)
        return _packed(VERSION + lines.encode("utf-8", "replace") + b"\r\n" + block + b"\r\n\r\n", self.level)

    def _info(self, date: str | None) -> bytes:
        head = [("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", date), ("Content-Type", "application/warc-fields")]
        return self._record(head, b"format: WARC File Format 1.0\r\n")

    def member(self, row: dict) -> bytes:
        payload = row["payload"] or b""
        size = (row["payload_bytes"] or 0) if row["payload"] is None else len(payload)
        digest = row["payload_digest"] or base32_sha1(payload)
        if len(digest) == 40:  # in hexadecimal digits
            digest = base64.b32encode(bytes.fromhex(digest)).decode()
        http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % size
        revisit = row["record_type"] == "revisit"
        head = [
            ("WARC-Type", row["record_type"]),
            ("WARC-Record-ID", row["record_id"]),
            ("WARC-Target-URI", row["target_uri"]),
            ("WARC-Date", row["date"]),
            ("WARC-Payload-Digest", f"sha1:{digest}"),
            ("WARC-Refers-To", row["refers_to"]),
            ("WARC-Profile", REVISIT_PROFILE if revisit else None),
            ("Content-Type", "application/http; msgtype=response"),
        ]
        return self._record(head, http if revisit else http + payload)

    def commit(self, messages: list) -> None:
        fs, _ = _filesystem(self.path)
        for path in [p for m in messages if m is not None for p in m.paths]:
            fs.move(path, path.removesuffix(".part"))

    def abort(self, messages: list) -> None:
        fs, _ = _filesystem(self.path)
        for path in [p for m in messages if m is not None for p in m.paths]:
            fs.delete_file(path)


class WarcDataSource(DataSource):
    """``spark.read.format("warc").load(path)`` and ``df.write.format("warc").save(path)``.

    Read options: ``recordTypes`` (a comma-separated list), ``payloads`` (false: headers only),
    ``splitBytes`` (archives below it share a partition). Write options: ``level`` of gzip, ``fileBytes``.
    """

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return READ_SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(dict(self.options))


def register(spark: SparkSession) -> None:
    """Makes the source known, and lets this session hand it predicates, which Spark does not by default."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcDataSource)


def write_pages(
    pages: DataFrame,
    path: str,
    id_col: str = "page_id",
    url_col: str = "url",
    payload_col: str = "html",
    min_revisit_bytes: int = 0,
    date: str = "2024-01-01T00:00:00Z",
) -> None:
    """Writes a record for each row: a response, or a revisit of the largest id with the same payload.

    Payloads are texts in UTF-8, null ones empty, of any length; those shorter than
    ``min_revisit_bytes`` are all responses. The record id carries the row's id; a null id is
    smaller than any other. Rows that repeat the largest id of a payload are all responses. An
    empty table writes no record, and other columns are ignored.

    Only digests are grouped. What shares one, as a bitmap of the groups tells, is decided without payloads, and
    revisits are written without: their digest and size are known. Of what stays a response only the
    rows of groups, told by a second bitmap, are joined with their payloads, so payloads are shuffled once for
    each group at most; all others go from the scan to the archive.
    """
    payload = F.coalesce(F.col(payload_col).cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("target_uri"), payload.alias("payload"))
    key = F.coalesce(F.concat(F.lit("="), F.col("id").cast("string")), F.lit(""))
    rows = rows.withColumns({"sha1": F.sha1("payload"), "key": key, "payload_bytes": F.octet_length("payload").cast("long")})
    groups = (
        rows.where(F.col("payload_bytes") >= min_revisit_bytes)
        .groupBy("sha1")
        .agg(F.max("id").alias("keep"), F.count(F.lit(1)).alias("n"))
        .where("n > 1")
        .select("sha1", "keep")
    )
    groups = written(groups, "payloads")
    members = bitmap_of(groups.select("sha1"))
    slim = probed(rows.select("id", "target_uri", "sha1", "key", "payload_bytes"), members, "member", F.col("sha1")).where("member")
    revisit = F.coalesce("shared", F.lit(False)) & ~F.col("id").eqNullSafe(F.col("keep"))
    decided = slim.join(groups.withColumn("shared", F.lit(True)), "sha1", "left").select("id", "target_uri", "sha1", "key", "payload_bytes", "keep", revisit.alias("revisit"))
    decided = written(decided, "decided")
    responses = written(decided.where("NOT revisit").select("sha1", "key").distinct(), "responses")

    def record_id(column: str) -> Column:
        return F.concat(F.lit("<urn:loam:page:"), F.coalesce(F.col(column).cast("string"), F.lit("")), F.lit(">"))

    def record(of: DataFrame, kind: str, digest: Column, refers_to: Column, body: Column) -> DataFrame:
        return of.select(
            F.lit(kind).alias("record_type"), record_id("id").alias("record_id"), "target_uri", F.lit(date).alias("date"),
            digest.alias("payload_digest"), refers_to.alias("refers_to"), "payload_bytes", body.alias("payload"),
        )

    none = F.lit(None)
    told = probed(probed(rows, members, "member", F.col("sha1")), bitmap_of(responses), "kept", F.col("sha1"), F.col("key"))
    straight = told.where("NOT member")
    joined = told.where("member AND kept").join(responses, ["sha1", "key"], "left_semi")
    out = record(straight, "response", none.cast("string"), none.cast("string"), F.col("payload"))
    out = out.union(record(joined, "response", none.cast("string"), none.cast("string"), F.col("payload")))
    out = out.union(record(decided.where("revisit"), "revisit", F.col("sha1"), record_id("keep"), none.cast("binary")))
    register(pages.sparkSession)
    out.write.format("warc").mode("append").save(path)
    discard(groups, decided, responses)


def read_pages(
    spark: SparkSession, path: str, id_col: str = "page_id", payloads: bool = True, record_types: Sequence[str] = ("response", "revisit")
) -> DataFrame:
    """(id_col, target_uri, record_type, payload_bytes, payload_digest, refers_to, payload) of an archive folder.

    Records of other types are passed over by a predicate on their headers, and with ``payloads`` off all
    payloads are. Ids are null where a record's id is not of this module's form; an empty folder
    gives no rows.
    """
    register(spark)
    rows = spark.read.format("warc").option("payloads", str(payloads).lower()).load(path).where(F.col("record_type").isin(*record_types))
    number = lambda c: F.expr(f"try_cast(regexp_extract({c}, '<urn:loam:page:(-?[0-9]+)>', 1) AS bigint)")
    return rows.select(
        number("record_id").alias(id_col),
        "target_uri",
        "record_type",
        "payload_bytes",
        "payload_digest",
        number("refers_to").alias("refers_to"),
        "payload",
    )


def archive_pages(pages: DataFrame, payloads: bool = True, **options) -> DataFrame:
    """Writes ``pages`` to a new archive in the shared folder and reads it back; cases as in :func:`write_pages`."""
    spark = pages.sparkSession
    path = new_path(spark, "warc")
    write_pages(pages, path, **options)
    return read_pages(spark, path, payloads=payloads)
