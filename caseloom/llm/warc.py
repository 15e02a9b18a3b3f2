"""Web archives: records of pages, a normaliser for whole-file gzip, and reading by offset.

1. :func:`decide` finds equal payloads by a hash and their length. Of each group the smallest id
   is the response, the others revisit it; payloads below ``min_bytes`` are all responses.
2. :func:`write_archives` writes WARC files in which one gzip stream spans all records, as many
   tools leave them: nothing in them can be read without inflating all before it.
3. :func:`normalise` reads every such file once as a stream, writes each record as a gzip member
   of its own to a new file, and beside it a sidecar index with the offset and length of each
   member. Neither a file nor a record is ever held whole. Input of several members is read too.
4. :func:`read_archives` opens members by the offsets of the sidecars, checks the digest of every
   stored payload, and returns a row per page.

Files lie below a folder that all executors reach, through pyarrow's file systems. A task writes
files under names of its own attempt and returns them; a written table of these names says which
files count, so a repeated task leaves files that nobody reads, and no file is read half done.

A NULL payload is the empty one. A NULL URL is left out; control characters and blanks in a URL are
percent-encoded. A NULL id loses to any other; a group of NULL ids has responses only, and rows
that repeat the smallest id are all responses. Long payloads are written and normalised in chunks.
An empty table gives no rows. Columns other than id, URL and payload are not looked at.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from typing import BinaryIO
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseloom.llm.common import whole
from caseloom.sources.sinks import stage_path, write_stage

#: Inflated bytes after which a task opens its next file.
FILE_BYTES = 64 << 20
CHUNK = 1 << 20
LEVEL = 6
#: Groups of equal payloads up to which their heads are sent to all tasks (some 80 bytes each).
BROADCAST_GROUPS = 100_000
#: Beyond it rows meet the heads in so many places per group.
SALTS = 16
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORDS = "page_id string, url string, body binary, bytes bigint, digest string, refers_to string"
INDEX = "id string, type string, offset bigint, length bigint, digest string, file string"


def filesystem(uri: str):
    """pyarrow's file system for a path or URI, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1))


def decide(pages: DataFrame, min_bytes: int = 0, page_id: str = "page_id", url: str = "url", payload: str = "html") -> DataFrame:
    """One row per record: ``page_id, url, body, bytes, digest`` (hexadecimal SHA-1) and
    ``refers_to``, the id of the response of a revisit."""
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), whole(payload).cast("binary").alias("body"))
    rows = rows.withColumns({"bytes": F.octet_length("body").cast("bigint"), "digest": F.sha1("body"), "same": F.sha2("body", 256)})
    enough = F.col("bytes") >= min_bytes
    groups = rows.filter(enough).groupBy("same", "bytes").agg(F.min("page_id").alias("head"), F.count(F.lit(1)).alias("n"))
    groups = write_stage(groups.filter((F.col("n") > 1) & F.col("head").isNotNull()).drop("n"), "payload-groups")
    if groups.count() <= BROADCAST_GROUPS:
        joined = rows.join(F.broadcast(groups), ["same", "bytes"], "left")
    else:
        salts = F.sequence(F.lit(0), F.lit(SALTS - 1)).cast("array<bigint>")
        heads = groups.withColumn("salt", F.explode(salts))
        salted = rows.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)))
        joined = salted.join(heads, ["same", "bytes", "salt"], "left").drop("salt")
    other = F.col("head").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("head"))
    return joined.select("page_id", "url", "body", "bytes", "digest", F.when(other, F.col("head")).alias("refers_to"))


def urn(page_id: str | None) -> str:
    return "<urn:page>" if page_id is None else f"<urn:page:{quote(page_id, safe='')}>"


def from_urn(value: str) -> str | None:
    return unquote(value[len("<urn:page:") : -1]) if value.startswith("<urn:page:") else None


def _head(fields: list[tuple[str, str]]) -> bytes:
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n").encode()


def record_parts(page_id: str | None, url: str | None, body: bytes, digest: str, size: int, refers_to: str | None, date: str = DATE) -> Iterator[bytes]:
    """The bytes of a record: its header, then its block. A revisit has the HTTP header alone,
    which states the length of the payload it stands for."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    stored = body if refers_to is None else b""
    fields = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", urn(page_id)), ("WARC-Date", date)]
    if url is not None:
        fields.append(("WARC-Target-URI", "".join(quote(c) if c <= " " or c == "\x7f" else c for c in url)))
    fields.append(("WARC-Payload-Digest", "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode()))
    if refers_to is not None:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", urn(refers_to))]
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(http) + len(stored)))]
    yield _head(fields)
    yield http
    for at in range(0, len(stored), CHUNK):
        yield stored[at : at + CHUNK]
    yield b"\r\n\r\n"


def info_record(date: str = DATE) -> bytes:
    block = b"software: caseloom\r\nformat: WARC File Format 1.1\r\n"
    fields = [("WARC-Type", "warcinfo"), ("WARC-Record-ID", "<urn:warcinfo>"), ("WARC-Date", date), ("Content-Type", "application/warc-fields")]
    return _head([*fields, ("Content-Length", str(len(block)))]) + block + b"\r\n\r\n"


def write_archives(records: DataFrame, folder: str, file_bytes: int = FILE_BYTES, level: int = LEVEL, date: str = DATE) -> DataFrame:
    """Write the records of :func:`decide`; returns the written table of the ``file``s (names below
    the folder) with their number of ``records``."""
    plain = records.withColumns({"page_id": F.col("page_id").cast("string"), "refers_to": F.col("refers_to").cast("string")})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = filesystem(folder)
        system.create_dir(root, recursive=True)
        out, packer, name, size, count = None, None, "", 0, 0

        def closed() -> pa.RecordBatch:
            out.write(packer.flush())
            out.close()
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([count], pa.int64())], ["file", "records"])

        for batch in batches:
            for row in batch.to_pylist():
                if out is None:
                    name, size, count = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                    out, packer = system.open_output_stream(f"{root}/{name}", compression=None), zlib.compressobj(level, zlib.DEFLATED, 31)
                    out.write(packer.compress(info_record(date)))
                for part in record_parts(row["page_id"], row["url"], row["body"], row["digest"], row["bytes"], row["refers_to"], date):
                    out.write(packer.compress(part))
                    size += len(part)
                count += 1
                if size >= file_bytes:
                    yield closed()
                    out = None
        if out is not None:
            yield closed()

    columns = [c.split(" ")[0] for c in RECORDS.split(", ")]
    return write_stage(plain.select(*columns).mapInArrow(run, "file string, records bigint"), "archives")


class Inflated:
    """The inflated bytes of a gzip file of one or more members, read in chunks."""

    def __init__(self, source: BinaryIO):
        self.source, self.inflate, self.left, self.buffer = source, zlib.decompressobj(31), b"", bytearray()
        self.done = self.begun = False

    def _more(self) -> bool:
        """Get more bytes; False at the end."""
        while not self.done:
            if self.inflate.eof:
                self.left = self.inflate.unused_data or self.source.read(CHUNK)
                if not self.left:
                    self.done = True
                    return False
                self.inflate = zlib.decompressobj(31)
            data = self.left or self.inflate.unconsumed_tail or self.source.read(CHUNK)
            self.left = b""
            if not data and not self.begun:  # a file without a byte has no records
                self.done = True
                return False
            if not data:
                raise ValueError("the archive ends within a gzip member")
            self.begun = True
            found = self.inflate.decompress(data, 4 * CHUNK)
            if found:
                self.buffer += found
                return True
        return False

    def until(self, mark: bytes) -> bytes | None:
        """Bytes up to and with a mark; None at the end of the file."""
        at = 0
        while (found := self.buffer.find(mark, at)) < 0:
            at = max(0, len(self.buffer) - len(mark) + 1)
            if not self._more():
                if self.buffer.strip():
                    raise ValueError("the archive ends within a record header")
                return None
        return self._take(found + len(mark))

    def _take(self, n: int) -> bytes:
        out = bytes(self.buffer[:n])
        del self.buffer[:n]
        return out

    def exactly(self, n: int) -> Iterator[bytes]:
        while n:
            if not self.buffer and not self._more():
                raise ValueError("the archive ends within a record")
            part = self._take(min(n, CHUNK, len(self.buffer)))
            n -= len(part)
            yield part


def fields_of(head: bytes) -> dict[str, str]:
    """Named fields of a header, names in lower case."""
    lines = head.decode("utf-8", "surrogateescape").strip("\r\n").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("no WARC record where one should begin")
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}


@dataclass
class Member:
    offset: int
    length: int
    fields: dict[str, str]


def split_members(source: BinaryIO, target: BinaryIO, level: int = LEVEL) -> Iterator[Member]:
    """Write every record of the source as a gzip member of the target."""
    stream, at = Inflated(source), 0
    while (head := stream.until(b"\r\n\r\n")) is not None:
        head = head.lstrip(b"\r\n")
        fields, packer, length = fields_of(head), zlib.compressobj(level, zlib.DEFLATED, 31), 0
        size = int(fields["content-length"])
        length += target.write(packer.compress(head))
        for part in stream.exactly(size):
            length += target.write(packer.compress(part))
        if b"".join(stream.exactly(4)) != b"\r\n\r\n":
            raise ValueError("a record is longer than it says")
        length += target.write(packer.compress(b"\r\n\r\n"))
        length += target.write(packer.flush())
        yield Member(at, length, fields)
        at += length


def normalise(files: DataFrame, source: str, folder: str, level: int = LEVEL) -> DataFrame:
    """Rewrite the archives named in ``files`` (column ``file``, below ``source``) member by member
    into ``folder``, each with a sidecar ``.index`` of JSON lines. Returns the written table of new
    ``file``s with their ``records``."""
    count = max(1, files.count())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (old, old_root), (new, new_root) = filesystem(source), filesystem(folder)
        new.create_dir(new_root, recursive=True)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                fresh = f"{uuid.uuid4().hex}.warc.gz"
                number = 0
                with (
                    old.open_input_stream(f"{old_root}/{name}", compression=None) as archive,
                    new.open_output_stream(f"{new_root}/{fresh}", compression=None) as target,
                    new.open_output_stream(f"{new_root}/{fresh}.index", compression=None) as index,
                ):
                    for member in split_members(archive, target, level):
                        said = member.fields
                        row = {"id": said.get("warc-record-id"), "type": said.get("warc-type"), "offset": member.offset, "length": member.length}
                        row |= {"digest": said.get("warc-payload-digest"), "file": fresh}
                        index.write(json.dumps(row).encode() + b"\n")
                        number += 1
                yield pa.RecordBatch.from_arrays([pa.array([fresh]), pa.array([number], pa.int64())], ["file", "records"])

    dealt = files.select("file").repartition(count)
    return write_stage(dealt.mapInArrow(run, "file string, records bigint"), "members")


def parse_member(data: bytes) -> dict:
    """A row of :func:`read_archives` from one member; a stored payload is checked."""
    record = zlib.decompress(data, 31)
    head, _, rest = record.partition(b"\r\n\r\n")
    said = fields_of(head)
    http, _, payload = rest[: int(said["content-length"])].partition(b"\r\n\r\n")
    size = next(int(v) for k, _, v in (line.partition(b":") for line in http.split(b"\r\n")) if k.strip().lower() == b"content-length")
    digest, kind = said["warc-payload-digest"].removeprefix("sha1:"), said["warc-type"]
    if kind == "response" and (len(payload) != size or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
        raise ValueError(f"payload of {said['warc-record-id']} is not the one written")
    refers = said.get("warc-refers-to")
    return {
        "page_id": from_urn(said["warc-record-id"]), "url": said.get("warc-target-uri"), "payload_bytes": size, "payload_digest": digest,
        "record_type": kind, "refers_to": from_urn(refers) if refers else None, "payload": payload if kind == "response" else None,
    }


def read_index(files: DataFrame, folder: str) -> DataFrame:
    """The sidecar rows of the files that count."""
    index = files.sparkSession.read.schema(INDEX).json(f"{folder}/*.index")
    return index.join(files.select("file"), "file", "left_semi")


def read_archives(files: DataFrame, folder: str, payload: bool = False) -> DataFrame:
    """Per page: ``page_id`` (text), ``url``, ``payload_bytes``, ``payload_digest``, ``record_type``,
    ``refers_to`` (text), and the stored ``payload`` if asked for."""
    spark = files.sparkSession
    schema = "page_id string, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to string"
    schema += ", payload binary" if payload else ""
    if files.isEmpty():
        return spark.createDataFrame([], schema)
    index = read_index(files, folder).filter(F.col("type").isin("response", "revisit")).select("file", "offset", "length")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = filesystem(folder)
        name, source = None, None
        names = [c.split(" ")[0] for c in schema.split(", ")]
        types = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.binary()]

        def out(rows: list[dict]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], t) for n, t in zip(names, types)], names)  # noqa: B905

        for batch in batches:
            rows, size = [], 0
            for row in batch.to_pylist():
                if row["file"] != name:
                    if source is not None:
                        source.close()
                    name, source = row["file"], system.open_input_file(f"{root}/{row['file']}")
                source.seek(row["offset"])
                rows.append(parse_member(source.read(row["length"])))
                size += len(rows[-1]["payload"] or b"")
                if not payload:
                    rows[-1]["payload"] = None
                elif size >= 16 * CHUNK:
                    yield out(rows)
                    rows, size = [], 0
            if rows:
                yield out(rows)
        if source is not None:
            source.close()

    return index.mapInArrow(run, schema)


def archive(pages: DataFrame, min_bytes: int = 0, page_id: str = "page_id", url: str = "url", payload: str = "html", folder: str | None = None) -> DataFrame:
    """Write the pages, normalise the archives and read them back: per page ``page_id,
    payload_bytes, payload_digest, record_type, refers_to``, ids in their own type."""
    root = folder or stage_path(pages.sparkSession, "warc")
    kind = pages.schema[page_id].dataType
    written = write_archives(decide(pages, min_bytes, page_id, url, payload), f"{root}/whole")
    members = normalise(written, f"{root}/whole", f"{root}/members")
    found = read_archives(members, f"{root}/members")
    ids = {c: F.col(c).cast(kind) for c in ("page_id", "refers_to")}
    return found.withColumns(ids).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
