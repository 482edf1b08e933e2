"""Operator 9, WARC files as a chunked record table.

``read_warc`` streams WARC files (plain, or gzip with any number of members) and
returns each record's block as rows of at most ``chunk`` bytes: the record's
identifier and chunk number, the bytes, and the SHA-1 of the block up to and with
that chunk.  A task holds a read buffer, one chunk and the rows of one output batch
(about ``FLUSH`` bytes), never a whole record, so an oversized payload costs no more
memory than a small one.  The last chunk says whether the block's declared length
and digest hold.

Files are opened with Arrow's file systems by URI (local, HDFS, object stores), a
file a task.  ``write_warc`` streams rows into files the same way, for tests and
for tables that hold pages rather than files; a task's file has a name of its own, and
only the files of attempts that succeeded are listed, so lost executors do no harm.

Defined results.  A record without content has one chunk of no bytes.  A file cut
short ends with a chunk whose ``length_ok`` is false.  A file that is empty or
whose first line is no WARC version gives no rows; where that happens between
records the rest of the file is skipped, with a row of record_id null and the file's
remaining offset.  Damage in a gzip member ends its record (``length_ok`` false where its
bytes are missing); a row of record_id null follows, and reading goes on at the next
member that starts with a record.  Header lines are read whole.  Records without a digest have ``digest_ok`` null; so have digests
other than sha1 and md5.  Repeated rows are records of their own.  ``write_warc``
skips rows without content (null) and writes null ids and URIs as missing headers.
An empty table gives no files and no rows.  Extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import sys
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .memory import task
from .storage import cut, shared_dir

CHUNK, FLUSH, BUFFER = 1 << 16, 4 << 20, 1 << 18
SCHEMA = (
    "file string, record_id string, warc_type string, target_uri string, content_length long, chunk_no int, start long, n_bytes int, chunk binary, "
    "sha1_so_far string, last boolean, length_ok boolean, digest_ok boolean"
)
_ARROW = pa.schema([
    ("file", pa.string()), ("record_id", pa.string()), ("warc_type", pa.string()), ("target_uri", pa.string()), ("content_length", pa.int64()), ("chunk_no", pa.int32()), ("start", pa.int64()), ("n_bytes", pa.int32()),
    ("chunk", pa.binary()), ("sha1_so_far", pa.string()), ("last", pa.bool_()), ("length_ok", pa.bool_()), ("digest_ok", pa.bool_()),
])


class Reader:
    """Buffered reads from a binary stream, unpacked where it starts like gzip."""

    def __init__(self, stream, buffer: int = BUFFER):
        self.stream, self.size, self.held, self.at = stream, buffer, b"", 0
        self.raw = stream.read(buffer)
        self.zipped = self.raw[:2] == b"\x1f\x8b"
        self.unzip = zlib.decompressobj(31) if self.zipped else None
        self.offset = 0
        self.taken, self.member = len(self.raw), 0  # bytes read from the stream, and where the open member starts
        self.fresh, self.broken = True, False

    def _more(self) -> bool:
        """Appends bytes to the buffer; false at the end."""
        while not self.broken:
            if not self.raw and not self._fill():
                return False
            if self.zipped and self.fresh:  # zeros may fill up members
                self.raw = self.raw.lstrip(b"\0")
                self.member, self.fresh = self.taken - len(self.raw), not self.raw
                if self.fresh:
                    continue
            if not self.zipped:
                new, self.raw = self.raw, b""
            else:
                try:
                    new = self.unzip.decompress(self.raw, self.size)
                except zlib.error:
                    self.broken = True
                    return False
                if self.unzip.eof:
                    self.raw, self.unzip, self.fresh = self.unzip.unused_data, zlib.decompressobj(31), True
                else:
                    self.raw = self.unzip.unconsumed_tail
            if new:
                self.held = self.held[self.at :] + new
                self.at = 0
                return True
        return False

    def _fill(self) -> bool:
        new = self.stream.read(self.size)
        self.taken += len(new)
        self.raw += new
        return bool(new)

    def resume(self) -> bool:
        """After damage: goes on at the next gzip member that starts with a record; false if there is none."""
        self.held, self.at = b"", 0
        if self.stream.seekable():  # a damaged member may have been read beyond its end
            self.stream.seek(self.member + 1)
            self.raw, self.taken = b"", self.member + 1
        else:
            self.raw = self.raw[1:]
        while True:
            at = self.raw.find(b"\x1f\x8b\x08")
            if at >= 0:
                self.raw = self.raw[at:]
                while len(self.raw) < self.size and self._fill():
                    pass
                try:
                    if zlib.decompressobj(31).decompress(self.raw, 5) == b"WARC/":
                        self.unzip, self.fresh, self.broken = zlib.decompressobj(31), True, False
                        return True
                except zlib.error:
                    pass
                self.raw = self.raw[1:]
                continue
            self.raw = self.raw[-2:]
            if not self._fill():
                return False

    def read(self, n: int) -> bytes:
        while len(self.held) - self.at < n and self._more():
            pass
        out = self.held[self.at : self.at + n]
        self.at += len(out)
        self.offset += len(out)
        return out

    def line(self, limit: int = 1 << 16) -> bytes:
        """Up to and with the next line feed, at most ``limit`` bytes."""
        seen = 0
        while (end := self.held.find(b"\n", self.at + seen, self.at + limit)) < 0 and (seen := len(self.held) - self.at) < limit and self._more():
            pass
        return self.read(end + 1 - self.at if end >= 0 else limit)


def _digest(header: str | None):
    """The running hash that a declared digest asks for, and its expected values; None for others."""
    name, _, value = (header or "").partition(":")
    if name.lower() not in ("sha1", "md5") or not value:
        return None
    return hashlib.new(name.lower()), value.strip()


def _matches(digest, expected: str) -> bool:
    return expected.lower() == digest.hexdigest() or expected.upper() == base64.b32encode(digest.digest()).decode() or expected == base64.b64encode(digest.digest()).decode()


def records(stream, file: str, chunk: int = CHUNK) -> Iterator[dict]:
    """Rows of SCHEMA from an open file."""
    reader = Reader(stream)
    first = True
    while True:
        line = reader.line()
        while line in (b"\r\n", b"\n"):
            line = reader.line()
        if reader.broken and not line.startswith(b"WARC/"):
            yield dict.fromkeys(_ARROW.names) | {"file": file, "start": reader.offset - len(line)}
            if not reader.resume():
                return
            continue
        if not line:
            return
        if not line.startswith(b"WARC/"):
            if not first:
                yield dict.fromkeys(_ARROW.names) | {"file": file, "start": reader.offset - len(line)}
            return
        first = False
        headers: dict[str, str] = {}
        while (line := reader.line(sys.maxsize)).strip():
            name, _, value = line.decode("utf-8", "replace").partition(":")
            headers[name.strip().lower()] = value.strip()
        try:
            length = max(0, int(headers.get("content-length", "0")))
        except ValueError:
            length = 0
        torn = not line  # the headers have no end
        sha1, declared = hashlib.sha1(), _digest(headers.get("warc-block-digest"))
        number = start = 0
        while True:
            data = reader.read(min(chunk, length - start))
            sha1.update(data)
            if declared:
                declared[0].update(data)
            start += len(data)
            short = torn or start < length and (len(data) < chunk)
            last = short or start >= length
            yield {
                "file": file, "record_id": headers.get("warc-record-id"), "warc_type": headers.get("warc-type"), "target_uri": headers.get("warc-target-uri"), "content_length": length,
                "chunk_no": number, "start": start - len(data), "n_bytes": len(data), "chunk": data, "sha1_so_far": sha1.hexdigest(), "last": last, "length_ok": (not short) if last else None,
                "digest_ok": _matches(*declared) if last and declared else None,
            }
            number += 1
            if last:
                break


def read_warc(files: DataFrame, column: str = "file", chunk: int = CHUNK) -> DataFrame:
    """The chunked record table of the files that ``column`` names by URI."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for batch in it:
            for uri in batch.column(0).to_pylist():
                system, path = fs.FileSystem.from_uri(uri)
                with system.open_input_file(path) as stream:
                    for row in records(stream, uri, chunk):
                        rows.append(row)
                        held += (row["n_bytes"] or 0) + 400
                        if held >= FLUSH:
                            yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)
                            rows, held = [], 0
        yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)

    return files.select(F.col(column).cast("string")).where(F.col(column).isNotNull()).mapInArrow(task(run), SCHEMA)


def _record(record_id: str | None, uri: str | None, block: bytes) -> bytes:
    lines = ["WARC/1.1", "WARC-Type: resource", "WARC-Date: 2024-01-01T00:00:00Z", "Content-Type: text/html"]
    if record_id is not None:
        lines.append(f"WARC-Record-ID: <urn:page:{record_id}>")
    if uri is not None:
        lines.append("WARC-Target-URI: " + uri.replace("\r", "%0D").replace("\n", "%0A"))
    lines += ["WARC-Block-Digest: sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode(), f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode("utf-8", "surrogatepass") + b"\r\n\r\n"


def write_warc(pages: DataFrame, record_id: str, uri: str, content: str, folder: str | None = None) -> DataFrame:
    """Writes rows as gzip WARC files of one member a record, a file a task; returns the column ``file`` of their URIs."""
    folder = folder or f"{shared_dir(pages.sparkSession).rstrip('/')}/warc-{uuid.uuid4().hex}"

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = fs.FileSystem.from_uri(folder)
        out, name = None, f"{uuid.uuid4().hex}.warc.gz"
        for batch in it:
            for key, target, block in zip(*(batch.column(i) for i in range(3))):
                if not block.is_valid:
                    continue
                if out is None:
                    system.create_dir(path, recursive=True)
                    out = system.open_output_stream(f"{path}/{name}", compression=None)
                block = block.as_buffer().to_pybytes()
                zipper = zlib.compressobj(wbits=31)
                out.write(zipper.compress(_record(key.as_py(), target.as_py(), block)))
                for at in range(0, len(block), BUFFER):
                    out.write(zipper.compress(block[at : at + BUFFER]))
                out.write(zipper.compress(b"\r\n\r\n") + zipper.flush())
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"])], names=["file"])

    return cut(pages.select(F.col(record_id).cast("string"), F.col(uri).cast("string"), F.col(content).cast("binary")).mapInArrow(task(run), "file string"))


def op9_warc(spark, sf_dir: str) -> DataFrame:
    """No table holds WARC files, so ``pages`` are written as such to the shared folder, and read back as chunks."""
    files = write_warc(spark.read.parquet(f"{sf_dir}/pages.parquet"), "page_id", "url", "html")
    return read_warc(files).drop("file").withColumn("chunk", F.md5("chunk")).withColumnRenamed("chunk", "chunk_md5")


OP9_SQL = """
with chunks as (
  select page_id, url, encode(html) as raw, octet_length(encode(html)) as n,
    unnest(range(0, greatest(1, cast(ceil(octet_length(encode(html)) / 65536.0) as bigint)))) as i
  from pages where html is not null)
select '<urn:page:' || page_id || '>' as record_id, 'resource' as warc_type, url as target_uri, n as content_length,
  cast(i as integer) as chunk_no, i * 65536 as start, cast(least(65536, n - i * 65536) as integer) as n_bytes,
  md5(raw[i * 65536 + 1:i * 65536 + 65536]) as chunk_md5, sha1(raw[1:i * 65536 + 65536]) as sha1_so_far,
  (i + 1) * 65536 >= n as last,
  case when (i + 1) * 65536 >= n then true end as length_ok, case when (i + 1) * 65536 >= n then true end as digest_ok
from chunks
"""
