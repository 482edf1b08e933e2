"""Byte chunks (stream_id, seq, chunk): whole files in batch, a TCP peer as a streaming source."""

from __future__ import annotations

import re
import socket
import time
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

SCHEMA = "stream_id string, seq long, chunk binary"
PIECE = 4 << 20


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """A chunk for each file; the file's path is its stream."""
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("stream_id"), F.lit(0).cast("long").alias("seq"), F.col("content").alias("chunk"))


def read_zero_framed(spark: SparkSession, path: str, size: int = 64 << 20) -> DataFrame:
    """(stream_id, start, frame) of zero-framed files, split by ranges of about ``size`` bytes that tasks read by themselves.

    A frame belongs to the range that its first byte is in; ``start`` orders a file's frames.  Bytes after a file's last zero are dropped.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "length")  # the content is not read here
    ranges = files.withColumn("at", F.explode(F.expr(f"sequence(0L, greatest(length - 1, 0L), {size}L)"))).select("path", "at")
    parts = max(1, min(ranges.count(), 10_000))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for name, at in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                system, file = fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", name))
                with system.open_input_file(file) as source:
                    yield from _range(source, name, at, at + size)

    return ranges.repartition(parts).mapInArrow(run, "stream_id string, start long, frame binary")


def _range(source, name: str, at: int, end: int) -> Iterator[pa.RecordBatch]:
    """Frames that start in [at, end)."""
    first = max(0, at - 1)  # a zero just before the range makes its first byte a frame's first
    source.seek(first)
    held, place, inside = b"", first, at == 0
    while place < end:
        data = source.read(PIECE)
        held += data
        *frames, rest = held.split(b"\0")
        starts, found = [], []
        for frame in frames:
            if inside and frame and at <= place < end:
                starts.append(place)
                found.append(frame)
            inside, place = True, place + len(frame) + 1
        held = rest
        if found:
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(found)), pa.array(starts, pa.int64()), pa.array(found, pa.binary())], names=["stream_id", "start", "frame"])
        if not data:
            return


class TcpChunks(DataSource):
    """``spark.readStream.format('tcp_chunks').option('host', ...).option('port', ...)``; a closed connection ends the stream's data."""

    @classmethod
    def name(cls) -> str:
        return "tcp_chunks"

    def schema(self) -> str:
        return SCHEMA

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:
        return TcpReader(self.options.get("host", "localhost"), int(self.options.get("port", "19021")), float(self.options.get("wait", "0.2")))


class TcpReader(SimpleDataSourceStreamReader):
    """Reads on the driver what has arrived; Spark keeps each batch's rows until they are committed."""

    def __init__(self, host: str, port: int, wait: float):
        self.host, self.port, self.wait, self.peer, self.ended = host, port, wait, None, False

    def initialOffset(self) -> dict:
        return {"seq": 0}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        if self.peer is None and not self.ended:
            self.peer = socket.create_connection((self.host, self.port))
            self.peer.settimeout(self.wait)
        rows, seq, until = [], start["seq"], time.monotonic() + self.wait
        while self.peer is not None and time.monotonic() < until:
            try:
                data = self.peer.recv(1 << 16)
            except TimeoutError:
                break
            if not data:
                self.peer, self.ended = None, True
                break
            rows.append((f"{self.host}:{self.port}", seq, data))
            seq += 1
        return iter(rows), {"seq": seq}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        raise RuntimeError("a TCP peer cannot be read again")

    def commit(self, end: dict) -> None:
        pass
