"""Byte streams to frames, and frames to decoded rows.

Zero-framed streams split anywhere at zero bytes.  Raw streams have no frame ends, so
a stream's chunks meet in one task (``applyInArrow`` by stream).  The catalog is a
dictionary of at most 65,536 entries (indices have 16 bits) and its strings; ``shared``
checks its size before it is broadcast.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import grammar, render
from ..functions.codec import LEVELS, Catalog, Eof, Malformed, decode, frame_decode
from .locate import bounded

MAX_CATALOG_CHARS = 256 << 20
FRAME = "status string, idx int, tag string, level tinyint, level_name string, timestamp string, format string, args string, message string, fragments array<string>, consumed int"
_TYPE = pa.struct([
    ("status", pa.string()), ("idx", pa.int32()), ("tag", pa.string()), ("level", pa.int8()), ("level_name", pa.string()), ("timestamp", pa.string()), ("format", pa.string()), ("args", pa.string()), ("message", pa.string()),
    ("fragments", pa.list_(pa.string())), ("consumed", pa.int32()),
])
RAW, ZERO_FRAMED = "raw", "rzcobs"
SPLIT_ROWS = 50_000
_JSON = json.JSONEncoder(separators=(", ", ": ")).encode
POLICIES = ("permissive", "dropmalformed", "failfast")


def shared(spark: SparkSession, catalog: Catalog) -> Broadcast:
    chars = sum(len(e.format) for e in catalog.entries.values())
    if len(catalog.entries) > 1 << 16 or chars > MAX_CATALOG_CHARS:
        raise ValueError(f"a catalog of {len(catalog.entries)} entries and {chars} characters is too large")
    return spark.sparkContext.broadcast(catalog)


def decode_row(data: bytes, catalog: Catalog, at: int = 0) -> dict:
    """The frame at ``at`` as a row; status: ok, eof, malformed, or unrenderable where a value has no text."""
    try:
        frame = decode(data, catalog, at)
    except Eof:
        return {"status": "eof"}
    except Malformed:
        return {"status": "malformed"}
    level = frame.entry.level
    row = {
        "status": "ok", "idx": frame.index, "tag": frame.entry.tag, "level": level, "level_name": None if level is None else LEVELS[level].upper(), "format": frame.entry.format,
        "args": _JSON([render.plain(a) for a in frame.arguments]), "consumed": frame.consumed,
    }
    try:
        row["timestamp"] = render.timestamp(frame, catalog)
        row["fragments"] = render.fragments(frame.entry.format, frame.arguments, None, catalog)
        row["message"] = "".join(row["fragments"])
    except render.Unrenderable:
        row["status"] = "unrenderable"
    return row


def _struct(rows: list[dict | None]) -> pa.StructArray:
    """Rows as columns of FRAME."""
    mask = pa.array([r is None for r in rows], pa.bool_())
    return pa.StructArray.from_arrays([pa.array([r and r.get(f.name) for r in rows], f.type) for f in _TYPE], fields=list(_TYPE), mask=mask)


def decode_frames(frames: DataFrame, catalog: Catalog, column: str = "frame", framed: bool | None = None) -> DataFrame:
    """``frames`` with a struct column ``decoded``; framed: the bytes are a zero-framed body, else a raw frame; by default what the catalog's encoding says.

    In a framed body too few bytes are malformed, and bytes after the frame are padding.
    """
    table, framed = shared(frames.sparkSession, catalog), catalog.encoding == ZERO_FRAMED if framed is None else framed

    @F.arrow_udf(FRAME)
    def run(column: pa.Array) -> pa.Array:
        return _struct([_one(raw, table.value, framed) for raw in column.to_pylist()])

    return frames.withColumn("decoded", run(F.col(column)))


def _one(raw: bytes | None, catalog: Catalog, framed: bool) -> dict | None:
    if raw is None or not framed:
        return None if raw is None else decode_row(raw, catalog)
    try:
        row = decode_row(frame_decode(raw), catalog)
    except Malformed:
        return {"status": "malformed"}
    return {"status": "malformed"} if row["status"] == "eof" else row


def decode_rows(frames: DataFrame, catalog: Catalog, framed: bool) -> DataFrame:
    """(all columns but the last, decoded fields) of rows whose last column is a frame; works behind stateful operators, whose rows Arrow functions don't take."""
    table, kept = shared(frames.sparkSession, catalog), frames.schema.fields[:-1]
    schema = T.StructType([*kept, *T._parse_datatype_string(FRAME).fields])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            rows = _struct([_one(raw, table.value, framed) for raw in batch.column(len(kept)).to_pylist()])
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(kept))), *rows.flatten()], names=schema.names)

    return frames.mapInArrow(run, schema)


def split_zero_framed(streams: DataFrame, column: str = "bytes") -> DataFrame:
    """``streams`` with a row for each frame: columns ``ordinal`` and ``frame``.  Empty pieces between zeros are none.

    Bytes after the last zero are an unfinished frame and dropped.  A null stream has no frames.
    Files larger than a row may be are split by ranges of bytes: ``sources.chunks.read_zero_framed``.
    """
    others = [c for c in streams.columns if c != column]
    plain = streams.select(*others, column)
    kinds = T.StructType([*plain.schema.fields[:-1], T.StructField("ordinal", T.IntegerType()), T.StructField("frame", T.BinaryType())])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for i, stream in enumerate(batch.column(batch.num_columns - 1)):
                raw = stream.as_py()
                pieces = [p for p in raw.split(b"\0")[:-1] if p] if raw else []
                for lo in range(0, len(pieces), SPLIT_ROWS):
                    some = pieces[lo : lo + SPLIT_ROWS]
                    rows = pa.array([i] * len(some), pa.int32())
                    yield pa.RecordBatch.from_arrays([*(batch.column(k).take(rows) for k in range(len(others))), pa.array(range(lo, lo + len(some)), pa.int32()), pa.array(some, pa.binary())], names=kinds.names)

    return plain.mapInArrow(run, kinds)


def decode_stream(chunks: DataFrame, catalog: Catalog, stream: str = "stream_id", seq: str = "seq", chunk: str = "chunk") -> DataFrame:
    """(stream, ordinal, decoded fields) of chunked byte streams, split as the catalog's encoding says."""
    if catalog.encoding == RAW:
        return decode_raw_streams(chunks, catalog, stream, seq, chunk)
    if catalog.encoding != ZERO_FRAMED:
        raise ValueError(f"unknown encoding: {catalog.encoding}")
    kind, parts = chunks.schema[stream].dataType.simpleString(), int(chunks.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by("_seq")
        frames = [f for f in b"".join(x for x in group.column("_chunk").to_pylist() if x).split(b"\0")[:-1] if f]
        return pa.table({"_stream": pa.array([group.column("_stream")[0].as_py()] * len(frames), group.schema.field("_stream").type), "ordinal": pa.array(range(len(frames)), pa.int32()), "frame": pa.array(frames, pa.binary())})

    plain = chunks.select(F.col(stream).alias("_stream"), F.col(seq).alias("_seq"), F.col(chunk).alias("_chunk")).repartition(parts, "_stream")
    pieces = plain.groupBy("_stream").applyInArrow(run, f"_stream {kind}, ordinal int, frame binary")
    return decode_frames(pieces, catalog, framed=True).select(F.col("_stream").alias(stream), "ordinal", "decoded.*")


def early_level_filter(frames: DataFrame, catalog: Catalog, keep: list[int], column: str = "frame") -> DataFrame:
    """Frames whose index is one of ``keep``, judged before decoding, from raw frames' first two bytes."""
    digits = F.hex(F.substring(column, 1, 2))
    index = F.conv(F.concat(F.substring(digits, 3, 2), F.substring(digits, 1, 2)), 16, 10).cast("int")
    return frames.where(index.isin([i for i in keep if i in catalog.entries]))


def raw_frames(data: bytes, catalog: Catalog) -> Iterator[dict]:
    """Rows of a raw stream in order; the first malformed frame ends it, an unfinished one at the end is left out."""
    at = 0
    while at < len(data):
        row = decode_row(data, catalog, at)
        if row["status"] == "eof":
            return
        yield row
        if row["status"] == "malformed":
            return
        at += row["consumed"]


def decode_raw_streams(chunks: DataFrame, catalog: Catalog, stream: str = "stream_id", seq: str = "seq", chunk: str = "chunk") -> DataFrame:
    """(stream, ordinal, decoded fields): chunks of each raw stream in order of ``seq``; one task a stream, since only decoding finds frame ends."""
    table = shared(chunks.sparkSession, catalog)
    kind = chunks.schema[stream].dataType.simpleString()

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by("_seq")
        rows = list(raw_frames(b"".join(x for x in group.column("_chunk").to_pylist() if x), table.value))
        out = _struct(rows)
        columns = {"_stream": pa.array([group.column("_stream")[0].as_py()] * len(rows), group.schema.field("_stream").type), "ordinal": pa.array(range(len(rows)), pa.int32())}
        return pa.table(columns | {f.name: out.field(i) for i, f in enumerate(_TYPE)})

    # by a number of partitions, since decoding costs far more than its bytes let the planner expect
    parts = int(chunks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    plain = chunks.select(F.col(stream).alias("_stream"), F.col(seq).alias("_seq"), F.col(chunk).alias("_chunk")).repartition(parts, "_stream")
    return plain.groupBy("_stream").applyInArrow(run, f"_stream {kind}, ordinal int, {FRAME}").withColumnRenamed("_stream", stream)


def apply_policy(decoded: DataFrame, policy: str = "permissive", status: str = "decoded.status") -> DataFrame:
    """permissive keeps malformed rows, dropmalformed drops them, failfast raises at the first."""
    if policy not in POLICIES:
        raise ValueError(f"no such policy: {policy}")
    if policy == "permissive":
        return decoded
    if policy == "dropmalformed":
        return decoded.where(F.col(status) == "ok")
    good = F.when(F.col(status) == "ok", F.lit(True)).otherwise(F.raise_error(F.lit("malformed frame")).cast("boolean"))
    return decoded.where(good)


def skipped_frames(decoded: DataFrame, status: str = "decoded.status") -> DataFrame:
    """A host record for each frame that was skipped."""
    return decoded.where(F.col(status) == "malformed").withColumn("message", F.lit("(frame skipped: malformed)")).withColumn("origin", F.lit("host"))


def lookup_formats(frames: DataFrame, table: DataFrame, idx: str = "idx") -> DataFrame:
    """Index to format as a join; an index that the table lacks makes the row malformed.

    An index has 16 bits: a table of no more rows is broadcast, a larger one joined by a shuffle.
    """
    found = next(n for n in ("_found" + "_" * i for i in range(99)) if n not in {c.lower() for c in frames.columns + table.columns})
    return frames.join(bounded(table).withColumn(found, F.lit(True)), idx, "left").withColumn("status", F.when(F.col(found), "ok").otherwise("malformed")).drop(found)


_COLORS = {"TRACE": "2", "INFO": "32", "WARN": "33", "ERROR": "31"}


def display(level_name: Column, timestamp: Column, message: Column, colored: bool = False) -> Column:
    """``[timestamp ][LEVEL ]message``; nulls and their spaces are left out."""
    if colored:
        paint = F.create_map(*(F.lit(x) for pair in _COLORS.items() for x in pair))[level_name]
        level_name = F.when(paint.isNull(), level_name).otherwise(F.concat(F.lit("\x1b["), paint, F.lit("m"), level_name, F.lit("\x1b[0m")))
    return F.concat_ws(" ", timestamp, level_name, message)


def format_fragments(table: DataFrame) -> DataFrame:
    """(idx, place, kind, text, argument, type, hint) of each fragment of a format table's formats: literals, and parameters with their types."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            rows = []
            for idx, format in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for place, f in enumerate(grammar.parse(format)):
                    text = isinstance(f, str)
                    rows.append((idx, place, "literal" if text else "parameter", f if text else None, None if text else f.index, None if text else f.type.kind, None if text or f.hint is None else f.hint.kind))
            columns = list(zip(*rows)) or [()] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.string(), pa.string(), pa.int32(), pa.string(), pa.string()))], names=["idx", "place", "kind", "text", "argument", "type", "hint"])

    return table.select("idx", "format").where("format is not null").mapInArrow(run, "idx int, place int, kind string, text string, argument int, type string, hint string")
