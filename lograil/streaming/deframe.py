"""Structured Streaming: chunks of byte streams to frames, with each stream's unfinished bytes as state.

Chunks carry ``seq``, since a micro-batch has no order: chunks ahead of a gap wait in
the state until it closes.  State is bounded by the unfinished frame and the chunks that wait.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.codec import Catalog, Eof, Malformed, decode
from ..operators.frames import RAW, ZERO_FRAMED, decode_rows, shared

OUTPUT = "stream_id string, ordinal long, frame binary"
STATE = "next_seq long, ordinal long, rest binary, seqs array<long>, chunks array<binary>"


def split(rest: bytes, data: bytes) -> tuple[list[bytes], bytes]:
    """Whole frames, and the bytes that no zero has closed yet."""
    *frames, rest = (rest + data).split(b"\0")
    return [f for f in frames if f], rest


def _advance_by(take: Callable[[bytes, bytes], tuple[list[bytes], bytes | None]]):
    """State of a stream whose frames ``take(rest, data)`` finds; a rest of None ends the stream for good."""

    def advance(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seq, ordinal, rest, seqs, chunks = state.get if state.exists else (0, 0, b"", [], [])
        waiting = dict(zip(seqs, map(bytes, chunks)))
        rest = None if rest is None else bytes(rest)
        for batch in batches:
            for s, c in zip(batch["seq"], batch["chunk"]):
                if s >= seq and rest is not None:  # what came before is a repeat
                    waiting[int(s)] = b"" if c is None else bytes(c)
        found = []
        while seq in waiting and rest is not None:
            frames, rest = take(rest, waiting.pop(seq))
            found += frames
            seq += 1
        if rest is None:
            waiting = {}
        state.update((seq, ordinal + len(found), rest, list(waiting), list(waiting.values())))
        yield pd.DataFrame({"stream_id": [key[0]] * len(found), "ordinal": range(ordinal, ordinal + len(found)), "frame": found})

    return advance


def _frames(chunks: DataFrame, take) -> DataFrame:
    plain = chunks.select(F.col("stream_id").cast("string"), F.col("seq").cast("long"), F.col("chunk").cast("binary")).where("stream_id is not null and seq is not null")
    return plain.groupBy("stream_id").applyInPandasWithState(_advance_by(take), OUTPUT, STATE, "append", GroupStateTimeout.NoTimeout)


def deframe_stream(chunks: DataFrame) -> DataFrame:
    """Frames of a streaming table (stream_id, seq, chunk) of zero-framed streams; every stream's seq counts from 0."""
    return _frames(chunks, split)


def raw_stream(chunks: DataFrame, catalog: Catalog) -> DataFrame:
    """Frames of raw streams, whose ends only decoding finds; the first malformed frame is the stream's last."""
    table = shared(chunks.sparkSession, catalog)

    def take(rest: bytes, data: bytes) -> tuple[list[bytes], bytes | None]:
        data, at, found = rest + data, 0, []
        while at < len(data):
            try:
                n = decode(data, table.value, at).consumed
            except Eof:
                break
            except Malformed:
                return [*found, data[at:]], None
            found.append(data[at : at + n])
            at += n
        return found, data[at:]

    return _frames(chunks, take)


def decode_streaming(chunks: DataFrame, catalog: Catalog) -> DataFrame:
    """(stream_id, ordinal, decoded fields) of streaming chunks, split as the catalog's encoding says."""
    framed = catalog.encoding == ZERO_FRAMED
    if not framed and catalog.encoding != RAW:
        raise ValueError(f"unknown encoding: {catalog.encoding}")
    frames = deframe_stream(chunks) if framed else raw_stream(chunks, catalog)
    return decode_rows(frames, catalog, framed)


def reloading(version: Callable[[], object], load: Callable[[], Catalog], run: Callable[[DataFrame, Catalog], None]) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: ``run(batch, catalog)`` with a catalog that is loaded anew whenever ``version()`` changes."""
    held: dict = {}

    def batch(df: DataFrame, _: int) -> None:
        now = version()
        if held.get("version", held) != now:
            held.update(version=now, catalog=load())
        run(df, held["catalog"])

    return batch
