"""Operator 8, media columns: MPEG transport streams (ISO/IEC 13818-1).

``demux`` takes a column of stream bytes, finds the 188 byte packets, parses the
program association and program map tables (sections over several packets, CRC
checked), checks continuity counters, drops duplicate packets, reassembles
the packetised elementary stream of every mapped PID, and returns a row for each
elementary packet: its timestamps (33 bit values and unwrapped over the stream),
whether it starts at a random-access point, and its payload.  Packet headers are
parsed as arrays, whole streams at a time; the loop is over elementary packets.

Defined results.  Null and empty streams, and streams without a sync byte that
repeats, give no rows.  Bytes that break the packet grid are skipped up to the next
place where sync bytes repeat.  Packets flagged as erroneous count as lost.  A PID
that no table maps gives no rows.  Tables with a bad CRC are ignored.  An
elementary packet cut short by the stream's end is returned with what there is and
``complete`` false; one with lost packets inside has ``lost`` above 0.  Rows are
judged one by one: repeated rows repeat their packets, null ids stay null, other
columns are ignored.  An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .memory import task

PACKET, SYNC, WRAP = 188, 0x47, 1 << 33
VIDEO, AUDIO = 0x101, 0x102


def _crc_table() -> list[int]:
    out = []
    for i in range(256):
        c = i << 24
        for _ in range(8):
            c = (c << 1) ^ 0x04C11DB7 if c & 0x80000000 else c << 1
        out.append(c & 0xFFFFFFFF)
    return out


_CRC = _crc_table()


def crc32_mpeg(data: bytes) -> int:
    c = 0xFFFFFFFF
    for b in data:
        c = ((c << 8) & 0xFFFFFFFF) ^ _CRC[(c >> 24) ^ b]
    return c


@dataclass
class Unit:
    """One elementary packet."""

    pid: int
    program: int
    stream_type: int
    number: int
    stream_id: int
    pts: int | None
    dts: int | None
    random_access: bool
    lost: int
    complete: bool
    payload: bytes
    pts_unwrapped: int | None = None


@dataclass
class Stream:
    packets: int = 0
    skipped_bytes: int = 0
    programs: dict[int, int] = field(default_factory=dict)
    streams: dict[int, tuple[int, int]] = field(default_factory=dict)
    units: list[Unit] = field(default_factory=list)


def packet_starts(data: np.ndarray) -> np.ndarray:
    """Offsets of the packets: the grid from the first sync byte, taken up anew where it breaks.

    A place is taken up when the two next packets, as far as the data go, start with
    sync bytes too.  If such a place lies inside the packet before a break, that
    packet was none.
    """
    n, at, found = len(data), 0, []
    sync = np.flatnonzero(data == SYNC)
    sync = sync[sync + PACKET <= n]

    def confirmed(places: np.ndarray) -> np.ndarray:
        ok = np.ones(len(places), bool)
        for k in (1, 2):
            ok &= (places + k * PACKET >= n) | (data[np.minimum(places + k * PACKET, n - 1)] == SYNC)
        return places[ok]

    while at + PACKET <= n:
        if data[at] != SYNC:
            later = confirmed(sync[np.searchsorted(sync, at) :])
            if not len(later):
                break
            at = int(later[0])
        grid = at + PACKET * np.arange((n - at) // PACKET)
        broken = np.flatnonzero(data[grid] != SYNC)
        if not len(broken):
            found.append(grid)
            break
        good = grid[: broken[0]]
        last = int(good[-1])
        inside = confirmed(sync[np.searchsorted(sync, last + 1) : np.searchsorted(sync, last + PACKET)])
        if len(inside):
            found.append(good[:-1])
            at = int(inside[0])
        else:
            found.append(good)
            at = last + PACKET
    return np.concatenate(found) if found else np.zeros(0, np.int64)


def _sections(payloads: list[tuple[bool, bytes]]) -> Iterator[bytes]:
    """Whole PSI sections with a valid CRC from one PID's payloads."""
    held = b""
    for start, data in payloads:
        if start:
            if not data or data[0] + 1 > len(data):
                held = b""
                continue
            held += data[1 : 1 + data[0]]
            yield from _whole(held)
            held = data[1 + data[0] :]
        elif held:
            held += data
        while len(held) >= 3 and held[0] != 0xFF and len(held) >= (size := 3 + ((held[1] & 0x0F) << 8 | held[2])):
            yield from _whole(held[:size])
            held = held[size:]
        if held[:1] == b"\xff":
            held = b""


def _whole(section: bytes) -> Iterator[bytes]:
    if len(section) >= 12 and len(section) == 3 + ((section[1] & 0x0F) << 8 | section[2]) and crc32_mpeg(section) == 0:
        yield section


def _time(b: bytes) -> int:
    return (b[0] >> 1 & 7) << 30 | b[1] << 22 | (b[2] >> 1) << 15 | b[3] << 7 | b[4] >> 1


def demux(stream: bytes | None) -> Stream:
    """The programs and elementary packets of a transport stream."""
    out = Stream()
    if not stream:
        return out
    data = np.frombuffer(stream, dtype=np.uint8)
    starts = packet_starts(data)
    out.packets, out.skipped_bytes = len(starts), len(data) - PACKET * len(starts)
    if not len(starts):
        return out
    b1, b3 = data[starts + 1], data[starts + 3]
    pids = (b1.astype(np.int32) & 0x1F) << 8 | data[starts + 2]
    error, begins = b1 & 0x80 > 0, b1 & 0x40 > 0
    control, counter = b3 >> 4 & 3, b3 & 15
    adapted = control & 2 > 0
    length = np.where(adapted, data[starts + 4].astype(np.int64) + 1, 0)
    flags = np.where(adapted & (length > 1), data[np.minimum(starts + 5, len(data) - 1)], 0)
    has = (control & 1 > 0) & ~error & (length < PACKET - 4)

    def payload(i: int) -> bytes:
        return stream[starts[i] + 4 + length[i] : starts[i] + PACKET]

    def of(pid: int) -> list[tuple[bool, bytes]]:
        return [(bool(begins[i]), payload(i)) for i in np.flatnonzero((pids == pid) & has)]

    for section in _sections(of(0)):
        if section[0] == 0:
            for k in range(8, len(section) - 4, 4):
                number = section[k] << 8 | section[k + 1]
                if number:
                    out.programs[(section[k + 2] & 0x1F) << 8 | section[k + 3]] = number
    for pid, program in out.programs.items():
        for section in _sections(of(pid)):
            if section[0] != 2:
                continue
            k = 12 + ((section[10] & 0x0F) << 8 | section[11])
            while k + 5 <= len(section) - 4:
                out.streams.setdefault((section[k + 1] & 0x1F) << 8 | section[k + 2], (program, section[k]))
                k += 5 + ((section[k + 3] & 0x0F) << 8 | section[k + 4])
    for pid, (program, kind) in sorted(out.streams.items()):
        out.units += _units(pid, program, kind, np.flatnonzero((pids == pid) & has), begins, counter, flags, payload)
    return out


def _units(pid, program, kind, index, begins, counter, flags, payload) -> list[Unit]:
    if not len(index):
        return []
    c = counter[index].astype(np.int64)
    gap = (np.diff(c, prepend=c[0] - 1) - 1) % 16
    gap[flags[index] & 0x80 > 0] = 0  # announced discontinuity
    gap[0] = 0
    same = np.flatnonzero(gap == 15)
    twice = [k for k in same if payload(index[k]) == payload(index[k - 1])]
    gap[twice] = 0
    once = np.ones(len(index), bool)
    once[twice] = False
    index, gap = index[once], gap[once]
    first = np.flatnonzero(begins[index])
    units: list[Unit] = []
    high, last = 0, None
    for number, (a, b) in enumerate(zip(first, [*first[1:], len(index)])):
        body = b"".join(payload(i) for i in index[a:b])
        if len(body) < 6 or body[:3] != b"\0\0\1":
            continue
        size = body[4] << 8 | body[5]
        pts = dts = None
        at = 6
        if body[3] not in (0xBC, 0xBE, 0xBF, 0xF0, 0xF1, 0xFF, 0xF2, 0xF8) and len(body) >= 9:
            at = 9 + body[8]
            if body[7] & 0x80 and len(body) >= 14:
                pts = _time(body[9:14])
            dts = _time(body[14:19]) if body[7] & 0xC0 == 0xC0 and len(body) >= 19 else pts
        whole = len(body) >= 6 + size if size else True
        data = body[at : 6 + size] if size else body[at:]
        unwrapped = None
        if pts is not None:
            if last is not None and pts - last < -(WRAP // 2):
                high += WRAP
            elif last is not None and pts - last > WRAP // 2:
                high -= WRAP
            last, unwrapped = pts, pts + high
        # a gap before the first packet of a unit fell into the unit before
        lost = int(gap[a + 1 : b].sum())
        if b < len(index):
            lost += int(gap[b])
        units.append(Unit(pid, program, kind, number, body[3], pts, dts, bool(flags[index[a]] & 0x40), lost, whole and not lost, data, unwrapped))
    return units


_ROW = [
    ("pid", pa.int32()), ("program", pa.int32()), ("stream_type", pa.int32()), ("number", pa.int32()), ("stream_id", pa.int32()), ("pts", pa.int64()), ("dts", pa.int64()),
    ("random_access", pa.bool_()), ("lost", pa.int32()), ("complete", pa.bool_()), ("payload", pa.binary()), ("pts_unwrapped", pa.int64()),
]
SCHEMA = "id long, pid int, program int, stream_type int, number int, stream_id int, pts long, dts long, random_access boolean, lost int, complete boolean, payload binary, pts_unwrapped long"


def elementary_packets(streams: DataFrame, id_column: str, media: str) -> DataFrame:
    """A row for each elementary packet of each stream of the column ``media``."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["id", *(n for n, _ in _ROW)]
        for batch in it:
            ids, rows, held = [], [], 0
            for i in range(batch.num_rows):
                units = demux(batch.column(1)[i].as_py()).units
                ids += [batch.column(0)[i].as_py()] * len(units)
                rows += units
                held += sum(len(u.payload) for u in units)
                if held > 8 << 20 or i + 1 == batch.num_rows:
                    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *(pa.array([getattr(u, n) for u in rows], t) for n, t in _ROW)], names=names)
                    ids, rows, held = [], [], 0

    return streams.select(F.col(id_column).cast("long"), F.col(media).cast("binary")).mapInArrow(task(run), SCHEMA)


# A multiplexer, for streams to test on.


def _packets(pid: int, body: bytes, counter: int, random_access: bool = False) -> tuple[bytes, int]:
    """``body`` as packets of ``pid`` from continuity counter ``counter``; the last one is stuffed, the first one may be flagged."""
    out, first, at = bytearray(), True, 0
    while at < len(body) or first:
        flagged = random_access and first
        room = 184 - (2 if flagged else 0)
        piece = body[at : at + room]
        at += len(piece)
        stuffing = room - len(piece)
        out += bytes([SYNC, (0x40 if first else 0) | pid >> 8, pid & 0xFF, (0x30 if flagged or stuffing else 0x10) | counter])
        if flagged:
            out += bytes([1 + stuffing, 0x40]) + b"\xff" * stuffing
        elif stuffing:
            out += bytes([stuffing - 1]) + (b"\0" + b"\xff" * (stuffing - 2) if stuffing > 1 else b"")
        out += piece
        counter, first = (counter + 1) % 16, False
    return bytes(out), counter


def _stamp(mark: int, t: int) -> bytes:
    t %= WRAP
    return bytes([mark << 4 | t >> 29 & 0x0E | 1, t >> 22 & 0xFF, t >> 14 & 0xFE | 1, t >> 7 & 0xFF, t << 1 & 0xFE | 1])


def pes(stream_id: int, data: bytes, pts: int, dts: int | None = None) -> bytes:
    stamps = _stamp(2, pts) if dts is None else _stamp(3, pts) + _stamp(1, dts)
    body = bytes([0x80, 0x80 if dts is None else 0xC0, len(stamps)]) + stamps + data
    size = len(body) if len(body) < 1 << 16 else 0
    return b"\0\0\1" + bytes([stream_id, size >> 8, size & 0xFF]) + body


def section(table: int, extension: int, body: bytes) -> bytes:
    size = len(body) + 9
    head = bytes([table, 0xB0 | size >> 8, size & 0xFF, extension >> 8, extension & 0xFF, 0xC1, 0, 0])
    return head + body + crc32_mpeg(head + body).to_bytes(4, "big")


def tables(program: int = 1) -> bytes:
    pat = section(0, 1, bytes([program >> 8, program & 0xFF, 0xF0, 0x00]))
    pmt = section(2, program, bytes([0xE0 | VIDEO >> 8, VIDEO & 0xFF, 0xF0, 0, 0x1B, 0xE0 | VIDEO >> 8, VIDEO & 0xFF, 0xF0, 0, 0x0F, 0xE0 | AUDIO >> 8, AUDIO & 0xFF, 0xF0, 0]))
    return _packets(0, b"\0" + pat, 0)[0] + _packets(0x1000, b"\0" + pmt, 0)[0]


def mux(video: list[bytes], audio: list[bytes] = (), start: int = 90_000, tick: int = 3003, every: int = 12) -> bytes:
    """A stream of one program: a video packet a tick, of which each ``every``-th is a random-access point, and audio packets between them."""
    out, v, a = bytearray(tables()), 0, 0
    for i, frame in enumerate(video):
        packets, v = _packets(VIDEO, pes(0xE0, frame, start + tick * i + tick, start + tick * i), v, i % every == 0)
        out += packets
        if i < len(audio):
            packets, a = _packets(AUDIO, pes(0xC0, audio[i], start + tick * i), a)
            out += packets
    return bytes(out)


FRAME = 2048


@F.arrow_udf(T.BinaryType())
def text_streams(texts: pa.Array) -> pa.Array:
    """Each text as a stream: its UTF-8 bytes in video packets of FRAME bytes, and the last 16 bytes of each frame as audio."""
    out = []
    for text in texts.to_pylist():
        raw = (text or "").encode("utf-8", "surrogatepass")
        frames = [raw[i : i + FRAME] for i in range(0, len(raw), FRAME)]
        out.append(None if text is None else mux(frames, [f[-16:] for f in frames]))
    return pa.array(out, pa.binary())


def op8_transport_stream(spark, sf_dir: str) -> DataFrame:
    """No table holds media, so each document's text is multiplexed into a stream, and all streams are taken apart again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", text_streams("text").alias("media"))
    found = elementary_packets(docs, "doc_id", "media").withColumnRenamed("id", "doc_id")
    return found.withColumn("payload", F.md5("payload")).withColumnRenamed("payload", "payload_md5").withColumn("n_lost", F.col("lost").cast("int")).drop("lost")


OP8_SQL = """
with frames as (
  select doc_id, encode(text) as raw, unnest(range(0, cast(ceil(octet_length(encode(text)) / 2048.0) as bigint))) as i
  from documents),
data as (
  select doc_id, i, raw[i * 2048 + 1:i * 2048 + 2048] as video from frames)
select doc_id, 257 as pid, 1 as program, 27 as stream_type, cast(i as integer) as number, 224 as stream_id,
  90000 + 3003 * i + 3003 as pts, 90000 + 3003 * i as dts, i % 12 = 0 as random_access, true as complete,
  md5(video) as payload_md5, 90000 + 3003 * i + 3003 as pts_unwrapped, 0 as n_lost
from data
union all
select doc_id, 258, 1, 15, cast(i as integer), 192, 90000 + 3003 * i, 90000 + 3003 * i, false, true,
  md5(video[greatest(1, octet_length(video) - 15):octet_length(video)]), 90000 + 3003 * i, 0
from data
"""
