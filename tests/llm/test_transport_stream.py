import random

import pytest

from lograil.llm import transport_stream as ts


def frames(seed, n=40):
    rng = random.Random(seed)
    return [rng.randbytes(rng.choice([0, 1, 50, 157, 158, 165, 184, 400, 3000])) for _ in range(n)]


def video(stream):
    return [u for u in stream.units if u.pid == ts.VIDEO]


@pytest.mark.parametrize("seed", range(5))
def test_exact_round_trip(seed):
    v, a = frames(seed), frames(100 + seed)
    raw = ts.mux(v, a)
    got = ts.demux(raw)
    assert len(raw) % 188 == 0 and got.packets == len(raw) // 188 and got.skipped_bytes == 0
    assert got.programs == {0x1000: 1} and got.streams == {ts.VIDEO: (1, 0x1B), ts.AUDIO: (1, 0x0F)}
    assert [u.payload for u in video(got)] == v and [u.payload for u in got.units if u.pid == ts.AUDIO] == a
    assert [u.pts for u in video(got)] == [90_000 + 3003 * (i + 1) for i in range(len(v))] and [u.dts for u in video(got)] == [90_000 + 3003 * i for i in range(len(v))]
    assert [u.random_access for u in video(got)] == [i % 12 == 0 for i in range(len(v))]
    assert all(u.complete and not u.lost for u in got.units)


def test_unbounded_packets_and_wrapping_time():
    v = [b"x" * 70_000, b"y", b"z"]
    got = video(ts.demux(ts.mux(v, start=2**33 - 5000)))
    assert [u.payload for u in got] == v
    assert [u.pts for u in got] == [(2**33 - 5000 + 3003 * (i + 1)) % 2**33 for i in range(3)] and [u.pts_unwrapped for u in got] == [2**33 - 5000 + 3003 * (i + 1) for i in range(3)]


def test_lost_repeated_and_damaged_packets():
    v = [bytes([i]) * 1000 for i in range(6)]
    raw = ts.mux(v)
    packets = [raw[i : i + 188] for i in range(0, len(raw), 188)]
    inside = 2 + 6 * 2 + 2  # the third packet of the third unit
    lost = video(ts.demux(b"".join(packets[:inside] + packets[inside + 1 :])))
    assert [u.lost for u in lost] == [0, 0, 1, 0, 0, 0] and not lost[2].complete and [u.payload for u in lost[:2] + lost[3:]] == v[:2] + v[3:]
    twice = ts.demux(b"".join(packets[: inside + 1] + packets[inside:]))
    assert [u.payload for u in video(twice)] == v
    junk = ts.demux(b"junk" + b"".join(packets[:10]) + b"\x47noise" + b"".join(packets[10:]) + b"\x47end")
    assert [u.payload for u in video(junk)] == v and junk.skipped_bytes == 14
    flagged = bytearray(raw)
    flagged[188 * inside + 1] |= 0x80
    assert [u.lost for u in video(ts.demux(bytes(flagged)))] == [0, 0, 1, 0, 0, 0]
    cut = video(ts.demux(b"".join(packets[:-1])))
    assert [u.complete for u in cut] == [True] * 5 + [False]
    broken = bytearray(raw)
    broken[187] ^= 1
    assert ts.demux(bytes(broken)).units == []


def test_table_over_several_packets():
    body = bytes([0xE1, 0x01, 0xF0, 0]) + b"".join(bytes([0x1B, 0xE0 | (0x200 + i) >> 8, (0x200 + i) & 0xFF, 0xF0, 3, 0x0A, 1, i]) for i in range(60))
    pat = ts._packets(0, b"\0" + ts.section(0, 1, bytes([0, 7, 0xF0, 0x00])), 0)[0]
    got = ts.demux(pat + ts._packets(0x1000, b"\0" + ts.section(2, 7, body), 0)[0])
    assert got.streams == {0x200 + i: (7, 0x1B) for i in range(60)}


def test_edges(spark):
    good = ts.mux([b"one", b"two"])
    data = [(1, None), (2, b""), (3, b"\x47"), (4, b"no sync here" * 100), (None, good), (5, good), (5, good), (6, ts.mux([b"v" * 3_000_000])), (7, b"\x47" * 1000)]
    df = spark.createDataFrame(data, "id long, media binary").selectExpr("*", "1 as pid", "2 as payload")
    got = sorted(((r.id or 0), r.number, len(r.payload)) for r in ts.elementary_packets(df, "id", "media").collect())
    assert got == [(0, 0, 3), (0, 1, 3), (5, 0, 3), (5, 0, 3), (5, 1, 3), (5, 1, 3), (6, 0, 3_000_000)]
    assert ts.elementary_packets(df.where("false"), "id", "media").count() == 0


def test_query_gives_texts_back(spark, tiny):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{tiny}/documents.parquet").collect()}
    streams = spark.read.parquet(f"{tiny}/documents.parquet").select("doc_id", ts.text_streams("text").alias("m"))
    back = {}
    for r in ts.elementary_packets(streams, "doc_id", "m").where("pid = 257").orderBy("id", "number").collect():
        back[r.id] = back.get(r.id, b"") + bytes(r.payload)
    assert {k: v.decode() for k, v in back.items()} == {k: v for k, v in docs.items() if v}
