import gzip
import hashlib
import io
import random
import tracemalloc

import pytest

from lograil.llm import warc


def record(block, name="a", extra=b"", length=None):
    n = len(block) if length is None else length
    return b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:%s>\r\nWARC-Target-URI: http://x/%s\r\n%sContent-Length: %d\r\n\r\n" % (name.encode(), name.encode(), extra, n) + block + b"\r\n\r\n"


def read(data, chunk=1000):
    return list(warc.records(io.BytesIO(data), "f", chunk))


@pytest.mark.parametrize("pack", [lambda rs: b"".join(rs), lambda rs: b"".join(map(gzip.compress, rs)), lambda rs: gzip.compress(b"".join(rs))])
def test_exact_round_trip(pack):
    rng = random.Random(1)
    blocks = [rng.randbytes(n) for n in (0, 1, 999, 1000, 1001, 2000, 50_000)] + [b"WARC/1.0\r\n\r\n" * 300]
    got = read(pack([record(b, str(i)) for i, b in enumerate(blocks)]))
    back = {}
    for r in got:
        held = back.setdefault(r["record_id"], b"")
        assert r["start"] == len(held) and r["n_bytes"] == len(r["chunk"]) <= 1000
        back[r["record_id"]] = held + r["chunk"]
        assert r["sha1_so_far"] == hashlib.sha1(back[r["record_id"]]).hexdigest()
    assert list(back.values()) == blocks
    assert [r["length_ok"] for r in got if r["last"]] == [True] * len(blocks) and all(r["digest_ok"] is None for r in got)
    assert [max(1, -(-len(b) // 1000)) for b in blocks] == [sum(r["record_id"] == k for r in got) for k in back]


def test_digests_and_damage():
    good, bad = (b"WARC-Block-Digest: md5:%s\r\n" % hashlib.md5(x).hexdigest().encode() for x in (b"body", b"other"))
    assert [r["digest_ok"] for r in read(record(b"body", extra=good) + record(b"body", extra=bad) + record(b"body", extra=b"WARC-Block-Digest: crc:1\r\n"))] == [True, False, None]
    cut = read(record(b"x" * 5000)[:-2000])
    assert [r["length_ok"] for r in cut][-1] is False and cut[-1]["last"] and sum(r["n_bytes"] for r in cut) < 5000
    assert read(b"") == [] and read(b"no warc at all") == [] and read(gzip.compress(b"")) == []
    mixed = read(record(b"one") + b"garbage\r\n" + record(b"two"))
    assert [r["record_id"] for r in mixed] == ["<urn:a>", None] and mixed[1]["start"] == len(record(b"one"))
    broken = gzip.compress(record(random.Random(0).randbytes(50_000)))
    assert read(broken[: len(broken) // 2])[-1]["length_ok"] is False
    assert read(record(b"z", length=-5))[0]["n_bytes"] == 0


def test_an_oversized_record_is_never_held():
    class Endless(io.RawIOBase):
        """A record of 200 MB made while it is read."""

        head, left = record(b"", length=200_000_000)[:-4], 200_000_000

        def read(self, n=-1):
            out, self.head = self.head[:n], self.head[n:]
            if not out:
                out = b"q" * min(n, self.left)
                self.left -= len(out)
            return out

    tracemalloc.start()
    count = sum(1 for _ in warc.records(Endless(), "f", 1 << 16))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert count == -(-200_000_000 // (1 << 16)) and peak < 8 << 20


def test_edges(spark):
    data = [(1, "http://a/", "<p>"), (1, "http://a/", "<p>"), (None, None, "x" * 200_000), (2, "http://b/\n", ""), (3, "http://c/", None)]
    df = spark.createDataFrame(data, "page_id long, url string, html string").selectExpr("*", "1 as file", "'c' as chunk")
    rows = warc.read_warc(warc.write_warc(df, "page_id", "url", "html")).collect()
    got = sorted((r.record_id or "", r.target_uri or "", r.chunk_no, r.n_bytes, r.last, bool(r.digest_ok)) for r in rows)
    assert got == sorted([("<urn:page:1>", "http://a/", 0, 3, True, True)] * 2 + [("<urn:page:2>", "http://b/%0A", 0, 0, True, True)] + [("", "", i, min(65536, 200_000 - 65536 * i), i == 3, i == 3) for i in range(4)])
    assert warc.read_warc(warc.write_warc(df.where("false"), "page_id", "url", "html")).count() == 0


def test_query_over_all_pages(spark, tiny):
    pages = {f"<urn:page:{r.page_id}>": r.html.encode() for r in spark.read.parquet(f"{tiny}/pages.parquet").collect()}
    rows = warc.op9_warc(spark, tiny).where("last").collect()
    assert {r.record_id: r.sha1_so_far for r in rows} == {k: hashlib.sha1(v).hexdigest() for k, v in pages.items()} and all(r.digest_ok for r in rows)


@pytest.mark.parametrize("seekable", [True, False])
@pytest.mark.parametrize("at", [3, 14, 25, 9000, -6])
def test_records_after_a_damaged_member(at, seekable):
    rng = random.Random(4)
    blocks = [rng.randbytes(20_000) for _ in range(5)]
    members = [gzip.compress(record(b, str(i))) for i, b in enumerate(blocks)]
    hurt = bytearray(members[2])
    hurt[at : at + 4] = b"\xff\xff\xff\xff"
    hurt[10:11] = b"\x07" if at == 14 else hurt[10:11]  # no such kind of block
    stream = io.BytesIO(b"".join([*members[:2], bytes(hurt), *members[3:]]))
    stream.seekable = lambda: seekable
    rows = list(warc.records(stream, "f", 1 << 20)) if seekable else list(warc.records(Pipe(stream.getvalue()), "f", 1 << 20))
    sound = {r["record_id"]: r["chunk"] for r in rows if r["length_ok"]}
    assert all(sound[f"<urn:{i}>"] == blocks[i] for i in (0, 1, 3, 4))
    assert sum(r["record_id"] is None and r["chunk"] is None for r in rows) == 1


class Pipe(io.BytesIO):
    def seekable(self):
        return False


def test_long_header_lines_are_whole():
    uri = "http://x/" + "y" * 300_000
    data = record(b"body").replace(b"http://x/a", uri.encode())
    for packed in (data, gzip.compress(data)):
        assert [(r["target_uri"], r["chunk"]) for r in read(packed)] == [(uri, b"body")]
