"""Operators on Spark: queries against their SQL, filters, templates, catalogs, sinks and streaming."""

import json
import os
import subprocess
import sys
import time

import duckdb
import pytest
from pyspark.sql import functions as F

from lograil import sinks
from lograil.functions import hints
from lograil.operators import filters, frames, locate, template
from lograil.plans.logview import CATALOG
from lograil.plans.queries import ORACLE_SQL, QUERIES
from lograil.sources import catalog, chunks
from lograil.streaming.deframe import decode_streaming, deframe_stream, reloading

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="module")
def duck(tiny):
    con = duckdb.connect()
    con.sql("set timezone = 'UTC'")
    for t in ("events", "part"):
        con.sql(f"create view {t} as from '{tiny}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, tiny, duck, name):
    df = QUERIES[name](spark, tiny)
    columns = sorted(df.columns)
    want = duck.sql(ORACLE_SQL[name])
    assert sorted(want.columns) == columns
    got = sorted(tuple(map(str, r)) for r in df.select(*columns).collect())
    assert got == sorted(tuple(map(str, r)) for r in duck.sql(f"select {', '.join(columns)} from ({ORACLE_SQL[name]})").fetchall()) and got


def test_directives():
    d = filters.parse_directives
    assert d("", "app") == {"app": 4} and d("info", "app") == {"app": 2} and d("other=info", "app") == {"app": 4} and d("warn,info", "app") == {"app": 2}
    assert d("app::a=info,app::a=off,,app::b", "app") == {"app::a": None, "app::b": 0, "app": 4}
    assert filters.modules_on_for("app::a=info,off", "app", "warn") == ["app::a"] and filters.modules_off_for("app::a=info,off", "app", "warn") == ["app"]
    for bad in ("app=loud", "1app", "app::", "=info", "app::a b"):
        with pytest.raises(filters.DirectiveError):
            d(bad, "app")


def test_filter_edges(spark):
    rows = spark.createDataFrame([(1, "app", 0), (2, "app::x", 2), (3, "appx", 4), (4, "app::x", None), (5, None, 4), (6, "app::xy", 4)], "id int, module string, level int")
    keep = lambda text: [r.id for r in rows.where(filters.directive_filter(text, "app", F.col("module"), F.col("level"))).orderBy("id").collect()]
    assert keep("app::x=info,off") == [2, 4] and keep("trace") == [1, 2, 4, 6] and keep("app=error,off") == [4, 6]
    assert rows.where(filters.device_only(F.lit("host"))).count() == 0 and rows.where(filters.device_only(F.lit("host"), verbose=True)).count() == 6


@pytest.mark.parametrize("bad", ["", "{t}", "{s", "{s}}", "{x} {s}", "{s:bold:bold}", "{s:red:blue}", "{s:1:2}", "{s:loud}", "{foo%bold} {s}"])
def test_bad_templates(bad):
    with pytest.raises(template.TemplateError):
        template.parse(bad)


def test_templates(spark):
    rows = spark.createDataFrame([(4, "boom", "", None, None, None), (2, "a longer message", "7", "/a/b/c.rs", 9, "k::m::f"), (None, "printed", None, None, None, None)], "level int, message string, timestamp string, file string, line long, module string")
    show = lambda text, **k: [r[0] for r in rows.select(template.render(text, {c: F.col(c) for c in rows.columns}, **k)).collect()]
    assert show("{t}|{L}|{s:4}|{F}|{ff}|{l}|{m}|{c}") == ["<time>|ERROR|boom|<file>|<file>|0   |<mod path>|<crate>", "7|INFO |a longer message|/a/b/c.rs|b/c.rs|9   |k::m::f|k", "printed"]
    assert show("{s:>6}{s:^7}{s:06}")[0] == "  boom boom  boom00"
    assert show("{ffffff} {s}")[1].startswith("//a/b/c.rs ") or show("{ffffff} {s}")[1].startswith("/a/b/c.rs ")
    assert show("{[{L}]%bold} {s}", color=True)[0] == "\x1b[1m[\x1b[31mERROR\x1b[0m]\x1b[0m boom"
    assert show("{L:blue:7}{s}", color=True)[0] == "\x1b[34mERROR\x1b[0m  boom"  # escapes don't count as width
    assert template.warnings("{t} {s}", False) and template.warnings("{s}", True) and not template.warnings("{s}", False)
    assert template.preset("default", False, False, host=True) == "{L} {s} (HOST)"


def test_columns_agree_with_the_renderer(spark):
    from lograil.functions.render import text

    xs = [0, 1, 42, 255, 256, 65_535, 1_618_910_624_804, 2**53 + 1, 2**62]
    df = spark.createDataFrame([(x,) for x in xs], "x long")
    x = F.col("x")
    for hint, column in {"": hints.decimal(x), "012": hints.decimal(x, 12), "#06x": hints.hexadecimal(x, 6, True), "X": hints.hexadecimal(x, upper=True), "#b": hints.binary(x, alternate=True), "o": hints.octal(x), "us": hints.seconds(x, 6), "tms": hints.clock(x, 3), "ts": hints.clock(x, 0)}.items():
        assert [r[0] for r in df.select(column).collect()] == [text(f"{{=u64:{hint}}}" if hint else "{=u64}", (("u", v),), None, CATALOG) for v in xs]
    for size in (1, 2, 4, 8):
        values = [v for v in (0, 1, 127, 128, 255, 2**31, 2**63 - 1) if v < 1 << 8 * size]
        back = spark.createDataFrame([(v,) for v in values], "x long").select(hints.from_little_endian(hints.little_endian(x, size), 0, size), hints.from_little_endian(hints.little_endian(x, size), 0, size, True))
        assert [(int(a), b) for a, b in back.collect()] == [(v, v - (1 << 8 * size) * (v >= 1 << 8 * size - 1)) for v in values]


def test_policies_and_null_frames(spark):
    df = frames.decode_frames(spark.createDataFrame([(1, bytearray(b"\x01\x00")), (2, None), (3, bytearray(b"")), (4, bytearray(b"\x05\x7f"))], "id int, frame binary"), CATALOG)
    assert {r.id: r.decoded and r.decoded.status for r in df.collect()} == {1: "malformed", 2: None, 3: "malformed", 4: "malformed"}
    assert frames.apply_policy(df, "dropmalformed").count() == 0 and frames.skipped_frames(df).count() == 3
    with pytest.raises(Exception, match="malformed frame"):
        frames.apply_policy(df, "failfast").collect()
    assert frames.decode_frames(df.select("frame").where("false"), CATALOG).collect() == []


def test_splitting(spark):
    df = spark.createDataFrame([(1, bytearray(b"\0\0ab\0\0\xa0\x0b\0rest")), (2, bytearray(b"")), (3, None)], "s int, bytes binary")
    got = [(r.s, r.ordinal, bytes(r.frame)) for r in frames.split_zero_framed(df).collect()]
    assert got == [(1, 0, b"ab"), (1, 1, b"\xa0\x0b")]


def test_catalog(spark):
    names = ['"log_version_ = 4"', '"log_encoding_ = raw"']
    assert catalog.settings(names, "log_") == ("4", "raw") and catalog.settings([], "log_", has_section=False) is None
    for bad, section in ((["log_version_ = 9", "log_encoding_ = raw"], True), ([*names, "log_version_ = 3"], True), (["log_encoding_ = raw"], True), (names, False)):
        with pytest.raises(catalog.CatalogError):
            catalog.settings(bad, "log_", section)
    assert catalog.settings(["log_version_ = 9", "log_encoding_ = raw"], "log_", check=False) == ("9", "raw")
    sym = lambda tag, data, **k: json.dumps({"package": "p", "tag": tag, "data": data, "disambiguator": "1"} | k)
    value = lambda n: bytearray(n.to_bytes(16, "little"))
    rows = [(sym("log_info", "x={=u8}"), 1, None), (sym("log_str", "hello"), 2, None), ("", 3, None), ("$d.1", 4, None), (sym("mine", "z"), 5, None), (sym("log_timestamp", "{=u32:us}"), 6, None), (sym("log_bitflags_value", "F::1::B"), 7, value(2)), (sym("log_bitflags_value", "F::0::A"), 8, value(1 << 100))]
    symbols = spark.createDataFrame(rows, "name string, address long, data binary")
    loaded = catalog.load(catalog.format_table(symbols, "log_"), catalog.bitflags_table(symbols, "log_"))
    assert {i: (e.tag, e.format, e.level) for i, e in loaded.entries.items()} == {1: ("info", "x={=u8}", 2), 2: ("str", "hello", None)} and loaded.timestamp == "{=u32:us}"
    assert loaded.bitflags == {("F", "p", "1"): [("A", 1 << 100), ("B", 2)]} and loaded.indices() == [1]
    again = catalog.load(catalog.to_table(spark, loaded), encoding="raw")
    assert again.entries == loaded.entries and again.timestamp == loaded.timestamp
    with pytest.raises(Exception, match="16 bytes"):
        catalog.bitflags_table(symbols.withColumn("data", F.lit(b"x")), "log_").collect()


def test_locations(spark):
    table = spark.createDataFrame([(1, "a.rs", 1, "k::f"), (1, "b.rs", 2, "k::f")], "idx int, file string, line long, module string")
    with pytest.raises(Exception, match="repeated location"):
        locate.unique_locations(table).collect()
    assert locate.unique_locations(table.where("line = 1")).count() == 1
    assert [r[0] for r in spark.createDataFrame([("f",), ("k::f",), (None,)], "m string").select(locate.module_path(F.col("m")).function).collect()] == [None, "f", None]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", None, "1.5", "f.rs", 3, "k::m::f", 7), ("b", "INFO", None, None, None, "f", 8)], "d string, l string, t string, f string, n long, m string, h long")
    out = df.select(sinks.json_frame(*(F.col(c) for c in ("d", "l", "t", "f", "n", "m", "h"))).alias("json"))
    assert out.first()[0] == '{"data":"a","host_timestamp":7,"level":null,"location":{"file":"f.rs","line":3,"module_path":{"crate_name":"k","modules":["m"],"function":"f"}},"target_timestamp":"1.5"}'
    sinks.write_json(out, str(tmp_path / "j"))
    assert {(r.data, r.level, r.location.line) for r in sinks.read_json(spark, str(tmp_path / "j")).collect()} == {("a", None, 3), ("b", "INFO", None)}
    sinks.write_text(df, str(tmp_path / "t"), "d", "m")
    assert spark.read.text(str(tmp_path / "t")).count() == 2


def test_streaming_keeps_rests_and_waits_for_gaps(spark, tmp_path):
    source, batches = tmp_path / "in", [[("s", 0, b"\x01\x02"), ("t", 0, b"\x09\x00")], [("s", 2, b"\x05\x00\x06")], [("s", 1, b"\x03\x00\x04"), ("s", 0, b"\x01\x02")], [("s", 3, b"\x00\x00\x07")]]
    got = []
    for i, rows in enumerate(batches):  # each run continues from the checkpoint
        spark.createDataFrame([(a, b, bytearray(c)) for a, b, c in rows], chunks.SCHEMA).coalesce(1).write.mode("append").parquet(str(source))
        stream = deframe_stream(spark.readStream.schema(chunks.SCHEMA).parquet(str(source)))
        query = stream.writeStream.foreachBatch(lambda df, _: got.extend((r.stream_id, r.ordinal, bytes(r.frame)) for r in df.collect())).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        query.awaitTermination(120)
        if i == 1:
            assert got == [("t", 0, b"\x09")]
    assert sorted(got) == [("s", 0, b"\x01\x02\x03"), ("s", 1, b"\x04\x05"), ("s", 2, b"\x06"), ("t", 0, b"\x09")]


def test_files_and_sockets(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(b"\x01\x00")
    row = chunks.read_files(spark, str(tmp_path)).first()
    assert row.stream_id.endswith("a.bin") and bytes(row.chunk) == b"\x01\x00"
    import socket
    import threading

    server = socket.create_server(("127.0.0.1", 0))

    def serve():
        peer, _ = server.accept()
        peer.sendall(b"abc\0")
        peer.close()

    threading.Thread(target=serve, daemon=True).start()
    reader = chunks.TcpReader("127.0.0.1", server.getsockname()[1], 1.0)
    rows, end = reader.read(reader.initialOffset())
    assert b"".join(r[2] for r in rows) == b"abc\0" and reader.read(end)[1] == end


def test_entry_without_the_llm_folder(tmp_path):
    for name in ("lograil", "__spark_entry__.py"):
        subprocess.run(["cp", "-r", f"{ROOT}/{name}", str(tmp_path)], check=True)
    subprocess.run(["rm", "-rf", str(tmp_path / "lograil/llm")], check=True)
    code = "import __spark_entry__ as e; assert e.queries() and set(e.oracle_sql()) <= set(e.queries()) and not any(n.startswith('op') for n in e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True)


def test_more_bit_flags_than_are_taken_in_raise(spark):
    table = spark.createDataFrame([(1, "info", 2, "x", None)], catalog.FORMAT_TABLE)
    flags = spark.range((1 << 16) + 1).selectExpr("cast(id as string) ident", "'p' package", "'1' disambig", "cast(null as string) crate_name", "array(named_struct('pos', 0, 'name', 'A', 'value', X'01')) flags")
    with pytest.raises(catalog.CatalogError):
        catalog.load(table, flags)
    assert len(catalog.load(table, flags.where("ident <> '0'")).bitflags) == 1 << 16


def test_files_split_by_ranges_of_bytes(spark, tmp_path):
    frame = [bytes([1 + i % 250]) * (1 + i % 37) for i in range(500)]
    (tmp_path / "a").write_bytes(b"\0" + b"\0".join(frame) + b"\0\0unfinished")
    (tmp_path / "b").write_bytes(b"x\0")
    (tmp_path / "c").write_bytes(b"")
    whole = chunks.read_zero_framed(spark, str(tmp_path)).collect()
    for size in (1, 7, 100, 5000):
        got = chunks.read_zero_framed(spark, str(tmp_path), size).collect()
        assert sorted(map(tuple, got)) == sorted(map(tuple, whole))
    assert [bytes(r.frame) for r in sorted(whole, key=lambda r: r.start) if r.stream_id.endswith("a")] == frame and len(whole) == 501


def _run_stream(spark, source, catalog_, checkpoint, out, view):
    query = decode_streaming(source, catalog_).writeStream.format("parquet").option("checkpointLocation", checkpoint).option("path", out).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(out)


@pytest.mark.parametrize("encoding", ["raw", "rzcobs"])
def test_streaming_decode_goes_on_after_a_restart(spark, tmp_path, encoding):
    from lograil.functions.codec import Catalog, Entry, encode, stream_encode

    table = Catalog({1: Entry("info", "n={=u32}", 2)}, encoding=encoding)
    sent = [encode(1, table, [i]) for i in range(40)]
    data = b"".join(sent) if encoding == "raw" else stream_encode(sent)
    pieces = [data[i : i + 13] for i in range(0, len(data), 13)]
    source, half = str(tmp_path / "in"), len(pieces) // 2
    rows = [("s", i, bytearray(p)) for i, p in enumerate(pieces)]
    rows[1], rows[half] = rows[half], rows[1]  # a chunk comes before its turn
    schema = "stream_id string, seq long, chunk binary"
    for part in (rows[:half], rows[half:]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        got = _run_stream(spark, stream, table, str(tmp_path / "check"), str(tmp_path / "out"), encoding)
    assert [r.message for r in got.orderBy("ordinal").collect()] == [f"n={i}" for i in range(40)]


def test_a_bad_raw_frame_ends_its_stream(spark, tmp_path):
    from lograil.functions.codec import Catalog, Entry, encode

    table = Catalog({1: Entry("info", "n={=u8}", 2)}, encoding="raw")
    data = encode(1, table, [5]) + b"\x63\x00" + encode(1, table, [6])
    source = str(tmp_path / "in")
    spark.createDataFrame([("s", 0, bytearray(data)), ("s", 1, bytearray(encode(1, table, [7])))], "stream_id string, seq long, chunk binary").write.parquet(source)
    stream = spark.readStream.schema("stream_id string, seq long, chunk binary").parquet(source)
    got = _run_stream(spark, stream, table, str(tmp_path / "check"), str(tmp_path / "out"), "bad")
    assert [(r.ordinal, r.status, r.message) for r in got.orderBy("ordinal").collect()] == [(0, "ok", "n=5"), (1, "malformed", None)]
    with pytest.raises(ValueError):
        decode_streaming(stream, Catalog({}, encoding="morse"))


def test_tcp_chunks_as_a_stream(spark, tmp_path):
    import socket
    import threading

    from lograil.functions.codec import Catalog, Entry, encode, stream_encode

    table = Catalog({1: Entry("info", "n={=u8}", 2)})
    server = socket.create_server(("127.0.0.1", 0))

    def serve():
        peer, _ = server.accept()
        peer.sendall(stream_encode([encode(1, table, [i]) for i in range(20)]))
        peer.close()

    threading.Thread(target=serve, daemon=True).start()
    spark.dataSource.register(chunks.TcpChunks)
    stream = spark.readStream.format("tcp_chunks").option("host", "127.0.0.1").option("port", str(server.getsockname()[1])).option("wait", "1").load()
    query = decode_streaming(stream, table).writeStream.format("memory").queryName("tcp_frames").option("checkpointLocation", str(tmp_path / "check")).start()
    until = time.monotonic() + 90
    while time.monotonic() < until and (not query.isActive or spark.table("tcp_frames").count() < 20):
        time.sleep(0.5)
    query.stop()
    assert [r.message for r in spark.table("tcp_frames").orderBy("ordinal").collect()] == [f"n={i}" for i in range(20)]


def test_catalogs_are_loaded_anew_when_their_version_changes():
    versions, loaded, seen = iter([1, 1, 2]), [], []
    run = reloading(lambda: next(versions), lambda: loaded.append(0) or len(loaded), lambda df, c: seen.append((df, c)))
    for i in range(3):
        run(i, i)
    assert seen == [(0, 1), (1, 1), (2, 2)]
