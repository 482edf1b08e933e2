"""Queries of single features: a catalog made for the feature, frames encoded from ``events``, decoded and rendered, with the SQL of the text.

``message(name, format, pieces, sql)`` sends one statement an event; other queries
are over symbol rows, directive lists and templates, which no table holds.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import grammar, producer
from ..functions.codec import Catalog, Entry
from ..functions.hints import little_endian
from ..operators import filters, frames, locate, template
from ..sources import catalog as catalogs
from .logview import CATALOG, LEVELS, TYPES, VIEW_SQL, logs, raw_frames

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
PREFIX = "log_"


def _id(size: int = 4) -> Column:
    return little_endian(F.col("event_id"), size)


def _len(raw: Column) -> Column:
    return F.concat(little_endian(F.octet_length(raw), 4), raw)


def _bin(text: str) -> Column:
    return F.unhex(F.lit(text.encode("utf-8").hex()))


def _le(value: int, size: int = 2) -> Column:
    return F.unhex(F.lit(value.to_bytes(size, "little").hex()))


def message(name: str, format: str, pieces: list[Column] | None, sql: str, others: dict[int, str] | None = None, timestamp: str | None = None, bitflags: dict | None = None, make=None) -> None:
    """A query (event_id, message) of statement 1 = ``format``; ``others``: nested formats by index."""
    entries = {1: Entry("info", format, 2)} | {i: Entry("derived", f) for i, f in (others or {}).items()}
    table = Catalog(entries, timestamp=timestamp, encoding="raw", bitflags=bitflags or {})

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        sent = logs(spark, sf_dir).select("event_id", F.concat(_le(1), *(make() if make else pieces)).alias("frame"))
        parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        return frames.decode_frames(sent.repartition(parts), table).select("event_id", F.when(F.col("decoded.status") == "ok", F.col("decoded.message")).alias("message"))

    QUERIES[name] = run
    ORACLE_SQL[name] = f"select event_id, {sql} as message from {VIEW_SQL}"


def _register() -> None:
    byte = lambda: F.col("event_id") % 256
    low = "(event_id % 256)"
    signed = lambda: (F.col("event_id") % 7) - 3
    v = "(event_id % 7 - 3)"
    ones = "case {v} when -1 then repeat('1', 128) when -2 then repeat('1', 127) || '0' when -3 then repeat('1', 126) || '01' else to_base({v}, 2) end".format(v=v)
    octal = "case {v} when -1 then '0o3' || repeat('7', 42) when -2 then '0o3' || repeat('7', 41) || '6' when -3 then '0o3' || repeat('7', 41) || '5' else '0o' || to_base({v}, 8) end".format(v=v)
    text = lambda: F.col("event_type").cast("binary")
    message("h06_binary_octal_signed", "{0=i32:b} {0=i32:#o}", None, f"{ones} || ' ' || {octal}", make=lambda: [little_endian(signed(), 4)])
    message("h07_ascii_bytes", "{=[u8]:a}", None, "'b\"' || event_type || '\\\"\\n\\xff\\\\\"'", make=lambda: [_len(F.concat(text(), F.unhex(F.lit("220aff5c"))))])
    message("h08_ascii_of_a_slice", "{=[?]:a}", None, "'b\"' || chr((65 + event_id % 26)::int) || 'z\"'", {2: "{=u8}"}, make=lambda: [_le(2, 4), _le(2), little_endian(65 + F.col("event_id") % 26, 1), _le(122, 1)])
    message("h11_debug_text", "{=str:?}", None, "'\"' || event_type || '\\n\\\"\"'", make=lambda: [_len(F.concat(text(), F.unhex(F.lit("0a22"))))])
    message("h12_debug_of_unsigned", "x={:b}", None, f"'x=S {{ x: ' || to_base({low}, 2) || ' }}'", {2: "S {{ x: {=u8:?} }}"}, make=lambda: [_le(2), little_endian(byte(), 1)])
    message("h16_unknown_microseconds", "{=u64:iso8601us}", None, "event_id::varchar", make=lambda: [_id(8)])
    message("h18_cbor", "{=[u8]:cbor}", None, "'[' || event_id % 24 || ', \"' || event_type || '\"]'", make=lambda: [_len(F.concat(F.unhex(F.lit("82")), little_endian(F.col("event_id") % 24, 1), little_endian(96 + F.octet_length(text()), 1), text()))])
    message("h20_bits_as_ascii", "{0=8..24:a}", None, "'b\"' || chr((65 + event_id % 26)::int) || chr((97 + event_id % 25)::int) || '\"'", make=lambda: [little_endian(97 + F.col("event_id") % 25, 1), little_endian(65 + F.col("event_id") % 26, 1)])
    message("h21_bool_char", "{=bool} {=char}", None, "case when event_id % 2 = 1 then 'true' else 'false' end || ' ' || chr((960 + event_id % 20)::int)", make=lambda: [little_endian(F.col("event_id") % 2, 1), little_endian(960 + F.col("event_id") % 20, 4)])
    message("h22_floats", "{=f64} {=f32}", None, "((event_id % 4000) / 4.0)::double::varchar || ' ' || ((event_id % 100) / 8.0)::double::varchar", make=lambda: [_float("d", 8)(F.col("event_id") % 4000 / 4), _float("f", 4)(F.col("event_id") % 100 / 8)])
    message("h23_hints_are_inherited", "{:#x}", None, f"'S(0x' || lower(to_base({low}, 16)) || ' ' || to_base({low}, 2) || ' -5)'", {2: "S({0=u8} {0=u8:b} {1=i8:?})"}, make=lambda: [_le(2), little_endian(byte(), 1), _le(251, 1)])
    message("h24_sequence", "<{=__internal_FormatSequence}>", None, f"'<' || {low} || '|' || event_type || '|>'", {2: "{=u8}|", 3: "{=str}|"}, make=lambda: [_le(2), little_endian(byte(), 1), _le(3), _len(text()), _le(0)])
    message("h25_slice", "{=[?]}", None, f"'[<' || {low} || '>, <' || (255 - {low}) || '>]'", {2: "<{=u8}>"}, make=lambda: [_le(2, 4), _le(2), little_endian(byte(), 1), little_endian(255 - byte(), 1)])
    message("h26_unknown_hint", "{=u8:loud} {=i8:us} {=[u8]:ms}", None, f"{low} || ' -7 [1, 2]'", make=lambda: [little_endian(byte(), 1), _le(249, 1), _le(2, 4), _le(0x0201, 2)])
    message("h17_bitflags_wide", "{=u128:__internal_bitflags_F@app@1}", None, "case event_id % 4 when 0 then 'NONE' when 1 then 'LOW' when 2 then 'TOP' else 'LOW | TOP' end", bitflags={("F", "app", "1"): [("LOW", 1), ("TOP", 1 << 100), ("NONE", 0)]}, make=lambda: [little_endian(F.col("event_id") % 2, 8), F.when(F.expr("event_id div 2 % 2 = 1"), _le(1 << 36, 8)).otherwise(_le(0, 8))])
    message("h17_bitflags_unknown", "{=u8:__internal_bitflags_G@app@1}", None, f"{low}::varchar", make=lambda: [little_endian(byte(), 1)])
    message("d02_wide_integers", "{=u128} {=i128} {=usize} {=isize}", None, "event_id || ' ' || (-1 - event_id) || ' ' || event_id || ' -1'", make=lambda: [_id(8), _le(0, 8), little_endian(-1 - F.col("event_id"), 8), _le((1 << 64) - 1, 8), _id(4), _le((1 << 32) - 1, 4)])
    message("d02_arrays", "{=[u8; 2]} {=[?; 2]}", None, f"'[' || {low} || ', 7] [' || {low} || '!, 9!]'", {2: "{=u8}!"}, make=lambda: [little_endian(byte(), 1), _le(7, 1), _le(2), little_endian(byte(), 1), _le(9, 1)])
    message("d03_repeated_arguments", "{1=u16} {0=u8} {1=u16}", None, f"'65535 ' || {low} || ' 65535'", make=lambda: [little_endian(byte(), 1), _le(65535)])
    message("d04_merged_bit_ranges", "{0=0..4} {0=3..8:#b} {1=12..16:x}", None, f"({low} % 16) || ' 0b' || to_base({low} // 8, 2) || ' ' || lower(to_base({low} // 16, 16))", make=lambda: [little_endian(byte(), 1), little_endian(byte(), 1)])
    message("d06_enumeration", "x={=?}", None, "case when event_id % 2 = 0 then 'x=None' else 'x=Some(' || event_id || ')' end", {2: "None|Some({=?})", 3: "{=u32}"}, make=lambda: [_le(2), F.when(F.col("event_id") % 2 == 0, _le(0, 1)).otherwise(F.concat(_le(1, 1), _le(3), _id(4)))])
    message("d07_slice_of_enumerations", "{=[?]}", None, f"'[A, B(' || {low} || '), A]'", {2: "A|B({=u8})"}, make=lambda: [_le(3, 4), _le(2), _le(0, 1), _le(1, 1), little_endian(byte(), 1), _le(0, 1)])
    message("x03_preformatted", "{=__internal_Display} {=__internal_Debug:?}", None, "event_type || ' \"' || event_type || '\"'", make=lambda: [text(), _le(255, 1), text(), _le(255, 1)])
    message("x02_derived_record", "{}", None, f"'Point {{ x: ' || {low} || ', label: \"' || event_type || '\" }}'", {2: producer.structure("Point", [("x", "u8"), ("label", "str")])}, make=lambda: [_le(2), little_endian(byte(), 1), _len(text())])
    message("x02_derived_enumeration", "{}", None, f"case when event_id % 3 = 2 then 'Pair(' || {low} || ', -1)' when event_id % 3 = 1 then 'Named {{ n: ' || event_id || ' }}' else 'Unit' end",
            {2: producer.enumeration([("Unit", []), ("Named", [("n", "u32")]), ("Pair", [(None, "u8"), (None, "i8")])])},
            make=lambda: [_le(2), F.when(F.col("event_id") % 3 == 0, _le(0, 1)).when(F.col("event_id") % 3 == 1, F.concat(_le(1, 1), _id(4))).otherwise(F.concat(_le(2, 1), little_endian(byte(), 1), _le(255, 1)))])
    message("e03_written_formats", "{=?}", None, "'(' || event_id || ', ' || event_type || ')'", {2: "{=__internal_FormatSequence}", 3: "({=u32}, ", 4: "{=str})"}, make=lambda: [_le(2), _le(3), _id(4), _le(4), _len(text()), _le(0)])
    message("e04_inspected_expression", producer.inspect("f({x}) + 1")[0][1], None, "'f({x}) + 1 = ' || event_id", {2: "{=u32}"}, make=lambda: [_le(2), _id(4)])
    message("e05_panics", producer.panic("unreachable", "state {=u8}")[1], None, f"'panicked at ''internal error: entered unreachable code: state ' || {low} || ''''", make=lambda: [little_endian(byte(), 1)])
    message("e06_failed_comparison", producer.compare(True, "dev {=u8}")[1], None, f"'panicked at ''assertion failed: `(left == right)`: dev ' || {low} || '''' || chr(10) || ' left: `' || event_id || '`' || chr(10) || 'right: `43`'", {2: "{=u32}"}, make=lambda: [little_endian(byte(), 1), _le(2), _id(4), _le(2), _le(43, 4)])
    message("e07_unwrapped_error", producer.unwrap("read({port})")[1], None, "'panicked at ''unwrap failed: read({port})''' || chr(10) || 'error: `' || chr(34) || event_type || chr(34) || '`'", {2: "{=str}"}, make=lambda: [_le(2), _len(text())])
    message("e08_interned_strings", "{=istr}/{=istr}", None, "case when event_id % 2 = 0 then 'even' else 'odd' end || '/even'", {7: "even", 8: "odd"}, make=lambda: [little_endian(7 + F.col("event_id") % 2, 2), _le(7)])


def _float(code: str, size: int):
    import struct

    @F.arrow_udf("binary")
    def pack(x: pa.Array) -> pa.Array:
        return pa.array([None if v is None else struct.pack("<" + code, v) for v in x.to_pylist()], pa.binary())

    return lambda c: pack(c.cast("double"))


_register()


def _values(name: str, columns: str, rows: list[tuple], make) -> None:
    """A query whose result is these rows, whatever the scale."""

    def literal(x) -> str:
        return "null" if x is None else str(x).lower() if isinstance(x, bool) else str(x) if isinstance(x, (int, float)) else "'" + x.replace("'", "''") + "'"

    QUERIES[name] = make
    ORACLE_SQL[name] = f"select * from (values {', '.join('(' + ', '.join(map(literal, r)) + ')' for r in rows)}) t({columns})"


def _table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def _error(call, *args, error: type[Exception], text=lambda e: str(e)) -> str:
    try:
        return f"ok {call(*args)}"
    except error as e:
        return text(e)


_GRAMMAR = {
    "{=1..9}": "ok", "{=9..1}": "invalid type", "{=0..129}": "invalid type", "{=0..8x}": "data after bit range", "{=[u8;  4]}": "ok", "{=[u8;}": "array without length", "{=[?;4}": "array without bracket", "{=[u8;x]}": "invalid integer",
    "{{}}": "ok", "}{": "unmatched close bracket", "{{{}}}": "ok", "}": "unmatched close bracket", "{=u8:loud}": "unknown hint", "{:}": "missing hint", "{x}": "unexpected content", "{0=u8}{0=u16}": "conflicting types", "{0=0..4}{0=2..9}": "ok", "{1=u8}": "unused argument", "{=u9}": "invalid type",
}
_values("p09_grammar_errors", "format, outcome", list(_GRAMMAR.items()), lambda spark, _: _table(spark, [(f, _error(lambda x: grammar.parse(x, strict=True) and "", f, error=grammar.FormatError, text=lambda e: e.kind).strip()) for f in _GRAMMAR], "format string, outcome string"))
_values("p06_unknown_hints_by_mode", "mode, outcome", [("strict", "unknown hint"), ("lenient", "unknown")], lambda spark, _: _table(spark, [(m, _error(lambda x: grammar.parse("{=u8:loud}", strict=x)[0].hint.kind, m == "strict", error=grammar.FormatError, text=lambda e: e.kind).removeprefix("ok ")) for m in ("strict", "lenient")], "mode string, outcome string"))
_WIRE = {"{0=0..4} {0=7..12}": "bits 0..12", "{0=30..31} {0=2..4}": "bits 2..31", "{1=u8} {0=str} {1=u8}": "str, u8", "{=[?; 3]}": "formats 3"}


def _wire(text: str) -> str:
    return ", ".join(f"bits {t.a}..{t.b}" if t.kind == "bits" else f"{t.kind} {t.a}" if t.kind in ("array", "formats") else t.kind for t in grammar.wire_types(text))


_values("a02_covering_bit_ranges", "format, wire", list(_WIRE.items()), lambda spark, _: _table(spark, [(f, _wire(f)) for f in _WIRE], "format string, wire string"))
_values(
    "j05_format_fragments", "idx, place, kind, text, argument, type, hint",
    [(1, 0, "literal", "id=", None, None, None), (1, 1, "parameter", None, 0, "u64", None), (1, 2, "literal", " user=", None, None, None), (1, 3, "parameter", None, 1, "u32", ""), (1, 4, "literal", " type=", None, None, None), (1, 5, "parameter", None, 2, "istr", None)],
    lambda spark, _: frames.format_fragments(catalogs.to_table(spark, CATALOG)).where("idx = 1"),
)
_MARKS = [
    ("4 raw", ["log_version_ = 4", "log_encoding_ = raw"], True), ("repeated", ["log_version_ = 4", '"log_version_ = 4"', "log_encoding_ = raw"], True), ("two encodings", ["log_version_ = 4", "log_encoding_ = raw", "log_encoding_ = rzcobs"], True),
    ("unused", [], False), ("no section", ["log_version_ = 4"], False), ("no version", ["log_encoding_ = raw"], True), ("old version", ["log_version_ = 2", "log_encoding_ = raw"], True), ("unknown encoding", ["log_version_ = 3", "log_encoding_ = xyz"], True),
]
_values(
    "s05_catalog_settings", "what, outcome",
    [("4 raw", "ok ('4', 'raw')"), ("repeated", "more than one symbol of version"), ("two encodings", "more than one symbol of encoding"), ("unused", "ok None"), ("no section", "a version but no section of formats"), ("no version", "a section of formats but no version"), ("old version", "wire format version 2; this reads 3 and 4"), ("unknown encoding", "unknown encoding: xyz")],
    lambda spark, _: _table(spark, [(what, _error(catalogs.settings, names, PREFIX, section, error=catalogs.CatalogError)) for what, names, section in _MARKS], "what string, outcome string"),
)
_values("s02_version_check_left_out", "checked, outcome", [(True, "wire format version 9; this reads 3 and 4"), (False, "ok ('9', 'raw')")], lambda spark, _: _table(spark, [(c, _error(catalogs.settings, ["log_version_ = 9", "log_encoding_ = raw"], PREFIX, True, c, error=catalogs.CatalogError)) for c in (True, False)], "checked boolean, outcome string"))


def _symbols(spark: SparkSession) -> DataFrame:
    made = producer.Interner(PREFIX)
    made.timestamp("{=u64:us}")
    for level in LEVELS:
        made.statement(level, f"at \"{level}\"\n{{=u8}}")
    made.statement("println", "plain")
    made.intern("shared")
    made.intern("shared")
    made.add("custom_section", "not a format")
    rows = [*made.symbols(), ("", 0, "", None), ("$d.1", 0, "", None), ("__LOG_MARKER_END", 0, "", None)]
    return spark.createDataFrame(rows, "name string, address int, section string, data binary")


_SYMBOL_ROWS = [(1, "timestamp", None, "{=u64:us}"), *((2 + i, level, i, f'at "{level}"\n{{=u8}}') for i, level in enumerate(LEVELS)), (7, "println", None, "plain"), (8, "str", None, "shared")]
_values("s01_symbols_to_formats", "idx, tag, level, format", _SYMBOL_ROWS, lambda spark, _: catalogs.format_table(_symbols(spark), PREFIX).select("idx", "tag", F.col("level").cast("int").alias("level"), "format"))
_values("s11_catalog_there_and_back", "idx, tag, level, format", [(0, *_SYMBOL_ROWS[0][1:]), *_SYMBOL_ROWS[1:]], lambda spark, _: catalogs.to_table(spark, catalogs.load(catalogs.format_table(_symbols(spark), PREFIX))).select("idx", "tag", F.col("level").cast("int").alias("level"), "format"))
_values("d08_statement_indices", "idx", [(i,) for i in range(2, 8)], lambda spark, _: _table(spark, [(i,) for i in catalogs.load(catalogs.format_table(_symbols(spark), PREFIX)).indices()], "idx int"))
_values("e14_mangled_symbols", "package, tag, data, disambiguator, crate_name", [('a"b', "log_info", "x\t@\\{=u8}", "3", "a-b")], lambda spark, _: _table(spark, [(producer.mangle('a"b', "log_info", "x\t@\\{=u8}", 3, "a-b"),)], "n string").select(F.from_json("n", catalogs.SYMBOL).alias("s")).select("s.*"))
_values("s10_source_paths", "path", [("/root/src/a.rs",), ("/abs/a.rs",), ("/root/a.rs",), ("/lib/x.rs",), ("b.rs",)], lambda spark, _: _table(spark, [("/root", "src", "a.rs"), ("/root", "src", "/abs/a.rs"), ("/root/", "", "a.rs"), ("/root", "/lib", "x.rs"), (None, None, "b.rs")], "f string, d string, n string").select(locate.joined_path(F.col("f"), F.col("d"), F.col("n")).alias("path")))


def _locations_of(spark: SparkSession, _: str) -> DataFrame:
    symbols = catalogs.format_table(_symbols(spark), PREFIX)
    names = [r.raw_symbol for r in symbols.where("level is not null").orderBy("idx").collect()]  # five rows of a fixture
    rows = [(locate.STATEMENT, n, f"src/{i}.rs", 10 + i, f"app::m{i}") for i, n in enumerate(names)] + [(locate.STATEMENT, "dropped by the linker", "x.rs", 1, "app"), ("other", names[0], "y.rs", 2, "app")]
    return locate.locations_of(spark.createDataFrame(rows, "name string, linkage_name string, file string, line long, module string"), symbols)


_values("l06_locations_by_linkage_name", "idx, file, line, module", [(2 + i, f"src/{i}.rs", 10 + i, f"app::m{i}") for i in range(5)], _locations_of)
_values("q06_modules_by_level", "level, modules_on, modules_off", [("trace", "app::b", "app,app::a"), ("info", "app,app::b", "app::a"), ("error", "app,app::b", "app::a")], lambda spark, _: _table(spark, [(x, ",".join(filters.modules_on_for("info,app::a=off,app::b", "app", x)), ",".join(filters.modules_off_for("info,app::a=off,app::b", "app", x))) for x in ("trace", "info", "error")], "level string, modules_on string, modules_off string"))
_values("q03_directive_errors", "directives, outcome", [("app=loud", "unknown level: 'loud'"), ("1app", "not a module path: '1app'"), ("app::", "not a module path: 'app::'"), ("app::a,,warn", "ok {'app::a': 0, 'app': 3}")], lambda spark, _: _table(spark, [(d, _error(filters.parse_directives, d, "app", error=filters.DirectiveError)) for d in ("app=loud", "1app", "app::", "app::a,,warn")], "directives string, outcome string"))
_values("t18_template_warnings", "template, stamped, found", [("{t} {s}", True, ""), ("{t} {s}", False, "the template has a timestamp, the stream has none"), ("{s}", True, "the stream has timestamps, the template has none"), ("{{t}%bold} {s}", False, "the template has a timestamp, the stream has none")], lambda spark, _: _table(spark, [(t, x, "; ".join(template.warnings(t, x))) for t, x in (("{t} {s}", True), ("{t} {s}", False), ("{s}", True), ("{{t}%bold} {s}", False))], "template string, stamped boolean, found string"))
_TEMPLATES = {"{s:bold:bold}": "repeated style: bold", "{s:red:blue}": "two colours: blue", "{s:1:2}": "two widths: 2", "{s:loud}": "unknown parameter: loud", "{s:bold:red:>05}": "ok"}
_values("t03_template_parameters", "template, outcome", list(_TEMPLATES.items()), lambda spark, _: _table(spark, [(t, _error(lambda x: template.parse(x) and "", t, error=template.TemplateError).strip()) for t in _TEMPLATES], "template string, outcome string"))


def query(name: str, sql: str):
    def add(f):
        QUERIES[name], ORACLE_SQL[name] = f, sql.replace("@LOGS", VIEW_SQL)
        return f

    return add


_PRINTS = Catalog(CATALOG.entries | {6: Entry("println", "print {=u64}")}, timestamp=CATALOG.timestamp)


def _with_prints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third event is a print: a statement without a level."""
    log = raw_frames(logs(spark, sf_dir))
    printed = F.concat(_le(6), little_endian(F.col("ms"), 8), little_endian(F.col("event_id"), 8))
    sent = log.withColumn("frame", F.when(F.col("event_id") % 3 == 0, printed).otherwise(F.col("frame"))).select("event_id", "module", "frame").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    return frames.decode_frames(sent, _PRINTS, framed=False).select("event_id", "module", "decoded.*")


@query("q08_prints_pass_filters", "select event_id, event_id % 3 = 0 as printed from @LOGS where event_id % 3 = 0 or level >= 4")
def q08_prints_pass_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = _with_prints(spark, sf_dir).where(filters.directive_filter("error", "app", F.col("module"), F.col("level")))
    return kept.select("event_id", F.col("level").isNull().alias("printed"))


@query("q09_device_records", "select event_id from @LOGS where event_id % 2 = 1")
def q09_device_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    origin = F.when(F.col("event_id") % 2 == 1, "device").otherwise("host")
    return logs(spark, sf_dir).withColumn("origin", origin).where(filters.device_only(F.col("origin"))).select("event_id")


@query("t17_prints_bypass_templates", "select event_id, case when event_id % 3 = 0 then 'print ' || event_id else ['TRACE', 'DEBUG', 'INFO', 'WARN', 'ERROR'][level + 1] || ' <time>' end as line from @LOGS")
def t17_prints_bypass_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _with_prints(spark, sf_dir)
    columns = {"level": F.col("level"), "timestamp": F.lit(""), "message": F.when(F.col("level").isNull(), F.col("message")).otherwise(F.lit(""))}
    return rows.select("event_id", template.render("{L:1} {t}{s}", columns).alias("line"))


@query(
    "t15_colored_template",
    "select event_id, chr(27) || '[' || ['90', '97', '32', '33', '31'][level + 1] || 'm' || ['TRACE', 'DEBUG', 'INFO', 'WARN', 'ERROR'][level + 1] || chr(27) || '[0m' || repeat(' ', 5 - length(['TRACE', 'DEBUG', 'INFO', 'WARN', 'ERROR'][level + 1])) || '|' "
    "|| repeat(' ', 12 - length(event_type)) || chr(27) || '[1;36m' || event_type || chr(27) || '[0m' as line from @LOGS",
)
def t15_colored_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Padding doesn't count the colours."""
    return logs(spark, sf_dir).select("event_id", template.render("{L}|{s:bold:cyan:>12}", {"level": F.col("level"), "message": F.col("event_type")}, color=True).alias("line"))


@query("t05_zero_padding", "select event_id, lpad(event_id::varchar, 8, '0') || ' ' || event_type as line from @LOGS")
def t05_zero_padding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs(spark, sf_dir).select("event_id", template.render("{l:>08} {s}", {"level": F.col("level"), "message": F.col("event_type"), "line": F.col("event_id")}).alias("line"))


@query(
    "t14_assertion_difference",
    "select event_id, chr(27) || '[1mpanicked at ''x''' || chr(27) || '[0m' || chr(10) || chr(27) || '[1mdiff' || chr(27) || '[0m ' || chr(27) || '[31m< left' || chr(27) || '[0m / ' || chr(27) || '[32mright >' || chr(27) || '[0m' || chr(10) "
    "|| chr(27) || '[31m<' || chr(27) || '[0m' || chr(27) || '[31m' || event_type || chr(27) || '[0m' || chr(27) || '[31;1m1' || chr(27) || '[0m' || chr(10) "
    "|| chr(27) || '[32m>' || chr(27) || '[0m' || chr(27) || '[32m' || event_type || chr(27) || '[0m' || chr(27) || '[32;1m2' || chr(27) || '[0m' as line from @LOGS",
)
def t14_assertion_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    failed = F.concat(F.lit("panicked at 'x'\n left: `"), "event_type", F.lit("1`\nright: `"), "event_type", F.lit("2`"))
    return logs(spark, sf_dir).select("event_id", template.render("{L} {s}", {"level": F.lit(4), "message": failed}, diffs=True).alias("line"))


@query("j01_colored_display", "select event_id, case when level = 1 then 'DEBUG' else chr(27) || '[' || ['2', '', '32', '33', '31'][level + 1] || 'm' || ['TRACE', 'DEBUG', 'INFO', 'WARN', 'ERROR'][level + 1] || chr(27) || '[0m' end || ' ' || event_type as line from @LOGS")
def j01_colored_display(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.element_at(F.array(*(F.lit(x.upper()) for x in LEVELS)), F.col("level") + 1)
    return logs(spark, sf_dir).select("event_id", frames.display(name, F.lit(None).cast("string"), F.col("event_type"), colored=True).alias("line"))


def _chunked(spark: SparkSession, sf_dir: str, framed: bool) -> DataFrame:
    """Byte streams cut to chunks at places that no frame knows."""
    from .logview import streams

    sent = raw_frames(logs(spark, sf_dir))
    if framed:
        whole = streams(sent)
    else:
        joined = sent.groupBy(F.expr("event_id div 1000").alias("stream_id")).agg(F.sort_array(F.collect_list(F.struct("event_id", F.hex("frame").alias("hex")))).alias("x"))
        whole = joined.select("stream_id", F.unhex(F.array_join("x.hex", "")).alias("bytes"))
    cuts = whole.select("stream_id", "bytes", F.posexplode(F.expr("sequence(1, greatest(octet_length(bytes), 1), 777)")).alias("seq", "at"))
    return cuts.select("stream_id", "seq", F.substring("bytes", F.col("at"), F.lit(777)).alias("chunk"))


_STREAMED = "select event_id // 1000 as stream_id, level, 'id=' || event_id as head from @LOGS"


def _heads(df: DataFrame) -> DataFrame:
    return df.select("stream_id", F.col("level").cast("int").alias("level"), F.substring_index("message", " ", 1).alias("head"))


@query("f08_framed_by_the_catalog", _STREAMED)
def f08_framed_by_the_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _heads(frames.decode_stream(_chunked(spark, sf_dir, True), CATALOG))


@query("f08_raw_by_the_catalog", _STREAMED)
def f08_raw_by_the_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _heads(frames.decode_stream(_chunked(spark, sf_dir, False), Catalog(CATALOG.entries, CATALOG.timestamp, "raw")))


@query("f11_fail_fast", _STREAMED)
def f11_fail_fast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without a malformed frame the strictest policy lets all pass."""
    return _heads(frames.apply_policy(frames.decode_stream(_chunked(spark, sf_dir, True), CATALOG), "failfast", "status"))


@query("f09_stream_opens_with_a_zero", "select event_id // 1000 as stream_id, true as opened from @LOGS group by 1")
def f09_stream_opens_with_a_zero(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .logview import streams

    return streams(raw_frames(logs(spark, sf_dir))).select("stream_id", (F.hex(F.substring("bytes", 1, 1)) == "00").alias("opened"))


@query("a01_bitflags_by_definition", "select p_brand as ident, string_agg('F' || p_partkey || '=' || p_partkey, ',' order by p_partkey desc) as flags from (select distinct p_brand, p_partkey from part) group by p_brand")
def a01_bitflags_by_definition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symbol rows of flags, collected by key in order of definition: later parts are defined first."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_brand", "p_partkey").distinct()
    data = F.concat_ws("::", "p_brand", (1_000_000_000 - F.col("p_partkey")).cast("string"), F.concat(F.lit("F"), F.col("p_partkey").cast("string")))
    name = F.to_json(F.struct(F.lit("app").alias("package"), F.lit(PREFIX + "bitflags_value").alias("tag"), data.alias("data"), F.lit("1").alias("disambiguator"), F.lit("app").alias("crate_name")))
    symbols = part.select(name.alias("name"), F.concat(little_endian(F.col("p_partkey"), 8), _le(0, 8)).alias("data"))
    flags = catalogs.bitflags_table(symbols, PREFIX)
    value = lambda f: F.conv(F.hex(F.concat(*(F.substring(f["value"], 8 - i, 1) for i in range(8)))), 16, 10)
    return flags.select("ident", F.array_join(F.transform("flags", lambda f: F.concat(f["name"], F.lit("="), value(f))), ",").alias("flags"))
