"""Named queries over the driver's tables, one or more for each operator, with the SQL of their results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import sinks
from ..functions import hints
from ..operators import filters, frames, locate, template
from .logview import CATALOG, LOCATIONS, VIEW_SQL, logs, raw_frames, streams

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
_NAMES = ["TRACE", "DEBUG", "INFO", "WARN", "ERROR"]
_LEVEL_NAME = "['TRACE', 'DEBUG', 'INFO', 'WARN', 'ERROR'][level + 1]"
_ISO = "strftime(make_timestamp(ms * 1000), '%Y-%m-%dT%H:%M:%S') || '.' || lpad((ms % 1000)::varchar, 3, '0') || 'Z'"
_MESSAGE = "'id=' || event_id || ' user=' || case when user_id < 1000 then lpad(user_id::varchar, 4, '0') else user_id::varchar end || ' type=' || event_type"


def _query(name: str, sql: str):
    def add(f: Query) -> Query:
        QUERIES[name], ORACLE_SQL[name] = f, sql.replace("@LOGS", VIEW_SQL)
        return f

    return add


def _text(name: str, column: Callable[[], Column], sql: str, alias: str = "text") -> None:
    """A query of one text an event."""
    QUERIES[name] = lambda spark, sf_dir: logs(spark, sf_dir).select("event_id", column().alias(alias))
    ORACLE_SQL[name] = f"select event_id, {sql} as {alias} from {VIEW_SQL}"


X, X_SQL = (lambda: (F.col("event_id") * 2654435761 + F.col("user_id")) % 2147483647), "((event_id * 2654435761 + user_id) % 2147483647)"
_SIGNED, _SIGNED_SQL = (lambda: (F.col("event_id") * 40503) % 65536 - 32768), "((event_id * 40503) % 65536 - 32768)"


def _lpad(digits: str, n: int) -> str:
    return f"case when length({digits}) < {n} then lpad({digits}, {n}, '0') else {digits} end"


_text("hint_dec_pad", lambda: hints.decimal(X(), 8), _lpad(f"{X_SQL}::varchar", 8))
_text("hint_dec_pad_signed", lambda: hints.decimal(_SIGNED(), 8), f"case when {_SIGNED_SQL} < 0 then '-' || lpad(abs({_SIGNED_SQL})::varchar, 7, '0') else lpad({_SIGNED_SQL}::varchar, 8, '0') end")
_text("hint_hex", lambda: hints.hexadecimal(X()), f"lower(to_base({X_SQL}, 16))")
_text("hint_hex_alt", lambda: hints.hexadecimal(X(), 12, alternate=True, upper=True), f"'0x' || lpad(upper(to_base({X_SQL}, 16)), 10, '0')")
_text("hint_bin", lambda: hints.binary(X(), 34, alternate=True), f"'0b' || lpad(to_base({X_SQL}, 2), 32, '0')")
_text("hint_oct", lambda: hints.octal(X(), alternate=True), f"'0o' || to_base({X_SQL}, 8)")
_text("hint_hex_signed16", lambda: hints.hexadecimal(_SIGNED(), alternate=True, bits=16), f"'0x' || lower(to_base(({_SIGNED_SQL} + 65536) % 65536, 16))")
_text("bit_extract", lambda: hints.bits(X(), 7, 12), f"({X_SQL} // 128) % 32", "bits")
_text("hint_seconds_us", lambda: hints.seconds(F.col("us"), 6), "(us // 1000000)::varchar || '.' || lpad((us % 1000000)::varchar, 6, '0')")
_text("hint_seconds_ms", lambda: hints.seconds(F.col("ms"), 3), "(ms // 1000)::varchar || '.' || lpad((ms % 1000)::varchar, 3, '0')")


def _clock_sql(x: str, unit: int, places: int) -> str:
    two = lambda v: f"lpad(({v})::varchar, 2, '0')"
    s = f"({x} // {unit})"
    tail = f" || '.' || lpad(({x} % {unit})::varchar, {places}, '0')" if places else ""
    return f"case when {s} // 86400 > 0 then ({s} // 86400)::varchar || ':' else '' end || {two(f'{s} // 3600 % 24')} || ':' || {two(f'{s} // 60 % 60')} || ':' || {two(f'{s} % 60')}{tail}"


_text("hint_time_tus", lambda: hints.clock(F.col("us"), 6), _clock_sql("us", 1_000_000, 6))
_text("hint_time_tms", lambda: hints.clock(X(), 3), _clock_sql(X_SQL, 1000, 3))
_text("hint_time_ts", lambda: hints.clock(F.col("event_id") * 37, 0), _clock_sql("(event_id * 37)", 1, 0))
_text("hint_iso8601_ms", lambda: hints.iso8601(F.col("ms")), _ISO)
_text("hint_iso8601_s", lambda: hints.iso8601(F.expr("ms div 1000"), millis=False), "strftime(make_timestamp(ms // 1000 * 1000000), '%Y-%m-%dT%H:%M:%SZ')")
_FLAGS = [("READ", 1), ("WRITE", 2), ("EXEC", 4), ("ALL", 7), ("NONE", 0)]
_text(
    "bitflags_render", lambda: hints.bitflags(F.col("event_id") % 16, _FLAGS),
    "case when event_id % 16 = 8 then '(empty)' when event_id % 16 = 0 then 'NONE' else concat_ws(' | ', " + ", ".join(f"case when (event_id % 16) & {v} = {v} then '{n}' end" for n, v in _FLAGS if v) + ") end",
)
_text("slice_render", lambda: hints.byte_list(F.col("event_type").cast("binary")), "'[' || array_to_string(list_transform(string_split(event_type, ''), lambda c: ord(c)::varchar), ', ') || ']'")
_text("slice_render_hex", lambda: hints.byte_list(F.col("event_type").cast("binary"), "#x"), "'[' || array_to_string(list_transform(string_split(event_type, ''), lambda c: '0x' || lower(to_base(ord(c), 16))), ', ') || ']'")


@_query("level_threshold", "select event_id, level from @LOGS where level >= 3")
def level_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs(spark, sf_dir).where(filters.level_at_least(F.col("level"), "warn")).select("event_id", "level")


DIRECTIVES = "info,other=trace,app::view=off,app::click::s1,app::error=off,app::view::s2=trace,app::signup=warn,app::error=error"


@_query(
    "directive_filter",
    """select event_id, module from @LOGS where case when module like 'app::view::s2%' then true when module = 'app::click::s1' then true
when event_type = 'view' then false when event_type = 'error' then level >= 4 when event_type = 'signup' then level >= 3 else level >= 2 end""",
)
def directive_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs(spark, sf_dir).where(filters.directive_filter(DIRECTIVES, "app", F.col("module"), F.col("level"))).select("event_id", "module")


def _decoded(spark: SparkSession, sf_dir: str, corrupt: bool = False) -> DataFrame:
    """Events encoded, framed, joined to byte streams, split and decoded again."""
    sent = raw_frames(logs(spark, sf_dir))
    if corrupt:  # an index that no catalog has
        sent = sent.withColumn("frame", F.when(F.col("event_id") % 7 == 0, F.concat(F.unhex(F.lit("E703")), F.expr("substring(frame, 3)"))).otherwise(F.col("frame")))
    pieces = frames.split_zero_framed(streams(sent))
    return frames.decode_frames(pieces, CATALOG).select("stream_id", "ordinal", "decoded.*")


@_query("roundtrip_zero_framed", f"select event_id, level, {_ISO} as timestamp, {_MESSAGE} as message from @LOGS")
def roundtrip_zero_framed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _decoded(spark, sf_dir).select(F.get_json_object("args", "$[0]").cast("long").alias("event_id"), F.col("level").cast("int").alias("level"), "timestamp", "message")


@_query("roundtrip_raw", f"select event_id // 1000 as stream_id, level, {_MESSAGE} as message from @LOGS")
def roundtrip_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    sent = raw_frames(logs(spark, sf_dir)).select(F.expr("event_id div 1000").alias("stream_id"), F.col("event_id").alias("seq"), F.col("frame").alias("chunk"))
    return frames.decode_raw_streams(sent, CATALOG).select("stream_id", F.col("level").cast("int").alias("level"), "message")


@_query("roundtrip_native", "select event_id, level, user_id, ms from @LOGS where level >= 3")
def roundtrip_native(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fixed-width format decodes with Columns alone, and the level filter comes before it."""
    sent = frames.early_level_filter(raw_frames(logs(spark, sf_dir)).select("frame"), CATALOG, [i for i, e in CATALOG.entries.items() if (e.level or 0) >= 3])
    part = lambda at, size: hints.from_little_endian(F.col("frame"), at, size)
    return sent.select(part(10, 8).cast("long").alias("event_id"), (part(0, 2) - 1).cast("int").alias("level"), part(18, 4).alias("user_id"), part(2, 8).cast("long").alias("ms"))


@_query("malformed_skip", f"select event_id, {_MESSAGE} as message from @LOGS where event_id % 7 <> 0")
def malformed_skip(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = frames.apply_policy(_decoded(spark, sf_dir, corrupt=True), "dropmalformed", "status")
    return kept.select(F.get_json_object("args", "$[0]").cast("long").alias("event_id"), "message")


@_query("skipped_frames", "select event_id // 1000 as stream_id, count(*) as skipped from @LOGS where event_id % 7 = 0 group by 1")
def skipped_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames.skipped_frames(_decoded(spark, sf_dir, corrupt=True), "status").groupBy("stream_id").agg(F.count("*").alias("skipped"))


@_query("fragments", f"select event_id, 'id=|' || event_id || '| user=|' || {_lpad('user_id::varchar', 4)} || '| type=|' || event_type as pieces from @LOGS")
def fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _decoded(spark, sf_dir).select(F.get_json_object("args", "$[0]").cast("long").alias("event_id"), F.array_join("fragments", "|").alias("pieces"))


@_query("display", f"select event_id, {_ISO} || ' ' || {_LEVEL_NAME} || ' ' || {_MESSAGE} as line from @LOGS")
def display(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _decoded(spark, sf_dir).select(F.get_json_object("args", "$[0]").cast("long").alias("event_id"), frames.display(F.col("level_name"), F.col("timestamp"), F.col("message")).alias("line"))


def _indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs(spark, sf_dir).withColumn("idx", F.col("level") + 1)


def _locations(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(LOCATIONS, "idx int, file string, line long, module string")


@_query("dictionary_lookup", "select event_id, case when event_type = 'error' then null else event_type || '!' end as format, case when event_type = 'error' then 'malformed' else 'ok' end as status from @LOGS")
def dictionary_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = spark.createDataFrame([(i, module.split("::")[1] + "!") for i, _, _, module in LOCATIONS], "idx int, format string")
    return frames.lookup_formats(_indexed(spark, sf_dir), table).select("event_id", "format", "status")


_FILE = "case when event_type <> 'error' then 'src/app/' || event_type || '/mod.rs' end"


@_query("location_left_join", f"select event_id, {_FILE} as file, case when event_type <> 'error' then 10 * (level + 1) end as line from @LOGS")
def location_left_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return locate.with_locations(_indexed(spark, sf_dir).drop("module"), _locations(spark), working_dir="/work").select("event_id", "file", "line")


@_query("location_gate", "select event_id, null::varchar as file from @LOGS")
def location_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    indices = spark.createDataFrame([(i,) for i in CATALOG.indices()], "idx int")
    return locate.with_locations(_indexed(spark, sf_dir).drop("module"), _locations(spark), indices).select("event_id", "file")


@_query("module_path_split", "select event_id, 'app' as crate_name, event_type as modules, 's' || (user_id % 3) as function from @LOGS")
def module_path_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = logs(spark, sf_dir).select("event_id", locate.module_path(F.col("module")).alias("p"))
    return path.select("event_id", "p.crate_name", F.array_join("p.modules", "::").alias("modules"), "p.function")


def _templated(name: str, location: bool, text: str | None = None) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = locate.with_locations(_indexed(spark, sf_dir).drop("module"), _locations(spark))
        columns = {c: F.col(c) for c in ("level", "file", "line", "module")} | {"message": F.col("event_type"), "timestamp": hints.iso8601(F.col("ms"))}
        return rows.select("event_id", template.render(text or template.preset(name, True, location), columns).alias("line"))

    return run


_PATH = "case when event_type <> 'error' then 'app::' || event_type || '::handle' else '<mod path>' end"
_FULL = "case when event_type <> 'error' then '/work/src/app/' || event_type || '/mod.rs' else '<file>' end"
_LINE = "case when event_type <> 'error' then (10 * (level + 1))::varchar else '0' end"
QUERIES["template_default"] = _templated("default", True)
ORACLE_SQL["template_default"] = f"select event_id, {_ISO} || ' ' || rpad({_LEVEL_NAME}, 5, ' ') || ' ' || event_type || chr(10) || '└─ ' || {_PATH} || ' @ ' || {_FULL} || ':' || rpad({_LINE}, 4, ' ') as line from {VIEW_SQL}"
QUERIES["template_oneline"] = _templated("oneline", True)
ORACLE_SQL["template_oneline"] = f"""select event_id, {_ISO} || ' [' || rpad({_LEVEL_NAME}, 5, ' ') || '] ' || event_type || ' (' || case when event_type <> 'error' then 'app' else '<crate>' end || ' '
|| case when event_type <> 'error' then 'app/' || event_type || '/mod.rs' else '<file>' end || ':' || {_LINE} || ')' as line from {VIEW_SQL}"""
QUERIES["template_custom"] = _templated("", True, "{L:>7}|{{s:^12}!%<20}|{l:06}")
ORACLE_SQL["template_custom"] = f"""select event_id, lpad({_LEVEL_NAME}, 7, ' ') || '|' || rpad(repeat(' ', ((12 - length(event_type)) // 2)::int) || event_type || repeat(' ', (12 - length(event_type) - (12 - length(event_type)) // 2)::int) || '!', 20, ' ')
|| '|' || rpad({_LINE}, 6, '0') as line from {VIEW_SQL}"""


@_query("json_frame", f"select event_id, event_type as data, ms * 1000000 as host_timestamp, {_LEVEL_NAME} as level, {_FILE.replace('src', '/work/src')} as file, case when event_type <> 'error' then event_type end as module, {_ISO} as target_timestamp from @LOGS")
def json_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written as JSON text and parsed again."""
    rows = locate.with_locations(_indexed(spark, sf_dir).drop("module"), _locations(spark))
    name = F.element_at(F.array(*map(F.lit, _NAMES)), F.col("level") + 1)
    text = sinks.json_frame(F.col("event_type"), name, hints.iso8601(F.col("ms")), F.col("file"), F.col("line"), F.col("module"), F.col("ms") * 1_000_000)
    parsed = rows.select("event_id", F.from_json(text, sinks.JSON_FRAME).alias("j"))
    return parsed.select("event_id", "j.data", "j.host_timestamp", "j.level", "j.location.file", F.array_join("j.location.module_path.modules", "::").alias("module"), "j.target_timestamp")


@_query("bitflags_catalog", "select p_brand as ident, string_agg(p_partkey::varchar, ',' order by p_partkey) as flags from (select distinct p_brand, p_partkey from part) group by p_brand")
def bitflags_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flags collected by key and put in order of definition: the catalog's only aggregation."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_brand", "p_partkey").distinct()
    flags = part.groupBy(F.col("p_brand").alias("ident")).agg(F.sort_array(F.collect_list("p_partkey")).alias("x"))
    return flags.select("ident", F.array_join(F.transform("x", lambda v: v.cast("string")), ",").alias("flags"))


@_query("warnings_by_module", "select module, count(*) as n, max(ms) as last_ms from @LOGS where level >= 3 group by module")
def warnings_by_module(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decoded frames are rows like any other."""
    kept = logs(spark, sf_dir).where(filters.level_at_least(F.col("level"), "warn"))
    return kept.groupBy("module").agg(F.count("*").alias("n"), F.max("ms").alias("last_ms"))


from . import survey  # noqa: E402

QUERIES |= survey.QUERIES
ORACLE_SQL |= survey.ORACLE_SQL
