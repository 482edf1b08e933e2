"""Catalogs: symbol rows to format table, bit flags and stream settings; and their tables back and forth.

A symbol row is (name, address, section, data): ``name`` is JSON text {package, tag,
data, disambiguator[, crate_name]}.  Rows come from any table; reading object files is
left to tools that have a parser for them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.codec import Catalog, Entry

VERSIONS = ("3", "4")
ENCODINGS = ("raw", "rzcobs")
LEVEL_TAGS = {"trace": 0, "debug": 1, "info": 2, "warn": 3, "error": 4}
TAGS = {"prim", "derived", "bitflags", "write", "str", "timestamp", "bitflags_value", "println", *LEVEL_TAGS}
SYMBOL = "package string, tag string, data string, disambiguator string, crate_name string"
FORMAT_TABLE = "idx int, tag string, level tinyint, format string, raw_symbol string"


class CatalogError(ValueError):
    pass


def settings(names: list[str], prefix: str, has_section: bool = True, check: bool = True) -> tuple[str, str] | None:
    """(version, encoding) from marker symbols ``{prefix}version_ = x`` and ``{prefix}encoding_ = x``; None where the stream kind is not in use."""
    found: dict[str, set] = {"version": set(), "encoding": set()}
    for name in names:
        for kind, values in found.items():
            if name.strip('"').startswith(f"{prefix}{kind}_ = "):
                if values:
                    raise CatalogError(f"more than one symbol of {kind}")
                values.add(name.strip('"').split(" = ", 1)[1])
    version, encoding = (next(iter(v), None) for v in found.values())
    if not has_section:
        if version is None:
            return None
        raise CatalogError("a version but no section of formats")
    if version is None:
        raise CatalogError("a section of formats but no version")
    if check:
        check_version(version)
    if encoding not in ENCODINGS:
        raise CatalogError(f"unknown encoding: {encoding}")
    return version, encoding


def check_version(version: str) -> None:
    if version not in VERSIONS:
        raise CatalogError(f"wire format version {version}; this reads {' and '.join(VERSIONS)}")


def _tag(prefix: str):
    """``{prefix}info`` and the like without prefix; others are custom."""
    bare = F.when(F.col("s.tag").startswith(prefix), F.expr(f"substring(s.tag, {len(prefix) + 1})"))
    return F.when(bare.isin(*TAGS), bare).otherwise("custom")


def format_table(symbols: DataFrame, prefix: str) -> DataFrame:
    """FORMAT_TABLE of all symbols that carry a format; mapping and marker symbols and custom tags are left out."""
    rows = symbols.where(~F.col("name").rlike(rf"^$|^\$d|^\"?{prefix}(version|encoding)_ =|^__.*_MARKER")).withColumn("s", F.from_json("name", SYMBOL)).withColumn("tag", _tag(prefix)).where("tag <> 'custom' and tag <> 'bitflags_value'")
    level = F.expr("case tag " + " ".join(f"when '{t}' then {n}" for t, n in LEVEL_TAGS.items()) + " end").cast("tinyint")
    return rows.select(F.col("address").cast("int").alias("idx"), "tag", level.alias("level"), F.col("s.data").alias("format"), F.col("name").alias("raw_symbol"))


def bitflags_table(symbols: DataFrame, prefix: str) -> DataFrame:
    """(ident, package, disambig, crate_name, flags) with the flags in order of definition; data is ``IDENT::position::NAME``, the value 16 bytes, lowest first."""
    rows = symbols.withColumn("s", F.from_json("name", SYMBOL)).withColumn("tag", _tag(prefix)).where("tag = 'bitflags_value'").withColumn("p", F.split("s.data", "::"))
    value = F.when(F.length("data") == 16, F.col("data")).otherwise(F.raise_error(F.lit("a flag's value must have 16 bytes")).cast("binary"))
    rows = rows.select(F.col("p")[0].alias("ident"), F.col("s.package").alias("package"), F.col("s.disambiguator").alias("disambig"), F.col("s.crate_name").alias("crate_name"), F.struct(F.col("p")[1].cast("int").alias("pos"), F.col("p")[2].alias("name"), value.alias("value")).alias("f"))
    return rows.groupBy("ident", "package", "disambig", "crate_name").agg(F.sort_array(F.collect_list("f")).alias("flags"))


def load(table: DataFrame, flags: DataFrame | None = None, encoding: str = "rzcobs", version: str = "4", timestamp: str | None = None, check: bool = True) -> Catalog:
    """The driver's catalog of a format table, of any version without ``check``; at most 65,536 rows of either table are taken in, as many as indices exist, and more raise."""
    if check:
        check_version(version)
    rows = table.select("idx", "tag", "level", "format").limit((1 << 16) + 2).collect()
    stamps = [r for r in rows if r.tag == "timestamp"]
    if len(stamps) > 1:
        raise CatalogError("two timestamp formats")
    entries: dict[int, Entry] = {}
    for r in rows:
        if r.tag == "timestamp":
            continue
        if not 0 <= r.idx < 1 << 16 or r.idx in entries:
            raise CatalogError(f"index {r.idx} repeats or is out of range")
        entries[r.idx] = Entry(r.tag, r.format, r.level)
    known = {}
    kinds = flags.limit((1 << 16) + 1).collect() if flags is not None else []
    if len(kinds) > 1 << 16:
        raise CatalogError("more than 65,536 kinds of bit flags")
    for r in kinds:
        key = (r.ident, r.package, r.disambig) + ((r.crate_name,) if r.crate_name is not None else ())
        known[key] = [(f["name"], int.from_bytes(f["value"], "little")) for f in r.flags]
    return Catalog(entries, stamps[0].format if stamps else timestamp, encoding, version, known)


def to_table(spark: SparkSession, catalog: Catalog) -> DataFrame:
    """The catalog as FORMAT_TABLE, to write as parquet or JSON and load again."""
    rows = [(i, e.tag, e.level, e.format, None) for i, e in sorted(catalog.entries.items())]
    if catalog.timestamp is not None:
        rows.append((0, "timestamp", None, catalog.timestamp, None))
    return spark.createDataFrame(rows, FORMAT_TABLE)
