"""Source locations of frames: a broadcast left join behind an all-or-nothing gate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def coverage_gate(indices: DataFrame, locations: DataFrame) -> bool:
    """Whether every index has a location: one missing drops the locations of all.  Both sides have at most 65,536 rows."""
    return indices.select("idx").distinct().join(locations.select("idx"), "idx", "left_anti").isEmpty()


#: The variable that a log statement leaves in debug sections.
STATEMENT = "LOG_STATEMENT"
#: An index has 16 bits: a dictionary by index has no more rows.
MAX_ROWS = 1 << 16


def bounded(table: DataFrame) -> DataFrame:
    """``table``, marked for broadcast if it has no more rows than there are indices; larger ones are left to a shuffled join."""
    return F.broadcast(table) if table.limit(MAX_ROWS + 1).count() <= MAX_ROWS else table


def with_locations(frames: DataFrame, locations: DataFrame, indices: DataFrame | None = None, working_dir: str | None = None) -> DataFrame:
    """``frames`` and (file, line, module), null where unknown; paths below ``working_dir`` become relative."""
    table = locations.select("idx", "file", "line", "module")
    if indices is not None and not coverage_gate(indices, locations):
        table = table.where("false")
    if working_dir:
        head = working_dir.rstrip("/") + "/"
        table = table.withColumn("file", F.when(F.col("file").startswith(head), F.expr(f"substring(file, {len(head) + 1})")).otherwise(F.col("file")))
    return frames.join(bounded(table), "idx", "left")


def locations_of(variables: DataFrame, symbols: DataFrame, statement: str = STATEMENT) -> DataFrame:
    """(idx, file, line, module) of log statements.

    variables: (name, linkage_name, file, line, module) of a debug section's variables, of which those
    named ``statement`` are taken by their linkage name; symbols: (raw_symbol, idx) of a format table.
    Variables whose symbol the linker dropped have no index and are left out; two of one index are an error.
    """
    marked = variables.where(F.col("name") == statement).select("linkage_name", "file", "line", "module")
    found = marked.join(bounded(symbols.select(F.col("raw_symbol").alias("linkage_name"), "idx")), "linkage_name")
    return unique_locations(found.select("idx", "file", "line", "module"))


def joined_path(folder: Column, directory: Column, name: Column) -> Column:
    """A source file's path: later absolute parts replace what comes before them, null and empty parts are left out."""
    out = None
    for part in (folder, directory, name):
        part = F.nullif(part, F.lit(""))
        out = part if out is None else F.when(part.isNull(), out).when(out.isNull() | part.startswith("/"), part).otherwise(F.concat(F.regexp_replace(out, "/+$", ""), F.lit("/"), part))
    return out


def unique_locations(locations: DataFrame, key: str = "idx") -> DataFrame:
    """``locations``, checked: two rows of one key are an error when the result is computed."""
    counted = locations.groupBy(key).agg(F.count("*").alias("_n"), *(F.first(c).alias(c) for c in locations.columns if c != key))
    return counted.where(F.when(F.col("_n") == 1, F.lit(True)).otherwise(F.raise_error(F.lit("repeated location")).cast("boolean"))).select(*locations.columns)


def module_path(module: Column) -> Column:
    """struct<crate_name, modules, function>; null for paths of fewer than two parts."""
    parts = F.split(module, "::")
    n = F.size(parts)
    return F.when(n >= 2, F.struct(parts[0].alias("crate_name"), F.slice(parts, 2, n - 2).alias("modules"), F.element_at(parts, -1).alias("function")))
