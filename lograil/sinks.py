"""Sinks: text lines, and JSON lines with a schema-version header."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators.locate import module_path

SCHEMA_VERSION = 1
JSON_FRAME = "data string, host_timestamp long, level string, location struct<file:string,line:long,module_path:struct<crate_name:string,modules:array<string>,function:string>>, target_timestamp string"


def json_frame(message: Column, level_name: Column, timestamp: Column, file: Column, line: Column, module: Column, host_timestamp: Column) -> Column:
    """A frame as JSON with its keys in the order of JSON_FRAME and nulls kept; the host's time (ns) is given, so that results repeat."""
    location = F.struct(file.alias("file"), line.cast("long").alias("line"), module_path(module).alias("module_path"))
    row = F.struct(message.alias("data"), host_timestamp.cast("long").alias("host_timestamp"), level_name.alias("level"), location.alias("location"), F.coalesce(timestamp, F.lit("")).alias("target_timestamp"))
    return F.to_json(row, {"ignoreNullFields": "false"})


def now_ns() -> Column:
    return F.unix_micros(F.current_timestamp()) * 1000


def write_json(lines: DataFrame, path: str, column: str = "json") -> None:
    """JSON lines below ``path/frames`` and the header line below ``path/schema``: files of many tasks have no first line in common."""
    spark = lines.sparkSession
    spark.createDataFrame([(f'{{"schema_version":{SCHEMA_VERSION}}}',)], "value string").coalesce(1).write.text(f"{path}/schema")
    lines.select(F.col(column).alias("value")).write.text(f"{path}/frames")


def read_json(spark: SparkSession, path: str) -> DataFrame:
    header = spark.read.json(f"{path}/schema", "schema_version int").first()
    if header is None or header.schema_version != SCHEMA_VERSION:
        raise ValueError(f"schema version {header and header.schema_version}; this reads {SCHEMA_VERSION}")
    return spark.read.json(f"{path}/frames", JSON_FRAME)


def write_text(lines: DataFrame, path: str, column: str = "line", origin: str | None = None) -> None:
    """Text lines; with a column of origins, device and host records go to folders of their own."""
    if origin is None:
        lines.select(F.col(column).alias("value")).write.text(path)
    else:
        lines.select(F.col(column).alias("value"), F.col(origin).alias("origin")).write.partitionBy("origin").text(path)
