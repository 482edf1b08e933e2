"""A log-stream view of ``events``: one frame an event, with levels and module paths by the event's type."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.codec import Catalog, Entry, stream_encode
from ..functions.hints import little_endian

TYPES = ["view", "click", "signup", "purchase", "error"]  # in order of level
_STATEMENT = "id={=u64} user={=u32:04} type={=istr}"
LEVELS = ["trace", "debug", "info", "warn", "error"]
CATALOG = Catalog({1 + i: Entry(LEVELS[i], _STATEMENT, i) for i in range(5)} | {11 + i: Entry("str", t) for i, t in enumerate(TYPES)}, timestamp="{=u64:iso8601ms}")
#: Source lines of the statements; index 5 has none.
LOCATIONS = [(1 + i, f"/work/src/app/{t}/mod.rs", 10 * (i + 1), f"app::{t}::handle") for i, t in enumerate(TYPES[:4])]
EPOCH_MS = "timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts) div 1000"

VIEW_SQL = """(select event_id, user_id, event_type, epoch_us(ts) // 1000 as ms, epoch_us(ts) as us,
  case event_type when 'view' then 0 when 'click' then 1 when 'signup' then 2 when 'purchase' then 3 else 4 end as level,
  'app::' || event_type || '::s' || (user_id % 3) as module from events)"""


def logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_id, user_id, event_type, ms, us, level, module)."""
    level = F.array_position(F.array(*map(F.lit, TYPES)), F.col("event_type")).cast("int") - 1
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", "event_type", F.expr(EPOCH_MS).alias("ms"), F.expr(EPOCH_MS.removesuffix(" div 1000")).alias("us"))
    module = F.concat(F.lit("app::"), "event_type", F.lit("::s"), (F.col("user_id") % 3).cast("string"))
    return events.withColumn("level", level).withColumn("module", module)


def raw_frames(log: DataFrame) -> DataFrame:
    """``log`` and its wire frames, encoded with Columns: index, timestamp, arguments."""
    level, kind = F.col("level") + 1, F.col("level") + 11
    return log.withColumn("frame", F.concat(little_endian(level, 2), little_endian(F.col("ms"), 8), little_endian(F.col("event_id"), 8), little_endian(F.col("user_id"), 4), little_endian(kind, 2)))


def streams(frames: DataFrame, column: str = "frame", size: int = 1000) -> DataFrame:
    """(stream_id, bytes): the frames of each ``size`` event numbers, zero-framed, as one byte stream, in order."""
    parts = int(frames.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = frames.select(F.expr(f"event_id div {size}").alias("stream_id"), "event_id", column).repartition(parts, "stream_id")

    def run(group: pa.Table) -> pa.Table:
        raw = group.sort_by("event_id").column(column).to_pylist()
        return pa.table({"stream_id": group.column("stream_id")[:1], "bytes": pa.array([stream_encode([x for x in raw if x is not None])], pa.binary())})

    return spread.groupBy("stream_id").applyInArrow(run, "stream_id long, bytes binary")
