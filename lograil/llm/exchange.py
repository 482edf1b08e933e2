"""Packed exchange: numeric columns cross the shuffle as a few binary blocks.

A map task hands over numpy columns and the target partition of each entry; one
row per (map flush, target partition) travels, holding the columns back to back.
The reduce side gets numpy columns again.  Against one row per entry this saves
the row header and the JVM's per-row work, which dominate for entries of a few
integers, and it is an ordinary shuffle: lost executors are recomputed as ever.

An empty input gives an exchange without rows; the reducer then sees no call.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .memory import task

U64 = np.uint64
#: A flush briefly needs about five times this.
FLUSH_BYTES = 12 << 20
#: Text handled at once: its arrays of 64 bits stay below the size that the workers map by themselves, and in the cache.
CHARS = 100_000
SCHEMA = "part int, block binary"
_ARROW = pa.schema([("part", pa.int32()), ("block", pa.binary())])


def parts_of(spark: SparkSession) -> int:
    """As many target partitions as the session's shuffles have."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def part_by(hashes: np.ndarray, n: int) -> np.ndarray:
    """Target partition by equal ranges of a 64 bit hash."""
    return (((hashes >> U64(32)) * U64(n)) >> U64(32)).astype(np.int32)


class Packer:
    """Collects entries of one fixed layout and turns them into blocks, each headed by ``tag``."""

    def __init__(self, dtypes: list[str], tag: bytes = b""):
        self.tag = tag
        self.dtypes = [np.dtype(d) for d in dtypes]
        self.width = sum(d.itemsize for d in self.dtypes)
        self.held: list[tuple[np.ndarray, list[np.ndarray]]] = []
        self.bytes = 0

    def add(self, part: np.ndarray, *columns: np.ndarray) -> Iterator[pa.RecordBatch]:
        if len(part):
            self.held.append((part, [np.asarray(c).astype(d, copy=False) for c, d in zip(columns, self.dtypes)]))
            self.bytes += len(part) * self.width
        if self.bytes >= FLUSH_BYTES:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if not self.held:
            return
        part = np.concatenate([p for p, _ in self.held])
        order = np.argsort(part, kind="stable")
        part = part[order]
        columns = [np.concatenate([c[i] for _, c in self.held])[order] for i in range(len(self.dtypes))]
        self.held, self.bytes = [], 0
        cuts = np.flatnonzero(np.diff(part, prepend=-1))
        blocks = [self.tag + b"".join(np.ascontiguousarray(c[a:b]).tobytes() for c in columns) for a, b in zip(cuts, [*cuts[1:], len(part)])]
        yield pa.RecordBatch.from_arrays([pa.array(part[cuts], pa.int32()), pa.array(blocks, pa.binary())], schema=_ARROW)


def unpack(blocks: Iterable[bytes], dtypes: list[str]) -> list[np.ndarray]:
    kinds = [np.dtype(d) for d in dtypes]
    width = sum(d.itemsize for d in kinds)
    held: list[list[np.ndarray]] = [[] for _ in kinds]
    for block in blocks:
        n, at = len(block) // width, 0
        for k, d in enumerate(kinds):
            held[k].append(np.frombuffer(block, dtype=d, count=n, offset=at))
            at += n * d.itemsize
    return [np.concatenate(h) if h else np.zeros(0, dtype=d) for h, d in zip(held, kinds)]


def batches(it: Iterator[pa.RecordBatch], text: str = "text", chars: int = CHARS) -> Iterator[tuple[pa.RecordBatch, list]]:
    """Arrow batches cut so that each has about ``chars`` bytes of text, with the texts; one row may exceed it."""
    for batch in it:
        texts = batch.column(batch.schema.get_field_index(text))
        if not len(texts):
            continue
        sizes = np.array([len(x) if x is not None else 0 for x in texts.cast(pa.large_binary()).to_pylist()], dtype=np.int64) if texts.null_count else np.diff(np.frombuffer(texts.buffers()[1], dtype=np.int64 if pa.types.is_large_string(texts.type) else np.int32)[texts.offset : texts.offset + len(texts) + 1])
        group = np.cumsum(sizes) // chars
        cuts = np.flatnonzero(np.diff(group, prepend=-1))
        for a, b in zip(cuts, [*cuts[1:], len(texts)]):
            part = batch.slice(a, b - a)
            yield part, texts.slice(a, b - a).to_pylist()


def reduce_blocks(df: DataFrame, dtypes: list[str], function: Callable[..., Iterator[pa.RecordBatch]], schema: str, parts: int | None = None) -> DataFrame:
    """Sends blocks to their partitions and calls ``function(*columns)`` once in each that has any."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = [x for batch in it for x in batch.column(1).to_pylist()]
        if blocks:
            columns = unpack(blocks, dtypes)
            del blocks
            yield from function(*columns)

    return df.repartitionById(parts or parts_of(df.sparkSession), "part").mapInArrow(task(run), schema)


def runs(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of runs of equal keys in sorted columns."""
    n = len(keys[0])
    if not n:
        z = np.zeros(0, dtype=np.int64)
        return z, z
    new = np.zeros(n, dtype=bool)
    new[0] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    starts = np.flatnonzero(new)
    return starts, np.append(starts[1:], n)
