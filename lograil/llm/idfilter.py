"""A bitmap of fixed size that says which ids may be among a set: keeps the texts of others out of a shuffle.

``2**BITS`` bits (16 MB) whatever the input, so it may be broadcast at any size.  An id
of the set always passes; others pass by chance, the more the larger the set is (at
2**27 ids about two thirds).  The join that follows decides, so results don't depend on it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .memory import task

BITS, PAGE = 27, 16


def _place(*ids: Column) -> Column:
    return F.pmod(F.xxhash64(*ids), F.lit(1 << BITS)).cast("int")


def _pages(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in it:
        out = []
        for places in batch.column(1):
            flags = np.zeros(1 << PAGE, bool)
            flags[places.values.to_numpy(zero_copy_only=False)] = True
            out.append(np.packbits(flags).tobytes())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["page", "bits"])


def bitmap(places: DataFrame) -> Broadcast:
    """The bits at the places (column p: integers below 2**BITS), broadcast as bytes.

    At most 2**(BITS - PAGE) rows of 2**PAGE bits come to the driver.
    """
    places = places.select(F.shiftright("p", PAGE).alias("page"), F.col("p").bitwiseAND(F.lit((1 << PAGE) - 1)).alias("at"))
    pages = places.groupBy("page").agg(F.collect_set("at").alias("at")).mapInArrow(task(_pages), "page int, bits binary").toArrow()
    found = np.zeros(1 << (BITS - 3), np.uint8)
    for page, bits in zip(pages.column("page").to_pylist(), pages.column("bits").to_pylist()):
        found[page << (PAGE - 3) : (page + 1) << (PAGE - 3)] = np.frombuffer(bits, np.uint8)
    return places.sparkSession.sparkContext.broadcast(found)


def are_set(bits: np.ndarray, p: np.ndarray) -> np.ndarray:
    return (bits[p >> 3] >> (7 - (p & 7)).astype(np.uint8)) & 1 == 1


def maybe_in(ids: DataFrame, column: str):
    """A function of a column: false only if its value, as a 64 bit integer, is none of ``ids``.  Runs ``ids``."""
    shared = bitmap(ids.select(_place(F.col(column).cast("long")).alias("p")))

    @F.arrow_udf("boolean")
    def may(at: pa.Array) -> pa.Array:
        return pa.array(are_set(shared.value, at.to_numpy(zero_copy_only=False)))

    return lambda id_column: may(_place(F.col(id_column).cast("long")))
