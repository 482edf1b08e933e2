"""What operators 5 and 7 share: the repeats they look for, winnowed anchors, and the union of found intervals.

A repeat is a run of at least ``MIN_WORDS`` equal words (lower-cased runs of letters
and digits) that two different documents have.  The result of either operator is, for
each document, the maximal spans of words covered by repeats.

Anchors: of each ``MIN_WORDS - GRAM + 1`` consecutive windows of ``GRAM`` words the
one of least hash (the rightmost of equals) is selected (winnowing, Schleimer et al.,
SIGMOD 2003).  Two documents that share MIN_WORDS words select the same windows in
them, so every repeat holds an anchor that both have: no repeat is missed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .exchange import Packer, part_by, runs, unpack
from .memory import task
from .text import U64, PrefixHash, Words, mix

MIN_WORDS, GRAM = 50, 16
#: Place of an anchor's first word in its context of 2 * MIN_WORDS - GRAM words.
REACH = MIN_WORDS - GRAM
WIDTH = REACH + MIN_WORDS
INTERVAL = ["<i8", "<i4", "<i4", "<i8"]
SPANS = "doc_id long, start_word int, end_word int, n_words int, other_doc_id long"


def winnow(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Word indices of the anchors of a batch, sorted, and their hashes."""
    window = REACH + 1
    n = len(words.hashes)
    if n < MIN_WORDS:
        return np.zeros(0, np.int64), np.zeros(0, U64)
    grams = PrefixHash(words.hashes).span(np.arange(n - GRAM + 1), np.arange(GRAM, n + 1))
    low = U64((1 << 26) - 1)
    key = (grams & ~low) | (low - np.arange(len(grams), dtype=U64))
    span, least = 1, key
    while span * 2 <= window:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    rest = window - span
    if rest:
        least = np.minimum(least[:-rest], least[rest:])
    whole = words.doc[: n - MIN_WORDS + 1] == words.doc[MIN_WORDS - 1 :]
    chosen = np.zeros(len(grams), bool)
    chosen[(low - (least[whole] & low)).astype(np.int64)] = True
    at = np.flatnonzero(chosen)
    return at, mix(grams[at])  # least hashes crowd at the low end: mixed again, equal ranges of them part evenly


def reach(words: Words, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many words of its context an anchor has before it, and from its first word on."""
    row = words.doc[at]
    return np.minimum(REACH, at - words.first[row]), np.minimum(MIN_WORDS, words.first[row + 1] - at)


def several_docs(doc: np.ndarray, *keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of entries by equal keys: whether their group has more than one document, and another document of it."""
    order = np.lexsort((doc, *keys))
    start, end = runs(*(k[order] for k in keys))
    d = doc[order]
    size = end - start
    first, last = np.repeat(d[start], size), np.repeat(d[end - 1], size)
    many, other = np.empty(len(doc), bool), np.empty(len(doc), np.int64)
    many[order] = first != last
    other[order] = np.where(d == first, last, first)
    return many, other


def pack_intervals(pack: Packer, parts: int, doc, start, end, other) -> Iterator[pa.RecordBatch]:
    yield from pack.add(part_by(mix(doc.view(U64)), parts), doc, start, end, other)


def union_of(doc: np.ndarray, start: np.ndarray, end: np.ndarray, other: np.ndarray) -> list[np.ndarray]:
    """Overlapping and touching intervals of a document as one; the least other document stands for all."""
    order = np.lexsort((start, doc))
    doc, start, end, other = doc[order], start[order].astype(np.int64), end[order].astype(np.int64), other[order]
    base = np.cumsum(np.diff(doc, prepend=doc[:1]) != 0) * (1 << 33)
    high = np.maximum.accumulate(end + base)
    new = np.ones(len(doc), bool)
    new[1:] = (start + base)[1:] > high[:-1]
    at = np.flatnonzero(new)
    return [doc[at], start[at].astype(np.int32), np.maximum.reduceat(end, at).astype(np.int32), np.minimum.reduceat(other, at)]


def spans(blocks: DataFrame, parts: int) -> DataFrame:
    """The maximal spans by document, from blocks of intervals."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [x for batch in it for x in batch.column(1).to_pylist()]
        if held:
            doc, start, end, other = union_of(*unpack(held, INTERVAL))
            yield pa.RecordBatch.from_arrays([pa.array(doc), pa.array(start), pa.array(end), pa.array(end - start), pa.array(other)], names=["doc_id", "start_word", "end_word", "n_words", "other_doc_id"])

    return blocks.select("part", "block").repartitionById(parts, "part").mapInArrow(task(run), SPANS)


def plain(docs: DataFrame) -> DataFrame:
    """The rows that take part."""
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).where("doc_id is not null and text is not null")
