"""Operator 7, substring dedup by seed and extend.

1. One scan selects winnowed anchors (see ``repeats``) and sends (anchor, hash of its
   context, document, place) over a packed exchange.  Documents are joined on equal
   anchors: an anchor of one document only is dropped.
2. A seed's context is the words within reach, MIN_WORDS - GRAM before it and
   MIN_WORDS from it on.  Seeds of different documents whose contexts are equal
   extend both ways through all of it: nothing more need be compared.
3. Of each other context one seed (two, of different documents, where it has them)
   fetches its words.  The seeds of an anchor extend both ways against each other at
   once: an extension of i words to the left and MIN_WORDS - i to the right is shared
   with another document when the hash of just those words is.
4. The extensions of neighbouring seeds overlap; their union per document are the
   maximal repeats of at least MIN_WORDS words.

Every step is linear in the number of seeds: a passage that n documents share costs
n entries, not n^2 pairs, so nothing is capped.

Defined results.  Null and empty texts and texts of fewer than MIN_WORDS words have no
spans.  Rows with a null doc_id take no part.  Rows that share a doc_id are one
document: repeats among them do not count.  Repeats inside one document do not count.
Spans that touch are one.  ``other_doc_id`` is the least of the documents that the
extensions met first.  An empty table gives no rows.  Long texts are taken whole;
extra columns are ignored.  Words count from 0 in each text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .exchange import SCHEMA, Packer, batches, part_by, parts_of, runs, unpack
from .memory import task
from .repeats import INTERVAL, MIN_WORDS, REACH, WIDTH, pack_intervals, plain, reach, several_docs, spans, winnow
from .storage import Tables, cut
from .text import U64, PrefixHash, Words, mix

SEED = ["<u8", "<u8", "<i8", "<i4", "u1", "u1"]
CONTEXT = ["<u8", "<i8", "<i4", "u1", "u1", f"V{4 * WIDTH}"]
_MET = "part int, block binary, doc_id long, anchor long, place int"


def _seeds(parts: int):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = Packer(SEED)
        for batch, texts in batches(it):
            words = Words(texts)
            at, anchor = winnow(words)
            if not len(at):
                continue
            left, right = reach(words, at)
            context = PrefixHash(words.hashes).span(at - left, at + right) ^ mix(left.astype(U64))
            row = words.doc[at]
            doc = batch.column(0).to_numpy(zero_copy_only=False)[row]
            yield from pack.add(part_by(anchor, parts), anchor, context, doc, at - words.first[row], left, right)
        yield from pack.flush()

    return run


def _met(parts: int):
    """Intervals of seeds whose contexts meet, as blocks; and the seeds that must fetch theirs."""

    def rows(part, block, doc, anchor, place):
        return pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(block, pa.binary()), pa.array(doc, pa.int64()), pa.array(anchor, pa.int64()), pa.array(place, pa.int32())], names=["part", "block", "doc_id", "anchor", "place"])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = [x for batch in it for x in batch.column(1).to_pylist()]
        if not blocks:
            return
        anchor, context, doc, place, left, right = unpack(blocks, SEED)
        del blocks
        some, _ = several_docs(doc, anchor)
        anchor, context, doc, place, left, right = (x[some] for x in (anchor, context, doc, place, left, right))
        whole, other = several_docs(doc, context, anchor)
        pack = Packer(INTERVAL)
        yield_from = list(pack_intervals(pack, parts, doc[whole], (place - left.astype(np.int32))[whole], (place + right.astype(np.int32))[whole], other[whole])) + list(pack.flush())
        for b in yield_from:
            n = b.num_rows
            yield rows(b.column(0), b.column(1), [None] * n, [None] * n, [None] * n)
        # anchors with more than one context go on: all seeds of contexts of one document, two seeds of the others
        order = np.lexsort((place, doc, context, anchor))
        anchor, context, doc, place, whole = (x[order] for x in (anchor, context, doc, place, whole))
        start, end = runs(anchor)
        mixed = np.repeat(context[start] != context[end - 1], end - start)
        first, last = runs(anchor, context)
        two = np.zeros(len(anchor), bool)
        two[first] = two[last - 1] = True  # the least and the greatest document
        on = mixed & (~whole | two)
        n = int(on.sum())
        yield rows(np.full(n, -1, np.int32), [None] * n, doc[on], anchor[on].view(np.int64), place[on])

    return run


def contexts(words: Words, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(n, WIDTH) 32 bit words around anchors, 0 where the text ends; and the reaches."""
    left, right = reach(words, at)
    column = np.arange(WIDTH) - REACH
    inside = (column >= -left[:, None]) & (column < right[:, None])
    place = np.where(inside, at[:, None] + column, 0)
    token = np.maximum((words.hashes >> U64(32)).astype(np.uint32), np.uint32(1))
    return np.where(inside, token[place], np.uint32(0)).astype("<u4"), left, right


def wanted_places(words: Words, lists: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, word indices and anchors of the places that rows ask for, as far as the text still has the anchor there."""
    row = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
    place = np.array([w["place"] for x in lists for w in x], dtype=np.int64)
    anchor = np.array([w["anchor"] for x in lists for w in x], dtype=np.int64).view(U64)
    at, grams = winnow(words)
    key = words.first[row] + place
    k = np.minimum(np.searchsorted(at, key), max(0, len(at) - 1))
    ok = (at[k] == key) & (grams[k] == anchor) & (words.doc[np.minimum(key, len(words.doc) - 1)] == row) if len(at) else np.zeros(len(row), bool)
    return row[ok], key[ok], anchor[ok]


def _fetch(parts: int):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = Packer(CONTEXT)
        for batch, texts in batches(it):
            words = Words(texts)
            row, at, anchor = wanted_places(words, batch.column(2).to_pylist())
            if len(at):
                tokens, left, right = contexts(words, at)
                doc = batch.column(0).to_numpy(zero_copy_only=False)[row]
                yield from pack.add(part_by(anchor, parts), anchor, doc, at - words.first[row], left, right, tokens.view(CONTEXT[5]).ravel())
        yield from pack.flush()

    return run


def extend(anchor, doc, left, right, tokens) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Entries that share an extension, the words it has before the anchor's first word and from there on, and a document that shares it."""
    n = len(anchor)
    weights = mix(np.arange(1, WIDTH + 1, dtype=U64)) | U64(1)
    most, least, other = np.full(n, -1), np.full(n, WIDTH), np.full(n, -1, np.int64)
    for i in range(REACH + 1):
        able = np.flatnonzero((left >= i) & (right >= MIN_WORDS - i))
        if len(able) < 2:
            continue
        part = tokens[able, REACH - i : REACH - i + MIN_WORDS].astype(U64)
        h = mix((mix(part) * weights[:MIN_WORDS]).sum(axis=1, dtype=U64))
        many, who = several_docs(doc[able], h, anchor[able])
        hit = able[many]
        most[hit] = i
        least[hit] = np.minimum(least[hit], i)
        other[hit] = np.where(other[hit] < 0, who[many], np.minimum(other[hit], who[many]))
    hit = np.flatnonzero(most >= 0)
    return hit, most[hit], MIN_WORDS - least[hit], other[hit]


def _extend(parts: int):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = [x for batch in it for x in batch.column(1).to_pylist()]
        if not blocks:
            return
        anchor, doc, place, left, right, tokens = unpack(blocks, CONTEXT)
        del blocks
        pack = Packer(INTERVAL)
        order = np.argsort(anchor, kind="stable")
        cuts = np.searchsorted(anchor[order], np.unique(anchor[order])[:: 4096] if len(order) else anchor)
        for a, b in zip(cuts, [*cuts[1:], len(order)]):  # some thousand anchors at a time
            k = order[a:b]
            hit, before, after, other = extend(anchor[k], doc[k], left[k], right[k], tokens[k].view("<u4").reshape(-1, WIDTH))
            yield from pack_intervals(pack, parts, doc[k][hit], place[k][hit] - before, place[k][hit] + after, other)
        yield from pack.flush()

    return run


def meet(docs: DataFrame, parts: int) -> DataFrame:
    """Seeds joined on equal anchors: blocks of intervals (part >= 0), and the seeds that must fetch their contexts (part < 0)."""
    return docs.mapInArrow(task(_seeds(parts)), SCHEMA).repartitionById(parts, "part").mapInArrow(task(_met(parts)), _MET)


def substring_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, start_word, end_word, n_words, other_doc_id): the maximal spans that other documents repeat."""
    docs, parts, tables = plain(docs), parts_of(docs.sparkSession), Tables(docs.sparkSession)
    met = tables.write("met", meet(docs, parts))
    wanted = met.where("part < 0").groupBy("doc_id").agg(F.collect_list(F.struct("place", "anchor")).alias("wanted"))
    fetched = docs.join(wanted, "doc_id").select("doc_id", "text", "wanted").mapInArrow(task(_fetch(parts)), SCHEMA)
    extended = fetched.repartitionById(parts, "part").mapInArrow(task(_extend(parts)), SCHEMA)
    found = cut(spans(met.where("part >= 0").select("part", "block").union(extended), parts))
    tables.drop()
    return found


def op7_substring_dedup(spark, sf_dir: str) -> DataFrame:
    return substring_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
