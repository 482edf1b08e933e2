"""Operator 5, suffix-array dedup: a common-prefix-aware distributed merge sort.

The suffixes sorted are all those at winnowed anchors (see ``repeats``): a sparse suffix
array, in which every repeat of MIN_WORDS words has a suffix.  A suffix is a string of
symbols: its anchor (hash of the first GRAM words, so that ranges of it part evenly),
its next MIN_WORDS words, then the REACH words before it, nearest first; symbols
beyond these cannot change the result.

1. Distinguishing prefixes (prefix doubling merge sort, Bingmann, Sanders and Schimek
   2020): anchors are counted by a packed exchange of hashes, and a bitmap of fixed
   size says which may have several documents.  Any other suffix is told apart
   by its anchor, so its anchor is all of it that is sent and sorted.
2. Each map task sorts its suffixes and sends the run front-coded: the number of
   symbols shared with the suffix before it, and the other symbols.  Of suffixes of a
   run that are equal in full two, of different documents, stand for all; the rest are
   intervals already.
3. Each reduce task owns a range of anchors and merges its runs with a loser tree
   (Ng and Kakehi, 2008).  Every head knows how many symbols it shares with the last
   winner, the losers on the path how many with it; heads that differ in that are
   decided by it, and others are compared from there on.  Known prefixes
   are never compared again, and the merge yields the common-prefix array as well.
4. Suffixes in a stretch of the array with at least MIN_WORDS - i common words and the
   same i words before them, from two documents, share MIN_WORDS words; their union
   by document are the maximal repeats.

Every step is linear in the suffixes, apart from sorting: nothing is capped.

Defined results: those of operator 7.  Null and empty texts and texts of fewer than
MIN_WORDS words have no spans.  Rows with a null doc_id take no part.  Rows that share
a doc_id are one document; repeats inside one document do not count.  Spans that touch
are one.  Ties in the order are broken by run.  An empty table gives no rows.  Long
texts are taken whole; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame

from .exchange import FLUSH_BYTES, SCHEMA, Packer, batches, part_by, parts_of, reduce_blocks, runs
from .idfilter import BITS, are_set, bitmap
from .memory import task
from .repeats import INTERVAL, MIN_WORDS, REACH, pack_intervals, plain, several_docs, spans, winnow
from .substring_dedup import contexts
from .text import U64, Words, mix

SYMBOLS = 2 + MIN_WORDS + REACH
KEY = 4 * SYMBOLS
SLICE = 50_000


def suffix_keys(anchor: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    """(n, SYMBOLS) big-endian symbols, which sort as bytes do."""
    head = np.stack([(anchor >> U64(32)).astype(np.uint32), anchor.astype(np.uint32)], axis=1)
    return np.concatenate([head, tokens[:, REACH:], tokens[:, :REACH][:, ::-1]], axis=1).astype(">u4")


def front_coded(keys: np.ndarray, size: np.ndarray, anchor: np.ndarray, doc: np.ndarray, place: np.ndarray, left: np.ndarray, right: np.ndarray, parts: int, settled: list | None = None) -> Iterator[tuple[int, bytes]]:
    """The sorted run of these suffixes, of ``size`` symbols each, as (target partition, front-coded block).

    ``settled`` gets (doc, start, end, other) of suffixes that are equal in full in several documents, of which two go on.
    """
    keys = keys.astype(">u4")  # parts of a run that are joined lose their order of bytes
    keys[np.arange(SYMBOLS) >= size[:, None]] = 0
    order = np.lexsort((doc, np.unique(np.ascontiguousarray(keys).view(f"V{KEY}").ravel(), return_inverse=True)[1]))
    keys, size, doc, place, left, right, anchor = (x[order] for x in (keys, size, doc, place, left, right, anchor))
    if settled is not None and len(keys):
        new = np.ones(len(keys), bool)
        new[1:] = (keys[1:] != keys[:-1]).any(axis=1) | (size[1:] < SYMBOLS) | (left[1:] != left[:-1]) | (right[1:] != right[:-1])
        start = np.flatnonzero(new)
        end = np.append(start[1:], len(keys))
        several = doc[start] != doc[end - 1]
        for a, b in zip(start[several & (end - start > 2)], end[several & (end - start > 2)]):
            k = np.arange(a, b)
            settled.append((doc[k], place[k].astype(np.int64) - left[k], place[k].astype(np.int64) + right[k], np.where(doc[k] == doc[a], doc[b - 1], doc[a])))
            new[b - 1] = True
        drop = np.zeros(len(keys), bool)
        inside = np.repeat(several & (end - start > 2), end - start)
        drop[inside] = ~new[inside]
        keys, size, doc, place, left, right, anchor = (x[~drop] for x in (keys, size, doc, place, left, right, anchor))
    part = part_by(anchor, parts)
    same = keys[1:] == keys[:-1]
    common = np.zeros(len(keys), np.uint8)
    common[1:] = np.minimum(np.where(same.all(axis=1), SYMBOLS, (~same).argmax(axis=1)), np.minimum(size[1:], size[:-1]))
    cuts = np.flatnonzero(np.diff(part, prepend=-1))
    common[cuts] = 0
    columns = [doc.astype("<i8"), place.astype("<i4"), left.astype("u1"), right.astype("u1"), size.astype("u1"), common]
    for a, b in zip(cuts, [*cuts[1:], len(keys)]):
        at = np.arange(SYMBOLS)
        rest = keys[a:b][(at >= common[a:b, None]) & (at < size[a:b, None])]
        yield int(part[a]), np.array([b - a], "<u4").tobytes() + b"".join(c[a:b].tobytes() for c in columns) + rest.tobytes()


def read_run(block: bytes) -> Iterator[tuple[int, bytes, tuple[int, int, int, int]]]:
    """(symbols shared with the suffix before, suffix, (doc, place, left, right)) of a front-coded block."""
    n, at, columns = int(np.frombuffer(block, "<u4", 1)[0]), 4, []
    for kind in ("<i8", "<i4", "u1", "u1", "u1", "u1"):
        columns.append(np.frombuffer(block, kind, n, at).tolist())
        at += n * np.dtype(kind).itemsize
    key = b""
    for doc, place, left, right, size, common in zip(*columns):
        end = at + 4 * (size - common)
        key = key[: 4 * common] + block[at:end]
        at = end
        yield common, key, (doc, place, left, right)


class LoserTree:
    """Merges sorted runs of (symbols shared with the one before, string, value); yields the same.

    ``shared[r]``: symbols that the head of run r shares with the last string yielded
    if r has just moved up, else with the string that it lost to.
    """

    def __init__(self, runs: list[Iterable]):
        self.runs = [iter(r) for r in runs]
        self.size = 1 << max(0, len(runs) - 1).bit_length()
        self.heads: list = [None] * self.size
        self.shared = [0] * self.size
        self.losers = [0] * self.size
        self.compared = 0
        for r in range(len(runs)):
            self._next(r)

    def _next(self, r: int) -> None:
        head = next(self.runs[r], None)
        self.heads[r] = head
        if head is not None:
            self.shared[r] = head[0]

    def _play(self, a: int, b: int) -> tuple[int, int]:
        """Winner and loser."""
        x, y = self.heads[a], self.heads[b]
        if x is None or y is None:
            return (b, a) if x is None else (a, b)
        common, other = self.shared[a], self.shared[b]
        if common != other:
            return (a, b) if common > other else (b, a)
        p, q = x[1][4 * common :], y[1][4 * common :]
        if p == q:
            win, lose = (a, b) if a < b else (b, a)
            new = common + len(p) // 4
        else:
            n = min(len(p), len(q))
            differ = int.from_bytes(p[:n]) ^ int.from_bytes(q[:n])
            new = common + (n - (differ.bit_length() + 7) // 8) // 4
            win, lose = (a, b) if p < q else (b, a)
        self.compared += new - common + 1
        self.shared[lose] = new
        return win, lose

    def __iter__(self) -> Iterator[tuple[int, bytes, tuple]]:
        size, losers = self.size, self.losers
        winners = [0] * size + list(range(size))
        for node in range(size - 1, 0, -1):
            winners[node], losers[node] = self._play(winners[2 * node], winners[2 * node + 1])
        win = winners[1] if size > 1 else 0
        while (head := self.heads[win]) is not None:
            yield self.shared[win], head[1], head[2]
            self._next(win)
            node = (win + size) >> 1
            while node:
                win, losers[node] = self._play(win, losers[node])
                node >>= 1


def shared_extensions(common: np.ndarray, before: np.ndarray, doc: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of sorted suffixes: those with a repeat, its words before and from the anchor on, and a document that shares it.

    common: symbols shared with the suffix before; ``before``: (n, REACH) words before
    the anchor, nearest first.
    """
    n = len(doc)
    words = np.maximum(common.astype(np.int64) - 2, 0)
    words[common < 2] = -1
    most, least, other = np.full(n, -1), np.full(n, REACH + 1), np.full(n, -1, np.int64)
    hashes = np.zeros(n, U64)
    for i in range(REACH + 1):
        if i:
            hashes = mix(hashes ^ (before[:, i - 1].astype(U64) + U64(i << 32)))
        stretch = np.cumsum(words < MIN_WORDS - i)
        able = np.flatnonzero((left >= i) & (right >= MIN_WORDS - i))
        if len(able) < 2:
            continue
        many, who = several_docs(doc[able], hashes[able], stretch[able])
        hit = able[many]
        most[hit] = i
        least[hit] = np.minimum(least[hit], i)
        other[hit] = np.where(other[hit] < 0, who[many], np.minimum(other[hit], who[many]))
    hit = np.flatnonzero(most >= 0)
    return hit, most[hit], MIN_WORDS - least[hit], other[hit]


ANCHOR = ["<u8", "<i8"]
#: Places whose anchors are merged before they are sent.
HELD = 1 << 19


def _ends(anchor: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each anchor the least and the greatest document."""
    order = np.lexsort((doc, anchor))
    anchor, doc = anchor[order], doc[order]
    start, end = runs(anchor)
    keep = np.unique(np.concatenate([start, end - 1]))
    return anchor[keep], doc[keep]


def _anchors(parts: int):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack, held, size = Packer(ANCHOR), [], 0
        for batch, texts in batches(it):
            words = Words(texts)
            at, anchor = winnow(words)
            held.append((anchor, batch.column(0).to_numpy(zero_copy_only=False)[words.doc[at]].astype(np.int64)))
            size += len(at)
            if size > HELD:
                anchor, doc = _ends(*(np.concatenate(x) for x in zip(*held)))
                yield from pack.add(part_by(anchor, parts), anchor, doc)
                held, size = [], 0
        if held:
            anchor, doc = _ends(*(np.concatenate(x) for x in zip(*held)))
            yield from pack.add(part_by(anchor, parts), anchor, doc)
        yield from pack.flush()

    return run


def _bit(anchor: np.ndarray) -> np.ndarray:
    return (mix(anchor) >> U64(64 - BITS)).astype(np.int64)


def _repeated(anchor: np.ndarray, doc: np.ndarray) -> Iterator[pa.RecordBatch]:
    many, _ = several_docs(doc, anchor)
    yield pa.RecordBatch.from_arrays([pa.array(np.unique(_bit(anchor[many])).astype(np.int32))], names=["p"])


def _runs(parts: int, repeated: Broadcast):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        pack = Packer(INTERVAL, b"I")

        def flush() -> Iterator[pa.RecordBatch]:
            settled: list = []
            blocks = list(front_coded(*(np.concatenate(x) for x in zip(*held)), parts, settled))
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in blocks], pa.int32()), pa.array([b"S" + b for _, b in blocks], pa.binary())], names=["part", "block"])
            if settled:
                yield from pack_intervals(pack, parts, *(np.concatenate(x) for x in zip(*settled)))

        for batch, texts in batches(it):
            words = Words(texts)
            at, anchor = winnow(words)
            if not len(at):
                continue
            row = words.doc[at]
            several = are_set(repeated.value, _bit(anchor))
            tokens, left, right = contexts(words, at)
            doc = batch.column(0).to_numpy(zero_copy_only=False)[row].astype(np.int64)
            held.append((suffix_keys(anchor, tokens), np.where(several, SYMBOLS, 2), anchor, doc, at - words.first[row], left, right))
            size += len(at) * KEY
            if size >= FLUSH_BYTES:
                yield from flush()
                held, size = [], 0
        if held:
            yield from flush()
        yield from pack.flush()

    return run


def _merge(parts: int):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks, pack = [], Packer(INTERVAL)
        for batch in it:
            for part, block in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if block[:1] == b"S":
                    blocks.append(block[1:])
                else:  # an interval already
                    yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([block[1:]], pa.binary())], names=["part", "block"])
        held: list[tuple] = []

        def done() -> Iterator[pa.RecordBatch]:
            common = np.array([x[0] for x in held])
            common[0] = 0
            keys = np.frombuffer(b"".join(x[1].ljust(KEY, b"\0") for x in held), ">u4").reshape(-1, SYMBOLS)
            doc, place, left, right = np.array([x[2] for x in held], np.int64).T
            hit, before, after, other = shared_extensions(common, keys[:, 2 + MIN_WORDS :], doc, left, right)
            yield from pack_intervals(pack, parts, doc[hit], place[hit] - before, place[hit] + after, other)

        for entry in LoserTree([read_run(b) for b in blocks]):
            alone = len(entry[1]) == 8  # told apart by its anchor; what follows it shares no anchor with what came before, so common prefixes stay right
            if entry[0] < 2 and len(held) >= SLICE:  # another anchor
                yield from done()
                held = []
            if not alone:
                held.append(entry)
        if held:
            yield from done()
        yield from pack.flush()

    return run


def suffix_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, start_word, end_word, n_words, other_doc_id): the maximal spans that other documents repeat."""
    docs, parts = plain(docs), parts_of(docs.sparkSession)
    counted = reduce_blocks(docs.mapInArrow(task(_anchors(parts)), SCHEMA), ANCHOR, _repeated, "p int", parts)
    sorted_runs = docs.mapInArrow(task(_runs(parts, bitmap(counted))), SCHEMA)
    return spans(sorted_runs.repartitionById(parts, "part").mapInArrow(task(_merge(parts)), SCHEMA), parts)


def op5_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    return suffix_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
