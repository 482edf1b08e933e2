"""Operator 1, line dedup: fuzzy lines by MinHash.

Lines are the pieces of a text between ``\\n``.  Two lines are alike when the
Jaccard similarity of their sets of ``SHINGLE`` character shingles is at least
``threshold``; of each connected component of alike lines the first line, by
(doc_id, line number), stays and the rest go.

1. One scan hashes each line, makes its character-shingle signature and sends
   (band, line hash) and (line hash, place, count) over packed exchanges; a line that
   a batch repeats is sent once by its hash, and its other places are spread evenly.
2. Lines that share a band form buckets; the buckets of one least line are one group,
   and groups of more than ``chunk`` lines are dealt into pairs of chunks.  Only lines of
   groups fetch their text, once each, from documents that a bitmap lets through.
   Each group is verified by exact Jaccard, skipping pairs that verified pairs already
   connect and pairs that bitmaps of the shingles exclude.  No group is capped.
3. Distributed union-find over the verified pairs, then every place of a line
   whose component has another place joins its component's keeper.

Banding: 16 bands of 6 rows find a pair of Jaccard 0.8 with probability 0.992,
of 0.85 with 0.9996.  Exact repeats are found always (64 bit hashes: among n
different lines about n^2/2^65 pairs are taken as equal).

Defined results.  Blank lines (white space alone) take no part and stay.  A line
shorter than a shingle has itself as its only shingle.  Null texts have no lines.
Rows with null doc_id take no part.  Rows that share doc_id and text are one
document; rows that share only doc_id are judged each by its own text.
Ties go to the least (doc_id, line number).  An empty table gives no
rows.  Extra columns are ignored, whatever their names.  Very long lines are
compared whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .exchange import SCHEMA, Packer, batches, part_by, parts_of, runs, unpack
from .idfilter import maybe_in
from .memory import task
from .names import column, unused
from .storage import Tables, cut
from .text import PrefixHash, codepoints, minhash, mix, shingles32
from .verify import Sets, dealt, verified

SHINGLE, BANDS, ROWS, THRESHOLD, CHUNK, SEED = 6, 16, 6, 0.8, 1000, 20_251
U64 = np.uint64
#: Lines whose repeats are merged before they are sent, and lines whose signatures are not sent twice.
HELD, RECENT = 1 << 17, 1 << 12
_SPACE = np.zeros(0x110000, dtype=bool)
_SPACE[[c for c in range(0x3001) if chr(c).isspace()]] = True


class Lines:
    """The lines of a batch that are not blank: row, number in the text, span in cps, 64 bit hash."""

    def __init__(self, texts: list[str | None]):
        self.cps, offsets = codepoints(texts)
        self.offsets = offsets
        n = len(self.cps)
        breaks = np.flatnonzero(self.cps == 10)
        rows = np.flatnonzero(np.diff(offsets) > 0)
        starts = np.unique(np.concatenate([offsets[rows], breaks + 1]))
        starts = starts[starts < n]  # a break that ends its text opens an empty line, which is not kept
        row = np.searchsorted(offsets, starts, side="right") - 1
        stop = np.append(breaks, n)
        ends = np.minimum(stop[np.searchsorted(stop, starts)], offsets[row + 1])
        number = np.arange(len(starts)) - np.searchsorted(row, row)
        solid = np.concatenate([[0], np.cumsum(~_SPACE[self.cps])])
        full = solid[ends] > solid[starts]
        self.starts, self.ends, self.row, self.number = starts[full], ends[full], row[full], number[full]
        self.hashes = PrefixHash(self.cps).span(self.starts, self.ends)

    def signatures(self, which: np.ndarray) -> np.ndarray:
        starts, ends = self.starts[which], self.ends[which]
        windows = shingles32(self.cps, SHINGLE)
        short = ends - starts < SHINGLE
        windows[starts[short]] = self.hashes[which][short].astype(np.uint32)
        stops = np.where(short, starts + 1, ends - SHINGLE + 1)
        edge = np.zeros(len(windows) + 1, dtype=np.int8)
        edge[starts] += 1
        edge[stops] -= 1
        valid = np.cumsum(edge[:-1], dtype=np.int8).astype(bool)
        bounds = np.concatenate([[0], np.cumsum(stops - starts)])
        return minhash(windows[valid], bounds, BANDS * ROWS, SEED)


def _bands(signatures: np.ndarray) -> np.ndarray:
    """(n, BANDS) hashes of the bands."""
    s = signatures.reshape(len(signatures), BANDS, ROWS).astype(U64)
    h = np.broadcast_to(np.arange(1, BANDS + 1, dtype=U64) * U64(0x9E3779B97F4A7C15), s.shape[:2]).copy()
    for r in range(ROWS):
        h = mix(h ^ (s[:, :, r] * U64(0xD6E8FEB86659FD93)))
    return h


BAND, PLACE = ["<u8", "<u8"], ["<u8", "<i8", "<i4", "<i8", "<i8"]
MET = "kind int, h long, member long, doc_id long, line_no int, text_hash long, places long, first boolean"
_MET = pa.schema([("kind", pa.int32()), ("h", pa.int64()), ("member", pa.int64()), ("doc_id", pa.int64()), ("line_no", pa.int32()), ("text_hash", pa.int64()), ("places", pa.int64()), ("first", pa.bool_())])


def _scan(parts: int):
    """Blocks B: (band, line); P: (line, first place, places) of some ``HELD`` lines; R: their other places."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands, places, others = Packer(BAND, b"B"), Packer(PLACE, b"P"), Packer(PLACE, b"R")
        held, recent = [], np.zeros(0, U64)

        def flush() -> Iterator[pa.RecordBatch]:
            h, doc, line, text = (np.concatenate(x) for x in zip(*held))
            order = np.lexsort((line, doc, h))
            start, end = runs(h[order])
            k = order[start]
            yield from places.add(part_by(h[k], parts), h[k], doc[k], line[k], text[k], end - start)
            k = np.delete(order, start)
            spread = mix(mix(doc[k].view(U64)) ^ line[k].astype(U64))  # not by line: one may be a third of all
            yield from others.add(part_by(spread, parts), h[k], doc[k], line[k], text[k], np.ones(len(k), np.int64))

        for batch, texts in batches(it):
            lines = Lines(texts)
            if not len(lines.hashes):
                continue
            doc = np.asarray(batch.column(0).to_numpy(zero_copy_only=False), dtype=np.int64)[lines.row]
            held.append((lines.hashes, doc, lines.number, batch.column(2).to_numpy()[lines.row]))
            new, first = np.unique(lines.hashes, return_index=True)
            fresh = ~np.isin(new, recent, assume_unique=True)
            which = np.sort(first[fresh])
            b = _bands(lines.signatures(which)).ravel()
            yield from bands.add(part_by(b, parts), b, np.repeat(lines.hashes[which], BANDS))
            if len(recent) + len(which) > RECENT:
                recent = new
            else:
                recent = np.concatenate([recent, new[fresh]])
            if sum(len(x[0]) for x in held) > HELD:
                yield from flush()
                held.clear()
        if held:
            yield from flush()
        for pack in (bands, places, others):
            yield from pack.flush()

    return run


def _rows(kind: int, n: int, **columns: np.ndarray) -> pa.RecordBatch:
    columns["kind"] = np.full(n, kind, np.int32)
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in _MET], schema=_MET)


def _meet(bands: list[np.ndarray], places: list[np.ndarray], others: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """kind 0: places by line; 1: members of a bucket, under its least one; 2: other places."""
    band, h = bands
    order = np.lexsort((h, band))
    band, h = band[order], h[order]
    new, _ = runs(band, h)
    band, h = band[new], h[new]
    start, end = runs(band)
    size = end - start
    least, h = np.repeat(h[start], size)[np.repeat(size > 1, size)], h[np.repeat(size > 1, size)]
    order = np.lexsort((h, least))
    new, _ = runs(least[order], h[order])  # buckets of several bands
    least, h = least[order][new], h[order][new]
    for lo in range(0, len(h), 1 << 18):
        k = slice(lo, lo + (1 << 18))
        yield _rows(1, len(h[k]), h=least[k].view(np.int64), member=h[k].view(np.int64))
    for kind, (h, doc, line, text, count) in ((0, places), (2, others)):
        order = np.lexsort((line, doc, h))
        h, doc, line, text, count = h[order], doc[order], line[order], text[order], count[order]
        start, end = runs(h)
        total = np.repeat(np.add.reduceat(count, start), end - start) if len(h) else count
        first = np.zeros(len(h), bool)
        first[start] = kind == 0
        for lo in range(0, len(h), 1 << 18):
            k = slice(lo, lo + (1 << 18))
            yield _rows(kind, len(h[k]), h=h[k].view(np.int64), doc_id=doc[k], line_no=line[k], text_hash=text[k], places=total[k], first=first[k])


def _reduce(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    blocks = [x for batch in it for x in batch.column(1).to_pylist()]
    if blocks:
        yield from _meet(*(unpack((x[1:] for x in blocks if x[:1] == tag), kinds) for tag, kinds in ((b"B", BAND), (b"P", PLACE), (b"R", PLACE))))


def shingle_sets(lines: list[str]) -> Sets:
    """The character shingles of each line; a shorter line is one itself."""
    cps, offsets = codepoints(lines)
    prefix = PrefixHash(cps)
    sizes = np.maximum(np.diff(offsets) - SHINGLE + 1, np.diff(offsets) > 0)
    row = np.repeat(np.arange(len(lines)), sizes)
    at = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + offsets[:-1][row]
    return Sets(row, prefix.span(at, np.minimum(at + SHINGLE, offsets[1:][row])), len(lines))


def _sets(it: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, Sets]]:
    for batch, lines in batches(it, "line"):
        yield batch.column(0).to_numpy(), batch.column(1).to_numpy(), shingle_sets(lines)


def _fetch(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (text, wanted lines): (h, line), each once."""
    for batch, texts in batches(it):
        wanted = batch.column(1)
        sizes = np.diff(np.asarray(wanted.offsets))
        flat = wanted.flatten()
        h, number = flat.field(0).to_numpy(), flat.field(1).to_numpy().astype(np.int64)
        lines = Lines(texts)
        row = np.repeat(np.arange(len(texts)), sizes)
        keys, key = (lines.row.astype(np.int64) << 32) + lines.number, (row << 32) + number
        at = np.minimum(np.searchsorted(keys, key), max(0, len(keys) - 1))
        # rows may repeat a doc_id with another text: only lines that hash as they should go on
        at = at[(keys[at] == key) & (lines.hashes[at].view(np.int64) == h)] if len(keys) else at[:0]
        _, one = np.unique(lines.hashes[at], return_index=True)
        at = at[one]
        text = [texts[r][s - o : e - o] for r, s, e, o in zip(lines.row[at].tolist(), lines.starts[at].tolist(), lines.ends[at].tolist(), lines.offsets[lines.row[at]].tolist())]
        yield pa.RecordBatch.from_arrays([pa.array(lines.hashes[at].view(np.int64)), pa.array(text, pa.string())], names=["h", "line"])


def line_dedup(docs: DataFrame, threshold: float = THRESHOLD, chunk: int = CHUNK) -> DataFrame:
    """(doc_id, line_no, keep_doc_id, keep_line_no, text_hash): every line that goes, the line that stays for it, and xxhash64 of its text."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).where("doc_id is not null and text is not null")
    parts, tables = parts_of(spark), Tables(spark)
    scanned = docs.withColumn("text_hash", F.xxhash64("text")).mapInArrow(task(_scan(parts)), SCHEMA)
    met = tables.write("met", scanned.repartitionById(parts, "part").mapInArrow(task(_reduce), MET))
    first = met.where("kind = 0 and first").select("h", "doc_id", "line_no", "places")
    members = tables.write("members", met.where("kind = 1").select("h", F.col("member")).distinct())
    wanted = members.select(F.col("member").alias("h")).distinct().join(first, "h")
    wanted = tables.write("wanted", wanted.groupBy("doc_id").agg(F.collect_list(F.struct("h", "line_no")).alias("wanted")))
    fetched = docs.where(maybe_in(wanted, "doc_id")("doc_id")).join(wanted, "doc_id").select("text", "wanted").mapInArrow(task(_fetch), "h long, line string")
    groups = dealt(members, "h", "member", chunk).join(fetched.dropDuplicates(["h"]).withColumnRenamed("h", "member"), "member").select("group", "member", "line")
    edges = groups.repartition("group").sortWithinPartitions("group", "member").mapInArrow(task(verified(_sets, threshold, once=True)), "a long, b long")
    labels = components(edges)
    keeper = first.join(labels.withColumnRenamed("node", "h"), "h", "left").where("root is not null or places > 1").withColumn("root", F.coalesce("root", "h"))
    best = keeper.groupBy("root").agg(F.min(F.struct("doc_id", "line_no")).alias("k"))
    keeper = keeper.join(best, "root").select("h", F.col("k.doc_id").alias("keep_doc_id"), F.col("k.line_no").alias("keep_line_no"))
    places = met.where("kind <> 1").select("h", "doc_id", "line_no", "text_hash")
    gone = places.join(keeper, "h").where("doc_id <> keep_doc_id or line_no <> keep_line_no")
    gone = cut(gone.select("doc_id", "line_no", "keep_doc_id", "keep_line_no", "text_hash"))
    tables.drop()
    return gone


def op1_line_dedup(spark, sf_dir: str) -> DataFrame:
    return line_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("text_hash")


def without_lines(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """``docs`` with the lines of ``gone`` taken out and n_chars, where there is one, set anew; documents that lose all their lines go."""
    columns = docs.columns
    doc, text_hash, lost = unused(docs, "_doc", "_hash", "_gone")
    lists = gone.groupBy(F.col("doc_id").alias(doc), F.col("text_hash").alias(text_hash)).agg(F.collect_set("line_no").alias(lost))
    text = F.col("text").cast("string")
    plain = docs.join(lists, (F.col("doc_id").cast("long") == F.col(doc)) & (F.xxhash64(text) == F.col(text_hash)), "left")
    kept = F.filter(F.split(text, "\n"), lambda x, i: ~F.array_contains(lost, i))
    out = plain.withColumn("text", F.when(F.col(lost).isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))).where(F.col(lost).isNull() | F.col("text").rlike(r"(?U)\S"))
    if "n_chars" in columns:
        out = out.withColumn("n_chars", F.when(F.col(lost).isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long")))
    return out.select(*(column(c) for c in columns))
