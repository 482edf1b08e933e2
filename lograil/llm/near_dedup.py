"""Operator 4, MinHash near-dedup: chosen-path set similarity join.

A document is the set of its ``SHINGLE``-word shingles (lower-cased words; a
shorter text is one shingle of all its words).  Documents are near copies when
the Jaccard similarity of their sets is at least ``threshold``; of each connected
component of near copies the least doc_id stays.

The join follows Christiani and Pagh's chosen path as made practical in CPSJoin
(Christiani, Pagh, Sivertsen 2018): a document is embedded as ``COORDINATES``
minwise tokens; at a node of a random tree each coordinate is selected with
probability 1/(threshold * COORDINATES), by a hash of the node's path, and the
documents part by their token there, so that a document follows about
1/threshold branches.  ``TREES`` independent trees are grown.  Paths depend on the
document alone, so a map task walks the first levels by itself, as many as take
documents of random content below ``NODE`` a node; one exchange then brings nodes
together.  Nodes of at most ``NODE`` documents are compared exhaustively on 256
bit sketches.  In larger nodes the documents that resemble the node on average
(the "brute force" rule of the paper) are compared with all and leave it; the
rest branches on, level by level, until no large node is left.

Pairs whose sketches allow the threshold (three standard deviations below it) are
candidates.  Candidates' components fetch their texts once, from documents that a bitmap
of fixed size lets through (``idfilter``), and every pair of a component is verified by
exact Jaccard unless verified pairs already connect it.
Components of more than ``CHUNK`` documents are dealt into chunks, and all pairs of
chunks are verified as separate groups, so none is capped and no task holds one whole.

Recall at similarity 0.55: a tree of depth 2 finds a pair with probability 0.57,
eight trees with 0.998; the tests measure at least 0.97 against brute force.

Defined results.  Null, empty and word-less texts have no near copies.  Rows with
a null doc_id take no part and stay.  Rows that share a doc_id are one document,
alike to what any of their texts is alike to; they stay or go together.  Texts of
equal words are copies without further look.  An empty table gives no rows.  Very
long texts are taken whole.  Extra columns are ignored, and kept by ``keep_one``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .exchange import SCHEMA, Packer, batches, part_by, parts_of, runs, unpack
from .idfilter import maybe_in
from .memory import task
from .storage import cut
from .text import U64, PrefixHash, Words, minhash, mix
from .verify import Labels, Sets, dealt, verified

SHINGLE, THRESHOLD, TREES, NODE, CHUNK, SEED = 3, 0.55, 8, 1000, 2000, 404
COORDINATES, SKETCH = 128, 256
MARGIN = 3 * 2 * math.sqrt((0.5 + THRESHOLD / 2) * (0.5 - THRESHOLD / 2) / SKETCH)
#: Documents of unrelated content part about thus much a level.
SPREAD = 30
DOC = ["<u8", "<i8", "V32", f"V{4 * COORDINATES}"]
ENTRY = ["<u8", "<i8", "V32"]
PAIR = ["<i8", "<i8"]


class Shingles:
    """The shingle sets of a batch: hashes, and the bounds of each row's; ``words`` hashes the row's word sequence."""

    def __init__(self, texts: list[str | None]):
        w = Words(texts)
        at, hashes = w.grams(SHINGLE)
        count = np.diff(w.first)
        few = np.flatnonzero((count > 0) & (count < SHINGLE))
        whole = PrefixHash(w.hashes)
        self.words = whole.span(w.first[:-1], w.first[1:])
        if len(few):
            at = np.concatenate([at, w.first[few]])
            hashes = np.concatenate([hashes, self.words[few]])
            order = np.argsort(at, kind="stable")
            at, hashes = at[order], hashes[order]
        self.hashes = hashes
        self.bounds = np.searchsorted(at, w.first)
        self.some = np.flatnonzero(np.diff(self.bounds) > 0)

    def embed(self) -> tuple[np.ndarray, np.ndarray]:
        """Of each row that has words: tokens (n, COORDINATES) and sketch (n, 4) of 64 bits."""
        s = minhash((self.hashes >> U64(32)).astype(np.uint32), self.bounds, SKETCH, SEED)[self.some]
        bits = ((s * np.uint32(0x9E3779B1)) >> np.uint32(31)).astype(np.uint8)
        return np.ascontiguousarray(s[:, :COORDINATES]), np.packbits(bits, axis=1).view("<u8")


def _raw(a: np.ndarray, kind: str) -> np.ndarray:
    return np.ascontiguousarray(a).view(kind).ravel()


def _scan(parts: int):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = Packer(DOC)
        for batch, texts in batches(it):
            s = Shingles(texts)
            if not len(s.some):
                continue
            tokens, sketch = s.embed()
            doc = batch.column(0).to_numpy(zero_copy_only=False)[s.some]
            key = s.words[s.some]
            yield from pack.add(part_by(key, parts), key, doc, _raw(sketch, DOC[2]), _raw(tokens, DOC[3]))
        yield from pack.flush()

    return run


def step(doc: np.ndarray, path: np.ndarray, tokens: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """One level down: (index into tokens, path) of all branches that the entries follow."""
    bound = U64(min(2**64 - 1, int(2**64 / (threshold * COORDINATES))))
    salt = mix(np.arange(1, COORDINATES + 1, dtype=U64))
    docs, paths = [], []
    for lo in range(0, len(doc), 8192):
        d, p = doc[lo : lo + 8192], path[lo : lo + 8192]
        entry, c = np.nonzero(mix(p[:, None] ^ salt[None, :]) < bound)
        docs.append(d[entry])
        paths.append(mix(p[entry] ^ mix((c.astype(U64) << U64(32)) + tokens[d[entry], c])))
    return (np.concatenate(docs), np.concatenate(paths)) if docs else (doc[:0], path[:0])


def walk(tokens: np.ndarray, depth: int, trees: int, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(row, path) after ``depth`` levels of each tree.  A root selects ceil(1/threshold) coordinates, never none."""
    rows, everyone = [], np.arange(len(tokens))
    if depth == 0:
        return everyone, np.zeros(len(tokens), U64)
    rng = np.random.default_rng(SEED)
    docs, paths = [], []
    for tree in range(trees):
        for c in rng.choice(COORDINATES, size=math.ceil(1 / threshold), replace=False):
            docs.append(everyone)
            paths.append(mix(mix(np.array([tree + 1], U64)) ^ mix((U64(c) << U64(32)) + tokens[:, c].astype(U64))))
    doc, path = np.concatenate(docs), np.concatenate(paths)
    for _ in range(depth - 1):
        doc, path = step(doc, path, tokens, threshold)
    return doc, path


def _branch(parts: int, depth: int, trees: int, threshold: float):
    """Copies of equal words become pairs; of each set of copies one document walks the trees."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = [x for batch in it for x in batch.column(1).to_pylist()]
        if not blocks:
            return
        key, doc, sketch, tokens = unpack(blocks, DOC)
        del blocks
        order = np.lexsort((doc, key))
        start, end = runs(key[order])
        pairs, entries = Packer(PAIR, b"P"), Packer(ENTRY, b"E")
        a, b = np.repeat(doc[order[start]], end - start), doc[order]
        yield from pairs.add(part_by(mix(b[a != b].view(U64)), parts), a[a != b], b[a != b])
        one = order[start]
        doc, sketch, tokens = doc[one], sketch[one], tokens[one].view("<u4").reshape(-1, COORDINATES)
        for lo in range(0, len(doc), 4096):
            d, path = walk(tokens[lo : lo + 4096], depth, trees, threshold)
            yield from entries.add(part_by(mix(path), parts), path, doc[lo + d], sketch[lo + d])
        yield from pairs.flush()
        yield from entries.flush()

    return run


def _alike(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Estimated similarity by sketches (n, 4)."""
    return 1 - 2 * np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64) / SKETCH


def compare(path: np.ndarray, doc: np.ndarray, sketch: np.ndarray, threshold: float, node: int) -> tuple[list[tuple[int, int]], np.ndarray, np.ndarray]:
    """Links of candidate pairs, and the (doc, path) entries of large nodes that branch on."""
    order = np.lexsort((*sketch.T, doc, path))
    path, doc, sketch = path[order], doc[order], sketch[order]
    new, _ = runs(path, doc, *sketch.T)  # a document has each of its texts here
    path, doc, sketch = path[new], doc[new], sketch[new]
    start, end = runs(path)
    size = np.repeat(end - start, end - start)
    on_doc, on_path = [], []
    docs, at = np.unique(doc, return_inverse=True)
    found = Labels(len(docs))
    least = threshold - MARGIN
    small = np.flatnonzero((size > 1) & (size <= node))
    for gap in range(1, node):
        i = small[small + gap < len(path)]
        i = i[path[i] == path[i + gap]]
        if not len(i):
            break
        small = i
        i = i[found.fresh(at[i], at[i + gap])]
        i = i[_alike(sketch[i], sketch[i + gap]) >= least]
        if len(i):
            found.add(at[i], at[i + gap])
    for a, b in zip(start[end - start > node], end[end - start > node]):
        bits = np.unpackbits(sketch[a:b].view(np.uint8), axis=1)
        ones, n = bits.sum(axis=0, dtype=np.int64), b - a
        agree = np.where(bits == 1, ones - 1, n - ones - 1).mean(axis=1) / max(1, n - 1)
        del bits
        dense = 2 * agree - 1 >= 0.9 * threshold
        members, todo = np.arange(a, b), np.flatnonzero(dense) + a
        while len(todo):
            # of each component the next dense member; members of one component need no comparison with each other
            label = found.label[at[todo]]
            _, heads = np.unique(label, return_index=True)
            for i in todo[heads].tolist():
                j = members[found.label[at[members]] != found.label[at[i]]]
                j = j[_alike(sketch[j], sketch[i][None, :]) >= least]
                if len(j):
                    found.add(at[j], np.full(len(j), at[i]))
            todo = np.delete(todo, heads)
            label = found.label[at[members]]
            if len(todo) and (label == label[0]).all():
                break
        on_doc.append(doc[members[~dense]])
        on_path.append(path[members[~dense]])
    empty = np.zeros(0, np.int64)
    on_doc, on_path = np.concatenate([empty, *on_doc]), np.concatenate([empty.view(U64), *on_path])
    order = np.lexsort((on_doc, on_path))
    new, _ = runs(on_path[order], on_doc[order])
    return [(int(docs[x]), int(docs[y])) for x, y in found.made], on_doc[order][new], on_path[order][new]


def _meet(threshold: float, node: int):
    """kind 0: copies; 1: candidate pairs; 2: a document and a node that branches on."""

    def out(kind: int, a, b) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), kind, np.int32)), pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["kind", "a", "b"])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = [x for batch in it for x in batch.column(1).to_pylist()]
        a, b = unpack((x[1:] for x in blocks if x[:1] == b"P"), PAIR)
        yield out(0, a, b)
        path, doc, sketch = unpack((x[1:] for x in blocks if x[:1] == b"E"), ENTRY)
        del blocks
        links, on_doc, on_path = compare(path, doc, sketch.view("<u8").reshape(-1, 4), threshold, node)
        yield out(1, np.array([x for x, _ in links], np.int64), np.array([y for _, y in links], np.int64))
        yield out(2, on_doc, on_path.view(np.int64))

    return run


def _onward(parts: int, threshold: float):
    """Rows (doc_id, text, paths) of large nodes: one level down."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entries = Packer(ENTRY, b"E")
        for batch, texts in batches(it):
            s = Shingles(texts)
            if not len(s.some):
                continue
            tokens, sketch = s.embed()
            doc, paths = batch.column(0).to_numpy(zero_copy_only=False)[s.some], batch.column(2).take(pa.array(s.some))
            count = np.array([len(x) for x in paths])
            d, path = step(np.repeat(np.arange(len(doc)), count), paths.flatten().to_numpy(zero_copy_only=False).view(U64), tokens, threshold)
            yield from entries.add(part_by(mix(path), parts), path, doc[d], _raw(sketch, "V32")[d])
        yield from entries.flush()

    return run


def _sets(it: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, Sets]]:
    for batch, texts in batches(it):
        s = Shingles(texts)
        yield batch.column(0).to_numpy(), batch.column(1).to_numpy(), Sets(np.repeat(np.arange(len(texts)), np.diff(s.bounds)), s.hashes, len(texts))


def near_groups(docs: DataFrame, threshold: float = THRESHOLD, trees: int = TREES, node: int = NODE, chunk: int = CHUNK) -> DataFrame:
    """(doc_id, keep_doc_id) of every document in a group of near copies, the one that stays included."""
    spark, parts = docs.sparkSession, parts_of(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).where("doc_id is not null and text is not null")
    depth = max(0, math.ceil(math.log(max(1, docs.count()) / node) / math.log(SPREAD)))
    blocks = docs.mapInArrow(task(_scan(parts)), SCHEMA).repartitionById(parts, "part").mapInArrow(task(_branch(parts, depth, trees, threshold)), SCHEMA)
    kinds = "kind int, a long, b long"
    met = cut(blocks.repartitionById(parts, "part").mapInArrow(task(_meet(threshold, node)), kinds))
    copies, candidates = met.where("kind = 0"), met.where("kind = 1")
    while not met.where("kind = 2").isEmpty():
        on = cut(met.where("kind = 2").groupBy(F.col("a").alias("doc_id")).agg(F.collect_set("b").alias("paths")))
        some = docs.where(maybe_in(on, "doc_id")("doc_id"))
        blocks = some.join(on, "doc_id").select("doc_id", "text", "paths").mapInArrow(task(_onward(parts, threshold)), SCHEMA)
        met = cut(blocks.repartitionById(parts, "part").mapInArrow(task(_meet(threshold, node)), kinds))
        candidates = candidates.union(met.where("kind = 1"))
    labels = cut(components(candidates.select("a", "b")).withColumnRenamed("node", "doc_id"))
    groups = dealt(labels, "root", "doc_id", chunk)
    fetched = docs.where(maybe_in(labels, "doc_id")("doc_id")).join(groups, "doc_id").select("group", "doc_id", "text")
    edges = fetched.repartition("group").sortWithinPartitions("group", "doc_id").mapInArrow(task(verified(_sets, threshold)), "a long, b long")
    return components(edges.union(copies.select("a", "b"))).select(F.col("node").alias("doc_id"), F.col("root").alias("keep_doc_id"))


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with one document of each group of near copies."""
    gone = near_groups(docs, **options).where("doc_id <> keep_doc_id").select("doc_id")
    return docs.join(gone, docs["doc_id"].cast("long") == gone["doc_id"], "left_anti")


def op4_near_dedup(spark, sf_dir: str) -> DataFrame:
    """(doc_id, keep_doc_id) of the documents that go."""
    return near_groups(spark.read.parquet(f"{sf_dir}/documents.parquet")).where("doc_id <> keep_doc_id")
