"""Exact verification of candidate groups: the links of Jaccard similarity among the sets of each group.

Vectorised over many groups at once.  Members of a group are taken by rising size and
compared at distance 1, 2, ... in that order; a pair is left out when its sizes exclude
the threshold (then so do all larger distances), when verified links connect it already,
or when the bitmaps of its sets differ in more places than sets of the threshold can
(an upper bound, so nothing is lost).  n members that are all alike cost about n
comparisons, n unlike ones n^2/2 comparisons of bitmaps; ``dealt`` bounds n.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import UnionFind
from .exchange import runs

U64 = np.uint64
LOW = U64((1 << 40) - 1)
#: Elements of sets handled at once.
ELEMENTS = 1 << 20


class Sets:
    """Sets of 64 bit hashes, cut to 40 bits: sorted values, and the bounds of each set's."""

    def __init__(self, row: np.ndarray, hashes: np.ndarray, n: int):
        keys = (row.astype(U64) << U64(40)) | (hashes >> U64(24))
        keys.sort()
        if len(keys):
            keys = keys[np.concatenate([[True], keys[1:] != keys[:-1]])]
        self.bounds = np.searchsorted(keys, np.arange(n + 1, dtype=U64) << U64(40))
        self.values = keys & LOW

    @classmethod
    def joined(cls, parts: list[Sets]) -> Sets:
        out = cls.__new__(cls)
        base = np.cumsum([0, *(len(p.values) for p in parts)])
        out.bounds = np.concatenate([np.zeros(1, np.int64), *(p.bounds[1:] + b for p, b in zip(parts, base))])
        out.values = np.concatenate([np.zeros(0, U64), *(p.values for p in parts)])
        return out

    def take(self, which: np.ndarray) -> Sets:
        out = Sets.__new__(Sets)
        at, sizes = self.places(which)
        out.bounds, out.values = np.concatenate([[0], np.cumsum(sizes)]), self.values[at]
        return out

    def sizes(self) -> np.ndarray:
        return np.diff(self.bounds)

    def places(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the values of these sets are, one after another, and how many each has."""
        sizes = (self.bounds[1:] - self.bounds[:-1])[which]
        ends = np.cumsum(sizes)
        return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(self.bounds[:-1][which] - (ends - sizes), sizes), sizes

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many values each pair of sets shares."""
        at, sizes = self.places(np.stack([a, b], axis=1).ravel())
        keys = (np.repeat(np.arange(len(a), dtype=U64), sizes.reshape(-1, 2).sum(axis=1)) << U64(40)) | self.values[at]
        keys.sort()
        return np.bincount((keys[1:][keys[1:] == keys[:-1]] >> U64(40)).astype(np.int64), minlength=len(a))

    def bitmaps(self, which: np.ndarray, width: int) -> np.ndarray:
        """(n, width / 64): a bit is set if a value falls on it."""
        out = np.zeros((len(which), width // 8), np.uint8)
        step = max(1, (1 << 24) // width)
        for lo in range(0, len(which), step):
            some = which[lo : lo + step]
            at, sizes = self.places(some)
            flags = np.zeros(len(some) * width, bool)
            flags[np.repeat(np.arange(len(some)) * width, sizes) + (self.values[at] & U64(width - 1)).astype(np.int64)] = True
            out[lo : lo + step] = np.packbits(flags.reshape(len(some), width), axis=1)
        return out.view(U64)


class Labels:
    """Components of numbers 0 to n-1 that grow by arrays of links, with the links that made them."""

    def __init__(self, n: int):
        self.label = np.arange(n)
        self.made: list[tuple[int, int]] = []

    def fresh(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        return self.label[i] != self.label[j]

    def add(self, i: np.ndarray, j: np.ndarray) -> None:
        x, y = self.label[i], self.label[j]
        pairs = np.unique((np.minimum(x, y).astype(np.int64) << 32) | np.maximum(x, y))
        sets = UnionFind()
        for k in pairs.tolist():
            if sets.union(k >> 32, k & 0xFFFFFFFF):
                self.made.append((k >> 32, k & 0xFFFFFFFF))
        to = np.arange(len(self.label))
        old = list(sets.parent)
        if old:
            to[old] = [sets.find(k) for k in old]
            self.label = to[self.label]


def links(group: np.ndarray, which: np.ndarray, sets: Sets, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of sets whose links form the components that all pairs of one group with Jaccard >= threshold form.

    group: the group of each entry; which: the index of its set.  Empty sets are like none.
    """
    sizes = sets.sizes()
    order = np.lexsort((which, sizes[which], group))
    order = order[sizes[which[order]] > 0]
    g, s = group[order], which[order]
    if len(g) > 1:
        keep = np.concatenate([[True], (g[1:] != g[:-1]) | (s[1:] != s[:-1])])
        g, s = g[keep], s[keep]
    size, n, labels = sizes[s], len(g), Labels(len(sizes))
    most = (1 - threshold) / (1 + threshold)
    active, gap, bits, row = np.arange(max(0, n - 1)), 1, None, None
    while len(active):
        i = active[active < n - gap]
        i = i[g[i] == g[i + gap]]
        i = i[size[i] >= threshold * size[i + gap]]
        if gap & (gap - 1) == 0 and len(i):  # groups that are one component are done
            start, end = runs(g)
            first = np.repeat(labels.label[s[start]], end - start)
            apart = np.add.reduceat((labels.label[s] != first).astype(np.int64), start) > 0
            i = i[np.repeat(apart, end - start)[i]]
        active = i
        i = i[labels.fresh(s[i], s[i + gap])]
        if gap == 4 and len(active):
            used = np.unique(s[np.isin(g, np.unique(g[active]))])
            width = 1 << int(np.clip(np.ceil(np.log2(4 * max(1, int(np.median(sizes[used]))))), 9, 13))
            bits, row = sets.bitmaps(used, width), np.zeros(len(sizes), np.int64)
            row[used] = np.arange(len(used))
        if bits is not None and len(i):
            good = [np.zeros(0, bool)]
            for lo in range(0, len(i), 1 << 14):
                k = i[lo : lo + (1 << 14)]
                apart = np.bitwise_count(bits[row[s[k]]] ^ bits[row[s[k + gap]]]).sum(axis=1, dtype=np.int64)
                good.append(apart <= most * (size[k] + size[k + gap]) + 1e-6)
            i = i[np.concatenate(good)]
        if len(i):
            total = np.cumsum(size[i] + size[i + gap])
            for k in np.split(i, np.flatnonzero(np.diff(total // ELEMENTS)) + 1):
                both = sets.common(s[k], s[k + gap])
                alike = k[both >= threshold * (size[k] + size[k + gap] - both)]
                if len(alike):
                    labels.add(s[alike], s[alike + gap])
        gap += 1
    made = np.array(labels.made, np.int64).reshape(-1, 2)
    return made[:, 0], made[:, 1]


def dealt(members: DataFrame, key: str, member: str, chunk: int) -> DataFrame:
    """(group, ``member``): each key's members as one group; more than ``chunk`` are dealt into chunks, and each pair of chunks is a group.

    ``members`` has each pair of key and member once.
    """
    large = members.groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") > chunk).select(key, F.ceil(F.col("n") / chunk).cast("int").alias("chunks"))
    mine = members.join(large, key, "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
    mine = mine.withColumn("mine", F.pmod(F.xxhash64(member), F.col("chunks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    return mine.select(F.xxhash64(key, F.least("mine", "other"), F.greatest("mine", "other")).alias("group"), member)


def verified(batches_of_sets: Callable[[Iterator[pa.RecordBatch]], Iterator[tuple[np.ndarray, np.ndarray, Sets]]], threshold: float, once: bool = False):
    """For mapInArrow over rows in runs of equal groups: links (a, b) between names.

    ``batches_of_sets`` gives (group, name, sets) of consecutive rows; ``once``: equal names have equal sets.
    """

    def out(group: np.ndarray, name: np.ndarray, sets: Sets) -> pa.RecordBatch:
        which = np.arange(len(name))
        if once:
            names, first, which = np.unique(name, return_index=True, return_inverse=True)
            sets, name = sets.take(first), names
        a, b = links(group, which, sets, threshold)
        return pa.RecordBatch.from_arrays([pa.array(name[a]), pa.array(name[b])], names=["a", "b"])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total = [], 0
        for group, name, sets in batches_of_sets(it):
            held.append((group, name, sets))
            total += len(sets.values)
            if total < ELEMENTS:
                continue
            group, name, sets = np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]), Sets.joined([h[2] for h in held])
            n = int(np.flatnonzero(group == group[-1])[0]) if group[0] != group[-1] else 0  # the last group may go on
            if n:
                yield out(group[:n], name[:n], sets.take(np.arange(n)))
            rest = sets.take(np.arange(n, len(name)))
            held, total = [(group[n:], name[n:], rest)], 0 if not n else len(rest.values)
        if held:
            yield out(np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]), Sets.joined([h[2] for h in held]))

    return run
