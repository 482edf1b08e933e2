import random
import re

import numpy as np
import pytest

from lograil.llm import near_dedup
from lograil.llm.components import UnionFind


def shingles(text):
    w = [m.lower() for m in re.findall(r"[^\W_]+", text or "")]
    return {tuple(w[i : i + 3]) for i in range(len(w) - 2)} or ({tuple(w)} if w else set())


def pairs(docs, threshold=0.55):
    sets = sorted(((len(s), d, s) for d, t in docs if d is not None and (s := shingles(t))), key=lambda x: x[:2])
    return {tuple(sorted((a, b))) for i, (n, a, s) in enumerate(sets) for m, b, t in sets[i + 1 :] if a != b and m * threshold <= n and len(s & t) >= threshold * len(s | t)}


def groups(edges):
    links = UnionFind()
    for a, b in edges:
        links.union(a, b)
    return {(x, r) for x in list(links.parent) if (r := links.find(x)) != x}


@pytest.mark.parametrize("options", [{}, {"node": 8}, {"node": 3, "chunk": 2}])
def test_recall_and_precision_against_brute_force(spark, options):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    edges = pairs(rows)
    got = {tuple(r) for r in near_dedup.near_groups(spark.createDataFrame(rows, "doc_id long, text string"), **options).where("doc_id <> keep_doc_id").collect()}
    root = dict(groups(edges))
    found = dict(got)
    linked = sum(found.get(a, a) == found.get(b, b) for a, b in edges)
    assert len(edges) > 100 and linked >= 0.97 * len(edges)
    assert all(root.get(a, a) == root.get(k, k) for a, k in got)  # nothing else is joined


def test_hot_group_of_variants(spark):
    rng = random.Random(2)
    vocabulary = ["".join(rng.choices("abcdefgh", k=5)) for _ in range(400)]
    base = rng.choices(vocabulary, k=150)
    docs = []
    for i in range(700):  # one large node of near copies, none equal
        w = list(base)
        for _ in range(3):
            w[rng.randrange(150)] = rng.choice(vocabulary)
        docs.append((i, " ".join(w)))
    docs += [(1000 + i, " ".join(rng.choices(vocabulary, k=80))) for i in range(300)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {tuple(r) for r in near_dedup.near_groups(df, node=50, chunk=100).where("doc_id <> keep_doc_id").collect()}
    assert got == {(i, 0) for i in range(1, 700)}


def test_edges(spark):
    long = " ".join(f"w{i}" for i in range(60_000))
    data = [(1, None), (2, ""), (3, "!!"), (4, "one two"), (5, "One, two!"), (None, "one two"), (6, long), (7, long + " tail"), (8, "a b c d e f"), (8, "a b c d e f"), (9, "x y z u v w"), (8, "x y z u v w"), (10, "two one")]
    df = spark.createDataFrame(data, "doc_id long, text string").selectExpr("*", "1 as keep_doc_id", "2 as key", "3 as root")
    got = {tuple(r) for r in near_dedup.near_groups(df).where("doc_id <> keep_doc_id").collect()}
    assert got == {(5, 4), (7, 6), (9, 8)}
    kept = near_dedup.keep_one(df)
    assert kept.columns == df.columns and sorted((r.doc_id or 0) for r in kept.collect()) == [0, 1, 2, 3, 4, 6, 8, 8, 8, 10]
    assert near_dedup.near_groups(df.where("false")).count() == 0 and near_dedup.keep_one(df.where("false")).count() == 0


def test_similar_documents_share_paths():
    """Measured recall of the trees at the threshold itself."""
    rng = np.random.default_rng(5)
    n, hits = 400, 0
    a = rng.integers(0, 2**32, (n, near_dedup.COORDINATES), dtype=np.uint32)
    b = np.where(rng.random(a.shape) < near_dedup.THRESHOLD, a, rng.integers(0, 2**32, a.shape, dtype=np.uint32))
    (da, pa), (db, pb) = (near_dedup.walk(x, 2, near_dedup.TREES, near_dedup.THRESHOLD) for x in (a, b))
    for i in range(n):
        hits += bool(set(pa[da == i].tolist()) & set(pb[db == i].tolist()))
    assert hits >= 0.97 * n


@pytest.mark.parametrize("others, options", [(0, {}), (1500, {}), (60, {"node": 8})])
def test_each_text_of_a_document_has_its_near_copies(spark, others, options):
    rng = random.Random(8)
    vocabulary = ["".join(rng.choices("abcdefgh", k=5)) for _ in range(500)]
    docs = [(10_000 + i, " ".join(rng.choices(vocabulary, k=40))) for i in range(others)]
    want = set()
    for i in range(20):
        first, second = (rng.choices(vocabulary, k=80) for _ in range(2))
        docs += [(100 + i, " ".join(first)), (100 + i, " ".join(second)), (200 + i, " ".join([*first, "tail"])), (300 + i, " ".join([*second, "tail"]))]
        want |= {(200 + i, 100 + i), (300 + i, 100 + i)}
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert {tuple(r) for r in near_dedup.near_groups(df, **options).where("doc_id <> keep_doc_id").collect()} == want
