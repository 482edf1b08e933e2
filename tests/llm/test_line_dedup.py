import random
import string
import time

import numpy as np
from pyspark.sql import functions as F

from lograil.llm.components import UnionFind, components
from lograil.llm.line_dedup import BANDS, ROWS, SHINGLE, Lines, line_dedup, op1_line_dedup, without_lines
from lograil.llm.text import minhash, mix
from lograil.llm.verify import Sets, links


def jaccard(a, b):
    sets = [{x[i : i + SHINGLE] for i in range(len(x) - SHINGLE + 1)} or {x} for x in (a, b)]
    return len(sets[0] & sets[1]) / len(sets[0] | sets[1])


def brute(docs, threshold=0.8):
    """doc_id -> text to the set of (doc, line, keep doc, keep line)."""
    lines = [(d, i, x) for d, t in sorted(docs.items()) for i, x in enumerate((t or "").split("\n")) if x.strip()]
    sets = [frozenset(x[i : i + SHINGLE] for i in range(len(x) - SHINGLE + 1)) or frozenset([x]) for _, _, x in lines]
    links, byset = UnionFind(), {}
    for i, s in enumerate(sets):
        byset.setdefault(s, []).append(i)
        links.find(i)
    for same in byset.values():
        for i in same[1:]:
            links.union(same[0], i)
    distinct = sorted(byset, key=len)
    for a, s in enumerate(distinct):
        for t in distinct[a + 1 :]:
            if len(t) * threshold > len(s):
                break
            if len(s & t) >= threshold * len(s | t):
                links.union(byset[s][0], byset[t][0])
    out = set()
    for i, (d, n, _) in enumerate(lines):
        if (r := links.find(i)) != i:
            out.add((d, n, lines[r][0], lines[r][1]))
    return out


def rows(df):
    return {(r.doc_id, r.line_no, r.keep_doc_id, r.keep_line_no) for r in df.collect()}


def test_against_brute_force(spark, tiny):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{tiny}/documents.parquet").collect()}
    got, want = rows(op1_line_dedup(spark, tiny)), brute(docs)
    gone, should = {x[:2] for x in got}, {x[:2] for x in want}
    assert len(gone & should) >= 0.97 * len(should)
    assert gone <= should  # verified exactly: nothing else goes


def test_edits_and_exact_copies(spark):
    rng = random.Random(4)
    base = ["".join(rng.choices(string.ascii_lowercase + " ", k=200)) for _ in range(40)]
    edited = [x[:90] + "QQQ" + x[93:] for x in base]
    docs = {i: "\n".join([a, b]) for i, (a, b) in enumerate(zip(base, reversed(base)))} | {100 + i: x for i, x in enumerate(edited)}
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    got = rows(line_dedup(df))
    assert got == brute(docs) and {x[0] for x in got} >= set(range(100, 140))


def test_edge_cases(spark):
    long = "word " * 60_000
    data = [
        (1, "same\n\n\nsame\nab", "x"), (1, "same\n\n\nsame\nab", "x"), (2, None, "x"), (3, "", "x"), (None, "same", "x"), (4, "\n \nab\nsame\n", None),
        (5, long, "x"), (6, long + "!", "x"), (7, "äö \U0001f600 line", "x"), (8, "äö \U0001f600 line", "x"),
    ]
    df = spark.createDataFrame(data, "doc_id long, text string, h string").withColumn("bucket", F.lit(1)).withColumn("part", F.lit("p"))
    got = rows(line_dedup(df))
    assert got == {(1, 3, 1, 0), (4, 2, 1, 4), (4, 3, 1, 0), (6, 0, 5, 0), (8, 0, 7, 0)}
    assert rows(line_dedup(df.where("false"))) == set()
    twice = spark.createDataFrame([(1, "first line\nother thing"), (1, "x"), (2, "other thing")], "doc_id long, text string")
    assert rows(line_dedup(twice)) == {(2, 0, 1, 1)}
    out = {(r.doc_id, r.text) for r in without_lines(df.withColumn("n_chars", F.length("text").cast("long")).where("doc_id <> 1 or doc_id is null"), line_dedup(df)).collect()}
    assert out == {(2, None), (3, ""), (None, "same"), (5, long), (7, data[8][1])}


def test_lines_split_like_python():
    texts = ["a\n\nb", None, "", "\n", "x\n", "\ny", "last"]
    got = Lines(texts)
    want = [(i, n, x) for i, t in enumerate(texts) for n, x in enumerate((t or "").split("\n")) if x.strip()]
    assert [(r, n, "".join(map(chr, got.cps[s:e]))) for r, n, s, e in zip(got.row, got.number, got.starts, got.ends)] == want


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(300)] + [(1000 + i, 1001 + i) for i in range(60)] + [(7, 7), (None, 3), (2000, 2001), (2000, 2001)]
    links = UnionFind()
    for a, b in edges:
        if a is not None and a != b:
            links.union(a, b)
    got = {(r.node, r.root) for r in components(spark.createDataFrame(edges, "a long, b long").repartition(9)).collect()}
    assert got == {(x, links.find(x)) for x in list(links.parent)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_documents_keep_their_other_lines(spark):
    docs = spark.createDataFrame([(1, "shared line\nmine"), (2, "yours\nshared line\n\nend"), (3, "shared line\n \u2003\n")], "doc_id long, text string").withColumn("n_chars", F.length("text").cast("long"))
    out = {(r.doc_id, r.text, r.n_chars) for r in without_lines(docs, line_dedup(docs)).collect()}
    assert out == {(1, "shared line\nmine", 16), (2, "yours\n\nend", 10)}


def test_extra_columns_may_have_any_name(spark):
    docs = spark.createDataFrame([(1, "shared line\nmine", 7, 8, 9, 1), (2, "shared line", 4, 5, 6, 1)], "doc_id int, text string, _gone int, _doc int, _HASH int, `a.b` int")
    out = without_lines(docs, line_dedup(docs))
    assert out.columns == docs.columns and [tuple(r) for r in out.collect()] == [(1, "shared line\nmine", 7, 8, 9, 1)]


def test_links_against_brute_force():
    """Groups of all sizes: like, unlike, chained and repeated members."""
    rng = np.random.default_rng(3)
    sets, group = [], []
    for g, n in enumerate([1, 2, 2, 3, 5, 9, 40, 120]):
        base = rng.integers(0, 1 << 62, 60)
        for _ in range(n):
            x = base.copy()
            k = rng.integers(0, 25)
            x[:k] = rng.integers(0, 1 << 62, k)
            sets.append(np.unique(x[: rng.integers(30, 61)]) if rng.random() < 0.5 else np.unique(x))
            group.append(g)
    sets.append(np.zeros(0, np.int64))
    group.append(7)
    row = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    packed = Sets(row, mix(np.concatenate(sets).astype(np.uint64)), len(sets))
    a, b = links(np.array(group), np.arange(len(sets)), packed, 0.8)
    got, want = UnionFind(), UnionFind()
    for x, y in zip(a.tolist(), b.tolist()):
        got.union(x, y)
    real = [set(x.tolist()) for x in sets]
    for i in range(len(sets)):
        for j in range(i):
            if group[i] == group[j] and real[i] and real[j] and len(real[i] & real[j]) >= 0.8 * len(real[i] | real[j]):
                want.union(i, j)
    assert [got.find(i) for i in range(len(sets))] == [want.find(i) for i in range(len(sets))]


def test_unlike_lines_of_one_group_cost_little():
    rng = np.random.default_rng(4)
    shared = rng.integers(0, 1 << 62, 40)
    n = 2000
    values = np.concatenate([np.concatenate([shared, rng.integers(0, 1 << 62, 60)]) for _ in range(n)])
    sets = Sets(np.repeat(np.arange(n), 100), mix(values.astype(np.uint64)), n)
    began = time.perf_counter()
    assert not len(links(np.zeros(n, int), np.arange(n), sets, 0.8)[0])
    assert time.perf_counter() - began < 10


def test_chunks_of_a_group_lose_no_link(spark):
    rng = random.Random(9)
    base = "".join(rng.choices(string.ascii_lowercase, k=120))
    docs = [(i, base[:i] + "Z" + base[i + 1 :]) for i in range(100)]  # all of one component
    got = rows(line_dedup(spark.createDataFrame(docs, "doc_id long, text string"), chunk=7))
    assert got == brute(dict(docs)) and len(got) == 99


def test_a_line_that_every_document_repeats(spark):
    docs = spark.range(300).selectExpr("id as doc_id", "concat('the hot line\nthe hot line\nown ', uuid()) as text")
    docs = spark.createDataFrame(docs.collect(), docs.schema)
    got = rows(line_dedup(docs))
    assert got == {(d, n, 0, 0) for d in range(300) for n in (0, 1) if d or n}


def test_signatures_find_pairs_as_often_as_the_binomial_says():
    rng = np.random.default_rng(6)
    n, size, same = 3000, 90, 80  # Jaccard 0.8
    a = rng.integers(0, 1 << 32, (n, size), dtype=np.uint32)
    b = np.concatenate([a[:, :same], rng.integers(0, 1 << 32, (n, size - same), dtype=np.uint32)], axis=1)
    bounds = np.arange(0, n * size + 1, size)
    x, y = (minhash(v.ravel(), bounds, BANDS * ROWS, 1).reshape(n, BANDS, ROWS) for v in (a, b))
    assert (x == y).all(axis=2).any(axis=1).mean() > 0.985
