"""Operators 5 and 7 against brute force."""

import random
import re

import pytest

from lograil.llm import substring_dedup, suffix_dedup
from lograil.llm.repeats import GRAM, MIN_WORDS, winnow
from lograil.llm.text import Words

OPERATORS = {"suffix array": suffix_dedup.suffix_repeats, "seed and extend": substring_dedup.substring_repeats}
QUERIES = {"suffix array": suffix_dedup.op5_suffix_dedup, "seed and extend": substring_dedup.op7_substring_dedup}


def tokens(text):
    return [m.lower() for m in re.findall(r"[^\W_]+", text or "")]


def brute(docs, n=MIN_WORDS):
    where = {}
    for d, t in docs:
        w = tokens(t) if d is not None else []
        for i in range(len(w) - n + 1):
            where.setdefault(tuple(w[i : i + n]), set()).add(d)
    out = set()
    for d, t in docs:
        w = tokens(t) if d is not None else []
        covered = sorted(i for i in range(len(w) - n + 1) if len(where[tuple(w[i : i + n])]) > 1)
        spans = []
        for i in covered:
            if spans and i <= spans[-1][1]:
                spans[-1][1] = i + n
            else:
                spans.append([i, i + n])
        out |= {(d, a, b) for a, b in spans}
    return out


def spans(df):
    return {(r.doc_id, r.start_word, r.end_word) for r in df.collect()}


@pytest.mark.parametrize("name", OPERATORS)
@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_against_brute_force(spark, name, sf):
    rows = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet").select("doc_id", "text").collect()
    want = brute([tuple(r) for r in rows])
    assert spans(QUERIES[name](spark, f"/root/testdata/{sf}")) == want and want


@pytest.mark.parametrize("name", OPERATORS)
def test_overlapping_passages_in_many_documents(spark, name):
    rng = random.Random(6)
    word = lambda: "".join(rng.choices("abcde", k=3))
    pool = [word() for _ in range(600)]
    docs = []
    for i in range(250):
        parts = []
        for _ in range(rng.randrange(1, 6)):
            a = rng.randrange(540)
            parts += pool[a : a + rng.choice([30, 49, 50, 51, 60, 120])] + [word() for _ in range(rng.choice([0, 1, 20, 60]))]
        docs.append((i, " ".join(parts)))
    docs += [(1000 + i, docs[3][1]) for i in range(40)]  # a hot document
    got = OPERATORS[name](spark.createDataFrame(docs, "doc_id long, text string").repartition(5))
    rows = got.collect()
    assert {(r.doc_id, r.start_word, r.end_word) for r in rows} == brute(docs)
    assert all(r.other_doc_id != r.doc_id and r.n_words == r.end_word - r.start_word for r in rows)


@pytest.mark.parametrize("name", OPERATORS)
def test_edges(spark, name):
    w = [f"w{i}" for i in range(30_000)]
    part = lambda a, b: " ".join(w[a:b])
    data = [
        (1, None), (2, ""), (3, part(0, 49)), (4, part(0, 50)), (5, "Start. " + part(0, 50).upper().replace(" ", ", ")), (None, part(0, 50)), (6, part(100, 200) + " x " + part(100, 200)), (7, part(300, 400)), (7, part(300, 400)),
        (8, part(1000, 30_000)), (9, "y " + part(1000, 30_000)), (10, part(500, 560) + " z " + part(600, 660)), (11, part(600, 660) + " " + part(500, 560)), (12, part(700, 750)), (12, part(700, 800)), (13, part(705, 760)),
        (14, " ".join(["same"] * 300)), (15, " ".join(["same"] * 80)),
    ]
    df = spark.createDataFrame(data, "doc_id long, text string").selectExpr("*", "1 as part", "'b' as block", "2 as anchor", "3 as place")
    assert spans(OPERATORS[name](df)) == {(4, 0, 50), (5, 1, 51), (8, 0, 29_000), (9, 1, 29_001), (10, 0, 60), (10, 61, 121), (11, 0, 120), (12, 5, 60), (13, 0, 55), (14, 0, 300), (15, 0, 80)}
    assert spans(OPERATORS[name](df.where("false"))) == set()


def test_winnowing_selects_in_every_window():
    rng = random.Random(1)
    texts = [" ".join(rng.choices(["a", "b", "c", "dd"], k=rng.choice([0, 10, 49, 50, 51, 300]))) for _ in range(30)] + [" ".join(["z"] * 200)]
    words = Words(texts)
    at = set(winnow(words)[0].tolist())
    for row in range(len(texts)):
        for p in range(int(words.first[row]), int(words.first[row + 1]) - MIN_WORDS + 1):
            assert at & set(range(p, p + MIN_WORDS - GRAM + 1))


def coded(strings):
    out, last = [], b""
    for s in sorted(strings):
        common = 0
        while common < len(s) // 4 and last[4 * common : 4 * common + 4] == s[4 * common : 4 * common + 4]:
            common += 1
        out.append((common, s, None))
        last = s
    return out


@pytest.mark.parametrize("k", [0, 1, 2, 3, 7, 16])
def test_loser_tree_merges_and_never_compares_known_prefixes(k):
    rng = random.Random(k)
    runs = [coded([b"".join(bytes([0, 0, 0, rng.choice([0, 0, 0, 1])]) for _ in range(24)) for _ in range(rng.choice([0, 1, 40]))]) for _ in range(k)]
    tree = suffix_dedup.LoserTree(runs)
    got = list(tree)
    assert got == coded([s for r in runs for _, s, _ in r])
    # each comparison that reads symbols ends with one that differs, all others it reads become known
    assert tree.compared <= len(got) * (max(1, k) - 1).bit_length() + 24 * max(1, len(got))
