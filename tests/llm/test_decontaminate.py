import re

import pytest

from lograil.llm.decontaminate import clean, contaminated, op3_decontaminate

ITEM = "Alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu"
from lograil.llm import decontaminate


def words(text):
    return [m for m in re.finditer(r"[^\W_]+", text)]


def brute(docs, items, n=10, shortest=5):
    grams = {}
    for item, text in items:
        w = [m[0].lower() for m in words(text or "")]
        k = min(n, len(w))
        for i in range(len(w) - k + 1 if k >= shortest else 0):
            grams.setdefault(tuple(w[i : i + k]), set()).add(item)
    out = set()
    for doc, text in docs:
        w = [m[0].lower() for m in words(text or "")]
        hits = sorted((i, i + len(g), min(items)) for g, items in grams.items() for i in range(len(w) - len(g) + 1) if tuple(w[i : i + len(g)]) == g)
        spans = []
        for a, b, item in hits:
            if spans and a <= spans[-1][1]:
                spans[-1] = (spans[-1][0], max(b, spans[-1][1]), min(item, spans[-1][2]))
            else:
                spans.append((a, b, item))
        total = sum(b - a for a, b, _ in spans)
        out |= {(doc, item, a, b, len(w), total, "drop" if total >= 0.5 * len(w) else "cut") for a, b, item in spans}
    return out


@pytest.mark.parametrize("slice_words", [2_000_000, 300])
def test_against_brute_force(spark, tiny, slice_words):
    docs, bench = spark.read.parquet(f"{tiny}/documents.parquet"), spark.read.parquet(f"{tiny}/benchmark.parquet")
    want = brute([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in bench.collect()])
    got = {(r.doc_id, r.item_id, r.start_word, r.end_word, r.doc_words, r.hit_words, r.action) for r in contaminated(docs, bench, slice_words=slice_words).collect()}
    assert got == want and want
    assert op3_decontaminate(spark, tiny).count() == len(want)


def test_edges_and_cleaning(spark):
    filler = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen "
    docs = [
        (1, filler + ITEM.upper().replace(" ", " -- ") + "! tail", "p"), (2, ITEM, "p"), (3, None, "p"), (4, "", "p"), (None, ITEM + " " + filler * 2, "p"), (5, filler, None),
        (6, "short item of five words here", "p"), (1, filler + ITEM.upper().replace(" ", " -- ") + "! tail", "p"), (7, (filler * 20_000) + ITEM, "p"), (8, ITEM.replace("beta", "B"), "p"),
    ]
    df = spark.createDataFrame(docs, "doc_id long, text string, item_id string")
    bench = spark.createDataFrame([(1, ITEM), (2, None), (3, "short ITEM of five words"), (4, "too short"), (None, filler), (0, ITEM)], "item_id long, text string")
    got = {(r.doc_id, r.item_id, r.start_word, r.action) for r in contaminated(df, bench).collect()}
    # "B gamma ..." leaves no clean run of ten words but the eleven after it
    assert got == {(1, 0, 14, "cut"), (2, 0, 0, "drop"), (None, 0, 0, "cut"), (6, 3, 0, "drop"), (7, 0, 280_000, "cut"), (8, 0, 2, "drop")}
    out = clean(df, bench)
    assert out.columns == df.columns
    rows = [(r.doc_id, r.text) for r in out.collect()]
    assert sorted(r for r in rows if r[0] in (1, 3, 4, 5)) == sorted([(1, filler + "! tail"), (1, filler + "! tail"), (4, ""), (5, filler)] + [(3, None)], key=str) or {r for r in rows if r[0] in (1, 3, 4, 5)} == {(1, filler + "! tail"), (3, None), (4, ""), (5, filler)}
    assert not {2, 6, 8} & {r[0] for r in rows} and len(rows) == 7
    assert contaminated(df.where("false"), bench).count() == 0 and contaminated(df, bench.where("false")).count() == 0
    assert clean(df, bench.where("false")).count() == len(docs)


def test_names_may_clash_and_slices_agree(spark):
    text = "one two three four five six seven eight nine ten"
    docs = spark.createDataFrame([(1, f"before it all {text} and after it comes much more text than that, word after word after word", 7, 8, 9)], "doc_id long, text string, _words int, _HIT int, _spans int")
    items = spark.createDataFrame([(i, f"{text} {i}") for i in range(30)], "item_id long, text string")
    for size in (2_000_000, 60):
        out = decontaminate.clean(docs, items, slice_words=size)
        assert out.columns == docs.columns
        assert [tuple(r) for r in out.collect()] == [(1, "before it all  and after it comes much more text than that, word after word after word", 7, 8, 9)]
