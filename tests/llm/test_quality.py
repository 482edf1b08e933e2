import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from lograil.llm import quality


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    train = labels.where("doc_id % 4 <> 0")
    models = quality.train(docs, train)
    held = quality.score(docs, models).join(labels.where("doc_id % 4 = 0"), "doc_id").selectExpr("quality", "toxic", "scores.quality as quality_score", "scores.toxic as toxic_score").toPandas()
    assert len(held) > 800
    good, toxic = held["quality"] == 1, held["toxic"] == 1
    assert ((held["quality_score"] >= 0) == good).mean() > 0.97 and (held["quality_score"][good] >= 0).mean() > 0.99
    assert (held["toxic_score"][toxic] > 0).mean() > 0.8 and (held["toxic_score"][~toxic] <= 0).mean() > 0.995


def test_features_against_python():
    texts = ["The cat, the cat!", None, "", "a a a", "Ünder $$ x" * 30, "x"]
    row, place = quality.features(texts)
    for i, text in enumerate(texts):
        alone = quality.features([text])[1]
        assert np.array_equal(place[row == i], alone) and len(set(alone.tolist())) == len(alone)
    assert len(quality.features(["the cat , the cat !"])[1]) == len({"the", "cat", ",", "!", "the cat", "cat ,", ", the", "cat !"})
    assert len(quality.features(["a a a"])[1]) == 3 and len(quality.features([None, ""])[1]) == 0


def test_dual_coordinate_descent_reaches_the_optimum():
    """Against the primal objective minimised by plain subgradient steps."""
    rng = np.random.default_rng(0)
    sets = [np.unique(rng.integers(0, 30, 8)) for _ in range(200)]
    y = np.array([1 if 3 in s or rng.random() < 0.2 else 0 for s in sets])
    model = quality.fit(sets, y, bits=5, c=1.0, epochs=400, min_docs=1)
    sign, p, q = np.where(y == 1, 1.0, -1.0), np.ones(32), np.ones(32)
    for s, t in zip(sets, y):
        (p if t else q)[s] += 1
    usable = p + q - 2 >= 1
    r = np.where(usable, np.log(p / p[usable].sum() / (q / q[usable].sum())), 0)
    x = np.zeros((200, 33))
    for i, s in enumerate(sets):
        x[i, s] = r[s]
        x[i, 32] = 1
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    objective = lambda w: 0.5 * w @ w + np.maximum(0, 1 - sign * (x @ w)).sum()
    w, best = np.zeros(33), np.inf
    for k in range(1, 20_000):
        w -= (w - x.T @ (sign * (sign * (x @ w) < 1))) / (k + 10)
        best = min(best, objective(w))
    mine = np.append(np.where(r != 0, model.weights / np.where(r != 0, r, 1), 0), model.intercept)
    assert objective(mine) <= best * 1.001


def test_edges(spark):
    rng = random.Random(0)
    word = lambda: "".join(rng.choices("abcd", k=3))
    docs = [(i, " ".join(word() for _ in range(30)) + (" trash" if i % 2 else "")) for i in range(60)] + [(100, None), (101, ""), (None, "trash trash"), (7, "trash"), (102, "w " * 100_000)]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "'x' as quality", "1 as toxic", "0 as places")
    labels = spark.createDataFrame([(i, 1 - i % 2, 0) for i in range(60)] + [(3, None, None), (None, 1, 1), (5, 0, 0), (999, 1, 1)], "doc_id long, quality int, toxic int")
    out = quality.keep(df, labels)
    kept = [r.doc_id for r in out.collect()]
    assert out.columns == df.columns and set(range(0, 60, 2)) <= set(kept) and not set(range(1, 60, 2)) & set(kept) and None not in kept
    scores = quality.score(df, quality.train(df, labels)).collect()
    assert all(r.scores.toxic is None for r in scores)  # one class only
    assert quality.keep(df, labels.where("false")).count() == len(docs)
    assert quality.keep(df.where("false"), labels).count() == 0
    assert quality.train(df, labels, max_labelled=10)["toxic"] is None


@pytest.mark.parametrize("sf", ["tiny"])
def test_query_keeps_rows_once(spark, request, sf):
    rows = quality.op10_quality(spark, request.getfixturevalue(sf)).collect()
    assert 100 < len({r.doc_id for r in rows}) == len(rows) <= 200


def grams(text):
    tokens = re.findall(r"[^\W_]+|(?:[^\w\s]|_)+", (text or "").lower())
    pairs = list(zip(tokens, tokens[1:]))
    return {*tokens, *pairs, *(["twice"] if any(a == b for a, b in pairs) else [])}


def plain_nbsvm(sets, labels):
    """Log-count ratios and dual coordinate descent over sets of grams themselves."""
    p, q, count = Counter(), Counter(), Counter()
    for s, y in zip(sets, labels):
        (p if y else q).update(s)
        count.update(s)
    usable = [g for g in count if count[g] >= quality.MIN_DOCS]
    sums = [sum(c[g] + 1 for g in usable) for c in (p, q)]
    r = {g: math.log((p[g] + 1) / sums[0] / ((q[g] + 1) / sums[1])) for g in usable}
    w, b, dual, rng = dict.fromkeys(r, 0.0), 0.0, [0.0] * len(sets), np.random.default_rng(quality.SEED)
    for _ in range(quality.EPOCHS):
        moved = 0.0
        for i in rng.permutation(len(sets)):
            x, y = [g for g in sets[i] if g in r], 1 if labels[i] else -1
            k = math.sqrt(sum(r[g] ** 2 for g in x) + 1)
            new = min(max(dual[i] - (y * (sum(w[g] * r[g] for g in x) + b) / k - 1), 0), quality.C)
            step, moved = (new - dual[i]) * y / k, max(moved, abs(new - dual[i]))
            dual[i] = new
            b += step
            for g in x:
                w[g] += step * r[g]
        if moved < 1e-3:
            break
    return lambda s: sum(w[g] * r[g] for g in s if g in r) + b


def test_query_against_plain_python(spark):
    sf = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    docs = {d: quality.features([t])[1].tolist() for d, t in texts.items()}  # grams by their hashed places, a few of which collide
    assert all(len(grams(t)) * 0.99 <= len(docs[d]) <= len(grams(t)) for d, t in texts.items())
    labels = sorted((r.doc_id, r.quality, r.toxic) for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if r.doc_id in docs)
    good, toxic = (plain_nbsvm([docs[x[0]] for x in labels], [x[k] == 1 for x in labels]) for k in (1, 2))
    want = {d: (good(s), toxic(s)) for d, s in docs.items()}
    got = {r.doc_id: (r.quality_score, r.toxic_score) for r in quality.op10_quality(spark, sf).collect()}
    assert set(got) == {d for d, (a, b) in want.items() if a >= 0 and b <= 0} and len(got) > 500
    assert all(abs(got[d][k] - want[d][k]) < 1e-3 for d in got for k in (0, 1))


def test_a_score_of_zero_is_kept_and_names_may_clash(spark):
    df = spark.createDataFrame([(1, "same", 1.0, 2, 3), (2, None, 4.0, 5, 6)], "doc_id long, text string, _scores double, _quality int, _S int")
    models = {"quality": quality.Model(np.zeros(1 << quality.BITS, np.float32), 0.0), "toxic": None}
    assert quality.score(df, models, into="x").where(quality.accepted("x")).count() == 2
    out = quality.keep(df, spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int"))
    assert out.columns == df.columns and sorted(map(tuple, out.collect())) == [(1, "same", 1.0, 2, 3), (2, None, 4.0, 5, 6)]
