"""Operator 10, quality classifier: Naive Bayes support vectors (NBSVM).

Tokens are lower-cased words and runs of other visible characters; a document's
features are the indicators of its 1- and 2-grams, hashed to ``2**BITS`` places.
The 2-gram of a token and itself counts as its own feature and as one that all such
2-grams share, so that text of repeated words is known whatever the word.
For each label (``quality`` and ``toxic``) the indicators are scaled by the
class log-count ratio ``r = log((p/|p|) / (q/|q|))``, and a linear L2-regularised
hinge-loss model is fitted to the scaled features by dual coordinate descent
(Hsieh et al., ICML 2008).  A document is rejected when the quality model finds
it bad or the toxicity model finds it toxic.

Only the fit is bounded: it takes the ``max_labelled`` labelled documents of the
least hash of doc_id.  Their features come from a distributed scan; the solver
runs on the driver over them.  Scoring reads every document once, without a
shuffle; what is broadcast are two weight tables of fixed size.

Defined results.  Null and empty texts have no features and get the models'
intercepts.  Rows with a null doc_id are scored like others.  A doc_id labelled
twice counts with its least labels; null labels are left out.  A label with one
class only in the sample, or without rows, has no model: nothing is rejected for
it and its score is null.  Repeated rows get equal scores.  A score of exactly 0
is kept.  Empty documents give no rows.  Other columns are kept by ``keep``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .exchange import batches
from .memory import task
from .names import column, unused
from .text import PrefixHash, codepoints, tables

BITS, MAX_LABELLED, MIN_DOCS, ALPHA, C, EPOCHS, SEED = 20, 20_000, 3, 1.0, 4.0, 12, 10
TWICE = 0x1234567890ABCDEF
_SPACE = np.zeros(0x110000, dtype=bool)
_SPACE[[c for c in range(0x3001) if chr(c).isspace()]] = True


def features(texts: list[str | None], bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """The rows and hashed places of all indicators of a batch, sorted, each once."""
    lower, word = tables()
    cps, offsets = codepoints(texts)
    low = lower[cps]
    n = len(cps)
    kind = word[cps].astype(np.int8) + 1
    kind[_SPACE[cps]] = 0
    new = np.empty(n, dtype=bool)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    new[0] = True
    np.not_equal(kind[1:], kind[:-1], out=new[1:])
    edge = offsets[1:-1]
    new[edge[edge < n]] = True
    starts = np.flatnonzero(new)
    ends = np.append(starts[1:], n)
    solid = kind[starts] > 0
    starts, ends = starts[solid], ends[solid]
    row = np.searchsorted(offsets, starts, side="right") - 1
    one = PrefixHash(low).span(starts, ends)
    pair = row[1:] == row[:-1]
    two = (one[:-1] * np.uint64(0x9E3779B97F4A7C15) ^ (one[1:] >> np.uint64(3)))
    twice = np.unique(row[1:][pair & (one[:-1] == one[1:])]).astype(np.int64)
    two = two[pair] * np.uint64(0xBF58476D1CE4E5B9)
    shift = np.uint64(64 - bits)
    again = np.int64(TWICE >> (64 - bits))
    keys = np.concatenate([(row.astype(np.int64) << bits) | (one >> shift).astype(np.int64), (row[1:][pair].astype(np.int64) << bits) | (two >> shift).astype(np.int64), (twice << bits) | again])
    keys.sort()
    keys = keys[np.flatnonzero(np.diff(keys, prepend=-1))]
    return keys >> bits, keys & ((1 << bits) - 1)


@dataclass
class Model:
    """A linear model over hashed indicators; the log-count ratios are folded into the weights."""

    weights: np.ndarray
    intercept: float

    def scores(self, rows: np.ndarray, places: np.ndarray, n: int) -> np.ndarray:
        return np.bincount(rows, weights=self.weights[places], minlength=n) + self.intercept


def fit(sets: list[np.ndarray], labels: np.ndarray, bits: int = BITS, alpha: float = ALPHA, c: float = C, epochs: int = EPOCHS, min_docs: int = MIN_DOCS) -> Model | None:
    """NBSVM of documents (arrays of places) with labels 0 and 1; None where a class is missing."""
    good = np.asarray(labels) == 1
    if not len(sets) or good.all() or not good.any():
        return None
    size = 1 << bits
    p, q = np.full(size, alpha), np.full(size, alpha)
    for places, y in zip(sets, good):
        (p if y else q)[places] += 1
    usable = p + q - 2 * alpha >= min_docs
    r = np.where(usable, np.log((p / p[usable].sum()) / (q / q[usable].sum())), 0.0)
    # rows are scaled to unit length, so that long documents weigh no more; the intercept is one more feature
    norms = [max(1e-12, float(np.sqrt((v := r[x]) @ v + 1.0))) for x in sets]
    y = np.where(good, 1.0, -1.0)
    w, b = np.zeros(size), 0.0
    dual = np.zeros(len(y))
    rng = np.random.default_rng(SEED)
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(len(y)):
            x, k = sets[i], norms[i]
            v = r[x]
            gradient = y[i] * (w[x] @ v + b) / k - 1.0
            old = dual[i]
            new = min(max(old - gradient, 0.0), c)
            if new != old:
                dual[i] = new
                step = (new - old) * y[i] / k
                w[x] += step * v
                b += step
                moved = max(moved, abs(new - old))
        if moved < 1e-3:
            break
    return Model((w * r).astype(np.float32), float(b))


def _sample(docs: DataFrame, labels: DataFrame, limit: int) -> DataFrame:
    """(quality, toxic, places) of the labelled documents that the fit takes."""
    labels = labels.select(F.col("doc_id").cast("long"), F.col("quality").cast("int"), F.col("toxic").cast("int")).where("doc_id is not null")
    labels = labels.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.min("toxic").alias("toxic"))
    labels = labels.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    # at most ``limit`` rows of three integers, whatever the input
    found = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).join(F.broadcast(labels), "doc_id")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in batches(it):
            row, places = features(texts)
            offsets = np.searchsorted(row, np.arange(len(texts) + 1)).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(places.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), lists], names=["doc_id", "quality", "toxic", "places"])

    return found.select("doc_id", "text", "quality", "toxic").mapInArrow(task(run), "doc_id long, quality int, toxic int, places array<int>")


def train(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> dict[str, Model | None]:
    """The models of 'quality' (1: good) and 'toxic' (1: toxic)."""
    table = _sample(docs, labels, max_labelled).toArrow()
    order = pa.compute.sort_indices(table, [("doc_id", "ascending"), ("quality", "ascending"), ("toxic", "ascending")]).to_numpy() if table.num_rows else []
    found = []
    for chunk in table.column("places").chunks:
        values, ends = chunk.values.to_numpy(), chunk.offsets.to_numpy()
        found += [values[a:b] for a, b in zip(ends[:-1], ends[1:])]
    sets = [found[i] for i in order]
    table = table.drop_columns("places").take(pa.array(order, pa.int64()))
    models = {}
    for label in ("quality", "toxic"):
        y = table.column(label).to_pylist()
        with_label = [i for i, v in enumerate(y) if v is not None]
        models[label] = fit([sets[i] for i in with_label], np.array([y[i] for i in with_label]))
    return models


def score(docs: DataFrame, models: dict[str, Model | None], text: str = "text", into: str = "scores") -> DataFrame:
    """``docs`` and a struct column ``into`` of quality (negative: rejected) and toxic (positive: rejected)."""
    shared = docs.sparkSession.sparkContext.broadcast(models)

    @F.arrow_udf("struct<quality:double,toxic:double>")
    def scores(column: pa.Array) -> pa.Array:
        models, out = shared.value, {"quality": [], "toxic": []}
        batch = pa.RecordBatch.from_arrays([column.cast(pa.string())], names=["text"])
        for _, texts in batches(iter([batch])):
            row, places = features(texts)
            for label, model in models.items():
                out[label].append(model.scores(row, places, len(texts)) if model else np.full(len(texts), np.nan))
        columns = []
        for label in ("quality", "toxic"):
            x = np.concatenate(out[label]) if out[label] else np.zeros(0)
            columns.append(pa.array(x, mask=np.isnan(x)))
        return pa.StructArray.from_arrays(columns, names=["quality", "toxic"])

    return docs.withColumn(into, scores(F.col(text).cast("string")))


def accepted(scores: str) -> Column:
    return (F.coalesce(F.col(scores)["quality"], F.lit(0.0)) >= 0) & (F.coalesce(F.col(scores)["toxic"], F.lit(0.0)) <= 0)


def keep(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """The documents that the classifier keeps, with their own columns."""
    (scores,) = unused(docs, "_scores")
    kept = score(docs, train(docs, labels, max_labelled), into=scores).where(accepted(scores))
    return kept.select(*(column(c) for c in docs.columns))


def op10_quality(spark, sf_dir: str) -> DataFrame:
    """(doc_id, quality_score, toxic_score) of each document kept."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    scored = score(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return scored.where(accepted("scores")).select("doc_id", F.col("scores.quality").alias("quality_score"), F.col("scores.toxic").alias("toxic_score"))
