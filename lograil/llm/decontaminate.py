"""Operator 3, benchmark decontamination.

Words are maximal runs of letters and digits, lower-cased.  Every window of
``n`` words of a benchmark item is one entry of a broadcast hash set (an item
of fewer words, but ``shortest`` at least, has one window of all its words).
One scan hashes every word window of every document, looks the hashes up, and
verifies each hit word by word against the item.  Verified windows merge into
spans.  A document whose spans hold at least ``drop_share`` of its words goes;
from other documents the spans are cut out, from the first word's first to the
last word's last character.

The broadcast is checked: a benchmark of more than ``slice_words`` words is
dealt into slices of about that size.  Each slice is a pass of its own over the
documents: its result is cut to the shared folder and its broadcast dropped before the
next is made, so that one slice is in memory at a time.  One slice is the usual case,
and needs no cut and no shuffle.

Defined results.  Null and empty texts have no words and stay.  Null items and
items of fewer than ``shortest`` words match nothing.  Null ids stay as they
are.  Rows are judged one by one, so repeated rows give repeated results.  A
window of several items is given to the least item_id.  An empty table on
either side gives no hits.  Other columns are kept by ``clean`` and ignored by
``contaminated``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .exchange import batches
from .memory import task
from .names import unused
from .storage import cut
from .text import Words

N, SHORTEST, DROP_SHARE, SLICE_WORDS = 10, 5, 0.5, 2_000_000
_SPANS = "array<struct<item_id:long,start_word:int,end_word:int,start_char:int,end_char:int>>"
_SPAN_TYPE = pa.list_(pa.struct([("item_id", pa.int64()), ("start_word", pa.int32()), ("end_word", pa.int32()), ("start_char", pa.int32()), ("end_char", pa.int32())]))


class Grams:
    """The windows of a benchmark slice by length: sorted hashes, with each one's items and words."""

    def __init__(self, items: list[Row], n: int, shortest: int):
        self.by: dict[int, tuple[np.ndarray, list[list[tuple[int, np.ndarray]]]]] = {}
        found: dict[int, dict[int, list]] = {}
        for item in sorted((i for i in items if i.item_id is not None and i.text), key=lambda i: i.item_id):
            words = Words([item.text])
            size = min(n, len(words.hashes))
            if size < shortest:
                continue
            at, hashes = words.grams(size)
            for a, h in zip(at.tolist(), hashes.tolist()):
                entry = found.setdefault(size, {}).setdefault(h, [])
                window = [words.lower[s:e].tobytes() for s, e in zip(words.starts[a : a + size], words.ends[a : a + size])]
                if all(w != window for _, w in entry):
                    entry.append((item.item_id, window))
        for size, table in found.items():
            keys = np.array(sorted(table), dtype=np.uint64)
            self.by[size] = keys, [table[k] for k in keys.tolist()]

    def hits(self, words: Words) -> list[tuple[int, int, int, int]]:
        """(row, first word, end word, item) of verified windows."""
        found = []
        for size, (keys, entries) in self.by.items():
            at, hashes = words.grams(size)
            if not len(at):
                continue
            place = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
            for i in np.flatnonzero(keys[place] == hashes).tolist():
                a = int(at[i])
                window = [words.lower[s:e].tobytes() for s, e in zip(words.starts[a : a + size], words.ends[a : a + size])]
                for item, known in entries[int(place[i])]:
                    if known == window:
                        row = int(words.doc[a])
                        found.append((row, a - int(words.first[row]), a - int(words.first[row]) + size, item))
                        break
        return found


def merge(spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """(start, end, item) with touching and overlapping ones joined; the least item stands for all."""
    out: list[list[int]] = []
    for start, end, item in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
            out[-1][2] = min(out[-1][2], item)
        else:
            out.append([start, end, item])
    return [tuple(x) for x in out]


def _mark(shared):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams: Grams = shared.value
        for batch, texts in batches(it):
            words = Words(texts)
            spans: dict[int, list[tuple[int, int, int]]] = {}
            for row, a, b, item in grams.hits(words):
                spans.setdefault(row, []).append((a, b, item))
            place = batch.num_columns - 2
            before = batch.column(place).to_pylist()
            count = np.diff(words.first)
            for row, have in enumerate(before):
                if have:
                    spans.setdefault(row, []).extend((s["start_word"], s["end_word"], s["item_id"]) for s in have)
            new = []
            for row in range(len(texts)):
                first, origin = int(words.first[row]), int(words.offsets[row])
                new.append([
                    {"item_id": item, "start_word": a, "end_word": b, "start_char": int(words.starts[first + a]) - origin, "end_char": int(words.ends[first + b - 1]) - origin}
                    for a, b, item in merge(spans.get(row, []))
                ])
            columns = [batch.column(i) for i in range(batch.num_columns)]
            columns[place] = pa.array(new, _SPAN_TYPE)
            columns[place + 1] = pa.array(count.astype(np.int32))
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return run


def _marked(docs: DataFrame, benchmark: DataFrame, n: int, shortest: int, slice_words: int) -> DataFrame:
    """``docs`` and two more columns at the end, of names that it doesn't have: spans, and numbers of words."""
    spark = docs.sparkSession
    items = benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).where("item_id is not null and text is not null")
    total = items.agg(F.sum(F.size(F.split("text", r"\s+")))).first()[0] or 0
    slices = max(1, -(-total // slice_words))
    spans, count = unused(docs, "_spans", "_words")
    out = docs.withColumn(spans, F.lit(None).cast(_SPANS)).withColumn(count, F.lit(None).cast("int"))
    schema = out.schema
    for i in range(slices):
        part = items if slices == 1 else items.where(F.pmod(F.xxhash64("item_id"), F.lit(slices)) == i)
        shared = spark.sparkContext.broadcast(Grams(part.collect(), n, shortest))
        out = out.mapInArrow(task(_mark(shared)), schema)
        if slices > 1:
            out = cut(out)
            shared.destroy()
    return out


def _hit_words(spans: str) -> Column:
    return F.aggregate(spans, F.lit(0), lambda n, s: n + s.end_word - s.start_word)


def contaminated(docs: DataFrame, benchmark: DataFrame, n: int = N, shortest: int = SHORTEST, drop_share: float = DROP_SHARE, slice_words: int = SLICE_WORDS) -> DataFrame:
    """A row for each span: doc_id, item_id, its words and characters, the document's words, those in spans, and 'drop' or 'cut'."""
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    marked = _marked(docs, benchmark, n, shortest, slice_words).where("size(_spans) > 0").withColumn("hit_words", _hit_words("_spans"))
    action = F.when(F.col("hit_words") >= drop_share * F.col("_words"), "drop").otherwise("cut")
    return marked.select("doc_id", F.explode("_spans").alias("s"), F.col("_words").alias("doc_words"), "hit_words", action.alias("action")).select("doc_id", "s.*", "doc_words", "hit_words", "action")


@F.arrow_udf(T.StringType())
def _cut(texts: pa.Array, spans: pa.Array) -> pa.Array:
    out = []
    for text, cuts in zip(texts.to_pylist(), spans.to_pylist()):
        if cuts:
            edges = [0, *(e for s in cuts for e in (s["start_char"], s["end_char"])), len(text)]
            text = "".join(text[a:b] for a, b in zip(edges[::2], edges[1::2]))
        out.append(text)
    return pa.array(out, pa.string())


def clean(docs: DataFrame, benchmark: DataFrame, n: int = N, shortest: int = SHORTEST, drop_share: float = DROP_SHARE, slice_words: int = SLICE_WORDS) -> DataFrame:
    """``docs`` without benchmark passages: spans cut out (n_chars set anew, where there is one), mostly contaminated documents gone."""
    columns = docs.columns
    # the map's columns have plain names: it takes none with dots
    docs = docs.toDF(*(c if c in ("text", "n_chars") else f"column{i}" for i, c in enumerate(columns)))
    plain = docs.columns
    marked = _marked(docs, benchmark, n, shortest, slice_words)
    spans, words = marked.columns[-2:]
    (hit,) = unused(marked, "_hit")
    marked = marked.withColumn(hit, _hit_words(spans)).where((F.col(hit) == 0) | (F.col(hit) < drop_share * F.col(words)))
    out = marked.withColumn("text", F.when(F.col(hit) > 0, _cut("text", spans)).otherwise(F.col("text")))
    if "n_chars" in columns:
        out = out.withColumn("n_chars", F.when(F.col(hit) > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.select(*plain).toDF(*columns)


def op3_decontaminate(spark, sf_dir: str) -> DataFrame:
    return contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


OP3_SQL = r"""
with words as (
  select doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') as w from documents),
grams as (
  select doc_id, len(w) as n, i, array_to_string(w[i:i + 9], ' ') as g
  from (select doc_id, w, unnest(range(1, len(w) - 8)) as i from words)),
items as (
  select item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') as w from benchmark),
item_grams as (
  select g, min(item_id) as item_id from (
    select item_id, array_to_string(w[i:i + 9], ' ') as g
    from (select item_id, w, unnest(range(1, len(w) - 8)) as i from items)) group by g),
hits as (
  select doc_id, n, i - 1 as a, item_id from grams join item_grams using (g)),
marks as (
  select *, case when a <= lag(a) over (partition by doc_id order by a) + 10 then 0 else 1 end as new from hits),
islands as (
  select *, sum(new) over (partition by doc_id order by a rows unbounded preceding) as k from marks),
spans as (
  select doc_id, min(item_id) as item_id, min(a) as start_word, max(a) + 10 as end_word, any_value(n) as doc_words from islands group by doc_id, k),
pieces as (
  select doc_id, regexp_extract_all(text, '[^\p{L}\p{N}]+|[\p{L}\p{N}]+') as p from documents where doc_id in (select doc_id from spans)),
places as (
  select doc_id, row_number() over (partition by doc_id order by i) - 1 as word, total - length(x) as a, total as b
  from (select doc_id, i, p[i] as x, sum(length(p[i])) over (partition by doc_id order by i) as total from (select doc_id, p, unnest(range(1, len(p) + 1)) as i from pieces))
  where regexp_matches(x, '[\p{L}\p{N}]')),
totals as (
  select doc_id, sum(end_word - start_word) as hit_words from spans group by doc_id)
select spans.doc_id, item_id, cast(start_word as integer) as start_word, cast(end_word as integer) as end_word,
  cast(doc_words as integer) as doc_words, cast(hit_words as integer) as hit_words,
  case when hit_words >= 0.5 * doc_words then 'drop' else 'cut' end as action,
  cast(s.a as integer) as start_char, cast(e.b as integer) as end_char
from spans join totals using (doc_id)
join places s on s.doc_id = spans.doc_id and s.word = start_word
join places e on e.doc_id = spans.doc_id and e.word = end_word - 1
"""
