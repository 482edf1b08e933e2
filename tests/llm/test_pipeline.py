"""The pipeline stage by stage, each against brute force on its own input."""

import re

import corpus_pipeline
import tiktoken
from lograil.llm import bpe, quality
from pyspark.sql import functions as F
from test_line_dedup import brute as alike_lines
from test_near_dedup import groups, pairs

STAGES = dict(corpus_pipeline.STAGES)
WORD = re.compile(r"[^\W_]+")


def table(df):
    return {r.doc_id: r.text for r in df.collect()}


def fixed(spark, df):
    """The stage's output as the next one's input, computed once."""
    return spark.createDataFrame(df.collect(), df.schema)


def without_passages(text, items, n=10):
    """None: most of the text is benchmark; else the text without it."""
    words = [(m.group().lower(), *m.span()) for m in WORD.finditer(text)]
    hit = [False] * len(words)
    for size in range(5, n + 1):
        known = {tuple(w[i : i + size]) for w in items if size == min(n, len(w)) for i in range(len(w) - size + 1)}
        for i in range(len(words) - size + 1):
            if tuple(w for w, _, _ in words[i : i + size]) in known:
                hit[i : i + size] = [True] * size
    if not any(hit):
        return text
    if sum(hit) >= 0.5 * len(words):
        return None
    out, at = "", 0
    for i, (h, (_, a, b)) in enumerate(zip(hit, words)):
        if h:
            if i == 0 or not hit[i - 1]:
                out += text[at:a]
            at = b
    return out + text[at:]


def test_each_stage_against_brute_force(spark, tiny):
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    kept = fixed(spark, STAGES["quality classifier"](spark, docs, tiny))
    assert set(table(kept)) == {r.doc_id for r in quality.op10_quality(spark, tiny).collect()} and kept.columns == docs.columns

    lined = fixed(spark, STAGES["line dedup"](spark, kept, tiny))
    gone = {}
    for d, n, _, _ in alike_lines(table(kept)):
        gone.setdefault(d, set()).add(n)
    want = {d: t for d, t in ((d, "\n".join(x for i, x in enumerate((t or "").split("\n")) if i not in gone.get(d, ()))) for d, t in table(kept).items()) if d not in gone or t.strip()}
    got = table(lined)
    assert lined.columns == docs.columns and set(got) == set(want) and sum(got[d] == want[d] for d in got) >= 0.97 * len(got)

    apart = fixed(spark, STAGES["near dedup"](spark, lined, tiny))
    copies = {x for x, _ in groups(pairs(list(got.items())))}
    assert apart.columns == docs.columns and set(got) - copies <= set(table(apart)) and len(set(table(apart)) & copies) <= 0.03 * max(34, len(copies))

    clean = fixed(spark, STAGES["decontamination"](spark, apart, tiny))
    items = [[m.lower() for m in WORD.findall(r.text)] for r in spark.read.parquet(f"{tiny}/benchmark.parquet").collect()]
    want = {d: x for d, t in table(apart).items() if (x := without_passages(t or "", items)) is not None}
    assert clean.columns == docs.columns and {d: t or "" for d, t in table(clean).items()} == want

    enc = bpe.encoding(bpe.read_ranks(bpe.rank_file()), bpe.PATTERN)
    rows = STAGES["bpe"](spark, clean, tiny).collect()
    assert isinstance(enc, tiktoken.Encoding) and {r.doc_id: r.tokens for r in rows} == {d: enc.encode_ordinary(t) for d, t in table(clean).items()}


def test_whole_run_equals_its_stages(spark, tiny):
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = fixed(spark, stage(spark, docs, tiny))
    assert sorted(map(str, corpus_pipeline.run(spark, tiny).collect())) == sorted(map(str, docs.collect()))


def test_edges_pass_through_all_stages(spark, tiny):
    long = " ".join(f"w{i}" for i in range(50_000))
    data = [(1, None, None), (2, "", "x"), (None, "a text without an id", "x"), (None, None, None), (3, "twice the same row of text", "x"), (3, "twice the same row of text", "x"), (4, long, "x")]
    docs = spark.createDataFrame(data, "doc_id long, text string, source string").selectExpr("*", "1 as _words", "2 as _gone", "3 as _scores", "4 as `key.b`")
    for name, stage in corpus_pipeline.STAGES:
        out = fixed(spark, stage(spark, docs, tiny))
        empty = stage(spark, docs.where("false"), tiny)
        assert empty.count() == 0
        if name != "bpe":
            assert out.columns == docs.columns == empty.columns
            docs = out
    found = {(r.doc_id, r.n_bytes, r.round_trip) for r in out.collect()}
    assert {(1, None, None), (2, 0, True), (None, None, None), (4, len(long), True)} <= found and out.where(F.col("doc_id") == 3).count() == 2
