import random

from lograil.llm import bpe


def test_whole_table_round_trip(spark, tiny):
    enc = bpe.encoding(bpe.read_ranks(bpe.rank_file()), bpe.PATTERN)
    got = {r.doc_id: r for r in bpe.op6_bpe(spark, tiny).collect()}
    docs = spark.read.parquet(f"{tiny}/documents.parquet").collect()
    assert len(got) == len(docs)
    for d in docs:
        assert got[d.doc_id].round_trip and got[d.doc_id].tokens == enc.encode_ordinary(d.text) and got[d.doc_id].n_bytes == len(d.text.encode())


def test_safe_boundaries():
    enc = bpe.encoding(bpe.read_ranks(bpe.rank_file()), bpe.PATTERN)
    rng = random.Random(3)
    parts = [" ", "  ", "\n", "\n\n", "\t", "word", "Zähler", "12", "don't", "'s", "!!", " ", "　", "日本", "\x1c", "_", "é", "🙂"]
    for _ in range(300):
        text = "".join(rng.choices(parts, k=rng.randrange(1, 80)))
        assert "".join(bpe.split_safe(text, 5)) == text
        assert bpe.encode_text(enc, text, 5) == enc.encode_ordinary(text)
        assert enc.decode_bytes(enc.encode_ordinary(text)) == text.encode()
    assert len(bpe.split_safe("abc " * 50_000)) > 2 and len(bpe.split_safe("a" * 70_000)) == 1


def test_edges(spark):
    data = [(1, None), (2, ""), (None, "<|endoftext|>"), (2, ""), (5, "x " * 100_000), (6, "a" * 80_000)]
    df = spark.createDataFrame(data, "doc_id long, text string").selectExpr("*", "1 as tokens", "2 as n_tokens")
    out = bpe.encode(df)
    rows = out.collect()
    assert len(rows) == 6 and [r for r in rows if r.doc_id == 1][0][1:] == (None, None, None, None)
    assert [tuple(r[1:]) for r in rows if r.doc_id == 2] == [([], 0, 0, True)] * 2
    assert all(r.round_trip for r in rows if r.doc_id != 1) and [r.n_tokens > 1 for r in rows if r.doc_id is None] == [True]
    back = out.select("doc_id", bpe.decoder(spark)("tokens").alias("raw")).collect()
    assert {(r.doc_id, bytes(r.raw).decode() if r.raw is not None else None) for r in back} == set(data)
    bad = spark.createDataFrame([([999_999_999],), ([None],), (None,), ([],)], "t array<int>").select(bpe.decoder(spark)("t").alias("raw")).collect()
    assert [r.raw for r in bad] == [None, None, None, b""]
    assert bpe.encode(df.where("false")).count() == 0
