"""Operator 6, byte-level BPE encoding and decoding with tiktoken and a local rank file.

The rank file is read on the driver and its bytes (about 1 MB, the size of a
vocabulary) travel to the workers as a broadcast, so the path need only exist on
the driver.  Each worker builds the encoding once.  Long texts are split where
no piece of the pre-tokenising pattern can reach across: before a space or a
line break that follows a letter or digit and precedes anything but white
space.  The tokens are those of the unsplit text.  Decoding joins the tokens'
raw bytes; only whole documents are turned into text again.

Defined results.  Null text: null tokens, null counts.  Empty text: no tokens.
Special-token strings in a text are ordinary text.  Text without a safe boundary
stays in one piece, however long.  Repeated rows, null ids and any other columns
do not matter: the operator maps row by row.  An empty table gives no rows.
Decoding: a token id outside the vocabulary or a null gives null bytes.
"""

from __future__ import annotations

import base64
import functools
import re
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .exchange import batches
from .memory import task

#: The pre-tokenising pattern of the rank files in use.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
MAX_RANK_FILE = 64 << 20
CHUNK = 1 << 16
_SAFE = re.compile(r"(?<=[^\W_])(?=[ \n]\S)")


def rank_file(name: str = "byte_bpe_50k.tiktoken") -> str:
    """Path of a rank file of the installed public tokenizers."""
    import public_tokenizers

    return public_tokenizers.path(name)


def read_ranks(path: str) -> bytes:
    data = Path(path).read_bytes()
    if len(data) > MAX_RANK_FILE:
        raise ValueError(f"{path}: {len(data)} bytes are too many for a rank file")
    return data


@functools.lru_cache(maxsize=2)
def encoding(ranks: bytes, pattern: str) -> tiktoken.Encoding:
    table = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, ranks.splitlines()) if token}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=table, special_tokens={})


def split_safe(text: str, chunk: int = CHUNK) -> list[str]:
    """Pieces of at least ``chunk`` characters, the last one excepted, that encode independently."""
    if len(text) <= chunk:
        return [text]
    pieces, start = [], 0
    while cut := _SAFE.search(text, start + chunk):
        pieces.append(text[start : cut.start()])
        start = cut.start()
    return [*pieces, text[start:]]


def encode_text(enc: tiktoken.Encoding, text: str, chunk: int = CHUNK) -> list[int]:
    if len(text) <= chunk:
        return enc.encode_ordinary(text)
    return [token for piece in split_safe(text, chunk) for token in enc.encode_ordinary(piece)]


def encode(docs: DataFrame, path: str | None = None, pattern: str = PATTERN) -> DataFrame:
    """(doc_id, tokens, n_tokens, n_bytes, round_trip) of each document; round_trip: the decoded raw bytes are the text's."""
    ranks = docs.sparkSession.sparkContext.broadcast(read_ranks(path or rank_file()))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(ranks.value, pattern)
        for batch, texts in batches(it, chars=4_000_000):
            tokens = [None if t is None else encode_text(enc, t) for t in texts]
            raw = [None if t is None else t.encode("utf-8", "surrogatepass") for t in texts]
            same = [None if t is None else enc.decode_bytes(t) == r for t, r in zip(tokens, raw)]
            counts = np.array([len(t) if t else 0 for t in tokens], dtype=np.int64)
            flat = np.empty(int(counts.sum()), dtype=np.int32)
            at = 0
            for t, n in zip(tokens, counts):
                if n:
                    flat[at : at + n] = t
                    at += n
            null = np.array([t is None for t in tokens])
            offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets, mask=np.append(null, False)), pa.array(flat))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), lists, pa.array(counts, mask=null), pa.array([None if r is None else len(r) for r in raw], pa.int64()), pa.array(same, pa.bool_())],
                names=["doc_id", "tokens", "n_tokens", "n_bytes", "round_trip"],
            )

    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return docs.mapInArrow(task(run), "doc_id long, tokens array<int>, n_tokens long, n_bytes long, round_trip boolean")


def decoder(spark, path: str | None = None, pattern: str = PATTERN):
    """A function of a column of token lists: the raw bytes of the tokens."""
    ranks = spark.sparkContext.broadcast(read_ranks(path or rank_file()))

    @F.arrow_udf("binary")
    def decode(tokens: pa.Array) -> pa.Array:
        enc = encoding(ranks.value, pattern)
        out = []
        for ids in tokens.to_pylist():
            try:
                out.append(None if ids is None or None in ids else enc.decode_bytes(ids))
            except (KeyError, OverflowError):
                out.append(None)
        return pa.array(out, pa.binary())

    def column(tokens: Column | str) -> Column:
        return decode(F.col(tokens) if isinstance(tokens, str) else tokens)

    return column


def op6_bpe(spark, sf_dir: str) -> DataFrame:
    return encode(spark.read.parquet(f"{sf_dir}/documents.parquet"))
