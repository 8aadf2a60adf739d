"""Encoding of texts with a public byte-level BPE vocabulary, and decoding back to bytes."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rank file of the vocabulary byte_bpe_50k; every function takes another one as a parameter.
RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the vocabulary's own pre-splitting pattern.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Characters from which a text is encoded in parts.
LONG = 100_000
#: A place where the pattern ends one match and starts the next whatever stands around it: before the first white
#: space after something else, and between a letter or digit and a sign, or a letter and a digit.
SAFE = regex.compile(r"(?<=\S)(?=\s)|(?<=[\p{L}\p{N}])(?=[^\s\p{L}\p{N}])|(?<=\p{L})(?=\p{N})|(?<=\p{N})(?=\p{L})")


@lru_cache(2)
def encoder(ranks: bytes) -> tiktoken.Encoding:
    table = {base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks.splitlines() if line)}
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=table, special_tokens={})


def rank_file(spark: SparkSession, path: str = RANKS):
    """The rank file (about 1 MB, a fixed size) sent once to every executor, which then need not have it."""
    return spark.sparkContext.broadcast(Path(path).read_bytes())


def parts(text: str, long: int = LONG) -> Iterator[str]:
    """The text in pieces of about ``long`` characters, cut only at safe boundaries."""
    start = 0
    while len(text) - start > long:
        cut = SAFE.search(text, start + long)
        if not cut:
            break
        yield text[start : cut.start()]
        start = cut.start()
    yield text[start:]


def encode(enc: tiktoken.Encoding, text: str | None) -> list[int]:
    """Ids of a text; none for null. Names of special tokens are ordinary text."""
    if not text:
        return []
    if len(text) <= LONG:
        return enc.encode_ordinary(text)
    return [i for p in parts(text) for i in enc.encode_ordinary(p)]


def texts(column: pa.Array) -> list[str | None]:
    """Python strings of a column; bytes that are no UTF-8 become U+FFFD."""
    try:
        return column.to_pylist()
    except UnicodeDecodeError:
        return [None if x is None else x.decode("utf-8", "replace") for x in column.cast(pa.binary()).to_pylist()]


def encode_texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranks: str = RANKS) -> DataFrame:
    """``id_col, ids``: the token ids of every row's whole text; an empty list for an empty and for a null text.

    Other columns are dropped, so their names cannot clash. Repeated rows stay repeated.
    """
    file = rank_file(df.sparkSession, ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(file.value)
        for b in batches:
            ids = [encode(enc, t) for t in texts(b.column(1))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int32()))], [id_col, "ids"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, F.col(text_col).alias("text_")).mapInArrow(run, f"`{id_col}` {kind}, ids array<int>")


def decode_ids(df: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", ranks: str = RANKS) -> DataFrame:
    """``id_col, text``: the tokens' bytes joined first and decoded then, so characters of several tokens come out whole.

    A null list gives null, an unknown id an error.
    """
    file = rank_file(df.sparkSession, ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(file.value)
        for b in batches:
            out = [None if i is None else enc.decode_bytes(i).decode("utf-8", "replace") for i in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string())], [id_col, "text"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, F.col(ids_col).alias("ids_")).mapInArrow(run, f"`{id_col}` {kind}, text string")
