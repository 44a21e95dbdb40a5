"""Encoding a corpus with a public byte-level BPE, and decoding it again.

The rank file is a parameter; each Python worker loads it once. Texts go through in Arrow batches. A long text is first cut at
safe boundaries: just before a blank or line feed that follows a letter or digit. The pre-split pattern of these vocabularies
never joins the two sides of such a place, and looks ahead only, so the pieces' ids are those of the whole text.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the pre-split pattern that belongs to the vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PIECE = 100_000
_SAFE = regex.compile(r"(?<=[\p{L}\p{N}])(?=[ \n])")
_LOADED: dict[str, object] = {}


def tokenizer(ranks: str):
    if ranks not in _LOADED:
        import tiktoken

        with open(ranks, "rb") as f:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _LOADED[ranks] = tiktoken.Encoding("local", pat_str=PATTERN, mergeable_ranks=table, special_tokens={})
    return _LOADED[ranks]


def pieces(text: str, size: int = PIECE) -> Iterator[str]:
    """The text in pieces of about ``size`` characters, cut only at safe boundaries; a stretch without any stays whole."""
    start = 0
    while len(text) - start > size:
        cut = _SAFE.search(text, start + size)
        if not cut:
            break
        yield text[start : cut.start()]
        start = cut.start()
    yield text[start:]


def encode_text(text: str | None, enc) -> list[int]:
    if not text:
        return []
    if len(text) <= PIECE:
        return enc.encode_ordinary(text)
    return [i for p in pieces(text) for i in enc.encode_ordinary(p)]


def encode(df: DataFrame, text: str, ranks: str = RANKS):
    """A column expression with the ids of ``text``: array<int>, empty for empty and null texts. Special tokens are ordinary text."""

    @F.pandas_udf("array<int>")
    def ids(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        enc = tokenizer(ranks)
        for s in batches:
            yield pd.Series([encode_text(x, enc) for x in s], index=s.index, dtype=object)

    return ids(df[text])


def decode(df: DataFrame, ids: str, ranks: str = RANKS):
    """The text of the ids, joined as raw bytes before decoding, since a character may be spread over several ids."""

    @F.pandas_udf("string")
    def text(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        enc = tokenizer(ranks)
        for s in batches:
            yield pd.Series([b"".join(enc.decode_tokens_bytes([int(i) for i in x])).decode("utf-8", "replace") for x in s], index=s.index, dtype=object)

    return text(df[ids])
