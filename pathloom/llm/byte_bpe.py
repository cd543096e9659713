"""Byte-level BPE encoding and decoding with the tiktoken library and a local rank file.

Long texts are split by a regex at boundaries where the pre-splitting pattern always ends a match, so
the pieces encode to the same ids as the whole text; ids decode to raw bytes, which need not be UTF-8.

Defined cases: a null or empty text has no ids; texts of any length are encoded whole; equal texts get
equal ids, and of two merges the one of the lower rank comes first; an empty table gives an empty table; other columns pass, those named like an output are replaced.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import public_tokenizers
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathloom.llm.shared import map_text

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
#: Characters of text that are encoded at a time.
PIECE_CHARS = 1 << 16
#: Between a visible character and a space or line feed every match of the pattern ends, and no
#: earlier match looks past this point.
SAFE = regex.compile(r"(?<=[\p{L}\p{N}\p{P}\p{S}])(?=[ \n])")

_codecs: dict[tuple[str, str], Codec] = {}


def pieces(text: str, chars: int = PIECE_CHARS) -> Iterator[str]:
    """The text cut at safe boundaries into pieces of ``chars`` or a little more characters."""
    at = 0
    while len(text) - at > chars:
        found = SAFE.search(text, at + chars)
        if not found:
            break
        yield text[at : found.start()]
        at = found.start()
    yield text[at:]


class Codec:
    """Encoder and decoder for one rank file and pattern."""

    def __init__(self, ranks: str = RANKS, pattern: str = public_tokenizers.PATTERN) -> None:
        with open(ranks, "rb") as lines:
            merges = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.encoding = tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=merges, special_tokens={})

    def encode(self, text: str) -> list[int]:
        ids: list[int] = []
        for piece in pieces(text):
            ids += self.encoding.encode_ordinary(piece)
        return ids

    def decode(self, ids: Iterable[int]) -> bytes:
        return self.encoding.decode_bytes(list(ids))


def codec(ranks: str = RANKS, pattern: str = public_tokenizers.PATTERN) -> Codec:
    """The codec of this worker, loaded once."""
    if (ranks, pattern) not in _codecs:
        _codecs[ranks, pattern] = Codec(ranks, pattern)
    return _codecs[ranks, pattern]


def encode(df: DataFrame, text: str = "text", ids: str = "ids", ranks: str = RANKS, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """Adds the ids of each whole text as ``array<int>``."""
    return map_text(df, text, {ids: "array<int>"}, lambda texts: [[codec(ranks, pattern).encode(t) for t in texts]])


def decode(df: DataFrame, ids: str = "ids", data: str = "data", ranks: str = RANKS, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """Adds the raw bytes of each list of ids (null: no bytes)."""

    def udf(column: pd.Series) -> pd.Series:
        c = codec(ranks, pattern)
        return column.map(lambda x: c.decode([] if x is None else x.tolist()))

    return df.withColumn(data, F.pandas_udf(udf, "binary")(ids))


def digests(df: DataFrame, text: str = "text", ranks: str = RANKS, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """Encodes, decodes the ids again, and replaces the text by digests of both."""

    def fn(texts: list[str]) -> list[list]:
        c = codec(ranks, pattern)
        n, ids_sha, data_sha = [], [], []
        for t in texts:
            ids = c.encode(t)
            n.append(len(ids))
            ids_sha.append(hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
            data_sha.append(hashlib.sha256(c.decode(ids)).hexdigest())
        return [n, ids_sha, data_sha]

    return map_text(df, text, {"n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"}, fn, drop=(text,))
