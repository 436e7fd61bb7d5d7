"""Operator 8, BPE encoding and decoding.

Encoding merges each distinct pre-token with a priority queue over a linked symbol list (word_bpe.WordBpe.merge) and
keeps the result in a memo of its task, bounded in bytes. Decoding joins the vocabulary strings of the ids. Both work text by text, with
one vocabulary for each worker.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import appended
from .word_bpe import Memo, WordBpe


def text_encoder(bpe: WordBpe) -> Callable[[str | None], bytes]:
    """Function text -> ids as little-endian unsigned 32-bit integers."""
    pieces = Memo(lambda t: np.asarray(bpe.merge(t), dtype="<u4").tobytes())
    return lambda text: b"".join(map(pieces.__getitem__, bpe.pre_tokens(text))) if text else b""


def text_decoder(bpe: WordBpe) -> Callable[[bytes], str]:
    """Function ids -> text. This vocabulary family has no decoder of its own: strings are joined by single spaces."""
    names = bpe.token_names()
    return lambda ids: " ".join(map(names.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))


def _id_column(ids: list[bytes], packed: bool) -> pa.Array:
    if packed:
        return pa.array(ids, type=pa.binary())
    ends = np.cumsum([0, *(len(x) // 4 for x in ids)], dtype=np.int32)
    return pa.ListArray.from_arrays(ends, np.frombuffer(b"".join(ids), dtype="<i4"))


def _id_type(packed: bool) -> str:
    return "binary" if packed else "array<int>"


def encode(docs: DataFrame, tokenizer_path: str, text: str = "text", ids: str = "ids", packed: bool = False, carry: Sequence[str] | None = None) -> DataFrame:
    """Add the token ids of every whole text, without added special tokens, truncation or padding: an array of int, or with
    packed the ids as little-endian unsigned 32-bit integers (binary).

    Null and empty texts give no ids (an empty array). Long texts are encoded whole. Repeated rows give repeated results, an
    empty table gives no rows; other columns (those named in carry, or all) pass through, and a column named like the new
    one is replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(WordBpe.load(tokenizer_path))

    def make():
        one = text_encoder(shared.value)
        return lambda texts: [_id_column([one(t) for t in texts], packed)]

    return appended(docs, text, f"`{ids}` {_id_type(packed)}", make, carry)


def decode(rows: DataFrame, tokenizer_path: str, ids: str = "ids", text: str = "decoded", packed: bool = False, carry: Sequence[str] | None = None) -> DataFrame:
    """Add the decoded text of the ids; null or no ids give the empty text. Other rows and columns as in encode()."""
    shared = rows.sparkSession.sparkContext.broadcast(WordBpe.load(tokenizer_path))

    def make():
        one = text_decoder(shared.value)
        return lambda batch: [[one((x if packed else np.asarray(x, dtype="<u4").tobytes()) if x else b"") for x in batch]]

    return appended(rows, ids, f"`{text}` string", make, carry)


def encode_and_decode(docs: DataFrame, tokenizer_path: str, text: str = "text", ids: str = "ids", decoded: str = "decoded", packed: bool = False, carry: Sequence[str] | None = None) -> DataFrame:
    """encode() and decode() in one pass over the rows, text by text: adds the ids and what they decode to."""
    shared = docs.sparkSession.sparkContext.broadcast(WordBpe.load(tokenizer_path))

    def make():
        forth, back = text_encoder(shared.value), text_decoder(shared.value)

        def both(texts: list[str | None]) -> list:
            found = [forth(t) for t in texts]
            return [_id_column(found, packed), [back(x) for x in found]]

        return both

    return appended(docs, text, f"`{ids}` {_id_type(packed)}, `{decoded}` string", make, carry)
