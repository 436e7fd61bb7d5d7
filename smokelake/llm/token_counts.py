"""Operator 1, token counts by the whole-token shortcut.

Before the job, every word-end string of the vocabulary is merged once on the driver; those that give exactly one token
are proven. In the job a pre-token in that set counts as one, and only the rest is merged.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import appended
from .word_bpe import Memo, WordBpe


def text_counter(bpe: WordBpe, single: frozenset[str]) -> Callable[[str | None], int]:
    """Function text -> number of tokens, without added special tokens; null counts as the empty text."""
    merged = Memo(lambda t: len(bpe.merge(t)))

    def count(text: str | None) -> int:
        if not text:
            return 0
        tokens = bpe.pre_tokens(text)
        rest = [t for t in tokens if t not in single]
        return len(tokens) - len(rest) + sum(map(merged.__getitem__, rest))

    return count


def token_counts(docs: DataFrame, tokenizer_path: str, limit: int = 2048, text: str = "text", carry: Sequence[str] | None = None) -> DataFrame:
    """Add n_bytes, n_tokens and over_limit (n_tokens > limit) to every row.

    Null and empty texts have 0 bytes and 0 tokens. Long texts are processed whole. Rows are independent: repeated rows
    give repeated results, an empty table gives no rows, other columns (those named in carry, or all) pass through, and
    columns named like the new ones are replaced. The vocabulary and the proven set are broadcast; both are bounded by the
    vocabulary file.
    """
    bpe = WordBpe.load(tokenizer_path)
    shared = docs.sparkSession.sparkContext.broadcast((bpe, bpe.single_tokens()))

    def make():
        count = text_counter(*shared.value)
        return lambda texts: [[len(t.encode()) if t else 0 for t in texts], [count(t) for t in texts]]

    return appended(docs, text, "n_bytes long, n_tokens long", make, carry).withColumn("over_limit", F.col("n_tokens") > limit)
