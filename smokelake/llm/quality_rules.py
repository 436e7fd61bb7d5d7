"""Operator 9, quality rules by repetition coverage.

Each text becomes an array of word hashes; rolling hashes over it find the word n-grams that occur twice or more. The
share of the text's characters that lies inside repeated n-grams or repeated lines, and in the most frequent short n-gram, decides.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame

from .common import appended

SYMBOLS = b"#*$%&|<>"
_BASE = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class RepetitionRules:
    """Most a kept text may have; the shares are the published limits of the Gopher rules (Rae et al. 2021, table A1).

    max_repeat_percent: of the words, in 3-word windows found twice or more. max_top: by n-gram length in words, the share of
    word characters in the most frequent n-gram. max_coverage: by length, the share inside later occurrences of n-grams.
    max_lines, max_line_chars: shares of lines and of word characters that equal an earlier line.
    """

    min_words: int = 50
    max_repeat_percent: int = 50
    max_top: tuple[tuple[int, float], ...] = ((2, 0.20), (3, 0.18), (4, 0.16))
    max_coverage: tuple[tuple[int, float], ...] = ((5, 0.15), (6, 0.14), (7, 0.13), (8, 0.12), (9, 0.11), (10, 0.10))
    max_lines: float = 0.30
    max_line_chars: float = 0.20


def inside(starts: np.ndarray, length: int, n: int) -> np.ndarray:
    """Which of n words lie in a window of so many words that begins at one of the starts."""
    edge = np.zeros(n + 1, dtype=np.int32)
    edge[starts] = 1
    edge[length:] -= edge[: n + 1 - length].copy()
    return np.cumsum(edge[:n]) > 0


def repeats(grams: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """For each window, how often its hash occurs and whether it did before; and the starts of the windows of the top count. None if no hash repeats."""
    ordered = np.sort(grams)
    if not (ordered[1:] == ordered[:-1]).any():
        return None
    _, first, group, counts = np.unique(grams, return_index=True, return_inverse=True, return_counts=True)
    return counts[group], first[group] != np.arange(len(grams)), first[counts == counts.max()]


@dataclass
class Measures:
    n_words: int = 0
    word_chars: int = 0
    n_symbols: int = 0
    n_dup_lines: int = 0
    n_repeat_words: int = 0
    dup_line_share: float = 0.0
    dup_char_share: float = 0.0
    top: dict[int, float] | None = None
    coverage: dict[int, float] | None = None


def measure(text: str | None, rules: RepetitionRules) -> Measures:
    """All measures of a text; shares by length hold 0 where nothing repeats."""
    top_lengths, cover_lengths = [k for k, _ in rules.max_top], [k for k, _ in rules.max_coverage]
    data = text.encode("utf-8") if text else b""
    m = Measures(top=dict.fromkeys(top_lengths, 0.0), coverage=dict.fromkeys(cover_lengths, 0.0))
    m.n_symbols = len(data) - len(data.translate(None, SYMBOLS))
    words = data.split()  # bytes split at ASCII white space alone
    m.n_words = n = len(words)
    if not n:
        return m
    sizes = np.fromiter(map(len, words) if text.isascii() else (len(w.decode("utf-8")) for w in words), dtype=np.int64, count=n)
    m.word_chars = chars = int(sizes.sum())
    seen: set[bytes] = set()
    lines = dup_chars = 0
    for line in data.split(b"\n") if b"\n" in data else ():
        if line in seen:
            lines += 1
            m.n_dup_lines += 1
            dup_chars += sum(len(w.decode("utf-8")) for w in line.split())
        elif line.split(None, 1):
            lines += 1
            seen.add(line)
    m.dup_line_share, m.dup_char_share = m.n_dup_lines / max(lines, 1), dup_chars / chars
    rolled = own = np.fromiter(map(hash, words), dtype=np.int64, count=n).view(np.uint64)
    ends = np.concatenate(([0], np.cumsum(sizes)))
    for k in range(2, min(max([3, *top_lengths, *cover_lengths]), n) + 1):
        rolled = rolled[:-1] * _BASE + own[k - 1 :]
        if k != 3 and k not in m.top and k not in m.coverage:
            continue
        found = repeats(rolled)
        if found is None:
            break  # a longer n-gram can't repeat either
        counts, later, top = found
        if k == 3:
            m.n_repeat_words = int(inside(np.flatnonzero(counts > 1), k, n).sum())
        if k in m.top:
            m.top[k] = float(counts.max() * (ends[top + k] - ends[top]).max()) / chars
        if k in m.coverage:
            m.coverage[k] = float(sizes[inside(np.flatnonzero(later), k, n)].sum()) / chars
    return m


def verdict(m: Measures, rules: RepetitionRules) -> tuple[bool, str | None]:
    """Whether the base rule fails, and the name of the first rule that does (null: kept)."""
    if m.n_words < rules.min_words:
        return True, "words"
    if 100 * m.n_repeat_words > rules.max_repeat_percent * m.n_words:
        return True, "repeat_words"
    if m.dup_line_share > rules.max_lines:
        return False, "lines"
    if m.dup_char_share > rules.max_line_chars:
        return False, "line_chars"
    over = [f"top_{k}" for k, most in rules.max_top if m.top[k] > most] + [f"coverage_{k}" for k, most in rules.max_coverage if m.coverage[k] > most]
    return False, over[0] if over else None


def quality_rules(docs: DataFrame, rules: RepetitionRules = RepetitionRules(), text: str = "text", carry: Sequence[str] | None = None) -> DataFrame:
    """Add the measures (n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, dup_line_share, dup_char_share; top and coverage, maps by n-gram length) and the decisions base_failed, failed_rule and kept.

    base_failed: fewer than min_words words, or over max_repeat_percent of the words in repeated 3-word windows. kept: not
    base_failed and no measure over its limit; failed_rule names the first one that is. Null and empty texts have no words
    and fail; n-grams longer than the text count 0. Long texts are measured whole; repeated rows give repeated results, an
    empty table gives no rows. Other columns (those named in carry, or all) pass through; those named like the new ones are replaced.
    """

    def make():
        def columns(texts: list[str | None]) -> list[list]:
            found = [measure(t, rules) for t in texts]
            told = [verdict(m, rules) for m in found]
            numbers = [[getattr(m, c) for m in found] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "dup_line_share", "dup_char_share")]
            maps = [[list(x.items()) for x in column] for column in ([m.top for m in found], [m.coverage for m in found])]
            return [*numbers, *maps, [base for base, _ in told], [rule for _, rule in told], [rule is None for _, rule in told]]

        return columns

    counts = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, dup_line_share double, dup_char_share double"
    return appended(docs, text, f"{counts}, top map<int,double>, coverage map<int,double>, base_failed boolean, failed_rule string, kept boolean", make, carry)
