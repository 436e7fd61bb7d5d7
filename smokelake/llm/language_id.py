"""Operator 7, language ID by error-correcting output codes.

Each language gets a codeword of bits. One binary classifier over hashed byte n-grams predicts each bit; decoding sums the
logistic losses of the predicted margins against every codeword and takes the least. A small gap to the next codeword
flags the row as ambiguous.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import appended, checked, forget, materialize, unit_hash


@dataclass(frozen=True)
class LanguageSettings:
    """sample: labelled rows that the fit takes, shared by the languages, but one row for each of them at least, and twice as many at most; buckets: hashed n-gram features; orders: n-gram lengths in bytes; gap: least lead of the best codeword's probability that isn't ambiguous."""

    sample: int = 4000
    buckets: int = 4096
    orders: tuple[int, ...] = (1, 2, 3, 4)
    epochs: int = 60
    rate: float = 0.05
    decay: float = 1e-4
    gap: float = 0.2
    seed: int = 7


#: ASCII that is no letter counts as a space.
_LETTERS = np.array([b if b >= 128 or chr(b).isalpha() else 32 for b in range(256)], dtype=np.uint32)


def features(text: str, s: LanguageSettings) -> np.ndarray:
    """Hashed byte n-gram counts of the whole text in lower case."""
    codes = _LETTERS[np.frombuffer(f" {text.lower()} ".encode(), dtype=np.uint8)]
    codes = codes[(codes != 32) | (np.concatenate(([0], codes[:-1])) != 32)]  # one space in place of many
    total = np.zeros(s.buckets, dtype=np.uint32)
    rolled = np.zeros(len(codes) + 1, dtype=np.uint32)
    for k in range(1, max(s.orders) + 1):
        if k > len(codes):
            break
        rolled = rolled[:-1] * np.uint32(257) + codes[k - 1 :] + np.uint32(k)
        if k in s.orders:
            mixed = (rolled ^ (rolled >> np.uint32(15))) * np.uint32(0x9E3779B1)
            total += np.bincount(mixed >> np.uint32(32 - int(s.buckets).bit_length() + 1), minlength=s.buckets).astype(np.uint32)
    return total


def scaled(counts: np.ndarray) -> np.ndarray:
    """Square roots at unit length, row by row."""
    x = np.sqrt(counts.astype(np.float32))
    return x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-9)


def codewords(n: int, seed: int) -> np.ndarray:
    """n codewords of +1 and -1. Up to 6 classes every distinct split is a bit; beyond, the best of up to 200 seeded random codes by least distance, of fewer where there are many classes."""
    if n <= 6:
        splits = [s for s in itertools.product((1, -1), repeat=n) if s[0] == 1 and -1 in s]
        return np.array(splits or [[1] * n], dtype=np.float32).T
    rng = np.random.default_rng(seed)
    bits = int(np.ceil(10 * np.log2(n)))
    tries = (rng.choice(np.array([1, -1], dtype=np.float32), size=(n, bits)) for _ in range(max(1, min(200, 200_000_000 // n**2))))
    return max(tries, key=lambda c: _least_distance(c) if n <= 10_000 else 0)


def _least_distance(c: np.ndarray) -> float:
    """The least distance of two codewords, times two; a thousand rows of all pairs at a time."""
    n, bits = c.shape
    least = np.inf
    for lo in range(0, n, 1000):
        same = c[lo : lo + 1000] @ c.T
        same[np.arange(len(same)), np.arange(lo, lo + len(same))] = -bits
        least = min(least, bits - same.max())
    return least


@dataclass
class LanguageModel:
    languages: list[str]
    code: np.ndarray
    weights: np.ndarray
    bias: np.ndarray

    def decode(self, x: np.ndarray) -> np.ndarray:
        """Probability of each language for rows of scaled features, by loss-weighted decoding."""
        margins = x @ self.weights + self.bias
        loss = np.logaddexp(0, -margins) @ (self.code > 0).T.astype(margins.dtype) + np.logaddexp(0, margins) @ (self.code < 0).T.astype(margins.dtype)
        p = np.exp(loss.min(axis=1, keepdims=True) - loss)
        return p / p.sum(axis=1, keepdims=True)


def fit_arrays(x: np.ndarray, labels: list[str], s: LanguageSettings) -> LanguageModel:
    """Logistic fits of all bits at once by Adam; each language weighs the same."""
    languages = sorted(set(labels))
    code = codewords(len(languages), s.seed)
    place = {v: k for k, v in enumerate(languages)}
    y = np.array([place[v] for v in labels])
    target = code[y]
    weight = (len(y) / (len(languages) * np.bincount(y)))[y][:, None].astype(np.float32)
    w, b = np.zeros((x.shape[1], code.shape[1]), np.float32), np.zeros(code.shape[1], np.float32)
    state = [np.zeros_like(w), np.zeros_like(w), np.zeros_like(b), np.zeros_like(b)]
    rng, step = np.random.default_rng(s.seed), 0
    for _ in range(s.epochs):
        order = rng.permutation(len(y))
        for at in range(0, len(order), 256):
            rows, step = order[at : at + 256], step + 1
            z = x[rows] @ w + b
            g = -target[rows] / (1 + np.exp(target[rows] * z)) * weight[rows] / len(rows)
            for k, (p, d) in enumerate(((w, x[rows].T @ g + s.decay * w), (b, g.sum(axis=0)))):
                m, v = state[2 * k], state[2 * k + 1]
                m += 0.1 * (d - m)
                v += 0.001 * (d * d - v)
                p -= s.rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return LanguageModel(languages, code, w, b)


def fit(docs: DataFrame, learn: Column, settings: LanguageSettings = LanguageSettings(), text: str = "text", lang: str = "lang", key: str = "doc_id") -> LanguageModel:
    """Fit on rows where learn holds and text and lang are not null.

    Labels are counted over all rows, and every label is learned. Of each language a seeded sample of about sample / languages rows
    is taken, its first row in seeded order always; their features are made on the executors, and only these bounded rows
    reach the driver. Ids and texts place rows in the sample; rows that repeat both share a place. With no
    row to learn from (an empty table, no label) every text is `und`.
    """
    s = settings
    rows = docs.filter(learn & F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(key).alias("id"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    rows = rows.withColumn("place", unit_hash(F.col("id").cast("string"), F.col("text"), seed=s.seed))
    counts = materialize(rows.groupBy("lang").agg(F.count("*").alias("n"), F.min("place").alias("first")))
    n = counts.count()
    if not n:
        return LanguageModel([], np.zeros((0, 0), np.float32), np.zeros((s.buckets, 0), np.float32), np.zeros(0, np.float32))
    rates = counts.select(F.col("lang").alias("of"), F.greatest(F.lit(s.sample / n) / F.col("n"), "first").alias("rate"))

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"place": pdf["place"], "lang": pdf["lang"], "x": [features(t, s).tobytes() for t in pdf["text"]]})

    taken = rows.join(checked(rates, 100_000), (F.col("lang") == F.col("of")) & (F.col("place") <= F.col("rate")))
    # the first rows of all languages come before the others, so the bound drops none of them
    taken = taken.select("place", "lang", "text", F.row_number().over(Window.partitionBy("lang").orderBy("place", F.xxhash64("text"))).alias("nth"))
    picked = taken.orderBy(F.col("nth") > 1, "place", "lang").limit(2 * max(s.sample, n)).select("place", "lang", "text")
    got = sorted(picked.mapInPandas(make, "place double, lang string, x binary").collect())
    forget(counts)
    x = scaled(np.stack([np.frombuffer(r["x"], dtype=np.uint32) for r in got]))
    return fit_arrays(x, [r["lang"] for r in got], s)


def language_id(docs: DataFrame, model: LanguageModel, settings: LanguageSettings = LanguageSettings(), text: str = "text", carry: Sequence[str] | None = None) -> DataFrame:
    """Add lang_pred, score (probability of the decoded language, 0 to 1) and ambiguous.

    Null texts and texts without a letter give `und`, score 0 and ambiguous true. Long texts are read whole. Rows are
    independent of each other: repeated rows give repeated results, an empty table gives no rows; other columns (those named
    in carry, or all) pass through, and those named like the new ones are replaced. Ties between codewords go to the
    language first in order. The model holds buckets x bits weights and is broadcast.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        model = shared.value

        def columns(texts: list[str | None]) -> list:
            told = np.array([bool(model.languages) and bool(t) and any(map(str.isalpha, t)) for t in texts], dtype=bool)
            pred, score, unsure = np.array(["und"] * len(texts), dtype=object), np.zeros(len(texts)), np.ones(len(texts), dtype=bool)
            at = np.flatnonzero(told)
            for lo in range(0, len(at), 256):
                part = at[lo : lo + 256]
                p = model.decode(scaled(np.stack([features(texts[k], settings) for k in part])))
                ranked = np.sort(p, axis=1)
                pred[part] = np.array(model.languages, dtype=object)[p.argmax(axis=1)]
                score[part] = ranked[:, -1]
                unsure[part] = (ranked[:, -1] - ranked[:, -2] < settings.gap) if p.shape[1] > 1 else False
            return [pred.tolist(), score, unsure]

        return columns

    return appended(docs, text, "lang_pred string, score double, ambiguous boolean", make, carry)
