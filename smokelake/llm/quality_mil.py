"""Operator 3, quality classifier by attention-based multiple-instance learning.

A document is a bag of passages. Every passage is encoded from hashed byte n-grams; gated attention, learned from the
document labels alone, weighs the passages, and the weighted representation is scored.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import appended, unit_hash


@dataclass(frozen=True)
class QualitySettings:
    """sample: labelled documents that the fit takes, with all their passages, twice as many at most; passage: bytes of a passage; buckets: hashed features (a power of two)."""

    sample: int = 3000
    passage: int = 512
    buckets: int = 1024
    width: int = 32
    gate: int = 16
    epochs: int = 40
    rate: float = 0.003
    decay: float = 1e-4
    seed: int = 3


#: Passages that are counted at a time.
PART = 64


def passages(text: str | None, s: QualitySettings) -> Iterator[np.ndarray]:
    """Hashed counts of byte 1-, 2- and 3-grams for each passage of the whole text (at least one passage), by where an n-gram begins; up to PART passages at a time."""
    codes = np.frombuffer((text or "").encode(), dtype=np.uint8)
    n = max(1, -(-len(codes) // s.passage))
    shift = np.uint32(32 - int(s.buckets).bit_length() + 1)
    for lo in range(0, n, PART):
        hi = min(lo + PART, n)
        part = codes[lo * s.passage : hi * s.passage + 2].astype(np.uint32)
        total = np.zeros((hi - lo) * s.buckets, dtype=np.int64)
        rolled = np.zeros(len(part) + 1, dtype=np.uint32)
        for k in range(1, min(3, len(part)) + 1):
            rolled = rolled[:-1] * np.uint32(257) + part[k - 1 :] + np.uint32(k)
            mixed = (((rolled ^ (rolled >> np.uint32(15))) * np.uint32(0x9E3779B1)) >> shift)[: (hi - lo) * s.passage]
            total += np.bincount(np.arange(len(mixed), dtype=np.int64) // s.passage * s.buckets + mixed, minlength=len(total))
        yield total.reshape(hi - lo, s.buckets).astype(np.uint16)


def scaled(counts: np.ndarray) -> np.ndarray:
    """Square roots at unit length, and two numbers that tell repetition: buckets in use per n-gram, and concentration."""
    x = np.sqrt(counts.astype(np.float32))
    total = np.maximum((x * x).sum(axis=1, keepdims=True), 1)
    used = np.count_nonzero(counts, axis=1)[:, None].astype(np.float32) / np.minimum(total, counts.shape[1])
    peak = np.sqrt((x**4).sum(axis=1, keepdims=True)) / total
    return np.concatenate([x / np.sqrt(total), used, peak], axis=1)


@dataclass
class QualityModel:
    """p: parameters by name; none if there was nothing to learn from. Wx, bx: passage encoder; V, U, w: gated attention; c, b: score of the weighted representation."""

    p: dict[str, np.ndarray]

    def encode(self, x: np.ndarray) -> np.ndarray:
        """Passages as they are weighed: of some tens of numbers each."""
        return np.tanh(x @ self.p["Wx"] + self.p["bx"])

    def forward(self, h: np.ndarray, starts: np.ndarray) -> dict[str, np.ndarray]:
        """h: encoded passages of several documents one after the other; starts: where each document begins."""
        p = self.p
        t, g = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["U"])))
        e = (t * g) @ p["w"]
        doc = np.repeat(np.arange(len(starts)), np.diff([*starts, len(h)]))
        a = np.exp(e - np.maximum.reduceat(e, starts)[doc])
        a /= np.add.reduceat(a, starts)[doc]
        z = np.add.reduceat(a[:, None] * h, starts, axis=0)
        return {"h": h, "t": t, "g": g, "a": a, "z": z, "doc": doc, "logit": z @ p["c"] + p["b"]}

    def gradients(self, x: np.ndarray, starts: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean logistic loss."""
        p, f = self.p, self.forward(self.encode(x), starts)
        d = (1 / (1 + np.exp(-f["logit"])) - y) / len(y)
        dz = d[:, None] * p["c"]
        da = (dz[f["doc"]] * f["h"]).sum(axis=1)
        de = f["a"] * (da - np.add.reduceat(f["a"] * da, starts)[f["doc"]])
        dt, dg = de[:, None] * p["w"] * f["g"] * (1 - f["t"] ** 2), de[:, None] * p["w"] * f["t"] * f["g"] * (1 - f["g"])
        dh = (f["a"][:, None] * dz[f["doc"]] + dt @ p["V"].T + dg @ p["U"].T) * (1 - f["h"] ** 2)
        return {"Wx": x.T @ dh, "bx": dh.sum(axis=0), "V": f["h"].T @ dt, "U": f["h"].T @ dg, "w": (f["t"] * f["g"]).T @ de, "c": f["z"].T @ d, "b": d.sum()}

    def score(self, h: np.ndarray, starts: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.forward(h, starts)["logit"].astype(np.float64)))


def fit_bags(bags: list[np.ndarray], y: np.ndarray, s: QualitySettings) -> QualityModel:
    """Adam over batches of 64 documents; bags hold passage counts, scaled batch by batch."""
    rng = np.random.default_rng(s.seed)
    shape = {"Wx": (s.buckets + 2, s.width), "bx": (s.width,), "V": (s.width, s.gate), "U": (s.width, s.gate), "w": (s.gate,), "c": (s.width,), "b": ()}
    p = {k: (rng.normal(0, 1 / np.sqrt(v[0]) if len(v) == 2 else 0.3, v) if k in ("Wx", "V", "U", "w", "c") else np.zeros(v)).astype(np.float32) for k, v in shape.items()}
    p["Wx"] *= np.float32(8)  # scaled inputs are short in each feature
    model = QualityModel(p)
    m, v, step = {k: np.zeros_like(x) for k, x in p.items()}, {k: np.zeros_like(x) for k, x in p.items()}, 0
    for _ in range(s.epochs):
        order = rng.permutation(len(bags))
        for at in range(0, len(order), 64):
            rows, step = order[at : at + 64], step + 1
            part = [bags[i] for i in rows]
            starts = np.cumsum([0, *(len(b) for b in part[:-1])])
            for k, d in model.gradients(scaled(np.concatenate(part)), starts, y[rows]).items():
                d = d + s.decay * p[k]
                m[k] = 0.9 * m[k] + 0.1 * d
                v[k] = 0.999 * v[k] + 0.001 * d * d
                p[k] = (p[k] - s.rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return model


def fit(docs: DataFrame, labels: DataFrame, learn: Column, settings: QualitySettings = QualitySettings(), text: str = "text", label: str = "label", key: str = "doc_id") -> QualityModel:
    """Fit on the documents of labels where learn (over the columns of labels) holds and the label is 0 or 1.

    Labels are counted over all ids; of each class a seeded sample of about sample / 2 ids is taken. That sample
    is bounded, so it is broadcast to the documents; all passages of the sampled documents are counted on the executors, and
    reach the driver as rows: 2 bytes a bucket, four times the sampled text. An id with several labels counts as the smallest of them; documents that repeat an id are bags of
    their own, null ids take no part, a null text is an empty one. With no row to learn from (an empty table, no or only
    null labels) every score is 0.5.
    """
    s = settings
    rows = labels.filter(learn & F.col(label).isin(0, 1) & F.col(key).isNotNull()).groupBy(F.col(key).alias("id")).agg(F.min(F.col(label).cast("int")).alias("label"))
    counts = {r[0]: r[1] for r in rows.groupBy("label").count().collect()}  # two rows at most
    if not counts:
        return QualityModel({})
    rate = F.lit(0.0)
    for k, n in sorted(counts.items()):
        rate = F.when(F.col("label") == k, F.lit(min(1.0, s.sample / 2 / n))).otherwise(rate)

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for place, label, doc, text in zip(pdf["place"], pdf["label"], pdf["doc"], pdf["text"], strict=True):
                rows = [p.tobytes() for part in passages(text, s) for p in part]
                yield pd.DataFrame({"place": place, "label": label, "doc": doc, "nth": range(len(rows)), "x": rows})

    place = unit_hash(F.col("id").cast("string"), seed=s.seed)
    sampled = rows.select("id", "label", place.alias("place")).filter(F.col("place") < rate).orderBy("place", "id").limit(2 * s.sample)
    texts = docs.select(F.col(key).alias("id"), F.col(text).alias("text"))
    picked = texts.join(F.broadcast(sampled), "id").orderBy("place", "id", F.xxhash64("text")).limit(2 * s.sample)
    picked = picked.select("place", "label", F.monotonically_increasing_id().alias("doc"), "text").repartition(32, "doc")
    got = picked.mapInPandas(make, "place double, label int, doc long, nth int, x binary").orderBy("place", "doc", "nth")
    bags, y, last = [], [], None
    for r in got.toLocalIterator():
        if r["doc"] != last:
            last = r["doc"]
            bags.append([])
            y.append(r["label"])
        bags[-1].append(np.frombuffer(r["x"], dtype=np.uint16))
    if not bags:
        return QualityModel({})
    return fit_bags([np.stack(b) for b in bags], np.array(y, dtype=np.float32), s)


def quality_score(docs: DataFrame, model: QualityModel, settings: QualitySettings = QualitySettings(), threshold: float = 0.3, text: str = "text", carry: Sequence[str] | None = None) -> DataFrame:
    """Add score (0 to 1, higher: label 1 likelier) and predicted (1 if score >= threshold, else 0).

    Null and empty texts are one empty passage and get its score. Long texts are scored whole, in every passage; a text is held as 32 numbers for each passage. Rows are
    independent: repeated rows give repeated results, an empty table gives no rows; other columns (those named in carry, or all)
    pass through, and those named like the new ones are replaced. The model is of fixed size and is broadcast.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        model = shared.value

        def columns(texts: list[str | None]) -> list:
            if not model.p:
                return [np.full(len(texts), 0.5), np.full(len(texts), int(threshold <= 0.5), dtype=np.int32)]
            encoded, sizes, part = [], [], []

            def settle() -> None:
                if part:
                    encoded.append(model.encode(scaled(np.concatenate(part))))
                    part.clear()

            for text in texts:
                sizes.append(0)
                for counts in passages(text, settings):
                    part.append(counts)
                    sizes[-1] += len(counts)
                    if sum(map(len, part)) >= 512:
                        settle()
            settle()
            score = model.score(np.concatenate(encoded), np.cumsum([0, *sizes[:-1]]))
            return [score, (score >= threshold).astype(np.int32)]

        return columns

    return appended(docs, text, "score double, predicted int", make, carry)
