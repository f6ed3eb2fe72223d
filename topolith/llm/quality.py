"""Quality scores from supervised subword embeddings.

A document is a bag of hashed features: its words, their character n-grams
(over UTF-8 bytes, word ends included) and two marks of repetition (a word
equal to the one before; a word met earlier in the text). Each feature has a
learned vector; a document's vector is their average, and a softmax layer
turns it into class probabilities. Vectors and layer are trained together by
stochastic gradient descent in numpy, a document a step; a feature's step is
its share of the document times the square root of the number of features, so
that long documents move their vectors as far as short ones.

For scoring, the layer is folded into the vectors: as the average is linear,
each feature then carries one number, the difference of the two classes'
logits, and a score is the logistic function of their mean. This changes no
score beyond rounding and keeps what travels to executors small and constant.
"""

from __future__ import annotations

import gc
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, text_or_empty, to_bytes

_BASE = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)


@dataclass(frozen=True)
class Settings:
    """Parameters of features and training.

    ``max_rows`` and ``max_bytes`` bound the labelled sample that the driver
    trains on: at most so many rows, in the order of a hash of the id, each a
    text of at most so many characters. Nothing else is bounded.
    """

    bits: int = 18
    sizes: tuple[int, ...] = (3, 4)
    dim: int = 16
    epochs: int = 6
    rate: float = 0.5
    max_rows: int = 4000
    max_bytes: int = 16384
    threshold: float = 0.3
    seed: int = 7


class Features:
    """Hashed features of UTF-8 texts."""

    #: Bytes of a text hashed at a time; cuts lie between words, a longer word comes alone.
    STEP = 1 << 20

    def __init__(self, s: Settings):
        self.s = s
        self._powers(1 << 14)
        self.shift = np.uint64(64 - s.bits)
        self.repeat_at = 0  # buckets 0 and 1 hold the marks of repetition
        self.earlier_at = 1

    def _powers(self, n: int) -> None:
        with np.errstate(over="ignore"):
            self.up = np.cumprod(np.full(n, _BASE, np.uint64), dtype=np.uint64)
            inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
            self.down = np.cumprod(np.full(n, inverse, np.uint64), dtype=np.uint64)

    def _bucket(self, h: np.ndarray, salt: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            h = (h ^ (h >> np.uint64(29)) ^ np.uint64(salt * 0x632BE59BD9B4E019 & (1 << 64) - 1)) * _MIX
        return (h >> self.shift).astype(np.int64)

    def parts(self, text: bytes) -> Iterator[tuple[np.ndarray, int, int]]:
        """Arrays of feature buckets, with counts of repeats and of words met earlier."""
        words = text.split()
        seen: list[np.ndarray] = []
        begin = size = 0
        for i, w in enumerate(words):
            if size and size + len(w) + 2 > self.STEP:
                yield self._part(words[begin:i], seen)
                begin, size = i, 0
            size += len(w) + 1
        if words:
            yield self._part(words[begin:], seen)

    def _part(self, words: list[bytes], seen: list[np.ndarray]) -> tuple[np.ndarray, int, int]:
        line = b" " + b" ".join(words) + b" "
        a = np.frombuffer(line, np.uint8)
        if len(a) > len(self.up):
            self._powers(max(len(a), 2 * len(self.up)))
        gaps = np.flatnonzero(a == 32)
        wide = a.astype(np.uint64) + np.uint64(1)
        with np.errstate(over="ignore"):
            sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(wide * self.up[: len(a)], dtype=np.uint64)))
            hashes = (sums[gaps[1:]] - sums[gaps[:-1] + 1]) * self.down[gaps[:-1] + 1]
        same = int((hashes[1:] == hashes[:-1]).sum())
        fresh = np.unique(hashes)
        earlier = len(hashes) - len(fresh)
        for old in seen:
            earlier += int(np.isin(fresh, old).sum())
        seen.append(fresh)
        out = [self._bucket(hashes, 1)]
        space = np.concatenate(([0], np.cumsum(a == 32)))
        for n in self.s.sizes:
            if len(a) < n:
                continue
            m = len(a) - n + 1
            inner = space[n - 1 : n - 1 + m] - space[1 : 1 + m] if n > 2 else np.zeros(m, np.int64)
            at = np.flatnonzero(inner == 0)
            h = np.zeros(len(at), np.uint64)
            for k in range(n):
                h = h << np.uint64(8) | a[at + k]
            out.append(self._bucket(h, n + 1))
        return np.concatenate(out), same, earlier

    def counted(self, text: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Distinct buckets and their counts."""
        found = list(self.parts(text))
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.float32)
        extra = [np.repeat([self.repeat_at, self.earlier_at], [same, earlier]) for _, same, earlier in found]
        ids, counts = np.unique(np.concatenate([f[0] for f in found] + extra), return_counts=True)
        return ids, counts.astype(np.float32)


@dataclass
class Model:
    """``weight``: a number for each bucket; ``bias``: what a text without words gets."""

    settings: Settings
    weight: np.ndarray
    bias: float

    def scorer(self):
        features, weight, bias = Features(self.settings), self.weight, self.bias

        def score(text: bytes) -> float:
            total, n = 0.0, 0
            for ids, same, earlier in features.parts(text):
                total += float(weight[ids].sum(dtype=np.float64)) + same * float(weight[features.repeat_at]) + earlier * float(weight[features.earlier_at])
                n += len(ids) + same + earlier
            z = bias + (total / n if n else 0.0)
            return float(1 / (1 + np.exp(-np.clip(z, -40, 40))))

        return score


def train(texts: list[bytes], labels: list[int], settings: Settings = Settings()) -> Model:
    """Trains vectors and a two-class softmax by stochastic gradient descent.

    Rows are visited in an order fixed by ``seed``, so that equal input gives
    equal models. Without rows of both classes every score is the share of
    class 1 (one half without any rows).
    """
    s, rng = settings, np.random.default_rng(settings.seed)
    n_buckets = 1 << s.bits
    if len(set(labels)) < 2:
        share = min(max(float(np.mean(labels)) if labels else 0.5, 1e-3), 1 - 1e-3)
        return Model(s, np.zeros(n_buckets, np.float32), float(np.log(share / (1 - share))))
    features = Features(s)
    docs = [features.counted(t) for t in texts]
    vectors = rng.uniform(-1 / s.dim, 1 / s.dim, (n_buckets, s.dim)).astype(np.float32)
    layer, bias = np.zeros((2, s.dim), np.float32), np.zeros(2, np.float32)
    steps, done = s.epochs * len(docs), 0
    for _ in range(s.epochs):
        for k in rng.permutation(len(docs)):
            ids, counts = docs[k]
            rate = s.rate * (1 - done / steps)
            done += 1
            share = counts / max(1.0, float(counts.sum()))
            rows = vectors[ids]
            mean = share @ rows if len(ids) else np.zeros(s.dim, np.float32)
            z = layer @ mean + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[labels[k]] -= 1
            back = p @ layer
            layer -= rate * np.outer(p, mean)
            bias -= np.float32(0.1) * rate * p
            if len(ids):
                # frequent features take larger steps than rare ones, damped by the square root of the bag's size
                vectors[ids] = rows - (rate * np.minimum(1.0, share * len(ids) ** 0.5))[:, None] * back
    return Model(s, vectors @ (layer[1] - layer[0]), float(bias[1] - bias[0]))


def fit(docs: DataFrame, labels: DataFrame, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model:
    """Trains on a bounded sample of labelled rows whose ids are not held out.

    Rows with a null label, a label other than 0 and 1, or a null id are left
    out; of several labels of one id the smallest counts, of several texts the
    smallest. See ``Settings`` for the bound.
    """
    learn = (
        labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & ~held_out(id_col))
        .groupBy(F.col(id_col).alias("_id"))
        .agg(F.min(label_col).cast("int").alias("_label"))
    )
    sized = docs.select(F.col(id_col).alias("_id"), F.length(text_or_empty(text_col)).alias("_size"))
    chosen = (
        sized.where(F.col("_size") <= settings.max_bytes)
        .select("_id")
        .distinct()
        .join(learn, "_id")
        .orderBy(F.xxhash64("_id"), "_id")
        .limit(settings.max_rows)
    )
    rows = (
        docs.select(F.col(id_col).alias("_id"), text_or_empty(text_col).alias("_text"))
        .where(F.length("_text") <= settings.max_bytes)
        .join(F.broadcast(chosen), "_id")  # max_rows rows at most
        .groupBy("_id", "_label")
        .agg(F.min("_text").alias("_text"))
        .collect()
    )
    rows.sort(key=lambda r: r["_id"])
    return train([r["_text"].encode("utf-8", "surrogatepass") for r in rows], [r["_label"] for r in rows], settings)


def held_out(id_col: str = "doc_id"):
    """Whether crc32 of the id as text is divisible by five: never learned from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(False))


def score(docs: DataFrame, model: Model, text_col: str = "text", out_col: str = "score") -> DataFrame:
    """``docs`` with a column for the probability of class 1, from the text alone.

    A null text counts as empty; a text without words gets the bias's
    probability. All rows and columns stay; a column named ``out_col`` is
    replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # one number a bucket, whatever the data

    @F.arrow_udf("double")
    def scored(it: Iterator[pa.Array]) -> Iterator[pa.Array]:
        gc.collect()  # what earlier tasks of this worker left in cycles
        one = shared.value.scorer()
        for texts in it:
            yield pa.array([one(t) for t in to_bytes(texts)], pa.float64())

    return docs.withColumn(out_col, scored(text_or_empty(text_col)))


def scores(docs: DataFrame, labels: DataFrame, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``held_out``, ``score`` and ``predicted`` of every document, repeated rows included.

    ``predicted`` is 1 from ``settings.threshold`` on. Null ids are not held
    out; null and empty texts get the bias's probability, equal texts equal
    scores; very long texts are read whole, a part at a time. An empty table
    gives an empty result; other columns are left out, whatever their names.
    """
    model = fit(docs, labels, settings, id_col, text_col)
    scored = score(docs.select(id_col, text_col), model, text_col)
    return scored.select(id_col, held_out(id_col).alias("held_out"), "score", (F.col("score") >= settings.threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents whose score reaches the threshold, with their columns as they were.

    Null and empty texts are scored as any other; repeated rows stay or go alike;
    an empty table gives an empty result.
    """
    model = fit(docs, labels, settings, id_col, text_col)
    mark = "_score"
    while mark in docs.columns:
        mark += "_"
    return score(docs, model, text_col, mark).where(F.col(mark) >= settings.threshold).drop(mark)
