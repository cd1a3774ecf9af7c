"""Quality classifier: logistic regression on hashed word n-grams, learned by follow-the-regularised-leader.

Features: words, pairs of words, shapes of words (letter case, digits, marks) with pairs of shapes, and whether a word
repeats the one before it; each hashed into `1 << bits` weights, as a share of its document's words. Scoring is a sparse dot product with
the weights, which are of fixed size and sent to every executor.

Learning takes at most `bound` labelled documents on the driver; scoring reads every whole text.

Defined results: null is empty; an empty text scores as the bias alone; without labelled rows of both kinds all score the
share of ones, 0.5 if there is none. Repeated rows score alike. Extra columns pass through.
"""

from __future__ import annotations

import re

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import rest_of, slices, texts

BITS, BOUND, SCALE = 18, 6000, 8.0
_UP, _LOW, _DIGIT, _RUN = re.compile(rb"[A-Z]+"), re.compile(rb"[a-z\x80-\xff]+"), re.compile(rb"[0-9]+"), re.compile(rb"(.)\1+", re.S)
C1, C2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def shape(word: bytes) -> bytes:
    """`Word,` -> `Aa,`; runs of one mark are one."""
    return _RUN.sub(rb"\1", _DIGIT.sub(b"0", _LOW.sub(b"a", _UP.sub(b"A", word))))


class Features:
    """Turns a text into feature numbers; keeps a bounded memory of words."""

    def __init__(self, bits: int = BITS, most: int = 200_000):
        self.shift, self.most, self.seen = np.uint64(64 - bits), most, {}

    def _new(self, word: bytes) -> tuple[int, int]:
        if len(self.seen) >= self.most:
            self.seen.clear()
        got = self.seen[word] = (xxhash.xxh64_intdigest(word, 1), xxhash.xxh64_intdigest(shape(word), 2))
        return got

    def __call__(self, text: bytes) -> np.ndarray:
        words = text.split()
        if not words:
            return np.empty(0, np.int64)
        get, new = self.seen.get, self._new
        both = np.array([get(w) or new(w) for w in words], np.uint64)
        w, s = both[:, 0], both[:, 1]
        pair = lambda x, c: (x[:-1] * C1 + x[1:]) * c
        same = np.full(np.count_nonzero(w[1:] == w[:-1]), 12345 << 40, np.uint64)
        every = np.concatenate((w * C1, s * C1, pair(w, C2), pair(s, C2 + np.uint64(2)), same * C1))
        return (every >> self.shift).astype(np.int64), len(words)

    def rows(self, text: bytes):
        got = self(text)
        return got if isinstance(got, tuple) else (got, 1)


def train_ftrl(examples, labels, bits: int = BITS, alpha: float = 0.5, beta: float = 0.05, l1: float = 1e-4, l2: float = 1e-3, epochs: int = 3, seed: int = 7):
    """Weights and bias. examples: (feature numbers, words) per document."""
    n, z = np.zeros(1 << bits), np.zeros(1 << bits)
    bn = bz = 0.0
    rng = np.random.default_rng(seed)
    packed = []
    for ids, size in examples:
        u, c = np.unique(ids, return_counts=True)
        packed.append((u.astype(np.int32), (c * (SCALE / size)).astype(np.float32)))

    def weight(zz, nn):
        return np.where(np.abs(zz) <= l1, 0.0, -(zz - np.sign(zz) * l1) / ((beta + np.sqrt(nn)) / alpha + l2))

    for _ in range(epochs):
        for k in rng.permutation(len(packed)):
            u, x = packed[k]
            w, b = weight(z[u], n[u]), -bz / ((beta + bn**0.5) / alpha + l2)
            p = 1 / (1 + np.exp(-np.clip(w @ x + b, -35, 35)))
            g = (p - labels[k]) * x
            s = (np.sqrt(n[u] + g * g) - np.sqrt(n[u])) / alpha
            z[u] += g - s * w
            n[u] += g * g
            gb = p - labels[k]
            bz += gb - ((bn + gb * gb) ** 0.5 - bn**0.5) / alpha * b
            bn += gb * gb
    return weight(z, n).astype(np.float32), float(-bz / ((beta + bn**0.5) / alpha + l2))


def fit(sample, bits: int = BITS, **how) -> tuple[np.ndarray, float]:
    """sample: pandas with text, y."""
    y = (sample["y"].to_numpy() > 0).astype(float)
    if not 0 < y.sum() < len(y):
        share = y.mean() if len(y) else 0.5
        share = min(1 - 1e-6, max(1e-6, share))
        return np.zeros(1 << bits, np.float32), float(np.log(share / (1 - share)))
    make = Features(bits)
    return train_ftrl((make.rows(t.encode()) for t in sample["text"]), y, bits, **how)


def score(docs: DataFrame, weights: np.ndarray, bias: float, bits: int = BITS, name: str = "score") -> DataFrame:
    """docs with a score in 0..1."""
    out = T.StructType([*(f for f in docs.schema.fields if f.name != name), T.StructField(name, T.DoubleType())])
    held = docs.sparkSession.sparkContext.broadcast((weights, bias))

    def run(batches):
        import pyarrow as pa

        w, b = held.value
        make = Features(bits)
        for batch in slices(batches):
            dots = [float(w[ids].sum(dtype=np.float64)) * SCALE / size + b for ids, size in map(make.rows, texts(batch))]
            yield rest_of(batch, {name: pa.array(1 / (1 + np.exp(-np.clip(dots, -35, 35))), pa.float64())})

    return docs.mapInArrow(run, out)
