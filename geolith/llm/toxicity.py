"""Toxic spans by a linear-chain conditional random field.

Documents carry labels, words do not: a word of a toxic training document counts as toxic if it, or what it begins with,
is found in toxic documents and all but never in clean ones. On these tagged words a chain of two states is learned (hashed
features of the word, its start and end and its neighbours; two-by-two transitions), by the gradient of the
likelihood from forward-backward. A document's score comes from its marginals: the greatest, and the expected number of
toxic words, through a logistic curve learned on the same documents. Offending words are those of marginal 0.5 or more.

Learning takes at most `bound` labelled documents on the driver. Scoring reads every whole text: the chain over all words
of a batch is run in blocks of 64 words side by side, linked by products of transfer matrices, so a long document is no slower
a word than a short one, and memory is bounded by the slice.

Defined results: null is empty; an empty text has no marginals and scores as one without any toxic word; without labelled
rows of both kinds all score the share of ones, 0.5 if there is none. Repeated rows score alike. Extra columns pass through.
"""

from __future__ import annotations

import re

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import rest_of, slices

BITS, BOUND, BLOCK, FLOOR = 17, 5000, 64, 0.1
WORD = re.compile(r"[^\W_]+")


def words_of(text: str) -> list[str]:
    """Words of the text as it stands, so that they have its offsets; each is lower-cased on its own."""
    return [w.lower() for w in WORD.findall(text)]


def word_features(word: str, bits: int = BITS) -> list[int]:
    parts = ("w" + word, "4" + word[:4], "5" + word[:5], "3" + word[-3:])
    return [xxhash.xxh64_intdigest(x.encode(), 6) >> (64 - bits) for x in parts]


# ---- the chain ---------------------------------------------------------------------------------------------------------


def marginals(energy: np.ndarray, start: np.ndarray, trans: np.ndarray, pairs: bool = False):
    """P(state 1) of each word; energy: state 1 over state 0; start: True where a chain begins; trans: 2x2 log weights.

    With pairs, also the expected counts of the four transitions (2x2). Works on all chains at once: a word's transfer matrix
    is [prior or transition] x [emission]; prefix products over blocks side by side, scaled at each step.
    """
    n = len(energy)
    if not n:
        return (np.empty(0), np.zeros((2, 2))) if pairs else np.empty(0)
    e = np.clip(energy, -30, 30)
    hi = np.maximum(e, 0)
    emit = np.stack([np.exp(-hi), np.exp(e - hi)], 1)
    t = np.exp(trans - trans.max())
    step = np.where(start[:, None, None], np.ones((2, 2)), t)  # at a start, whatever came before
    m = step * emit[:, None, :]
    rows = -(-n // BLOCK)
    pad = rows * BLOCK - n
    if pad:
        m = np.concatenate((m, np.broadcast_to(np.eye(2), (pad, 2, 2))))
    # word k of each block side by side
    m = np.ascontiguousarray(m.reshape(rows, BLOCK, 2, 2).transpose(1, 2, 3, 0))
    a = m[:, 0, 0], m[:, 0, 1], m[:, 1, 0], m[:, 1, 1]

    def product(left, right):
        p, q, r, s = left[0] * right[0] + left[1] * right[2], left[0] * right[1] + left[1] * right[3], left[2] * right[0] + left[3] * right[2], left[2] * right[1] + left[3] * right[3]
        top = np.maximum(np.maximum(p, q), np.maximum(r, s))
        return p / top, q / top, r / top, s / top

    whole = tuple(x[0] for x in a)
    for k in range(1, BLOCK):
        whole = product(whole, tuple(x[k] for x in a))

    def enter(backwards: bool):
        """The vector on entering each block, from the products of those before (after) it, by doubling."""
        out = np.ones((2, rows))
        if rows == 1:
            return out
        w = tuple(x[::-1].copy() for x in (whole[0], whole[2], whole[1], whole[3])) if backwards else tuple(x.copy() for x in whole)
        d = 1
        while d < rows:
            new = product(tuple(x[:-d] for x in w), tuple(x[d:] for x in w))
            for x, y in zip(w, new, strict=True):
                x[d:] = y
            d *= 2
        v = np.stack([w[0] + w[2], w[1] + w[3]])
        out[:, 1:] = v[:, :-1] / v[:, :-1].max(axis=0)
        return out[:, ::-1].copy() if backwards else out

    f, b = np.empty((BLOCK, 2, rows)), np.empty((BLOCK, 2, rows))
    v0, v1 = enter(False)
    for k in range(BLOCK):
        x0, x1 = v0 * a[0][k] + v1 * a[2][k], v0 * a[1][k] + v1 * a[3][k]
        top = np.maximum(x0, x1)
        v0, v1 = x0 / top, x1 / top
        f[k, 0], f[k, 1] = v0, v1
    v0, v1 = enter(True)
    for k in range(BLOCK - 1, -1, -1):
        b[k, 0], b[k, 1] = v0, v1
        x0, x1 = a[0][k] * v0 + a[1][k] * v1, a[2][k] * v0 + a[3][k] * v1
        top = np.maximum(x0, x1)
        v0, v1 = x0 / top, x1 / top
    f, b = f.transpose(2, 0, 1).reshape(-1, 2)[:n], b.transpose(2, 0, 1).reshape(-1, 2)[:n]
    both = f * b
    one = both[:, 1] / both.sum(axis=1)
    if not pairs:
        return one
    inner = ~start[1:]
    x = f[:-1, :, None] * t[None] * (emit[1:] * b[1:])[:, None, :]
    x = x[inner]
    return one, (x / x.sum(axis=(1, 2), keepdims=True)).sum(axis=0)


# ---- learning ----------------------------------------------------------------------------------------------------------


def told_words(words: list[str], docs: list[np.ndarray], y: np.ndarray, least: int = 4, clean: float = 0.02) -> np.ndarray:
    """True for the words (docs hold their numbers) that the labels tell: they, or what they begin with, are in so many toxic
    documents that chance alone makes no such word, and in clean ones at no more than `clean` of the rate."""
    def numbered(size: int):
        seen: dict[str, int] = {}
        return np.array([seen.setdefault(w[:size], len(seen)) for w in words], np.int64), len(seen)

    groups = [(np.arange(len(words)), len(words)), numbered(4), numbered(5)]
    counts = [np.zeros((2, n)) for _, n in groups]
    for ids, label in zip(docs, y, strict=True):
        own = np.unique(ids)
        for (group, _), c in zip(groups, counts, strict=True):
            c[int(label), np.unique(group[own])] += 1
    toxic, rest = max(1, int(y.sum())), max(1, int(len(y) - y.sum()))
    # rate^k times the number of words far below one
    need = max(least, int(np.ceil(np.log(1e-3 / (1 + sum(n for _, n in groups))) / np.log(toxic / (toxic + rest)))))
    told = lambda c: (c[1] >= need) & (c[0] / rest <= clean * c[1] / toxic)
    return np.logical_or.reduce([told(c)[group] for (group, _), c in zip(groups, counts, strict=True)])


class Model:
    """Weights: three tables (own word, word before, word after), transitions, and the curve of the document score."""

    def __init__(self, own, before, after, bias, trans, curve):
        self.own, self.before, self.after, self.bias, self.trans, self.curve = own, before, after, bias, trans, curve

    def document(self, p: np.ndarray) -> float:
        c = self.curve
        if isinstance(c, float):
            return c
        return float(1 / (1 + np.exp(-np.clip(c @ summary(p), -35, 35))))


def summary(p: np.ndarray) -> np.ndarray:
    """The greatest marginal, and the expected number of toxic words among those of FLOOR or more: the many words that are all but surely
    clean must not add up to something in a long text; their mean, which no length can raise, counts instead."""
    top, total, mean = (float(p.max()), float(p[p >= FLOOR].sum()), float(p.mean())) if len(p) else (0.0, 0.0, 0.0)
    return np.array([1.0, top, np.log1p(total), np.log(mean + 1e-5)])


def fit(sample, bits: int = BITS, rounds: int = 40, rate: float = 0.3, l2: float = 1e-6) -> Model:
    """sample: pandas with text, y."""
    y = (sample["y"].to_numpy() > 0).astype(float)
    size = 1 << bits
    if not 0 < y.sum() < len(y):
        return Model(np.zeros(size, np.float32), np.zeros(size, np.float32), np.zeros(size, np.float32), 0.0, np.zeros((2, 2)), float(y.mean()) if len(y) else 0.5)
    number: dict[str, int] = {}
    docs = [np.array([number.setdefault(w, len(number)) for w in words_of(t)], np.int32) for t in sample["text"]]
    told = told_words(list(number), docs, y)
    feats = np.array([word_features(w, bits) for w in number], np.int32).reshape(-1, 4)
    v = len(number)
    # chains side by side, so many words at a time
    chunks, held, words = [], [], 0
    for k, ids in enumerate(docs):
        held.append(k)
        words += len(ids)
        if words >= 200_000 or k == len(docs) - 1:
            ids = np.concatenate([docs[i] for i in held])
            start = np.zeros(len(ids) + 1, bool)
            start[np.cumsum([0, *(len(docs[i]) for i in held)])] = True
            tag = np.concatenate([told[docs[i]] * y[i] for i in held])
            chunks.append((ids, start[:-1], tag, held))
            held, words = [], 0
    own, before, after, trans, bias = np.zeros(size), np.zeros(size), np.zeros(size), np.zeros((2, 2)), -3.0
    observed = np.zeros((2, 2))
    for _, start, tag, _ in chunks:
        inner = ~start[1:]
        np.add.at(observed, (tag[:-1][inner].astype(int), tag[1:][inner].astype(int)), 1)
    sq = {"o": np.full(size, 1e-6), "b": np.full(size, 1e-6), "a": np.full(size, 1e-6), "t": np.full((2, 2), 1e-6), "c": 1e-6}

    def energies(tables, ids, start):
        e = tables[0][ids] + bias
        e[1:] += np.where(start[1:], 0, tables[1][ids[:-1]])
        e[:-1] += np.where(start[1:], 0, tables[2][ids[1:]])
        return e

    def by_word():
        return own[feats].sum(axis=1), before[feats[:, 0]], after[feats[:, 0]]

    for _ in range(rounds):
        tables, sums, expected, gc = by_word(), np.zeros((3, v)), np.zeros((2, 2)), 0.0
        for ids, start, tag, _ in chunks:
            if not len(ids):
                continue
            p, pairs = marginals(energies(tables, ids, start), start, trans, pairs=True)
            g, expected = p - tag, expected + pairs
            sums[0] += np.bincount(ids, g, v)
            sums[1] += np.bincount(ids[:-1], np.where(start[1:], 0, g[1:]), v)
            sums[2] += np.bincount(ids[1:], np.where(start[1:], 0, g[:-1]), v)
            gc += float(g.sum())
        go = np.bincount(feats.ravel(), np.repeat(sums[0], 4), size)
        gb, ga = np.bincount(feats[:, 0], sums[1], size), np.bincount(feats[:, 0], sums[2], size)
        for name, w, gr in (("o", own, go), ("b", before, gb), ("a", after, ga), ("t", trans, expected - observed)):
            gr = gr + l2 * w
            sq[name] += gr * gr
            w -= rate * gr / np.sqrt(sq[name])
        sq["c"] += gc * gc
        bias -= rate * gc / np.sqrt(sq["c"])
    model = Model(own.astype(np.float32), before.astype(np.float32), after.astype(np.float32), bias, trans, 0.5)
    tables, x = by_word(), np.zeros((len(docs), 4))
    for ids, start, _, held in chunks:
        p = marginals(energies(tables, ids, start), start, trans)
        for k, part in zip(held, np.split(p, np.cumsum([len(docs[i]) for i in held])[:-1]), strict=True):
            x[k] = summary(part)
    c = np.zeros(4)
    for _ in range(30):  # Newton's steps, ridge for separable data
        q = 1 / (1 + np.exp(-np.clip(x @ c, -35, 35)))
        h = (x * (q * (1 - q))[:, None]).T @ x + 1e-2 * np.eye(4)
        c -= np.linalg.solve(h, x.T @ (q - y) + 1e-2 * c)
    model.curve = c
    return model


# ---- scoring -----------------------------------------------------------------------------------------------------------


class Scorer:
    def __init__(self, model: Model, bits: int = BITS, most: int = 200_000):
        self.m, self.bits, self.most, self.seen = model, bits, most, {}
        self.table = np.zeros((3, 1024), np.float32)

    def _new(self, word: str) -> int:
        k = self.seen[word] = len(self.seen)
        if k >= self.table.shape[1]:
            self.table = np.concatenate((self.table, np.zeros_like(self.table)), axis=1)
        f = word_features(word.lower(), self.bits)
        self.table[:, k] = self.m.own[f].sum(), self.m.before[f[0]], self.m.after[f[0]]
        return k

    def __call__(self, batch: list[str]) -> list[np.ndarray]:
        """Marginals of each text's words."""
        if len(self.seen) > self.most:
            self.seen.clear()
        get, new, ids, lengths = self.seen.get, self._new, [], []
        for text in batch:
            words = WORD.findall(text)
            lengths.append(len(words))
            ids += [k if (k := get(w)) is not None else new(w) for w in words]
        ids = np.array(ids, np.int64)
        at = np.cumsum([0, *lengths])
        start = np.zeros(len(ids), bool)
        start[at[:-1][at[:-1] < len(ids)]] = True
        own, before, after = self.table[:, ids].astype(float)
        e = own + self.m.bias
        if len(ids):
            e[1:] += np.where(start[1:], 0, before[:-1])
            e[:-1] += np.where(start[1:], 0, after[1:])
        return np.split(marginals(e, start, self.m.trans), at[1:-1])


SPANS = "array<struct<start: int, end: int>>"


def score(docs: DataFrame, model: Model, bits: int = BITS, with_spans: bool = True) -> DataFrame:
    """docs with score and, if asked for, spans: character offsets of the offending words, neighbours joined."""
    added = ["score", "spans"] if with_spans else ["score"]
    out = T.StructType([*(f for f in docs.schema.fields if f.name not in added), T.StructField("score", T.DoubleType())])
    if with_spans:
        out.add("spans", T._parse_datatype_string(SPANS))
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        import pyarrow as pa

        run_batch = Scorer(held.value, bits)
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        for batch in slices(batches):
            rows = [t or "" for t in batch.column(batch.schema.get_field_index("text")).to_pylist()]
            probs = run_batch(rows)
            new = {"score": pa.array([held.value.document(p) for p in probs], pa.float64())}
            if with_spans:
                spans = []
                for text, p in zip(rows, probs, strict=True):
                    found: list[dict] = []
                    if len(p) and p.max() >= 0.5:
                        own = [(m.start(), m.end()) for m in WORD.finditer(text)]
                        last = -2
                        for k in np.flatnonzero(p >= 0.5).tolist():
                            if k == last + 1:
                                found[-1]["end"] = own[k][1]
                            else:
                                found.append({"start": own[k][0], "end": own[k][1]})
                            last = k
                    spans.append(found)
                new["spans"] = pa.array(spans, kind)
            yield rest_of(batch, new)

    return docs.mapInArrow(run, out)
