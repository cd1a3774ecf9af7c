"""Scoring by a hierarchical Pitman-Yor language model.

Every context word is a restaurant whose customers are the words that follow it; all these restaurants share one parent,
whose customers are their tables, and whose own base is uniform. Seating is sampled by blocked Gibbs: in a sweep all customers of
every (context, word) pair leave and sit down again, as the number of their tables is drawn given their count, the parent's
probability and the tables of the other words: exactly up to 256 customers or where tables are few, else from the saddlepoint of its distribution. Predictive probabilities are averaged over the last sweeps, and give scores and perplexities.

Words: the most frequent training words (at most `vocabulary`) are dishes of their own; the others share one dish, and take their
add-one share of it by their own count. All words are counted, over all training documents, and all pairs take seats, so
what is gathered grows with the corpus; only the vocabulary and vectors over it (64 K entries) reach the driver and the executors.

How it runs: pairs (context, word) of all documents are dealt by a hash into parts of about `part_tokens`, in one shuffle of
packed, sorted arrays, into a table of one row a part. A part holds counts and where each pair occurs. A hot context is
spread over all parts; its totals are combined as vectors. Sweeps run part by part, and between two sweeps the totals of
all parts are added up (within one, a part sees those of the last). Each sweep's tables are written to the shared folder. Seating is a
function of seed, part and the recorded totals, so scoring samples it anew, and a lost executor costs a part's work and no state.

Defined results: null is empty text, which is the end alone; repeated rows score alike and each get a row; a null id is in the bucket
of the empty string; without training documents the counts are zero and the base is the whole model. Extra columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, drop_tables, slices, texts

END, RARE = b"", 0
VOCABULARY, PART_TOKENS, SWEEPS, KEPT, ROUNDS, SEED = 65_535, 3_000_000, 6, 4, 8, 11
#: Up to so many customers a table count is drawn from its whole distribution, in blocks of so many numbers; beyond, by rejection.
TABULATED, CELLS = 256, 1 << 18
#: Points at which a density of table counts is taken.
POINTS = 97
#: Tables, as a multiple of customers ^ discount, up to which the series of _shared is sound: for discounts of STEEP or less, and above.
REACH, REACH_STEEP, STEEP = 1.5, 0.9, 0.85
#: Greatest values of _shared by (customers, discount), as the sweeps ask for the same ones.
BOUNDS: dict = {}


# ---- seating -----------------------------------------------------------------------------------------------------------


@lru_cache(maxsize=4)
def log_stirling(most: int, discount: float) -> np.ndarray:
    """log of the number of weighted seatings (sizes less discount, rising) of c customers at t tables, at [c, t]."""
    out = np.full((most + 1, most + 1), -np.inf)
    out[1, 1] = 0.0
    t = np.arange(1, most + 1)
    for c in range(1, most):
        stay = np.where(t <= c, np.log(np.maximum(c - discount * t, 1e-300)), -np.inf)
        out[c + 1, 1:] = np.logaddexp(out[c, :-1], out[c, 1:] + stay)
    return out


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """Stirling's series after eight steps up; x > 0."""
    y, steps = x + 8, np.ones_like(x)
    for k in range(8):
        steps = steps * (x + k)
    z = 1 / (y * y)
    return (y - 0.5) * np.log(y) - y + 0.9189385332046727 + (1 / 12 - z * (1 / 360 - z * (1 / 1260 - z / 1680))) / y - np.log(steps)


@lru_cache(maxsize=4)
def _saddles(d: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """log -log of the share tables / customers, rising; and there, of the saddlepoint m = log(1 - z): log -m, and the slope of log share by m."""
    x = np.linspace(np.log(1e-14), np.log(700), 1 << 14)
    m = -np.exp(x)
    y, z = np.exp(m), -np.expm1(m)
    near = m > -1e-3  # there by series, as the terms cancel
    share = np.where(near, (1 - d) * m / 2 - (1 - d * d) * m * m / 24, np.log(-np.expm1(d * m)) - np.log(d) + (1 - d) * m - np.log(z))
    slope = np.where(near, (1 - d) / 2 - (1 - d * d) * m / 12, d * np.exp(d * m) / np.expm1(d * m) + y / z + 1 - d)
    return np.log(-share), x, slope


def _log_seatings(c: np.ndarray, t: np.ndarray, d: float) -> np.ndarray:
    """log of the probability that t table sizes (1 - (1 - z)^d) add up to c, by the saddlepoint; sound for many tables.

    The saddlepoint is looked up: the exponent is flat there, so that its error counts by its square only. What the saddlepoint's
    factor is off by where nearly all sizes are one is Stirling's error for the factorial of the rest.
    """
    shares, places, slopes = _saddles(d)
    k = np.maximum(c - t, 1e-3)
    share = np.log(-np.log1p(-k / c))
    m = -np.exp(np.interp(share, shares, places))
    log_z, log_k = np.log(-np.expm1(m)), np.log(k)
    spread = np.log(c * np.interp(share, shares, slopes)) + log_z - m
    return t * np.log(-np.expm1(d * m)) - c * log_z - 0.5 * (spread - log_k) + k * log_k - k - _log_gamma(k + 1)


def _peaks(c: np.ndarray, a: np.ndarray, base: np.ndarray, d: float) -> tuple[np.ndarray, np.ndarray]:
    """Where the table counts of _crowded are likeliest, up to about one, and the width of the peak: by halving, over the saddlepoints."""
    shares, places, slopes = _saddles(d)
    low, high = np.zeros(len(c), np.int64), np.full(len(c), len(places) - 1)
    log_base, rows, gains = np.log(base), np.exp(-np.exp(shares)), np.log(-np.expm1(-d * np.exp(places)))
    while np.any(high - low > 1):  # the weight falls with the tables at low, and rises at high
        mid = (low + high) // 2
        t = c * rows[mid]
        rises = gains[mid] + log_base + np.log((a + t - 0.5) / (t + 0.5)) > 0
        low, high = np.where(rises, low, mid), np.where(rises, mid, high)
    t = c * rows[low]
    y = np.exp(-d * np.exp(places[low]))
    bend = -d * y / (1 - y) / (t * slopes[low]) + 1 / (a + t) - 1 / (t + 1)
    peak = (t + c * rows[high]) / 2
    return np.maximum(peak, 1.0), np.clip(1 / np.sqrt(np.maximum(-bend, 1e-12)), 0.3, np.maximum(peak, 1.0))


def _crowded(c: np.ndarray, a: np.ndarray, base: np.ndarray, d: float, rng: np.random.Generator) -> np.ndarray:
    """Table counts of pairs with many customers and tables: their distribution, from the saddlepoint, at points around its peak; a draw
    from the points where these are whole numbers, and from the lines between them where it is wide. The work is the same whatever the customers."""
    every, half = np.arange(len(c)), POINTS // 2
    peak, width = _peaks(c, a, base, d)
    narrow = 7 * width <= half - 1
    lo = np.where(narrow, np.rint(peak) - half, np.maximum(peak - 7 * width, 0.5))
    hi = np.where(narrow, np.rint(peak) + half, np.minimum(peak + 7 * width, c + 0.5))
    at = lo[:, None] + (hi - lo)[:, None] * np.linspace(0, 1, POINTS)
    at[narrow] = np.rint(at[narrow])
    t, (c_, a_, base_) = np.clip(at, 1.0, c[:, None]), (v[:, None] for v in (c, a, base))
    x = _log_seatings(c_, t, d) + t * np.log(base_) + _log_gamma(a_ + t) - _log_gamma(t + 1)
    x[narrow[:, None] & (at != t)] = -np.inf
    x = np.exp(x - x.max(axis=1, keepdims=True))
    out = np.empty(len(c))
    sums = np.cumsum(x[narrow], axis=1)
    k = (sums <= rng.random((len(sums), 1)) * sums[:, -1:]).sum(axis=1)
    out[narrow] = at[narrow][np.arange(len(sums)), k]
    wide = ~narrow
    x, at, step = x[wide], at[wide], ((hi - lo) / (POINTS - 1))[wide]
    sums = np.concatenate((np.zeros((len(x), 1)), np.cumsum((x[:, 1:] + x[:, :-1]) / 2, axis=1)), axis=1)
    u = rng.random(len(x)) * sums[:, -1]
    k = np.clip((sums <= u[:, None]).sum(axis=1) - 1, 0, POINTS - 2)
    # within a step the density is a line: its distribution function is a parabola
    every = every[: len(x)]
    p, q, rest = x[every, k], x[every, k + 1], u - sums[every, k]
    f = 2 * rest / np.maximum(p + np.sqrt(np.maximum(p * p + 2 * rest * (q - p), 0)), 1e-300)
    out[wide] = at[every, k] + np.clip(f, 0, 1) * step
    return np.clip(np.rint(out), 1, c).astype(np.int64)


def _shared(c: np.ndarray, t: np.ndarray, d: float) -> np.ndarray:
    """The probability that t table sizes add up to c, over t times that of one table of c (sizes: 1 - (1 - z)^d).

    The series is that of (1 - (1 - z)^d)^t, by powers of (1 - z)^d; it is sound while t is not far over c^d.
    """
    first, term, total = _log_gamma(c - d), np.ones_like(t), np.ones_like(t)
    for k in range(1, 60):
        # C(t, k + 1) / t, and the coefficient of (1 - z)^(d (k + 1)) over that of (1 - z)^d
        term = term * (t - k) / (k + 1)
        x = -d * (k + 1)
        scale = 0.0 if abs(x - round(x)) < 1e-9 else math.gamma(-d) / math.gamma(x)
        more = (-1) ** k * scale * term * np.exp(_log_gamma(c + x) - first)
        total = total + more
        if np.all(np.abs(more) < 1e-13 * np.abs(total)) and scale:
            break
    return np.maximum(total, 0)


def _roomy(c: np.ndarray, a: np.ndarray, base: np.ndarray, d: float, rng: np.random.Generator) -> np.ndarray:
    """Table counts of pairs with far fewer tables than customers, by rejection from a negative binomial."""
    reach = REACH if d <= STEEP else REACH_STEEP
    sizes, at = np.unique(c, return_inverse=True)
    if len(BOUNDS) > 200_000:
        BOUNDS.clear()
    new = np.array([x for x in sizes.tolist() if (x, d) not in BOUNDS])
    if len(new):
        grid = 1 + np.linspace(0, reach, 64) * new[:, None] ** d
        most = 1.01 * _shared(np.repeat(new, 64), grid.ravel(), d).reshape(-1, 64).max(axis=1)
        BOUNDS.update(((x, d), y) for x, y in zip(new.tolist(), most.tolist(), strict=True))
    bound = np.array([BOUNDS[x, d] for x in sizes.tolist()])[at]
    out, left = np.ones(len(c), np.int64), np.arange(len(c))
    while len(left):
        t = 1.0 + rng.negative_binomial(a[left] + 1, 1 - base[left])
        fits = t <= 1 + reach * c[left] ** d
        taken = np.zeros(len(left), bool)
        taken[fits] = rng.random(int(fits.sum())) * bound[left[fits]] < _shared(c[left[fits]], t[fits], d)
        out[left[taken]] = t[taken].astype(np.int64)
        left = left[~taken]
    return out


def seat(c: np.ndarray, base: np.ndarray, rest: np.ndarray, theta: float, d: float, rng: np.random.Generator) -> np.ndarray:
    """All customers of each pair leave and sit down again: its table count, drawn afresh given its customers.

    c: customers, one or more; base: parent's probability of the dish; rest: tables of the other dishes of the restaurant. t has the weight
    S(c, t) * base^t * (theta + d rest) (theta + d (rest + 1)) ... (t factors), S the generalised Stirling numbers.
    """
    c, a, t = c.astype(np.int64), theta / d + rest, np.ones(len(c), np.int64)
    for size in np.unique(c[(c > 1) & (c <= TABULATED)]).tolist():
        own, k = np.flatnonzero(c == size), np.arange(size)
        known = log_stirling(TABULATED, d)[size, 1 : size + 1]
        for i in np.split(own, range(CELLS // size, len(own), CELLS // size)):
            x = known + np.cumsum(np.log((a[i, None] + k) * (d * base[i, None])), axis=1)
            x = np.cumsum(np.exp(x - x.max(axis=1, keepdims=True)), axis=1)
            t[i] = 1 + (x[:, :-1] <= rng.random((len(i), 1)) * x[:, -1:]).sum(axis=1)
    many = np.flatnonzero(c > TABULATED)
    if len(many):
        far = 1 + (a[many] + 1) * base[many] / np.maximum(1 - base[many], 1e-12)
        few = far + 8 * np.sqrt(far / np.maximum(1 - base[many], 1e-12)) < (REACH if d <= STEEP else REACH_STEEP) * c[many] ** d
        for own, draw in ((many[few], _roomy), (many[~few], _crowded)):
            for i in np.split(own, range(CELLS // POINTS, len(own), CELLS // POINTS)):
                if len(i):
                    t[i] = draw(c[i].astype(float), a[i], base[i], d, rng)
    return t


@dataclass
class Totals:
    """What one sweep knows of all restaurants: parent's probabilities by word, customers and tables by context."""

    word: np.ndarray
    customers: np.ndarray
    tables: np.ndarray


@dataclass
class Model:
    ids: dict
    log_base: np.ndarray
    theta: float
    discount: float
    history: list  # Totals, one for each sweep
    last: list  # Totals for the predictive of each kept sweep
    rare_log: tuple  # log10 of the denominators: of a rare word's share, of the base


def one_sweep(part: int, k: int, u, w, counts, tables, many, at: Totals, theta: float, discount: float) -> np.ndarray:
    """Tables after sweep k of a part; many: the pairs of two customers or more, as one customer has one table."""
    # the recorded totals hold what this pair had in the last sweep
    rest = np.maximum(at.tables[u[many]] - tables[many], 0)
    out = tables.copy()
    out[many] = seat(counts[many], at.word[w[many]], rest, theta, discount, np.random.default_rng((SEED, part, k)))
    return out


def sweep(state: DataFrame, known, theta: float, discount: float, k: int) -> DataFrame:
    """Every customer of every part reseated once; tables (null: one a pair) go in and come out."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for r in _packed(batch):
                x, counts = unpack(r["pairs"], np.uint32), unpack(r["counts"], np.uint32).astype(np.int64)
                tables = (counts > 0).astype(np.int64) if r["tables"] is None else unpack(r["tables"], np.uint32).astype(np.int64)
                new = one_sweep(r["part"], k, x >> 16, x & 0xFFFF, counts, tables, np.flatnonzero(counts >= 2), known.value, theta, discount)
                yield pa.RecordBatch.from_arrays([pa.array([r["part"]], pa.int64()), *(pa.array([v], pa.binary()) for v in (r["pairs"], r["counts"], pack(new.astype(np.uint32))))], names=["part", "pairs", "counts", "tables"])

    return state.mapInArrow(run, "part long, pairs binary, counts binary, tables binary")


def part_tables(part: int, pairs: np.ndarray, counts: np.ndarray, history: list, theta: float, discount: float, keep: int):
    """Tables of each pair after each of the last `keep` sweeps of the recorded history."""
    u, w = pairs >> 16, pairs & 0xFFFF
    many = np.flatnonzero(counts >= 2)
    tables = (counts > 0).astype(np.int64)
    kept = []
    for k, at in enumerate(history):
        tables = one_sweep(part, k, u, w, counts, tables, many, at, theta, discount)
        if k >= len(history) - keep:
            kept.append(tables.copy())
    return kept


def parent(tables: np.ndarray, theta: float, rng: np.random.Generator, before: np.ndarray | None) -> np.ndarray:
    """The parent's predictive probabilities, its customers being the tables by word; seats sampled the same way."""
    n1, n2 = np.count_nonzero(tables == 1), np.count_nonzero(tables == 2)
    d = float(np.clip(n1 / (n1 + 2 * n2), 0.05, 0.95)) if n1 + n2 else 0.5
    uniform = 1 / len(tables)
    t, many = (tables > 0).astype(np.int64), np.flatnonzero(tables >= 2)
    for _ in range(ROUNDS):
        t[many] = seat(tables[many], np.full(len(many), uniform), t.sum() - t[many], theta, d, rng)
    return (np.maximum(tables - d * t, 0) + (theta + d * t.sum()) * uniform) / (theta + tables.sum())


# ---- packed arrays -----------------------------------------------------------------------------------------------------


def pack(x: np.ndarray) -> bytes:
    """Byte planes, which compress well for sorted or small numbers."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(-1, x.itemsize).T).tobytes()


def unpack(b: bytes, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(size, -1).T).view(kind).ravel()


def held_out(doc_id, modulus: int = 7, rest: int = 2) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % modulus == rest


def row_key(doc_id, text: bytes) -> int:
    """A row by id and text, as signed 64 bits: what repeats both scores alike."""
    import xxhash

    return int(np.uint64(xxhash.xxh64_intdigest(text, doc_id & 0xFFFFFFFFFFFFFFFF if doc_id is not None else 1)).view(np.int64))


def _packed(batch):
    """Rows one at a time, as each may hold a part."""
    for i in range(batch.num_rows):
        yield batch.slice(i, 1).to_pylist()[0]


def _rows(batch):
    for doc_id, text in zip(batch.column(0).to_pylist(), texts(batch), strict=True):
        yield doc_id, text, text.lower().split()


def count_words(docs: DataFrame) -> DataFrame:
    """word (binary; empty: end of text), n over the training documents. A cut table."""

    def run(batches):
        from collections import Counter

        import pyarrow as pa

        seen: Counter = Counter()

        def flush():
            out = pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], names=["word", "n"])
            seen.clear()
            return out

        for batch in slices(batches):
            for doc_id, _, words in _rows(batch):
                if not held_out(doc_id):
                    seen.update(words)
                    seen[END] += 1
            if len(seen) > 300_000:
                yield flush()
        if seen:
            yield flush()

    return cut(docs.mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")), "words")


def frequent_words(counts: DataFrame, most: int):
    """The most frequent words, at most so many, as pandas: all whose count is over a mark. The mark is set on a scale of
    steps of 2 %, so that only a few hundred numbers and then the words themselves come to the driver."""
    step = F.floor(F.log(F.col("n").cast("double")) / float(np.log(1.02))).cast("int")
    steps = sorted(((r[0], r[1]) for r in counts.groupBy(step.alias("s")).count().collect()), reverse=True)
    mark, taken = None, 0
    for s, k in steps:
        if taken + k > most:
            break
        mark, taken = s, taken + k
    kept = counts.where(step >= mark) if mark is not None else counts.limit(0)
    return kept.toPandas().sort_values(["n", "word"], ascending=[False, True], kind="stable")


def deal_pairs(lines: DataFrame, end: int, parts: int) -> DataFrame:
    """key, held_out, ids (16 bits a word, and end) -> one row a part: pairs (context << 16 | word, sorted), train counts, occurrences of each,
    and the rows they are in. A cut table."""

    def run(batches):
        import pyarrow as pa

        def emit(keys, train, tokens, owner):
            pair, doc = np.concatenate(tokens), np.concatenate(owner)
            part = ((pair.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)) % np.uint64(parts)
            order = np.lexsort((pair, part))
            pair, doc, part = pair[order], doc[order], part[order]
            cuts = np.flatnonzero(np.diff(part)) + 1
            out = [[] for _ in range(5)]
            keys, train = np.array(keys, np.int64), np.array(train, np.uint8)
            for a, b in zip([0, *cuts], [*cuts, len(pair)], strict=True):
                used, local = np.unique(doc[a:b], return_inverse=True)
                for col, x in zip(out, (int(part[a]), pack(pair[a:b]), pack(local.astype(np.uint16)), keys[used].tobytes(), train[used].tobytes()), strict=True):
                    col.append(x)
            return pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), *(pa.array(x, pa.binary()) for x in out[1:])], names=["part", "pairs", "docs", "keys", "train"])

        keys, train, tokens, owner, size = [], [], [], [], 0
        for batch in slices(batches):
            for key, held, ids in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                own = np.frombuffer(ids, np.uint16).astype(np.uint32)
                own[1:] |= own[:-1] << np.uint32(16)
                own[0] |= np.uint32(end << 16)
                tokens.append(own)
                owner.append(np.full(len(own), len(keys), np.int32))
                keys.append(key)
                train.append(not held)
                size += len(own)
                if size > 1_500_000 or len(keys) >= 65_000:
                    yield emit(keys, train, tokens, owner)
                    keys, train, tokens, owner, size = [], [], [], [], 0
        if keys:
            yield emit(keys, train, tokens, owner)

    def merge(key, table):
        import pyarrow as pa

        pair, doc, train, keys, at = [], [], [], [], 0
        for r in _packed(table):
            own = np.frombuffer(r["keys"], np.int64)
            pair.append(unpack(r["pairs"], np.uint32))
            doc.append(unpack(r["docs"], np.uint16).astype(np.uint32) + np.uint32(at))
            keys.append(own)
            train.append(np.frombuffer(r["train"], np.uint8))
            at += len(own)
        pair, doc, train = np.concatenate(pair), np.concatenate(doc), np.concatenate(train)
        order = np.argsort(pair, kind="stable")
        pair, doc = pair[order], doc[order]
        first = np.flatnonzero(np.append(True, pair[1:] != pair[:-1]))
        counts = np.add.reduceat(train[doc].astype(np.int64), first)
        times = np.diff(np.append(first, len(pair)))
        row = [int(key[0].as_py()), pack(pair[first]), pack(counts.astype(np.uint32)), pack(times.astype(np.uint32)), pack(doc), np.concatenate(keys).tobytes()]
        return pa.table({n: pa.array([x], pa.int64() if n == "part" else pa.binary()) for n, x in zip(("part", "pairs", "counts", "times", "docs", "keys"), row, strict=True)})

    dealt = lines.select("key", "held_out", "ids").mapInArrow(run, "part long, pairs binary, docs binary, keys binary, train binary")
    return cut(dealt.groupBy("part").applyInArrow(merge, "part long, pairs binary, counts binary, times binary, docs binary, keys binary"), "pairs")


def by_vocabulary(parts: DataFrame, size: int, values) -> list[np.ndarray]:
    """Vectors over the vocabulary, added up over the parts. values(part, pairs, counts) -> [(by, numbers)], by: words or contexts."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for r in _packed(batch):
                found = values(r["part"], unpack(r["pairs"], np.uint32), unpack(r["counts"], np.uint32).astype(np.int64))
                for k, (by, x) in enumerate(found):
                    sums = np.bincount(by, x, size)
                    some = np.flatnonzero(sums)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), k), pa.int32()), pa.array(some, pa.int32()), pa.array(sums[some].astype(np.int64))], names=["k", "id", "n"])

    sums = parts.select("part", "pairs", "counts").mapInArrow(run, "k int, id int, n long").groupBy("k", "id").agg(F.sum("n").alias("n"))
    found = sums.toPandas()
    out = []
    for k in range(int(found["k"].max()) + 1 if len(found) else 0):
        own, x = found[found["k"] == k], np.zeros(size, np.int64)
        x[own["id"].to_numpy()] = own["n"].to_numpy()
        out.append(x)
    return out


# ---- the model ---------------------------------------------------------------------------------------------------------


def score_documents(docs: DataFrame, vocabulary: int = VOCABULARY, part_tokens: int = PART_TOKENS, theta: float = 1.0) -> DataFrame:
    """doc_id, text -> doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity."""
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    spark, sc = docs.sparkSession, docs.sparkSession.sparkContext
    counts = count_words(docs)
    total = counts.agg(F.sum("n"), F.count("*")).first()
    n, v = total[0] or 0, total[1]
    top = frequent_words(counts, vocabulary)
    ids = {bytes(w): k + 1 for k, w in enumerate(top["word"])}
    size = len(ids) + 1
    c = np.concatenate(([0], top["n"].to_numpy(np.int64)))
    rare_n, rare_v = n - int(c.sum()), v - len(ids)
    log_base = np.log10((c + 1) / (n + v + 1))
    c[RARE] = rare_n
    held = sc.broadcast(ids)

    # every document: what is known without the pairs, its rare words, and its words by number, so that texts are read no more
    def outline(batches):
        import pyarrow as pa

        get = held.value.get
        end = get(END, RARE)
        for batch in slices(batches):
            out = [[] for _ in range(8)]
            for doc_id, text, words in _rows(batch):
                own = [*[get(w, RARE) for w in words], end]
                a = np.array(own, np.int64)
                rare = [w for w, i in zip(words, own, strict=False) if not i]
                if not end:
                    rare.append(END)
                for col, x in zip(out, (row_key(doc_id, text), doc_id, held_out(doc_id), len(own), int(np.count_nonzero(a)), float(log_base[a[a > 0]].sum()), rare, a.astype(np.uint16).tobytes()), strict=True):
                    col.append(x)
            kinds = (pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.list_(pa.binary()), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds, strict=True)], names=["key", "doc_id", "held_out", "n_tokens", "known", "base", "rare", "ids"])

    lines = cut(docs.mapInArrow(outline, "key long, doc_id long, held_out boolean, n_tokens long, known long, base double, rare array<binary>, ids binary"), "outline")
    tokens = lines.agg(F.sum("n_tokens")).first()[0] or 0
    shares = max(1, -(-tokens // part_tokens))
    pairs = deal_pairs(lines, ids.get(END, RARE), shares)

    # first totals: one table a pair, the parent by plain counts
    starts = by_vocabulary(pairs, size, lambda p, x, k: [(x >> 16, k), (x >> 16, (k > 0).astype(float)), (x & 0xFFFF, (k > 0).astype(float)), (np.minimum(k, 3).astype(np.int64), np.ones(len(k)))])
    starts = starts + [np.zeros(max(size, 4), np.int64)] * (4 - len(starts))
    customers, tables, by_word, often = starts
    n1, n2 = (int(often[1]), int(often[2])) if size > 2 else (0, 0)
    discount = float(np.clip(n1 / (n1 + 2 * n2), 0.05, 0.95)) if n1 + n2 else 0.5
    rng = np.random.default_rng(SEED)
    history = [Totals(parent(by_word[:size], theta, rng, None), customers, tables)]
    last, state = [], pairs.select("part", "pairs", "counts", F.lit(None).cast("binary").alias("tables"))
    for k in range(SWEEPS):
        known = sc.broadcast(history[-1])
        before, state = state, cut(sweep(state, known, theta, discount, k), "seats")
        if k:
            drop_tables(spark, before)
        got = by_vocabulary(state.select("part", "pairs", F.col("tables").alias("counts")), size, lambda p, x, t: [(x >> 16, t.astype(float)), (x & 0xFFFF, t.astype(float))])
        got = got + [np.zeros(size, np.int64)] * (2 - len(got))
        now = Totals(parent(got[1], theta, rng, None), customers, got[0])
        last.append(now)
        if k < SWEEPS - 1:
            history.append(now)
    drop_tables(spark, state)
    model = sc.broadcast((history, last[-KEPT:]))

    def score_part(batches):
        import pyarrow as pa

        history, last = model.value
        for batch in batches:
            for r in _packed(batch):
                x, cnt = unpack(r["pairs"], np.uint32), unpack(r["counts"], np.uint32).astype(np.int64)
                times, doc, keys = unpack(r["times"], np.uint32), unpack(r["docs"], np.uint32), np.frombuffer(r["keys"], np.int64)
                u, w = x >> 16, x & 0xFFFF
                p = np.zeros(len(x))
                for t, at in zip(part_tables(r["part"], x, cnt, history, theta, discount, len(last)), last, strict=True):
                    p += (np.maximum(cnt - discount * t, 0) + (theta + discount * at.tables[u]) * at.word[w]) / (theta + at.customers[u])
                each = np.bincount(doc, np.repeat(np.log10(p / len(last)), times), len(keys))
                # a packed row for each share of the documents: rows follow the parts, not parts times documents
                share = (keys.view(np.uint64) % np.uint64(shares)).astype(np.int64)
                order = np.argsort(share, kind="stable")
                cuts = np.flatnonzero(np.diff(share[order])) + 1
                packed = [(int(share[i[0]]), keys[i].tobytes(), each[i].tobytes()) for i in np.split(order, cuts) if len(i)]
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in packed], t) for k, t in enumerate((pa.int64(), pa.binary(), pa.binary()))], names=["share", "keys", "sums"])

    def add_up(share, table):
        import pyarrow as pa

        keys = np.concatenate([np.frombuffer(x, np.int64) for x in table.column("keys").to_pylist()])
        sums = np.concatenate([np.frombuffer(x, np.float64) for x in table.column("sums").to_pylist()])
        unique, at = np.unique(keys, return_inverse=True)
        return pa.table({"key": unique, "pairs": np.bincount(at, sums, len(unique))})

    seated = pairs.mapInArrow(score_part, "share long, keys binary, sums binary").groupBy("share").applyInArrow(add_up, "key long, pairs double")
    # rare words: their own count, if any, for the base and for their share of the rare dish
    shares, bases = float(np.log10(rare_n + rare_v + 1)), float(np.log10(n + v + 1))
    # most frequent words have been told apart already
    rest = counts.withColumnRenamed("n", "c")
    words = lines.select("key", F.explode("rare").alias("word")).join(rest, "word", "left")
    one = F.log10(F.coalesce("c", F.lit(0)) + 1)
    rare = words.groupBy("key").agg(F.sum(one).alias("logs"), F.count("*").alias("rares"), F.count("c").alias("rare_known"))
    # rows that repeat id and text share a key, and their sums are those of all of them
    rows = lines.drop("rare", "ids").groupBy("key", "doc_id", "held_out", "n_tokens", "known").agg(F.max("base").alias("base"), F.count("*").alias("m"))
    m = F.col("m")
    logs, rares = F.coalesce("logs", F.lit(0.0)) / m, F.coalesce("rares", F.lit(0)) / m
    whole = rows.join(seated, "key").join(rare, "key", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("rare_known", F.lit(0)) / m).cast("long").alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") + logs - rares * bases).alias("base_score"), (F.col("pairs") / m + logs - rares * shares).alias("score"), F.explode(F.sequence(F.lit(1).cast("long"), m)).alias("_"),
    )
    return whole.drop("_").withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))
