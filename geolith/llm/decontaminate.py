"""Benchmark decontamination by winnowing.

The least 5-word hash of each 8-word window is its fingerprint. A document window whose fingerprint is one of the benchmark's
is then compared word by word, so every shared span of 8 words or more is found and nothing else is.
Items of fewer than 8 words are one window of their own length.

The benchmark is a stated set of bounded size: it is cut into blocks of at most `block_bytes` of text, each block's index
is sent to the executors in turn, and all documents are read once for a block. A hot passage is a hot entry of the index, not
a join key: nothing is shuffled.

Defined results: null has no words; a document without words has no hits and no items; an item without words never
occurs; items that repeat an id count once, by that id, null ids not at all; repeated documents are judged one by one; an empty
benchmark leaves all documents clean. Extra columns pass through; columns named as an added one are replaced.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ALNUM_WORDS, cut, rest_of, slices, texts

WINDOW, GRAM = 8, 5
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)


def gram_hashes(mixed: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k words; mixed: uint64 per word. Arithmetic wraps."""
    n = len(mixed) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    h = mixed[:n].copy()
    for j in range(1, k):
        h = h * BASE + mixed[j : j + n]
    h ^= h >> np.uint64(31)
    return h * np.uint64(0xBF58476D1CE4E5B9)


def window_minima(h: np.ndarray, w: int) -> np.ndarray:
    """The least of each w neighbours."""
    n = len(h) - w + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    m = h[:n].copy()
    for j in range(1, w):
        np.minimum(m, h[j : j + n], out=m)
    return m


def _mix(ids: np.ndarray) -> np.ndarray:
    x = ids.astype(np.uint64) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(29))


class Index:
    """One block of the benchmark: words, fingerprints, and where each window is."""

    def __init__(self, items: list[tuple[str, bytes]], window: int = WINDOW, gram: int = GRAM):
        self.window, self.gram, self.names = window, gram, [n for n, _ in items]
        self.words: dict[bytes, int] = {}
        ids, starts, at = [], [], 0
        by_length: dict[int, list[np.ndarray]] = {}
        for _, text in items:
            words = ALNUM_WORDS.findall(text.lower())
            own = np.array([self.words.setdefault(w, len(self.words) + 1) for w in words], np.int32)
            if len(own):
                size = min(window, len(own))
                by_length.setdefault(size, []).append(np.arange(at, at + len(own) - size + 1))
            ids.append(own)
            starts.append(at)
            at += len(own)
        self.ids, self.starts = (np.concatenate(ids) if ids else np.empty(0, np.int32)), np.array(starts, np.int64)
        mixed, self.by_length = _mix(self.ids), {}
        for size, found in by_length.items():
            pos = np.concatenate(found)
            full = gram_hashes(mixed, size)[pos]
            order = np.argsort(full, kind="stable")
            prints = full if size < window else window_minima(gram_hashes(mixed, gram), window - gram + 1)[pos]
            sieve = np.zeros(1 << 16, bool)
            sieve[(prints >> np.uint64(48)).astype(np.int64)] = True
            self.by_length[size] = (np.unique(prints), sieve, full[order], pos[order])

    def match(self, words: list[bytes]) -> tuple[np.ndarray, set[int], float]:
        """Mask of the hit words; numbers of the items of which a window occurs; the greatest share of an item (of a window or more) that occurs."""
        n, items, places = len(words), set(), []
        hit = np.zeros(n + 1, np.int64)
        get = self.words.get
        ids = np.array([get(w, 0) for w in words], np.int32)
        mixed = _mix(ids)
        for size, (prints, sieve, full, pos) in self.by_length.items():
            if n < size:
                continue
            own = gram_hashes(mixed, size) if size < self.window else window_minima(gram_hashes(mixed, self.gram), size - self.gram + 1)
            may = np.flatnonzero(sieve[(own >> np.uint64(48)).astype(np.int64)])
            may = may[prints[np.minimum(np.searchsorted(prints, own[may]), len(prints) - 1)] == own[may]]
            if not len(may):
                continue
            # extend the shared fingerprints to whole windows
            spans = ids[may[:, None] + np.arange(size)]
            whole = gram_hashes(mixed, size)[may]
            lo, hi = np.searchsorted(full, whole, "left"), np.searchsorted(full, whole, "right")
            seen: dict[bytes, bool] = {}
            for s, row, a, b in zip(may.tolist(), spans, lo.tolist(), hi.tolist(), strict=True):
                if a == b:
                    continue
                key = row.tobytes()
                if key not in seen:
                    same = (self.ids[pos[a:b, None] + np.arange(size)] == row).all(axis=1)
                    seen[key] = bool(same.any())
                    items.update((np.searchsorted(self.starts, pos[a:b][same], "right") - 1).tolist())
                    if size == self.window:
                        places.append(pos[a:b][same])
                if seen[key]:
                    hit[s] += 1
                    hit[min(s + size, n)] -= 1
        extent = 0.0
        if places:
            # words of the items, each counted once
            covered = np.unique(np.concatenate(places)[:, None] + np.arange(self.window))
            item, many = np.unique(np.searchsorted(self.starts, covered, "right") - 1, return_counts=True)
            extent = float((many / np.diff(np.append(self.starts, len(self.ids)))[item]).max())
        return np.cumsum(hit)[:n] > 0, items, extent


def _blocks(benchmark: DataFrame, block_bytes: int):
    """The benchmark in blocks of about block_bytes of text each."""
    rows = benchmark.where("item_id is not null").select(F.col("item_id").cast("string").alias("item_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).distinct()
    size = rows.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    n = max(1, -(-size // block_bytes))
    for k in range(n):
        block = rows if n == 1 else rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k)
        yield [(r.item_id, r.text.encode()) for r in block.collect()]


ADDED = "n_words long, hits array<struct<start: int, end: int>>, items array<string>, extent double"


def find_overlaps(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, gram: int = GRAM, block_bytes: int = 8 << 20) -> DataFrame:
    """docs with n_words, hits (word spans, disjoint and in order) and items (ids of the items found, sorted as strings) and extent (the greatest
    share of one item's words that is in it; items shorter than a window do not count)."""
    names = [f.name for f in T._parse_datatype_string(ADDED).fields]
    kept = T.StructType([f for f in docs.schema.fields if f.name not in names])
    out = T.StructType([*kept.fields, *T._parse_datatype_string(ADDED).fields])
    sc, frame, first = docs.sparkSession.sparkContext, docs.select(*(F.col(f"`{n}`") for n in kept.names)), True
    for block in _blocks(benchmark, block_bytes):
        held = sc.broadcast(Index(block, window, gram))

        def scan(batches, held=held, first=first):
            import pyarrow as pa

            index = held.value
            kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
            for batch in slices(batches):
                counts, hits, items, extents = [], [], [], []
                before = [0.0] * batch.num_rows if first else batch.column(batch.schema.get_field_index("extent")).to_pylist()
                at = None if first else batch.column(batch.schema.get_field_index("hits")).to_pylist(), None if first else batch.column(batch.schema.get_field_index("items")).to_pylist()
                for k, text in enumerate(texts(batch)):
                    words = ALNUM_WORDS.findall(text.lower())
                    mask, found, extent = index.match(words)
                    found = {index.names[i] for i in found}
                    if not first:
                        for h in at[0][k]:
                            mask[h["start"] : h["end"]] = True
                        found |= set(at[1][k])
                    edges = np.flatnonzero(np.diff(np.concatenate(([0], mask.astype(np.int8), [0]))))
                    counts.append(len(words))
                    hits.append([{"start": a, "end": b} for a, b in edges.reshape(-1, 2).tolist()])
                    items.append(sorted(found))
                    extents.append(max(extent, before[k]))
                yield rest_of(batch, {"n_words": pa.array(counts, pa.int64()), "hits": pa.array(hits, kind), "items": pa.array(items, pa.list_(pa.string())), "extent": pa.array(extents, pa.float64())})

        frame = (frame if first else cut(frame, "overlaps")).mapInArrow(scan, out)
        first = False
    return frame


def contaminated(least_items: int = 2):
    return F.size("items") >= least_items


def holds_item(least_extent: float = 0.5):
    """Most of one item, or all of it, is in the document."""
    return F.col("extent") >= least_extent
