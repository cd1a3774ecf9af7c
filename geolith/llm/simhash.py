"""SimHash near-duplicates by bit-sliced comparison.

A fingerprint has a bit where more than half of the document's shingle hashes have it. Two fingerprints that differ in at
most `radius` bits are linked; documents fall into the components of these links.

Candidates come from the pigeonhole rule: with 64 bits in b parts, fingerprints within the radius agree on b - radius parts.
b grows with the number of fingerprints, so that a bucket (one agreed value) stays small: 4 parts (16 agreed bits), 5 (25) or
6 (32); each choice is exact. Low bits of the agreed value are dropped while buckets would hold only a few. A bucket of more than
`block` fingerprints is cut into chunks by a hash and every pair of chunks is a block of its own, so no task ever
holds more than two chunks of it.

In a block the fingerprints are stored as 64 vertical bit planes. All are compared with all: a plane at a time, each difference
is added to carry-save counters (two bitwise sums and an overflow), 64 distances to a machine word; rows of which every
distance is over the radius are abandoned. A block hands on a spanning forest of its links, never all pairs; the forests are
joined by distributed components. Equal fingerprints are one node from the start, however many documents share them.

Defined results: null and texts without words have fingerprint zero, linked like any other; fewer words than a shingle
are one shingle; repeated ids are one document; rows with a null id are fingerprinted but stand alone, component null.
An empty table: no rows. Extra columns are ignored.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, cut, slices, texts

SHINGLE, SEED, RADIUS = 3, 42, 3


# ---- fingerprints ------------------------------------------------------------------------------------------------------


def fingerprint(text: bytes, size: int = SHINGLE) -> int:
    """64 bits, unsigned. text: UTF-8."""
    import xxhash

    words = text.lower().split()
    if not words:
        return 0
    line, k, h = b" ".join(words), min(size, len(words)), xxhash.xxh64_intdigest
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    hashes = np.array([h(line[a:b], SEED) for a, b in zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)], np.uint64)
    return majority(hashes)


def majority(hashes: np.ndarray) -> int:
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 14):  # bits of a slice at a time
        part = hashes[at : at + (1 << 14)].astype("<u8")
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """doc_id, text -> doc_id, fp (the bits as a signed long)."""

    def run(batches):
        import pyarrow as pa

        for batch in slices(batches):
            fp = np.array([fingerprint(t, size) for t in texts(batch)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, fp long")


# ---- one block ---------------------------------------------------------------------------------------------------------


def planes(fp: np.ndarray) -> np.ndarray:
    """64 x words: bit j of word w of plane p is bit p of fingerprint 64 w + j."""
    n = -(-len(fp) // 64) * 64
    bits = np.zeros((64, n), np.uint8)
    bits[:, : len(fp)] = np.unpackbits(fp.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").T
    return np.packbits(bits, axis=1, bitorder="little").view("<u8")


def near(fp: np.ndarray, rows: np.ndarray, sliced: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """(row numbers with any, bits of the fingerprints within the radius) for some rows against all; radius up to 3.

    A block is 64 fingerprints, a machine word of each plane; it is abandoned once all its distances from all rows are over the radius, and
    so is a row once only the fingerprint itself is left."""
    if not 0 <= radius <= 3:
        raise ValueError("two counters tell distances up to 3")
    words = sliced.shape[1]
    alive, blocks, full = rows, np.arange(words), np.full(words, np.uint64(0xFFFFFFFFFFFFFFFF))
    if len(fp) % 64:
        full[-1] = np.uint64((1 << (len(fp) % 64)) - 1)
    own = fp[rows]
    one, two, over = (np.zeros((len(rows), words), np.uint64) for _ in range(3))
    over |= ~full
    for p in range(64):
        flip = np.where((own >> np.uint64(p)) & np.uint64(1), np.uint64(0xFFFFFFFFFFFFFFFF), np.uint64(0))
        diff = sliced[p][None, :] ^ flip[:, None]
        carry = one & diff
        one ^= diff
        over |= two & carry
        two ^= carry
        if p % 8 == 7:
            left = ~over
            held, open_ = np.bitwise_count(left).sum(axis=1) > 1, left.any(axis=0)
            if not held.all() or not open_.all():
                alive, own, blocks, sliced = alive[held], own[held], blocks[open_], sliced[:, open_]
                one, two, over = (x[held][:, open_] for x in (one, two, over))
                if not len(alive):
                    break
    if radius < 3:
        over = over | {0: one | two, 1: two, 2: one & two}[radius]
    out = np.zeros((len(alive), words), np.uint64)
    out[:, blocks] = ~over
    return alive, out


def block_links(fp: np.ndarray, radius: int = RADIUS, tile: int = 512) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links of a block of different fingerprints: (member, root) by number."""
    sliced, found, bits = planes(fp), [], []
    for at in range(0, len(fp), tile):
        rows, got = near(fp, np.arange(at, min(at + tile, len(fp))), sliced, radius)
        some = np.bitwise_count(got).sum(axis=1) > 1
        found.append(rows[some])
        bits.append(got[some])
    rows, links = np.concatenate(found), np.concatenate(bits)
    if not len(rows):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    where = np.full(len(fp), -1)
    where[rows] = np.arange(len(rows))
    left = np.zeros(len(fp), bool)
    left[rows] = True
    member, root = [], []
    for seed in rows.tolist():
        if not left[seed]:
            continue
        left[seed] = False
        front = np.array([seed])
        while len(front):
            reach = np.bitwise_or.reduce(links[where[front]], axis=0)
            front = np.flatnonzero(np.unpackbits(reach.astype("<u8").view(np.uint8), bitorder="little")[: len(fp)].astype(bool) & left)
            left[front] = False
            member.append(front)
            root.append(np.full(len(front), seed))
    return np.concatenate(member), np.concatenate(root)


# ---- all fingerprints --------------------------------------------------------------------------------------------------


def parts_of(count: int, radius: int = RADIUS) -> tuple[int, int]:
    """(parts, agreed bits kept) for so many fingerprints: buckets of about 256 if they were spread evenly."""
    want = max(1, count // 256).bit_length()
    for b in (radius + 1, radius + 2, radius + 3):
        bits = 64 * (b - radius) // b
        if want <= bits or b == radius + 3:
            return b, max(1, min(bits, want))
    raise AssertionError


def agreed(fp, parts: int, kept: int, radius: int = RADIUS):
    """The agreed value of each choice of parts, hashed together and cut to `kept` bits; with the number of the choice."""
    edges = [64 * k // parts for k in range(parts + 1)]
    piece = [F.shiftrightunsigned(F.shiftleft(fp, 64 - hi), 64 - hi + lo) for lo, hi in zip(edges, edges[1:], strict=False)]
    return F.array(
        *(
            F.struct(F.lit(k).alias("choice"), F.pmod(F.xxhash64(*(piece[i] for i in pick)), F.lit(1 << kept)).alias("value"))
            for k, pick in enumerate(combinations(range(parts), parts - radius))
        )
    )


def link(nodes: DataFrame, radius: int = RADIUS, block: int = 4096) -> DataFrame:
    """nodes: node (long), fp (long), all fp different -> forest edges a, b that join all fingerprints within the radius."""
    count = nodes.count()
    parts, kept = parts_of(count, radius)
    keyed = nodes.withColumn("x", F.explode(agreed(F.col("fp"), parts, kept, radius))).select("node", "fp", "x.choice", "x.value")
    # buckets over the block size are few; their chunks meet pair by pair
    large = keyed.groupBy("choice", "value").agg(F.count("*").alias("size")).where(F.col("size") > block)
    large = large.select("choice", "value", F.ceil(F.col("size") / (block // 2)).cast("int").alias("chunks"))
    dealt = keyed.join(large, ["choice", "value"], "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
    own = F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int")
    pairs = F.expr("transform(sequence(0, chunks - 1), o -> struct(least(o, own) as lo, greatest(o, own) as hi))")
    blocks = dealt.withColumn("own", own).select("choice", "value", F.explode(pairs).alias("pair"), "node", "fp")
    blocks = blocks.select("choice", "value", "pair.lo", "pair.hi", "node", "fp")
    keys = ["choice", "value", "lo", "hi"]
    sorted_ = blocks.repartition(*keys).sortWithinPartitions(*keys)

    def run(batches):
        import pyarrow as pa

        def columns(b):
            return [b.column(k).to_numpy(zero_copy_only=False) for k in range(6)]

        def links(held):
            node, fp = np.concatenate([h[1] for h in held]), np.concatenate([h[2] for h in held])
            if len(fp) < 2:
                return None
            order = np.argsort(node, kind="stable")
            node, fp = node[order], fp[order]
            m, r = block_links(fp.view(np.uint64), radius)
            return (node[m], node[r]) if len(m) else None

        held, out = [], []  # the open block
        for b in batches:
            if not b.num_rows:
                continue
            c, v, lo, hi, node, fp = columns(b)
            change = np.flatnonzero((c[1:] != c[:-1]) | (v[1:] != v[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])) + 1
            cuts = [0, *change.tolist(), len(c)]
            for s, e in zip(cuts, cuts[1:], strict=False):
                key = (c[s], v[s], lo[s], hi[s])
                if held and held[0][0] != key:
                    out.append(links(held))
                    held = []
                held.append((key, node[s:e], fp[s:e]))
            if out:
                found = [x for x in out if x]
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([x[k] for x in found])) for k in (0, 1)], names=["a", "b"])
                out = []
        if held and (x := links(held)):
            yield pa.RecordBatch.from_arrays([pa.array(x[0]), pa.array(x[1])], names=["a", "b"])

    return sorted_.mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, size: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """doc_id, text -> doc_id, fp (signed), component_id: one row per row of docs."""
    prints = cut(fingerprints(docs, size), "fingerprints")
    nodes = cut(prints.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("node")), "simhash-nodes")
    found = components(link(nodes, radius), "simhash")
    whole = nodes.join(found, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id"))
    return prints.join(whole, "fp", "left").select("doc_id", "fp", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))
