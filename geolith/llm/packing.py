"""Best-fit packing of tokenised documents into sequences, bettered by local search.

Documents are tokenised and closed by an end id; only those longer than a sequence are cut. Full pieces are sequences of their
own. The rest are dealt by a hash with each row's own number into groups of about `group_pieces`, so neither a source, a key nor
rows that repeat make a group hot; each group is packed by best fit decreasing and then searched: pieces move, or are exchanged
one for one or two for one, between underfull bins while the sum of squared fills grows. The search ends when no such exchange is
left, or when the bins are as few as their contents allow, as then no bin can be emptied.

Defined results: null is an empty text, which is the end id alone; a table without rows packs to nothing; repeated rows are packed as
often as they occur; null ids stay null. Extra columns are ignored.
"""

from __future__ import annotations

import zlib
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

SIZE = 4096
#: Bytes of text that are tokenised at a time, if a single text is not longer.
SLICE_BYTES = 6 << 20


# ---- tokens ------------------------------------------------------------------------------------------------------------


class WordEncoder:
    """Ids of texts whose words, between ASCII blanks, are encoded on their own.

    The vocabulary drops white space and its normaliser and splitter never look across it, so a text's ids are its words'
    ids in a row. Words are told apart by Arrow, a batch at a time; each different word is encoded once while it is
    remembered, and the ids of all words are laid out by numpy.
    """

    #: A-Z to a-z (the vocabulary drops case), and the blanks to one.
    TABLE = bytes(32 if c in (9, 10, 13) else c + 32 if 65 <= c <= 90 else c for c in range(256))
    BLANKS = bytes(32 if c in (9, 10, 13) else c for c in range(256))
    #: Stands between words that are encoded in one text; one token, and in no word that is encoded that way.
    MARK = "\x01"

    def __init__(self, path: str, end_id: int = 1, most: int = 1_200_000):
        from tokenizers import Tokenizer

        self.tokenizer, self.end_id, self.most = Tokenizer.from_file(path), end_id, most
        mark = self.tokenizer.encode(self.MARK, add_special_tokens=False).ids
        self.mark = mark[0] if len(mark) == 1 else None
        # texts with these are left as they are, as special strings are looked for before case is dropped
        self.special = [str(t.content).encode()[:2] for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.clear()

    def clear(self) -> None:
        # word 0 is the end
        self.seen: dict[bytes, int] = {}
        self.pool, self.used = np.full(1 << 16, self.end_id, np.uint32), 1
        self.start, self.long, self.count = np.zeros(1 << 16, np.int64), np.ones(1 << 16, np.int32), 1

    def _grow(self, name: str, need: int) -> None:
        x = getattr(self, name)
        if need > len(x):
            setattr(self, name, np.concatenate((x, np.zeros(max(len(x), need - len(x)), x.dtype))))

    def _put(self, words: list[bytes], ids: np.ndarray, sizes: np.ndarray) -> None:
        self._grow("pool", self.used + len(ids))
        self._grow("start", self.count + len(words))
        self._grow("long", self.count + len(words))
        self.pool[self.used : self.used + len(ids)] = ids
        at = slice(self.count, self.count + len(words))
        self.start[at] = self.used + np.cumsum(sizes) - sizes
        self.long[at] = sizes
        self.seen.update(zip(words, range(self.count, self.count + len(words)), strict=True))
        self.used += len(ids)
        self.count += len(words)

    def _odd(self, text: bytes) -> bool:
        return self.mark is None or self.MARK.encode() in text or any(s in text for s in self.special)

    def _encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, one after the other, and how many each has."""
        if self._odd(b" ".join(words)):
            odd = [self._odd(w) for w in words]
            own = [np.array(self.tokenizer.encode(w.decode(), add_special_tokens=False).ids, np.uint32) if o else None for w, o in zip(words, odd, strict=True)]
            plain = [w for w, o in zip(words, odd, strict=True) if not o]
            ids, sizes = self._encode(plain) if plain else (np.empty(0, np.uint32), np.empty(0, np.int64))
            rest = iter(np.split(ids, np.cumsum(sizes)[:-1]))
            own = [next(rest) if x is None else x for x in own]
            return np.concatenate(own), np.array([len(x) for x in own])
        ids, sizes = [], []
        for at in range(0, len(words), 2000):
            some = f" {self.MARK} ".join([w.decode() for w in words[at : at + 2000]])
            whole = np.array(self.tokenizer.encode_batch_fast([some], add_special_tokens=False)[0].ids, np.uint32)
            marks = np.flatnonzero(whole == self.mark)
            ids.append(np.delete(whole, marks))
            sizes.append(np.diff(np.concatenate(([-1], marks, [len(whole)]))) - 1)
        return np.concatenate(ids), np.concatenate(sizes)

    def _learn(self, new: list[bytes]) -> None:
        """A stop or comma after an ASCII letter is a token of its own, so a word with one is its stem and the mark."""
        seen = self.seen
        cutoff = [w for w in new if w.endswith((b".", b",")) and w[-2:-1].isalpha() and b"<" not in w]
        if cutoff:
            told = set(cutoff)
            whole = [w for w in new if w not in told]
            whole += [w for w in {x for w in cutoff for x in (w[:-1], w[-1:])}.difference(whole) if w not in seen]
        else:
            whole = new
        if whole:
            self._put(whole, *self._encode(whole))
        if cutoff:
            head = np.fromiter((seen[w[:-1]] for w in cutoff), np.int64, len(cutoff))
            tail = np.fromiter((seen[w[-1:]] for w in cutoff), np.int64, len(cutoff))
            self._put(cutoff, self.lay(np.stack((head, tail), 1).ravel()), self.long[head].astype(np.int64) + self.long[tail])

    def lay(self, codes: np.ndarray) -> np.ndarray:
        """The ids of words by number, in a row."""
        long = self.long[codes]
        end = np.cumsum(long, dtype=np.int64)
        total = int(end[-1]) if len(end) else 0
        return self.pool[np.repeat(self.start[codes] - (end - long), long) + np.arange(total)]

    def __call__(self, texts) -> tuple[np.ndarray, np.ndarray]:
        """texts: an Arrow string or binary array -> ids of all texts, each closed by the end id; where each ends."""
        import pyarrow as pa
        import pyarrow.compute as pc

        if len(self.seen) > self.most:
            self.clear()
        data = pc.fill_null(texts.cast(pa.large_binary()), b"")
        offsets = np.frombuffer(data.buffers()[1], np.int64, len(data) + 1, data.offset * 8)
        lo, hi = int(offsets[0]), int(offsets[-1])
        raw = data.buffers()[2].slice(lo, hi - lo).to_pybytes() if hi > lo else b""
        if any(s in raw for s in self.special):
            rows = [t.translate(self.BLANKS if any(s in t for s in self.special) else self.TABLE) for t in data.to_pylist()]
            data = pa.array(rows, pa.large_binary())
        else:
            data = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer((offsets - lo).tobytes()), pa.py_buffer(raw.translate(self.TABLE))])
        parts = pc.split_pattern(data, " ")
        words = parts.flatten().dictionary_encode()
        each = words.dictionary.to_pylist()
        get = self.seen.get
        new = [w for w in each if w not in self.seen]
        if new:
            self._learn(new)
        number = np.fromiter(map(get, each), np.int64, len(each))
        codes = number[words.indices.to_numpy(zero_copy_only=False)] if len(words) else np.empty(0, np.int64)
        # the end after each text
        last = np.cumsum(pc.list_value_length(parts).to_numpy(zero_copy_only=False).astype(np.int64))
        whole = np.zeros(len(codes) + len(last), np.int64)
        inner = np.ones(len(whole), bool)
        inner[last + np.arange(len(last))] = False
        whole[inner] = codes
        sizes = np.concatenate(([0], np.cumsum(self.long[whole], dtype=np.int64)))
        return self.lay(whole), sizes[last + np.arange(len(last)) + 1]


@lru_cache(maxsize=2)
def encoder(path: str, end_id: int) -> WordEncoder:
    """One for each worker process, so that words are remembered from task to task."""
    return WordEncoder(path, end_id)


def by_bytes(batch, column: int, most: int = SLICE_BYTES):
    """An Arrow batch in slices of about so many bytes of a column, a row at least."""
    import pyarrow.compute as pc

    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        before = int(ends[at - 1]) if at else 0
        stop = max(at + 1, int(np.searchsorted(ends, before + most, "right")))
        yield batch.slice(at, stop - at)
        at = stop


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def tokenize(docs: DataFrame, tokenizer_path: str, end_id: int = 1, size: int = SIZE, with_ids: bool = True) -> DataFrame:
    """doc_id, text -> a row per piece: doc_id, piece, start, length, ids_crc32 and, if asked for, ids (little-endian unsigned 32-bit)."""

    def run(batches):
        import os

        import pyarrow as pa

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        encode = encoder(tokenizer_path, end_id)
        for whole in batches:
            for batch in by_bytes(whole, 1):
                ids, ends = encode(batch.column(1))
                begin = np.concatenate(([0], ends[:-1]))
                many = -(-(ends - begin) // size)
                row = np.repeat(np.arange(len(ends)), many)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
                start = piece * size
                length = np.minimum(size, (ends - begin)[row] - start)
                raw, at = memoryview(ids.astype("<u4").tobytes()), 4 * (begin[row] + start)
                parts = [raw[a:b] for a, b in zip(at.tolist(), (at + 4 * length).tolist(), strict=True)]
                columns = [batch.column(0).take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array([zlib.crc32(p) for p in parts], pa.int64())]
                if with_ids:
                    columns.append(pa.array([bytes(p) for p in parts], pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: len(columns)])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, PIECES + ", ids binary" * with_ids)


# ---- one group ---------------------------------------------------------------------------------------------------------


def best_fit(lengths, size: int = SIZE) -> list[list[int]]:
    """Best fit decreasing: bins of piece numbers. Open bins by room, the rooms in use as bits of a number."""
    room: dict[int, list[int]] = {}
    mask, bins = 0, []
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        need = lengths[i]
        above = mask >> need
        if above:
            left = need + (above & -above).bit_length() - 1
            b = room[left].pop()
            if not room[left]:
                mask ^= 1 << left
        else:
            left, b = size, len(bins)
            bins.append([])
        bins[b].append(i)
        if rest := left - need:
            room.setdefault(rest, []).append(b)
            mask |= 1 << rest
    return bins


class Search:
    """Exchanges between underfull bins, each the one that grows the sum of squared fills most.

    A bin that takes gains g, the one that gives loses it, and the squares grow by 2 g (g + fill that takes - fill that gives).
    What a taker hands back is one of its pieces, or nothing: then the exchange is a move.
    """

    def __init__(self, bins: list[list[int]], lengths, size: int = SIZE):
        self.size, self.bins = size, [list(b) for b in bins]
        # after the pieces, a piece of no length in each bin stands for handing back nothing
        self.long = np.concatenate((np.asarray(lengths, np.int64), np.zeros(len(bins), np.int64)))
        self.at = np.zeros(len(self.long), np.int64)
        self.pieces = len(lengths)
        for k, b in enumerate(self.bins):
            self.at[b] = k
        self.at[self.pieces :] = np.arange(len(bins))
        self.fill = np.bincount(self.at, self.long, len(bins)).astype(np.int64)
        self.least = -(-int(self.fill.sum()) // size)
        self.left = sum(bool(b) for b in self.bins)

    def exchange(self, give: int, out: list[tuple[int, ...]]):
        """The best exchange of one of these sets of pieces of bin `give`: (set, piece that comes back), or None."""
        taker = self.fill[self.at]
        open_ = np.flatnonzero((taker < self.size) & (taker > 0) & (self.at != give))
        if not len(open_) or not out:
            return None
        back, taker = self.long[open_], taker[open_]
        best, found = 0, None
        sums = np.array([self.long[list(s)].sum() for s in out])
        sums, first = np.unique(sums, return_index=True)
        block = max(1, 2_000_000 // len(open_))
        for a in range(0, len(sums), block):
            g = sums[a : a + block, None] - back
            grows = np.where((g > 0) & (g <= self.size - taker), g * (g + taker - self.fill[give]), 0)
            k = int(grows.argmax())
            if grows.flat[k] > best:
                best, found = int(grows.flat[k]), (out[first[a + k // len(open_)]], int(open_[k % len(open_)]))
        return found

    def apply(self, give: int, out: tuple[int, ...], back: int) -> None:
        take = int(self.at[back])
        gain = int(self.long[list(out)].sum() - self.long[back])
        self.bins[give] = [x for x in self.bins[give] if x not in out]
        self.bins[take] += out
        self.at[list(out)] = take
        if back < self.pieces:
            self.bins[take].remove(back)
            self.bins[give].append(back)
            self.at[back] = give
        self.fill[give] -= gain
        self.fill[take] += gain
        self.left -= not self.bins[give]

    def run(self) -> list[list[int]]:
        moved = True
        while moved and self.left > self.least:
            moved = False
            # the emptiest gives first
            for give in np.argsort(self.fill, kind="stable").tolist():
                while self.left > self.least and 0 < self.fill[give] < self.size:
                    own = self.bins[give]
                    step = self.exchange(give, [(i,) for i in own])
                    if step is None:
                        step = self.exchange(give, [(i, j) for k, i in enumerate(own) for j in own[:k]])
                    if step is None:
                        break
                    self.apply(give, *step)
                    moved = True
        return [b for b in self.bins if b]


def local_search(bins: list[list[int]], lengths, size: int = SIZE) -> list[list[int]]:
    """Moves, one-for-one and two-for-one exchanges until none grows the sum of squared fills, or the bins are as few as the
    contents allow; empty bins go."""
    return Search(bins, lengths, size).run()


# ---- all pieces --------------------------------------------------------------------------------------------------------


def pack(pieces: DataFrame, size: int = SIZE, group_pieces: int = 20_000) -> DataFrame:
    """pieces: doc_id, piece, length (and more) -> the same rows with sequence_id and offset. pieces should be a cut table, as
    it is read twice; columns of these two names are replaced."""
    names = [c for c in pieces.columns if c not in ("sequence_id", "offset")]
    pieces = pieces.select(*names)
    short = pieces.where(F.col("length") < size)
    groups = max(1, -(-short.count() // group_pieces))
    full = pieces.where(F.col("length") >= size).withColumn("sequence_id", -1 - F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))
    out = ", ".join(f"`{n}` {t}" for n, t in pieces.dtypes) + ", sequence_id long, offset long"

    def run(key, table):
        import pyarrow as pa

        lengths = table.column("length").to_pylist()
        bins = local_search(best_fit(lengths, size), lengths, size)
        seq, at = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
        for b, members in enumerate(bins):
            o = 0
            for i in members:
                seq[i], at[i] = (key[0].as_py() << 32) + b, o
                o += lengths[i]
        return table.select(names).append_column("sequence_id", pa.array(seq)).append_column("offset", pa.array(at))

    # the row's number parts rows that repeat; it is the same whenever the written table is read
    dealt = short.groupBy(F.pmod(F.xxhash64("doc_id", "piece", "length", F.monotonically_increasing_id()), F.lit(groups)).alias("pack_group"))
    return dealt.applyInArrow(run, out).unionByName(full)


def pack_documents(docs: DataFrame, tokenizer_path: str, size: int = SIZE, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids), sequence_id, offset."""
    return pack(cut(tokenize(docs, tokenizer_path, size=size, with_ids=with_ids), "pieces"), size)
