import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from tokenizers import Tokenizer

from geolith.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = [
    "", None, "İstanbul IŞIK", "Ends. comma, x.", "é. ü, Ä.", "<|startoftext|> hi <|STARTOFTEXT|> A.", "a<|endoftext|>b.", "don't I'LL we've.", "x\x01y \x01",
    " nb sp\x0bv\x0cf", "ABC.DEF, 12.5, 3,4.", "é. É, ́x", "ΣΑΣ. Σ,", "  two  spaces \n\n tabs\t\t", "\x1c\x1d.x", "a.,b.,", "'s.", "x'S.", "ﬁ. K. Å,",
]


def test_ids_are_those_of_the_plain_tokenizer():
    plain, rng = Tokenizer.from_file(PATH), random.Random(3)
    texts = ODD + ["".join(rng.choice("abcXYZéÄßİΣ .,'<|>0129\n\t\r\x0b́😀中-\x01") for _ in range(rng.randint(1, 30))) for _ in range(3000)]
    encode = packing.WordEncoder(PATH, most=500)
    for at in range(0, len(texts), 700):
        some = texts[at : at + 700]
        ids, ends = encode(pa.array(some))
        for x, own in zip(some, np.split(ids, ends[:-1]), strict=True):
            assert own.tolist() == [*plain.encode(x or "", add_special_tokens=False).ids, 1], x


def test_pieces_cover_each_document(spark):
    plain = Tokenizer.from_file(PATH)
    # repeated rows, null ids and texts, a text of 1 MB, and columns with the names of results
    rows = [(1, "a b c"), (1, "a b c"), (2, None), (None, "x y"), (None, "x y"), (3, "word " * 9000), (4, "lot" * 350_000)]
    docs = spark.createDataFrame([(*r, "clash", 7) for r in rows], "doc_id long, text string, sequence_id string, offset int")
    got = [r.asDict() for r in packing.pack_documents(docs, PATH, with_ids=True).collect()]
    whole = {}
    for r in sorted(got, key=lambda r: r["piece"]):
        assert r["ids_crc32"] == zlib.crc32(r["ids"]) and 4 * r["length"] == len(r["ids"]) and 0 < r["length"] <= 4096
        whole.setdefault(r["doc_id"], {}).setdefault(r["piece"], []).append(r)
    for doc_id, text in rows:
        want = np.array([*plain.encode(text or "", add_special_tokens=False).ids, 1], "<u4").tobytes()
        pieces = whole[doc_id]
        assert b"".join(pieces[k][0]["ids"] for k in sorted(pieces)) == want
        assert all(x["start"] == 4096 * k for k, xs in pieces.items() for x in xs)
        assert all(x["length"] == 4096 for k, xs in pieces.items() for x in xs if k < max(pieces))
    assert len(whole[1][0]) == len(whole[None][0]) == 2
    by = {}
    for r in got:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 4096


def test_no_rows(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert packing.pack_documents(docs, PATH).count() == 0


def squares(bins, lengths):
    return sum(sum(lengths[i] for i in b) ** 2 for b in bins)


def test_search_empties_bins():
    rng = random.Random(1)
    for lo, hi in ((700, 1400), (1000, 2000), (30, 4000), (1366, 2100)):
        lengths = [rng.randint(lo, hi) for _ in range(400)]
        # from one piece a bin, the search alone must do the work
        alone = [[i] for i in range(len(lengths))]
        found = packing.local_search(alone, lengths)
        assert sorted(i for b in found for i in b) == list(range(400)) and all(sum(lengths[i] for i in b) <= 4096 for b in found)
        assert squares(found, lengths) >= squares(alone, lengths)
        start = packing.best_fit(lengths)
        assert len(packing.local_search(start, lengths)) <= len(start)
        # no exchange of the three kinds is left, unless the bins are as few as can be
        if len(found) > -(-sum(lengths) // 4096):
            fills = [sum(lengths[i] for i in b) for b in found]
            for a, own in enumerate(found):
                outs = [lengths[i] for i in own] + [lengths[i] + lengths[j] for k, i in enumerate(own) for j in own[:k]]
                for b, theirs in enumerate(found):
                    for s in outs if a != b and fills[a] < 4096 > fills[b] else ():
                        for y in (0, *(lengths[i] for i in theirs)):
                            g = s - y
                            assert not (0 < g <= 4096 - fills[b] and g + fills[b] > fills[a])


def test_two_for_one_is_found():
    # 3000 + 1000 | 2000 + 1900: the two of the second bin fit where 3000 is only if it comes back
    lengths = [600, 500, 3000, 1090]
    found = packing.local_search([[0, 1], [2], [3]], lengths)
    assert len(found) == 2
