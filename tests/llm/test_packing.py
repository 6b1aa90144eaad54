import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest

from sessionledger.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def ids_of(tokenizer, text):
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]


def check(rows, wanted, capacity):
    """rows: placed pieces; wanted: Counter of (doc_id, piece, start, length, crc)."""
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == wanted
    bins = defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins)


@pytest.mark.parametrize("capacity", [64, 2048])
def test_pieces_and_places(docs, empty, tokenizer, capacity):
    wanted = Counter()
    for r in docs.select("doc_id", "text").collect():
        ids = ids_of(tokenizer, r.text)
        for p, s in enumerate(range(0, len(ids), capacity)):
            part = ids[s:s + capacity]
            wanted[r.doc_id, p, s, len(part), zlib.crc32(np.array(part, dtype="<u4").tobytes())] += 1
    placed = packing.pack_documents(docs, PATH, capacity)
    n = check(placed.collect(), wanted, capacity)
    total = sum(k[3] * c for k, c in wanted.items())
    assert n <= -(-total // capacity) + max(3, total // capacity // 20)
    packed = packing.sequences(placed).collect()
    assert len(packed) == n and sum(len(r.ids) for r in packed) == 4 * total
    assert packing.pack_documents(empty, PATH, capacity).count() == 0


def test_words_agree_with_the_library(small, tokenizer):
    encode = packing._encoder(PATH)
    odd = ["ΣΑΣ it'S 'Tis I'LL", "İstanbul ŉ ﬁ", "éţ", "a b c", "x​y", "1a2b 12.5%", "<|startoftext|> <|endoftext|>x", "word!!, (word)...", "日本語"]
    for t in odd + [r.text for r in small.collect()]:
        assert encode(t) == np.array(tokenizer.encode(t, add_special_tokens=False).ids, dtype="<u4").tobytes(), t[:60]


def test_plan_packs_every_piece_once():
    r = random.Random(5)
    for capacity in (7, 50, 300):
        counts = Counter(r.randint(1, capacity) for _ in range(r.choice([1, 30, 900])))
        plan = packing.plan_bins(dict(counts), capacity)
        got = Counter()
        for times, bin_ in plan:
            assert sum(bin_) <= capacity
            for n in bin_:
                got[n] += times
        assert got == counts
    assert packing.plan_bins({}, 10) == []


def test_two_replace_the_smallest():
    # greedy fills 6 + 3 and leaves a gap of 1; 2 + 2 fit the gap and the room of 3 exactly
    assert packing.plan_bins({6: 1, 3: 1, 2: 2}, 10)[0] == (1, [6, 2, 2])


def test_unfit_lengths(spark):
    with pytest.raises(ValueError):
        packing.best_two_fit(spark.createDataFrame([(1, 0, 11)], "doc_id long, piece int, length long"), 10)
