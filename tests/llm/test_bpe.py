import base64

import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F

from sessionledger.llm import bpe

PATH = P.path("byte_bpe_50k.tiktoken")
ODD = ["", "a  b", "x\n\ny", " lead", "trail ", "tab\tx", "a\x1cb \x1c c", "a\x85b", "a\xa0b", "it's I'LL they're", "日本語 テキスト", "\n", "a\n b", "a \nb", "12 345", "!!! ..", "<|endoftext|>", "ſ's İ", "\r\nx", "🙂 ok", "a" * 3000, " " * 50, "é é"]


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def numbers(raw):
    return [int.from_bytes(raw[i:i + 4], "little") for i in range(0, len(raw), 4)]


def test_same_ids_as_the_library(library, small, texts):
    one = bpe.codec(PATH, P.PATTERN)
    for t in ODD + [t or "" for t in texts] + [r.text for r in small.collect()]:
        raw = one.encode(t)
        assert numbers(raw) == library.encode_ordinary(t), t[:50]
        assert one.decode(raw) == t.encode()


def test_perfect_hash():
    keys = [f"key {i}".encode() for i in range(5000)]
    h = bpe.PerfectHash(keys)
    assert sorted(h.find(k) for k in keys) == list(range(5000))
    assert all(h.keys[h.find(k)] == k for k in keys)
    foreign = b"no key"
    assert h.keys[h.find(foreign)] != foreign


def test_columns(docs, empty, library):
    out = docs.withColumn("ids", bpe.encode(F.col("text"), PATH, P.PATTERN)).withColumn("back", bpe.decode(F.col("ids"), PATH, P.PATTERN))
    for r in out.collect():
        assert numbers(r.ids) == library.encode_ordinary(r.text or "") and bytes(r.back) == (r.text or "").encode()
    same = docs.select("text", bpe.round_trip(F.col("text"), PATH, P.PATTERN).alias("b")).collect()
    assert all(bytes(r.b.decoded) == (r.text or "").encode() and numbers(r.b.ids) == library.encode_ordinary(r.text or "") for r in same)
    assert empty.withColumn("ids", bpe.encode(F.col("text"), PATH, P.PATTERN)).count() == 0
