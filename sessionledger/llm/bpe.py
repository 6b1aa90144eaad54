"""Byte-level BPE encoding and decoding with a two-tier lookup.

First tier: a minimal perfect hash over the vocabulary answers whole pre-tokens that are entries themselves.
Second tier, for the rest: the pre-token's bytes form a doubly linked list; a heap holds the ranks of
neighbouring pairs, the lowest is merged, and its neighbours' new pairs go on the heap.

Pre-tokens are the matches of the pattern. A text is first cut where a match must begin: at line feeds and
single blanks between other characters (with the pattern of public_tokenizers, which allows it). A worker
remembers a bounded number of pieces and pre-tokens; texts with other blanks are matched as a whole. Ids
are little-endian unsigned 32-bit integers.

A null text is empty and has no ids. Very long texts are encoded piece by piece. Repeated rows get the same
answer, and an empty table gives an empty result. Other columns pass through untouched.
"""

from __future__ import annotations

import base64
import heapq
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
import xxhash
from public_tokenizers import PATTERN
from pyspark.sql import Column
from pyspark.sql import functions as F

PIECES_KEPT = 240_000  # of a worker's memory of encoded pieces, and twice as many pre-tokens
DECODED_AT_ONCE = 100_000  # ids
MASK = (1 << 64) - 1


class PerfectHash:
    """Hash and displace: every key of a fixed set has a place of its own in 0 .. n - 1.

    Keys are put in buckets by one part of a 64-bit hash. Buckets are served from the largest to the smallest;
    each tries displacements until all its keys fall on free places, and a lone key is sent straight to a
    free place, written as a negative displacement. ``find`` gives a key's place; the caller compares the key
    stored there, as a foreign key falls on some place too.
    """

    PER_BUCKET = 3

    def __init__(self, keys: list[bytes]):
        n = len(keys)
        self.n, self.buckets = n, n // self.PER_BUCKET + 1
        hashes = [xxhash.xxh3_64_intdigest(k) for k in keys]
        if len(set(hashes)) < n:
            raise ValueError("keys must differ")
        by_bucket: dict[int, list[int]] = {}
        for h in hashes:
            by_bucket.setdefault(h % self.buckets, []).append(h)
        taken, self.shift = bytearray(n), [0] * self.buckets
        lone = []
        for b, own in sorted(by_bucket.items(), key=lambda x: (-len(x[1]), x[0])):
            if len(own) == 1:
                lone.append(b)
                continue
            d = 0
            while True:
                places = [self._place(h, d) for h in own]
                if len(set(places)) == len(places) and not any(taken[p] for p in places):
                    break
                d += 1
            self.shift[b] = d
            for p in places:
                taken[p] = 1
        for b, p in zip(lone, (p for p in range(n) if not taken[p])):
            self.shift[b] = -p - 1
        self.keys: list[bytes] = [b""] * n
        self.values = [0] * n
        for k in keys:
            self.keys[self.find(k)] = k

    def _place(self, h: int, d: int) -> int:
        if d < 0:
            return -d - 1
        x = ((h ^ (d * 0x9E3779B97F4A7C15)) * 0xBF58476D1CE4E5B9) & MASK
        return (x ^ (x >> 31)) % self.n

    def find(self, key: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(key)
        return self._place(h, self.shift[h % self.buckets])


class Codec:
    """Encoder and decoder of one rank file and pattern."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.bytes_of = {r: k for k, r in self.ranks.items()}
        self.whole = PerfectHash(list(self.ranks))
        for k, r in self.ranks.items():
            self.whole.values[self.whole.find(k)] = r
        self.matches = regex.compile(pattern).findall
        self.after_blank: dict[str, bytes] = {}  # pieces that follow a single blank, without it
        self.first: dict[str, bytes] = {}  # pieces that begin a line, and line feeds
        self.tokens: dict[str, bytes] = {}  # pre-tokens met lately
        self.older: dict[str, bytes] = {}  # and before that
        sizes = np.array([len(self.bytes_of.get(i, b"")) for i in range(max(self.bytes_of, default=0) + 1)])
        self.sizes, self.starts = sizes, np.concatenate(([0], sizes.cumsum()[:-1]))
        self.flat = np.frombuffer(b"".join(self.bytes_of.get(i, b"") for i in range(len(sizes))), dtype=np.uint8)
        self.parted = pattern == PATTERN

    def token(self, t: str) -> bytes:
        found = self.tokens.get(t)
        if found is None:
            found = self.older.get(t)
            if found is None:
                raw = t.encode()
                at = self.whole.find(raw)
                ids = [self.whole.values[at]] if self.whole.keys[at] == raw else self.merge(raw)
                found = struct.pack(f"<{len(ids)}I", *ids)
            if len(self.tokens) > PIECES_KEPT:
                self.older, self.tokens = self.tokens, {}
            self.tokens[t] = found
        return found

    def merge(self, raw: bytes) -> list[int]:
        """Ids of bytes that are no entry as a whole."""
        rank, n = self.ranks.get, len(raw)
        ends = list(range(1, n + 2))  # end of the part that begins here; 0 if none does any more
        before = list(range(-1, n))
        bits = (n + 1).bit_length()
        low = (1 << bits) - 1
        # heap entries are rank, start and end of a pair in one number
        heap = [r << 2 * bits | i << bits | i + 2 for i in range(n - 1) if (r := rank(raw[i:i + 2])) is not None]
        heapq.heapify(heap)
        pop, push = heapq.heappop, heapq.heappush
        while heap:
            x = pop(heap)
            i, end = x >> bits & low, x & low
            mid = ends[i]
            # stale unless the two parts are still as they were
            if not mid or mid >= n or ends[mid] != end:
                continue
            ends[mid] = 0
            ends[i] = end
            if end < n:
                before[end] = i
                r = rank(raw[i:ends[end]])
                if r is not None:
                    push(heap, r << 2 * bits | i << bits | ends[end])
            j = before[i]
            if j >= 0:
                r = rank(raw[j:end])
                if r is not None:
                    push(heap, r << 2 * bits | j << bits | end)
        out, i = [], 0
        while i < n:
            out.append(self.ranks[raw[i:ends[i]]])
            i = ends[i]
        return out

    def encode(self, text: str) -> bytes:
        # only blanks and line feeds that stand alone between other characters part the text
        if not text:
            return b""
        if not self.parted:
            return b"".join([self.token(t) for t in self.matches(text)])
        lines = text.split("\n")
        after, first = self.after_blank, self.first
        if len(after) + len(first) > PIECES_KEPT:
            after.clear()
            first.clear()
        out = []
        for k, line in enumerate(lines):
            words = line.split(" ")
            if len(words) != len(line.split()) or not line or line[0].isspace() or line[-1].isspace():
                return b"".join([self.token(t) for t in self.matches(text)])
            if k:
                out.append(self._piece("\n", first, ""))
            out.append(first.get(words[0]) or self._piece(words[0], first, ""))
            rest = words[1:]
            try:
                out += [after[w] for w in rest]
            except KeyError:
                out += [after.get(w) or self._piece(w, after, " ") for w in rest]
        return b"".join(out)

    def _piece(self, piece: str, known: dict[str, bytes], lead: str) -> bytes:
        found = known.get(piece)
        if found is None:
            found = known[piece] = b"".join([self.token(t) for t in self.matches(lead + piece)])
        return found

    def decode(self, ids: bytes) -> bytes:
        k = np.frombuffer(ids, dtype="<u4")
        if k.size and (k.max() >= len(self.sizes) or not self.sizes[k].all()):
            raise KeyError("an id that is not in the vocabulary")
        out = []
        for i in range(0, len(k), DECODED_AT_ONCE):
            part = k[i:i + DECODED_AT_ONCE]
            n = self.sizes[part]
            ends = n.cumsum()
            out.append(self.flat[np.repeat(self.starts[part] - ends + n, n) + np.arange(ends[-1])].tobytes())
        return b"".join(out)


_codecs: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str) -> Codec:
    """One codec per worker and rank file."""
    if (path, pattern) not in _codecs:
        _codecs[path, pattern] = Codec(path, pattern)
    return _codecs[path, pattern]


def encode(text: Column, path: str, pattern: str) -> Column:
    """The ids of a text as binary."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        one = codec(path, pattern)
        for batch in batches:
            yield pd.Series([one.encode(t) if t is not None else b"" for t in batch], dtype=object)

    return F.pandas_udf(run, "binary")(text)


def decode(ids: Column, path: str, pattern: str) -> Column:
    """The bytes that ids stand for; null stays null."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        one = codec(path, pattern)
        for batch in batches:
            yield pd.Series([one.decode(x) if x is not None else None for x in batch], dtype=object)

    return F.pandas_udf(run, "binary")(ids)


def round_trip(text: Column, path: str, pattern: str) -> Column:
    """struct(ids, decoded): a text's ids and the bytes that these ids stand for, in one pass over the texts."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        one = codec(path, pattern)
        for batch in batches:
            ids = [one.encode(t) if t is not None else b"" for t in batch]
            yield pd.DataFrame({"ids": pd.Series(ids, dtype=object), "decoded": pd.Series(map(one.decode, ids), dtype=object)})

    return F.pandas_udf(run, "ids binary, decoded binary")(text)
