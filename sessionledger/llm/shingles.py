"""Sets of word shingles as sorted arrays of 64-bit hashes, computed for many texts at a time.

Words are runs of bytes other than ASCII blanks, with A-Z in lower case. A word's hash is a polynomial over
its bytes, read off prefix sums; a shingle's hash mixes those of its words in order. A text with fewer words
than the shingle is one shingle of all its words.
"""

from __future__ import annotations

import numpy as np

CHUNK = 400_000  # bytes worked on at a time; a longer text is a chunk of its own
_BASE = 0x9E3779B97F4A7C15
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_powers: list[np.ndarray] = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse mod 2^64."""
    if len(_powers[0]) <= n:
        size = max(n + 1, CHUNK + 1)
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers[0], _powers[1]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _combine(words: list[np.ndarray], seed: int) -> np.ndarray:
    out = np.full(len(words[0]), seed, dtype=np.uint64)
    for w in words:
        out = _mix(out * np.uint64(_BASE) + w)
    return out


def _chunk(texts: list[bytes], size: int) -> list[np.ndarray]:
    joined = b" ".join(texts).lower()
    lengths = np.array([len(t) for t in texts], dtype=np.int64)
    firsts = np.concatenate(([0], (lengths + 1).cumsum()[:-1]))
    a = np.frombuffer(joined, dtype=np.uint8)
    edge = np.diff(np.concatenate(([True], _BLANK[a], [True])).astype(np.int8))
    s, e = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    power, inverse = _power_tables(len(a))
    sums = np.concatenate((np.zeros(1, dtype=np.uint64), ((a.astype(np.uint64) + np.uint64(1)) * power[:len(a)]).cumsum(dtype=np.uint64)))
    words = _mix((sums[e] - sums[s]) * inverse[s] + (e - s).astype(np.uint64))
    n_words = np.bincount(np.searchsorted(firsts, s, side="right") - 1, minlength=len(texts))
    ends = n_words.cumsum()
    out = []
    shingled = _combine([words[i:len(words) - size + 1 + i] for i in range(size)], 1) if len(words) >= size else words[:0]
    for n, end in zip(n_words.tolist(), ends.tolist()):
        if n >= size:
            own = np.sort(shingled[end - n:end - size + 1])
            fresh = np.ones(len(own), dtype=bool)
            np.not_equal(own[1:], own[:-1], out=fresh[1:])
            out.append(own[fresh])
        elif n:
            out.append(_combine([words[i:i + 1] for i in range(end - n, end)], 2))
        else:
            out.append(words[:0])
    return out


def shingle_sets(texts: list[str | None], size: int = 4) -> list[np.ndarray]:
    """One sorted array of distinct shingle hashes per text; empty for a null text or one without a word."""
    out: list[np.ndarray] = []
    held, n = [], 0
    for t in texts:
        raw = (t or "").encode()
        if held and n + len(raw) > CHUNK:
            out += _chunk(held, size)
            held, n = [], 0
        held.append(raw)
        n += len(raw) + 1
    return out + (_chunk(held, size) if held else [])
