"""Best-two-fit packing of token sequences.

A bin is filled greedily, always with the longest piece that still fits. When nothing fits, its smallest
piece is weighed against two unpacked pieces that fill the gap plus that piece's room more tightly; if
there are such two, they take its place.

Lengths are whole numbers up to the capacity, so the plan only needs the number of pieces of each length:
at most ``capacity`` counts, however large the corpus. It is made on the driver, each bin pattern with the
number of times it can be repeated. Pieces are then dealt to the planned places by their rank among the
pieces of their length. Ranks are counted in blocks of a piece's hash, so a length that a third of all
pieces share is not ordered in one task.

Tokens: texts are cut at blanks, tabs and line breaks, which this tokenizer drops, and each distinct word
is encoded once per worker; the ids of a text are those of its words in order. Words of plain Latin letters
are merged from the tokenizer file's ranks, which tests hold against the tokenizers library; the library
itself encodes everything else.

Nulls: a null text is empty, and so has the end token only. Repeated rows are packed as rows of their own;
rows equal in id and text are interchangeable. An empty table gives an empty result.
"""

from __future__ import annotations

import json
import os
import re
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sessionledger.llm.common import blocks_for, hash60
from sessionledger.session import materialize

END = 0  # follows each document
WORDS_KEPT = 150_000  # of a worker's memory of encoded words
_words: dict[str, tuple] = {}  # by tokenizer file: word -> its ids as little-endian unsigned 32-bit integers, and the encoders
MARKS = ".,!?;:%$#&*|"
plain = re.compile("[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017e]+").fullmatch  # letters that NFC leaves alone and that have one small letter
# a text with a rare blank is encoded as a whole
_ODD = re.compile("[\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200f\u2028\u2029\u202f\u205f\u3000\ufeff]")


def _byte_symbols() -> dict[str, int]:
    """The printable character that byte-level vocabularies write for each byte."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [x for x in range(256) if x not in shown]
    return {chr(x): x for x in shown} | {chr(256 + i): x for i, x in enumerate(rest)}


def _word_merger(path: str):
    """Ids of one lower-case word, by the tokenizer file's merges in their order.

    A byte that no UTF-8 text has stands for the end of a word, and joins the last letter first.
    """
    import tiktoken

    byte_of = _byte_symbols()
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    merged = {"".join(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]}
    single = {c + e for c in byte_of for e in ("", "</w>")}
    ranks = {}
    for token, n in model["vocab"].items():
        if token in merged or token in single:
            ends = token.endswith("</w>")
            ranks[bytes(byte_of[c] for c in token.removesuffix("</w>")) + b"\xff" * ends] = n
    ranks[b"\xff"] = 1 << 30
    return tiktoken.Encoding("words", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece


def _encoder(path: str):
    if path not in _words:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        _words[path] = ({"": b""}, Tokenizer.from_file(path), _word_merger(path))
    words, tok, merge = _words[path]

    def direct(texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype="<u4").tobytes() for e in tok.encode_batch_fast(texts, add_special_tokens=False)]

    def learn(new: set[str]) -> None:
        """Plain Latin words, with or without marks behind them, are merged one by one; the library does all others."""
        other = []
        for w in new:
            core = w.rstrip(MARKS)
            if not plain(core):
                other.append(w)
                continue
            low = core.lower()
            ids = words.get(low)
            if ids is None:
                found = merge(low.encode() + b"\xff")
                ids = words[low] = struct.pack(f"<{len(found)}I", *found)
            if len(w) > len(core):  # one more match of the tokenizer's pattern
                marks = w[len(core):]
                if marks not in words:
                    words[marks] = direct([marks])[0]
                ids += words[marks]
            words[w] = ids
        words.update(zip(other, direct(other)))

    def encode(text: str) -> bytes:
        if _ODD.search(text):
            return direct([text])[0]
        parts = text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")
        new = set(parts).difference(words)
        if new:
            if len(words) > WORDS_KEPT:
                words.clear()
                words[""] = b""
                new = set(parts).difference(words)
            learn(new)
        return b"".join([words[w] for w in parts])

    return encode


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = 2048, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, piece, start, length, ids``: documents as token ids with the end token, cut at ``capacity``.

    ``ids`` are little-endian unsigned 32-bit integers.
    """

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = _encoder(tokenizer)
        for pdf in batches:
            keys, pieces, starts, lengths, ids = [], [], [], [], []
            for k, t in zip(pdf["k"], pdf["t"]):
                raw = encode(t) + END.to_bytes(4, "little")
                n = len(raw) // 4
                for p, s in enumerate(range(0, n, capacity)):
                    keys.append(k)
                    pieces.append(p)
                    starts.append(s)
                    lengths.append(min(capacity, n - s))
                    ids.append(raw[4 * s:4 * (s + capacity)])
            yield pd.DataFrame({"k": pd.array(keys, dtype=pdf["k"].dtype), "piece": pieces, "start": starts, "length": lengths, "ids": ids})

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    if kind in ("bigint", "int"):  # keeps nulls apart from floats
        rows, kind = rows.withColumn("k", F.col("k").cast("string")), "string"
    return rows.mapInPandas(cut, f"k {kind}, piece int, start long, length long, ids binary").select(
        F.col("k").cast(docs.schema[key].dataType).alias(key), "piece", "start", "length", "ids")


def plan_bins(counts: dict[int, int], capacity: int) -> list[tuple[int, list[int]]]:
    """(times, lengths of the bin) in order; counts: pieces of each length from 1 to capacity."""
    free = np.zeros(capacity + 1, dtype=np.int64)
    for n, c in counts.items():
        free[n] = c
    out = []
    while True:
        held = free.copy()
        gap, bin_ = capacity, []
        while gap > 0:
            fits = np.flatnonzero(held[:gap + 1])
            if not len(fits):
                break
            n = int(fits[-1])
            k = min(gap // n, int(held[n]))
            held[n] -= k
            bin_ += [n] * k
            gap -= n * k
        if not bin_:
            return out
        need = free - held
        if gap > 0:
            small = bin_[-1]
            held[small] += 1
            pair = _best_two(held, small, gap + small)
            if pair:
                bin_ = sorted([*bin_[:-1], *pair], reverse=True)
                for n in pair:
                    held[n] -= 1
                need = np.maximum(need, free - held)
            else:
                held[small] -= 1
        used = np.flatnonzero(need)
        # the same choices are made again as long as the pieces they need are there
        times = max(1, int((free[used] // need[used]).min()))
        free -= (free - held) * times
        out.append((times, bin_))


def _best_two(held: np.ndarray, small: int, room: int) -> tuple[int, int] | None:
    """The two unpacked lengths with the largest sum that is over ``small`` and within ``room``."""
    own = np.flatnonzero(held[:room])
    if not len(own):
        return None
    at = np.searchsorted(own, np.minimum(room - own, own), side="right") - 1
    at = np.where((at >= 0) & (own[at] == own) & (held[own] < 2), at - 1, at)
    sums = np.where(at >= 0, own + own[at], 0)
    i = int(sums.argmax())
    return (int(own[i]), int(own[at[i]])) if sums[i] > small else None


def _places(plan: list[tuple[int, list[int]]]) -> dict[str, np.ndarray]:
    """One row per bin pattern and length in it: pieces first .. of that length go there, per to a bin."""
    taken: dict[int, int] = {}
    rows, seq = [], 0
    for times, bin_ in plan:
        offset = 0
        for n in dict.fromkeys(bin_):
            per = bin_.count(n)
            rows.append((n, taken.get(n, 0), seq, offset, per))
            taken[n] = taken.get(n, 0) + per * times
            offset += n * per
        seq += times
    rows.sort()
    names = ("length", "first", "seq", "offset", "per")
    return {k: np.array([r[i] for r in rows], dtype=np.int64) for i, k in enumerate(names)}


def best_two_fit(pieces: DataFrame, capacity: int = 2048, length: str = "length", keys: tuple[str, ...] = ("doc_id", "piece")) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``: places gapless from 0 in sequences of at most ``capacity``.

    Lengths must be whole numbers from 1 to ``capacity``. ``keys`` tell pieces apart. ``pieces`` is read
    several times, so it should be a stored table.
    """
    names = [c for c in pieces.columns if c not in ("sequence_id", "offset")]
    given = {n: f"c{i}" for i, n in enumerate(names)}
    counts = {int(r["n"]): int(r["m"]) for r in pieces.groupBy(F.col(length).alias("n")).agg(F.count("*").alias("m")).collect()}  # at most capacity rows
    if any(not 1 <= n <= capacity for n in counts):
        raise ValueError(f"lengths must be from 1 to {capacity}")
    places = _places(plan_bins(counts, capacity))
    sent = pieces.sparkSession.sparkContext.broadcast(places)

    b = 8 * blocks_for(sum(counts.values()))
    own = [F.col(given[k]) for k in keys]
    rows = pieces.select(*(F.col(f"`{n}`").alias(c) for n, c in given.items()), F.col(length).alias("n"))
    rows = rows.withColumn("block", hash60(*own) % b)
    sizes = rows.groupBy("n", "block").agg(F.count("*").alias("m"))
    ahead = Window.partitionBy("n").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("n", "block", F.coalesce(F.sum("m").over(ahead), F.lit(0)).alias("ahead"))
    order = Window.partitionBy("n", "block").orderBy(*own)
    ranked = rows.withColumn("r", F.row_number().over(order) - 1).join(sizes, ["n", "block"]).withColumn("rank", F.col("r") + F.col("ahead"))

    def place(n: pd.Series, rank: pd.Series) -> pd.DataFrame:
        p = sent.value
        at = np.searchsorted(p["length"] * (1 << 40) + p["first"], n.to_numpy() * (1 << 40) + rank.to_numpy(), side="right") - 1
        k = rank.to_numpy() - p["first"][at]
        return pd.DataFrame({"sequence_id": p["seq"][at] + k // p["per"][at], "offset": p["offset"][at] + k % p["per"][at] * n.to_numpy()})

    fill = F.pandas_udf(place, "sequence_id long, offset long")
    out = ranked.withColumn("place", fill(F.col("n").cast("long"), F.col("rank").cast("long")))
    return out.select(*(F.col(c).alias(n) for n, c in given.items()), "place.sequence_id", "place.offset")


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 2048, key: str = "doc_id", text: str = "text", keep_ids: bool = True) -> DataFrame:
    """All documents as placed pieces: ``key, piece, start, length, ids_crc32, sequence_id, offset`` and ``ids`` if kept."""
    pieces = token_pieces(docs, tokenizer, capacity, key, text).withColumn("ids_crc32", F.crc32("ids"))
    stored = materialize(pieces if keep_ids else pieces.drop("ids"))
    return best_two_fit(stored, capacity, keys=(key, "piece", "start", "ids_crc32"))


def sequences(placed: DataFrame) -> DataFrame:
    """The packed token sequences, ``sequence_id, ids``; needs pieces with ids. A group is one sequence."""
    parts = placed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("p"))
    return parts.select("sequence_id", F.aggregate("p", F.lit(b""), lambda a, x: F.concat(a, x["ids"])).alias("ids"))
