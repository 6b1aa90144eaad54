"""Phrase collocations per language, counted by Rabin-Karp fingerprints.

Texts are lower-cased (A-Z), cut into pieces at ``. , ; : ! ?`` and line ends, pieces into words at blanks and tabs. A task
joins its texts to one string of bytes with single blanks between words; prefix polynomials over the bytes modulo
primes give the fingerprint of every phrase of 1, 2 or 3 words as a difference of two prefixes. Per task equal fingerprints are
counted at once and keep a pointer to one occurrence; the shuffle adds counts and keeps the least pointer.

Only phrases of at least ``least`` occurrences matter, and all parts of a frequent phrase are frequent. So lengths are
counted one after the other, and a task makes fingerprints of n + 1 words only where both phrases of n words inside may be
frequent, by a bit filter of fixed size. A filter lets through too much when it is full, never too little.

A fingerprint is two residues; a third, the check, goes with it. Fingerprints whose occurrences differ in the check
are two phrases: their rows are counted again by fingerprint and check together. Pointers are then read from the texts, only
for frequent phrases, and the text's own fingerprint and check must be the ones that were counted. All further work is
on phrases as text.

Scores are exact: floor(10^6 a a / (l r)) in decimals, lowest cut (ties: after the fewest words). A candidate inside a
longer candidate of at least half its count goes.

Null and empty texts have no words. A null language is ``und``. Repeated rows count again. A piece longer than ``SLICE`` bytes
is worked on in slices that overlap by the words a phrase can reach, so texts of any length are read whole and memory follows
``SLICE`` and ``ENTRIES`` (and the longest word). Other columns are not read, so their names never clash. An empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sessionledger.llm.common import SENT_ROWS, sent
from sessionledger.session import materialize

UNKNOWN = "und"
LONGEST = 3
SLICE = 1 << 19  # bytes hashed at a time
ENTRIES, ROWS_OUT, KEPT_LANGS = 500_000, 100_000, 1_000  # phrases that a task holds before it counts them; rows that leave at a time
FILTER_BITS = 27  # of the number of bits of a filter: 16 MB, whatever the input
BLOCK_WORDS = 1 << 12  # 64-bit words of a filter that come to the driver in one row
PRIMES = (2_147_483_647, 2_147_483_629, 2_147_483_587)  # the largest below 2^31; products fit 62 bits
BASES = (911_382_323, 972_663_749, 1_370_589_211)

_BLANK, _END = 1, 2
_kind = np.zeros(256, dtype=np.uint8)
_kind[[0x20, 0x09]] = _BLANK
_kind[[*b".,;:!?", 0x0A, 0x0B, 0x0C, 0x0D]] = _END
_plain = bytes(range(256)).translate(bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t", b"abcdefghijklmnopqrstuvwxyz "))
_blanks, _stops = re.compile(rb"  +"), re.compile(rb"[ .,;:!?\n\x0b\x0c\r]")


def normal(text: str) -> bytes:
    """UTF-8 with A-Z in lower case and single blanks; places of phrases are places in these bytes."""
    return _blanks.sub(b" ", text.encode().translate(_plain))


def _normal_column(text: Column) -> Column:
    """``normal`` as a column, for reading phrases back."""
    up, low = "ABCDEFGHIJKLMNOPQRSTUVWXYZ\t", "abcdefghijklmnopqrstuvwxyz "
    return F.regexp_replace(F.translate(text, up, low), "  +", " ").cast("binary")


class Hasher:
    """Prefix polynomials modulo each prime; powers grow to the longest slice and shrink again."""

    def __init__(self, primes: tuple[int, ...] = PRIMES):
        self.primes, self.power, self.inverse = primes, [np.ones(1, dtype=np.int64)] * len(primes), [np.ones(1, dtype=np.int64)] * len(primes)

    def _tables(self, n: int) -> None:
        if len(self.power[0]) < n:
            size = max(n, SLICE + (SLICE >> 3))
            for k, p in enumerate(self.primes):
                for out, base in ((self.power, BASES[k] % p), (self.inverse, pow(BASES[k], -1, p))):
                    t, step = np.ones(1, dtype=np.int64), base
                    while len(t) < size:  # doubles: base^i for i < 2m from those for i < m
                        t, step = np.concatenate((t, t * step % p)), step * step % p
                    out[k] = t[:size]

    def spans(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
        """One residue per prime of the bytes of every span."""
        self._tables(len(data) + 1)
        out = []
        for p, power, inverse in zip(self.primes, self.power, self.inverse):
            sums = np.concatenate((np.zeros(1, dtype=np.int64), ((data.astype(np.int64) + 1) * power[:len(data)] % p).cumsum()))
            out.append((sums[ends] - sums[starts]) % p * inverse[starts] % p)
        if len(self.power[0]) > 4 * SLICE:  # after a very long word
            self.power, self.inverse = [x[:SLICE] for x in self.power], [x[:SLICE] for x in self.inverse]
        return out


def slices(text: bytes, words: int) -> Iterator[tuple[int, bytes, int]]:
    """``offset, bytes, own``: parts of at most about ``SLICE`` bytes; phrases that start before ``own`` are a part's own and lie in it."""
    at = 0
    while len(text) - at > SLICE:
        cut = max(text.rfind(c, at + 1, at + SLICE) for c in (b" ", b".", b",", b"\n"))
        if cut < 0:
            m = _stops.search(text, at + SLICE)
            cut = m.start() if m else len(text)
        end = cut
        for _ in range(words):  # the phrase's words behind the cut
            m = _stops.search(text, end + 1)
            end = m.start() if m else len(text)
        yield at, text[at:end], cut - at
        at = cut
    yield at, text[at:], len(text) - at


def phrases(parts: list[tuple[bytes, int]], n: int, hasher: Hasher, passes=None) -> tuple[np.ndarray, ...]:
    """Of all phrases of n words in the parts ``bytes, own``: fingerprint, check, number of the part, start, end; and the count of words.

    ``passes(fingerprints)`` tells which phrases of n - 1 words may be frequent; without it all are.
    """
    joined = b"\n".join(x for x, _ in parts)
    data = np.frombuffer(joined, dtype=np.uint8)
    kind = _kind[data]
    edge = np.diff(np.concatenate(([True], kind > 0, [True])).astype(np.int8))
    s, e = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    piece = np.concatenate(([0], (kind == _END).cumsum()))[s]
    first = np.concatenate(([0], np.array([len(x) + 1 for x, _ in parts]).cumsum()[:-1]))
    part = np.searchsorted(first, s, side="right") - 1
    own = s - first[part] < np.array([o for _, o in parts])[part]
    m = len(s) - n + 1
    if m <= 0:
        none = np.zeros(0, dtype=np.int64)
        return none, none, none, none, none, int(own.sum())
    at = np.flatnonzero((piece[:m] == piece[n - 1:]) & own[:m])
    if passes is not None and len(at):
        shorter = np.flatnonzero(piece[:m + 1] == piece[n - 2:]) if n > 2 else np.arange(len(s))
        ok = np.zeros(len(s), dtype=bool)
        one, two, *_ = hasher.spans(data, s[shorter], e[shorter + n - 2])
        ok[shorter[passes(one << 31 | two)]] = True
        at = at[ok[at] & ok[at + 1]]
    one, two, check = hasher.spans(data, s[at], e[at + n - 1])
    return one << 31 | two, check, part[at], s[at] - first[part[at]], e[at + n - 1] - first[part[at]], int(own.sum())


def _bit(fp, lang_hash):
    """The place of a fingerprint of a language in a filter."""
    x = (np.asarray(fp).astype(np.uint64) ^ np.uint64(lang_hash)) * np.uint64(0x9E3779B97F4A7C15)
    return (x >> np.uint64(64 - FILTER_BITS)).astype(np.int64)


def _lang_hash(lang: str) -> int:
    return int.from_bytes(lang.encode()[:7].ljust(7, b"~"), "little") * 0x2545F4914F6CDD1D & ((1 << 64) - 1)


_COUNTED = "lang string, fp long, check int, p long, q long, m long"


def _compact(entries: list[np.ndarray]) -> list[np.ndarray]:
    """Entries ``fp, check, p, q, m`` with one row for each fingerprint and check; its pointer is that of one occurrence."""
    fp, check, p, q, m = entries
    order = np.argsort(fp, kind="stable")
    f, k = fp[order], check[order]
    head = np.concatenate(([True], f[1:] != f[:-1]))
    if ((f[1:] == f[:-1]) & (k[1:] != k[:-1])).any():  # two phrases under one fingerprint
        order = np.lexsort((check, fp))
        f, k = fp[order], check[order]
        head = np.concatenate(([True], (f[1:] != f[:-1]) | (k[1:] != k[:-1])))
    at = np.flatnonzero(head)
    one = order[at]
    return [f[at], k[at], p[one], q[one], np.add.reduceat(m[order], at)]


def _counter(n: int, primes: tuple[int, ...], sieve=None):
    """Rows of ``_COUNTED`` per task: a fingerprint's count, its check and a pointer. Fingerprint -1 counts words."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hasher = Hasher(primes)
        bits = None if sieve is None else np.frombuffer(sieve.value, dtype=np.uint8)
        held: dict[str, list[list[np.ndarray]]] = {}
        words: dict[str, int] = {}
        n_held = 0

        def add(lang: str, parts: list, pointers: list) -> None:
            nonlocal n_held
            salt = _lang_hash(lang)

            def passes(fp: np.ndarray) -> np.ndarray:
                b = _bit(fp, salt)
                return bits[b >> 3] >> (b & 7) & 1 == 1

            fp, check, part, start, end, count = phrases(parts, n, hasher, None if bits is None else passes)
            base, offset = np.array([p for p, _ in pointers], dtype=np.int64), np.array([o for _, o in pointers], dtype=np.int64)
            if n == 1:
                words[lang] = words.get(lang, 0) + count
            if len(fp):
                held.setdefault(lang, []).append([fp, check.astype(np.int32), base[part], (start + offset[part]) << 31 | (end - start), np.ones(len(fp), dtype=np.int64)])
                n_held += len(fp)

        def counted(everything: bool) -> Iterator[pd.DataFrame]:
            """Counts what is held; counts that repeat much stay for the next round, others leave."""
            nonlocal n_held
            n_held = 0
            for lang in list(held):
                entries = _compact([np.concatenate(x) for x in zip(*held.pop(lang))])
                if not everything and len(held) < KEPT_LANGS and len(entries[0]) <= ENTRIES // 2:
                    held[lang] = [entries]
                    n_held += len(entries[0])
                    continue
                for i in range(0, len(entries[0]), ROWS_OUT):
                    yield pd.DataFrame({"lang": lang, **{c: x[i:i + ROWS_OUT] for c, x in zip(("fp", "check", "p", "q", "m"), entries)}})
            if n_held > ENTRIES // 2:
                yield from counted(True)

        for pdf in batches:
            for lang, rows in pdf.groupby("lang", sort=False):
                parts, pointers, size = [], [], 0
                for p, t in zip(rows["p"], rows["t"]):
                    for offset, data, own in slices(normal(t), n):
                        if parts and size + len(data) > SLICE:
                            add(lang, parts, pointers)
                            parts, pointers, size = [], [], 0
                            if n_held > ENTRIES:
                                yield from counted(False)
                        parts.append((data, own))
                        pointers.append((p, offset))
                        size += len(data) + 1
                if parts:
                    add(lang, parts, pointers)
                if n_held > ENTRIES:
                    yield from counted(False)
        yield from counted(True)
        if words:
            yield pd.DataFrame({"lang": list(words), "fp": -1, "check": 0, "p": 0, "q": 0, "m": list(words.values())})

    return run


def _added(rows: DataFrame, *by: str) -> DataFrame:
    """Sums by fingerprint. Tasks have counted what they hold, so rows are dealt out before Spark adds them up, as another count on
    their side would find little to add and take much memory."""
    sums = rows.repartition("lang", "fp").groupBy(*by).agg(F.min("check").alias("clo"), F.max("check").alias("chi"), F.min_by("q", "p").alias("q"), F.min("p").alias("p"), F.sum("m").alias("m"))
    return sums.select("lang", "fp", "clo", "chi", "p", "q", "m")


def _sieve(frequent: DataFrame) -> bytes:
    """The bit filter of the frequent fingerprints: 2^FILTER_BITS bits, set by Spark 64 at a time."""
    words = 1 << (FILTER_BITS - 6)

    def mark(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bits = np.zeros(1 << (FILTER_BITS - 3), dtype=np.uint8)
        for pdf in batches:
            for lang, fps in pdf.groupby("lang")["fp"]:
                b = _bit(fps.to_numpy(), _lang_hash(lang))
                np.bitwise_or.at(bits, b >> 3, (1 << (b & 7)).astype(np.uint8))
        whole = bits.view(np.int64)
        for a in range(0, words, 1 << 18):
            at = np.flatnonzero(whole[a:a + (1 << 18)]) + a
            if len(at):
                yield pd.DataFrame({"w": at, "bits": whole[at]})

    def packed(pdf: pd.DataFrame) -> pd.DataFrame:
        """At most ``BLOCK_WORDS`` rows as one string of bytes."""
        block = np.zeros(BLOCK_WORDS, dtype=np.int64)
        block[pdf["w"].to_numpy() % BLOCK_WORDS] = pdf["bits"].to_numpy()
        return pd.DataFrame({"block": pdf["block"].iloc[:1], "bits": [block.tobytes()]})

    rows = frequent.select("lang", "fp").mapInPandas(mark, "w long, bits long").groupBy("w").agg(F.bit_or("bits").alias("bits"))
    blocks = rows.withColumn("block", F.expr(f"cast(w div {BLOCK_WORDS} as int)")).groupBy("block").applyInPandas(packed, "block int, bits binary")
    found = {r["block"]: bytes(r["bits"]) for r in blocks.collect()}  # the filter's own size, whatever the input
    return b"".join(found.get(i, bytes(8 * BLOCK_WORDS)) for i in range(words // BLOCK_WORDS))


def _read_back(docs: DataFrame, frequent: DataFrame, primes: tuple[int, ...]) -> DataFrame:
    """``lang, phrase, a`` of ``frequent``: texts at its pointers, checked against the fingerprints."""
    frequent = materialize(frequent)
    wanted = frequent.groupBy("p").agg(F.collect_list(F.struct("lang", "fp", "clo", "q", "m")).alias("found"))  # at most a text's own phrases
    few = frequent.count() <= SENT_ROWS  # counted in phrases, as a text may hold many
    held = docs.join(F.broadcast(wanted) if few else wanted, "p").dropDuplicates(["p"])

    one = held.select(F.inline(F.array(F.struct(_normal_column(F.col("t")).alias("data"), F.col("found")))))
    spans = one.select("data", F.inline("found"))
    span = F.substring(F.col("data"), F.expr("int(shiftright(q, 31)) + 1"), F.expr("int(q & 2147483647)"))

    def fingerprint(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        hasher = Hasher(primes)
        for batch in batches:
            data = [x.encode() for x in batch]
            ends = np.array([len(x) for x in data]).cumsum()
            one, two, check = hasher.spans(np.frombuffer(b"".join(data), dtype=np.uint8), np.concatenate(([0], ends[:-1])), ends)
            yield pd.DataFrame({"fp": one << 31 | two, "check": check})

    own = F.pandas_udf(fingerprint, "fp long, check int")(F.col("phrase"))
    read = spans.select("lang", "fp", "clo", span.cast("string").alias("phrase"), F.col("m").alias("a")).withColumn("own", own)
    same = (F.col("own.fp") == F.col("fp")) & (F.col("own.check") == F.col("clo"))
    return read.select("lang", F.when(same, F.col("phrase")).otherwise(F.raise_error(F.lit("a pointer leads to another phrase"))).alias("phrase"), "a")


def frequent_phrases(docs: DataFrame, least: int = 10, text: str = "text", key: str = "doc_id", lang: str = "lang", primes: tuple[int, ...] = PRIMES) -> tuple[DataFrame, DataFrame]:
    """``lang, phrase, a`` of all phrases of up to ``LONGEST`` words with a >= least, and ``lang, n`` with all words of a language."""
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col(f"`{lang}`").cast("string"), F.lit(UNKNOWN)).alias("lang"), F.xxhash64(F.col(f"`{key}`"), F.col(f"`{text}`")).alias("p"), F.col(f"`{text}`").alias("t")).filter("t is not null")
    tables, sums, sieve = [], None, None
    for n in range(1, LONGEST + 1):
        counted = rows.mapInPandas(_counter(n, primes, sieve), _COUNTED)
        found = materialize(_added(counted, "lang", "fp").filter((F.col("m") >= least) | (F.col("fp") == -1)))
        if n == 1:
            sums = found.filter("fp = -1").select("lang", F.col("m").alias("n")).filter("n > 0")
        found = found.filter("fp >= 0")
        clash = found.filter("clo <> chi").select("lang", "fp")
        if not clash.isEmpty():
            again = _added(counted.join(sent(clash), ["lang", "fp"], "left_semi"), "lang", "fp", "check").filter(F.col("m") >= least)
            tables.append(materialize(again))
            tables.append(found.filter("clo = chi"))
        else:
            tables.append(found)
        if n < LONGEST:
            sieve = spark.sparkContext.broadcast(_sieve(found))
    whole = tables[0]
    for t in tables[1:]:
        whole = whole.unionByName(t)
    return materialize(_read_back(rows, whole, primes)), sums


def exact_score() -> Column:
    """floor(10^6 a a / (l r)) of columns ``a, l, r``; exact for counts below 10^15."""
    return F.expr("(decimal(1000000) * cast(a as decimal(15,0)) * cast(a as decimal(15,0))) div (cast(l as decimal(18,0)) * cast(r as decimal(18,0)))")


def collocations(docs: DataFrame, least: int = 10, top: int = 2_000, inside_percent: int = 50, text: str = "text", key: str = "doc_id", lang: str = "lang", primes: tuple[int, ...] = PRIMES) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: the best ``top`` phrases of every language."""
    counts, sums = frequent_phrases(docs, least, text, key, lang, primes)
    w = counts.withColumn("w", F.split("phrase", " ", -1))
    longer = w.filter("size(w) > 1")

    def joined(a: Column, n: Column) -> Column:
        return F.array_join(F.slice("w", a, n), " ")

    k = F.explode(F.sequence(F.lit(1), F.size("w") - 1))
    cuts = longer.select("lang", "phrase", "a", "w", k.alias("k"))
    sides = F.inline(F.array(F.struct(F.lit(True).alias("is_left"), joined(F.lit(1), F.col("k")).alias("part")), F.struct(F.lit(False).alias("is_left"), joined(F.col("k") + 1, F.size("w")).alias("part"))))
    parts = cuts.select("lang", "phrase", "a", "k", sides).join(counts.select("lang", F.col("phrase").alias("part"), F.col("a").alias("f")), ["lang", "part"])
    pairs = parts.groupBy("lang", "phrase", "a", "k").agg(F.max(F.when(F.col("is_left"), F.col("f"))).alias("l"), F.max(F.when(~F.col("is_left"), F.col("f"))).alias("r"))
    scored = pairs.withColumn("score", exact_score())
    best = scored.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("b"))

    # a phrase of n words lies in those of n + 1 only as their first or last n words, and by them in all longer ones
    inner = longer.filter("size(w) > 2").select("lang", "a", F.explode(F.array(joined(F.lit(1), F.size("w") - 1), joined(F.lit(2), F.size("w") - 1))).alias("phrase"))
    covered = inner.groupBy("lang", "phrase").agg(F.max("a").alias("outer_a"))
    left = best.join(covered, ["lang", "phrase"], "left").filter(F.col("outer_a").isNull() | (100 * F.col("outer_a") < inside_percent * F.col("a")))
    rows = left.select("lang", "phrase", "a", "b.l", "b.r", "b.score")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # many buckets first, so that no task orders all phrases of a language
    few = rows.withColumn("bucket", F.pmod(F.xxhash64("phrase"), F.lit(64))).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "bucket").orderBy(*order))).filter(F.col("rank") <= top)
    ranked = few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("rank") <= top)
    return ranked.join(sent(sums), "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
