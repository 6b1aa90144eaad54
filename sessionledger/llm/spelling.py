"""Spelling variants: words one edit apart, found by asymmetric q-chunks, and the form each of them stands for.

Of two words the shorter (of equal ones the smaller) contributes two disjoint chunks of half its length, its first and
its last code points; the other contributes its positional grams of that length. One edit touches at most one of
the two chunks: one edit behind the first chunk leaves it in place, one before the last chunk moves that by the difference in
length, so by one at most. Chunks and grams meet where text, place within that shift and lengths agree, and the
edit distance is verified on the words themselves. Grams at places where no chunk can come to lie are not made.

A key under which too many pairs would meet (a beginning or an end that very many words share) is refined, never cut: what
the chunk leaves of both words differs by the same one edit, so the rests contribute chunks and grams again, and the key is
joined with theirs, until keys are small or the rests have two code points at most. Keys are 64-bit hashes; as words are
verified, equal hashes cost time only.

A word's *form* is its near word of largest count (ties: smallest in code-point order), if that count is at
least ``ratio`` times its own; its *root* is where the forms lead. Counts grow along forms, so they end.

Null texts have no words. A null document id is passed on to ``edit`` as it is. Empty texts and tables give no rows; repeated
rows count again; texts and words of any length are taken whole. Other columns are not read, so their names never clash.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionledger.llm.common import sent
from sessionledger.session import materialize

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RUN = "[a-zÀ-ÿ]+"
PAIRS = 20_000  # pairs of one key that are compared without refining it


def runs(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``key, run``: every maximal run of letters, A-Z in lower case, in every place where it stands."""
    low = F.translate(F.col(f"`{text}`"), UPPER, LOWER)
    return docs.select(F.col(f"`{key}`").alias("key"), F.explode(F.regexp_extract_all(low, F.lit(RUN), F.lit(0))).alias("run"))


def without_every(divisor: int) -> Callable[[Column, Column], Column]:
    """An edit for ``count_words``: where ``divisor`` divides the crc32 of ``key:run``, the run loses the code point at that number modulo its length."""

    def edit(key: Column, run: Column) -> Column:
        h = F.crc32(F.concat_ws(":", key.cast("string"), run))
        at = (h % F.length(run)).cast("int")
        shorter = F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))
        return F.when(key.isNotNull() & (h % divisor == 0), shorter).otherwise(run)

    return edit


def count_words(docs: DataFrame, text: str = "text", key: str = "doc_id", least_length: int = 6, least_count: int = 5, edit: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """``word, n``: the words of at least ``least_length`` code points and ``least_count`` occurrences in all texts."""
    rows = runs(docs, text, key)
    word = edit(F.col("key"), F.col("run")) if edit else F.col("run")
    return rows.select(word.alias("word")).filter(F.length("word") >= least_length).groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= least_count)


def _refined(rows: DataFrame) -> DataFrame:
    """Rows ``word, n, chunks, key, at, len`` (the rest of a word that a key leaves open) with the next chunks or grams joined to their key."""
    size, own = F.col("len"), F.col("chunks")

    def part(at: Column, q: Column, rest: Column, partner: Column, end: int) -> Column:
        """One chunk or gram: partner is the chunk side's length, end tells which of its two chunks it is."""
        key = F.xxhash64("key", partner, F.lit(end), F.substring(F.col("word"), F.col("at") + at + 1, q))
        return F.struct(key.alias("key"), (F.col("at") + rest).alias("at"), (size - q).alias("len"))

    def both(partner: Column) -> Column:
        q = F.floor(partner / 2).cast("int")
        return F.array(part(F.lit(0), q, q, partner, 0), part(size - q, q, F.lit(0), partner, 1))

    # a gram side of this length meets chunk sides of the same length and of one code point less
    parts = F.when(own, both(size)).otherwise(F.concat(both(size), F.when(size > 1, both(size - 1)).otherwise(F.slice(both(size), 1, 0))))
    return rows.select("word", "n", "chunks", F.inline(parts)).select("word", "n", "chunks", "key", "at", "len")


def near_pairs(words: DataFrame) -> DataFrame:
    """``a, a_n, b, b_n``: each pair of words one edit apart once; b is the longer, of equal lengths the larger. ``words``: distinct ``word, n``."""
    both = F.explode(F.array(F.lit(True), F.lit(False)))
    rows = words.select("word", "n", both.alias("chunks"), F.lit(0).cast("long").alias("key"), F.lit(0).alias("at"), F.length("word").alias("len")).filter("len > 0")
    pairs = None
    while True:
        rows = materialize(_refined(rows))
        keys = rows.groupBy("key").agg(F.sum(F.col("chunks").cast("long")).alias("s"), F.sum((~F.col("chunks")).cast("long")).alias("t"), F.max("len").alias("most"))
        # a word meets itself under each of its keys, so one pair is none
        open_keys = materialize(keys.filter("s > 0 and t > 0 and s * t > 1").select("key", ((F.col("s") * F.col("t") > PAIRS) & (F.col("most") > 2)).alias("hot")))
        hot = open_keys.filter("hot").select("key")
        n_hot = hot.count()
        plain = rows.join(sent(open_keys.filter("not hot").select("key")), "key", "left_semi")
        s, t = plain.filter("chunks").select("key", F.col("word").alias("a"), F.col("n").alias("a_n")), plain.filter("not chunks").select("key", F.col("word").alias("b"), F.col("n").alias("b_n"))
        ordered = (F.length("b") == F.length("a") + 1) | ((F.length("b") == F.length("a")) & (F.col("a") < F.col("b")))
        found = s.join(t, (s.key == t.key) & ordered & (F.levenshtein("a", "b", 1) == 1)).select("a", "a_n", "b", "b_n")
        if pairs is None and not n_hot:
            return found.distinct()
        found = materialize(found)
        pairs = found if pairs is None else pairs.unionByName(found)
        if not n_hot:
            return pairs.distinct()
        rows = rows.join(sent(hot), "key", "left_semi")


def _roots(forms: DataFrame) -> DataFrame:
    """``word, root`` of words with a form, by following pointers of doubling length."""
    jumps = materialize(forms.select("word", F.col("form").alias("root")))
    while True:
        further = jumps.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = materialize(jumps.join(sent(further), "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        jumps = moved.select("word", "root")
        if moved.filter("moved").isEmpty():
            return jumps


def variants(words: DataFrame, ratio: int = 5) -> DataFrame:
    """``word, n, n_near, form, form_n, root`` of every row of ``words`` (distinct ``word, n``)."""
    words = materialize(words.select("word", F.col("n").cast("long").alias("n")))
    pairs = materialize(near_pairs(words))
    sides = F.inline(F.array(
        F.struct(F.col("a").alias("word"), F.col("a_n").alias("n"), F.col("b").alias("other"), F.col("b_n").alias("other_n")),
        F.struct(F.col("b").alias("word"), F.col("b_n").alias("n"), F.col("a").alias("other"), F.col("a_n").alias("other_n"))))
    near = pairs.select(sides).groupBy("word", "n").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("less"), "other")).alias("best"))
    strong = -F.col("best.less") >= ratio * F.col("n")
    near = materialize(near.select("word", "n_near", F.when(strong, F.col("best.other")).alias("form"), F.when(strong, -F.col("best.less")).alias("form_n")))
    roots = _roots(near.filter("form is not null"))
    return (words.join(near, "word", "left").join(roots, "word", "left")
            .select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), "form", "form_n", F.coalesce("root", "word").alias("root")))
