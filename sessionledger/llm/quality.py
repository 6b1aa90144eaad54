"""Quality rules: plain counts, and how far a document's histograms lie from its language's.

Two histograms of a document are held against references that are taken over all documents of its
language: character classes (capitals, digits, blanks, punctuation, symbols, all else) and the language's
most common words with one place for all other words. The distance is the Jensen-Shannon distance, the
square root of the divergence in bits, from 0 to 1. A short text has ragged histograms, so each distance
only counts from a minimum length on.

A document whose language is null is held against every language with a word reference (where none has one,
against every language) and against all documents together, and counts as the nearest of them: the one whose
larger distance, as a share of its limit, is the smallest. It stays if any of them would keep it. A language with fewer words in
the corpus than ``MIN_REFERENCE_WORDS`` has no word reference: only the character classes are compared.
A null text has no words. Repeated rows are judged alike. An empty table gives an empty result. Only
built-in functions are used; other columns pass through untouched, but for one named ``quality``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sessionledger.llm.common import let
from sessionledger.session import materialize

BLANKS = " \t\n\x0b\f\r"
COMMON_WORDS = 12
MIN_CHARS, MIN_WORDS = 200, 60
MAX_CHAR_DISTANCE, MAX_WORD_DISTANCE = 0.32, 0.29
MIN_REFERENCE_WORDS = 5_000
WINDOW = 8
LANGUAGES_SENT = 1_000  # references of more languages are joined by shuffle
ANY = "*"  # the reference of all documents; other languages are written with a leading "="

CAPITALS, DIGITS, MARKS, SYMBOLS = r"\p{Lu}", r"\p{Nd}", "[.,;:!?'\"()-]", "[#*$%&|<>]"


def words_of(text: Column) -> Column:
    """The runs of characters other than ASCII blanks."""
    t = F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANKS))
    return F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, r"[\x20\x09-\x0D]+"))


def repeated_words(words: Column) -> Column:
    """Words inside windows of eight that occur twice or more in the text."""

    def covered(h: Column) -> Column:
        ordered = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))

        def starts(o: Column) -> Column:
            def twice(s: Column, j: Column) -> Column:
                before = F.when(j > 0, F.get(o, j - 1)["x"] == s["x"])
                after = F.get(o, j + 1)["x"] == s["x"]
                return F.coalesce(before, F.lit(False)) | F.coalesce(after, F.lit(False))

            return F.sort_array(F.transform(F.filter(o, twice), lambda s: s["i"]))

        return let(ordered, lambda o: F.aggregate(
            starts(o), F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).cast("long").alias("n")),
            lambda a, s: F.struct(s.alias("last"), (a["n"] + F.least(F.lit(WINDOW), s - a["last"])).alias("n")),
            lambda a: a["n"]))

    def counted(w: Column) -> Column:
        hashes = F.transform(F.sequence(F.lit(1), F.size(w) - WINDOW + 1), lambda i: F.xxhash64(F.slice(w, i, WINDOW)))
        return let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(covered(h)))

    own = let(F.transform(words, lambda x: F.xxhash64(x)), counted)
    return F.when(F.size(words) > WINDOW, own).otherwise(F.lit(0).cast("long"))


def _classes(text: Column, word_chars: Column) -> list[Column]:
    """Characters of each class; the last is everything else."""
    n = F.length(text).cast("long")
    some = [F.regexp_count(text, F.lit(p)).cast("long") for p in (CAPITALS, DIGITS, MARKS, SYMBOLS)]
    return [*some, n - word_chars, n]


def measures(docs: DataFrame, text: str, keep: dict[str, Column]) -> DataFrame:
    """The columns of ``keep`` and a struct ``m`` of the counts: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, classes, joined."""
    t = F.coalesce(F.col(text), F.lit(""))
    # the generator keeps the split from being copied
    split = docs.select(*(c.alias(n) for n, c in keep.items()), t.alias("t"), F.inline(F.array(F.struct(words_of(t).alias("w")))))
    t, w = F.col("t"), F.col("w")
    lines = F.transform(F.filter(F.split(t, "\n"), lambda x: F.btrim(x, F.lit(BLANKS)) != ""), lambda x: F.xxhash64(x))
    chars = F.length(F.array_join(w, "")).cast("long")
    upper, digits, marks, symbols, blanks, n = _classes(t, chars)
    row = F.struct(
        F.size(w).cast("long").alias("n_words"), chars.alias("word_chars"), symbols.alias("n_symbols"),
        let(lines, lambda a: (F.size(a) - F.size(F.array_distinct(a))).cast("long")).alias("n_dup_lines"),
        repeated_words(w).alias("n_repeat_words"),
        F.array(upper, digits, blanks, marks, symbols, n).alias("classes"),
        F.concat(F.lit(" "), F.array_join(w, "  "), F.lit(" ")).alias("joined"))
    return split.select(*keep, F.inline(F.array(F.struct(row.alias("m")))))


def references(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """One row per language and one for all: ``ref_lang, ref_classes, ref_words, ref_shares, ref_total`` from every document."""
    t = F.coalesce(F.col(text), F.lit(""))
    name = F.coalesce(F.concat(F.lit("="), F.col(lang)), F.lit(ANY))
    counts = docs.select(name.alias("ref_lang"), F.explode(words_of(t)).alias("w")).groupBy("ref_lang", "w").agg(F.count("*").alias("n"))
    # a language's words and, under ANY, those of all languages; w is null in the row of a language's total
    both = counts.select(F.explode(F.array_distinct(F.array("ref_lang", F.lit(ANY)))).alias("ref_lang"), "w", "n").groupBy("ref_lang", "w").agg(F.sum("n").alias("n"))
    totals = both.groupBy("ref_lang").agg(F.sum("n").alias("ref_total"))
    # a limited row number is pushed below the shuffle: a few words per task and language
    order = Window.partitionBy("ref_lang").orderBy(F.desc("n"), "w")
    top = both.withColumn("k", F.row_number().over(order)).filter(F.col("k") <= COMMON_WORDS)
    lists = top.groupBy("ref_lang").agg(F.sort_array(F.collect_list(F.struct("k", "w", "n"))).alias("l")).join(totals, "ref_lang")
    n = F.length(t).cast("long")
    chars = F.length(F.array_join(words_of(t), "")).cast("long")
    per = docs.select(name.alias("ref_lang"), F.array(*_classes(t, chars)).alias("c"))
    upper, digits, marks, symbols, blanks, n = (F.col("c")[i] for i in range(6))
    classes = (per.select("ref_lang", upper.alias("c0"), digits.alias("c1"), blanks.alias("c2"), marks.alias("c3"), symbols.alias("c4"), n.alias("c5"))
               .groupBy("ref_lang").agg(*(F.sum(f"c{i}").alias(f"c{i}") for i in range(6)))
               .select(F.explode(F.array_distinct(F.array("ref_lang", F.lit(ANY)))).alias("ref_lang"), *(f"c{i}" for i in range(6)))
               .groupBy("ref_lang").agg(F.array(*(F.sum(f"c{i}") for i in range(6))).alias("ref_classes")))
    return classes.join(lists, "ref_lang", "left").select(
        "ref_lang", "ref_classes", F.coalesce(F.col("l.w"), F.array().cast("array<string>")).alias("ref_words"),
        F.coalesce(F.transform("l", lambda x: x["n"] / F.col("ref_total")), F.array().cast("array<double>")).alias("ref_shares"), F.coalesce("ref_total", F.lit(0)).alias("ref_total"))


def js_distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance of two share arrays of one length, from 0 to 1."""

    def part(a: Column, b: Column) -> Column:
        return F.when(a > 0, a * F.log2(2 * a / (a + b))).otherwise(0.0)

    both = F.zip_with(p, q, lambda a, b: (part(a, b) + part(b, a)) / 2)
    return F.sqrt(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.aggregate(both, F.lit(0.0), lambda s, x: s + x))))


def _class_shares(c: Column) -> Column:
    """Five named classes and the rest, as shares; c ends with the number of characters."""
    named = [F.get(c, F.lit(i)) for i in range(5)]
    n = F.get(c, F.lit(5))
    return F.transform(F.array(*named, n - sum(named[1:], named[0])), lambda x: F.greatest(x, F.lit(0)) / F.greatest(n, F.lit(1)))


def _word_shares(words: Column, joined: Column, n_words: Column) -> Column:
    """Shares of the listed words; ``joined`` has every word between blanks of its own."""

    def count(w: Column) -> Column:
        bare = F.replace(joined, F.concat(F.lit(" "), w, F.lit(" ")), F.lit(""))
        return (F.octet_length(joined) - F.octet_length(bare)) / (F.octet_length(w) + 2) / F.greatest(n_words, F.lit(1))

    return F.transform(words, count)


def _with_rest(shares: Column) -> Column:
    return let(shares, lambda s: F.concat(s, F.array(F.greatest(F.lit(0.0), 1 - F.aggregate(s, F.lit(0.0), lambda a, x: a + x)))))


def _candidates(stored: DataFrame) -> DataFrame:
    """``ref_lang, refs``: a language's own reference and, under ANY, all that a document of unknown language is held against."""
    own = F.struct("ref_classes", "ref_words", "ref_shares", "ref_total")
    named = stored.filter(F.col("ref_lang") != ANY)
    heard = named.filter(F.col("ref_total") >= MIN_REFERENCE_WORDS)
    if heard.isEmpty() and not named.isEmpty():
        unknown = named
    else:
        unknown = heard.unionByName(stored.filter(F.col("ref_lang") == ANY))
    together = unknown.agg(F.collect_list(own).alias("refs")).filter(F.size("refs") > 0).select(F.lit(ANY).alias("ref_lang"), "refs")
    return named.select("ref_lang", F.array(own).alias("refs")).unionByName(together)


def judge(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """``docs`` with a struct ``quality``: the counts, char_distance, word_distance, base_failed, kept.

    A distance is null where a minimum length guards it.
    """
    own = [c for c in docs.columns if c != "quality"]
    stored = materialize(references(docs, text, lang))
    refs = _candidates(stored)
    refs = F.broadcast(refs) if stored.count() <= LANGUAGES_SENT else refs
    key = F.coalesce(F.concat(F.lit("="), F.col(lang)), F.lit(ANY))
    # the struct keeps names of the caller apart from the ones used here
    packed = measures(docs, text, {"d": F.struct(*(F.col(f"`{c}`") for c in own)), "ref_lang": key}).join(refs, "ref_lang")
    m = F.col("m")

    def distances(r: Column) -> Column:
        by_char = F.when(m.classes[5] >= MIN_CHARS, js_distance(_class_shares(m.classes), _class_shares(r["ref_classes"])))
        by_word = F.when((m.n_words >= MIN_WORDS) & (r["ref_total"] >= MIN_REFERENCE_WORDS),
                         js_distance(_with_rest(_word_shares(r["ref_words"], m.joined, m.n_words)), _with_rest(r["ref_shares"])))
        return F.struct(by_char.alias("char_distance"), by_word.alias("word_distance"))

    def ranked(d: Column) -> Column:
        far = F.greatest(F.coalesce(d["char_distance"], F.lit(0.0)) / MAX_CHAR_DISTANCE, F.coalesce(d["word_distance"], F.lit(0.0)) / MAX_WORD_DISTANCE)
        return F.struct(far.alias("far"), d["char_distance"].alias("char_distance"), d["word_distance"].alias("word_distance"))

    nearest = F.array_min(F.transform(F.transform("refs", distances), ranked))
    scored = packed.select("d", F.inline(F.array(F.struct(m.alias("m"), nearest.alias("nearest"))))).select("d", "m", "nearest.char_distance", "nearest.word_distance")
    failed = (m.n_words < 20) | (100 * m.n_repeat_words > 30 * m.n_words)
    near = (F.coalesce(F.col("char_distance"), F.lit(0.0)) <= MAX_CHAR_DISTANCE) & (F.coalesce(F.col("word_distance"), F.lit(0.0)) <= MAX_WORD_DISTANCE)
    counts = [m[c].alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    return scored.select(*(F.col("d")[c].alias(c) for c in own), F.struct(*counts, "char_distance", "word_distance", failed.alias("base_failed"), (~failed & near).alias("kept")).alias("quality"))
