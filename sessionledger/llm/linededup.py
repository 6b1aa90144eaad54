"""Dedup of line passages.

A text is cut into chunks of whole lines. Line hashes are hashed over a window of two lines that rolls down
the text; a chunk ends below a line whose window hash falls in one of ``MEAN`` residues, unless the line
above ends one. A boundary hence depends on the three lines around it alone: lines put in front of a passage do
not move the cuts inside it.

``drop_passages`` takes chunks of three lines or more as seeds. The lines around a repeated chunk are looked at two by
two, wherever the cuts fall: every two neighbouring lines are seeds beside them. A line of more than ``LONG_LINE_WORDS``
words, a paragraph, is a seed of its own; this goes beyond the method of multi-line chunks and reaches documents of one
line. A seed with a word that stands in the corpus more than once is a repeat everywhere but at its first place, by
document id, then place. Repeats that touch or overlap in a text make a run, from the first line of a passage to its
last. A run goes when a chunk is part of it and it has ``CHUNK_WORDS`` words or more; a run that no chunk reaches, as
passages of two or three lines are, goes from ``RUN_WORDS`` words on. So closing braces and other lines that say next to
nothing stay where they are. A run may have been put together from several earlier places. A line's first place in the corpus is
never inside a repeat, so every line of the corpus stays once. Lines without a word between two runs may stay.

``drop_repeats`` removes whole chunks of two lines or more alone. Single lines up to that length are never removed.

Repeats are found by two 64-bit hashes. Then the bytes decide: repeated pieces are grouped by their text as
well, and a hash pair that stands for two different texts is left alone.

Nulls: a null text stays null; rows with a null id come last in the order. Rows equal in id and text count
as one document and keep the same lines. Passages are as long as the texts make them; nothing is cut short.
Columns named ``n_removed`` and, for
passages, ``n_by_chunks`` are replaced, others pass through untouched. An empty table gives an empty result.

The lists of repeated hashes and of what to remove are broadcast when they are counted and short; beyond
that the same joins shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionledger.llm.common import let
from sessionledger.session import materialize

MEAN = 2
LONG_LINE_WORDS = 50  # a line of more words is a passage of its own
CHUNK_WORDS, RUN_WORDS = 5, 10  # fewest words of a run that goes, with a chunk in it and without
#: Thai, Lao, Burmese, Khmer, kana and Han are written without blanks: each of their characters counts as a word.
UNSPACED = r"\x{E00}-\x{EFF}\x{1000}-\x{109F}\x{1780}-\x{17FF}\x{3040}-\x{30FF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}\x{20000}-\x{3FFFF}"
LONG_LINE = rf"^\s*+(?:\S++\s++){{{LONG_LINE_WORDS}}}\S"
LONG_UNSPACED = rf"^\s*+(?:(?:[{UNSPACED}]|[^\s{UNSPACED}]++)\s*+){{{LONG_LINE_WORDS + 1}}}"
WORD = rf"[{UNSPACED}]|[^\s{UNSPACED}]+"
SENT_ROWS = 400_000  # of a join's small side that may be broadcast


def _ends(lines: Column) -> Column:
    """Last lines of the chunks, from 0."""
    hashes = F.transform(lines, lambda x: F.xxhash64(x))

    def cut(h: Column) -> Column:
        def hit(i: Column) -> Column:
            return F.coalesce(F.pmod(F.xxhash64(F.get(h, i - 1), F.get(h, i)), F.lit(MEAN)) == 0, F.lit(False))

        marks = F.transform(h, lambda x, i: (i > 0) & hit(i))
        return let(marks, lambda m: F.filter(F.sequence(F.lit(0), F.size(m) - 1), lambda i: (i == F.size(m) - 1) | (F.get(m, i) & ~F.coalesce(F.get(m, i - 1), F.lit(False)))))

    return let(hashes, cut)


def _chunks(lines: Column) -> Column:
    """Of all chunks in order: ``at`` (first line), ``size`` in lines, ``piece`` (text)."""

    def spans(e: Column) -> Column:
        def span(x: Column, i: Column) -> Column:
            start = F.coalesce(F.get(e, i - 1), F.lit(-1)) + 1
            return F.struct(start.alias("at"), (x - start + 1).alias("size"), F.array_join(F.slice(lines, start + 1, x - start + 1), "\n").alias("piece"))

        return F.transform(e, span)

    return let(_ends(lines), spans)


def chunks_of(text: Column) -> Column:
    """The texts of all chunks in order; joined with line feeds they give the text again."""
    return let(F.split(text, "\n"), lambda lines: F.transform(_chunks(lines), lambda c: c["piece"]))


def _seeds(lines: Column) -> Column:
    """What is looked up in the corpus, as ``_chunks``: chunks of three lines or more, every two lines that follow each other, and every long line."""
    chunks = F.filter(_chunks(lines), lambda c: c["size"] > 2)
    pairs = F.transform(F.slice(lines, 1, F.size(lines) - 1), lambda x, i: F.struct(i.alias("at"), F.lit(2).alias("size"), F.concat(x, F.lit("\n"), F.get(lines, i + 1)).alias("piece")))
    alone = F.transform(lines, lambda x, i: F.struct(i.alias("at"), F.lit(1).alias("size"), x.alias("piece")))

    def long(x: Column) -> Column:
        # 51 words have at least 101 bytes, and most lines need the plain pattern alone
        return (F.octet_length(x) > 2 * LONG_LINE_WORDS) & (x.rlike(LONG_LINE) | (x.rlike(r"[\x{E00}-\x{3FFFF}]") & x.rlike(LONG_UNSPACED)))

    return F.concat(chunks, pairs, F.filter(alone, lambda c: long(c["piece"])))


def _keys(text: str, key: str) -> list[Column]:
    return [F.xxhash64(F.lit(1), F.col(key), F.col(text)).alias("k1"), F.xxhash64(F.lit(2), F.col(key), F.col(text)).alias("k2")]


def _prepared(docs: DataFrame, text: str, key: str) -> DataFrame:
    return docs.select(
        F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("d"),
        *_keys(text, key),
        F.inline(F.array(F.struct(chunks_of(F.col(text)).alias("parts")))))


def _sent(small: DataFrame) -> DataFrame:
    return F.broadcast(small) if small.count() <= SENT_ROWS else small


def _later(pieces: DataFrame) -> DataFrame:
    """``k1, k2, at``: of pieces ``id, k1, k2, at, piece`` with a word the places whose text stands at an earlier one too."""
    hashed = pieces.filter(r"piece rlike '\\S'").withColumns({"h1": F.xxhash64(F.lit(3), "piece"), "h2": F.xxhash64(F.lit(4), "piece")})
    places = materialize(hashed.drop("piece"))
    order = F.struct(F.col("id").isNull().alias("last"), "id", "k1", "k2", "at")
    # per task one row for each hash, so a piece in a third of all documents is no heavy key
    twice = materialize(places.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min(order).alias("first")).filter("n > 1").select("h1", "h2", "first"))
    same = hashed.select("h1", "h2", "piece").join(_sent(twice.select("h1", "h2")), ["h1", "h2"], "left_semi")
    texts = same.groupBy("h1", "h2", "piece").agg(F.count("*").alias("n")).groupBy("h1", "h2").agg(F.count("*").alias("texts"))
    sure = materialize(twice.join(texts.filter("texts = 1").select("h1", "h2"), ["h1", "h2"]))
    return places.join(_sent(sure), ["h1", "h2"]).filter(~order.eqNullSafe(F.col("first"))).select("k1", "k2", "at")


def repeats(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``k1, k2, removed``: per document (by the hashes of its id and text) the numbers of the chunks to remove."""
    chunk = _prepared(docs, text, key).select(F.col("d")[key].alias("id"), "k1", "k2", F.posexplode("parts").alias("at", "piece")).filter(r"instr(piece, '\n') > 0")
    return _later(chunk).groupBy("k1", "k2").agg(F.collect_set("at").alias("removed"))


def repeated_spans(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``k1, k2, removed``: per document the spans ``at, size`` of lines that stand at an earlier place too; spans overlap."""
    lines = docs.select(F.col(key).alias("id"), *_keys(text, key), F.inline(F.array(F.struct(F.split(F.col(text), "\n").alias("lines")))))
    seeds = lines.select("id", "k1", "k2", F.inline(_seeds(F.col("lines")))).select("id", "k1", "k2", F.struct("at", "size").alias("at"), "piece")
    return _later(seeds).groupBy("k1", "k2").agg(F.collect_set("at").alias("removed"))


def drop_repeats(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``docs`` with repeated chunks taken out of ``text``, and the count of them as ``n_removed``."""
    marks = materialize(repeats(docs, text, key))
    rows = _prepared(docs, text, key).join(_sent(marks), ["k1", "k2"], "left")

    def without(parts: Column, removed: Column) -> Column:
        kept = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), removed)
        return F.array_join(F.transform(kept, lambda i: F.get(parts, i)), "\n")

    left = F.when(F.col("removed").isNull(), F.col("d")[text]).otherwise(without(F.col("parts"), F.col("removed")))
    cols = [left.alias(c) if c == text else F.col("d")[c].alias(c) for c in docs.columns if c != "n_removed"]
    return rows.select(*cols, F.when(F.col("removed").isNull(), 0).otherwise(F.size("removed")).alias("n_removed"))


def _runs(lines: Column, removed: Column) -> Column:
    """Of the runs of lines that go: ``at`` (first line), ``size`` in lines, ``chunk`` (whether one is part of it)."""

    def runs(gone: Column) -> Column:
        first = F.filter(gone, lambda x, i: F.coalesce(F.get(gone, i - 1) < x - 1, F.lit(True)))
        last = F.filter(gone, lambda x, i: F.coalesce(F.get(gone, i + 1) > x + 1, F.lit(True)))
        return F.zip_with(first, last, lambda f, e: F.struct(f.alias("at"), (e - f + 1).alias("size")))

    def marked(chunks: Column) -> Column:
        # a chunk lies in the run of its first line, so the runs that chunks start in are found by their lines
        return F.transform(
            let(F.array_sort(F.array_distinct(F.flatten(F.transform(removed, lambda s: F.sequence(s["at"], s["at"] + s["size"] - 1))))), runs),
            lambda r: F.struct(r["at"].alias("at"), r["size"].alias("size"), F.arrays_overlap(F.sequence(r["at"], r["at"] + r["size"] - 1), chunks).alias("chunk")))

    def enough(r: Column) -> Column:
        words = F.regexp_count(F.array_join(F.slice(lines, r["at"] + 1, r["size"]), "\n"), F.lit(WORD))
        return words >= F.when(r["chunk"], CHUNK_WORDS).otherwise(RUN_WORDS)

    return F.filter(let(F.transform(F.filter(removed, lambda s: s["size"] > 2), lambda s: s["at"]), marked), enough)


def drop_passages(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``docs`` with repeated passages taken out of ``text``; ``n_removed`` counts their lines, ``n_by_chunks`` those of runs with a chunk."""
    marks = materialize(repeated_spans(docs, text, key))
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("d"), *_keys(text, key)).join(_sent(marks), ["k1", "k2"], "left")
    found = let(F.split(F.col("d")[text], "\n"), lambda lines: _runs(lines, F.col("removed")))
    # the generator keeps the list from being copied
    rows = rows.select("d", F.inline(F.array(F.struct(F.when(F.col("removed").isNotNull(), found).alias("runs")))))
    hit = F.coalesce(F.size("runs") > 0, F.lit(False))
    gone = F.flatten(F.transform("runs", lambda r: F.sequence(r["at"], r["at"] + r["size"] - 1)))

    def without(lines: Column) -> Column:
        kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), gone)
        return F.array_join(F.transform(kept, lambda i: F.get(lines, i)), "\n")

    whole = F.col("d")[text]
    left = F.when(hit, let(F.split(whole, "\n"), without)).otherwise(whole)

    def count(runs: Column) -> Column:
        return F.when(hit, F.aggregate(runs, F.lit(0), lambda n, r: n + r["size"])).otherwise(0)

    cols = [left.alias(c) if c == text else F.col("d")[c].alias(c) for c in docs.columns if c not in ("n_removed", "n_by_chunks")]
    return rows.select(*cols, count(F.col("runs")).alias("n_removed"), count(F.filter("runs", lambda r: r["chunk"])).alias("n_by_chunks"))
