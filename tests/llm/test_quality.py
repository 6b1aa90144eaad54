import math
import re
from collections import Counter

from pyspark.sql import functions as F

from sessionledger.llm import quality


def counts(text):
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = Counter(tuple(w[i:i + 8]) for i in range(len(w) - 7))
    inside = {i + j for i in range(len(w) - 7) if windows[tuple(w[i:i + 8])] > 1 for j in range(8)}
    n, repeated = len(w), len(inside)
    return n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), repeated, n < 20 or 100 * repeated > 30 * n


def test_counts(docs, small, empty):
    for df in (docs, small):
        rows = quality.judge(df).collect()
        assert len(rows) == df.count()
        for r in rows:
            q = r.quality
            assert (q.n_words, q.word_chars, q.n_symbols, q.n_dup_lines, q.n_repeat_words, q.base_failed) == counts(r.text)
            assert not (q.base_failed and q.kept)
    assert quality.judge(empty).count() == 0


def test_clean_stays_and_junk_goes(spark):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet").groupBy("doc_id").agg(F.max("quality").alias("good"))
    judged = quality.judge(spark.read.parquet(f"{sf}/documents.parquet")).join(labels, "doc_id")
    kept = {r.good: r.k for r in judged.groupBy("good").agg(F.avg(F.col("quality.kept").cast("int")).alias("k")).collect()}
    assert kept[1] > 0.9 and kept[0] < 0.15


def test_references_and_distance(spark):
    rows = [(1, "aa bb aa cc", "x"), (2, "aa dd", "x"), (3, "Zz!", None), (4, None, "x")]
    refs = {r.ref_lang: r for r in quality.references(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert refs["=x"].ref_words == ["aa", "bb", "cc", "dd"] and refs["=x"].ref_shares == [3 / 6, 1 / 6, 1 / 6, 1 / 6]
    assert refs["*"].ref_total == 7 and refs["*"].ref_classes[5] == 11 + 5 + 3
    p, q = [0.5, 0.5, 0.0], [0.25, 0.0, 0.75]
    m = [(a + b) / 2 for a, b in zip(p, q)]
    wanted = math.sqrt(sum(a * math.log2(a / c) for a, c in zip(p, m) if a) / 2 + sum(b * math.log2(b / c) for b, c in zip(q, m) if b) / 2)
    got = spark.createDataFrame([(p, q)], "p array<double>, q array<double>").select(quality.js_distance(F.col("p"), F.col("q"))).first()[0]
    assert abs(got - wanted) < 1e-12


def test_clean_texts_of_unknown_language_stay(spark):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet").groupBy("doc_id").agg(F.max("quality").alias("good"))
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang")
    # one language dominates: three in four rows of the others are left out
    docs = docs.filter((F.col("lang") == "en") | (F.col("doc_id") % 4 == 0))
    extra = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", F.col("lang").alias("was")).join(labels, "doc_id").filter("doc_id % 4 = 1")
    known = docs.join(extra.select("doc_id"), "doc_id", "left_anti")
    both = known.unionByName(docs.limit(0)).selectExpr("doc_id", "text", "lang", "lang as was", "-1 as good").unionByName(extra.selectExpr("doc_id", "text", "cast(null as string) lang", "was", "good"))
    rows = quality.judge(both).filter("good >= 0").select("was", "good", "quality.kept", "quality.base_failed").collect()
    for was in {r.was for r in rows}:
        clean = [r.kept for r in rows if r.was == was and r.good == 1 and not r.base_failed]
        assert clean and sum(clean) / len(clean) > 0.9, (was, sum(clean), len(clean))
    junk = [r.kept for r in rows if r.good == 0]
    assert junk and sum(junk) / len(junk) < 0.15
