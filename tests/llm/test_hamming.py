import random

import pytest
from pyspark.sql import functions as F

from sessionledger.llm import hamming


def brute(rows, k):
    code = {}
    for i, v in rows:
        if i is not None and v is not None:
            code.setdefault(i, set()).add(tuple((x or 0) > 0 for x in v))
    width = max((len(c) for cs in code.values() for c in cs), default=0)
    pad = {i: {c + (False,) * (width - len(c)) for c in cs} for i, cs in code.items()}
    out = {}
    for q in pad:
        if q % 5 == 0:
            near = {(sum(a != b for a, b in zip(x, y)), i) for x in pad[q] for i in pad if i != q for y in pad[i]}
            out[q] = sorted(near)[:k]
    return out


@pytest.mark.parametrize("dims,k", [(16, 3), (40, 10), (64, 7)])
def test_exact(spark, monkeypatch, dims, k):
    monkeypatch.setattr(hamming, "BLOCK_ROWS", 60)
    monkeypatch.setattr(hamming, "BLOCK_QUERIES", 7)
    r = random.Random(dims)
    one = [r.gauss(0, 1) for _ in range(dims)]
    rows = [(i, one if i % 3 == 0 else [r.gauss(0, 1) for _ in range(dims)]) for i in range(240)]
    rows += [(5, rows[5][1]), (None, one), (1000, None), (1001, [1.0, None]), (1005, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("rank", F.lit(1))
    got = {}
    for x in hamming.top_k(df, F.col("vec_id") % 5 == 0, k).orderBy("query_id", "rank").collect():
        got.setdefault(x.query_id, []).append((x.distance, x.neighbor_id))
    assert got == brute(rows, k)


def test_few_rows(spark):
    df = spark.createDataFrame([(0, [1.0]), (5, [-1.0])], "vec_id long, embedding array<double>")
    assert [(r.query_id, r.neighbor_id, r.distance) for r in hamming.top_k(df, F.col("vec_id") == 0, 4).collect()] == [(0, 5, 1)]
    assert hamming.top_k(df.limit(0), F.col("vec_id") == 0, 4).count() == 0
