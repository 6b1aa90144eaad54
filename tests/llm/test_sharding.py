from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from sessionledger.llm import sharding


def check(rows, n_shards, n):
    sizes = Counter(r.shard for r in rows)
    assert len(rows) == n and max(sizes.values()) - min(sizes.values() if len(sizes) == n_shards else [0]) <= 1
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


@pytest.mark.parametrize("block", [7, 20_000])
def test_even_and_mixed(spark, monkeypatch, block):
    monkeypatch.setattr("sessionledger.llm.common.BLOCK_ROWS", block)
    df = spark.range(1000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") < 50, F.concat(F.lit("rare"), "id")).when(F.col("id") % 7 == 0, None).otherwise("other").alias("source"))
    rows = sharding.interleave(df, 16).collect()
    check(rows, 16, 1000)
    for s in ("hot", "other", None):
        per = Counter(r.shard for r in rows if r.source == s)
        assert max(per.values()) - min(per.values()) <= 4  # 33 sources of one row push the cuts
    assert [tuple(r) for r in sharding.interleave(df, 16).orderBy("doc_id").collect()] == sorted(map(tuple, rows))


def test_awkward_rows(spark, docs, empty, tmp_path):
    rows = sharding.interleave(docs, 4).collect()
    check(rows, 4, docs.count())
    assert Counter(r.doc_id for r in rows) == Counter(r.doc_id for r in docs.collect())
    assert sharding.interleave(empty, 4).count() == 0
    few = sharding.interleave(docs.filter("doc_id in (7, 8)"), 4)
    check(few.collect(), 4, 2)
    sharding.write_shards(docs.filter("doc_id in (7, 8)").select("doc_id", "text"), few, str(tmp_path / "shards"))
    assert spark.read.parquet(str(tmp_path / "shards")).count() == 2
