import pytest
from compare import check, duck
from pyspark.sql import functions as F

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op3_exact_top_k_search", "op4_sharding", "op5_chat_formatting", "op6_ngram_jaccard_join"])
def test_twin(spark, name):
    from __spark_entry__ import catalogue

    con = duck(SMALL)
    assert check(spark, con, SMALL, catalogue()[name])[1] == "ok"


def test_every_operator_is_registered():
    import __spark_entry__ as e

    names = e.queries()
    assert all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11)) and "pipeline" in names


def test_stages(spark):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    extra = spark.createDataFrame([(None, None, None, None, None), (10**6, "", "en", "x", 0), (10**6 + 1, "123 456", None, None, 7)], docs.schema)
    now = docs.unionByName(extra)
    ids = {}
    for name, stage in p.STAGES:
        out = stage(spark, now, SMALL).cache()
        ids[name] = out.count()
        if name != p.STAGES[-1][0]:
            assert tuple(out.columns) == p.COLUMNS and out.dtypes == docs.dtypes
            if name != "line_dedup":  # filters take rows out and leave the rest as it was
                assert out.exceptAll(now).count() == 0
            else:
                assert ids[name] == now.count() and out.filter(F.col("n_chars") != F.length("text")).count() == 0
        now = out
    assert now.select("doc_id").distinct().count() == ids["ngram_jaccard_join"]
    assert ids["language_id"] == docs.count() and ids["quality_rules"] < ids["language_id"]


def test_run_is_its_stages(spark):
    import corpus_pipeline as p

    out = p.run(spark, SMALL)
    assert out.columns[:4] == ["doc_id", "piece", "start", "length"] and out.count() > 100
