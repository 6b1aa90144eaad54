"""Long chains of windows run in tasks of bounded rows, however large the table is."""

from pyspark.sql import functions as F

from sessionledger.operators import grouping as gr
from sessionledger.operators import reconstruct as r
from sessionledger.plans import allocation_queries as aq
from sessionledger.plans import binding as b

SF = "/root/testdata/sf0.001"


def task_rows(df):
    return df.select(F.spark_partition_id().alias("p")).groupBy("p").count().agg(F.max("count")).first()[0]


def test_calls_are_dealt_by_their_number(spark, monkeypatch):
    monkeypatch.setattr(gr, "TASK_ROWS", 500)
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    try:
        calls = gr.skew_safe(aq.recon_calls(spark, SF), ["round_id"], "call_no", r.round_facts)
        assert task_rows(calls) < 1_000  # of 6,000
        assert calls.count() == b.table(spark, SF, "lineitem").count()
        plan = calls._jdf.queryExecution().executedPlan().toString()
        assert plan.count("hashpartitioning(l_orderkey") == 1  # windows and join use the one shuffle of the lines
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_skew_safe_deals_by_rows(spark, monkeypatch):
    monkeypatch.setattr(gr, "TASK_ROWS", 100)
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    try:
        d = spark.range(2_000).select((F.col("id") % 400).alias("k"), F.col("id").alias("o"))
        body = lambda x, g: g.running(x, {"s": gr.Run("sum", F.col("o"), "upto")})
        dealt = gr.skew_safe(d, ["k"], "o", body, deal=True)
        assert task_rows(dealt) < 300
        assert sorted(dealt.collect()) == sorted(gr.skew_safe(d, ["k"], "o", body, mode="plain").collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
