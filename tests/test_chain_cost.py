"""What a long chain of windows costs: its operators, and code that the JVM still compiles."""

import pytest
from pyspark.sql import functions as F

from sessionledger.operators import allocate as a
from sessionledger.operators.grouping import BlockedGroups, PlainGroups, Total
from sessionledger.plans import allocation_queries as aq
from sessionledger.plans import load_all

SF = "/root/testdata/sf0.001"
JIT_LIMIT = 8_000  # bytes of a method beyond which HotSpot runs it in its interpreter for good
c = F.col


@pytest.fixture
def static_plans(spark):
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    yield spark
    spark.conf.set("spark.sql.adaptive.enabled", before)


@pytest.mark.parametrize("name", ["priced_calls", "round_parts"])
def test_generated_code_is_small_enough_to_be_compiled(static_plans, name):
    plan = load_all()[name].plan(static_plans, SF)._jdf.queryExecution().executedPlan()
    debug = getattr(getattr(static_plans._jvm.org.apache.spark.sql.execution.debug, "package$"), "MODULE$")
    stages = debug.codegenStringSeq(plan)
    assert max(stages.apply(i)._3().maxMethodCodeSize() for i in range(stages.size())) <= JIT_LIMIT


def test_totals_share_windows(static_plans):
    plan = aq.reconstructed(static_plans, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Window [") <= 21  # 20 of the chain, one that numbers the calls


@pytest.mark.parametrize("engine", [PlainGroups(["g"], "o"), BlockedGroups(["g"], "o", 7)])
def test_splits_in_one_step_equal_single_ones(spark, engine):
    df = spark.range(200).select((c("id") % 9).alias("g"), c("id").alias("o"), (c("id") * 37 % 11).alias("v"), (c("id") * 53 % 17).alias("w"))
    both = a.split_each(df, engine, {"x": (c("v"), F.lit(1003), None), "y": (c("w"), c("s") * 3, c("o") % 2 == 0)}, {"s": Total("sum", c("v"))})
    one = a.split_exact(df, engine, "x", c("v"), F.lit(1003))
    one = a.split_exact(engine.totals(one, {"s": Total("sum", c("v"))}), engine, "y", c("w"), c("s") * 3, c("o") % 2 == 0)
    assert sorted(both.select("g", "o", "x", "y", "s").collect()) == sorted(one.select("g", "o", "x", "y", "s").collect())


def test_round_io_reconstructs_once(static_plans):
    plan = load_all()["round_io"].plan(static_plans, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Window [") <= 21  # twice as many with the chain of the system card beside it
