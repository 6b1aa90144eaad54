"""Bills of session trees of any depth."""

from pyspark.sql import functions as F

from sessionledger.operators import sessions as o


def test_deep_trees_and_cycles(spark):
    chain = [(i, i - 1) for i in range(1, 41)]
    star = [(100 + i, 20) for i in range(5)]
    cycle = [(200, 201), (201, 202), (202, 200), (203, 200)]
    df = spark.createDataFrame([*chain, *star, *cycle, (300, None), (301, 301)], "session_id long, parent_id long")
    up = {}
    for a, p in [*chain, *star, *cycle]:
        up.setdefault(a, p)
    want = {}
    for node in up:
        at, depth = up[node], 1
        while at is not None and at != node and (node, at) not in want:
            want[node, at] = depth
            at, depth = up.get(at), depth + 1
    assert {(r.session_id, r.ancestor_id): r.depth for r in o.ancestors(df).collect()} == want
    assert want[40, 0] == 40 and want[203, 202] == 3


def test_tree_bills(spark):
    edges = spark.createDataFrame([(2, 1), (3, 2), (4, 2), (9, 8)], "session_id long, parent_id long")
    bills = spark.createDataFrame([(i, float(i)) for i in (1, 2, 3, 4, 5)], "session_id long, usd double")
    got = {r.session_id: (r.descendants, r.levels, r.usd, r.children_usd, r.combined_usd) for r in o.tree_bills(edges, bills, ["usd"]).collect()}
    assert got == {1: (3, 2, 1.0, 9.0, 10.0), 2: (2, 1, 2.0, 7.0, 9.0), 3: (0, 0, 3.0, 0.0, 3.0), 4: (0, 0, 4.0, 0.0, 4.0), 5: (0, 0, 5.0, 0.0, 5.0)}
    assert o.tree_bills(edges.limit(0), bills.limit(0), ["usd"]).count() == 0
    assert o.ancestors(edges.withColumn("extra", F.lit(1))).count() == 6
