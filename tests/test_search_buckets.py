"""Searches over a table of arcs in buckets: no step shuffles the arcs."""

from pyspark.sql import functions as F

from cloudgrid.functions.lineage import drop, settle_by
from cloudgrid.operators import graphs


def test_steps_of_a_search_leave_arcs_where_they_are(spark, monkeypatch):
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    plans, settle = [], graphs.settle
    monkeypatch.setattr(graphs, "settle", lambda df: (plans.append(df._jdf.queryExecution().executedPlan().toString()), settle(df))[1])
    try:
        # a path of 5 nodes, and a branch
        e = spark.createDataFrame([(k, k + 1) for k in range(4)] + [(1, 9)], "u long, v long")
        assert {(r.node, r.hop) for r in graphs.hops(e, 0).collect()} == {(0, 0), (1, 1), (2, 2), (3, 3), (4, 4), (9, 2)}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    steps = [p for p in plans if "SortMergeJoin" in p and "hop" in p]
    assert len(steps) >= 5 and all("Bucketed: true" in p and "hashpartitioning(u#" not in p for p in steps)


def test_a_table_in_buckets_goes(spark):
    t = settle_by(spark.range(10).withColumn("k", F.col("id") % 3), "k")
    assert t.count() == 10
    drop(t)
    assert not spark.catalog.tableExists(t._settled_as)
