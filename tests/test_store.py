"""Points in the order of a curve: what a rectangle reads, and that it loses none."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cloudgrid.functions import scalar
from cloudgrid.functions.lineage import fresh
from cloudgrid.operators import graphs, points
from cloudgrid.sources import store


def read(df) -> int:
    """Rows that the scan of a collected frame handed on."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    plan = plan.finalPhysicalPlan() if plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec" else plan
    leaves, total = plan.collectLeaves(), 0
    for k in range(leaves.size()):
        total += leaves.apply(k).metrics().apply("numOutputRows").value()
    return total


def test_ranges_cover_the_rectangle_and_little_else():
    r = np.random.default_rng(1)
    key = lambda x, y: sum((x >> k & 1) << 2 * k | (y >> k & 1) << 2 * k + 1 for k in range(6))
    for _ in range(60):
        x0, x1 = sorted(r.integers(0, 64, 2).tolist())
        y0, y1 = sorted(r.integers(0, 64, 2).tolist())
        inside = {key(x, y) for x in range(x0, x1 + 1) for y in range(y0, y1 + 1)}
        for most in (1, 4, 64):
            spans = store.curve_ranges(x0, y0, x1, y1, 6, most)
            assert len(spans) <= most and all(a <= b for a, b in spans) and all(p[1] + 1 < q[0] for p, q in zip(spans, spans[1:], strict=False))
            held = {m for a, b in spans for m in range(a, b + 1)}
            assert inside <= held
        assert len(held) <= 2 * len(inside) + 64


def test_two_axes_interleave(spark):
    p = spark.range(500).selectExpr("id * 7919 % 2147483648 x", "id * 104729 * 31 % 2147483648 y").select("x", "y", scalar.interleaved("x", "y").alias("m"))
    for r in p.collect():
        assert r.m == sum((r.x >> k & 1) << 2 * k | (r.y >> k & 1) << 2 * k + 1 for k in range(31))


def test_a_rectangle_reads_less_than_twice_its_points(spark):
    n = 200_000
    p = spark.range(n).select((F.pmod(F.xxhash64("id"), F.lit(1 << 20)) / float(1 << 20)).alias("x"), (F.pmod(F.xxhash64("id", F.lit(1)), F.lit(1 << 20)) / float(1 << 20)).alias("y"), "id")
    at = fresh(spark, "store")
    store.write(p, at, rows=20_000, page=200)
    for box in ((0.25, 0.125, 0.5, 0.75), (0.6, 0.6, 0.8, 0.7), (0.0, 0.0, 1.0, 0.11)):
        got, want = store.area(spark, at, *box), points.area(p, *box).count()
        assert got.count() == want and got.columns == ["x", "y", "id"]
        assert want <= read(got) < 2 * want
    assert store.area(spark, at, 0.3, 0.3, 0.3, 0.3).count() == points.area(p, 0.3, 0.3, 0.3, 0.3).count()
    assert store.area(spark, at, 5, 5, 6, 6).count() == store.area(spark, at, 0.5, 0.5, 0.4, 0.6).count() == 0
    ranges = spark.read.parquet(f"{at}/ranges").collect()
    assert len(ranges) == 10 and sum(r.n for r in ranges) == n


def test_many_small_files_are_written_by_few_tasks(spark):
    """What comes to the driver is a task's, so tasks don't grow with the number of small files; the files are as small, and lose nothing."""
    n = 60_000
    p = spark.range(n).selectExpr("id * 7919 % 4096 / 4096 x", "id * 104729 % 4093 / 4093 y", "id")
    at = fresh(spark, "store")
    before = spark.sparkContext._jsc.sc().dagScheduler().nextStageId()
    store.write(p, at, rows=100, page=50)
    ranges = spark.read.parquet(f"{at}/ranges").collect()
    assert 600 <= len(ranges) < 900 and max(r.n for r in ranges) <= 100 and sum(r.n for r in ranges) == n
    tracker = spark.sparkContext.statusTracker()
    tasks = [i.numTasks for k in range(before, spark.sparkContext._jsc.sc().dagScheduler().nextStageId()) if (i := tracker.getStageInfo(k))]
    assert tasks and max(tasks) <= store.TASKS
    spans = sorted((r.low, r.high) for r in ranges)
    assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:], strict=False))
    assert store.area(spark, at, 0.25, 0.125, 0.5, 0.75).count() == points.area(p, 0.25, 0.125, 0.5, 0.75).count()


def test_one_place_holding_a_third_is_many_files(spark):
    p = spark.range(9000).selectExpr("case when id % 3 = 0 then 0.5 else id / 9000 end x", "case when id % 3 = 0 then 0.5 else id * 7 % 9000 / 9000 end y", "id")
    at = fresh(spark, "store")
    store.write(p, at, rows=500, page=100)
    ranges = spark.read.parquet(f"{at}/ranges").collect()
    assert max(r.n for r in ranges) < 1500 and sum(r.n for r in ranges) == 9000
    assert store.area(spark, at, 0.5, 0.5, 0.5, 0.5).count() == p.where("x = 0.5 and y = 0.5").count() >= 3000


@pytest.mark.parametrize("rows", [[], [(None, 0.5, 1)], [(0.5, 0.5, 1), (None, None, 2), (float("nan"), 0.1, 3)]])
def test_no_points_and_points_without_a_place(spark, rows):
    at = fresh(spark, "store")
    store.write(spark.createDataFrame(rows, "x double, y double, id int"), at)
    got = store.area(spark, at, 0.0, 0.0, 1.0, 1.0)
    assert got.columns == ["x", "y", "id"] and [r.id for r in got.collect()] == [r[2] for r in rows if r[0] == 0.5]


def test_strides_count_within_files_over_tasks(spark):
    p = spark.range(1000).selectExpr("case when id % 3 = 0 then 'a' when id % 3 = 1 then 'b' end f", "id")
    got = {(r.f, r.id) for r in points.stride_sample(p, 8, "f", ["id"]).collect()}
    want = {(f, i) for k, f in enumerate(("a", "b", None)) for i in range(k, 1000, 24)}
    assert got == want


def test_first_edges(spark):
    e = spark.createDataFrame([(1, 2, 5, "b"), (1, 2, 5, "a"), (1, 2, 7, "c"), (2, 1, 1, "z")], "u int, v int, c int, p string")
    assert sorted(tuple(r) for r in graphs.distinct_edges(e, "c", "p").collect()) == [(1, 2, 5, "a"), (2, 1, 1, "z")]
