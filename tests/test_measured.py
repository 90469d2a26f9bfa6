"""What goes through the driver, and how many rounds a wind takes."""

import pytest
from pyspark.sql import functions as F

from cartoweave.operators import graph as N
from cartoweave.plans.fixpoint import dealt, stems
from cartoweave.queries import QUERIES
from cartoweave.session import MEASURED, broadcast_by_measure


def test_no_side_is_broadcast_by_estimate(spark, sf):
    plan = QUERIES["mean_within_radius"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
    assert int(spark.conf.get("spark.sql.adaptive.autoBroadcastJoinThreshold")) <= MEASURED


def test_a_lower_threshold_stays(spark):
    other = spark.newSession()
    other.conf.set("spark.sql.autoBroadcastJoinThreshold", "256k")
    broadcast_by_measure(other)
    broadcast_by_measure(other)
    assert other.conf.get("spark.sql.adaptive.autoBroadcastJoinThreshold") == str(256 << 10)
    assert other.conf.get("spark.sql.autoBroadcastJoinThreshold") == "-1"


def test_frozen_segments_take_no_rounds(spark):
    """Air that changes at a peak goes over sixty frozen segments, and falls on the land behind them."""
    heights = [(10, 9), (90, 9), (30, 9), *[(30, -9)] * 120, (30, 9), (25, 9), (10, 9), (30, 9)]
    rows = [("a", i, i, h, t, 100.0) for i, (h, t) in enumerate(heights)]
    lines = spark.createDataFrame(rows, "line string, place long, cell_id long, height long, temperature long, strength double")
    whole = sorted(map(tuple, N.wind(lines).collect()))
    spark.sparkContext.setJobGroup("wind", "")
    found = N.wind(lines, segment=2)
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("wind"))
    spark.sparkContext._jsc.clearJobGroup()
    assert sorted(map(tuple, found.collect())) == whole
    assert jobs < 100


def test_an_expansion_shuffles_its_steps_alone(spark):
    """Two owners along a chain of 14 cells, each with costs of its own: a round is a job and a look at what came of it, and what is known stays where it is."""
    n = 14
    cells = spark.createDataFrame([(i, float(i % 3)) for i in range(n)], "cell_id long, toll double")
    edges = spark.createDataFrame([(a, b) for i in range(n - 1) for a, b in ((i, i + 1), (i + 1, i))], "src long, dst long")
    seeds = spark.createDataFrame([(0, 1, 1.0), (n - 1, 2, 2.0)], "cell_id long, owner long, pace double")
    want, left, right = {}, [0.0], [0.0]
    for i in range(1, n - 1):
        left.append(left[-1] + (1 + i % 3) / 1.0)
        right.append(right[-1] + (1 + (n - 1 - i) % 3) / 2.0)
    for i in range(n):
        ways = ([(left[i], 1)] if i < n - 1 else []) + ([(right[n - 1 - i], 2)] if i else [])
        want[i] = min((v, o) for v, o in ways if v <= 50)
    spark.sparkContext.setJobGroup("expansion", "")
    found = N.expand_by_owner(seeds, cells, edges, (1 + F.col("toll")) / F.col("pace"), 50)
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("expansion"))
    spark.sparkContext._jsc.clearJobGroup()
    assert {r[0]: (r[1], r[2]) for r in found.collect()} == want
    assert jobs < 70
    a, b = (dealt(spark.range(9).selectExpr("id AS cell_id", f"id * {k} AS owner"), "cell_id", 4) for k in (2, 3))
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = a.unionByName(b).groupBy("cell_id", "owner").count()._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
    assert "Exchange" not in plan


def test_a_long_line_of_rivers_takes_few_jobs(spark, tmp_path):
    """Each of 60 rivers ends in the one before, and ten end in the last but one: rounds follow the logarithm of the depth."""
    n = 60
    ends = [(i, i - 1) for i in range(1, n)] + [(n + i, n - 2) for i in range(10)]
    rows = [(i, 1, i, 0, 1.0) for i in range(n + 10)] + [(i, 2, to, 0, 1.0) for i, to in ends]
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_extendedprice double").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.range(n + 10).selectExpr("id AS p_partkey", "25 AS p_size").write.parquet(f"{tmp_path}/part.parquet")
    spark.sparkContext.setJobGroup("rivers", "")
    found = {r.river_id: (r.stem, r.depth) for r in QUERIES["river_hierarchy"](spark, str(tmp_path)).collect()}
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("rivers"))
    spark.sparkContext._jsc.clearJobGroup()
    assert found == {i: (0, i if i < n else n - 1) for i in range(n + 10)}
    assert jobs < 120


def test_stems_of_a_cycle_raise(spark):
    with pytest.raises(RuntimeError, match="cycle"):
        stems(spark.createDataFrame([(1, 2), (2, 1), (3, None)], "node long, to long"), 4)
    assert stems(spark.createDataFrame([], "node long, to long")).count() == 0
