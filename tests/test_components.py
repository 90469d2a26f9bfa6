"""Connected components where shuffles have many partitions."""

from cartoweave.plans.components import connected_components


def test_a_dense_group_takes_few_tasks(spark):
    """Many links of one group, a chain, a self-loop and null ends, over 40 partitions that are not merged."""
    other = spark.newSession()
    for k, v in {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}.items():
        other.conf.set(k, v)
    dense = [(i, j) for i in range(100, 200) for j in range(100, i)]
    rows = dense + [(i + 1, i) for i in range(300, 340)] + [(7, 7), (None, 5), (6, None)]
    edges = other.createDataFrame(rows, "src int, dst int")
    tracker = other.sparkContext.statusTracker()
    other.sparkContext.setJobGroup("dense", "")
    found = connected_components(edges)
    jobs = tracker.getJobIdsForGroup("dense")
    other.sparkContext._jsc.clearJobGroup()
    tasks = sum(s.numTasks for j in jobs for i in tracker.getJobInfo(j).stageIds if (s := tracker.getStageInfo(i)))
    expected = {i: 100 for i in range(100, 200)} | {i: 300 for i in range(300, 341)} | {7: 7}
    assert {r.node: r.component for r in found.collect()} == expected
    assert found.schema["component"].dataType.simpleString() == "int"
    assert tasks < 1000, tasks
