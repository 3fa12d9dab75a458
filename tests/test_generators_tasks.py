"""Generated inputs: a task's rows are bounded, whatever their number."""

from latticework.sources import generators


def test_rows_of_a_task_are_bounded(spark):
    n = 9 * generators.TASK_ROWS + 1
    for made in (generators.random_points(spark, n), generators.centred(spark, n), generators.random_coo(spark, 4, 3, n)):
        assert made.rdd.getNumPartitions() >= 10
    assert generators.random_points(spark, 0).count() == 0
    assert sorted(r["id"] for r in generators.random_points(spark, 7).collect()) == list(range(7))
