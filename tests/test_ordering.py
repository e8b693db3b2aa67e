from pyspark.sql import functions as F

from lintlake.operators.ordering import numbered, with_previous
from lintlake.operators.tasks import order_violations


def hot(spark, n=3000):
    """One group holds a third of all rows."""
    return spark.range(n).select("id", F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("g"), (F.col("id") % 50).cast("string"))).alias("g"),
                                 ((F.col("id") * 7919) % n).alias("k"))


def test_numbers_match_a_window(spark):
    rows = [tuple(r) for r in numbered(hot(spark), [F.col("g")], [F.col("k")], "n").select("g", "k", "n").collect()]
    by_group = {}
    for g, k, n in sorted(rows):
        by_group.setdefault(g, []).append(n)
    assert len(rows) == 3000
    assert all(ns == list(range(1, len(ns) + 1)) for ns in by_group.values())


def test_numbers_over_everything_and_null_groups(spark):
    frame = spark.createDataFrame([(None, 2), (None, 1), ("a", 5)], "g string, k int")
    assert sorted(r.n for r in numbered(frame, [], [F.col("k")], "n").collect()) == [1, 2, 3]
    assert sorted((r.g or "", r.k, r.n) for r in numbered(frame, [F.col("g")], [F.col("k")], "n").collect()) == [("", 1, 1), ("", 2, 2), ("a", 5, 1)]


def test_no_window_holds_a_whole_group(spark):
    made = numbered(hot(spark), [F.col("g")], [F.col("k")], "n")
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window" in line]
    # The only window runs over the blocks: one row per group and slice.
    assert len(windows) == 1 and "sum(_n" in windows[0]


def test_previous_crosses_slices(spark):
    rows = with_previous(hot(spark), [F.col("g")], [F.col("k")], F.col("k"), "before").select("g", "k", "before").collect()
    last = {}
    for r in sorted(rows, key=lambda r: (r.g, r.k)):
        assert r.before == last.get(r.g)
        last[r.g] = r.k


def test_order_violation(spark):
    tasks = spark.createDataFrame(
        [(1, 0, "a", 30, "pending"), (2, 0, "a", 20, "pending"), (3, 0, "b", 5, "pending"), (4, 0, "b", 9, "completed"), (5, 0, "b", 8, "pending")],
        "task_id int, phase int, file string, line int, status string")
    assert [tuple(r) for r in order_violations(tasks).collect()] == [(0, "b")]
