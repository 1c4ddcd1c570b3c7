from pyspark.sql import functions as F

from cairnmark.streaming import queue


def test_backoff_and_order(spark):
    jobs = spark.createDataFrame([("a", 1, 1), ("b", 0, 2), ("c", 2, 0), ("d", 0, 3)], "func string, attempt int, position int")
    assert [r["func"] for r in queue.assignment_order(jobs).collect()] == ["b", "d", "c", "a"]
    assert [r["m"] for r in jobs.select(queue.backoff_minutes(F.col("attempt")).alias("m")).collect()] == [8.0, 4.0, 16.0, 4.0]


def test_gauges(spark):
    log = spark.createDataFrame([("f", "queued"), ("f", "running"), ("f", "queued"), ("g", "finished")], "func string, state string")
    got = {r["func"]: (r["queued"], r["running"], r["finished"]) for r in queue.gauges(log).collect()}
    assert got == {"f": (2, 1, 0), "g": (0, 0, 1)}
