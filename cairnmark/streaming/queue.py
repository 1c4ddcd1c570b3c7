"""A job queue as a structured stream: requests in, calls out, each (func, args) computed once.

Requests are deduplicated within their watermark; what the store has answered already is left out by a stream-static
anti join at every micro-batch, and the rest is evaluated and appended. A batch that is replayed finds its own calls, so
delivery at least once gives results once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from cairnmark.operators.memo import Evaluator, misses


def pending(requests: DataFrame, event_time: str = "ts", late: str = "10 minutes") -> DataFrame:
    """Requests (func, args, event time), each once within the watermark."""
    return requests.withWatermark(event_time, late).dropDuplicatesWithinWatermark(["func", "args"])


def run_queue(requests: DataFrame, evaluator: Evaluator, checkpoint: str, available_now: bool = True):
    """Starts the query; requests is a stream of func, args, ts."""

    def batch(df: DataFrame, _: int) -> None:
        todo = misses(df.select("func", "args"), evaluator.store.calls, ["func", "args"])
        evaluator.evaluate(todo)

    w = pending(requests).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if available_now else w).start()


def gauges(jobs: DataFrame) -> DataFrame:
    """Queued, running and finished jobs by func, of a job log (func, state)."""
    return jobs.groupBy("func").agg(*[F.count_if(F.col("state") == s).alias(s) for s in ("queued", "running", "finished")])


def backoff_minutes(attempt: Column) -> Column:
    """A job is handed out again after 4 minutes, and twice as long each time."""
    return F.lit(4) * F.pow(F.lit(2), attempt)


def assignment_order(jobs: DataFrame) -> DataFrame:
    """Jobs (func, attempt, position) in the order workers get them: those never started first, then retries."""
    return jobs.orderBy((F.col("attempt") > 0).cast("int"), "position")


def assignment_places(jobs: DataFrame) -> DataFrame:
    """Jobs (func, attempt, position, ...) with the place from 1 at which they are handed out among those of their func."""
    w = Window.partitionBy("func").orderBy((F.col("attempt") > 0).cast("int"), "position")
    return jobs.withColumn("place", F.row_number().over(w))
