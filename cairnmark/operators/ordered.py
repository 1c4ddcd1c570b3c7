"""Running sums and numbers over parts of any size: in two levels, so that no task ever holds a whole part."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from cairnmark.session import materialize


def running_sum(df: DataFrame, parts: list[str], bucket: str, order: list, value: Column, out: str) -> DataFrame:
    """Adds `out`: the sum of value over the rows before this one, within parts, ordered by (bucket, order).

    Two levels: bucket totals are summed first (one row per bucket), so no task ever holds a whole part,
    however hot. df must be stable under re-reading (a table or a materialized frame).
    """
    key = [*parts, bucket]
    totals = df.groupBy(*key).agg(F.sum(value).alias("_t"))
    before = Window.partitionBy(*parts).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*key, F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_off"))
    a, b = df.alias("a"), offsets.alias("b")
    on = None
    for k in key:
        c = F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
        on = c if on is None else on & c
    inside = Window.partitionBy(*[F.col(f"a.{k}") for k in key]).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return a.join(b, on).select("a.*", (F.col("b._off") + F.coalesce(F.sum(value).over(inside), F.lit(0))).alias(out))


def numbered(df: DataFrame, parts: list[str], order: list, out: str) -> DataFrame:
    """Adds `out`: the 0-based position of each row in its part, in the given order, by range partitions and their counts.

    Rows are dealt by range and written once, so that partition sizes are stable; ties take any order.
    """
    n = max(1, df.sparkSession.sparkContext.defaultParallelism)
    dealt = materialize(df.repartitionByRange(n, *parts, *order).withColumn("_p", F.spark_partition_id()), "numbered")
    return running_sum(dealt, parts, "_p", order, F.lit(1), out).drop("_p")
