"""Helpers shared by the corpus operators: whole-table scans, two-level running sums, exact small reads."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F, types as T

from cairnmark.operators.ordered import numbered, running_sum  # noqa: F401
from cairnmark.session import materialize, shared_dir, table  # noqa: F401

#: A frame is broadcast only if its counted bytes are no more than this.
BROADCAST_BYTES = 64 << 20


def n_bytes(df: DataFrame) -> int:
    """Bytes of the values of df: eight for each number, eight and the counted length for all else."""
    width = F.lit(0).cast("long")
    for f in df.schema.fields:
        value = F.col(f"`{f.name}`")
        if not isinstance(f.dataType, (T.NumericType, T.BooleanType, T.DateType, T.TimestampType)):
            text = value if isinstance(f.dataType, (T.StringType, T.BinaryType)) else value.cast("string")
            width = width + F.coalesce(F.octet_length(text), F.lit(0))
        width = width + 8
    return df.agg(F.sum(width)).first()[0] or 0


def small(df: DataFrame) -> DataFrame:
    """df, marked for broadcast if its counted bytes are few enough; larger ones are joined by shuffling."""
    return F.broadcast(df) if n_bytes(df) <= BROADCAST_BYTES else df


def n_buckets(rows: int) -> int:
    """How many buckets even out the two levels of a running sum: as many as rows that a bucket then holds."""
    return max(1, math.isqrt(rows))


def hash_bucket(n: int, *cols: Column | str) -> Column:
    return F.pmod(F.xxhash64(*cols), F.lit(n)).cast("int")


def ranked(df: DataFrame, order: list, out: str) -> DataFrame:
    """Adds `out`: the 0-based position in the given order; ties take any order."""
    return numbered(df, [], order, out)


WORD_SPLIT = r"[\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    """Number of maximal runs of non-white-space; null counts as none."""
    return F.coalesce(F.size(F.filter(F.split(text, WORD_SPLIT), lambda x: x != "")), F.lit(0)).cast("long")


