"""Connected components as labels of nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame

from cairnmark.operators.graph import connected


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of every node of edges (a, b); label: the least node of its component, in rounds that are logarithmic
    in the nodes."""
    return connected(edges).withColumnRenamed("component", "label")
