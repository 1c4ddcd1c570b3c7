import pytest


@pytest.fixture(scope="session")
def frame(spark):
    """Rows (doc_id, text, source) as documents, with extra columns whose names operators use themselves."""

    def make(rows, parts=3):
        full = [(*r, *[None] * (3 - len(r))) for r in rows]
        df = spark.createDataFrame(full, "doc_id long, text string, source string").repartition(parts)
        return df.selectExpr("doc_id", "text", "source AS lang", "source", "CAST(length(text) AS LONG) AS n_chars", "'x' AS size", "1 AS key", "'y' AS shard", "2.5 AS score", "array(1) AS data", "'q' AS rid", "0 AS hub", "'d' AS d")

    return make
