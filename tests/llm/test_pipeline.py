"""The pipeline's stages, each against its own input, and the registered queries against their SQL."""

import duckdb
import pytest
from brute import contained_items, jaccard_components
from pyspark.sql import functions as F

import corpus_pipeline
from cairnmark.llm import mixing, queries
from cairnmark.llm.common import materialize, table
from test_queries import TABLES, same


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_agrees_with_sql(name, spark, sf, duck):
    same(queries.QUERIES[name](spark, sf), duck.execute(queries.ORACLES[name]))


def test_all_queries_are_there():
    assert [n.split("_")[0] for n in queries.QUERIES] == [f"op{i}" for i in range(1, 11)]


def test_stages(spark, sf):
    docs = table(spark, sf, "documents")
    rows = {}
    for name, stage in corpus_pipeline.STAGES:
        out = materialize(stage(spark, docs, sf), name)
        if name != "sharding":
            assert out.columns == table(spark, sf, "documents").columns
        rows[name] = ([(r["doc_id"], r["text"]) for r in docs.collect()], [(r["doc_id"], r["text"]) for r in out.collect()] if name != "sharding" else out.collect())
        if name == "mixing":
            want = {r["source"]: (r["target"], r["t"]) for r in mixing.mix(docs).groupBy("source").agg(F.first("target").alias("target"), F.sum("taken").alias("t")).collect()}
            words = out.groupBy("source").agg(F.sum(mixing.n_words(F.col("text"))).alias("w"))
            assert all(abs(r["w"] - want[r["source"]][0]) <= 1 for r in words.collect())
        docs = out
    before, after = rows["ngram_jaccard"]
    comp = jaccard_components(before)
    assert sorted(d for d, _ in after) == sorted({c if n else d for d, n, c in comp})
    before, after = rows["decontamination"]
    items = [(r["item_id"], r["text"]) for r in table(spark, sf, "benchmark").collect()]
    bad = {d for d, *_ in contained_items(before, items)}
    assert sorted(d for d, _ in after) == sorted(d for d, _ in before if d not in bad)
    shards = [r["shard"] for r in rows["sharding"][1]]
    assert len(shards) == len(rows["mixing"][1]) and max(map(shards.count, range(16))) - min(map(shards.count, range(16))) <= 1


def write_tables(spark, folder, rows):
    """documents with columns of names that operators use, and small labels and benchmark tables."""
    extra = ["1 AS key", "2 AS label", "0.5 AS score", "'x' AS shard", "3 AS size", "'y' AS rid", "4 AS a", "'z' AS edge", "5 AS epochs", "array(1) AS prefix", "struct(1 AS b) AS row"]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.selectExpr("*", *extra).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (2, None, 1), (None, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, " ".join(f"item{i}" for i in range(20))), (2, None), (3, "")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return f"file://{folder}"


def edge_rows():
    words = lambda n, k: " ".join(f"w{k}x{i}" for i in range(n))
    texts = [None, "", " \n\t", "one", "one", words(30, 1), words(30, 1), words(30_000, 2), "a " * 40, "é " * 30, f"{words(40, 3)} {' '.join(f'item{i}' for i in range(20))} {words(40, 4)}", f"{words(20, 5)}. you idiot. i will kill you. {words(20, 6)}", "x" * 100_000]
    rows = [(i, t, "en", ["s", "t", None][i % 3], None if t is None else len(t)) for i, t in enumerate(texts)]
    return rows + [rows[5], rows[1], (None, words(50, 7), None, "s", 1), (None, words(50, 7), None, "s", 1), (None, None, None, None, None)]


def test_edge_rows_through_the_pipeline(spark, tmp_path):
    sf = write_tables(spark, tmp_path / "edge", edge_rows())
    docs = table(spark, sf, "documents")
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = materialize(stage(spark, docs, sf), name)
        assert out.schema.simpleString() == docs.schema.simpleString()
        docs = out
        kept[name] = [(r["doc_id"], r["text"]) for r in out.collect()]
    all_rows = [(r[0], r[1]) for r in edge_rows()]
    ids = lambda name: sorted((i for i, _ in kept[name]), key=str)
    assert ids("toxicity") == sorted((i for i, _ in all_rows if i != 11), key=str)
    assert ids("ngram_jaccard") == sorted([0, 1, 1, 2, 3, 5, 7, 8, 9, 10, 12, None, None], key=str)
    assert ids("decontamination") == sorted([0, 1, 1, 2, 3, 5, 7, 8, 9, 12, None, None], key=str)
    assert {i for i, _ in kept["mixing"]} <= {3, 5, 7, 8, 9, 12, None} and all((t or "").split() for _, t in kept["mixing"])
    out = corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect()
    assert len(out) == len(kept["mixing"]) and len({(r["shard"], r["slot"]) for r in out}) == len(out)


def test_empty_table_through_the_pipeline(spark, tmp_path):
    sf = write_tables(spark, tmp_path / "empty", [])
    assert corpus_pipeline.run(spark, sf).count() == 0


def test_toxicity_stage_drops_what_the_query_predicts(spark, sf):
    docs = table(spark, sf, "documents")
    bad = {r["doc_id"] for r in queries.QUERIES["op9_toxicity"](spark, sf).filter("predicted = 1").collect()}
    kept = [r["doc_id"] for r in corpus_pipeline.toxicity(spark, docs, sf).collect()]
    assert bad and sorted(kept) == sorted(r["doc_id"] for r in docs.collect() if r["doc_id"] not in bad)
