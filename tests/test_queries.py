"""Every registered query that has SQL must agree with it on the small tables."""

import os

import duckdb
import pytest

from cairnmark.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def normal(x):
    if isinstance(x, float):
        return repr(round(x, 6))
    return repr(bytes(x) if isinstance(x, bytearray) else x)


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


def same(df, rel):
    names = [c[0] for c in rel.description]
    want = sorted(tuple(normal(r[names.index(c)]) for c in sorted(names)) for r in rel.fetchall())
    got = sorted(tuple(normal(r[c]) for c in sorted(df.columns)) for r in df.collect())
    assert sorted(df.columns) == sorted(names)
    assert got == want


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_agrees_with_sql(name, spark, sf, duck):
    same(catalog.QUERIES[name](spark, sf), duck.execute(catalog.ORACLES[name]))


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_greedy_picks_do_not_overlap(spark, sf):
    got = catalog.QUERIES["greedy_solution"](spark, sf)
    pairs = catalog.QUERIES["overlap_pairs"](spark, sf)
    chosen = {r["cand"] for r in got.collect()}
    assert chosen
    assert not [p for p in pairs.collect() if p["a"] in chosen and p["b"] in chosen]


def test_program_text(spark, sf):
    lines = [r["text"] for r in catalog.QUERIES["ilp_problem"](spark, sf).orderBy("line").collect()]
    assert lines[0].startswith("NAME") and lines[-1] == "ENDATA" and "ROWS" in lines and "COLUMNS" in lines


def test_blake2b_ids(spark, sf):
    from cairnmark.functions import node

    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in catalog.QUERIES["cid_blake2b"](spark, sf).collect():
        assert r["cid"] == str(node.to_ipld(texts[r["doc_id"]])[0])


def test_package_does_not_need_the_corpus_part():
    root = os.path.dirname(os.path.dirname(os.path.abspath(catalog.__file__)))
    for folder, _, files in os.walk(root):
        if os.path.basename(folder) == "llm":
            continue
        for f in files:
            if f.endswith(".py"):
                assert "cairnmark.llm" not in open(os.path.join(folder, f)).read()
