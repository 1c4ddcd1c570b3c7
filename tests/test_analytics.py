from pyspark.sql import functions as F

import pytest

from cairnmark.operators import analytics as A, resolve as R


def cands(spark, rows):
    return spark.createDataFrame(rows, "cand long, func long, nodes array<long>, callee string, callee_size long, caller_savings long")


def test_overlap_chain(spark):
    c = cands(spark, [(0, 1, [0, 3], "a", 1, 5), (1, 1, [2, 5], "b", 1, 5), (2, 1, [4, 7], "c", 1, 5), (3, 2, [0, 9], "d", 1, 5)])
    assert sorted((r["a"], r["b"]) for r in A.overlaps(c).collect()) == [(0, 1), (1, 2)]
    # equal benefits: the first goes, and takes its neighbour away
    assert sorted(r["cand"] for r in A.greedy_selection(c).collect()) == [0, 2, 3]


def test_greedy_prefers_benefit_and_counts_copies(spark):
    c = cands(spark, [(0, 1, [0, 4], "a", 3, 4), (1, 1, [2, 6], "b", 3, 5), (2, 2, [0, 1], "b", 3, 1)])
    assert sorted(r["cand"] for r in A.greedy_selection(c).collect()) == [1, 2]
    copies = spark.createDataFrame([(1, 3), (2, 1)], "func long, copies long")
    got = A.greedy_selection(c.filter("callee = 'a'"), min_benefit=9, copies=copies)
    assert [r["caller_savings"] for r in got.collect()] == [12]
    assert A.greedy_selection(c.filter("callee = 'a'"), min_benefit=2).count() == 0


def test_runs(spark):
    df = spark.createDataFrame([("x", i) for i in (1, 2, 3, 7, 9, 10, 10)], "k string, v long")
    runs = A.encode_runs(df, ["k"], "v")
    assert runs.first()["nodes"] == [1, 4, 7, 8, 9, 11]
    assert sorted(r["node"] for r in A.decode_runs(runs).collect()) == [1, 2, 3, 7, 9, 10]


def test_size_correction(spark):
    df = spark.createDataFrame([(10, 5, 7), (10, 5, 12)], "est long, sav long, act long")
    got = df.select("act", *A.corrected(F.col("est"), F.col("sav"), F.col("act"))).orderBy("act").collect()
    assert [(r["callee_size"], r["caller_savings"]) for r in got] == [(7, 2), (12, 5)]


def test_refinement(spark):
    df = spark.createDataFrame([("g", i, v) for i, v in enumerate("abacb")], "group_key string, item long, value string")
    got = A.refine(df, lambda a, b: a == b, F.col("value"))
    assert {r["item"]: r["class"] for r in got.collect()} == {0: 0, 1: 1, 2: 0, 3: 3, 4: 1}


def test_program():
    lp = A.LinearProgram("TEST")
    x, y, z = lp.bool_var("X"), lp.int_var("Y", 1, 9), lp.real_var("Z", None)
    lp.constraint("R1", [(1, x), (2, y), (3, x)], "<=", 4)
    lp.constraint("R2", [(1, z)], ">=", 0)
    lp.constraint("R3", [(-1, y)], "=", -1)
    lp.minimize([(1, x), (-1, z)])
    text = lp.mps()
    assert "    X         R1                   4" in text and " BV BND       X       " in text and " FR BND       Z       " in text
    assert text[2:6] == [" N  COST", " L  R1", " G  R2", " E  R3"]
    with pytest.raises(ValueError):
        lp.real_var("TOOLONGNAME")
    assert A.reduced([(1, "a"), (-1, "a"), (2, "b")]) == {"a": 0, "b": 2}


def program_text(df):
    rows = df.orderBy("line").collect()
    assert [r["line"] for r in rows] == list(range(len(rows)))
    return [r["text"] for r in rows]


def test_selection_program_is_that_of_the_plain_writer(spark):
    rows = [(i * 3, i % 4, [i, i + 6], f"c{(i * 7) % 11}", i % 5 + 1, i % 9) for i in range(60)] + [(500, 9, [0, 2], "alone", 9, 1), (501, 9, [1, 3], None, 1, 9)]
    c = cands(spark, rows).repartition(5)
    pairs = sorted((r["a"], r["b"]) for r in A.overlaps(c).collect())
    callees = {r[3] for r in rows if r[3]}
    size = {k: min(r[4] for r in rows if r[3] == k) for k in callees}
    useful = [r for r in rows if r[3] in callees and sum(x[5] for x in rows if x[3] == r[3]) > size[r[3]]]
    assert pairs and 0 < len(useful) < len(rows)
    lp, ys, xs, cost = A.LinearProgram("SELECT"), {}, {}, []
    for i, (cand, _, _, callee, _, savings) in enumerate(useful):
        if callee not in ys:
            ys[callee] = lp.bool_var(f"Y{len(ys):07d}")
            cost.append((size[callee], ys[callee]))
        xs[cand] = lp.bool_var(f"X{i:07d}")
        cost.append((-savings, xs[cand]))
        lp.constraint(f"C{i:07d}", [(1, xs[cand]), (-1, ys[callee])], "<=", 0)
    for i, (a, b) in enumerate(pairs):
        if a in xs and b in xs:
            lp.constraint(f"O{i:07d}", [(1, xs[a]), (1, xs[b])], "<=", 1)
    lp.minimize(cost)
    assert program_text(A.selection_program(c, A.overlaps(c))) == lp.mps()
    assert program_text(A.selection_program(c.filter("cand = 500"), A.overlaps(c))) == A.LinearProgram("SELECT").mps()


def test_selection_program_of_over_a_million_candidates(spark):
    c = spark.range(1_000_003).select(F.col("id").alias("cand"), F.col("id").alias("func"), F.array(F.lit(0).cast("long"), F.lit(2).cast("long")).alias("nodes"),
                                      F.col("id").alias("callee"), F.lit(5).cast("long").alias("callee_size"), F.when(F.col("id") % 500_000 == 2, 7).otherwise(0).cast("long").alias("caller_savings"))
    text = program_text(A.selection_program(c, A.overlaps(c)))
    assert [t for t in text if t.startswith(" BV")] == [f" BV BND       {v}000000{i}" for i in range(3) for v in "YX"]


def test_names_past_seven_digits(spark):
    ids = [0, 9_999_999, 10**7, 10**7 + 36**6 - 1, 10**7 + 36**6, 10**7 + 26 * 36**6 - 1]
    df = spark.createDataFrame([(i,) for i in ids], "i long")
    got = [r["n"] for r in df.orderBy("i").select(A._name("X", "i").alias("n")).collect()]
    assert got == ["X0000000", "X9999999", "XA000000", "XAZZZZZZ", "XB000000", "XZZZZZZZ"]
    with pytest.raises(Exception, match="no names"):
        spark.createDataFrame([(10**7 + 26 * 36**6,)], "i long").select(A._name("X", "i")).collect()


def test_candidates_without_savings_fail(spark):
    c = cands(spark, [(0, 1, [0, 1], "a", 1, 5), (1, 1, [4, 5], "a", 1, None)])
    with pytest.raises(Exception, match="no savings"):
        A.selection_program(c, A.overlaps(c)).collect()


def symbols(spark):
    d = spark.createDataFrame([("m1", "f", "strong", "x"), ("m2", "f", "local", "x"), ("m2", "g", "weak", "y"), ("m3", "g", "weak", "y"), ("m3", "h", "strong", "z")], "module string, name string, linkage string, content string")
    r = spark.createDataFrame([("m2", "u", "f"), ("m3", "u", "f"), ("m1", "u", "g"), ("m1", "u", "none")], "module string, name string, ref string")
    return r, d


def test_resolution(spark):
    r, d = symbols(spark)
    get = lambda df: {(x["module"], x["ref"]): x["target"] for x in df.collect()}
    assert get(R.resolve_merge(r, d)) == {("m2", "f"): "m2", ("m3", "f"): None, ("m1", "g"): None, ("m1", "none"): None}
    assert get(R.resolve_guided(r, d)) == {("m2", "f"): "m2", ("m3", "f"): "m1", ("m1", "g"): None, ("m1", "none"): None}
    assert get(R.resolve_mux(r, d)) == {("m2", "f"): "m2", ("m3", "f"): "m1", ("m1", "g"): "m2", ("m1", "none"): None}
    two = d.unionByName(spark.createDataFrame([("m9", "h", "strong", "q")], d.schema))
    with pytest.raises(Exception, match="several strong"):
        R.resolve_mux(r.withColumn("ref", F.lit("h")).filter("module = 'm1'"), two).collect()


def test_unique_names(spark):
    d = spark.createDataFrame([("a", "f"), ("b", "f"), ("c", "f"), ("a", "f.0")], "module string, name string")
    got = [r["unique_name"] for r in R.unique_names(d).collect()]
    assert len(set(got)) == 4 and {"f", "f.0"} <= set(got)


def test_equal_up_to_renaming(spark):
    d = spark.createDataFrame([("a", "f", "P"), ("a", "g", "Q"), ("b", "x", "P"), ("b", "y", "Q"), ("c", "f", "P"), ("c", "g", "R")], "module string, name string, content string")
    r = spark.createDataFrame([(m, u, v) for m, u, v in (("a", "f", "g"), ("a", "g", "f"), ("b", "x", "y"), ("b", "y", "x"), ("c", "f", "g"), ("c", "g", "f"))], "module string, name string, ref string")
    got = {(x["module"], x["name"]): (x["class_module"], x["class_name"]) for x in R.dedupe_up_to_renaming(d, r).collect()}
    assert got["b", "x"] == ("a", "f") and got["b", "y"] == ("a", "g") and got["c", "f"] == ("c", "f")


def test_several_references_need_places(spark):
    d = spark.createDataFrame([("a", "f", "P"), ("a", "g", "P"), ("a", "p", "Q"), ("a", "q", "R")], "module string, name string, content string")
    rows = [("a", "f", "p", 1), ("a", "f", "q", 2), ("a", "g", "q", 1), ("a", "g", "p", 2)]
    r = spark.createDataFrame(rows, "module string, name string, ref string, pos int")
    assert {x["name"]: x["class_name"] for x in R.dedupe_up_to_renaming(d, r).collect()} == {x: x for x in "fgpq"}
    with pytest.raises(Exception, match="need pos"):
        R.dedupe_up_to_renaming(d, r.drop("pos"))
