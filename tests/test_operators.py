"""Operators whose rounds have no fixed end, modules, fields of nodes and nested calls, against plain versions."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from cairnmark.functions import fields
from cairnmark.operators import analytics as A, candidates, graph, resolve
from cairnmark.operators.memo import TEST_FUNCS, Evaluator, Registry
from cairnmark.sources.modules import Modules
from cairnmark.sources.store import open_store
from test_analytics import cands


@pytest.fixture
def store(spark, tmp_path):
    return open_store(spark, f"file://{tmp_path}/store", create=True)


def test_paths_longer_than_any_number_of_rounds(spark):
    edges = spark.createDataFrame([(i, i + 1, f"/{i}") for i in range(70)], "src long, dst long, step string")
    found = graph.paths_to(edges, spark.createDataFrame([(70,)], "node long"), spark.createDataFrame([(0, "r")], "node long, root string")).collect()
    assert [(r["target"], r["root"], len(r["steps"])) for r in found] == [(70, "r", 70)]


def test_paths_in_a_cycle_fail(spark):
    edges = spark.createDataFrame([(0, 1, "a"), (1, 0, "b")], "src long, dst long, step string")
    with pytest.raises(ValueError, match="cycle"):
        graph.paths_to(edges, spark.createDataFrame([(1,)], "node long"), spark.createDataFrame([(0, "r")], "node long, root string"))


def test_components_of_a_chain(spark):
    names = list(range(300))
    random.Random(1).shuffle(names)
    edges = spark.createDataFrame([*itertools.pairwise(names), (1000, 1000)], "a long, b long")
    assert {r["component"] for r in graph.connected(edges).filter("node < 1000").collect()} == {0}
    assert [r["component"] for r in graph.connected(edges).filter("node = 1000").collect()] == [1000]


def test_refine_many_values_of_one_fingerprint(spark):
    items = spark.createDataFrame([("g", i, i % 70) for i in range(140)] + [(None, 200, 1), (None, 201, None)], "group_key string, item long, value long")
    got = {r["item"]: r["class"] for r in A.refine(items, lambda a, b: a == b, F.lit(0)).collect()}
    assert got == {**{i: i % 70 for i in range(140)}, 200: 200, 201: 201}


def test_dedupe_keeps_places_apart_and_follows_cycles(spark):
    d = spark.createDataFrame([("m", n, c) for n, c in (("a", "1"), ("b", "2"), ("f", "x"), ("g", "x"), ("h", "x"), ("p", "y"), ("q", "y"))], "module string, name string, content string")
    refs = spark.createDataFrame([("m", "f", 0, "a"), ("m", "f", 1, "b"), ("m", "g", 0, "b"), ("m", "g", 1, "a"), ("m", "h", 0, "a"), ("m", "h", 1, "b"), ("m", "p", 0, "q"), ("m", "q", 0, "p")], "module string, name string, pos int, ref string")
    got = {r["name"]: r["class_name"] for r in resolve.dedupe_up_to_renaming(d, refs).collect()}
    assert got == {"a": "a", "b": "b", "f": "f", "g": "g", "h": "f", "p": "p", "q": "p"}


def plain_greedy(rows, min_benefit=1):
    """(cand, func, nodes, callee, size, savings): all benefits anew at every turn."""
    def meet(x, y):
        return x[1] == y[1] and any(s < f and e > t for s, e in itertools.batched(x[2], 2) for t, f in itertools.batched(y[2], 2))

    own = {}
    for r in sorted(rows):
        mine = own.setdefault(r[3], [])
        if not any(meet(r, o) for o in mine):
            mine.append(r)
    chosen, left = [], dict(own)
    while left:
        def gain(k):
            return sum(r[5] for r in left[k] if not any(meet(r, c) for c in chosen)) - min(r[4] for r in rows if r[3] == k)

        best = min(left, key=lambda k: (-gain(k), min(r[0] for r in rows if r[3] == k)))
        if gain(best) < min_benefit:
            break
        chosen += [r for r in left.pop(best) if not any(meet(r, c) for c in chosen)]
    return sorted(r[0] for r in chosen)


@pytest.mark.parametrize("seed", [1, 2])
def test_greedy_against_a_plain_version(spark, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(120):
        s = rng.randrange(60)
        rows.append((i, rng.randrange(3), [s, s + rng.randint(1, 9), s + 70, s + 70 + rng.randint(1, 90)], f"c{rng.randrange(25)}", rng.randint(1, 6), rng.randint(1, 9)))
    assert sorted(r["cand"] for r in A.greedy_selection(cands(spark, rows)).collect()) == plain_greedy(rows)


def test_overlaps_across_buckets(spark):
    c = cands(spark, [(0, 1, [0, 1000], "a", 1, 1), (1, 1, [999, 1001], "a", 1, 1), (2, 1, [1000, 1002, 63, 64], "a", 1, 1), (3, 1, [], "a", 1, 1), (4, 1, [5, 5], "a", 1, 1)])
    assert sorted((r["a"], r["b"]) for r in A.overlaps(c).collect()) == [(0, 1), (0, 2), (1, 2)]


def test_modules(store, spark):
    rows = [("m", 1, "b", "x" * 50), ("m", 0, "a", "short"), ("n", 0, "a", "x" * 50), ("n", 1, "z", None), (None, 0, "q", "y" * 40)]
    modules = Modules(store)
    modules.add(spark.createDataFrame(rows, "module string, pos long, name string, text string"))
    assert {r["module"]: r["text"] for r in modules.rejoin().collect()} == {"m": "short" + "x" * 50, "n": "x" * 50, None: "y" * 40}
    assert store.blocks.count() == 2 and modules.part_ids().count() == 4
    assert {r["module"]: (r["num_parts"], r["num_shared_parts"]) for r in modules.sharing().collect()} == {"m": (2, 1), "n": (2, 1), None: (1, 0)}
    modules.add(spark.createDataFrame([("m", 0, "a", "new")], "module string, pos long, name string, text string"))
    assert {r["module"]: r["text"] for r in modules.rejoin().collect()}["m"] == "new"
    modules.add(spark.createDataFrame([], "module string, pos long, name string, text string"))
    assert modules.modules().count() == 3


def test_fields(spark):
    df = spark.createDataFrame([('{"map":{"a":[1,2,{"float":"0.5"}],"b":"é"}}',)], "j string")
    j, a = F.col("j"), fields.at(F.col("j"), "a")
    got = df.select(
        a, fields.at_or_null(j, "x"), fields.get_value_or(j, "x", "7"), fields.get_value_or(F.lit(None).cast("string"), "x", "7"), fields.element(a, 0), fields.element(a, -1), fields.contains(j, "b"), fields.contains(a, "b"),
        fields.size(j), fields.size(fields.at(j, "b")), fields.size(F.lit("5")), fields.is_empty(F.lit("[]")), fields.kind_of(fields.element(a, 2)), fields.is_integer(F.lit("128"), 8), fields.is_integer(F.lit("128"), 8, False),
        fields.with_field(j, "a", "null"), fields.without_field(j, "a"), fields.appended(F.lit("[1]"), "[2]"), fields.concatenated(F.lit("[1]"), F.lit("[2]"))).first()
    assert list(got) == ['[1,2,{"float":"0.5"}]', "null", "7", "7", "1", '{"float":"0.5"}', True, False, 2, 2, 0, True, "float", False, True,
                         '{"map":{"a":null,"b":"é"}}', '{"map":{"b":"é"}}', "[1,[2]]", "[1,2]"]
    for bad in (fields.at(j, "x"), fields.element(a, 3), fields.with_field(a, "x", "1")):
        with pytest.raises(Exception, match="NodeError|no member|no element|can't be edited"):
            df.select(bad).collect()


def call(store, spark, registry, func, *args):
    ids = [bytearray(r["cid"]) for x in args for r in store.put(spark.createDataFrame([(str(x),)], "json string")).collect()]
    done = Evaluator(store, registry).evaluate(spark.createDataFrame([(func, ids)], "func string, args array<binary>"))
    return store.get(done.select(F.col("result").alias("cid"))).first()["json"]


def test_nested_calls(store, spark):
    assert call(store, spark, TEST_FUNCS, "test.sum_to", 3) == "6"
    assert sorted(r["func"] for r in store.calls.collect()) == ["test.sum_to"] * 4  # each nested call is cached
    assert call(store, spark, TEST_FUNCS, "test.ackermann_calls", 1, 1) == "3"


def test_calls_that_wait_for_each_other_fail(store, spark):
    r = Registry()
    r.register_nested("a", 1, lambda calls, x: calls.get("b", x))
    r.register_nested("b", 1, lambda calls, x: calls.get("a", x))
    with pytest.raises(RuntimeError, match="wait for each other"):
        call(store, spark, r, "a", 1)


def test_harness_functions(store, spark):
    assert call(store, spark, TEST_FUNCS, "test.sleep", 0) == "null"
    with pytest.raises(Exception, match="test.throw_exception.*as asked for"):
        call(store, spark, TEST_FUNCS, "test.throw_exception")


def test_small_filters(spark):
    df = spark.createDataFrame([(1, 2, 1), (2, 5, 5)], "k long, num_args long, num_returns long")
    assert [r["k"] for r in candidates.at_most_args(df, 4).collect()] == [1]
    g = spark.createDataFrame([("a", 2, 2), ("b", 1, 2)], "group_key string, num_unique_callees long, num_members long")
    assert [r["group_key"] for r in A.duplicated(g).collect()] == ["b"]


def test_sorted_listing_stops_early(store, spark):
    store.set_heads(spark.createDataFrame([(n, bytearray(b"\x01\x71\x00\x01\x01")) for n in ("b", "a b", "a", "é", "Z")], "name string, cid binary"))
    assert [r["name"] for r in store.list_heads().collect()] == ["é", "Z", "a", "a b", "b"]
    assert [r["name"] for r in store.list_heads(2).collect()] == ["é", "Z"]
