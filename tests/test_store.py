import pytest

from pyspark.sql import functions as F

from cairnmark.functions import node
from cairnmark.functions.cid import CID
from cairnmark.operators import graph
from cairnmark.operators.memo import Evaluator, Registry, ackermann, queens
from cairnmark.sources import car
from cairnmark.sources.store import open_store


def cid_of(value) -> str:
    return str(node.to_ipld(value)[0])


@pytest.fixture
def store(spark, tmp_path):
    return open_store(spark, str(tmp_path / "store"), create=True)


def put(store, *values):
    rows = [(node.to_json(v),) for v in values]
    return {r["json"]: bytes(r["cid"]) for r in store.put(store.spark.createDataFrame(rows, "json string")).collect()}


BIG = ["x" * 60, list(range(50))]


def test_put_and_get(store):
    got = put(store, 2, *BIG, BIG[0])
    assert got["2"] == node.to_ipld(2)[0].data
    put(store, BIG[0])  # again
    assert store.blocks.count() == 2  # the small one is its own id
    keys = store.spark.createDataFrame([(bytearray(c),) for c in got.values()], "cid binary")
    assert {r["json"] for r in store.get(keys).collect()} == {node.to_json(v) for v in [2, *BIG]}
    assert store.has(keys).count() == 3
    unknown = store.spark.createDataFrame([(bytearray(node.to_ipld("y" * 99)[0].data),)], "cid binary")
    assert store.has(unknown).count() == store.get(unknown).count() == 0


def test_heads(store):
    two, three = cid_of(2), cid_of(3)
    store.set("/head/x", f"/cid/{two}")
    store.set("/head/y", "/head/x")
    store.set("/head/x", f"/cid/{three}")
    assert store.resolve("/head/x") == CID.parse(three).data
    assert store.resolve("/head/y") == CID.parse(two).data
    store.delete_heads(store.spark.createDataFrame([("x",), ("unknown",)], "name string"))
    assert store.resolve("/head/x") is None
    assert [r["name"] for r in store.heads.collect()] == ["y"]
    with pytest.raises(ValueError):
        store.set(f"/cid/{two}", "/head/y")
    with pytest.raises(KeyError):
        store.set("/head/z", "/head/none")


def test_call_life_cycle(store):
    five, primes = cid_of(5), cid_of([2, 3, 5, 7, 11])
    uri = f"/call/primes/{five}"
    assert store.resolve(uri) is None
    store.set(uri, f"/cid/{primes}")
    assert store.resolve(uri) == CID.parse(primes).data
    assert store.list_calls("primes").count() == 1
    assert [r["func"] for r in store.list_funcs().collect()] == ["primes"]
    store.invalidate("primes")
    assert store.resolve(uri) is None
    assert store.list_funcs().count() == 0


def test_users_reach_and_garbage(store, spark):
    leaf = "leaf " * 20
    leaf_cid = node.to_ipld(leaf)[0]
    b, c = {"b": leaf_cid, "pad": "p" * 40}, {"c": [leaf_cid, leaf_cid], "pad": "q" * 40}
    top = [node.to_ipld(b)[0], node.to_ipld(c)[0]]
    put(store, leaf, b, c, top, "lost " * 20)
    top_cid = cid_of(top)
    store.set("/head/h", f"/cid/{top_cid}")
    store.set(f"/call/f/{leaf_cid}", f"/cid/{leaf_cid}")
    users = store.names_using(spark.createDataFrame([(bytearray(leaf_cid.data),)], "cid binary")).collect()
    assert sorted(u["kind"] for u in users) == ["block", "block", "call"]
    assert store.reachable().count() == 4
    assert [node.to_json("lost " * 20)] == [r["json"] for r in store.get(store.garbage().select("cid")).collect()]


def test_transfer_and_archive(store, spark, tmp_path):
    put(store, *BIG, {"a": node.to_ipld(BIG[0])[0], "pad": "z" * 50})
    store.set("/head/h", "/cid/" + cid_of({"a": node.to_ipld(BIG[0])[0], "pad": "z" * 50}))
    store.set("/call/f/" + cid_of(1), "/cid/" + cid_of(BIG[1]))
    other = open_store(spark, str(tmp_path / "other"), create=True)
    store.transfer(other)
    store.transfer(other)
    assert other.blocks.count() == 3 and other.heads.count() == 1 and other.calls.count() == 1
    path = str(tmp_path / "a.car")
    car.export_archive(store, path)
    third = open_store(spark, str(tmp_path / "third"), create=True)
    car.import_archive(third, path)
    assert third.resolve("/head/h") == store.resolve("/head/h")
    assert third.list_calls("f").count() == 1
    want = {bytes(r["cid"]) for r in store.blocks.select("cid").collect()}
    assert want <= {bytes(r["cid"]) for r in third.blocks.select("cid").collect()}


def test_versions(store, spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        open_store(spark, str(tmp_path / "none"))
    assert open_store(spark, store.path).path == store.path
    spark.createDataFrame([(99,)], "version int").coalesce(1).write.json(str(tmp_path / "bad/version.json"))
    with pytest.raises(ValueError):
        open_store(spark, str(tmp_path / "bad"))


def test_evaluate(store, spark, tmp_path):
    log = tmp_path / "ran"
    reg = Registry()

    def add(a, b):
        with open(log, "a") as f:
            f.write("x")
        return a + b

    reg.register("test.add", 2, add)
    reg.register("test.fail", 1, lambda a: 1 // a)
    with pytest.raises(ValueError):
        reg.register("test.add", 2, add)
    ev = Evaluator(store, reg)
    one, two = (bytearray(node.to_ipld(x)[0].data) for x in (1, 2))
    calls = spark.createDataFrame([("test.add", [two, two])] * 3 + [("test.add", [one, two])], "func string, args array<binary>")
    got = {tuple(bytes(a) for a in r["args"]): bytes(r["result"]) for r in ev.evaluate(calls).collect()}
    assert got == {(bytes(two), bytes(two)): node.to_ipld(4)[0].data, (bytes(one), bytes(two)): node.to_ipld(3)[0].data}
    assert log.read_text() == "xx"
    ev.evaluate(calls).collect()
    assert log.read_text() == "xx"  # all of them cached
    with pytest.raises(KeyError):
        ev.evaluate(calls.withColumn("func", F.lit("none")))
    with pytest.raises(TypeError):
        ev.evaluate(calls.withColumn("args", F.slice("args", 1, 1)))
    zero = spark.createDataFrame([("test.fail", [bytearray(node.to_ipld(0)[0].data)])], "func string, args array<binary>")
    with pytest.raises(Exception, match="/call/test.fail/"):
        ev.evaluate(zero).collect()


def test_recursive_functions(spark):
    assert [ackermann(m, n) for m, n in ((0, 0), (1, 2), (2, 2), (3, 3))] == [1, 4, 7, 61]
    assert queens(spark, 6).first()["solutions"] == 4


def test_paths(spark):
    edges = spark.createDataFrame([("A", "B", "0"), ("A", "C", "1"), ("B", "D", "x"), ("C", "D", "y"), ("C", "D", "z")], "src string, dst string, step string")
    roots = spark.createDataFrame([("A", "/head/h")], "node string, root string")
    got = graph.paths_to(edges, spark.createDataFrame([("D",)], "node string"), roots)
    assert sorted("/".join(r["steps"]) for r in got.collect()) == ["0/x", "1/y", "1/z"]
    assert graph.closure(edges, roots).count() == 4


def test_strong_components(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (5, 4), (5, 6)], "src int, dst int")
    assert {r["node"]: r["scc"] for r in graph.strong_components(edges).collect()} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 6: 6}


def test_queue(store, spark, tmp_path):
    from cairnmark.streaming.queue import run_queue

    reg = Registry()
    reg.register("test.add", 2, lambda a, b: a + b)
    two, three = (bytearray(node.to_ipld(x)[0].data) for x in (2, 3))
    rows = [("test.add", [two, two]), ("test.add", [two, two]), ("test.add", [two, three])]
    source = str(tmp_path / "in")
    spark.createDataFrame(rows, "func string, args array<binary>").withColumn("ts", F.current_timestamp()).write.parquet(source)
    stream = spark.readStream.schema("func string, args array<binary>, ts timestamp").parquet(source)
    run_queue(stream, Evaluator(store, reg), str(tmp_path / "ck")).awaitTermination()
    assert store.list_calls("test.add").count() == 2


def test_inlined_links(store, spark):
    two = node.to_ipld(2)[0]
    inner = node.to_ipld([two])[0]
    outer = node.to_ipld({"a": inner, "b": inner})[0]
    put(store, [two], {"a": inner, "b": inner})
    keys = spark.createDataFrame([(bytearray(outer.data),)], "cid binary")
    show = lambda d: node.from_json(store.inline(keys, d).first()["json"])
    assert show(0) == {"a": inner, "b": inner}
    assert show(1) == {"a": [two], "b": [two]}
    assert show(2) == show(5) == {"a": [2], "b": [2]}


def test_pass_fold(store, spark):
    reg = Registry()
    reg.register("pass.add", 2, lambda p, x: p + x)
    reg.register("pass.mul", 2, lambda p, x: p * x)
    ev = Evaluator(store, reg)
    start = spark.createDataFrame([(i, bytearray(node.to_ipld(i)[0].data)) for i in range(4)], "item int, cid binary")
    got = ev.fold(start, [("pass.add", node.to_ipld(1)[0].data), ("pass.mul", node.to_ipld(10)[0].data)])
    assert {r["item"]: node.from_ipld(CID(bytes(r["cid"]))) for r in got.collect()} == {i: (i + 1) * 10 for i in range(4)}


def test_node_files(spark, tmp_path):
    from cairnmark.sources import nodes

    (tmp_path / "a.bin").write_bytes(node.to_cbor([1, 2]) + node.to_cbor("x"))
    (tmp_path / "b.bin").write_bytes(b'{"map":{"k":1.0}}'.replace(b"1.0", b"1"))
    (tmp_path / "c.bin").write_bytes(b"\xff\xfe raw")
    got = sorted(r["json"] for r in nodes.read_nodes(spark, str(tmp_path / "*.bin")).collect())
    assert got == sorted(['[1,2]', '"x"', '{"map":{"k":1}}', node.to_json(b"\xff\xfe raw")])
    assert nodes.read_nodes(spark, str(tmp_path / "a.bin"), "cbor").count() == 2
    assert nodes.read_nodes(spark, str(tmp_path / "b.bin"), "json").first()["json"] == '{"map":{"k":1}}'
    assert nodes.read_nodes(spark, str(tmp_path / "c.bin"), "raw").first()["json"] == node.to_json(b"\xff\xfe raw")
    df = spark.createDataFrame([('"a"',), ('{"base64":"YQ=="}',)], "json string")
    assert [r[0] for r in df.select(nodes.plain_of_json("json")).collect()] == ["a", '{"base64":"YQ=="}']
    assert bytes(df.filter("json LIKE '%base64%'").select(nodes.raw_of_json("json")).first()[0]) == b"a"
    nodes.write_lines(df.selectExpr("json AS text"), str(tmp_path / "out"), ["text"])
    nodes.write_csv(df, str(tmp_path / "csv"))
    assert spark.read.text(str(tmp_path / "out")).count() == spark.read.csv(str(tmp_path / "csv"), header=True).count() == 2


def test_plans(spark):
    from cairnmark.plans.experiments import Plans

    p = Plans(spark, {"a": {"call": "id", "args": ["${var:b}"]}, "b": {"call": "id", "args": ["${var:a}"]}, "c": {"call": "id", "args": ["${var:none}"]}}, {})
    with pytest.raises(ValueError):
        p.get("a")
    with pytest.raises(KeyError):
        p.get("c")
