"""Registered queries of the engine's own operators over the driver's tables, with the equivalent SQL.

How the tables are read: documents.source is a module and documents.text a part; events are a log of heads (per user)
or of calls (func = event_type); lineitem rows are candidates (function = order, group = part, callee = supplier); the
foreign keys region < nation < customer < orders are links.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from cairnmark.functions import fields, multibase, names, node
from cairnmark.operators import analytics, candidates, graph, memo, resolve
from cairnmark.session import materialize, shared_dir, table
from cairnmark.sources import car, nodes
from cairnmark.sources.modules import Modules
from cairnmark.sources.store import Store, latest, open_store
from cairnmark.streaming import queue

from . import experiments

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
_TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _sql(name: str, spark_sql: str, oracle: str | None = None) -> None:
    """Register a query that is one declarative plan; tables are written {name} in both texts."""
    used = [t for t in _TABLES if "{" + t + "}" in spark_sql]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return spark.sql(spark_sql, **{t: table(spark, sf_dir, t) for t in used})

    QUERIES[name] = run
    ORACLES[name] = re.sub(r"\{(\w+)\}", r"\1", oracle or spark_sql)


def _query(oracle: str | None = None):
    """Register a query that goes through operators of the package."""

    def add(fn):
        QUERIES[fn.__name__] = fn
        if oracle:
            ORACLES[fn.__name__] = oracle
        return fn

    return add


# --- parts, modules, store ---


def _new_store(spark) -> Store:
    return open_store(spark, f"{shared_dir(spark)}/store-{uuid.uuid4().hex}", create=True)


def _modules(spark, sf_dir) -> Modules:
    """The documents as modules: source is the module, doc_id the place and name, text the part."""
    modules = Modules(_new_store(spark))
    modules.add(table(spark, sf_dir, "documents").select(F.col("source").alias("module"), F.col("doc_id").alias("pos"), F.col("doc_id").cast("string").alias("name"), "text"))
    return modules


def _hexed(modules: Modules, rows: DataFrame) -> DataFrame:
    """rows with the part's id replaced by the SHA-256 of the text that the store gives for it: what SQL can compare."""
    texts = modules.texts(rows).select(F.col("part").alias("id"), F.sha2("text", 256).alias("sha"))
    return rows.join(texts, F.col("part") == F.col("id")).drop("part", "id").withColumnRenamed("sha", "part")


@_query("""
WITH p AS (SELECT source AS module, sha256(text) AS part FROM documents),
c AS (SELECT part, count(*) AS copies, count(DISTINCT module) AS modules FROM p GROUP BY part)
SELECT p.module, count(*) AS num_parts, count(DISTINCT p.part) AS num_unique_parts,
       count(DISTINCT CASE WHEN c.modules > 1 THEN p.part END) AS num_shared_parts, CAST(sum(c.copies) AS BIGINT) AS total_copies
FROM p JOIN c ON p.part = c.part GROUP BY p.module""")
def module_sharing(spark, sf_dir):
    return _modules(spark, sf_dir).sharing()


@_query("SELECT sha256(text) AS cid, count(*) AS copies, min(doc_id) AS first_doc FROM documents GROUP BY 1")
def node_put_dedup(spark, sf_dir):
    modules = _modules(spark, sf_dir)
    rows = modules.manifest().groupBy("part").agg(F.count(F.lit(1)).alias("copies"), F.min("pos").alias("first_doc"))
    return _hexed(modules, rows).withColumnRenamed("part", "cid")


@_query("SELECT source AS module, sha256(text) AS part, count(*) AS copies FROM documents GROUP BY 1, 2")
def part_copies(spark, sf_dir):
    modules = _modules(spark, sf_dir)
    return _hexed(modules, modules.copies())


@_query("SELECT DISTINCT source AS module FROM documents")
def list_modules(spark, sf_dir):
    return _modules(spark, sf_dir).modules()


@_query("SELECT source AS module, doc_id AS name, sha256(text) AS part FROM documents")
def list_module_parts(spark, sf_dir):
    modules = _modules(spark, sf_dir)
    return _hexed(modules, modules.manifest().select("module", F.col("pos").alias("name"), "part"))


@_query("SELECT DISTINCT sha256(text) AS part FROM documents")
def list_all_parts(spark, sf_dir):
    modules = _modules(spark, sf_dir)
    return _hexed(modules, modules.part_ids())


@_query("SELECT sha256(text) AS part, min(text) AS text FROM documents WHERE doc_id IN (SELECT doc_id FROM labels) GROUP BY 1")
def get_part_by_id(spark, sf_dir):
    modules = _modules(spark, sf_dir)
    asked = modules.manifest().join(table(spark, sf_dir, "labels").select(F.col("doc_id").alias("pos")), "pos", "left_semi")
    return modules.texts(asked).select(F.sha2("text", 256).alias("part"), "text")


@_query("SELECT source AS module, sha256(string_agg(text, '' ORDER BY doc_id)) AS whole FROM documents GROUP BY 1")
def rejoin_module(spark, sf_dir):
    return _modules(spark, sf_dir).rejoin().select("module", F.sha2("text", 256).alias("whole"))


@_query("SELECT sha256(text) AS part, min(source) AS first_module, count(DISTINCT source) AS modules FROM documents GROUP BY 1")
def melt_parts(spark, sf_dir):
    modules = _modules(spark, sf_dir)
    return _hexed(modules, modules.melt())


@_query("SELECT doc_id, source AS module, first_value(doc_id) OVER (PARTITION BY sha256(text) ORDER BY doc_id) AS kept FROM documents")
def merge_dedup(spark, sf_dir):
    return _modules(spark, sf_dir).merged().select(F.col("pos").alias("doc_id"), "module", F.col("kept_pos").alias("kept"))


@_query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def head_latest(spark, sf_dir):
    log = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", F.struct("ts", "event_id").alias("seq"))
    return latest(log, ["user_id"]).select("user_id", "event_id", "event_type")


@_query("SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1 AND event_type <> 'error'")
def head_delete(spark, sf_dir):
    log = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", F.struct("ts", "event_id").alias("seq"))
    return latest(log, ["user_id"]).filter("event_type <> 'error'").select("user_id", "event_id")


_CALLS = "SELECT event_type AS func, user_id AS arg, max(event_id) AS result FROM events GROUP BY 1, 2"


def _int_cid(c) -> Column:
    return node.block_of_json(F.col(c).cast("string"))["cid"]


def _int_of(cid: Column) -> Column:
    return node.json_of_block(cid, node.inline_content(cid)).cast("long")


def _call_store(spark, sf_dir) -> Store:
    """Calls event_type(user_id) whose result is an event; the later half of the events is set after the earlier one."""
    store, e = _new_store(spark), table(spark, sf_dir, "events")
    rows = materialize(e.select("event_id", F.col("event_type").alias("func"), F.array(_int_cid("user_id")).alias("args"), _int_cid("event_id").alias("result")), "calls")
    half = rows.agg(F.max("event_id")).first()[0] // 2
    for part in ("event_id <= {}", "event_id > {}"):
        store.set_calls(rows.filter(part.format(half)))
    return store


def _shown(calls: DataFrame) -> DataFrame:
    return calls.select("func", _int_of(F.col("args")[0]).alias("arg"), _int_of(F.col("result")).alias("result"))


@_query(_CALLS)
def call_latest(spark, sf_dir):
    return _shown(_call_store(spark, sf_dir).calls)


@_query("SELECT DISTINCT event_type AS func FROM events")
def list_funcs(spark, sf_dir):
    return _call_store(spark, sf_dir).list_funcs()


@_query(f"SELECT * FROM ({_CALLS}) WHERE func = 'click'")
def list_calls(spark, sf_dir):
    return _shown(_call_store(spark, sf_dir).list_calls("click"))


@_query(f"SELECT * FROM ({_CALLS}) WHERE func <> 'click'")
def call_invalidate(spark, sf_dir):
    store = _call_store(spark, sf_dir)
    store.invalidate("click")
    return _shown(store.calls)


def _head_store(spark, sf_dir) -> Store:
    """Heads by user, each at the user's last event."""
    store = _new_store(spark)
    store.set_heads(table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("name"), _int_cid("event_id").alias("cid")))
    return store


@_query("SELECT concat('copy/', CAST(user_id AS VARCHAR(20))) AS name, max(event_id) AS cid FROM events GROUP BY user_id")
def copy_head(spark, sf_dir):
    store = _head_store(spark, sf_dir)
    store.copy_heads(store.heads.select(F.col("name").alias("source"), F.concat(F.lit("copy/"), "name").alias("target")))
    return store.heads.filter("name LIKE 'copy/%'").select("name", _int_of(F.col("cid")).alias("cid"))


@_query("SELECT CAST(user_id AS VARCHAR) AS name, max(event_id) AS cid FROM events GROUP BY 1 ORDER BY encode(CAST(user_id AS VARCHAR)) LIMIT 25")
def first_heads(spark, sf_dir):
    return _head_store(spark, sf_dir).list_heads(25).select("name", _int_of(F.col("cid")).alias("cid"))


_USES = """
SELECT n_nationkey AS cid, 'customer' AS kind, c_custkey AS id FROM nation JOIN customer ON c_nationkey = n_nationkey
UNION ALL SELECT n_nationkey, 'supplier', s_suppkey FROM nation JOIN supplier ON s_nationkey = n_nationkey
UNION ALL SELECT n_nationkey, 'region', CAST(n_regionkey AS BIGINT) FROM nation"""


@_query(_USES)
def names_using(spark, sf_dir):
    store, n = _new_store(spark), table(spark, sf_dir, "nation")
    nation = F.to_json(F.struct(F.struct(F.col("n_name").alias("name"), F.concat(F.lit("key "), F.col("n_nationkey").cast("string")).alias("key")).alias("map")))
    rows = materialize(n.select("n_nationkey", "n_regionkey", node.block_of_json(nation)["cid"].alias("cid")), "nations")
    store.put(n.select(nation.alias("json")))
    link = lambda c: F.struct(multibase.encode_column(c).alias("cid"))

    def holder(kind: str, df: DataFrame, key: str, nation_key: str) -> DataFrame:
        at = df.join(rows, F.col(nation_key) == F.col("n_nationkey"))
        return at.select(F.to_json(F.struct(F.struct(F.col(key).alias("id"), F.lit(kind).alias("kind"), F.array(link(F.col("cid"))).alias("nations")).alias("map"))).alias("json"))

    region = rows.groupBy("n_regionkey").agg(F.sort_array(F.collect_list("cid")).alias("cids")).select(F.to_json(F.struct(F.struct(
        F.col("n_regionkey").alias("id"), F.lit("region").alias("kind"), F.transform(F.col("cids"), lambda c: F.struct(F.concat(F.lit("u"), F.translate(F.rtrim(F.base64(c), F.lit("=")), "+/", "-_")).alias("cid"))).alias("nations")).alias("map"))).alias("json"))
    holders = holder("customer", table(spark, sf_dir, "customer"), "c_custkey", "c_nationkey").unionByName(holder("supplier", table(spark, sf_dir, "supplier"), "s_suppkey", "s_nationkey"))
    store.put(holders.unionByName(region))
    used = store.names_using(rows.select("cid")).filter("kind = 'block'").select(F.col("cid").alias("nation"), F.col("src").alias("cid"))
    text = store.get(used.select("cid").distinct())
    found = used.join(text, "cid").join(rows.select(F.col("cid").alias("nation"), "n_nationkey"), "nation")
    return found.select(F.col("n_nationkey").alias("cid"), F.get_json_object("json", "$.map.kind").alias("kind"), F.get_json_object("json", "$.map.id").cast("long").alias("id"))


def _half_stored(spark, sf_dir) -> tuple[Store, DataFrame]:
    """A store of the texts of even documents, and the ids of all: (doc_id, text, cid)."""
    store = _new_store(spark)
    d = materialize(table(spark, sf_dir, "documents").select("doc_id", "text", node.block_of_text("text").alias("b")), "ids")
    store.put_blocks(d.filter("doc_id % 2 = 0").select("b.*"))
    return store, d.select("doc_id", "text", "b.cid")


@_query("SELECT doc_id FROM documents WHERE strlen(text) > 32 AND sha256(text) IN (SELECT sha256(text) FROM documents WHERE doc_id % 2 = 0)")
def has_blocks(spark, sf_dir):
    store, ids = _half_stored(spark, sf_dir)
    return ids.filter("octet_length(text) > 32").join(store.has(ids.select("cid").distinct()), "cid", "left_semi").select("doc_id")


@_query("SELECT sha256(text) AS part FROM documents WHERE doc_id % 2 = 0 AND strlen(text) > 32 AND sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE doc_id % 3 = 0) GROUP BY 1")
def garbage_parts(spark, sf_dir):
    store, ids = _half_stored(spark, sf_dir)
    store.set_heads(ids.filter("doc_id % 3 = 0").select(F.col("doc_id").cast("string").alias("name"), "cid"))
    return store.garbage().select(F.sha2(node.text_of_block("cid", "content"), 256).alias("part"))


# --- memo ---

_REQ, _CACHED = ["l_partkey", "l_suppkey"], "SELECT DISTINCT l_partkey, l_suppkey FROM lineitem WHERE l_linenumber = 1"


def _requests(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    return li.filter("l_linenumber <> 1").select(*_REQ), li.filter("l_linenumber = 1").select(*_REQ)


@_query(f"SELECT l_partkey, l_suppkey FROM lineitem WHERE l_linenumber <> 1 AND (l_partkey, l_suppkey) IN ({_CACHED})")
def memo_hits(spark, sf_dir):
    return memo.hits(*_requests(spark, sf_dir), _REQ)


@_query(f"SELECT DISTINCT l_partkey, l_suppkey FROM lineitem WHERE l_linenumber <> 1 AND (l_partkey, l_suppkey) NOT IN ({_CACHED})")
def memo_misses(spark, sf_dir):
    return memo.misses(*_requests(spark, sf_dir), _REQ)


@_query("SELECT l_partkey, l_suppkey, count(*) AS asked FROM lineitem GROUP BY 1, 2")
def pending_dedupe(spark, sf_dir):
    return memo.pending(table(spark, sf_dir, "lineitem"), _REQ)


@_query("SELECT o_orderkey, CASE WHEN o_orderstatus <> 'O' THEN 'status=' || o_orderstatus ELSE '' END || CASE WHEN o_orderpriority <> '5-LOW' THEN ';priority=' || o_orderpriority ELSE '' END AS cache_key FROM orders")
def option_key(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    options = F.create_map(F.lit("status"), "o_orderstatus", F.lit("priority"), "o_orderpriority")
    kept = memo.normalized_options(options, {"status": "O", "priority": "5-LOW"})
    text = lambda k: F.try_element_at(kept, F.lit(k))
    return o.select("o_orderkey", F.concat(F.coalesce(F.concat(F.lit("status="), text("status")), F.lit("")), F.coalesce(F.concat(F.lit(";priority="), text("priority")), F.lit(""))).alias("cache_key"))


def _called(spark, func: str, args: DataFrame, columns: list[str]) -> DataFrame:
    """args (integers) with the result of a registered function of some of its columns, through a store of calls."""
    keyed = materialize(args.select("*", F.array(*[_int_cid(c) for c in columns]).alias("args")), "args")
    done = memo.Evaluator(_new_store(spark), memo.TEST_FUNCS).evaluate(keyed.select(F.lit(func).alias("func"), "args"))
    return keyed.join(done.select("args", _int_of(F.col("result")).alias("result")), "args").drop("args")


@_query("SELECT c_custkey, c_custkey + c_nationkey AS total FROM customer")
def call_add(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    return _called(spark, "test.add", c, ["c_custkey", "c_nationkey"]).select("c_custkey", F.col("result").alias("total"))


@_query("SELECT DISTINCT CAST(l_linenumber AS BIGINT) AS n, CAST(l_linenumber * (l_linenumber + 1) / 2 AS BIGINT) AS total FROM lineitem WHERE l_linenumber <= 3")
def call_nested(spark, sf_dir):
    n = table(spark, sf_dir, "lineitem").filter("l_linenumber <= 3").select(F.col("l_linenumber").cast("long").alias("n")).distinct()
    return _called(spark, "test.sum_to", n, ["n"]).select("n", F.col("result").alias("total"))


@_query("SELECT 7 AS n, 40 AS solutions")
def call_nqueens(spark, sf_dir):
    return memo.queens(spark, 7).select(F.lit(7).alias("n"), F.col("solutions").cast("int").alias("solutions"))


@_query("SELECT * FROM (VALUES (0, 3, 4), (1, 4, 6), (2, 2, 7), (3, 3, 61)) t(m, n, result)")
def call_ackermann(spark, sf_dir):
    args = spark.createDataFrame([(0, 3), (1, 4), (2, 2), (3, 3)], "m int, n int")
    return _called(spark, "test.ackermann", args, ["m", "n"]).select("m", "n", F.col("result").cast("int").alias("result"))


# --- navigation, graphs ---


@_query("""
SELECT '/region/' || r_name || '/nation/' || n_name || '/customer/' || CAST(c_custkey AS VARCHAR) AS path, c_custkey FROM customer
JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""")
def paths_to(spark, sf_dir):
    r, n, c = (table(spark, sf_dir, t) for t in ("region", "nation", "customer"))
    node_of = lambda kind, key: F.concat(F.lit(kind + ":"), F.col(key).cast("string"))
    edges = n.select(node_of("r", "n_regionkey").alias("src"), node_of("n", "n_nationkey").alias("dst"), F.concat(F.lit("/nation/"), "n_name").alias("step"))
    edges = edges.unionByName(c.select(node_of("n", "c_nationkey").alias("src"), node_of("c", "c_custkey").alias("dst"), F.concat(F.lit("/customer/"), F.col("c_custkey").cast("string")).alias("step")))
    roots = r.select(node_of("r", "r_regionkey").alias("node"), F.concat(F.lit("/region/"), "r_name").alias("root"))
    found = graph.paths_to(edges, c.select(node_of("c", "c_custkey").alias("node")), roots)
    return found.select(F.concat("root", F.array_join("steps", "")).alias("path"), F.split("target", ":")[1].cast("long").alias("c_custkey"))


_EDGES = """SELECT 'o' || CAST(o_orderkey AS STRING) AS src, 'c' || CAST(o_custkey AS STRING) AS dst FROM {orders}
UNION ALL SELECT 'c' || CAST(c_custkey AS STRING), 'n' || CAST(c_nationkey AS STRING) FROM {customer}
UNION ALL SELECT 'n' || CAST(n_nationkey AS STRING), 'r' || CAST(n_regionkey AS STRING) FROM {nation}"""


def _edges(spark, sf_dir):
    return spark.sql(_EDGES, **{t: table(spark, sf_dir, t) for t in ("orders", "customer", "nation")})


_EDGES_SQL = re.sub(r"\{(\w+)\}", r"\1", _EDGES).replace("STRING", "VARCHAR")
_REACH = f"""WITH RECURSIVE e AS ({_EDGES_SQL}), r(node) AS (
SELECT 'o' || CAST(o_orderkey AS VARCHAR) FROM orders WHERE o_orderpriority = '1-URGENT' UNION SELECT e.dst FROM r JOIN e ON e.src = r.node) SELECT node FROM r"""


@_query(_REACH)
def closure(spark, sf_dir):
    roots = table(spark, sf_dir, "orders").filter("o_orderpriority = '1-URGENT'").select(F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("node"))
    return graph.closure(_edges(spark, sf_dir), roots)


@_query(f"WITH reach AS ({_REACH}), e AS ({_EDGES_SQL}), n AS (SELECT src AS node FROM e UNION SELECT dst FROM e) SELECT n.node, r.node IS NOT NULL AS flag FROM n LEFT JOIN reach r ON r.node = n.node")
def fixpoint_flags(spark, sf_dir):
    edges = _edges(spark, sf_dir)
    urgent = table(spark, sf_dir, "orders").filter("o_orderpriority = '1-URGENT'").select(F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("node"), F.lit(True).alias("flag"))
    nodes = edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct().join(urgent, "node", "left").select("node", F.coalesce("flag", F.lit(False)).alias("flag"))
    return graph.propagate_flags(nodes, edges)


@_query("SELECT event_id AS node, CASE WHEN event_id % 10 < 5 THEN event_id - event_id % 10 ELSE event_id END AS scc FROM events")
def scc(spark, sf_dir):
    # of each ten events, five make a ring and lead on to the other five, which make a chain
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("src"))
    k = F.col("src") % 10
    edges = e.select("src", F.explode(F.when(k == 4, F.array(F.col("src") - 4, F.col("src") + 1)).when(k < 9, F.array(F.col("src") + 1))).alias("dst"))
    return graph.strong_components(edges)


_OPEN, _CLOSE = "chr(123)", "chr(125)"
_Q = "'\"' || {} || '\"'"


def _map_json(**fields: str) -> str:
    """SQL of the JSON of a map node whose fields are SQL of JSON."""
    inner = " || ',' || ".join(f"'\"{k}\":' || {v}" for k, v in fields.items())
    return f"{_OPEN} || '\"map\":' || {_OPEN} || {inner} || {_CLOSE} || {_CLOSE}"


_REGION = _map_json(name="'\"' || r_name || '\"'")
_NATION = _map_json(name="'\"' || n_name || '\"'", region=_REGION)
# the id of a region's node holds the node itself: CBOR of a map of one member
_REGION_CID = "'u' || rtrim(translate(to_base64(unhex('017100' || printf('%02x', 7 + strlen(r_name)) || 'a1646e616d65' || printf('%02x', 96 + strlen(r_name)) || hex(encode(r_name)))), '+/', '-_'), '=')"
_REGION_LINK = f"{_OPEN} || '\"cid\":\"' || {_REGION_CID} || '\"' || {_CLOSE}"


def _linked(spark, sf_dir) -> tuple[Store, DataFrame, DataFrame]:
    """A store of nodes customer > nation > region, and the ids (key, cid) of nations and of customers."""
    store = _new_store(spark)

    def put(rows: DataFrame, key: str, json: Column) -> DataFrame:
        rows = rows.select(F.col(key).alias("key"), json.alias("json"))
        return materialize(rows.join(store.put(rows), "json").select("key", "cid"), "nodes")

    def under(df: DataFrame, up: DataFrame, on: str, key: str, name: str, field: str) -> DataFrame:
        link = F.struct(multibase.encode_column(F.col("cid")).alias("cid")).alias(field)
        return put(df.join(up.withColumnRenamed("key", on), on), key, F.to_json(F.struct(F.struct(F.col(name).alias("name"), link).alias("map"))))

    regions = put(table(spark, sf_dir, "region"), "r_regionkey", F.to_json(F.struct(F.struct(F.col("r_name").alias("name")).alias("map"))))
    nations = under(table(spark, sf_dir, "nation"), regions, "n_regionkey", "n_nationkey", "n_name", "region")
    return store, nations, under(table(spark, sf_dir, "customer"), nations, "c_nationkey", "c_custkey", "c_name", "nation")


def _inlined(store: Store, ids: DataFrame, key: str, depth: int) -> DataFrame:
    return ids.join(store.inline(ids.select("cid").distinct(), depth), "cid").select(F.col("key").alias(key), "json")


@_query(f"SELECT n_nationkey, {_map_json(name=_Q.format('n_name'), region=_REGION_LINK)} AS json FROM nation JOIN region ON n_regionkey = r_regionkey")
def deref_depth0(spark, sf_dir):
    store, nations, _ = _linked(spark, sf_dir)
    return _inlined(store, nations, "n_nationkey", 0)


@_query(f"SELECT n_nationkey, {_NATION} AS json FROM nation JOIN region ON n_regionkey = r_regionkey")
def deref_depth1(spark, sf_dir):
    store, nations, _ = _linked(spark, sf_dir)
    return _inlined(store, nations, "n_nationkey", 1)


@_query(f"SELECT c_custkey, {_map_json(name=_Q.format('c_name'), nation=_NATION)} AS json FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def deref_depth2(spark, sf_dir):
    store, _, customers = _linked(spark, sf_dir)
    return _inlined(store, customers, "c_custkey", 2)


def _props(spark, sf_dir) -> DataFrame:
    """event_id, event_type, value, json: the properties of an event as a map node."""
    e = table(spark, sf_dir, "events")
    return e.select("event_id", "event_type", "value", F.concat(F.lit('{"map":'), "props", F.lit("}")).alias("json"))


@_query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, coalesce(json_extract_string(props, '$.none'), 'absent') AS missing, 'null' AS none FROM events")
def json_props_get(spark, sf_dir):
    j = F.col("json")
    return _props(spark, sf_dir).select("event_id", fields.at(j, "k").cast("long").alias("k"), F.replace(fields.get_value_or(j, "none", '"absent"'), F.lit('"'), F.lit("")).alias("missing"), fields.at_or_null(j, "none").alias("none"))


@_query("""SELECT event_id, json_extract(props, '$.k') IS NOT NULL AS has_k, false AS has_x, chr(123) || '"map":' || chr(123) || '"k":' || (json_extract(props, '$.k') :: VARCHAR) || ',"user":"x"' || chr(125) || chr(125) AS edited,
chr(123) || '"map":' || chr(123) || chr(125) || chr(125) AS dropped, '[1,2,' || (json_extract(props, '$.k') :: VARCHAR) || ']' AS list, json_extract(props, '$.k') :: VARCHAR AS last, 3 :: BIGINT AS elements FROM events""")
def node_edits(spark, sf_dir):
    j = F.col("json")
    rows = _props(spark, sf_dir).withColumn("list", fields.appended(fields.concatenated(F.lit("[1]"), F.lit("[2]")), fields.at(j, "k")))
    return rows.select("event_id", fields.contains(j, "k").alias("has_k"), fields.contains(j, "x").alias("has_x"), fields.with_field(j, "user", '"x"').alias("edited"), fields.without_field(j, "k").alias("dropped"), "list",
                       fields.element(F.col("list"), -1).alias("last"), fields.size(F.col("list")).alias("elements"))


@_query("SELECT doc_id, strlen(text) AS size, strlen(text) = 0 AS empty FROM documents")
def size_and_empty(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", node.block_of_text("text").alias("b")).select("doc_id", node.json_of_block("b.cid", "b.content").alias("json"))
    return d.select("doc_id", fields.size(F.col("json")).alias("size"), fields.is_empty(F.col("json")).alias("empty"))


# --- candidates ---

_CAND = "SELECT l_orderkey AS func, CAST(l_partkey AS STRING) AS group_key, l_suppkey AS callee, l_linenumber AS callee_size, CAST(l_quantity AS BIGINT) AS caller_savings FROM {lineitem}"
_CAND_SQL = _CAND.replace("STRING", "VARCHAR").replace("{lineitem}", "lineitem")


def _cands(spark, sf_dir):
    return spark.sql(_CAND, lineitem=table(spark, sf_dir, "lineitem"))


_GROUPS = f"SELECT group_key, CAST(sum(caller_savings) AS BIGINT) AS total_caller_savings, min(callee_size) AS min_callee_size, count(*) AS num_members FROM ({_CAND_SQL}) GROUP BY 1"


@_query(_GROUPS)
def grouped_candidates(spark, sf_dir):
    return analytics.group_candidates(_cands(spark, sf_dir))


@_query(f"SELECT * FROM ({_GROUPS}) WHERE total_caller_savings > min_callee_size")
def worth_extracting(spark, sf_dir):
    return analytics.worth_extracting(analytics.group_candidates(_cands(spark, sf_dir)))


@_query(f"""WITH d AS (SELECT DISTINCT func, group_key, callee FROM ({_CAND_SQL})), n AS (SELECT group_key, callee, count(*) AS n FROM d GROUP BY 1, 2)
SELECT g.*, u.num_unique_callees, u.num_callees_without_duplicates FROM ({_GROUPS}) g
JOIN (SELECT group_key, count(*) AS num_unique_callees, count(CASE WHEN n = 1 THEN 1 END) AS num_callees_without_duplicates FROM n GROUP BY 1) u ON u.group_key = g.group_key""")
def grouped_callees(spark, sf_dir):
    c = _cands(spark, sf_dir).withColumn("nodes", F.lit(0))
    return analytics.group_callees(c, analytics.group_candidates(c))


@_query(f"""SELECT count(*) AS groups, CAST(sum(num_members) AS BIGINT) AS members, count(CASE WHEN num_members = 1 THEN 1 END) AS singletons,
count(CASE WHEN total_caller_savings > min_callee_size THEN 1 END) AS profitable_groups,
CAST(sum(CASE WHEN total_caller_savings > min_callee_size THEN num_members ELSE 0 END) AS BIGINT) AS profitable_members,
max(num_members) AS largest, arg_max(group_key, num_members * 1000000000000 - CAST(group_key AS BIGINT)) AS largest_group FROM ({_GROUPS})""")
def candidate_report(spark, sf_dir):
    groups = analytics.group_candidates(_cands(spark, sf_dir)).withColumn("group_key", F.col("group_key").cast("long"))
    return analytics.candidate_report(groups).withColumn("largest_group", F.col("largest_group").cast("string"))


_CALLEES = f"""WITH d AS (SELECT DISTINCT func, group_key, callee FROM ({_CAND_SQL})), n AS (SELECT group_key, callee, count(*) AS n FROM d GROUP BY 1, 2)
SELECT g.*, u.num_unique_callees, u.num_callees_without_duplicates FROM ({_GROUPS}) g
JOIN (SELECT group_key, count(*) AS num_unique_callees, count(CASE WHEN n = 1 THEN 1 END) AS num_callees_without_duplicates FROM n GROUP BY 1) u ON u.group_key = g.group_key"""


def _callee_groups(spark, sf_dir) -> DataFrame:
    c = _cands(spark, sf_dir).withColumn("nodes", F.lit(0))
    return analytics.group_callees(c, analytics.group_candidates(c))


@_query(f"SELECT CAST(sum(num_members) AS BIGINT) AS members, CAST(sum(num_unique_callees) AS BIGINT) AS unique_callees, CAST(sum(num_callees_without_duplicates) AS BIGINT) AS callees_without_duplicates FROM ({_CALLEES})")
def callee_report(spark, sf_dir):
    return analytics.callee_report(_callee_groups(spark, sf_dir))


@_query(f"SELECT * FROM ({_CALLEES}) WHERE num_unique_callees < num_members")
def duplicated_groups(spark, sf_dir):
    return analytics.duplicated(_callee_groups(spark, sf_dir))


@_query("""WITH s AS (SELECT l_suppkey AS callee, min(l_linenumber) AS actual FROM lineitem WHERE l_suppkey % 3 > 0 GROUP BY 1)
SELECT l_orderkey, l_linenumber, l_suppkey AS callee, CAST(coalesce(s.actual, l_linenumber + 2) AS BIGINT) AS callee_size, CAST(CAST(l_quantity AS BIGINT) + least(0, coalesce(s.actual, l_linenumber + 2) - l_linenumber - 2) AS BIGINT) AS caller_savings
FROM lineitem LEFT JOIN s ON s.callee = l_suppkey""")
def remeasured_savings(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    c = li.select("l_orderkey", "l_linenumber", F.col("l_suppkey").alias("callee"), (F.col("l_linenumber") + 2).cast("long").alias("callee_size"), F.col("l_quantity").cast("long").alias("caller_savings"))
    sizes = li.filter("l_suppkey % 3 > 0").groupBy(F.col("l_suppkey").alias("callee")).agg(F.min("l_linenumber").cast("long").alias("actual"))
    return analytics.remeasured(c, sizes)


@_query("""WITH b AS (SELECT s_suppkey AS item, min(s_suppkey) OVER (PARTITION BY s_nationkey) AS best FROM supplier WHERE s_suppkey % 2 = 0)
SELECT l_orderkey, l_linenumber, l_suppkey AS callee, coalesce(b.best, l_suppkey) AS refined FROM lineitem LEFT JOIN b ON b.item = l_suppkey""")
def refined_callees(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").filter("s_suppkey % 2 = 0").select(F.col("s_nationkey").alias("class"), F.col("s_suppkey").alias("item"), F.lit(1).alias("size"))
    better = s.join(analytics.representatives(s), "class").select("item", "best")
    return analytics.refined(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_suppkey").alias("callee")), better)


@_query("SELECT p_partkey AS item FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_linenumber > 2)")
def unproven_items(spark, sf_dir):
    proven = table(spark, sf_dir, "lineitem").filter("l_linenumber > 2").select(F.col("l_partkey").alias("item"))
    return analytics.unproven(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("item")), proven)


@_query("SELECT l_orderkey, l_linenumber, CAST(l_linenumber + l_suppkey % 5 - 2 AS BIGINT) AS callee_size, CAST(l_quantity AS BIGINT) + least(0, l_suppkey % 5 - 2) AS caller_savings FROM lineitem")
def size_correction(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    actual = F.col("l_linenumber") + F.col("l_suppkey") % 5 - 2
    return li.select("l_orderkey", "l_linenumber", *analytics.corrected(F.col("l_linenumber"), F.col("l_quantity").cast("long"), actual))


@_query("SELECT o_orderkey, CAST(floor((row_number() OVER (PARTITION BY o_custkey % 10 ORDER BY o_orderdate, o_orderkey) - 1) / 64) AS BIGINT) AS batch FROM orders")
def batches_of_64(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumn("p", F.col("o_custkey") % 10)
    return analytics.batches(o, ["p"], ["o_orderdate", "o_orderkey"]).select("o_orderkey", F.col("batch").cast("long").alias("batch"))


_RUNS = """SELECT k, string_agg(CAST(s AS VARCHAR) || '-' || CAST(e AS VARCHAR), ',' ORDER BY s) AS nodes FROM (
SELECT k, min(event_id) AS s, max(event_id) + 1 AS e FROM (
SELECT event_type AS k, event_id, event_id - row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS i FROM events) GROUP BY k, i) GROUP BY k"""


def _runs(spark, sf_dir):
    return analytics.encode_runs(table(spark, sf_dir, "events").select(F.col("event_type").alias("k"), "event_id"), ["k"], "event_id")


@_query(_RUNS)
def nodeset_encode(spark, sf_dir):
    ends = F.transform(F.sequence(F.lit(0), (F.size("nodes") / 2 - 1).cast("int")), lambda i: F.concat_ws("-", F.element_at("nodes", 2 * i + 1).cast("string"), F.element_at("nodes", 2 * i + 2).cast("string")))
    return _runs(spark, sf_dir).select("k", F.array_join(ends, ",").alias("nodes"))


@_query("SELECT event_type AS k, event_id AS node FROM events")
def nodeset_decode(spark, sf_dir):
    return analytics.decode_runs(_runs(spark, sf_dir)).select("k", "node")


_SPAN = "SELECT user_id AS func, event_id AS cand, event_id AS s, event_id + 40 AS e FROM {t}"


def _spans(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("func"), F.col("event_id").alias("cand"), F.array(F.col("event_id"), F.col("event_id") + 40).alias("nodes"),
                    (F.col("user_id") * 10 + F.col("event_id") % 5).alias("callee"), (F.col("event_id") % 7 + 1).alias("callee_size"), (F.col("event_id") % 11).alias("caller_savings"))


_PAIRS = f"SELECT a.cand AS a, b.cand AS b FROM ({_SPAN.format(t='events')}) a JOIN ({_SPAN.format(t='events')}) b ON a.func = b.func AND a.cand < b.cand AND b.s < a.e AND a.s < b.e"


@_query(_PAIRS)
def overlap_pairs(spark, sf_dir):
    return analytics.overlaps(_spans(spark, sf_dir))


@_query(f"""WITH p AS ({_PAIRS}), t AS (SELECT a AS cand FROM p UNION SELECT b FROM p),
c AS (SELECT event_id AS cand, user_id * 10 + event_id % 5 AS callee, event_id % 7 + 1 AS callee_size, event_id % 11 AS caller_savings FROM events),
g AS (SELECT callee, CAST(sum(caller_savings) AS BIGINT) AS savings, min(callee_size) AS size, CAST(sum(CASE WHEN t.cand IS NULL THEN caller_savings ELSE 0 END) AS BIGINT) AS free_savings FROM c LEFT JOIN t ON t.cand = c.cand GROUP BY 1)
SELECT *, savings <= size AS useless, free_savings > size AS always_profitable FROM g""")
def ilp_presolve(spark, sf_dir):
    c = _spans(spark, sf_dir)
    return analytics.presolve(c, analytics.overlaps(c))


@_query()
def greedy_solution(spark, sf_dir):
    return analytics.greedy_selection(_spans(spark, sf_dir)).select("cand", "func", "callee", "callee_size", "caller_savings")


@_query()
def ilp_problem(spark, sf_dir):
    c = _spans(spark, sf_dir)
    return analytics.selection_program(c, analytics.overlaps(c))


_sql("contiguous_windows", """
SELECT o_orderkey, count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS reach,
       max(CASE WHEN o_orderstatus = 'F' THEN o_orderkey END) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS stop FROM {orders}""")
@_query("SELECT event_id FROM (SELECT event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events) WHERE before IS NULL OR before <> event_type")
def redundant_rows(spark, sf_dir):
    return analytics.changed(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], "event_type").select("event_id")


@_query("SELECT l_partkey AS var, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS coefficient FROM lineitem GROUP BY 1")
def lp_terms(spark, sf_dir):
    return analytics.linear_terms(table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("var"), F.col("l_quantity").cast("long").alias("k")))


def _savings(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("callee"), F.col("l_linenumber").alias("callee_size"), F.col("l_quantity").cast("long").alias("caller_savings"))


@_query("SELECT l_suppkey AS callee, CAST(sum(CASE WHEN l_quantity > 10 THEN CAST(l_quantity AS BIGINT) ELSE 0 END) - min(l_linenumber) AS BIGINT) AS benefit FROM lineitem GROUP BY 1")
def callee_benefit(spark, sf_dir):
    return analytics.benefits(_savings(spark, sf_dir), eligible=F.col("caller_savings") > 10)


@_query("SELECT callee, benefit FROM (SELECT l_suppkey AS callee, CAST(sum(CAST(l_quantity AS BIGINT)) - min(l_linenumber) AS BIGINT) AS benefit FROM lineitem GROUP BY 1) WHERE benefit > 0 ORDER BY benefit DESC, callee LIMIT 1")
def best_callee(spark, sf_dir):
    return analytics.best_callee(analytics.benefits(_savings(spark, sf_dir)))


@_query("SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING count(CASE WHEN l_returnflag = 'R' THEN 1 END) = 0 AND count(*) > 1")
def outlinable(spark, sf_dir):
    line, none = F.col("l_linenumber").cast("int"), F.array().cast("array<int>")
    sets = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(line).alias("nodes"), F.collect_list(F.when(F.col("l_returnflag") == "R", line)).alias("forbidden"))
    sets = sets.select("*", none.alias("forced"), none.alias("dominating"), none.alias("dominators"))
    return sets.filter(candidates.outlinable(sets) & (F.size("nodes") > 1)).select("l_orderkey")


@_query("SELECT d.doc_id, coalesce(l.quality, -1) AS replacement FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id")
def rewritten_callers(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.lit("m").alias("module"), F.col("doc_id").alias("name"), F.col("doc_id").alias("key"), F.lit(-1).cast("long").alias("part"))
    new = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("key"), F.col("quality").cast("long").alias("new_part"))
    return candidates.rewrite(d, new, key="key").select(F.col("name").alias("doc_id"), F.col("part").alias("replacement"))


# --- symbols ---

_DEFS = """SELECT CAST(p_size AS STRING) AS module, 's' || CAST(p_partkey % 1700 AS STRING) AS name, CASE WHEN p_partkey % 3 = 0 THEN 'local' WHEN p_partkey % 3 = 1 THEN 'weak' ELSE 'strong' END AS linkage FROM {part}"""
_DEFS_SQL = _DEFS.replace("STRING", "VARCHAR").replace("{part}", "part")
_RF = "SELECT CAST((p_size + 1) % 50 + 1 AS STRING) AS module, CAST(p_partkey AS STRING) AS name, 's' || CAST(p_partkey * 7 % 2300 AS STRING) AS ref FROM {part}"
_RF_SQL = _RF.replace("STRING", "VARCHAR").replace("{part}", "part")


def _symbols(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return spark.sql(_RF, part=p), spark.sql(_DEFS, part=p)


_OWN = f"SELECT r.*, CASE WHEN EXISTS (SELECT 1 FROM ({_DEFS_SQL}) d WHERE d.module = r.module AND d.name = r.ref) THEN r.module END AS target FROM ({_RF_SQL}) r"


@_query(_OWN)
def resolve_merge(spark, sf_dir):
    return resolve.resolve_merge(*_symbols(spark, sf_dir))


_ONE = f"SELECT name, min(module) AS module FROM ({_DEFS_SQL}) WHERE linkage <> 'local' GROUP BY name HAVING count(*) = 1"


@_query(_ONE)
def resolve_unique(spark, sf_dir):
    return resolve.unique_globals(_symbols(spark, sf_dir)[1])


@_query(f"SELECT o.module, o.name, o.ref, coalesce(o.target, u.module) AS target FROM ({_OWN}) o LEFT JOIN ({_ONE}) u ON u.name = o.ref")
def resolve_guided(spark, sf_dir):
    return resolve.resolve_guided(*_symbols(spark, sf_dir))


_WEAK = f"SELECT name, min(CASE WHEN linkage = 'strong' THEN module END) AS s, min(CASE WHEN linkage = 'weak' THEN module END) AS w, count(CASE WHEN linkage = 'strong' THEN 1 END) AS n FROM ({_DEFS_SQL}) GROUP BY name"


@_query(f"SELECT o.module, o.name, o.ref, coalesce(o.target, d.s, d.w) AS target FROM ({_OWN}) o LEFT JOIN ({_WEAK}) d ON d.name = o.ref WHERE coalesce(d.n, 0) <= 1")
def resolve_mux(spark, sf_dir):
    refs, defs = _symbols(spark, sf_dir)
    clash = defs.filter("linkage = 'strong'").groupBy("name").count().filter("count > 1").select(F.col("name").alias("ref"))
    return resolve.resolve_mux(refs.join(clash, "ref", "left_anti").select("module", "name", "ref"), defs)


# definitions: a part has the size as content and refers to two others of its module; renaming leaves 7 names of each
_TREE = """WITH RECURSIVE p AS (SELECT p_partkey, p_partkey % 40 AS m, p_partkey // 40 AS k, CAST(p_size % 3 AS VARCHAR) AS content FROM part),
d AS (SELECT CAST(m AS VARCHAR) AS module, CAST(k AS VARCHAR) AS name, content, CAST(2 * k + 1 AS VARCHAR) AS a, CAST(2 * k + 2 AS VARCHAR) AS b, k, m FROM p),
depth AS (SELECT max(k) AS k FROM d),
t(round, module, name, sig) AS (
SELECT 0, module, name, sha256(content) FROM d
UNION ALL SELECT t.round + 1, d.module, d.name, sha256(d.content || '|' || coalesce(a.sig, '@' || d.a) || '|' || coalesce(b.sig, '@' || d.b))
FROM (SELECT DISTINCT round FROM t) r JOIN t ON t.round = r.round JOIN d ON d.module = t.module AND d.name = t.name
LEFT JOIN t a ON a.module = d.module AND a.name = d.a LEFT JOIN t b ON b.module = d.module AND b.name = d.b WHERE t.round < 12)
SELECT module, name, first_value(module) OVER w AS class_module, first_value(name) OVER w AS class_name FROM t WHERE round = 12 WINDOW w AS (PARTITION BY sig ORDER BY module, name)"""


@_query(_TREE)
def dedupe_up_to_renaming(spark, sf_dir):
    # every module is a binary tree of parts: k refers to 2 k + 1 and 2 k + 2, in this order
    p = table(spark, sf_dir, "part").select((F.col("p_partkey") % 40).cast("string").alias("module"), F.floor(F.col("p_partkey") / 40).alias("k"), (F.col("p_size") % 3).cast("string").alias("content"))
    d = p.select("module", F.col("k").cast("string").alias("name"), "content")
    refs = p.select("module", F.col("k").cast("string").alias("name"), F.explode(F.array(F.lit(1), F.lit(2))).alias("pos"), "k").withColumn("ref", (2 * F.col("k") + F.col("pos")).cast("string")).drop("k")
    return resolve.dedupe_up_to_renaming(d, refs)


_sql("symbol_list", "SELECT page_id, host FROM (SELECT page_id, regexp_extract(url, '://([^/]*)', 1) AS host FROM {pages}) WHERE EXISTS (SELECT 1 FROM (VALUES ('www\\\\..*'), ('.*\\\\.example\\\\.org')) g(p) WHERE host RLIKE p)",
     "SELECT page_id, host FROM (SELECT page_id, regexp_extract(url, '://([^/]*)', 1) AS host FROM {pages}) WHERE regexp_matches(host, 'www\\..*') OR regexp_matches(host, '.*\\.example\\.org')")
_sql("equivalence_clusters", "SELECT doc_id, min(doc_id) OVER (PARTITION BY sha2(lower(regexp_replace(text, '[^A-Za-z]+', '')), 256)) AS class FROM {documents}",
     "SELECT doc_id, min(doc_id) OVER (PARTITION BY sha256(lower(regexp_replace(text, '[^A-Za-z]+', '', 'g')))) AS class FROM {documents}")


@_query("SELECT class, arg_min(item, size * 1000000000 + item) AS best FROM (SELECT source AS class, doc_id AS item, strlen(text) AS size FROM documents) GROUP BY 1")
def best_representative(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("source").alias("class"), F.col("doc_id").alias("item"), F.octet_length("text").alias("size"))
    return analytics.representatives(d)


@_query("SELECT source AS group_key, doc_id AS item, min(doc_id) OVER (PARTITION BY source, sha256(text)) AS class FROM documents")
def refinements(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("source").alias("group_key"), F.col("doc_id").alias("item"), F.sha2(F.col("text").cast("binary"), 256).alias("value"))
    return analytics.refine(d, lambda a, b: a == b, F.col("value"))


# --- codecs ---

_NAMES = {"base16": "'f' || lower(hex({b}))", "base16upper": "'F' || upper(hex({b}))", "base64": "'m' || rtrim(to_base64({b}), '=')", "base64pad": "'M' || to_base64({b})", "base64url": "'u' || rtrim(translate(to_base64({b}), '+/', '-_'), '=')", "base64urlpad": "'U' || translate(to_base64({b}), '+/', '-_')"}


_BITS = "(SELECT item_id, CAST(CAST(encode(text) AS BIT) AS VARCHAR) AS bits FROM benchmark)"
_DIGIT = "CAST(1 + list_sum(list_transform(range(0, 5), lambda j: CASE WHEN substr(bits, i * 5 + j + 1, 1) = '1' THEN 1 << (4 - j) ELSE 0 END)) AS INT)"
_BASE32 = "array_to_string(list_transform(range(0, (length(bits) + 4) // 5), lambda i: substr('{digits}', {digit}, 1)), '')"


def _multibase(base: str):
    def run(spark, sf_dir):
        return table(spark, sf_dir, "benchmark").select("item_id", multibase.encode_column(F.col("text").cast("binary"), base).alias("text"))

    QUERIES[f"multibase_{base}"] = run
    if base.startswith("base32"):
        digits = "abcdefghijklmnopqrstuvwxyz234567"
        digits, sign = (digits.upper(), "B") if base.endswith("upper") else (digits, "b")
        ORACLES[f"multibase_{base}"] = f"SELECT item_id, '{sign}' || {_BASE32.format(digits=digits, digit=_DIGIT)} AS text FROM {_BITS}"
    elif base in _NAMES:
        ORACLES[f"multibase_{base}"] = f"SELECT item_id, {_NAMES[base].format(b='encode(text)')} AS text FROM benchmark"


for _b in multibase.BASES:
    _multibase(_b)


@_query("SELECT DISTINCT l_linenumber AS n, 'u' || rtrim(translate(to_base64(unhex('01710001' || printf('%02x', l_linenumber))), '+/', '-_'), '=') AS cid FROM lineitem")
def cid_identity_small_int(spark, sf_dir):
    n = table(spark, sf_dir, "lineitem").select(F.col("l_linenumber").alias("n")).distinct()
    return n.select("n", multibase.encode_column(node.block_of_json(F.col("n").cast("string"))["cid"]).alias("cid"))


@_query()
def cid_blake2b(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", node.block_of_text("text").alias("b"))
    return d.select("doc_id", multibase.encode_column(F.col("b.cid")).alias("cid"), "b.content_type", "b.hash_type", F.octet_length("b.content").alias("n_bytes"))


@_query("""SELECT event_id, '{"map":{"type":' || to_json(event_type) || ',"user":' || CAST(user_id AS VARCHAR) || ',"event":' || CAST(event_id AS VARCHAR) || '}}' AS json FROM events""")
def node_json_round_trip(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    text = F.concat(F.lit('{"map":{"event":'), F.col("event_id").cast("string"), F.lit(',"type":'), F.concat(F.lit('"'), "event_type", F.lit('"')), F.lit(',"user":'), F.col("user_id").cast("string"), F.lit("}}"))
    return e.select("event_id", node.block_of_json(text).alias("b")).select("event_id", node.json_of_block("b.cid", "b.content").alias("json"))


@_query("SELECT page_id, regexp_extract(url, '^([a-z]+)://', 1) AS scheme, regexp_extract(url, '://([^/?#]*)', 1) AS host, regexp_extract(url, '://[^/?#]*([^?#]*)', 1) AS path, regexp_extract(url, '[?]([^#]*)', 1) AS query, regexp_extract(url, '#(.*)$', 1) AS fragment FROM pages")
def uri_parse(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", names.uri_parts(F.col("url")).alias("u")).select("page_id", "u.*")


@_query("SELECT page_id, replace(replace(html, '<', '&lt;'), '\"', '&quot;') AS html FROM pages")
def html_escape(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", names.html_escape(F.col("html")).alias("html"))


@_query("SELECT n_nationkey, n_name || chr(233) || chr(223) || chr(255) AS name FROM nation")
def latin1_names(spark, sf_dir):
    raw = F.concat(F.col("n_name").cast("binary"), F.lit(b"\xe9\xdf\xff"))
    return table(spark, sf_dir, "nation").select("n_nationkey", names.latin1_to_utf8(raw).alias("name"))


@_query("""SELECT event_type, count(value) AS floats, count(props) AS maps, count(CASE WHEN event_id % 1000 < 128 THEN 1 END) AS small_integers, count(event_id) AS integers FROM events GROUP BY 1""")
def value_kinds(spark, sf_dir):
    e = _props(spark, sf_dir)
    number = (F.col("event_id") % 1000).cast("string")
    value = F.concat(F.lit('{"float":"'), F.col("value").cast("string"), F.lit('"}'))
    kinds = e.select("event_type", fields.kind_of(value).alias("v"), fields.kind_of(F.col("json")).alias("p"), fields.kind_of(number).alias("n"), fields.is_integer(number, 8).alias("small"))
    return kinds.groupBy("event_type").agg(F.count_if(F.col("v") == "float").alias("floats"), F.count_if(F.col("p") == "map").alias("maps"), F.count_if("small").alias("small_integers"), F.count_if(F.col("n") == "integer").alias("integers"))


# --- benchmark rows ---

_STATS = "SELECT event_type AS configuration, user_id % 10 AS benchmark, avg(value) AS mean, stddev_samp(value) AS stdev FROM events GROUP BY 1, 2"


def _stats(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("configuration"), (F.col("user_id") % 10).alias("benchmark"), "value")
    return analytics.summary(e, ["configuration", "benchmark"], "value")


@_query(f"SELECT configuration, benchmark, round(mean, 6) AS mean, round(stdev, 6) AS stdev FROM ({_STATS})")
def bench_stats(spark, sf_dir):
    return _stats(spark, sf_dir).select("configuration", "benchmark", F.round("mean", 6).alias("mean"), F.round("stdev", 6).alias("stdev"))


@_query(f"""SELECT r.configuration, r.benchmark, round(b.mean / r.mean, 6) AS speedup, round(sqrt(pow(b.stdev / b.mean, 2) + pow(r.stdev / r.mean, 2)) * b.mean / r.mean, 6) AS speedup_stdev
FROM ({_STATS}) r JOIN ({_STATS}) b ON b.benchmark = r.benchmark AND b.configuration = 'click'""")
def bench_speedup(spark, sf_dir):
    return analytics.speedups(_stats(spark, sf_dir), "click").select("configuration", "benchmark", F.round("speedup", 6).alias("speedup"), F.round("speedup_stdev", 6).alias("speedup_stdev"))


@_query(f"SELECT r.configuration, round(exp(avg(ln(b.mean / r.mean))), 6) AS geomean FROM ({_STATS}) r JOIN ({_STATS}) b ON b.benchmark = r.benchmark AND b.configuration = 'click' GROUP BY 1")
def bench_geomean(spark, sf_dir):
    return analytics.geometric_mean(analytics.speedups(_stats(spark, sf_dir), "click"), ["configuration"], "speedup").select("configuration", F.round("geomean", 6).alias("geomean"))


@_query("SELECT user_id % 10 AS benchmark, round(avg(CASE WHEN event_type = 'click' THEN value END), 6) AS click, round(avg(CASE WHEN event_type = 'view' THEN value END), 6) AS view FROM events GROUP BY 1")
def bench_pivot(spark, sf_dir):
    e = table(spark, sf_dir, "events").select((F.col("user_id") % 10).alias("benchmark"), "event_type", "value")
    p = e.groupBy("benchmark").pivot("event_type", ["click", "view"]).agg(F.avg("value"))
    return p.select("benchmark", F.round("click", 6).alias("click"), F.round("view", 6).alias("view"))


@_query(f"""SELECT benchmark, m FROM (SELECT benchmark, round(avg(mean), 6) AS m, row_number() OVER (ORDER BY avg(mean), benchmark) AS lo, row_number() OVER (ORDER BY avg(mean) DESC, benchmark DESC) AS hi FROM ({_STATS}) GROUP BY benchmark) WHERE lo <= 3 OR hi <= 3""")
def bench_head_tail(spark, sf_dir):
    means = _stats(spark, sf_dir).groupBy("benchmark").agg(F.avg("mean").alias("m"))
    return analytics.head_tail(means, ["m", "benchmark"], 3).select("benchmark", F.round("m", 6).alias("m"))


@_query("SELECT source, CAST(sum(strlen(text)) AS BIGINT) AS bytes FROM documents GROUP BY 1")
def total_size(spark, sf_dir):
    return analytics.total_size(table(spark, sf_dir, "documents"), ["source"], "text")


@_query("SELECT event_id, 4.0::DOUBLE * pow(2, event_id % 6) AS minutes FROM events")
def retry_backoff(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", queue.backoff_minutes(F.col("event_id") % 6).alias("minutes"))


@_query("SELECT event_type AS func, count(CASE WHEN event_id % 3 = 0 THEN 1 END) AS queued, count(CASE WHEN event_id % 3 = 1 THEN 1 END) AS running, count(CASE WHEN event_id % 3 = 2 THEN 1 END) AS finished FROM events GROUP BY 1")
def queue_gauges(spark, sf_dir):
    state = F.element_at(F.array(*map(F.lit, ("queued", "running", "finished"))), (F.col("event_id") % 3 + 1).cast("int"))
    return queue.gauges(table(spark, sf_dir, "events").select(F.col("event_type").alias("func"), state.alias("state")))


@_query("SELECT event_id, CAST(row_number() OVER (PARTITION BY event_type ORDER BY CASE WHEN event_id % 4 > 0 THEN 1 ELSE 0 END, event_id) AS BIGINT) AS place FROM events")
def assignment_order(spark, sf_dir):
    jobs = table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("func"), (F.col("event_id") % 4).alias("attempt"), F.col("event_id").alias("position"))
    return queue.assignment_places(jobs).select("event_id", F.col("place").cast("long").alias("place"))


@_query("SELECT s_suppkey AS k, s_name AS name, NULL AS segment FROM supplier UNION ALL SELECT c_custkey, c_name, c_mktsegment FROM customer")
def union_all_rows(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("name"))
    return analytics.concatenated([s, table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))])


# --- candidates from ordered rows, rewriting, plans ---

_ITEMS = "SELECT l_orderkey AS func, l_linenumber AS pos, 0 AS block, concat(l_returnflag, ' ', CAST(l_partkey AS STRING)) AS text, l_linestatus = 'O' AS ok FROM (SELECT l_orderkey, l_linenumber, min(l_partkey) AS l_partkey, min(l_returnflag) AS l_returnflag, min(l_linestatus) AS l_linestatus FROM {lineitem} GROUP BY 1, 2)"


def _windows(spark, sf_dir):
    return candidates.window_candidates(spark.sql(_ITEMS, lineitem=table(spark, sf_dir, "lineitem")), min_savings=1)


_WINDOWS = """WITH i AS (SELECT l_orderkey AS func, l_linenumber AS pos, l_returnflag || ' ' || CAST(l_partkey AS VARCHAR) AS text, l_linestatus = 'O' AS ok FROM (SELECT l_orderkey, l_linenumber, min(l_partkey) AS l_partkey, min(l_returnflag) AS l_returnflag, min(l_linestatus) AS l_linestatus FROM lineitem GROUP BY 1, 2)),
n AS (SELECT *, row_number() OVER (PARTITION BY func ORDER BY pos) AS r FROM i),
w AS (SELECT a.func, a.pos AS s, b.pos + 1 AS e, b.r - a.r + 1 AS k, a.text AS head, a.r AS ar, b.r AS br FROM n a JOIN n b ON a.func = b.func AND b.r BETWEEN a.r AND a.r + 9),
x AS (SELECT w.func, w.s, w.e, w.k, w.head, sum(strlen(c.text)) AS total, bool_and(c.ok) AS ok, string_agg(c.text, chr(10) ORDER BY c.r) AS whole FROM w JOIN n c ON c.func = w.func AND c.r BETWEEN w.ar AND w.br GROUP BY ALL)
SELECT func, s, e, CAST(k AS VARCHAR) || ':' || split_part(head, ' ', 1) AS group_key, CAST(total + 8 AS BIGINT) AS callee_size, CAST(total - 5 AS BIGINT) AS caller_savings, sha256(whole) AS callee FROM x WHERE ok AND total - 5 >= 1"""


@_query(_WINDOWS)
def window_candidates(spark, sf_dir):
    c = _windows(spark, sf_dir)
    return c.select("func", F.col("nodes")[0].alias("s"), F.col("nodes")[1].alias("e"), "group_key", F.col("callee_size").cast("long").alias("callee_size"), F.col("caller_savings").cast("long").alias("caller_savings"), "callee")


@_query(f"SELECT callee, min(callee_size) - 8 AS size, count(*) AS members FROM ({_WINDOWS}) GROUP BY 1")
def extracted_callees(spark, sf_dir):
    return _windows(spark, sf_dir).groupBy("callee").agg((F.min("callee_size") - 8).cast("long").alias("size"), F.count(F.lit(1)).alias("members"))


@_query(f"""WITH c AS ({_WINDOWS}), g AS (SELECT group_key FROM c GROUP BY 1 HAVING sum(caller_savings) > min(callee_size)),
a AS (SELECT callee, min(callee_size) - 8 AS actual FROM c GROUP BY 1)
SELECT c.func, c.s, c.e, c.group_key, CAST(floor((row_number() OVER (PARTITION BY c.func ORDER BY c.group_key, c.s, c.e) - 1) / 64) AS BIGINT) AS batch, a.actual AS callee_size, c.caller_savings + least(0, a.actual - c.callee_size) AS caller_savings
FROM c JOIN g ON g.group_key = c.group_key JOIN a ON a.callee = c.callee""")
def grouped_callees_for_functions(spark, sf_dir):
    c = _windows(spark, sf_dir)
    sizes = c.groupBy("callee").agg((F.min("callee_size") - 8).alias("actual"))
    out = candidates.grouped_callees_for_functions(c, sizes)
    return out.select("func", F.col("nodes")[0].alias("s"), F.col("nodes")[1].alias("e"), "group_key", F.col("batch").cast("long").alias("batch"), F.col("callee_size").cast("long").alias("callee_size"), F.col("caller_savings").cast("long").alias("caller_savings"))


@_query("""SELECT source AS module, CAST(doc_id AS VARCHAR) AS name, CASE WHEN doc_id % 2 = 0 THEN 'new:' || sha256(text) ELSE sha256(text) END AS part FROM documents d
WHERE NOT EXISTS (SELECT 1 FROM documents o WHERE sha256(o.text) = sha256(d.text) AND o.doc_id % 2 <> d.doc_id % 2)""")
def rewritten_module(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("source").alias("module"), "doc_id", F.sha2("text", 256).alias("part"))
    odd = d.groupBy("part").agg(F.count_distinct(F.col("doc_id") % 2).alias("n")).filter("n = 1").select("part")
    d = d.join(odd, "part", "left_semi")
    new = d.filter("doc_id % 2 = 0").select("part", F.concat(F.lit("new:"), "part").alias("new_part")).distinct()
    return candidates.rewrite(d.select("module", F.col("doc_id").cast("string").alias("name"), "part"), new)


@_query("SELECT p_partkey, p_size % 5 <> 0 AND NOT (p_size % 7 = p_size % 5) AS ok FROM part")
def outlinable_sets(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", F.sequence(F.lit(0), F.col("p_size") % 5).alias("all"), (F.col("p_size") % 5).alias("k"), (F.col("p_size") % 7).alias("f"))
    sets = p.select("p_partkey", F.filter("all", lambda x: x > 0).alias("nodes"), F.when(F.col("f") == F.col("k"), F.array("k")).otherwise(F.array(F.lit(99))).alias("forbidden"),
                    F.array("k").alias("forced"), F.array(F.lit(0)).alias("dominating"), F.array(F.lit(0)).alias("dominators"))
    return sets.select("p_partkey", candidates.outlinable(sets).alias("ok"))


@_query("""SELECT page_id, s.section FROM (SELECT page_id, regexp_extract(url, '://([^/?#]*)', 1) AS host, regexp_extract(url, '://[^/?#]*/([a-z]*)', 1) AS lang FROM pages) p
JOIN (VALUES ('nouse', '^www\\..*$', '^.*$'), ('noplugin', '^.*\\.example\\.org$', '^en$'), ('nouse', '^m\\..*$', '^d.$')) s(section, mp, np) ON regexp_full_match(p.host, s.mp) AND regexp_full_match(p.lang, s.np) GROUP BY 1, 2""")
def symbol_sections(spark, sf_dir):
    u = F.col("url")
    s = table(spark, sf_dir, "pages").select(F.concat_ws(" ", F.regexp_extract(u, "://([^/?#]*)", 1)).alias("module"), F.regexp_extract(u, "://[^/?#]*/([a-z]*)", 1).alias("name"), "page_id")
    lists = spark.createDataFrame([("nouse", "www.*", "*"), ("noplugin", "*.example.org", "en"), ("nouse", "m.*", "d?")], "section string, module_glob string, name_glob string")
    return s.join(candidates.matches_sections(s.select("module", "name").distinct(), lists), ["module", "name"]).select("page_id", "section").distinct()


@_query("SELECT source, count(*) AS n FROM documents WHERE n_chars > 100 GROUP BY 1")
def experiment_plan(spark, sf_dir):
    config = {
        "docs": {"file": f"{sf_dir}/documents.parquet"}, "again": {"call": "id", "args": ["${var:docs}"]},
        "long": {"call": "longer", "args": ["${var:again}", 100]}, "counts": {"call": "count", "args": ["${var:long}"]},
    }
    funcs = {"longer": lambda df, n: df.filter(F.col("n_chars") > n), "count": lambda df: df.groupBy("source").agg(F.count(F.lit(1)).alias("n"))}
    return experiments.Plans(spark, config, funcs).get("counts")


@_query("SELECT l_orderkey AS experiment, max(l_partkey) AS text_size FROM lineitem GROUP BY 1")
def size_report(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.max("l_partkey").alias("p"))
    out = F.concat(F.lit("   text\t   data\n  "), F.col("p").cast("string"), F.lit("\t      12\n"))
    return candidates.size_report(li.select(F.col("l_orderkey").alias("experiment"), out.alias("output")))


# --- archives, transfers, references, files ---


@_query("SELECT CAST(doc_id AS VARCHAR) AS name, sha256(text) AS part FROM documents WHERE doc_id % 4 = 0")
def archive_round_trip(spark, sf_dir):
    store, ids = _half_stored(spark, sf_dir)
    store.set_heads(ids.filter("doc_id % 4 = 0").select(F.col("doc_id").cast("string").alias("name"), "cid"))
    path, other = f"{shared_dir(spark)}/archive-{uuid.uuid4().hex}.car", _new_store(spark)
    car.export_archive(store, path)
    car.import_archive(other, path)
    heads = other.heads
    return heads.join(other.contents(heads.select("cid").distinct()), "cid").select("name", F.sha2(node.text_of_block("cid", "content"), 256).alias("part"))


@_query("SELECT CAST(doc_id AS VARCHAR) AS name, sha256(text) AS part FROM documents WHERE doc_id % 6 = 0")
def transfer_store(spark, sf_dir):
    store, ids = _half_stored(spark, sf_dir)
    store.set_heads(ids.filter("doc_id % 6 = 0").select(F.col("doc_id").cast("string").alias("name"), "cid"))
    other = _new_store(spark)
    other.put_blocks(ids.filter("doc_id % 12 = 0").join(store.blocks, "cid").select("cid", "content_type", "hash_type", "content"))  # what is there isn't sent
    store.transfer(other)
    heads = other.heads
    return heads.join(other.contents(heads.select("cid").distinct()), "cid").select("name", F.sha2(node.text_of_block("cid", "content"), 256).alias("part"))


@_query("SELECT n_nationkey, count(c_custkey) AS refs FROM nation JOIN customer ON c_nationkey = n_nationkey GROUP BY 1")
def reference_counts(spark, sf_dir):
    store, nations, _ = _linked(spark, sf_dir)
    refs = store.refs.distinct().groupBy(F.col("dest").alias("cid")).agg(F.count(F.lit(1)).alias("refs"))
    return nations.join(refs, "cid").select(F.col("key").alias("n_nationkey"), "refs")


@_query("SELECT DISTINCT c_nationkey AS n_nationkey FROM customer")
def links_of_nodes(spark, sf_dir):
    store, nations, customers = _linked(spark, sf_dir)
    found = store.contents(customers.select("cid").distinct()).select(F.explode(node.links_of_block("cid", "content")).alias("cid")).distinct()
    return nations.join(found, "cid").select(F.col("key").alias("n_nationkey"))


@_query(f"SELECT DISTINCT v FROM (SELECT user_id AS v FROM ({_CALLS.replace('user_id AS arg', 'user_id')}) UNION SELECT result FROM ({_CALLS}))")
def store_roots(spark, sf_dir):
    return _call_store(spark, sf_dir).roots().select(_int_of(F.col("cid")).alias("v"))


@_query("SELECT CASE WHEN event_id % 3 = 0 THEN 'map' WHEN event_id % 3 = 1 THEN 'integer' ELSE 'list' END AS kind, count(*) AS n FROM events GROUP BY 1")
def kinds_of_blocks(spark, sf_dir):
    k, n = F.col("event_id") % 3, F.col("event_id").cast("string")
    json = F.when(k == 0, F.concat(F.lit('{"map":{"n":'), n, F.lit("}}"))).when(k == 1, n).otherwise(F.concat(F.lit("["), n, F.lit("]")))
    blocks = table(spark, sf_dir, "events").select(node.block_of_json(json).alias("b")).select("b.*")
    return blocks.groupBy(node.kind_of_block("cid", "content").alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@_query("""SELECT event_id, chr(123) || '"float":"' || regexp_replace(CAST(value AS VARCHAR), '\.0$', '') || '"' || chr(125) AS json FROM events WHERE value IS NOT NULL AND abs(value) < 1e15""")
def floats_round_trip(spark, sf_dir):
    e = table(spark, sf_dir, "events").filter("value IS NOT NULL AND abs(value) < 1e15")
    json = F.concat(F.lit('{"float":"'), F.col("value").cast("string"), F.lit('"}'))
    return e.select("event_id", node.block_of_json(json).alias("b")).select("event_id", node.json_of_block("b.cid", "b.content").alias("json"))


@_query("SELECT event_id, props AS json FROM events")
def nodes_round_trip(spark, sf_dir):
    path = f"{shared_dir(spark)}/nodes-{uuid.uuid4().hex}"
    j = _props(spark, sf_dir).select("event_id", fields.with_field(F.col("json"), "id", F.col("event_id").cast("string")).alias("text"))
    j.select("text").write.text(path)
    back = nodes.read_nodes(spark, path, "json")
    return back.select(fields.at(F.col("json"), "id").cast("long").alias("event_id"), F.concat(F.lit('{"k": '), fields.at(F.col("json"), "k"), F.lit("}")).alias("json"))


@_query("SELECT CAST(p_partkey AS VARCHAR) AS p_partkey, p_name FROM part")
def csv_round_trip(spark, sf_dir):
    path = f"{shared_dir(spark)}/csv-{uuid.uuid4().hex}"
    nodes.write_csv(table(spark, sf_dir, "part").select("p_partkey", "p_name"), path)
    return spark.read.csv(path, header=True)


@_query("SELECT '/head/' || replace(replace(c_name, '#', '%23'), ' ', '%20') || '/%C3%A9' AS uri FROM customer")
def head_uris(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(names.uri_text(F.concat("c_name", F.lit("/é"))).alias("uri"))


@_query("SELECT page_id, CAST(page_id AS VARCHAR) AS last FROM pages")
def last_parameter(spark, sf_dir):
    uri = F.concat(F.lit("/call?x=first&y=a%20b&x="), F.col("page_id").cast("string"))
    return table(spark, sf_dir, "pages").select("page_id", F.element_at(names.last_parameters(uri), "x").alias("last"))


# --- names, filters, lists, passes ---


@_query("""SELECT module, name, CASE WHEN r = 1 THEN name ELSE name || '.' || CAST(r - 2 AS VARCHAR) END AS unique_name FROM (
SELECT CAST(p_partkey % 40 AS VARCHAR) AS module, 's' || CAST(p_partkey // 40 % 9 AS VARCHAR) || CAST(p_partkey // 360 AS VARCHAR) AS name, row_number() OVER (PARTITION BY 's' || CAST(p_partkey // 40 % 9 AS VARCHAR) || CAST(p_partkey // 360 AS VARCHAR) ORDER BY CAST(p_partkey % 40 AS VARCHAR)) AS r FROM part)""")
def unique_names(spark, sf_dir):
    k = F.floor(F.col("p_partkey") / 40)
    d = table(spark, sf_dir, "part").select((F.col("p_partkey") % 40).cast("string").alias("module"), F.concat(F.lit("s"), (k % 9).cast("string"), F.floor(k / 9).cast("string")).alias("name"))
    return resolve.unique_names(d).select("module", "name", "unique_name")


@_query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_linenumber + l_quantity <= 20")
def few_arguments(spark, sf_dir):
    return candidates.at_most_args(table(spark, sf_dir, "lineitem"), 20, "l_linenumber", "l_quantity").select("l_orderkey", "l_linenumber")


@_query("SELECT doc_id AS item FROM labels WHERE doc_id % 3 <> 0")
def validatable_items(spark, sf_dir):
    items = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("item"), F.when(F.col("doc_id") % 3 != 0, F.col("quality")).alias("value"))
    return candidates.validatable(items, lambda a, b: a == b).select("item")


@_query("SELECT o_custkey, string_agg(CAST(o_orderkey AS VARCHAR) || ',' || CAST(o_orderkey + 1 AS VARCHAR), ',' ORDER BY o_orderkey) AS list FROM orders GROUP BY 1")
def result_lists(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.array(F.col("o_orderkey").cast("string"), (F.col("o_orderkey") + 1).cast("string")).alias("list"))
    return analytics.concat_lists(o, ["o_custkey"], ["o_orderkey"], "list").select("o_custkey", F.array_join("list", ",").alias("list"))


@_query("""SELECT a.s_nationkey AS g, a.s_suppkey AS supplier, b.c_custkey AS customer FROM (SELECT s_nationkey, s_suppkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS r FROM supplier) a
JOIN (SELECT c_nationkey, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS r FROM customer) b ON a.s_nationkey = b.c_nationkey AND a.r = b.r""")
def zipped_members(spark, sf_dir):
    place = lambda k, c: F.row_number().over(Window.partitionBy(k).orderBy(c)).alias("place")
    s = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("g"), F.col("s_suppkey").alias("supplier"), place("s_nationkey", "s_suppkey"))
    c = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("g"), F.col("c_custkey").alias("customer"), place("c_nationkey", "c_custkey"))
    return analytics.zipped(s, c, ["g"], "place").drop("place")


@_query("SELECT s_suppkey AS item, s_suppkey + 12 AS result FROM supplier")
def pass_fold(spark, sf_dir):
    start = materialize(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("item"), _int_cid("s_suppkey").alias("cid")), "start")
    done = memo.Evaluator(_new_store(spark), memo.TEST_FUNCS).fold(start, [("test.add", node.to_ipld(5)[0].data), ("test.add", node.to_ipld(7)[0].data)])
    return done.select("item", _int_of(F.col("cid")).alias("result"))


@_query("SELECT r_regionkey AS a, 'no implementation of none.' || r_name AS error FROM region")
def missing_functions(spark, sf_dir):
    evaluator, rows = memo.Evaluator(_new_store(spark), memo.Registry()), []
    for r in table(spark, sf_dir, "region").select("r_regionkey", "r_name").collect():  # five regions
        try:
            evaluator.evaluate(spark.createDataFrame([(f"none.{r['r_name']}", [])], "func string, args array<binary>"))
        except KeyError as e:
            rows.append((r["r_regionkey"], e.args[0]))
    return spark.createDataFrame(rows, "a long, error string")
