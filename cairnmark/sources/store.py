"""A content-addressed store on Parquet: blocks, heads and calls as append-only logs.

Heads and calls are upserts, so reads keep the last row of a key by seq; a null CID or result is a tombstone. Blocks are
written once. References between blocks are derived from contents when they are put. All lookups are batches:
a frame of keys is joined, never looked up one by one.
"""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession, functions as F

from cairnmark.functions import node
from cairnmark.functions.names import parse_uri, uri_text
from cairnmark.session import materialize

VERSION = 1
SCHEMAS = {
    "blocks": "cid binary, content_type int, hash_type int, content binary",
    "refs": "dest binary, src binary",
    "heads": "name string, cid binary, seq long",
    "calls": "args array<binary>, result binary, seq long, func string",
}


def latest(log: DataFrame, keys: list[str], seq: str = "seq") -> DataFrame:
    """The last row of each key by seq, all columns: one aggregate, so that a hot key is combined before the shuffle."""
    rest = [c for c in log.columns if c not in keys]
    return log.groupBy(*keys).agg(F.max(F.struct(F.col(seq).alias("_s"), *rest)).alias("_r")).select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])


class Store:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    # --- tables ---

    def _read(self, name: str) -> DataFrame:
        return self.spark.read.schema(SCHEMAS[name]).parquet(f"{self.path}/{name}")

    def _append(self, name: str, df: DataFrame) -> None:
        w = df.write.mode("append")
        (w.partitionBy("func") if name == "calls" else w).parquet(f"{self.path}/{name}")

    def _seq(self) -> int:
        """Greater than any earlier one."""
        return time.time_ns()

    @property
    def blocks(self) -> DataFrame:
        return self._read("blocks")

    @property
    def refs(self) -> DataFrame:
        """src, dest; a put that failed halfway may have left pairs that its repetition wrote again, so readers use them as a set."""
        return self._read("refs")

    @property
    def heads(self) -> DataFrame:
        """name, cid"""
        return latest(self._read("heads"), ["name"]).filter("cid IS NOT NULL").select("name", "cid")

    @property
    def calls(self) -> DataFrame:
        """func, args, result"""
        return latest(self._read("calls"), ["func", "args"]).filter("result IS NOT NULL").select("func", "args", "result")

    # --- writes ---

    def put(self, values: DataFrame, json_col: str = "json") -> DataFrame:
        """Stores nodes given as JSON; returns json, cid of every row. Known and repeated blocks are written once."""
        rows = values.select(F.col(json_col).alias("json")).distinct().withColumn("b", node.block_of_json("json"))
        made = rows.select("json", "b.*")
        self.put_blocks(made.drop("json"))
        return made.select("json", "cid")

    def put_blocks(self, blocks: DataFrame) -> None:
        """Identity CIDs hold their content, so no block is written for them; their links still count as references."""
        new = blocks.dropDuplicates(["cid"]).join(self.blocks.select("cid"), "cid", "left_anti")
        new = materialize(new.withColumn("links", node.links_of_block("cid", "content")), "new")
        # references first: a block that is there has its references, and those of a failed put are written again
        self._append("refs", new.select(F.explode(F.array_distinct("links")).alias("dest"), F.col("cid").alias("src")))
        self._append("blocks", new.filter("hash_type <> 0").select("cid", "content_type", "hash_type", "content"))

    def set_heads(self, rows: DataFrame) -> None:
        """rows: name, cid. Within one call the greatest CID of a name is taken."""
        rows = rows.groupBy("name").agg(F.max("cid").alias("cid"))
        self._append("heads", rows.select("name", "cid", F.lit(self._seq()).alias("seq")))

    def set_calls(self, rows: DataFrame) -> None:
        """rows: func, args, result."""
        rows = rows.groupBy("func", "args").agg(F.max("result").alias("result"))
        self._append("calls", rows.select("args", "result", F.lit(self._seq()).alias("seq"), "func"))

    def set(self, uri: str, target: str) -> None:
        """Points a head or call at what another name stands for."""
        name, cid = parse_uri(uri), self.resolve(target)
        if name.kind == "cid":
            raise ValueError("can't set a CID")
        if cid is None:
            raise KeyError(target)
        if name.kind == "head":
            self.set_heads(self.spark.createDataFrame([(name.head, bytearray(cid))], "name string, cid binary"))
        else:
            self.set_calls(self.spark.createDataFrame([(name.func, [bytearray(a.data) for a in name.args], bytearray(cid))], "func string, args array<binary>, result binary"))

    def delete_heads(self, names: DataFrame) -> None:
        """Deletes heads by name; unknown names are no error."""
        self._append("heads", names.select("name", F.lit(None).cast("binary").alias("cid"), F.lit(self._seq()).alias("seq")).distinct())

    def invalidate(self, func: str) -> None:
        """Forgets all calls of a function: tombstones in its partition, which alone is read."""
        rows = self.calls.filter(F.col("func") == func).withColumn("result", F.lit(None).cast("binary"))
        self._append("calls", rows.select("args", "result", F.lit(self._seq()).alias("seq"), "func"))

    # --- reads ---

    def contents(self, keys: DataFrame) -> DataFrame:
        """(cid, content) of every known key (cid); identity CIDs hold their own, without touching the blocks."""
        inline = node.inline_content(F.col("cid"))
        keys = keys.select("cid", inline.alias("own"))
        own = keys.filter("own IS NOT NULL").select("cid", F.col("own").alias("content"))
        stored = keys.filter("own IS NULL").select("cid").join(self.blocks.select("cid", "content"), "cid")
        return own.unionByName(stored)

    def get(self, keys: DataFrame) -> DataFrame:
        """json of every known key (cid)."""
        return self.contents(keys).select("cid", node.json_of_block("cid", "content").alias("json"))

    def inline(self, keys: DataFrame, depth: int = 0) -> DataFrame:
        """json of every known key with links replaced by what they point to, `depth` levels down.

        Each level fetches the links of all rows by one join and puts their contents in place.
        """
        found = self.get(keys).select("cid", "json")
        for level in range(depth):
            links = found.select(F.explode(node.links_of_json("json")).alias("cid")).distinct()
            have = self.get(links).select(F.col("cid").alias("link"), F.col("json").alias("value"))
            each = found.select("cid", "json", F.explode_outer(F.array_distinct(node.links_of_json("json"))).alias("link"))
            whole = each.join(have, "link", "left").groupBy("cid", "json").agg(F.map_from_entries(F.collect_list(F.when(F.col("value").isNotNull(), F.struct(F.base64("link"), "value")))).alias("m"))
            found = whole.select("cid", node.replace_links("json", "m").alias("json"))
        return found

    def has(self, keys: DataFrame) -> DataFrame:
        """The keys (cid) that are known; identity CIDs always are."""
        own = node.inline_content(F.col("cid")).isNotNull()
        return keys.filter(own).unionByName(keys.filter(~own).join(self.blocks.select("cid"), "cid", "left_semi"))

    def resolve(self, uri: str) -> bytes | None:
        name = parse_uri(uri)
        if name.kind == "cid":
            return name.cid.data
        if name.kind == "head":
            row = self.heads.filter(F.col("name") == name.head).first()
            return None if row is None else bytes(row["cid"])
        args = F.array(*[F.lit(bytearray(a.data)) for a in name.args]).cast("array<binary>")
        row = self.calls.filter((F.col("func") == name.func) & (F.col("args") == args)).first()
        return None if row is None else bytes(row["result"])

    def copy_heads(self, names: DataFrame) -> None:
        """Points heads at what others stand for: names (source, target); unknown sources are left out."""
        found = names.join(self.heads.withColumnRenamed("name", "source"), "source")
        self.set_heads(materialize(found.select(F.col("target").alias("name"), "cid"), "heads"))

    def list_heads(self, limit: int | None = None) -> DataFrame:
        """name, cid in order of the names' URIs, byte by byte; with a limit, as many of the first of them."""
        out = self.heads.orderBy(uri_text(F.col("name")).cast("binary"))
        return out if limit is None else out.limit(limit)

    def list_funcs(self) -> DataFrame:
        return self.calls.select("func").distinct()

    def list_calls(self, func: str) -> DataFrame:
        return self.calls.filter(F.col("func") == func)

    def names_using(self, cids: DataFrame) -> DataFrame:
        """(cid, kind, src, name, func, args): blocks, heads and calls that refer to the given cids, each once."""
        none = {"src": "binary", "name": "string", "func": "string", "args": "array<binary>"}

        def rows(df: DataFrame, kind: str, **have: str) -> DataFrame:
            return df.select("cid", F.lit(kind).alias("kind"), *[(F.col(have[c]) if c in have else F.lit(None)).cast(t).alias(c) for c, t in none.items()])

        calls = self.calls
        by_arg = calls.select(F.explode("args").alias("cid"), "func", "args")
        by_result = calls.select(F.col("result").alias("cid"), "func", "args")
        return (
            rows(self.refs.withColumnRenamed("dest", "cid").join(cids, "cid", "left_semi"), "block", src="src")
            .unionByName(rows(self.heads.join(cids, "cid", "left_semi"), "head", name="name"))
            .unionByName(rows(by_arg.unionByName(by_result).join(cids, "cid", "left_semi"), "call", func="func", args="args"))
            .distinct()
        )

    def roots(self) -> DataFrame:
        """CIDs that heads and calls hold."""
        c = self.calls
        return self.heads.select("cid").union(c.select("result")).union(c.select(F.explode("args"))).distinct()

    def reachable(self, roots: DataFrame | None = None) -> DataFrame:
        from cairnmark.operators.graph import closure

        return closure(self.refs.select("src", F.col("dest").alias("dst")), (self.roots() if roots is None else roots).select(F.col("cid").alias("node"))).withColumnRenamed("node", "cid")

    def garbage(self) -> DataFrame:
        """Blocks that no head or call reaches."""
        return self.blocks.join(self.reachable(), "cid", "left_anti")

    def transfer(self, to: Store, roots: DataFrame | None = None) -> None:
        """Copies what roots (all of them: heads and calls too) reach to another store; what it has isn't sent."""
        live = self.reachable(roots)
        to.put_blocks(self.blocks.join(live, "cid", "left_semi"))
        if roots is None:
            to.set_heads(self.heads)
            to.set_calls(self.calls)


def open_store(spark: SparkSession, path: str, create: bool = False) -> Store:
    """Opens the store at path; its version is checked. A scheme that Spark can't read fails with Spark's own error."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(jvm.org.apache.hadoop.fs.Path(f"{path}/version.json")):
        found = spark.read.schema("version int").json(f"{path}/version.json").first()["version"]
        if found != VERSION:
            raise ValueError(f"store has version {found}, expected {VERSION}")
    elif not create:
        raise FileNotFoundError(path)
    else:
        for name, schema in SCHEMAS.items():
            w = spark.createDataFrame([], schema).write.mode("append")
            w.parquet(f"{path}/{name}")
        spark.createDataFrame([(VERSION,)], "version int").coalesce(1).write.json(f"{path}/version.json")
    return Store(spark, path)
