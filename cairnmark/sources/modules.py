"""Modules over a store: a module is an ordered list of named parts, each part a block that equal parts share.

The manifest of a module is rows, not one node, so that a module may have any number of parts: module, pos, name and the
id of the part. Adding a module again replaces its rows: the rows of its last addition count.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from cairnmark.functions import node
from cairnmark.session import materialize

from .store import Store

MANIFEST = "module string, pos long, name string, part binary, seq long"


class Modules:
    def __init__(self, store: Store):
        self.store, self.path = store, f"{store.path}/manifests"

    def add(self, parts: DataFrame) -> None:
        """Splits modules given by their parts (module, pos, name, text): stores each text once and writes the manifests.

        Null texts are null nodes and come back as null; positions say how parts are joined again; an empty frame adds nothing.
        """
        texts = parts.select("text").distinct().withColumn("b", node.block_of_text("text"))
        made = materialize(texts.select("text", "b.*"), "parts")
        self.store.put_blocks(made.drop("text"))
        ids = made.select(F.col("text").alias("t"), F.col("cid").alias("part"))
        rows = parts.join(ids, F.col("text").eqNullSafe(F.col("t")))
        seq = F.lit(self.store._seq()).alias("seq")
        rows.select("module", F.col("pos").cast("long").alias("pos"), F.col("name").cast("string").alias("name"), "part", seq).write.mode("append").parquet(self.path)

    def _manifest(self) -> DataFrame:
        return self.store.spark.read.schema(MANIFEST).parquet(self.path)

    def manifest(self) -> DataFrame:
        """module, pos, name, part of the last addition of each module."""
        rows = self._manifest()
        last = rows.groupBy("module").agg(F.max("seq").alias("last"))
        on = F.col("r.module").eqNullSafe(F.col("l.module")) & (F.col("r.seq") == F.col("l.last"))
        return rows.alias("r").join(last.alias("l"), on, "left_semi").select("module", "pos", "name", "part")

    def modules(self) -> DataFrame:
        return self._manifest().select("module").distinct()

    def part_ids(self) -> DataFrame:
        """The ids of all parts, each once, in order of their bytes."""
        return self.manifest().select("part").distinct().orderBy("part")

    def copies(self) -> DataFrame:
        """How often each module holds a part."""
        return self.manifest().groupBy("module", "part").agg(F.count(F.lit(1)).alias("copies"))

    def texts(self, parts: DataFrame) -> DataFrame:
        """(part, text) of the given parts, each once, by one join with the blocks."""
        keys = parts.select(F.col("part").alias("cid")).distinct()
        return self.store.contents(keys).select(F.col("cid").alias("part"), node.text_of_block("cid", "content").alias("text"))

    def rejoin(self) -> DataFrame:
        """(module, text): the parts of every module put together again in order; null parts are empty."""
        rows = self.manifest()
        whole = rows.join(self.texts(rows), "part").groupBy("module").agg(F.array_sort(F.collect_list(F.struct("pos", "name", "text"))).alias("rows"))
        return whole.select("module", F.array_join(F.transform("rows", lambda r: F.coalesce(r["text"], F.lit(""))), "").alias("text"))

    def melt(self) -> DataFrame:
        """(part, first_module, modules): all modules as one, each part once."""
        return self.manifest().groupBy("part").agg(F.min("module").alias("first_module"), F.count_distinct("module").alias("modules"))

    def sharing(self) -> DataFrame:
        """Per module: parts, unique parts, parts that other modules have too, and copies of its parts anywhere."""
        own = self.manifest().groupBy("module", "part").agg(F.count(F.lit(1)).alias("n"))
        all_ = own.groupBy("part").agg(F.sum("n").alias("copies"), F.count(F.lit(1)).alias("modules"))
        rows = own.join(all_, "part")
        return rows.groupBy("module").agg(F.sum("n").alias("num_parts"), F.count(F.lit(1)).alias("num_unique_parts"), F.count_if(F.col("modules") > 1).alias("num_shared_parts"), F.sum(F.col("n") * F.col("copies")).alias("total_copies"))

    def merged(self) -> DataFrame:
        """(module, pos, name, part, kept_module, kept_pos): the first (pos, module) that holds the same part."""
        rows = self.manifest()
        first = rows.groupBy("part").agg(F.min(F.struct("pos", "module")).alias("f"))
        return rows.join(first, "part").select("module", "pos", "name", "part", F.col("f.module").alias("kept_module"), F.col("f.pos").alias("kept_pos"))
