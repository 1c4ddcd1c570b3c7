"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact shingle containment.

An item with m shingles may miss at most m - ceil(0.8 m) of them, so of its bottom-k MinHash sketch with
k = m - ceil(0.8 m) + 1 values at least one lies in any document that contains it: long documents are probed with
all their shingles, whatever their size, and no contained item is lost. Items are partitioned by size (powers of
two); a document probes only the partitions whose items it is large enough to hold.

Limit: an item of fewer than five words is one shingle of all its words, as in the SQL, so it is found only in
documents of just those words, never inside a longer one.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import materialize, table
from .shingles import arrow_rows, at_least, distinct, shingles

PERCENT = 80
#: Items that one pass over the documents searches for; more items make more passes, so what is broadcast is bounded.
BLOCK_ITEMS = 20_000


class ItemIndex:
    """Sketches and shingle sets of a bounded block of items (id, text, number of rows)."""

    def __init__(self, items: list[tuple], percent: int = PERCENT):
        by_set = {}
        for item_id, data, rows in items:
            s = distinct(shingles(data))
            if len(s):
                by_set.setdefault(s.tobytes(), (s, []))[1].append((item_id, rows))
        self.sets = [s for s, _ in by_set.values()]
        self.ids = [ids for _, ids in by_set.values()]
        self.need = np.array([at_least(percent, len(s)) for s in self.sets], np.int64)
        parts: dict[int, list] = {}
        for i, s in enumerate(self.sets):
            parts.setdefault(len(s).bit_length(), []).append(i)
        self.parts = []
        for k in sorted(parts):
            own = parts[k]
            keys = np.concatenate([self.sets[i][: len(self.sets[i]) - self.need[i] + 1] for i in own])  # sets are in hash order: the least values
            item = np.concatenate([np.full(len(self.sets[i]) - self.need[i] + 1, i) for i in own])
            order = np.argsort(keys, kind="stable")
            self.parts.append((int(self.need[own].min()), keys[order], item[order]))
        self.seen = np.zeros(1 << 20, bool)
        for _, keys, _ in self.parts:
            self.seen[(keys >> np.uint64(44)).astype(np.int64)] = True

    def matches(self, h: np.ndarray) -> list[tuple]:
        """(item index, its shingles in the document) of every item contained well enough in a document's shingles."""
        h = distinct(h)
        hit = h[self.seen[(h >> np.uint64(44)).astype(np.int64)]]
        if not len(hit):
            return []
        found: set[int] = set()
        for least, keys, item in self.parts:
            if least > len(h):
                break
            lo, hi = np.searchsorted(keys, hit, "left"), np.searchsorted(keys, hit, "right")
            for a, b in zip(lo[hi > lo], hi[hi > lo], strict=True):
                found.update(item[a:b].tolist())
        out = []
        for i in sorted(found):
            at = np.searchsorted(h, self.sets[i])
            n = int((h[np.minimum(at, len(h) - 1)] == self.sets[i]).sum())
            if n >= self.need[i]:
                out.append((i, n))
        return out


def item_blocks(items: DataFrame, percent: int = PERCENT, block: int = BLOCK_ITEMS):
    """Broadcast indexes of the items, at most about `block` of them in each. Repeated rows are combined, so that any
    number of copies of one item is one entry of its block, with the number of its rows."""
    items = items.filter("text IS NOT NULL").groupBy("item_id", F.col("text").cast("binary").alias("data")).agg(F.count(F.lit(1)).alias("rows"))
    items = materialize(items, "items")
    n = math.ceil(items.count() / block)
    part = F.pmod(F.xxhash64("item_id", "data"), F.lit(max(1, n)))
    for i in range(n):
        rows = [(r["item_id"], bytes(r["data"]), r["rows"]) for r in items.filter(part == i).collect()]
        yield items.sparkSession.sparkContext.broadcast(ItemIndex(rows, percent))


def find_items(docs: DataFrame, items: DataFrame, percent: int = PERCENT) -> DataFrame:
    """One row per (document row, item) where the document holds percent % or more of the item's distinct shingles.

    Columns doc_id, item_id, n_shingles (the item's), n_found. Null and empty texts and items hold nothing; null ids
    and repeated rows are reported as they are; extra columns are ignored; without items there are no rows.
    """
    source = docs.select("doc_id", F.col("text").cast("binary").alias("data"))
    kind = T.StructType([source.schema["doc_id"], T.StructField("item_id", items.schema["item_id"].dataType), T.StructField("n_shingles", T.LongType()), T.StructField("n_found", T.LongType())])
    arrow = to_arrow_schema(kind)
    out = None
    for index in item_blocks(items, percent):

        def scan(batches, index=index):
            own = index.value
            for batch in batches:
                rows = [(doc_id, item, len(own.sets[i]), n) for doc_id, data in arrow_rows([batch], 0, 1) for i, n in own.matches(shingles(data)) for item, count in own.ids[i] for _ in range(count)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), arrow, strict=True)], schema=arrow)

        found = source.mapInArrow(scan, kind)
        out = found if out is None else out.unionByName(found)
    return out if out is not None else docs.sparkSession.createDataFrame([], kind)


def decontaminate(docs: DataFrame, items: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The rows of docs that hold no item; each row is judged by its own text, all columns stay.

    Null and empty texts hold nothing and stay, as do null ids; repeated rows go or stay together; texts of any length
    are read whole; items without text are none, and without items or documents docs is returned as it is.
    """
    for index in item_blocks(items, percent):

        @F.pandas_udf("boolean")
        def holds(data):
            import pandas as pd

            own = index.value
            return pd.Series([bool(own.matches(shingles(x))) for x in data], dtype=bool)

        docs = docs.filter(~holds(F.coalesce(F.col("text"), F.lit("")).cast("binary")))
    return docs


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_WORDS = "regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+')"
_SHINGLES = "SELECT DISTINCT id, array_to_string(w[i:i+least(len(w), 5)-1], ' ') AS s FROM (SELECT id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM {t} WHERE len(w) > 0)"
ORACLE = f"""
WITH b AS (SELECT item_id AS id, {_WORDS} AS w FROM benchmark), d AS (SELECT doc_id AS id, {_WORDS} AS w FROM documents),
bs AS ({_SHINGLES.format(t='b')}), ds AS ({_SHINGLES.format(t='d')}), n AS (SELECT id, count(*) AS n FROM bs GROUP BY id)
SELECT ds.id AS doc_id, bs.id AS item_id, n.n AS n_shingles, count(*) AS n_found
FROM bs JOIN ds ON bs.s = ds.s JOIN n ON n.id = bs.id GROUP BY ALL HAVING count(*) * 100 >= 80 * n.n
"""
