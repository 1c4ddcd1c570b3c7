"""CAR archives: a varint-framed header and blocks, read and written a file at a time.

The root block is a map {"calls": {func: [{"args": [...], "result": link}]}, "heads": {name: link}}.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from cairnmark.functions.cid import CID, get_varint, put_varint
from cairnmark.functions.node import block_head, from_cbor, from_ipld, to_cbor, to_ipld


def frames(data: bytes) -> tuple[list[CID], Iterator[tuple[CID, bytes]]]:
    """(roots, blocks) of an archive."""
    n, at = get_varint(data, 0)
    header = from_cbor(data[at : at + n])
    if not isinstance(header, dict) or header.get("version") != 1:
        raise ValueError("unsupported archive")

    def blocks(at: int):
        while at < len(data):
            size, at = get_varint(data, at)
            part = data[at : at + size]
            if len(part) != size:
                raise ValueError("archive is cut off")
            cid, used = CID.load(part)
            yield cid, part[used:]
            at += size

    return header["roots"], blocks(at + n)


def read_blocks(spark: SparkSession, path: str) -> DataFrame:
    """(path, cid, content) of every block of the archives at path, one task to a file; a file of 2 GB or more fails, as
    it is one value."""

    def parse(frames_of):
        for pdf in frames_of:
            for p, content in zip(pdf["path"], pdf["content"], strict=True):
                _, blocks = frames(bytes(content))
                rows = [(p, c.data, b) for c, b in blocks]
                yield pd.DataFrame(rows, columns=["path", "cid", "content"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(parse, "path string, cid binary, content binary")


def import_archive(store, path: str) -> None:
    """Puts all blocks of an archive in a store and sets its heads and calls."""
    spark = store.spark
    blocks = read_blocks(spark, path).select("cid", "content")
    store.put_blocks(blocks.select("cid", block_head("cid").alias("h"), "content").select("cid", "h.*", "content"))
    for row in spark.read.format("binaryFile").load(path).select("content").toLocalIterator():
        roots, found = frames(bytes(row["content"]))
        held = dict(found)
        for cid in roots:
            root = from_ipld(cid, held.get(cid))
            heads = [(k, bytearray(v.data)) for k, v in root.get("heads", {}).items()]
            calls = [(f, [bytearray(a.data) for a in c["args"]], bytearray(c["result"].data)) for f, cs in root.get("calls", {}).items() for c in cs]
            if heads:
                store.set_heads(spark.createDataFrame(heads, "name string, cid binary"))
            if calls:
                store.set_calls(spark.createDataFrame(calls, "func string, args array<binary>, result binary"))


def export_archive(store, path: str) -> CID:
    """Writes what heads and calls reach to an archive file at path, anywhere that Spark can write; returns the CID of its root.

    An archive is one file, so its writer is one process; blocks come to it a partition at a time.
    """
    root: dict = {"calls": {}, "heads": {}}
    for r in store.heads.orderBy("name").toLocalIterator():
        root["heads"][r["name"]] = CID(bytes(r["cid"]))
    for r in store.calls.orderBy("func", "args").toLocalIterator():
        root["calls"].setdefault(r["func"], []).append({"args": [CID(bytes(a)) for a in r["args"]], "result": CID(bytes(r["result"]))})
    cid, content = to_ipld(root, identity=False)
    header = to_cbor({"roots": [cid], "version": 1})
    live = store.blocks.join(store.reachable(), "cid", "left_semi")
    where = store.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out, waiting = where.getFileSystem(store.spark.sparkContext._jsc.hadoopConfiguration()).create(where, True), bytearray()
    try:
        waiting += put_varint(len(header)) + header
        for key, data in itertools.chain(((bytes(r["cid"]), bytes(r["content"])) for r in live.select("cid", "content").toLocalIterator()), [(cid.data, content)]):
            waiting += put_varint(len(key) + len(data)) + key + data
            if len(waiting) >= 1 << 20:
                out.write(waiting)
                waiting = bytearray()
        out.write(waiting)
    finally:
        out.close()
    return cid
