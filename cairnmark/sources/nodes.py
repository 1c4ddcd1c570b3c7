"""Nodes in files: JSON lines, raw bytes and CBOR sequences in, the same and plain text out; CSV and line files."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from cairnmark.functions import node
from cairnmark.functions.cid import CID

_JSONS = T.ArrayType(T.StringType())


@F.pandas_udf(_JSONS)
def _cbor_values(data: pd.Series) -> pd.Series:
    return pd.Series([[node.to_json(v) for v in node.from_cbor_sequence(bytes(x))] for x in data], dtype=object)


def _guess(data: bytes) -> list[str]:
    """JSON where it reads as such, else a CBOR sequence, else raw bytes."""
    try:
        return [node.to_json(node.from_json(data.decode()))]
    except ValueError:
        pass
    try:
        return [node.to_json(v) for v in node.from_cbor_sequence(data)]
    except ValueError:
        return [node.to_json(data)]


@F.pandas_udf(_JSONS)
def _auto_values(data: pd.Series) -> pd.Series:
    return pd.Series([_guess(bytes(x)) for x in data], dtype=object)


def read_nodes(spark: SparkSession, path: str, form: str = "auto") -> DataFrame:
    """(path, json) of the nodes in the files at path. json: a node on each line; raw: a file is one bytes node;
    cbor: a file is a sequence; auto: decided for each file."""
    if form == "json":
        return spark.read.text(path).select(F.input_file_name().alias("path"), F.col("value").alias("json"))
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    if form == "raw":
        return files.select("path", F.concat(F.lit('{"base64":"'), F.translate(F.base64("content"), "\r\n", ""), F.lit('"}')).alias("json"))
    if form not in ("cbor", "auto"):
        raise ValueError(f"unknown form {form}")
    values = _cbor_values("content") if form == "cbor" else _auto_values("content")
    return files.select("path", F.explode(values).alias("json"))


@F.pandas_udf(T.BinaryType())
def cbor_of_json(json: pd.Series) -> pd.Series:
    return json.map(lambda x: node.to_cbor(node.from_json(x)))


@F.pandas_udf(T.BinaryType())
def raw_of_json(json: pd.Series) -> pd.Series:
    def one(x):
        v = node.from_json(x)
        if not isinstance(v, bytes):
            raise node.NodeError("only bytes can be written raw")
        return v

    return json.map(one)


@F.pandas_udf(T.StringType())
def plain_of_json(json: pd.Series) -> pd.Series:
    """Strings as they are, links as their ids, all else as JSON."""

    def one(x):
        v = node.from_json(x)
        return v if isinstance(v, str) else str(v) if isinstance(v, CID) else x

    return json.map(one)


def write_lines(rows: DataFrame, path: str, order: list) -> None:
    """One text file of the column `text`, in the given order: for formats that are read as a whole."""
    rows.repartitionByRange(1, *order).sortWithinPartitions(*order).select("text").write.text(path)


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.csv(path, header=True)
