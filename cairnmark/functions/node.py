"""Values of the store (nodes): canonical CBOR and JSON forms, ordering, and Spark columns for them.

A node is None, bool, int (-2**63 to 2**64 - 1), float, str, bytes, CID (a link), a list or a dict with string keys.
"""

from __future__ import annotations

import base64
import json
import math
import struct

import pandas as pd
from pyspark.sql import functions as F, types as T

from .cid import CID, DAG_CBOR, DAG_CBOR_UNRESTRICTED, RAW

INT_MIN, INT_MAX, UINT_MAX = -(1 << 63), (1 << 63) - 1, (1 << 64) - 1
KINDS = ("null", "boolean", "integer", "float", "string", "bytes", "list", "map", "link")


class NodeError(ValueError):
    pass


def kind(v) -> str:
    for k, t in (("null", type(None)), ("boolean", bool), ("integer", int), ("float", float), ("string", str), ("bytes", bytes), ("list", list), ("map", dict), ("link", CID)):
        if isinstance(v, t):
            return k
    raise NodeError(f"no node: {type(v)}")


def key_order(key: str) -> tuple[int, bytes]:
    """Shorter keys (in bytes) first, then bytewise."""
    b = key.encode()
    return len(b), b


def sort_key(v):
    """A key for the documented order: by kind, then by value; maps by their entries in key order."""
    k = kind(v)
    rank = KINDS.index(k)
    if k == "float":
        return rank, (0, 0.0) if math.isnan(v) else (1, v)
    if k == "string":
        return rank, v.encode()
    if k == "list":
        return rank, [sort_key(x) for x in v]
    if k == "map":
        return rank, [(key_order(x), sort_key(v[x])) for x in sorted(v, key=key_order)]
    return rank, v.data if k == "link" else 0 if v is None else v


def links(v) -> list[CID]:
    """Links in the node, depth first, with repeats."""
    if isinstance(v, CID):
        return [v]
    if isinstance(v, list):
        return [x for y in v for x in links(y)]
    if isinstance(v, dict):
        return [x for y in sorted(v, key=key_order) for x in links(v[y])]
    return []


# --- CBOR ---


def _head(major: int, n: int) -> bytes:
    for size, info, most in ((0, n, 23), (1, 24, 0xFF), (2, 25, 0xFFFF), (4, 26, 0xFFFFFFFF), (8, 27, UINT_MAX)):
        if n <= most:
            return bytes([major << 5 | info]) + n.to_bytes(size, "big")[:size] if size else bytes([major << 5 | n])
    raise NodeError("integer out of range")


def to_cbor(v) -> bytes:
    k = kind(v)
    if k == "null":
        return b"\xf6"
    if k == "boolean":
        return b"\xf5" if v else b"\xf4"
    if k == "integer":
        if not INT_MIN <= v <= UINT_MAX:
            raise NodeError("integer out of range")
        return _head(0, v) if v >= 0 else _head(1, -1 - v)
    if k == "float":
        return b"\xfb" + (b"\x7f\xf8" + bytes(6) if math.isnan(v) else struct.pack(">d", v))
    if k == "string":
        b = v.encode()
        return _head(3, len(b)) + b
    if k == "bytes":
        return _head(2, len(v)) + v
    if k == "link":
        return _head(6, 42) + _head(2, len(v.data) + 1) + b"\0" + v.data
    if k == "list":
        return _head(4, len(v)) + b"".join(map(to_cbor, v))
    return _head(5, len(v)) + b"".join(to_cbor(x) + to_cbor(v[x]) for x in sorted(v, key=key_order))


class _Reader:
    def __init__(self, data: bytes):
        self.data, self.at = bytes(data), 0

    def take(self, n: int) -> bytes:
        if n > len(self.data) - self.at:
            raise NodeError("CBOR is cut off")
        self.at += n
        return self.data[self.at - n : self.at]

    def head(self) -> tuple[int, int, int | None]:
        b = self.take(1)[0]
        major, info = b >> 5, b & 31
        if info < 24:
            return major, info, info
        if info < 28:
            return major, info, int.from_bytes(self.take(1 << (info - 24)), "big")
        if info == 31 and major in (2, 3, 4, 5, 7):
            return major, info, None
        raise NodeError("reserved additional information")

    def at_break(self) -> bool:
        if self.data[self.at : self.at + 1] == b"\xff":
            self.at += 1
            return True
        return False

    def chunks(self, major: int, n: int | None) -> bytes:
        if n is not None:
            return self.take(n)
        out = b""
        while not self.at_break():
            m, _, k = self.head()
            if m != major or k is None:
                raise NodeError("bad chunk of an indefinite string")
            if m == 3:
                part = self.take(k)
                _text(part)
                out += part
            else:
                out += self.take(k)
        return out

    def value(self):
        major, info, n = self.head()
        if major == 0:
            return n
        if major == 1:
            if -1 - n < INT_MIN:
                raise NodeError("integer out of range")
            return -1 - n
        if major == 2:
            return self.chunks(2, n)
        if major == 3:
            return _text(self.chunks(3, n))
        if major == 4:
            out = []
            while len(out) != n if n is not None else not self.at_break():
                out.append(self.value())
            return out
        if major == 5:
            out, i = {}, 0
            while i != n if n is not None else not self.at_break():
                key = self.value()
                if not isinstance(key, str):
                    raise NodeError("map key is no string")
                out[key] = self.value()  # the last of equal keys wins
                i += 1
            return out
        if major == 6:
            inner = self.value() if n == 42 else None
            if not isinstance(inner, bytes) or inner[:1] != b"\0":
                raise NodeError("unsupported tag")
            return CID.from_bytes(inner[1:])
        if info in (20, 21):
            return info == 21
        if info in (22, 23):
            return None
        if info in (25, 26, 27):
            return struct.unpack({25: ">e", 26: ">f", 27: ">d"}[info], n.to_bytes(1 << (info - 24), "big"))[0]
        raise NodeError("unsupported simple value")


def _text(b: bytes) -> str:
    try:
        return b.decode()
    except UnicodeDecodeError as e:
        raise NodeError("bad UTF-8") from e


def from_cbor(data: bytes):
    r = _Reader(data)
    v = r.value()
    if r.at != len(r.data):
        raise NodeError("bytes after the value")
    return v


def from_cbor_sequence(data: bytes) -> list:
    r, out = _Reader(data), []
    while r.at < len(r.data):
        out.append(r.value())
    return out


def is_dag_cbor(v) -> bool:
    """Whether the node has neither unsigned integers beyond 2**63 - 1 nor non-finite floats."""
    k = kind(v)
    if k == "integer":
        return v <= INT_MAX
    if k == "float":
        return math.isfinite(v)
    return all(map(is_dag_cbor, v if k == "list" else v.values())) if k in ("list", "map") else True


def to_ipld(v, identity: bool = True) -> tuple[CID, bytes]:
    """(CID, content) of a node: bytes are stored raw, everything else as CBOR."""
    if isinstance(v, bytes):
        content_type, content = RAW, v
    else:
        content_type, content = DAG_CBOR if is_dag_cbor(v) else DAG_CBOR_UNRESTRICTED, to_cbor(v)
    return CID.calculate(content_type, content, None if identity else 0xB220), content


def from_ipld(cid: CID, content: bytes | None = None):
    """The node of a CID; identity CIDs hold their own content."""
    content = cid.hash_bytes if cid.is_identity else content
    return bytes(content) if cid.content_type == RAW else from_cbor(content)


# --- JSON ---


def float_text(x: float) -> str:
    """Shortest digits in ECMAScript's layout, but -0 keeps its sign."""
    if math.isnan(x):
        return "NaN"
    if math.isinf(x):
        return "Infinity" if x > 0 else "-Infinity"
    sign = "-" if math.copysign(1, x) < 0 else ""
    if x == 0:
        return sign + "0"
    mantissa, _, exp = f"{abs(x)!r}".partition("e")
    whole, _, part = mantissa.partition(".")
    digits = (whole + (part if part != "0" else "")).lstrip("0")
    lead = len(whole) if whole != "0" else len(part.lstrip("0")) - len(part)
    point = lead + int(exp or 0)
    digits = digits.rstrip("0")
    k = len(digits)
    if k <= point <= 21:
        return sign + digits + "0" * (point - k)
    if 0 < point <= 21:
        return sign + digits[:point] + "." + digits[point:]
    if -6 < point <= 0:
        return sign + "0." + "0" * -point + digits
    e = point - 1
    return sign + digits[0] + ("." + digits[1:] if k > 1 else "") + "e" + ("+" if e >= 0 else "-") + str(abs(e))


def to_json(v, base: str = "base64url") -> str:
    k = kind(v)
    if k == "float":
        return json.dumps({"float": float_text(v)}, separators=(",", ":"))
    if k == "bytes":
        return '{"base64":"' + base64.b64encode(v).decode() + '"}'
    if k == "link":
        return '{"cid":"' + v.as_string(base) + '"}'
    if k == "list":
        return "[" + ",".join(to_json(x, base) for x in v) + "]"
    if k == "map":
        return '{"map":{' + ",".join(json.dumps(x, ensure_ascii=False) + ":" + to_json(v[x], base) for x in sorted(v, key=key_order)) + "}}"
    return json.dumps(v, ensure_ascii=False)


def _pairs(pairs: list) -> dict:
    out = dict(pairs)
    if len(out) != len(pairs):
        raise NodeError("duplicate key")
    return out


def _reject(text: str):
    raise NodeError(f"number {text} is no integer")


def from_json(text: str):
    try:
        return _lift(json.loads(text, object_pairs_hook=_pairs, parse_float=_reject, parse_constant=_reject))
    except json.JSONDecodeError as e:
        raise NodeError(str(e)) from e


def _lift(v):
    if isinstance(v, int) and not isinstance(v, bool) and not INT_MIN <= v <= UINT_MAX:
        raise NodeError("integer out of range")
    if isinstance(v, list):
        return [_lift(x) for x in v]
    if not isinstance(v, dict):
        return v
    if len(v) != 1:
        raise NodeError("special object needs one member")
    ((tag, x),) = v.items()
    if tag == "map" and isinstance(x, dict):
        return {k: _lift(y) for k, y in x.items()}
    if not isinstance(x, str):
        raise NodeError("bad special object")
    if tag == "float":
        try:
            return {"NaN": math.nan, "Infinity": math.inf, "-Infinity": -math.inf}.get(x, None) if x in ("NaN", "Infinity", "-Infinity") else float(x)
        except ValueError as e:
            raise NodeError("bad float") from e
    if tag == "base64":
        try:
            return base64.b64decode(x, validate=True)
        except ValueError as e:
            raise NodeError("bad base64") from e
    if tag == "cid" and x[:1] == "u":
        try:
            return CID.parse(x)
        except ValueError as e:
            raise NodeError("bad CID") from e
    raise NodeError("unknown special object")


# --- columns ---

BLOCK = T.StructType([T.StructField("cid", T.BinaryType()), T.StructField("content_type", T.IntegerType()), T.StructField("hash_type", T.IntegerType()), T.StructField("content", T.BinaryType())])


def _block(v) -> tuple:
    cid, content = to_ipld(v)
    return cid.data, cid.content_type, 0 if cid.is_identity else 0xB220, content


@F.pandas_udf(BLOCK)
def block_of_json(s: pd.Series) -> pd.DataFrame:
    """Block of a node given as JSON."""
    return pd.DataFrame([_block(from_json(x)) for x in s], columns=["cid", "content_type", "hash_type", "content"])


@F.pandas_udf(BLOCK)
def block_of_text(s: pd.Series) -> pd.DataFrame:
    """Block of a string node (null: the null node)."""
    return pd.DataFrame([_block(None if x is None else x) for x in s], columns=["cid", "content_type", "hash_type", "content"])


@F.pandas_udf(T.StringType())
def text_of_block(cid: pd.Series, content: pd.Series) -> pd.Series:
    """Text of string nodes; null for nodes of other kinds."""
    nodes = (from_ipld(CID(bytes(c)), x) for c, x in zip(cid, content, strict=True))
    return pd.Series([v if isinstance(v, str) else None for v in nodes], dtype=object)


@F.pandas_udf(T.StringType())
def json_of_block(cid: pd.Series, content: pd.Series) -> pd.Series:
    return pd.Series([None if c is None else to_json(from_ipld(CID(bytes(c)), x)) for c, x in zip(cid, content, strict=True)], dtype=object)


@F.pandas_udf(T.ArrayType(T.BinaryType()))
def links_of_block(cid: pd.Series, content: pd.Series) -> pd.Series:
    return pd.Series([[x.data for x in links(from_ipld(CID(bytes(c)), y))] for c, y in zip(cid, content, strict=True)], dtype=object)


@F.pandas_udf(T.StringType())
def kind_of_block(cid: pd.Series, content: pd.Series) -> pd.Series:
    return pd.Series([kind(from_ipld(CID(bytes(c)), y)) for c, y in zip(cid, content, strict=True)], dtype=object)


def inline_content(cid):
    """Content of an identity CID (null for others), with built-in functions: heads of 4 bytes, or 5 for type 0x0171."""
    at = F.when(F.substring(cid, 2, 1) == F.lit(b"\xf1"), 4).otherwise(3)
    return F.when(F.substring(cid, at, F.lit(1)) == F.lit(b"\x00"), F.substring(cid, at + 2, F.octet_length(cid)))


@F.pandas_udf(T.StructType([T.StructField("content_type", T.IntegerType()), T.StructField("hash_type", T.IntegerType())]))
def block_head(cid: pd.Series) -> pd.DataFrame:
    """Content and hash type of each CID."""
    rows = [CID(bytes(c))._fields()[:2] for c in cid]
    return pd.DataFrame(rows, columns=["content_type", "hash_type"])


@F.pandas_udf(T.ArrayType(T.BinaryType()))
def links_of_json(json: pd.Series) -> pd.Series:
    return pd.Series([[c.data for c in links(from_json(x))] for x in json], dtype=object)


@F.pandas_udf(T.StringType())
def replace_links(json: pd.Series, values: pd.Series) -> pd.Series:
    """JSON with links replaced by JSON of their targets; values: by base 64 of the link."""

    def put(v, known):
        if isinstance(v, CID):
            got = known.get(base64.b64encode(v.data).decode())
            return v if got is None else from_json(got)
        if isinstance(v, list):
            return [put(x, known) for x in v]
        if isinstance(v, dict):
            return {k: put(x, known) for k, x in v.items()}
        return v

    keyed = [{k.replace("\r\n", ""): v for k, v in dict(m or {}).items()} for m in values]
    return pd.Series([to_json(put(from_json(j), m)) for j, m in zip(json, keyed, strict=True)], dtype=object)
