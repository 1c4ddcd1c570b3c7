"""Names of the store as URIs: /cid/C, /head/any/slashes, /call/func/C,C."""

from __future__ import annotations

from dataclasses import dataclass
from urllib.parse import quote, unquote

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

from .cid import CID

SAFE = "-._~!$&'()*+,;=:@"


@dataclass(frozen=True)
class Name:
    kind: str  # cid, head or call
    cid: CID | None = None
    head: str | None = None
    func: str | None = None
    args: tuple[CID, ...] = ()

    def uri(self) -> str:
        if self.kind == "cid":
            return f"/cid/{self.cid}"
        if self.kind == "head":
            return "/head/" + quote(self.head, safe=SAFE + "/")
        return f"/call/{quote(self.func, safe=SAFE)}/" + ",".join(map(str, self.args))


def parse_uri(uri: str) -> Name:
    path, _, _ = uri.partition("?")
    parts = path.split("/")
    if parts[0] or len(parts) < 3:
        raise ValueError(f"no name: {uri}")
    if any(unquote(p) in (".", "..") for p in parts[1:]):
        raise ValueError("dot segments are not allowed")
    kind, rest = parts[1], [unquote(p, errors="strict") for p in parts[2:]]
    if kind == "cid" and len(rest) == 1:
        return Name("cid", cid=CID.parse(rest[0]))
    if kind == "head" and "/".join(rest):
        return Name("head", head="/".join(rest))
    if kind == "call" and len(rest) == 2 and rest[0]:
        return Name("call", func=rest[0], args=tuple(CID.parse(a) for a in rest[1].split(",") if a))
    raise ValueError(f"no name: {uri}")


def query_parameters(uri: str) -> list[tuple[str, str]]:
    _, _, query = uri.partition("?")
    return [(unquote(k), unquote(v)) for k, _, v in (p.partition("=") for p in query.split("&") if p)]


@F.pandas_udf(T.MapType(T.StringType(), T.StringType()))
def last_parameters(uri: pd.Series) -> pd.Series:
    """Query parameters of each URI; of those given several times the last value counts."""
    return pd.Series([None if u is None else dict(query_parameters(u)) for u in uri], dtype=object)


def uri_parts(uri: Column) -> Column:
    """struct(scheme, host, path, query, fragment) with built-in functions; parts that are missing are empty."""
    get = lambda p, i: F.coalesce(F.regexp_extract(uri, p, i), F.lit(""))
    rx = r"^(?:([A-Za-z][A-Za-z0-9+.\-]*)://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"
    return F.struct(*[get(rx, i).alias(n) for i, n in enumerate(("scheme", "host", "path", "query", "fragment"), 1)])


@F.pandas_udf(T.StringType())
def uri_text(head: pd.Series) -> pd.Series:
    """URI of each head's name."""
    return pd.Series([None if h is None else Name("head", head=h).uri() for h in head], dtype=object)


def latin1_to_utf8(b: Column) -> Column:
    """Symbol bytes read as ISO-8859-1."""
    return F.decode(b, "ISO-8859-1")


def html_escape(s: Column) -> Column:
    """Only < and " are escaped."""
    return F.replace(F.replace(s, F.lit("<"), F.lit("&lt;")), F.lit('"'), F.lit("&quot;"))
