"""Access to the parts of nodes in columns of their JSON, and edits that give new nodes. Null JSON is no node: null comes back."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, functions as F

from .node import NodeError, from_json, kind, to_json

class _Missing:
    """Stands for a member that a map lacks; a class is the same in every process."""


def _column(kind_: str, fn: Callable, *args) -> Column:
    """fn(node, *values) of every row; args: the JSON, then columns of JSON or plain values, or Python values."""
    cols = [a if isinstance(a, Column) else F.lit(a) for a in args]

    @F.pandas_udf(kind_)
    def run(*series: pd.Series) -> pd.Series:
        return pd.Series([None if row[0] is None else fn(from_json(row[0]), *row[1:]) for row in zip(*series, strict=True)], dtype=object)

    return run(*cols)


def _held(v, key):
    return v[key] if isinstance(v, dict) and key in v else _Missing


def _strict(v, key):
    found = _held(v, key)
    if found is _Missing:
        raise NodeError(f"no member {key!r}")
    return to_json(found)


def at(json: Column, key) -> Column:
    """The member of a map; fails where there is none."""
    return _column("string", _strict, json, key)


def at_or_null(json: Column, key) -> Column:
    """The member of a map; the null node where there is none."""
    return _column("string", lambda v, k: to_json(None if (x := _held(v, k)) is _Missing else x), json, key)


def get_value_or(json: Column, key, default) -> Column:
    """The member of a map, or default (JSON) where there is none or the node is null."""
    return F.coalesce(_column("string", lambda v, k, d: d if (x := _held(v, k)) is _Missing else to_json(x), json, key, default), default if isinstance(default, Column) else F.lit(default))


def element(json: Column, index) -> Column:
    """The element of a list by its place from 0; negative places count from the end. Fails beyond the ends."""

    def get(v, i):
        if not isinstance(v, list) or not -len(v) <= i < len(v):
            raise NodeError(f"no element {i}")
        return to_json(v[int(i)])

    return _column("string", get, json, index)


def contains(json: Column, key) -> Column:
    """Whether a map has the member."""
    return _column("boolean", lambda v, k: _held(v, k) is not _Missing, json, key)


def size(json: Column) -> Column:
    """Members of a map, elements of a list, bytes of a string or bytes; 0 of all else."""
    return _column("long", lambda v: len(v.encode()) if isinstance(v, str) else len(v) if isinstance(v, (dict, list, bytes)) else 0, json)


def is_empty(json: Column) -> Column:
    return size(json) == 0


def kind_of(json: Column) -> Column:
    return _column("string", kind, json)


def is_integer(json: Column, bits: int, signed: bool = True) -> Column:
    """Whether a node is an integer that fits into so many bits."""
    low, high = (-(1 << bits - 1), (1 << bits - 1) - 1) if signed else (0, (1 << bits) - 1)
    return _column("boolean", lambda v: kind(v) == "integer" and low <= v <= high, json)


def _edited(v, wanted: type):
    if not isinstance(v, wanted):
        raise NodeError(f"{kind(v)} can't be edited so")
    return v


def with_field(json: Column, key, value) -> Column:
    """A map with the member (JSON) added or replaced."""
    return _column("string", lambda v, k, x: to_json({**_edited(v, dict), k: from_json(x)}), json, key, value)


def without_field(json: Column, key) -> Column:
    """A map without the member; one that lacks it is as it was."""
    return _column("string", lambda v, k: to_json({a: b for a, b in _edited(v, dict).items() if a != k}), json, key)


def appended(json: Column, value) -> Column:
    """A list with an element (JSON) at its end."""
    return _column("string", lambda v, x: to_json([*_edited(v, list), from_json(x)]), json, value)


def concatenated(json: Column, other: Column) -> Column:
    """Two lists as one."""
    return _column("string", lambda v, x: to_json(_edited(v, list) + _edited(from_json(x), list)), json, other)
