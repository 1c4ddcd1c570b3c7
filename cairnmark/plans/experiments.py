"""Named plans that refer to each other: each is built once, from files, other plans, or both.

A plan is {"file": path, "format": ...} or {"call": function name, "args": [...]}; an argument "${var:x}" is the frame
of plan x, anything else is passed as it is. Frames are lazy, so only what a result needs is computed.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_VAR = re.compile(r"\$\{var:([^}]+)\}")


class Plans:
    def __init__(self, spark: SparkSession, config: dict[str, dict], functions: dict[str, Callable]):
        self.spark, self.config, self.functions = spark, config, {"id": lambda x: x, **functions}
        self._built: dict[str, DataFrame] = {}
        self._open: list[str] = []

    def get(self, name: str) -> DataFrame:
        if name in self._built:
            return self._built[name]
        if name not in self.config:
            raise KeyError(f"no plan {name}")
        if name in self._open:
            raise ValueError("plans refer to each other: " + " > ".join([*self._open, name]))
        self._open.append(name)
        try:
            spec = self.config[name]
            if "file" in spec:
                out = self.spark.read.format(spec.get("format", "parquet")).load(spec["file"])
            else:
                out = self.functions[spec["call"]](*map(self._argument, spec.get("args", [])))
        finally:
            self._open.pop()
        self._built[name] = out
        return out

    def _argument(self, x):
        m = _VAR.fullmatch(x) if isinstance(x, str) else None
        return self.get(m[1]) if m else x
