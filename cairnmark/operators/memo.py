"""Memoized evaluation: registered functions over batches of calls, computed once per (func, args).

Requests are split by joins into hits and misses; misses are deduplicated before they are computed by mapInPandas, and
their results are appended to the calls. A function's version is part of its name, so a new version misses the old calls.
"""

from __future__ import annotations

import os
import time
from collections.abc import Callable
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from cairnmark.functions import node
from cairnmark.functions.cid import CID
from cairnmark.functions.names import Name
from cairnmark.session import materialize


@dataclass
class Registry:
    """Functions by versioned name: arity and a function of that many nodes that returns a node."""

    funcs: dict[str, tuple[int, Callable]] = field(default_factory=dict)
    nested: set[str] = field(default_factory=set)

    def register(self, name: str, arity: int, fn: Callable) -> None:
        if name in self.funcs:
            raise ValueError(f"{name} is registered already")
        self.funcs[name] = (arity, fn)

    def register_nested(self, name: str, arity: int, fn: Callable) -> None:
        """A function whose first parameter, ahead of the nodes, is Calls: through it, it calls other functions."""
        self.register(name, arity, fn)
        self.nested.add(name)


def hits(requests: DataFrame, calls: DataFrame, keys: list[str]) -> DataFrame:
    return requests.join(calls.select(*keys), keys, "left_semi")


def misses(requests: DataFrame, calls: DataFrame, keys: list[str]) -> DataFrame:
    """Requests without a cached call, each once."""
    return requests.dropDuplicates(keys).join(calls.select(*keys), keys, "left_anti")


def pending(requests: DataFrame, keys: list[str]) -> DataFrame:
    """Requests that are asked for at the same time, each once, with how often."""
    return requests.groupBy(*keys).agg(F.count(F.lit(1)).alias("asked"))


def normalized_options(options, defaults: dict[str, str]):
    """The entries of a map column that differ from the defaults: what belongs in a cache key."""
    known = F.create_map(*[F.lit(x) for kv in defaults.items() for x in kv])
    return F.map_filter(options, lambda k, v: ~v.eqNullSafe(F.try_element_at(known, k)))


class Pending(Exception):
    """A function needs calls that have no result yet."""

    def __init__(self, calls: list[tuple[str, list]]):
        super().__init__(f"{len(calls)} calls are needed first")
        self.calls = calls


class Calls:
    """What a function that calls others is given: results that are known, and a list of those that it asks for."""

    def __init__(self, known: dict[tuple, object]):
        self.known, self.wanted = known, []

    def get(self, func: str, *args):
        """The result of a call; if it isn't known yet, the function is run again once it is."""
        return self.all([(func, *args)])[0]

    def all(self, calls: list[tuple]) -> list:
        """Results of several calls, which are evaluated at the same time."""
        keys = [(f, *(node.to_ipld(a)[0].data for a in args)) for f, *args in calls]
        missing = [(f, args) for k, (f, *args) in zip(keys, calls, strict=True) if k not in self.known]
        if missing:
            raise Pending(missing)
        return [self.known[k] for k in keys]


BLOCKS = "array<struct<cid: binary, content_type: int, hash_type: int, content: binary>>"


class Evaluator:
    """Evaluates calls against a store; several rounds are needed where functions request others first."""

    def __init__(self, store, registry: Registry):
        self.store, self.registry = store, registry
        self.waiting: list[DataFrame] = []

    def fold(self, start: DataFrame, passes: list[tuple[str, bytes]]) -> DataFrame:
        """(item, cid) after all passes (func, id of its parameters) over start (item, cid), each cached by its input."""
        now = start.select("item", "cid")
        for func, params in passes:
            calls = now.select("item", F.lit(func).alias("func"), F.array(F.lit(bytearray(params)), F.col("cid")).alias("args"))
            done = self.evaluate(calls.select("func", "args"))
            now = materialize(calls.join(done, ["func", "args"]).select("item", F.col("result").alias("cid")), "pass")
        return now

    def evaluate(self, requests: DataFrame) -> DataFrame:
        """func, args, result of all requests (func, args). A function that is missing, or whose arity differs, fails
        before anything runs; a function that raises fails its call with a message that names it.

        Calls that functions ask for are evaluated first, each once however many ask, and what asked for them is run
        again with their results: as many rounds as calls are nested deep. Calls that wait for each other fail.
        """
        wanted = materialize(requests.select("func", "args").distinct(), "wanted")
        open_ = wanted
        while True:
            open_ = materialize(misses(open_, self.store.calls, ["func", "args"]), "open")
            if open_.isEmpty():
                return wanted.join(self.store.calls, ["func", "args"])
            self._check(open_)
            made = self._run(self._ready(open_))
            done = made.filter("cid IS NOT NULL")
            self.store.put_blocks(done.select("cid", "content_type", "hash_type", "content"))
            self.store.set_calls(done.select("func", "args", F.col("cid").alias("result")))
            if self.registry.nested:
                need = made.select("func", "args", F.explode("needs").alias("n"))
                self.store.put_blocks(need.select(F.explode("n.args").alias("b")).select("b.*"))
                self._append_needs(need.select("func", "args", F.col("n.func").alias("need_func"), F.transform("n.args", lambda a: a["cid"]).alias("need_args")))
                asked = self._needs().join(open_, ["func", "args"], "left_semi").select(F.col("need_func").alias("func"), F.col("need_args").alias("args"))
                new = materialize(asked.distinct().join(open_, ["func", "args"], "left_anti"), "asked")
                if done.isEmpty() and new.isEmpty():
                    raise RuntimeError("calls wait for each other")
                open_ = open_.unionByName(new)

    def _check(self, calls: DataFrame) -> None:
        shapes = calls.groupBy("func").agg(F.min(F.size("args")).alias("lo"), F.max(F.size("args")).alias("hi"))
        for r in shapes.toLocalIterator():
            if r["func"] not in self.registry.funcs:
                raise KeyError(f"no implementation of {r['func']}")
            arity = self.registry.funcs[r["func"]][0]
            if not arity == r["lo"] == r["hi"]:
                raise TypeError(f"{r['func']} takes {arity} arguments")

    def _needs(self) -> DataFrame:
        """func, args, need_func, need_args: which calls asked for which."""
        return self.waiting[-1]

    def _append_needs(self, rows: DataFrame) -> None:
        rows = rows if not self.waiting else self.waiting[-1].unionByName(rows)
        self.waiting = [materialize(rows.distinct(), "needs")]

    def _ready(self, calls: DataFrame) -> DataFrame:
        """Calls (func, args, contents, known) all of whose needs are answered; known: func, args, cid, content of those."""
        blocks = self.store.blocks.select("cid", "content")
        none = F.array().cast("array<struct<func: string, args: array<binary>, cid: binary, content: binary>>")
        calls = calls.withColumn("known", none)
        if self.registry.nested and self.waiting:
            answers = self.store.calls.select(F.col("func").alias("need_func"), F.col("args").alias("need_args"), F.col("result").alias("cid"))
            needs = self._needs().join(calls.select("func", "args"), ["func", "args"], "left_semi").join(answers, ["need_func", "need_args"], "left").join(blocks, "cid", "left")
            each = F.struct(F.col("need_func").alias("func"), F.col("need_args").alias("args"), "cid", "content")
            held = needs.groupBy("func", "args").agg(F.count_if(F.col("cid").isNull()).alias("missing"), F.collect_list(each).alias("known"))
            calls = calls.drop("known").join(held, ["func", "args"], "left").filter("coalesce(missing, 0) = 0").select("func", "args", F.coalesce("known", none).alias("known"))
        part = calls.select("func", "args", "known", F.posexplode("args").alias("pos", "cid")).join(blocks, "cid", "left")
        whole = part.groupBy("func", "args").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "content"))), lambda x: x["content"]).alias("contents"), F.first("known").alias("known"))
        return whole.unionByName(calls.filter(F.size("args") == 0).select("func", "args", F.array().cast("array<binary>").alias("contents"), "known"))

    def _run(self, calls: DataFrame) -> DataFrame:
        """func, args and the block of the result of every call, or the calls that it needs first."""
        funcs, nested = self.registry.funcs, self.registry.nested

        def block(v) -> tuple:
            cid, content = node.to_ipld(v)
            return cid.data, cid.content_type, 0 if cid.is_identity else 0xB220, content

        def run(batches):
            for pdf in batches:
                rows = []
                for func, args, contents, known in zip(pdf["func"], pdf["args"], pdf["contents"], pdf["known"], strict=True):
                    cids = [CID(bytes(a)) for a in args]
                    try:
                        values = [node.from_ipld(c, x) for c, x in zip(cids, contents, strict=True)]
                        if func in nested:
                            values.insert(0, Calls({(k["func"], *map(bytes, k["args"])): node.from_ipld(CID(bytes(k["cid"])), k["content"]) for k in known}))
                        rows.append((func, list(args), *block(funcs[func][1](*values)), []))
                    except Pending as e:
                        keys = ("cid", "content_type", "hash_type", "content")
                        rows.append((func, list(args), None, None, None, None, [{"func": f, "args": [dict(zip(keys, block(a), strict=True)) for a in xs]} for f, xs in e.calls]))
                    except Exception as e:
                        raise RuntimeError(f"{Name('call', func=func, args=tuple(cids)).uri()}: {e}") from e
                out = pd.DataFrame(rows, columns=["func", "args", "cid", "content_type", "hash_type", "content", "needs"])
                yield out.astype({"content_type": "Int32", "hash_type": "Int32"})

        kind = f"func string, args array<binary>, cid binary, content_type int, hash_type int, content binary, needs array<struct<func: string, args: {BLOCKS}>>"
        return materialize(calls.mapInPandas(run, kind), "made")


def ackermann(m: int, n: int) -> int:
    """By an explicit stack, with known values remembered."""
    known: dict[tuple[int, int], int] = {}
    stack = [(m, n)]
    while stack:
        a, b = stack[-1]
        if a == 0:
            known[a, b] = b + 1
        elif b == 0:
            if (a - 1, 1) not in known:
                stack.append((a - 1, 1))
                continue
            known[a, b] = known[a - 1, 1]
        else:
            if (a, b - 1) not in known:
                stack.append((a, b - 1))
                continue
            inner = known[a, b - 1]
            if (a - 1, inner) not in known:
                stack.append((a - 1, inner))
                continue
            known[a, b] = known[a - 1, inner]
        stack.pop()
    return known[m, n]


def queens(spark, n: int) -> DataFrame:
    """(solutions) of the n queens problem: boards grow by a row a round, as one explode and filter of bit masks."""
    boards = spark.createDataFrame([(0, 0, 0)], "cols int, up int, down int")
    for _ in range(n):
        bit = F.explode(F.array(*[F.lit(1 << i) for i in range(n)])).alias("bit")
        free = (F.col("cols").bitwiseOR(F.col("up")).bitwiseOR(F.col("down"))).bitwiseAND(F.col("bit")) == 0
        boards = boards.select("*", bit).filter(free).select(
            F.col("cols").bitwiseOR(F.col("bit")).alias("cols"), F.shiftleft(F.col("up").bitwiseOR(F.col("bit")), 1).alias("up"), F.shiftright(F.col("down").bitwiseOR(F.col("bit")), 1).alias("down"))
    return boards.agg(F.count(F.lit(1)).alias("solutions"))


def _nested_ackermann(calls: Calls, m: int, n: int) -> int:
    if m == 0:
        return n + 1
    inner = 1 if n == 0 else calls.get("test.ackermann_calls", m, n - 1)
    return calls.get("test.ackermann_calls", m - 1, inner)


def _nested_sum(calls: Calls, n: int) -> int:
    """n + (n - 1) + ... + 0, each sum a call of its own."""
    return n + calls.get("test.sum_to", n - 1) if n > 0 else 0


def _sleep(seconds: int):
    """Waits and gives null: for tests of calls that take long."""
    time.sleep(seconds)


def _throw():
    raise RuntimeError("an exception, as asked for")


def _fatal():
    """Ends the worker process: for tests of lost workers."""
    os._exit(1)


TEST_FUNCS = Registry()
TEST_FUNCS.register("test.add", 2, lambda a, b: a + b)
TEST_FUNCS.register("test.ackermann", 2, ackermann)
TEST_FUNCS.register("test.sleep", 1, _sleep)
TEST_FUNCS.register("test.throw_exception", 0, _throw)
TEST_FUNCS.register("test.fatal_error", 0, _fatal)
TEST_FUNCS.register_nested("test.ackermann_calls", 2, _nested_ackermann)
TEST_FUNCS.register_nested("test.sum_to", 1, _nested_sum)
