"""Candidate generation over ordered rows, and what follows it: extraction, size correction, rewriting.

items: func, pos (order within func), block (windows don't leave one), text, ok (false: forbidden).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from .analytics import batches, corrected, group_candidates, worth_extracting


def window_candidates(items: DataFrame, max_adjacent: int = 10, max_nodes: int = 50, min_savings: int = 1, call_size: int = 5, overhead: int = 8) -> DataFrame:
    """(func, nodes, group_key, callee_size, caller_savings): contiguous windows that end at each row.

    A window reaches back at most max_adjacent rows and stops before a forbidden row or the block's start. Sizes are
    those of the texts; savings are the size less that of a call; a callee has a fixed overhead. Windows of equal
    length and first words form a group. The window of rows of one func is sorted, never gathered.
    """
    n = min(max_adjacent, max_nodes)
    w = Window.partitionBy("func", "block").orderBy("pos")
    size = F.octet_length("text")
    rows = items.select("func", "block", "pos", "ok", "text", size.alias("size"), F.coalesce(F.sum(size).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"),
                        F.row_number().over(w).alias("i"))
    rows = rows.withColumn("bad", F.coalesce(F.max(F.when(~F.col("ok"), F.col("i"))).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0)))
    reach = F.least(F.lit(n), F.col("i") - F.col("bad")).cast("int")
    starts = F.collect_list(F.struct("pos", "before", "text")).over(w.rowsBetween(-(n - 1), 0))
    x = rows.withColumn("back", starts).withColumn("reach", reach).filter("reach > 0")
    x = x.select("func", "pos", "before", "size", "back", F.explode(F.sequence(F.lit(1), "reach")).alias("k"))
    first = F.element_at("back", -F.col("k"))
    total = F.col("before") + F.col("size") - first["before"]
    out = x.select("func", F.array(first["pos"], F.col("pos") + 1).alias("nodes"), F.concat_ws(":", F.col("k"), F.split(first["text"], " ")[0]).alias("group_key"),
                   (total + overhead).alias("callee_size"), (total - call_size).alias("caller_savings"),
                   F.sha2(F.array_join(F.transform(F.slice("back", F.size("back") - F.col("k") + 1, F.col("k")), lambda r: r["text"]), "\n"), 256).alias("callee"))
    return out.filter(F.col("caller_savings") >= min_savings)


def outlinable(sets: DataFrame, dominators: Column | str = "dominators") -> Column:
    """Whether a set may leave its function: rows of arrays nodes, forbidden, forced, dominating, and dominators (of the
    entry, the first node): not empty, nothing forbidden, all that is forced, nothing before the entry that isn't its dominator."""
    inside = F.array_union(F.col("nodes"), dominators if isinstance(dominators, Column) else F.col(dominators))
    return (F.size("nodes") > 0) & ~F.arrays_overlap("nodes", "forbidden") & (F.size(F.array_except("forced", "nodes")) == 0) & (F.size(F.array_except("dominating", inside)) == 0)


def grouped_callees_for_functions(candidates: DataFrame, sizes: DataFrame, batch: int = 64) -> DataFrame:
    """Candidates of worthwhile groups with their batch in the function, and size and savings corrected by the real
    size of their callee (sizes: callee, actual). What isn't worthwhile leaves before anything is extracted."""
    groups = worth_extracting(group_candidates(candidates))
    kept = batches(candidates.join(groups.select("group_key"), "group_key", "left_semi"), ["func"], ["group_key", F.col("nodes")], batch)
    x = kept.join(sizes, "callee")
    size, savings = corrected(F.col("callee_size"), F.col("caller_savings"), F.col("actual"))
    return x.select("func", "group_key", "nodes", "callee", "batch", F.col("callee_size").alias("estimated_callee_size"), F.col("caller_savings").alias("estimated_caller_savings"), size, savings)


def rewrite(functions: DataFrame, new_parts: DataFrame, key: str = "part") -> DataFrame:
    """functions (module, name, part) with parts replaced where new_parts (key, new_part) has another one; the key is the
    part itself or another column of functions."""
    return functions.join(new_parts, key, "left").select("module", "name", F.coalesce("new_part", "part").alias("part"))


def at_most_args(candidates: DataFrame, max_args: int, args: str = "num_args", returns: str = "num_returns") -> DataFrame:
    """Candidates whose arguments and return values, taken together, are no more than max_args."""
    return candidates.filter(F.col(args) + F.col(returns) <= max_args)


def validatable(items: DataFrame, same) -> DataFrame:
    """Items that are equivalent to themselves: what a prover can't show that of can't be refined."""
    return items.filter(same(F.col("value"), F.col("value")))


def copies(functions: DataFrame) -> DataFrame:
    return functions.groupBy("part").agg(F.count(F.lit(1)).alias("copies"))


def size_report(lines: DataFrame) -> DataFrame:
    """(experiment, text_size): the first field of the second line of each experiment's size output (output)."""
    return lines.select("experiment", F.split(F.trim(F.split("output", "\n")[1]), r"\s+")[0].cast("long").alias("text_size"))


def matches_sections(symbols: DataFrame, lists: DataFrame) -> DataFrame:
    """(module, name, section): sections of lists (section, module_glob, name_glob) that a symbol falls under.

    Globs know * and ?. Lists are short and written by hand; they are broadcast after they have been counted.
    """

    def pattern(c: str) -> Column:
        quoted = F.regexp_replace(c, r"([.\\+^$|(){}\[\]])", r"\\$1")
        return F.concat(F.lit("^"), F.replace(F.replace(quoted, F.lit("*"), F.lit(".*")), F.lit("?"), F.lit(".")), F.lit("$"))

    p = lists.select("section", pattern("module_glob").alias("mp"), pattern("name_glob").alias("np"))
    if p.count() <= 10_000:
        p = F.broadcast(p)
    return symbols.join(p, F.expr("module RLIKE mp AND name RLIKE np")).select("module", "name", "section").distinct()
