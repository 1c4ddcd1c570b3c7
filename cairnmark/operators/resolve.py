"""Symbol resolution across modules, and deduplication of definitions that are equal up to renaming.

definitions: module, name, linkage (strong, weak or local), content. references: module, name (of the user), ref.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from cairnmark.session import materialize


def unique_globals(definitions: DataFrame) -> DataFrame:
    """(name, module) of names with exactly one definition that isn't local."""
    g = definitions.filter("linkage <> 'local'").groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.min("module").alias("module"))
    return g.filter("n = 1").select("name", "module")


def resolve_merge(references: DataFrame, definitions: DataFrame) -> DataFrame:
    """A reference binds to its module's own definition, else it stays external."""
    own = definitions.select(F.col("module"), F.col("name").alias("ref"), F.lit(True).alias("own")).distinct()
    return references.join(own, ["module", "ref"], "left").select("module", "name", "ref", F.when(F.col("own"), F.col("module")).alias("target"))


def resolve_guided(references: DataFrame, definitions: DataFrame) -> DataFrame:
    """Own definition, else the only global one, else external."""
    one = unique_globals(definitions).select(F.col("name").alias("ref"), F.col("module").alias("glob"))
    return resolve_merge(references, definitions).join(one, "ref", "left").select("module", "name", "ref", F.coalesce("target", "glob").alias("target"))


def resolve_mux(references: DataFrame, definitions: DataFrame) -> DataFrame:
    """Own definition, else the only strong one, else the first weak one, else external; two strong ones fail."""
    d = definitions.groupBy(F.col("name").alias("ref")).agg(
        F.count_if(F.col("linkage") == "strong").alias("strong"),
        F.min(F.when(F.col("linkage") == "strong", F.col("module"))).alias("s"), F.min(F.when(F.col("linkage") == "weak", F.col("module"))).alias("w"))
    x = resolve_merge(references, definitions).join(d, "ref", "left")
    clash = F.raise_error(F.concat(F.lit("several strong definitions of "), F.col("ref")))
    other = F.when(F.col("strong") > 1, clash).otherwise(F.coalesce("s", "w"))
    return x.select("module", "name", "ref", F.when(F.col("target").isNotNull(), F.col("target")).otherwise(other).alias("target"))


def unique_names(definitions: DataFrame) -> DataFrame:
    """Adds unique_name: the name for its first module, then name.0, name.1 and so on, past those that are taken."""
    n = F.row_number().over(Window.partitionBy("name").orderBy("module")) - 2
    todo = definitions.withColumn("unique_name", F.when(n < 0, F.col("name")).otherwise(F.concat("name", F.lit("."), n.cast("string"))))
    taken = definitions.select("name").distinct().withColumnRenamed("name", "unique_name")
    while True:  # every clash moves to a greater number, so that names settle once they are past those taken
        todo = materialize(todo, "names")
        w = Window.partitionBy("unique_name").orderBy((F.col("unique_name") != F.col("name")).cast("int"), "name", "module")
        marked = todo.withColumn("k", F.row_number().over(w)).join(taken.withColumn("t", F.lit(True)), "unique_name", "left")
        clash = (F.col("k") > 1) | (F.col("t").isNotNull() & (F.col("unique_name") != F.col("name")))
        marked = marked.withColumn("clash", clash)
        if marked.filter("clash").isEmpty():
            return todo
        last = F.element_at(F.split("unique_name", r"\."), -1).cast("long")
        todo = marked.withColumn("unique_name", F.when(F.col("clash"), F.concat("name", F.lit("."), (last + 1).cast("string"))).otherwise(F.col("unique_name"))).select(*todo.columns)


def dedupe_up_to_renaming(definitions: DataFrame, references: DataFrame) -> DataFrame:
    """(module, name, class_module, class_name): definitions whose contents are equal and whose references lead, place by
    place, to equal definitions.

    references: module, name, pos, ref; pos is the place of the reference in its definition. Without that column no
    definition may have several references: their order isn't known, and they fail. A reference that its module
    doesn't define stands for its name. Classes start by content and are split by the classes of their references in
    order, until none splits: cycles need no order. Splitting only adds classes, of which there are no more than
    definitions, so it ends. The first (module, name) of a class stands for it.
    """
    d = definitions.select("module", "name", F.sha2(F.coalesce(F.col("content").cast("binary"), F.lit(b"")), 256).alias("sig"))
    placed = "pos" in references.columns
    refs = references.select("module", "name", F.col("pos") if placed else F.lit(0).alias("pos"), "ref")
    before = -1
    while True:
        d = materialize(d, "classes")
        n = d.select("sig").distinct().count()
        if n == before:
            break
        before = n
        target = d.select("module", F.col("name").alias("ref"), F.col("sig").alias("rs"))
        to = F.coalesce(F.concat(F.lit("="), F.col("rs")), F.concat(F.lit("@"), F.col("ref")))
        r = refs.join(target, ["module", "ref"], "left").groupBy("module", "name").agg(F.array_sort(F.collect_list(F.struct("pos", to.alias("to")))).alias("rs"))
        if not placed:
            r = r.withColumn("rs", F.when(F.size("rs") > 1, F.raise_error(F.lit("several references of a definition need pos"))).otherwise(F.col("rs")))
        each = F.transform("rs", lambda x: F.concat(x["pos"].cast("string"), x["to"]))
        d = d.join(r, ["module", "name"], "left").select("module", "name", F.sha2(F.concat_ws("\x00", "sig", F.coalesce(each, F.array().cast("array<string>"))), 256).alias("sig"))
    first = d.groupBy("sig").agg(F.min(F.struct("module", "name")).alias("f"))
    return d.join(first, "sig").select("module", "name", F.col("f.module").alias("class_module"), F.col("f.name").alias("class_name"))
