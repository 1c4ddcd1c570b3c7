"""Sharding by balanced label propagation, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import hash_bucket, materialize, n_buckets, running_sum, small, table

#: A hub (group of linked rows) heavier than this part of a shard moves row by row when room is short.
HOT_PART = 0.01
#: Rows of one hub that meet in a task; hubs with more are dealt over as many tasks as that makes.
HUB_ROWS = 1_000


def _unit(*cols) -> Column:
    """Uniform in [0, 1) by hash."""
    return F.pmod(F.xxhash64(*cols), F.lit(1 << 30)) / F.lit(float(1 << 30))


def _loads(df: DataFrame, n: int) -> list[float]:
    """Weight by shard: n numbers."""
    got = {r["shard"]: r["w"] for r in df.groupBy("shard").agg(F.sum("w").alias("w")).collect()}
    return [float(got.get(s) or 0) for s in range(n)]


def _dealt(hubs: DataFrame) -> DataFrame:
    """hubs (hub, n, ...) once for each salt that its rows have."""
    return hubs.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / HUB_ROWS)))).drop("n")


def link(rows: DataFrame) -> DataFrame:
    """The rows (rid, hub, w) of hubs of two or more rows, with a salt that deals out the rows of large hubs."""
    hubs = materialize(rows.groupBy("hub").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "hubs")
    hot = small(hubs.filter(F.col("n") > HUB_ROWS))
    salted = rows.join(hot, "hub", "left").withColumn("salt", F.pmod(F.xxhash64("rid"), F.floor((F.coalesce("n", F.lit(1)) - 1) / HUB_ROWS) + 1)).drop("n")
    return salted.join(_dealt(hubs), ["hub", "salt"], "left_semi")


def cut_links(placed: DataFrame) -> DataFrame:
    """(rows, links, cut) of rows (hub, shard): a link joins a row to its hub, which stands where most of its rows are."""
    cells = placed.groupBy("hub", "shard").agg(F.count(F.lit(1)).alias("n"))
    per = cells.groupBy("hub").agg(F.sum("n").alias("n"), F.max("n").alias("home"))
    return per.agg(F.sum("n").alias("rows"), F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("links"), F.sum(F.col("n") - F.col("home")).alias("cut"))


def propagate(linked: DataFrame, n_shards: int, capacity: float, rounds: int = 4) -> DataFrame:
    """Moves rows (rid, hub, salt, w) between shards towards where most of their hub's weight is.

    Every round each hub prefers the shard that holds most of its weight; its other rows move there as far as the
    shard's quota (capacity less load) allows, where quota is short by hash of the hub, or of the row in hot hubs.
    Weights are summed per (hub, shard) before anything meets, so a hot hub is 16 numbers, not a gathered group, and
    these go to its rows by hub and salt.
    """
    now = materialize(linked.withColumn("shard", hash_bucket(n_shards, F.lit("start"), "rid")), "lp")
    for step in range(rounds):
        loads = _loads(now, n_shards)
        cells = now.groupBy("hub", "shard").agg(F.sum("w").alias("cw"), F.count(F.lit(1)).alias("cn"))
        pref = cells.groupBy("hub").agg(F.max_by("shard", F.struct("cw", (-F.col("shard")).alias("s"))).alias("to"), F.sum("cw").alias("hub_w"), F.sum("cn").alias("n"))
        moving = now.join(_dealt(pref), ["hub", "salt"]).withColumn("moves", F.col("to") != F.col("shard"))
        want = {r["to"]: float(r["w"]) for r in moving.filter("moves").groupBy("to").agg(F.sum("w").alias("w")).collect()}
        if not want:
            break
        share = [min(1.0, max(0.0, capacity - loads[s]) / want[s]) if s in want else 0.0 for s in range(n_shards)]
        if not any(share):
            break
        u = F.when(F.col("hub_w") > HOT_PART * capacity, _unit(F.lit(step), "rid")).otherwise(_unit(F.lit(step), "hub"))
        goes = F.col("moves") & (u < F.element_at(F.array(*map(F.lit, share)), F.col("to") + 1))
        now = materialize(moving.select("rid", "hub", "salt", "w", F.when(goes, F.col("to")).otherwise(F.col("shard")).alias("shard")), "lp")
    return now


def _fill(free: DataFrame, room: list[float]) -> Column:
    """Shard of a free row by where the middle of its weight falls in the shards' room, taken one after another."""
    total, edge, cond = sum(room), 0.0, None
    for s, r in enumerate(room):
        edge += r
        here = (F.col("before") + F.col("w") / 2) * F.lit(total) < F.lit(edge) * F.col("_all")
        if r > 0:
            cond = F.when(here, F.lit(s)) if cond is None else cond.when(here, F.lit(s))
    last = max((s for s, r in enumerate(room) if r > 0), default=0)
    return F.lit(last) if cond is None else cond.otherwise(F.lit(last))


def balance(rows: DataFrame, linked: DataFrame, n_shards: int, law: str) -> DataFrame:
    """(rid, shard) of all rows: linked ones as propagated up to each shard's target, the rest fills what room is left."""
    n, total = rows.agg(F.count(F.lit(1)), F.sum("w")).first()
    total = float(total or 0)
    targets = [float(int(total) // n_shards + (s < int(total) % n_shards)) for s in range(n_shards)] if law == "rows" else [total / n_shards] * n_shards
    b = n_buckets(n)
    cut = running_sum(linked.withColumn("bucket", hash_bucket(b, "hub", "salt")), ["shard"], "bucket", ["hub", "rid"], F.col("w"), "before")
    stays = F.col("before") + F.col("w") <= F.element_at(F.array(*map(F.lit, targets)), F.col("shard") + 1)
    kept = materialize(cut.filter(stays).select("rid", "w", "shard"), "kept")
    mean = total / max(1, n)
    # heavy rows first, so that light ones even out what those leave
    phase = F.when(F.col("w") > 4 * mean, 0).when(F.col("w") > mean / 2, 1).otherwise(2)
    free = rows.join(kept.select("rid"), "rid", "left_anti").withColumn("phase", phase).withColumn("bucket", hash_bucket(n_buckets(n), F.lit("free"), "rid"))
    free = running_sum(materialize(free.select("rid", "w", "phase", "bucket"), "free"), ["phase"], "bucket", ["rid"], F.col("w"), "before")
    free = materialize(free, "free")
    sums = {r["phase"]: float(r["w"]) for r in free.groupBy("phase").agg(F.sum("w").alias("w")).collect()}
    placed = kept.select("rid", "w", "shard")
    loads = _loads(kept, n_shards)
    for p in sorted(sums):
        left = sum(w for q, w in sums.items() if q >= p)
        room = [max(0.0, t - x) for t, x in zip(targets, loads, strict=True)]
        part = sums[p] / left
        room = [r * part for r in room] if law != "rows" else room
        here = free.filter(F.col("phase") == p).withColumn("_all", F.lit(sums[p]))
        here = here.select("rid", "w", _fill(here, room).alias("shard"))
        if p < max(sums):
            loads = [x + y for x, y in zip(loads, _loads(here, n_shards), strict=True)]
        placed = placed.unionByName(here)
    return placed.select("rid", F.col("shard").cast("int").alias("shard"))


def assign_shards(docs: DataFrame, n_shards: int = 16, law: str = "rows", rounds: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Puts every row of docs into a shard, equal texts together as far as capacity allows.

    law 'rows': shard counts differ by one at most; 'bytes': byte sums differ by about a light row. Links run from
    each row to a hub, its text, so n copies make n links. Null and empty texts are the same text of no bytes; null
    or repeated ids are rows like any other; an empty table gives no rows; other columns are ignored.
    Returns doc_id, size, text_crc32, law, shard, slot (gapless from 0 in each shard).
    """
    if law not in ("rows", "bytes"):
        raise ValueError(f"unknown law {law}")
    text = F.coalesce(F.col(text_col), F.lit(""))
    size = F.octet_length(text).cast("long") + 1
    base = docs.select(F.col(id_col).alias("doc_id"), size.alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.unhex(F.md5(text.cast("binary"))).alias("hub"))
    base = materialize(base.withColumn("rid", F.monotonically_increasing_id()), "docs")
    rows = base.select("rid", "hub", (F.lit(1).cast("long") if law == "rows" else F.col("size")).alias("w"))
    total = float(rows.agg(F.sum("w")).first()[0] or 0)
    linked = propagate(link(rows), n_shards, total / n_shards, rounds)
    placed = balance(rows.select("rid", "w"), linked, n_shards, law)
    n = base.count()
    out = materialize(base.join(placed, "rid").withColumn("bucket", hash_bucket(n_buckets(n), "rid")), "placed")
    out = running_sum(out, ["shard"], "bucket", ["rid"], F.lit(1), "slot")
    return out.select("doc_id", "size", "text_crc32", F.lit(law).alias("law"), "shard", F.col("slot").cast("long").alias("slot"))


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign_shards(table(spark, sf_dir, "documents")).withColumn("grown_shard", F.lit(None).cast("int"))
