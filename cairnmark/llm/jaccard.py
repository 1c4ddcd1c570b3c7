"""N-gram Jaccard join by grouped prefixes.

Every document is a set of hashed 5-word shingles. Shingles have one global order, rare ones first (a fixed-size
count sketch over all documents, then the hash), and a set's prefix of n - ceil(0.8 n) + 1 shingles meets the prefix
of every set that it can link with. Documents with the same prefix and size make one group; groups are paired by
their prefix shingles, pairs are filtered by size and position, then expanded to members and verified on whole sets.

Two sets that link share not one but a known number of prefix shingles, which grows with their sizes: fewer, and a
pair is dropped unseen; and a pair that must share more than it has hot shingles need not be looked for at those.
Pairs are first tried in stars: each group of a shingle against the one whose prefix is the most common, which among
edited copies is the one edited least, whichever components its shingles lie in. What that connects needs no further pairs: all pairs that remain between
different components are verified at last, where of each shingle only groups outside its largest component look for
others. So no component is lost, and copies never make pairs by the square.

Texts edited a little too much to link have many prefix shingles in common all the same. A parity signature tells them
apart before any text is read: each shingle flips one of SIGNATURE bits, so that two sets differ in at least as many
shingles as their signatures do in bits, and sets that differ in more than linking ones may are no pair.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.window import Window

from .common import materialize, small, table
from .graphs import components
from .shingles import arrow_rows, at_least, distinct, shingles

PERCENT = 80
SKETCH_BITS = 22
#: Star rounds before all pairs that are left.
STARS = 2
#: A shingle of more groups than this is hot.
HOT = 32
#: Members that one task verifies against a copy of their centre.
STAR = 200
#: Groups of one shingle that one task compares with those that look for others.
SPLIT = 2_000
#: Bits of a set's parity signature, in words of 64.
SIGNATURE = 512
WORDS = [f"s{i}" for i in range(SIGNATURE // 64)]


def _sketch(docs: DataFrame) -> DataFrame:
    """(bucket, n): frequent buckets of shingle hashes, over all documents; at most 2 ** SKETCH_BITS rows."""

    def scan(batches):
        seen, counts, held, waiting = set(), np.zeros(1 << SKETCH_BITS, np.int64), [], 0
        for (data,) in arrow_rows(batches, 0):
            h = distinct(shingles(data))
            d = xxhash.xxh3_64_intdigest(h.tobytes())
            if d not in seen:
                seen.add(d)
                held.append((h >> np.uint64(64 - SKETCH_BITS)).astype(np.int64))
                waiting += len(h)
            if waiting > 2_000_000:
                counts += np.bincount(np.concatenate(held), minlength=len(counts))
                held, waiting = [], 0
        if held:
            counts += np.bincount(np.concatenate(held), minlength=len(counts))
        at = np.flatnonzero(counts >= max(4.0, 4 * counts.mean()))  # rarer ones stay as rare as any
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(counts[at])], ["bucket", "n"])

    return docs.select(F.col("text").cast("binary")).mapInArrow(scan, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def _prefixes(docs: DataFrame, percent: int) -> DataFrame:
    """(doc_id, text_md5, n, key, gkey, prefix, signature) of every row; prefix only where a task meets a group first."""
    spark = docs.sparkSession
    levels = np.zeros(1 << SKETCH_BITS, np.uint8)
    heavy = _sketch(docs).toArrow()
    levels[heavy["bucket"].to_numpy()] = np.log2(heavy["n"].to_numpy()).astype(np.uint8) + 1
    shared = spark.sparkContext.broadcast(levels)
    kind = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("text_md5", T.BinaryType()), T.StructField("n", T.LongType()), T.StructField("key", T.LongType()), T.StructField("gkey", T.LongType()), T.StructField("prefix", T.ArrayType(T.LongType())), *[T.StructField(w, T.LongType()) for w in WORDS]])
    arrow = to_arrow_schema(kind)

    def scan(batches):
        seen, level = set(), shared.value
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part, rows = batch.slice(start, 512), []
                for doc_id, md5, data in arrow_rows([part], 0, 1, 2):
                    h = distinct(shingles(data))
                    n = len(h)
                    if not n:
                        rows.append((doc_id, md5, 0, None, None, None, *[None] * len(WORDS)))
                        continue
                    place = (level[(h >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)].astype(np.uint64) << np.uint64(58)) | (h >> np.uint64(6))
                    p = n - at_least(percent, n) + 1
                    top = np.argpartition(place, p - 1)[:p] if p < n else np.arange(n)
                    prefix = h[top[np.argsort(place[top], kind="stable")]].view(np.int64)
                    gkey = np.uint64(xxhash.xxh3_64_intdigest(prefix.tobytes(), n)).view(np.int64)
                    first = gkey not in seen
                    seen.add(gkey)
                    rows.append((doc_id, md5, n, set_key(h), int(gkey), prefix if first else None, *signature(h)))
                yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows, strict=True), arrow, strict=True)], schema=arrow)

    text = F.col("text").cast("binary")
    source = docs.select("doc_id", F.unhex(F.md5(F.coalesce(text, F.lit(b"")))).alias("text_md5"), text.alias("data"))
    return source.mapInArrow(scan, kind)


def _tokens(base: DataFrame, percent: int) -> DataFrame:
    """(gkey, n, common, tokens, pos, m): a row for each group that has a prefix shingle in common with a group of a
    size that it can link with, and these shingles, with their places and the numbers of their groups, as arrays.

    Each place of each prefix is sent once. A shingle's groups are looked through by size: where neither the next
    smaller nor the next larger one is near enough, none is. Linking groups keep all shingles they have in common.
    common: the logarithms of m, summed up.
    """
    place = F.shiftleft("n", 32).bitwiseOR(F.col("pos").cast("long"))
    dealt = base.filter("prefix IS NOT NULL").select("gkey", "n", F.posexplode("prefix").alias("pos", "token"))
    dealt = dealt.select("token", "gkey", place.alias("place")).repartition("token")
    # a group comes once from each task that meets it
    dealt = dealt.groupBy("token", "gkey").agg(F.first("place").alias("place"))
    by_size = Window.partitionBy("token").orderBy("place")
    every = by_size.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    n = F.shiftright("place", 32)
    dealt = dealt.select("token", "gkey", "place", n.alias("n"), F.count(F.lit(1)).over(every).alias("m"), F.lag(n).over(by_size).alias("less"), F.lead(n).over(by_size).alias("more"))
    near = F.coalesce(F.col("less") * 100 >= F.col("n") * percent, F.lit(False)) | F.coalesce(F.col("n") * 100 >= F.col("more") * percent, F.lit(False))
    kept = dealt.filter(near).select("gkey", "token", "place", "m").repartition("gkey")
    t = F.struct("token", F.col("place").bitwiseAND(F.lit(0xFFFFFFFF)).cast("int").alias("pos"), "m")
    kept = kept.groupBy("gkey").agg(F.first(n).alias("n"), F.sum(F.log("m")).alias("common"), F.collect_list(t).alias("t"))
    return kept.select("gkey", "n", "common", F.col("t.token").alias("tokens"), F.col("t.pos").alias("pos"), F.col("t.m").alias("m"))


def set_key(h: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh3_64_intdigest(h.tobytes())).view(np.int64))


def signature(h: np.ndarray) -> np.ndarray:
    """Words of the parities of how many hashes fall on each of SIGNATURE bits."""
    odd = np.bincount((h & np.uint64(SIGNATURE - 1)).astype(np.int64), minlength=SIGNATURE) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _verify(docs: DataFrame, base: DataFrame, members: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """(a, b, ok) of pairs (a, b) of keys: ok where their whole sets link. Members meet a copy of their centre a.

    Each text is read where it stands and sent once for each pair, to a task that holds at most about STAR members of
    one centre at a time.
    """
    parts = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / STAR).cast("long").alias("parts"))
    # only centres of more than STAR members are looked up, so that members of one centre needn't meet for it
    member = pairs.join(small(parts.filter("parts > 1")), "a", "left").select("a", F.pmod(F.xxhash64("b"), F.coalesce("parts", F.lit(1))).alias("salt"), F.col("b").alias("key"))
    centre = parts.select(F.col("a").alias("key"), F.col("a"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("salt"))
    both = centre.select("a", "salt", "key", F.lit(0).alias("role")).unionByName(member.withColumn("role", F.lit(1)))
    row = members.select("key", F.col("row.doc_id").alias("doc_id"), F.col("row.text_md5").alias("text_md5"))
    wanted = materialize(row.join(both, "key"), "wanted")
    ids = wanted.select("doc_id", "text_md5").distinct()
    same = base.alias("b").join(small(ids).alias("i"), F.col("b.doc_id").eqNullSafe(F.col("i.doc_id")) & (F.col("b.text_md5") == F.col("i.text_md5")), "left_semi")
    repeated = not same.groupBy("doc_id", "text_md5").count().filter("count > 1").isEmpty()
    text = F.col("text").cast("binary")
    source = docs.select("doc_id", F.unhex(F.md5(F.coalesce(text, F.lit(b"")))).alias("text_md5"), text.alias("data")).alias("s")
    if repeated:
        near = small(ids).alias("i")
        source = source.join(near, F.col("s.doc_id").eqNullSafe(F.col("i.doc_id")) & (F.col("s.text_md5") == F.col("i.text_md5")), "left_semi").dropDuplicates(["doc_id", "text_md5"]).alias("s")
    w = small(wanted).alias("w")
    rows = source.join(w, F.col("s.doc_id").eqNullSafe(F.col("w.doc_id")) & (F.col("s.text_md5") == F.col("w.text_md5")))
    rows = rows.select("a", "salt", "role", "key", "data").repartition("a", "salt").sortWithinPartitions("a", "salt", "role")

    def check(batches):
        centre_set = None
        for batch in batches:
            out = []
            for a, role, key, data in arrow_rows([batch], 0, 2, 3, 4):
                h = distinct(shingles(data))
                if role == 0:
                    centre_set = h
                    continue
                both_in = len(h) + len(centre_set) - len(distinct(np.concatenate([h, centre_set])))
                out.append((a, key, 100 * both_in >= percent * (len(h) + len(centre_set) - both_in)))
            if out:
                a, b, ok = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(ok, pa.bool_())], ["a", "b", "ok"])

    return materialize(rows.mapInArrow(check, "a long, b long, ok boolean"), "verified")


def _size_fits(x: str, y: str, percent: int) -> Column:
    return F.least(x, y) * 100 >= F.greatest(x, y) * percent


def _need(x: str, y: str, percent: int) -> Column:
    """Shingles that linking sets of sizes x and y have in common, at least."""
    return F.expr(f"(({x} + {y}) * {percent} + {99 + percent}) div {100 + percent}")


def _common(x: str, y: str, percent: int) -> Column:
    """Of these, those that lie in both prefixes, at least: no more than ceil(0.8 n) - 1 lie behind a prefix."""
    return _need(x, y, percent) - F.expr(f"(greatest({x}, {y}) * {percent} + 99) div 100") + 1


def _near(x: str, y: str, percent: int) -> Column:
    """No more bits of the signatures differ than shingles of linking sets may; true where a signature is unknown."""
    bits = F.lit(0)
    for w in WORDS:
        bits = bits + F.bit_count(F.col(f"{x}.{w}").bitwiseXOR(F.col(f"{y}.{w}")))
    return F.coalesce(bits <= F.col(f"{x}.n") + F.col(f"{y}.n") - 2 * _need(f"{x}.n", f"{y}.n", percent), F.lit(True))


def _rest(t: DataFrame, percent: int) -> DataFrame:
    """(g, h): pairs of groups of different components that may link.

    Of each pair the group of the lighter component looks for the other one. If both have more in common than they
    have hot shingles, hot ones aren't looked at. Of the s shingles that are, at least k must be met, so at least one
    of the first s - k + 1: those alone are looked up. Shingles of many groups are dealt over several tasks: each of
    the groups that look for others goes to one of them, and the groups looked for to all. Dealing is explicit, as the
    bytes of these rows say nothing of the work they make.
    """
    tasks = int(t.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    split = F.ceil(F.col("m") / SPLIT).cast("int")
    x = t.filter("out").withColumn("salt", F.pmod(F.xxhash64("gkey"), split).cast("int")).repartition(tasks, "token", "salt").alias("x")
    y = t.withColumn("salt", F.explode(F.sequence(F.lit(0), split - 1))).repartition(tasks, "token", "salt").alias("y")
    k = _common("x.n", "y.n", percent)
    hot, seen = F.least("x.hot", "y.hot"), F.least("x.shared", "y.shared")
    cool, rank = F.least(F.col("x.shared") - F.col("x.hot"), F.col("y.shared") - F.col("y.hot")), F.col("x.rank")
    met = F.when(k <= hot, (k <= seen) & (rank <= F.col("x.shared") - k)).otherwise((k - hot <= cool) & (rank <= F.col("x.shared") - F.col("x.hot") - k + hot))
    # before and behind a common shingle there must be room for what else they have in common
    room = F.least("x.pos", "y.pos") + F.least(F.col("x.n") - F.col("x.pos"), F.col("y.n") - F.col("y.pos")) >= _need("x.n", "y.n", percent)
    turn = (F.col("x.ord") < F.col("y.ord")) | (F.col("x.mixed") & (F.col("x.ord") == F.col("y.ord")) & (F.col("x.gkey") < F.col("y.gkey")))
    on = (F.col("x.token") == F.col("y.token")) & (F.col("x.salt") == F.col("y.salt"))
    on = on & _size_fits("x.n", "y.n", percent) & _near("x", "y", percent) & room & met & turn
    return x.join(y, on).select(F.col("x.gkey").alias("g"), F.col("y.gkey").alias("h")).distinct()


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(doc_id, text_md5, n_shingles, key, label, component_id) of every row of docs.

    key: the row's shingle set (null without words); label: its component; component_id: the least doc_id that links
    reach. Rows without
    words link with nothing and keep their own id; null ids come last, so a component of null ids alone has none;
    repeated rows have one set and one component; other columns are ignored; an empty table gives no rows.
    """
    base = materialize(_prefixes(docs, percent), "prefixes")
    tokens = materialize(_tokens(base, percent), "tokens")
    keyed = base.filter("key IS NOT NULL").groupBy("gkey", "key").agg(F.min(F.struct("doc_id", "text_md5")).alias("row"), F.first("n").alias("n"), *[F.first(w).alias(w) for w in WORDS])
    paired = tokens.select("gkey").union(keyed.groupBy("gkey").agg(F.count(F.lit(1)).alias("m")).filter("m > 1").select("gkey")).distinct()
    members = materialize(keyed.join(paired, "gkey", "left_semi"), "members")
    labels = members.select(F.col("key").alias("node"), F.col("key").alias("label"))
    tested = links = None
    for step in range(STARS + 1):
        own = materialize(members.select("gkey", "key", "n", *WORDS).join(labels, members["key"] == labels["node"]).drop("node"), "own")
        group = materialize(own.groupBy("gkey").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.min("key").alias("least"), F.first("n").alias("n"), *[F.when(F.min("key") == F.max("key"), F.first(w)).alias(w) for w in WORDS]), "groups")
        inner = group.filter("low < high")
        wide = tokens.join(group.select("gkey", "low", "high"), "gkey")
        mixed = F.col("low") != F.col("high")
        if step < STARS:
            noise = 1 + F.pmod(F.xxhash64("gkey", F.lit(step)), F.lit(1024)) / 8192
            met = wide.select("gkey", "n", F.when(~mixed, F.col("low")).alias("label"), (F.col("common") / F.col("n") * noise).cast("float").alias("score"), F.explode("tokens").alias("token")).repartition("token")
            met = met.withColumn("c", F.max(F.struct("score", "gkey", "n", "label")).over(Window.partitionBy("token")))
            met = met.filter((F.col("c.gkey") != F.col("gkey")) & ~F.coalesce(F.col("c.label") == F.col("label"), F.lit(False)))
            met = met.groupBy(F.col("c.gkey").alias("g"), F.col("gkey").alias("h")).agg(F.first("c.n").alias("gn"), F.first("n").alias("hn"), F.count(F.lit(1)).alias("met"))
            # pairs of few common shingles wait for the last step
            gpairs = met.filter(_size_fits("gn", "hn", percent) & (2 * F.col("met") >= _common("gn", "hn", percent)))
            gpairs = gpairs.join(group.select(F.col("gkey").alias("g"), F.col("least").alias("a")), "g")
            pairs = gpairs.select("a", F.col("h").alias("gkey")).join(own.select("gkey", F.col("key").alias("b")), "gkey").select("a", "b")
            pairs = pairs.unionByName(own.join(inner.select("gkey", F.col("least").alias("a")), "gkey").select("a", F.col("key").alias("b")))
            pairs = pairs.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        else:
            weight = wide.groupBy("low").agg(F.sum(F.size("tokens")).alias("weight"))
            order = group.select("gkey", "n", "low", mixed.alias("mixed"), *WORDS).join(small(weight), "low")
            order = materialize(order.select("gkey", "n", "mixed", "weight", "low", *WORDS), "order")
            at = tokens.join(order.select("gkey", "mixed", "weight", "low"), "gkey")
            at = at.select("gkey", "mixed", "weight", "low", F.inline(F.arrays_zip("tokens", "pos", "m")).alias("token", "pos", "m")).repartition("token")
            same = Window.partitionBy("token")
            of = F.struct((~F.col("mixed")).cast("int").alias("a"), "weight", "low")
            at = at.select("gkey", "token", "pos", "m", "mixed", "low", of.alias("ord"), F.max(of).over(same).alias("top"), F.min("low").over(same).alias("tl"), F.max("low").over(same).alias("th"), F.max("mixed").over(same).alias("any"))
            at = at.filter("tl < th OR any").select("gkey", "token", "pos", "m", (F.col("mixed") | (F.col("ord") < F.col("top"))).alias("out")).repartition("gkey")
            own_tokens = Window.partitionBy("gkey").orderBy((F.col("m") > HOT).cast("int"), "token")
            every = own_tokens.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
            at = at.withColumn("rank", F.row_number().over(own_tokens) - 1)
            at = at.withColumn("hot", F.count_if(F.col("m") > HOT).over(every)).withColumn("shared", F.count(F.lit(1)).over(every))
            t = materialize(at.join(order, "gkey").select("token", "m", "gkey", "n", "pos", "hot", "shared", "rank", "mixed", of.alias("ord"), *WORDS, "out"), "apart")
            gpairs = _rest(t, percent)
            gpairs = gpairs.unionByName(inner.select(F.col("gkey").alias("g"), F.col("gkey").alias("h")))
            one_side = own.select(F.col("gkey").alias("g"), F.struct("key", "label", "n", *WORDS).alias("x"))
            other = own.select(F.col("gkey").alias("h"), F.struct("key", "label", "n", *WORDS).alias("y"))
            pairs = gpairs.join(one_side, "g").join(other, "h").filter((F.col("x.label") != F.col("y.label")) & _near("x", "y", percent))
            pairs = pairs.select(F.col("x.key").alias("a"), F.col("y.key").alias("b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        pairs = materialize(pairs, "pairs")
        if not pairs.isEmpty():
            checked = _verify(docs, base, members, pairs, percent)
            tested = checked.select("a", "b") if tested is None else tested.unionByName(checked.select("a", "b"))
            good = checked.filter("ok").select("a", "b")
            links = good if links is None else links.unionByName(good)
            labels = materialize(members.select(F.col("key").alias("node")).join(components(links), "node", "left").select("node", F.coalesce("label", "node").alias("label")), "labels")
    labels = materialize(labels, "labels")
    least = base.filter("key IS NOT NULL").groupBy("key").agg(F.min("doc_id").alias("d")).join(labels.withColumnRenamed("node", "key"), "key", "left")
    least = materialize(least.select("key", "d", F.coalesce("label", "key").alias("label")), "least")
    top = least.groupBy("label").agg(F.min("d").alias("component_id"))
    of_key = least.join(top, "label").select("key", "label", "component_id")
    out = base.select("doc_id", "text_md5", F.col("n").alias("n_shingles"), "key").join(of_key, "key", "left")
    return out.select("doc_id", "text_md5", "n_shingles", "key", "label", F.when(F.col("key").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def keep_one(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The rows of docs without all but one of each component: the one of the least (doc_id, MD5 of the text) stays.

    Null ids stay only where a component has no other; of repeated rows that would stay one does; rows without words
    all stay. Columns are those of docs.
    """
    found = materialize(near_duplicates(docs, percent).filter("key IS NOT NULL").select("doc_id", "text_md5", "label"), "components")
    order = F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "text_md5")
    best = found.groupBy("label").agg(F.min(order).alias("b"))
    rows = found.join(best, "label").withColumn("wins", order.eqNullSafe(F.col("b")))
    losers = materialize(rows.filter("NOT wins").select("doc_id", "text_md5").distinct(), "losers")
    again = rows.filter("wins").groupBy("doc_id", "text_md5").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("doc_id", "text_md5")
    again = materialize(again, "again")
    kept = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("id"), F.unhex(F.md5(F.coalesce(F.col("text").cast("binary"), F.lit(b"")))).alias("md5"))

    def on(side):
        return kept["id"].eqNullSafe(side["doc_id"]) & (kept["md5"] == side["text_md5"])

    gone = small(losers)
    out = kept.join(gone, on(gone), "left_anti")
    if not again.isEmpty():
        twice = small(again)
        one = kept.join(twice, on(twice), "left_semi").dropDuplicates(["id", "md5"])
        out = out.join(twice, on(twice), "left_anti").unionByName(one)
    return out.select("row.*")


def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_shingles", "component_id")
