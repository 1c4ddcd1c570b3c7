"""Mixing sources to target weights by Efraimidis-Spirakis sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import WORD_SPLIT, materialize, n_buckets, n_words, ranked, running_sum, table

#: A target stops at so many times its source's size.
MAX_EPOCHS = 3
WEIGHTS = (1, 2, 3)
#: Mean bytes a word of ordinary prose; documents far from it weigh less.
USUAL_BYTES = 6.0


def quality(n_bytes: Column, words: Column) -> Column:
    """Weight in (0, 1] by how near the mean word is to USUAL_BYTES; empty documents weigh 1."""
    return F.when(words > 0, F.lit(USUAL_BYTES) / (F.lit(USUAL_BYTES) + F.abs(n_bytes / words - F.lit(USUAL_BYTES)))).otherwise(F.lit(1.0))


def source_targets(sizes: DataFrame, weights: tuple = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(source, source_size, target) from (source, size): weights by code point order, nulls last, capped and reshared.

    A source is capped where cap / weight lies below the common level; the level only rises as excess is reshared,
    so it is raised by one aggregate a step until no more sources are capped.
    """
    src = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    pos = F.col("pos") % len(weights)
    src = ranked(src, [F.col("source").asc_nulls_last()], "pos").withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (pos + 1).cast("int")))
    src = materialize(src.withColumn("cap", F.col("source_size") * F.lit(float(max_epochs))), "sources")
    total, all_w = src.agg(F.sum("source_size"), F.sum("weight")).first()
    level, capped = (total / all_w if total else 0.0), -1
    while total:
        hit = F.col("cap") / F.col("weight") < F.lit(level)
        n, held, left = src.agg(F.count_if(hit), F.sum(F.when(hit, F.col("cap")).otherwise(0.0)), F.sum(F.when(hit, 0.0).otherwise(F.col("weight")))).first()
        if n == capped or not left:
            break
        level, capped = (total - held) / left, n
    return src.select("source", F.col("source_size").cast("long").alias("source_size"), F.least(F.col("weight") * F.lit(level), F.col("cap")).alias("target"))


def _keyed(docs: DataFrame, seed: str) -> DataFrame:
    """docs with size, text_md5 and key (exponential, scaled by quality)."""
    hashed = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))).cast("binary"))
    uniform = (F.conv(F.substring(hashed, 1, 13), 16, 10).cast("long") + 1) / F.lit(float(1 << 52))
    text = F.coalesce(F.col("text"), F.lit(""))
    out = docs.select("*", n_words(F.col("text")).alias("size"), F.md5(text.cast("binary")).alias("text_md5"))
    return out.withColumn("key", -F.log(uniform) / quality(F.octet_length(text), F.col("size")))


ORDER = ["key", "doc_id", "size", "text_md5"]


def mix(docs: DataFrame, seed: str = "mix", weights: tuple = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """How many words of each row of docs the mix takes: (doc_id, source, size, source_size, target, taken, ...).

    Each source gives floor(target / size) whole epochs; the rest of its budget goes to documents in the order of
    the exponential keys -ln(u) / quality, u by hash of seed and doc_id, up to the budget: the last one in part.
    Null texts have no words, null sources are one source, null ids hash as such; equal rows tie and are alike, so
    reruns agree. A table without words takes nothing; an empty one gives no rows; other columns are ignored.
    Also returned: text_md5, key, epochs, rest (the budget after whole epochs), before (words of earlier rows).
    """
    base = materialize(_keyed(docs.select("doc_id", "text", "source"), seed).drop("text"), "mix")
    targets = source_targets(base.select("source", "size"), weights, max_epochs)
    b = n_buckets(base.count())
    bucket = F.least(F.floor((F.lit(1.0) - F.exp(-F.col("key"))) * b), F.lit(b - 1)).cast("int")
    run = running_sum(base.withColumn("bucket", bucket), ["source"], "bucket", ORDER, F.col("size"), "before")
    a, t = run.alias("a"), targets.alias("t")
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    out = a.join(t, F.col("a.source").eqNullSafe(F.col("t.source"))).select("a.*", "t.source_size", "t.target", epochs.alias("epochs"))
    out = out.withColumn("rest", F.floor(F.col("target") - F.col("epochs") * F.col("source_size")).cast("long"))
    part = F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), F.col("rest") - F.col("before")))
    return out.withColumn("taken", F.col("epochs") * F.col("size") + part).drop("bucket")


def mixed_documents(docs: DataFrame, seed: str = "mix", weights: tuple = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """The mix itself, with the columns of docs: each row as often as it is taken whole, the last one of each source cut.

    A cut text has the first words of its budget, joined by spaces, and its own n_chars; equal rows on the edge share
    what is left. Rows without words are not taken. Only one number a source is joined to the documents.
    """
    taken = materialize(mix(docs, seed, weights, max_epochs), "taken")
    order = F.struct(*ORDER)
    edge = taken.filter("before + size > rest").groupBy("source").agg(F.min(order).alias("edge"))
    plan = taken.groupBy("source").agg(F.first("epochs").alias("epochs"), F.first("rest").alias("rest")).alias("p")
    plan = plan.join(edge.alias("e"), F.col("p.source").eqNullSafe(F.col("e.source")), "left").select("p.*", "e.edge").alias("p")
    at = taken.alias("t").join(plan, F.col("t.source").eqNullSafe(F.col("p.source"))).filter(F.struct(*[F.col(f"t.{c}").alias(c) for c in ORDER]).eqNullSafe(F.col("p.edge")))
    share = at.groupBy("t.source").agg(F.floor((F.first("p.rest") - F.min("t.before")) / F.count(F.lit(1))).cast("long").alias("share")).alias("s")
    plan = plan.join(share, F.col("p.source").eqNullSafe(F.col("s.source")), "left").select(F.col("p.source").alias("_source"), "p.epochs", "p.edge", F.coalesce("s.share", F.lit(0)).cast("long").alias("share"))
    plan = materialize(plan, "plan")
    rows = _keyed(docs.select(F.struct("*").alias("row"), "doc_id", "text", "source"), seed).alias("d")
    mine = F.struct(*ORDER)
    rows = rows.join(plan.alias("q"), F.col("d.source").eqNullSafe(F.col("q._source"))).filter("size > 0")
    whole = F.col("epochs") + F.when(F.col("edge").isNull() | (mine < F.col("edge")), 1).otherwise(0)
    part = F.when(mine.eqNullSafe(F.col("edge")), F.col("share")).otherwise(F.lit(0))
    parts = F.concat(F.array_repeat(F.lit(0).cast("long"), whole.cast("int")), F.when(part > 0, F.array(part)).otherwise(F.array().cast("array<long>")))
    rows = rows.select("row", F.explode(parts).alias("cut"))
    short = F.array_join(F.slice(F.filter(F.split("row.text", WORD_SPLIT), lambda x: x != ""), 1, F.col("cut").cast("int")), " ")
    text = F.when(F.col("cut") > 0, short).otherwise(F.col("row.text"))
    new = {"text": text, "n_chars": F.when(F.col("cut") > 0, F.length(short).cast("long")).otherwise(F.col("row.n_chars"))} if "n_chars" in docs.columns else {"text": text}
    return rows.select(*[new.get(c, F.col("row")[c]).alias(c) for c in docs.columns])


def op3_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")


ORACLE = r"""
WITH d AS (SELECT doc_id, source, md5(coalesce(text, '')) AS text_md5, strlen(coalesce(text, '')) AS n_bytes,
                  CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
                  (CAST('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 13) AS BIGINT) + 1) / 4503599627370496.0::DOUBLE AS u FROM documents),
k AS (SELECT *, -ln(u) / CASE WHEN size > 0 THEN 6.0::DOUBLE / (6.0::DOUBLE + abs(n_bytes::DOUBLE / size - 6.0::DOUBLE)) ELSE 1.0::DOUBLE END AS key FROM d),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS DOUBLE) AS weight FROM d GROUP BY source),
r AS (SELECT *, 3.0::DOUBLE * source_size / weight AS ratio, (SELECT sum(source_size) FROM s)::DOUBLE AS total FROM s),
l AS (SELECT ratio, (total - coalesce(sum(3.0::DOUBLE * source_size) OVER (ORDER BY ratio RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW EXCLUDE TIES) - 3.0::DOUBLE * source_size, 0))
             / (coalesce(sum(weight) OVER (ORDER BY ratio DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0)) AS level FROM r),
c AS (SELECT level FROM l WHERE level <= ratio ORDER BY ratio LIMIT 1),
t AS (SELECT source, source_size, least(weight * (SELECT level FROM c), 3.0::DOUBLE * source_size) AS target FROM r),
w AS (SELECT k.doc_id, k.size, t.source_size, t.target,
             CASE WHEN t.source_size > 0 THEN CAST(floor(t.target / t.source_size) AS BIGINT) ELSE 0 END AS epochs,
             coalesce(sum(k.size) OVER (PARTITION BY k.source ORDER BY k.key, k.doc_id, k.size, k.text_md5 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
      FROM k JOIN t ON k.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       CAST(epochs * size + greatest(0, least(size, CAST(floor(target - epochs * source_size) AS BIGINT) - before)) AS BIGINT) AS taken FROM w
"""
