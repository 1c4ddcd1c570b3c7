"""URL filter: a blocked Bloom filter passes possible hits to an exact hash join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import table

#: (verdict, host, path); the rule text is host + path.
RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def url_host(url: Column) -> Column:
    """Host after the first '://', A-Z lower-cased; empty for null or no '://'."""
    return F.translate(F.coalesce(F.regexp_extract(url, PARTS, 1), F.lit("")), UPPER, LOWER)


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, PARTS, 2), F.lit(""))


def _mask(h: Column) -> Column:
    """Four bits of the key's 64-bit block word."""
    m = F.lit(0).cast("long")
    for shift in (20, 28, 36, 44):
        bit = F.shiftrightunsigned(h, shift).bitwiseAND(F.lit(63)).cast("int")
        m = m.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), bit))
    return m


#: Blocks that a filter has at most: 16 MB. More keys than 8 million make it pass more, which the exact join removes.
MAX_BLOCKS = 1 << 21


def block_count(keys: DataFrame) -> int:
    """A power of two that gives each of the counted keys 16 bits or more, as far as MAX_BLOCKS goes."""
    return min(MAX_BLOCKS, max(64, 1 << (keys.count() // 4).bit_length()))


def blocked_bloom(keys: DataFrame, key: str, n_blocks: int) -> DataFrame:
    """One row, one column `words`: array of n_blocks 64-bit words. Its size is fixed by n_blocks, not by the keys."""
    h = F.xxhash64(key)
    words = keys.select(F.pmod(h, F.lit(n_blocks)).cast("int").alias("block"), _mask(h).alias("m")).groupBy("block").agg(F.bit_or("m").alias("w"))
    filled = words.agg(F.map_from_entries(F.collect_list(F.struct("block", "w"))).alias("m"))
    return filled.select(F.transform(F.sequence(F.lit(0), F.lit(n_blocks - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0).cast("long"))).alias("words"))


def filter_urls(pages: DataFrame, listed: DataFrame, path_lengths: list[int], url: str = "url", default: str = "allow") -> DataFrame:
    """Adds host, path, rule and verdict to every row of pages.

    listed: (host, path, verdict) of listed canonical URLs; an entry fits its host and all subdomains where the
    url's path starts with its path, and the longest entry wins (then the greater text). path_lengths: the lengths
    of the listed paths, which bound the probes per url. Every probe (host suffix, path prefix) is tested against
    the Bloom filter, whose size follows from the count of entries; possible hits alone go to the exact join, which
    removes false positives, and pages without any are shuffled nowhere. Nulls and urls
    without '://' have empty host and path, no rule and the default verdict. Repeated rows are judged alike,
    an empty list gives everyone the default; columns of pages are kept, those named like the new ones excepted.
    """
    entries = listed.select(F.concat("host", "path").alias("rule"), F.struct("host", "path").alias("k"), "verdict").dropDuplicates(["k"])
    keys = entries.select(F.concat_ws("\x00", "k.host", "k.path").alias("key"))
    n_blocks = block_count(keys)
    bloom = blocked_bloom(keys, "key", n_blocks).scalar()
    kept = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    page = pages.select(F.struct(*kept).alias("page"), url_host(F.col(url)).alias("host"), url_path(F.col(url)).alias("path"))
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    prefixes = F.array(*[F.when(F.length("path") >= n, F.substring("path", 1, n)) for n in sorted(set(path_lengths))] or [F.lit(None).cast("string")])
    probes = F.flatten(F.transform(suffixes, lambda s: F.transform(F.filter(prefixes, lambda p: p.isNotNull()), lambda p: F.struct(s.alias("host"), p.alias("path")))))

    def maybe(p: Column) -> Column:
        h = F.xxhash64(F.concat_ws("\x00", p["host"], p["path"]))
        m = _mask(h)
        return F.element_at(F.col("words"), F.pmod(h, F.lit(n_blocks)).cast("int") + 1).bitwiseAND(m) == m

    probed = page.withColumn("words", bloom).select("page", "host", "path", F.filter(probes, maybe).alias("maybe"))
    none = probed.filter(F.size("maybe") == 0).select("page.*", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    hits = probed.filter(F.size("maybe") > 0).withColumn("rid", F.monotonically_increasing_id()).select("rid", "page", "host", "path", F.explode("maybe").alias("k"))
    best = F.max(F.when(F.col("verdict").isNotNull(), F.struct(F.length("rule").alias("n"), "rule", "verdict")))
    found = hits.join(entries, "k", "left").groupBy("rid").agg(F.first("page").alias("page"), F.first("host").alias("host"), F.first("path").alias("path"), best.alias("b"))
    return none.unionByName(found.select("page.*", "host", "path", F.col("b.rule").alias("rule"), F.coalesce("b.verdict", F.lit(default)).alias("verdict")))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = spark.createDataFrame([(h, p, v) for v, h, p in RULES], "host string, path string, verdict string")
    out = filter_urls(table(spark, sf_dir, "pages").select("page_id", "url"), listed, [len(p) for _, _, p in RULES])
    return out.select("page_id", "host", "path", "rule", "verdict")


_FITS = "(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')"
_LONGEST = sorted(RULES, key=lambda r: -len(r[1] + r[2]))
ORACLE = f"""
WITH a AS (SELECT page_id, CASE WHEN url IS NULL OR strpos(url, '://') = 0 THEN '' ELSE substr(url, strpos(url, '://') + 3) END AS r FROM pages),
b AS (SELECT page_id, regexp_extract(r, '^[^/?#]*') AS h0, r FROM a),
c AS (SELECT page_id, translate(h0, '{UPPER}', '{LOWER}') AS host, regexp_extract(substr(r, length(h0) + 1), '^[^?#]*') AS path FROM b),
d AS (SELECT page_id, host, path, CASE {' '.join(f"WHEN {_FITS.format(h=h, p=p)} THEN '{h}{p}'" for _, h, p in _LONGEST)} END AS rule FROM c)
SELECT page_id, host, path, rule, CASE {' '.join(f"WHEN rule = '{h}{p}' THEN '{v}'" for v, h, p in _LONGEST)} ELSE 'allow' END AS verdict FROM d
"""
