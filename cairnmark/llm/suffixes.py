"""Exact removal of repeated 400-byte strings by distributed prefix doubling.

A sorted rank for every byte of the corpus is many times the corpus itself. So positions are ranked in two grains.

Anchors first: of every 301 consecutive 100-byte strings, the one with the least hash (the first of equal ones). Every
400-byte window owns the anchor that lies in it, and equal windows own equal anchors at equal offsets, so nothing is
lost. Anchors whose 100 bytes occur once leave. Where all bytes of the windows that an anchor owns recur around
another anchor, all these windows are repeated; else some may be. Two rounds narrow down which: offsets of windows are
cut into cells of 43, then 7; the bytes that all windows of a cell share (400 less the cell's width) must be repeated,
or none of them is; where all bytes that any of them touches are repeated, all are. Only cells between the two go on.

What is left is a few positions on either side of the ends of repeats, and these go through prefix doubling. A window
starts with the names of its four 100-byte strings. Round one pairs the names at offset 100 and sorts the pairs; a
pair's place in that order is its rank, a pair that occurs once leaves and takes its window along. Round two pairs the
ranks at offset 200; a pair that occurs twice is a repeated string of 400 bytes, which is the threshold.

Whatever is known to be repeated stays as a partner for those that aren't decided, one representative per rank. Where
equality decides it is that of 128-bit BLAKE2b digests of the bytes, or of four 64-bit hashes; the one 64-bit hash of an
anchor's 100 bytes only says which anchors to compare.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import materialize, ranked, small, table
from .shingles import arrow_rows, mixed

N = 400
GRAM = 100
SPAN = N - GRAM + 1
WIDTHS = (43, 7)
#: Names that a window's prefix doubling starts with.
PARTS = [f"r{i}" for i in range(N // GRAM)]
CHUNK = 1 << 19
_POS = np.uint64((1 << 24) - 1)
_TABLE = np.random.default_rng(7).integers(0, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15


class Powers:
    """Powers of the base and of its inverse mod 2 ** 64, as far as needed so far (at most a chunk and its overlap)."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def __call__(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            n = max(n, 2 * len(self.up))
            inverse = pow(_BASE, -1, 1 << 64)
            self.up, self.down = (np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n - 1, b, np.uint64)])) for b in (_BASE, inverse))
        return self.up, self.down


def prefix_sums(data: np.ndarray, powers: Powers) -> np.ndarray:
    up, _ = powers(len(data) + 1)
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_TABLE[data] * up[: len(data)], out=out[1:])
    return out


def span_hash(sums: np.ndarray, start: np.ndarray, stop: np.ndarray, powers: Powers) -> np.ndarray:
    """Hash of bytes start to stop; the same wherever they stand."""
    _, down = powers(len(sums))
    return mixed((sums[stop] - sums[start]) * down[start] + (stop - start).astype(np.uint64))


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Least of each w consecutive values, by prefix and suffix minima of blocks."""
    n = len(x) - w + 1
    full = np.full(-(-len(x) // w) * w, np.iinfo(np.uint64).max, np.uint64)
    full[: len(x)] = x
    grid = full.reshape(-1, w)
    head = np.minimum.accumulate(grid, axis=1).reshape(-1)
    tail = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(tail[:n], head[w - 1 : w - 1 + n])


def digests(data: bytes, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Two words of the BLAKE2b digest of bytes start to stop, for each pair."""
    view = memoryview(data)
    out = b"".join([hashlib.blake2b(view[a:b], digest_size=16).digest() for a, b in zip(start.tolist(), stop.tolist(), strict=True)])
    return np.frombuffer(out, np.int64).reshape(-1, 2)


def anchors(data: bytes, powers: Powers):
    """(class, position, first and last window start it owns, digest of all bytes of those windows) as arrays."""
    raw, parts = np.frombuffer(data, np.uint8), []
    for c in range(0, max(0, len(raw) - N + 1), CHUNK):
        own = raw[c : c + CHUNK + N - 1]
        sums = prefix_sums(own, powers)
        at = np.arange(len(own) - GRAM + 1)
        h = span_hash(sums, at, at + GRAM, powers)
        least = sliding_min((h & ~_POS) | at.astype(np.uint64), SPAN)
        pos = (least & _POS).astype(np.int64)
        cut = np.flatnonzero(np.diff(pos)) + 1
        lo, hi = np.concatenate([[0], cut]), np.concatenate([cut, [len(pos)]]) - 1
        p = pos[lo]
        parts.append((h[p].view(np.int64), p + c, lo + c, hi + c, *digests(data, lo + c, hi + c + N).T))
    return [np.concatenate(x) for x in zip(*parts, strict=True)] if parts else None


def _key() -> Column:
    return F.unhex(F.md5(F.coalesce(F.col("text").cast("binary"), F.lit(b""))))


def _anchors(docs: DataFrame) -> DataFrame:
    """(h, d, p, lo, hi, u, v) of the anchors of every text, once per task."""

    def scan(batches):
        powers, seen = Powers(), set()
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                out = []
                for d, data in arrow_rows([batch.slice(start, 256)], 0, 1):
                    if d in seen:
                        continue
                    seen.add(d)
                    got = anchors(data, powers)
                    if got is not None:
                        out.append((d, got))
                if out:
                    h, *rest = (pa.array(np.concatenate([g[i] for _, g in out])) for i in range(6))
                    sizes = [len(g[0]) for _, g in out]
                    ds = pa.array([d for d, _ in out], pa.binary()).take(pa.array(np.repeat(np.arange(len(out)), sizes)))
                    yield pa.RecordBatch.from_arrays([h, ds, *rest], ["h", "d", "p", "lo", "hi", "u", "v"])

    source = docs.select(_key().alias("d"), F.col("text").cast("binary").alias("data")).filter(F.octet_length("data") >= N)
    return source.mapInArrow(scan, "h long, d binary, p long, lo long, hi long, u long, v long")


def _texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(d, data) of the wanted texts, each once."""
    source = docs.select(_key().alias("d"), F.col("text").cast("binary").alias("data"))
    return materialize(source.join(small(wanted.select("d").distinct()), "d", "left_semi").dropDuplicates(["d"]), "texts")


def _cells(texts: DataFrame, todo: DataFrame, width: int) -> DataFrame:
    """Rows (h, x, i, u, v, d, p, a, b, done) of cells of this width; todo: (h, d, p, a, b, done), offsets a to b.

    x: first offset of the cell; i: hash of the bytes its windows share; u, v: digest of all their bytes (null beyond the
    text).
    """
    lists = todo.groupBy("d").agg(F.collect_set(F.struct("h", "p", "a", "b", "done")).alias("cells"))  # at most a text's length

    def scan(batches):
        powers = Powers()
        for batch in batches:
            for row in range(batch.num_rows):
                part = batch.slice(row, 1)
                whole = part.column(1).to_pylist()[0]
                data = np.frombuffer(whole, np.uint8)
                items = part.column(2).flatten()
                h, p, a, b = (items.field(f).to_numpy() for f in ("h", "p", "a", "b"))
                done = items.field("done").to_numpy(zero_copy_only=False)
                order = np.argsort(p, kind="stable")
                h, p, a, b, done = h[order], p[order], a[order], b[order], done[order]
                for c in np.unique(p // CHUNK):
                    here = p // CHUNK == c
                    base = max(0, int(c) * CHUNK - N)
                    sums = prefix_sums(data[base : (int(c) + 1) * CHUNK + 2 * N], powers)
                    first = a[here] // width * width
                    n = (b[here] - first) // width + 1
                    k = np.repeat(np.flatnonzero(here), n)
                    x = np.repeat(first, n) + width * (np.arange(len(k)) - np.repeat(np.cumsum(n) - n, n))
                    y, q = x + width - 1, p[k] - base
                    i = span_hash(sums, q - x, q - y + N, powers)
                    fits = (p[k] - y >= 0) & (p[k] - x + N <= len(data))
                    u, v = digests(whole, np.where(fits, p[k] - y, 0), np.where(fits, p[k] - x + N, 0)).T
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(h[k]), pa.array(x), pa.array(i.view(np.int64)), pa.array(u, mask=~fits), pa.array(v, mask=~fits), part.column(0).take(pa.array(np.zeros(len(k), np.int64))),
                         pa.array(p[k]), pa.array(np.maximum(a[k], x)), pa.array(np.minimum(b[k], y)), pa.array(done[k])],
                        ["h", "x", "i", "u", "v", "d", "p", "a", "b", "done"])

    return texts.join(lists, "d").select("d", "data", "cells").mapInArrow(scan, "h long, x long, i long, u long, v long, d binary, p long, a long, b long, done boolean")


def _starts(texts: DataFrame, todo: DataFrame) -> DataFrame:
    """(d, w, open, names of the parts): every window start of todo once; open if it isn't known to be repeated."""
    lists = todo.groupBy("d").agg(F.collect_set(F.struct("p", "a", "b", "done")).alias("cells"))

    def scan(batches):
        powers = Powers()
        for batch in batches:
            for row in range(batch.num_rows):
                part = batch.slice(row, 1)
                data = np.frombuffer(part.column(1).to_pylist()[0], np.uint8)
                items = part.column(2).flatten()
                p, a, b = (items.field(f).to_numpy() for f in ("p", "a", "b"))
                done = items.field("done").to_numpy(zero_copy_only=False)
                n = b - a + 1
                each = np.repeat(p - b, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                starts = np.unique(each[(each >= 0) & (each + N <= len(data))])
                is_open = np.isin(starts, each[~np.repeat(done, n)])
                for c in np.unique(starts // CHUNK):
                    here = starts // CHUNK == c
                    own, base = starts[here], int(c) * CHUNK
                    sums = prefix_sums(data[base : base + CHUNK + N], powers)
                    names = [span_hash(sums, own - base + at, own - base + at + GRAM, powers).view(np.int64) for at in range(0, N, GRAM)]
                    yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(np.zeros(len(own), np.int64))), pa.array(own), pa.array(is_open[here]), *map(pa.array, names)], ["d", "w", "open", *PARTS])

    return texts.join(lists, "d").select("d", "data", "cells").mapInArrow(scan, "d binary, w long, open boolean, " + ", ".join(f"{r} long" for r in PARTS))


def _pairs_that_recur(rows: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """(x, y) of the pairs of columns of rows, each once, that occur more than once."""
    each = F.explode(F.array(*[F.struct(F.col(x).alias("x"), F.col(y).alias("y")) for x, y in pairs]))
    return rows.select(each.alias("k")).groupBy("k.x", "k.y").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("x", "y")


def _doubled(rows: DataFrame) -> DataFrame:
    """The rows of windows (d, w, open, names) that recur, by prefix doubling; each start is there once."""
    ranks = PARTS
    while True:
        pairs = list(zip(ranks[::2], ranks[1::2], strict=True))
        order = small(ranked(materialize(_pairs_that_recur(rows, pairs), "recur"), ["x", "y"], "rank"))
        ranks = []
        for x, y in pairs:
            ranks.append(f"{x}{y}")
            rows = rows.join(order.select(F.col("x").alias(x), F.col("y").alias(y), F.col("rank").alias(ranks[-1])), [x, y]).drop(x, y)
        if len(ranks) == 1:
            return rows
        rows = materialize(rows, "doubled")


def repeated_windows(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((d, lo, hi): window starts that are repeated, by text key d; (d): texts of a window or more that occur twice)."""
    twice = docs.select(_key().alias("d"), F.octet_length("text").alias("n")).filter(F.col("n") >= N).groupBy("d").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("d")
    twice = materialize(twice, "twice")
    found = materialize(_anchors(docs).withColumn("o", F.xxhash64("d", "p")), "anchors")
    classes = materialize(found.groupBy("h").agg(F.min("o").alias("m"), F.max("o").alias("n")).filter("m < n").select("h"), "classes")
    shared = found.join(small(classes), "h", "left_semi").join(small(twice.withColumn("dup", F.lit(True))), "d", "left")
    shared = shared.withColumns({"b": F.col("p") - F.col("lo"), "e": F.col("hi") - F.col("p"), "dup": F.col("dup").isNotNull()})
    shared = materialize(shared, "shared")
    context = ["h", "b", "e", "u", "v"]
    ranks = shared.groupBy(*context).agg(F.min("o").alias("m"), F.max("o").alias("n"), F.bool_or(~F.col("dup")).alias("new")).filter("m < n AND new").select(*context)
    ranks = small(materialize(ranks, "ranks")).withColumn("full", F.lit(True))
    many = shared.filter("NOT dup").join(ranks, context, "left").withColumn("full", F.col("full").isNotNull())
    many = materialize(many.select("h", "d", "p", "lo", "hi", "b", "e", "u", "v", "full"), "ranked")
    out = many.filter("full").select("d", "lo", "hi")
    undecided = many.filter("NOT full")
    # one representative of equal ones before they meet by class
    partners = many.filter("full").select(*context, "d", "p", "lo", "hi").unionByName(shared.filter("dup").select(*context, "d", "p", "lo", "hi"))
    partners = partners.groupBy(*context).agg(F.min(F.struct("d", "p", "lo", "hi")).alias("r")).select("h", "r.*")
    partners = partners.join(small(undecided.select("h").distinct()), "h", "left_semi")
    todo = undecided.select("h", "d", "p", "lo", "hi", F.lit(False).alias("done")).unionByName(partners.withColumn("done", F.lit(True)))
    todo = materialize(todo.select("h", "d", "p", (F.col("p") - F.col("hi")).alias("a"), (F.col("p") - F.col("lo")).alias("b"), "done"), "todo")
    texts = _texts(docs, todo)
    for width in WIDTHS:
        rows = materialize(_cells(texts, todo, width).withColumn("o", F.xxhash64("d", "p")), "cells")
        many_u = rows.filter("u IS NOT NULL").groupBy("h", "x", "u", "v").agg((F.min("o") < F.max("o")).alias("rep")).filter("rep")
        rows = materialize(rows.join(small(many_u), ["h", "x", "u", "v"], "left").withColumn("rep", F.col("rep").isNotNull()), "cells")
        out = out.unionByName(rows.filter("rep AND NOT done").select("d", (F.col("p") - F.col("b")).alias("lo"), (F.col("p") - F.col("a")).alias("hi")))
        # undecided: shared bytes are repeated, all bytes aren't (as far as seen)
        groups = rows.groupBy("h", "x", "i").agg(F.min("o").alias("m"), F.max("o").alias("n"), F.bool_or(~F.col("rep") & ~F.col("done")).alias("open")).filter("m < n AND open").select("h", "x", "i")
        live = rows.join(small(groups), ["h", "x", "i"], "left_semi")
        known = F.col("rep") | F.col("done")
        beyond = F.when(F.col("u").isNull(), F.col("o"))
        kept = live.filter(known).groupBy("h", "x", "u", "v", beyond.alias("w")).agg(F.min(F.struct("d", "p")).alias("r"), F.min("a").alias("a"), F.max("b").alias("b"))
        # a partner's whole cell is read where its text reaches: equal bytes may be owned at other offsets there
        kept = kept.select("h", "r.d", "r.p", "a", "b", F.lit(True).alias("done"))
        todo = materialize(live.filter(~known).select("h", "d", "p", "a", "b", F.lit(False).alias("done")).unionByName(kept), "todo")
    starts = materialize(_starts(texts, todo), "starts")
    return out.unionByName(_doubled(starts).filter("open").select("d", F.col("w").alias("lo"), F.col("w").alias("hi"))), twice


def runs(pairs: np.ndarray) -> np.ndarray:
    """Maximal removed runs (start, stop) of window starts (lo, hi)."""
    if not len(pairs):
        return pairs.reshape(0, 2)
    pairs = pairs[np.argsort(pairs[:, 0], kind="stable")]
    lo, stop = pairs[:, 0], np.maximum.accumulate(pairs[:, 1] + N)
    new = np.flatnonzero(np.concatenate([[True], lo[1:] > stop[:-1]]))
    return np.stack([lo[new], np.append(stop[new[1:] - 1], stop[-1])], axis=1)


def remove_repeats(docs: DataFrame, keep_text: bool = False) -> DataFrame:
    """What is left of every row of docs once each byte of a 400-byte string that also starts elsewhere is removed.

    Returns doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, with keep_text, `kept` (bytes). Null and empty texts
    lose nothing, nor does any text under 400 bytes; repeated rows of 400 bytes or more lose all; strings are judged
    on the input; texts of any length are read whole; other columns are ignored; an empty table gives no rows.
    """
    spans, twice = repeated_windows(docs)
    lists = spans.groupBy("d").agg(F.collect_set(F.struct("lo", "hi")).alias("w"))

    def merge(batches):
        for batch in batches:
            out = []
            for row in range(batch.num_rows):
                items = batch.column(1).slice(row, 1).flatten()
                out.append(runs(np.stack([items.field("lo").to_numpy(), items.field("hi").to_numpy()], axis=1)).astype(np.int64).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["d", "runs"])

    removed = materialize(lists.mapInArrow(merge, "d binary, runs binary").withColumn("all", F.lit(False)).unionByName(twice.select("d", F.lit(None).cast("binary").alias("runs"), F.lit(True).alias("all"))), "runs")
    source = docs.select("doc_id", _key().alias("d"), F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("data"))
    rows = source.join(small(removed), "d", "left").select("doc_id", "data", "runs", "all")
    id_type = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *["kept"] * keep_text]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), *[pa.binary()] * keep_text]

    def cut(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part, out = batch.slice(start, 256), []
                for data, mine, whole in arrow_rows([part], 1, 2, 3):
                    spans = [(0, len(data))] if whole else np.frombuffer(mine or b"", np.int64).reshape(-1, 2).tolist()
                    at, kept = 0, []
                    for lo, stop in spans:
                        kept.append(data[at:lo])
                        at = stop
                    kept = b"".join([*kept, data[at:]])
                    out.append((len(data), len(data) - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), *[kept] * keep_text))
                yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)]], names)

    return rows.mapInArrow(cut, f"doc_id {id_type}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * keep_text)


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
