"""Exact substring dedup: every byte covered by a string of LENGTH bytes that also starts anywhere else goes.

A suffix array of the corpus is built bucket by bucket, only where it matters and only as deep as LENGTH:

1. Buckets. A suffix's bucket is its anchor: of the 64-byte strings within its first LENGTH bytes the one with the least hash (the first such). Equal LENGTH-byte
   strings have equal anchors at equal distance. Suffixes in a row that share an anchor form a hull, at most 336 bytes; a hull is one row. An anchor that occurs once settles
   all its suffixes, as does a hull when all rows of its anchor hold the same hull.
2. What is left are anchors with different hulls: the edges of copies. One copy of each hull goes to a block of buckets, and a block sorts its buckets' suffixes: by their first
   bytes up to the next place of a difference cover, then by that place's rank (and the last few bytes in the same way). Ranks of the cover's places are computed beforehand
   for the whole block, for 40, 80 and 160 bytes by doubling, so ties of any length cost a few comparisons of integers. Hulls are laid out so that anchors stand on multiples of the cover's period: suffixes that can tie
   have one phase, and one shift reaches the cover for all. Neighbours that agree in all LENGTH bytes are repeats.
3. A bucket of more than BUCKET_MAX different hulls (the edges of a passage that very many documents share) is split until its parts fit: its suffixes by their distance from the anchor, in two halves, and each half by
   all bytes that its suffixes have in common, which are the more the fewer distances are left. A part of one distance has one whole string of LENGTH bytes: if it is still too large, all its suffixes repeat.

Hashes are of 64 bits; which hulls of an anchor agree is decided by two of them, and in parts and blocks by bytes. Filters that spare rows a shuffle are sized by what they hold, up to a fixed size; joins decide.

Defined results: a null or empty text has no byte and loses none; matches never cross documents; every row is a document of its own, so repeated rows repeat all their strings, rows without doc_id too;
texts of any length are treated whole; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readloom.llm.common import filter_bits, filter_of, passes, stored, table
from readloom.llm.shingles import mixed

LENGTH, HEAD = 200, 64
PERIOD = 40  #: of the difference cover; LENGTH = PERIOD + 4 * PERIOD
BLOCK_HULLS, BUCKET_MAX = 2000, 4000
PIECE = 1 << 20
HALVINGS = 8  #: of the 137 distances from an anchor
FEW = 10_000  #: keys that are broadcast
_R = np.random.default_rng(31).integers(0, 1 << 63, 300, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def difference_cover(period: int) -> list[int]:
    """Places such that any two numbers reach one of them with the same shift, modulo period: greedily, the place that adds most differences."""
    cover, missing = [0], set(range(1, period))
    while missing:
        best = max(range(period), key=lambda p: len({(p - c) % period for c in cover} & missing | {(c - p) % period for c in cover} & missing))
        missing -= {(best - c) % period for c in cover} | {(c - best) % period for c in cover}
        cover.append(best)
    return sorted(cover)


def _pieces(texts: list[bytes]) -> Iterator[tuple[list[int], list[int], list[bytes]]]:
    """Number of the text, place in it, and bytes, in lots of PIECE bytes. Longer texts overlap by LENGTH - 1, so that no suffix is lost or met twice."""
    of, at, parts, size = [], [], [], 0
    for i, t in enumerate(texts):
        for start in range(0, max(1, len(t) - LENGTH + 1), PIECE - LENGTH + 1):
            part = t[start : start + PIECE]
            if len(part) < LENGTH:
                continue
            if size + len(part) > PIECE:
                yield of, at, parts
                of, at, parts, size = [], [], [], 0
            of.append(i)
            at.append(start)
            parts.append(part)
            size += len(part)
    if parts:
        yield of, at, parts


def anchors(of: list[int], at: list[int], parts: list[bytes]) -> dict[str, np.ndarray]:
    """The hulls of a lot: text (its number), start (of the hull's first suffix), more (suffixes after it), left (from start to the anchor), anchor, hull (hashes); cut: place in the lot."""
    a = np.frombuffer(b"".join(parts), np.uint8)
    h = _R[a]
    for level in range(6):
        m = 1 << level
        high = h[m:]
        h = h[:-m] * _R[256 + 2 * level] + (high ^ (high >> np.uint64(29))) * _R[257 + 2 * level]
    mask = np.uint64(PIECE - 1)
    low = (h & ~mask) | np.arange(len(h), dtype=np.uint64)
    for m in (1, 2, 4, 8, 16, 32, 64):
        low = np.minimum(low[:-m], low[m:])
    low = np.minimum(low[:-9], low[9:])  # over the 137 heads of a suffix
    sizes = np.array([len(p) for p in parts])
    begin = np.cumsum(sizes) - sizes
    inside = np.zeros(len(a) + 1, np.int8)
    inside[begin] += 1
    inside[begin + sizes - LENGTH + 1] -= 1
    starts = np.flatnonzero(np.cumsum(inside[: len(low)]))
    place = (low[starts] & mask).astype(np.int64)
    fresh = np.ones(len(starts), bool)
    fresh[1:] = (place[1:] != place[:-1]) | (starts[1:] != starts[:-1] + 1)
    first = np.flatnonzero(fresh)
    s0, s1, p = starts[first], starts[np.append(first[1:], len(starts)) - 1], place[first]

    def name(s: np.ndarray) -> np.ndarray:
        return mixed(h[s] * _R[280] + h[s + 64] * _R[281] + mixed(h[s + 128] * _R[282] + h[s + 136] * _R[283]))

    left, more = p - s0, s1 - s0
    hull = mixed(name(s0) * _R[284] + mixed(name(s1) + left.astype(np.uint64) * _R[285] + more.astype(np.uint64)))
    part = np.searchsorted(begin, s0, "right") - 1
    return {"text": np.array(of)[part], "start": s0 - begin[part] + np.array(at)[part], "more": more, "left": left, "anchor": mixed(h[p]).view(np.int64), "hull": hull.view(np.int64), "cut": s0}


def repeated_in_block(bucket: np.ndarray, left: np.ndarray, hulls: list[bytes]) -> np.ndarray:
    """For all suffixes of all hulls, one hull after the other: whether another hull of the bucket has the same LENGTH bytes at the same distance from the anchor."""
    cover = difference_cover(PERIOD)
    sizes = np.array([len(x) for x in hulls], np.int64)
    # Anchors on multiples of PERIOD.
    begin = np.empty(len(hulls), np.int64)
    at = 0
    for i, (n, x) in enumerate(zip(sizes.tolist(), left.tolist(), strict=True)):
        at += -(at + x) % PERIOD
        begin[i] = at
        at += n
    text = np.zeros(at + LENGTH, np.uint8)
    for b, x in zip(begin.tolist(), hulls, strict=True):
        text[b : b + len(x)] = np.frombuffer(x, np.uint8)
    # Ranks of the cover's places: of PERIOD bytes by sorting, then of twice as many by sorting pairs of ranks.
    grid = np.arange(0, at, PERIOD)
    places = (grid[:, None] + np.array(cover)).ravel()
    places = places[places < at]
    index = np.full(at + LENGTH, -1, np.int64)
    index[places] = np.arange(len(places))
    keys = np.lib.stride_tricks.sliding_window_view(text, PERIOD)[places].copy().view(">u8")
    order = np.lexsort(keys.T[::-1])
    step = np.zeros(len(places), np.int64)
    step[1:] = np.cumsum((keys[order[1:]] != keys[order[:-1]]).any(1))
    rank = np.empty(len(places), np.int64)
    rank[order] = step
    short = rank
    for width in (PERIOD, 2 * PERIOD):
        after = index[places + width]
        rank = np.unique(rank << 32 | np.where(after < 0, 0, rank[after] + 1), return_inverse=True)[1].astype(np.int64)
    # Suffixes. From the shift to the cover on, the long rank speaks for 160 bytes; a short one at the cover's last place that leaves it room speaks
    # for 40 near the end; what stands before and after them is shorter than the cover's gaps and compared as it is.
    shift = np.array([min((c - r) % PERIOD for c in cover) for r in range(PERIOD)])
    back = np.array([min((r - c) % PERIOD for c in cover) for r in range(PERIOD)])
    count = sizes - LENGTH + 1
    of = np.repeat(np.arange(len(hulls)), count)
    offset = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    s = begin[of] + offset
    ahead, behind = shift[s % PERIOD], back[(s + LENGTH - PERIOD) % PERIOD]
    width = 8 * -(-int(max(shift.max(), back.max(), 1)) // 8)
    window = np.lib.stride_tricks.sliding_window_view(text, width)

    def words(at: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """The bytes from first to last of the width at each place, as integers."""
        column = np.arange(width)
        return (window[at] * ((column >= first[:, None]) & (column < last[:, None]))).view(">u8").astype(np.uint64).T

    zero, full = np.zeros(len(s), np.int64), np.full(len(s), width)
    columns = [bucket[of], left[of] - offset, *words(s, zero, ahead), rank[index[s + ahead]], short[index[s + LENGTH - PERIOD - behind]], *words(s + LENGTH - width, full - behind, full)]
    order = np.lexsort(columns[::-1])
    same = np.ones(len(order) - 1, bool) if len(order) else np.zeros(0, bool)
    for c in columns:
        same &= c[order[1:]] == c[order[:-1]]
    out = np.zeros(len(order), bool)
    out[order[1:]] |= same
    out[order[:-1]] |= same
    return out


def _runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.flatnonzero(np.diff(flags.astype(np.int8), prepend=0, append=0))
    return edge[0::2], edge[1::2] - 1


def _lots(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, list[bytes], dict[str, np.ndarray]]]:
    for b in batches:
        for start in range(0, b.num_rows, 512):
            ids = b.column(0)[start : start + 512]
            texts = [t or b"" for t in b.column(1)[start : start + 512].cast(pa.large_binary()).to_pylist()]
            for of, at, parts in _pieces(texts):
                yield ids, parts, anchors(of, at, parts)


def _key(documents: DataFrame, id_col: str, text_col: str):
    """What tells texts apart, also where ids are null or repeat: rows of equal keys have equal spans."""
    return F.struct(documents[id_col].cast("bigint").alias("id"), F.xxhash64(documents[text_col].cast("string")).alias("print"))


def repeated_spans(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc (as _key), spans: for each document with repeats, arrays of struct<lo, hi>: byte ranges that may touch or overlap."""
    docs = documents.select(_key(documents, id_col, text_col).alias("doc"), documents[text_col].cast("string").alias("text"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, x in _lots(batches):
            yield pa.RecordBatch.from_arrays([pa.array(x["anchor"]), pa.array(x["hull"])], ["anchor", "hull"])

    seen = docs.mapInArrow(scan, "anchor bigint, hull bigint").groupBy("anchor").agg(F.count("*").alias("n"), F.min("hull").alias("lo"), F.max("hull").alias("hi"))
    several = stored(seen.where("n > 1").select("anchor", (F.col("lo") != F.col("hi")).alias("differ")))
    # By the anchor's own bits.
    size = filter_bits(several.count())
    bit_of = F.expr(f"anchor & {size - 1}L")
    known = documents.sparkSession.sparkContext.broadcast((filter_of(several, bit_of), filter_of(several.where("differ"), bit_of)))

    def cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        has, open_ = (np.frombuffer(x, np.uint8) for x in known.value)
        for ids, parts, x in _lots(batches):
            bit = x["anchor"] & (size - 1)
            keep = np.flatnonzero(passes(has, bit))
            x = {k: v[keep] for k, v in x.items()}
            bit = bit[keep]
            wanted = passes(open_, bit)
            _, once = np.unique(np.stack([x["anchor"], x["hull"]]), axis=1, return_index=True) if len(keep) else (None, np.zeros(0, int))
            wanted &= np.isin(np.arange(len(keep)), once)
            lot = b"".join(parts)
            hulls = [lot[c : c + m + LENGTH] if w else None for c, m, w in zip(x["cut"].tolist(), x["more"].tolist(), wanted.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(x["text"])), *(pa.array(x[k]) for k in ("anchor", "hull", "start")), *(pa.array(x[k].astype(np.int32)) for k in ("more", "left")), pa.array(hulls, pa.binary())], ["doc", "anchor", "hull", "start", "more", "left", "data"])

    met = stored(docs.mapInArrow(cut_out, "doc struct<id:bigint,print:bigint>, anchor bigint, hull bigint, start bigint, more int, left int, data binary").join(several, "anchor"))
    sure = met.where("not differ").select("doc", F.col("start").alias("lo"), F.expr(f"start + more + {LENGTH}").alias("hi"))

    apart = met.where("differ")
    copies = apart.groupBy("anchor", "hull").agg(F.count("*").alias("n"), F.any_value("data", True).alias("data"), F.any_value("left").alias("left"))
    copies = stored(copies)
    # Rows of buckets that are small enough, and after HALVINGS those that aren't. lo, hi: the distances from the anchor that a row stands for.
    rest = copies.select("anchor", "hull", "n", "left", "data", F.lit(0).alias("lo"), F.lit(LENGTH - HEAD).alias("hi"), F.lit(None).cast("binary").alias("same"))
    fitting = None
    for level in range(HALVINGS + 1):
        key = ["anchor", "lo", "same"]
        large = stored(rest.groupBy(*key).agg(F.count("*").alias("hulls")).where(f"hulls > {BUCKET_MAX}").drop("hulls"))
        n_large = large.count()
        named = large.select(*[F.col(c).alias(f"k_{c}") for c in key])
        named = F.broadcast(named) if n_large <= FEW else named
        met = (F.col("anchor") == F.col("k_anchor")) & (F.col("lo") == F.col("k_lo")) & F.col("same").eqNullSafe(F.col("k_same"))
        fits = rest.join(named, met, "left_anti") if n_large else rest
        fitting = fits if fitting is None else fitting.unionByName(fits)
        if not n_large:
            rest = None
            break
        rest = rest.join(named, met, "left_semi")
        if level < HALVINGS:
            halves = "array(struct(lo as lo, cast((lo + hi) div 2 as int) as hi), struct(cast((lo + hi) div 2 as int) + 1 as lo, hi as hi))"
            rest = rest.withColumn("h", F.explode(F.expr(f"filter({halves}, h -> h.lo <= h.hi and h.lo <= left and h.hi >= left - (length(data) - {LENGTH}))")))
            rest = stored(rest.select("anchor", "hull", "n", "left", "data", "h.lo", "h.hi", F.expr(f"substring(data, left - h.lo + 1, {LENGTH} - h.hi + h.lo)").alias("same")))
    # What a row's suffixes need of its hull.
    fitting = fitting.withColumns({"top": F.expr("least(hi, left)"), "low": F.expr(f"greatest(lo, left - (length(data) - {LENGTH}))")})
    fitting = fitting.select("anchor", "hull", "n", F.expr("left - top").alias("base"), F.col("top").alias("left"), F.expr(f"substring(data, left - top + 1, top - low + {LENGTH})").alias("data"), F.xxhash64("anchor", "lo", "same").alias("bucket"))
    fitting = stored(fitting)
    n_blocks = max(1, math.ceil(fitting.count() / BLOCK_HULLS))

    def sort_block(t: pa.Table) -> pa.Table:
        anchor, hull, n, left, base, bucket = (t[k].to_numpy() for k in ("anchor", "hull", "n", "left", "base", "bucket"))
        data = t["data"].to_pylist()
        again = repeated_in_block(bucket, left.astype(np.int64), data)
        rows: list[tuple] = []
        at = 0
        for i, d in enumerate(data):
            m = len(d) - LENGTH + 1
            lo, hi = ([0], [m - 1]) if n[i] > 1 else _runs(again[at : at + m])
            rows += [(anchor[i], hull[i], a + base[i], b + base[i]) for a, b in zip(lo, hi, strict=True)]
            at += m
        return pa.table(dict(zip(("anchor", "hull", "first", "last"), (pa.array([r[k] for r in rows], pa.int64() if k < 2 else pa.int32()) for k in range(4)), strict=True)))

    ranges = fitting.withColumn("block", F.pmod(F.col("bucket"), F.lit(n_blocks))).groupBy("block").applyInArrow(sort_block, "anchor bigint, hull bigint, first int, last int")
    if rest is not None:
        ranges = ranges.unionByName(rest.select("anchor", "hull", F.expr("left - lo").alias("first"), F.expr("left - lo").alias("last")))
    edges = apart.join(ranges, ["anchor", "hull"]).select("doc", F.expr("start + first").alias("lo"), F.expr(f"start + last + {LENGTH}").alias("hi"))
    return sure.unionByName(edges).groupBy("doc").agg(F.collect_set(F.struct("lo", "hi")).alias("spans"))  # equal rows share their key and have the same spans


def _kept(raw: bytes, spans: list | None) -> tuple[int, int, bytes]:
    """Bytes removed, runs of them, and what stays. spans: (lo, hi) in any order."""
    if not spans:
        return 0, 0, raw
    removed = runs = end = 0
    kept = []
    for lo, hi in sorted(spans):
        if lo > end or not runs:
            kept.append(raw[end:lo])
            runs += 1
            end = lo
        if hi > end:
            removed += hi - end
            end = hi
    return removed, runs, b"".join([*kept, raw[end:]])


def without_repeats(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each row of documents: doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept (the remaining bytes) and their kept_sha256."""
    spans = repeated_spans(documents, id_col, text_col)
    docs = documents.select(_key(documents, id_col, text_col).alias("key"), documents[text_col].cast("string").alias("text"))
    rows = docs.join(spans, docs.key == spans.doc, "left").select(F.col("key.id").alias("id"), "text", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start in range(0, b.num_rows, 512):
                c = b.slice(start, 512)
                texts = [t or b"" for t in c.column(1).cast(pa.large_binary()).to_pylist()]
                out = [_kept(t, s and [(x["lo"], x["hi"]) for x in s]) for t, s in zip(texts, c.column(2).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([c.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64()), pa.array([x[2] for x in out], pa.binary()), pa.array([hashlib.sha256(x[2]).hexdigest() for x in out], pa.string())], ["id", "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256"])

    return rows.mapInArrow(run, "id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary, kept_sha256 string").withColumnRenamed("id", id_col)


def op8_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    return without_repeats(table(spark, sf_dir, "documents")).drop("kept")
