"""Hard negatives by bit-sliced integer products.

Components become integers, and a vector's integers become bit planes: one bit of each component in two's complement, packed into 64-bit words. The product of an anchor with a candidate's plane is a sum of counted bits (of the
anchor's planes and that plane), weighted by the planes' values. Planes of candidates are taken most significant first. What the lower planes may still add lies between that many times the sum of the anchor's negative and of its
positive components, so each plane halves the interval that holds the score. A candidate goes as soon as its interval shows that it can't be among those asked for; the intervals of what is left end as exact scores.

An anchor's positives are its best candidates of the same label, searched among vectors of that label only. A negative for a positive of score p has a different label and a score from the margin's share of p up to p: candidates
go when their intervals leave all bands of the anchor's positives, or when enough others that are surely in the band are surely better.

Anchors and candidates are dealt into blocks of bounded size as packed planes (8 bytes for each plane and 64 components); each pair of blocks is one task's group, no side is broadcast or collected. Each group returns the asked-for number of
rows at most for each anchor (and positive), and a window takes the best of those.

Defined results: vectors that are null or hold null, NaN or infinite components, and rows without id or label, take no part; each row is a vector of its own, so rows of one id are other rows to each other and each of them an
anchor; only vectors of one dimension are compared; fewer than asked for give fewer rows; ties go to the smaller id; other columns, whatever their names, are ignored. Components of any finite size are treated
exactly (as Python integers where 64 bits don't hold the sums); a score of the result that no 64-bit integer holds raises an error.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from readloom.llm.common import stored, table

ANCHORS, CANDIDATES, PART = 1024, 8192, 64  #: anchors and candidates of a block; anchors that a task takes at a time
DENSE = 0.25  #: share of a task's pairs up to which they are taken one by one
LONG = 1 << 63


def sliced(x: np.ndarray, planes: int) -> np.ndarray:
    """Planes of integers (rows, components): (rows, planes, words), the least significant plane first, the last one the sign's."""
    words = max(1, -(-x.shape[1] // 64))
    bits = np.zeros((len(x), planes, words * 64), np.uint8)
    for j in range(planes):
        bits[:, j, : x.shape[1]] = x >> j & 1
    return np.packbits(bits, axis=2, bitorder="little").view("<u8")


class Intervals:
    """Scores of pairs (anchor, candidate), bounded from below and above while planes of the candidates come in."""

    def __init__(self, q: np.ndarray, v: np.ndarray) -> None:
        """q, v: planes of anchors and candidates."""
        self.q, self.v, self.planes, self.words = q, v, q.shape[1], q.shape[2]
        # Sums and their hundredfold fit 64 bits, or are Python integers.
        self.kind = np.int64 if 2 * self.planes + (64 * self.words).bit_length() + 7 < 63 else object
        self.values = np.array([-(1 << j) if j == self.planes - 1 else 1 << j for j in range(self.planes)], self.kind)
        count = lambda bits: np.bitwise_count(bits).astype(np.int64).sum(2).astype(self.kind) @ self.values
        self.least = count(q & q[:, -1:, :])  # the sum of an anchor's negative components
        self.most = count(q) - self.least

    def part(self, plane: int, q: np.ndarray, v: np.ndarray) -> np.ndarray:
        """What a plane adds. q: (planes, words, ...) of anchors, v: (words, ...) of the plane; the rest broadcasts."""
        counts = sum(np.bitwise_count(q[i, w] & v[w]).astype(self.kind) * self.values[i] for i in range(self.planes) for w in range(self.words))
        return counts * self.values[plane]

    def refine(self, allowed: np.ndarray, judge: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray], left: list | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Anchors, candidates and exact scores of those allowed pairs that judge keeps to the end, anchors and candidates ascending. judge: gets pairs' anchors, least and greatest scores after each plane, says which may stay.

        While most pairs are left, planes are taken for all of them at once, then for each pair that is left. left: gets their number after each plane."""
        alive, plane = allowed.copy(), self.planes - 1
        score = np.zeros(alive.shape, self.kind)
        wide_q = np.moveaxis(self.q, 0, 2)[..., None]

        def judged(r: np.ndarray, s: np.ndarray) -> np.ndarray:
            rest = (1 << plane) - 1
            keep = judge(r, s + self.least[r] * rest, s + self.most[r] * rest)
            if left is not None:
                left.append(int(keep.sum()))
            return keep

        while plane >= 0 and alive.mean() > DENSE:
            score += self.part(plane, wide_q, self.v[:, plane].T[:, None, :])
            rows, cols = np.nonzero(alive)
            gone = ~judged(rows, score[rows, cols])
            alive[rows[gone], cols[gone]] = False
            plane -= 1
        rows, cols = np.nonzero(alive)
        s = score[rows, cols]
        while plane >= 0:
            s = s + self.part(plane, np.moveaxis(self.q[rows], 0, 2), self.v[cols, plane].T)
            keep = judged(rows, s)
            rows, cols, s = rows[keep], cols[keep], s[keep]
            plane -= 1
        return rows, cols, s


def kth(rows: np.ndarray, low: np.ndarray, n: int, k: int) -> np.ndarray:
    """For each of n anchors the k-th greatest of its pairs' values; where it has fewer, what is under all others."""
    order = np.argsort(low, kind="stable")
    order = order[np.argsort(rows[order], kind="stable")]
    at = np.searchsorted(rows[order], np.arange(n + 1))
    out = np.full(n, -math.inf if low.dtype == object else np.iinfo(np.int64).min, low.dtype)
    enough = np.diff(at) >= k
    out[enough] = low[order[at[1:][enough] - k]]
    return out


def nearest(x: Intervals, allowed: np.ndarray, k: int, left: list | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best allowed candidates of each anchor, of equal scores the first ones: anchors, candidates, scores."""

    def judge(rows: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        if not len(rows) or low.max() <= high.min():  # so wide that nothing can go
            return np.ones(len(rows), bool)
        return high >= kth(rows, low, len(x.q), k)[rows]

    return first(*x.refine(allowed, judge, left), k)


def in_bands(x: Intervals, allowed: np.ndarray, tops: np.ndarray, k: int, percent: int, left: list | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each anchor and each of its bands (tops: anchors x bands, None where an anchor has fewer) the k best allowed candidates with a score from percent of the band's top up to it: anchors, bands, candidates, scores."""
    has = np.not_equal(tops, None)
    tops = np.where(has, tops, 0).astype(x.kind)

    def judge(rows: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        keep = np.zeros(len(rows), bool)
        for b in range(tops.shape[1]):
            top = tops[rows, b]
            some = has[rows, b] & (low <= top) & (100 * high >= percent * top)
            sure = some & (high <= top) & (100 * low >= percent * top)
            if sure.any():
                some &= high >= kth(rows[sure], low[sure], len(x.q), k)[rows]
            keep |= some
        return keep

    rows, cols, score = x.refine(allowed, judge, left)
    out = []
    for b in range(tops.shape[1]):
        top = tops[rows, b]
        inside = has[rows, b] & (score <= top) & (100 * score >= percent * top)
        r, c, s = first(rows[inside], cols[inside], score[inside], k)
        out.append((r, np.full(len(r), b), c, s))
    return tuple(np.concatenate(z) for z in zip(*out, strict=True)) if out else (rows[:0], rows[:0], cols[:0], score[:0])


def first(rows: np.ndarray, cols: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of pairs in ascending order each row's k greatest scores, of equal ones the first."""
    order = np.argsort(-score, kind="stable")
    order = order[np.argsort(rows[order], kind="stable")]
    rows, cols, score = rows[order], cols[order], score[order]
    keep = np.arange(len(rows)) - np.searchsorted(rows, rows) < k
    return rows[keep], cols[keep], score[keep]


def _integers(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x), in doubles: as 64-bit integers where all fit, else as Python integers."""
    y = np.floor(scale * x)
    if not y.size or np.abs(y).max() < 2.0**62:
        return y.astype(np.int64)
    return np.array([[int(c) for c in r] for r in y], object).reshape(x.shape)


def planes_of(vectors: DataFrame, scale: int = 256) -> tuple[DataFrame, int]:
    """vectors: vec_id, label, x (array<double>). Stored rows row, vec_id, label, dim, bits; and the number of planes, which all of them share."""
    most = vectors.agg(F.max(F.expr("array_max(transform(x, c -> abs(c)))"))).first()[0] or 0.0
    planes = (math.floor(scale * most) + 1).bit_length() + 1

    def slice_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dim = np.array([len(v) for v in batch.column(2)], np.int64)
            bits: list[bytes] = [b""] * len(batch)
            for d in np.unique(dim):
                at = np.flatnonzero(dim == d)
                x = np.array(batch.column(2).take(pa.array(at)).flatten(), float).reshape(len(at), d)
                for i, b in zip(at, sliced(_integers(x, scale), planes), strict=True):
                    bits[i] = b.tobytes()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(dim, pa.int32()), pa.array(bits, pa.binary())], names=["vec_id", "label", "dim", "bits"])

    made = stored(vectors.select("vec_id", "label", "x").mapInArrow(slice_, "vec_id bigint, label bigint, dim int, bits binary"))
    return made.withColumn("row", F.monotonically_increasing_id()), planes  # the files don't change, so nor do rows


def _array(bits: pd.Series, planes: int) -> np.ndarray:
    return np.frombuffer(b"".join(bits), "<u8").reshape(len(bits), planes, -1)


def _frame(columns: dict[str, list]) -> pd.DataFrame:
    out = {c: np.concatenate(v) if v else np.zeros(0, np.int64) for c, v in columns.items()}
    for c, v in out.items():
        if v.dtype == object:
            if len(v) and max(abs(int(s)) for s in v) >= LONG:
                raise OverflowError(f"a {c} doesn't fit into 64 bits")
            out[c] = v.astype(np.int64)
    return pd.DataFrame(out)


def positives(rows: DataFrame, planes: int, anchors: DataFrame, k: int, anchor_block: int = ANCHORS, candidate_block: int = CANDIDATES) -> DataFrame:
    """a_row, p_row, positive_id, positive_score: the k best other rows of the anchor's label."""
    keys = ["dim", "label", "ab", "cb"]
    left, right = _dealt(rows, anchors, ["dim", "label"], anchor_block, candidate_block)

    def search(a: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        out: dict[str, list] = {"a_row": [], "p_row": [], "positive_id": [], "positive_score": []}
        if len(a) and len(c):
            c = c.sort_values(["vec_id", "row"])
            q, v, ids, places = _array(a["bits"], planes), _array(c["bits"], planes), c["vec_id"].to_numpy(), c["row"].to_numpy()
            for start in range(0, len(a), PART):
                own = a["row"].to_numpy()[start : start + PART]
                r, col, score = nearest(Intervals(q[start : start + PART], v), own[:, None] != places[None, :], k)
                for name, x in zip(out, (own[r], places[col], ids[col], score), strict=True):
                    out[name].append(x)
        return _frame(out)

    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(search, "a_row bigint, p_row bigint, positive_id bigint, positive_score bigint")
    best = Window.partitionBy("a_row").orderBy(F.desc("positive_score"), "positive_id", "p_row")
    return found.withColumn("r", F.row_number().over(best)).where(F.col("r") <= k).drop("r")


def _dealt(rows: DataFrame, anchors: DataFrame, keys: list[str], anchor_block: int, candidate_block: int) -> tuple[DataFrame, DataFrame]:
    """anchors with ab and each cb, rows with cb and each ab. The numbers of blocks are those of the largest set of rows with equal keys, so that no block is larger; small sets leave most of their blocks empty."""
    sizes = lambda t: t.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    n_a, n_c = max(1, math.ceil(sizes(anchors) / anchor_block)), max(1, math.ceil(sizes(rows) / candidate_block))
    block = F.xxhash64("row")
    left = anchors.select(*[F.col(c).alias(c) for c in anchors.columns]).withColumns({"ab": F.pmod(block, F.lit(n_a)), "cb": F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n_c - 1).cast("bigint")))})
    right = rows.withColumns({"cb": F.pmod(block, F.lit(n_c)), "ab": F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n_a - 1).cast("bigint")))})
    return left, right


def hard_negatives(vectors: DataFrame, is_anchor: Column, n_positives: int = 5, n_negatives: int = 5, percent: int = 80, scale: int = 256, anchor_block: int = ANCHORS, candidate_block: int = CANDIDATES) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score. vectors: vec_id, label, embedding; is_anchor: a condition on vec_id."""
    x = F.expr("cast(embedding as array<double>)")
    slim = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("label").cast("bigint").alias("label"), x.alias("x"))
    slim = slim.where("vec_id is not null and label is not null and x is not null and forall(x, c -> c is not null and not isnan(c) and abs(c) < double('Infinity'))")
    rows, planes = planes_of(slim, scale)
    anchors = rows.where(is_anchor)
    pairs = stored(positives(rows, planes, anchors, n_positives, anchor_block, candidate_block))
    bands = pairs.groupBy("a_row").agg(F.sort_array(F.collect_list(F.struct("p_row", "positive_id", "positive_score"))).alias("p"))  # n_positives at most
    asked = anchors.join(bands.withColumnRenamed("a_row", "row"), "row").withColumnRenamed("label", "own")
    left, right = _dealt(rows, asked, ["dim"], anchor_block, candidate_block)
    keys = ["dim", "ab", "cb"]

    def search(a: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        out: dict[str, list] = {"a_row": [], "anchor_id": [], "p_row": [], "positive_id": [], "negative_id": [], "positive_score": [], "negative_score": []}
        if len(a) and len(c):
            c = c.sort_values(["vec_id", "row"])
            q, v, ids, labels = _array(a["bits"], planes), _array(c["bits"], planes), c["vec_id"].to_numpy(), c["label"].to_numpy()
            for start in range(0, len(a), PART):
                some = a.iloc[start : start + PART]
                own, own_ids = some["row"].to_numpy(), some["vec_id"].to_numpy()
                held = some["p"].to_list()
                tops = np.array([[*(p["positive_score"] for p in h), *[None] * (n_positives - len(h))] for h in held], object).reshape(len(some), n_positives)
                other = some["own"].to_numpy()[:, None] != labels[None, :]
                r, band, col, score = in_bands(Intervals(q[start : start + PART], v), other, tops, n_negatives, percent)
                of = [held[i][b] for i, b in zip(r, band, strict=True)]
                p_rows, p_ids, top = (np.array([p[f] for p in of], np.int64) for f in ("p_row", "positive_id", "positive_score"))
                for name, z in zip(out, (own[r], own_ids[r], p_rows, p_ids, ids[col], top, score), strict=True):
                    out[name].append(z)
        return _frame(out)

    schema = "a_row bigint, anchor_id bigint, p_row bigint, positive_id bigint, negative_id bigint, positive_score bigint, negative_score bigint"
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(search, schema)
    best = Window.partitionBy("a_row", "p_row").orderBy(F.desc("negative_score"), "negative_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= n_negatives).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op13_hard_negatives(spark, sf_dir: str) -> DataFrame:
    """Every seventh id's label is moved by one first."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(table(spark, sf_dir, "embeddings").withColumn("label", moved), F.col("vec_id") % 100 == 0)


OP13_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS x, row_number() OVER () AS r FROM embeddings
  WHERE label IS NOT NULL AND vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.r AS ar, a.vec_id AS anchor_id, c.r AS cr, c.vec_id, a.label = c.label AS same, CAST(list_sum(list_transform(list_zip(a.x, c.x), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v a JOIN v c ON a.r <> c.r WHERE a.vec_id % 100 = 0
), p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ar ORDER BY score DESC, vec_id) AS k FROM s WHERE same) WHERE k <= 5),
n AS (
  SELECT p.anchor_id, p.vec_id AS positive_id, CAST(row_number() OVER (PARTITION BY p.ar, p.cr ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score
  FROM p JOIN s ON s.ar = p.ar AND NOT s.same AND 80 * p.score <= 100 * s.score AND 100 * s.score <= 100 * p.score
) SELECT * FROM n WHERE rank <= 5
"""
