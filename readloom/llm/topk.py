"""Exact top-k search by inner product, pruned with multi-resolution segment statistics.

A vector is cut into 1, 4, then 16 segments. With the mean m and deviation s of a segment of n components, |a - b|^2 over it is at least
n * ((m_a - m_b)^2 + (s_a - s_b)^2), so the sum over segments bounds the distance from below and, as q.v = (|q|^2 + |v|^2 - |q - v|^2) / 2,
the score from above: by the sum of n * (m_q * m_v + s_q * s_v). Bounds are taken coarse to fine against the k-th best exact score found so far; exact scores follow for survivors only.

Queries and candidates are dealt into blocks of bounded size, and each pair of a query block and a candidate block is one task's group; no side is
broadcast or collected. Each group returns k rows for each of its queries, and a window takes the k best of those.

Defined results: vectors that are null or hold null, NaN or infinite components, and rows without vec_id, take no part; each row is a vector of its own, so rows of one vec_id are
candidates to each other; only vectors of one dimension are compared; fewer candidates than k give fewer rows; ties go to the smaller vec_id; components of any
finite size are treated exactly, and a score of the result that no 64-bit integer holds raises an error; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from readloom.llm.common import stored, table

LEVELS = (1, 4, 16)
QUERY_BLOCK, CANDIDATE_BLOCK, PART = 1024, 4096, 64
FOUND = "query_row bigint, query_id bigint, vec_id bigint, score bigint"
LONG = 1 << 63


def _stats(x: np.ndarray, segments: int) -> tuple[np.ndarray, np.ndarray]:
    """Features whose inner product bounds that of the vectors: sqrt(n) * mean and sqrt(n) * deviation of each segment."""
    parts = np.array_split(x, min(segments, max(1, x.shape[1])), axis=1)
    root = [math.sqrt(p.shape[1]) for p in parts]
    mean = np.stack([p.mean(1) * r if p.shape[1] else np.zeros(len(x)) for p, r in zip(parts, root, strict=True)], 1)
    dev = np.stack([p.std(1) * r if p.shape[1] else np.zeros(len(x)) for p, r in zip(parts, root, strict=True)], 1)
    return np.hstack([mean, dev]), (x * x).sum(1)


def _best(q: np.ndarray, q_ids: np.ndarray, q_rows: np.ndarray, v: np.ndarray, v_ids: np.ndarray, v_rows: np.ndarray, k: int, counts: list | None = None) -> pd.DataFrame:
    """The k best candidates of each query within one pair of blocks, but for its own row. v is sorted by id. counts: gets the pairs left after each level.

    Bounds and exact scores are matrix products over the candidates that some query of the part still needs."""
    fq, fv = q.astype(float), v.astype(float)
    # Sums under 2^53 are exact in doubles, whose products are much faster; those that 64 bits don't hold are Python integers.
    largest = float(np.abs(fq).max()) * float(np.abs(fv).max()) * q.shape[1] if q.size and v.size else 0.0
    kind = np.int64 if largest < 2.0**62 else object
    x, y = (fq, fv) if largest < 2.0**53 else (q.astype(kind), v.astype(kind))
    # A common factor changes no order, and keeps squares of components within doubles.
    unit = max(1.0, float(np.abs(fq).max(initial=0)), float(np.abs(fv).max(initial=0))) if kind is object else 1.0
    stats = [(_stats(fq / unit, n), _stats(fv / unit, n)) for n in LEVELS]
    least = np.iinfo(np.int64).min if kind is np.int64 else -math.inf

    def score(rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
        out = (x[rows] @ y[cols].T).astype(kind)
        out[q_rows[rows, None] == v_rows[None, cols]] = least
        return out

    found = []
    for start in range(0, len(q), PART):
        rows, cols = np.arange(start, min(start + PART, len(q))), np.arange(len(v))
        # A first threshold for each query: its k-th exact score among those candidates whose middle bounds are best for any query of the part.
        (a, _), (b, _) = stats[1]
        n_seeds = min(len(v), k + 1)
        seeds = np.unique(np.argpartition(-(a[rows] @ b.T), n_seeds - 1, axis=1)[:, :n_seeds])
        scores = score(rows, seeds)
        limit = np.sort(scores, axis=1)[:, len(seeds) - k] if len(seeds) >= k else np.full(len(rows), least, kind)
        alive, left = np.ones((len(rows), len(v)), bool), [len(rows) * len(v)]
        for (a, na), (b, nb) in stats:
            slack = 1e-9 * (na[rows, None] + nb[None, cols]) + 1e-6
            alive &= a[rows] @ b[cols].T + slack >= limit.astype(float)[:, None] / unit**2
            some = alive.any(0)
            cols, alive = cols[some], alive[:, some]
            left.append(int(alive.sum()))
        if counts is not None:
            counts.append(left)
        scores = score(rows, cols)
        r, c = np.nonzero(alive & (scores >= limit[:, None]) & (scores > least))
        ids, s = v_ids[cols[c]], scores[r, c]
        order = np.argsort(ids, kind="stable")
        order = order[np.argsort(-s[order], kind="stable")]  # no score here is least, so -s holds
        order = order[np.argsort(r[order], kind="stable")]
        r, ids, s = r[order], ids[order], s[order]
        rank = np.arange(len(r)) - np.searchsorted(r, r)
        r, ids, s = r[rank < k], ids[rank < k], s[rank < k]
        if kind is object and any(not -LONG <= z < LONG for z in s):
            raise OverflowError("a score doesn't fit into 64 bits")
        found.append(pd.DataFrame({"query_row": q_rows[rows[r]], "query_id": q_ids[rows[r]], "vec_id": ids, "score": s.astype(np.int64)}))
    return pd.concat(found, ignore_index=True) if found else pd.DataFrame({c: [] for c in ("query_row", "query_id", "vec_id", "score")}, dtype=np.int64)


def _integers(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x), in doubles: as 64-bit integers where all fit, else as Python integers."""
    y = np.floor(scale * x)
    return y.astype(np.int64) if not y.size or np.abs(y).max() < 2.0**62 else np.array([[int(c) for c in r] for r in y], object).reshape(x.shape)


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256, query_block: int = QUERY_BLOCK, candidate_block: int = CANDIDATE_BLOCK) -> DataFrame:
    """query_id, rank (from 1), vec_id, score. Components become floor(scale * x); queries: rows whose id is divisible by every."""
    x = vectors.select(vectors[id_col].cast("bigint").alias("vec_id"), vectors[vector_col].cast("array<double>").alias("x")).where("vec_id is not null and x is not null and forall(x, c -> c is not null and not isnan(c) and abs(c) < double('Infinity'))")
    # Written, so that a row is the same one on both sides.
    keyed = stored(x.select("vec_id", "x", F.size("x").alias("dim"))).withColumn("row", F.monotonically_increasing_id())
    n, n_queries = keyed.select(F.count("*"), F.count_if(F.col("vec_id") % every == 0)).first()
    p, qn = max(1, math.ceil(n / candidate_block)), max(1, math.ceil(n_queries / query_block))
    block = F.xxhash64("row")
    queries = keyed.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("vec_id"), F.col("row").alias("row"), F.col("x").alias("x"), F.col("dim").alias("dim"), F.pmod(block, F.lit(qn)).alias("qb"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(p - 1).cast("bigint"))).alias("cb"))
    candidates = keyed.select("vec_id", "row", "x", "dim", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(qn - 1).cast("bigint"))).alias("qb"), F.pmod(block, F.lit(p)).alias("cb"))

    def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({c: [] for c in ("query_row", "query_id", "vec_id", "score")}, dtype=np.int64)
        right = right.sort_values(["vec_id", "row"])
        dim = int(left["dim"].iloc[0])
        q, v = (_integers(np.stack(t["x"].to_list()).astype(float).reshape(len(t), dim), scale) for t in (left, right))
        (q_ids, q_rows), (v_ids, v_rows) = ((t["vec_id"].to_numpy(np.int64), t["row"].to_numpy(np.int64)) for t in (left, right))
        return _best(q, q_ids, q_rows, v, v_ids, v_rows, k)

    keys = ["dim", "qb", "cb"]
    found = queries.groupBy(*keys).cogroup(candidates.groupBy(*keys)).applyInPandas(search, FOUND)
    best = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op3_topk_search(spark, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"))


OP3_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.x, c.x), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
), r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
