"""Mixing sources to target weights by temperature, DataFrame operations only.

A source with share s of all tokens gets weight s^t / sum(s^t). The exponent t in [0, 1] is bisected to the smallest at which no source would be
repeated more often than max_repeats within the token budget; where a target entropy is named (as a part of the entropy of equal weights), t is raised
further, if need be, until the weights' entropy is no higher than that. Lower exponents flatten the mixture, so both conditions are monotone in t.

All of an exponent's conditions are a few sums and maxima over sources, so GRID exponents are tried in one aggregation and the interval shrinks to a part in GRID each round: no row holds all sources.

The weights are realised exactly to within one document per source: a source with budget b and T tokens is passed over b div T times in full, and for the rest its documents are
permuted in blocks. Documents go to about sqrt(n) blocks by a hash of their id, blocks are permuted by a seeded hash, blocks that fit the rest are drawn whole, and within the one block at
the edge documents are drawn in hash order while they fit. So cumulative sums run over a source's blocks and over one block's documents only, never over all of a source.

Defined results: a null source counts as the source ''; a null or empty text has 0 tokens; a source without tokens is dropped; rows that share source and doc_id are drawn together; an
empty table gives an empty result; columns pass through unchanged. Tokens are words between blanks.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from readloom.llm.common import cut, free_prefix, stored, table

MAX_REPEATS, ENTROPY_PART, SEED = 4.0, 0.9, 17
GRID, ROUNDS = 32, 8  #: exponents tried in a round, and rounds: the interval shrinks to 32^-8 = 2^-40
FEW = 10_000  #: sources whose plan is broadcast


def source_weights(sizes: DataFrame, budget: int | None = None, max_repeats: float = MAX_REPEATS, entropy_part: float | None = ENTROPY_PART) -> DataFrame:
    """sizes: src, docs, tokens (one row a source). Adds exponent, weight, budget (tokens to draw), passes and rest (budget = passes * tokens + rest)."""
    rows = sizes.where("tokens > 0").select("src", "docs", "tokens")
    total, n, least, most = rows.agg(F.sum("tokens"), F.count("*"), F.min("tokens"), F.max("tokens")).first()
    if not n:
        return rows.select("*", *[F.lit(0.0).cast(t).alias(c) for c, t in (("exponent", "double"), ("weight", "double"), ("budget", "bigint"), ("passes", "bigint"), ("rest", "bigint"))])
    goal = float(total if budget is None else budget)
    share = F.col("tokens") / F.lit(float(total))

    def fit(exponents: list[float]) -> tuple[list[bool], list[float]]:
        """Whether each exponent fits, and the sum of its powers. With z = sum(s^t) a weight is s^t / z: repeats are greatest at the least source, and the entropy is ln z - t * sum(s^t ln s) / z."""
        sums = rows.agg(*[f for t in exponents for f in (F.sum(F.pow(share, F.lit(t))), F.sum(F.pow(share, F.lit(t)) * F.log(share)))]).first()
        out, z = [], [sums[2 * i] for i in range(len(exponents))]
        for i, t in enumerate(exponents):
            repeats = (least / total) ** t / z[i] * goal / least if t < 1 else goal / total
            entropy = math.log(z[i]) - t * sums[2 * i + 1] / z[i]
            out.append(repeats <= max_repeats + 1e-9 and (entropy_part is None or entropy <= entropy_part * math.log(n) + 1e-12))
        return out, z

    # Between low (does not fit) and high (fits, or is 1).
    low, high = 0.0, 1.0
    if fit([0.0])[0][0]:
        high = 0.0
    else:
        for _ in range(ROUNDS):
            tried = [low + (high - low) * i / GRID for i in range(1, GRID)]
            fits = [*fit(tried)[0], True]
            first = fits.index(True)
            low, high = (tried[first - 1] if first else low), (tried[first] if first < len(tried) else high)
    z = fit([high])[1][0]
    out = rows.select("*", F.lit(high).alias("exponent"), (F.pow(share, F.lit(high)) / F.lit(z)).alias("weight"))
    out = out.withColumn("budget", F.floor(F.col("weight") * F.lit(goal) + F.lit(1e-6)).cast("bigint"))
    return out.withColumns({"passes": F.expr("budget div tokens"), "rest": F.expr("budget % tokens")})


def _beside(rows: DataFrame, few: DataFrame, on: str) -> DataFrame:
    """rows joined to few, written before, of which one row belongs to each source. Few are broadcast once counted; more are joined by shuffle."""
    return rows.join(F.broadcast(few) if few.count() <= FEW else few, rows[on] == few["src"])


def draw(docs: DataFrame, budget: int | None = None, max_repeats: float = MAX_REPEATS, entropy_part: float | None = ENTROPY_PART, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """__src, __id, __copies: how often each (source, document) is drawn; __block and __rank: its place in the permutation of the last pass. Those drawn 0 times are left out."""
    gap = r"[\\x20\\x09-\\x0D]+"
    words = F.expr(f"cast(size(array_remove(split(coalesce(cast(`{text_col}` as string), ''), '{gap}'), '')) as bigint)")
    slim = stored(docs.select(F.coalesce(docs[source_col].cast("string"), F.lit("")).alias("__src"), docs[id_col].alias("__id"), words.alias("n")))
    sizes = slim.groupBy(F.col("__src").alias("src")).agg(F.count("*").alias("docs"), F.sum("n").alias("tokens"))
    plan = stored(source_weights(stored(sizes), budget, max_repeats, entropy_part).withColumn("n_blocks", F.expr("cast(ceil(sqrt(docs)) as bigint)")).select("src", "passes", "rest", "n_blocks"))

    placed = _beside(slim, plan, "__src").withColumn("__block", F.expr(f"pmod(xxhash64(__id, {seed}), n_blocks)"))
    blocks = placed.groupBy("src", "__block", "passes", "rest").agg(F.sum("n").alias("block_tokens"))
    order = Window.partitionBy("src").orderBy(F.xxhash64("__block", F.lit(seed), F.lit("block")), "__block")
    blocks = blocks.select("src", "__block", "passes", "rest", "block_tokens", F.row_number().over(order).alias("__rank"), (F.sum("block_tokens").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("block_tokens")).alias("before"))
    blocks = cut(blocks.withColumn("room", F.col("rest") - F.col("before")))  # what the rest has left for this block

    whole = blocks.select("src", "__block", "__rank", F.expr("passes + case when room >= block_tokens then 1 else 0 end").alias("__copies"), F.expr("room > 0 and room < block_tokens").alias("edge"), "room")
    every = _beside(slim, plan.select("src", "n_blocks"), "__src").withColumn("__block", F.expr(f"pmod(xxhash64(__id, {seed}), n_blocks)")).drop("n_blocks").join(whole, ["src", "__block"])
    ids = every.groupBy("__src", "__id", "__block", "__rank", "__copies", "edge", "room").agg(F.sum("n").alias("n"))
    by_hash = Window.partitionBy("__src", "__block").orderBy(F.xxhash64("__id", F.lit(seed), F.lit("row")), "__id")
    edge = ids.where("edge").withColumn("upto", F.sum("n").over(by_hash.rowsBetween(Window.unboundedPreceding, 0)))
    edge = edge.withColumn("__copies", F.expr("__copies + case when upto <= room then 1 else 0 end"))
    keep = ["__src", "__id", "__block", "__rank", "__copies"]
    return ids.where("not edge").select(*keep).unionByName(edge.select(*keep)).where("__copies > 0")


def mix(docs: DataFrame, budget: int | None = None, max_repeats: float = MAX_REPEATS, entropy_part: float | None = ENTROPY_PART, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """docs, same columns, each row as often as it is drawn."""
    p = free_prefix(docs)
    drawn = draw(docs, budget, max_repeats, entropy_part, seed, id_col, text_col, source_col)
    drawn = drawn.select(F.col("__src").alias(f"{p}src"), F.col("__id").alias(f"{p}id"), F.col("__copies").alias(f"{p}copies"))
    own = F.coalesce(docs[source_col].cast("string"), F.lit(""))
    out = docs.join(drawn, (own == drawn[f"{p}src"]) & docs[id_col].eqNullSafe(drawn[f"{p}id"]))
    return out.withColumn(f"{p}pass", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col(f"{p}copies")))).select(*[docs[c] for c in docs.columns])


def op6_mixing(spark, sf_dir: str) -> DataFrame:
    """draw() over the whole table documents, a row for each document drawn: doc_id, source, copies, block, block_rank."""
    out = draw(table(spark, sf_dir, "documents"))
    return out.select(F.col("__id").alias("doc_id"), F.col("__src").alias("source"), F.col("__copies").alias("copies"), F.col("__block").alias("block"), F.col("__rank").alias("block_rank"))


def mixing_weights(spark, sf_dir: str) -> DataFrame:
    """The weights that op6_mixing realises, which SQL can express: source, docs, tokens, exponent, weight, passes. Which documents a rest takes depends on a hash."""
    docs = table(spark, sf_dir, "documents")
    words = F.expr("cast(size(array_remove(split(coalesce(text, ''), '[\\\\x20\\\\x09-\\\\x0D]+'), '')) as bigint)")
    sizes = stored(docs.groupBy(F.coalesce(docs.source.cast("string"), F.lit("")).alias("src")).agg(F.count("*").alias("docs"), F.sum(words).alias("tokens")))
    out = source_weights(sizes)
    return out.select(F.col("src").alias("source"), "docs", "tokens", F.round("exponent", 6).alias("exponent"), F.round("weight", 6).alias("weight"), "passes")


WEIGHTS_SQL = rf"""
WITH RECURSIVE t AS (
  SELECT coalesce(source, '') AS source, count(*) AS docs, CAST(sum(len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> ''))) AS BIGINT) AS tokens FROM documents GROUP BY 1
), s AS (SELECT *, tokens / sum(tokens) OVER () AS share, sum(tokens) OVER () AS total FROM t WHERE tokens > 0),
l AS (SELECT list(share) AS shares FROM s),
b AS (SELECT 0 AS step, -1.0::DOUBLE AS low, 1.0::DOUBLE AS high UNION ALL
  SELECT step + 1, CASE WHEN fits THEN low ELSE mid END, CASE WHEN fits THEN mid ELSE high END FROM (
    SELECT *, z < 0 OR ((list_max(list_transform(w, lambda x: pow(x, mid - 1) / z)) <= {MAX_REPEATS} + 1e-9) AND -list_sum(list_transform(w, lambda x: pow(x, mid) / z * ln(pow(x, mid) / z))) <= {ENTROPY_PART} * ln(len(w)) + 1e-12) AS fits FROM (
      SELECT step, low, high, greatest((low + high) / 2, 0) AS mid, list_sum(list_transform(shares, lambda x: pow(x, greatest((low + high) / 2, 0)))) AS z, shares AS w FROM b, l WHERE step < 60))),
e AS (SELECT high AS t FROM b WHERE step = 60), z AS (SELECT sum(pow(share, t)) AS z FROM s, e)
SELECT source, docs, tokens, round(t, 6) AS exponent, round(pow(share, t) / z, 6) AS weight, CAST(floor(pow(share, t) / z * total + 1e-6) AS BIGINT) // tokens AS passes FROM s, e, z
"""
