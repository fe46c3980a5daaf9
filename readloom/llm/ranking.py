"""Ranked lexical search: the k best documents of each item by integer impacts, found with WAND in shards of documents.

One pass over the documents counts all their terms and keeps, of each document, those that a filter of the items' terms lets pass (bounded in size; an equi-join on the terms themselves decides afterwards). The counts
give the statistics N, L and df, and with them each term's weight. Postings are then dealt into shards of documents and meet the items in blocks of bounded size: no side is broadcast or collected.

In a shard, an item's terms have a maximum impact each. Documents are taken in ascending order, a window of them at a time. The terms of least maxima whose sum can't beat the heap's threshold select no pivots: a document that
holds only such terms is skipped without being read. Of the other terms' documents those are pivots whose maxima, with those of the terms not read yet, beat the threshold; the remaining terms are looked up for pivots
only, each tightening their bounds, and what is left is scored and enters the heap. Windows double from a small one, so that the threshold rises early. The shards' heaps are merged by a window with a group limit.

Defined results: null texts and texts without a term have none, count in no statistic and are never returned; rows of one doc_id are documents of their own, so it may be returned for each of them; rows without doc_id are
documents too, and come last among equal scores; items that are null, empty or hold no term that a document has return nothing, rows of one item_id (also of a null one) are one item whose terms add up; an empty table
gives an empty result; texts of any length are read whole; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from readloom.llm.common import filter_bits, filter_of, stored, table

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SHARD, ITEMS, SALTS = 16384, 256, 16  #: documents of a shard, items of a block, parts that a frequent term's documents are dealt into
FIRST, WIDEST = 64, 4096  #: documents of a shard's first and largest windows
_TERM = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
_LOWER = bytes.maketrans(UPPER.encode(), LOWER.encode())
COUNTED = "doc_id bigint, n bigint, terms array<string>, times array<int>"


def item_terms(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """item_id, term, times."""
    low = F.translate(items[text_col].cast("string"), UPPER, LOWER)
    rows = items.select(items[id_col].cast("bigint").alias("item_id"), F.explode(F.regexp_extract_all(low, F.lit(TERM), F.lit(0))).alias("term"))
    return rows.groupBy("item_id", "term").agg(F.count("*").alias("times"))


def counted_documents(docs: DataFrame, terms: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n, terms, times: of each document with a term the number of all its terms, and the distinct ones that may be among terms (a column term), with their occurrences. Stored."""
    bits = filter_bits(terms.count())
    passing = filter_of(terms, F.crc32(F.encode("term", "utf-8")) % bits).ljust(bits // 8, b"\0")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, sizes, ends, words, times = [], [], [0], [], []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found = Counter(_TERM.findall((text.as_buffer().to_pybytes() if text.is_valid else b"").translate(_LOWER)))
                if not found:
                    continue
                for word, k in found.items():
                    at = zlib.crc32(word) % bits
                    if passing[at >> 3] >> (at & 7) & 1:
                        words.append(word)
                        times.append(k)
                ids.append(i)
                sizes.append(found.total())
                ends.append(len(words))
            ends_ = pa.array(ends, pa.int32())
            lists = [pa.ListArray.from_arrays(ends_, pa.array(words, pa.binary()).cast(pa.string())), pa.ListArray.from_arrays(ends_, pa.array(times, pa.int32()))]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), *lists], names=["doc_id", "n", "terms", "times"])

    slim = docs.select(docs[id_col].cast("bigint").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    return stored(slim.mapInArrow(count, COUNTED))


def best_of_shard(docs: np.ndarray, terms: np.ndarray, gains: np.ndarray, wanted: np.ndarray, weights: np.ndarray, k: int, skipped: list | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The k best documents of one item and their scores, by WAND. docs, terms, gains: postings sorted by term, then document (numbers from 0); wanted, weights: the item's distinct terms and what each multiplies gains by.

    skipped: gets the number of documents that hold one of the terms, and of those that were scored."""
    starts, ends = np.searchsorted(terms, wanted, "left"), np.searchsorted(terms, wanted, "right")
    held = (ends > starts) & (weights > 0)
    lists = [(docs[a:b], gains[a:b] * w) for a, b, w in zip(starts[held], ends[held], weights[held], strict=True)]
    most = np.array([g.max() for _, g in lists], np.int64)
    order = np.argsort(most, kind="stable")
    lists, most = [lists[i] for i in order], most[order]
    sums = np.concatenate([[0], np.cumsum(most)])  # sums[i]: of the i least maxima
    best_docs, best = np.zeros(0, np.int64), np.zeros(0, np.int64)
    threshold, begin, width, scored = 0, 0, FIRST, 0
    end = 1 + max((int(d[-1]) for d, _ in lists), default=-1)
    while begin < end and sums[-1] > threshold:
        stop = min(begin + width, end)
        few = int(np.searchsorted(sums, threshold, "right")) - 1  # so many terms can't beat the threshold together
        bound, score = np.zeros(stop - begin, np.int64), np.zeros(stop - begin, np.int64)
        for (d, g), top in zip(lists[few:], most[few:], strict=True):
            a, b = np.searchsorted(d, (begin, stop))
            at = d[a:b] - begin
            bound[at] += top
            score[at] += g[a:b]
        pivots = np.flatnonzero((bound > 0) & (bound + sums[few] > threshold))
        exact = score[pivots]
        for i in range(few - 1, -1, -1):
            keep = exact + sums[i + 1] > threshold
            pivots, exact = pivots[keep], exact[keep]
            if not len(pivots):
                break
            d, g = lists[i]
            at = np.searchsorted(d, pivots + begin)
            here = at < len(d)
            here[here] = d[at[here]] == pivots[here] + begin
            exact[here] += g[at[here]]
        scored += len(pivots)
        keep = exact > threshold  # an equal score of a later document doesn't displace an earlier one
        all_docs, all_scores = np.concatenate([best_docs, pivots[keep] + begin]), np.concatenate([best, exact[keep]])
        first = np.lexsort((all_docs, -all_scores))[:k]
        best_docs, best = all_docs[first], all_scores[first]
        threshold = int(best[-1]) if len(best) == k else 0
        begin, width = stop, min(2 * width, WIDEST)
    if skipped is not None:
        skipped.append((len(np.unique(np.concatenate([d for d, _ in lists]))) if lists else 0, scored))
    return best_docs, best


def search(docs: DataFrame, items: DataFrame, k: int = 10, b: int = 75, shard_docs: int = SHARD, block_items: int = ITEMS) -> DataFrame:
    """item_id, rank (from 1), doc_id, score. docs: doc_id, text; items: item_id, text; b: percent by which a document's length counts."""
    asked = stored(item_terms(items))
    blocks = max(1, math.ceil(asked.select("item_id").distinct().count() / block_items))
    asked = asked.withColumn("block", F.pmod(F.xxhash64("item_id"), F.lit(blocks)).cast("int"))
    names = stored(asked.select("term").distinct().withColumn("term_id", F.monotonically_increasing_id()))
    asked = asked.join(names, "term")

    counted = counted_documents(docs, names)
    n_docs, n_terms = counted.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    shards = max(1, math.ceil(n_docs / shard_docs))
    # A place of its own for each stored row, so that rows of one doc_id are dealt out too; files don't change, so nor do places.
    row = F.monotonically_increasing_id()
    m = F.expr(f"{100 - b} + ({b} * n * {n_docs}L) div {max(1, n_terms)}L")
    rows = counted.select("doc_id", row.alias("row"), m.alias("m"), F.arrays_zip("terms", "times").alias("t"))
    rows = rows.withColumn("salt", F.pmod("row", F.lit(SALTS)).cast("int")).select("doc_id", "row", "salt", "m", F.explode("t").alias("t")).select("doc_id", "row", "salt", "m", F.col("t.terms").alias("term"), F.col("t.times").alias("tf"))
    salted = lambda t: t.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    df = rows.groupBy("term").agg(F.count("*").alias("df")).join(names, "term")
    weights = df.select("term_id", F.expr(f"cast(floor(1000 * ln((2D * {n_docs} + 2) / (2 * df + 1))) as bigint)").alias("w"))
    in_block = salted(asked.select("block", "term", "term_id").distinct())
    gain = F.expr("(1000000000L * tf) div (1000L * tf + 8L * m)")
    postings = rows.join(in_block, ["term", "salt"]).select(F.pmod("row", F.lit(shards)).cast("int").alias("shard"), F.col("block").alias("block"), "doc_id", "row", F.col("term_id").alias("term_id"), gain.alias("gain"))
    weighted = asked.join(weights, "term_id").select("block", "item_id", "term_id", (F.col("times") * F.col("w")).alias("weight"), F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"))

    def best(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = {"item_id": [], "doc_id": [], "row": [], "score": []}
        if len(left) and len(right):
            places = left[["doc_id", "row"]].drop_duplicates().sort_values(["doc_id", "row"], na_position="last").reset_index(drop=True)
            number = pd.Series(np.arange(len(places)), index=places["row"])
            docs_, terms = number.loc[left["row"]].to_numpy(np.int64), left["term_id"].to_numpy(np.int64)
            order = np.lexsort((docs_, terms))
            docs_, terms, gains = docs_[order], terms[order], left["gain"].to_numpy(np.int64)[order]
            for item, asked_ in right.groupby("item_id", dropna=False):
                found, score = best_of_shard(docs_, terms, gains, asked_["term_id"].to_numpy(np.int64), asked_["weight"].to_numpy(np.int64), k)
                out["item_id"] += [None if pd.isna(item) else int(item)] * len(found)
                out["doc_id"] += [None if pd.isna(x) else int(x) for x in places["doc_id"].iloc[found]]
                out["row"] += places["row"].iloc[found].tolist()
                out["score"] += score.tolist()
        return pd.DataFrame({c: pd.array(v, "Int64") for c, v in out.items()})

    found = postings.groupBy("shard", "block").cogroup(weighted.groupBy("shard", "block")).applyInPandas(best, "item_id bigint, doc_id bigint, row bigint, score bigint")
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"), "row")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def op11_ranked_search(spark, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP11_SQL = rf"""
WITH words AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{TERM}')) AS term FROM documents
), tf AS (SELECT doc_id, term, count(*) AS tf FROM words GROUP BY 1, 2),
d AS (SELECT doc_id, CAST(sum(tf) AS BIGINT) AS n FROM tf GROUP BY 1),
s AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS total FROM d),
w AS (SELECT term, CAST(floor(1000 * ln((2.0::DOUBLE * any_value(docs) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, s GROUP BY 1),
q AS (SELECT item_id, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{TERM}')) AS term FROM benchmark),
r AS (
  SELECT q.item_id, tf.doc_id, CAST(sum(w.w * ((1000000000 * tf.tf) // (1000 * tf.tf + 8 * (25 + (75 * d.n * s.docs) // s.total)))) AS BIGINT) AS score
  FROM q JOIN tf ON tf.term = q.term JOIN w ON w.term = q.term JOIN d ON d.doc_id = tf.doc_id, s GROUP BY 1, 2
), o AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM r WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM o WHERE rank <= 10
"""
