"""Relations of a weighted directed graph: edges(src, dst, off)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readloom.checkpoints import cut
from readloom.operators.overlap import smallest_offset


def reverse(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "off")


def nodes(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()


def degrees(edges: DataFrame) -> DataFrame:
    """id, out_degree, in_degree, from one pass over the edges."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("src").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("dst").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("e")).select("e.*")
    return ends.groupBy("id").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"))


def drop_isolated(reads: DataFrame, edges: DataFrame) -> DataFrame:
    return reads.join(nodes(edges), "id", "left_semi")


def tips(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Ids that edges could still be added from (they have in-edges only) and to (out-edges only)."""
    d = degrees(edges)
    return d.where("out_degree = 0 and in_degree > 0").select("id"), d.where("in_degree = 0 and out_degree > 0").select("id")


def statistics(edges: DataFrame) -> DataFrame:
    """One row: nodes, edges, max_out, max_in, and how many nodes have out-degree 0 to 5."""
    d = degrees(edges)
    few = [F.count_if(F.col("out_degree") == k).alias(f"out_{k}") for k in range(6)]
    return d.agg(F.count("*").alias("nodes"), F.sum("out_degree").alias("edges"), F.max("out_degree").alias("max_out"), F.max("in_degree").alias("max_in"), *few)


def upsert(edges: DataFrame, more: DataFrame) -> DataFrame:
    """With more edges, no loops, and the smaller offset of equal ones."""
    return smallest_offset(edges.unionByName(more).where("src <> dst"))


def append(edges: DataFrame, more: DataFrame) -> DataFrame:
    """With more edges, parallel ones too."""
    return edges.unionByName(more)


def delete(edges: DataFrame, gone: DataFrame) -> DataFrame:
    """Without all edges between the pairs of gone."""
    return edges.join(gone.select("src", "dst").distinct(), ["src", "dst"], "left_anti")


def clear_nodes(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Without the out-edges of ids."""
    return edges.join(ids.select(F.col("id").alias("src")), "src", "left_anti")


def merge_nodes(edges: DataFrame, into: DataFrame) -> DataFrame:
    """into: id, target, add. Edges of id become edges of target, in-edges longer and out-edges shorter by add; loops go, the smallest offset stays."""
    s, d = into.select(F.col("id").alias("src"), F.col("target").alias("s_to"), F.col("add").alias("s_add")), into.select(F.col("id").alias("dst"), F.col("target").alias("d_to"), F.col("add").alias("d_add"))
    moved = edges.join(s, "src", "left").join(d, "dst", "left")
    moved = moved.select(F.coalesce("s_to", "src").alias("src"), F.coalesce("d_to", "dst").alias("dst"), (F.col("off") + F.coalesce("d_add", F.lit(0)) - F.coalesce("s_add", F.lit(0))).cast("int").alias("off"))
    return smallest_offset(moved.where("src <> dst"))


def merge_zero_cycles(edges: DataFrame, reads: DataFrame) -> DataFrame:
    """Merges nodes that edges of offset 0 or less join both ways into the shortest read of their group (of equal lengths the greatest id)."""
    a, b = edges.alias("a"), edges.alias("b")
    both = a.join(b, (F.col("a.src") == F.col("b.dst")) & (F.col("a.dst") == F.col("b.src"))).where("a.off = 0 and b.off <= 0").select(F.col("a.src").alias("src"), F.col("a.dst").alias("dst"), F.lit(0).alias("off"))
    groups = components(both)
    lengths = reads.select("id", F.length("seq").alias("n"))
    best = groups.join(lengths, "id").groupBy("component").agg(F.min_by("id", F.struct("n", -F.col("id"))).alias("target"))
    return merge_nodes(edges, groups.join(best, "component").where("id <> target").select("id", "target", F.lit(0).alias("add")))


def equal_graphs(a: DataFrame, b: DataFrame) -> bool:
    return contains_graph(a, b) and contains_graph(b, a)


def contains_graph(a: DataFrame, b: DataFrame) -> bool:
    """Whether each edge of b, with its offset, is in a."""
    return b.select("src", "dst", "off").exceptAll(a.select("src", "dst", "off")).isEmpty()


def contains_edge(edges: DataFrame, pairs: DataFrame, at_most: int | None = None, at_least: int | None = None) -> DataFrame:
    """Those pairs (src, dst) that have an edge, of an offset within the bounds."""
    held = edges
    if at_most is not None:
        held = held.where(F.col("off") <= at_most)
    if at_least is not None:
        held = held.where(F.col("off") >= at_least)
    return pairs.join(held, ["src", "dst"], "left_semi")


def weights(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """src, dst, off of pairs; -1 where there is no edge."""
    return pairs.join(edges, ["src", "dst"], "left").select("src", "dst", F.coalesce("off", F.lit(-1)).alias("off"))


def adjacency(edges: DataFrame) -> DataFrame:
    """src and its (off, dst), sorted. A node's edges are in one row: for graphs of bounded degree."""
    return edges.groupBy("src").agg(F.sort_array(F.collect_list(F.struct("off", "dst"))).alias("out"))


def components(edges: DataFrame) -> DataFrame:
    """id, component: the smallest id that a node is connected to, whatever the edges' directions. Alternating stars: rounds grow with the logarithm of a component's size."""
    ends = edges.select("src", "dst")
    own = nodes(edges)
    links = cut(ends.where("src <> dst").select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct())
    seen = None
    while True:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.join(low, "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = large.join(large.groupBy("u").agg(F.min("v").alias("m")), "u")
        links = cut(small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
        now = links.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == seen:
            return own.join(links, own.id == links.u, "left").select("id", F.coalesce("v", "id").alias("component"))
        seen = now
