"""Chains as single rows: what lies between two nodes that aren't inner (one in- and one out-edge). Graphs of overlaps are mostly chains, so iterations over rows of chains need fewer rounds and rows than over edges.

A chain: src, dst, off, via (the node behind src), tail (the one before dst), last (the last edge's offset), last_n (its number of path steps), parts (its number of edges), path (array of node, off). (src, via) tells chains apart, and
so does (dst, tail). Edges between nodes that aren't inner, and those on cycles of inner nodes only, are chains of one edge."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from readloom.checkpoints import cut, forget
from readloom.operators.graph import degrees

COLUMNS = ("src", "dst", "off", "via", "tail", "last", "last_n", "parts", "path")
JUMPS = 3  #: pointers that a round follows: its reach is four times the one before


def plain_chains(edges: DataFrame) -> DataFrame:
    """Each edge as a chain of its own. Edges may have a path; chains stay what they are."""
    if "tail" in edges.columns:
        return edges.select(*COLUMNS)
    path = F.col("path") if "path" in edges.columns else F.array(F.struct(F.col("dst").alias("node"), F.col("off").cast("int").alias("off")))
    rows = edges.select("src", "dst", F.col("off").cast("bigint").alias("off"), path.alias("path"))
    return rows.select("src", "dst", "off", F.col("dst").alias("via"), F.col("src").alias("tail"), F.col("off").alias("last"), F.size("path").alias("last_n"), F.lit(1).alias("parts"), "path")


def last_of_chain(step: DataFrame) -> DataFrame:
    """src, to, steps: for each inner node the last inner one of its chain and the edges up to it. step: src, dst, on (whether dst is inner) of inner nodes' out-edges. Nodes on cycles of inner nodes have none."""
    at = cut(step.select("src", F.when(F.col("on"), F.col("dst")).otherwise(F.col("src")).alias("to"), F.col("on").cast("bigint").alias("steps"), (~F.col("on")).alias("done")))
    n, reach = at.count(), 1
    while reach <= n and not at.where("not done").isEmpty():
        on = at.select(F.col("src").alias("to"), F.col("to").alias("t2"), F.col("steps").alias("s2"), F.col("done").alias("d2"))
        far = at.where("not done")
        for _ in range(JUMPS):  # those that are done are followed by nothing: their last node points to itself
            far = far.join(on, "to").select("src", F.col("t2").alias("to"), (F.col("steps") + F.col("s2")).alias("steps"), F.col("d2").alias("done"))
        before, at = at, cut(at.where("done").unionByName(far))
        forget(before)
        reach *= JUMPS + 1
    return at.where("done").drop("done")


def compress(edges: DataFrame) -> DataFrame:
    """The chains of a graph, or of one whose edges are chains already. Inner nodes find the last one of their chain by following pointers of pointers; each chain is put together once. Written."""
    rows = cut(plain_chains(edges))
    inner = cut(degrees(rows).where("out_degree = 1 and in_degree = 1").select("id"))
    into = inner.select(F.col("id").alias("dst"), F.lit(True).alias("on"))
    step = rows.join(inner.select(F.col("id").alias("src")), "src", "left_semi").join(into, "dst", "left").withColumn("on", F.coalesce("on", F.lit(False)))
    step = cut(step)
    of = last_of_chain(step.select("src", "dst", "on"))
    members = step.join(of, "src").groupBy("to").agg(F.sort_array(F.collect_list(F.struct((-F.col("steps")).alias("o"), *[c for c in COLUMNS]))).alias("m"))
    rest = members.select(
        F.expr("m[0].src").alias("first"), F.expr("element_at(m, -1)").alias("z"), F.expr("aggregate(m, 0L, (a, x) -> a + x.off)").alias("rest"),
        F.expr("aggregate(m, 0, (a, x) -> a + x.parts)").alias("more"), F.expr("flatten(transform(m, x -> x.path))").alias("ways"),
    )
    begin = rows.join(inner.select(F.col("id").alias("src")), "src", "left_anti")
    joined = begin.alias("b").join(rest, F.col("b.dst") == F.col("first"), "left")
    long = F.col("first").isNotNull()
    pick = lambda whole, own: F.when(long, whole).otherwise(own)
    chains = joined.select(
        "src", pick(F.col("z.dst"), F.col("b.dst")).alias("dst"), (F.col("b.off") + F.coalesce("rest", F.lit(0))).alias("off"), "via", pick(F.col("z.tail"), F.col("b.tail")).alias("tail"), pick(F.col("z.last"), F.col("b.last")).alias("last"),
        pick(F.col("z.last_n"), F.col("b.last_n")).alias("last_n"), (F.col("b.parts") + F.coalesce("more", F.lit(0))).alias("parts"), pick(F.concat("b.path", "ways"), F.col("b.path")).alias("path"),
    )
    cycles = step.join(of.select("src"), "src", "left_anti").select(*COLUMNS)
    out = cut(chains.unionByName(cycles))
    forget(rows, inner, step)
    return out


def expand(chains: DataFrame) -> DataFrame:
    """src, dst, off: the chains' edges."""
    steps = F.expr("transform(path, (x, i) -> struct(case when i = 0 then src else path[i - 1].node end as src, x.node as dst, x.off as off))")
    return chains.select(F.explode(steps).alias("e")).select("e.src", "e.dst", F.col("e.off").cast("int").alias("off"))


def turned(chains: DataFrame) -> DataFrame:
    """src, dst, off, via of the reversed graph's chains; via is what was the tail."""
    return chains.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "off", F.col("tail").alias("via"))


def longest_ways(edges: DataFrame) -> DataFrame:
    """id, length, next: of each node the greatest sum of offsets on a way to a node without out-edges, and the next node on it (of equal ways that with the smallest); null next for those that have none. Nodes from which a way runs
    into a cycle are left out.

    Chains are taken level by level from the ends, with one table a level: a node is decided once all its chains lead to decided ones, so each chain is used once. Nodes inside of chains get theirs from the chain's end."""
    chains = compress(edges)
    rows = chains.select("src", "dst", "off", "via")
    out = rows.groupBy("src").agg(F.count("*").alias("n"))
    fresh = cut(rows.select(F.col("dst").alias("id")).distinct().join(out, F.col("id") == F.col("src"), "left_anti").select("id", F.lit(0).cast("bigint").alias("length"), F.lit(None).cast("bigint").alias("next")))
    decided, part = [fresh], None
    while not fresh.isEmpty():
        ways = rows.join(fresh.select(F.col("id").alias("dst"), "length"), "dst").select("src", F.struct((F.col("off") + F.col("length")).alias("length"), (-F.col("via")).alias("o")).alias("best"), F.lit(1).alias("c"))
        ways = ways if part is None else part.unionByName(ways)
        known = cut(ways.groupBy("src").agg(F.max("best").alias("best"), F.sum("c").alias("c")).join(out, "src"))
        fresh = known.where("c = n").select(F.col("src").alias("id"), F.col("best.length").alias("length"), (-F.col("best.o")).alias("next"))
        part = known.where("c < n").select("src", "best", "c")
        decided.append(fresh)
    ends = reduce(DataFrame.unionByName, decided)
    inside = chains.where("size(path) > 1").join(ends.select(F.col("id").alias("dst"), "length"), "dst")
    inside = inside.select("src", "via", (F.col("length") + F.col("off")).alias("whole"), F.col("path.node").alias("nodes"), F.posexplode("path").alias("i", "x"))
    before = Window.partitionBy("src", "via").orderBy("i")
    inside = inside.select(F.col("x.node").alias("id"), (F.col("whole") - F.sum("x.off").over(before)).alias("length"), F.expr("get(nodes, i + 1)").alias("next")).where("next is not null")
    return ends.unionByName(inside)
