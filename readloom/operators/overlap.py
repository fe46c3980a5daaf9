"""Exact suffix-prefix overlaps: which reads continue which, by what offset.

The loop over overlap lengths is one grouping: reads meet on the least k-mer of what they share (seeds.py), and the full overlap is then compared on packed sequences. Reads are shuffled once, with some rows each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from readloom.checkpoints import cut
from readloom.config import Params
from readloom.functions.sequences import right_offset
from readloom.operators import seeds


def candidates(reads: DataFrame, p: Params, sources: DataFrame | Callable[[Column], Column] | None = None, targets: DataFrame | Callable[[Column], Column] | None = None, paired: bool = False, lengths: bool = False) -> DataFrame:
    """src, dst, off, ov (with lengths also n, the target's length): all overlaps of p.min_overlap to p.max_overlap bases. sources, targets: ids that may be either, as a table or as a condition on an id; all by default. paired: each read's complement is there, too, as id xor 1."""
    paired = paired and not any(isinstance(x, DataFrame) for x in (sources, targets))  # a table would be asked for both strands
    slim = reads.select("id", "seq").where("id % 2 <> 0") if paired else reads.select("id", "seq")
    for name, ids in (("s", sources), ("t", targets)):
        if isinstance(ids, DataFrame):
            slim = slim.join(ids.select("id", F.lit(True).alias(name)).distinct(), "id", "left").withColumns({name: F.coalesce(name, F.lit(False)), f"{name}2": F.lit(False)})
        else:
            holds = [F.lit(True) if ids is None else F.coalesce(ids(x), F.lit(False)) for x in (F.col("id"), F.col("id").bitwiseXOR(F.lit(1)))]
            slim = slim.withColumns({name: holds[0], f"{name}2": holds[1] if paired else F.lit(False)})
    return seeds.overlaps(slim, p.min_overlap, p.max_overlap, paired).select("src", "dst", "off", "ov", *["n"] * lengths)


def top_small(cand: DataFrame, p: Params) -> DataFrame:
    """Of the overlaps under p.transitive_from, each source's few longest; of equally long ones those to smaller ids."""
    order = Window.partitionBy("src").orderBy(F.desc("ov"), "dst")
    return cand.where(F.col("ov") < p.transitive_from).withColumn("r", F.row_number().over(order)).where(F.col("r") <= p.small_overlaps_kept).drop("r")


def smallest_offset(edges: DataFrame) -> DataFrame:
    """A row for each src and dst."""
    return edges.groupBy("src", "dst").agg(F.min("off").cast("int").alias("off"))


def drop_transitive(edges: DataFrame, big: DataFrame, reads: DataFrame) -> DataFrame:
    """Without those edges A -> C for which a large overlap B -> C shows that A -> B -> C spells the same. B needn't follow A by an edge."""
    seqs = reads.select(F.col("id").alias("src"), "seq")
    a = edges.join(seqs, "src").alias("a")
    b = big.where("off > 0").join(seqs, "src").alias("b")
    via = (F.col("a.dst") == F.col("b.dst")) & F.expr("a.src <> b.src and a.off >= b.off and length(b.seq) + a.off - b.off - length(a.seq) >= 0 and substring(a.seq, a.off - b.off + 1, b.off) = substring(b.seq, 1, b.off)")
    return a.join(b, via, "left_anti").select("src", "dst", "off")


def overlap_edges(reads: DataFrame, p: Params, paired: bool = False) -> DataFrame:
    """src, dst, off: the overlap graph, as of candidates, top_small, smallest_offset and drop_transitive; decided from each read's own overlaps, which are shuffled once. Written, as graphs are read many times. paired: as of candidates."""
    slim = reads.select("id", "seq").where("id % 2 <> 0") if paired else reads.select("id", "seq")
    yes, back = F.lit(True), F.lit(paired)
    found = seeds.overlaps(slim.withColumns({"s": yes, "t": yes, "s2": back, "t2": back}), p.min_overlap, 1 << 25, paired, rest=True)
    return cut(seeds.edges_of(found, p.min_overlap, p.max_overlap, p.transitive_from, p.small_overlaps_kept))


def wrong_edges(edges: DataFrame, reads: DataFrame) -> DataFrame:
    """Edges whose overlap does not match: none, for exact overlaps."""
    a, b = reads.select(F.col("id").alias("src"), F.col("seq").alias("a")), reads.select(F.col("id").alias("dst"), F.col("seq").alias("b"))
    return edges.join(a, "src").join(b, "dst").where("not (startswith(b, substring(a, off + 1)) or startswith(substring(a, off + 1), b))").select("src", "dst", "off")


def mirrored(edges: DataFrame, reads: DataFrame) -> DataFrame:
    """What the complements' edges are: from dst's to src's, by the right offset."""
    n = lambda c: reads.select(F.col("id").alias(c), F.length("seq").alias(f"n_{c}"))
    return edges.join(n("src"), "src").join(n("dst"), "dst").select(F.col("dst").bitwiseXOR(F.lit(1)).alias("src"), F.col("src").bitwiseXOR(F.lit(1)).alias("dst"), right_offset(F.col("n_src"), F.col("n_dst"), F.col("off")).alias("off"))
