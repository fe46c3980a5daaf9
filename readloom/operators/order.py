"""Reads in lexicographic order, and what neighbours in it share."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from readloom.checkpoints import cut
from readloom.functions.sequences import SORT_ORDER, common_prefix


def in_order(reads: DataFrame) -> DataFrame:
    """reads with place: key (bases as letters in their sort order), length, id; dealt to partitions by ranges of place and written, with part: the range's number."""
    place = F.struct(F.translate("seq", SORT_ORDER, "ABCD").alias("key"), F.length("seq").alias("n"), F.col("id").alias("at"))
    return cut(reads.withColumn("place", place).repartitionByRange("place").withColumn("part", F.spark_partition_id()))


def neighbour_lcp(reads: DataFrame) -> DataFrame:
    """id, lcp: the longest common prefix of each read and the next one in order; 0 for the last. Only ranges are windowed; of each range's first read one row goes to the range before."""
    rows = in_order(reads)
    nexts = rows.withColumn("nxt", F.lead("seq").over(Window.partitionBy("part").orderBy("place")))
    firsts = rows.groupBy("part").agg(F.min_by("seq", "place").alias("seq"))
    after = firsts.select("part", F.lead("seq").over(Window.orderBy("part")).alias("first_after"))
    full = nexts.join(after, "part").withColumn("nxt", F.coalesce("nxt", "first_after"))
    return full.select("id", F.when(F.col("nxt").isNull(), 0).otherwise(common_prefix("seq", "nxt")).cast("bigint").alias("lcp"))
