"""Counts and statistics of reads and contigs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readloom.functions import packed

LETTERS = "ACGNTU"
TOGETHER = 1 << 21  #: places whose k-mers a task counts at a time


def length_statistics(seqs: DataFrame) -> DataFrame:
    """One row: n, total, average, least, most."""
    n = F.length("seq")
    return seqs.agg(F.count("*").alias("n"), F.sum(n).alias("total"), F.avg(n).alias("average"), F.min(n).alias("least"), F.max(n).alias("most"))


def full_statistics(seqs: DataFrame) -> DataFrame:
    """Adds sum of squares, population deviation and the upper median, which comes from counts of each length: no list of all values."""
    counts = seqs.groupBy(F.length("seq").cast("bigint").alias("value")).agg(F.count("*").alias("count"))
    return weighted_statistics(counts)


def weighted_statistics(counts: DataFrame) -> DataFrame:
    """counts: value, count. One row of n, total, average, least, most, median (upper), stddev (population), squares."""
    from pyspark.sql import Window

    order = Window.orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    every = Window.partitionBy()
    ranked = counts.withColumns({"upto": F.sum("count").over(order), "all": F.sum("count").over(every)})
    v, c = F.col("value"), F.col("count")
    out = ranked.agg(F.sum(c).alias("n"), F.sum(v * c).alias("total"), (F.sum(v * c) / F.sum(c)).alias("average"), F.min(v).alias("least"), F.max(v).alias("most"), F.min(F.when(F.col("upto") > F.expr("all div 2"), v)).alias("median"), F.sum(v * v * c).alias("squares"))
    return out.withColumn("stddev", F.sqrt(F.greatest(F.col("squares") / F.col("n") - F.col("average") * F.col("average"), F.lit(0.0))))


def moments(samples: DataFrame) -> DataFrame:
    """samples: name, value. For each name count, total, squares, least, most, average, stddev."""
    v = F.col("value")
    out = samples.groupBy("name").agg(F.count(v).alias("n"), F.sum(v).alias("total"), F.sum(v * v).alias("squares"), F.min(v).alias("least"), F.max(v).alias("most"), F.avg(v).alias("average"))
    return out.withColumn("stddev", F.sqrt(F.greatest(F.col("squares") / F.col("n") - F.col("average") * F.col("average"), F.lit(0.0))))


def named(rows: DataFrame) -> DataFrame:
    """name, value (strings) of one row's columns, or of rows of name, value, at (a number that tells later from earlier): the last of each name."""
    if {"name", "value", "at"} <= set(rows.columns):
        return rows.groupBy("name").agg(F.max_by(F.col("value").cast("string"), "at").alias("value"))
    return rows.select(F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("string").alias("value")) for c in rows.columns])).alias("x")).select("x.*")


def value_counts(values: DataFrame, column: str) -> DataFrame:
    return values.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("count"))


def trimmed(values: DataFrame, column: str, left: int, right: int) -> DataFrame:
    """Without the left smallest and right largest values: by counts, so that only ranks of different values are windowed."""
    from pyspark.sql import Window

    c = value_counts(values, column)
    order = Window.orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    c = c.withColumns({"upto": F.sum("count").over(order), "all": F.sum("count").over(Window.partitionBy())})
    left_over = F.least(F.col("upto"), F.col("all") - right) - F.greatest(F.col("upto") - F.col("count"), F.lit(left))
    return c.select("value", left_over.alias("count")).where("count > 0")


def kmer_counts(seqs: DataFrame, k: int) -> DataFrame:
    """kmer (a number, three bits a base), times: how often each k-mer of up to 21 bases occurs. A task counts many reads' k-mers before anything is shuffled; letters other than A, C, G, T, N, U are an error."""
    if not 0 < k <= 21:
        raise ValueError("k-mers of 1 to 21 bases")
    code = np.full(256, 255, np.uint8)
    code[list(LETTERS.encode())] = range(len(LETTERS))

    def counted(parts: list[np.ndarray]) -> pa.RecordBatch:
        kmers, times = np.unique(np.concatenate(parts), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(kmers.view(np.int64)), pa.array(times.astype(np.int64))], names=["kmer", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            flat = batch.column(0).cast(pa.large_binary())
            if not len(flat):
                continue
            ends = np.frombuffer(flat.buffers()[1], np.int64)[flat.offset : flat.offset + len(flat) + 1]
            codes, lengths = code[np.frombuffer(flat.buffers()[2], np.uint8)[ends[0] : ends[-1]]], np.diff(ends)
            if (codes == 255).any():
                raise ValueError("not a sequence")
            counts = np.maximum(lengths - (k - 1), 0)
            held.append(packed.numbers(codes, k, 3)[np.repeat(ends[:-1] - ends[0], counts) + packed.ragged(counts)])
            size += len(held[-1])
            if size >= TOGETHER:
                yield counted(held)
                held, size = [], 0
        if size:
            yield counted(held)

    return seqs.select("seq").where(F.length("seq") >= k).mapInArrow(run, "kmer bigint, n bigint").groupBy("kmer").agg(F.sum("n").alias("times"))


def unknown_histogram(seqs: DataFrame) -> DataFrame:
    """unknown (number of N), reads, both (strands)."""
    return seqs.groupBy(F.expr("length(seq) - length(replace(seq, 'N', ''))").alias("unknown")).agg(F.count("*").alias("reads"), (2 * F.count("*")).alias("both"))


def filter_counters(seqs: DataFrame, max_period: int) -> DataFrame:
    """One row: reads, with_n, periodic (of those without), kept, inner_n (one N, at least 10 bases from both ends)."""
    from readloom.functions.sequences import has_period

    n = F.contains("seq", F.lit("N"))
    periodic = ~n & has_period("seq", max_period)
    inner = F.expr("length(seq) - length(replace(seq, 'N', '')) = 1 and instr(seq, 'N') > 10 and length(seq) - instr(seq, 'N') >= 10")
    return seqs.agg(F.count("*").alias("reads"), F.count_if(n).alias("with_n"), F.count_if(periodic).alias("periodic"), F.count_if(~n & ~periodic).alias("kept"), F.count_if(inner).alias("inner_n"))
