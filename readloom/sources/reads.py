"""Files of reads, and saved graphs, as DataFrames.

Records of FASTA and FASTQ span lines, so lines get numbers first: a line's number in its file, from counts per file split, without gathering a file in one task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from readloom.checkpoints import exists
from readloom.functions.packed import ragged


BLOCK = 4096  #: records that move together


def format_of(path: str) -> str:
    """By what follows the last dot: fasta, pfasta (mates interleaved), fastq or fq; anything else is tokens."""
    end = path.rsplit(".", 1)[-1] if "." in path else ""
    return {"fasta": "fasta", "pfasta": "pfasta", "fastq": "fastq", "fq": "fastq"}.get(end, "tokens")


def format_column(path: str) -> Column:
    """As format_of, of a column of paths."""
    known = F.regexp_extract(path, r"\.(p?fasta|fastq|fq)$", 1)
    return F.when(known == "", "tokens").when(known == "fq", "fastq").otherwise(known)


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """no (from 0; of a folder's files in order of their names) and value. Spark's row numbers within a part of a file, moved by the sizes of the parts before: one count for each part is windowed, never the lines."""
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))
    lines = spark.read.text(path).select("value", place.alias("part"), F.monotonically_increasing_id().alias("mid"))
    sizes = lines.groupBy("part").agg(F.count("*").alias("n"), F.min("mid").alias("low"))
    before = sizes.withColumn("before", F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))).select("part", "low", F.coalesce("before", F.lit(0)).alias("before"))
    return lines.join(F.broadcast(before), "part").select((F.col("mid") - F.col("low") + F.col("before")).alias("no"), "value")


def _records(lines: DataFrame, size: int, at: int) -> DataFrame:
    return lines.where(F.col("no") % size == at).select(F.expr(f"no div {size}").alias("rn"), F.trim("value").alias("raw"))


def read_sequences(spark: SparkSession, path: str, fmt: str | None = None) -> DataFrame:
    """rn (record number), raw (the sequence as it stands). fmt: as format_of; two lines a record for FASTA, four for FASTQ, whose qualities are not read. pfasta also gets mate (0, 1) and numbers pairs."""
    fmt = fmt or format_of(path)
    if fmt == "fasta":
        return _records(numbered_lines(spark, path), 2, 1)
    if fmt == "fastq":
        return _records(numbered_lines(spark, path), 4, 1)
    if fmt == "pfasta":
        return _records(numbered_lines(spark, path), 2, 1).select(F.expr("rn div 2").alias("rn"), (F.col("rn") % 2).cast("int").alias("mate"), "raw")
    tokens = numbered_lines(spark, path).select("no", F.posexplode(F.expr("filter(split(value, '\\\\s+'), x -> x <> '')")).alias("i", "raw"))
    per_line = tokens.groupBy("no").agg(F.count("*").alias("n"))
    part = F.expr("no div 65536")
    blocks = per_line.groupBy(part.alias("b")).agg(F.sum("n").alias("n"))
    blocks = blocks.select("b", F.coalesce(F.sum("n").over(Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("blocks_before"))
    starts = per_line.withColumn("b", part).select("b", "no", F.coalesce(F.sum("n").over(Window.partitionBy("b").orderBy("no").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("lines_before"))
    starts = starts.join(blocks, "b").select("no", (F.col("blocks_before") + F.col("lines_before")).alias("start"))
    return tokens.join(starts, "no").select((F.col("start") + F.col("i")).alias("rn"), "raw")


def pair_files(first: DataFrame, second: DataFrame) -> DataFrame:
    """rn, mate1, mate2: the records of two files by number; what has no counterpart stays, with a null. Records move in blocks of neighbours, which are often alike."""
    none = F.lit(None).cast("string")
    rows = first.select("rn", F.col("raw").alias("mate1"), none.alias("mate2")).unionByName(second.select("rn", none.alias("mate1"), F.col("raw").alias("mate2")))
    block = F.expr(f"rn div {BLOCK}")
    return rows.repartition(block).groupBy(block.alias("block"), "rn").agg(F.max("mate1").alias("mate1"), F.max("mate2").alias("mate2")).drop("block")


def read_graph(spark: SparkSession, path: str) -> DataFrame:
    """src, dst, off of a graph saved as Parquet (save_graph), or in the binary layout: u32 nodes, then for each i32 id, i32 degree and degree times i32 target, i32 offset. path: a folder of save_graph_binary, of which a task reads
    one file at a time, or a single file."""
    if not path.endswith(".bin"):
        return spark.read.parquet(path)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in batch.column(0):
                ints = np.frombuffer(raw.as_buffer(), "<i4")
                starts = np.empty(int(ints[0]), np.int64)
                at = 1
                for k in range(len(starts)):  # a record's size stands in it; its edges are read all at once
                    starts[k] = at
                    at += 2 + 2 * int(ints[at + 1])
                degree = ints[starts + 1].astype(np.int64)
                places = np.repeat(starts + 2, degree) + 2 * ragged(degree)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ints[starts], degree).astype(np.int64)), pa.array(ints[places].astype(np.int64)), pa.array(ints[places + 1])], names=["src", "dst", "off"])

    if not exists(spark, f"{path}/index"):
        files = [path]
    else:
        files = [f"{path}/{r.file}" for r in spark.read.parquet(f"{path}/index").select("file").collect()]  # names only
    if not files:
        return spark.createDataFrame([], "src bigint, dst bigint, off int")
    return spark.read.format("binaryFile").load(files).select("content").mapInArrow(parse, "src bigint, dst bigint, off int")
