"""Helpers that all operators of this folder share."""

from __future__ import annotations

import tempfile

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from readloom import checkpoints
from readloom.checkpoints import forget  # noqa: F401

WORD_GAP = r"[\x20\x09-\x0D]+"  # between words, as a Java pattern
BLANKS = "' \\t\\n\\u000B\\u000C\\r'"  # the same characters, as an SQL literal


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; one of our own only where it is unset and the driver is the only machine."""
    sc = spark.sparkContext
    known = sc._jsc.sc().getCheckpointDir()
    if not known.isEmpty():
        return known.get()
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not named and not sc.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="readloom-"))
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """df written to the shared folder, so that lost executors don't bring back its lineage."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame, compression: str = "zstd") -> DataFrame:
    """As cut, but as a Parquet table: for wide rows. forget() removes it."""
    shared_dir(df.sparkSession)
    return checkpoints.cut(df, compression)


FILTER_BITS = 1 << 16, 1 << 27  #: least and most bits of a filter


def filter_bits(n: int) -> int:
    """Bits of a filter of n keys: at least eight for each, up to 16 MB. A fuller filter lets more rows pass; what uses one must decide by a join."""
    least, most = FILTER_BITS
    return min(most, max(least, 1 << (8 * max(1, n) - 1).bit_length()))


def filter_of(rows: DataFrame, bit: Column) -> bytes:
    """The filter of rows whose bits are bit: put together by partial aggregation, of which the driver gets the filter itself only."""
    bits = rows.select(bit.cast("bigint").alias("bit")).select(F.expr("bit div 32768").alias("part"), F.expr("bit % 32768").alias("at"))
    parts = bits.groupBy("part").agg(F.bitmap_construct_agg("at").alias("bits")).toLocalIterator()
    out: dict[int, bytes] = {r.part: bytes(r.bits) for r in parts}
    return b"".join(out.get(i, bytes(4096)) for i in range(max(out, default=-1) + 1))


def passes(filter_bytes: np.ndarray, bit: np.ndarray) -> np.ndarray:
    """Which bits are set; those behind the filter's end aren't."""
    byte = bit >> 3
    inside = byte < len(filter_bytes)
    out = np.zeros(len(bit), bool)
    out[inside] = (filter_bytes[byte[inside]] >> (bit[inside] & 7).astype(np.uint8) & 1).astype(bool)
    return out


def free_prefix(docs: DataFrame) -> str:
    """A beginning of names that no column of docs has, whatever the case of its letters."""
    prefix = "own_"
    while any(c.lower().startswith(prefix) for c in docs.columns):
        prefix = "_" + prefix
    return prefix


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
