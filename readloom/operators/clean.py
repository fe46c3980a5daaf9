"""From raw sequences to reads: trimming, checks, filters, both strands, duplicates, mates.

Odd ids are forward reads, even ids their reverse complements: the partner is id xor 1, and ids are never renumbered."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from readloom.checkpoints import cut
from readloom.config import Params
from readloom.functions import packed
from readloom.functions.sequences import has_period, reverse_complement


def first_token(raw: Column) -> Column:
    """Without leading blanks, up to the next blank."""
    return F.substring_index(F.ltrim(raw), " ", 1)


def trim_ends(s: str, left: int, right: int) -> Column:
    """Unless too little would be left."""
    return F.expr(f"case when length({s}) < {left + right + 10} then {s} else substring({s}, {left + 1}, length({s}) - {left + right}) end")


def trim_by_bases(s: str) -> Column:
    """Cuts as many bases off each end as the code of its outermost base says."""
    return F.expr(f"substring({s}, instr('ACGT', substring({s}, 1, 1)), greatest(0, length({s}) - greatest(instr('ACGT', substring({s}, 1, 1)) - 1, 0) - greatest(instr('ACGT', right({s}, 1)) - 1, 0)))")


def checked(s: Column) -> Column:
    """s, or an error where it holds anything but A, C, G, T, N, U."""
    return F.when(s.rlike("^[ACGTNU]*$"), s).otherwise(F.raise_error(F.concat(F.lit("not a sequence: "), s)))


def fill_unknown(s: str, key: str = "rn") -> Column:
    """N replaced by bases that depend on the record and the place only."""
    return F.expr(f"case when contains({s}, 'N') then array_join(transform(split({s}, ''), (c, i) -> case when c = 'N' then substring('ACGT', cast(pmod(xxhash64({key}, i), 4) as int) + 1, 1) else c end), '') else {s} end")


def prepared(raw: DataFrame, p: Params) -> DataFrame:
    """rn, seq: trimmed and checked, U read as T (as A without p.rna, where U is no base)."""
    seq = raw.select("rn", first_token(F.col("raw")).alias("t")).where("t <> ''").select("rn", trim_ends("t", p.trim_left, p.trim_right).alias("s")).select("rn", checked(F.col("s")).alias("s"))
    # A generator's output isn't replaced by its expressions: else the filters that follow, pushed below, would prepare a read anew for each period they try.
    return seq.select("rn", F.explode(F.array(F.replace("s", F.lit("U"), F.lit("T" if p.rna else "A")))).alias("seq"))


def valid(seqs: DataFrame, p: Params) -> DataFrame:
    """Without unknown bases (dropped or filled) and without short periods."""
    seqs = seqs.where(~F.contains("seq", F.lit("N"))) if p.drop_n else seqs.withColumn("seq", F.when(F.contains("seq", F.lit("N")), fill_unknown("seq")).otherwise(F.col("seq")))
    return seqs.where(~has_period("seq", p.max_period))


def both_strands(seqs: DataFrame) -> DataFrame:
    """id, seq: two rows for each rn, from one pass. The bytes of a batch's reads are turned together, which turns the order of its reads, too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            even, seq = pc.multiply(batch.column(0), 2), batch.column(1)
            yield pa.RecordBatch.from_arrays([pc.add(even, 1), seq], names=["id", "seq"])
            yield pa.RecordBatch.from_arrays([even[::-1], packed.turned(seq)], names=["id", "seq"])

    return seqs.select(F.col("rn").cast("bigint").alias("rn"), "seq").mapInArrow(run, "id bigint, seq string")


def clean(raw: DataFrame, p: Params) -> DataFrame:
    """raw: rn, raw. Both strands of all valid reads: id, seq."""
    return both_strands(valid(prepared(raw, p), p))


def dedup(reads: DataFrame) -> DataFrame:
    """Of equal sequences the one with the greatest id."""
    return reads.groupBy("seq").agg(F.max("id").alias("id")).select("id", "seq")


def contained_in_longer(reads: DataFrame) -> DataFrame:
    """id of each read that is a proper prefix of another. Reads meet on their first bases, as many as the shortest has; distinct sequences expected."""
    least, most = reads.agg(F.min(F.length("seq")), F.max(F.length("seq"))).first()
    if least == most:  # of one length, or no reads at all
        return reads.select("id").where(F.lit(False))
    short, long = reads.alias("a"), reads.alias("b")
    key = lambda t: F.substring(f"{t}.seq", 1, least)
    return short.join(long, (key("a") == key("b")) & (F.length("a.seq") < F.length("b.seq")) & F.startswith(F.col("b.seq"), F.col("a.seq")), "left_semi").select("id")


def drop_contained(reads: DataFrame) -> DataFrame:
    """Without duplicates, proper prefixes, and (as complements of prefixes) proper suffixes; a palindromic read loses both rows."""
    return _uncontained(cut(dedup(reads).withColumn("palindrome", F.col("seq") == reverse_complement(F.col("seq"))), "zstd"))


def _uncontained(distinct: DataFrame) -> DataFrame:
    inside = contained_in_longer(distinct)
    gone = cut(inside.unionByName(inside.select(F.col("id").bitwiseXOR(F.lit(1)).alias("id"))).distinct())
    others = distinct.where(~F.col("palindrome")).select("id", "seq")
    return others if gone.isEmpty() else others.join(gone, "id", "left_anti")


def distinct_reads(seqs: DataFrame) -> DataFrame:
    """id, seq: drop_contained(both_strands(seqs)). Duplicates meet as one strand of each rn, the lesser, packed: of the ids that its sequence has the greatest is the partner of the greatest that its complement has."""
    keys = seqs.where("seq is not null").select(F.col("rn").cast("bigint").alias("rn"), "seq").mapInArrow(_as_keys, "key binary, id bigint")
    held = cut(keys.repartition("key").groupBy("key").agg(F.max("id").alias("id")), "zstd")
    strands = held.mapInArrow(_as_strands, "id bigint, seq string, palindrome boolean")
    size, end = F.length("key"), F.expr("substring(key, -1, 1)")
    least, most, low, high = held.agg(F.min(size), F.max(size), F.min(end), F.max(end)).first()
    if least == most and low == high and (low is None or bytes(low) != b"\xff"):  # reads of one length are in no others
        return strands.where(~F.col("palindrome")).select("id", "seq")
    return _uncontained(strands)


def _as_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The lesser strand of each read, four bases a byte, behind it how many of the last byte's are none; of reads with other letters the text, behind it 255. The strand's id."""
    for batch in batches:
        if not batch.num_rows:
            continue
        codes, lengths = packed.base_codes(batch.column(1))
        words, counts = packed.pack(codes, lengths)
        back = packed.pack(3 - codes[::-1], lengths[::-1])[0]
        starts = np.cumsum(counts) - counts
        starts_back = len(words) - starts - counts
        turned, open_ = np.zeros(len(lengths), bool), np.arange(len(lengths))
        for w in range(int(counts.max())):
            open_ = open_[counts[open_] > w]
            a, b = words[starts[open_] + w], back[starts_back[open_] + w]
            turned[open_[b < a]] = True
            open_ = open_[a == b]
        need = -(-lengths // 4)
        out = np.zeros(int(need.sum()) + len(need), np.uint8)
        ends = np.cumsum(need + 1)
        both = np.concatenate([words, back]).view(np.uint8)
        at = packed.ragged(need)
        out[np.repeat(ends - need - 1, need) + at] = both[np.repeat(8 * np.where(turned, len(words) + starts_back, starts), need) + at]
        out[ends - 1] = 4 * need - lengths
        keys = pa.Array.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(np.concatenate([[0], ends])), pa.py_buffer(out)]).cast(pa.binary())
        plain = pc.match_substring_regex(batch.column(1), "^[ACGT]*$").to_numpy(zero_copy_only=False)
        if not plain.all():
            some, texts = np.flatnonzero(~plain), keys.to_pylist()
            for i in some.tolist():
                s = batch.column(1)[i].as_py()
                r = s[::-1].translate(str.maketrans("ACGT", "TGCA"))
                texts[i], turned[i] = min(s, r).encode() + b"\xff", r < s
            keys = pa.array(texts, pa.binary())
        yield pa.RecordBatch.from_arrays([keys, pa.array(2 * batch.column(0).to_numpy() + ~turned)], names=["key", "id"])


def _as_strands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Both strands of what _as_keys() made; one row of a palindrome."""
    letters = np.frombuffer(b"ACGT", np.uint8)[np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3]
    for batch in batches:
        flat = batch.column(0).cast(pa.large_binary())
        ends = np.frombuffer(flat.buffers()[1], np.int64)[flat.offset : flat.offset + len(flat) + 1]
        if len(ends) < 2:
            continue
        data, sizes = np.frombuffer(flat.buffers()[2], np.uint8)[ends[0] : ends[-1]], np.diff(ends)
        last = data[ends[1:] - ends[0] - 1].astype(np.int64)
        lengths = np.where(last == 255, 0, 4 * (sizes - 1) - last)
        if (sizes == sizes[0]).all() and (lengths == lengths[0]).all():
            text = letters[data.reshape(len(sizes), -1)[:, :-1]].reshape(len(sizes), -1)[:, : lengths[0]].ravel()
        else:
            text = letters[data].ravel()[packed.ragged(4 * sizes) < np.repeat(lengths, 4 * sizes)]
        seq = pa.Array.from_buffers(pa.large_string(), len(lengths), [None, pa.py_buffer(np.concatenate([[0], np.cumsum(lengths)])), pa.py_buffer(text)]).cast(pa.string())
        if (last == 255).any():
            seq = pa.array([k[:-1].decode() if k[-1] == 255 else s for k, s in zip(batch.column(0).to_pylist(), seq.to_pylist(), strict=True)], pa.string())
        back, ids = packed.turned(seq)[::-1], batch.column(1).to_numpy()
        same = pc.equal(seq, back)
        yield pa.RecordBatch.from_arrays([pa.array(ids), seq, same], names=["id", "seq", "palindrome"])
        other = pc.invert(same)
        yield pa.RecordBatch.from_arrays([pa.array(ids ^ 1), back, same], names=["id", "seq", "palindrome"]).filter(other)


def with_mates(reads: DataFrame) -> DataFrame:
    """Adds mate_id: ids come in fours (complement and read of mate 1, then of mate 2), a mate is two away; null where it didn't survive."""
    mate = F.when(F.col("id") % 4 < 2, F.col("id") + 2).otherwise(F.col("id") - 2)
    here = reads.select(F.col("id").alias("mate_id"))
    return reads.withColumn("wanted", mate).join(here, F.col("wanted") == F.col("mate_id"), "left").drop("wanted")


def pairs_to_raw(pairs: DataFrame) -> DataFrame:
    """rn, raw: mates 1 and 2 of pair n become records 2n and 2n + 1, so that with_mates finds them."""
    return pairs.select(F.explode(F.array(F.struct((2 * F.col("rn")).alias("rn"), F.col("mate1").alias("raw")), F.struct((2 * F.col("rn") + 1).alias("rn"), F.col("mate2").alias("raw")))).alias("r")).select("r.*").where("raw is not null")


def long_enough(reads: DataFrame, p: Params) -> DataFrame:
    return reads.where(F.length("seq") >= p.min_read)
