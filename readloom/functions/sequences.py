"""Scalar functions of sequences, as Spark columns: strings over A, C, G, T and N."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from readloom.functions import packed

HASH_BASE, HASH_MODULUS = 1_000_003, 2**31 - 1  #: of prefix hashes: a product of two values fits 64 bits

#: The order of bases, and the one that sorted reads follow.
BASES, COMPLEMENT, SORT_ORDER = "ACGT", "TGCA", "AGCT"


def complement(s: Column) -> Column:
    return F.translate(s, BASES, COMPLEMENT)


def reverse_complement(s: Column) -> Column:
    return F.reverse(complement(s))


def base_code(c: Column) -> Column:
    """0 to 3, or -1 for anything else."""
    return F.when(F.length(c) == 0, -1).otherwise(F.position(F.substring(c, 1, 1), F.lit(BASES)) - 1)


def code_base(n: Column) -> Column:
    return F.when((n >= 0) & (n < 4), F.substring(F.lit(BASES), n + 1, F.lit(1))).otherwise("N")


def pack(s: str) -> Column:
    """Base-4 number of the string column named s: at most 31 bases fit."""
    return F.expr(f"aggregate(sequence(1, length({s})), 0L, (a, i) -> a * 4 + instr('ACGT', substring({s}, i, 1)) - 1)")


def unpack(n: str, length: int) -> Column:
    return F.expr(f"array_join(transform(sequence({length - 1}, 0, -1), i -> substring('ACGT', cast(pmod(shiftright({n}, 2 * i), 4) as int) + 1, 1)), '')")


def pack_whole(s: str) -> Column:
    """Base-4 numbers of the string column named s, whatever its length: one for each 31 bases."""
    part = f"substring({s}, p, 31)"
    known = f"case when {part} rlike '^[ACGT]+$' then cast(conv(translate({part}, 'ACGT', '0123'), 4, 10) as bigint) else aggregate(sequence(1, length({part})), 0L, (a, i) -> a * 4 + instr('ACGT', substring({s}, p + i - 1, 1)) - 1) end"
    return F.expr(f"transform(case when length({s}) > 0 then sequence(1, length({s}), 31) else array() end, p -> {known})")


def unpack_whole(codes: str, n: str) -> Column:
    """The n bases (a column's name) that pack_whole's numbers stand for."""
    part = f"least(31, {n} - 31 * j)"
    bits = f"array_join(transform(sequence({part} - 1, 0, -1), i -> substring('ACGT', cast(pmod(shiftright(c, 2 * i), 4) as int) + 1, 1)), '')"
    return F.expr(f"array_join(transform({codes}, (c, j) -> case when c >= 0 then translate(right(lpad(conv(c, 10, 4), 31, '0'), {part}), '0123', 'ACGT') else {bits} end), '')")


def to_rna(s: Column) -> Column:
    return F.translate(s, "T", "U")


def to_dna(s: Column) -> Column:
    return F.translate(s, "U", "T")


def has_period(s: str, most: int) -> Column:
    """Whether the minimal period is at most most: a string is periodic in p if it begins with itself moved by p; its length is always a period."""
    # What a period of at most most leaves of the beginning is found again further on; few strings pass that test. Written out, as a lambda would end compiled code.
    found = f"contains(substring({s}, 2), substring({s}, 1, greatest(0, length({s}) - {most})))"
    return F.expr(f"{found} and ({' or '.join(f'startswith({s}, substring({s}, {p + 1}))' for p in range(1, most + 1))})")


def _of_texts(x: pd.Series, find) -> pd.Series:
    """What find gives for the texts of x (with their code points and lengths); null for null and empty ones."""
    known = np.flatnonzero(x.notna() & (x != ""))
    texts = x.iloc[known].tolist()
    out = pd.Series(pd.array([None] * len(x), "Int32"))
    if len(known):
        out.iloc[known] = find(texts, *packed.code_points(texts))
    return out


def min_period(s: str) -> Column:
    """The smallest p >= 1 at which the string agrees with itself moved by p; null for an empty one. The strings of a length in a batch are moved together."""

    @F.pandas_udf("int")
    def run(x: pd.Series) -> pd.Series:
        return _of_texts(x, packed.min_periods)

    return run(F.col(s))


def occurrences(s: str, pattern: str) -> Column:
    """0-based starts of pattern (a column's name), overlapping ones too; none of an empty or null pattern, or in a null string. Patterns and strings of the same lengths in a batch are compared together."""

    @F.pandas_udf("array<int>")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        known = np.flatnonzero(x.notna() & y.notna() & (y != ""))
        out = pd.Series([np.zeros(0, np.int32)] * len(x), dtype=object)
        if len(known):
            found, cuts = packed.occurrences(x.iloc[known].tolist(), y.iloc[known].tolist())
            out.iloc[known] = pd.Series(np.split(found, cuts), index=known, dtype=object)
        return out

    return run(F.col(s), F.col(pattern))


def min_rotation(s: str) -> Column:
    """0-based start of the smallest rotation, the first of equal ones; null for an empty string. No rotation is written out: the strings of a length in a batch compare the first letters of all rotations as numbers."""

    @F.pandas_udf("int")
    def run(x: pd.Series) -> pd.Series:
        return _of_texts(x, packed.min_rotations)

    return run(F.col(s))


def common_prefix(a: str, b: str) -> Column:
    """Length of the longest common prefix, by halving: a few comparisons of substrings, no loop over characters."""
    mid = "cast((x.lo + x.hi + 1) div 2 as int)"
    equal = f"substring({a}, 1, {mid}) = substring({b}, 1, {mid})"
    step = f"case when x.lo >= x.hi then x when {equal} then struct({mid} as lo, x.hi as hi) else struct(x.lo as lo, {mid} - 1 as hi) end"
    return F.expr(f"aggregate(sequence(1, 32), struct(0 as lo, least(length({a}), length({b})) as hi), (x, i) -> {step}, x -> x.lo)")


def overlap_length(len1: Column, len2: Column, off: Column) -> Column:
    return F.least(len1, len2 + off) - off


def right_offset(len1: Column, len2: Column, off: Column) -> Column:
    return len2 + off - len1


def differing_bits(a: str, b: str) -> Column:
    """Bits in which two strings of one length differ: A and T, C and G differ in two bits, any other two bases in one. Of the base-4 numbers of each 31 bases, whose XOR has just these bits."""
    code = lambda s: f"cast(conv(translate(substring({s}, 31 * k + 1, 31), 'ACGT', '0123'), 4, 10) as bigint)"
    return F.expr(f"case when {a} = {b} then 0 else aggregate(transform(sequence(0, (length({a}) - 1) div 31), k -> bit_count({code(a)} ^ {code(b)})), 0, (acc, x) -> acc + x) end")


def similar(a: str, b: str, percent: float) -> Column:
    """Whether two overlapping parts of one length are alike: half of what differing bits leave is at least percent of the length, and the ends
    agree: the first three bases and the low bit of the fourth, and the last three."""
    ends = f"substring({a}, 1, 3) = substring({b}, 1, 3) and (substring({a}, 4, 1) in ('C', 'T')) = (substring({b}, 4, 1) in ('C', 'T')) and right({a}, 3) = right({b}, 3)"
    same = F.floor((2 * F.length(a) - differing_bits(a, b)) / 2)
    return F.expr(ends) & (100 * same >= percent * F.length(a))


def kmers(s: str, k: int) -> Column:
    """Array of all k-mers, in order."""
    return F.expr(f"case when length({s}) >= {k} then transform(sequence(1, length({s}) - {k} + 1), i -> substring({s}, i, {k})) else cast(array() as array<string>) end")


def banded_lcs(a: Column, b: Column, band: int = 2) -> Column:
    """Length of the longest common subsequence whose paired places are at most band apart; null where a string is. All pairs of a batch take each step together (functions/packed.py)."""

    @F.pandas_udf("int")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        known = (x.notna() & y.notna()).to_numpy()
        codes, lengths = packed.base_codes(pa.array([*x[known], *y[known]], pa.string()))
        words, counts = packed.pack(codes, lengths)
        starts, k = np.cumsum(counts) - counts, int(known.sum())
        out = pd.Series(pd.array([None] * len(x), "Int32"))
        out[known] = packed.banded_lcs(words, starts[:k], np.zeros(k, np.int64), lengths[:k], starts[k:], lengths[k:], band)
        return out

    return run(a, b)


def alike_by_lcs(a: Column, b: Column, percent: float = 95, band: int = 2) -> Column:
    """Whether the banded common subsequence is over percent of the first one's length."""
    return 100 * banded_lcs(a, b, band) > percent * F.length(a)


def prefix_hashes(s: Column) -> Column:
    """Hashes of all prefixes, the empty one first: of h (a prefix's) and the next base's code c, (HASH_BASE * h + c + 1) modulo HASH_MODULUS. Null for null."""

    @F.arrow_udf("array<bigint>")
    def run(x: pa.Array) -> pa.Array:
        codes, lengths = packed.base_codes(pc.fill_null(x, ""))
        hashes = packed.prefix_hashes(codes, lengths, HASH_BASE, HASH_MODULUS)
        ends = np.concatenate([[0], np.cumsum(lengths + 1)]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(hashes), mask=x.is_null())

    return run(s)


def hash_power(n: str) -> Column:
    """HASH_BASE to the power n, modulo HASH_MODULUS, by squaring."""
    step = f"struct(case when getbit(cast({n} as bigint), i) = 1 then x.p * x.q % {HASH_MODULUS} else x.p end as p, x.q * x.q % {HASH_MODULUS} as q)"
    return F.expr(f"aggregate(sequence(0, 30), struct(1L as p, {HASH_BASE}L as q), (x, i) -> {step}, x -> x.p)")


def substring_hash(hashes: str, start: str, n: str) -> Column:
    """The hash of n bases from the 0-based start on, from the string's prefix_hashes: two lookups and a power, whatever n is."""
    return F.pmod(F.expr(f"get({hashes}, {start} + {n})") - F.expr(f"get({hashes}, {start})") * hash_power(n) % HASH_MODULUS, F.lit(HASH_MODULUS))
