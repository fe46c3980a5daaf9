"""Sets of small whole numbers as packed words, as Spark columns: array<bigint>, number i in bit i mod 64 of word i div 64. Arguments are columns' names or expressions; size: how many numbers there are, also a column or a number.

Sets that are combined have one size. Bits from size on are zero in every result. Null sets give null. Sets are changed by word operations inside higher-order functions, in the JVM; texts and places, a step for each number there, are made of all words of a batch at once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F


def _words(size: str | int) -> str:
    return f"case when {size} > 0 then sequence(0, cast(({size} - 1) div 64 as int)) else cast(array() as array<int>) end"


def _low(n: str) -> str:
    """A word's n lowest bits; none for n under 1, all for n over 63."""
    return f"(case when {n} <= 0 then 0L when {n} > 63 then -1L else shiftrightunsigned(-1L, cast(64 - {n} as int)) end)"


def _word(a: str, w: str) -> str:
    return f"coalesce(get({a}, cast({w} as int)), 0L)"


def from_places(places: str, size: str | int) -> Column:
    """The set of those places (an array of whole numbers, in any order, repeated or not) that are from 0 to size - 1."""
    inside = f"filter({places}, p -> p >= 0 and p < {size} and p div 64 = w)"
    return F.expr(f"transform({_words(size)}, w -> aggregate({inside}, 0L, (x, p) -> x | shiftleft(1L, cast(p % 64 as int))))")


def _bits(a: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A byte for each bit of all words, and each set's number of words; none for null."""
    words = pc.fill_null(a.flatten(), 0).to_numpy(zero_copy_only=False).astype("<i8")
    return np.unpackbits(words.view(np.uint8), bitorder="little"), pc.fill_null(pc.list_value_length(a), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def _ends(counts: np.ndarray, kind: type) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(counts)]).astype(kind)


def from_text(s: str, size: str | int) -> Column:
    """The set that text() writes, from a string of 0 and 1 (a column's name or an expression)."""

    @F.arrow_udf("array<bigint>")
    def run(x: pa.Array, n: pa.Array) -> pa.Array:
        flat, most = x.cast(pa.large_binary()), pc.fill_null(n, 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.frombuffer(flat.buffers()[1], np.int64)[flat.offset : flat.offset + len(flat) + 1] if len(flat) else np.zeros(1, np.int64)
        data = np.frombuffer(flat.buffers()[2], np.uint8)[ends[0] : ends[-1]] if flat.buffers()[2] else np.zeros(0, np.uint8)
        lengths, counts = np.diff(ends), np.maximum(-(-most // 64), 0)
        at = np.arange(len(data)) - np.repeat(ends[:-1] - ends[0], lengths)
        ones = np.flatnonzero((data == ord("1")) & (at < np.repeat(most, lengths)))
        bits = np.zeros(64 * int(counts.sum()), np.uint8)
        bits[np.repeat(64 * (np.cumsum(counts) - counts), lengths)[ones] + at[ones]] = 1
        words = np.packbits(bits, bitorder="little").view("<i8")
        return pa.ListArray.from_arrays(pa.array(_ends(counts, np.int32)), pa.array(words), mask=pc.or_(x.is_null(), n.is_null()))

    return run(F.expr(s), F.expr(f"cast({size} as bigint)"))


def both(a: str, b: str) -> Column:
    return F.expr(f"zip_with({a}, {b}, (x, y) -> x & y)")


def either(a: str, b: str) -> Column:
    return F.expr(f"zip_with({a}, {b}, (x, y) -> x | y)")


def one_of(a: str, b: str) -> Column:
    """In one of the two only."""
    return F.expr(f"zip_with({a}, {b}, (x, y) -> x ^ y)")


def none_of(a: str, size: str | int) -> Column:
    """What isn't in a."""
    return F.expr(f"transform({a}, (x, w) -> ~x & {_low(f'({size} - 64 * w)')})")


def moved_down(a: str, k: str | int) -> Column:
    """Each number less by k >= 0; those under k go."""
    q, r = f"cast({k} div 64 as int)", f"cast({k} % 64 as int)"
    low, high = _word(a, f"w + {q}"), _word(a, f"w + {q} + 1")
    return F.expr(f"transform({a}, (x, w) -> shiftrightunsigned({low}, {r}) | case when {r} = 0 then 0L else shiftleft({high}, 64 - {r}) end)")


def moved_up(a: str, k: str | int, size: str | int) -> Column:
    """Each number greater by k >= 0; those that reach size go."""
    q, r = f"cast({k} div 64 as int)", f"cast({k} % 64 as int)"
    at = lambda w: f"case when {w} >= 0 then {_word(a, f'greatest(0, {w})')} else 0L end"
    moved = f"shiftleft({at(f'(w - {q})')}, {r}) | case when {r} = 0 then 0L else shiftrightunsigned({at(f'(w - {q} - 1)')}, 64 - {r}) end"
    return F.expr(f"transform({a}, (x, w) -> ({moved}) & {_low(f'({size} - 64 * w)')})")


def with_range(a: str, low: str | int, high: str | int, value: bool, size: str | int) -> Column:
    """With, or without, all numbers from low to high, both included."""
    mask = f"({_low(f'(least({high} + 1, {size}) - 64 * w)')} & ~{_low(f'({low} - 64 * w)')})"
    return F.expr(f"transform({a}, (x, w) -> {f'x | {mask}' if value else f'x & ~{mask}'})")


def flipped(a: str, low: str | int, high: str | int, size: str | int) -> Column:
    """All numbers from low to high change: in or out."""
    return F.expr(f"transform({a}, (x, w) -> x ^ ({_low(f'(least({high} + 1, {size}) - 64 * w)')} & ~{_low(f'({low} - 64 * w)')}))")


def holds(a: str, i: str | int) -> Column:
    return F.expr(f"getbit({_word(a, f'{i} div 64')}, cast({i} % 64 as int)) = 1")


def size_of(a: str) -> Column:
    """How many numbers are in it."""
    return F.expr(f"aggregate({a}, 0, (n, x) -> n + bit_count(x))")


def size_between(a: str, low: str | int, high: str | int) -> Column:
    """How many numbers from low to high, both included, are in it."""
    return F.expr(f"aggregate(transform({a}, (x, w) -> bit_count(x & {_low(f'({high} + 1 - 64 * w)')} & ~{_low(f'({low} - 64 * w)')})), 0, (n, x) -> n + x)")


def places(a: str) -> Column:
    """The numbers in it, ascending."""

    @F.arrow_udf("array<int>")
    def run(x: pa.Array) -> pa.Array:
        bits, counts = _bits(x)
        ones = np.flatnonzero(bits)
        ends = np.searchsorted(ones, 64 * _ends(counts, np.int64))
        values = ones - np.repeat(64 * (np.cumsum(counts) - counts), np.diff(ends))
        return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(values.astype(np.int32)), mask=x.is_null())

    return run(F.expr(a))


def first_from(a: str, i: str | int) -> Column:
    """The smallest number in it that is i or greater; -1 if there is none. Of one word only: the first that has any."""
    left = f"filter(transform({a}, (x, w) -> struct(x & ~{_low(f'({i} - 64 * w)')} as x, w as w)), y -> y.x <> 0)"
    lowest = "case when y.x = -9223372036854775807L - 1L then 63 else bit_count((y.x & (~y.x + 1L)) - 1L) end"
    return F.expr(f"coalesce(get(transform(slice({left}, 1, 1), y -> 64 * y.w + {lowest}), 0), -1)")


def first_after(a: str, i: str | int) -> Column:
    """The smallest number in it that is greater than i; -1 if there is none."""
    return first_from(a, f"({i} + 1)")


def first_difference(a: str, b: str) -> Column:
    """The smallest number that is in one of the two only; -1 for equal sets."""
    return first_from(f"zip_with({a}, {b}, (p, q) -> p ^ q)", 0)


def text(a: str, size: str | int) -> Column:
    """A character for each number from 0 on: 1 where it is in."""

    @F.arrow_udf("string")
    def run(x: pa.Array, n: pa.Array) -> pa.Array:
        bits, counts = _bits(x)
        lengths = np.clip(pc.fill_null(n, 0).to_numpy(zero_copy_only=False), 0, 64 * counts)
        at = np.arange(len(bits)) - np.repeat(64 * (np.cumsum(counts) - counts), 64 * counts)
        shown = bits[at < np.repeat(lengths, 64 * counts)] + np.uint8(ord("0"))
        out = pa.Array.from_buffers(pa.large_string(), len(x), [None, pa.py_buffer(_ends(lengths, np.int64)), pa.py_buffer(shown)])
        return pc.if_else(pc.and_(x.is_valid(), n.is_valid()), out, None).cast(pa.string())

    return run(F.expr(a), F.expr(f"cast({size} as bigint)"))
