"""Functions of whole numbers, as Spark columns; arguments are columns' names. The numbers of a batch take each step together."""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

SIEVED = 1 << 24  #: primes under this number, or less where a batch has no greater ones, come from a sieve that a worker keeps
WITNESSES = (2, 3, 5, 7, 11, 13, 17, 19, 23, 29, 31, 37)  #: enough for all 64-bit numbers


def _known(*arrays: pa.Array) -> tuple[np.ndarray, list[np.ndarray]]:
    """Where none is null, and the numbers there."""
    there = functools.reduce(np.logical_and, [x.is_valid().to_numpy(zero_copy_only=False) for x in arrays])
    return there, [pc.fill_null(x, 0).to_numpy(zero_copy_only=False)[there] for x in arrays]


def _filled(there: np.ndarray, values: np.ndarray) -> pa.Array:
    out = np.zeros(len(there), np.int64)
    out[there] = values
    return pa.array(out, mask=~there)


def _positive_rest(a: np.ndarray, n: np.ndarray) -> np.ndarray:
    """As pmod()."""
    if (n == 0).any():
        raise ZeroDivisionError("remainder by zero")
    r = np.fmod(a, n)
    return np.where(r < 0, np.fmod(r + n, n), r)


def _big(x: str) -> Column:
    return F.expr(f"cast({x} as bigint)")


def gcd(a: str, b: str) -> Column:
    @F.arrow_udf("bigint")
    def run(x: pa.Array, y: pa.Array) -> pa.Array:
        there, (p, q) = _known(x, y)
        return _filled(there, np.gcd(p, q))

    return run(_big(a), _big(b))


def inverse(a: str, n: str) -> Column:
    """The number under n that times a leaves 1 of n; -1 if there is none. For n = 1 it is 0."""

    @F.arrow_udf("bigint")
    def run(s: pa.Array, m: pa.Array) -> pa.Array:
        there, (p, of) = _known(s, m)
        p, q = _positive_rest(p, of), of.copy()
        x, y = np.ones_like(p), np.zeros_like(p)
        left = np.flatnonzero(q)
        while len(left):
            b, rest = q[left], np.fmod(p[left], q[left])
            times = (p[left] - rest) // b
            p[left], q[left] = b, rest
            x[left], y[left] = y[left], x[left] - times * y[left]
            left = left[rest != 0]
        return _filled(there, np.where(p == 1, _positive_rest(x, of), -1))

    return run(_big(a), _big(n))


@functools.lru_cache(1)
def _primes(under: int) -> np.ndarray:
    prime = np.ones(under, bool)
    prime[:2] = False
    for d in range(2, int(under**0.5) + 1):
        if prime[d]:
            prime[d * d :: d] = False
    return np.flatnonzero(prime)


def _is_prime(n: int) -> bool:
    """Of an odd number over 37."""
    if any(n % w == 0 for w in WITNESSES):
        return False
    twos = ((n - 1) & (1 - n)).bit_length() - 1
    odd = (n - 1) >> twos
    for w in WITNESSES:
        x = pow(w, odd, n)
        if x not in (1, n - 1) and not any((x := x * x % n) == n - 1 for _ in range(twos - 1)):
            return False
    return True


def lower_prime(n: str) -> Column:
    """The greatest prime under n; null for n up to 2."""

    @F.arrow_udf("bigint")
    def run(s: pa.Array) -> pa.Array:
        there, (x,) = _known(s)
        out, few = np.zeros(len(x), np.int64), (x > 2) & (x <= SIEVED)
        if few.any():
            primes = _primes(1 << int(x[few].max() - 1).bit_length())
            out[few] = primes[np.searchsorted(primes, x[few], "left") - 1]
        for i in np.flatnonzero(x > SIEVED).tolist():
            p = (int(x[i]) - 2) | 1
            while not _is_prime(p):
                p -= 2
            out[i] = p
        there[there] = x > 2
        return _filled(there, out[x > 2])

    return run(_big(n))
