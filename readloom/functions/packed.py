"""Sequences of an Arrow batch as packed words: 32 bases of two bits in each, the first base lowest. Everything here works on all sequences, or all pairs of them, at once.

The codes of A, C, G, T are 0 to 3, so the bits in which two words differ are those of the bit metric: two for A and T, C and G, one for any other two bases."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute

_CODE = np.zeros(256, np.uint8)
_CODE[list(b"ACGT")] = range(4)
_COMPLEMENT = np.arange(256, dtype=np.uint8)
_COMPLEMENT[list(b"ACGT")] = list(b"TGCA")


def ragged(counts: np.ndarray) -> np.ndarray:
    """0 to n - 1 for each n, one behind the other."""
    return np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)


def base_codes(seqs: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The codes of all bases, and each sequence's length."""
    flat = seqs.cast(pa.large_binary())
    ends = np.frombuffer(flat.buffers()[1], np.int64)[flat.offset : flat.offset + len(flat) + 1]
    data = np.frombuffer(flat.buffers()[2], np.uint8)[ends[0] : ends[-1]] if len(flat) and flat.buffers()[2] else np.zeros(0, np.uint8)
    return _CODE[data], np.diff(ends)


def turned(seqs: pa.Array) -> pa.Array:
    """The reverse complements, last first: what stands in one row of bytes is turned as a whole. Null for null."""
    flat = seqs.cast(pa.large_binary())
    ends = np.frombuffer(flat.buffers()[1], np.int64)[flat.offset : flat.offset + len(flat) + 1] if len(flat) else np.zeros(1, np.int64)
    data = np.frombuffer(flat.buffers()[2], np.uint8)[ends[0] : ends[-1]] if len(flat) and flat.buffers()[2] else np.zeros(0, np.uint8)
    if (data > 127).any():  # letters of several bytes
        return pa.array([s if s is None else s[::-1].translate(str.maketrans("ACGT", "TGCA")) for s in reversed(seqs.to_pylist())], pa.string())
    known = flat.is_valid()[::-1]
    out = pa.Array.from_buffers(pa.large_string(), len(flat), [None, pa.py_buffer(np.ascontiguousarray(ends[-1] - ends[::-1])), pa.py_buffer(np.ascontiguousarray(_COMPLEMENT[data][::-1]))])
    return pa.compute.if_else(known, out, None).cast(pa.string())


def pack(codes: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words of all sequences, each followed by one of zeros, and each sequence's number of words."""
    counts = lengths // 32 + 2
    padded = np.zeros(int(counts.sum()) * 32, np.uint8)
    padded[np.repeat((np.cumsum(counts) - counts) * 32, lengths) + ragged(lengths)] = codes
    return (padded.reshape(-1, 4) @ np.array([1, 4, 16, 64], np.uint8)).view("<u8"), counts


def at(words: np.ndarray, starts: np.ndarray, place: np.ndarray) -> np.ndarray:
    """32 bases from a place of each sequence on; starts: its first word. What is behind its end is left to the caller's mask."""
    q = starts + (place >> 5)
    r = (2 * (place & 31)).astype(np.uint64)
    return words[q] >> r | (words[np.minimum(q + 1, len(words) - 1)] << np.uint64(1)) << (np.uint64(63) - r)


def lowest(n: np.ndarray) -> np.ndarray:
    """A mask of the first n bases of a word; none for n under 0, all for n over 31."""
    some = (np.uint64(1) << (2 * np.clip(n, 0, 31)).astype(np.uint64)) - np.uint64(1)
    return np.where(n > 31, ~np.uint64(0), some)


def complements(words: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The reverse complements of words of n bases, 1 to 32; what is behind them is zero."""
    x = (~words).byteswap()
    x = (x & np.uint64(0x0F0F0F0F0F0F0F0F)) << np.uint64(4) | x >> np.uint64(4) & np.uint64(0x0F0F0F0F0F0F0F0F)
    x = (x & np.uint64(0x3333333333333333)) << np.uint64(2) | x >> np.uint64(2) & np.uint64(0x3333333333333333)
    return x >> (64 - 2 * n).astype(np.uint64)


def alike(words: np.ndarray, starts: np.ndarray, i: np.ndarray, j: np.ndarray, off: np.ndarray, overlap: np.ndarray, percent: float) -> np.ndarray:
    """Whether sequences i from off on and sequences j are similar over their overlaps: the ends agree (the first three bases, the low bit of the fourth, the last three), and half of what differing bits leave is at least
    percent of the overlap."""
    a, b = starts[i], starts[j]
    head = (at(words, a, off) ^ at(words, b, np.zeros_like(off))) & lowest(overlap)
    back = np.maximum(overlap - 3, 0)
    tail = (at(words, a, off + back) ^ at(words, b, back)) & lowest(np.minimum(overlap, 3))
    out = (head & np.uint64(0x7F) == 0) & (tail == 0)
    left = np.flatnonzero(out)
    a, b, off, overlap = a[left], b[left], off[left], overlap[left]
    bits = np.zeros(len(left), np.int64)
    for start in range(0, int(overlap.max(initial=0)), 32):
        bits += np.bitwise_count((at(words, a, np.minimum(off + start, off + overlap)) ^ at(words, b, np.minimum(start, overlap))) & lowest(overlap - start))
    out[left] = 100 * ((2 * overlap - bits) // 2) >= percent * overlap
    return out


def banded_lcs(words: np.ndarray, a: np.ndarray, off: np.ndarray, n_a: np.ndarray, b: np.ndarray, n_b: np.ndarray, band: int = 2) -> np.ndarray:
    """Length of the longest common subsequence of pairs whose paired places are at most band apart: of n_a bases from off on of the sequences whose words start at a, and the first n_b of those at b.

    One diagonal of the band is one row of an array over all pairs; a step takes the next place of the first sequence for all of them. Numbers are as small as lengths allow; ends are only watched where pairs have different ones."""
    wide = 2 * band + 1
    most = int(min(n_a.max(initial=0), n_b.max(initial=0)))
    alike = len(a) > 0 and bool((n_a == n_a[0]).all() and (n_b == n_b[0]).all())
    best = np.zeros((wide + 2, len(a)), np.uint8 if most < 255 else np.int32)  # best[d + 1]: with the second sequence's place = the first one's + d - band; what is outside the band counts nothing
    base = lambda s, place: (at(words, s, np.maximum(place, 0)) & np.uint64(3)).astype(np.uint8)
    ahead = [base(b, np.clip(d - band, 0, n_b)) for d in range(wide)]
    for p in range(int(n_a.max(initial=0))):
        mine, before = base(a, off + np.minimum(p, n_a)), best.copy()
        for d in range(wide):
            q = p + d - band
            # One step back on the diagonal is the same d, the place above d + 1 of the step before, the place to the left d - 1 of this one.
            if alike and not (0 <= q < n_b[0]):
                continue
            new = np.maximum(before[d + 1] + (mine == ahead[d]), np.maximum(before[d + 2], best[d]))
            best[d + 1] = new if alike else np.where((p < n_a) & (q >= 0) & (q < n_b), new, best[d + 1])
        ahead = [*ahead[1:], base(b, np.clip(p + 1 + band, 0, n_b))]
    return best.max(0).astype(np.int32)


def numbers(codes: np.ndarray, m: int, bits: int = 2) -> np.ndarray:
    """At each place the number of the m codes from there on, of so many bits each (64 at most, together), by doubling; places with fewer codes behind them hold anything."""
    out, have = np.zeros(len(codes), np.uint64), 0
    power, span = codes.astype(np.uint64), 1
    ahead = lambda x, k: np.concatenate([x[k:], np.zeros(min(k, len(x)), np.uint64)])
    while m:
        if m & 1:
            out = out << np.uint64(bits * span) | ahead(power, have)
            have += span
        m >>= 1
        power, span = power << np.uint64(bits * span) | ahead(power, span), 2 * span
    return out


def minimizers(codes: np.ndarray, lengths: np.ndarray, k: int, intervals: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Sequence, place and k-mer (base-4 numbers of 31 codes each, the last of what is left) of the smallest k-mer, of equal ones the first, in each of a sequence's intervals of places."""
    places = np.maximum(lengths - k + 1, 0)
    width = np.maximum(-(-places // intervals), 1)
    parts = np.where(places > 0, (places - 1) // width + 1, 0)
    of = np.repeat(np.arange(len(lengths)), parts)
    begin = ragged(parts) * width[of]
    sizes = np.minimum(begin + width[of], places[of]) - begin
    if not len(of):
        return of, begin, [np.zeros(0, np.uint64)] * -(-k // 31)
    first = (np.cumsum(lengths) - lengths)[of] + begin
    where = np.repeat(first, sizes) + ragged(sizes)  # all places, interval by interval
    starts = np.cumsum(sizes) - sizes
    alive = np.ones(len(where), bool)
    values = []
    for word in range(0, k, 31):
        m = min(31, k - word)
        v = np.where(alive, numbers(codes, m)[np.minimum(where + word, len(codes) - 1)], ~np.uint64(0))
        least = np.minimum.reduceat(v, starts)
        alive &= v == np.repeat(least, sizes)
        values.append(least)
    place = np.minimum.reduceat(np.where(alive, where, len(codes)), starts)
    return of, begin + place - first, values


def prefix_hashes(codes: np.ndarray, lengths: np.ndarray, base: int, modulus: int) -> np.ndarray:
    """Hashes of all prefixes of all sequences, the empty ones first: a step takes the next base of every sequence that has one."""
    if len(lengths) and (lengths == lengths[0]).all():
        columns, out = codes.reshape(len(lengths), -1), np.zeros((len(lengths), int(lengths[0]) + 1), np.int64)
        for p in range(int(lengths[0])):
            out[:, p + 1] = (out[:, p] * base + columns[:, p] + 1) % modulus
        return out.ravel()
    ends = np.cumsum(lengths)
    first, out_first = ends - lengths, ends - lengths + np.arange(len(lengths))
    out = np.zeros(len(codes) + len(lengths), np.int64)
    left = np.argsort(-lengths, kind="stable")
    h = np.zeros(len(lengths), np.int64)
    for p in range(int(lengths.max(initial=0))):
        left = left[: int(np.searchsorted(-lengths[left], -p, "left"))]
        h[left] = (h[left] * base + codes[first[left] + p] + 1) % modulus
        out[out_first[left] + p + 1] = h[left]
    return out


def min_rotations(texts: list[str], codes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """0-based start of the smallest rotation of each text, the first of equal ones; none is empty. codes: the code points of all texts, one after the other."""
    letters = np.flatnonzero(np.bincount(codes))
    rank = np.zeros(int(letters[-1]) + 1, np.uint64)
    rank[letters] = np.arange(len(letters), dtype=np.uint64)
    bits = max(1, int(len(letters) - 1).bit_length())
    starts, out = np.cumsum(lengths) - lengths, np.zeros(len(lengths), np.int64)
    for n in np.unique(lengths).tolist():
        rows = np.flatnonzero(lengths == n)
        key = rank[codes[starts[rows, None] + np.arange(n)]]
        held = 1
        while held < n and 2 * held * bits <= 64:
            key = key << np.uint64(held * bits) | np.roll(key, -held, axis=1)
            held *= 2
        least = key == key.min(axis=1, keepdims=True)
        out[rows] = least.argmax(axis=1)
        # Rotations that begin alike are compared whole.
        for i in np.flatnonzero(least.sum(axis=1) > 1).tolist() if held < n else ():
            t = texts[rows[i]]
            out[rows[i]] = min((t[k:] + t[:k], k) for k in np.flatnonzero(least[i]).tolist())[1]
    return out


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All texts' code points, one text after the other, and the texts' lengths."""
    return np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32), np.array([len(t) for t in texts], np.int64)


def min_periods(texts: list[str], codes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The smallest place from which on each text is its own beginning; its length at most."""
    starts, out = np.cumsum(lengths) - lengths, lengths.copy()
    for n in np.unique(lengths).tolist():
        rows = np.flatnonzero(lengths == n)
        at = np.ascontiguousarray(codes[starts[rows, None] + np.arange(n)].T)
        for p in range(1, n):
            # Only those whose first letters agree are compared whole.
            alike = out[rows] == n
            for k in range(min(4, n - p)):
                alike &= at[p + k] == at[k]
            some = np.flatnonzero(alike)
            if len(some):
                some = some[(at[p:, some] == at[: n - p, some]).all(axis=0)]
                out[rows[some]] = p
    return out


def occurrences(texts: list[str], patterns: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Starts of each pattern in its text, and where those of the next text begin. No pattern is empty."""
    (codes, lengths), (own, sizes) = code_points(texts), code_points(patterns)
    starts, firsts = np.cumsum(lengths) - lengths, np.cumsum(sizes) - sizes
    of, found = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    kinds, kind = np.unique(np.stack([lengths, sizes]), axis=1, return_inverse=True)
    for i, (n, k) in enumerate(kinds.T.tolist()):
        if k > n:
            continue
        rows = np.flatnonzero(kind.ravel() == i)
        at = codes[starts[rows, None] + np.arange(n)]
        hit = np.ones((len(rows), n - k + 1), bool)
        for j in range(k):
            hit &= at[:, j : j + n - k + 1] == own[firsts[rows] + j][:, None]
        row, place = np.nonzero(hit)
        of.append(rows[row])
        found.append(place)
    of, found = np.concatenate(of), np.concatenate(found)
    order = np.argsort(of, kind="stable")
    return found[order].astype(np.int32), np.cumsum(np.bincount(of, minlength=len(texts)))[:-1]
