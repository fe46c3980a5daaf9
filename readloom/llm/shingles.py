"""Word shingles of many texts at once, as 64-bit fingerprints, with numpy.

Words are runs of bytes other than blank and \\t to \\r, with A-Z lower-cased. A word's hash is a sum of random byte values weighted with powers of an odd
number by place, mixed; a shingle's hash mixes those of its words by place. A text with fewer words than a shingle has its whole sequence as one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

CHUNK = 1 << 20  #: bytes of text whose temporary arrays are held at once; a longer text is a chunk of its own
_FOLD = bytes(c + 32 if 65 <= c <= 90 else 32 if c == 32 or 9 <= c <= 13 else c for c in range(256))
_RANDOM = np.random.default_rng(20240229)
_BYTE = _RANDOM.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLACE = _RANDOM.integers(0, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _words(buffer: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Start and hash of each word. buffer ends in a blank."""
    a = np.frombuffer(buffer, np.uint8)
    inside = a != 32
    edge = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    starts, ends = edge[0::2], edge[1::2]
    if not len(starts):
        return starts, np.zeros(0, np.uint64)
    lengths = ends - starts
    powers = np.cumprod(np.full(int(lengths.max()), _BASE, np.uint64))
    at = np.flatnonzero(inside)
    first = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    values = _BYTE[a[at]] * powers[np.arange(len(at)) - np.repeat(first, lengths)]
    return starts, mixed(np.add.reduceat(values, first) + lengths.astype(np.uint64))


def _chunks(texts: list[bytes]) -> Iterator[tuple[int, list[bytes]]]:
    start, size = 0, 0
    for i, t in enumerate(texts):
        if i > start and size + len(t) > CHUNK:
            yield start, texts[start:i]
            start, size = i, 0
        size += len(t) + 1
    if start < len(texts):
        yield start, texts[start:]


def shingle_sets(texts: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of each text: its place in texts and the hash, sorted by both."""
    docs, hashes = [], []
    for first, part in _chunks(texts):
        bounds = np.cumsum([0] + [len(t) + 1 for t in part])
        starts, words = _words((b" ".join(part) + b" ").translate(_FOLD))
        of = np.searchsorted(bounds, starts, "right") - 1
        count = np.bincount(of, minlength=len(part))
        begin = np.concatenate([[0], np.cumsum(count)[:-1]])
        full = max(0, len(words) - width + 1)
        h = np.zeros(full, np.uint64)
        for k in range(width):
            h += words[k : k + full] * _PLACE[k]
        same = of[:full] == of[width - 1 : width - 1 + full]
        d, h = of[:full][same], mixed(h[same])
        short = np.flatnonzero((count > 0) & (count < width))
        own = np.array([(words[b : b + n] * _PLACE[:n]).sum(dtype=np.uint64) for b, n in zip(begin[short], count[short], strict=True)], np.uint64)
        own += count[short].astype(np.uint64) * _PLACE[63]
        d, h = np.concatenate([d, short]), np.concatenate([h, mixed(own)])
        order = np.lexsort((h, d))
        d, h = d[order], h[order]
        fresh = np.ones(len(d), bool)
        fresh[1:] = (d[1:] != d[:-1]) | (h[1:] != h[:-1])
        docs.append(d[fresh] + first)
        hashes.append(h[fresh])
    return (np.concatenate(docs), np.concatenate(hashes)) if docs else (np.zeros(0, np.int64), np.zeros(0, np.uint64))


def set_prints(n_texts: int, docs: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Size of each set and two 64-bit fingerprints of it."""
    n = np.bincount(docs, minlength=n_texts).astype(np.int64)
    out = []
    for salt in (np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)):
        running = np.concatenate([[np.uint64(0)], np.cumsum(mixed(hashes ^ salt), dtype=np.uint64)])
        ends = np.cumsum(n)
        out.append((running[ends] - running[ends - n]).view(np.int64))
    return n, out[0], out[1]
