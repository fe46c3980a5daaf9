"""Overlaps inside k-mer groups, packed words, banded subsequences, hashes and bit sets against brute force."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from readloom.functions import bitsets, packed
from readloom.functions import sequences as fn
from readloom.operators import approximate, kmer_groups
from readloom.operators.kmer_groups import ROTATIONS, Rules, group_overlaps, unreached

CODE = {c: i for i, c in enumerate("ACGT")}


def changed(rng, s, n, gaps=True):
    s = list(s)
    for _ in range(n):
        p, kind = rng.randrange(len(s)), rng.random()
        if kind < 0.6 or not gaps:
            s[p] = rng.choice("ACGT")
        elif kind < 0.8 and len(s) > 1:
            del s[p]
        else:
            s.insert(p, rng.choice("ACGT"))
    return "".join(s)


def some_reads(seed, n, genome=160, least=30, most=70, errors=2, gaps=True):
    rng = random.Random(seed)
    g = "".join(rng.choices("ACGT", k=genome))
    out = []
    for i in range(n):
        size = rng.randrange(least, most)
        at = rng.randrange(0, genome - size)
        out.append((3 * i + 1, changed(rng, g[at : at + size], rng.randrange(0, errors + 1), gaps)))
    return out


def lcs(a, b, band=2):
    best = {}
    for i in range(len(a)):
        for j in range(max(0, i - band), min(len(b), i + band + 1)):
            best[i, j] = max(best.get((i - 1, j), 0), best.get((i, j - 1), 0), best.get((i - 1, j - 1), 0) + (a[i] == b[j]))
    return max(best.values(), default=0)


def alike(x, y, percent):
    low = lambda s: s[3:4] in ("C", "T") and s[3:4] != ""
    if x[:3] != y[:3] or low(x) != low(y) or x[-3:] != y[-3:]:
        return False
    bits = sum((CODE[p] ^ CODE[q]).bit_count() for p, q in zip(x, y, strict=True))
    return 100 * ((2 * len(x) - bits) // 2) >= percent * len(x)


def brute(reads, k, intervals, rules, pruned, rotations=ROTATIONS, sources=None, targets=None):
    """src, dst: smallest offset."""
    groups = {}
    for i, s in reads:
        places = len(s) - k + 1
        for r in rotations:
            table = str.maketrans("ACGT", r)
            width = -(-places // intervals) if places > 0 else 1
            for a in range(0, places, width):
                at = min(range(a, min(a + width, places)), key=lambda p: (s[p : p + k].translate(table), p))
                groups.setdefault((r, s[at : at + k]), []).append((-at, i, s))
    out = {}
    for members in groups.values():
        members.sort()
        near = {}
        for x, (p, i, s) in enumerate(members):
            for y, (q, j, t) in enumerate(members):
                off = q - p
                if i == j or off < 0 or (pruned and y <= x) or (sources is not None and i not in sources) or (targets is not None and j not in targets):
                    continue
                overlap = min(len(s), len(t) + off) - off
                if 100 * off > rules.max_offset_percent * len(s) or overlap < rules.min_overlap or len(t) + off < len(s):
                    continue
                a, b = s[off : off + overlap], t[:overlap]
                if alike(a, b, rules.percent) or (rules.lcs is not None and 100 * lcs(a, b) > rules.lcs * overlap):
                    near[x, y] = off
        if pruned:
            reach = {x: set() for x in range(len(members))}
            for x in reversed(range(len(members))):
                for y in (y for (z, y) in near if z == x):
                    reach[x] |= {y} | reach[y]
            near = {(x, y): off for (x, y), off in near.items() if not any((x, m) in near and y in reach[m] for m in range(len(members)))}
        for (x, y), off in near.items():
            pair = members[x][1], members[y][1]
            out[pair] = min(off, out.get(pair, off))
    return out


def found(df):
    rows = df.collect()
    assert len({(r.src, r.dst) for r in rows}) == len(rows)
    return {(r.src, r.dst): r.off for r in rows}


@pytest.mark.parametrize("pruned", [False, True])
@pytest.mark.parametrize("limits", [{}, {"group": 9, "block": 4}])
def test_groups_against_brute_force(spark, pruned, limits):
    reads = some_reads(5, 40) + [(1000, "A" * 50), (1001, "A" * 50), (1002, "ACGT"), (1003, "")]
    df = spark.createDataFrame([*((*r, "x") for r in reads), (1004, None, "x")], "id bigint, seq string, pos string").repartition(3)
    for rules, k, m in ((Rules(18, 90), 8, 3), (Rules(20, 95, 40, lcs=85), 8, 2)):
        assert (want := brute(reads, k, m, rules, pruned)) and found(group_overlaps(df, k, m, rules, pruned, **limits)) == want
    if pruned:  # chains of several steps were there to prune
        assert len(want) < len(brute(reads, k, m, rules, False))


def test_long_kmers_some_sources_and_nothing(spark):
    reads = some_reads(6, 36, least=50, most=90, errors=1)
    df = spark.createDataFrame(reads, "id bigint, seq string")
    rules = Rules(36, 90)
    assert (want := brute(reads, 35, 3, rules, False)) and found(group_overlaps(df, 35, 3, rules)) == want
    out, into = df.where("id % 2 = 1"), df.where("id % 4 < 2")
    want = brute(reads, 12, 3, rules, True, sources={i for i, _ in reads if i % 2 == 1}, targets={i for i, _ in reads if i % 4 < 2})
    for limits in ({}, {"group": 9, "block": 5}):
        assert found(group_overlaps(df, 12, 3, rules, True, sources=out.select("id"), targets=into.select("id"), **limits)) == want
    assert found(group_overlaps(df.limit(0), 12, 3, rules, True)) == {}


def test_one_kmer_in_all_reads(spark):
    """Reads that all share their minimiser, in blocks: each follows the one before, nothing else stays."""
    rng = random.Random(2)
    g = "".join(rng.choices("CGT", k=40)) + "A" * 12 + "".join(rng.choices("CGT", k=60))
    reads = [(2 * i, g[i : i + 60]) for i in range(40)]
    df = spark.createDataFrame(reads, "id bigint, seq string")
    got = found(group_overlaps(df, 12, 1, Rules(20, 100), True, ("ACGT",), group=8, block=4))
    assert got == {(2 * i, 2 * i + 2): 1 for i in range(39)} == brute(reads, 12, 1, Rules(20, 100), True, ("ACGT",))


@pytest.mark.parametrize("pruned", [False, True])
def test_large_group_some_rows_at_a_time(monkeypatch, pruned):
    """Of a group with more pairs than are tried at a time the same stays as of one that is tried whole; rows of one block are left to another group."""
    rng = random.Random(11)
    g = "".join(rng.choices("ACGT", k=90))
    reads = sorted((at - 20, 20 * n + at, changed(rng, g[at : at + 60], rng.randrange(0, 4), False)) for n in range(12) for at in range(0, 20, 2))
    codes, lengths = packed.base_codes(pa.array([s for *_, s in reads]))
    words, counts = packed.pack(codes, lengths)
    ends = np.concatenate([[0], np.cumsum(counts) * 8])
    blobs = pa.array([words.tobytes()[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)], pa.binary())
    every = np.ones(len(reads), bool)

    def kept(tried, part=None):
        monkeypatch.setattr(kmer_groups, "TRIED", tried)
        t = kmer_groups.Members(np.array([i for _, i, _ in reads]), np.array([-p for p, *_ in reads]), lengths, every, every, blobs, part)
        rows = [tuple(r.values()) for b in kmer_groups._in_groups(t, np.zeros(len(reads), np.int64), Rules(20, 70), pruned) for r in b.to_pylist()]
        assert len(set(rows)) == len(rows)
        return set(rows)

    whole = kept(1 << 20)
    assert len(whole) > 100 and all(kept(n) == whole for n in (1, 500, 3000))
    if not pruned:
        part = np.arange(len(reads)) % 2
        assert kept(500, part) == {r for r in whole if (part_of := {i: p for (_, i, _), p in zip(reads, part, strict=True)})[r[0]] != part_of[r[1]]}


@pytest.mark.parametrize("pruned", [False, True])
def test_no_call_for_each_two_places_of_a_kmer(spark, pruned):
    """A k-mer of 1,100 reads at many places took thousands of calls; now it is one group, with the same overlaps."""
    rng = random.Random(12)
    g = ["".join(rng.choices("CGT", k=40)) + "A" * 12 + "".join(rng.choices("CGT", k=40)) for _ in range(50)]
    reads = [(40 * a + i, x[i : i + 60]) for a, x in enumerate(g) for i in range(22)]
    out = group_overlaps(spark.createDataFrame(reads, "id bigint, seq string"), 12, 1, Rules(20, 100), pruned, ("ACGT",))
    assert "CoGroups" not in out._jdf.queryExecution().toString()
    inside = {(40 * a + i, 40 * a + j): j - i for a in range(50) for i in range(22) for j in ((i + 1,) if pruned else range(i + 1, 22)) if j < 22}
    assert {k: v for k, v in found(out).items() if k[0] // 40 == k[1] // 40} == inside


def test_unreached_of_random_graphs():
    rng = random.Random(8)
    for _ in range(300):
        m = rng.randrange(2, 12)
        edges = sorted({tuple(sorted(rng.sample(range(m), 2))) for _ in range(rng.randrange(1, 30))})
        near = np.zeros((m, m), int)
        near[tuple(zip(*edges, strict=True))] = 1
        reach = near.copy()
        for _ in range(m):
            reach |= (reach @ near > 0).astype(int)
        assert unreached(np.array([a for a, _ in edges]), np.array([b for _, b in edges])).tolist() == [not (near @ reach)[a, b] for a, b in edges]


def test_packed_words():
    rng = random.Random(3)
    seqs = ["".join(rng.choices("ACGT", k=rng.randrange(0, 140))) for _ in range(200)]
    codes, lengths = packed.base_codes(pa.array(seqs))
    words, counts = packed.pack(codes, lengths)
    starts = np.cumsum(counts) - counts
    for t, s in enumerate(seqs):
        for p in range(0, len(s), 5):
            x = int(packed.at(words, starts[t : t + 1], np.array([p]))[0])
            assert "".join("ACGT"[x >> 2 * q & 3] for q in range(len(s[p : p + 32]))) == s[p : p + 32]
    for k, m in ((5, 3), (31, 1), (33, 2), (62, 3), (100, 1)):
        of, pos, values = packed.minimizers(codes, lengths, k, m)
        got = [(int(t), int(p), [int(v[q]) for v in values]) for q, (t, p) in enumerate(zip(of, pos, strict=True))]
        want = []
        for t, s in enumerate(seqs):
            places = len(s) - k + 1
            width = -(-places // m) if places > 0 else 1
            for a in range(0, places, width):
                at = min(range(a, min(a + width, places)), key=lambda p: (s[p : p + k], p))
                word = [s[at : at + k][w : w + 31] for w in range(0, k, 31)]
                want.append((t, at, [int("".join(str(CODE[c]) for c in x), 4) for x in word]))
        assert got == want


def test_banded_lcs(spark):
    rng = random.Random(4)
    pairs = [(s := "".join(rng.choices("ACGT", k=rng.randrange(1, 60))), changed(rng, s, rng.randrange(0, 6))) for _ in range(200)]
    pairs += [("", ""), ("A", ""), ("", "ACGT"), (None, "A"), ("A", None), ("ACGTACGT", "TTTT"), ("ACGT" * 500, "CGT" + "ACGT" * 500)]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "id int, a string, b string").repartition(3)
    for band in (0, 1, 2, 5):
        got = {r.id: r.n for r in df.select("id", fn.banded_lcs(F.col("a"), F.col("b"), band).alias("n")).collect()}
        assert got == {i: None if a is None or b is None else lcs(a, b, band) for i, (a, b) in enumerate(pairs)}
    got = {r.id for r in df.where(fn.alike_by_lcs(F.col("a"), F.col("b"))).collect()}
    assert got == {i for i, (a, b) in enumerate(pairs) if a and b is not None and 100 * lcs(a, b) > 95 * len(a)}


def test_overlaps_with_missing_bases(spark):
    """The second branch takes overlaps that bits can't: a base is missing in the middle."""
    rng = random.Random(9)
    g = "".join(rng.choices("ACGT", k=120))
    reads = [(1, g[:80]), (3, g[10:50] + g[51:95])]
    df = spark.createDataFrame(reads, "id bigint, seq string")
    args = (df, 12, 3, 30, 95)
    assert found(approximate.approximate_overlaps(*args)) == {}
    assert set(found(approximate.approximate_overlaps(*args, lcs=95))) == {(1, 3)}


def test_prefix_hashes(spark):
    rng = random.Random(5)
    seqs = ["".join(rng.choices("ACGT", k=rng.randrange(0, 90))) for _ in range(60)] + [None, "", "A" * 3000]
    df = spark.createDataFrame(list(enumerate(seqs)), "id int, seq string").withColumn("h", fn.prefix_hashes(F.col("seq")))
    value = lambda s: [v := 0, *[v := (v * fn.HASH_BASE + CODE[c] + 1) % fn.HASH_MODULUS for c in s]]
    assert {r.id: r.h for r in df.collect()} == {i: None if s is None else value(s) for i, s in enumerate(seqs)}
    parts = df.where("length(seq) > 0").withColumn("i", F.expr("length(seq) div 3")).withColumn("n", F.expr("length(seq) - i - length(seq) div 5"))
    for r in parts.select("seq", "i", "n", fn.substring_hash("h", "i", "n").alias("v")).collect():
        assert r.v == value(r.seq[r.i : r.i + r.n])[-1]


@pytest.mark.parametrize("size", [1, 63, 64, 65, 130, 200])
def test_bit_sets(spark, size):
    rng = random.Random(size)
    rows = [([p for p in range(size) if rng.random() < d], [p for p in range(size) if rng.random() < 0.4], rng.randrange(0, size + 3), rng.randrange(0, size), rng.randrange(0, size)) for d in (0, 0.05, 0.5, 0.97, 1) for _ in range(3)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id int, p array<int>, q array<int>, k int, x int, y int")
    df = df.select("id", "k", F.least("x", "y").alias("lo"), F.greatest("x", "y").alias("hi"), bitsets.from_places("p", size).alias("a"), bitsets.from_places("q", size).alias("b"))
    shown = {
        "both": bitsets.both("a", "b"), "either": bitsets.either("a", "b"), "one_of": bitsets.one_of("a", "b"), "none_of": bitsets.none_of("a", size), "down": bitsets.moved_down("a", "k"), "up": bitsets.moved_up("a", "k", size),
        "with": bitsets.with_range("a", "lo", "hi", True, size), "without": bitsets.with_range("a", "lo", "hi", False, size), "flipped": bitsets.flipped("a", "lo", "hi", size),
    }
    df = df.select("*", *[c.alias(n) for n, c in shown.items()])
    df = df.select("id", "lo", "hi", "k", *[bitsets.places(n).alias(n) for n in ("a", *shown)], *[bitsets.text(n, size).alias(f"{n}_text") for n in ("none_of", "up")], bitsets.holds("a", "hi").alias("holds"), bitsets.size_of("a").alias("n"), bitsets.size_between("a", "lo", "hi").alias("between"), bitsets.first_from("a", "k").alias("first"), bitsets.first_after("a", "hi").alias("after"), bitsets.first_difference("a", "b").alias("differ"))
    for r in df.collect():
        p, q, k, x, y = rows[r.id]
        a, b, every, lo, hi = set(p), set(q), set(range(size)), min(x, y), max(x, y)
        part = set(range(lo, hi + 1))
        assert r.a == p and r.n == len(p)
        want = {"both": a & b, "either": a | b, "one_of": a ^ b, "none_of": every - a, "down": {z - k for z in a if z >= k}, "up": {z + k for z in a if z + k < size}, "with": a | part, "without": a - part, "flipped": a ^ part}
        assert {n: r[n] for n in want} == {n: sorted(v) for n, v in want.items()}
        assert r.none_of_text == "".join("01"[z not in a] for z in range(size)) and r.up_text == "".join("01"[z in want["up"]] for z in range(size))
        assert (r.holds, r.between) == (hi in a, len(a & part))
        assert (r.first, r.after, r.differ) == (min((z for z in a if z >= k), default=-1), min((z for z in a if z > hi), default=-1), min(a ^ b, default=-1))
