"""Exact overlaps from the least k-mers of ends and beginnings, against plain Python."""

import random
from dataclasses import replace

import pytest

from readloom.config import Params, derive
from readloom.operators import overlap, seeds


def rc(s):
    return s[::-1].translate(str.maketrans("ACGT", "TGCA"))


def brute(reads, n, most):
    return sorted((a, b, o, len(x) - o) for a, x in reads for b, y in reads if a != b for o in range(max(0, len(x) - most), len(x) - n + 1) if y.startswith(x[o:]))


def some_reads(seed, letters="ACGT"):
    """Windows of random, repetitive and palindromic genomes, of several lengths, both strands."""
    rng = random.Random(seed)
    half = "".join(rng.choices(letters, k=60))
    genomes = ["".join(rng.choices(letters, k=200)), "".join(rng.choices(letters, k=7)) * 20, half + rc(half), "ACCT" * 10 + "".join(rng.choices(letters, k=40)) + "AGGT" * 10, "A" * 70 + "C" * 50]
    found = sorted({g[i : i + k] for g in genomes for k in (30, 41) for i in range(0, len(g) - k, rng.choice([3, 4]))})
    one = [s for s in found if s != rc(s) and (s < rc(s) or rc(s) not in found)]
    return [(2 * i + 1, s) for i, s in enumerate(one)] + [(2 * i, rc(s)) for i, s in enumerate(one)]


@pytest.mark.parametrize("letters", ["ACGT", "ACGTN"])
@pytest.mark.parametrize("hot", [False, True])
def test_overlaps_of_repetitive_reads_equal_brute_force(spark, monkeypatch, letters, hot):
    if hot:
        monkeypatch.setattr(seeds, "HOT", 0)
        monkeypatch.setattr(seeds, "TRIED", 16)
    for n, most in ((12, 500), (17, 33), (26, 500), (1, 500)) if letters == "ACGT" and not hot else ((17, 33),):
        p = replace(derive(Params(), 41.0), min_overlap=n, max_overlap=most)
        rows = some_reads(n, letters)[:: 4 if n == 1 else 1]
        df = spark.createDataFrame([*rows, (10**6, None), (10**6 + 2, "ACG")] if n > 3 else rows, "id bigint, seq string")
        want = brute(rows, n, most)
        got = lambda **k: sorted(tuple(r) for r in overlap.candidates(df, p, **k).select("src", "dst", "off", "ov").collect())
        assert got() == want and want
        if n > 1:
            assert got(paired=True) == want
            some = dict(sources=lambda i: i % 4 == 1, targets=lambda i: i % 3 > 0)
            assert got(paired=True, **some) == got(**some) == [x for x in want if x[0] % 4 == 1 and x[1] % 3 > 0]
            table = spark.createDataFrame([(r[0],) for r in rows[:9]], "id bigint")
            assert got(sources=table) == [x for x in want if x[0] in {r[0] for r in rows[:9]}]


def test_a_read_has_few_rows_whatever_the_lengths_of_its_overlaps(spark):
    """It had a row for each length that an overlap may have, 34 of 80 bases (F20, F5, F9, F23)."""
    rng = random.Random(1)
    reads = [(2 * i + 1, "".join(rng.choices("ACGT", k=80))) for i in range(500)]
    counted = []

    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"id": [r[0] for r in reads], "seq": [r[1] for r in reads], **{c: [True] * 500 for c in ("s", "t", "s2", "t2")}})
    for paired in (False, True):
        counted.append(seeds._rows_of(batch, 25, 47, 500, paired).num_rows / 500)
    assert max(counted) < 3.5


def test_a_frequent_kmer_does_not_try_all_its_pairs(spark, monkeypatch):
    """300 reads that end with one part and 300 that begin with it, of which few overlap."""
    rng = random.Random(2)
    part = "".join(rng.choices("ACGT", k=26))
    word = lambda k: "".join(rng.choices("ACGT", k=k))
    rows = [(2 * i + 1, word(54) + part if i % 2 else part + word(54)) for i in range(600)] + [(2001, word(30) + part + "ACG" * 8), (2003, part + "ACG" * 8 + word(30))]
    tried = [0]
    real = seeds._Rows.overlapping
    monkeypatch.setattr(seeds, "TRIED", 1 << 10)
    monkeypatch.setattr(seeds._Rows, "overlapping", lambda self, i, j: (tried.__setitem__(0, tried[0] + len(i)), real(self, i, j))[1])
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"id": [r[0] for r in rows], "seq": [r[1] for r in rows], **{c: [True] * len(rows) for c in ("s", "t", "s2", "t2")}})
    table = pa.Table.from_batches([seeds._rows_of(batch, 25, 27, 500, False)]).sort_by([("key", "ascending"), ("meta", "ascending")])
    found = [tuple(x.values())[:4] for b in seeds._Rows(table, 27, 500, False).found() for x in b.to_pylist()]
    assert sorted(found) == brute(rows, 27, 500) and (2001, 2003, 30, 50) in found
    assert tried[0] < 10_000


@pytest.mark.parametrize("letters", ["ACGT", "ACGTN"])
def test_edges_by_source_equal_those_of_sequences(spark, letters):
    """Transitive edges are told by a read's own overlaps; drop_transitive compares sequences."""
    for n, most, large in ((12, 500, 20), (17, 33, 25)) if letters == "ACGT" else ((17, 500, 22),):
        p = replace(derive(Params(), 41.0), min_overlap=n, max_overlap=most, transitive_from=large)
        df = spark.createDataFrame(some_reads(n, letters), "id bigint, seq string")
        cand = overlap.candidates(df, p).cache()
        big = cand.where(cand.ov >= large)
        want = sorted(tuple(r) for r in overlap.drop_transitive(overlap.smallest_offset(big.unionByName(overlap.top_small(cand, p))), big, df).collect())
        for paired in (False, True):
            assert sorted(tuple(r) for r in overlap.overlap_edges(df, p, paired=paired).collect()) == want and want
        plan = overlap.seeds.edges_of(overlap.seeds.overlaps(df.selectExpr("id", "seq", "true as s", "true as t", "false as s2", "false as t2"), n, most, False, rest=True), n, most, large, 3)._jdf.queryExecution().optimizedPlan().toString()
        assert "Join" not in plan


def test_closure_meets_mirror_images_without_joins(spark, monkeypatch):
    """Candidates were made twice and joined with all reads' lengths twice (F9)."""
    from readloom.plans import fixtures, queries

    rng = random.Random(4)
    g = "".join(rng.choices("ACGT", k=300))
    rows = [(2 * i + 1, g[10 * i : 10 * i + 80]) for i in range(23)]
    rows += [(i - 1, rc(s)) for i, s in rows]
    monkeypatch.setattr(fixtures, "reads", lambda *_: spark.createDataFrame(rows, "id bigint, seq string"))
    out = queries.candidate_complement_closure(spark, "")
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    n = len(brute(rows, queries.L, 500))
    assert tuple(out.first()) == (n, 0) and n and "Join" not in plan and plan.count("MapInArrow") == 2
    monkeypatch.setattr(fixtures, "reads", lambda *_: spark.createDataFrame(rows[:-1], "id bigint, seq string"))  # one strand of a read is missing
    c = [x[:3] for x in brute(rows[:-1], queries.L, 500)]
    gone = sum((b ^ 1, a ^ 1, o) not in set(c) for a, b, o in c)
    assert tuple(queries.candidate_complement_closure(spark, "").first()) == (len(c), gone) and gone
