"""Files, cleaning, sequence functions, statistics, correction."""

import collections
import math
import random
import struct

import pytest
from pyspark.sql import functions as F

from readloom.config import Params, derive
from readloom.functions import sequences as fn
from readloom.operators import clean, correct, stats
from readloom.sources import reads as sources
from readloom.sources import sinks


def rc(s):
    return s[::-1].translate(str.maketrans("ACGT", "TGCA"))


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column).first()[0]


@pytest.fixture(scope="module")
def seqs():
    rng = random.Random(1)
    return ["".join(rng.choices("ACGT", k=rng.randrange(1, 60))) for _ in range(60)] + ["AC" * 20, "A" * 21, "ACGT", "GATTACA" * 5 + "GA"]


def test_formats():
    assert [sources.format_of(x) for x in ("a.fasta", "a.pfasta", "b.c.fastq", "x.fq", "x.fa", "noext")] == ["fasta", "pfasta", "fastq", "fastq", "tokens", "tokens"]


def write(path, text):
    path.write_text(text)
    return str(path)


def records(df):
    return [tuple(r) for r in df.orderBy(*df.columns[:-1]).collect()]


def test_scans(spark, tmp_path):
    assert records(sources.read_sequences(spark, write(tmp_path / "a.fasta", ">x\nACGT\n>y\nGG\n"))) == [(0, "ACGT"), (1, "GG")]
    assert records(sources.read_sequences(spark, write(tmp_path / "a.fastq", "@x\nACGT\n+\n@@@@\n@y\nGGTT\n+\n@III\n"))) == [(0, "ACGT"), (1, "GGTT")]
    assert records(sources.read_sequences(spark, write(tmp_path / "a.pfasta", ">1\nA\n>2\nC\n>3\nG\n>4\nT\n"))) == [(0, 0, "A"), (0, 1, "C"), (1, 0, "G"), (1, 1, "T")]
    assert records(sources.read_sequences(spark, write(tmp_path / "a.txt", "ACGT  GG\n\n TT\n"))) == [(0, "ACGT"), (1, "GG"), (2, "TT")]
    assert records(sources.read_sequences(spark, write(tmp_path / "empty.fasta", ""))) == []
    big = "".join(f">r{i}\n{'ACGT' * (i % 7 + 1)}\n" for i in range(5000))
    path = write(tmp_path / "big.fasta", big)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        got = records(sources.read_sequences(spark, path))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == [(i, "ACGT" * (i % 7 + 1)) for i in range(5000)]


def test_pairs(spark, tmp_path):
    a, b = (spark.createDataFrame(x, "rn bigint, raw string") for x in ([(0, "A"), (1, "C"), (2, "G")], [(0, "T"), (1, "TT")]))
    pairs = sources.pair_files(a, b)
    assert sorted(map(tuple, pairs.collect())) == [(0, "A", "T"), (1, "C", "TT"), (2, "G", None)]
    raw = clean.pairs_to_raw(pairs)
    assert sorted(map(tuple, raw.collect())) == [(0, "A"), (1, "T"), (2, "C"), (3, "TT"), (4, "G")]
    mates = {r.id: r.mate_id for r in clean.with_mates(clean.both_strands(raw.select("rn", F.col("raw").alias("seq")))).collect()}
    assert mates == {0: 2, 1: 3, 2: 0, 3: 1, 4: 6, 5: 7, 6: 4, 7: 5, 8: None, 9: None}


def test_graph_files(spark, tmp_path):
    edges = [(0, 1, 5), (0, 2, 7), (2, 1, 3)]
    raw = struct.pack("<I", 3) + struct.pack("<ii4i", 0, 2, 1, 5, 2, 7) + struct.pack("<ii", 1, 0) + struct.pack("<ii2i", 2, 1, 1, 3)
    (tmp_path / "g.bin").write_bytes(raw)
    assert sorted(map(tuple, sources.read_graph(spark, str(tmp_path / "g.bin")).collect())) == edges
    df = spark.createDataFrame(edges, "src bigint, dst bigint, off int")
    sinks.save_graph(df, str(tmp_path / "g"))
    assert sorted(map(tuple, sources.read_graph(spark, str(tmp_path / "g")).collect())) == edges
    many = sorted({(i % 40, (7 * i) % 97 + 40, i % 9) for i in range(400)} | {(3, k, 1) for k in range(200, 500)})
    made = spark.createDataFrame(many, "src bigint, dst bigint, off int").repartition(4)
    sinks.save_graph_binary(made, str(tmp_path / "many.bin"))
    (tmp_path / "many.bin" / "part-000000-99999.records").write_bytes(b"left by a lost task")
    assert sorted(map(tuple, sources.read_graph(spark, str(tmp_path / "many.bin")).collect())) == many
    files = spark.read.parquet(str(tmp_path / "many.bin" / "index")).collect()
    assert sum(r.nodes for r in files) == len({x for e in many for x in e[:2]})
    sinks.save_graph_binary(made.limit(0), str(tmp_path / "none.bin"))
    assert sources.read_graph(spark, str(tmp_path / "none.bin")).collect() == []
    with pytest.raises(Exception, match="32 bits"):
        sinks.save_graph_binary(made.withColumn("dst", F.col("dst") + (1 << 31)), str(tmp_path / "wide.bin"))


def test_cleaning(spark):
    p = Params()
    rows = [(0, "  AAACCCGGGTTTACGATTAGCATCGGACTTAGG tail"), (1, "ACGTACGTACGTACG"), (2, "NACGATTAGCATCGGACTTAGCATTTGN"), (3, "AAANCGATTAGCATCGGACTTAGCATTTG"), (4, "ACG" * 12), (5, ""), (6, "  ")]
    raw = spark.createDataFrame(rows, "rn bigint, raw string")
    prepared = {r.rn: r.seq for r in clean.prepared(raw, p).collect()}
    assert prepared == {0: "CCCGGGTTTACGATTAGCATCGGACTT", 1: "ACGTACGTACGTACG", 2: "GATTAGCATCGGACTTAGCATT", 3: "NCGATTAGCATCGGACTTAGCAT", 4: ("ACG" * 12)[3:-3]}
    got = {r.id: r.seq for r in clean.clean(raw, p).collect()}
    assert got == {1: prepared[0], 0: rc(prepared[0]), 5: prepared[2], 4: rc(prepared[2])}
    filled = {r.rn: r.seq for r in clean.valid(clean.prepared(raw, p), Params(drop_n=False)).collect()}
    assert set(filled) == {0, 2, 3} and filled[3][1:] == prepared[3][1:] and filled[3][0] in "ACGT"
    with pytest.raises(Exception, match="not a sequence"):
        clean.prepared(spark.createDataFrame([(0, "acgtacgtacgtacgtacgtacgt")], "rn bigint, raw string"), p).collect()
    rna = clean.prepared(spark.createDataFrame([(0, "AAAUUGCAUUGCACCC")], "rn bigint, raw string"), Params(rna=True)).first()
    assert rna.seq == "TTGCATTGCA"


def test_duplicates_and_contained(spark):
    base = "ACGATTAGCATCGGACTTAGCATTTGGCATACC"
    seqs = [base, base, base[:25], base[5:], "ACGT" * 6 + "ACGT", "TTTGCGCAATTACCGGATACCGTAG", rc(base[:25])]
    forward = [(2 * i + 1, s) for i, s in enumerate(seqs)]
    reads = spark.createDataFrame(forward + [(i - 1, rc(s)) for i, s in forward], "id bigint, seq string")
    distinct = {}
    for i, s in sorted(forward + [(i - 1, rc(s)) for i, s in forward]):
        distinct[s] = i
    assert {r.seq: r.id for r in clean.dedup(reads).collect()} == distinct
    inside = {i for s, i in distinct.items() if any(t != s and t.startswith(s) for t in distinct)}
    assert {r.id for r in clean.contained_in_longer(clean.dedup(reads)).collect()} == inside
    gone = inside | {i ^ 1 for i in inside} | {i for i, s in forward + [(i - 1, rc(s)) for i, s in forward] if s == rc(s)}
    assert {r.id for r in clean.drop_contained(reads).collect()} == set(distinct.values()) - gone


def test_functions(spark, seqs):
    df = spark.createDataFrame([(s,) for s in seqs], "s string")
    period = lambda s: next(p for p in range(1, len(s) + 1) if s.startswith(s[p:]))
    rotation = lambda s: min(range(len(s)), key=lambda i: (s[i:] + s[:i], i))
    rows = df.select("s", fn.reverse_complement(F.col("s")).alias("rc"), fn.min_period("s").alias("p"), fn.has_period("s", 20).alias("short"), fn.min_rotation("s").alias("r"), fn.kmers("s", 5).alias("k")).collect()
    for r in rows:
        assert (r.rc, r.p, r.short, r.r) == (rc(r.s), period(r.s), period(r.s) <= 20, rotation(r.s)), r.s
        assert r.k == [r.s[i : i + 5] for i in range(len(r.s) - 4)]
    short = df.where("length(s) <= 31").select("s", fn.pack("s").alias("n"))
    for r in short.collect():
        n = 0
        for c in r.s:
            n = 4 * n + "ACGT".index(c)
        assert r.n == n
    assert one(spark, fn.unpack("n", 6), n=27) == "AAACGT"
    assert one(spark, fn.occurrences("s", "p"), s="AAAA", p="AA") == [0, 1, 2] and one(spark, fn.occurrences("s", "p"), s="A", p="AA") == []
    for a, b in (("ACGT", "ACGT"), ("", "A"), ("ACG", "ACGTT"), ("ACGA", "ACGT"), ("T", "A")):
        assert one(spark, fn.common_prefix("a", "b"), a=a, b=b) == len(__import__("os").path.commonprefix([a, b]))
    assert [one(spark, fn.base_code(F.col("c")), c=c) for c in "ACGTN"] == [0, 1, 2, 3, -1]
    assert [one(spark, fn.code_base(F.col("c")), c=c) for c in (0, 3, 9)] == ["A", "T", "N"]
    assert one(spark, fn.overlap_length(F.col("a"), F.col("b"), F.col("o")), a=60, b=50, o=15) == 45 and one(spark, fn.right_offset(F.col("a"), F.col("b"), F.col("o")), a=60, b=50, o=15) == 5
    assert one(spark, fn.to_rna(fn.to_dna(F.col("a"))), a="UUTA") == "UUUA"


def test_bit_similarity(spark, seqs):
    assert one(spark, fn.differing_bits("a", "b"), a="ACGTA", b="TCGAG") == 5
    base = "ACGTTGCATGCATTAGCATC" * 5

    def change(at, c):
        return base[:at] + c + base[at + 1 :]

    for b, expected in ((base, True), (change(50, "A"), True), (change(0, "C"), False), (change(3, "A"), False), (change(3, "C"), True), (change(98, "A"), False), (base[:40] + "TTTTTTTTTTTT" + base[52:], False)):
        assert one(spark, fn.similar("a", "b", 95), a=base, b=b) is expected, b
    for a, b, n in (("ACGT", "ACGT", 4), ("ACGTAC", "CGTACG", 5), ("", "A", 0)):
        assert one(spark, fn.banded_lcs(F.col("a"), F.col("b")), a=a, b=b) == n
    assert one(spark, fn.alike_by_lcs(F.col("a"), F.col("b")), a=base, b=base[1:] + "A") is True


def test_parameters():
    p = derive(Params(), 60.0)
    assert (p.min_overlap, p.transitive_from, p.min_contig, p.max_parallel_offset, p.kmer) == (36, 51, 200, 250, 24)
    assert derive(Params(min_overlap=40), 60.0).transitive_from == 53 and derive(Params(), 0).min_contig == 200


def test_statistics(spark, seqs):
    df = spark.createDataFrame([(s,) for s in seqs], "seq string")
    n = sorted(map(len, seqs))
    r = stats.full_statistics(df).first()
    mean = sum(n) / len(n)
    assert (r.n, r.total, r.least, r.most, r.median, r.squares) == (len(n), sum(n), n[0], n[-1], n[len(n) // 2], sum(x * x for x in n))
    assert r.average == pytest.approx(mean) and r.stddev == pytest.approx(math.sqrt(sum((x - mean) ** 2 for x in n) / len(n)))
    values = df.select(F.length("seq").alias("value"), F.lit("a").alias("name"))
    m = stats.moments(values).first()
    assert m.n == len(n) and m.stddev == pytest.approx(r.stddev)
    kept = stats.trimmed(values, "value", 5, 7).collect()
    assert sorted(x for v, c in kept for x in [v] * c) == n[5 : len(n) - 7]
    assert stats.length_statistics(df.limit(0)).first().n == 0
    unknown = spark.createDataFrame([("ANNA",), ("ACGT",), ("A" * 11 + "N" + "C" * 12,)], "seq string")
    assert {r.unknown: (r.reads, r.both) for r in stats.unknown_histogram(unknown).collect()} == {2: (1, 2), 0: (1, 2), 1: (1, 2)}
    c = stats.filter_counters(unknown, 20).first()
    assert (c.reads, c.with_n, c.periodic, c.kept, c.inner_n) == (3, 2, 1, 0, 1)


def test_correction(spark):
    rng = random.Random(4)
    genome = "".join(rng.choices("ACGT", k=300))
    reads = [genome[i : i + 80] for i in range(0, 220, 4)]
    wrong = list(reads)
    for i in range(5, len(reads), 11):
        at = 3 if i % 2 else 40
        wrong[i] = reads[i][:at] + rc(reads[i][at]) + reads[i][at + 1 :]
    df = spark.createDataFrame(list(enumerate(wrong)), "id bigint, seq string")
    fixed = {r.id: r.seq for r in correct.correct(df).collect()}
    errors = sum(a != b for a, b in zip(wrong, reads, strict=True))
    assert errors >= 4 and sum(fixed[i] != s for i, s in enumerate(reads)) == 0
    known = {(r.big, r.small): r.n for r in correct.context_frequencies(df).collect()}
    assert all(n >= 2 for n in known.values())


def test_contig_files(spark, tmp_path):
    contigs = spark.createDataFrame([(1, "ACGT"), (0, "GGTTT")], "id bigint, seq string")
    sinks.write_contigs(contigs, str(tmp_path / "c"), files=1)
    assert "".join(p.read_text() for p in sorted((tmp_path / "c").glob("part*"))) == ">contig_id=0_length=5\nGGTTT\n>contig_id=1_length=4\nACGT\n"
    sinks.write_read_pair(spark.createDataFrame([(0, "A"), (1, "T"), (2, "C"), (3, "G")], "id bigint, seq string"), str(tmp_path / "r1"), str(tmp_path / "r2"))
    assert "T" in "".join(p.read_text() for p in (tmp_path / "r1").glob("part*")) and "G" in "".join(p.read_text() for p in (tmp_path / "r2").glob("part*"))
    assert sinks.contig_lines(contigs, rna=True).where("id = 0").first().value.endswith("GGUUU")


def test_whole_reads_are_packed_and_all_orders_propose(spark, monkeypatch):
    import random

    from readloom.plans import fixtures, queries

    rng = random.Random(4)
    base = "".join(rng.choices("ACGT", k=400))
    seqs = [base[i : i + 80] for i in range(0, 300, 7)]
    seqs = ["".join(rng.choice("ACGT") if rng.random() < 0.03 else c for c in s) for s in seqs]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(seqs)], "id bigint, seq string")
    monkeypatch.setattr(fixtures, "reads", lambda *_: df.unionByName(spark.createDataFrame([(1000, ""), (1001, "T" * 31), (1002, "GA" * 16)], "id bigint, seq string")))
    monkeypatch.setattr(fixtures, "error_reads", lambda *_: df)
    want = dict(enumerate(seqs)) | {1000: "", 1001: "T" * 31, 1002: "GA" * 16}
    rows = queries.QUERIES["packed_reads"](spark, "").collect()
    assert {r.id: r.back for r in rows} == want
    for r in rows:
        assert [int(x) for x in r.codes.split(",") if x] == [int("".join(str("ACGT".index(c)) for c in want[r.id][p : p + 31]), 4) for p in range(0, r.n, 31)]

    def least(s, order):  # (place, 20-mer) of each third of the places
        places = len(s) - 19
        width = -(-places // 3)
        return {(p, s[p : p + 20]) for a in range(0, places, width) for p in [min(range(a, min(a + width, places)), key=lambda p: (s[p : p + 20].translate(str.maketrans("ACGT", order)), p))]}

    found = {1: set(), 4: set()}
    for n, orders in ((1, ("ACGT",)), (4, ("ACGT", "CGTA", "GTAC", "TACG"))):
        for o in orders:
            m = [least(s, o) for s in seqs]
            found[n] |= {(i, j, p - q) for i, x in enumerate(m) for j, y in enumerate(m) if i != j for p, a in x for q, b in y if a == b and p >= q and 80 - (p - q) >= queries.L}
    assert len(found[4]) > len(found[1])
    assert {tuple(r) for r in queries.QUERIES["approx_candidates"](spark, "").collect()} == found[4]
    pairs = {(r.src, r.dst): r.off for r in queries.QUERIES["low_error_alignments"](spark, "").collect()}
    from readloom.operators import approximate

    apart = approximate.low_error_alignments(approximate.approximate_candidates(df, 20, 3, queries.L), df, 95)
    assert pairs == {(r.src, r.dst): r.off for r in apart.collect()} and set(pairs) <= {x[:2] for x in found[4]}


def test_neighbours_across_ranges(spark, seqs):
    from readloom.operators import order

    reads = [(i, s) for i, s in enumerate(seqs)] + [(900, "AAC"), (901, "AACG"), (902, "G"), (903, "TT"), (904, "TT")]
    key = lambda r: (r[1].translate(str.maketrans("AGCT", "ABCD")), len(r[1]), r[0])
    line = sorted(reads, key=key)
    want = {}
    for a, b in zip(line, [*line[1:], (None, "")], strict=True):
        want[a[0]] = next((k for k in range(min(len(a[1]), len(b[1]))) if a[1][k] != b[1][k]), min(len(a[1]), len(b[1])))
    assert {r.id: r.lcp for r in order.neighbour_lcp(spark.createDataFrame(reads, "id bigint, seq string")).collect()} == want


def test_numbers_theory(spark):
    import math

    from readloom.functions import numbers

    pairs = [(a, b) for a in range(0, 30) for b in range(1, 25)]
    df = spark.createDataFrame(pairs, "a bigint, b bigint").select("a", "b", numbers.gcd("a", "b").alias("g"), numbers.inverse("a", "b").alias("i"))
    for r in df.collect():
        assert r.g == math.gcd(r.a, r.b)
        assert r.i == (pow(r.a, -1, r.b) if r.g == 1 else -1)
    below = spark.range(2, 300).select("id", numbers.lower_prime("id").alias("p")).collect()
    prime = lambda n: n > 1 and all(n % k for k in range(2, int(n**0.5) + 1))
    assert {r.id: r.p for r in below} == {n: max((k for k in range(2, n) if prime(k)), default=None) for n in range(2, 300)}


def test_correction_counts_neighbours_before_a_shuffle_and_equals_brute_force(spark):
    """Every place was a row of the shuffle, and met the counts again in a join."""
    rng = random.Random(9)
    genome = "".join(rng.choices("ACGT", k=4000))
    reads = {2 * i + 1: genome[p : p + 80] for i, p in enumerate(range(0, 3920, 10))}
    reads |= {i: s[: 10 + i % 40] + rng.choice("ACGT") + s[11 + i % 40 :] for i, s in reads.items() if i % 3 == 0}
    reads |= {90_001: "A" * 34, 90_003: genome[:34] + "N" + genome[35:80], 90_005: genome[:35]}
    df = spark.createDataFrame(list(reads.items()), "id bigint, seq string").repartition(7)

    def once(now):
        places = [(i, k, s[k + 5 : k + 35], s[k : k + 5]) for i, s in now.items() for k in range(len(s) - 34)]
        n = collections.Counter((big, small) for _, _, big, small in places)
        by = collections.defaultdict(list)
        for (big, small), c in n.items():
            if c > 1:
                by[big].append((c, small))
        found = {}
        for i, k, big, have in places:
            options = [(c, small, [x for x in range(5) if small[x] != have[x]]) for c, small in by[big]]
            fit = [(c, small, d[0]) for c, small, d in options if len(d) == 1 and (k == 0 or 0 < d[0] < 4)]
            if fit and n[big, have] == 1:
                c, small, at = max(fit)
                found[i, k + at] = max(found.get((i, k + at), (0, "")), (c, small[at]))
        return {i: "".join(found.get((i, k), (0, c))[1] for k, c in enumerate(s)) for i, s in now.items()}, {b: c for b, c in n.items() if c > 1}

    forward, counts = once(reads)
    back = {i: rc(s) for i, s in once({i: rc(s) for i, s in forward.items()})[0].items()}
    assert {(r.big, r.small): r.n for r in correct.context_frequencies(df).collect()} == counts
    assert {r.id: r.seq for r in correct.correct(df).collect()} == back != reads
    assert "Generate" not in correct.context_frequencies(df)._jdf.queryExecution().executedPlan().toString()


def test_a_pair_of_files_makes_its_reads_once(spark, tmp_path):
    """They were made four times, for the sample and for the sort of either file."""
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    reads = spark.range(0, 400, 1, 4).selectExpr("id", "repeat('AC', 20) as seq").mapInArrow(count, "id bigint, seq string")
    sinks.write_read_pair(reads, str(tmp_path / "1.fasta"), str(tmp_path / "3.fasta"))
    assert seen.value == 400
    assert [sources.read_sequences(spark, str(tmp_path / f"{k}.fasta")).count() for k in (1, 3)] == [100, 100]
