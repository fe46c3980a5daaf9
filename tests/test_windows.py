"""Windows of long texts, and functions of reads that take the strings of a batch together."""

import random
import time

from pyspark.sql import functions as F

from readloom.functions import sequences as fn
from readloom.plans import fixtures


def test_windows_of_a_long_text_cost_no_more_than_those_of_short_ones(spark, tmp_path):
    """A text of a million letters took minutes: each window was looked for from the text's start."""
    rng = random.Random(1)
    letters = "".join(rng.choices("abcdefghijklmnop", k=1_000_000))
    spark.createDataFrame([(1, letters), (2, ""), (3, None), (4, letters[:86]), (5, "é " + letters[:85])], "doc_id bigint, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    start = time.time()
    rows = fixtures.raw_reads(spark, str(tmp_path)).groupBy(F.expr(f"rn div {fixtures.DOC}").alias("d")).agg(F.count("*").alias("n"), F.max("raw").alias("m")).collect()
    assert time.time() - start < 20
    g = letters.translate(str.maketrans(fixtures.LETTERS, fixtures.AS_BASES))
    windows = [g[p : p + 86] for p in range(0, len(g) - 85, 10)]
    assert {r.d: (r.n, r.m) for r in rows} == {1: (len(windows), max(windows)), 4: (1, windows[0])}


def test_functions_of_whole_batches(spark):
    rng = random.Random(2)
    texts = ["".join(rng.choices("ACGTN"[: rng.randint(1, 5)], k=rng.choice([1, 2, 5, 16, 17, 21, 40, 80]))) for _ in range(400)]
    texts += ["ACG" * 27, "A" * 80, "é漢" * 9, "", None]
    heads = [t and t[: rng.randint(0, 4)] for t in texts]
    rows = spark.createDataFrame(list(enumerate(zip(texts, heads, strict=True))), "i int, t struct<s string, h string>").select("i", "t.*")
    got = {r.i: r for r in rows.select("i", fn.min_rotation("s").alias("r"), fn.min_period("s").alias("p"), fn.has_period("s", 20).alias("short"), fn.occurrences("s", "h").alias("o")).collect()}
    for i, (s, h) in enumerate(zip(texts, heads, strict=True)):
        n = len(s or "")
        assert got[i].r == (min((s[k:] + s[:k], k) for k in range(n))[1] if s else None)
        assert got[i].p == (next(p for p in range(1, n + 1) if s.startswith(s[p:])) if s else None)
        assert got[i].short == (None if s is None else any(s.startswith(s[p:]) for p in range(1, 21)))
        assert got[i].o == ([k for k in range(n - len(h) + 1) if s.startswith(h, k)] if h else [])


def test_packed_whole(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choices("ACGT" if i % 3 else "ACGTN", k=rng.choice([1, 2, 30, 31, 32, 62, 80]))) for i in range(200)] + ["", "T" * 80, "A" * 31]

    def codes(s):
        out = []
        for p in range(0, len(s), 31):
            a = 0
            for c in s[p : p + 31]:
                a = a * 4 + "ACGT".find(c)
            out.append(a)
        return out

    df = spark.createDataFrame(list(enumerate(texts)), "i int, s string").withColumn("n", F.length("s")).withColumn("c", fn.pack_whole("s"))
    for r in df.withColumn("b", fn.unpack_whole("c", "n")).collect():
        assert r.c == codes(r.s)
        if "N" not in r.s:
            assert r.b == r.s


def test_reads_of_one_length_meet_no_others(spark):
    """Reads of equal length were joined with each other by their whole sequence."""
    from readloom.operators import clean

    rows = [(1, "ACGTTG"), (0, "CAACGT"), (3, "ACGTTG"), (2, "CAACGT"), (5, "ACGCGT"), (4, "ACGCGT")]
    df = spark.createDataFrame(rows, "id bigint, seq string")
    assert clean.contained_in_longer(df)._jdf.queryExecution().optimizedPlan().toString().count("Join") == 0
    assert {(r.id, r.seq) for r in clean.drop_contained(df).collect()} == {(3, "ACGTTG"), (2, "CAACGT")}


def test_minimizers_of_any_letters(spark):
    """In numbers where reads hold A, C, G, T only, as strings elsewhere: both meet on a k-mer that only one of them has other letters beside. No k-mer is cut out and translated in a lambda any more (F11)."""
    import random

    from readloom.operators import approximate

    rnd = random.Random(5)
    text = "".join(rnd.choice("ACGT") for _ in range(400))
    seqs = [text[i : i + 60] for i in range(0, 300, 7)] + [text[:30] + "N" + text[31:60], text[5:25] + "NN" + text[27:70], "ACG", "", "A" * 20, "N" * 45, text[100:139]]
    df = spark.createDataFrame([*enumerate(seqs), (99, None)], "id bigint, seq string")
    for k, m in ((15, 3), (33, 2)):
        rows = {}
        for r in approximate.ROTATIONS:
            t = str.maketrans("ACGT", r)
            for i, s in enumerate(seqs):
                n = len(s) - k + 1
                w = -(-n // m)
                for a in range(0, n, max(1, w)):
                    q = min(range(a, min(a + w, n)), key=lambda q: s[q : q + k].translate(t))  # noqa: B023
                    rows.setdefault((r, s[q : q + k]), []).append((i, q))
            made = approximate.minimizers(df, k, m, r)
            assert sorted(made.collect()) == sorted((i, q, kmer) for (o, kmer), x in rows.items() if o == r for i, q in x)
        want = {(i, j, p - q) for x in rows.values() for i, p in x for j, q in x if i != j and p >= q and min(len(seqs[i]), len(seqs[j]) + p - q) - (p - q) >= 20 and len(seqs[j]) + p - q >= len(seqs[i])}
        met = approximate.approximate_candidates(df, k, m, 20)
        assert {tuple(r) for r in met.collect()} == want
        assert "transform(" not in met._jdf.queryExecution().toString()


def test_bits_from_text(spark):
    from readloom.functions import bitsets

    texts = ["", "1", "0", "01" * 32, "1" * 64, "0" * 63 + "1", "1" * 65, "0" * 70 + "1" * 10, "10" * 100]
    df = spark.createDataFrame([(t, len(t)) for t in texts] + [(None, 5)], "t string, n int").withColumn("a", bitsets.from_text("t", "n"))
    got = df.select("t", bitsets.text("a", "n").alias("back"), bitsets.places("a").alias("p")).collect()
    assert [r.back for r in got[:-1]] == texts
    assert [r.p for r in got[:-1]] == [[i for i, c in enumerate(t) if c == "1"] for t in texts]


def test_query_of_bit_sets_has_a_step_for_each_word_only(spark, tmp_path):
    """Its sets were put together from places that a lambda found letter by letter (F14)."""
    from readloom.plans import queries

    spark.createDataFrame([(1, "some text of letters " * 9)], "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    plan = queries.bit_sets(spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert "array_append" not in plan and "contains(CT" not in plan


def test_both_strands_of_a_batch_are_turned_together(spark):
    """Each read was turned letter by letter: 40,000 long ones took longer than a batch of them needs."""
    from readloom.operators import clean

    rng = random.Random(6)
    texts = ["".join(rng.choices("ACGTN", k=rng.choice([0, 1, 2, 79, 80]))) for _ in range(3000)] + [None, "", "ACé漢T"]
    df = spark.createDataFrame([*enumerate(texts), (None, "AC")], "rn bigint, seq string").repartition(3)
    got = clean.both_strands(df).collect()
    turned = lambda s: s and s[::-1].translate(str.maketrans("ACGT", "TGCA"))
    want = [x for i, s in [*enumerate(texts), (None, "AC")] for x in ((i if i is None else 2 * i + 1, s), (i if i is None else 2 * i, turned(s)))]
    key = lambda x: (x[0] is None, x[0] or 0, x[1] or "")
    assert sorted(((r.id, r.seq) for r in got), key=key) == sorted(want, key=key)
    assert "Generate" not in clean.both_strands(df)._jdf.queryExecution().executedPlan().toString()


def test_a_level_of_longest_ways_and_a_pass_of_dangling_branches_send_little_to_the_driver(spark, monkeypatch):
    """Three tables were written for each level, and small join sides of all rounds went through the driver."""
    from readloom import checkpoints
    from readloom.operators import chains, simplify

    rows = [(i, i + 1 + k, 10 + k) for i in range(12) for k in (0, 1)]
    e = spark.createDataFrame(rows, "src bigint, dst bigint, off int")
    tables, plans, save = [], [], checkpoints.save
    monkeypatch.setattr(checkpoints, "save", lambda df, *x: (tables.append(1), plans.append(df._jdf.queryExecution().executedPlan().toString()), save(df, *x))[-1])
    best = {r.id: (r.length, r.next) for r in chains.longest_ways(e).collect()}
    want = {12: (0, None), 13: (0, None)}
    for i in reversed(range(12)):
        want[i] = max(((10 + k + want[i + 1 + k][0], i + 1 + k) for k in (0, 1)), key=lambda x: (x[0], -x[1]))
    assert best == want and len(tables) < 2 * 12 + 12
    plans.clear()
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    left = simplify.drop_dangling_fixpoint(e, 60).count()
    assert left and plans and not any("Broadcast" in p for p in plans) and spark.conf.get("spark.sql.autoBroadcastJoinThreshold") == before


def test_lcs_and_hashes_of_one_length_and_of_several(spark):
    """The query computed its common subsequences twice, and hashes went through a list for each read."""
    from readloom.plans import queries

    rng = random.Random(8)
    same = [("".join(rng.choices("ACGT", k=40)), "".join(rng.choices("ACGT", k=40))) for _ in range(60)]
    other = [("".join(rng.choices("ACGT", k=rng.randint(0, 300))), "".join(rng.choices("ACGT", k=rng.randint(0, 300)))) for _ in range(20)] + [("A" * 300, "A" * 300)]

    def lcs(a, b, band=2):
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                if abs(i - j) <= band:
                    best[i][j] = max(best[i - 1][j - 1] + (a[i - 1] == b[j - 1]), best[i - 1][j] if abs(i - 1 - j) <= band else 0, best[i][j - 1] if abs(i - j + 1) <= band else 0)
        return max(map(max, best))

    for pairs in (same, same + other):
        df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)] + [(-1, None, "A")], "i int, a string, b string").coalesce(1)
        got = {r.i: r for r in df.select("i", fn.banded_lcs(F.col("a"), F.col("b")).alias("n"), fn.prefix_hashes(F.col("a")).alias("h")).collect()}
        assert got[-1].n is None and got[-1].h is None
        for i, (a, b) in enumerate(pairs):
            assert got[i].n == lcs(a, b)
            h = [0]
            for c in a:
                h.append((h[-1] * fn.HASH_BASE + "ACGT".index(c) + 1) % fn.HASH_MODULUS)
            assert got[i].h == h
    plan = queries.banded_lcs(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "pythonUDF0" in plan and "pythonUDF1" not in plan


def test_numbers_of_a_batch_take_their_steps_together(spark):
    """The primes under a number were tried one by one, down to its half: 20,000 numbers about 900,000 took hours (F4)."""
    from readloom.functions import numbers

    near = [2**24 - 1, 2**24, 2**24 + 1, 2**24 + 44, 2**31, 2**40, 2**61, 2**63 - 1]
    values = [*range(-3, 60), None, *near, *range(880_000, 900_000)]
    df = spark.createDataFrame([(v,) for v in values], "n bigint")
    start = time.time()
    got = df.select("n", numbers.lower_prime("n").alias("p"), numbers.gcd("n", "360").alias("g"), numbers.inverse("n", "97").alias("i"), numbers.inverse("n", "-97").alias("j")).collect()
    assert time.time() - start < 20
    prime = lambda p: p > 1 and all(p % d for d in range(2, min(int(p**0.5) + 1, 70_000)))
    for r in got[:72] + got[72::999]:
        if r.n is None:
            assert r[1:] == (None,) * 4
            continue
        assert r.p is None if r.n <= 2 else r.p < r.n and prime(r.p) and (r.n > 2**32 or not any(prime(q) for q in range(r.p + 1, r.n)))
        import math

        assert r.g == math.gcd(r.n, 360)
        assert r.i == (pow(r.n, -1, 97) if r.n % 97 else -1)
    assert {r.n: r.p for r in got}[2**61] == 2**61 - 1 and {r.n: r.p for r in got}[2**63 - 1] == 2**63 - 25


def test_kmers_are_counted_as_numbers_before_a_shuffle(spark, monkeypatch):
    """Each k-mer was a string of its own row (F25)."""
    from collections import Counter

    from readloom.operators import stats

    rng = random.Random(8)
    texts = ["".join(rng.choices("ACGTNU"[: rng.randint(1, 6)], k=rng.choice([0, 14, 15, 16, 40, 300]))) for _ in range(500)] + [None]
    for k in (15, 21):
        got = stats.kmer_counts(spark.createDataFrame([(t,) for t in texts], "seq string"), k)
        want = Counter(t[i : i + k] for t in texts if t for i in range(len(t) - k + 1))
        assert sorted(r.times for r in got.collect()) == sorted(want.values())
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "MapInArrow" in plan


def test_texts_and_places_of_sets_are_made_of_a_batch_at_once(spark):
    """Each was put together in a lambda for each word (F2)."""
    from readloom.functions import bitsets

    df = spark.createDataFrame([([5, -1], 100), ([], 0), ([-(2**63)], 64), ([7], 2), (None, 3), ([1], None), ([3, 0], 128)], "a array<bigint>, n int")
    df = df.select("a", "n", bitsets.text("a", "n").alias("t"), bitsets.places("a").alias("p"))
    assert [(r.t, r.p) for r in df.collect()] == [("101" + "0" * 61 + "1" * 36, [0, 2, *range(64, 128)]), ("", []), ("0" * 63 + "1", [63]), ("11", [0, 1, 2]), (None, None), (None, [0]), ("11" + "0" * 126, [0, 1])]
    assert "transform" not in df._jdf.queryExecution().optimizedPlan().toString()


def test_letters_of_lines_are_read_in_one_pass_over_a_text(spark, tmp_path):
    """Each line went through a regular expression (F25, F28)."""
    texts = ["Some line of text, with é and 漢 in it!\n\nshort\nQuiXotic " + "abc, " * 9 + "\n", "one line without an end of twenty-one letters", "", None, "\n" * 3]
    spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    bases = str.maketrans(fixtures.LETTERS, fixtures.AS_BASES.replace("N", "A"))
    want = {2 * (d * fixtures.DOC + i) + 1: "".join(c for c in line if c in fixtures.LETTERS).translate(bases) for d, t in enumerate(texts) if t is not None for i, line in enumerate(t.split("\n"))}
    df = fixtures.line_reads(spark, str(tmp_path))
    assert {r.id: r.seq for r in df.collect()} == {i: s for i, s in want.items() if len(s) > 20}
    assert "regexp" not in df._jdf.queryExecution().optimizedPlan().toString()


def test_distinct_reads_are_told_by_one_packed_strand(spark):
    """Both strands were shuffled as strings (F26, and all queries over distinct reads)."""
    from readloom.operators import clean

    rng = random.Random(9)
    rc = lambda s: s[::-1].translate(str.maketrans("ACGT", "TGCA"))
    for sizes, letters in (([20], "ACGT"), ([0, 1, 2, 31, 32, 33, 64, 70], "ACGT"), ([3, 4, 5], "ACGTN"), ([4], "AT")):
        texts = ["".join(rng.choices(letters, k=rng.choice(sizes))) for _ in range(300)]
        texts += [rc(t) for t in texts[:50]] + [t + rc(t) for t in texts[:20] if len(sizes) > 1] + texts[100:150]
        rng.shuffle(texts)
        df = spark.createDataFrame([*enumerate(texts), (9999, None)], "rn bigint, seq string").repartition(3)
        want = {(r.id, r.seq) for r in clean.drop_contained(clean.both_strands(df)).collect()}
        got = clean.distinct_reads(df).collect()
        assert {(r.id, r.seq) for r in got} == want and len(got) == len(want) and want
    assert clean.distinct_reads(df.where("rn < 0")).count() == 0


def test_mates_and_pairs_of_files_move_in_order(spark, tmp_path):
    """All windows were sorted for each file, and shuffled by their numbers (F1, F27)."""
    from readloom.sources import reads as sources

    rng = random.Random(10)
    texts = [(i % 17, "".join(rng.choices("abcdefghij", k=rng.choice([0, 100, 285, 286, 300, 900])))) for i in range(40)] + [(99, None), (None, "a" * 400)]
    spark.createDataFrame(texts, "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    trimmed = {}
    for d, t in texts:
        if d is not None and t is not None:
            g = t.translate(str.maketrans(fixtures.LETTERS, fixtures.AS_BASES))
            for p in range(0, len(g) - 85, 10):
                trimmed.setdefault((d, p // 10), []).append(g[p + 3 : p + 83])
    rc = lambda s: s[::-1].translate(str.maketrans("ACGT", "TGCA"))
    want = sorted((d * fixtures.DOC + i, a, rc(b)) for (d, i), x in trimmed.items() for a in x for b in trimmed.get((d, i + 20), []))
    got = fixtures.mate_pairs(spark, str(tmp_path), ordered=True).withColumn("part", F.spark_partition_id()).collect()
    assert sorted((r.rn, r.mate1, r.mate2) for r in got) == want
    assert [r.rn for r in sorted(got, key=lambda r: r.part)] == [w[0] for w in want]
    first, second = (spark.range(n).select(F.col("id").alias("rn"), F.concat(F.lit(x), F.col("id").cast("string")).alias("raw")) for n, x in ((9000, "a"), (7000, "b")))
    both = sources.pair_files(first, second)
    assert both._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    assert {(r.rn, r.mate1, r.mate2) for r in both.collect()} == {(i, f"a{i}", f"b{i}" if i < 7000 else None) for i in range(9000)}
