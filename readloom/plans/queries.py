"""The driver's queries of the reads and graph operators, each over its whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readloom.functions import bitsets
from readloom.functions import sequences as fn
from readloom.operators import approximate, chains, clean, correct, graph, order, overlap, simplify, stats
from readloom.plans import fixtures
from readloom.plans.fixtures import GRAPH_SQL, PARAMS, SQL
from readloom.sources.sinks import COLOURS, graphviz

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
L, R, TOP = PARAMS.min_overlap, PARAMS.transitive_from, PARAMS.small_overlaps_kept
MOST, WEIGHT = 60, 40  #: bounds for the graph of orders, so that both outcomes occur


def query(sql: str | None = None, recursive: bool = False, on: str = SQL):
    """Registers a query under its name; sql follows the fixtures' common tables."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql if not on and not sql.lstrip().startswith("primes") else f"WITH {'RECURSIVE ' if recursive else ''}{on.strip()}{sql}"
        return f

    return add


# Reads.


@query("SELECT * FROM strands")
def reads_clean(spark, d):
    return fixtures.strand_reads(spark, d)


@query("SELECT count(*) AS n, CAST(sum(length(seq)) AS BIGINT) AS total, avg(length(seq)) AS average, min(length(seq)) AS least, max(length(seq)) AS most FROM strands")
def read_length_stats(spark, d):
    return stats.length_statistics(fixtures.strand_reads(spark, d))


@query("SELECT length(seq) - length(replace(seq, 'N', '')) AS unknown, count(*) AS reads, 2 * count(*) AS both FROM trimmed GROUP BY 1")
def n_histogram(spark, d):
    return stats.unknown_histogram(fixtures.trimmed_reads(spark, d))


@query("SELECT count(*) AS reads, count(*) FILTER (contains(seq, 'N')) AS with_n, count(*) FILTER (NOT contains(seq, 'N') AND len(list_filter(range(1, 21), lambda p: starts_with(seq, substr(seq, p + 1)))) > 0) AS periodic, (SELECT count(*) FROM valid) AS kept, count(*) FILTER (length(seq) - length(replace(seq, 'N', '')) = 1 AND instr(seq, 'N') > 10 AND length(seq) - instr(seq, 'N') >= 10) AS inner_n FROM trimmed")
def filter_counters(spark, d):
    return stats.filter_counters(fixtures.trimmed_reads(spark, d), PARAMS.max_period)


@query("SELECT max(id) AS id, seq FROM line_reads GROUP BY seq")
def dedup_reads(spark, d):
    return clean.dedup(fixtures.line_reads(spark, d))


_PREFIX = ", l AS (SELECT max(id) AS id, seq FROM (SELECT id, seq FROM line_reads UNION ALL SELECT id - 1, reverse(translate(seq, 'ACGT', 'TGCA')) FROM line_reads) GROUP BY seq) "


@query(_PREFIX + "SELECT DISTINCT a.id FROM l a JOIN l b ON substr(a.seq, 1, 21) = substr(b.seq, 1, 21) AND length(a.seq) < length(b.seq) AND starts_with(b.seq, a.seq)")
def prefix_contained_reads(spark, d):
    r = fixtures.line_reads(spark, d)
    return clean.contained_in_longer(clean.dedup(r.unionByName(r.select((F.col("id") - 1).alias("id"), fn.reverse_complement(F.col("seq")).alias("seq")))))


@query(", o AS (SELECT id, seq, lead(seq) OVER (ORDER BY translate(seq, 'AGCT', 'ABCD'), length(seq), id) AS nxt FROM line_reads) SELECT id, CASE WHEN nxt IS NULL THEN 0 WHEN starts_with(nxt, seq) THEN length(seq) ELSE len(list_filter(range(1, length(seq) + 1), lambda k: substr(seq, 1, k) = substr(nxt, 1, k))) END AS lcp FROM o")
def sorted_read_lcp(spark, d):
    """Neighbours in the sorted order (A, G, C, T) of all reads."""
    return order.neighbour_lcp(fixtures.line_reads(spark, d))


@query(", k AS (SELECT substr(seq, CAST(i AS INTEGER), 15) AS kmer FROM (SELECT seq, unnest(generate_series(1, length(seq) - 14)) AS i FROM line_reads)), c AS (SELECT kmer, count(*) AS times FROM k GROUP BY 1) SELECT times, count(*) AS kmers FROM c GROUP BY 1")
def kmer_spectrum(spark, d):
    return stats.value_counts(stats.kmer_counts(fixtures.line_reads(spark, d), 15), "times").select(F.col("value").alias("times"), F.col("count").alias("kmers"))


def _minimizer_sql(source: str, k: int, m: int, rotation: str = "ACGT") -> str:
    return f"""k AS (SELECT id, length(seq) - {k} + 1 AS places, i - 1 AS pos, substr(seq, CAST(i AS INTEGER), {k}) AS kmer FROM (SELECT id, seq, unnest(generate_series(1, length(seq) - {k} + 1)) AS i FROM {source} WHERE length(seq) >= {k})),
    mins AS (SELECT id AS read_id, arg_min(pos, translate(kmer, 'ACGT', '{rotation}') || lpad(CAST(pos AS VARCHAR), 9, '0')) AS pos, arg_min(kmer, translate(kmer, 'ACGT', '{rotation}') || lpad(CAST(pos AS VARCHAR), 9, '0')) AS kmer FROM k GROUP BY id, pos // CAST(ceil(places / {m}.0) AS BIGINT))"""


@query(", " + _minimizer_sql("line_reads", 15, 3, "GTAC") + " SELECT read_id, CAST(pos AS INTEGER) AS pos, kmer FROM mins")
def minimizers(spark, d):
    return approximate.minimizers(fixtures.line_reads(spark, d), 15, 3, "GTAC")


@query("SELECT id, reverse(translate(seq, 'ACGT', 'TGCA')) AS rc FROM line_reads")
def revcomp(spark, d):
    return fixtures.line_reads(spark, d).select("id", fn.reverse_complement(F.col("seq")).alias("rc"))


@query("SELECT rn, CAST(list_min(list_filter(range(1, 81), lambda p: starts_with(seq, substr(seq, CAST(p + 1 AS INTEGER))))) AS INTEGER) AS period FROM trimmed")
def min_period(spark, d):
    return fixtures.trimmed_reads(spark, d).select("rn", fn.min_period("seq").alias("period"))


@query("SELECT rn, array_to_string(list_filter(range(0, 77), lambda i: substr(seq, CAST(i + 1 AS INTEGER), 4) = substr(seq, 1, 4)), ',') AS places FROM trimmed")
def kmp_positions(spark, d):
    """All places of a read's first four bases in it."""
    return fixtures.trimmed_reads(spark, d).withColumn("head", F.substring("seq", 1, 4)).select("rn", F.array_join(fn.occurrences("seq", "head"), ",").alias("places"))


@query("SELECT rn, list_min(list_transform(range(0, 80), lambda i: substr(seq, CAST(i + 1 AS INTEGER)) || substr(seq, 1, CAST(i AS INTEGER)) || lpad(CAST(i AS VARCHAR), 2, '0'))) AS r FROM trimmed")
def min_rotation(spark, d):
    t = fixtures.trimmed_reads(spark, d).select("rn", "seq", fn.min_rotation("seq").alias("i"))
    return t.select("rn", F.expr("concat(substring(seq, i + 1), substring(seq, 1, i), lpad(cast(i as string), 2, '0'))").alias("r"))


@query("SELECT rn, CAST(list_sum(list_transform(range(1, 41), lambda i: CASE WHEN substr(seq, CAST(i AS INTEGER), 1) = substr(seq, CAST(i + 40 AS INTEGER), 1) THEN 0 WHEN translate(substr(seq, CAST(i AS INTEGER), 1), 'ACGT', 'TGCA') = substr(seq, CAST(i + 40 AS INTEGER), 1) THEN 2 ELSE 1 END)) AS INTEGER) AS bits FROM valid")
def bit_hamming(spark, d):
    t = clean.valid(fixtures.trimmed_reads(spark, d), PARAMS).select("rn", F.expr("substring(seq, 1, 40)").alias("a"), F.expr("substring(seq, 41, 40)").alias("b"))
    return t.select("rn", fn.differing_bits("a", "b").alias("bits"))


@query("""SELECT id, CAST(length(seq) AS INTEGER) AS n, array_to_string(list_transform(range(1, length(seq) + 1, 31), lambda p: list_reduce(list_transform(range(p, least(p + 31, length(seq) + 1)), lambda i: CAST(instr('ACGT', substr(seq, CAST(i AS INTEGER), 1)) - 1 AS BIGINT)), lambda a, b: a * 4 + b)), ',') AS codes, seq AS back FROM reads""")
def packed_reads(spark, d):
    """All bases of each read in numbers of 31 bases, and read back from them."""
    t = fixtures.reads(spark, d).select("id", F.length("seq").alias("n"), fn.pack_whole("seq").alias("codes"))
    return t.select("id", "n", F.array_join("codes", ",").alias("codes"), fn.unpack_whole("codes", "n").alias("back"))


# Overlaps.



def overlap_sql(reads: str, least: int, most: int, large: int = R) -> str:
    """Common tables of the overlap graph of the relation reads: cand (all overlaps of least to most bases), small, pre, final."""
    return f""", cand AS (SELECT a.id AS src, b.id AS dst, CAST(a.off AS INTEGER) AS off, CAST(length(a.seq) - a.off AS INTEGER) AS ov, a.seq AS s FROM (SELECT id, seq, unnest(generate_series(greatest(0, length(seq) - {most}), length(seq) - {least})) AS off FROM {reads}) a JOIN {reads} b ON substr(a.seq, CAST(a.off + 1 AS INTEGER), {least}) = substr(b.seq, 1, {least}) AND a.id <> b.id AND starts_with(b.seq, substr(a.seq, CAST(a.off + 1 AS INTEGER)))),
small AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY ov DESC, dst) AS r FROM cand WHERE ov < {large}) WHERE r <= {TOP}),
pre AS (SELECT src, dst, min(off) AS off, any_value(s) AS s FROM (SELECT src, dst, off, s FROM cand WHERE ov >= {large} UNION ALL SELECT src, dst, off, s FROM small) GROUP BY 1, 2),
final AS (SELECT src, dst, off FROM pre p WHERE NOT EXISTS (SELECT 1 FROM cand b WHERE b.ov >= {large} AND b.dst = p.dst AND b.src <> p.src AND b.off > 0 AND p.off >= b.off AND length(b.s) + p.off - b.off - length(p.s) >= 0 AND substr(p.s, p.off - b.off + 1, b.off) = substr(b.s, 1, b.off))) """


_CAND = overlap_sql("reads", L, PARAMS.max_overlap)


@query(_CAND + "SELECT src, dst, off, ov FROM cand")
def overlap_candidates(spark, d):
    return overlap.candidates(fixtures.reads(spark, d), PARAMS, paired=True).select("src", "dst", "off", F.col("ov").cast("int").alias("ov"))


@query(_CAND + "SELECT src, dst, off, ov FROM small")
def overlap_top3(spark, d):
    return overlap.top_small(overlap.candidates(fixtures.reads(spark, d), PARAMS, paired=True), PARAMS).select("src", "dst", "off", "ov")


@query(_CAND + "SELECT src, dst, off FROM final")
def overlap_edges(spark, d):
    return overlap.overlap_edges(fixtures.reads(spark, d), PARAMS, paired=True)


@query(_CAND + ", f AS (SELECT * FROM final UNION ALL SELECT src, dst, off + 1 FROM final WHERE src % 5 = 1) SELECT f.src, f.dst, f.off FROM f JOIN reads a ON a.id = f.src JOIN reads b ON b.id = f.dst WHERE NOT starts_with(b.seq, substr(a.seq, f.off + 1))")
def edge_validation(spark, d):
    """All edges of the overlap graph match; some that are moved by a base don't."""
    r = fixtures.reads(spark, d)
    e = overlap.overlap_edges(r, PARAMS, paired=True)
    return overlap.wrong_edges(e.unionByName(e.where("src % 5 = 1").withColumn("off", F.col("off") + 1)), r)


@query(_CAND + ", c AS (SELECT src, dst, off FROM cand), m AS (SELECT xor(dst, 1) AS src, xor(src, 1) AS dst, off FROM cand) SELECT count(*) AS candidates, (SELECT count(*) FROM (SELECT * FROM m EXCEPT ALL SELECT * FROM c)) AS unmatched FROM c")
def candidate_complement_closure(spark, d):
    """Both strands are looked at on their own, so this tells something. An overlap and its mirror image meet under the lesser of the two; what one has more of than the other is unmatched."""
    c = overlap.candidates(fixtures.reads(spark, d), PARAMS, lengths=True)
    own, mirror = F.struct("src", "dst", "off"), F.struct(F.col("dst").bitwiseXOR(F.lit(1)).alias("src"), F.col("src").bitwiseXOR(F.lit(1)).alias("dst"), (F.col("n") - F.col("ov")).alias("off"))
    both = c.select(F.least(own, mirror).alias("x"), F.when(own < mirror, 1).when(own > mirror, -1).otherwise(0).alias("k")).select("x.*", "k")
    n = both.repartition("src", "dst", "off").groupBy("src", "dst", "off").agg(F.count("*").alias("c"), F.sum("k").alias("k"))
    return n.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("candidates"), F.coalesce(F.sum(F.abs("k")), F.lit(0)).alias("unmatched"))


def _all_orders(source: str, k: int, m: int) -> str:
    parts = ",\n".join(_minimizer_sql(source, k, m, r).replace("k AS (", f"k{i} AS (", 1).replace("mins AS (", f"mins{i} AS (", 1).replace(" FROM k GROUP", f" FROM k{i} GROUP") for i, r in enumerate(approximate.ROTATIONS))
    return parts + ", mins AS (" + " UNION ALL ".join(f"SELECT {i} AS r, * FROM mins{i}" for i in range(len(approximate.ROTATIONS))) + ")"


_APPROX = ", " + _all_orders("error_reads", 20, 3) + """, cp AS (SELECT DISTINCT a.read_id AS src, b.read_id AS dst, CAST(a.pos - b.pos AS INTEGER) AS off FROM mins a JOIN mins b ON a.r = b.r AND a.kmer = b.kmer AND a.read_id <> b.read_id AND a.pos >= b.pos WHERE 80 - (a.pos - b.pos) >= 47),
al AS (SELECT c.src, c.dst, c.off, substr(x.seq, c.off + 1, 80 - c.off) AS a, substr(y.seq, 1, 80 - c.off) AS b FROM cp c JOIN error_reads x ON x.id = c.src JOIN error_reads y ON y.id = c.dst) """


@query(_APPROX + "SELECT src, dst, off FROM cp")
def approx_candidates(spark, d):
    """Under all four orders of bases."""
    return approximate.approximate_candidates(fixtures.error_reads(spark, d), 20, 3, L)


@query(_APPROX + """, g AS (SELECT *, CAST(list_sum(list_transform(range(1, length(a) + 1), lambda i: CASE WHEN substr(a, CAST(i AS INTEGER), 1) = substr(b, CAST(i AS INTEGER), 1) THEN 0 WHEN translate(substr(a, CAST(i AS INTEGER), 1), 'ACGT', 'TGCA') = substr(b, CAST(i AS INTEGER), 1) THEN 2 ELSE 1 END)) AS INTEGER) AS bits FROM al WHERE substr(a, 1, 3) = substr(b, 1, 3) AND (substr(a, 4, 1) IN ('C', 'T')) = (substr(b, 4, 1) IN ('C', 'T')) AND right(a, 3) = right(b, 3))
SELECT src, dst, CAST(min(off) AS INTEGER) AS off FROM g WHERE 100 * ((2 * length(a) - bits) // 2) >= 95 * length(a) GROUP BY 1, 2""")
def low_error_alignments(spark, d):
    """Under all four orders of bases."""
    return approximate.approximate_overlaps(fixtures.error_reads(spark, d), 20, 3, L, 95)


_GROUPS = ", " + _all_orders("error_reads", 20, 3) + f""", bases AS (SELECT id, seq, translate(seq, 'ACGT', '0101') AS low, translate(seq, 'ACGT', '0011') AS high FROM error_reads),
cp AS MATERIALIZED (SELECT a.r, a.kmer, a.read_id AS i, b.read_id AS j, CAST(a.pos AS INTEGER) AS pi, CAST(b.pos AS INTEGER) AS pj, CAST(a.pos - b.pos AS INTEGER) AS off FROM mins a JOIN mins b ON a.r = b.r AND a.kmer = b.kmer AND a.read_id <> b.read_id AND (a.pos > b.pos OR (a.pos = b.pos AND a.read_id < b.read_id)) WHERE 80 - (a.pos - b.pos) >= {L}),
tried AS (SELECT d.*, substr(x.low, d.off + 1) AS al, substr(y.low, 1, 80 - d.off) AS bl, substr(x.high, d.off + 1) AS ah, substr(y.high, 1, 80 - d.off) AS bh FROM (SELECT DISTINCT i, j, off FROM cp) d JOIN bases x ON x.id = d.i JOIN bases y ON y.id = d.j),
good AS MATERIALIZED (SELECT i, j, off FROM tried WHERE substr(al, 1, 3) = substr(bl, 1, 3) AND substr(ah, 1, 3) = substr(bh, 1, 3) AND substr(al, 4, 1) = substr(bl, 4, 1) AND right(al, 3) = right(bl, 3) AND right(ah, 3) = right(bh, 3)
  AND 100 * ((2 * (80 - off) - bit_count(xor(al::BIT, bl::BIT)) - bit_count(xor(ah::BIT, bh::BIT))) // 2) >= 95 * (80 - off)),
al AS MATERIALIZED (SELECT c.* FROM cp c JOIN good g ON g.i = c.i AND g.j = c.j AND g.off = c.off),
reach AS (SELECT r, kmer, i, pi, j, pj FROM al UNION SELECT a.r, a.kmer, a.i, a.pi, t.j, t.pj FROM al a JOIN reach t ON t.r = a.r AND t.kmer = a.kmer AND t.i = a.j AND t.pi = a.pj),
chained AS (SELECT DISTINCT a.r, a.kmer, a.i, a.pi, t.j, t.pj FROM al a JOIN reach t ON t.r = a.r AND t.kmer = a.kmer AND t.i = a.j AND t.pi = a.pj)
SELECT i AS src, j AS dst, min(off) AS off FROM al WHERE (r, kmer, i, pi, j, pj) NOT IN (SELECT (r, kmer, i, pi, j, pj) FROM chained) GROUP BY 1, 2"""


@query(_GROUPS, recursive=True)
def approx_pairs_pruned(spark, d):
    """Overlaps with errors that no chain of others within their k-mer's group connects."""
    return approximate.approximate_overlaps(fixtures.error_reads(spark, d), 20, 3, L, 95, pruned=True)


_LCS = """, lcs AS (SELECT rn, substr(seq, 1, 40) AS a, substr(seq, 41, 40) AS b, 0 AS i, [0, 0, 0, 0, 0] AS d FROM valid UNION ALL
  SELECT rn, a, b, i + 1, list_reduce([0, 1, 2, 3, 4], lambda row, k: list_append(row, CASE WHEN i + k BETWEEN 2 AND 41 THEN greatest(CASE WHEN k > 0 THEN row[k] ELSE 0 END, CASE WHEN k < 4 THEN d[k + 2] ELSE 0 END, d[k + 1] + CASE WHEN substr(a, i + 1, 1) = substr(b, i + k - 1, 1) THEN 1 ELSE 0 END) ELSE d[k + 1] END), CAST([] AS INTEGER[])) FROM lcs WHERE i < 40) """


@query(_LCS + "SELECT rn, list_max(d) AS n, 100 * list_max(d) > 95 * 40 AS alike FROM lcs WHERE i = 40", recursive=True)
def banded_lcs(spark, d):
    """Both halves of each read."""
    t = clean.valid(fixtures.trimmed_reads(spark, d), PARAMS).select("rn", F.expr("substring(seq, 1, 40)").alias("a"), F.expr("substring(seq, 41, 40)").alias("b"))
    return t.select("rn", fn.banded_lcs(F.col("a"), F.col("b")).alias("n"), F.length("a").alias("of")).select("rn", "n", (100 * F.col("n") > 95 * F.col("of")).alias("alike"))


@query()
def hybrid_alignments(spark, d):
    """Overlaps whose bits agree, or else whose banded common subsequence is long enough; tests hold them against brute force."""
    return approximate.approximate_overlaps(fixtures.error_reads(spark, d), 20, 3, L, 95, lcs=95)


@query(f", c AS (SELECT rn, seq, list_transform(range(1, 81), lambda i: CAST(instr('ACGT', substr(seq, CAST(i AS INTEGER), 1)) AS BIGINT)) AS codes FROM valid), h AS (SELECT rn, CAST(rn % 40 AS INTEGER) AS start, list_reduce(codes, lambda h, x: (h * {fn.HASH_BASE} + x) % {fn.HASH_MODULUS}, CAST(0 AS BIGINT)) AS whole, list_reduce(codes[rn % 40 + 1 : rn % 40 + 30], lambda h, x: (h * {fn.HASH_BASE} + x) % {fn.HASH_MODULUS}, CAST(0 AS BIGINT)) AS part FROM c) SELECT * FROM h")
def substring_hashes(spark, d):
    """Of each read the hash of thirty bases, from those of its prefixes, and of the whole."""
    t = clean.valid(fixtures.trimmed_reads(spark, d), PARAMS).select("rn", F.expr("cast(rn % 40 as int)").alias("start"), fn.prefix_hashes(F.col("seq")).alias("h"))
    return t.select("rn", "start", F.element_at("h", -1).alias("whole"), fn.substring_hash("h", "start", "30").alias("part"))


@query(""", s AS (SELECT rn, translate(seq, 'ACGTN', '01010') AS a, translate(seq, 'ACGTN', '00110') AS b, CAST(rn % 80 AS INTEGER) AS k, CAST(least(rn % 80, rn // 80 % 80) AS INTEGER) AS lo, CAST(greatest(rn % 80, rn // 80 % 80) AS INTEGER) AS hi FROM trimmed)
SELECT rn, CAST(a::BIT & b::BIT AS VARCHAR) AS both, CAST(a::BIT | b::BIT AS VARCHAR) AS either, CAST(xor(a::BIT, b::BIT) AS VARCHAR) AS one_of, CAST(~(a::BIT) AS VARCHAR) AS none_of, substr(a, k + 1) || repeat('0', k) AS down, repeat('0', k) || substr(a, 1, 80 - k) AS up,
substr(a, 1, lo) || repeat('1', hi - lo + 1) || substr(a, hi + 2) AS filled, substr(a, 1, lo) || repeat('0', hi - lo + 1) || substr(a, hi + 2) AS emptied, substr(a, 1, lo) || translate(substr(a, lo + 1, hi - lo + 1), '01', '10') || substr(a, hi + 2) AS flipped, substr(a, k + 1, 1) = '1' AS holds,
CAST(bit_count(a::BIT) AS INTEGER) AS n, CAST(length(replace(substr(a, lo + 1, hi - lo + 1), '0', '')) AS INTEGER) AS n_between, CASE WHEN instr(substr(a, k + 1), '1') = 0 THEN -1 ELSE CAST(k + instr(substr(a, k + 1), '1') - 1 AS INTEGER) END AS first_from, CASE WHEN instr(substr(a, k + 2), '1') = 0 THEN -1 ELSE CAST(k + instr(substr(a, k + 2), '1') AS INTEGER) END AS first_after,
CAST(instr(CAST(xor(a::BIT, b::BIT) AS VARCHAR), '1') - 1 AS INTEGER) AS first_difference, array_to_string(list_filter(range(0, 80), lambda i: substr(a, CAST(i + 1 AS INTEGER), 1) = '1'), ',') AS places FROM s""")
def bit_sets(spark, d):
    """Of each read the places of C and T as one set, those of G and T as the other."""
    of = lambda bits: bitsets.from_text(f"translate(seq, 'ACGTN', '{bits}')", 80)
    s = fixtures.trimmed_reads(spark, d).select("rn", of("01010").alias("a"), of("00110").alias("b"), F.expr("cast(rn % 80 as int)").alias("k"), F.expr("cast(least(rn % 80, rn div 80 % 80) as int)").alias("lo"), F.expr("cast(greatest(rn % 80, rn div 80 % 80) as int)").alias("hi"))
    made = {"both": bitsets.both("a", "b"), "either": bitsets.either("a", "b"), "one_of": bitsets.one_of("a", "b"), "none_of": bitsets.none_of("a", 80), "down": bitsets.moved_down("a", "k"), "up": bitsets.moved_up("a", "k", 80), "filled": bitsets.with_range("a", "lo", "hi", True, 80), "emptied": bitsets.with_range("a", "lo", "hi", False, 80), "flipped": bitsets.flipped("a", "lo", "hi", 80)}
    s = s.select("*", *[c.alias(n) for n, c in made.items()])
    numbers = [bitsets.holds("a", "k").alias("holds"), bitsets.size_of("a").alias("n"), bitsets.size_between("a", "lo", "hi").alias("n_between"), bitsets.first_from("a", "k").alias("first_from"), bitsets.first_after("a", "k").alias("first_after"), bitsets.first_difference("a", "b").alias("first_difference")]
    s = s.select("rn", *[bitsets.text(n, 80).alias(n) for n in made], *numbers, bitsets.places("a").alias("p"))
    return s.withColumn("places", F.array_join("p", ",")).drop("p")


@query(", k AS (SELECT substr(seq, CAST(i + 5 AS INTEGER), 30) AS big, substr(seq, CAST(i AS INTEGER), 5) AS small FROM (SELECT seq, unnest(generate_series(1, length(seq) - 34)) AS i FROM error_reads)), c AS (SELECT big, small, count(*) AS n FROM k GROUP BY 1, 2 HAVING count(*) >= 2) SELECT n, count(*) AS contexts FROM c GROUP BY 1")
def context_frequencies(spark, d):
    return correct.context_frequencies(fixtures.error_reads(spark, d)).groupBy("n").agg(F.count("*").alias("contexts"))


def _corrected_sql(rel: str, out: str) -> str:
    """Common tables of one pass over the relation rel (id, seq); the last is named out."""
    unlike = [f"substr(p.have, {k}, 1) <> substr(k.small, {k}, 1)" for k in range(1, 6)]
    return f"""{out}_p AS (SELECT id, i, substr(seq, i + 5, 30) AS big, substr(seq, i, 5) AS have FROM (SELECT id, seq, CAST(unnest(range(1, length(seq) - 33)) AS INTEGER) AS i FROM {rel} WHERE length(seq) >= 35)),
{out}_k AS (SELECT big, have AS small, count(*) AS n FROM {out}_p GROUP BY 1, 2 HAVING count(*) >= 2),
{out}_q AS (SELECT * FROM {out}_p p WHERE NOT EXISTS (SELECT 1 FROM {out}_k k WHERE k.big = p.big AND k.small = p.have)),
{out}_j AS (SELECT p.id, p.i, k.small, k.n, {" + ".join(f"CAST({u} AS INTEGER)" for u in unlike)} AS d, CASE {" ".join(f"WHEN {u} THEN {i + 1}" for i, u in enumerate(unlike))} ELSE 0 END AS k FROM {out}_q p JOIN {out}_k k ON k.big = p.big),
{out}_f AS (SELECT id, i, max(struct_pack(n := n, small := small, k := k)) FILTER (d = 1 AND (i = 1 OR k BETWEEN 2 AND 4)) AS best FROM {out}_j GROUP BY 1, 2),
{out}_y AS (SELECT id, i + best.k - 1 AS place, max(struct_pack(n := best.n, base := substr(best.small, best.k, 1))).base AS base FROM {out}_f WHERE best IS NOT NULL GROUP BY 1, 2),
{out}_z AS (SELECT r.id, string_agg(coalesce(y.base, substr(r.seq, r.c, 1)), '' ORDER BY r.c) AS seq FROM (SELECT id, seq, CAST(unnest(range(1, length(seq) + 1)) AS INTEGER) AS c FROM {rel} WHERE id IN (SELECT id FROM {out}_y)) r LEFT JOIN {out}_y y ON y.id = r.id AND y.place = r.c GROUP BY 1),
{out} AS (SELECT r.id, coalesce(z.seq, r.seq) AS seq FROM {rel} r LEFT JOIN {out}_z z ON z.id = r.id)"""


@query(", " + _corrected_sql("error_reads", "first") + ", turned AS (SELECT id, reverse(translate(seq, 'ACGT', 'TGCA')) AS seq FROM first), " + _corrected_sql("turned", "second") + " SELECT id, reverse(translate(seq, 'ACGT', 'TGCA')) AS seq FROM second")
def corrected_reads(spark, d):
    return correct.correct(fixtures.error_reads(spark, d))


# Mates.


@query("SELECT * FROM pairs")
def mate_pairs(spark, d):
    return fixtures.mate_pairs(spark, d)


_MATES = ", m AS (SELECT 4 * rn + 1 AS id, mate1 AS seq FROM pairs UNION ALL SELECT 4 * rn + 3, mate2 FROM pairs), v AS (SELECT * FROM m WHERE NOT contains(seq, 'N') AND NOT (" + " OR ".join(f"starts_with(seq, substr(seq, {p + 1}))" for p in range(1, 21)) + ")), b AS (SELECT id, CASE WHEN id % 4 < 2 THEN id + 2 ELSE id - 2 END AS want FROM (SELECT id FROM v UNION ALL SELECT id - 1 FROM v)) "


@query(_MATES + "SELECT b.id, o.id AS mate_id FROM b LEFT JOIN b o ON o.id = b.want")
def mate_ids(spark, d):
    raw = clean.pairs_to_raw(fixtures.mate_pairs(spark, d)).select("rn", F.col("raw").alias("seq"))
    return clean.with_mates(clean.both_strands(clean.valid(raw, PARAMS))).select("id", "mate_id")


# Graphs.


@query("SELECT id, o AS out_degree, i AS in_degree FROM deg", on=GRAPH_SQL)
def degrees(spark, d):
    return graph.degrees(fixtures.edges(spark, d))


@query("SELECT count(*) AS nodes, CAST(sum(o) AS BIGINT) AS edges, max(o) AS max_out, max(i) AS max_in, " + ", ".join(f"count(*) FILTER (o = {k}) AS out_{k}" for k in range(6)) + " FROM deg", on=GRAPH_SQL)
def degree_histogram(spark, d):
    return graph.statistics(fixtures.edges(spark, d))


@query("SELECT id, CASE WHEN o = 0 THEN 'from' ELSE 'to' END AS tip FROM deg WHERE (o = 0 AND i > 0) OR (i = 0 AND o > 0)", on=GRAPH_SQL)
def sources_sinks_tips(spark, d):
    out, into = graph.tips(fixtures.edges(spark, d))
    return out.select("id", F.lit("from").alias("tip")).unionByName(into.select("id", F.lit("to").alias("tip")))


@query("SELECT c_custkey AS id FROM customer WHERE c_custkey NOT IN (SELECT src FROM edges WHERE src % 3 = 0 UNION SELECT dst FROM edges WHERE src % 3 = 0)", on=GRAPH_SQL)
def isolated_nodes(spark, d):
    all_nodes = fixtures.table(spark, d, "customer").select(F.col("c_custkey").alias("id"))
    return all_nodes.join(graph.drop_isolated(all_nodes, fixtures.edges(spark, d).where("src % 3 = 0")), "id", "left_anti")


@query("SELECT dst AS src, src AS dst, off FROM edges", on=GRAPH_SQL)
def reverse_graph(spark, d):
    return graph.reverse(fixtures.edges(spark, d))


@query("SELECT * FROM edges", on=GRAPH_SQL)
def smallest_offset(spark, d):
    return overlap.smallest_offset(fixtures.parallel_edges(spark, d))


@query("SELECT count(*) AS edges FROM edges", on=GRAPH_SQL)
def edge_count(spark, d):
    return fixtures.edges(spark, d).agg(F.count("*").alias("edges"))


@query("SELECT src, string_agg(off || ':' || dst, ',' ORDER BY off, dst) AS ends FROM edges GROUP BY 1", on=GRAPH_SQL)
def adjacency(spark, d):
    return graph.adjacency(fixtures.edges(spark, d)).select("src", F.expr("array_join(transform(out, x -> concat(x.off, ':', x.dst)), ',')").alias("ends"))


@query("SELECT (SELECT count(*) FROM (SELECT src, dst, off FROM edges EXCEPT ALL SELECT src, dst, off FROM multi)) = 0 AS contained, (SELECT count(*) FROM (SELECT src, dst, off FROM multi EXCEPT ALL SELECT src, dst, off FROM edges)) = 0 AS same", on=GRAPH_SQL)
def graph_equal_subset(spark, d):
    a, b = fixtures.parallel_edges(spark, d), fixtures.edges(spark, d)
    return spark.range(1).select(F.lit(graph.contains_graph(a, b)).alias("contained"), F.lit(graph.equal_graphs(a, b)).alias("same"))


_TRI = f", tri AS (SELECT e.* FROM edges e JOIN (SELECT a.src, b.dst, min(a.off + b.off) AS off FROM edges a JOIN edges b ON a.dst = b.src GROUP BY 1, 2) t ON e.src = t.src AND e.dst = t.dst AND e.off = t.off WHERE e.off <= {WEIGHT}) "


@query(_TRI + "SELECT * FROM tri", on=GRAPH_SQL)
def triangle_edges(spark, d):
    return simplify.triangle_edges(fixtures.edges(spark, d), WEIGHT)


@query(_TRI + "SELECT * FROM edges WHERE (src, dst) NOT IN (SELECT (src, dst) FROM tri)", on=GRAPH_SQL)
def triangles_removed(spark, d):
    return simplify.drop_triangles(fixtures.edges(spark, d), WEIGHT)


@query(", o AS (SELECT *, 80 - off AS ov FROM edges), r AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY ov DESC, dst) AS r FROM o WHERE ov < 65) SELECT * FROM o WHERE (src, dst) NOT IN (SELECT (src, dst) FROM r WHERE r > 1)", on=GRAPH_SQL)
def small_overlap_pruned(spark, d):
    return simplify.drop_small_overlaps(fixtures.edges(spark, d).withColumn("ov", 80 - F.col("off")), 65, 1)


def _dangling_sql(rel: str) -> str:
    return f""", e AS ({rel}), od AS (SELECT id, CAST(sum(o) AS BIGINT) AS o FROM (SELECT src AS id, 1 AS o FROM e UNION ALL SELECT dst, 0 FROM e) GROUP BY 1),
w AS (SELECT e.src AS start, e.dst AS via, e.dst AS cur, e.off AS total, [struct_pack(src := e.src, dst := e.dst)] AS path FROM e JOIN od ON od.id = e.src WHERE od.o > 1
  UNION ALL SELECT w.start, w.via, e.dst, w.total + e.off, list_append(w.path, struct_pack(src := e.src, dst := e.dst)) FROM w JOIN e ON e.src = w.cur JOIN od ON od.id = w.cur AND od.o = 1 WHERE w.total <= {MOST}),
b AS (SELECT w.*, count(*) OVER (PARTITION BY start) AS k, row_number() OVER (PARTITION BY start ORDER BY total DESC, cur DESC, via DESC) AS r FROM w JOIN od ON od.id = w.cur AND od.o = 0 WHERE w.total <= {MOST}),
gone AS (SELECT DISTINCT p.src, p.dst FROM (SELECT unnest(path) AS p FROM b JOIN od ON od.id = b.start WHERE b.k < od.o OR b.r > 1)) """


@query(_dangling_sql("SELECT * FROM edges") + "SELECT * FROM edges WHERE (src, dst) NOT IN (SELECT (src, dst) FROM gone)", recursive=True, on=GRAPH_SQL)
def dangling_branches_pass(spark, d):
    return simplify.drop_dangling(fixtures.edges(spark, d), MOST)


@query(_dangling_sql("SELECT dst AS src, src AS dst, off FROM edges") + "SELECT * FROM edges WHERE (dst, src) NOT IN (SELECT (src, dst) FROM gone)", recursive=True, on=GRAPH_SQL)
def upper_dangling_pass(spark, d):
    return simplify.drop_upper_dangling(fixtures.edges(spark, d), MOST).select("src", "dst", "off")


@query()
def dangling_fixpoint(spark, d):
    return simplify.drop_dangling_fixpoint(fixtures.edges(spark, d), MOST).select("src", "dst", "off")


@query(f""", ways AS (SELECT id AS start, id, CAST(0 AS BIGINT) AS dist FROM deg WHERE o > 1 UNION SELECT w.start, e.dst, w.dist + e.off FROM ways w JOIN edges e ON e.src = w.id WHERE w.dist <= {MOST}),
best AS (SELECT start, id, min(dist) AS dist FROM ways GROUP BY 1, 2),
met AS (SELECT b.start, e.src, e.dst, e.off FROM best b JOIN edges e ON e.src = b.id JOIN best h ON h.start = b.start AND h.id = e.dst WHERE b.dist <= {MOST} AND b.dist + e.off = h.dist),
gone AS (SELECT DISTINCT src, dst FROM (SELECT *, row_number() OVER (PARTITION BY start, dst ORDER BY off, src) AS r FROM met) WHERE r > 1) SELECT * FROM edges WHERE (src, dst) NOT IN (SELECT (src, dst) FROM gone)""", recursive=True, on=GRAPH_SQL)
def parallel_paths_snapshot(spark, d):
    return simplify.drop_parallel_paths(fixtures.edges(spark, d), MOST)


@query()
def parallel_paths_exact(spark, d):
    return simplify.drop_parallel_paths_exact(fixtures.edges(spark, d), MOST)


@query(", u AS (SELECT src AS a, dst AS b FROM edges UNION SELECT dst, src FROM edges), reach AS (SELECT id, id AS low FROM deg UNION SELECT u.b, r.low FROM reach r JOIN u ON u.a = r.id WHERE r.low < u.b) SELECT id, min(low) AS component FROM reach GROUP BY 1", recursive=True, on=GRAPH_SQL)
def components(spark, d):
    return graph.components(fixtures.edges(spark, d))


@query(", ways AS (SELECT id, CAST(0 AS BIGINT) AS length FROM deg WHERE o = 0 UNION SELECT e.src, w.length + e.off FROM ways w JOIN edges e ON e.dst = w.id), best AS (SELECT id, max(length) AS length FROM ways GROUP BY 1) SELECT b.id, b.length, min(e.dst) AS next FROM best b LEFT JOIN (SELECT e.src, e.dst, e.off + t.length AS length FROM edges e JOIN best t ON t.id = e.dst) e ON e.src = b.id AND e.length = b.length GROUP BY 1, 2", recursive=True, on=GRAPH_SQL)
def longest_paths(spark, d):
    return chains.longest_ways(fixtures.edges(spark, d))


@query(_CAND + "SELECT f.src || ' -> ' || f.dst || ' [label=\"(' || f.off || ',' || (least(length(a.seq), length(b.seq) + f.off) - f.off) || ')\", color=' || " + f"{list(COLOURS)}" + f"[f.src % {len(COLOURS)} + 1] || '];' AS value FROM final f JOIN reads a ON a.id = f.src JOIN reads b ON b.id = f.dst")
def graph_graphviz(spark, d):
    r = fixtures.reads(spark, d)
    return graphviz(overlap.overlap_edges(r, PARAMS, paired=True), r)


@query(", c AS (SELECT length(seq) AS v FROM line_reads), s AS (SELECT list_sort(list(v)) AS a FROM c) SELECT count(*) AS n, CAST(sum(v) AS BIGINT) AS total, round(avg(v), 6) AS average, CAST(min(v) AS BIGINT) AS least, CAST(max(v) AS BIGINT) AS most, CAST((SELECT a[len(a) // 2 + 1] FROM s) AS BIGINT) AS median, CAST(sum(v * v) AS BIGINT) AS squares, round(stddev_pop(v), 6) AS stddev FROM c")
def contig_length_stats(spark, d):
    s = stats.full_statistics(fixtures.line_reads(spark, d))
    return s.withColumns({"average": F.round("average", 6), "stddev": F.round("stddev", 6)})
