r"""Line dedup by a deletion-neighbourhood join, DataFrame operations only.

Lines are what stands between \n; lines without a word are never touched. Of equal lines the earliest stays, by (doc_id, line number). A line of
near_words words or more (NEAR_WORDS; 2 at least) also goes if an earlier line of as many words at least lies within one edit of it, where an edit inserts, removes or replaces one word. Lines
are compared with all earlier ones, those that go included, so the result doesn't depend on an order of work.

Emitting each word-deletion of each line would multiply the corpus, so lines first meet on a cheaper key that any pair within the bound shares: one edit
leaves the first or the last 2^(k-1) words alone, for lines of 2^k to 2^(k+1) - 1 words. Only lines that share such a key with a
different line emit their deletion variants (hashes of the line without its i-th word, built from running XORs of position-salted word hashes)
and their own hash. Lines with the same variant and the same i differ in that word only; a line whose own hash is another's variant lacks one word. So a minimum per
key, combined before the shuffle, gives each line's earliest neighbour without listing pairs; the edit distance of line and neighbour is then verified on their words.

Defined results: null texts stay null; rows that share a doc_id are one document and get equal decisions; a null doc_id comes first; a document that loses all lines
keeps its row with what is left (blank lines or nothing); columns of any other name pass through; an empty table gives an empty result. Equal lines are found by 128-bit hashes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readloom.llm.common import forget, free_prefix, stored, table

NEAR_WORDS = 5  #: one edit leaves a similarity of 0.8 or more from here on; shorter lines are only compared for equality by default
_GAP = r"[\\x20\\x09-\\x0D]+"


def _lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc, no, line and its hashes, for each line that has a word."""
    out = docs.select(docs[id_col].alias("doc"), F.posexplode(F.split(docs[text_col].cast("string"), "\n")).alias("no", "line"))
    return out.where(F.col("line").rlike(r"[^\x20\x09-\x0D]")).withColumns({"h1": F.xxhash64("line"), "h2": F.xxhash64(F.lit(7), "line")})


def _meeting_keys(near_words: int) -> str:
    """SQL for the keys that a line of words w meets others on. A power of two also belongs with the lines that are a word shorter."""

    def both(k: str) -> str:
        h = f"cast(pow(2, {k} - 1) as int)"
        return f"xxhash64('first', {k}, slice(w, 1, {h})), xxhash64('last', {k}, slice(w, size(w) - {h} + 1, {h}))"

    k = "cast(floor(log2(size(w))) as int)"
    return f"case when size(w) < {max(2, near_words)} then cast(array() as array<bigint>) when pow(2, {k}) = size(w) then array({both(k)}, {both(f'({k} - 1)')}) else array({both(k)}) end"


def near_lines(distinct: DataFrame, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Lines (doc and no of their first occurrence) with an earlier line within one edit: doc, no, near_doc, near_no."""
    keyed = distinct.select("doc", "no", F.explode("keys").alias("key"))
    met = keyed.groupBy("key").agg(F.min(F.struct("doc", "no")).alias("a"), F.max(F.struct("doc", "no")).alias("b")).where("not a <=> b").select("key")
    suspects = keyed.join(met, "key", "left_semi").groupBy("doc").agg(F.collect_set("no").alias("nos"))
    texts = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"))
    # A text is split once, whatever the number of its lines that are wanted.
    taken = texts.join(suspects, texts.id.eqNullSafe(suspects.doc)).select("doc", F.inline(F.expr("flatten(transform(array(split(text, '\\n')), all -> transform(nos, n -> struct(n as no, get(all, n) as line))))")))
    lines = stored(taken.select("doc", "no", F.expr(f"array_remove(split(line, '{_GAP}'), '')").alias("w")).where("w is not null").groupBy("doc", "no").agg(F.min("w").alias("w")))

    words = lines.repartition("doc", "no").select("doc", "no", F.posexplode("w").alias("i", "word"))
    own = "over (partition by doc, no)"
    upto = "over (partition by doc, no order by i rows between unbounded preceding and current row)"
    here, shifted = "xxhash64(word, i)", "xxhash64(word, i - 1)"
    sums = words.select("doc", "no", "i", F.expr(here).alias("x"), F.expr(shifted).alias("y"))
    sums = sums.select("doc", "no", "i", "x", F.expr(f"bit_xor(x) {upto}").alias("left"), F.expr(f"bit_xor(y) {upto}").alias("passed"), F.expr(f"bit_xor(x) {own}").alias("whole"), F.expr(f"bit_xor(y) {own}").alias("moved"))
    # A variant is what stands before i, and what stands after it moved by one; the line itself is emitted once, with i = -1.
    variants = sums.select("doc", "no", F.explode(F.expr("case when i = 0 then array(struct(-1 as i, whole as v), struct(i as i, left ^ x ^ moved ^ passed as v)) else array(struct(i as i, left ^ x ^ moved ^ passed as v)) end")).alias("e")).select("doc", "no", "e.i", "e.v")
    variants = stored(variants)

    place = F.struct("doc", "no")
    groups = variants.groupBy("v", "i").agg(F.min(place).alias("low"), F.max(place).alias("high"))
    # For each key that several lines share: the earliest of all, and the line itself, if any, that the key is the hash of.
    shared = groups.groupBy("v").agg(F.min("low").alias("first"), F.max("high").alias("last"), F.min(F.when(F.col("i") == -1, F.col("low"))).alias("itself")).where("not first <=> last").drop("last")
    best = groups.join(shared, "v").select("v", "i", F.expr("case when i = -1 then first else least(low, itself) end").alias("near"))
    found = variants.join(best, ["v", "i"]).select("doc", "no", "near")
    near = found.where(F.col("near") < place).groupBy("doc", "no").agg(F.min("near").alias("near"))

    a, b = lines.alias("a"), lines.alias("b")
    pairs = near.join(a, (F.col("a.doc").eqNullSafe(near.doc)) & (F.col("a.no") == near.no)).select(near.doc, near.no, "near", F.col("a.w").alias("wa"))
    pairs = pairs.join(b, (F.col("b.doc").eqNullSafe(F.col("near.doc"))) & (F.col("b.no") == F.col("near.no"))).select(pairs.doc, pairs.no, "near", "wa", F.col("b.w").alias("wb"))
    out = stored(pairs.where(within_one_edit("wa", "wb")).select("doc", "no", F.col("near.doc").alias("near_doc"), F.col("near.no").alias("near_no")))
    forget(lines, variants)
    return out


def within_one_edit(a: str, b: str):
    """Whether the word arrays a and b are at most one inserted, removed or replaced word apart."""
    at = f"array_position(zip_with({a}, {b}, (x, y) -> x <=> y), false)"
    return F.expr(f"""case when {at} = 0 then true
      when size({a}) = size({b}) then slice({a}, cast({at} as int) + 1, size({a})) = slice({b}, cast({at} as int) + 1, size({b}))
      when size({a}) = size({b}) + 1 then slice({a}, cast({at} as int) + 1, size({a})) = slice({b}, cast({at} as int), size({b}))
      when size({a}) + 1 = size({b}) then slice({a}, cast({at} as int), size({a})) = slice({b}, cast({at} as int) + 1, size({b})) else false end""")


def removed_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", near_words: int = NEAR_WORDS) -> DataFrame:
    """doc, removed (sorted numbers of its lines that go, from 0), n_near (how many of them equal no earlier line): for each document that loses a line."""
    lines = _lines(docs, id_col, text_col)
    keys = lines.withColumn("w", F.expr(f"array_remove(split(line, '{_GAP}'), '')")).select("doc", "no", "h1", "h2", F.expr(_meeting_keys(near_words)).alias("keys"))
    distinct = stored(keys.groupBy("h1", "h2").agg(F.min(F.struct("doc", "no")).alias("at"), F.max(F.struct("doc", "no")).alias("last"), F.any_value("keys").alias("keys")).select("h1", "h2", "at.doc", "at.no", (~F.col("at").eqNullSafe(F.col("last"))).alias("again"), "keys"))
    found = near_lines(distinct, docs, id_col, text_col)
    near = found.select(F.col("doc").alias("near_of"), F.col("no").alias("near_at"))
    # What repeats and what is near an earlier line decides; all other lines stay.
    marks = distinct.select("h1", "h2", "doc", "no", "again").join(near, distinct.doc.eqNullSafe(near.near_of) & (distinct.no == near.near_at), "left")
    marks = stored(marks.where("again or near_at is not null").select("h1", "h2", F.col("doc").alias("first_doc"), F.col("no").alias("first_no"), F.col("near_at").isNotNull().alias("near")))
    forget(distinct, found)
    hit = lines.select("doc", "no", "h1", "h2").join(marks, ["h1", "h2"]).where("near or not (doc <=> first_doc and no = first_no)")
    first = F.expr("doc <=> first_doc and no = first_no")
    return hit.groupBy("doc").agg(F.sort_array(F.collect_set("no")).alias("removed"), F.size(F.collect_set(F.when(first, F.col("no")))).alias("n_near"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", near_words: int = NEAR_WORDS) -> DataFrame:
    """docs, same columns and rows, without the lines that removed_lines() names."""
    p = free_prefix(docs)
    gone = removed_lines(docs, id_col, text_col, near_words).select(F.col("doc").alias(f"{p}doc"), F.col("removed").alias(f"{p}removed"))
    out = docs.join(gone, docs[id_col].eqNullSafe(gone[f"{p}doc"]), "left")
    # Numbers of lines that stay by one set difference; the text is split once.
    left = f"array_join(flatten(transform(array(split(cast(`{text_col}` as string), '\\n')), all -> transform(array_except(sequence(0, size(all) - 1), {p}removed), i -> get(all, i)))), '\\n')"
    text = F.expr(f"case when {p}removed is null then cast(`{text_col}` as string) else {left} end")
    return out.withColumn(text_col, text).select(*[f"`{c}`" for c in docs.columns])


def op10_line_dedup(spark, sf_dir: str) -> DataFrame:
    """What removed_lines() decides over the whole table documents: doc_id, n_removed, n_near, removed (numbers of lines)."""
    out = removed_lines(table(spark, sf_dir, "documents"))
    return out.select(F.col("doc").alias("doc_id"), F.size("removed").cast("bigint").alias("n_removed"), F.col("n_near").cast("bigint").alias("n_near"), F.array_join("removed", ",").alias("removed"))


OP10_SQL = rf"""
WITH d AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(0, len(string_split(text, chr(10))))) AS no FROM documents WHERE text IS NOT NULL),
l AS (SELECT doc_id, no, line, list_filter(regexp_split_to_array(line, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM d WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
o AS (SELECT DISTINCT doc_id, no, line, w, dense_rank() OVER (ORDER BY doc_id NULLS FIRST, no) AS ord FROM l),
f AS (SELECT line, min(ord) AS ord, any_value(w) AS w FROM o GROUP BY 1),
k AS (SELECT ord, array_to_string(w, ' ') AS own FROM f WHERE len(w) >= {NEAR_WORDS}),
v AS (SELECT ord, i, array_to_string(w[1:i - 1] || w[i + 1:], ' ') AS v FROM (SELECT ord, w, unnest(range(1, len(w) + 1)) AS i FROM f WHERE len(w) >= {NEAR_WORDS})),
near AS (
  SELECT v.ord FROM v JOIN (SELECT v, i, min(ord) AS low FROM v GROUP BY 1, 2) g ON v.v = g.v AND v.i = g.i WHERE g.low < v.ord
  UNION SELECT v.ord FROM v JOIN (SELECT own, min(ord) AS low FROM k GROUP BY 1) g ON v.v = g.own WHERE g.low < v.ord
  UNION SELECT k.ord FROM k JOIN (SELECT v, min(ord) AS low FROM v GROUP BY 1) g ON k.own = g.v WHERE g.low < k.ord
  UNION SELECT k.ord FROM k JOIN (SELECT own, min(ord) AS low FROM k GROUP BY 1) g ON k.own = g.own WHERE g.low < k.ord),
h AS (SELECT o.doc_id, o.no, o.ord = f.ord AS first FROM o JOIN f ON o.line = f.line WHERE o.ord <> f.ord OR f.ord IN (SELECT ord FROM near))
SELECT doc_id, count(*) AS n_removed, count(*) FILTER (first) AS n_near, string_agg(CAST(no AS VARCHAR), ',' ORDER BY no) AS removed FROM h GROUP BY 1
"""
