"""Quality rules with risk-controlled thresholds, DataFrame operations only.

Each rule gives a document a value in thousandths, higher is worse. For each stratum a sequence of verdicts over all rules together is laid out first, from strict to loose: step t rejects what reaches, by any rule, the
lowest cutoff at which t percent of the documents there are bad, as estimated from the bad labels and all documents. Labels of good documents have no part in that, so
they can test the steps: in order, a step is certified if the exact binomial upper bound of its rate of rejected good documents stays under the risk; the first that fails ends the sequence (fixed-sequence
testing needs no further correction), and confidence is divided by the number of strata (Bonferroni). The last certified step is taken; a stratum without one rejects nothing beyond the base rules. So the risk
holds for all rules of a stratum together, and certifying a step takes as few good labels as the risk itself allows.

Counting a text's words, repeated windows and lines happens inside its own row with array functions: no shuffle, and a
text costs n log n at most. Only counts leave the rows; what is joined to all rows is one row for each stratum, broadcast only if it was counted to be FEW at most.

Defined results: a null or empty text has no words and fails the base rules; a repeated row is judged as often as it
occurs; documents without a label take no part in the tests, an unknown id in labels none either; the label of an id
that has several is the worst; a null stratum is a stratum of its own; without labels nothing but the base rules rejects; columns of any other name pass through.
Two 3-word windows count as equal if their 64-bit hashes are.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from readloom.llm.common import BLANKS, forget, free_prefix, stored, table

RISK, CONFIDENCE = 0.02, 0.95  #: rejected good documents of a stratum, over all rules; certainty of that
STEPS = (100, 90, 80, 70, 60, 50, 40, 30, 20, 10)  #: percent of bad documents, estimated, from a cutoff on: strict to loose
FEW = 10_000  #: strata whose cutoffs are broadcast
GRID = (5, 10, 20, 30, 50, 75, 100, 150, 200, 250, 300, 400, 500, 600, 700, 800, 900, 1000)  #: cutoffs in thousandths
MIN_WORDS, MAX_REPEAT = 50, 50  #: the contract's base rules
COUNTS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")
RULES = {
    "symbols": "1000 * n_symbols div greatest(word_chars, 1)",
    "dup_lines": "1000 * n_dup_lines div greatest(n_lines, 1)",
    "repeats": "1000 * n_repeat_words div greatest(n_words, 1)",
    "long_words": "least(1000, 20 * word_chars div greatest(n_words, 1))",
}


def measured(docs: DataFrame, text_col: str = "text", prefix: str = "") -> DataFrame:
    """docs with the counts of each text; prefix keeps their names from clashing with columns of docs."""
    p = prefix
    gap = r"[\\x20\\x09-\\x0D]"
    df = docs.withColumn(f"{p}t", F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    df = df.withColumn(f"{p}words", F.expr(f"array_remove(split({p}t, '{gap}+'), '')"))
    df = df.withColumn(f"{p}lines", F.expr(f"transform(filter(split({p}t, '\\n'), x -> x rlike '[^\\\\x20\\\\x09-\\\\x0D]'), x -> xxhash64(x))"))
    df = df.withColumns({
        f"{p}n_words": F.expr(f"cast(size({p}words) as bigint)"),
        f"{p}word_chars": F.expr(f"cast(length(translate({p}t, {BLANKS}, '')) as bigint)"),
        f"{p}n_symbols": F.expr(f"cast(length({p}t) - length(translate({p}t, '#*$%&|<>', '')) as bigint)"),
        f"{p}n_lines": F.expr(f"cast(size({p}lines) as bigint)"),
        f"{p}n_dup_lines": F.expr(f"cast(size({p}lines) - size(array_distinct({p}lines)) as bigint)"),
        f"{p}windows": F.expr(f"case when size({p}words) >= 3 then transform(slice({p}words, 1, size({p}words) - 2), (w, i) -> xxhash64(w, get({p}words, i + 1), get({p}words, i + 2))) else cast(array() as array<bigint>) end"),
    }).drop(f"{p}t", f"{p}words", f"{p}lines")
    # Texts whose windows are all different, most of them, are done; the others sort (window, start) once.
    df = df.withColumn(f"{p}sorted", F.expr(f"case when size(array_distinct({p}windows)) < size({p}windows) then sort_array(transform({p}windows, (h, i) -> struct(h as h, i as i))) end"))
    df = df.withColumn(f"{p}starts", F.expr(f"case when {p}sorted is not null then sort_array(transform(filter({p}sorted, (x, i) -> coalesce(get({p}sorted, i - 1).h = x.h, false) or coalesce(get({p}sorted, i + 1).h = x.h, false)), x -> x.i)) end"))
    df = df.withColumn(f"{p}n_repeat_words", F.expr(f"case when {p}starts is null then 0L else aggregate(transform({p}starts, (x, i) -> cast(least(3, coalesce(get({p}starts, i + 1) - x, 3)) as bigint)), 0L, (a, x) -> a + x) end"))
    # A generator's output can't be replaced by its expressions: else a filter on a count, pushed below the columns above, would sort anew for each element.
    counts = [f"{p}{n}" for n in COUNTS]
    return df.select(*docs.columns, F.explode(F.array(F.struct(*counts))).alias(f"{p}m")).select(*docs.columns, *[F.col(f"{p}m.{n}") for n in counts])


def base_failed(prefix: str = "") -> Column:
    return F.expr(f"{prefix}n_words < {MIN_WORDS} or 100 * {prefix}n_repeat_words > {MAX_REPEAT} * {prefix}n_words")


def rule_values(prefix: str = "") -> dict[str, Column]:
    out = {}
    for rule, sql in RULES.items():
        for n in COUNTS:
            sql = sql.replace(n, f"{prefix}{n}") if prefix else sql
        out[rule] = F.expr(f"cast({sql} as bigint)")
    return out


def _lgamma(x: str) -> str:
    """SQL for the logarithm of the gamma function of x >= 1: Stirling's series at x + 8."""
    z = f"({x} + 8D)"
    shift = " + ".join(f"ln({x} + {k}D)" for k in range(8))
    return f"(({z} - 0.5D) * ln({z}) - {z} + 0.9189385332046727D + 1D/(12D*{z}) - 1D/(360D*pow({z}, 3)) + 1D/(1260D*pow({z}, 5)) - ({shift}))"


def binomial_cdf(x: str, n: str, p: str) -> Column:
    """P(X <= x) of n draws that each hit with p, exact but for rounding; 1 where x lies at or above the mean, which no test accepts."""
    top = f"({_lgamma(f'({n} + 1D)')} - {_lgamma(f'({x} + 1D)')} - {_lgamma(f'({n} - {x} + 1D)')} + {x} * ln({p}) + ({n} - {x}) * ln(1D - {p}))"
    # The terms below x as products of ratios, none over 1.
    ratios = f"aggregate(sequence(0L, cast({x} as bigint)), struct(1D as term, 0D as total), (a, i) -> struct(a.term * ({x} - i) * (1D - {p}) / (({n} - {x} + i + 1D) * {p}) as term, a.total + a.term as total), a -> a.total)"
    return F.expr(f"case when {x} >= {n} * {p} then 1D else exp({top}) * {ratios} end")


def beside(rows: DataFrame, few: DataFrame, stratum: Column) -> DataFrame:
    """rows with the columns of few, a table with one row for each stratum that was written before. Its size is counted; a table of more than FEW rows is joined by shuffle."""
    small = F.broadcast(few) if few.count() <= FEW else few
    return rows.join(small, stratum.eqNullSafe(few["stratum"]), "left")


def calibrate(features: DataFrame, labels: DataFrame, id_col: str, stratum: str, rules: Sequence[str], risk: float = RISK, confidence: float = CONFIDENCE, grid: Sequence[int] = GRID, steps: Sequence[int] = STEPS) -> DataFrame:
    """features: id, stratum and a value for each rule. A row for each stratum: stratum, cutoff_<rule> (null: none). labels: id_col and quality (1: good).

    Documents are counted for each stratum, rule and place in the grid with partial aggregation; what is left has strata x rules x places rows."""
    judged = labels.where("quality is not null").groupBy(labels[id_col].alias("label_id")).agg(F.min("quality").alias("quality"))
    slim = features.select(features[id_col].alias("id"), features[stratum].alias("of"), F.array(*[features[r].cast("bigint") for r in rules]).alias("values"))
    held = stored(slim.join(judged, slim.id == judged.label_id, "left").select("of", "values", "quality"))
    reached = F.expr("case " + " ".join(f"when value >= {g} then {g}L" for g in sorted(grid, reverse=True)) + " end")
    cells = held.select("of", "quality", F.posexplode("values").alias("rule", "value")).groupBy("of", "rule", reached.alias("cutoff")).agg(F.count("*").alias("n"), F.count("quality").alias("labelled"), F.count_if(F.col("quality") < 1).alias("bad"))
    every = Window.partitionBy("of", "rule")
    upward = every.orderBy(F.desc_nulls_last("cutoff")).rowsBetween(Window.unboundedPreceding, 0)
    cells = cells.select("of", "rule", "cutoff", F.sum("n").over(upward).alias("n"), F.sum("bad").over(upward).alias("bad"), F.sum("n").over(every).alias("all_n"), F.sum("labelled").over(every).alias("all_labelled"))
    lowest = [F.min(F.when((F.col("bad") > 0) & (100 * F.col("bad") * F.col("all_n") >= t * F.col("all_labelled") * F.col("n")), F.col("cutoff"))) for t in steps]
    by_rule = cells.groupBy("of", "rule").agg(F.array(*lowest).alias("cutoffs"))
    plan = stored(by_rule.groupBy(F.col("of").alias("stratum")).agg(F.expr("transform(sort_array(collect_list(struct(rule, cutoffs))), x -> x.cutoffs)").alias("cutoffs")))

    # How many steps pass before one rejects: a later one rejects all that an earlier one does.
    first = F.expr(f"array_min(transform(sequence(0, {len(rules) - 1}), i -> size(filter(get(cutoffs, i), c -> c is null or get(values, i) < c))))")
    good = beside(held.where("quality >= 1"), plan, F.col("of")).groupBy("stratum", first.alias("first")).agg(F.count("*").alias("k"))
    tried = stored(good.groupBy("stratum").agg(F.sum("k").cast("double").alias("n"), *[F.coalesce(F.sum(F.when(F.col("first") <= j, F.col("k"))), F.lit(0)).cast("double").alias(f"x{j}") for j in range(len(steps))]))
    level = (1 - confidence) / max(1, tried.count())
    passed = F.lit(len(steps))
    for j in reversed(range(len(steps))):
        passed = F.when(binomial_cdf(f"x{j}", "n", f"{risk}D") > level, j).otherwise(passed)
    last = tried.select(F.col("stratum").alias("of"), (passed - 1).alias("last")).where("last >= 0")
    return plan.join(last, plan.stratum.eqNullSafe(last.of)).select("stratum", *[F.expr(f"get(get(cutoffs, {i}), last)").alias(f"cutoff_{r}") for i, r in enumerate(rules)])


def rejected_by(rules: Sequence[str], values: str = "", cutoffs: str = "cutoff_") -> Column:
    """Whether any rule's value reaches its stratum's cutoff. values, cutoffs: what their columns' names begin with."""
    out = F.lit(False)
    for r in rules:
        out = out | F.coalesce(F.col(f"{values}{r}") >= F.col(f"{cutoffs}{r}"), F.lit(False))
    return out


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang", risk: float = RISK, confidence: float = CONFIDENCE) -> DataFrame:
    """A row for each row of docs: id, the counts, base_failed, kept and each rule's value and cutoff."""
    slim = docs.select(docs[id_col].alias("id"), docs[stratum_col].cast("string").alias("lang"), docs[text_col].alias("text"))
    rows = measured(slim, "text").drop("text").withColumn("base_failed", base_failed()).withColumns(rule_values())
    rows = stored(rows)  # the counts cost much, and both the calibration and the verdicts need them
    cutoffs = stored(calibrate(rows.where("not base_failed"), labels.withColumnRenamed(id_col, "id"), "id", "lang", list(RULES), risk, confidence))
    out = beside(rows, cutoffs, F.col("lang")).drop("stratum")
    return out.withColumn("kept", ~F.col("base_failed") & ~rejected_by(list(RULES))).withColumnRenamed("id", id_col).withColumnRenamed("lang", "stratum")


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang", risk: float = RISK, confidence: float = CONFIDENCE) -> DataFrame:
    """The rows of docs that judge() keeps, with the columns of docs. Texts are counted once; what is written of a row are its values and 128 bits of its id, text and stratum, by which those that go are found again. So what the result
    depends on, and stays on disk as long as it isn't written, has no texts in it."""
    p = free_prefix(docs)
    own, text, of = F.col(f"`{id_col}`"), F.col(f"`{text_col}`").cast("string"), F.col(f"`{stratum_col}`").cast("string")
    prints = {f"{p}h1": F.xxhash64(own, text, of, of.isNull()), f"{p}h2": F.xxhash64(F.lit(7), own, text, of, of.isNull())}
    seen = docs.select(own.alias("id"), of.alias("lang"), text.alias("text"), *[c.alias(n.removeprefix(p)) for n, c in prints.items()])
    rows = stored(measured(seen).withColumn("base_failed", base_failed()).withColumns(rule_values()).select("id", "lang", "h1", "h2", "base_failed", *RULES))
    cutoffs = stored(calibrate(rows.where("not base_failed"), labels.withColumnRenamed(id_col, "id"), "id", "lang", list(RULES), risk, confidence))
    gone = stored(beside(rows, cutoffs, F.col("lang")).where(F.col("base_failed") | rejected_by(list(RULES))).select(F.col("h1").alias(f"{p}h1"), F.col("h2").alias(f"{p}h2")).distinct())
    forget(rows, cutoffs)
    return docs.withColumns(prints).join(gone, list(prints), "left_anti").select(*[f"`{c}`" for c in docs.columns])


def op4_quality_rules(spark, sf_dir: str) -> DataFrame:
    """The contract's columns of judge() over the whole table documents, calibrated on the whole table labels."""
    out = judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "stratum", *RULES, *[f"cutoff_{r}" for r in RULES])


def _sql() -> str:
    rules = list(RULES)
    values = {"symbols": "1000 * n_symbols // greatest(word_chars, 1)", "dup_lines": "1000 * n_dup_lines // greatest(n_lines, 1)", "repeats": "1000 * n_repeat_words // greatest(n_words, 1)", "long_words": "least(1000, 20 * word_chars // greatest(n_words, 1))"}
    grid = "[" + ", ".join(map(str, GRID)) + "]"
    cdf = f"list_sum(list_transform(range(0, CAST(x AS BIGINT) + 1), lambda i: exp(lgamma(n + 1.0) - lgamma(i + 1.0) - lgamma(n - i + 1.0) + i * ln({RISK}) + (n - i) * ln(1 - {RISK}))))"
    return f"""
WITH d AS (SELECT row_number() OVER () AS rn, doc_id, lang, coalesce(text, '') AS text FROM documents),
w AS (SELECT rn, doc_id, lang, text, list_filter(regexp_split_to_array(text, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM d),
l AS (SELECT rn, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines FROM (SELECT rn, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY 1),
g AS (SELECT rn, unnest(range(1, len(w) - 1)) AS i, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS g FROM w WHERE len(w) >= 3),
r AS (SELECT rn, i FROM (SELECT rn, i, count(*) OVER (PARTITION BY rn, g) AS k FROM g) WHERE k > 1),
p AS (SELECT rn, CAST(sum(least(3, coalesce(nxt - i, 3))) AS BIGINT) AS n_repeat_words FROM (SELECT rn, i, lead(i) OVER (PARTITION BY rn ORDER BY i) AS nxt FROM r) GROUP BY 1),
m AS (SELECT w.rn, doc_id, lang AS stratum, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(length(text) - length(translate(text, '#*$%&|<>', '')) AS BIGINT) AS n_symbols,
  CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words FROM w LEFT JOIN l USING (rn) LEFT JOIN p USING (rn)),
f AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT} * n_words AS base_failed, {", ".join(f"CAST({values[r]} AS BIGINT) AS {r}" for r in rules)} FROM m),
j AS (SELECT doc_id, min(quality) AS quality FROM labels WHERE quality IS NOT NULL GROUP BY 1),
h AS (SELECT f.stratum, [{", ".join(rules)}] AS v, quality FROM f LEFT JOIN j ON f.doc_id = j.doc_id WHERE NOT base_failed),
e AS (SELECT stratum, quality, unnest(v) AS value, unnest(range(0, {len(rules)})) AS rule FROM h),
c AS (SELECT stratum, rule, list_max(list_filter({grid}, lambda g: g <= value)) AS cutoff, count(*) AS n, count(quality) AS labelled, count(*) FILTER (quality < 1) AS bad FROM e GROUP BY 1, 2, 3),
u AS (SELECT stratum, rule, cutoff, sum(n) OVER up AS n, sum(bad) OVER up AS bad, sum(n) OVER (PARTITION BY stratum, rule) AS all_n, sum(labelled) OVER (PARTITION BY stratum, rule) AS all_labelled FROM c WINDOW up AS (PARTITION BY stratum, rule ORDER BY cutoff DESC NULLS LAST ROWS UNBOUNDED PRECEDING)),
s AS (SELECT unnest([{", ".join(map(str, STEPS))}]) AS t, unnest(range(0, {len(STEPS)})) AS step),
k AS (SELECT stratum, step, {", ".join(f"min(cutoff) FILTER (rule = {i} AND bad > 0 AND 100 * bad * all_n >= t * all_labelled * n) AS c{i}" for i in range(len(rules)))} FROM u, s GROUP BY 1, 2),
x AS (SELECT k.stratum, k.step, count(*) AS n, count(*) FILTER ({" OR ".join(f"coalesce(v[{i + 1}] >= c{i}, false)" for i in range(len(rules)))}) AS x FROM h JOIN k ON h.stratum IS NOT DISTINCT FROM k.stratum WHERE quality >= 1 GROUP BY 1, 2),
t AS (SELECT stratum, step, x >= n * {RISK} OR {cdf} > {1 - CONFIDENCE} / (SELECT count(*) FROM (SELECT DISTINCT stratum FROM x)) AS failed FROM x),
b AS (SELECT stratum, coalesce(min(step) FILTER (failed), {len(STEPS)}) - 1 AS last FROM t GROUP BY 1),
z AS (SELECT k.* FROM k JOIN b ON k.stratum IS NOT DISTINCT FROM b.stratum AND k.step = b.last)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT ({" OR ".join(f"coalesce({r} >= c{i}, false)" for i, r in enumerate(rules))}) AS kept,
  f.stratum, {", ".join(rules)}, {", ".join(f"CAST(c{i} AS BIGINT) AS cutoff_{r}" for i, r in enumerate(rules))} FROM f LEFT JOIN z ON f.stratum IS NOT DISTINCT FROM z.stratum
"""


OP4_SQL = _sql()
