r"""Chat formatting by prefix-target expansion, DataFrame operations only.

A turn is formatted as  <|role|>text<|end|>  with role and text escaped: \ as \\, < as \l, [ as \b, | as \p. No <, [ or | of a text is left,
so no text can hold a turn mark or another template's control string (such as </s> or [INST]), and unescaping gives the text back.
Each assistant turn becomes an example of its own: all turns before it are context, only its reply and end mark are trainable. Turns after the
last assistant turn, or a conversation without one, form an example that trains nothing, so that no turn is lost.

A conversation is formatted once, as one string, and an example's loss mask is a range of characters in it: context_chars to chars; what stands before is its prompt. All prompts of
a conversation together grow with the square of its turns, so expand_targets() cuts them out only when asked to, while completions are cut out by the mask in linear time: the string is parsed into turns, and each
mask is laid over the turn that ends where it does. Places are summed up in blocks of about the square root of a conversation's turns, which keeps long conversations cheap. Turns are gathered with partial aggregation before the shuffle.

Defined results: null texts and roles count as empty; a role counts as assistant in any case of letters; rows of one turn number follow by role, then text; rows without a
turn number come first; repeated rows are repeated turns; a row without conv_id is a conversation of its own (nothing says which others it belongs to); an empty table gives an empty result; other columns are ignored. A conversation's
text stands in one row, so it may have up to 2 GB.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from readloom.llm.common import stored, table

END = "<|end|>"
MARKS = (("<", "\\l"), ("[", "\\b"), ("|", "\\p"))


def escaped(c: Column) -> Column:
    for plain, mark in (("\\", "\\\\"), *MARKS):
        c = F.replace(c, F.lit(plain), F.lit(mark))
    return c


def unescaped(c: Column) -> Column:
    """Pairs are read from the left, so doubled escape marks are taken out first."""

    def plain(x: Column) -> Column:
        for text, mark in MARKS:
            x = F.replace(x, F.lit(mark), F.lit(text))
        return x

    return F.array_join(F.transform(F.split(c, r"\\\\"), plain), "\\")


def _upto(array: str) -> str:
    """SQL: the running sums of an array of numbers, in blocks: appending to an array copies it, so no array that is appended to grows over the square root of all."""
    block = f"cast(ceil(sqrt(size({array}))) as int)"
    blocks = f"transform(sequence(0, cast(ceil(size({array}) / {block}) as int) - 1), b -> slice({array}, b * {block} + 1, {block}))"
    summed = "(a, x) -> struct(array_append(a.all, a.n + x) as all, a.n + x as n)"
    within = f"transform({blocks}, p -> aggregate(p, struct(cast(array() as array<bigint>) as all, 0L as n), {summed}, a -> a.all))"
    before = "aggregate(parts, struct(cast(array() as array<bigint>) as all, 0L as n), (a, p) -> struct(array_append(a.all, a.n) as all, a.n + element_at(p, -1) as n), a -> a.all)"
    return f"case when size({array}) = 0 then cast(array() as array<bigint>) else element_at(transform(array({within}), parts -> element_at(transform(array({before}), starts -> flatten(zip_with(parts, starts, (p, s) -> transform(p, x -> x + s)))), 1)), 1) end"


def format_conversations(rows: DataFrame) -> DataFrame:
    """conv_id, formatted, and examples: target (the turn it trains, from 0; null: none), context_chars, chars. rows: conv_id, turn, role, text."""
    text, role = F.coalesce(F.col("text").cast("string"), F.lit("")), F.coalesce(F.col("role").cast("string"), F.lit(""))
    turn = F.struct(F.col("turn"), role.alias("role"), text.alias("text"))
    whole = rows.where("conv_id is not null").groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    turns = whole.unionByName(rows.where("conv_id is null").select("conv_id", F.array(turn).alias("turns")))
    made = turns.select("conv_id", F.transform("turns", lambda t: F.concat(F.lit("<|"), escaped(t.role), F.lit("|>"), escaped(t.text), F.lit(END))).alias("pieces"), F.transform("turns", lambda t: F.lower(t.role) == "assistant").alias("trains"), F.transform("turns", lambda t: F.length(escaped(t.role)) + 4).alias("heads"))
    made = made.withColumn("sizes", F.expr("transform(pieces, x -> cast(length(x) as bigint))"))
    made = made.select("conv_id", F.array_join("pieces", "").alias("formatted"), "trains", "heads", "sizes", F.expr(_upto("sizes")).alias("ends"))
    # The last turn has an example even where it trains nothing.
    example = "transform(sequence(1, size(ends)), i -> case when trains[i - 1] then struct(i - 1 as target, ends[i - 1] - sizes[i - 1] + heads[i - 1] as context_chars, ends[i - 1] as chars) when i = size(ends) then struct(cast(null as int) as target, ends[i - 1] as context_chars, ends[i - 1] as chars) end)"
    return made.select("conv_id", "formatted", F.expr(f"filter({example}, x -> x is not null)").alias("examples"))


def _parsed(formatted: DataFrame) -> DataFrame:
    """formatted with pieces (its turns as they stand, each with its end mark) and ends (the characters up to each one's end): from the strings alone."""
    cuts = f"split(formatted, '{END.replace('|', chr(92) * 2 + '|')}')"
    out = formatted.withColumn("pieces", F.expr(f"transform(slice({cuts}, 1, size({cuts}) - 1), p -> concat(p, '{END}'))"))
    return out.withColumn("sizes", F.expr("transform(pieces, p -> cast(length(p) as bigint))")).withColumn("ends", F.expr(_upto("sizes"))).drop("sizes")


def expand_targets(formatted: DataFrame, with_text: bool = True) -> DataFrame:
    """A row for each example: the columns of formatted but formatted and examples, then target, context_chars, chars, and completion: the characters under its loss mask. with_text also gives prompt, all
    characters before. Only what formatted and examples hold decides; a mask that doesn't lie within one turn up to its end is an error."""
    keys = [c for c in formatted.columns if c not in ("formatted", "examples")]
    # The turn's number says where to look; where it ends must be where the mask does.
    piece = "get(pieces, coalesce(e.target, size(pieces) - 1))"
    at = "get(ends, coalesce(e.target, size(ends) - 1))"
    start = f"{at} - length({piece})"
    cut = f"case when {at} = e.chars and e.context_chars between {start} and e.chars then substring({piece}, cast(e.context_chars - ({start}) as int) + 1, cast(e.chars - e.context_chars as int)) else cast(raise_error('a loss mask beyond its turn') as string) end"
    fields = ["e.target as target", "e.context_chars as context_chars", "e.chars as chars", f"{cut} as completion"]
    if with_text:
        fields.append("substring(formatted, 1, cast(e.context_chars as int)) as prompt")
    return _parsed(formatted).select(*keys, F.inline(F.expr(f"transform(examples, e -> struct({', '.join(fields)}))")))


def replies(examples: DataFrame) -> DataFrame:
    """examples with reply: the completion without its end mark, unescaped; null where nothing is trained."""
    return examples.withColumn("reply", F.when(F.col("target").isNotNull(), unescaped(F.expr(f"substring(completion, 1, length(completion) - {len(END)})"))))


def read_back(formatted: DataFrame) -> DataFrame:
    """formatted with turns (role, text), parsed from its strings alone."""
    parts = f"transform(pieces, p -> struct(substring_index(substring(p, 3), '|>', 1) as role, substring(p, instr(p, '|>') + 2, length(p) - instr(p, '|>') - {1 + len(END)}) as text))"
    out = _parsed(formatted).withColumn("turns", F.expr(parts))
    return out.withColumn("turns", F.transform("turns", lambda t: F.struct(unescaped(t.role).alias("role"), unescaped(t.text).alias("text")))).drop("pieces", "ends")


def op5_chat_format(spark, sf_dir: str) -> DataFrame:
    """The contract's digest, read back from the written conversations and their examples; formatted_chars counts all examples' prompts and completions."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    own = spark.range(2).select(F.lit(-1).cast("bigint").alias("conv_id"), F.col("id").cast("bigint").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"))
    made = stored(format_conversations(rows.unionByName(own)).withColumn("row", F.monotonically_increasing_id()))  # numbers of written rows stay
    loss = replies(expand_targets(made, with_text=False)).groupBy("row").agg(F.expr("array_join(transform(sort_array(collect_list(case when reply is not null then struct(target, reply) end)), x -> x.reply), '')").alias("loss"), F.sum("chars").alias("formatted_chars"))
    all_turns = F.array_join(F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")
    back = read_back(made).select("row", "conv_id", F.size("turns").cast("bigint").alias("n_turns"), F.sha2(all_turns.cast("binary"), 256).alias("turns_sha256"))
    digests = loss.select("row", F.length("loss").cast("bigint").alias("loss_chars"), F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"), "formatted_chars")
    return back.join(digests, "row").select("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")


OP5_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), n AS (
  SELECT *, length(role) + length(regexp_replace(role, '[^\\<\[|]', '', 'g')) + length(text) + length(regexp_replace(text, '[^\\<\[|]', '', 'g')) + 11 AS chars,
         row_number() OVER w AS i, count(*) OVER (PARTITION BY conv_id) AS n
  FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
), s AS (SELECT *, sum(chars) OVER (PARTITION BY conv_id ORDER BY i) AS upto FROM n)
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
       coalesce(sum(CASE WHEN lower(role) = 'assistant' THEN length(text) END), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(CASE WHEN lower(role) = 'assistant' THEN text END, '' ORDER BY i), '')) AS loss_sha256,
       sum(CASE WHEN lower(role) = 'assistant' OR i = n THEN upto ELSE 0 END)::BIGINT AS formatted_chars
FROM s GROUP BY conv_id
"""
