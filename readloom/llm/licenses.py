"""License scans: an Aho-Corasick automaton finds notice phrases and identifier tags, a shunting-yard parser evaluates
the license expressions behind the tags.

Texts are lower-cased (A-Z only) and cut into words: runs of ASCII letters and digits and of all characters beyond ASCII.
A notice phrase matches where its words stand consecutively, whatever separates them.

Defined results: a null or empty text has 0 words and no label; a repeated row is scanned as often as it occurs; a text
of any length is scanned whole; an expression that can't be parsed gives no label; other columns of the input are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Fixed by the contract: the phrases that count as base findings.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Our further notice phrases: phrase, label, weight of the evidence.
NOTICES = {
    "bsd license": ("bsd", 0.6), "isc license": ("isc", 0.6), "mozilla public license": ("mpl", 0.7), "eclipse public license": ("epl", 0.7),
    "lesser general public license": ("lgpl", 0.8), "affero general public license": ("agpl", 0.8), "boost software license": ("bsl", 0.7), "artistic license": ("artistic", 0.6),
    "licensed under cc by": ("cc-by", 0.6), "licensed under cc by nc": ("cc-by-nc", 0.7), "licensed under cc by sa": ("cc-by-sa", 0.7), "licensed under cc0": ("cc0", 0.7),
    "creative commons attribution": ("cc-by", 0.6), "creative commons zero": ("cc0", 0.7), "all rights reserved": ("proprietary", 0.3), "released into the public domain": ("public-domain", 0.7),
    "permission is hereby granted free of charge to any person obtaining a copy": ("mit", 0.9), "redistribution and use in source and binary forms": ("bsd", 0.9),
    "permission to use copy modify and or distribute this software": ("isc", 0.9), "this is free and unencumbered software": ("unlicense", 0.9),
    "free software foundation either version": ("gpl", 0.6), "apache org licenses license 2 0": ("apache", 0.9),
}
BASE_WEIGHT, TAG_WEIGHT = 0.6, 0.9
TAG = "spdx license identifier"
SCHEMA = "id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double, expressions array<struct<text:string, ids:array<string>, permitted:boolean>>, spans array<struct<label:string, first_word:bigint, n_words:bigint>>"
#: Licenses under which an expression may be used without copyleft duties.
PERMISSIVE = frozenset("mit apache-2.0 bsd-2-clause bsd-3-clause isc zlib unlicense cc0-1.0 bsl-1.0 0bsd".split())

_KEEP = bytes(range(48, 58)) + bytes(range(97, 123)) + bytes(range(128, 256))
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c in _KEEP else 32 for c in range(256))
_TOKEN = re.compile(r"[()]|[A-Za-z0-9.+:-]+")
_BINDS = {"or": 1, "and": 2, "with": 3}


def to_postfix(tokens: list[str]) -> list[str] | None:
    """Shunting yard: with binds before and, and before or; None if the tokens aren't an expression."""
    out: list[str] = []
    held: list[str] = []
    operand_next = True
    for t in tokens:
        if t == "(":
            if not operand_next:
                return None
            held.append(t)
        elif t == ")":
            if operand_next:
                return None
            while held and held[-1] != "(":
                out.append(held.pop())
            if not held:
                return None
            held.pop()
        elif t in _BINDS:
            if operand_next:
                return None
            while held and held[-1] != "(" and _BINDS[held[-1]] >= _BINDS[t]:
                out.append(held.pop())
            held.append(t)
            operand_next = True
        else:
            if not operand_next:
                return None
            out.append(t)
            operand_next = False
    if operand_next or "(" in held:
        return None
    return out + held[::-1]


def evaluate(expression: str, allowed: frozenset[str] = PERMISSIVE) -> tuple[list[str], bool] | None:
    """The licenses that an expression names, and whether its choices (or) and duties (and) can be met by allowed ones;
    an exception (with) only adds permissions. None if it can't be parsed."""
    postfix = to_postfix(_TOKEN.findall(expression.lower()))
    if postfix is None:
        return None
    stack: list[tuple[list[str], bool]] = []
    for t in postfix:
        if t not in _BINDS:
            stack.append(([t], t.rstrip("+") in allowed))
            continue
        b, a = stack.pop(), stack.pop()
        stack.append(a if t == "with" else (a[0] + b[0], (a[1] and b[1]) if t == "and" else (a[1] or b[1])))
    return sorted(set(stack[0][0])), stack[0][1]


@lru_cache(maxsize=1)
def _automaton():
    import ahocorasick

    a = ahocorasick.Automaton()
    for phrase in {*BASE, *NOTICES, TAG}:
        a.add_word(f" {phrase} ", phrase)
    a.make_automaton()
    return a


def _head(text: str) -> str:
    """The longest beginning of a line that is an expression: what follows the tag up to the first token that can't continue it."""
    tokens, depth, operand_next = [], 0, True
    for m in re.finditer(r"[()]|[A-Za-z0-9.+:-]+|\S", text.split("\n", 1)[0]):
        t = m[0].lower()
        if t == "(" and operand_next:
            depth += 1
        elif t == ")" and not operand_next and depth:
            depth -= 1
        elif t in _BINDS and not operand_next:
            operand_next = True
        elif re.fullmatch(r"[a-z0-9.+:-]+", t) and t not in _BINDS and operand_next:
            operand_next = False
        else:
            break
        tokens.append(m[0].rstrip(".:") or m[0])
    return " ".join(tokens)


def _behind(raw: bytes, tags: list[int]) -> Iterator[str]:
    """For each tag, by the number of its first word, the rest of the line that its last word stands in, without what parts a tag from its expression."""
    kept = np.concatenate([[False], np.isin(np.frombuffer(raw.translate(_FOLD), np.uint8), np.frombuffer(_KEEP, np.uint8)), [False]])
    ends = np.flatnonzero(kept[:-1] & ~kept[1:])  # of words
    for i in tags:
        at = int(ends[i + TAG.count(" ")])
        stop = raw.find(b"\n", at)
        yield raw[at : stop if stop >= 0 else len(raw)].decode("utf-8", "replace").lstrip(" \t\r:=")


def scan(raw: bytes, allowed: frozenset[str] = PERMISSIVE) -> tuple:
    """One text's row of SCHEMA without its id."""
    words = raw.translate(_FOLD).split()
    joined = b" " + b" ".join(words) + b" "
    hits = [(end - len(p) - 1, p) for end, p in _automaton().iter(joined.decode("latin-1"))]
    if not hits:
        return len(words), 0, None, None, "", "", 0.0, [], []
    gaps = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    at = np.searchsorted(gaps, [h[0] for h in hits])
    places = sorted((int(i), p) for i, (_, p) in zip(at, hits, strict=True))
    base = [(i, BASE[p]) for i, p in places if p in BASE]
    spans = [(BASE[p] if p in BASE else NOTICES[p][0], i, p.count(" ") + 1) for i, p in places if p != TAG]
    miss, expressions = 1.0, []
    for label_weight in {(BASE[p], BASE_WEIGHT) if p in BASE else NOTICES[p] for _, p in places if p != TAG}:
        miss *= 1 - label_weight[1]
    labels = {x[0] for x in spans}
    tags = [i for i, p in places if p == TAG]
    if tags:
        for behind in _behind(raw, tags):
            head = _head(behind)
            if head and (found := evaluate(head, allowed)):
                expressions.append({"text": head, "ids": found[0], "permitted": found[1]})
                labels |= {x for x in found[0] if "," not in x}
                miss *= 1 - TAG_WEIGHT
    starts = [i for i, _ in base]
    return len(words), len(base), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in base})), ",".join(sorted(labels)), round(1 - miss, 6), expressions, [dict(zip(("label", "first_word", "n_words"), x, strict=True)) for x in spans]


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", allowed: frozenset[str] = PERMISSIVE) -> DataFrame:
    """A row for each row of docs: SCHEMA, the id under its own name. No shuffle: each task scans its own texts."""
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = docs.sparkSession.createDataFrame([], SCHEMA).schema
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, texts = b.column(0), b.column(1).cast(pa.large_binary())
            for at in range(0, b.num_rows, 1024):
                rows = [scan(t.as_py() or b"", allowed) for t in texts[at : at + 1024]]
                columns = [ids[at : at + 1024].to_pylist(), *zip(*rows, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    return docs.select(docs[id_col].cast("bigint"), docs[text_col].cast("string")).mapInArrow(run, schema).withColumnRenamed("id", id_col)


BASE_SQL = r"""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
h AS (SELECT doc_id, w, list_filter(range(0, len(w)), lambda i: w[i + 2] = 'license' AND w[i + 1] IN ('mit', 'apache')) || list_filter(range(0, len(w)), lambda i: w[i + 1] = 'general' AND w[i + 2] = 'public' AND w[i + 3] = 'license') AS hits FROM w)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(hits) AS BIGINT) AS n_base, list_min(hits) AS first_word, list_max(hits) AS last_word,
  coalesce(array_to_string(list_sort(list_distinct(list_transform(hits, lambda i: CASE w[i + 1] WHEN 'general' THEN 'gpl' ELSE w[i + 1] END))), ','), '') AS base_labels FROM h
"""


def license_base(spark, sf_dir: str) -> DataFrame:
    """The base columns of op9_license_scan, which SQL can express; labels, score, expressions and spans are the method's own."""
    return op9_license_scan(spark, sf_dir).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")


def op9_license_scan(spark, sf_dir: str) -> DataFrame:
    """The contract's digest of scan_licenses over the whole table documents."""
    from readloom.llm.common import table

    return scan_licenses(table(spark, sf_dir, "documents")).drop("expressions", "spans")
