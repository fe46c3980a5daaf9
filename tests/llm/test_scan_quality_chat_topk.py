import hashlib
import math
import random
import re

import pytest

from readloom.llm import chat, licenses, quality, topk
from readloom.llm.common import stored as common_stored

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, n_words int, kept string"
TEXTS = [
    None, "", " \n\t ", "word", "a b", "MIT License, mit  LICENSE;Apache\nlicense", "GNU General Public License v3 mit license",
    "SPDX-License-Identifier: (MIT OR Apache-2.0) AND GPL-3.0-only WITH Classpath-exception-2.0\nrest", "SPDX-License-Identifier: OR (", "admit license", "mit licenses", "éMIT license ñ mit license",
    "a b c a b c a b c " * 30, "x\nx\nx\n \n\ny\nx", "### $$$ %%% word " * 20, "line of words here\n" * 40, "the cat sat on the mat and " * 4000,
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en" if i % 2 else None, "s", 1, 7, "x") for i, t in enumerate(TEXTS)]
    return spark.createDataFrame([*rows, rows[5], (None, "mit license", None, None, None, None, None)], DOCS)


def expected_licenses(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    found = [(i, label) for phrase, label in licenses.BASE.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    at = [i for i, _ in found]
    return len(words), len(found), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in found}))


def test_licenses_against_brute_force(docs):
    out = licenses.scan_licenses(docs).collect()
    assert len(out) == docs.count()
    by_id = dict(enumerate(TEXTS)) | {None: "mit license"}
    for r in out:
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == expected_licenses(by_id[r.doc_id]), r
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(","))) and 0 <= r.score <= 1
    tagged = next(r for r in out if r.doc_id == 7)
    assert tagged.labels == "apache-2.0,classpath-exception-2.0,gpl-3.0-only,mit" or tagged.labels == "apache-2.0,gpl-3.0-only,mit"
    assert tagged.expressions[0].permitted is False


def test_licenses_empty_table(spark):
    assert licenses.scan_licenses(spark.createDataFrame([], DOCS)).count() == 0


def test_shunting_yard():
    assert licenses.to_postfix("a or b and c with d".split()) == "a b c d with and or".split()
    assert licenses.to_postfix("( a or b ) and c".split()) == "a b or c and".split()
    for bad in ("", "a or", "or a", "( a", "a )", "a b", "a ( b )", "( )"):
        assert licenses.to_postfix(bad.split()) is None
    assert licenses.evaluate("MIT OR GPL-3.0") == (["gpl-3.0", "mit"], True)
    assert licenses.evaluate("MIT AND GPL-3.0") == (["gpl-3.0", "mit"], False)
    assert licenses.evaluate("(MIT OR GPL-2.0) AND (Apache-2.0 OR GPL-3.0)")[1]


def expected_quality(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    from collections import Counter

    counts = Counter(windows)
    covered = {i + d for i, w in enumerate(windows) if counts[w] > 1 for d in range(3)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered), len(words) < 50 or 100 * len(covered) > 50 * len(words)


def test_quality_against_brute_force(spark, docs):
    labels = spark.createDataFrame([(1, 1, 0), (2, None, 0), (None, 1, 0), (999, 0, 0)], "doc_id bigint, quality int, toxic int")
    by_id = dict(enumerate(TEXTS)) | {None: "mit license"}
    out = quality.judge(docs, labels).collect()
    assert len(out) == docs.count()
    for r in out:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == expected_quality(by_id[r.doc_id]), r
        assert not (r.base_failed and r.kept)
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns and kept.count() == sum(r.kept for r in out)
    assert quality.judge(spark.createDataFrame([], DOCS), labels).count() == 0


def test_binomial_cdf(spark):
    def cdf(x, n, p):
        return sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(x + 1))

    cases = [(0, 10, 0.1), (3, 100, 0.1), (7, 900, 0.01), (50, 1000, 0.1), (0, 3000, 0.005)]
    rows = spark.createDataFrame([(float(x), float(n), p) for x, n, p in cases], "x double, n double, p double").select(quality.binomial_cdf("x", "n", "p")).collect()
    for (x, n, p), (got,) in zip(cases, rows, strict=True):
        assert got == pytest.approx(cdf(x, n, p), rel=1e-6)


def test_cutoffs_hold_the_risk(spark):
    """On fresh rows of the same kind, rejected good documents stay within the risk; junk is rejected."""
    rng = random.Random(3)

    def rows(first, n):
        return [(first + i, int(g := rng.random() < 0.8), "a" if i % 3 else "b", min(1000, max(0, int(rng.gauss(20 if g else 400, 40))))) for i in range(n)]

    held, fresh = rows(0, 6000), rows(10_000, 6000)
    features = spark.createDataFrame([(i, s, v) for i, _, s, v in held], "id bigint, stratum string, noise bigint")
    labels = spark.createDataFrame([(i, g) for i, g, _, _ in held], "id bigint, quality int")
    cut = {r.stratum: r.cutoff_noise for r in quality.calibrate(features, labels, "id", "stratum", ["noise"]).collect()}
    assert set(cut) == {"a", "b"}
    for s, c in cut.items():
        good = [v for _, g, t, v in fresh if g and t == s]
        bad = [v for _, g, t, v in fresh if not g and t == s]
        assert sum(v >= c for v in good) / len(good) < 0.02 and sum(v >= c for v in bad) / len(bad) > 0.9


def test_chat_round_trip(spark):
    turns = [
        (1, 0, "user", "</s>[INST] <|end|> \\l \\\\b \\ ["), (1, 1, "assistant", "é\\"), (1, 2, "user", None), (1, 3, "Assistant", "two"), (1, 4, "user", "last"),
        (2, 0, "user", "alone"), (3, 0, "assistant", ""), (4, None, None, "x"), (4, 1, "assistant", "y"), (4, 1, "assistant", "y"), (None, 0, "we<ird|>", "z"), (None, 1, "assistant", "w" * 100_000), (None, 1, "assistant", "w"),
    ]
    df = spark.createDataFrame(turns, "conv_id bigint, turn bigint, role string, text string").selectExpr("*", "1 as formatted", "2 as examples", "3 as row")
    made = chat.format_conversations(df)
    back = {(r.conv_id, r.formatted): r for r in chat.read_back(made).collect()}
    examples = chat.replies(chat.expand_targets(made.withColumn("whole", made.formatted))).collect()
    assert sum(c is None for c, _ in back) == 3 and len(back) == 7
    for (c, formatted), r in back.items():
        own = sorted(((t[1], t[2] or "", t[3] or "") for t in turns if t[0] == c), key=lambda x: (x[0] is not None, x[0], x[1], x[2]))
        if c is None:
            own = [x for x in own if x[1:] == tuple(r.turns[0])]
        assert [(t.role, t.text) for t in r.turns] == [(a, x) for _, a, x in own]
        replies = [x for _, a, x in own if a.lower() == "assistant"]
        mine = sorted((e for e in examples if e.whole == formatted), key=lambda e: e.chars)
        assert [e.reply for e in mine if e.target is not None] == replies
        for e in mine:
            assert formatted[: e.context_chars] == e.prompt and formatted[e.context_chars : e.chars] == e.completion
            if e.target is not None:
                assert e.completion.endswith(chat.END) and e.completion.count("<") == 1
    assert chat.format_conversations(df.limit(0)).count() == 0


def test_chat_mask_decides(spark):
    """Replies are what the mask covers; a mask that is off gives other text or an error, never the turn that was meant."""
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([(1, 0, "user", "ab"), (1, 1, "assistant", "cdef")], "conv_id bigint, turn bigint, role string, text string")
    made = chat.format_conversations(rows)
    moved = made.withColumn("examples", F.expr("transform(examples, e -> struct(e.target, e.context_chars + 1 as context_chars, e.chars))"))
    assert [r.reply for r in chat.replies(chat.expand_targets(moved)).collect()] == ["def"]
    for wrong in ("struct(e.target, e.context_chars, e.chars - 1 as chars)", "struct(e.target, 0L as context_chars, e.chars)", "struct(e.target - 1 as target, e.context_chars, e.chars)"):
        with pytest.raises(Exception, match="loss mask"):
            chat.expand_targets(made.withColumn("examples", F.expr(f"transform(examples, e -> {wrong})"))).collect()


def test_chat_long_conversation(spark, tmp_path):
    """80,000 turns of one conversation, which took a minute when each turn copied all places before it."""
    import time

    rows = spark.range(80_000).selectExpr("7L as conv_id", "id as turn", "if(id % 2 = 0, 'user', 'assistant') as role", "concat('text <', id) as text")
    rows.write.parquet(str(tmp_path / "conversations.parquet"))
    begin = time.time()
    out = {r.conv_id: r for r in chat.op5_chat_format(spark, str(tmp_path)).collect()}
    loss = "".join(f"text <{i}" for i in range(1, 80_000, 2))
    assert out[7].n_turns == 80_000 and out[7].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest() and time.time() - begin < 30


def test_chat_query_digest(spark, tmp_path):
    spark.createDataFrame([(5, 0, "user", "a"), (5, 1, "assistant", "b<")], "conv_id bigint, turn bigint, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    out = {r.conv_id: r for r in chat.op5_chat_format(spark, str(tmp_path)).collect()}
    assert set(out) == {-1, 5} and out[5].loss_chars == 2 and out[5].n_turns == 2
    assert out[5].loss_sha256 == hashlib.sha256(b"b<").hexdigest() and out[5].turns_sha256 == hashlib.sha256(b"user\na\nassistant\nb<\n").hexdigest()


def brute_top_k(rows, k, every):
    ok = [(r, i, [math.floor(256 * x) for x in v]) for r, (i, v) in enumerate(rows) if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for r, q, x in ok:
        if q % every == 0:
            scored = sorted((-sum(a * b for a, b in zip(x, v, strict=True)), i) for s, i, v in ok if s != r and len(v) == len(x))
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored[:k])]
    return sorted(out)


@pytest.mark.parametrize("blocks", [(1024, 4096), (3, 17)])
def test_top_k_against_brute_force(spark, blocks):
    rng = random.Random(1)
    rows = [(i, [rng.gauss(i % 3, 1) for _ in range(10)]) for i in range(240)]
    rows += [(i, [0.5] * 10) for i in range(300, 330)] + [(i, [-0.25] * 10) for i in range(330, 340)]  # ties, far vectors
    rows += [(400, None), (401, [None] * 10), (402, [float("nan")] * 10), (403, [float("inf")] * 10), (None, [1.0] * 10), (450, [1.0, 2.0]), (451, [3.0, 4.0]), (rows[7][0], rows[7][1]), (20, rows[20][1]), (20, rows[21][1])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").selectExpr("*", "1 as score", "2 as v")
    out = topk.top_k(df, 5, 10, query_block=blocks[0], candidate_block=blocks[1])
    assert sorted(map(tuple, out.collect())) == brute_top_k(rows, 5, 10)
    assert topk.top_k(df.limit(0)).count() == 0


def test_top_k_of_large_components(spark):
    rng = random.Random(2)
    for size, k in ((1e6, 5), (2.0**22, 5)):
        rows = [(i, [rng.gauss(0.3, 0.5) * size for _ in range(4)]) for i in range(60)]
        df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
        out = sorted(map(tuple, topk.top_k(df, k, 10, query_block=3, candidate_block=17).collect()))
        assert out == brute_top_k(rows, k, 10) and max(r[3] for r in out) > 2**53
    # The best score doesn't fit: no wrong ranks, an error.
    far = spark.createDataFrame([(0, [3e7, 3e7]), (1, [1e9, 1e9]), (2, [2e7, 3e7])], "vec_id bigint, embedding array<double>")
    with pytest.raises(Exception, match="64 bits"):
        topk.top_k(far, 2, 10).collect()
    # One that doesn't fit but isn't asked for is no error.
    low = spark.createDataFrame([(0, [3e7, 3e7]), (1, [-1e9, -1e9]), (2, [2e4, 3e4])], "vec_id bigint, embedding array<double>")
    assert [tuple(r) for r in topk.top_k(low, 1, 10).collect()] == brute_top_k([(0, [3e7, 3e7]), (1, [-1e9, -1e9]), (2, [2e4, 3e4])], 1, 10)


def test_top_k_prunes():
    import numpy as np

    rng = np.random.default_rng(0)
    v = rng.normal(size=(2000, 64)).cumsum(1) * 50  # neighbouring components alike: what segment means can tell apart
    counts = []
    topk._best(v[:64].astype(int), np.arange(64), np.arange(64), v.astype(int), np.arange(2000), np.arange(2000), 5, counts)
    assert counts[0][-1] < 0.2 * counts[0][0]


def test_long_license_expressions_are_read_to_their_line_end():
    for behind in ("", "\nmore text"):
        row = licenses.scan(("SPDX-License-Identifier: " + "MIT OR " * 500 + "Apache-2.0 AND GPL-3.0-only" + behind).encode())
        assert "gpl-3.0-only" in row[5].lower() and row[7][0]["text"].lower().endswith("gpl-3.0-only")


def quality_corpus(spark, tmp_path):
    rng = random.Random(12)
    rows, labels = [], []
    for i in range(2400):
        bad = rng.random() < 0.1
        words = ["".join(rng.choices("abcdefghij", k=rng.randrange(3, 9))) for _ in range(rng.randrange(55, 80))]
        if bad:
            for _ in range(rng.randrange(8, 30)):
                words.insert(rng.randrange(len(words)), rng.choice(["$$$", "###", "<|>"]))
        text = " ".join(words) + ("\n#" if rng.random() < 0.1 else "")
        rows.append((i, text, ("a", "b", None)[i % 3], "s", 1, i, "k", 5))
        if i % 4:
            labels.append((i, int(not bad), 0))
    docs = spark.createDataFrame([*rows, (rows[0][0], *rows[0][1:]), (None, None, None, None, None, None, None, None)], "doc_id bigint, text string, lang string, source string, n_chars bigint, own_symbols bigint, cutoff_symbols string, n_words bigint")
    labels = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    return docs, labels, {r[0]: r for r in rows}


def test_quality_certifies_every_stratum(spark, tmp_path):
    """Cutoffs in each stratum, rejected good documents of all rules together within the risk, the query equal to its SQL, and columns of clashing names kept."""
    import duckdb

    docs, labels, _ = quality_corpus(spark, tmp_path)
    out = quality.judge(docs, labels).collect()
    quality_of = {r.doc_id: r.quality for r in labels.collect()}
    for s in ("a", "b", None):
        own = [r for r in out if r.stratum == s and not r.base_failed]
        assert own[0].cutoff_symbols is not None
        good = [r.kept for r in own if quality_of.get(r.doc_id) == 1]
        bad = [r.kept for r in own if quality_of.get(r.doc_id) == 0]
        assert good.count(False) <= 0.02 * len(good) and bad.count(True) < 0.2 * len(bad)
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns and sorted(kept.collect(), key=str) == sorted((r for r in docs.collect() if r.doc_id in {x.doc_id for x in out if x.kept}), key=str)
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tmp_path}/{t}.parquet/*.parquet')")
    query = quality.op4_quality_rules(spark, str(tmp_path))
    expected = con.execute(quality.OP4_SQL)
    order = [[c[0] for c in expected.description].index(c) for c in query.columns]
    assert sorted(map(tuple, query.collect()), key=str) == sorted((tuple(r[i] for i in order) for r in expected.fetchall()), key=str)


def test_quality_bound_without_enough_labels(spark):
    """No cutoff where too few good labels bound the risk."""
    rows = [(i, "s", 900 if i % 10 == 0 else 0) for i in range(200)]
    features = spark.createDataFrame(rows, "id bigint, stratum string, noise bigint")
    labels = spark.createDataFrame([(i, int(i % 10 > 0)) for i in range(100)], "id bigint, quality int")
    assert [r.cutoff_noise for r in quality.calibrate(features, labels, "id", "stratum", ["noise"]).collect()] in ([], [None])
    assert [r.cutoff_noise for r in quality.calibrate(features, labels, "id", "stratum", ["noise"], risk=0.2).collect()] == [900]


def test_license_tags_are_where_the_automaton_found_them():
    cases = [
        ("SPDX-License-Identifier: MIT", "mit"), ("// spdx license identifier = Apache-2.0 OR MIT */", "apache-2.0,mit"), ("SPDX_LICENSE_IDENTIFIER:\tISC\r\nGPL-2.0", "isc"), ("SPDX\nLicense\nIdentifier: Zlib", "zlib"),
        ("spdx license identifiers: MIT", ""), ("SPDX-License-Identifier:\nMIT", ""), ("é SPDX-License-Identifier: 0BSD é", "0bsd"), ("SPDX-License-Identifier: MIT SPDX-License-Identifier: ISC", "isc,mit"), ("SPDX-License-Identifier:", ""),
    ]
    for text, labels in cases:
        assert licenses.scan(text.encode())[5] == labels, text
    row = licenses.scan(("SPDX-License-Identifier: " + " OR ".join(f"License-{i}" for i in range(400))).encode())
    assert len(row[5].split(",")) == 400


def test_license_labels_and_score_exactly():
    row = licenses.scan(TEXTS[7].encode())
    assert row[4] == "" and row[5] == "apache-2.0,gpl-3.0-only,mit" and row[6] == 0.9 and row[7][0]["ids"] == ["apache-2.0", "gpl-3.0-only", "mit"] and row[7][0]["permitted"] is False
    row = licenses.scan(b"BSD license, MIT license")
    assert row[4:7] == ("mit", "bsd,mit", round(1 - 0.4 * 0.4, 6)) and [x["first_word"] for x in row[8]] == [0, 2]


def test_license_base_columns_against_sql(spark, docs, tmp_path):
    import duckdb

    docs.where("doc_id is not null").write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    expected = con.execute(licenses.BASE_SQL).fetchall()
    out = licenses.license_base(spark, str(tmp_path)).collect()
    assert sorted(map(tuple, out), key=str) == sorted(expected, key=str)


def test_quality_keeps_no_texts_on_disk(spark, monkeypatch):
    """What the kept rows depend on are no copies of the texts; equal texts in two strata, repeated rows, nulls and other columns come back as they were."""
    written = []
    monkeypatch.setattr(quality, "stored", lambda df, *a: (written.append(df.columns), common_stored(df, *a))[1])
    good, bad = " ".join(f"word{i}" for i in range(60)), " ".join(["a b c"] * 30)
    rows = [(1, good, "en", 5), (1, good, "en", 5), (2, good, None, 6), (None, good, "de", 7), (3, bad, "en", 8), (4, None, "en", 9), (5, "", None, 9), (None, bad, None, 9)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, h1 int")
    kept = quality.keep_good(docs, spark.createDataFrame([], "doc_id bigint, quality int"))
    assert kept.columns == docs.columns and sorted(map(repr, map(tuple, kept.collect()))) == sorted(map(repr, rows[:4]))
    assert written and not any("text" in c for columns in written for c in columns)
