"""Ranked search, token files and hard negatives against brute force."""

import math
import random
import re
import struct
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from readloom.llm import negatives, ranking, tokenfiles

BPE = public_tokenizers.path("byte_bpe_50k.json")
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOW = str.maketrans(ranking.UPPER, ranking.LOWER)


# Ranked search.


def terms_of(text):
    return TERM.findall((text or "").translate(LOW))


def ranked(docs, items, k=10):
    counted = [(i, Counter(terms_of(t))) for i, t in docs]
    counted = [(i, c, c.total()) for i, c in counted if c]
    n, total = len(counted), sum(x[2] for x in counted)
    df = Counter(t for _, c, _ in counted for t in c)
    asked = defaultdict(Counter)
    for i, t in items:
        asked[i].update(terms_of(t))
    out = []
    for item, words in asked.items():
        scores = []
        for i, c, size in counted:
            m = 25 + (75 * size * n) // total
            s = sum(times * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 8 * m)) for t, times in words.items() if c[t])
            if s > 0:
                scores.append((-s, i is None, i, s))
        scores.sort(key=lambda x: (x[0], x[1], x[2] or 0))
        out += [(item, r + 1, x[2], x[3]) for r, x in enumerate(scores[:k])]
    return sorted(out, key=str)


def some_docs():
    rng = random.Random(4)
    words = [f"w{i}" for i in range(40)] + ["Ünder", "ÀB", "日本", "x", "x"]
    docs = [(i, " ".join(rng.choices(words, weights=[1 / (1 + j) for j in range(45)], k=rng.randrange(0, 60)))) for i in range(200)]
    docs += [(7, docs[7][1]), (7, docs[7][1]), (None, docs[3][1]), (None, "w39 ünder"), (300, None), (301, ""), (302, " .,-\x00\x7f"), (303, "W1-w1_W1\tw2 w3"), (304, "w5 " * 40000 + "日本"), (305, docs[9][1])]
    items = [(0, "w1 w1 W39, under"), (1, "Ünder ünder àb"), (2, "w3 w4 w5 w6 w7 w8 w9 w30 w31 w32"), (3, None), (4, ""), (5, "nowhere"), (None, "w38 日本"), (6, " ".join(words)), (6, "w1"), (8, docs[7][1])]
    return docs, items


@pytest.mark.parametrize("shard,block", [(7, 2), (1 << 14, 256)])
def test_search_against_brute_force(spark, shard, block):
    docs, items = some_docs()
    d = spark.createDataFrame([(*x, "s", 1, 2) for x in docs], "doc_id bigint, text string, term string, n int, row int").repartition(3)
    i = spark.createDataFrame([(*x, 0) for x in items], "item_id bigint, text string, doc_id int")
    got = sorted((tuple(r) for r in ranking.search(d, i, shard_docs=shard, block_items=block).collect()), key=str)
    assert got == ranked(docs, items)


def test_search_of_nothing(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    items = spark.createDataFrame([(1, "a b")], "item_id bigint, text string")
    assert ranking.search(docs, items).collect() == []
    some = spark.createDataFrame([(1, "a b")], "doc_id bigint, text string")
    assert ranking.search(some, items.limit(0)).collect() == []
    assert [tuple(r)[:3] for r in ranking.search(some, items).collect()] == [(1, 1, 1)]


def test_best_of_shard_skips_and_loses_nothing():
    rng = np.random.default_rng(3)
    skipped = []
    for _ in range(60):
        n, t = int(rng.integers(1, 3000)), int(rng.integers(1, 12))
        lists = [np.sort(rng.choice(n, int(rng.integers(0, n + 1) * rng.random() ** 3), replace=False)) for _ in range(t)]
        docs, terms = np.concatenate(lists).astype(np.int64), np.repeat(np.arange(t), [len(x) for x in lists])
        gains = rng.integers(1, 50, len(docs))
        wanted, weights = rng.permutation(t), rng.integers(0, 40, t)
        total = np.zeros(n, np.int64)
        for w, x in zip(weights, wanted, strict=True):
            np.add.at(total, docs[terms == x], gains[terms == x] * w)
        order = [i for i in np.lexsort((np.arange(n), -total)) if total[i] > 0][:5]
        found, scores = ranking.best_of_shard(docs, terms, gains, wanted, weights, 5, skipped)
        assert found.tolist() == order and scores.tolist() == total[order].tolist()
    held, scored = np.array(skipped).sum(0)
    assert scored < 0.7 * held


# Token files.


TOKENIZER = Tokenizer.from_file(BPE)


def library(text):
    return TOKENIZER.encode(text or "", add_special_tokens=False).ids + [0]


def frames(path):
    """What a reader without an index gets from a file."""
    mask = lambda c: ((((c >> 15) | (c << 17)) & 0xFFFFFFFF) + 0xA282EAD8) % 2**32
    data = open(path, "rb").read()
    at = 0
    while at < len(data):
        n, check = struct.unpack_from("<QI", data, at)
        assert check == mask(zlib.crc32(data[at : at + 8]))
        payload = data[at + 12 : at + 12 + n]
        assert struct.unpack_from("<I", data, at + 12 + n)[0] == mask(zlib.crc32(payload))
        yield at, n + 16, payload
        at += n + 16


def odd_texts():
    rng = random.Random(1)
    letters = "ab ,.'\n\té\x1c\x1f\xa0᠎Σ1½s!  ​\x85　ª×Ã<|>"
    out = ["".join(rng.choices(letters, k=rng.randrange(0, 30))) for _ in range(1500)]
    return out + ["don't. It's  ok\n\n\nx\n", " a", "a ", "\n", "x\ny", "x \ny", "a <|endoftext|> b", "a  <|endoftext|>", "<|endoftext|", "日本語 です。", "é.è", "word" * 50000, "two words\n" * 20000, "Ã " * 9]


def test_cuts_change_no_ids():
    texts = odd_texts()
    encoder, tokenizer = tokenfiles.Encoder(BPE, False), Tokenizer.from_file(BPE)
    want = [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert encoder.cuts
    for _ in range(2):  # the second time from kept pieces
        assert [x.tolist() for x in encoder.encode([t.encode() for t in texts])] == want
    assert encoder.encode([]) == [] and encoder.encode([b""])[0].tolist() == []
    tokenizer.encode_special_tokens = True
    plain = tokenfiles.Encoder(BPE, True)
    assert [x.tolist() for x in plain.encode([t.encode() for t in texts])] == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_files_index_and_shuffled_reading(spark, tmp_path):
    texts = odd_texts()[::9]
    docs = [(i * 3 % 400, t) for i, t in enumerate(texts)] + [(5, "a"), (5, "b"), (5, None), (5, ""), (None, "no id"), (-2, "first"), (7, texts[0]), (7, texts[0])]
    d = spark.createDataFrame([(*x, "s", 1) for x in docs], "doc_id bigint, text string, part string, offset int").repartition(3)
    index = tokenfiles.write_records(d, BPE, folder=str(tmp_path))
    rows = sorted(index.collect(), key=lambda r: (r.part, r.offset))
    # Ids ascend over all files; a file read without the index holds what the index says.
    assert [r.doc_id for r in rows] == sorted((i for i, _ in docs), key=lambda i: (i is not None, i or 0))
    held = {(f, at, n) for f in {r.file for r in rows} for at, n, _ in frames(f)}
    assert held == {(r.file, r.offset, r["size"]) for r in rows}
    want = sorted(((i, struct.pack(f"<{len(x := library(t))}I", *x)) for i, t in docs), key=str)
    for seed in (None, 3):
        assert sorted(((r.doc_id, bytes(r.ids)) for r in tokenfiles.read_records(index, seed).collect()), key=str) == want
    # In a shuffled order the records come as the seed says, not as the files do.
    assert [(r.part, r.offset) for r in tokenfiles.read_records(index, 3).collect()] != [(r.part, r.offset) for r in rows]
    out = tokenfiles.digests(tokenfiles.read_records(index, 3)).collect()
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in out) == Counter((i, len(b) // 4, zlib.crc32(b)) for i, b in want)
    ordered = sorted(out, key=lambda r: r.start)
    assert [r.start for r in ordered] == [sum(x.n_tokens for x in ordered[:k]) for k in range(len(ordered))]
    assert [r.doc_id for r in ordered] == [r.doc_id for r in rows]


def test_damaged_records_and_nothing(spark, tmp_path):
    d = spark.createDataFrame([(1, "one two"), (2, "three")], "doc_id bigint, text string").coalesce(1)
    index = tokenfiles.write_records(d, BPE, folder=str(tmp_path))
    for r in index.collect():
        data = bytearray(open(r.file, "rb").read()[r.offset : r.offset + r["size"]])
        for at in range(len(data)):
            data[at] ^= 4
            with pytest.raises(ValueError, match="damaged"):
                tokenfiles.payload_of(bytes(data), "here")
            data[at] ^= 4
        with pytest.raises(ValueError, match="damaged"):
            tokenfiles.payload_of(bytes(data[:-1]), "here")
    empty = tokenfiles.write_records(d.limit(0), BPE, folder=str(tmp_path))
    assert empty.collect() == [] and tokenfiles.digests(tokenfiles.read_records(empty)).collect() == []
    wrong = index.withColumn("offset", F.col("offset") + 1)
    with pytest.raises(Exception, match="damaged record"):
        tokenfiles.read_records(wrong).collect()


# Hard negatives.


def mined(rows, every=10, n_pos=5, n_neg=5, percent=80):
    v = [(r, i, lab, [math.floor(Fraction(c) * 256) for c in x]) for r, (i, lab, x) in enumerate(rows) if i is not None and lab is not None and x is not None and all(c is not None and math.isfinite(c) for c in x)]
    out = []
    for r, i, lab, x in v:
        if i % every:
            continue
        scored = [(-sum(a * b for a, b in zip(x, y, strict=True)), j, l2) for s, j, l2, y in v if s != r and len(y) == len(x)]
        for p, j, _ in sorted(t for t in scored if t[2] == lab)[:n_pos]:
            inside = sorted((n, m) for n, m, l2 in scored if l2 != lab and percent * -p <= 100 * -n <= 100 * -p)
            out += [(i, j, k + 1, m, -p, -n) for k, (n, m) in enumerate(inside[:n_neg])]
    return sorted(out)


def run(spark, rows, **sizes):
    t = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id bigint, label int, embedding array<double>, row int, bits int").repartition(3)
    return sorted(tuple(r) for r in negatives.hard_negatives(t, F.col("vec_id") % 10 == 0, **sizes).collect())


def vectors(n=240, dim=5, size=1.0):
    rng = random.Random(dim)
    return [(i, i % 4 if i % 3 else 1, [rng.gauss(0.2, 0.5) * size for _ in range(dim)]) for i in range(n)]


@pytest.mark.parametrize("dim,sizes", [(5, {"anchor_block": 4, "candidate_block": 17}), (70, {}), (64, {"anchor_block": 100, "candidate_block": 50})])
def test_negatives_against_brute_force(spark, dim, sizes):
    rows = vectors(dim=dim)
    assert (want := mined(rows)) and run(spark, rows, **sizes) == want


def test_negatives_of_odd_rows(spark):
    rows = vectors(60, 3)
    rows += [(10, 1, rows[10][2]), (10, 2, rows[11][2]), (21, 1, rows[21][2]), (500, 1, None), (510, None, [1.0, 1.0, 1.0]), (None, 1, [1.0, 1.0, 1.0]), (520, 1, [1.0, None, 1.0]), (530, 1, [1.0, math.nan, 1.0]), (540, 1, [math.inf, 0.0, 1.0]), (550, 1, []), (551, 2, []), (552, 1, []), (560, 1, [1.0, 2.0]), (561, 1, [1.0, 2.0]), (562, 2, [1.0, 1.9]), (570, 9, [0.5, 0.5, 0.5])]
    rows += [(600 + i, 1 + i % 2, [0.25, 0.25, 0.25]) for i in range(20)]
    assert run(spark, rows, anchor_block=3, candidate_block=8) == mined(rows)
    assert run(spark, []) == []


def test_negatives_of_large_components(spark):
    rows = vectors(60, 4, 1e5)
    rows += [(100, 1, [2.0**20] * 4), (101, 1, [2.0**21, 0.0, 1.0, -3.0])]
    assert run(spark, rows) == mined(rows)
    wide = vectors(40, 4, 2.0**22) # sums that 64 bits hold, whose hundredfold they don't
    assert run(spark, wide) == mined(wide)
    with pytest.raises(Exception, match="64 bits"):
        run(spark, vectors(40, 4, 1e200))


def test_intervals_hold_scores_and_shrink():
    rng = np.random.default_rng(1)
    q, v = rng.normal(0, 0.3, (8, 64)), rng.normal(0, 0.3, (4000, 64))
    a, b = (np.floor(256 * x).astype(np.int64) for x in (q, v))
    planes = int(max(np.abs(a).max(), np.abs(b).max())).bit_length() + 1
    x = negatives.Intervals(negatives.sliced(a, planes), negatives.sliced(b, planes))
    exact, widths, left = a @ b.T, [], []

    def judge(rows, low, high):
        widths.append(int((high - low).max()))
        assert (low.reshape(8, -1) <= exact).all() and (exact <= high.reshape(8, -1)).all()
        return np.ones(len(rows), bool)

    x.refine(np.ones((8, 4000), bool), judge)
    assert widths[-1] == 0 and all(m <= n // 2 for n, m in zip(widths, widths[1:], strict=False))
    r, c, s = negatives.nearest(x, np.ones((8, 4000), bool), 5, left)
    assert (exact[r, c] == s).all() and s.tolist() == (-np.sort(-exact, axis=1)[:, :5]).ravel().tolist()
    assert left[-2] < 2000  # dropped before their scores were exact
