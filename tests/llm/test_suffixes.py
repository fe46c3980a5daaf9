import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from readloom.llm import suffixes

DOCS = "doc_id bigint, text string, source string, start bigint, hull string"


def words(rng, n):
    return " ".join("".join(rng.choices("abcdefghé", k=rng.randrange(2, 9))) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(9)
    out = []
    shared = [words(rng, n) for n in (30, 36, 40, 60, 200)]
    for i in range(60):
        parts = [words(rng, rng.randrange(0, 60))]
        for _ in range(rng.randrange(0, 3)):
            s = rng.choice(shared)
            a, b = sorted(rng.sample(range(len(s) + 1), 2)) if rng.random() < 0.6 else (0, len(s))
            parts += [s[a:b], words(rng, rng.randrange(0, 40))]
        out.append((i, "".join(parts) if rng.random() < 0.5 else " ".join(parts)))
    copy = out[3][1] + shared[4]
    out += [(70, copy), (71, copy), (72, copy[:100] + "Q" + copy[101:]), (72, copy), (None, copy + "x"), (None, shared[4] + words(rng, 50)), (None, None), (73, ""), (74, None), (75, "a" * 199), (76, "b" * 200), (77, "c" * 201), (78, "ab" * 700), (79, "x" * 150 + "ab" * 150)]
    big = words(rng, 400)
    out += [(80, big), (81, big[:199]), (82, big[:200]), (83, big[-200:]), (84, "zz" + big[50:249]), (85, "yy" + big[50:250])]
    return out


def brute(rows):
    raw = [(i, (t or "").encode()) for i, t in rows]
    counts = Counter(b[s : s + 200] for _, b in raw for s in range(len(b) - 199))
    out = []
    for i, b in raw:
        gone = np.zeros(len(b) + 1, bool)
        for s in range(len(b) - 199):
            if counts[b[s : s + 200]] > 1:
                gone[s : s + 200] = True
        kept = bytes(np.frombuffer(b, np.uint8)[~gone[:-1]])
        out.append((i, len(b), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize(("bucket_max", "piece"), [(4000, 1 << 20), (2, 1 << 20), (4000, 1 << 11)])
def test_against_brute_force(spark, rows, bucket_max, piece, monkeypatch):
    monkeypatch.setattr(suffixes, "BUCKET_MAX", bucket_max)
    if piece < 1 << 20:  # the workers' own module keeps its constants, so pieces are tried here
        monkeypatch.setattr(suffixes, "PIECE", piece)
        texts = [(t or "").encode() for _, t in rows]
        seen = [Counter(), Counter()]
        for _of, at, parts in suffixes._pieces(texts):
            x = suffixes.anchors(_of, at, parts)
            for t, s, m in zip(x["text"], x["start"], x["more"], strict=True):
                seen[0].update((int(t), int(s) + k) for k in range(int(m) + 1))
        assert seen[0] == Counter((i, s) for i, t in enumerate(texts) for s in range(len(t) - 199))
        return
    out = suffixes.without_repeats(spark.createDataFrame([(i, t, "s", 1, "h") for i, t in rows], DOCS))
    assert sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in out.collect()), key=str) == brute(rows)


def test_empty(spark):
    assert suffixes.without_repeats(spark.createDataFrame([], DOCS)).count() == 0
    assert suffixes.without_repeats(spark.createDataFrame([(1, "a" * 150, "", 1, "")], DOCS)).first().n_removed == 0


@pytest.mark.parametrize("period", [7, 40, 133])
def test_cover(period):
    cover = suffixes.difference_cover(period)
    assert {(a - b) % period for a in cover for b in cover} == set(range(period)) and len(cover) < 3 * period**0.5


def test_block_against_brute_force():
    rng = random.Random(1)
    base = [bytes(rng.choices(b"ab", k=336)) for _ in range(3)]
    hulls, left, bucket = [], [], []
    for i in range(40):
        b = bytearray(base[i % 3])
        for _ in range(rng.randrange(3)):
            b[rng.randrange(336)] = 99
        a, z = rng.randrange(0, 60), rng.randrange(0, 60)
        hulls.append(bytes(b[a : 336 - z]))
        left.append(130 - a)
        bucket.append(i % 3)
    got = suffixes.repeated_in_block(np.array(bucket), np.array(left), hulls)
    names = [(k, x - s, h[s : s + 200]) for k, x, h in zip(bucket, left, hulls, strict=True) for s in range(len(h) - 199)]
    counts = Counter(names)
    assert got.tolist() == [counts[n] > 1 for n in names] and 0 < got.sum() < len(got)


def test_hot_passage_is_split_by_bytes(spark, monkeypatch):
    """Hundreds of documents that share a passage, each between words of its own: no bucket of theirs is held whole, and every part is sorted or of one string."""
    monkeypatch.setattr(suffixes, "BUCKET_MAX", 8)
    monkeypatch.setattr(suffixes, "BLOCK_HULLS", 20)
    rng = random.Random(4)
    passage = words(rng, 60)
    rows = [(i, words(rng, 12) + passage[: rng.choice([230, 260, len(passage)])] + words(rng, 12)) for i in range(120)] + [(500 + i, passage[i : i + 215] + "#" + str(i)) for i in range(0, 60, 3)]
    out = suffixes.without_repeats(spark.createDataFrame([(i, t, "s", 1, "h") for i, t in rows], DOCS))
    assert sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in out.collect()), key=str) == brute(rows)


def test_many_equal_rows(spark):
    """Rows of one key give their spans once, however many they are; null ids too."""
    rng = random.Random(6)
    text = words(rng, 60) + "unique" + words(rng, 100)
    part = text[40:300]
    rows = [(7, text)] * 3000 + [(None, part)] * 3000 + [(9, words(rng, 30) + part)]
    out = suffixes.without_repeats(spark.createDataFrame([(i, t, "s", 1, "h") for i, t in rows], DOCS).repartition(4))
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in out.collect()) == Counter(brute(rows))


def test_filters(spark):
    from pyspark.sql import functions as F

    from readloom.llm import common

    for ids in ([], [0], [5, 32767, 32768, 65535, 70_000], list(range(0, 200_000, 7))):
        bits = common.filter_bits(len(ids))
        assert bits >= 8 * len(ids) and bits & (bits - 1) == 0
        made = common.filter_of(spark.createDataFrame([(i,) for i in ids], "id bigint"), F.expr(f"id % {bits}"))
        got = common.passes(np.frombuffer(made, np.uint8), np.arange(bits))
        assert set(np.flatnonzero(got).tolist()) == {i % bits for i in ids}
