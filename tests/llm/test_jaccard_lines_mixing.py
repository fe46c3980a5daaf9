import math
import random
import re
from collections import Counter, defaultdict

import pytest

from readloom.llm import graph, jaccard, lines, mixing

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, n bigint, doc string, token string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, *[None] * (8 - len(r))) for r in rows], DOCS)


def words_of(rng, n):
    return [rng.choice("alpha beta gamma delta eps zeta eta theta iota kappa".split()) + str(rng.randrange(60)) for _ in range(n)]


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(5)
    rows, n = [], 0
    passage = " ".join(words_of(rng, 60))

    def add(text, source="s"):
        nonlocal n
        rows.append((n, text, "en", source))
        n += 1

    for size in (3, 4, 6, 10, 12, 18, 25, 60, 200):
        for _ in range(4):
            base = words_of(rng, size)
            add(" ".join(base))
            for edits in (0, 1, 1, 2, 4, 8):
                w = list(base)
                for _ in range(edits):
                    at = rng.randrange(max(1, len(w)))
                    w[at : at + 1] = rng.choice([[], ["new" + str(rng.randrange(999))], [*w[at : at + 1], "more" + str(rng.randrange(999))]])
                add("  ".join(w).upper() if edits == 0 else "\n".join(w))
    for _ in range(30):
        add(" ".join(words_of(rng, 30)) + " " + passage)
    for t in (None, "", " \t\n", "one", "one", "ONE", "one two", "a b c", "é è ê ë", "É è ê ë", "x " * 40_000):
        add(t)
    return rows


def brute_components(rows, width, num, den):
    sets = {}
    for i, text, *_ in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets[i] = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and den * both >= num * (len(sets[a]) + len(sets[b]) - both):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in sets}


@pytest.mark.parametrize(("width", "num", "den"), [(3, 90, 100), (5, 80, 100), (2, 60, 100)])
def test_jaccard_against_brute_force(spark, corpus, width, num, den):
    out = jaccard.ngram_jaccard(frame(spark, [*corpus, corpus[5]]), width, num, den).collect()
    assert len(out) == len(corpus) + 1
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in out} == brute_components(corpus, width, num, den)


@pytest.mark.parametrize("limit", [0, 6, 24])
def test_jaccard_at_any_boundary(spark, corpus, limit, monkeypatch):
    monkeypatch.setattr(jaccard, "boundary", lambda *a: limit)
    out = jaccard.ngram_jaccard(frame(spark, corpus), 3, 85, 100).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in out} == brute_components(corpus, 3, 85, 100)


def test_jaccard_edges(spark):
    docs = frame(spark, [(None, "a b c d e f"), (1, "a b c d e f"), (2, None), (3, "a b c d e f"), (3, "a b c d e f")])
    out = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.ngram_jaccard(docs, 3, 90, 100).collect()), key=str)
    assert out == sorted([(None, 4, None), (1, 4, 1), (2, 0, 2), (3, 4, 1), (3, 4, 1)], key=str)
    assert jaccard.ngram_jaccard(docs.limit(0)).count() == 0
    kept = jaccard.one_of_each_group(docs, 3, 90, 100)
    assert kept.columns == docs.columns and sorted([r.doc_id for r in kept.collect()], key=str) == sorted([None, 1, 2], key=str)


def test_jaccard_documents_of_several_texts(spark):
    """Rows of one id and different texts are one document, whatever their order."""
    rng = random.Random(9)
    one, two, three = (" ".join(words_of(rng, 40)) for _ in range(3))
    rows = [(5, one), (5, two), (2, two + " more"), (9, one), (7, three), (7, three + " x"), (8, "apart " + " ".join(words_of(rng, 30)))]
    for order in (rows, rows[::-1]):
        out = {(r.doc_id, r.n_shingles): r.component_id for r in jaccard.ngram_jaccard(frame(spark, order), 3, 90, 100).collect()}
        assert out == {(5, 38): 2, (2, 39): 2, (9, 38): 2, (7, 38): 7, (7, 39): 7, (8, 29): 8}


def test_jaccard_of_a_template(spark):
    """Many texts that share most of their shingles without being linked: no list is multiplied out, and no token's texts meet in one group."""
    import time

    shared = " ".join(f"t{i}" for i in range(58))  # 56 shingles of three words
    docs = spark.range(60_000).selectExpr("id as doc_id", f"concat('{shared}', ' a', id, ' b', id, ' c', id, ' d', id, ' e', id, ' f', id, ' g', id, ' h', id) as text")
    docs = docs.unionByName(docs.where("doc_id % 6000 = 0").selectExpr("doc_id + 100000 as doc_id", "concat(text, ' end') as text"))
    begin = time.time()
    out = {r.doc_id: r.component_id for r in jaccard.ngram_jaccard(docs, 3, 90, 100).collect()}
    assert all(c == (d - 100_000 if d >= 100_000 else d) for d, c in out.items()) and len(out) == 60_010 and time.time() - begin < 120


def test_blob_bytes():
    import numpy as np

    for kind in (np.uint16, np.uint32):
        x = np.random.default_rng(1).integers(0, np.iinfo(kind).max, 37).astype(kind)
        assert (jaccard._back(b"xy" + jaccard._high_first(x), kind, 37, 2) == x).all()


def test_boundary_follows_cost():
    sizes = dict.fromkeys(range(1, 25), 10)
    assert jaccard.boundary(sizes, 1e9, 90, 100) == 24
    assert 0 <= jaccard.boundary(sizes, 0, 90, 100) < jaccard.boundary(sizes, 50, 90, 100) <= 24


def test_components(spark):
    rng = random.Random(2)
    chain = [(i, i + 1) for i in range(0, 40)] + [(100, 200 + i) for i in range(30)] + [(rng.randrange(500, 540), rng.randrange(500, 540)) for _ in range(25)]
    rng.shuffle(chain)
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in chain:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    out = {r.id: r.component for r in graph.components(spark.createDataFrame(chain, "a bigint, b bigint")).collect()}
    assert out == {x: root(x) for a, b in chain for x in (a, b) if a != b}


def near(a, b, near_words=lines.NEAR_WORDS):
    if abs(len(a) - len(b)) > 1 or min(len(a), len(b)) < near_words:
        return False
    if len(a) < len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) <= 1
    return any(a[:i] + a[i + 1 :] == b for i in range(len(a)))


def brute_lines(rows, near_words=lines.NEAR_WORDS):
    """doc_id to its numbers of lines that go."""
    split = lambda s: [w for w in re.split(r"[\x20\x09-\x0D]+", s) if w]
    at = sorted({((i is not None, i), n, line) for i, text, *_ in rows if text is not None for n, line in enumerate(text.split("\n")) if split(line)})
    gone, seen = defaultdict(set), []
    for (_, i), n, line in at:
        w = split(line)
        if any(line == x or near(w, v, near_words) for x, v in seen):
            gone[i].add(n)
        seen.append((line, w))
    return {i: sorted(v) for i, v in gone.items()}


def line_rows():
    rng = random.Random(8)
    base = [words_of(rng, n) for n in (1, 2, 7, 8, 8, 9, 15, 16, 17, 31, 32, 33, 64, 300)]
    rows = []
    for i in range(60):
        text = []
        for _ in range(rng.randrange(1, 6)):
            w = list(rng.choice(base))
            for _ in range(rng.choice([0, 1, 1, 2])):
                at = rng.randrange(len(w))
                w[at : at + 1] = rng.choice([[], ["n" + str(rng.randrange(4))], [w[at], "m"], [w[at], w[at]]]) or w[at : at + 1]
            text.append(rng.choice([" ", "  "]).join(w) + rng.choice(["", "", "\r"]))
        rows.append((i, "\n".join(text) + rng.choice(["", "\n", "\n \n"])))
    return [*rows, (70, None), (71, ""), (72, "\n\n \n"), (73, "a a a a a a a a a\na a a a a a a a\n" + "a " * 10), (None, " ".join(base[7])), (74, " ".join(base[12]) + "\n" + "q " * 20_000 + "\n" + "q " * 19_999)]


def test_lines_against_brute_force(spark):
    rows = line_rows()
    docs = frame(spark, [*rows, rows[4]])
    out = lines.removed_lines(docs).collect()
    expected = brute_lines(rows)
    assert {r.doc: r.removed for r in out} == expected and sum(map(len, expected.values())) > 50 and sum(r.n_near for r in out) > 20
    texts = lines.dedup_lines(docs)
    assert texts.columns == docs.columns and texts.count() == docs.count()
    by_id = dict(rows)
    for r in texts.collect():
        t = by_id[r.doc_id]
        assert r.text == (None if t is None else "\n".join(x for n, x in enumerate(t.split("\n")) if n not in expected.get(r.doc_id, [])))
    assert lines.dedup_lines(docs.limit(0)).count() == 0


def test_short_lines_take_part(spark):
    rng = random.Random(3)
    rows = [(i, "\n".join(" ".join(rng.choices("abc", k=rng.randrange(1, 6))) for _ in range(rng.randrange(1, 4)))) for i in range(40)]
    assert {r.doc: r.removed for r in lines.removed_lines(frame(spark, rows), near_words=2).collect()} == brute_lines(rows, 2)
    rows = [(i, "\n".join(" ".join(rng.choices("abcdef", k=rng.randrange(3, 6))) for _ in range(rng.randrange(1, 3)))) for i in range(60)]
    assert {r.doc: r.removed for r in lines.removed_lines(frame(spark, rows), near_words=4).collect()} == brute_lines(rows, 4)


def test_a_document_of_many_lines(spark):
    """100,000 near lines in one text, and clashing names of columns."""
    import time

    n = 100_000
    text = "\n".join(f"a b c d e f g h{i // 2} i{i}" for i in range(n))
    docs = spark.createDataFrame([(1, text, 2, "x", 3), (2, "own line", 2, "y", 4)], "doc_id bigint, text string, own_removed bigint, __removed string, doc bigint")
    begin = time.time()
    out = {r.doc_id: r for r in lines.dedup_lines(docs).collect()}
    assert out[1].text == "\n".join(text.split("\n")[::2]) and out[2].text == "own line" and time.time() - begin < 60
    assert lines.dedup_lines(docs).columns == docs.columns and out[2].own_removed == 2 and out[1]["__removed"] == "x"


def test_within_one_edit(spark):
    cases = [("", ""), ("a", ""), ("a b", "a"), ("a b", "b"), ("a b c", "a x c"), ("a b c", "x y c"), ("a b", "b a"), ("a", "b c"), ("a b c d", "a c d"), ("a a", "a")]
    rows = spark.createDataFrame([(a.split(), b.split()) for a, b in cases], "a array<string>, b array<string>").select(lines.within_one_edit("a", "b"), lines.within_one_edit("b", "a")).collect()
    assert [tuple(r) for r in rows] == [(x, x) for x in (True, True, True, True, True, False, False, False, True, True)]


def brute_weights(tokens, budget, max_repeats, part):
    total = sum(tokens.values())

    def weights(t):
        w = {k: (v / total) ** t for k, v in tokens.items()}
        return {k: x / sum(w.values()) for k, x in w.items()}

    def fits(t):
        w = weights(t)
        return max(w[k] * budget / tokens[k] for k in w) <= max_repeats + 1e-9 and (part is None or -sum(x * math.log(x) for x in w.values() if x) <= part * math.log(len(w)) + 1e-12)

    low, high = 0.0, 1.0
    if fits(0.0):
        return 0.0, weights(0.0)
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (low, mid) if fits(mid) else (mid, high)
    return high, weights(high)


@pytest.mark.parametrize(("budget", "max_repeats", "part"), [(None, 4.0, 0.9), (None, 2.0, None), (3000, 50.0, 0.5), (None, 1.0, None)])
def test_mixing_weights_and_budgets(spark, budget, max_repeats, part):
    rng = random.Random(4)
    rows = [(i, " ".join(["w"] * rng.randrange(0, 40)), "en", rng.choices(["big", "mid", "small", None], [60, 30, 6, 4])[0]) for i in range(900)]
    rows += [(2000, None, "en", "empty"), (2001, "", "en", "empty"), (2002, "w " * 5000, "en", "big"), (None, "w w", "en", "mid")]
    tokens, per = Counter(), {}
    for i, t, _, s in rows:
        tokens[s or ""] += len((t or "").split())
        per[s or "", i] = len((t or "").split())
    tokens = {k: v for k, v in tokens.items() if v}
    exponent, weights = brute_weights(tokens, budget or sum(tokens.values()), max_repeats, part)
    docs = frame(spark, rows)
    sizes = spark.createDataFrame([(k, 1, v) for k, v in tokens.items()], "src string, docs bigint, tokens bigint")
    for r in mixing.source_weights(sizes, budget, max_repeats, part).collect():
        assert r.exponent == pytest.approx(exponent, abs=1e-9) and r.weight == pytest.approx(weights[r.src], rel=1e-6)
    drawn = mixing.draw(docs, budget, max_repeats, part).collect()
    used, copies = Counter(), defaultdict(set)
    for r in drawn:
        assert r["__copies"] > 0
        used[r["__src"]] += r["__copies"] * per[r["__src"], r["__id"]]
        copies[r["__src"]].add(r["__copies"])
    for s, n in tokens.items():
        goal = math.floor(weights[s] * (budget or sum(tokens.values())) + 1e-6)
        longest = max(v for (k, _), v in per.items() if k == s)
        assert goal - longest <= used[s] <= goal, (s, goal, used[s])
        assert not copies[s] or max(copies[s]) - min(copies[s]) <= 1
        assert max(copies[s], default=0) <= math.ceil(max_repeats)
    assert "empty" not in used
    mixed = mixing.mix(docs, budget, max_repeats, part)
    assert mixed.columns == docs.columns and mixed.count() == sum(r["__copies"] for r in drawn)


def test_mixing_clashing_names_and_long_texts(spark):
    rows = [(i, "w " * (200_000 if i == 3 else 5), "x" if i % 4 else "y", 1, 2, 3, 4) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, __copies int, __src int, src int, own_copies int")
    out = mixing.mix(docs)
    assert out.columns == docs.columns and {tuple(r) for r in out.collect()} <= set(rows)


def test_mixing_many_sources(spark):
    """No row holds all sources: more sources than are broadcast, with ties."""
    n = mixing.FEW + 500
    sizes = spark.range(n).selectExpr("cast(id as string) as src", "1L as docs", "1 + id % 7 as tokens")
    out = mixing.source_weights(sizes).agg({"weight": "sum", "src": "count"}).first()
    assert out[0] == pytest.approx(1.0) or out[1] == pytest.approx(1.0)


def test_mixing_edges(spark):
    docs = frame(spark, [(1, "a b", "en", "x"), (1, "a b", "en", "x"), (2, "c", "en", "x")])
    assert mixing.mix(docs).count() >= 2 and mixing.mix(docs.limit(0)).count() == 0
    assert sorted(map(tuple, mixing.draw(docs).collect())) == sorted(map(tuple, mixing.draw(docs.repartition(3)).collect()))
