"""Secret scans: patterns find candidates, a random forest trained from labelled findings removes false positives.

Candidates are values assigned to telling names (bare or quoted, whatever blanks and escapes stand there; an unclosed quote ends with the line), passwords in addresses, strings with known prefixes, key blocks, runs of
20 or more token characters that hold a digit, and quoted phrases with blanks that hold none of these. The forest looks at a candidate's
length, its character transitions (mean log-likelihoods under a letter-pair model of words, and changes of character class), its dictionary coverage (words of WORDS and the whole words of a public vocabulary, whose path is a parameter), whether it stands in a path or address,
and the words next to it. It is grown here with numpy on a bounded sample of labelled findings (MAX_LABELS, at most) with bootstrapped rows and random subsets of features, and is the same for one seed.
Without labelled findings of one's own, findings() makes some: secrets of common formats, and what is mistaken for them.

Defined results: a null or empty text has no finding; repeated rows have theirs each; texts of any length are scanned whole; a text's findings don't overlap (the longest first, then the first); positions count
UTF-8 bytes; rows without doc_id keep a null id; other columns are ignored.
"""

from __future__ import annotations

import math
import random
import re
from collections.abc import Iterable, Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from readloom.llm.common import table
from readloom.llm.sentencepieces import MODEL

MAX_LABELS, TREES, DEPTH, LEAST_LEAF, SEED = 20_000, 30, 10, 3, 5
SIDE = 60  #: bytes of text on either side that features look at
_NAME = rb"(?:api[_-]?key|access[_-]?key|private[_-]?key|client[_-]?secret|secret|token|passw(?:or)?d|passphrase|passwd|pwd|credential|auth)[a-z_\-]{0,16}"
#: A name, its sign, and what it is set to: in quotes up to the closing one or the line's end (looked at only, so that names inside are found too), or bare.
_VALUE = re.compile(rb"(?i)" + _NAME + rb"[\"']?\s*(?::=|:|=>?)\s*(?:(?=\"([^\"\\\n]*(?:\\[^\n][^\"\\\n]*)*)(\"?))|(?='([^'\\\n]*(?:\\[^\n][^'\\\n]*)*)('?))|([^\s\"',;]{6,}))")
_ADDRESS = re.compile(rb"://[^\s/:@\"']*:([^\s/@\"']{6,})@")
_BLANK = re.compile(rb"\s")
_KNOWN = re.compile(rb"AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{30,}|sk-[A-Za-z0-9_-]{20,}|xox[abprs]-[A-Za-z0-9-]{10,}|AIza[A-Za-z0-9_-]{30,}|eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{4,}")
_BLOCK = re.compile(rb"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----[\s\S]*?(?:-----END [A-Z ]{0,40}PRIVATE KEY-----|\Z)")
_TOKEN_BYTES = np.isin(np.arange(256), list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/=_-"))
_DIGITS = np.isin(np.arange(256), list(b"0123456789"))
#: Common words and parts of names; runs of them cover readable candidates.
WORDS = frozenset("the and for with from that this your have not you are was name user users file files data value values test tests example sample demo dummy default config settings server client service system local host http https www com org net index main page home image images style script public private static build node modules package lock version release branch commit merge master hash sha md5 uuid guid key keys token tokens secret secrets password passwords change changeme here insert enter replace placeholder none null true false undefined string number object array function return class method model table column schema query select update delete create admin root guest account email address phone order product customer report document content title header footer button label input output error message debug info warning start stop begin end time date year month day first last next previous count total size length width height color black white green blue red path folder directory library resource assets vendor source target project module component container instance cluster region zone access request response session cookie login logout".split())
_NEAR = ("key", "token", "secret", "passw", "auth", "credential", "api", "bearer")
_FAR = ("commit", "sha", "md5", "hash", "checksum", "uuid", "guid", "example", "placeholder", "test", "digest", "id", "color", "version", "etag")
FEATURES = ("length", "entropy", "letters_ll", "switches", "digits", "upper", "lower", "hex", "covered", "in_path", "slashes", "near", "far", "assigned", "quoted", "repeats", "separators", "uuid_shape")


def _assigned(raw: bytes, m: re.Match) -> tuple[int, int, str]:
    """What a match of _VALUE found. A quoted text with blanks is a phrase; of one that no quote closes the part before the first blank counts."""
    if m[5] is not None:
        return (*m.span(5), "value")
    at = 1 if m[1] is not None else 3
    s, e = m.span(at)
    blank = _BLANK.search(raw, s, e)
    if not blank:
        return s, e, "value"
    return (s, e, "phrase") if m[at + 1] else (s, blank.start(), "value")


def candidates(raw: bytes) -> list[tuple[int, int, str]]:
    """Start, end and kind of each candidate, in order."""
    found = [(m.start(), m.end(), "block") for m in _BLOCK.finditer(raw)] if b"-----BEGIN" in raw else []
    found += [x for m in _VALUE.finditer(raw) if (x := _assigned(raw, m))[1] - x[0] >= 6]
    found += [(*m.span(1), "value") for m in _ADDRESS.finditer(raw)]
    found += [(*m.span(), "known") for m in _KNOWN.finditer(raw)]
    if raw:
        a = np.frombuffer(raw, np.uint8)
        edge = np.flatnonzero(np.diff(_TOKEN_BYTES[a], prepend=False, append=False))
        starts, ends = edge[0::2], edge[1::2]
        long = ends - starts >= 20
        digits = np.concatenate([[0], np.cumsum(_DIGITS[a])]) if long.any() else None
        found += [(int(s), int(e), "run") for s, e in zip(starts[long], ends[long], strict=True) if digits[e] > digits[s]]
    kept: list[tuple[int, int, str]] = []
    rank = {"block": 0, "value": 1, "known": 2, "run": 3, "phrase": 4}
    taken: list[tuple[int, int]] = []
    import bisect

    for s, e, kind in sorted(found, key=lambda x: (max(2, rank[x[2]]), -(x[1] - x[0]), x[0], rank[x[2]])):
        at = bisect.bisect_left(taken, (s, e))
        if (at == 0 or taken[at - 1][1] <= s) and (at == len(taken) or taken[at][0] >= e):
            taken.insert(at, (s, e))
            kept.append((s, e, kind))
    return sorted(kept)


def _pairs(words: Iterable[str]) -> np.ndarray:
    """Log-probabilities of a lower-case letter after another in words."""
    counts = np.full((26, 26), 0.5)
    for w in words:
        for a, b in zip(w, w[1:], strict=False):
            counts[ord(a) - 97, ord(b) - 97] += 1
    return np.log(counts / counts.sum(1, keepdims=True))


@lru_cache(maxsize=2)
def lexicon(model_path: str = MODEL) -> tuple[frozenset[str], np.ndarray]:
    """The dictionary and its letter pairs: WORDS, and what begins a word in the vocabulary file and has four letters or more. Read on the driver only."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model_path)
    found = {p[1:].lower() for p in (sp.id_to_piece(i) for i in range(sp.get_piece_size())) if re.fullmatch("\u2581[A-Za-z][a-z]{3,}", p)}
    words = frozenset(found | {w for w in WORDS if re.fullmatch("[a-z]+", w)} | WORDS)
    return words, _pairs(w for w in words if re.fullmatch("[a-z]+", w))


def features(value: str, before: str, after: str, known: tuple[frozenset[str], np.ndarray] | None = None) -> list[float]:
    """FEATURES of a candidate and up to SIDE characters around it. known: a lexicon()."""
    dictionary, likely = lexicon() if known is None else known
    n = max(1, len(value))
    counts = np.bincount(np.frombuffer(value.encode("latin-1", "replace"), np.uint8), minlength=256)
    p = counts[counts > 0] / n
    low = value.lower()
    pairs = [likely[ord(a) - 97, ord(b) - 97] for a, b in zip(low, low[1:], strict=False) if "a" <= a <= "z" and "a" <= b <= "z"]
    kinds = ["d" if c.isdigit() else "u" if c.isupper() else "l" if c.islower() else "o" for c in value]
    covered = 0
    for part in re.findall(r"[a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", value).lower()):
        at = 0
        while at < len(part):
            size = next((k for k in range(min(12, len(part) - at), 2, -1) if part[at : at + k] in dictionary), 0)
            covered += size
            at += size or 1
    lead, trail = before.lower(), after.lower()
    around = re.findall(r"[a-z]+", lead[-40:])[-4:] + re.findall(r"[a-z]+", trail[:30])[:3]
    glued = re.search(r"\S*$", before)[0]
    return [
        min(n, 400), float(-(p * np.log2(p)).sum()), float(np.mean(pairs)) if pairs else -3.3, sum(a != b for a, b in zip(kinds, kinds[1:], strict=False)) / n,
        kinds.count("d") / n, kinds.count("u") / n, kinds.count("l") / n, sum(c in "0123456789abcdefABCDEF" for c in value) / n, covered / n,
        float("/" in glued or "\\" in glued or "://" in glued or trail[:1] in ("/", "\\") or re.match(r"\.[a-z]{1,5}\b", trail) is not None), min(20, value.count("/")) / n,
        sum(any(x in w for x in _NEAR) for w in around), sum(any(w == x or (len(x) > 3 and x in w) for x in _FAR) for w in around),
        float(re.search(r"[:=]\s*[\"']?$", lead) is not None), float(lead[-1:] in ("'", '"')), max(map(len, re.findall(r"((.)\2*)", value) and [m[0] for m in re.finditer(r"(.)\1*", value)] or [""])) / n,
        sum(c in "-_." for c in value) / n, float(re.fullmatch(r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}", value) is not None),
    ]


def findings(n: int, seed: int) -> list[tuple[str, str, str, int]]:
    """n labelled findings: value, text before, text after, label (1: a secret)."""
    rng = random.Random(seed)
    hexes, alnum, url = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_"
    words = sorted(lexicon()[0])

    def pick(chars: str, k: int) -> str:
        return "".join(rng.choices(chars, k=k))

    def prose(k: int) -> str:
        if rng.random() < 0.3:  # words that no list holds
            return " ".join(pick("etaoinshrdlu", rng.randrange(2, 9)) for _ in range(k))
        return " ".join(rng.choices(words, k=k))

    out = []
    for _ in range(n):
        secret = rng.random() < 0.5
        if secret:
            value = rng.choice([lambda: pick(hexes, rng.choice([32, 40, 48, 64])), lambda: pick(alnum, rng.randrange(20, 64)), lambda: "AKIA" + pick(alnum.upper(), 16), lambda: "ghp_" + pick(alnum, 36), lambda: "sk-" + pick(url, rng.randrange(24, 56)), lambda: pick(alnum + "+/", 43) + "=", lambda: "eyJ" + pick(url, 20) + "." + pick(url, 40) + "." + pick(url, 30), lambda: pick(alnum + "!#%&?*", rng.randrange(10, 20))])()
            name = rng.choice(["token", "api_key", "apiKey", "secret", "password", "access_key", "auth_token", "client_secret", "SECRET_KEY", "Authorization: Bearer"])
            before = prose(rng.randrange(1, 5)) + " " + name + rng.choice([" = ", "=", ": ", ' = "', "='", '": "', " "])
            after = rng.choice(['" ', "' ", "\n", ", ", " "]) + prose(rng.randrange(1, 4))
        else:
            kind = rng.randrange(9)
            before, after = prose(rng.randrange(1, 5)) + " ", rng.choice([" ", "\n", ". ", ", "]) + prose(rng.randrange(1, 4))
            if kind == 0:
                value = "-".join(pick(hexes, k) for k in (8, 4, 4, 4, 12))
                before += rng.choice(["", "id = ", "uuid: ", "request "])
            elif kind == 1:
                value = pick(hexes, rng.choice([32, 40, 64]))
                before += rng.choice(["commit ", "sha1: ", "sha256:", "md5 ", "checksum = ", "etag ", "digest "])
            elif kind == 2:
                value = "_".join(rng.choices(words, k=rng.randrange(3, 6))) + rng.choice(["", str(rng.randrange(100))])
                before += rng.choice(["", "token = ", "key: ", "password="])
            elif kind == 3:
                value = rng.choice(["your_api_key_here", "changeme123", "xxxxxxxxxxxxxxxxxxxx", "<insert-token-here>", "REPLACE_WITH_TOKEN", "********************", "example_password", "0" * 32, "1234567890" * 3, "${SECRET_TOKEN}", "process.env.API_KEY", "None", "undefined"])
                before += rng.choice(["token = ", 'api_key: "', "password=", 'secret = "'])
            elif kind == 4:
                value = "/".join(rng.choices(words, k=rng.randrange(3, 7))) + str(rng.randrange(1000))
                before += rng.choice(["/", "https://" + rng.choice(words) + ".com/", "./"])
                after = rng.choice([".png", ".js", "/", ".html"]) + after
            elif kind == 5:
                value = pick("0123456789", rng.randrange(20, 40))
            elif kind == 6:
                value = "".join(w.title() for w in rng.choices(words, k=rng.randrange(3, 6))) + str(rng.randrange(10))
            elif kind == 7:
                value = pick(alnum, rng.randrange(20, 30))
                before += rng.choice(["/static/", "https://cdn." + rng.choice(words) + ".com/a/", "\\assets\\"])
                after = rng.choice([".js", ".css", ".png", "/"]) + after
            else:
                value = rng.choice("-=_") * rng.randrange(20, 60) + rng.choice(["", "1"])
        out.append((value, before[-SIDE:], after[:SIDE], int(secret)))
    return out


def grow(x: np.ndarray, y: np.ndarray, trees: int = TREES, seed: int = SEED) -> list[tuple[np.ndarray, ...]]:
    """A forest: for each tree the feature (-1: leaf), threshold, left child, right child and share of secrets of its nodes."""
    rng = np.random.default_rng(seed)
    tries = max(1, math.isqrt(x.shape[1]) + 1)
    forest = []
    for _ in range(trees):
        nodes: list[list[float]] = []

        def split(rows: np.ndarray, depth: int, nodes: list[list[float]] = nodes) -> int:
            at = len(nodes)
            nodes.append([-1, 0.0, -1, -1, float(y[rows].mean())])
            if depth == DEPTH or len(rows) < 2 * LEAST_LEAF or nodes[at][4] in (0.0, 1.0):
                return at
            best = (1e-9, -1, 0.0)
            parent = nodes[at][4] * (1 - nodes[at][4]) * len(rows)
            for f in rng.choice(x.shape[1], tries, replace=False):
                order = rows[np.argsort(x[rows, f], kind="stable")]
                v, ones = x[order, f], np.cumsum(y[order])
                k = np.arange(1, len(rows))
                ok = (v[1:] > v[:-1]) & (k >= LEAST_LEAF) & (len(rows) - k >= LEAST_LEAF)
                if ok.any():
                    a, b = ones[:-1], ones[-1] - ones[:-1]
                    gain = np.where(ok, parent - a * (k - a) / k - b * (len(rows) - k - b) / (len(rows) - k), -1)
                    i = int(np.argmax(gain))
                    best = max(best, (float(gain[i]), int(f), float((v[i] + v[i + 1]) / 2)))
            if best[1] >= 0:
                left = x[rows, best[1]] <= best[2]
                nodes[at][:2] = best[1], best[2]
                nodes[at][2] = split(rows[left], depth + 1)
                nodes[at][3] = split(rows[~left], depth + 1)
            return at

        split(rng.integers(0, len(x), len(x)), 0)
        t = np.array(nodes)
        forest.append((t[:, 0].astype(int), t[:, 1], t[:, 2].astype(int), t[:, 3].astype(int), t[:, 4]))
    return forest


def predict(forest: list[tuple[np.ndarray, ...]], x: np.ndarray) -> np.ndarray:
    """The forest's mean share of secrets for each row."""
    total = np.zeros(len(x))
    for feature, threshold, left, right, share in forest:
        at = np.zeros(len(x), int)
        while (inner := feature[at] >= 0).any():
            f = feature[at]
            at = np.where(inner, np.where(x[np.arange(len(x)), f] <= threshold[at], left[at], right[at]), at)
        total += share[at]
    return total / max(1, len(forest))


def train(labelled: Sequence[tuple[str, str, str, int]], seed: int = SEED) -> list[tuple[np.ndarray, ...]]:
    """A forest from labelled findings; of more than MAX_LABELS, an evenly spaced sample is used."""
    rows = labelled[:: -(-len(labelled) // MAX_LABELS)] if len(labelled) > MAX_LABELS else labelled
    return grow(np.array([features(*r[:3]) for r in rows]), np.array([r[3] for r in rows], float), seed=seed)


def scan_secrets(docs: DataFrame, forest: list[tuple[np.ndarray, ...]] | None = None, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each candidate: doc_id, start and end (bytes), kind, value, score (the forest's), secret (score over threshold; key blocks always). No shuffle; the forest is of bounded size."""
    known = docs.sparkSession.sparkContext.broadcast((forest if forest is not None else train(findings(4000, SEED)), lexicon()))  # the vocabulary's size, whatever the corpus
    names = ["id", "start", "end", "kind", "value", "score", "secret"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grown, words = known.value
        for b in batches:
            for at in range(0, b.num_rows, 512):
                c = b.slice(at, 512)
                rows, seen = [], []
                for i, raw in zip(c.column(0).to_pylist(), c.column(1).cast(pa.large_binary()).to_pylist(), strict=True):
                    for s, e, kind in candidates(raw or b""):
                        rows.append((i, s, e, kind, raw[s:e].decode("utf-8", "replace")))
                        seen.append(features(rows[-1][4], raw[max(0, s - SIDE) : s].decode("utf-8", "ignore"), raw[e : e + SIDE].decode("utf-8", "ignore"), words))
                score = np.round(predict(grown, np.array(seen)), 6) if rows else np.zeros(0)
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), *(pa.array([r[k] for r in rows], pa.int64()) for k in (1, 2)), *(pa.array([r[k] for r in rows], pa.string()) for k in (3, 4)), pa.array(score), pa.array([bool(p > threshold or r[3] == "block") for r, p in zip(rows, score, strict=True)], pa.bool_())], names)

    return docs.select(docs[id_col].cast("bigint").alias("id"), docs[text_col].cast("string").alias("text")).mapInArrow(run, "id bigint, start bigint, end bigint, kind string, value string, score double, secret boolean").withColumnRenamed("id", id_col)


def op2_secret_scan(spark, sf_dir: str) -> DataFrame:
    """scan_secrets over the whole table documents; a secret itself is shown as a digest only."""
    from pyspark.sql import functions as F

    out = scan_secrets(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "start", "end", "kind", F.sha2("value", 256).alias("value_sha256"), "score", "secret")
