"""SentencePiece encoding and decoding, with distinct sampled segmentations: Gumbel top-k without replacement by a perturbed A-star search.

A text's canonical encoding comes from the library and a public model file. Its lattice holds every way to cut the whole text into pieces of the vocabulary; a character that no piece covers is spelled in bytes.
A piece weighs exp(ALPHA * score - PIECE_COST), a segmentation the product over its pieces, and log-probabilities are normalised over all of a text's segmentations. A text is cut into runs between characters that no piece holds next to each other (before
blanks, for one): its lattice is the chain of those of its runs, and so is its canonical encoding. Summed from their ends backwards, lattices give each piece's exact probability at its place.

Perturbing every segmentation's log-probability with Gumbel noise and taking the k largest draws k segmentations without replacement. The search never lists them: a node (the ways of the runs
before, and what is excluded as the next run's way) has as bound the exact maximum of its perturbed leaves, drawn top-down: what isn't the maximal child gets, as one group, a Gumbel with its log-mass as
location, truncated at its parent's maximum. The largest bound in the queue is expanded: its own maximal leaf is the next sample, its siblings go into the queue. The (k+1)-th maximum is
the threshold that inclusion scores refer to: log(1 - exp(-exp(log_prob - threshold))).

Most runs take their likeliest pieces, so each run's way over these is kept whole; one that deviates draws the place, the piece and all that follows from its lattice, and excluded ways are left out by
drawing from what branches off them. No way is left out, however small its share.

Each row's noise is a hash of its key, the sample's number and the place in the text, so results don't depend on partitions or retries. The model's path is a parameter; runs' lattices are computed
where first met and kept up to MOST_EDGES; then the runs that come often stay, and others are computed anew.

Defined results: a null or empty text has no ids and one segmentation; a text with fewer segmentations than k gives all it has, with an inclusion score of 0 (certain); a null key
counts as key 0 with its text's hash; repeated rows get equal samples; decoding gives back any text exactly, the meta symbol U+2581 included; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from readloom.llm.common import table

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
K, SEED = 3, 11
ALPHA, PIECE_COST = 1 / 8000, 3.0
MOST_EDGES, MOST_RUN, OFTEN = 2_000_000, 64, 4  #: kept by a worker; characters of a run that is kept; times that a run must have come to outlast a full table
LOT = 1 << 18  #: bytes of texts that are drawn together, up to one text over
LETTERS_AT_HAND = 64  #: letters whose steps in the trie are in a table
META = "▁"
SAMPLE = "rank int, n_ids int, log_prob double, perturbed double, log_inclusion double, ids_sha256 string, ids array<int>, decodes boolean"


def _spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... counts[0] of them; then those of starts[1], and so on."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + counts, counts)


def _log_sums(x: np.ndarray, heads: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Logarithm of the sum of exp(x) of each run of x that begins at heads; -inf where all are."""
    most = np.maximum.reduceat(x, heads)
    base = np.where(most > -np.inf, most, 0.0)
    with np.errstate(divide="ignore"):
        return base + np.log(np.add.reduceat(np.exp(x - np.repeat(base, counts)), heads))


class Vocabulary:
    """The model's pieces, and the lattices of runs met so far in flat arrays, runs by their numbers.

    A node is a place in a run, the next node the next place; node i has the edges first[i] to first[i + 1], shortest first, with log-probabilities log_p and nodes to (-1: the run's end).
    Run i has the likeliest pieces way_n[i] from way_at[i] on in way (edges), spelled as say_n[i] ids from say_at[i] on in say (an unknown character, always a run of its own, as its bytes), and the canonical ids id_n[i] from id_at[i] on in id; apart has the log-mass of all that leaves this way at each of its places, way_rest their sum, way_log the way's own."""

    def __init__(self, model: bytes):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        n = self.sp.get_piece_size()
        self.pieces = [self.sp.id_to_piece(i) for i in range(n)]
        self.scores = [self.sp.get_score(i) for i in range(n)]
        special = [self.sp.is_byte(i) or self.sp.is_control(i) or self.sp.is_unknown(i) or self.sp.is_unused(i) for i in range(n)]
        self.ids = {p: i for i, p in enumerate(self.pieces) if not special[i]}
        self.byte = {i: bytes([int(p[3:5], 16)]) for i, p in enumerate(self.pieces) if self.sp.is_byte(i)}
        self.byte_id = {b[0]: i for i, b in self.byte.items()}
        spelled = [self.byte.get(i) or (b"" if special[i] else p.replace(META, " ").encode()) for i, p in enumerate(self.pieces)]
        self.spelling, self.spelled = np.frombuffer(b"".join(spelled), np.uint8), np.array([len(x) for x in spelled])
        self.spelled_at = np.cumsum(self.spelled) - self.spelled
        if any(META in p.lstrip(META) for p in self.ids) or any(c not in self.ids for p in self.ids for c in p):
            raise ValueError("a piece goes past a word's end, or has a character that is no piece")
        self.log_w = ALPHA * np.array(self.scores) - PIECE_COST
        # A trie of the pieces, META as a blank: from node t by letter c to trie_to at the place of t * letters + c in trie_key; for the commonest letters also in near.
        self.letters = np.array(sorted({ord(c) for p in self.ids for c in p.replace(META, " ")}), np.uint32)
        held: dict[str, int] = {}
        for p in self.ids:
            for c in p.replace(META, " "):
                held[c] = held.get(c, 0) + 1
        common = sorted(held, key=lambda c: (-held[c], c))
        letter = {c: i for i, c in enumerate(common)}
        self.letter = np.full(0x110000, -1, np.int32)
        self.letter[[ord(c) for c in common]] = np.arange(len(letter))
        #: Whether some piece has these two letters one after the other.
        self.joined = np.zeros((len(letter), len(letter)), bool)
        for p in self.ids:
            q = [letter[c] for c in p.replace(META, " ")]
            self.joined[q[:-1], q[1:]] = True
        steps: dict[int, int] = {}
        ends = [-1]
        for p, i in self.ids.items():
            t = 0
            for c in p.replace(META, " "):
                t = steps.setdefault(t * len(letter) + letter[c], len(ends))
                if t == len(ends):
                    ends.append(-1)
            ends[t] = i
        order = sorted(steps)
        self.trie_key, self.trie_to, self.trie_piece = np.array(order), np.array([steps[x] for x in order], np.int32), np.array(ends, np.int32)
        self.at_hand = min(LETTERS_AT_HAND, len(letter))
        self.near = np.full((len(ends), self.at_hand), -1, np.int32)
        source, by = self.trie_key // len(letter), self.trie_key % len(letter)
        close = by < self.at_hand
        self.near[source[close], by[close]] = self.trie_to[close]
        self.forget()

    def forget(self) -> None:
        """Nothing is met."""
        self.runs: dict[str, int] = {}
        self.nodes = self.edges = self.n_runs = self.steps = self.n_ids = self.n_says = 0
        self.first, self.log_p, self.piece, self.to = np.zeros(1, np.int32), np.zeros(0), np.zeros(0, np.int32), np.zeros(0, np.int32)
        self.root, self.way_at, self.way_n, self.size = (np.zeros(0, np.int32) for _ in range(4))
        self.way_log, self.way_p, self.way_rest = np.zeros(0), np.zeros(0), np.zeros(0)
        self.way, self.apart = np.zeros(0, np.int32), np.zeros(0)
        self.id_at, self.id_n, self.id, self.say_at, self.say_n, self.say, self.times = (np.zeros(0, np.int32) for _ in range(7))

    def ways(self, piece: str) -> list[tuple[float, list[int]]]:
        """All segmentations of a short string with their log-weights, listed."""
        known: dict[int, list] = {len(piece): [(0.0, [])]}
        for at in range(len(piece) - 1, -1, -1):
            known[at] = [(w + ALPHA * self.scores[i] - PIECE_COST, [i, *rest]) for end in range(at + 1, len(piece) + 1) if (i := self.ids.get(piece[at:end])) is not None for w, rest in known[end]]
        return known[0]

    def _add(self, name: str, had: int, new: np.ndarray) -> None:
        """new behind the first had entries, in room that grows by half."""
        old = getattr(self, name)
        if had + len(new) > len(old):
            old = np.concatenate([old[:had], np.empty(max(len(new), had // 2), old.dtype)])
            setattr(self, name, old)
        old[had : had + len(new)] = new

    def _step(self, t: np.ndarray, c: np.ndarray) -> np.ndarray:
        """The trie's nodes behind nodes t by letters c; -1: none."""
        out = self.near[t, np.clip(c, 0, self.at_hand - 1)]
        out[c < 0] = -1
        far = np.flatnonzero(c >= self.at_hand)
        if len(far):
            key = t[far].astype(np.int64) * len(self.letters) + c[far]
            j = np.minimum(np.searchsorted(self.trie_key, key), len(self.trie_key) - 1)
            out[far] = np.where(self.trie_key[j] == key, self.trie_to[j], -1)
        return out

    def meet(self, words: list[str]) -> np.ndarray:
        """Adds the lattices and canonical ids of runs (blanks as blanks, none empty) to the tables; their numbers."""
        text = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        size = np.array([len(w) for w in words])
        root = np.cumsum(size) - size
        n = len(text)
        stop = np.repeat(root + size, size)
        c = self.letter[text]
        at, t, length = np.arange(n), np.zeros(n, np.int32), 0
        unknown = np.flatnonzero(c < 0)
        starts, lengths, piece = [unknown], [np.ones(len(unknown), np.int64)], [(-1 - text[unknown].astype(np.int64)).astype(np.int32)]
        while len(at):
            t = self._step(t, c[at + length])
            length += 1
            ok = np.flatnonzero(t >= 0)
            at, t = at[ok], t[ok]
            p = self.trie_piece[t]
            is_piece = np.flatnonzero(p >= 0)
            starts.append(at[is_piece])
            lengths.append(np.full(len(is_piece), length))
            piece.append(p[is_piece])
            ok = np.flatnonzero(at + length < stop[at])
            at, t = at[ok], t[ok]
        # Edges by their places, of one place the shortest first: each part's places rise, so an edge comes after the edges of places before and of shorter ones at its own.
        count = np.zeros(n, np.int64)
        for x in starts:
            count[x] += 1
        first = np.cumsum(count) - count
        m = int(count.sum())
        start, end, pieces, filled = np.repeat(np.arange(n), count), np.empty(m, np.int64), np.empty(m, np.int32), first.copy()
        for x, y, p in zip(starts, lengths, piece, strict=True):
            to = filled[x]
            end[to], pieces[to] = x + y, p
            filled[x] += 1
        piece = pieces
        w = np.where(piece >= 0, self.log_w[np.maximum(piece, 0)], 0.0)
        closing = end == stop[start]
        # From the words' ends backwards: the log-mass of all ways from each place on.
        mass = np.zeros(n + 1)
        left = stop[start] - start
        order = np.argsort(left.astype(np.uint16) if size.max() < 65536 else left, kind="stable")
        level = np.searchsorted(left[order], np.arange(1, size.max() + 2))
        behind = np.where(closing, n, end)  # place n has mass 0
        for a, b in zip(level[:-1].tolist(), level[1:].tolist(), strict=True):
            e = order[a:b]
            s = start[e]
            head = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
            mass[s[head]] = _log_sums(w[e] + mass[behind[e]], head, np.diff(head, append=b - a))
        log_p = np.minimum(w + mass[behind] - mass[start], 0.0)
        # Each word's way over the likeliest edges (the shortest of equal ones), and what leaves it.
        on, node, rounds = np.arange(len(words)), root.copy(), []
        way_n, way_log = np.zeros(len(words), np.int32), np.zeros(len(words))
        while len(on):
            k = count[node]
            e = _spread(first[node], k)
            heads = np.cumsum(k) - k
            x = log_p[e]
            top = np.maximum.reduceat(x, heads)
            is_top = np.flatnonzero(x == np.repeat(top, k))
            pick = is_top[np.searchsorted(is_top, heads)]
            x[pick] = -np.inf
            rounds.append((on, e[pick], way_log[on] + _log_sums(x, heads, k)))
            way_n[on] += 1
            way_log[on] += top
            e = e[pick]
            go = np.flatnonzero(~closing[e])
            on, node = on[go], end[e[go]]
        way_at = np.cumsum(way_n) - way_n
        way, apart = np.empty(way_n.sum(), np.int32), np.empty(way_n.sum())
        for r, (on, e, rest) in enumerate(rounds):
            way[way_at[on] + r], apart[way_at[on] + r] = e, rest
        rest = _log_sums(apart, way_at, way_n)
        self._add("first", self.nodes, np.append(first, m) + self.edges)
        for name, new in (("log_p", log_p), ("piece", piece), ("to", np.where(closing, -1, end + self.nodes))):
            self._add(name, self.edges, new)
        for name, new in (("root", root + self.nodes), ("size", size), ("way_at", way_at + self.steps), ("way_n", way_n), ("way_log", way_log), ("way_p", np.where(rest == -np.inf, 2.0, np.exp(way_log))), ("way_rest", rest)):
            self._add(name, self.n_runs, new)
        for name, new in (("way", way + self.edges), ("apart", apart)):
            self._add(name, self.steps, new)
        say, say_n = self.spell(piece[way]), way_n.copy()
        bad = np.flatnonzero(piece[way[way_at]] < 0)
        say_n[bad] = [len(chr(-1 - int(piece[way[way_at[i]]])).encode()) for i in bad.tolist()]
        # The library puts a blank before what it encodes; an unknown character behind that keeps the run apart, and their ids are left out.
        ids = [list(x) for x in self.encode(["\n" + w for w in words])]
        id_n = np.fromiter(map(len, ids), np.int64, len(ids)) - 2
        self._add("id", self.n_ids, np.fromiter(chain.from_iterable(x[2:] for x in ids), np.int32, int(id_n.sum())))
        self._add("say", self.n_says, say)
        for name, new in (("say_at", np.cumsum(say_n) - say_n + self.n_says), ("say_n", say_n), ("id_at", np.cumsum(id_n) - id_n + self.n_ids), ("id_n", id_n), ("times", np.zeros(len(words)))):
            self._add(name, self.n_runs, new)
        self.n_ids, self.n_says = self.n_ids + int(id_n.sum()), self.n_says + len(say)
        number = np.arange(self.n_runs, self.n_runs + len(words))
        self.nodes, self.edges, self.steps, self.n_runs = self.nodes + n, self.edges + m, self.steps + len(way), self.n_runs + len(words)
        return number

    def chains(self, texts: list[str]) -> list[np.ndarray]:
        """The numbers of each text's runs."""
        if self.edges > MOST_EDGES:
            often = sorted(((-int(self.times[i]), w) for w, i in self.runs.items() if self.times[i] >= OFTEN))[: self.n_runs // 4]
            self.forget()
            if often:
                self.runs.update(zip((w for _, w in often), self.meet([w for _, w in often]).tolist(), strict=True))
        texts = [" " + t if t else "" for t in texts]
        joined = "".join(texts)
        c = self.letter[np.frombuffer(joined.encode("utf-32-le"), np.uint32)]
        apart = np.ones(len(c) + 1, bool)
        apart[1:-1] = (c[:-1] < 0) | (c[1:] < 0) | ~self.joined[c[:-1], c[1:]]
        ends = np.cumsum([0, *map(len, texts)])
        apart[ends] = True
        cuts = np.flatnonzero(apart)
        flat = list(map(joined.__getitem__, map(slice, cuts[:-1].tolist(), cuts[1:].tolist())))
        number = np.fromiter(map(self.runs.get, flat, repeat(-1)), np.int64, len(flat))
        new = np.flatnonzero(number < 0)
        if len(new):
            missing = list(dict.fromkeys(flat[i] for i in new.tolist()))
            found = dict(zip(missing, self.meet(missing).tolist(), strict=True))
            number[new] = [found[flat[i]] for i in new.tolist()]
            self.runs.update((w, i) for w, i in found.items() if len(w) <= MOST_RUN)
        self.times[: self.n_runs] += np.bincount(number, minlength=self.n_runs).astype(np.int32)
        return np.split(number, np.searchsorted(cuts, ends[1:-1]))

    def canonical(self, runs: np.ndarray) -> np.ndarray:
        """The canonical ids of a chain of runs."""
        return self.id[_spread(self.id_at[runs], self.id_n[runs])]

    def spell(self, ids: np.ndarray) -> np.ndarray:
        """ids with unknown characters (under 0) as their bytes."""
        bad = np.flatnonzero(ids < 0)
        if not len(bad):
            return ids
        parts, last = [], 0
        for i in bad.tolist():
            parts += [ids[last:i], [self.byte_id[b] for b in chr(-1 - int(ids[i])).encode()]]
            last = i + 1
        return np.concatenate([*parts, ids[last:]]).astype(np.int32)

    def encode(self, texts: list[str]) -> list:
        """Canonical ids. The library reads the meta symbol as a blank, so it is passed as a character the text lacks, and spelled in bytes."""
        stand_in = [next(c for c in map(chr, range(0xE000, 0xF8FF)) if c not in t and c not in self.ids) if META in t else "" for t in texts]
        out = self.sp.encode([t.replace(META, s) if s else t for t, s in zip(texts, stand_in, strict=True)], num_threads=1)
        for i, s in enumerate(stand_in):
            if s:
                out[i] = np.array(out[i], np.int32)
                old, new = ([self.byte_id[b] for b in c.encode()] for c in (s, META))
                hit = np.flatnonzero((out[i][:-2] == old[0]) & (out[i][1:-1] == old[1]) & (out[i][2:] == old[2]))
                for k in range(3):
                    out[i][hit + k] = new[k]
        return out

    def decode(self, ids) -> bytes:
        """The UTF-8 bytes that ids spell, without the blank that encoding puts first."""
        ids = np.asarray(ids, np.int64)
        size = self.spelled[ids]
        ends = np.cumsum(size)
        at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.spelled_at[ids] - ends + size, size)
        return self.spelling[at].tobytes().removeprefix(b" ")


@lru_cache(maxsize=2)
def vocabulary(model: bytes) -> Vocabulary:
    return Vocabulary(model)


_STEP = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    """SplitMix64's output function."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _uniform(seed: np.ndarray, number: np.ndarray) -> np.ndarray:
    """Each seed's draw of that number, inside (0, 1)."""
    return ((_mixed(seed + (number + 1).astype(np.uint64) * _STEP) >> np.uint64(12)).astype(np.float64) + 0.5) * 2.0**-52


def _walk(v: Vocabulary, node: np.ndarray, place: np.ndarray, seed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A drawn way from each node (-1: an end) to its word's end: all edges, in the nodes' order, and how many each has. place: of the node in the text."""
    on, rounds, count = np.flatnonzero(node >= 0), [], np.zeros(len(node), np.int64)
    node, place, seed = node[on].astype(np.int64), place[on], seed[on]
    while len(on):
        left = _uniform(seed, 4 * place + 3)
        e, last = v.first[node].astype(np.int64), v.first[node + 1] - 1
        at, far = e.copy(), np.arange(len(on))
        while len(far):  # the shortest first; one without a share only where no other is left
            p = np.exp(v.log_p[at])
            e[far] = np.where(p > 0, at, e[far])
            go = np.flatnonzero((left >= p) & (at < last[far]))
            left, far, at = (left - p)[go], far[go], at[go] + 1
        rounds.append((on, e))
        count[on] += 1
        to = v.to[e]
        go = np.flatnonzero(to >= 0)
        place = (place + to - node)[go]
        on, node, seed = on[go], to[go].astype(np.int64), seed[go]
    at = np.cumsum(count) - count
    out = np.empty(count.sum(), np.int64)
    for r, (on, e) in enumerate(rounds):
        out[at[on] + r] = e
    return out, count


def _pick(u: np.ndarray, x: np.ndarray, heads: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """For each run of log-weights x the place (in x) that u, between 0 and 1, chooses."""
    most = np.maximum.reduceat(x, heads)
    p = np.exp(x - np.repeat(most, counts))
    upto = np.cumsum(p / np.repeat(np.add.reduceat(p, heads), counts))
    before = np.concatenate([[0.0], upto])[heads]
    at = np.clip(np.searchsorted(upto, before + u, "right"), heads, heads + counts - 1)
    wrong = np.flatnonzero(p[at] == 0)  # rounding only
    if len(wrong):
        top = np.flatnonzero(p == 1.0)
        at[wrong] = top[np.searchsorted(top, heads[wrong])]
    return at


class _Ways:
    """Drawn ways of runs: log-probabilities log_p, log-masses of all other ways rest, and for those runs (places of) that left their likeliest way their edges."""

    __slots__ = ("log_p", "rest", "of", "count", "edges")

    def __init__(self, v: Vocabulary, words: np.ndarray, number: np.ndarray, place: np.ndarray, seed: np.ndarray):
        """words: runs' numbers; number: of the run in its text; place: of its first character."""
        self.log_p, self.rest = v.way_log[words], v.way_rest[words]
        self.of = far = np.flatnonzero(_uniform(seed, 4 * number) >= v.way_p[words])
        if not len(far):
            self.count, self.edges = np.zeros(0, np.int64), np.zeros(0, np.int64)
            return
        w, seed, number, place = words[far], seed[far], number[far], place[far]
        n, at = v.way_n[w].astype(np.int64), v.way_at[w].astype(np.int64)
        heads = np.cumsum(n) - n
        leave = _pick(_uniform(seed, 4 * number + 1), v.apart[_spread(at, n)], heads, n) - heads
        root = v.root[w].astype(np.int64)
        node = np.where(leave > 0, v.to[v.way[at + np.maximum(leave, 1) - 1]], root).astype(np.int64)
        best = v.way[at + leave]
        a, n = v.first[node].astype(np.int64), (v.first[node + 1] - v.first[node]).astype(np.int64)
        e = _spread(a, n)
        heads = np.cumsum(n) - n
        x = v.log_p[e]
        x[heads + best - a] = -np.inf
        e = e[_pick(_uniform(seed, 4 * number + 2), x, heads, n)]
        to = v.to[e]
        more, m = _walk(v, to, place + to - root, seed)
        self.count = leave + 1 + m
        ends = np.cumsum(self.count)
        begin = ends - self.count
        self.edges = np.empty(ends[-1], np.int64)
        self.edges[_spread(begin, leave)] = v.way[_spread(at, leave)]
        self.edges[begin + leave] = e
        self.edges[_spread(begin + leave + 1, m)] = more
        self.log_p[far] = np.add.reduceat(v.log_p[self.edges], begin)
        self.rest[far] = np.log1p(-np.exp(self.log_p[far]))  # such a way has at most half of its run's mass


def _branches(v: Vocabulary, root: int, out: list[tuple[int, ...]]) -> tuple[np.ndarray, list[tuple[int, int]], list[int]]:
    """All ways of a run but those in out, by where they branch off: log-mass, (number in out, edges in common), and the first edge apart."""
    mass, prefix, edge = [], [], []
    stack = [(root, 0.0, 0, range(len(out)))]
    while stack:
        node, before, depth, own = stack.pop()
        a, b = int(v.first[node]), int(v.first[node + 1])
        follow: dict[int, list[int]] = {}
        for i in own:
            follow.setdefault(out[i][depth], []).append(i)
        for e, p in zip(range(a, b), v.log_p[a:b].tolist(), strict=True):
            if e not in follow:
                mass.append(before + p)
                prefix.append((own[0], depth))
                edge.append(e)
            elif (to := int(v.to[e])) >= 0:
                stack.append((to, before + p, depth + 1, follow[e]))
    return np.array(mass), prefix, edge


class _Sample:
    """Its runs' log-probabilities, those that left their likeliest way (of, count, edges), and the noisy log-masses of what was passed over from run at on. out: ways excluded at that run."""

    __slots__ = ("log_p", "of", "count", "edges", "at", "free", "off", "top", "bound", "taken", "out")

    def aim(self) -> None:
        """Sets the largest bound and its place. Truncation at top keeps their order, so only the largest is ever truncated."""
        self.off = int(self.free.argmax()) if len(self.free) else -1
        most = float(self.free[self.off]) if len(self.free) else -np.inf
        self.bound = -float(np.logaddexp(-self.top, -most)) if most > -np.inf else -np.inf

    def way(self, v: Vocabulary, words: np.ndarray, t: int) -> tuple[int, ...]:
        """The edges of run t."""
        i = int(np.searchsorted(self.of, t))
        if i < len(self.of) and self.of[i] == t:
            a = int(self.count[:i].sum())
            return tuple(self.edges[a : a + int(self.count[i])].tolist())
        a = int(v.way_at[words[t]])
        return tuple(v.way[a : a + int(v.way_n[words[t]])].tolist())


def _noise(u: np.ndarray) -> np.ndarray:
    return -np.log(-np.log(u))


def _spelled(v: Vocabulary, chains: list[np.ndarray], samples: list[_Sample]) -> list[np.ndarray]:
    """The ids of samples, each of its chain."""
    if not samples:
        return []
    runs = np.concatenate(chains)
    sizes = np.array([len(c) for c in chains])
    shift = np.cumsum(sizes) - sizes
    of, count = np.concatenate([x.of + b for x, b in zip(samples, shift.tolist(), strict=True)]), np.concatenate([x.count for x in samples])
    n = v.say_n[runs].astype(np.int64)
    n[of] = count  # in their places, the first of the run's table for the time being
    ends = np.cumsum(n)
    ids = np.take(v.say, _spread(v.say_at[runs], n), mode="clip")
    ids[_spread((ends - n)[of], count)] = v.piece[np.concatenate([x.edges for x in samples])]
    return np.split(ids, np.concatenate([[0], ends])[shift[1:]])


def draw(v: Vocabulary, chains: list[np.ndarray], k: int, seeds: np.ndarray) -> list[list[tuple[float, float, float, np.ndarray]]]:
    """For each chain of runs (numbers): log_prob, perturbed log_prob, log_inclusion and ids of k distinct segmentations (fewer if there are no more), the largest perturbed first.

    All chains take each step together; what is drawn depends on a chain's own seed alone."""
    places = [np.cumsum(v.size[c], dtype=np.int64) - v.size[c] for c in chains]
    done: list[list[_Sample]] = [[] for _ in chains]
    open_ = list(range(len(chains)))
    tops = _noise(_uniform(_mixed(seeds), np.zeros(len(seeds), np.int64)))
    for r in range(k):
        seed_r = _mixed(seeds + np.array([r + 1], np.uint64) * _STEP)
        turns: list[tuple] = []  # each chain's turn: the sample it branches from, the run t, its new way, the noisy log-mass left there, the ways excluded
        if r == 0:
            turns = [(i, None, -1, (), 0.0, []) for i in open_]
        else:
            found = []
            for i in open_:
                old = max(done[i], key=lambda x: x.bound)
                if old.bound == -np.inf:
                    continue
                t = old.at + old.off
                out = list(dict.fromkeys([*(old.out if old.off == 0 else []), old.way(v, chains[i], t)]))
                old.taken = old.bound
                old.free[old.off] = -np.inf
                old.aim()
                found.append((i, old, t, out, *_branches(v, int(v.root[chains[i][t]]), out)))
            if not found:
                break
            which, at = np.array([x[0] for x in found]), np.array([x[2] for x in found])
            counts = np.array([len(x[4]) for x in found])
            heads = np.cumsum(counts) - counts
            picks = (_pick(_uniform(seed_r[which], 4 * at + 1), np.concatenate([x[4] for x in found]), heads, counts) - heads).tolist()
            noise = _noise(_uniform(seed_r[which], 4 * at + 2)).tolist()
            to = v.to[[x[6][j] for x, j in zip(found, picks, strict=True)]]
            more, n = _walk(v, to, np.array([int(places[i][t]) - int(v.root[chains[i][t]]) for i, _, t, *_ in found]) + to, seed_r[which])
            more = [x.tolist() for x in np.split(more, np.cumsum(n)[:-1])]
            for (i, old, t, out, mass, prefix, edge), j, rest, u in zip(found, picks, more, noise, strict=True):
                way = (*out[prefix[j][0]][: prefix[j][1]], edge[j], *rest)
                out = [*out, way]
                mass = np.delete(mass, j) if v.to[edge[j]] < 0 else _branches(v, int(v.root[chains[i][t]]), out)[0]
                turns.append((i, old, t, way, (float(np.logaddexp.reduce(mass)) if len(mass) else -np.inf) + u, out))
        many = [len(chains[i]) - t - 1 for i, _, t, *_ in turns]
        number = np.concatenate([np.arange(t + 1, len(chains[i])) for i, _, t, *_ in turns])
        seed = np.repeat(seed_r[[x[0] for x in turns]], many)
        made = _Ways(v, np.concatenate([chains[i][t + 1 :] for i, _, t, *_ in turns]), number, np.concatenate([places[i][t + 1 :] for i, _, t, *_ in turns]), seed)
        noisy = made.rest + _noise(_uniform(seed, 4 * number + 2 + (1 << 40)))
        ends = np.cumsum([0, *many])
        far = np.searchsorted(made.of, ends)
        upto = np.concatenate([[0], np.cumsum(made.count)])[far]
        open_ = []
        for (i, old, t, way, free, out), a, b, fa, fb, ea, eb in zip(turns, ends[:-1].tolist(), ends[1:].tolist(), far[:-1].tolist(), far[1:].tolist(), upto[:-1].tolist(), upto[1:].tolist(), strict=True):
            x = _Sample()
            log_p, of, count, edges = made.log_p[a:b], made.of[fa:fb] - (a - t - 1), made.count[fa:fb], made.edges[ea:eb]
            if old is None:
                x.log_p, x.of, x.count, x.edges, x.at, x.out, x.top = log_p, of, count, edges, 0, [], float(tops[i])
                x.free = np.cumsum(log_p) - log_p + noisy[a:b]
            else:
                f = int(np.searchsorted(old.of, t))
                x.log_p = np.concatenate([old.log_p[:t], [v.log_p[list(way)].sum()], log_p])
                x.of, x.count = np.concatenate([old.of[:f], [t], of]), np.concatenate([old.count[:f], [len(way)], count])
                x.edges = np.concatenate([old.edges[: int(old.count[:f].sum())], np.array(way, np.int64), edges])
                x.at, x.out, x.top = t, out, old.taken
                x.free = (np.cumsum(x.log_p) - x.log_p)[t:] + np.concatenate([[free], noisy[a:b]])
            x.aim()
            done[i].append(x)
            open_.append(i)
    ids = iter(_spelled(v, [c for c, found in zip(chains, done, strict=True) for _ in found], [x for found in done for x in found]))
    result = []
    for found in done:
        threshold = max(x.bound for x in found) if len(found) == k else -np.inf
        rows = []
        for x in found:
            log_prob = float(x.log_p.sum())
            e = np.exp(min(700.0, log_prob - threshold)) if threshold > -np.inf else np.inf
            inclusion = 0.0 if e > 40 else float(np.log(-np.expm1(-e))) if e > 1e-300 else log_prob - threshold
            rows.append((log_prob, x.top, inclusion, next(ids)))
        result.append(rows)
    return result


def sample(v: Vocabulary, ids: np.ndarray, k: int, rng: np.random.Generator) -> list[tuple[float, float, float, np.ndarray]]:
    """draw() for a chain of single pieces, each with a lattice of its own."""
    v.forget()
    return draw(v, [v.meet([v.pieces[i].replace(META, " ") for i in ids.tolist()])], k, rng.integers(0, 2**64, 1, np.uint64))[0]


def _runs_of_equal(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of equal values begin and end."""
    edge = np.flatnonzero(np.diff(x)) + 1
    return np.concatenate([[0], edge])[: len(x)], np.concatenate([edge, [len(x)]])[: max(len(x), 0) and len(edge) + 1]


def encode(docs: DataFrame, k: int = K, seed: int = SEED, model_path: str = MODEL, with_ids: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each row of docs: doc_id, n_ids, ids (canonical; null unless with_ids), decodes (whether they give the text back), samples (SAMPLE, ids null unless with_ids, decodes as above)."""
    from pyspark.sql.pandas.types import to_arrow_schema

    with open(model_path, "rb") as f:
        model = docs.sparkSession.sparkContext.broadcast(f.read())  # the vocabulary's size, whatever the corpus
    schema = docs.sparkSession.createDataFrame([], f"id bigint, n_ids int, ids array<int>, decodes boolean, samples array<struct<{', '.join(x.replace(' ', ':', 1) for x in SAMPLE.split(', '))}>>").schema
    arrow = to_arrow_schema(schema)
    item = arrow.field("samples").type.value_type

    def lists(parts: list[np.ndarray]) -> pa.Array:
        if not with_ids:
            return pa.nulls(len(parts), pa.list_(pa.int32()))
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)), pa.array(np.concatenate([np.zeros(0, np.int32), *parts]).astype(np.int32)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute  # noqa: F401

        v = vocabulary(model.value)
        for b in batches:
            size = np.cumsum(pa.compute.fill_null(pa.compute.binary_length(b.column(1)), 0).to_numpy(zero_copy_only=False)) // LOT
            for start, end in zip(*(x.tolist() for x in _runs_of_equal(size)), strict=True):
                c = b.slice(start, end - start)
                ids, texts = c.column(0), [t or "" for t in c.column(1).to_pylist()]
                chains = v.chains(texts)
                canonical = [v.canonical(x) for x in chains]
                keys = [f"{seed} {i}" if i is not None else f"{seed} - {hashlib.blake2b(t.encode(), digest_size=8).hexdigest()}" for i, t in zip(ids.to_pylist(), texts, strict=True)]
                seeds = np.array([int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest(), "big") for x in keys], np.uint64)
                drawn = draw(v, chains, k, seeds)
                flat = [(r + 1, *s) for d in drawn for r, s in enumerate(d)]
                samples = pa.StructArray.from_arrays([
                    pa.array([x[0] for x in flat], pa.int32()), pa.array([len(x[4]) for x in flat], pa.int32()), *(pa.array([x[j] for x in flat], pa.float64()) for j in (1, 2, 3)),
                    pa.array([hashlib.sha256(x[4].astype("<i4").tobytes()).hexdigest() for x in flat], pa.string()), lists([x[4] for x in flat]),
                    pa.array([v.decode(s[3]) == t.encode() for d, t in zip(drawn, texts, strict=True) for s in d], pa.bool_()),
                ], fields=list(item))
                offsets = pa.array(np.concatenate([[0], np.cumsum([len(d) for d in drawn])]).astype(np.int32))
                yield pa.RecordBatch.from_arrays([ids, pa.array([len(x) for x in canonical], pa.int32()), lists(canonical), pa.array([v.decode(x) == t.encode() for x, t in zip(canonical, texts, strict=True)]), pa.ListArray.from_arrays(offsets, samples).cast(arrow.field("samples").type)], schema=arrow)

    return docs.select(docs[id_col].cast("bigint").alias("id"), docs[text_col].cast("string").alias("text")).mapInArrow(run, schema).withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, model_path: str = MODEL, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id, text: what the ids spell."""
    with open(model_path, "rb") as f:
        model = encoded.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(model.value)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([None if x is None else v.decode(x).decode() for x in b.column(1).to_pylist()], pa.string())], ["id", "text"])

    return encoded.select(encoded[id_col].cast("bigint").alias("id"), encoded[ids_col].alias("ids")).mapInArrow(run, "id bigint, text string").withColumnRenamed("id", id_col)


def op7_sentencepiece(spark, sf_dir: str) -> DataFrame:
    """For each whole text of documents a row of rank 0 with its canonical ids, and one for each sampled segmentation: ids, their digest (of samples), and whether they give the text back."""
    from pyspark.sql import functions as F

    out = encode(table(spark, sf_dir, "documents"))
    plain = F.struct(F.lit(0).alias("rank"), "n_ids", *[F.lit(None).cast(t).alias(c) for c, t in (("log_prob", "double"), ("perturbed", "double"), ("log_inclusion", "double"), ("ids_sha256", "string"))], "ids", "decodes")
    out = out.select("doc_id", F.explode(F.concat(F.array(plain), "samples")).alias("s"))
    return out.select("doc_id", "s.rank", "s.decodes", "s.n_ids", F.round("s.log_prob", 6).alias("log_prob"), F.round("s.perturbed", 6).alias("perturbed"), F.round("s.log_inclusion", 6).alias("log_inclusion"), "s.ids_sha256", "s.ids")
