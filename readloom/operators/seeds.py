"""Exact overlaps from seeds that an overlap alone decides: the least k-mer (by a hash) of what two reads share, which is an end of the one and the beginning of the other.

As an end of a read grows, its least k-mer seldom changes, so a read has about two rows for all its ends and two for all its beginnings, most of them the same, in place of one for each length of an overlap. Rows carry the read,
packed, so nothing is joined afterwards. Of reads whose strands are both there, one strand is read: k-mers are turned to the lesser of both strands', and an overlap found is also that of the complements.

Where a k-mer has many rows, its pairs meet on the first bases of the least overlap, so a task's work grows with rows and overlaps, not with the square of its rows.

Defined results: reads without a sequence or shorter than the least overlap have none; other letters than A, C, G, T are letters like others (their complement is the letter itself); letters are bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readloom.functions import packed

K = 25  #: bases of a seed at most
TRIED = 1 << 20  #: pairs that a task tries at a time
HOT = 64  #: so many pairs for a row of a k-mer, and its pairs are not all tried
BEGINS, ENDS, TIED, SOURCE, TARGET, SOURCE_BACK, TARGET_BACK = (1 << b for b in range(7))  #: bits of a row. ENDS: its k-mer is the least of some end, BEGINS: of some beginning; _BACK: of the read's complement
FOUND = "src bigint, dst bigint, off int, ov int, n int"  #: n: the target's length
WITH_REST = FOUND + ", rest binary, other string"  #: besides the target's bases behind the overlap, as they stand where others than A, C, G, T are among the target's
_OTHER = ~np.uint64(0)  #: the key of k-mers with other letters
_ACGT = np.zeros(256, bool)
_ACGT[list(b"ACGT")] = True


def _mixed(x: np.ndarray) -> np.ndarray:
    """Numbers in an order that has nothing to do with their size; different ones stay different."""
    x = (x ^ x >> np.uint64(31)) * np.uint64(0x9E3779B97F4A7C15)
    return (x ^ x >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)


def _binary(codes: np.ndarray, lengths: np.ndarray) -> pa.Array:
    words, counts = packed.pack(codes, lengths)
    need = -(-lengths // 32)
    words = words[packed.ragged(counts) < np.repeat(need, counts)]
    ends = pa.array(np.concatenate([[0], np.cumsum(need) * 8]), pa.int64())
    return pa.Array.from_buffers(pa.large_binary(), len(lengths), [None, ends.buffers()[1], pa.py_buffer(words)]).cast(pa.binary())


def _least(keys: np.ndarray, lengths: np.ndarray, k: int, n: int, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Read, place and bits of all k-mers that are the least of an end or a beginning of n to most bases. keys: at each base of all reads."""
    starts, out = np.cumsum(lengths) - lengths, []
    for size in np.unique(lengths).tolist():
        rows, p = np.flatnonzero(lengths == size), np.arange(size - k + 1)
        for some in np.array_split(rows, max(1, len(rows) * size >> 22)):
            at = keys[starts[some, None] + p]
            behind = np.minimum.accumulate(at[:, ::-1], axis=1)[:, ::-1][:, np.minimum(p, size - n)]
            before = np.minimum.accumulate(at, axis=1)[:, np.maximum(p, n - k)]
            bits = ((at == behind) & (p >= size - most)) * np.uint8(ENDS) | ((at == before) & (p + k <= most)) * np.uint8(BEGINS)
            row, place = np.nonzero(bits)
            out.append((some[row], place, bits[row, place].astype(np.int64)))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 3


def _rows_of(batch: pa.RecordBatch, k: int, n: int, most: int, paired: bool) -> pa.RecordBatch:
    flat = batch.column(1).cast(pa.large_binary())
    ends = np.frombuffer(flat.buffers()[1], np.int64)[flat.offset : flat.offset + len(flat) + 1]
    data, lengths = np.frombuffer(flat.buffers()[2], np.uint8)[ends[0] : ends[-1]], np.diff(ends)
    if int(lengths.max(initial=0)) >= 1 << 25:
        raise OverflowError("sequences of 2^25 bases or more")
    codes = packed.base_codes(batch.column(1))[0]
    keys, turned = packed.numbers(codes, k), np.zeros(len(codes), bool)
    if paired:
        back = packed.numbers(3 - codes[::-1], k)[::-1]
        back = np.concatenate([back[k - 1 :], back[: k - 1]])
        turned = back < keys
        keys = np.minimum(keys, back)
    keys = _mixed(keys)
    strange = ~_ACGT[data]
    odd = np.zeros(len(lengths), bool)
    if strange.any():
        upto = np.concatenate([[0], np.cumsum(strange), np.full(k, strange.sum())])
        other = upto[k : k + len(codes)] > upto[: len(codes)]
        keys, turned = np.where(other, _OTHER, keys), turned & ~other
        odd[np.repeat(np.arange(len(lengths)), lengths)[strange]] = True
    of, pos, bits = _least(keys, lengths, k, n, most)
    here = ends[of] - ends[0] + pos
    key, turned = keys[here], turned[here]
    if paired and odd.any():  # nothing tells which strand of such k-mers to take, so both
        again = np.flatnonzero(key == _OTHER)
        of, pos, key, bits = (np.concatenate([x, x[again]]) for x in (of, pos, key, bits))
        turned = np.concatenate([turned, np.ones(len(again), bool)])
    order = np.lexsort((key, of))
    same = (np.diff(of[order]) == 0) & (np.diff(key[order]) == 0)
    tied = np.zeros(len(of), bool)
    tied[order[1:][same]] = tied[order[:-1][same]] = True
    flags = [batch.column(c).to_numpy(zero_copy_only=False)[of].astype(np.int64) for c in range(2, 6)]
    s, t, s2, t2 = flags
    ids, size = batch.column(0).to_numpy()[of], lengths[of]
    swap = lambda x, y: np.where(turned, y, x)
    bits = swap(bits, (bits & BEGINS) * ENDS // BEGINS | (bits & ENDS) * BEGINS // ENDS)
    bits = bits | TIED * tied | SOURCE * swap(s, s2) | TARGET * swap(t, t2) | SOURCE_BACK * swap(s2, s) | TARGET_BACK * swap(t2, t)
    # A row without anything to be is none.
    ends_ok = (bits & ENDS > 0) & (bits & (SOURCE | TARGET_BACK) > 0)
    begins_ok = (bits & BEGINS > 0) & (bits & (TARGET | SOURCE_BACK) > 0)
    meta = np.where(turned, size - k - pos, pos) << 32 | size << 7 | bits & ~np.where(ends_ok, 0, ENDS) & ~np.where(begins_ok, 0, BEGINS)
    words, texts, at = _binary(codes, lengths), batch.column(1), of
    if paired:
        words = pa.concat_arrays([words, _binary(np.where(strange, 0, 3 - codes).astype(np.uint8)[::-1], lengths[::-1])])
        at = np.where(turned, 2 * len(lengths) - 1 - of, of)
    other = pa.nulls(len(of), pa.string())
    if odd.any():
        both = pa.concat_arrays([texts.cast(pa.string()), packed.turned(texts)]) if paired else texts.cast(pa.string())
        other = pc.if_else(pa.array(odd[of]), both.take(pa.array(at)), None)
    some = pa.array(np.flatnonzero(ends_ok | begins_ok))
    columns = [pa.array(key.view(np.int64)), pa.array(np.where(turned, ids ^ 1, ids)), pa.array(meta), words.take(pa.array(at)), other]
    return pa.RecordBatch.from_arrays([c.take(some) for c in columns], names=["key", "id", "meta", "words", "other"])


class _Rows:
    """Rows of whole k-mers, sorted by key and place."""

    def __init__(self, table: pa.Table, n: int, most: int, paired: bool, rest: bool = False) -> None:
        key, meta = table.column("key").to_numpy(), table.column("meta").to_numpy()
        self.id, self.pos, self.n, self.bits = table.column("id").to_numpy(), meta >> 32, meta >> 7 & (1 << 25) - 1, meta & 127
        self.group = np.cumsum(np.diff(key, prepend=key[:1]) != 0)
        self.least, self.most, self.paired, self.rest = n, most, paired, rest
        flat = table.column("words").combine_chunks().cast(pa.large_binary())
        flat = flat.chunk(0) if isinstance(flat, pa.ChunkedArray) else flat
        ends = np.frombuffer(flat.buffers()[1], np.int64)[flat.offset : flat.offset + len(flat) + 1]
        self.words = np.frombuffer(flat.buffers()[2], np.uint8)[ends[0] : ends[-1]].view("<u8")
        self.starts = (ends[:-1] - ends[0]) // 8
        # Where a read holds a k-mer again, only the first one within an overlap counts: a beginning's k-mer may stand as far from its start as from the one before in the end's read, at most.
        self.room = self.pos + 1
        tied = np.flatnonzero(self.bits & (TIED | ENDS) == TIED | ENDS)
        tied = tied[np.lexsort((self.pos[tied], self.id[tied], self.group[tied]))]
        again = np.flatnonzero((np.diff(self.id[tied]) == 0) & (np.diff(self.group[tied]) == 0)) + 1
        self.room[tied[again]] = self.pos[tied[again]] - self.pos[tied[again - 1]]
        other = table.column("other")
        self.other = other.to_pylist() if other.null_count < len(other) else None

    def text(self, i: int) -> str:
        if self.other[i] is not None:
            return self.other[i]
        words = self.words[self.starts[i] : self.starts[i] + -(-self.n[i] // 32)]
        return "".join("ACGT"[int(w) >> 2 * b & 3] for w in words for b in range(32))[: self.n[i]]

    def overlapping(self, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of pairs those whose reads overlap so that their k-mers lie upon each other."""
        off = self.pos[i] - self.pos[j]
        ov = self.n[i] - off
        wanted = (self.bits[i] & SOURCE > 0) & (self.bits[j] & TARGET > 0) | (self.bits[i] & TARGET_BACK > 0) & (self.bits[j] & SOURCE_BACK > 0)
        left = np.flatnonzero((off >= 0) & (ov >= self.least) & (ov <= self.most) & (ov <= self.n[j]) & (self.id[i] != self.id[j]) & wanted)
        done, start = [], 0
        while len(left):
            a, b, o, v = i[left], j[left], off[left], ov[left]
            same = (packed.at(self.words, self.starts[a], o + start) ^ packed.at(self.words, self.starts[b], np.full(len(b), start))) & packed.lowest(v - start) == 0
            left, v = left[same], v[same]
            start += 32
            done.append(left[v <= start])
            left = left[v > start]
        left = np.sort(np.concatenate(done)) if done else left
        if self.other is not None:
            left = np.array([x for x in left.tolist() if self.other[i[x]] is None and self.other[j[x]] is None or self.text(j[x]).startswith(self.text(i[x])[off[x] :])], np.int64)
        return i[left], j[left]

    def _cold(self, i: np.ndarray, first: np.ndarray, upto: np.ndarray, begin: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Rows i with rows begin[first] to begin[upto]."""
        sums = np.cumsum(upto - first)
        a = 0
        while a < len(i):
            b = max(a + 1, int(np.searchsorted(sums, (sums[a - 1] if a else 0) + TRIED, "right")))
            for c in range(0, int(upto[a] - first[a]) if b == a + 1 else 1, TRIED):  # one row may have more than are tried at a time
                lo = first[a:b] + c if b == a + 1 else first[a:b]
                counts = np.minimum(upto[a:b] - lo, TRIED) if b == a + 1 else upto[a:b] - lo
                yield self.overlapping(np.repeat(i[a:b], counts), begin[np.repeat(lo, counts) + packed.ragged(counts)])
            a = b

    def _hot(self, i: np.ndarray, j: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Ends i and beginnings j of one k-mer: they meet on the first bases of the least overlap, for each place of the k-mer in a beginning."""
        n = self.least

        def window(rows: np.ndarray, place: np.ndarray) -> np.ndarray:
            h = np.zeros(len(rows), np.uint64)
            for start in range(0, n, 32):
                h = _mixed(h ^ packed.at(self.words, self.starts[rows], place + start) & packed.lowest(np.full(len(rows), n - start))) + np.uint64(1)
            return h

        for place in np.unique(self.pos[j]).tolist():
            these = j[self.pos[j] == place]
            off = self.pos[i] - place
            those = i[(place < self.room[i]) & (off <= self.n[i] - n)]
            h = window(these, np.zeros(len(these), np.int64))
            order = np.argsort(h, kind="stable")
            these, h = these[order], h[order]
            want = window(those, self.pos[those] - place)
            yield from self._cold(those, np.searchsorted(h, want, "left"), np.searchsorted(h, want, "right"), these)

    def pairs(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """All overlaps: rows of ends and of beginnings."""
        end, begin = np.flatnonzero(self.bits & ENDS), np.flatnonzero(self.bits & BEGINS)
        if not len(end) or not len(begin):
            return
        at = self.group << 32 | self.pos
        first = np.searchsorted(at[begin], self.group[end] << 32 | np.maximum(self.pos[end] - (self.n[end] - self.least), 0), "left")
        upto = np.maximum(np.searchsorted(at[begin], self.group[end] << 32 | self.room[end], "left"), first)
        groups = int(self.group[-1]) + 1
        tried = np.bincount(self.group[end], upto - first, groups)
        hot = np.flatnonzero((tried > TRIED >> 4) & (tried > HOT * np.bincount(self.group, minlength=groups)))
        cold = ~np.isin(self.group[end], hot)
        yield from self._cold(end[cold], first[cold], upto[cold], begin)
        for g in hot.tolist():
            yield from self._hot(*(x[slice(*np.searchsorted(self.group[x], [g, g + 1]))] for x in (end, begin)))

    def found(self) -> Iterator[pa.RecordBatch]:
        twice = []
        for i, j in self.pairs():
            tied = (self.bits[i] & self.bits[j] & TIED) > 0
            if tied.any():  # an overlap may hold its least k-mer on both strands
                twice.append((i[tied], j[tied]))
            yield from self._batches(i[~tied], j[~tied])
        if twice:
            i, j = (np.concatenate(x) for x in zip(*twice, strict=True))
            src, dst, off = self.id[i], self.id[j], self.pos[i] - self.pos[j]
            if self.paired:
                back = dst ^ 1 < src
                src, dst, off = np.where(back, dst ^ 1, src), np.where(back, src ^ 1, dst), np.where(back, self.n[j] - self.n[i] + off, off)
            order = np.lexsort((off, dst, src))
            new = np.ones(len(order), bool)
            new[1:] = (np.diff(src[order]) != 0) | (np.diff(dst[order]) != 0) | (np.diff(off[order]) != 0)
            yield from self._batches(i[order[new]], j[order[new]])

    def _batches(self, i: np.ndarray, j: np.ndarray) -> Iterator[pa.RecordBatch]:
        off = self.pos[i] - self.pos[j]
        ov = self.n[i] - off
        wanted = (self.bits[i] & SOURCE > 0) & (self.bits[j] & TARGET > 0)
        yield from self._batch(i[wanted], j[wanted], off[wanted], ov[wanted], False)
        if self.paired:
            wanted = (self.bits[i] & TARGET_BACK > 0) & (self.bits[j] & SOURCE_BACK > 0) & (self.id[i] ^ 1 != self.id[j])
            yield from self._batch(j[wanted], i[wanted], (self.n[j] - ov)[wanted], ov[wanted], True)

    def _batch(self, i: np.ndarray, j: np.ndarray, off: np.ndarray, ov: np.ndarray, back: bool) -> Iterator[pa.RecordBatch]:
        """back: of the complements of i and j."""
        if not len(i):
            return
        columns = [pa.array(self.id[i] ^ int(back)), pa.array(self.id[j] ^ int(back)), pa.array(off, pa.int32()), pa.array(ov, pa.int32()), pa.array(self.n[j], pa.int32())]
        if self.rest:
            size = self.n[j] - ov
            counts = -(-size // 32)
            first, words = np.cumsum(counts) - counts, np.zeros(int(counts.sum()), np.uint64)
            for k in range(int(counts.max(initial=0))):
                some = np.flatnonzero(counts > k)
                m = np.minimum(size[some] - 32 * k, 32)
                place = size[some] - 32 * k - m if back else ov[some] + 32 * k
                word = packed.at(self.words, self.starts[j[some]], place) & packed.lowest(m)
                words[first[some] + k] = packed.complements(word, m) if back else word
            ends = pa.array(np.append(first, len(words)) * 8)
            other = pa.nulls(len(j), pa.string())
            if self.other is not None:
                texts = [None if self.other[x] is None else self.other[x][v:] if not back else self.other[x][:c][::-1].translate(str.maketrans("ACGT", "TGCA")) for x, v, c in zip(j.tolist(), ov.tolist(), size.tolist(), strict=True)]
                other = pa.array(texts, pa.string())
                for x in range(len(texts)):
                    if texts[x]:  # the same number for such a letter on both strands
                        words[first[x] : first[x] + counts[x]] = packed.pack(*packed.base_codes(pa.array(texts[x : x + 1])))[0][: counts[x]]
            columns += [pa.Array.from_buffers(pa.large_binary(), len(j), [None, ends.buffers()[1], pa.py_buffer(words)]).cast(pa.binary()), other]
        yield pa.RecordBatch.from_arrays(columns, names=["src", "dst", "off", "ov", "n", "rest", "other"][: len(columns)])


def whole_groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Tables of whole groups from batches sorted by key."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        k = batch.column(batch.schema.get_field_index(key)).to_numpy()
        last = int(np.searchsorted(k, k[-1]))  # the last group may go on in the next batch
        if held and (last or held[-1].column(held[-1].schema.get_field_index(key))[-1].as_py() != k[0]):
            yield pa.Table.from_batches([*held, batch.slice(0, last)])
            held = []
        elif last:
            yield pa.Table.from_batches([batch.slice(0, last)])
        held.append(batch.slice(last))
    if held:
        yield pa.Table.from_batches(held)


def overlaps(reads: DataFrame, n: int, most: int, paired: bool, rest: bool = False) -> DataFrame:
    """FOUND, or with rest WITH_REST: all overlaps of n to most bases of reads (id, seq, and whether a read may be source or target, and whether its complement may: s, t, s2, t2). paired: reads are one strand of each pair."""
    k = min(K, n)
    k -= k % 2 == 0  # no k-mer is its own complement

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield _rows_of(batch, k, n, most, paired)

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, "key"):
            yield from _Rows(table, n, most, paired, rest).found()

    made = reads.where(F.length("seq") >= n).select(F.col("id").cast("bigint").alias("id"), "seq", "s", "t", "s2", "t2").mapInArrow(rows, "key bigint, id bigint, meta bigint, words binary, other string")
    return made.repartition("key").sortWithinPartitions("key", "meta").mapInArrow(joined, WITH_REST if rest else FOUND)


def edges_of(found: DataFrame, n: int, most: int, large: int, kept: int) -> DataFrame:
    """src, dst, off: of overlaps (WITH_REST, of any number of bases from n on) those of up to most bases that are large or among a source's kept longest others (of equally long ones those to smaller ids), the smallest offset for each
    two reads; without those A -> C for which a large overlap B -> C shows that A -> B -> C spells the same. A's own overlaps tell: B is one of them then, and B -> C is an overlap if what is behind A in B begins what is behind A in C."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, "src"):
            src, dst, off, ov, size = (table.column(c).to_numpy().astype(np.int64) for c in ("src", "dst", "off", "ov", "n"))
            flat = pa.concat_arrays([c.cast(pa.large_binary()) for c in table.column("rest").chunks])
            ends = np.frombuffer(flat.buffers()[1], np.int64)[flat.offset : flat.offset + len(flat) + 1]
            words = np.frombuffer(flat.buffers()[2], np.uint8)[ends[0] : ends[-1]].view("<u8") if flat.buffers()[2] else np.zeros(0, np.uint64)
            starts, behind = (ends[:-1] - ends[0]) // 8, size - ov
            other = table.column("other").to_pylist() if table.column("other").null_count < len(src) else None
            fit = ov <= most
            small = np.flatnonzero(fit & (ov < large))
            small = small[np.lexsort((dst[small], -ov[small], src[small]))]
            heads = np.flatnonzero(np.diff(src[small], prepend=-1, append=-1)) if len(small) else small
            rank = packed.ragged(np.diff(heads)) if len(small) else small
            edge = np.concatenate([np.flatnonzero(fit & (ov >= large)), small[rank < kept]])
            edge = edge[np.lexsort((off[edge], dst[edge], src[edge]))]
            new = np.ones(len(edge), bool)
            new[1:] = (np.diff(src[edge]) != 0) | (np.diff(dst[edge]) != 0)
            edge = np.sort(edge[new])
            group = np.cumsum(np.diff(src, prepend=src[:1]) != 0)
            at = group << 32 | off
            first, upto = np.searchsorted(group, group[edge], "left"), np.searchsorted(at, at[edge], "left")
            gone = np.zeros(len(edge), bool)
            sums, a = np.cumsum(upto - first), 0
            while a < len(edge):
                b = max(a + 1, int(np.searchsorted(sums, (sums[a - 1] if a else 0) + TRIED, "right")))
                counts = upto[a:b] - first[a:b]
                e = np.repeat(np.arange(a, b), counts)
                via, c = np.repeat(first[a:b], counts) + packed.ragged(counts), edge[e]
                reach = size[via] - off[c] + off[via]  # bases of B -> C
                left = np.flatnonzero((reach >= max(large, n)) & (reach <= np.minimum(most, size[c])) & (dst[via] != dst[c]))
                begin = 0
                while len(left):
                    p, q = via[left], c[left]
                    more = behind[p] > begin
                    ok = ~more
                    ok[more] = (words[starts[p[more]] + begin // 32] ^ words[starts[q[more]] + begin // 32]) & packed.lowest(behind[p[more]] - begin) == 0
                    begin += 32
                    left, p = left[ok], p[ok]
                    whole = left[behind[p] <= begin]
                    if other is not None:
                        whole = np.array([x for x in whole.tolist() if _begins(other, via[x], c[x], words, starts, behind)], np.int64)
                    gone[e[whole]] = True
                    left = left[behind[p] > begin]
                a = b
            edge = edge[~gone]
            yield pa.RecordBatch.from_arrays([pa.array(src[edge]), pa.array(dst[edge]), pa.array(off[edge], pa.int32())], names=["src", "dst", "off"])

    return found.repartition("src").sortWithinPartitions("src", "off").mapInArrow(run, "src bigint, dst bigint, off int")


def _begins(other: list[str | None], i: int, j: int, words: np.ndarray, starts: np.ndarray, size: np.ndarray) -> bool:
    """Whether what is behind i begins what is behind j, letter by letter where one has others than A, C, G, T."""
    if other[i] is None and other[j] is None:
        return True
    text = lambda x: other[x] if other[x] is not None else "".join("ACGT"[int(w) >> 2 * b & 3] for w in words[starts[x] : starts[x] + -(-size[x] // 32)] for b in range(32))[: size[x]]
    return text(j).startswith(text(i))
