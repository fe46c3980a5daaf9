"""N-gram Jaccard join: which texts share, directly or through others, at least a given part of their word shingles.

Size-aware and heavy-light. Tokens are a set's shingles, ordered rare first by the number of documents that hold them. Small sets enumerate all token subsets of
the overlap that a link to a set of size b needs (fixed for each pair of sizes), and meet on equal subsets. Large sets put their rarest tokens into inverted lists (as many as a
link can miss, plus one) and meet by scanning those. The boundary is the size at which the measured cost of subsets plus list scans is least.

Lists of a passage or template that very many documents share are not multiplied out. First every list links its members to one pivot only; verified links
form components; then only lists that still hold several components are scanned for pairs across components whose places in the token order leave room
for the overlap. The scan joins by classes of size: the larger of two sets asks for those sizes only that its place leaves room for, and the smaller one is listed only by its first places. A pair within one component
needs no test, a pair without that room can't be linked, so no link that matters is lost.

One text of each class of equal sets is counted and linked. Counting tokens moves a few bytes for each shingle: texts are hashed in batches, each batch sends its different tokens, with how many of its texts hold them, to hash
buckets, and a bucket answers with how rare each is. So a token that a third of all texts hold is one entry for each batch, and bucket and batch sizes bound each task's memory; both grow with the corpus, so that what goes from a batch to a
bucket doesn't shrink to nothing. All pairs are verified on 64-bit shingle hashes of whole texts.

Defined results: texts without a word have an empty set and are linked with nothing; equal sets are one class, its smallest doc_id stands for it; rows that share a doc_id are one document: it is linked by any of its
texts; a row without doc_id keeps its size, has no component and takes no part; other columns are ignored (ngram_jaccard) or kept (one_of_each_group).
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readloom.llm.common import filter_bits, filter_of, forget, free_prefix, passes, stored, table
from readloom.llm.graph import components
from readloom.llm.shingles import set_prints, shingle_sets

BATCH_BYTES, BATCH_DOCS = 4 << 20, 60_000  #: texts that are counted together
BUCKET_BYTES = 8 << 20  #: text for each hash bucket
GROWS_FROM, GROWS_TO = 30 << 30, 8  #: text from which both grow with its square root, and how many times at most
MOST_SUBSETS = 4096  #: of one set
PER_PIVOT = 64  #: texts verified against a pivot in one group
PER_TEXT = 64  #: groups that one copy of a text is joined to
CLASSES = 4  #: of size, for sizes that can be linked
FEW = 10_000  #: rows that are broadcast


def overlap_needed(a, b, num: int, den: int):
    """Shingles that sets of sizes a and b must share for a similarity of num / den."""
    return -(-num * (a + b) // (num + den))


def prefix_length(n, num: int, den: int):
    return n - -(-num * n // den) + 1


def subset_sizes(n: int, num: int, den: int) -> dict[int, int]:
    """For each size that a set linked to one of size n can have: the overlap needed."""
    return {b: overlap_needed(n, b, num, den) for b in range(-(-num * n // den), den * n // num + 1)}


def subset_cost(n: int, num: int, den: int) -> int:
    return sum(math.comb(n, c) for c in subset_sizes(n, num, den).values())


@lru_cache
def small_max(num: int, den: int) -> int:
    """The size up to which no set has more than MOST_SUBSETS subsets to enumerate."""
    n = 0
    while n < 64 and subset_cost(n + 1, num, den) <= MOST_SUBSETS:
        n += 1
    return n


def _texts(column: pa.Array) -> list[bytes]:
    return [t or b"" for t in column.cast(pa.large_binary()).to_pylist()]


def _slices(b: pa.RecordBatch, batch_bytes: int = BATCH_BYTES) -> Iterator[tuple[list, list[bytes]]]:
    """Ids and texts in parts of bounded size."""
    ids, texts = b.column(0), b.column(1).cast(pa.large_binary())
    start, size = 0, 0
    sizes = pa.compute.fill_null(pa.compute.binary_length(texts), 0).to_pylist()
    for i, n in enumerate(sizes):
        if i > start and (size + n > batch_bytes or i - start >= BATCH_DOCS):
            yield ids[start:i].to_pylist(), _texts(texts[start:i])
            start, size = i, 0
        size += n
    if start < len(sizes):
        yield ids[start:].to_pylist(), _texts(texts[start:])


def set_table(docs: DataFrame, width: int) -> DataFrame:
    """doc, n, p1, p2 (fingerprints of the set). docs: doc, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute  # noqa: F401

        for b in batches:
            for ids, texts in _slices(b):
                n, p1, p2 = set_prints(len(texts), *shingle_sets(texts, width))
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *map(pa.array, (n, p1, p2))], ["doc", "n", "p1", "p2"])

    return docs.select("doc", "text").mapInArrow(run, "doc bigint, n bigint, p1 bigint, p2 bigint")


def _high_first(x: np.ndarray) -> bytes:
    """Bytes of one weight stand together, so that high ones compress."""
    return np.ascontiguousarray(x.astype(x.dtype.newbyteorder(">")).view(np.uint8).reshape(-1, x.itemsize).T).tobytes()


def _back(data: bytes, kind, n: int, at: int) -> np.ndarray:
    kind = np.dtype(kind)
    return np.ascontiguousarray(np.frombuffer(data, np.uint8, kind.itemsize * n, at).reshape(kind.itemsize, n).T).view(kind.newbyteorder(">")).ravel().astype(kind)


def _rising(x: np.ndarray) -> bytes:
    """Rising 32-bit numbers as their differences, which take fewer bits."""
    return _high_first(np.diff(x, prepend=x.dtype.type(0)))


def _risen(data: bytes, n: int, at: int) -> np.ndarray:
    return np.cumsum(_back(data, np.uint32, n, at), dtype=np.uint32)


def _packed(data: bytes) -> bytes:
    """Compressed harder than shuffles are: these bytes are most of what the join has on disk."""
    return len(data).to_bytes(8, "little") + pa.compress(data, "zstd", asbytes=True)


def _unpacked(data: bytes) -> bytes:
    return pa.decompress(data[8:], int.from_bytes(data[:8], "little"), "zstd", asbytes=True)


def rare_first_tokens(docs: DataFrame, wanted, width: int, num: int, den: int, n_buckets: int, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """doc, p1, p2, n, missing, tokens: the tokens that other texts hold too, rarest first, after missing that none does: all of a small set's, and of a
    large one's as many as belong to its prefix. Texts that can't be linked have no row. docs: doc, text, without null ids; wanted: broadcast (bytes, bits) of the filter of p1 ^ doc of those that count."""
    most_small = small_max(num, den)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute  # noqa: F401
        from pyspark import TaskContext

        has, bits = wanted.value
        has = np.frombuffer(has, np.uint8)
        serial = TaskContext.get().partitionId() << 32
        for b in batches:
            for ids, texts in _slices(b, batch_bytes):
                of, h = shingle_sets(texts, width)
                ids = np.array(ids, np.int64)
                n, p1, p2 = set_prints(len(texts), of, h)
                once = np.zeros(len(ids), bool)
                once[np.unique(np.stack([ids, p1, p2]), axis=1, return_index=True)[1]] = True
                keep = once & (n > 0) & passes(has, (p1 ^ ids) & (bits - 1))
                if not keep.any():
                    continue
                pairs = keep[of]
                of, h = (np.cumsum(keep) - 1)[of[pairs]].astype(np.uint16), h[pairs]
                key = (h % np.uint64(n_buckets)) << np.uint64(32) | h >> np.uint64(32)
                order = np.argsort(key)
                key, of = key[order], of[order]
                first = np.flatnonzero(np.diff(key, prepend=key[:1] ^ np.uint64(1)) != 0)
                count = np.diff(first, append=len(key)).astype(np.uint16)
                bucket, low = (key[first] >> np.uint64(32)).astype(np.int64), key[first].astype(np.uint32)
                edge = np.flatnonzero(np.diff(bucket, prepend=-1) != 0)
                size = np.diff(edge, append=len(bucket))
                blobs = [_packed(_rising(low[a : a + m]) + _high_first(count[a : a + m])) for a, m in zip(edge.tolist(), size.tolist(), strict=True)]
                own = np.array([keep.sum(), len(edge), len(first), len(of)], np.int64).tobytes() + np.stack([ids[keep], n[keep], p1[keep], p2[keep]]).tobytes() + bucket[edge].tobytes() + size.astype(np.int64).tobytes() + _high_first(count) + _high_first(of)
                yield pa.RecordBatch.from_arrays([pa.array([*bucket[edge].tolist(), n_buckets + hash((serial, "own")) % n_buckets], pa.int32()), pa.array([serial] * (len(edge) + 1), pa.int64()), pa.array([*blobs, _packed(own)], pa.binary())], ["bucket", "batch", "data"])
                serial += 1

    def count(t: pa.Table) -> pa.Table:
        bucket = t["bucket"][0].as_py()
        if bucket >= n_buckets:
            return t
        data = [_unpacked(d) for d in t["data"].to_pylist()]
        parts = [(_risen(d, len(d) // 6, 0), _back(d, np.uint16, len(d) // 6, 4 * (len(d) // 6))) for d in data]
        everything, held = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        order = np.argsort(everything, kind="stable")
        everything, held = everything[order], held[order].astype(np.int64)
        edge = np.flatnonzero(np.diff(everything, prepend=everything[:1] ^ np.uint32(1)) != 0)
        total = np.add.reduceat(held, edge)
        several = total > 1
        tokens, rank = everything[edge[several]], np.minimum(255, np.rint(8 * np.log2(total[several]))).astype(np.uint8)
        out = []
        for low, _ in parts:
            at = np.searchsorted(tokens, low)
            hit = at < len(tokens)
            hit[hit] = tokens[at[hit]] == low[hit]
            ranks = np.zeros(len(low), np.uint8)
            ranks[hit] = rank[at[hit]]
            out.append(_packed(ranks.tobytes() + _rising(low[hit])))
        return pa.table({"bucket": t["bucket"], "batch": t["batch"], "data": pa.array(out, pa.binary())})

    def choose(t: pa.Table) -> pa.Table:
        empty = pa.schema([(c, pa.int64()) for c in ("doc", "p1", "p2", "n", "missing")] + [("tokens", pa.list_(pa.int64()))])
        answers = dict(zip(t["bucket"].to_pylist(), map(_unpacked, t["data"].to_pylist()), strict=True))
        own = answers.pop(next(b for b in answers if b >= n_buckets))
        n_docs, n_edges, n_first, n_pairs = np.frombuffer(own, np.int64, 4).tolist()
        ids, n, p1, p2 = np.frombuffer(own, np.int64, 4 * n_docs, 32).reshape(4, n_docs)
        at = 32 + 32 * n_docs
        buckets, sizes = np.frombuffer(own, np.int64, 2 * n_edges, at).reshape(2, n_edges)
        at += 16 * n_edges
        counts, of = _back(own, np.uint16, n_first, at).astype(np.int64), _back(own, np.uint16, n_pairs, at + 2 * n_first).astype(np.int64)
        rank, token = np.zeros(n_first, np.uint8), np.zeros(n_first, np.int64)
        begin = 0
        for bucket, m in zip(buckets.tolist(), sizes.tolist(), strict=True):
            data = answers[bucket]
            r = np.frombuffer(data, np.uint8, m)
            rank[begin : begin + m] = r
            token[begin : begin + m][r > 0] = _risen(data, int((r > 0).sum()), m).astype(np.int64) | bucket << 32
            begin += m
        rank, token = np.repeat(rank, counts), np.repeat(token, counts)
        hit = rank > 0
        rank, token, of = rank[hit], token[hit], of[hit]
        order = np.lexsort((token, rank, of))
        token, of = token[order], of[order]
        shared = np.bincount(of, minlength=n_docs)
        begin = np.cumsum(shared) - shared
        missing = n - shared
        take = np.where(n <= most_small, shared, np.clip(prefix_length(n, num, den) - missing, 0, shared))
        take[prefix_length(n, num, den) <= missing] = 0
        rows = np.flatnonzero(take)
        flat = token[np.concatenate([np.arange(begin[r], begin[r] + take[r]) for r in rows])] if len(rows) else token[:0]
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(take[rows])]).astype(np.int32)), pa.array(flat))
        return pa.Table.from_arrays([*(pa.array(x[rows]) for x in (ids, p1, p2, n, missing)), lists], schema=empty)

    kind = "bucket int, batch bigint, data binary"
    answers = docs.select("doc", "text").mapInArrow(emit, kind).groupBy("bucket").applyInArrow(count, kind)
    return answers.groupBy("batch").applyInArrow(choose, "doc bigint, p1 bigint, p2 bigint, n bigint, missing bigint, tokens array<bigint>")


def boundary(sizes: dict[int, int], scan_cost: float, num: int, den: int) -> int:
    """The size up to which sets enumerate subsets. sizes: how many sets of each size up to small_max(); scan_cost: rows met for each row in a list."""
    most = small_max(num, den)
    lists = {n: max(0, prefix_length(n, num, den)) * (1 + scan_cost) for n in range(1, most + 1)}
    costs = [sum(c * (subset_cost(n, num, den) if n <= b else lists[n]) for n, c in sizes.items() if n <= most) for b in range(most + 1)]
    return int(np.argmin(costs))


def subset_pairs(small: DataFrame, limit: int, num: int, den: int) -> DataFrame:
    """a, b: small sets that share a subset of the size that their sizes ask for, each with the first of its counterparts."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for t in batches:
            rows = []
            for doc, n, tokens in zip(t["doc"], t["n"], t["tokens"], strict=True):
                for b, c in subset_sizes(n, num, den).items():
                    if b > limit or c > len(tokens):
                        continue
                    for s in combinations(sorted(tokens), c):
                        key = hashlib.blake2b(np.array(s, np.int64).tobytes(), digest_size=8).digest()
                        rows.append((min(n, b), max(n, b), int.from_bytes(key, "big", signed=True), doc, n))
            yield pd.DataFrame(rows, columns=["low", "high", "key", "doc", "n"])

    keys = small.select("doc", "n", "tokens").mapInPandas(run, "low bigint, high bigint, key bigint, doc bigint, n bigint")
    firsts = keys.groupBy("low", "high", "key").agg(F.min(F.when(F.col("n") == F.col("low"), F.col("doc"))).alias("first_low"), F.min(F.when(F.col("n") == F.col("high"), F.col("doc"))).alias("first_high"), F.count("*").alias("held")).where("held > 1 and first_low is not null and first_high is not null")
    met = keys.join(firsts, ["low", "high", "key"])
    return met.select(F.when(F.col("n") == F.col("low"), F.col("first_high")).otherwise(F.col("first_low")).alias("a"), F.col("doc").alias("b")).where("a <> b").distinct()


def verified(pairs: DataFrame, docs: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """Those pairs (a, b) that are linked. Only texts of documents in pairs move, and no group holds more than about PER_PIVOT of them."""
    ids = stored(pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct())
    bits = filter_bits(ids.count())
    known = docs.sparkSession.sparkContext.broadcast(filter_of(ids, F.expr(f"xxhash64(id) & {bits - 1}L")))

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        has = np.frombuffer(known.value, np.uint8)
        for b in batches:
            keep = pa.array(passes(has, b.column(2).to_numpy()))
            yield pa.RecordBatch.from_arrays([c.filter(keep) for c in b.columns[:2]], ["doc", "text"])

    near = docs.select("doc", "text", F.expr(f"xxhash64(doc) & {bits - 1}L").alias("bit")).mapInArrow(pick, "doc bigint, text string")
    parts = pairs.groupBy("a").agg(F.count("*").alias("m")).select("a", F.expr(f"cast(ceil(m / {PER_PIVOT}) as bigint)").alias("parts"))
    members = pairs.join(parts, "a").select("a", F.expr("pmod(xxhash64(b), parts)").alias("part"), F.col("b").alias("doc"))
    pivots = members.select("a", "part").distinct().select("a", "part", F.col("a").alias("doc"))
    # A text that many groups need has a copy for each PER_TEXT of them.
    needs = stored(members.unionByName(pivots))
    salts = needs.groupBy("doc").agg(F.count("*").alias("k")).select("doc", F.expr(f"cast(ceil(k / {PER_TEXT}) as bigint)").alias("salts"))
    texts = near.join(salts, "doc").dropDuplicates(["doc", "text"]).select("doc", "text", F.explode(F.expr("sequence(0L, salts - 1)")).alias("salt"))
    hot = stored(salts.where("salts > 1"))
    named = F.broadcast(hot) if hot.count() <= FEW else hot
    salted = needs.join(named, "doc", "left").select("a", "part", "doc", F.expr("pmod(xxhash64(a, part), coalesce(salts, 1L))").alias("salt"))
    rows = salted.join(texts, ["doc", "salt"]).select("a", "part", "doc", "text")

    def check(t: pa.Table) -> pa.Table:
        a, ids, texts = t["a"][0].as_py(), t["doc"].to_pylist(), _texts(t["text"].combine_chunks())
        of, h = shingle_sets(texts, width)
        cuts = np.searchsorted(of, np.arange(len(ids) + 1))
        owns = [h[cuts[i] : cuts[i + 1]] for i, b in enumerate(ids) if b == a]
        linked = set()
        for i, b in enumerate(ids):
            for own in owns if b != a and b not in linked else ():
                both = len(np.intersect1d(own, h[cuts[i] : cuts[i + 1]], assume_unique=True))
                if both and den * both >= num * (len(own) + cuts[i + 1] - cuts[i] - both):
                    linked.add(b)
        linked = sorted(linked)
        return pa.table({"a": pa.array([a] * len(linked), pa.int64()), "b": pa.array(linked, pa.int64())})

    return rows.groupBy("a", "part").applyInArrow(check, "a bigint, b bigint")


def ngram_jaccard(documents: DataFrame, width: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each row of documents: doc_id, n_shingles, component_id. Sets are linked if den * intersection >= num * union."""
    docs = documents.select(documents[id_col].cast("bigint").alias("doc"), documents[text_col].cast("string").alias("text"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    growth = min(GROWS_TO, max(1.0, math.sqrt(size / GROWS_FROM)))
    n_buckets = max(8, math.ceil(size / (BUCKET_BYTES * growth)))
    sets = stored(set_table(docs, width))
    classes = sets.where("doc is not null and n > 0").groupBy("p1", "p2").agg(F.min("doc").alias("rep"), F.count("*").alias("copies"))
    classes = stored(classes)
    # Documents of several texts hold their classes together.
    several = sets.where("doc is not null and n > 0").groupBy("doc").agg(F.min(F.struct("p1", "p2")).alias("lo"), F.max(F.struct("p1", "p2")).alias("hi")).where("lo <> hi").select("doc")
    tied = stored(sets.join(several, "doc", "left_semi").join(classes, ["p1", "p2"]).select(F.col("doc").alias("a"), F.col("rep").alias("b")).where("a <> b").distinct())

    named = docs.where("doc is not null")
    bits = filter_bits(classes.count())
    wanted = documents.sparkSession.sparkContext.broadcast((filter_of(classes, F.expr(f"(p1 ^ rep) & {bits - 1}L")), bits))
    ordered = stored(rare_first_tokens(named, wanted, width, num, den, n_buckets, int(BATCH_BYTES * growth)))  # before the join: what was shuffled for it goes
    tokens = stored(ordered.join(classes.select(F.col("rep").alias("doc"), "p1", "p2", "copies"), ["doc", "p1", "p2"]).dropDuplicates(["doc", "p1", "p2"]))
    forget(ordered)
    small = tokens.where(F.col("n") <= small_max(num, den))
    prefix = tokens.select("doc", "n", "copies", "missing", F.posexplode(F.expr(f"slice(tokens, 1, cast(n - cast(ceil(n * {num}D / {den}D - 1e-9D) as bigint) + 1 - missing as int))")).alias("i", "token")).withColumn("at", F.col("missing") + F.col("i"))
    held = prefix.groupBy("token").agg(F.count("*").alias("c")).agg(F.sum("c").alias("rows"), F.sum(F.col("c").cast("double") * F.col("c")).alias("scans")).first()
    scan_cost = (held["scans"] or 0) / max(1, held["rows"] or 0)
    limit = boundary(dict(small.groupBy("n").count().collect()), scan_cost, num, den)

    # Lists hold the sets that can be linked to one over the limit.
    lists = stored(prefix.where(F.expr(f"cast(floor(n * {den}D / {num}D + 1e-9D) as bigint) > {limit}")).select("token", "doc", "n", "at", "copies"))
    room = f"{{0}}.n - {{0}}.at >= ceil({num}D * (x.n + y.n) / {num + den}D - 1e-9D)"
    fits = f"least(x.n, y.n) * {den} >= greatest(x.n, y.n) * {num} and greatest(x.n, y.n) > {limit} and " + " and ".join(room.format(s) for s in "xy")
    order = F.struct(-F.col("copies"), "at", "doc", "n")
    pivots = lists.groupBy("token").agg(F.min(order).alias("p"), F.count("*").alias("c")).where("c > 1").select("token", F.col("p.doc").alias("doc"), F.col("p.n").alias("n"), F.col("p.at").alias("at"))
    starred = lists.alias("y").join(pivots.alias("x"), (F.col("x.token") == F.col("y.token")) & (F.col("x.doc") != F.col("y.doc")) & F.expr(fits)).select(F.col("x.doc").alias("a"), F.col("y.doc").alias("b"))
    first = stored(starred.unionByName(subset_pairs(small.where(F.col("n") <= limit), limit, num, den)).distinct())
    forget(tokens)
    links = stored(verified(first, named, width, num, den))

    found = components(links)
    labelled = lists.join(found, lists.doc == found.id, "left").select("token", "doc", "n", "at", F.coalesce("component", "doc").alias("of"))
    mixed_lists = labelled.groupBy("token").agg(F.min("of").alias("lo"), F.max("of").alias("hi")).where("lo <> hi").select("token")
    labelled = stored(labelled.join(mixed_lists, "token", "left_semi"))
    forget(lists)
    # x is the larger set, or of equal ones that with the greater id.
    size_class = f"cast(floor({CLASSES}D * ln({{0}}) / ln({den}D / {num}D) + 1e-9D) as int)" if num < den else "cast({0} as int)"
    least, most = f"ceil({num}D * n / {den}D - 1e-9D)", f"least(n, floor((n - at) * {num + den}D / {num}D + 1e-9D) - n)"
    asking = labelled.where(f"{most} >= {least}").select("*", F.explode(F.expr(f"sequence({size_class.format(least)}, {size_class.format(most)})")).alias("size")).alias("x")
    listed = labelled.where(f"n - at >= ceil({2 * num}D * n / {num + den}D - 1e-9D)").withColumn("size", F.expr(size_class.format("n"))).alias("y")
    apart = F.expr("(x.n > y.n or (x.n = y.n and x.doc > y.doc)) and x.doc <> y.doc and x.of <> y.of")
    across = asking.join(listed, (F.col("x.token") == F.col("y.token")) & (F.col("x.size") == F.col("y.size")) & apart & F.expr(fits)).select(F.expr("least(x.doc, y.doc)").alias("a"), F.expr("greatest(x.doc, y.doc)").alias("b")).distinct()
    tested = first.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    across = stored(across.join(tested, ["a", "b"], "left_anti"))
    more = stored(verified(across, named, width, num, den))

    ends = components(links.unionByName(more).unionByName(tied))
    own = classes.join(ends, classes.rep == ends.id, "left").select("p1", "p2", F.coalesce("component", "rep").alias("component_id"))
    out = sets.join(own, ["p1", "p2"], "left")
    return out.select(F.col("doc").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("doc").isNotNull(), F.coalesce("component_id", "doc")).alias("component_id"))


def one_of_each_group(documents: DataFrame, width: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text", judged: DataFrame | None = None) -> DataFrame:
    """documents, same columns, with the row of the smallest doc_id of each component only; rows without doc_id stay. judged: ids and texts to link them by, if not their own."""
    found = ngram_jaccard(documents if judged is None else judged, width, num, den, id_col, text_col)
    name = f"{free_prefix(documents)}gone"
    extra = found.where(f"`{id_col}` is not null and `{id_col}` <> component_id").select(F.col(id_col).alias(name)).distinct()
    return documents.join(extra, documents[id_col].cast("bigint") == extra[name], "left_anti")


def op1_ngram_jaccard(spark, sf_dir: str) -> DataFrame:
    return ngram_jaccard(table(spark, sf_dir, "documents"), width=3, num=90, den=100)


OP1_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN CAST([] AS VARCHAR[]) WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
                      ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS sh FROM d
), t AS (SELECT doc_id, unnest(sh) AS g FROM s), n AS (SELECT doc_id, CAST(len(sh) AS BIGINT) AS n FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM t a JOIN t b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 90 * (x.n + y.n - k)),
u AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
reach AS (SELECT doc_id, doc_id AS low FROM n UNION SELECT u.b, r.low FROM reach r JOIN u ON u.a = r.doc_id WHERE r.low < u.b)
SELECT n.doc_id, n.n AS n_shingles, min(r.low) AS component_id FROM n JOIN reach r ON r.doc_id = n.doc_id GROUP BY 1, 2
"""
