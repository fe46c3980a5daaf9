"""Token ids as binary records in files, with an index of their offsets.

A file is a sequence of frames: the payload's length (8 bytes), the masked checksum of these (4), the payload, its masked checksum (4). A payload is a document's id (8 bytes), whether it has one (1), the width of a token id
(1: 2 or 4 bytes, as the vocabulary needs), the ids. All numbers are little-endian. A checksum is the CRC-32, rotated right by 15 bits, plus 0xA282EAD8: so a frame within a payload, or a run of zeros, doesn't check itself.

Documents are dealt into ranges of ids and sorted within; a task writes one file, under a name of its own attempt, and returns the index rows (doc_id, part, file, offset, size, n_tokens), which Spark commits as a Parquet table: what a
lost task has left is in no index. Readers take index rows in any order and read single frames, so an epoch is shuffled by sorting the index, not the data. Files lie in the shared folder of spark.checkpoint.dir, by any file
system that pyarrow knows.

Texts are cut, before the library encodes them, where its pre-tokenizer cuts as well, whatever stands on either side (see _cuts); a batch's distinct pieces are encoded once, and up to PIECES of them are kept by a worker. So ids are
those of the whole text, and the memory for a text of any length is that of its own bytes and ids.

Defined results: null text is empty; empty texts have the end id only; documents are in ascending order of ids, those without one first, rows of one doc_id in the order in which the table is read; equal rows are records of
their own; an empty table gives no file and an empty index; other columns, whatever their names, are ignored. A frame that doesn't fit its checksums raises an error that names file and offset.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from readloom.llm.common import shared_dir, stored, table

MASK = 0xA282EAD8
PIECES = 500_000  #: pieces whose ids a worker keeps
LOT = 8 << 20  #: bytes of texts that are cut and encoded at a time; a longer text is a lot of its own
INDEX = "doc_id bigint, part int, file string, offset bigint, size bigint, n_tokens bigint"
LENGTH, SUM, HEAD = "<Q", "<I", "<qBB"  #: of a frame and a payload

_PLAIN, _LETTER, _STOP = np.zeros(256, bool), np.zeros(256, bool), np.zeros(256, bool)
_PLAIN[33:127] = True  # visible ASCII
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_STOP[list(b".,;:!?")] = True


def masked(crc: int) -> int:
    return ((crc >> 15 | crc << 17) + MASK) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    length = struct.pack(LENGTH, len(payload))
    return b"".join((length, struct.pack(SUM, masked(zlib.crc32(length))), payload, struct.pack(SUM, masked(zlib.crc32(payload)))))


def payload_of(data: bytes, where: str) -> bytes:
    """What a frame holds, if its checksums fit."""
    length = struct.unpack_from(LENGTH, data)[0] if len(data) >= 16 else -1
    if length != len(data) - 16 or struct.unpack_from(SUM, data, 8)[0] != masked(zlib.crc32(data[:8])) or struct.unpack_from(SUM, data, 12 + length)[0] != masked(zlib.crc32(data[12:-4])):
        raise ValueError(f"damaged record: {where}")
    return data[12:-4]


def _cuts(data: np.ndarray) -> np.ndarray:
    """At which places (before a byte, or at the end) UTF-8 text may be cut without changing what the byte-level pre-tokenizer finds on either side.

    It ends a piece between a visible character and a blank or line feed, and behind a letter before anything but a letter; a single line feed between visible characters is a piece; a single blank belongs to what follows.
    Only characters are judged whose class is the same in all Unicode versions: visible ASCII, and letters of two bytes that begin with C3."""
    cut = np.zeros(len(data) + 1, bool)
    if len(data) < 3:
        return cut
    before, here, after = data[:-2], data[1:-1], data[2:]
    accented = np.zeros(len(before), bool)
    accented[1:] = (data[:-3] == 0xC3) & (before[1:] != 0x97) & (before[1:] != 0xB7)
    between = (_PLAIN[before] | accented) & (_PLAIN[after] | (after == 0xC3))
    line = (here == 10) & between
    cut[1:-2] = line | ((here == 32) & between) | (_STOP[here] & (_LETTER[before] | accented))
    cut[2:-1] |= line
    return cut


class Encoder:
    """ids of texts by a file of the tokenizers library, without special tokens added. One for each worker and file."""

    known: dict[tuple[str, bool], Encoder] = {}

    def __init__(self, path: str, as_text: bool) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = as_text
        added = self.tokenizer.get_added_tokens_decoder().values()
        self.special = [] if as_text else [t.content.encode() for t in added]
        kind = np.uint16 if self.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32
        self.kind = np.dtype(kind).newbyteorder("<")
        pre = self.tokenizer.pre_tokenizer
        # Cuts are those of one pre-tokenizer; with any other, and with a normalizer, a text is one piece.
        self.cuts = self.tokenizer.normalizer is None and type(pre).__name__ == "ByteLevel" and not pre.add_prefix_space and pre.use_regex
        self.pieces: dict[bytes, bytes] = {}

    @classmethod
    def of(cls, path: str, as_text: bool) -> Encoder:
        if (path, as_text) not in cls.known:
            cls.known[path, as_text] = cls(path, as_text)
        return cls.known[path, as_text]

    def _whole(self, pieces: list[bytes]) -> list[bytes]:
        """Their ids, as bytes: half the memory of arrays."""
        out: list[bytes] = []
        code = "H" if self.kind.itemsize == 2 else "I"
        for start in range(0, len(pieces), 4096):
            made = self.tokenizer.encode_batch_fast([p.decode() for p in pieces[start : start + 4096]], add_special_tokens=False)
            out += [array(code, x.ids).tobytes() for x in made]
        return out

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        """The ids of each of a lot of texts."""
        whole = [not self.cuts or any(s in t for s in self.special) for t in texts]
        ends = np.cumsum([0] + [0 if w else len(t) for t, w in zip(texts, whole, strict=True)])
        data = np.frombuffer(b"".join(t for t, w in zip(texts, whole, strict=True) if not w), np.uint8)
        cut = _cuts(data)
        cut[ends] = True
        places = np.flatnonzero(cut)
        n = len(places) - 1
        counts = np.zeros(0, np.int64)
        flat = np.zeros(0, self.kind)
        if n:
            offsets = pa.py_buffer(places.astype(np.int64))
            pieces = pa.Array.from_buffers(pa.large_binary(), n, [None, offsets, pa.py_buffer(data)]).dictionary_encode()
            names, which = pieces.dictionary.to_pylist(), pieces.indices.to_numpy()
            ids = list(map(self.pieces.get, names))
            new = [i for i, x in enumerate(ids) if x is None]
            for i, x in zip(new, self._whole([names[i] for i in new]), strict=True):
                ids[i] = x
                if len(self.pieces) < PIECES:
                    self.pieces[names[i]] = x
            sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // self.kind.itemsize
            starts, all_ids = np.cumsum(sizes) - sizes, np.frombuffer(b"".join(ids), self.kind)
            counts = sizes[which]
            # Ragged gather: the place of each id within its piece, behind the piece's start.
            at = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
            flat = all_ids[np.repeat(starts[which], counts) + at]
        # Each text's ids are those of the pieces between its ends.
        reach = np.concatenate([[0], np.cumsum(counts)])[np.searchsorted(places, ends)]
        apart = iter(self._whole([t for t, w in zip(texts, whole, strict=True) if w]))
        return [np.frombuffer(next(apart), self.kind) if w else flat[reach[i] : reach[i + 1]] for i, w in enumerate(whole)]


def _files(folder: str):
    """pyarrow's file system of a folder's address, and the folder's path there."""
    from pyarrow import fs

    if folder.startswith("file:"):
        folder = "/" + folder[5:].lstrip("/")
    return fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)


def _lots(batch: pa.RecordBatch) -> Iterator[tuple[list, list[bytes]]]:
    """ids and texts of a batch, LOT bytes at a time or one text."""
    ids, texts, size = [], [], 0
    for i, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
        t = text.as_buffer().to_pybytes() if text.is_valid else b""
        if texts and size + len(t) > LOT:
            yield ids, texts
            ids, texts, size = [], [], 0
        ids.append(i)
        texts.append(t)
        size += len(t)
    if texts:
        yield ids, texts


def write_records(docs: DataFrame, tokenizer: str, folder: str | None = None, end_id: int = 0, special_as_text: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes docs and writes their ids, with end_id behind each document's, to files in folder (a new one in the shared folder by default). Returns the stored index: doc_id, part, file, offset, size (of the frame), n_tokens.

    tokenizer: a file of the tokenizers library that all workers can read. special_as_text: whether a special token's string within a text is ordinary text."""
    to = f"{folder or shared_dir(docs.sparkSession)}/tokens-{uuid.uuid4().hex}"

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, context = Encoder.of(tokenizer, special_as_text), TaskContext.get()
        files, path = _files(to)
        name, out, offset = f"part-{context.partitionId():06d}-{context.taskAttemptId()}.records", None, 0
        end = np.array([end_id], encoder.kind).tobytes()
        try:
            for batch in batches:
                for ids, texts in _lots(batch):
                    if out is None:
                        files.create_dir(path, recursive=True)
                        out = files.open_output_stream(f"{path}/{name}")
                    frames, sizes = [], []
                    for i, x in zip(ids, encoder.encode(texts), strict=True):
                        frames.append(frame(struct.pack(HEAD, i or 0, i is not None, encoder.kind.itemsize) + x.tobytes() + end))
                        sizes.append(len(x) + 1)
                    out.write(b"".join(frames))
                    lengths = np.array([len(x) for x in frames], np.int64)
                    places = offset + np.cumsum(lengths) - lengths
                    offset += int(lengths.sum())
                    columns = [pa.array(ids, pa.int64()), pa.array(np.full(len(ids), context.partitionId(), np.int32)), pa.array([f"{to}/{name}"] * len(ids)), pa.array(places), pa.array(lengths), pa.array(sizes, pa.int64())]
                    yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "part", "file", "offset", "size", "n_tokens"])
        finally:
            if out is not None:
                out.close()

    slim = docs.select(docs[id_col].cast("bigint").alias("doc_id"), docs[text_col].cast("string").alias("text"), F.monotonically_increasing_id().alias("row"))
    order = [F.asc_nulls_first("doc_id"), F.asc("row")]
    ranges = slim.repartitionByRange(*order).sortWithinPartitions(*order)
    return stored(ranges.select("doc_id", "text").mapInArrow(write, INDEX))


def read_records(index: DataFrame, seed: int | None = None) -> DataFrame:
    """doc_id, part, offset, ids (32-bit little-endian, as binary) of the records that the rows of index name. seed: reads them in an order of its own, which depends on nothing else."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, source = None, None
        for batch in batches:
            rows = [batch.column(c).to_pylist() for c in ("part", "file", "offset", "size")]
            docs, ids, done, size = [], [], 0, 0
            for k, (file, offset, n) in enumerate(zip(*rows[1:], strict=True), 1):
                if file != name:
                    if source is not None:
                        source.close()
                    files, path = _files(file)
                    name, source = file, files.open_input_file(path)
                source.seek(offset)
                payload = payload_of(source.read(n), f"{file} at {offset}")
                doc, known, width = struct.unpack_from(HEAD, payload)
                docs.append(doc if known else None)
                ids.append(np.frombuffer(payload, f"<u{width}", offset=struct.calcsize(HEAD)).astype("<u4").tobytes())
                size += len(ids[-1])
                if size > LOT or k == len(batch):
                    yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(rows[0][done:k], pa.int32()), pa.array(rows[2][done:k], pa.int64()), pa.array(ids, pa.binary())], names=["doc_id", "part", "offset", "ids"])
                    docs, ids, done, size = [], [], k, 0
        if source is not None:
            source.close()

    rows = index.select("part", "file", "offset", "size")
    if seed is not None:
        rows = rows.orderBy(F.xxhash64(F.lit(seed), "part", "offset"), "part", "offset")
    return rows.mapInArrow(read, "doc_id bigint, part int, offset bigint, ids binary")


def digests(read: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of records read from files. Only counts are windowed: those of one file, and the files' totals."""
    rows = stored(read.select("doc_id", "part", "offset", F.expr("octet_length(ids) div 4").cast("bigint").alias("n_tokens"), F.crc32("ids").alias("ids_crc32")))
    upto = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = rows.groupBy("part").agg(F.sum("n_tokens").alias("n")).select("part", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("base"))
    within = Window.partitionBy("part").orderBy("offset").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("before", F.coalesce(F.sum("n_tokens").over(within), F.lit(0)))
    return placed.join(bases, "part").select("doc_id", (F.col("base") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")


def op12_token_files(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digests(read_records(write_records(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))))
