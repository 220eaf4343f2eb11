"""Operator 3: token ids in wavelet-matrix shards.

Documents in ascending id order are tokenized, an end id follows each, and
runs of whole documents become shards. A shard is one self-contained file
image: a directory of its documents and one bit-plane for each bit of an id,
highest first, each plane holding the order that the planes above have made
(zeros first, then ones, both stable). With the rank directory that comes with
each plane, ``access``, ``count`` and ``occurrences`` walk the planes and never
rebuild the ids.

Layout: ``TWM1``, a little-endian uint32 for the header's length, the header
as JSON, then the zstandard frames that the header lists with their lengths.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common, tokens

MAGIC = b"TWM2"
END_ID = 2
#: A shard is closed by the document that brings it to this many ids.
SHARD_TOKENS = 8_000_000
#: Words that the encoder keeps in each of its two generations, and bytes of text that it looks up together.
CACHED_WORDS, BATCH_BYTES = 400_000, 4_000_000
#: Bits that one entry of a plane's rank directory covers.
BLOCK_BITS = 4096
#: Bytes of a plane's piece, a multiple of a block's, and pieces that a reader keeps unpacked.
PIECE_BYTES, KEPT_PIECES = 1 << 16, 64
#: From so many occurrences on, a plane is searched as a whole.
MANY = 2000

SHARD_SCHEMA = "part int, seq int, part_start long, n_tokens long, n_docs long, payload binary"
DOC_SCHEMA = "part int, doc_id long, part_start long, n_tokens long, ids_crc32 long, first_id long, first_id_count long"


def _popcounts(plane: np.ndarray) -> np.ndarray:
    """Ones before each block of a packed plane, and in all of it."""
    pad = -len(plane) % (BLOCK_BITS // 8)
    ones = np.bitwise_count(np.pad(plane, (0, pad))).reshape(-1, BLOCK_BITS // 8).sum(axis=1, dtype=np.uint64)
    return np.concatenate([np.zeros(1, np.uint64), np.cumsum(ones, dtype=np.uint64)])


def encode_shard(doc_ids: list[int | None], counts: np.ndarray, ids: np.ndarray, level: int = 1) -> bytes:
    """The file image of documents whose ids follow one another in ``ids``."""
    bits = max(1, int(ids.max()).bit_length() if len(ids) else 1)
    work = ids.astype(np.uint16 if bits <= 16 else np.uint32)
    pack = zstandard.ZstdCompressor(level=level)
    frames, zeros = [], []
    for b in range(bits - 1, -1, -1):
        ones = (work & work.dtype.type(1 << b)) != 0
        plane = np.packbits(ones)
        frames.append(pack.compress(_popcounts(plane).tobytes()))
        frames += [pack.compress(plane[a : a + PIECE_BYTES].tobytes()) for a in range(0, len(plane), PIECE_BYTES)]
        low = np.flatnonzero(~ones)
        zeros.append(len(low))
        if b:
            below = np.empty_like(work)
            work.take(low, out=below[: len(low)], mode="clip")
            work.take(np.flatnonzero(ones), out=below[len(low) :], mode="clip")
            work = below
    known = np.array([d is not None for d in doc_ids], bool)
    directory = [np.array([d or 0 for d in doc_ids], "<i8").tobytes(), np.packbits(known).tobytes(), np.asarray(counts, "<i8").tobytes()]
    frames = [pack.compress(x) for x in directory] + frames
    header = json.dumps({"n": len(ids), "docs": len(doc_ids), "bits": bits, "zeros": zeros, "piece": PIECE_BYTES, "frames": [len(f) for f in frames]}).encode()
    return MAGIC + struct.pack("<I", len(header)) + header + b"".join(frames)


class WaveletShard:
    """Reads one file image. Positions and documents count from 0."""

    def __init__(self, image: bytes) -> None:
        if image[:4] != MAGIC:
            raise ValueError("not a wavelet-matrix shard")
        (size,) = struct.unpack_from("<I", image, 4)
        head = json.loads(image[8 : 8 + size])
        self.n, self.bits, self.zeros, self.piece = head["n"], head["bits"], head["zeros"], head["piece"]
        self._image, self._sizes = memoryview(image), head["frames"]
        self._at = np.cumsum([8 + size, *self._sizes])
        self._pieces = -(-((self.n + 7) // 8) // self.piece)
        self._held: dict[int, np.ndarray] = {}
        self._ranks: dict[int, np.ndarray] = {}
        self._unpack = zstandard.ZstdDecompressor()
        known = np.unpackbits(np.frombuffer(self._frame(1), np.uint8), count=head["docs"])
        self.doc_ids = [int(d) if k else None for d, k in zip(np.frombuffer(self._frame(0), "<i8"), known, strict=True)]
        self.counts = np.frombuffer(self._frame(2), "<i8")

    def _frame(self, f: int) -> bytes:
        return self._unpack.decompress(self._image[self._at[f] : self._at[f] + self._sizes[f]])

    def _first_frame(self, k: int) -> int:
        return 3 + k * (1 + self._pieces)

    def rank(self, k: int) -> np.ndarray:
        """Ones before each block of plane ``k``."""
        if k not in self._ranks:
            self._ranks[k] = np.frombuffer(self._frame(self._first_frame(k)), np.uint64)
        return self._ranks[k]

    def _piece(self, k: int, at: int) -> tuple[np.ndarray, int]:
        """The piece of plane ``k`` that holds byte ``at``, and its first byte."""
        f = self._first_frame(k) + 1 + at // self.piece
        if f not in self._held:
            if len(self._held) >= KEPT_PIECES:
                self._held.pop(next(iter(self._held)))
            self._held[f] = np.frombuffer(self._frame(f), np.uint8)
        return self._held[f], at // self.piece * self.piece

    @property
    def unpacked(self) -> int:
        """Pieces of planes that are held unpacked."""
        return len(self._held)

    def plane(self, k: int) -> np.ndarray:
        """Plane ``k`` as a whole."""
        first = self._first_frame(k) + 1
        return np.frombuffer(b"".join(self._frame(f) for f in range(first, first + self._pieces)), np.uint8)

    def _ones(self, k: int, i: int) -> int:
        """Ones before position ``i`` of plane ``k``."""
        block = i // BLOCK_BITS
        total = int(self.rank(k)[block])
        if i % BLOCK_BITS:
            piece, first = self._piece(k, i // 8)
            at = block * (BLOCK_BITS // 8) - first
            total += int(np.bitwise_count(piece[at : i // 8 - first]).sum())
            if i % 8:
                total += (int(piece[i // 8 - first]) >> (8 - i % 8)).bit_count()
        return total

    def access(self, i: int) -> int:
        """The id at position ``i``."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for k in range(self.bits):
            piece, first = self._piece(k, i // 8)
            bit = piece[i // 8 - first] >> (7 - i % 8) & 1
            ones = self._ones(k, i)
            value, i = value << 1 | int(bit), self.zeros[k] + ones if bit else i - ones
        return value

    def _range(self, value: int, start: int, stop: int) -> tuple[int, int]:
        if value >> self.bits:
            return 0, 0
        for k in range(self.bits):
            a, b = self._ones(k, start), self._ones(k, stop)
            start, stop = (self.zeros[k] + a, self.zeros[k] + b) if value >> (self.bits - 1 - k) & 1 else (start - a, stop - b)
        return start, stop

    def count(self, value: int, start: int = 0, stop: int | None = None) -> int:
        """Occurrences of an id in positions [start, stop)."""
        a, b = self._range(value, start, self.n if stop is None else stop)
        return b - a

    def _select(self, k: int, bit: int, j: int) -> int:
        """Position of the ``j``-th (from 0) ``bit`` in plane ``k``."""
        before = self.rank(k).astype(np.int64)
        if not bit:
            before = np.arange(len(before), dtype=np.int64) * BLOCK_BITS - before
        block = int(np.searchsorted(before, j, side="right")) - 1
        piece, first = self._piece(k, block * (BLOCK_BITS // 8))
        at = block * (BLOCK_BITS // 8) - first
        found = np.flatnonzero(np.unpackbits(piece[at : at + BLOCK_BITS // 8]) == bit)
        return block * BLOCK_BITS + int(found[j - before[block]])

    def select(self, value: int, j: int) -> int:
        """Position of the ``j``-th (from 0) occurrence of an id."""
        a, b = self._range(value, 0, self.n)
        if not 0 <= j < b - a:
            raise IndexError(j)
        at = a + j
        for k in range(self.bits - 1, -1, -1):
            bit = value >> (self.bits - 1 - k) & 1
            at = self._select(k, bit, at - self.zeros[k] if bit else at)
        return at

    def occurrences(self, value: int) -> list[int]:
        """All positions of an id, ascending."""
        a, b = self._range(value, 0, self.n)
        if b - a < MANY:
            return [self.select(value, j) for j in range(b - a)]
        at = np.arange(a, b)
        for k in range(self.bits - 1, -1, -1):
            bit = value >> (self.bits - 1 - k) & 1
            places = np.flatnonzero(np.unpackbits(self.plane(k), count=self.n) == bit)
            at = places[at - self.zeros[k] if bit else at]
        return at.tolist()

    def count_first(self, starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The id at each of ``starts``, and how often it occurs before the ``stops``: access and count for many ranges at once."""
        value, low, high = np.zeros(len(starts), np.int64), starts.astype(np.int64), stops.astype(np.int64)
        for k in range(self.bits):
            plane = np.append(self.plane(k), np.uint8(0))
            upto = np.concatenate([[0], np.cumsum(np.bitwise_count(plane), dtype=np.int64)])
            ones = lambda i: upto[i // 8] + np.bitwise_count(plane[i // 8] >> (8 - i % 8).astype(np.uint8) & np.where(i % 8, 255, 0).astype(np.uint8))  # noqa: E731, B023
            bit = plane[low // 8] >> (7 - low % 8).astype(np.uint8) & 1
            a, b = ones(low), ones(high)
            value = value << 1 | bit
            low, high = np.where(bit, self.zeros[k] + a, low - a), np.where(bit, self.zeros[k] + b, high - b)
        return value, high - low

    def decode(self) -> np.ndarray:
        """All ids in their first order, from the lowest plane upwards."""
        out = np.zeros(self.n, np.uint16 if self.bits <= 16 else np.uint32)
        for k in range(self.bits - 1, -1, -1):
            ones = np.unpackbits(self.plane(k), count=self.n).view(bool)
            above = np.empty_like(out)
            above[np.flatnonzero(~ones)] = out[: self.zeros[k]]
            above[np.flatnonzero(ones)] = out[self.zeros[k] :] | out.dtype.type(1 << (self.bits - 1 - k))
            out = above
        return out


def _shards(path: str, end_id: int, shard_tokens: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = common.kept("wavelet", path, lambda p: tokens.WordEncoder(p, CACHED_WORDS, BATCH_BYTES))
        part = TaskContext.get().partitionId()
        seq = start = size = 0
        docs: list = []
        counts: list[np.ndarray] = []
        ids: list[np.ndarray] = []

        def image() -> pa.RecordBatch:
            row = [part], [seq], [start], [size], [len(docs)], [encode_shard(docs, np.concatenate(counts), np.concatenate(ids))]
            kinds = pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()
            names = ["part", "seq", "part_start", "n_tokens", "n_docs", "payload"]
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row, kinds, strict=True)], names)

        for batch in batches:
            names, done = batch.column(0).to_pylist(), 0
            for got, each in enc.encode_column(batch.column(1), end_id):
                ends, lo = np.cumsum(each), 0
                while lo < len(each):
                    before = int(ends[lo - 1]) if lo else 0
                    hi = min(len(each), int(np.searchsorted(ends, before + shard_tokens - size)) + 1)
                    docs += names[done + lo : done + hi]
                    counts.append(each[lo:hi])
                    ids.append(got[before : ends[hi - 1]].astype(np.uint16 if enc.short else np.uint32))
                    size += len(ids[-1])
                    lo = hi
                    if size >= shard_tokens:
                        yield image()
                        seq, start, size = seq + 1, start + size, 0
                        docs, counts, ids = [], [], []
                done += len(each)
        if docs:
            yield image()

    return run


def write_shards(docs: DataFrame, path: str, vocabulary: str | None = None, end_id: int = END_ID, shard_tokens: int = SHARD_TOKENS, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write ``docs`` as shards, one file each, below ``path``.

    Ids ascend within and across parts; rows with one id follow one another
    in the order of their texts, a null id comes first. A null or empty text
    is the end id alone. An empty table gives no shard.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    ordered = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    shards = ordered.mapInArrow(_shards(vocabulary or tokens.vocabulary_path(), end_id, shard_tokens), SHARD_SCHEMA)
    shards.write.option("maxRecordsPerFile", 1).option("compression", "none").parquet(path)


def read_shards(spark, path: str) -> DataFrame:
    return spark.read.schema(SHARD_SCHEMA).parquet(path)


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, start, payload in zip(batch.column(0), batch.column(1), batch.column(2), strict=True):
            shard = WaveletShard(payload.as_py())
            ids = shard.decode()
            ends = np.cumsum(shard.counts)
            starts = ends - shard.counts
            crc = [zlib.crc32(ids[a:b].astype("<u4").tobytes()) for a, b in zip(starts, ends, strict=True)]
            n = len(crc)
            del ids
            first, times = shard.count_first(starts, ends)
            yield pa.RecordBatch.from_arrays(
                [pa.array([part.as_py()] * n, pa.int32()), *(pa.array(c, pa.int64()) for c in (shard.doc_ids, starts + start.as_py(), shard.counts, crc, first, times))],
                ["part", "doc_id", "part_start", "n_tokens", "ids_crc32", "first_id", "first_id_count"],
            )


def _lookup(wanted: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for payload in batch.column(0):
                shard = WaveletShard(payload.as_py())
                ends = np.cumsum(shard.counts)
                for value in wanted:
                    at = np.array(shard.occurrences(value), np.int64)
                    doc = np.searchsorted(ends, at, side="right")
                    yield pa.RecordBatch.from_arrays([pa.array([value] * len(at), pa.int64()), pa.array([shard.doc_ids[d] for d in doc], pa.int64()), pa.array(at - (ends - shard.counts)[doc], pa.int64())], ["token_id", "doc_id", "place"])

    return run


def find_tokens(shards: DataFrame, wanted: list[int]) -> DataFrame:
    """token_id, doc_id, place of each occurrence of the ids in ``wanted``; only the planes' pieces on their way are unpacked."""
    return shards.select("payload").mapInArrow(_lookup(sorted(set(wanted))), "token_id long, doc_id long, place long")


def document_digests(shards: DataFrame, ranks: bool = False) -> DataFrame:
    """Per document, from the shards alone: doc_id, start, n_tokens, ids_crc32 and with ``ranks`` first_id, first_id_count.

    The last two, a document's first id and how often it holds that, come from
    ranks in the planes and not from the decoded ids. A document's start adds what all earlier parts hold to its start in its
    own part. That sum runs over one row a part, never over documents.
    """
    parts = shards.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    docs = shards.select("part", "part_start", "payload").mapInArrow(_documents, DOC_SCHEMA)
    return docs.join(common.maybe_broadcast(base), "part").select("doc_id", (F.col("base") + F.col("part_start")).alias("start"), "n_tokens", "ids_crc32", *(["first_id", "first_id_count"] if ranks else []))


def op3_wavelet_shards(spark, sf_dir: str) -> DataFrame:
    """All ``documents`` through shards in the shared folder and back, decoded and asked for ranks."""
    path = common.scratch_path(spark, "op3-shards")
    write_shards(common.table(spark, sf_dir, "documents"), path)
    return document_digests(read_shards(spark, path), ranks=True)
