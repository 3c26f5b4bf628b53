"""Token-id files: a concatenated id array with Elias-Fano encoded document boundaries.

Documents are dealt into ranges of ids and sorted; each range writes shards of about SHARD_IDS ids. A shard:

    4 bytes  "EFT1"
    8 x 8    documents, ids, bytes of an id (2 or 4), low bits, high words, select samples (of the boundaries), place of
             the first id in its range, 0                                     (little-endian unsigned)
    ...      boundaries: low bits, high bits and select samples
    ...      document ids: numbers without null, least id, low bits, high words, select samples (5 x 8), then as above
    ...      ids

Both lists are Elias-Fano coded: low bits packed and padded to 8 bytes; high bits in unary, 64-bit words; the bit place of
every 64th set bit, 4 bytes each, padded to 8. Boundaries are n + 1 growing sums; with l = floor(log2(ids / (n + 1))) low
bits each and the rest in unary they take about 2 + log2(ids / n) bits a document. boundary(i) is select(i) on the high
bits: a sample, then popcounts. Document ids ascend and are coded as distances from the least; null ids come last and are
only counted.
Shards are rows of a table in the shared folder, so Spark's committer makes a retried task's file count once, on any
store. Documents never span shards. Ranges are cut by (id, text hash), so neither null nor equal ids make a large one; at
most MAX_RANGES bounds reach the driver. The offsets before each range are joined to its shards.

Defined results: null and empty texts have only the end id; null ids come last; ties in id are ordered by text hash;
repeated rows are each written; an empty table gives no shard and no row.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, with_offsets, with_text_key, written
from .tokens import encoder

SHARD_IDS = 131_072
#: Characters of text for each range of ids.
RANGE_CHARS = 16_000_000
MAX_RANGES = 20_000
MAGIC = b"EFT1"
SAMPLE = 64
SHARDS = "part int, shard int, n_docs long, n_ids long, data binary"


def _padded(data: bytes) -> bytes:
    return data + bytes(-len(data) % 8)


class Boundaries:
    """Elias-Fano coded growing numbers, with select."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray) -> None:
        self.n, self.low_bits, self.low, self.high, self.samples = n, low_bits, low, high, samples

    @classmethod
    def of(cls, values: np.ndarray) -> Boundaries:
        n, top = len(values), int(values[-1]) if len(values) else 0
        low_bits = max(0, (top // max(1, n)).bit_length() - 1)
        values = values.astype(np.uint64)
        low = np.zeros(0, np.uint8)
        if low_bits:
            bits = (values[:, None] >> np.arange(low_bits, dtype=np.uint64)) & np.uint64(1)
            low = np.packbits(bits.astype(np.uint8).ravel(), bitorder="little")
        at = (values >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        size = -(-(int(at[-1]) + 1 if n else 0) // 64) * 64
        bits = np.zeros(size, np.uint8)
        bits[at] = 1
        return cls(n, low_bits, low, np.packbits(bits, bitorder="little").view(np.uint64), at[::SAMPLE].astype(np.uint32))

    def select(self, i: int) -> int:
        """Place of set bit i of the high bits."""
        place = int(self.samples[i // SAMPLE])
        left = i % SAMPLE
        word = place // 64
        now = int(self.high[word]) >> (place % 64) << (place % 64)
        while (c := now.bit_count()) <= left:
            left -= c
            word += 1
            now = int(self.high[word])
        for _ in range(left):
            now &= now - 1
        return word * 64 + (now & -now).bit_length() - 1

    def __getitem__(self, i: int) -> int:
        """The number at i alone, by select."""
        out = (self.select(i) - i) << self.low_bits
        if self.low_bits:
            first = i * self.low_bits
            a, z = first // 8, (first + self.low_bits + 7) // 8
            out |= (int.from_bytes(self.low[a:z].tobytes(), "little") >> (first % 8)) & ((1 << self.low_bits) - 1)
        return out

    def all(self) -> np.ndarray:
        """All numbers in one scan of the high bits."""
        at = np.flatnonzero(np.unpackbits(self.high.view(np.uint8), bitorder="little"))[: self.n]
        out = (at - np.arange(self.n)) << self.low_bits
        if self.low_bits:
            bits = np.unpackbits(self.low, bitorder="little", count=self.n * self.low_bits).reshape(self.n, self.low_bits)
            out |= bits.astype(np.int64) @ (np.int64(1) << np.arange(self.low_bits))
        return out


    def coded(self) -> bytes:
        return b"".join([_padded(self.low.tobytes()), self.high.tobytes(), _padded(self.samples.tobytes())])

    @classmethod
    def decoded(cls, data: bytes, at: int, n: int, low_bits: int, words: int, samples: int) -> tuple[Boundaries, int]:
        """What coded() wrote at a place, and the place after it."""
        n_low = -(-n * low_bits // 8)
        low = np.frombuffer(data, np.uint8, n_low, at)
        at += n_low + -n_low % 8
        high = np.frombuffer(data, "<u8", words, at)
        at += 8 * words
        marks = np.frombuffer(data, "<u4", samples, at)
        return cls(n, low_bits, low, high, marks), at + 4 * samples + -4 * samples % 8


def encode_shard(doc_ids: list[int | None], ids: list[np.ndarray], before: int, id_bytes: int = 2) -> bytes:
    b = Boundaries.of(np.append(0, np.cumsum([len(x) for x in ids])))
    total = sum(map(len, ids))
    known = [d for d in doc_ids if d is not None]
    least = known[0] if known else 0
    names = Boundaries.of(np.array([d - least for d in known], np.uint64))
    head = np.array([len(ids), total, id_bytes, b.low_bits, len(b.high), len(b.samples), before, 0], np.uint64)
    name_head = np.array([len(known), least % 2**64, names.low_bits, len(names.high), len(names.samples)], np.uint64)
    body = np.concatenate(ids).astype(f"<u{id_bytes}") if ids else np.zeros(0, np.uint16)
    return b"".join([MAGIC, head.tobytes(), b.coded(), name_head.tobytes(), names.coded(), body.tobytes()])


class Shard:
    """A shard read back: document ids, boundaries and ids."""

    def __init__(self, data: bytes) -> None:
        if data[:4] != MAGIC:
            raise ValueError("not a token file")
        self.n, total, id_bytes, low_bits, words, samples, self.before, _ = (int(x) for x in np.frombuffer(data, "<u8", 8, 4))
        self.boundaries, at = Boundaries.decoded(data, 68, self.n + 1, low_bits, words, samples)
        self.known, self.least, low_bits, words, samples = (int(x) for x in np.frombuffer(data, "<u8", 5, at))
        self.names, at = Boundaries.decoded(data, at + 40, self.known, low_bits, words, samples)
        self.ids = np.frombuffer(data, f"<u{id_bytes}", total, at)

    def doc_id(self, i: int) -> int | None:
        """The id of document i, by select; null ids come last."""
        if i >= self.known:
            return None
        return (self.names[i] + self.least + 2**63) % 2**64 - 2**63

    def document(self, i: int) -> np.ndarray:
        """The ids of document i of this shard, by two selects."""
        return self.ids[self.boundaries[i] : self.boundaries[i + 1]]


def write_tokens(documents: DataFrame, path: str, end_id: int, shard_ids: int = SHARD_IDS) -> DataFrame:
    """Encodes, sorts by doc_id and writes the shards; returns the table of shards."""
    docs = with_text_key(documents)

    # One pass over the texts for what the ranges need.
    keys = written(docs.select("dk", "tk", F.length("text").alias("chars")), "token-keys")
    chars = int(keys.agg(F.sum("chars")).first()[0] or 0)
    n = min(MAX_RANGES, max(1, chars // RANGE_CHARS))
    bounds: list[tuple[int, int]] = []
    if n > 1:
        ranges = keys.select("dk", "tk").repartitionByRange(n, "dk", "tk").groupBy(F.spark_partition_id().alias("part")).agg(F.min(F.struct("dk", "tk")).alias("low"))
        bounds = sorted((r.low.dk, r.low.tk) for r in ranges.collect())[1:]

    def encoded(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end = encoder(path), np.array([end_id], np.uint16)
        for batch in batches(frames):
            ids = [np.append(x, end).tobytes() for x in enc.ids(batch.column("text").to_pylist())]
            part = np.array([bisect_right(bounds, key) for key in zip(batch.column("dk").to_pylist(), batch.column("tk").to_pylist(), strict=True)], np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("dk"), batch.column("tk"), pa.array(part), pa.array(ids, pa.binary())], names=["doc_id", "dk", "tk", "part", "ids"])

    def shards(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, shard, before, names, held, size = -1, 0, 0, [], [], 0

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([shard], pa.int32()), pa.array([len(names)], pa.int64()), pa.array([size], pa.int64()), pa.array([encode_shard(names, held, before)], pa.binary())], names=["part", "shard", "n_docs", "n_ids", "data"])

        for batch in frames:
            for doc, p, blob in zip(batch.column("doc_id").to_pylist(), batch.column("part").to_pylist(), batch.column("ids"), strict=True):
                ids = np.frombuffer(blob.as_buffer(), np.uint16)
                if held and (p != part or size + len(ids) > shard_ids):
                    yield out()
                    before, shard, names, held, size = before + size, shard + 1, [], [], 0
                if p != part:
                    part, shard, before = p, 0, 0
                names.append(doc)
                held.append(ids.copy())
                size += len(ids)
        if held:
            yield out()

    # Encoding comes before the exchange: half the bytes of the text travel. The range bounds come from the ids alone.
    ids = docs.mapInArrow(encoded, "doc_id long, dk long, tk long, part int, ids binary")
    return written(ids.repartition("part").sortWithinPartitions("part", "dk", "tk").mapInArrow(shards, SHARDS), "token-files")


def read_tokens(files: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 and shard place for every document of the files."""

    def read(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in frames:
            for part, number, before, data in zip(batch.column("part").to_pylist(), batch.column("shard").to_pylist(), batch.column("before").to_pylist(), batch.column("data"), strict=True):
                shard = Shard(data.as_buffer().to_pybytes())
                n, base = shard.n, before + shard.before
                bounds = [shard.boundaries[i] for i in range(n + 1)]
                crc = [zlib.crc32(shard.ids[x:y].astype("<u4").tobytes()) for x, y in zip(bounds, bounds[1:], strict=False)]
                starts = np.array(bounds, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([shard.doc_id(i) for i in range(n)], pa.int64()), pa.array(starts[:-1] + base), pa.array(np.diff(starts)), pa.array(crc, pa.int64()), pa.array([part] * n, pa.int32()), pa.array([number] * n, pa.int32())], names=["doc_id", "start", "n_tokens", "ids_crc32", "part", "shard"])

    return with_offsets(files, "part", "n_ids").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long, part int, shard int")
