"""Packing: concatenate and cut. All documents' ids form one stream, cut into sequences of a fixed length.

Pass 1 encodes each document once, keeps a running total within each split of an input file (or each partition, where
the input isn't read from files) and writes ids, split and local offset to the shared folder. The prefix sums of one total
a split, by file name and place in the file, are the splits' global offsets, so the stream follows the input's order, such
as that of training positions; they are joined to the stream. Pass 2 cuts each document at multiples of the length: a piece is
a boundary record of document, place in the document, sequence and place in the sequence. No rows are exchanged. Only
the last sequence is short: it is padded to the length unless its size is a power of two.

Defined results: a null text is empty and has only its end id; repeated rows are each packed; an empty table gives no
piece; an empty document with the end id has one piece of length 1; null ids are allowed.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, with_offsets, with_text_key, written
from .tokens import encoder

LENGTH = 2048
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, padded_length long, ids binary"


def pack(documents: DataFrame, path: str, end_id: int, length: int = LENGTH, with_ids: bool = True) -> DataFrame:
    """Pieces of the stream. ids: little-endian unsigned 32-bit."""
    docs = with_text_key(documents).select("doc_id", "text", F.concat_ws(":", F.input_file_name(), F.lpad(F.input_file_block_start().cast("string"), 20, "0"), F.lpad(F.spark_partition_id().cast("string"), 10, "0")).alias("split"))

    def encoded(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end, totals = encoder(path), np.array([end_id], np.uint16), {}
        for batch in batches(frames):
            ids = [np.append(x, end) for x in enc.ids(batch.column("text").to_pylist())]
            starts = []
            for split, x in zip(batch.column("split").to_pylist(), ids, strict=True):
                starts.append(totals.get(split, 0))
                totals[split] = starts[-1] + len(x)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("split"), pa.array(starts, pa.int64()), pa.array([len(x) for x in ids], pa.int64()), pa.array([x.tobytes() for x in ids], pa.binary())], names=["doc_id", "split", "local", "n", "ids"])

    stream = written(docs.mapInArrow(encoded, "doc_id long, split string, local long, n long, ids binary"), "packing")
    total = int(stream.agg(F.sum("n")).first()[0] or 0)
    tail = total % length
    last = total // length if tail else -1
    last_padded = tail if tail & (tail - 1) == 0 else length

    def cut(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(frames, 2_000_000, "ids"):
            rows: list[tuple] = []
            for doc, before, local, blob in zip(batch.column("doc_id").to_pylist(), batch.column("before").to_pylist(), batch.column("local").to_pylist(), batch.column("ids"), strict=True):
                ids = np.frombuffer(blob.as_buffer(), np.uint16).astype("<u4")
                begin, n = before + local, len(ids)
                a = 0
                while a < n:
                    sequence, offset = divmod(begin + a, length)
                    z = min(n, a + length - offset)
                    piece = ids[a:z].tobytes()
                    rows.append((doc, a, z - a, zlib.crc32(piece), n, sequence, offset, last_padded if sequence == last else length, piece if with_ids else None))
                    a = z
            cols = list(zip(*rows, strict=True)) or [()] * 9
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols[:8]), pa.array(cols[8], pa.binary())], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "padded_length", "ids"])

    placed = with_offsets(stream, "split", "n").select("doc_id", "before", "local", "ids")
    return placed.mapInArrow(cut, PIECES)
