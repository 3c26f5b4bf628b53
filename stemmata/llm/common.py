"""Shared pieces: shared-folder tables, words, window hashes, anchors, partition offsets."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Stands for a null document id: null ids come last.
LAST = 2**63 - 1
MIX1 = np.uint64(0xBF58476D1CE4E5B9)
MIX2 = np.uint64(0x94D049BB133111EB)
BASES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a local one, but only if driver
    and executors are one process."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return (at or "file:///tmp/checkpoints").rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/stemmata/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def deleted(spark: SparkSession, path: str) -> None:
    """Deletes a table of the shared folder that nothing reads any more."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def with_text_key(docs: DataFrame) -> DataFrame:
    """doc_id (long), text, dk (doc_id, or LAST for null) and tk, a hash of the text that tells rows of one doc_id
    apart. dk and tk are never null. Other columns go."""
    doc_id, text = F.col("doc_id").cast("long"), F.col("text").cast("string")
    return docs.select(doc_id.alias("doc_id"), text.alias("text"), F.coalesce(doc_id, F.lit(LAST)).alias("dk"), F.xxhash64(text).alias("tk"))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, so that any bits of the result can serve as an index."""
    x = x ^ (x >> np.uint64(30))
    x = x * MIX1
    x ^= x >> np.uint64(27)
    x *= MIX2
    x ^= x >> np.uint64(31)
    return x


class WordHashes(dict):
    """word (bytes) -> 64-bit hash; emptied when it has too many words, so memory is bounded."""

    LIMIT = 150_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


WORD_HASHES = WordHashes()


def words_of(text: str | None) -> list[bytes]:
    """The words `[^\\x20\\x09-\\x0D]+`: bytes.split() parts at exactly these six bytes."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def hash_words(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(WORD_HASHES.__getitem__, words), np.uint64, len(words))


def grams(a: np.ndarray, k: int, base: np.uint64) -> np.ndarray:
    """Polynomial hashes of all k consecutive items, by doubling; len(a) - k + 1 of them."""
    n = len(a) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out, done, run, width, power = np.zeros(n, np.uint64), 0, a, 1, int(base)
    while width <= k:
        if k & width:
            out = out * np.uint64(power) + run[done : done + n]
            done += width
        if width * 2 <= k:
            run = run[:-width] * np.uint64(power) + run[width:]
        power = power * power % 2**64
        width *= 2
    return out


def sliding_min(a: np.ndarray, w: int) -> np.ndarray:
    """out[i] = min(a[i:i+w]); len(a) - w + 1 of them."""
    n = len(a) - w + 1
    if n <= 0:
        return a[:0]
    width = 1
    while width * 2 <= w:
        a = np.minimum(a[:-width], a[width:])
        width *= 2
    rest = w - width
    return np.minimum(a[:n], a[rest : rest + n]) if rest else a[:n]


def pieces(lengths: list[int], limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose lengths sum to about limit; a longer row stands alone."""
    start, total = 0, 0
    for i, n in enumerate(lengths):
        if i > start and total + n > limit:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(lengths):
        yield start, len(lengths)


def batches(frames: Iterator[pa.RecordBatch], limit: int = 4_000_000, column: str = "text") -> Iterator[pa.RecordBatch]:
    """Arrow batches cut to about `limit` bytes of text, for bounded memory."""
    for batch in frames:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
        for a, b in pieces(sizes, limit):
            yield batch.slice(a, b - a)


def sizes(docs: DataFrame) -> tuple[int, int]:
    """Characters and rows."""
    chars, rows = docs.agg(F.sum(F.length("text")), F.count("*")).first()
    return int(chars or 0), rows


def with_offsets(rows: DataFrame, part: str, amount: str) -> DataFrame:
    """Second pass of a prefix sum: adds `before`, the sum of `amount` over all partitions before the row's, in the order
    of their names. Only one row a partition is ordered in one task; written, so that Catalyst knows their size and
    broadcasts them if they are few, before the other side would be dealt."""
    ahead = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy(part).agg(F.sum(amount).alias("n")).select(F.col(part).alias("o_part"), F.coalesce(F.sum("n").over(ahead), F.lit(0)).cast("long").alias("before"))
    return rows.join(written(sums, "offsets"), F.col(part) == F.col("o_part")).drop("o_part")
