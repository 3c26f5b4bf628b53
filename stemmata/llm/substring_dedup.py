"""Substring dedup: removes words of 50-word windows that start in a document with a smaller id.

Pass 1 sketches every partition's window anchors (sketch.py) and merges the sketches; the merged counts never
underestimate. Pass 2 re-reads the documents, keeps the windows whose anchor is estimated repeated and groups
exactly these by 128-bit hashes. Windows travel in runs that share an anchor, so one row stands for about 16
windows. Within a map task, equal runs keep only the one of the least document for the exchange: the others are
decided there. A bucket therefore gets at most one row of each run from each task; anchors estimated heavy are
dealt by window instead, so that no passage sends unbounded rows to one task.

Defined results: a null or empty text has no words and is returned with zero counts; a text with fewer than 50
words has no window; a null doc_id counts as larger than all others, and two null or equal ids are not smaller
than each other, so neither removes from the other; repeated rows are each returned once per row; other columns
are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import sketch
from .common import BASES, batches, grams, hash_words, mix, sizes, with_text_key, words_of

WINDOW = 50
GRAM = 20
LONGEST_RUN = 64
#: Anchors estimated to occur this often are dealt by window.
HEAVY = 20_000
RUNS = "bucket long, doc long, tk long, start int, n int, hashes binary, done boolean"


def _laid_out(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Word hashes of a batch end to end, the end of each word's document, words per document."""
    words = [words_of(t) for t in batch.column("text").to_pylist()]
    lengths = [len(w) for w in words]
    h = np.concatenate([hash_words(w) for w in words]) if words else np.zeros(0, np.uint64)
    return h, np.repeat(np.cumsum(lengths), lengths), lengths


def _anchor_runs(h: np.ndarray, ends: np.ndarray, window: int, gram: int):
    whole, least = sketch.anchors(mix(grams(h, gram, BASES[0])), ends, gram, window)
    starts, stops = sketch.runs(whole, least, LONGEST_RUN)
    return starts, stops, least[starts]


def _keys(window: int, gram: int):
    def keys(frames: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        for batch in batches(frames):
            h, ends, _ = _laid_out(batch)
            starts, _, least = _anchor_runs(h, ends, window, gram)
            if len(starts):
                yield least

    return keys


def _rows(held: list[tuple], names: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "boolean": pa.bool_()}
    fields = [f.strip().split() for f in names.split(",")]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(zip(*held, strict=True), fields, strict=True)], names=[f[0] for f in fields])


def _candidates(shared, window: int, gram: int, buckets: int):
    """The runs of one partition; at its end all but the least document's of equal runs are done."""

    def emit(least_runs: dict) -> Iterator[pa.RecordBatch]:
        out = []
        for row in least_runs.values():
            out.append(row)
            if len(out) == 5000:
                yield _rows(out, RUNS)
                out = []
        if out:
            yield _rows(out, RUNS)

    def found(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, least_runs, over = shared.value, {}, []
        for batch in batches(frames):
            h, ends, lengths = _laid_out(batch)
            starts, stops, least = _anchor_runs(h, ends, window, gram)
            if not len(starts):
                continue
            good = counts.repeated(least)
            starts, stops, least = starts[good], stops[good], least[good]
            if not len(starts):
                continue
            heavy = counts.heavy(least)
            if heavy.any():
                sizes = np.where(heavy, stops - starts, 1)
                nth = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                each = np.repeat(heavy, sizes)
                starts, ends_of, least = np.repeat(starts, sizes) + nth * each, np.repeat(stops, sizes), np.repeat(least, sizes)
                stops = np.where(each, starts + 1, ends_of)
                heavy = each
            full = np.stack([mix(grams(h, window, b)) for b in BASES], 1)
            bucket = np.where(heavy, mix(full[starts, 0]), least) % np.uint64(buckets)
            first = np.cumsum(lengths) - lengths
            row = np.searchsorted(np.cumsum(lengths), starts, side="right")
            ids, tks = batch.column("dk").to_pylist(), batch.column("tk").to_pylist()
            for b, r, s, e in zip(bucket.tolist(), row.tolist(), starts.tolist(), stops.tolist(), strict=True):
                hashes = full[s:e].tobytes()
                new = (b, ids[r], tks[r], s - int(first[r]), e - s, hashes, False)
                old = least_runs.get(hashes)
                if old is None:
                    least_runs[hashes] = new
                    continue
                a, z = (old, new) if old[1] <= new[1] else (new, old)
                least_runs[hashes] = a
                if a[1] != z[1]:
                    over.append((*z[:5], None, True))
                else:  # the same document id: neither is smaller, both wait for the others
                    over.append((*z[:6], False))
                if len(over) == 5000:
                    yield _rows(over, RUNS)
                    over = []
            if len(least_runs) > 150_000:
                yield from emit(least_runs)
                least_runs = {}
        if over:
            yield _rows(over, RUNS)
        yield from emit(least_runs)

    return found


def _removed(rows: pd.DataFrame) -> pd.DataFrame:
    """Of a bucket's runs, the bits of the windows that also start in a smaller document."""
    n = rows["n"].to_numpy(np.int64)
    hashes = np.frombuffer(b"".join(rows["hashes"]), np.uint64).reshape(-1, 2)
    docs = np.repeat(rows["doc"].to_numpy(np.int64), n)
    order = np.lexsort((docs, hashes[:, 1], hashes[:, 0]))
    same = np.append(False, (hashes[order[1:]] == hashes[order[:-1]]).all(1))
    group = np.cumsum(~same) - 1
    least = docs[order][np.flatnonzero(~same)]
    gone = np.zeros(len(docs), bool)
    gone[order] = least[group] < docs[order]
    at = np.append(0, np.cumsum(n))
    some = np.add.reduceat(gone, at[:-1]) > 0 if len(n) else np.zeros(0, bool)
    kept = rows[some]
    bits = [np.packbits(gone[a:b], bitorder="little").tobytes() for a, b in zip(at[:-1][some], at[1:][some], strict=True)]
    return pd.DataFrame({"doc": kept["doc"], "tk": kept["tk"], "start": kept["start"], "n": kept["n"], "bits": bits})


def _result(window: int):
    def result(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(frames):
            ids, n_words, n_removed, sums, kept_texts = [], [], [], [], []
            for doc, text, removed in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), batch.column("removed").to_pylist(), strict=True):
                words = words_of(text)
                kept = words
                if removed:
                    delta = np.zeros(len(words) + 1, np.int64)
                    for x in removed:
                        at = np.arange(x["n"]) if x["bits"] is None else np.flatnonzero(np.unpackbits(np.frombuffer(x["bits"], np.uint8), bitorder="little", count=x["n"]))
                        np.add.at(delta, at + x["start"], 1)
                        np.add.at(delta, at + x["start"] + window, -1)
                    kept = list(compress(words, (np.cumsum(delta)[:-1] == 0).tolist()))
                ids.append(doc)
                n_words.append(len(words))
                n_removed.append(len(words) - len(kept))
                joined = b" ".join(kept)
                sums.append(hashlib.sha256(joined).hexdigest())
                kept_texts.append(joined.decode("utf-8", "surrogatepass"))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(sums, pa.string()), pa.array(kept_texts, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"])

    return result


def remove_repeated_windows(documents: DataFrame, window: int = WINDOW, gram: int = GRAM, heavy: int = HEAVY, max_cells: int = sketch.MAX_CELLS) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, kept_text for every row."""
    docs = with_text_key(documents)
    chars, _ = sizes(docs)
    counts = sketch.build(docs, _keys(window, gram), chars // 6 * 2 // (window - gram + 2), heavy, max_cells)
    shared = docs.sparkSession.sparkContext.broadcast(counts)
    buckets = max(8, chars // 4_000_000)
    runs = docs.mapInArrow(_candidates(shared, window, gram, buckets), RUNS)

    def decide(key, rows: pd.DataFrame) -> pd.DataFrame:
        if key[0] < 0:
            return pd.DataFrame({"doc": rows["doc"], "tk": rows["tk"], "start": rows["start"], "n": rows["n"], "bits": [None] * len(rows)})
        return _removed(rows)

    bucket = F.when(F.col("done"), -1 - F.pmod(F.xxhash64("doc", "tk"), F.lit(buckets))).otherwise(F.col("bucket"))
    gone = runs.groupBy(bucket.alias("b")).applyInPandas(decide, "doc long, tk long, start int, n int, bits binary")
    by_doc = gone.groupBy(F.col("doc").alias("g_doc"), F.col("tk").alias("g_tk")).agg(F.collect_list(F.struct("start", "n", "bits")).alias("removed"))
    joined = docs.join(by_doc, (docs["dk"] == by_doc["g_doc"]) & (docs["tk"] == by_doc["g_tk"]), "left").select("doc_id", "text", "removed")
    return joined.mapInArrow(_result(window), "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string")
