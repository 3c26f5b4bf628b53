"""Quality rules: counted statistics, base rules, and an isolation forest on the statistics.

Each whole text gives the four counted rules and FEATURES, shares that hardly depend on length (an echo is a
word equal to the one before it). TREES trees are grown on
SUBSAMPLE rows each, drawn from the TREES * SUBSAMPLE documents of least id hash (this bound is the forest's only
sample). A document's score is 2 ** (-mean path length / expected length): near 1 where few random splits isolate it.
All documents are scored. The threshold comes from all labelled rows that pass the base rules, as counts by score in
BINS bins: among the scores at which at most ALLOWED of the rows labelled good would go, the one that parts them best
from those labelled bad. Without labels nothing goes by the forest.

Defined results: a null text has no words and fails the base rules; a document labelled twice takes its lower label;
labels of unknown documents count for nothing; repeated rows are each returned; an empty table gives no row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BASES, batches, grams, hash_words, mix, with_text_key, words_of, written

SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
FEATURES = ("symbols", "marks", "echoes", "capitals", "dup_lines")
REPEAT = 8
TREES, SUBSAMPLE, BINS, ALLOWED, SEED = 100, 256, 2000, 0.01, 7
STATS = "doc_id long, dk long, tk long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, " + ", ".join(f"f_{f} double" for f in FEATURES)

_DIGIT, _LETTER, _CAPITAL = np.zeros(256, np.int64), np.zeros(256, np.int64), np.zeros(256, np.int64)
_CAPITAL[65:91] = 1
_DIGIT[48:58] = 1
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = 1


def _stats(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches(frames):
        texts = [t or "" for t in batch.column("text").to_pylist()]
        words = [words_of(t) for t in texts]
        n = np.array([len(w) for w in words], np.int64)
        h = np.concatenate([hash_words(w) for w in words]) if words else np.zeros(0, np.uint64)
        own = np.repeat(np.arange(len(n), dtype=np.uint64), n)
        salt = mix(own + np.uint64(1))
        ends = np.repeat(np.cumsum(n), n)
        echo = np.flatnonzero((h[1:] == h[:-1]) & (own[1:] == own[:-1])) + 1
        echoes = np.bincount(own[echo].astype(np.int64), minlength=len(n))
        g = grams(h, REPEAT, BASES[0])
        repeats = np.zeros(len(n), np.int64)
        if len(g):
            at = np.flatnonzero(np.arange(len(g)) + REPEAT <= ends[: len(g)])
            twice = at[pd.Series(mix(g[at]) ^ salt[at]).duplicated(keep=False).to_numpy()]
            delta = np.zeros(len(h) + 1, np.int64)
            np.add.at(delta, twice, 1)
            np.add.at(delta, twice + REPEAT, -1)
            repeats = np.bincount(own[np.cumsum(delta)[:-1] > 0].astype(np.int64), minlength=len(n))
        chars = np.array([len(t) - sum(map(t.count, SPACES)) for t in texts], np.int64)
        symbols = np.array([sum(map(t.count, SYMBOLS)) for t in texts], np.int64)
        dup, lines_of = np.zeros(len(n), np.int64), np.zeros(len(n), np.int64)
        for i, t in enumerate(texts):
            lines = [x for x in t.split("\n") if x.strip(SPACES)] if t else []
            lines_of[i], dup[i] = len(lines), len(lines) - len(set(lines))
        raw = [t.encode("utf-8", "surrogatepass") for t in texts]
        data, sizes = np.frombuffer(b"".join(raw), np.uint8), np.array([len(x) for x in raw], np.int64)
        owner = np.repeat(np.arange(len(n)), sizes)
        digits = np.bincount(owner, _DIGIT[data], len(n))
        letters = np.bincount(owner, _LETTER[data], len(n))
        capitals = np.bincount(owner, _CAPITAL[data], len(n))
        spaces = np.array([len(t) for t in texts]) - chars
        # Added to the denominators: a lone repeated line or mark in a short text is nothing odd.
        features = [symbols / (n + 10), (sizes - letters - digits - spaces) / (sizes + 50), echoes / (n + 10), capitals / (sizes + 50), np.maximum(dup - 1, 0) / (lines_of + 5)]
        counts = [n, chars, symbols, dup, repeats]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("dk"), batch.column("tk"), *(pa.array(c.astype(np.int64)) for c in counts), *(pa.array(f.astype(np.float64)) for f in features)], names=[f.split()[0] for f in STATS.split(", ")])


def statistics(documents: DataFrame) -> DataFrame:
    """Counts, features and base_failed of every row."""
    stats = with_text_key(documents).mapInArrow(_stats, STATS)
    return stats.withColumn("base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))


def expected_path(n: float) -> float:
    """Mean path length of an unsuccessful search among n rows."""
    return 0.0 if n <= 1 else 1.0 if n == 2 else 2.0 * (np.log(n - 1) + 0.5772156649015329) - 2.0 * (n - 1) / n


class Forest:
    """Isolation trees as arrays: in node i, feature, threshold, left child (right is next), or a leaf's path length."""

    def __init__(self, rows: np.ndarray, trees: int = TREES, subsample: int = SUBSAMPLE, seed: int = SEED) -> None:
        rng = np.random.default_rng(seed)
        self.size = min(subsample, len(rows))
        self.depth = max(1, int(np.ceil(np.log2(max(2, self.size)))))
        self.trees = [self._grow(rows[rng.choice(len(rows), self.size, replace=False)], rng) for _ in range(trees)] if len(rows) else []

    def _grow(self, rows: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        feature, threshold, child, path = [0], [0.0], [-1], [0.0]
        todo = [(0, np.arange(len(rows)), 0)]
        while todo:
            node, own, depth = todo.pop()
            low, high = rows[own].min(0), rows[own].max(0)
            varied = np.flatnonzero(low < high)
            if depth >= self.depth or len(own) <= 1 or not len(varied):
                path[node] = depth + expected_path(len(own))
                continue
            f = int(rng.choice(varied))
            at = rng.uniform(low[f], high[f])
            feature[node], threshold[node], child[node] = f, at, len(feature)
            left = rows[own, f] <= at
            for part in (own[left], own[~left]):
                todo.append((len(feature), part, depth + 1))
                feature.append(0), threshold.append(0.0), child.append(-1), path.append(0.0)
        return np.array(feature), np.array(threshold), np.array(child), np.array(path)

    def scores(self, rows: np.ndarray) -> np.ndarray:
        if not self.trees:
            return np.zeros(len(rows))
        total, every = np.zeros(len(rows)), np.arange(len(rows))
        for feature, threshold, child, path in self.trees:
            node = np.zeros(len(rows), np.int64)
            for _ in range(self.depth):
                inner = child[node] >= 0
                node = np.where(inner, child[node] + (rows[every, feature[node]] > threshold[node]), node)
            total += path[node]
        return 2.0 ** (-total / len(self.trees) / max(expected_path(self.size), 1.0))


def _least_by_hash(rows: DataFrame, wanted: int) -> DataFrame:
    """The `wanted` rows of least id hash. A bound on the hash leaves about twice as many to be sorted; it grows until it
    leaves enough, as it must where rows repeat."""
    hashed = rows.withColumn("chance", F.pmod(F.xxhash64("dk", "tk"), F.lit(2**40)) / float(2**40))
    share = 2.0 * wanted / max(1, rows.count())
    while share < 1.0 and hashed.filter(F.col("chance") < share).count() < wanted:
        share *= 4.0
    return hashed.filter(F.col("chance") < share).orderBy("chance", "dk", "tk").limit(wanted)


def judge(documents: DataFrame, labels: DataFrame, allowed: float = ALLOWED, trees: int = TREES, subsample: int = SUBSAMPLE) -> DataFrame:
    """doc_id, n_words, the four counts, base_failed, score, threshold, kept for every row."""
    stats = written(statistics(documents), "quality")
    features = [f"f_{f}" for f in FEATURES]
    fit = _least_by_hash(stats.filter(~F.col("base_failed")), trees * subsample).select(*features).collect()
    shared = stats.sparkSession.sparkContext.broadcast(Forest(np.array([tuple(r) for r in fit], np.float64).reshape(-1, len(features)), trees, subsample))

    def scored(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in frames:
            rows = np.column_stack([batch.column(f).to_numpy() for f in features])
            kept = [c for c in batch.schema.names if c not in features]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(shared.value.scores(rows))], names=[*kept, "score"])

    columns = ", ".join([*(f"{c} {t}" for c, t in stats.dtypes if c not in features), "score double"])
    scores = stats.mapInArrow(scored, columns)
    good = labels.select(F.col("doc_id").cast("long").alias("l_doc"), F.col("quality").cast("int").alias("quality")).filter("l_doc IS NOT NULL AND quality IS NOT NULL").groupBy("l_doc").agg(F.min("quality").alias("quality"))
    bins = scores.filter(~F.col("base_failed")).join(good, F.col("doc_id") == F.col("l_doc")).groupBy(F.floor(F.col("score") * BINS).alias("bin")).agg(F.count_if(F.col("quality") >= 1), F.count_if(F.col("quality") < 1)).collect()
    threshold = _threshold({int(b): (good, bad) for b, good, bad in bins}, allowed)
    return scores.withColumn("threshold", F.lit(threshold)).withColumn("kept", ~F.col("base_failed") & (F.col("score") < threshold)).drop("dk", "tk")


def _threshold(bins: dict[int, tuple[int, int]], allowed: float) -> float:
    """Of the scores from which on at most a share `allowed` of the good rows lie, the one that parts bad rows from good
    best (Youden's index; the highest such). Over 1 without good rows."""
    all_good, all_bad = (sum(x[i] for x in bins.values()) for i in (0, 1))
    if not all_good:
        return 1.1
    best, at, good, bad = 0.0, BINS + 1, 0, 0
    for b in range(BINS, -1, -1):
        g, n = bins.get(b, (0, 0))
        good, bad = good + g, bad + n
        if good > allowed * all_good:
            break
        if all_bad and (index := bad / all_bad - good / all_good) > best:
            best, at = index, b
    return at / BINS if best > 0 else 1.1
