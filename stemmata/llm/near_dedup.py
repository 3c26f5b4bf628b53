"""Near-dedup by BagMinHash: weighted Jaccard of five-word shingle multisets, 0.8 or more.

Signature: a shingle of weight w (its count) is a Poisson process of points (time, register, level) over the weight
axis [0, w), discretised at whole levels. The axis is cut into dyadic intervals [0, 1), [1, 2), [2, 4), [4, 8) and so on;
an interval's points are drawn in the order of time up to the text's limit and kept if their level lies below w, so a
shingle costs what its points cost, not its weight. Register r keeps the least time of its points: two texts share a register with probability equal to their weighted Jaccard similarity. The time limit starts where all
REGISTERS registers are filled almost surely and doubles for texts where one is not.

Classes first: texts with equal shingle multisets are one class, whatever their number; only a class's least document
goes on. Then each of BANDS bands of 4 registers deals the representatives into buckets:

1. star: each representative against the least of each bucket, exactly verified, one candidate each round (its least
   open one first); the links give components, and pairs within a component need no verifying;
2. rest: buckets that still hold two components or more, equal member sets once, are compared within tasks: registers
   in blocks first, then exactly, joining components as links are found. Buckets over BLOCK members are dealt as pairs
   of blocks, so no task holds more than two blocks.

A pair at similarity 0.8 shares no band with probability below 1e-7. Pairs are verified on 64-bit shingle hashes.

Defined results: a text with one to four words has one shingle of all its words; null, empty and word-free texts are one
class (they have no shingle and match nothing else); a class's id is its least doc_id, null ids last; repeated rows each
get a row; an empty table gives no row; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BASES, LAST, batches, grams, hash_words, mix, with_text_key, words_of, written

SHINGLE = 5
THRESHOLD = 0.8
REGISTERS, BANDS = 128, 32
BLOCK = 1024
#: Registers must agree on this share at least before a pair is verified: six deviations below 0.8.
SCREEN = 0.58
ROUNDS = 3
PREPARED = "dk long, tk long, hi long, lo long, n int, sig binary"
_STEP = 0x9E3779B97F4A7C15
_GOLD = np.uint64(_STEP)


def _unit(h: np.ndarray) -> np.ndarray:
    """A number in (0, 1) from a hash."""
    return ((h >> np.uint64(11)).astype(np.float64) + 0.5) / 2.0**53


def shingles(texts: list[str | None], k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of all texts end to end, and their number in each text."""
    words = [words_of(t) for t in texts]
    n = np.array([len(w) for w in words], np.int64)
    h = np.concatenate([hash_words(w) for w in words]) if words else np.zeros(0, np.uint64)
    full = mix(grams(h, k, BASES[0]))
    ends = np.cumsum(n)
    out, sizes = [], np.where(n >= k, n - k + 1, np.minimum(n, 1))
    for a, z, m in zip(ends - n, ends, n, strict=True):
        if m >= k:
            out.append(full[a : z - k + 1])
        elif m:
            out.append(mix(grams(h[a:z], int(m), BASES[0]) + np.uint64(m)))
    return (np.concatenate(out) if out else np.zeros(0, np.uint64)), sizes


def _points(keys: np.ndarray, owner: np.ndarray, width: np.ndarray, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Times, registers and texts of the points in the dyadic interval of each key, up to its text's limit. Points come
    at rate `width` (the interval's length), each with a register and a place on the interval."""
    times, hashes, owners, keys_at = [], [], [], []
    at, state = np.zeros(len(keys)), keys.copy()
    alive = np.arange(len(keys))
    while len(alive):
        state = mix(state + _GOLD)
        at = at - np.log(_unit(state)) / width[alive]
        good = at <= limit[owner[alive]]
        alive, at, state = alive[good], at[good], state[good]
        times.append(at)
        hashes.append(mix(state ^ BASES[1]))
        owners.append(owner[alive])
        keys_at.append(alive)
    if not times:
        return np.zeros(0), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(times), np.concatenate(hashes), np.concatenate(owners), np.concatenate(keys_at)


def signatures(keys: np.ndarray, weights: np.ndarray, owner: np.ndarray, texts: int, registers: int = REGISTERS) -> np.ndarray:
    """uint32 signatures of weighted sets. keys: different shingles; weights: their counts; owner: their text.

    Dyadic intervals of the weight axis are processes of their own. Those beyond a weight are never entered, and an
    interval's points are the same for every weight that reaches it."""
    total = np.bincount(owner, weights, texts)
    best = np.full((texts, registers), np.inf)
    mark = np.zeros((texts, registers), np.uint64)
    open_texts = total > 0
    limit = np.where(open_texts, (np.log(registers) + 4.0) / np.maximum(total, 1), 0.0) * registers
    while open_texts.any():
        use = open_texts[owner]
        k, w, o = keys[use], weights[use], owner[use]
        low, size = 0, 1
        while len(k):
            salt = np.uint64((low * 2 + 1) * _STEP % 2**64)
            t, h, who, which = _points(mix(k ^ salt), o, np.full(len(k), float(size)), limit)
            level = low + np.floor(_unit(mix(h + salt)) * size).astype(np.int64)
            inside = level < w[which]
            t, h, who = t[inside], h[inside], who[inside]
            cell = who * registers + (h % np.uint64(registers)).astype(np.int64)
            np.minimum.at(best.ravel(), cell, t)
            least = t == best.ravel()[cell]
            mark.ravel()[cell[least]] = h[least]
            low = low + size
            size = max(1, low)
            more = w > low
            k, w, o = k[more], w[more], o[more]
        open_texts = open_texts & ~(best <= limit[:, None]).all(1)
        limit = np.where(open_texts, limit * 2, limit)
    return (mix(mark) >> np.uint64(32)).astype(np.uint32)


def _prepare(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches(frames, 2_000_000):
        h, sizes = shingles(batch.column("text").to_pylist())
        n = len(sizes)
        owner = np.repeat(np.arange(n), sizes)
        order = np.lexsort((h, owner))
        h, owner = h[order], owner[order]
        new = np.append(True, (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])) if len(h) else np.zeros(0, bool)
        at = np.flatnonzero(new)
        weights = np.diff(np.append(at, len(h))).astype(np.float64)
        sig = signatures(h[at], weights, owner[at], n)
        ends = np.cumsum(sizes)
        # Sums over each text, wrapped at 64 bits: differences of running sums.
        sums = [np.append(np.uint64(0), np.cumsum(mix(x))) for x in (h, h ^ BASES[1])]
        hi, lo = (x[ends] - x[ends - sizes] for x in sums)
        hi = hi + sizes.astype(np.uint64)
        yield pa.RecordBatch.from_arrays([batch.column("dk"), batch.column("tk"), pa.array(hi.view(np.int64)), pa.array(lo.view(np.int64)), pa.array(sizes.astype(np.int32)), pa.array([s.tobytes() for s in sig], pa.binary())], names=["dk", "tk", "hi", "lo", "n", "sig"])


def _compressed(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts as they travel: a third of their bytes."""
    pack = zstandard.ZstdCompressor(level=1)
    for batch in batches(frames):
        z = [pack.compress((t or "").encode("utf-8", "surrogatepass")) for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("dk"), batch.column("tk"), pa.array(z, pa.binary())], names=["dk", "tk", "z"])


def _multiset(z: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Different shingles of a compressed text, sorted, and their counts."""
    return np.unique(shingles([zstandard.ZstdDecompressor().decompress(z).decode("utf-8", "surrogatepass")])[0], return_counts=True)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard of two multisets of shingles."""
    both, weights = np.concatenate([a[0], b[0]]), np.concatenate([a[1], b[1]])
    order = np.argsort(both, kind="stable")
    both, weights = both[order], weights[order]
    twice = np.flatnonzero(both[1:] == both[:-1])
    shared = int(np.minimum(weights[twice], weights[twice + 1]).sum())
    every = int(weights.sum())
    return shared / (every - shared) if every else 0.0


class Sets:
    """Union-find over small numbers of labels."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        while (y := self.up.get(x, x)) != x:
            self.up[x] = self.up.get(y, y)
            x = y
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True


def _bucket_links(rows: pd.DataFrame, threshold: float) -> pd.DataFrame:
    """Verified links between components that meet in a bucket (or a pair of blocks), joined as they are found."""
    sig = np.frombuffer(b"".join(rows["sig"]), np.uint32).reshape(len(rows), -1)
    ids, comps, texts = rows["id"].tolist(), rows["comp"].to_numpy(), rows["z"].tolist()
    sets_of: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    block = rows["block"].to_numpy()
    sets, out = Sets(), []
    two = block.min() != block.max()
    for i in range(len(rows)):
        later = np.arange(i + 1, len(rows))
        later = later[comps[later] != comps[i]]
        if two:
            later = later[block[later] != block[i]]
        if not len(later):
            continue
        agree = (sig[later] == sig[i]).mean(1)
        for j in later[np.argsort(-agree, kind="stable")][: int((agree >= SCREEN).sum())]:
            a, b = int(comps[i]), int(comps[j])
            if sets.root(a) == sets.root(b):
                continue
            for k in (i, int(j)):
                if k not in sets_of:
                    sets_of[k] = _multiset(texts[k])
            if similarity(sets_of[i], sets_of[int(j)]) >= threshold:
                sets.join(a, b)
                out.append((ids[i], ids[j]))
    return pd.DataFrame(out, columns=["a", "b"], dtype="int64")


def components(links: DataFrame, name: str) -> DataFrame:
    """id, comp (the least id that links reach) for all ids of links (a, b): repeated least labels with pointer jumping,
    where each round is written, so the plan stays short and lost executors cost no earlier round."""
    both = written(links.select("a", "b").union(links.select("b", "a")).distinct(), f"{name}-edges")
    labels = both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("comp"))
    labels = written(labels, f"{name}-labels")
    while True:
        seen = both.join(labels.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.min("comp").alias("near"))
        jump = labels.select(F.col("id").alias("comp"), F.col("comp").alias("far"))
        new = labels.join(seen, "id", "left").join(jump, "comp", "left").select("id", F.least("comp", "near", "far").alias("comp"), F.col("comp").alias("old"))
        new = written(new, f"{name}-round")
        if new.filter("comp < old").isEmpty():
            return new.select("id", "comp")
        labels = new.select("id", "comp")


def near_duplicates(documents: DataFrame, threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """doc_id, dk, tk, class_id (least doc_id of its component; null for documents without id), class_key, is_first
    (the one row of its class to keep) and joining_links for every row: the different verified links of the document's
    text class that the search met while it joined components; pairs of a component joined before are not verified, so
    near copies may be more."""
    docs = with_text_key(documents)
    prepared = written(docs.mapInArrow(_prepare, PREPARED), "near-prepared")
    same = prepared.groupBy("hi", "lo", "n").agg(F.min(F.struct("dk", "tk")).alias("at"))
    # A class goes by the document id of its first row, or by a hash where several classes have that id (or none).
    same = same.select("hi", "lo", "n", F.col("at.dk").alias("f_dk"), F.col("at.tk").alias("f_tk"))
    shared_ids = same.groupBy(F.col("f_dk").alias("s_dk")).agg(F.count("*").alias("s_n")).filter("s_n > 1")
    named = same.join(shared_ids, F.col("f_dk") == F.col("s_dk"), "left").withColumn("id", F.when(F.col("s_n").isNull(), F.col("f_dk")).otherwise(F.xxhash64("f_dk", "f_tk"))).drop("s_dk", "s_n")
    named = written(named, "near-classes")
    rep_keys = named.filter("n > 0").select("f_dk", "f_tk", "id")
    reps = prepared.join(rep_keys, (F.col("dk") == F.col("f_dk")) & (F.col("tk") == F.col("f_tk"))).select("id", "sig").groupBy("id").agg(F.first("sig").alias("sig"))
    reps = written(reps, "near-reps")

    def banded(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wide = REGISTERS // BANDS
        for batch in frames:
            sig = np.frombuffer(b"".join(x.as_buffer().to_pybytes() for x in batch.column("sig")), np.uint32).reshape(batch.num_rows, BANDS, wide).astype(np.uint64)
            h = np.zeros(sig.shape[:2], np.uint64)
            for j in range(wide):
                h = mix(h * BASES[0] + sig[:, :, j] + np.uint64(1))
            h = mix(h + np.arange(BANDS, dtype=np.uint64) * BASES[1])
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column("id").to_numpy(), BANDS)), pa.array(h.view(np.int64).ravel())], names=["id", "bucket"])

    members = reps.mapInArrow(banded, "id long, bucket long")
    buckets = members.groupBy("bucket").agg(F.min("id").alias("least"), F.count("*").alias("size")).filter("size > 1")
    in_buckets = written(members.join(buckets, "bucket").select("bucket", "id", "least", "size"), "near-buckets")

    # Texts of the representatives that share a bucket, once.
    wanted = in_buckets.select("id").distinct().join(reps, "id").join(rep_keys, "id")
    texts = docs.mapInArrow(_compressed, "dk long, tk long, z binary").join(wanted, (F.col("dk") == F.col("f_dk")) & (F.col("tk") == F.col("f_tk")))
    texts = written(texts.select("id", "sig", "z").groupBy("id").agg(F.first("sig").alias("sig"), F.first("z").alias("z")), "near-texts")

    def verified(pairs: DataFrame) -> DataFrame:
        """Of pairs (a, b) those with a similarity of `threshold` or more."""
        left = texts.select(F.col("id").alias("a"), F.col("sig").alias("a_sig"), F.col("z").alias("a_z"))
        right = texts.select(F.col("id").alias("b"), F.col("sig").alias("b_sig"), F.col("z").alias("b_z"))

        def check(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in frames:
                good = []
                for x, y, s, t in zip(*(batch.column(c).to_pylist() for c in ("a_sig", "b_sig", "a_z", "b_z")), strict=True):
                    near = (np.frombuffer(x, np.uint32) == np.frombuffer(y, np.uint32)).mean() >= SCREEN
                    good.append(bool(near) and similarity(_multiset(s), _multiset(t)) >= threshold)
                yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

        return pairs.join(left, "a").join(right, "b").select("a", "b", "a_sig", "b_sig", "a_z", "b_z").mapInArrow(check, "a long, b long")

    star = written(in_buckets.filter("id <> least").select(F.col("id").alias("a"), F.col("least").alias("b")).distinct(), "near-star")
    links = written(verified(star.groupBy("a").agg(F.min("b").alias("b"))), "near-links")
    comp = components(links, "near")
    labelled = lambda rows, column: rows.join(comp.select(F.col("id").alias(column), F.col("comp").alias(f"{column}_comp")), column, "left").withColumn(f"{column}_comp", F.coalesce(f"{column}_comp", column))
    for _ in range(ROUNDS):
        apart = labelled(labelled(star, "a"), "b").filter("a_comp <> b_comp").groupBy("a_comp", "b_comp").agg(F.min(F.struct("a", "b")).alias("pair")).select("pair.a", "pair.b")
        more = written(verified(apart), "near-links")
        if more.isEmpty():
            break
        links = links.unionByName(more)
        comp = components(links, "near")

    open_rows = labelled(in_buckets, "id").withColumnRenamed("id_comp", "comp")
    shape = open_rows.groupBy("bucket").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.bit_xor(F.xxhash64("id")).alias("who"), F.max("size").alias("size")).filter("low <> high")
    once = shape.groupBy("who", "size").agg(F.min("bucket").alias("bucket"))
    rest = open_rows.drop("size", "least").join(once, "bucket").withColumn("blocks", F.ceil(F.col("size") / block).cast("int")).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    # Block i meets every block j: as the first of (i, j) where i <= j, else as the second.
    rest = rest.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("x", F.least("block", "other")).withColumn("y", F.greatest("block", "other"))
    found = rest.join(texts, "id").groupBy("bucket", "x", "y").applyInPandas(lambda rows: _bucket_links(rows, threshold), "a long, b long")
    links = links.unionByName(written(found, "near-links"))
    comp = components(links, "near")

    links = links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    degree = links.select("a").union(links.select(F.col("b").alias("a"))).groupBy(F.col("a").alias("d_id")).agg(F.count("*").alias("joining_links"))
    classes = named.join(comp.withColumnRenamed("id", "c_id"), F.col("id") == F.col("c_id"), "left").withColumn("comp", F.coalesce("comp", "id")).drop("c_id")
    heads = classes.groupBy(F.col("comp").alias("h_comp")).agg(F.min(F.struct("f_dk", "f_tk")).alias("head"))
    classes = classes.join(heads, F.col("comp") == F.col("h_comp")).join(degree, F.col("id") == F.col("d_id"), "left")
    classes = written(classes.select("hi", "lo", "n", F.col("head.f_dk").alias("head_dk"), F.col("head.f_tk").alias("head_tk"), F.coalesce("joining_links", F.lit(0)).alias("joining_links")), "near-result")
    out = prepared.select("dk", "tk", "hi", "lo", "n").join(classes, ["hi", "lo", "n"])
    null = F.lit(None).cast("long")
    return out.select(
        F.when(F.col("dk") != LAST, F.col("dk")).otherwise(null).alias("doc_id"), "dk", "tk",
        F.when(F.col("head_dk") != LAST, F.col("head_dk")).otherwise(null).alias("class_id"),
        F.xxhash64("head_dk", "head_tk").alias("class_key"),
        ((F.col("dk") == F.col("head_dk")) & (F.col("tk") == F.col("head_tk"))).alias("is_first"), "joining_links",
    )
