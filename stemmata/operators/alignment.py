"""Aligning the blocks of many pairs of documents at once.

pairs: cmp_id, a_doc_id, b_doc_id. Result: cmp_id, position, relation, a_indices, b_indices, similarity, move_distance, in
reading order. Exact anchors and fuzzy candidates are joins over all pairs: anchors on (cmp_id, text), candidates on
(cmp_id, gap), where a gap lies between two anchors that keep their order, so no block meets the whole other side. Only
what is left then (a comparison's block numbers, its scored pairs and the texts of unmatched blocks and their neighbours)
goes to a kernel for each comparison, since groups consume neighbours in order. A comparison may have any size: its lists are
linear in its blocks, and what meets all with all is dealt (scored, dealt_windows) or read as a stream (paired).
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable, Iterable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from ..functions import similarity as S
from ..functions.text import word_count
from ..functions.worddiff import DiffOptions
from ..plans.tables import written

SPAN = 4
#: Blocks of the first side, and of the other, that meet at once.
CHUNK, FACING = 256, 1024
#: Cells of a table of common lengths that one call holds.
CELLS = 4_000_000
#: Blocks of the one side times those of the other that no anchor holds: comparisons of more are scored all over the tasks
#: (_spread, dealt_windows). The choice is the same.
DEALT = 500_000
MARGIN = 0.15
ALIGNMENTS = "cmp_id string, position int, relation string, a_indices array<int>, b_indices array<int>, similarity double, move_distance int"


def sides(pairs: DataFrame, blocks: DataFrame, options: DiffOptions | None = None) -> DataFrame:
    """cmp_id, side, block_index, text, kind, starts_stanza, block_id of every block of every comparison."""
    if options and options.exclude_artifacts:
        blocks = blocks.filter("kind <> 'ARTIFACT'")
    columns = ["block_index", "text", "kind", "starts_stanza", "block_id"]
    each = pairs.select(F.col("cmp_id").cast("string").alias("cmp_id"), F.explode(F.array(F.struct(F.lit("a").alias("side"), F.col("a_doc_id").alias("of")), F.struct(F.lit("b").alias("side"), F.col("b_doc_id").alias("of")))).alias("x"))
    return each.select("cmp_id", "x.side", "x.of").join(blocks.select(F.col("doc_id").alias("of"), *columns), "of").select("cmp_id", "side", *columns)


def anchors(rows: DataFrame) -> DataFrame:
    """Blocks whose text stands once on either side: cmp_id, a_index, b_index. One aggregation, no join."""
    counted = rows.groupBy("cmp_id", "text").agg(
        F.count_if(F.col("side") == "a").alias("n_a"), F.count_if(F.col("side") == "b").alias("n_b"),
        F.max(F.when(F.col("side") == "a", F.col("block_index"))).alias("a_index"), F.max(F.when(F.col("side") == "b", F.col("block_index"))).alias("b_index"),
    )
    return counted.filter("n_a = 1 AND n_b = 1").select("cmp_id", "a_index", "b_index")


def longest_increasing(values: list[int]) -> list[int]:
    """Places of a longest strictly increasing subsequence."""
    ends: list[int] = []
    at: list[int] = []
    before: list[int] = []
    for i, v in enumerate(values):
        slot = bisect_left(ends, v)
        ends[slot : slot + 1] = [v]
        at[slot : slot + 1] = [i]
        before.append(at[slot - 1] if slot else -1)
    out, i = [], at[-1] if at else -1
    while i >= 0:
        out.append(i)
        i = before[i]
    return out[::-1]


def _each(rows: DataFrame, work: Callable[[dict], Iterable[tuple]], schema: str) -> DataFrame:
    """Rows that hold a whole group in arrays, to the tuples that `work` makes of each."""
    names = [x.split(" ")[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                columns = list(zip(*work(batch.slice(at, 1).to_pylist()[0]), strict=True))
                if columns:
                    ready.append(columns)
                if sum(len(c[0]) for c in ready) >= 10_000:
                    yield flushed()
            if ready:
                yield flushed()

    def flushed() -> pa.RecordBatch:
        joined = [pa.array([v for columns in ready for v in columns[k]], type=kinds[k]) for k in range(len(names))]
        ready.clear()
        return pa.RecordBatch.from_arrays(joined, names)

    ready: list[list[tuple]] = []
    kinds = [to_arrow_type(f.dataType) for f in StructType.fromDDL(schema).fields]
    return rows.mapInArrow(run, schema)


def boundaries(found: DataFrame) -> DataFrame:
    """The anchors with the mark `bound` (1 or null) of those that keep their order: cmp_id, a_index, b_index, bound."""

    def marked(row: dict) -> Iterable[tuple]:
        anchored = sorted((x["a_index"], x["b_index"]) for x in row["anchored"])
        kept = set(longest_increasing([b for _, b in anchored]))
        return [(row["cmp_id"], a, b, 1 if i in kept else None) for i, (a, b) in enumerate(anchored)]

    rows = found.groupBy("cmp_id").agg(F.collect_list(F.struct("a_index", "b_index")).alias("anchored"))
    return _each(rows, marked, "cmp_id string, a_index int, b_index int, bound int")


def gaps(rows: DataFrame, found: DataFrame) -> DataFrame:
    """Blocks that no anchor holds, with the number of their gap: boundaries before them on their side."""
    sided = F.explode(F.array(F.struct(F.lit("a").alias("side"), F.col("a_index").alias("i")), F.struct(F.lit("b").alias("side"), F.col("b_index").alias("i")))).alias("x")
    held = boundaries(found).select("cmp_id", "bound", sided).select("cmp_id", "x.side", F.col("x.i").alias("block_index"), "bound", F.lit(1).alias("anchored"))
    marked = rows.join(held, ["cmp_id", "side", "block_index"], "left")
    before = Window.partitionBy("cmp_id", "side").orderBy("block_index").rowsBetween(Window.unboundedPreceding, -1)
    return marked.withColumn("gap", F.coalesce(F.count("bound").over(before), F.lit(0))).filter("anchored IS NULL").drop("anchored", "bound")


def _spread(met: DataFrame) -> DataFrame:
    """Rows of large comparisons over all tasks, of which each takes a while, however few bytes they have."""
    return met.repartition(int(met.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def _met_gaps(open_blocks: DataFrame) -> DataFrame:
    """Rows that hold the blocks a and b of a gap. Blocks meet as lists, not as pairs of texts."""
    # A large gap is dealt in chunks of its sides, each of which meets all of the other side, so that no row has it all.
    blocks = open_blocks.withColumn("chunk", F.floor(F.col("block_index") / F.when(F.col("side") == "a", CHUNK).otherwise(FACING)))
    listed = blocks.groupBy("cmp_id", "gap", "side", "chunk").agg(F.collect_list(F.struct("block_index", "text", F.greatest(word_count(F.col("text")), F.lit(1)).alias("words"))).alias("blocks"))
    side = lambda s: listed.filter(F.col("side") == s).select("cmp_id", "gap", F.col("blocks").alias(s))
    return side("a").join(side("b"), ["cmp_id", "gap"])


def _rated(row: dict, threshold: float) -> Iterator[tuple[list[int], list[int], float]]:
    """Plausible pairs of texts of a row of _met_gaps, each with the places of its blocks in order, and their score."""
    a, b = ([], [])
    for listed, side in ((a, row["a"]), (b, row["b"])):
        places: dict[str, list[int]] = {}
        words = {}
        for x in sorted(side, key=lambda x: x["block_index"]):
            places.setdefault(x["text"], []).append(x["block_index"])
            words[x["text"]] = x["words"]
        listed += [(at, text, words[text]) for text, at in places.items()]
    n, m = (np.array([len(x[1]) for x in side], dtype=np.int64) for side in (a, b))
    w, z = (np.array([x[2] for x in side], dtype=np.int64) for side in (a, b))
    every = n[:, None] + m
    may = (np.maximum(w[:, None], z) <= 3 * np.minimum(w[:, None], z)) & (2 * np.minimum(n[:, None], m) >= threshold * every - 1e-9)
    ours, theirs = np.flatnonzero(may.any(axis=1)), np.flatnonzero(may.any(axis=0))
    if not len(ours):
        return
    common = S.commons([a[i][1] for i in ours], [b[j][1] for j in theirs])
    near = may[np.ix_(ours, theirs)] & (2 * common >= threshold * every[np.ix_(ours, theirs)] - 1e-6)
    for i, j in np.argwhere(near).tolist():
        x, y = a[ours[i]], b[theirs[j]]
        s = 2 * int(common[i, j]) / (len(x[1]) + len(y[1])) if x[1] or y[1] else 1.0
        if s >= threshold:
            yield x[0], y[0], round(s, 4)


def scored(open_blocks: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Plausible pairs within gaps: cmp_id, gap, a_index, b_index, score."""
    every = lambda row: [(row["cmp_id"], row["gap"], i, j, s) for x, y, s in _rated(row, threshold) for i in x for j in y]
    return _each(_met_gaps(open_blocks), every, "cmp_id string, gap long, a_index int, b_index int, score double")


def _best_first(pairs: Iterable[tuple[float, int, int]]) -> Iterator[tuple[int, int, float]]:
    """Of (score, a, b) the best first, each block once; ties by a, then b."""
    used_a, used_b = set(), set()
    for s, a, b in sorted(pairs, key=lambda p: (-p[0], p[1], p[2])):
        if a not in used_a and b not in used_b:
            used_a.add(a), used_b.add(b)
            yield a, b, s


def assigned(candidates: DataFrame) -> DataFrame:
    """Best first, each block once; ties by a, then b. A gap is one group."""
    rows = candidates.groupBy("cmp_id", "gap").agg(F.collect_list(F.struct("score", "a_index", "b_index")).alias("pairs"))
    best = lambda row: [(row["cmp_id"], a, b, s) for a, b, s in _best_first((p["score"], p["a_index"], p["b_index"]) for p in row["pairs"])]
    return _each(rows, best, "cmp_id string, a_index int, b_index int, score double")


def _by_score(rows: Iterable[tuple[float | None, int | None, int, list[int] | None]]) -> Iterator[tuple[int, int, float]]:
    """_best_first of a stream (score, a, b, places) in that order, where b may stand for several blocks: rows without a score
    come first and tell their places."""
    used: set[int] = set()
    left: dict[int, list[int]] = {}
    for (score, a), found in groupby(rows, key=lambda x: x[:2]):
        free = []
        for _, _, b, places in found:
            if places:
                left[b] = places[::-1]
            elif a not in used and left.setdefault(b, [b]):
                free.append(left[b])
        if free:
            used.add(a)
            yield a, min(free, key=lambda at: at[-1]).pop(), score


def paired(open_blocks: DataFrame, threshold: float = 0.5, spread: bool = False) -> DataFrame:
    """What assigned makes of scored, without a row for each pair of blocks: those of the other side with one text are one,
    and the pairs of a gap are a sorted stream, so that no list has them all."""

    def listed(row: dict) -> Iterator[tuple]:
        several = {}
        for x, y, s in _rated(row, threshold):
            if len(y) > 1:
                several[y[0]] = y
            for i in x:
                yield row["cmp_id"], row["gap"], s, i, y[0], None
        for first, places in several.items():
            yield row["cmp_id"], row["gap"], None, None, first, places

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = lambda: pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)
        out: list[tuple] = []
        rows = (x for batch in batches for x in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        for (cmp_id, _), found in groupby(rows, key=lambda x: x[:2]):
            for a, b, s in _by_score(x[2:] for x in found):
                out.append((cmp_id, a, b, s))
                if len(out) >= 10_000:
                    yield made()
                    out.clear()
        if out:
            yield made()

    schema = StructType.fromDDL("cmp_id string, a_index int, b_index int, score double")
    names, kinds = schema.names, [to_arrow_type(f.dataType) for f in schema.fields]
    met = _met_gaps(open_blocks)
    rows = _each(_spread(met) if spread else met, listed, "cmp_id string, gap long, score double, a_index int, b_index int, places array<int>")
    ordered = rows.repartition("cmp_id", "gap").sortWithinPartitions("cmp_id", "gap", F.col("score").desc_nulls_first(), "a_index", "b_index")
    return ordered.mapInArrow(best, schema)


Pair = tuple[int, int, float]
Group = tuple[int, tuple[int, ...], float]


class Texts:
    """Blocks of one side against windows of the other. What is common to two single blocks is computed once for both
    directions (shared), and a block's row of the table goes on from a window to a longer one."""

    def __init__(self, one: dict[int, str], many: dict[int, str], shared: dict[tuple[int, int], int], swapped: bool) -> None:
        self.one, self.many, self.shared, self.swapped = one, many, shared, swapped
        self.pattern, self.at = S.Pattern(""), -1
        self.rows: dict[int, int] = {}

    def _use(self, i: int) -> S.Pattern:
        if self.at != i:
            self.pattern, self.at, self.rows = S.Pattern(self.one[i]), i, {}
        return self.pattern

    def _row(self, i: int, j: int) -> int:
        if j not in self.rows:
            pattern = self._use(i)
            self.rows[j] = pattern.after(pattern.start, self.many[j])
        return self.rows[j]

    def common(self, i: int, j: int) -> int:
        key = (j, i) if self.swapped else (i, j)
        if key not in self.shared:
            self._use(i)
            self.shared[key] = self.pattern.common(self._row(i, j))
        return self.shared[key]

    def length(self, window: tuple[int, ...]) -> int:
        return sum(len(self.many[j]) for j in window) + len(window) - 1

    def single(self, i: int, j: int) -> float:
        every = len(self.one[i]) + len(self.many[j])
        return round(2 * self.common(i, j) / every, 4) if every else 1.0

    def bound(self, i: int, window: tuple[int, ...]) -> float:
        """No score of the window's joined text is above; from the lengths alone."""
        n, m = len(self.one[i]), self.length(window)
        return 2 * min(n, m) / (n + m) + 1e-4

    def finer_bound(self, i: int, window: tuple[int, ...]) -> float:
        """As bound, from what the window's blocks have in common with the block one by one."""
        parts = sum(self.common(i, j) for j in window) + len(window) - 1
        return 2 * parts / (len(self.one[i]) + self.length(window)) + 1e-4

    def row_bound(self, i: int, window: tuple[int, ...]) -> float:
        """As finer_bound, with what the first block has in common with just the part of the block that the others, at
        best, leave to it."""
        n, rest = len(self.one[i]), sum(self.common(i, j) for j in window[1:]) + len(window) - 1
        k = max(0, n - rest)
        parts = k - (self._row(i, window[0]) & ((1 << k) - 1)).bit_count() + min(n, rest)
        return 2 * parts / (n + self.length(window)) + 1e-4

    def score(self, i: int, window: tuple[int, ...]) -> float:
        """Similarity of block i and the window's texts joined by spaces."""
        pattern = self._use(i)
        row = self._row(i, window[0])
        for j in window[1:]:
            row = pattern.after(row, " " + self.many[j])
        every = len(pattern.text) + self.length(window)
        return round(2 * pattern.common(row) / every, 4) if every else 1.0


def grown(pairs: list[Pair], free: set[int], texts: Texts, threshold: float) -> list[Group]:
    """Pairs whose block resembles a window of free neighbours around its partner clearly better than the partner alone.
    By the first side's order; a window's blocks are used up. Equal scores: the window that begins latest, then the shortest."""
    out: list[Group] = []
    for one, partner, score in sorted(pairs):
        if score + MARGIN >= 1.0:
            continue
        best: Group | None = None
        for before in range(SPAN):
            if before and partner - before not in free:
                break
            for after in range(SPAN - before):
                if after and partner + after not in free:
                    break
                if before + after == 0:
                    continue
                window = tuple(range(partner - before, partner + after + 1))
                least = max(threshold, score + MARGIN, best[2] if best else 0.0)
                if texts.bound(one, window) < least:
                    continue
                s = texts.score(one, window)
                if s >= threshold and s > score + MARGIN and (best is None or s > best[2]):
                    best = (one, window, s)
        if best:
            out.append(best)
            free.difference_update(best[1])
    return out


def _hopeful(lengths: np.ndarray, at: np.ndarray, widths: np.ndarray, table: np.ndarray, threshold: float) -> Iterator[list[tuple[int, int]]]:
    """For each row of the table (common lengths of a block, `lengths` long, and the free blocks `at`, `widths` long) the
    windows (first, last place in `at`) that bounds don't rule out, by first and then by last place."""
    first, last = [], []
    for k in range(1, SPAN):
        begins = np.flatnonzero(at[k:] - at[:-k] == k) if len(at) > k else np.empty(0, dtype=np.int64)
        first.append(begins), last.append(begins + k)
    first, last = np.concatenate(first), np.concatenate(last)
    order = np.lexsort((last, first))
    first, last = first[order], last[order]
    size = last - first
    sums = np.concatenate([[0], np.cumsum(widths)])
    joined = sums[last + 1] - sums[first] + size
    step = max(1, 500_000 // max(1, len(first)))
    for begin in range(0, len(lengths), step):
        n, common = lengths[begin : begin + step, None], table[begin : begin + step]
        every = np.maximum(n + joined, 1)
        bound = 2 * np.minimum(n, joined) / every
        single = np.where(n + widths > 0, 2 * common / np.maximum(n + widths, 1), 1.0)
        least = np.maximum(single[:, first], single[:, last])
        for k in range(1, SPAN - 1):
            least = np.maximum(least, single[:, np.minimum(first + k, last)])
        parts = np.concatenate([np.zeros((len(common), 1), dtype=np.int64), np.cumsum(common, axis=1, dtype=np.int64)], axis=1)
        finer = 2 * (parts[:, last + 1] - parts[:, first] + size) / every
        # Scores and single similarities are rounded to four places.
        hopeful = np.minimum(bound, finer) + 2e-4 >= np.maximum(threshold, least + MARGIN)
        for row in hopeful:
            found = np.flatnonzero(row)
            yield list(zip(first[found].tolist(), last[found].tolist(), strict=True))


#: Characters of windows that meet a group of blocks at once, where they aren't mostly each block's own: making a pack costs as
#: much as a block's search in so long a one.
MET = 20_000
#: Windows, counted for each block that they may suit, that are held at once.
HELD = 50_000


def _portions(hopeful: Iterable[list[tuple[int, int]]]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The windows of _hopeful as arrays (row, first, last), whole rows of them at a time."""
    rows: list[int] = []
    windows: list[tuple[int, int]] = []
    for row, found in enumerate(hopeful):
        rows += [row] * len(found)
        windows += found
        if len(rows) >= HELD:
            yield np.array(rows), *np.array(windows).T
            rows, windows = [], []
    if rows:
        yield np.array(rows), *np.array(windows).T


def _met_windows(rows: np.ndarray, first: np.ndarray, last: np.ndarray, lengths: np.ndarray, widths: np.ndarray) -> Iterator[np.ndarray]:
    """The places of (row, window) pairs in groups, rows of like length together, as their windows are of like length."""
    of = {}
    for place, row in enumerate(rows.tolist()):
        of.setdefault(row, []).append(place)
    sums = np.concatenate([[0], np.cumsum(widths)])
    chars = (sums[last + 1] - sums[first] + last - first).tolist()
    windows = list(zip(first.tolist(), last.tolist(), strict=True))
    group: list[int] = []
    seen: set[tuple[int, int]] = set()
    total = 0
    for row in sorted(of, key=lambda r: (lengths[r], r)):
        own = {windows[k]: chars[k] for k in of[row]}
        new = own.keys() - seen
        if group and total + sum(own[w] for w in new) > max(MET, 2 * sum(own.values())):
            yield np.array(group)
            group, seen, total = [], set(), 0
            new = own.keys()
        group += of[row]
        seen |= new
        total += sum(own[w] for w in new)
    if group:
        yield np.array(group)


def _window_commons(rows: np.ndarray, first: np.ndarray, last: np.ndarray, ones: list[str], many: list[str]) -> np.ndarray:
    """Lengths of longest common subsequences of block and window for each pair: blocks that share windows meet them in one
    pack."""
    out = np.zeros(len(rows), dtype=np.int64)
    lengths, widths = (np.array([len(t) for t in side], dtype=np.int64) for side in (ones, many))
    for group in _met_windows(rows, first, last, lengths, widths):
        own, x = np.unique(rows[group], return_inverse=True)
        windows, y = np.unique(first[group] * SPAN + last[group] - first[group], return_inverse=True)
        texts = [" ".join(many[w // SPAN : w // SPAN + w % SPAN + 1]) for w in windows.tolist()]
        blocks = [ones[i] for i in own.tolist()]
        if sum(map(len, blocks)) > sum(map(len, texts)):
            common = S.commons(blocks, texts)
        else:
            texts = S.Packed(texts)
            common = np.concatenate([S.commons([block], texts) for block in blocks])
        out[group] = common[x, y]
    return out


def _likely(rows: np.ndarray, first: np.ndarray, last: np.ndarray, ones: list[str], many: list[str], table: np.ndarray, threshold: float) -> Iterator[tuple[int, int, int, int]]:
    """Of hopeful windows those that may be chosen, by row, first and then last place, with their common length."""
    lengths, widths = (np.array([len(t) for t in side], dtype=np.int64) for side in (ones, many))
    sums = np.concatenate([[0], np.cumsum(widths)])
    every = np.maximum(lengths[rows] + sums[last + 1] - sums[first] + last - first, 1)
    single = np.zeros(len(rows))
    for k in range(SPAN):
        at = np.minimum(first + k, last)
        both = lengths[rows] + widths[at]
        single = np.maximum(single, np.where(both > 0, 2 * table[rows, at] / np.maximum(both, 1), 1.0))
    least = np.maximum(threshold, single + MARGIN) - 2e-4  # scores and single similarities are rounded to four places
    # Two neighbours are met by many windows and first; with them the longer windows' bounds rule most of these out.
    two = np.unique(np.concatenate([rows * len(many) + first, rows * len(many) + last - 1]))
    exact = _window_commons(two // len(many), two % len(many), two % len(many) + 1, ones, many)
    begin, end = (exact[np.searchsorted(two, rows * len(many) + x)] for x in (first, last - 1))
    most = np.where(last - first == 2, np.minimum(begin + table[rows, last], table[rows, first] + end), begin + end) + 1
    common = np.where(last - first == 1, begin, 0)
    longer = np.flatnonzero((last - first > 1) & (2 * np.minimum(most, lengths[rows]) / every >= least))
    common[longer] = _window_commons(rows[longer], first[longer], last[longer], ones, many)
    good = np.flatnonzero(2 * common / every >= least)
    return zip(rows[good].tolist(), first[good].tolist(), last[good].tolist(), common[good].tolist(), strict=True)


Span = tuple[int, int, int, float]


def _scores(ones: list[int], own: list[str], order: list[int], many: list[str], table: np.ndarray, threshold: float) -> Iterator[Span]:
    """Windows (block, first, last, score) of two to four neighbours that a block resembles, and none of them alone nearly as
    well; by block, first and last. `table` has the common lengths of both sides."""
    lengths, widths = (np.array([len(t) for t in side], dtype=np.int64) for side in (own, many))
    ratio = lambda common, every: round(2 * common / every, 4) if every else 1.0
    for portion in _portions(_hopeful(lengths, np.array(order), widths, table, threshold)):
        for i, x, y, c in _likely(*portion, own, many, table, threshold):
            n, common = len(own[i]), table[i]
            s = ratio(c, n + sum(len(many[k]) for k in range(x, y + 1)) + y - x)
            if s >= threshold and s > max(ratio(int(common[k]), n + len(many[k])) for k in range(x, y + 1)) + MARGIN:
                yield ones[i], order[x], order[y], s


def _chosen(windows: Iterable[Span], free: set[int]) -> list[Group]:
    """For each block in turn the best window of blocks that are still free, of equal ones the first; it is used up."""
    out: list[Group] = []
    for one, found in groupby(windows, key=lambda w: w[0]):
        best: Group | None = None
        for _, first, last, s in found:
            if (best is None or s > best[2]) and all(k in free for k in range(first, last + 1)):
                best = (one, tuple(range(first, last + 1)), s)
        if best:
            out.append(best)
            free.difference_update(best[1])
    return out


def gathered(ones: list[int], free: set[int], texts: Texts, threshold: float, table: np.ndarray | None = None) -> list[Group]:
    """Unmatched blocks that resemble a window of two to four free neighbours, and none of these alone nearly as well.
    `table` has the common lengths of `ones` and the free blocks in order, if they are known."""
    if not ones or len(free) < 2:
        return []
    order = sorted(free)
    many, step = [texts.many[j] for j in order], max(1, CELLS // len(order))

    def windows() -> Iterator[Span]:
        # Scores depend on no choice, so they are known before; only which windows are still free is seen in order.
        for at in range(0, len(ones), step):
            part = ones[at : at + step]
            own = [texts.one[i] for i in part]
            yield from _scores(part, own, order, many, S.commons(own, many) if table is None else table[at : at + step], threshold)

    return _chosen(windows(), free)


def dealt_windows(open_blocks: DataFrame, pairs: DataFrame, threshold: float) -> DataFrame:
    """The windows of blocks without a pair, as `gathered` scores them, for whole comparisons in cells of CHUNK by CHUNK
    blocks: cmp_id, what (split or merge), one, first, size, score."""
    taken = pairs.select("cmp_id", F.explode(F.array(F.struct(F.lit("a").alias("side"), F.col("a_index").alias("block_index")), F.struct(F.lit("b").alias("side"), F.col("b_index").alias("block_index")))).alias("x")).select("cmp_id", "x.*")
    free = open_blocks.join(taken, ["cmp_id", "side", "block_index"], "left_anti")
    # A chunk goes on with the blocks in which its last windows end.
    at = lambda n: F.floor((F.col("block_index") - n) / CHUNK).cast("int")
    chunks = free.withColumn("chunk", F.explode(F.sequence(F.greatest(at(SPAN - 1), F.lit(0)), at(0)))).groupBy("cmp_id", "side", "chunk").agg(F.collect_list(F.struct("block_index", "text")).alias("blocks"))
    chunks = written(chunks, "window-chunks")
    side = lambda s, n: chunks.filter(F.col("side") == s).select("cmp_id", F.col("chunk").alias(n), F.col("blocks").alias(s))
    met = _spread(side("a", "x").join(side("b", "y"), "cmp_id"))

    def rated(row: dict) -> Iterator[tuple]:
        (i, a), (j, b) = (zip(*sorted((x["block_index"], x["text"]) for x in row[s]), strict=True) for s in "ab")
        n, m = bisect_left(i, (row["x"] + 1) * CHUNK), bisect_left(j, (row["y"] + 1) * CHUNK)
        table = S.commons(list(a), list(b))
        for what, table, own, ones, order, many, end in (("split", table[:n], a[:n], i[:n], j, b, j[m - 1]), ("merge", table.T[:m], b[:m], j[:m], i, a, i[n - 1])):
            if n and m:
                for one, first, last, s in _scores(list(ones), list(own), list(order), list(many), table, threshold):
                    if first <= end:
                        yield row["cmp_id"], what, one, first, last - first, s

    return _each(met, rated, "cmp_id string, what string, one int, first int, size int, score double")


def in_reading_order(rows: list[dict]) -> list[dict]:
    """By the second side; deletions come before the first row whose first-side place lies behind theirs."""
    placed = sorted((r for r in rows if r["b_indices"]), key=lambda r: (min(r["b_indices"]), min(r["a_indices"] or [0])))
    deleted = sorted((r for r in rows if not r["b_indices"]), key=lambda r: r["a_indices"])
    out, n = [], 0
    for r in placed:
        at = min(r["a_indices"], default=-1)
        while n < len(deleted) and deleted[n]["a_indices"][0] < at:
            out.append(deleted[n])
            n += 1
        out.append(r)
    return out + deleted[n:]


def arrange(
    anchored: list[tuple[int, int]], pairs: list[Pair], a_texts: dict[int, str], b_texts: dict[int, str], options: DiffOptions, windows: tuple[list[Span], list[Span]] | None = None
) -> list[dict]:
    """Groups, moves, deletions and insertions of one comparison, in reading order. a_texts and b_texts hold the blocks
    that no anchor holds; `windows` those of b and of a that have been scored for blocks without a pair, else it is done here."""
    limit = options.align_threshold
    free_a, free_b = set(a_texts) - {a for a, _, _ in pairs}, set(b_texts) - {b for _, b, _ in pairs}
    shared: dict[tuple[int, int], int] = {}
    forward, backward = Texts(a_texts, b_texts, shared, False), Texts(b_texts, a_texts, shared, True)
    splits = grown(pairs, free_b, forward, limit)
    pairs = [p for p in pairs if p[0] not in {s[0] for s in splits}]
    merges = grown([(b, a, s) for a, b, s in pairs], free_a, backward, limit)
    pairs = [p for p in pairs if p[1] not in {m[0] for m in merges}]
    ones, others = sorted(free_a), sorted(free_b)
    table = S.commons([a_texts[i] for i in ones], [b_texts[j] for j in others]) if windows is None and max(len(ones), len(others)) > 1 and len(ones) * len(others) <= CELLS else None
    orphans = _chosen((w for w in sorted(windows[0]) if w[0] in free_a), free_b) if windows else gathered(ones, free_b, forward, limit, table)
    splits += orphans
    free_a -= {s[0] for s in orphans}
    if table is not None:  # what is left of it, for the other direction
        table = table[np.ix_([i in free_a for i in ones], [j in free_b for j in others])].T
    orphans = _chosen((w for w in sorted(windows[1]) if w[0] in free_b), free_a) if windows else gathered(sorted(free_b), free_a, backward, limit, table)
    merges += orphans
    free_b -= {m[0] for m in orphans}

    matched = sorted([(a, b, 1.0) for a, b in anchored] + pairs)
    kept = set(longest_increasing([b for _, b, _ in matched]))
    moved = {i for i, (_, _, s) in enumerate(matched) if options.detect_moves and i not in kept and s >= options.move_threshold}
    row = lambda relation, a, b, s, move=None: {"relation": relation, "a_indices": list(a), "b_indices": list(b), "similarity": s, "move_distance": move}
    rows = [row("MATCHED", [a], [b], s, b - a if i in moved else None) for i, (a, b, s) in enumerate(matched)]
    rows += [row("SPLIT", [a], window, s) for a, window, s in splits]
    rows += [row("MERGED", window, [b], s) for b, window, s in merges]
    rows += [row("DELETED", [a], [], 0.0) for a in free_a] + [row("INSERTED", [], [b], 0.0) for b in free_b]
    return in_reading_order(rows)


def align(rows: DataFrame, options: DiffOptions | None = None) -> DataFrame:
    """Alignments of all comparisons whose blocks `rows` (see sides) holds."""
    options = options or DiffOptions()
    found = written(anchors(rows), "anchors")
    open_blocks = written(gaps(rows, found), "gaps")
    none = lambda kind: F.lit(None).cast(kind)
    facts = found.select("cmp_id", F.lit("anchor").alias("what"), F.col("a_index").alias("i"), F.col("b_index").alias("j"), none("double").alias("score"), none("string").alias("text"))
    sizes = open_blocks.groupBy("cmp_id").agg(F.count_if(F.col("side") == "a").alias("n_a"), F.count_if(F.col("side") == "b").alias("n_b"))
    large = sizes.filter(F.col("n_a").cast("long") * F.col("n_b") > DEALT).select("cmp_id")
    dealt = not large.isEmpty()
    if dealt:
        large = written(large, "large")
        most = open_blocks.join(large, "cmp_id", "left_semi")
        pairs = paired(open_blocks.join(large, "cmp_id", "left_anti"), options.align_threshold).unionByName(paired(most, options.align_threshold, spread=True))
        pairs = written(pairs, "pairs")  # read twice
    else:
        pairs = paired(open_blocks, options.align_threshold)
    facts = facts.unionByName(pairs.select("cmp_id", F.lit("pair").alias("what"), F.col("a_index").alias("i"), F.col("b_index").alias("j"), "score", none("string").alias("text")))
    facts = facts.unionByName(open_blocks.select("cmp_id", F.col("side").alias("what"), F.col("block_index").alias("i"), F.lit(0).alias("j"), none("double").alias("score"), "text"))
    if dealt:
        windows = dealt_windows(most, pairs, options.align_threshold)
        facts = facts.unionByName(windows.select("cmp_id", "what", F.col("one").alias("i"), (F.col("first") * SPAN + F.col("size")).alias("j"), "score", none("string").alias("text")))
        facts = facts.unionByName(large.select("cmp_id", F.lit("dealt").alias("what"), F.lit(0).alias("i"), F.lit(0).alias("j"), none("double").alias("score"), none("string").alias("text")))
    rows_in = facts.groupBy("cmp_id").agg(F.collect_list(F.struct("what", "i", "j", "score", "text")).alias("facts"))

    def arranged(row: dict) -> Iterable[tuple]:
        of: dict[str, list[dict]] = {"anchor": [], "pair": [], "a": [], "b": [], "split": [], "merge": [], "dealt": []}
        for x in row["facts"]:
            of[x["what"]].append(x)
        texts = lambda w: {x["i"]: x["text"] for x in of[w]}
        scored = tuple([(x["i"], x["j"] // SPAN, x["j"] // SPAN + x["j"] % SPAN, x["score"]) for x in of[w]] for w in ("split", "merge")) if of["dealt"] else None
        out = arrange([(x["i"], x["j"]) for x in of["anchor"]], [(x["i"], x["j"], x["score"]) for x in of["pair"]], texts("a"), texts("b"), options, scored)
        return [(row["cmp_id"], n, r["relation"], r["a_indices"], r["b_indices"], r["similarity"], r["move_distance"]) for n, r in enumerate(out, 1)]

    return _each(rows_in, arranged, ALIGNMENTS)
