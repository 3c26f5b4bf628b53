"""Suffix dedup: removes every byte of a 400-byte string that starts at two places or more.

Which suffixes take part: the anchors of all 400-byte windows (sketch.py), about one byte in 185, whose count-min
estimate says that they may repeat. Equal windows have equal anchors at equal distances, so any repeated window
shows as two anchor suffixes that agree for r bytes rightwards and l bytes leftwards with l + r >= 400.

Merge sort: each map task sorts its suffixes (at most 400 bytes each), joins equal ones into one entry with a list
of places, and sends each key range one front-coded run (shared prefix length and remainder). A range's task merges
the runs with a loser tree whose players carry the length of the prefix that they share with the last winner, so
known prefixes are never compared again and the merge yields the common-prefix array as it goes. Suffixes of one
anchor stand next to each other there. For every suffix the longest r, and in the order of the left contexts the
longest l, come from its neighbours; where the neighbours don't settle both, a scan over its anchor's suffixes does.
All bytes [p - l, p + r) of a place p go, with the longest l and r over all partners that reach 400 together: those
strings all contain p, so their union is one interval.

Anchors estimated to occur HEAVY times or more are split within the merge sort: of a repeated window either the
`(length + gram) / 2` bytes from the anchor on agree, or the bytes before it up to the same sum less the anchor. So such
suffixes go out in two sorts, one by what follows and one by what precedes (with the roles of suffix and context
exchanged), dealt and grouped by that many bytes instead of the anchor's; the spans of both are joined. This changes who
meets whom in a task, not the pairs that count: those that reach `length` bytes meet in at least one of the sorts.

Defined results: a null text is empty; a text shorter than 400 bytes keeps all; repeated rows remove each other;
null ids are allowed; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import sketch
from .common import BASES, batches, grams, mix, sizes, sliding_min, with_text_key

LENGTH = 400
GRAM = 32
#: Estimated places of an anchor from which on its suffixes are split.
HEAVY = 20_000
#: Bytes of contexts a map task holds before it sends its sorted runs.
HELD = 96_000_000
BATCH = 2_000_000
MAX_RANGES = 4096
SPLIT_SAMPLE = 2000


def _laid_out(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a batch end to end, and the start of each text in them with the end at last."""
    column = batch.column("text")
    column = pc.fill_null(column, "")
    lengths = pc.binary_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
    data = b"".join(x.as_buffer().to_pybytes() if x.is_valid else b"" for x in column)
    return np.frombuffer(data, np.uint8), np.append(0, np.cumsum(lengths))


def _anchors(data: np.ndarray, bounds: np.ndarray, length: int, gram: int):
    """Anchor places, their hashes, and each window's wholeness and least hash."""
    h = mix(grams(data.astype(np.uint64) + np.uint64(1), gram, BASES[0])) | np.uint64(1)
    whole, least = sketch.anchors(h, np.repeat(bounds[1:], np.diff(bounds)), gram, length)
    if not whole.any():
        return np.zeros(0, np.int64), h[:0], whole, least
    span, none = length - gram + 1, np.uint64(2**64 - 1)
    upside_down = np.full(len(h) + span - 1, none)
    upside_down[span - 1 : span - 1 + len(least)] = np.where(whole, ~least, none)
    places = np.flatnonzero(h == ~sliding_min(upside_down, span))
    return places, h[places], whole, least


def _keys(length: int, gram: int):
    def keys(frames: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        for batch in batches(frames, BATCH):
            _, h, _, _ = _anchors(*_laid_out(batch), length, gram)
            if len(h):
                yield h

    return keys


def common_prefix(a: bytes, b: bytes, known: int = 0) -> int:
    """Length of the common prefix; the first `known` bytes are taken as equal and not looked at."""
    n = min(len(a), len(b))
    while known < n:
        x, y = a[known : known + 64], b[known : known + 64]
        if x != y:
            m = min(len(x), len(y))
            differ = int.from_bytes(x[:m]) ^ int.from_bytes(y[:m])
            return known + m - (differ.bit_length() + 7) // 8
        known += len(x)
    return n


def front_coded(entries: list[tuple[bytes, bytes]], places: list[list[tuple[int, int, int]]]) -> bytes:
    """A sorted run of (suffix, reversed left context): shared prefix lengths, remainders, contexts and places."""
    shared = [0] * len(entries)
    for i in range(1, len(entries)):
        shared[i] = common_prefix(entries[i - 1][0], entries[i][0])
    head = np.array([shared, [len(r) for r, _ in entries], [len(x) for _, x in entries], [len(p) for p in places]], np.uint32)
    body = b"".join(r[s:] for (r, _), s in zip(entries, shared, strict=True)) + b"".join(x for _, x in entries)
    at = np.array([x for p in places for x in p], np.int64)
    return zstandard.ZstdCompressor(level=1).compress(np.uint32(len(entries)).tobytes() + head.tobytes() + at.tobytes() + body)


def front_decoded(blob: bytes) -> tuple[list[bytes], list[int], list[bytes], list[np.ndarray]]:
    data = zstandard.ZstdDecompressor().decompress(blob)
    n = int(np.frombuffer(data, np.uint32, 1)[0])
    shared, r_len, l_len, n_at = np.frombuffer(data, np.uint32, 4 * n, 4).reshape(4, n).astype(np.int64)
    total = int(n_at.sum())
    at = np.frombuffer(data, np.int64, 3 * total, 4 + 16 * n).reshape(total, 3)
    place = 4 + 16 * n + 24 * total
    suffixes, last = [], b""
    for s, r in zip(shared.tolist(), r_len.tolist(), strict=True):
        last = last[:s] + data[place : place + r - s]
        place += r - s
        suffixes.append(last)
    lefts = []
    for k in l_len.tolist():
        lefts.append(data[place : place + k])
        place += k
    return suffixes, shared.tolist(), lefts, np.split(at, np.cumsum(n_at)[:-1]) if n else []


def merged(runs: list[tuple[list[bytes], list[int]]]) -> Iterator[tuple[int, int, int]]:
    """Loser tree over sorted runs with their common-prefix arrays: yields run, index, and the prefix shared with
    the string before. Each player's known prefix is that with the last winner; -1 marks an ended run."""
    width = 1
    while width < len(runs):
        width *= 2
    known = [0 if i < len(runs) and runs[i][0] else -1 for i in range(width)]
    now = [runs[i][0][0] if known[i] == 0 else b"" for i in range(width)]
    index = [0] * width

    def play(a: int, b: int) -> tuple[int, int]:
        p, q = known[a], known[b]
        if p != q:
            return (a, b) if p > q else (b, a)
        if p < 0:
            return a, b
        x, y = now[a], now[b]
        h = common_prefix(x, y, p)
        if h == len(x) or (h < len(y) and x[h] < y[h]):
            known[b] = h
            return a, b
        known[a] = h
        return b, a

    losers, level = [0] * width, list(range(width))
    for_node = {width + i: i for i in level}
    for node in range(width - 1, 0, -1):
        for_node[node], losers[node] = play(for_node[2 * node], for_node[2 * node + 1])
    best = for_node[1]
    while known[best] >= 0:
        yield best, index[best], known[best]
        index[best] += 1
        strings, shared = runs[best]
        if index[best] < len(strings):
            now[best], known[best] = strings[index[best]], shared[index[best]]
        else:
            known[best] = -1
        node = (width + best) // 2
        while node:
            best, losers[node] = play(best, losers[node])
            node //= 2


def _outward(steps: np.ndarray, i: int) -> np.ndarray:
    """Least of steps between i and each other position: the common prefix of sorted strings i and j."""
    n = len(steps)
    out = np.empty(n, np.int64)
    out[i] = 0
    out[i + 1 :] = np.minimum.accumulate(steps[i + 1 :])
    out[:i] = np.minimum.accumulate(steps[i:0:-1])[::-1] if i else []
    return out


def reaches(suffixes: list[bytes], shared: list[int], lefts: list[bytes], single: list[bool], length: int) -> list[tuple[int, int] | None]:
    """For different (suffix, left context) entries of one anchor, sorted by suffix: the longest left and right
    agreement with partners that reach `length` in all, or None. An entry found at two places is its own partner."""
    n = len(suffixes)
    steps = np.array(shared, np.int64)
    steps[0] = 0
    order = sorted(range(n), key=lefts.__getitem__)
    rank = [0] * n
    for j, i in enumerate(order):
        rank[i] = j
    left_steps = np.array([0] + [common_prefix(lefts[a], lefts[b]) for a, b in zip(order, order[1:], strict=False)], np.int64)
    order_at = np.array(order)
    out: list[tuple[int, int] | None] = []
    for i in range(n):
        if not single[i]:
            out.append((len(lefts[i]), len(suffixes[i])) if len(lefts[i]) + len(suffixes[i]) >= length else None)
            continue
        near = [(int(steps[i]), i - 1), (int(steps[i + 1]), i + 1) if i + 1 < n else (0, -1)] if i else [(int(steps[1]), 1) if n > 1 else (0, -1)]
        j = rank[i]
        left_near = ([(int(left_steps[j]), order[j - 1])] if j else []) + ([(int(left_steps[j + 1]), order[j + 1])] if j + 1 < n else [])
        r, l = max(near)[0], max(left_near, default=(0, -1))[0]
        if l + r < length:
            out.append(None)
            continue
        right_found = any(k >= 0 and x == r and r + common_prefix(lefts[i], lefts[k]) >= length for x, k in near)
        left_found = any(x == l and l + common_prefix(suffixes[i], suffixes[k]) >= length for x, k in left_near)
        if not (right_found and left_found):
            rights, by_rank = _outward(steps, i), _outward(left_steps, j)
            ls = np.empty(n, np.int64)
            ls[order_at] = by_rank
            good = (rights + ls >= length) & (np.arange(n) != i)
            if not good.any():
                out.append(None)
                continue
            r, l = int(rights[good].max()), int(ls[good].max())
        out.append((l, r))
    return out


def _range_spans(blobs: list[bytes], length: int, prefix: int, flipped: bool = False) -> pd.DataFrame:
    """Merges the runs of a key range and finds the removed interval of each place. Suffixes that share `prefix` bytes
    are one group. flipped: what is sorted are the reversed left contexts, and the suffixes are their contexts."""
    decoded = [front_decoded(b) for b in blobs]
    spans: list[np.ndarray] = []
    suffixes: list[bytes] = []
    shared: list[int] = []
    lefts: list[bytes] = []
    places: list[list[np.ndarray]] = []
    known: dict[bytes, int] = {}
    least = 0

    def flush() -> None:
        at = [np.concatenate(p) for p in places]
        if len(at) > 1 or (at and len(at[0]) > 1):
            for found, p in zip(reaches(suffixes, shared, lefts, [len(p) == 1 for p in at], length), at, strict=True):
                if found:
                    left, right = found[::-1] if flipped else found
                    spans.append(np.column_stack([p[:, 0], p[:, 1], p[:, 2] - left, p[:, 2] + right]))
        for x in (suffixes, shared, lefts, places, known):
            x.clear()

    for run, i, h in merged([(d[0], d[1]) for d in decoded]):
        suffix, left, at = decoded[run][0][i], decoded[run][2][i], decoded[run][3][i]
        if h < prefix:
            flush()
            least = 0
        elif suffixes:
            least = min(least, h)
            if not (h == len(suffix) and len(suffix) == len(last)):
                known.clear()
        last = suffix
        if left in known:
            places[known[left]].append(at)
            continue
        known[left] = len(suffixes)
        suffixes.append(suffix)
        shared.append(least)
        least = length
        lefts.append(left)
        places.append([at])
    flush()
    rows = np.concatenate(spans) if spans else np.zeros((0, 4), np.int64)
    return pd.DataFrame(rows, columns=["doc", "tk", "start", "stop"])


def halves(length: int, gram: int) -> tuple[int, int]:
    """For split anchors: how many bytes from the anchor on, or else before it, any repeated window shares."""
    right = (length + gram + 1) // 2
    return right, length - right + 1


def _candidates(shared, splitters: list[bytes], parts: int, length: int, gram: int):
    """Sorted front-coded runs for each key range; suffixes of heavy anchors in the two sorts of halves()."""
    reach, groups = length - gram, (len(splitters) + 1) * parts
    right, left = halves(length, gram)

    def batch_of(out: list[tuple]) -> pa.RecordBatch:
        bucket, blobs = zip(*out, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(bucket, pa.int64()), pa.array(blobs, pa.binary())], names=["bucket", "blob"])

    def bucket_of(kind: int, key: tuple[bytes, bytes]) -> int:
        """Kind k's buckets are k * groups and on. Heavy ones are dealt by a hash of what their groups share."""
        if kind:
            return kind * groups + hash_of(key[0][: (right, left)[kind - 1]]) % groups
        return (bisect_right(splitters, key[0][:gram]) if splitters else 0) * parts + (hash_of(key[0][:gram]) % parts if parts > 1 else 0)

    def sorted_runs(kinds: tuple[dict, dict, dict]) -> Iterator[pa.RecordBatch]:
        out = []
        for kind, entries in enumerate(kinds):
            by_range: dict[int, list] = {}
            for key in sorted(entries):
                by_range.setdefault(bucket_of(kind, key), []).append(key)
            for bucket, keys in by_range.items():
                out.append((bucket, front_coded(keys, [entries[k] for k in keys])))
                if len(out) == 64:
                    yield batch_of(out)
                    out = []
        if out:
            yield batch_of(out)

    def hash_of(data: bytes) -> int:
        return int.from_bytes(hashlib.blake2b(data, digest_size=6).digest())

    def found(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, kinds, held = shared.value, ({}, {}, {}), 0
        for batch in batches(frames, BATCH):
            data, bounds = _laid_out(batch)
            places, h, _, _ = _anchors(data, bounds, length, gram)
            good = counts.repeated(h)
            places, h = places[good], h[good]
            heavy = counts.heavy(h)
            ids, tks = batch.column("dk").to_pylist(), batch.column("tk").to_pylist()
            raw = data.tobytes()
            row = np.searchsorted(bounds, places, side="right") - 1
            for r, p, a, z, hot in zip(row.tolist(), places.tolist(), bounds[row].tolist(), bounds[row + 1].tolist(), heavy.tolist(), strict=True):
                suffix, before = raw[p : min(z, p + length)], raw[max(a, p - reach) : p][::-1]
                if not hot:
                    todo = [(0, (suffix, before))]
                else:
                    # Where one side is too short for its sort, it can't be the side that agrees that far.
                    todo = [(1, (suffix, before))] * (len(suffix) >= right) + [(2, (before, suffix))] * (len(before) >= left)
                for kind, key in todo:
                    old = kinds[kind].get(key)
                    if old is None:
                        kinds[kind][key] = [(ids[r], tks[r], p - a)]
                        held += 1000
                    else:
                        old.append((ids[r], tks[r], p - a))
                        held += 150
            if held > HELD:
                yield from sorted_runs(kinds)
                kinds, held = ({}, {}, {}), 0
        yield from sorted_runs(kinds)

    return found


def _result(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches(frames):
        cols: list[list] = [[], [], [], [], [], []]
        for doc, text, spans in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), batch.column("spans").to_pylist(), strict=True):
            data, removed = (text or "").encode("utf-8", "surrogatepass"), []
            for a, z in sorted((x["start"], x["stop"]) for x in spans or ()):
                if removed and a <= removed[-1][1]:
                    removed[-1][1] = max(z, removed[-1][1])
                else:
                    removed.append([a, z])
            cuts = [0, *(x for span in removed for x in span), len(data)]
            kept = b"".join(data[a:z] for a, z in zip(cuts[::2], cuts[1::2], strict=True))
            for c, x in zip(cols, (doc, len(data), len(data) - len(kept), len(removed), hashlib.sha256(kept).hexdigest(), kept), strict=True):
                c.append(x)
        yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols[:4]), pa.array(cols[4], pa.string()), pa.array(cols[5], pa.binary())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])


def _splitters(docs: DataFrame, rows: int, ranges: int, length: int, gram: int) -> list[bytes]:
    """Range bounds from the anchors of about SPLIT_SAMPLE documents chosen by hash, 64 anchors each at most. They
    only balance the ranges; the result doesn't depend on them."""
    if ranges < 2:
        return []

    def prefixes(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(frames, BATCH):
            data, bounds = _laid_out(batch)
            places, h, _, _ = _anchors(data, bounds, length, gram)
            row = np.searchsorted(bounds, places, side="right") - 1
            out = []
            for r in np.unique(row):
                own = row == r
                out += [data[p : p + gram].tobytes() for p in places[own][np.argsort(h[own])[:64]]]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["prefix"])

    chosen = docs.filter(F.pmod(F.xxhash64("dk", "tk"), F.lit(max(1, rows // SPLIT_SAMPLE))) == 0)
    found = sorted(bytes(r[0]) for r in chosen.mapInArrow(prefixes, "prefix binary").toLocalIterator())
    return sorted({found[len(found) * i // ranges] for i in range(1, ranges)}) if found else []


def remove_repeated_bytes(documents: DataFrame, length: int = LENGTH, gram: int = GRAM, heavy: int = HEAVY, max_cells: int = sketch.MAX_CELLS) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (binary) for every row."""
    docs = with_text_key(documents)
    chars, rows = sizes(docs)
    counts = sketch.build(docs, _keys(length, gram), 2 * chars // (length - gram), heavy, max_cells)
    groups = max(4, chars // 8_000_000)
    ranges = min(MAX_RANGES, groups)
    splitters = _splitters(docs, rows, ranges, length, gram)
    shared = docs.sparkSession.sparkContext.broadcast(counts)
    parts = -(-groups // ranges)
    runs = docs.mapInArrow(_candidates(shared, splitters, parts, length, gram), "bucket long, blob binary")
    prefixes, each = (gram, *halves(length, gram)), (len(splitters) + 1) * parts

    def spans(rows: pd.DataFrame) -> pd.DataFrame:
        kind = int(rows["bucket"].iloc[0]) // each
        return _range_spans(list(rows["blob"]), length, prefixes[kind], kind == 2)

    found = runs.groupBy("bucket").applyInPandas(spans, "doc long, tk long, start long, stop long")
    by_doc = found.groupBy(F.col("doc").alias("g_doc"), F.col("tk").alias("g_tk")).agg(F.collect_list(F.struct("start", "stop")).alias("spans"))
    joined = docs.join(by_doc, (docs["dk"] == by_doc["g_doc"]) & (docs["tk"] == by_doc["g_tk"]), "left").select("doc_id", "text", "spans")
    return joined.mapInArrow(_result, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
