"""Count-min sketch of anchors: partition sketches, merged by cell range, as bitmaps of a bounded size.

Windows are counted under their anchor, the leftmost item of least hash among the window's k-grams. Equal
windows have equal anchors, so an anchor's count is never below that of any window it stands for: the sketch
overestimates, and dropping the windows whose anchor is estimated single loses no repeated window. Only about
2 / (w + 1) of all positions are anchors, so a sketch serves many times its cells.

Size bound: two rows of at most MAX_CELLS cells, of which two bits each reach the driver and the executors
(128 MB at most). A fuller sketch only lets more windows through to the exact pass. The bound is a parameter of the
operators (max_cells, a power of two): each doubling serves twice the text for twice the memory.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix, sliding_min

DEPTH = 2
MAX_CELLS = 2**28
SLOT = 2**16
ROW_SHIFT = (np.uint64(0), np.uint64(32))


def anchors(h: np.ndarray, ends: np.ndarray, k: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """For texts laid end to end: which windows are whole, and the least k-gram hash of each window.

    h: hashes of all k-grams; ends: for each item the end of its text."""
    n = len(ends) - window + 1
    if n <= 0:
        return np.zeros(0, bool), np.zeros(0, np.uint64)
    whole = np.arange(n) + window <= ends[:n]
    return whole, sliding_min(h, window - k + 1)[:n]


def runs(whole: np.ndarray, least: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of runs of whole windows with one anchor hash, at most `longest` windows each."""
    n = len(least)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    change = np.ones(n, bool)
    change[1:] = (least[1:] != least[:-1]) | (whole[1:] != whole[:-1])
    starts = np.flatnonzero(change)
    stops = np.append(starts[1:], n)
    good = whole[starts]
    starts, stops = starts[good], stops[good]
    if len(starts) and (stops - starts).max() > longest:
        parts = (stops - starts + longest - 1) // longest
        nth = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        all_stops = np.repeat(stops, parts)
        starts = np.repeat(starts, parts) + nth * longest
        stops = np.minimum(starts + longest, all_stops)
    return starts, stops


def cells_for(expected: int, most: int = MAX_CELLS) -> int:
    """Cells of a row: a power of two, four times the expected keys, within SLOT and `most`."""
    return int(min(most, max(SLOT, 2 ** int(np.ceil(np.log2(max(1, expected) * 4))))))


class Sketch:
    """The merged sketch as bitmaps: cells counted twice or more, and cells counted `heavy` times or more."""

    def __init__(self, cells: int, repeated: np.ndarray, heavy: np.ndarray) -> None:
        self.cells, self.bits, self.heavy_bits = cells, repeated, heavy

    def _test(self, bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
        ok = np.ones(len(keys), bool)
        mixed = mix(keys)
        for row in range(DEPTH):
            at = ((mixed >> ROW_SHIFT[row]) & np.uint64(self.cells - 1)) + np.uint64(row * self.cells)
            ok &= (bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & np.uint8(1) != 0
        return ok

    def repeated(self, keys: np.ndarray) -> np.ndarray:
        return self._test(self.bits, keys)

    def heavy(self, keys: np.ndarray) -> np.ndarray:
        return self._test(self.heavy_bits, keys)


def _partition_rows(keys: list[np.ndarray], cells: int, part: int) -> Iterator[pa.RecordBatch]:
    """One partition's sketch, sparse: for each cell range its cells and their counts."""
    mixed = mix(np.concatenate(keys))
    slots, cell_rows, count_rows = [], [], []
    for row in range(DEPTH):
        at, n = np.unique(((mixed >> ROW_SHIFT[row]) & np.uint64(cells - 1)) + np.uint64(row * cells), return_counts=True)
        slot = (at // np.uint64(SLOT)).astype(np.int64)
        cut = np.flatnonzero(np.append(True, slot[1:] != slot[:-1]))
        for a, b in zip(cut, np.append(cut[1:], len(slot)), strict=True):
            slots.append(int(slot[a]))
            cell_rows.append((at[a:b] % np.uint64(SLOT)).astype(np.uint16).tobytes())
            count_rows.append(np.minimum(n[a:b], 2**32 - 1).astype(np.uint32).tobytes())
    for a in range(0, len(slots), 4096):
        n = len(slots[a : a + 4096])
        yield pa.RecordBatch.from_arrays(
            [pa.array(slots[a : a + n], pa.int64()), pa.array([part] * n, pa.int32()), pa.array(cell_rows[a : a + n], pa.binary()), pa.array(count_rows[a : a + n], pa.binary())],
            names=["slot", "part", "cell", "n"],
        )


def _merged(rows: pd.DataFrame) -> np.ndarray:
    counts = np.zeros(SLOT, np.uint64)
    for cell, n in zip(rows["cell"], rows["n"], strict=True):
        counts[np.frombuffer(cell, np.uint16)] += np.frombuffer(n, np.uint32)
    return counts


def build(docs: DataFrame, keys_of: Callable[[Iterator[pa.RecordBatch]], Iterator[np.ndarray]], expected: int, heavy: int, most: int = MAX_CELLS) -> Sketch:
    """Sketches each partition of docs, then merges the sketches by cell range, in two levels so that no task holds
    the cells of more than 64 partitions or of their sums. keys_of yields a partition's keys."""
    cells = cells_for(expected, most)

    def partition(frames):
        from pyspark import TaskContext

        part, held, size = TaskContext.get().partitionId(), [], 0
        for keys in keys_of(frames):
            held.append(keys)
            size += len(keys)
            if size > 2_000_000:
                yield from _partition_rows(held, cells, part)
                held, size = [], 0
        if held:
            yield from _partition_rows(held, cells, part)

    def summed(rows: pd.DataFrame) -> pd.DataFrame:
        counts = _merged(rows)
        at = np.flatnonzero(counts)
        return pd.DataFrame({"slot": [rows["slot"].iloc[0]], "cell": [at.astype(np.uint16).tobytes()], "n": [np.minimum(counts[at], 2**32 - 1).astype(np.uint32).tobytes()]})

    def bits(rows: pd.DataFrame) -> pd.DataFrame:
        counts = _merged(rows)
        return pd.DataFrame({"slot": [rows["slot"].iloc[0]], "repeated": [np.packbits(counts >= 2, bitorder="little").tobytes()], "heavy": [np.packbits(counts >= heavy, bitorder="little").tobytes()]})

    sparse = docs.mapInArrow(partition, "slot long, part int, cell binary, n binary")
    level = sparse.groupBy("slot", F.floor(F.col("part") / 64)).applyInPandas(summed, "slot long, cell binary, n binary")
    merged = level.groupBy("slot").applyInPandas(bits, "slot long, repeated binary, heavy binary")
    repeated, heavies = (np.zeros(DEPTH * cells // 8, np.uint8) for _ in range(2))
    for slot, a, b in merged.toLocalIterator():
        at = slice(slot * SLOT // 8, (slot + 1) * SLOT // 8)
        repeated[at], heavies[at] = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    return Sketch(cells, repeated, heavies)
