"""Order-sensitive text similarity: twice the longest common subsequence over the sum of lengths."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType


class Pattern:
    """A text to be compared with many: its letters' places, once. A row of the table of longest common subsequences is
    one number with a bit for each of its characters; a character of the other text costs one addition, and the row after
    a text goes on with whatever follows that text."""

    def __init__(self, text: str) -> None:
        self.text = text
        self.places: dict[str, int] = {}
        for i, c in enumerate(text):
            self.places[c] = self.places.get(c, 0) | 1 << i
        self.start = (1 << len(text)) - 1

    def after(self, row: int, text: str) -> int:
        ones = self.start
        for places in map(self.places.get, text):
            if places:
                hit = row & places
                row = (row + hit | row ^ hit) & ones
        return row

    def common(self, row: int) -> int:
        """Length of a longest common subsequence with the text that led to the row."""
        return len(self.text) - row.bit_count()


#: Bits between the texts of a pack.
SPARE = 8


class Pack:
    """Many texts to be compared with one text after the other: the rows of all their tables are one number, in which each
    text has whole bytes and at least SPARE bits behind its own that take up the additions' carries: a carry sets the lowest
    of them that is not set yet, so they are cleared once in SPARE steps."""

    def __init__(self, texts: list[str]) -> None:
        self.lengths = np.array([len(t) for t in texts], dtype=np.int64)
        taken = (self.lengths + SPARE + 7) // 8
        ends = np.cumsum(taken)
        self.begins, self.size = ends - taken, int(ends[-1])
        codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        codes = codes.astype(np.uint16) if not len(codes) or codes.max() < 1 << 16 else codes  # sorted by counting
        at = np.arange(len(codes), dtype=np.int32) + np.repeat((self.begins * 8 - (np.cumsum(self.lengths) - self.lengths)).astype(np.int32), self.lengths)
        order = np.argsort(codes, kind="stable")
        codes, at = codes[order], at[order]
        new = np.ones(len(codes), dtype=bool)
        new[1:] = codes[1:] != codes[:-1]
        letters, nth = codes[new], np.cumsum(new) - 1
        byte = at >> 3
        new[1:] |= byte[1:] != byte[:-1]
        cells = np.zeros((len(letters), self.size), dtype=np.uint8)
        if len(codes):
            cells[nth[new], byte[new]] = np.bitwise_or.reduceat(np.left_shift(np.uint8(1), (at & 7).astype(np.uint8)), np.flatnonzero(new))
        self.places = {chr(c): int.from_bytes(x.tobytes(), "little") for c, x in zip(letters.tolist(), cells, strict=True)}
        self.start = int.from_bytes(np.bitwise_or.reduce(cells, axis=0).tobytes(), "little")

    def common(self, text: str) -> np.ndarray:
        """Length of a longest common subsequence of the text and each of the pack's."""
        row = ones = self.start
        met = [places for places in map(self.places.get, text) if places]
        for at in range(0, len(met), SPARE):
            for places in met[at : at + SPARE]:
                hit = row & places
                row = row + hit | row ^ hit
            row &= ones
        left = np.bitwise_count(np.frombuffer(row.to_bytes(self.size, "little"), dtype=np.uint8))
        return self.lengths - np.add.reduceat(left, self.begins, dtype=np.int64)


#: Characters of a pack: beyond some thousand its numbers leave the processor's nearest cache.
PACKED = 100_000


def _packs(texts: list[str]) -> Iterator[tuple[int, int, Pack]]:
    """Packs of texts with the places of their first text and of the one after their last."""
    at = 0
    while at < len(texts):
        end, n = at + 1, len(texts[at])
        while end < len(texts) and n + len(texts[end]) <= PACKED:
            n, end = n + len(texts[end]), end + 1
        yield at, end, Pack(texts[at:end])
        at = end


class Packed(list):
    """Texts whose packs are made once, for several calls of commons."""

    def __init__(self, texts: list[str]) -> None:
        super().__init__(texts)
        self.packs = list(_packs(texts))


def commons(ones: list[str], many: list[str]) -> np.ndarray:
    """Lengths of longest common subsequences: a row for each of `ones`, a column for each of `many`."""
    ready = isinstance(many, Packed)
    if not ready and sum(map(len, ones)) > sum(map(len, many)):
        return commons(many, ones).T  # a step of the search is dear where the pack is small
    out = np.zeros((len(ones), len(many)), dtype=np.int32)
    for at, end, pack in many.packs if ready else _packs(many):
        for i, one in enumerate(ones):
            out[i, at:end] = pack.common(one)
    return out


def common_length(a: str, b: str) -> int:
    """Length of a longest common subsequence."""
    if len(a) < len(b):
        a, b = b, a
    pattern = Pattern(a)
    return pattern.common(pattern.after(pattern.start, b))


def ratio(a: str, b: str) -> float:
    """0 to 1; 1 for two empty texts."""
    if not a and not b:
        return 1.0
    if a == b:
        return 1.0
    start = 0
    for x, y in zip(a, b, strict=False):
        if x != y:
            break
        start += 1
    end, most = 0, min(len(a), len(b)) - start
    while end < most and a[-1 - end] == b[-1 - end]:
        end += 1
    return 2 * (start + end + common_length(a[start : len(a) - end], b[start : len(b) - end])) / (len(a) + len(b))


def ratio_with(pattern: Pattern, b: str, ends: int = 12) -> float:
    """ratio(pattern.text, b). Texts that begin or end alike are cut there first, the others share the pattern."""
    a = pattern.text
    if not a or not b or a[:ends] == b[:ends] or a[-ends:] == b[-ends:]:
        return ratio(a, b)
    return 2 * pattern.common(pattern.after(pattern.start, b)) / (len(a) + len(b))


def similarity(a: str, b: str) -> float:
    """ratio to four places, as the block metrics report it."""
    return round(ratio(a, b), 4)


def may_reach(a: str, b: str, threshold: float) -> bool:
    """False only where the lengths alone keep ratio(a, b) below the threshold."""
    return 2 * min(len(a), len(b)) >= threshold * (len(a) + len(b)) - 1e-9


@pandas_udf(DoubleType())
def _ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else ratio(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


def similarity_ratio(a: Column, b: Column) -> Column:
    return _ratio(a, b)
