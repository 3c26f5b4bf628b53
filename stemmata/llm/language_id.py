"""Language ID with interpolated Kneser-Ney character models in sorted hash arrays.

A text becomes lower-case letters with single spaces between words. For each language the model holds, for orders 1 to
ORDER, sorted 64-bit hashes of the seen n-grams with their interpolated probabilities, and of the seen contexts with
their back-off weights. The lowest orders count continuations, as Kneser and Ney have it. A text's language is the one
with the lowest cross-entropy per character; `rejected` marks texts whose cross-entropy lies beyond what calibration
rows of that language show, scaled with the square root of the length.

Training reads only text and non-null lang of documents whose crc32(doc_id) mod 5 is not 0, from which it takes by hash
about TRAIN_CHARS characters a language (1 of 4 of these for calibration). This is the classifier's only sample. Every
whole text is scored.

Defined results: null texts and texts without letters (marks alone are none) are `und` with score 0 and rejected; without any training row all
are `und`; a null doc_id counts as held out; repeated rows are each returned; ties between languages go to the first in
code-point order; other columns are ignored.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BASES, batches, mix

ORDER = 5
TRAIN_CHARS = 3_000_000
SPACE, EDGE = 32, 1
#: Stands between texts; a noncharacter.
BREAK = chr(0x10FFFF)
#: Rejection: share of calibration rows under the bound, and the factor beyond it.
QUANTILE, MARGIN = 0.999, 1.5
LONGEST = 400
#: Bytes of text scored at once; the arrays for it take some 60 times as much.
BATCH = 2_000_000
SHARPNESS = 40
UNKNOWN = "und"
RESULT = "doc_id long, held_out boolean, lang_pred string, score double, cross_entropy double, rejected boolean"


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Code point -> lower-case letter or mark, else a space."""
    table = np.full(0x110000, SPACE, np.uint32)
    for c in range(0x110000):
        x = chr(c)
        if x.isalpha() or unicodedata.category(x)[0] == "M":
            low = x.lower()
            table[c] = ord(low) if len(low) == 1 else c
    table[ord(BREAK)] = EDGE
    return table


@lru_cache(maxsize=1)
def _alphabetic() -> np.ndarray:
    """Whether a code point is a letter; marks alone are none."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def _chars(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The texts' letters and spaces end to end, ORDER - 1 edges before each, and each one's text."""
    gap = BREAK * (ORDER - 1)
    joined = gap + gap.join(t or "" for t in texts)
    codes = _letters()[np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)]
    owner = np.repeat(np.arange(len(texts)), [len(t or "") + ORDER - 1 for t in texts])
    keep = np.ones(len(codes), bool)
    keep[1:] = (codes[1:] != SPACE) | (codes[:-1] != SPACE)
    return codes[keep], owner[keep]


def _hashes(grams: np.ndarray) -> np.ndarray:
    """Hashes of rows of characters, any order."""
    h = np.zeros(len(grams), np.uint64)
    for j in range(grams.shape[1]):
        h = h * BASES[0] + grams[:, j].astype(np.uint64) + np.uint64(1)
    return mix(h)


def _grams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Different n-grams of the highest order, each occurrence's n-gram, and its text."""
    codes, owner = _chars(texts)
    at = np.flatnonzero(codes[ORDER - 1 :] != EDGE) + ORDER - 1
    if not len(at):
        return np.zeros((0, ORDER), np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)
    wide = codes.astype(np.uint64) + np.uint64(1)
    h = np.zeros(len(at), np.uint64)
    for j in range(ORDER):
        h = h * BASES[0] + wide[at - ORDER + 1 + j]
    which, _ = pd.factorize(h)
    first = np.empty(which.max() + 1, np.int64)
    first[which[::-1]] = at[::-1]
    return codes[first[:, None] + np.arange(1 - ORDER, 1)], which, owner[at]


class Model:
    """One language: per order, sorted n-gram hashes with probabilities and sorted context hashes with weights."""

    def __init__(self, grams: np.ndarray, counts: np.ndarray) -> None:
        self.orders: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        tables = [(grams, counts.astype(np.float64))]
        while tables[0][0].shape[1] > 1:  # continuation counts of the shorter n-grams
            shorter = tables[0][0][:, 1:]
            _, first, n = np.unique(_hashes(shorter), return_index=True, return_counts=True)
            tables.insert(0, (shorter[first], n.astype(np.float64)))
        for chars, n in tables:
            ones, twos = (n == 1).sum(), (n == 2).sum()
            discount = ones / (ones + 2 * twos) if ones and twos else 0.5
            _, context = np.unique(_hashes(chars[:, :-1]), return_inverse=True)
            total = np.bincount(context, n)
            weight = discount * np.bincount(context) / total
            lower = self._probability(chars[:, 1:]) if chars.shape[1] > 1 else np.full(len(chars), 1.0 / 2**16)
            p = (n - discount) / total[context] + weight[context] * lower
            self.orders.append(self._sorted(_hashes(chars), p) + self._sorted(*self._firsts(_hashes(chars[:, :-1]), weight[context])))

    @staticmethod
    def _firsts(h: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        u, first = np.unique(h, return_index=True)
        return u, v[first]

    @staticmethod
    def _sorted(h: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.argsort(h)
        return h[order], v[order]

    @staticmethod
    def _lookup(keys: np.ndarray, values: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
        return keys[at] == h, values[at]

    def _probability(self, chars: np.ndarray) -> np.ndarray:
        """P(last | the rest): the stored one, or the context's weight times that of the shorter n-gram."""
        order = chars.shape[1]
        if order == 0:
            return np.full(len(chars), 1.0 / 2**16)
        grams, p, contexts, weights = self.orders[order - 1]
        seen, out = self._lookup(grams, p, _hashes(chars))
        if not seen.all():
            rest = chars[~seen]
            known, weight = self._lookup(contexts, weights, _hashes(rest[:, :-1]))
            out = out.copy()
            out[~seen] = np.where(known, weight, 1.0) * self._probability(rest[:, 1:])
        return out

    def bits(self, chars: np.ndarray) -> np.ndarray:
        return -np.log2(self._probability(chars))


def _entropies(models: list[Model], texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Cross-entropy per character by text and language, and the number of characters."""
    grams, which, owner = _grams(texts)
    n = np.bincount(owner, minlength=len(texts))
    # Neither spaces nor marks are letters.
    letters = np.bincount(owner, _alphabetic()[grams[:, -1]][which], len(texts)) if len(which) else np.zeros(len(texts))
    out = np.column_stack([np.bincount(owner, m.bits(grams)[which], len(texts)) / np.maximum(n, 1) for m in models])
    return out, np.where(letters > 0, n, 0)


class Identifier:
    """Languages, their models, and the rejection bounds (mean, spread)."""

    def __init__(self, languages: list[str], models: list[Model]) -> None:
        self.languages, self.models = languages, models
        self.bounds = np.zeros((len(languages), 2))

    def calibrate(self, rows: dict[str, tuple[np.ndarray, np.ndarray]]) -> None:
        for i, lang in enumerate(self.languages):
            h, n = rows.get(lang, (np.zeros(0), np.zeros(0)))
            if len(h):
                mean = np.average(h, weights=n)
                self.bounds[i] = mean, MARGIN * np.quantile(np.maximum(0, h - mean) * np.sqrt(np.minimum(n, LONGEST)), QUANTILE) + 1.0
            else:
                self.bounds[i] = np.inf, 0

    def identify(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Language, score, cross-entropy, rejected."""
        if not self.models:
            n = len(texts)
            return [UNKNOWN] * n, np.zeros(n), np.zeros(n), np.ones(n, bool)
        h, n = _entropies(self.models, texts)
        best = h.argmin(1)
        least = h[np.arange(len(h)), best]
        score = 1.0 / np.exp2(-(h - least[:, None]) * np.minimum(n, SHARPNESS)[:, None]).sum(1)
        mean, spread = self.bounds[best].T
        rejected = (n == 0) | ((least - mean) * np.sqrt(np.minimum(n, LONGEST)) > spread)
        return [self.languages[b] if k else UNKNOWN for b, k in zip(best, n, strict=True)], np.where(n, score, 0.0), np.where(n, least, 0.0), rejected


def _fold(doc_id):
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))


def train(documents: DataFrame, train_chars: int = TRAIN_CHARS) -> Identifier:
    """Models and bounds from a sample by hash of the learnable rows."""
    rows = documents.select(F.col("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    rows = rows.filter((_fold(F.col("doc_id")) % 5 != 0) & F.col("text").rlike("\\p{L}") & F.col("lang").isNotNull())
    shares = rows.groupBy("lang").agg(F.sum(F.length("text")).alias("chars")).select(F.col("lang").alias("s_lang"), (F.lit(float(train_chars)) / F.col("chars")).alias("share"))
    chance = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1_000_000)) / 1e6
    # A row a language, as the models on the driver: few enough to broadcast.
    some = rows.join(F.broadcast(shares), F.col("lang") == F.col("s_lang")).filter(chance < F.col("share")).select("text", "lang", F.when(F.pmod(F.xxhash64("text", "doc_id"), F.lit(4)) == 0, 1).otherwise(0).alias("fold"))

    def counted(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(frames, BATCH):
            texts, langs = batch.column("text").to_pylist(), np.array(batch.column("lang").to_pylist(), object)
            fold = batch.column("fold").to_numpy()
            for lang in set(langs[fold == 0].tolist()):
                grams, which, _ = _grams([t for t, x, f in zip(texts, langs, fold, strict=True) if x == lang and f == 0])
                yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([grams.tobytes()], pa.binary()), pa.array([np.bincount(which, minlength=len(grams)).astype(np.int64).tobytes()], pa.binary())], names=["lang", "grams", "n"])

    def summed(pdf: pd.DataFrame) -> pd.DataFrame:
        grams = np.frombuffer(b"".join(pdf["grams"]), np.uint32).reshape(-1, ORDER)
        n = np.frombuffer(b"".join(pdf["n"]), np.int64)
        _, first, which = np.unique(_hashes(grams), return_index=True, return_inverse=True)
        return pd.DataFrame({"lang": pdf["lang"].iloc[:1], "grams": [grams[first].tobytes()], "n": [np.bincount(which, n).astype(np.int64).tobytes()]})

    tables = some.mapInArrow(counted, "lang string, grams binary, n binary").groupBy("lang").applyInPandas(summed, "lang string, grams binary, n binary").collect()
    tables = sorted((r for r in tables if len(r["n"])), key=lambda r: r["lang"])
    found = Identifier([r["lang"] for r in tables], [Model(np.frombuffer(r["grams"], np.uint32).reshape(-1, ORDER), np.frombuffer(r["n"], np.int64)) for r in tables])
    shared = documents.sparkSession.sparkContext.broadcast(found)

    def measured(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches(frames, BATCH):
            langs = batch.column("lang").to_pylist()
            h, n = _entropies(own.models, batch.column("text").to_pylist())
            good = [i for i, (x, k) in enumerate(zip(langs, n, strict=True)) if k and x in own.languages]
            yield pa.RecordBatch.from_arrays([pa.array([langs[i] for i in good], pa.string()), pa.array([h[i, own.languages.index(langs[i])] for i in good], pa.float64()), pa.array([int(n[i]) for i in good], pa.int64())], names=["lang", "h", "n"])

    if found.models:
        pdf = some.filter("fold = 1").mapInArrow(measured, "lang string, h double, n long").toPandas()
        found.calibrate({lang: (x["h"].to_numpy(), x["n"].to_numpy()) for lang, x in pdf.groupby("lang")})
    return found


def identify(documents: DataFrame, identifier: Identifier | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score, cross_entropy and rejected of every row."""
    shared = documents.sparkSession.sparkContext.broadcast(identifier or train(documents))
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), (_fold(F.col("doc_id")) % 5 == 0).alias("held_out"), F.col("text").cast("string").alias("text"))

    def predicted(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(frames, BATCH):
            lang, score, h, rejected = shared.value.identify(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(lang, pa.string()), pa.array(score), pa.array(h), pa.array(rejected)], names=[f.split()[0] for f in RESULT.split(", ")])

    return docs.mapInArrow(predicted, RESULT)
