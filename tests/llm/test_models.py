"""The trained models against plain versions of themselves, and the recall of the bands."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from stemmata.llm import language_id, near_dedup, quality

TEXTS = ["a banana and a bandana", "an anagram, and another", "bananas and anagrams"]


class PlainKneserNey:
    """Interpolated Kneser-Ney with dictionaries: raw counts of the highest order, continuation counts below it."""

    def __init__(self, texts, order):
        self.counts = [Counter() for _ in range(order + 1)]
        for t in texts:
            chars = [chr(language_id.EDGE)] * (order - 1) + list(t)
            for i in range(order - 1, len(chars)):
                self.counts[order][tuple(chars[i - order + 1 : i + 1])] += 1
        for n in range(order - 1, 0, -1):
            for gram in self.counts[n + 1]:
                self.counts[n][gram[1:]] += 1

    def p(self, gram):
        if not gram:
            return 1 / 2**16
        counts = self.counts[len(gram)]
        ones, twos = (sum(c == k for c in counts.values()) for k in (1, 2))
        d = ones / (ones + 2 * twos) if ones and twos else 0.5
        follow = [c for g, c in counts.items() if g[:-1] == gram[:-1]]
        if not follow:
            return self.p(gram[1:])
        return max(0, counts.get(gram, 0) - d) / sum(follow) + d * len(follow) / sum(follow) * self.p(gram[1:])


def test_kneser_ney_is_the_plain_one():
    grams, which, _ = language_id._grams(TEXTS)
    model = language_id.Model(grams, np.bincount(which))
    clean = ["".join(c if c.isalpha() else " " for c in t).replace("  ", " ") for t in TEXTS]
    plain = PlainKneserNey(clean, language_id.ORDER)
    rng, edge = random.Random(1), chr(language_id.EDGE)
    tried = [tuple(g) for t in clean for chars in [edge * 4 + t] for g in (chars[i : i + 5] for i in range(len(chars) - 4))]
    tried += [tuple(rng.choice("abdgnrz ") for _ in range(5)) for _ in range(300)]
    got = model._probability(np.array([[ord(c) for c in g] for g in tried], np.uint32))
    assert np.allclose(got, [plain.p(g) for g in tried], rtol=1e-9)


def test_letters_of_all_planes():
    models = [language_id.Model(g, np.bincount(w)) for g, w, _ in [language_id._grams(TEXTS)]]
    found = language_id.Identifier(["en"], models)
    found.calibrate({})
    texts = ["́̂", chr(0x32100) * 5, "ét", "12 ٣", "\ud800", "z", None, ""]
    lang, score, _, _ = found.identify(texts)
    assert lang == ["und", "en", "en", "und", "und", "en", "und", "und"]
    assert [s > 0 for s in score] == [x == "en" for x in lang]


def test_rejection_bound():
    found = language_id.Identifier(["x"], [])
    h, n = np.array([2.0, 2.2, 1.8, 3.0]), np.array([100, 50, 900, 25])
    found.calibrate({"x": (h, n)})
    mean = (2.0 * 100 + 2.2 * 50 + 1.8 * 900 + 3.0 * 25) / 1075
    deviations = [max(0, a - mean) * math.sqrt(min(b, language_id.LONGEST)) for a, b in zip(h, n, strict=True)]
    assert np.allclose(found.bounds[0], [mean, language_id.MARGIN * np.quantile(deviations, language_id.QUANTILE) + 1.0])


def test_forest_scores_are_mean_path_lengths():
    rng = np.random.default_rng(4)
    rows = np.vstack([rng.normal(0, 1, (500, 3)), rng.integers(0, 2, (40, 3))])
    forest = quality.Forest(rows, trees=20, subsample=64)

    def length(tree, row, node=0, depth=0):
        feature, threshold, child, path = tree
        if child[node] < 0:
            assert path[node] >= depth
            return path[node]
        return length(tree, row, child[node] + int(row[feature[node]] > threshold[node]), depth + 1)

    c = lambda n: 0.0 if n <= 1 else 1.0 if n == 2 else 2 * (sum(1 / k for k in range(1, n))) - 2 * (n - 1) / n
    assert abs(quality.expected_path(64) - c(64)) < 0.02  # the formula takes the logarithm for the harmonic sum
    plain = [2 ** (-np.mean([length(t, r) for t in forest.trees]) / quality.expected_path(64)) for r in rows]
    assert np.allclose(forest.scores(rows), plain)
    # Leaves hold the rows of the subsample: their number gives each leaf's path length.
    feature, threshold, child, path = forest.trees[0]
    assert path.max() <= forest.depth + quality.expected_path(64) and (feature < 3).all()


@given(st.dictionaries(st.integers(0, quality.BINS), st.tuples(st.integers(0, 30), st.integers(0, 30)), max_size=12), st.sampled_from([0.0, 0.01, 0.2]))
@settings(max_examples=300, deadline=None)
def test_threshold_parts_best(bins, allowed):
    good, bad = (sum(x[i] for x in bins.values()) for i in (0, 1))
    best = (0.0, 1.1)
    for b in range(quality.BINS, -1, -1):
        g, n = (sum(x[i] for k, x in bins.items() if k >= b) for i in (0, 1))
        if good and bad and g <= allowed * good and n / bad - g / good > best[0] + 1e-15:
            best = (n / bad - g / good, b / quality.BINS)
    assert quality._threshold(bins, allowed) == pytest.approx(best[1])


def test_bands_find_similar_pairs():
    """Of 3,000 pairs at a weighted similarity of 0.8 to 0.9 none is missed (expected: under one in ten million), and about
    half of those at 0.35 meet, which the signatures' screen and the exact check then drop."""
    rng = np.random.default_rng(2)
    wide = near_dedup.REGISTERS // near_dedup.BANDS

    def met(target, pairs):
        keys, weights, owner, exact = [], [], [], []
        for i in range(pairs):
            k = rng.integers(0, 2**63, 60).astype(np.uint64)
            a = rng.integers(1, 4, 60).astype(float)
            b = a.copy()
            order = rng.permutation(60)
            for j in order:
                if np.minimum(a, b).sum() / np.maximum(a, b).sum() <= target:
                    break
                b[j] = 0
            if np.minimum(a, b).sum() / np.maximum(a, b).sum() < target - 1e-9:
                b[j if b[j] == 0 else order[0]] = 1.0
            exact.append(np.minimum(a, b).sum() / np.maximum(a, b).sum())
            keys += [k, k[b > 0]]
            weights += [a, b[b > 0]]
            owner += [np.full(60, 2 * i), np.full((b > 0).sum(), 2 * i + 1)]
        sig = near_dedup.signatures(np.concatenate(keys), np.concatenate(weights), np.concatenate(owner), 2 * pairs)
        same = (sig[::2] == sig[1::2]).reshape(pairs, near_dedup.BANDS, wide).all(2).any(1)
        return same, np.array(exact)

    for target in (0.8, 0.85, 0.9):
        same, exact = met(target, 1000)
        assert same[exact >= 0.8].all() and (exact >= 0.75).all()
    assert 0.2 < met(0.35, 300)[0].mean() < 0.7
