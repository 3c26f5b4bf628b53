import random
from itertools import combinations

from stemmata.plans import pairs


def rows_of(docs):
    return [(d, i, t) for d, lines in docs.items() for i, t in enumerate(lines)]


def brute_force(docs):
    """The earlier document of most different shared lines, of equal ones the first, over all pairs."""
    best = {}
    for a, b in combinations(sorted(docs), 2):
        n = len(set(docs[a]) & set(docs[b]))
        if n > best.get(b, (0, 0))[0]:
            best[b] = (n, a)
    return sorted((a, b, n) for b, (n, a) in best.items())


def found(spark, docs, **options):
    rows = spark.createDataFrame(rows_of(docs), "doc_id long, block_index int, text string")
    return sorted((r.a_doc_id, r.b_doc_id, r.shared) for r in pairs.sharing_pairs(rows, **options).collect())


def test_a_large_group_of_copies_is_paired(spark):
    copies = {i: ["one", "two", "three"] for i in range(100, 130)}
    near = {i: [f"near {j}" if j != i % 7 else f"own {i}" for j in range(7)] for i in range(200, 240)}
    docs = copies | near | {1: ["one", "two", "three", "four"], 2: ["alone"], 3: ["two", "two"], 150: ["four", "near 1"]}
    got = found(spark, docs)
    assert got == brute_force(docs)
    assert (1, 129, 3) in got and len(got) == len(docs) - 2


def test_pairs_equal_brute_force_on_common_lines(spark, monkeypatch):
    draw = random.Random(7)
    for cell, common in ((100, 10), (3, 2)):
        monkeypatch.setattr(pairs, "CELL", cell)
        docs = {i: [f"hot {draw.randrange(6)}" for _ in range(draw.randrange(5))] + [f"rare {draw.randrange(40)}" for _ in range(draw.randrange(3))] for i in range(120)}
        assert found(spark, docs, common=common) == brute_force(docs)
