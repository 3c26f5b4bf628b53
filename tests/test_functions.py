import random

from hypothesis import given, settings
from hypothesis import strategies as st
from stemmata.functions.similarity import ratio, similarity
from stemmata.functions.worddiff import DELETE, EQUAL, INSERT, DiffOptions, diff_texts, distributed, for_readers, shortest_script, tokenize, words_in
from stemmata.operators.alignment import arrange, longest_increasing

TEXT = st.text(alphabet="ab c\n.A", max_size=60)


def common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(new[-1], row[j + 1]))
        row = new
    return row[-1]


@given(TEXT, TEXT)
@settings(max_examples=200, deadline=None)
def test_ratio_is_the_subsequence_share(a, b):
    expected = 2 * common(a, b) / (len(a) + len(b)) if a or b else 1.0
    assert abs(ratio(a, b) - expected) < 1e-12


@given(TEXT)
def test_tokens_join_to_the_text(text):
    assert "".join(tokenize(text)) == text
    assert all(t.strip() for t in tokenize(text)) or not text.strip()


@given(TEXT, TEXT)
@settings(max_examples=300, deadline=None)
def test_streams_carry_their_texts(a, b):
    unified, left, right = diff_texts(a, b)
    assert "".join(t for t, _ in left) == a and "".join(t for t, _ in right) == b
    assert all(s != INSERT for _, s in left) and all(s != DELETE for _, s in right)
    assert "".join(t for t, s in unified if s != INSERT).split() == a.split()
    assert "".join(t for t, s in unified if s != DELETE).split() == b.split()


def test_scripts_are_shortest_and_lossless():
    rng = random.Random(1)
    for _ in range(500):
        a, b = ([rng.randrange(1, 6) for _ in range(rng.randrange(12))] for _ in range(2))
        script = shortest_script(a, b)
        assert sum(len(r) for op, r in script if op == EQUAL) == common(a, b)
        for s in (script, for_readers(script)):
            assert [x for op, r in s if op != INSERT for x in r] == a and [x for op, r in s if op != DELETE for x in r] == b


def test_substitution_counts_words():
    unified, _, _ = diff_texts("the old grey house stood there", "the old green house stood there")
    assert (words_in(unified, INSERT), words_in(unified, DELETE), words_in(unified, EQUAL)) == (1, 1, 5)


def test_folding_compares_but_never_rewrites():
    unified, left, right = diff_texts("Stop, HERE now", "stop here now", DiffOptions(ignore_case=True, ignore_punctuation=True))
    assert unified == [("Stop, HERE now", EQUAL)] and right == [("stop here now", EQUAL)]


def test_distribution_cuts_by_length():
    assert distributed([("one two three four", EQUAL)], [8, 10], INSERT) == [[("one two ", EQUAL)], [("three four", EQUAL)]]


def test_longest_increasing():
    assert longest_increasing([2, 0, 1]) == [1, 2]
    assert longest_increasing([]) == []


def test_a_moved_block():
    rows = arrange([(0, 1), (1, 2), (2, 0)], [], {}, {}, DiffOptions())
    assert [(r["a_indices"], r["b_indices"], r["move_distance"]) for r in rows] == [([2], [0], -2), ([0], [1], None), ([1], [2], None)]
    assert all(r["move_distance"] is None for r in arrange([(0, 1), (1, 2), (2, 0)], [], {}, {}, DiffOptions(detect_moves=False)))


def test_split_and_merge():
    one, two = "The harbour lay quiet under a low sky.", "Nobody had come down to the boats since morning."
    for swap, relation in ((False, "SPLIT"), (True, "MERGED")):
        a, b = {0: f"{one} {two}"}, {0: one, 1: two}
        score = similarity(a[0], two)
        rows = arrange([], [(1, 0, score)] if swap else [(0, 1, score)], b if swap else a, a if swap else b, DiffOptions())
        assert [r["relation"] for r in rows] == [relation]
        rows = arrange([], [], b if swap else a, a if swap else b, DiffOptions())
        assert [r["relation"] for r in rows] == [relation]


def test_unrelated_blocks_are_inserted_then_deleted():
    rows = arrange([], [], {0: "aaaa bbbb"}, {0: "xxxx yyyy"}, DiffOptions())
    assert [r["relation"] for r in rows] == ["INSERTED", "DELETED"]
