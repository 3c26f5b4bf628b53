"""Whole results of seven pairs of texts, from text to JSON."""

import datetime
import json

import pytest
from pyspark.sql import functions as F
from stemmata.operators import alignment, blocks, collation, payload, store

# The pairs' texts and the results expected for them. Runs are (status letter, text); a block is
# (status, a_index, b_index, group, (similarity, edits, insertions, deletions, churn), unified, a's and b's runs).
TRUTH = "It is a truth universally acknowledged, that a single man in possession of a good fortune, must be in want of a wife."
FEELINGS = "However little known the feelings or views of such a man may be on his first entering a neighbourhood, this truth is so well fixed in the minds of the surrounding families."
SHEPHERD = "The Lord is my shepherd; I shall not want. He maketh me to lie down in green pastures: he leadeth me beside the still waters."
BEGINNING, LIGHT = "In the beginning God created the heaven and the earth. ", "And God said, Let there be light: and there was light."
VOID = "And the earth was without form, and void; and darkness was upon the face of the deep. "
SUMMER, ROUGH = "Shall I compare thee to a summer's day? Thou art more lovely and more temperate. ", "Rough winds do shake the darling buds of May, and summer's lease hath all too short a date."
PROMISE = "The promise lingers in a quieter line. "
BEST, SPRING = "It was the best of times, it was the worst of times. ", "It was the spring of hope, it was the winter of despair."
AGES = "of times, it was the worst of times, it was the age of wisdom, it was the age of foolishness."
DANTES, SAILOR = "Dantès looked toward the harbour and whispered, “Mercédès will ", "The young sailor stood calm—almost radiant—as the Pharaon came home."
ZERO = (1.0, 0, 0, 0, 0.0)


def same(text):
    return [("U", text)]


CASES = {
    "identical": (
        f"{TRUTH}\n\n{FEELINGS}", f"{TRUTH}\n\n{FEELINGS}", ((55, 2, 291), (55, 2, 291)), (1.0, 0, 0, 0, 55, 0.0, 0, 55, 55),
        [("UNCHANGED", 0, 0, None, ZERO, same(TRUTH), same(TRUTH), same(TRUTH)), ("UNCHANGED", 1, 1, None, ZERO, same(FEELINGS), same(FEELINGS), same(FEELINGS))],
    ),
    "substitution": (
        f"It was the best {AGES}", f"It was the brightest {AGES}", ((24, 1, 109), (24, 1, 114)), (0.9583, 2, 1, 1, 23, 0.0417, 0, 24, 24),
        [("MODIFIED", 0, 0, None, (0.9776, 2, 1, 1, 0.0417), [("U", "It was the "), ("D", "best "), ("I", "brightest "), ("U", AGES)], [("U", "It was the "), ("D", "best "), ("U", AGES)], [("U", "It was the "), ("I", "brightest "), ("U", AGES)])],
    ),
    "insertion": (
        SUMMER + ROUGH, SUMMER + PROMISE + ROUGH, ((33, 1, 172), (40, 1, 211)), (0.9041, 7, 7, 0, 33, 0.0959, 0, 33, 40),
        [("MODIFIED", 0, 0, None, (0.8982, 7, 7, 0, 0.0959), [("U", SUMMER), ("I", PROMISE), ("U", ROUGH)], same(SUMMER + ROUGH), [("U", SUMMER), ("I", PROMISE), ("U", ROUGH)])],
    ),
    "deletion": (
        BEGINNING + VOID + LIGHT, BEGINNING + LIGHT, ((38, 1, 195), (21, 1, 109)), (0.7119, 17, 0, 17, 21, 0.2881, 0, 38, 21),
        [("MODIFIED", 0, 0, None, (0.7171, 17, 0, 17, 0.2881), [("U", BEGINNING), ("D", VOID), ("U", LIGHT)], [("U", BEGINNING), ("D", VOID), ("U", LIGHT)], same(BEGINNING + LIGHT))],
    ),
    "paragraph_split": (
        BEST + SPRING, f"{BEST.strip()}\n\n{SPRING}", ((24, 1, 109), (24, 2, 110)), (1.0, 0, 0, 0, 24, 0.0, 2, 24, 24),
        [("SPLIT", 0, 0, "grp_0001", ZERO, same(BEST), same(BEST), same(BEST)), ("SPLIT", 0, 1, "grp_0001", ZERO, same(SPRING), same(SPRING), same(SPRING))],
    ),
    "unicode": (
        f"{DANTES}rejoice.” {SAILOR}", f"{DANTES}smile.” {SAILOR}", ((20, 1, 141), (20, 1, 139)), (0.95, 2, 1, 1, 19, 0.05, 0, 20, 20),
        [("MODIFIED", 0, 0, None, (0.9714, 2, 1, 1, 0.05), [("U", DANTES), ("D", "rejoice.” "), ("I", "smile.” "), ("U", SAILOR)], [("U", DANTES), ("D", "rejoice.” "), ("U", SAILOR)], [("U", DANTES), ("I", "smile.” "), ("U", SAILOR)])],
    ),
    "unrelated": (
        TRUTH, SHEPHERD, ((23, 1, 117), (25, 1, 125)), (0.0, 48, 25, 23, 0, 1.0, 0, 23, 25),
        [("INSERTED", None, 0, None, (0.0, 25, 25, 0, 1.0), [("I", SHEPHERD)], [], [("I", SHEPHERD)]), ("DELETED", 0, None, None, (0.0, 23, 0, 23, 1.0), [("D", TRUTH)], [("D", TRUTH)], [])],
    ),
}
RUN = {"U": "UNCHANGED", "D": "DELETION", "I": "INSERTION"}


def expected(case):
    _, _, facts, sums, listed = CASES[case]
    witness = lambda s, f: {
        "id": f"doc_golden_{case}_{s}", "title": f"Golden {case} {s.upper()}", "source_format": "TXT", "warnings": [],
        "metadata": {"word_count": f[0], "block_count": f[1], "char_count": f[2], "detected_language": None, "parser_name": "plaintext", "parser_version": "1", "ocr_confidence": None},
    }
    runs = lambda tokens: [{"text": t, "status": RUN[s]} for s, t in tokens]
    block_id = lambda s, i: None if i is None else f"blk_{s}_{i:04d}"
    blocks_of = [
        {
            "id": f"dbk_{n:04d}", "status": status, "kind": "PARAGRAPH", "a_index": i, "b_index": j, "a_block_id": block_id("a", i), "b_block_id": block_id("b", j), "tokens": runs(t), "a_tokens": runs(x), "b_tokens": runs(y),
            "metrics": dict(zip(payload.BLOCK_METRICS, m, strict=True)), "move_distance": None, "group_id": group, "stanza_boundary": None,
        }
        for n, (status, i, j, group, m, t, x, y) in enumerate(listed, 1)
    ]
    s = sums
    return {
        "comparison_id": f"cmp_golden_{case}", "created_at": "2026-01-02T03:04:05Z", "expires_at": "2026-01-09T03:04:05Z", "a": witness("a", facts[0]), "b": witness("b", facts[1]), "blocks": blocks_of,
        "metrics": {"similarity": s[0], "edit_count": s[1], "insertions": s[2], "deletions": s[3], "unchanged_tokens": s[4], "churn": s[5], "blocks_moved": 0, "blocks_split": s[6], "blocks_merged": 0, "stanza_breaks_changed": 0, "a_word_count": s[7], "b_word_count": s[8]},
        "options": {"granularity": "WORD", "detect_moves": True, "align_threshold": 0.5, "move_threshold": 0.75, "ignore_case": False, "ignore_punctuation": False, "normalize_whitespace": True},
        "truncated": False, "total_blocks": len(listed),
    }


@pytest.fixture(scope="module")
def results(spark):
    side = lambda s, k: spark.createDataFrame([(f"doc_golden_{c}_{s}", x[k], f"Golden {c} {s.upper()}") for c, x in CASES.items()], "doc_id string, text string, title string")
    texts = {"a": side("a", 0), "b": side("b", 1)}
    built = blocks.build_blocks(blocks.text_candidates(texts["a"]), witness="a").unionByName(blocks.build_blocks(blocks.text_candidates(texts["b"]), witness="b"))
    pairs = spark.createDataFrame([(f"cmp_golden_{c}", f"doc_golden_{c}_a", f"doc_golden_{c}_b") for c in CASES], "cmp_id string, a_doc_id string, b_doc_id string")
    rows = alignment.sides(pairs, built)
    found = collation.diff_blocks(rows, alignment.align(rows)).cache()
    metrics = collation.document_metrics(found)
    documents = texts["a"].unionByName(texts["b"]).select("doc_id", "title", F.lit("TXT").alias("source_format"), F.lit("plaintext").alias("parser_name"), F.lit("1").alias("parser_version"))
    stored = store.with_expiry(pairs, F.lit(datetime.datetime(2026, 1, 2, 3, 4, 5, tzinfo=datetime.UTC)).cast("timestamp"))
    rows_out = payload.payloads(found, metrics, stored, payload.summaries(documents, blocks.metadata(built))).collect()
    assert collation.violations(found, metrics, rows).count() == 0
    return {r.cmp_id: json.loads(r.payload) for r in rows_out}


@pytest.mark.parametrize("case", CASES)
def test_whole_result(results, case):
    assert results[f"cmp_golden_{case}"] == expected(case)


def test_a_comparison_without_blocks(spark, results):
    none = spark.createDataFrame([], "doc_id string, block_index int, kind string, text string, starts_stanza boolean, block_id string")
    rows = alignment.sides(spark.createDataFrame([("c", "x", "y")], "cmp_id string, a_doc_id string, b_doc_id string"), none)
    assert collation.diff_blocks(rows, alignment.align(rows)).count() == 0
