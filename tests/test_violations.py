import pytest
from pyspark.sql import functions as F
from stemmata.operators import alignment, collation

ONE, TWO = "The harbour lay quiet under a low sky.", "Nobody had come down to the boats since morning."
TEXTS = {1: ["Alpha opens the account.", "A steady line between.", f"{ONE} {TWO}", "Only here in the first."], 2: ["A steady line between.", "Alpha opens an account.", ONE, TWO, "New words in the second."]}


@pytest.fixture(scope="module")
def both(spark):
    rows = [(d, i, "PARAGRAPH", t, False, f"blk_a_{i:04d}") for d, texts in TEXTS.items() for i, t in enumerate(texts)]
    blocks = spark.createDataFrame(rows, "doc_id long, block_index int, kind string, text string, starts_stanza boolean, block_id string")
    sides = alignment.sides(spark.createDataFrame([("x", 1, 2)], "cmp_id string, a_doc_id long, b_doc_id long"), blocks).cache()
    return sides, collation.diff_blocks(sides, alignment.align(sides)).cache()


def rules(blocks, sides, metrics=None):
    return {r.rule for r in collation.violations(blocks, metrics or collation.document_metrics(blocks), sides).collect()}


def test_damage_to_either_side_is_seen(both):
    sides, blocks = both
    assert "SPLIT" in {r.status for r in blocks.collect()} and rules(blocks, sides) == set()
    edit = lambda column, change: blocks.withColumn(column, F.transform(column, lambda t: F.struct(change(t).alias("text"), t["status"].alias("status"))))
    lost = blocks.withColumn("tokens", F.filter("tokens", lambda t: t["status"] != "INSERTION"))
    assert "b_words" in rules(lost, sides)
    assert "a_words" in rules(edit("tokens", lambda t: F.replace(t["text"], F.lit(" "), F.lit(""))), sides)
    altered = edit("b_tokens", lambda t: F.replace(t["text"], F.lit("steady"), F.lit("other")))
    assert "b_text" in rules(altered, sides)
    assert {"a_text", "document_sums"} <= rules(blocks.filter("status <> 'DELETED'"), sides)
    wrong = collation.document_metrics(blocks).withColumn("unchanged_tokens", F.col("unchanged_tokens") + 1)
    assert rules(blocks, sides, wrong) == {"document_sums"}
