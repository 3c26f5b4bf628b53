"""Texts that one look finds tidy skip the passes of normalisation; these would leave them as they are."""

import random

from pyspark.sql import functions as F
from stemmata.functions import text as T

ODD = [" ", "  ", "\t", "\n", "\r", "\f", "\x07", "\x7f", "\x85", "\xa0", "\xad", "æ", "Æ", "œ", "ﬁ", "é", "é", "ß", "a", "b.", "Å", "字", "😀", " "]


def test_tidy_texts_are_left_alone(spark):
    draw = random.Random(3)
    texts = {"".join(draw.choice(ODD + [*"abcé "] * 8) for _ in range(draw.randrange(7))) for _ in range(3000)} | {"", " ", "plain words, only.", "deux étés"}
    frame = spark.createDataFrame([(t,) for t in sorted(texts)], "text string")
    passes = T.fold_ligatures(T.normalize_text(F.col("text")))
    rows = frame.select("text", T.is_tidy(F.col("text")).alias("tidy"), passes.alias("full"), T.strip(F.col("text")).alias("stripped"), F.regexp_replace("text", "(?U)^\\s+|\\s+$", "").alias("plain")).collect()
    assert all(r.text == r.full for r in rows if r.tidy) and sum(r.tidy for r in rows) > 100
    assert all(r.stripped == r.plain for r in rows)
    assert {"plain words, only.", "deux étés"} <= {r.text for r in rows if r.tidy}
