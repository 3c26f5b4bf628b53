"""Positioned lines to block candidates: bands, repeated heads, leading, gaps.

lines: doc_id, page (from 1), line_no (order in the document), top, page_height, text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BAND, GAP = 0.09, 1.6
MOST_PAGES, SAMPLED, LEAST_CHARS = 5000, 8, 8
ENDS = (".", "!", "?", '"', "”", "’", "'")


def band(top: Column, height: Column) -> Column:
    return F.when(height <= 0, "body").when(top / height <= BAND, "header").when(top / height >= 1 - BAND, "footer").otherwise("body")


def repeat_key(text: Column) -> Column:
    return F.lower(F.regexp_replace(F.regexp_replace(text, "\\p{Nd}", "#"), "(?U)^\\s+|\\s+$", ""))


def artifacts(lines: DataFrame) -> DataFrame:
    """doc_id, key of head and foot lines that repeat on enough pages."""
    pages = lines.groupBy("doc_id").agg(F.max("page").alias("pages")).filter("pages >= 2")
    need = F.least(F.lit(3), F.greatest(F.lit(2), F.floor(F.col("pages") * 0.5)))
    edge = lines.filter((band(F.col("top"), F.col("page_height")) != "body") & F.col("text").rlike("(?U)\\S"))
    counted = edge.groupBy("doc_id", repeat_key(F.col("text")).alias("key")).agg(F.countDistinct("page").alias("n"))
    return counted.join(pages, "doc_id").filter(F.col("n") >= need).select("doc_id", "key")


def leading(lines: DataFrame) -> DataFrame:
    """doc_id, leading: the most frequent step between lines of a page (of equal ones the first), or the least step."""
    order = Window.partitionBy("doc_id").orderBy("line_no")
    step = F.when(F.lag("page").over(order) == F.col("page"), F.bround(F.col("top") - F.lag("top").over(order), 1))
    steps = lines.select("doc_id", "line_no", step.alias("step")).filter("step > 0 OR step IS NULL")
    counted = steps.filter("step IS NOT NULL").groupBy("doc_id", "step").agg(F.count("*").alias("n"), F.min("line_no").alias("first"))
    best = counted.groupBy("doc_id").agg(F.max("n").alias("n"), F.max_by("step", F.struct("n", -F.col("first"))).alias("mode"), F.min("step").alias("least"))
    return best.select("doc_id", F.when(F.col("n") > 1, F.col("mode")).otherwise(F.col("least")).alias("leading"))


def candidates(lines: DataFrame) -> DataFrame:
    """doc_id, cand, kind, text, style, page: lines grouped by gaps; repeated heads stand alone as artifacts."""
    order = Window.partitionBy("doc_id").orderBy("line_no")
    marks = artifacts(lines).withColumn("artifact", F.lit(True))
    rows = lines.withColumn("key", repeat_key(F.col("text"))).join(marks, ["doc_id", "key"], "left").join(leading(lines), "doc_id", "left")
    rows = rows.withColumn("artifact", F.coalesce("artifact", F.lit(False)))
    lag = lambda c: F.lag(c).over(order)
    turned = F.col("page") != lag("page")
    ended = F.regexp_replace(lag("text"), "(?U)\\s+$", "").rlike("[" + "".join("\\" + c for c in ENDS) + "]$")
    apart = ~turned & (F.coalesce(F.col("leading"), F.lit(0.0)) > 0) & (F.col("top") - lag("top") > F.col("leading") * GAP)
    breaks = lag("page").isNull() | F.col("artifact") | lag("artifact") | apart | (turned & ended)
    rows = rows.withColumn("block", F.sum(F.when(breaks, 1).otherwise(0)).over(order))
    joined = rows.groupBy("doc_id", "block").agg(F.min("line_no").alias("cand"), F.first("artifact").alias("artifact"), F.min("page").alias("page"), F.array_sort(F.collect_list(F.struct("line_no", "text"))).alias("parts"))
    return joined.select("doc_id", "cand", F.when(F.col("artifact"), "ARTIFACT").otherwise("PARAGRAPH").alias("kind"), F.array_join(F.transform("parts", lambda p: p["text"]), "\n").alias("text"), F.lit(None).cast("string").alias("style"), F.col("page").cast("int").alias("page"))


def refused(lines: DataFrame, found: DataFrame) -> DataFrame:
    """doc_id, error: too many pages, or so few characters that the pages are scans."""
    pages = lines.groupBy("doc_id").agg(F.max("page").alias("pages"))
    chars = found.groupBy("doc_id").agg(F.sum(F.length("text")).alias("chars"))
    scan = F.coalesce("chars", F.lit(0)) / F.least(F.col("pages"), F.lit(SAMPLED)) < LEAST_CHARS
    error = F.when(F.col("pages") > MOST_PAGES, "MALFORMED_DOCUMENT").when(scan, "OCR_REQUIRED")
    return pages.join(chars, "doc_id", "left").select("doc_id", error.alias("error")).filter("error IS NOT NULL")


def multi_column(chars: DataFrame) -> DataFrame:
    """chars: doc_id, page, x0, page_width. doc_id, page whose characters stand in two columns."""
    middle = F.col("page_width") / 2
    sides = chars.groupBy("doc_id", "page").agg(F.count_if(F.col("x0") < middle * 0.9).alias("l"), F.count_if(F.col("x0") > middle * 1.1).alias("r"), F.count("*").alias("n"))
    balance = F.least("l", "r") / F.greatest("l", "r", F.lit(1))
    return sides.filter((F.col("l") > 0) & (F.col("r") > 0) & (balance > 0.5) & (F.col("n") - F.col("l") - F.col("r") < F.col("n") * 0.02)).select("doc_id", "page")


def page_text_candidates(pages: DataFrame) -> DataFrame:
    """The fallback: pages (doc_id, page, text) split at blank lines."""
    parts = F.posexplode(F.filter(F.transform(F.split("text", "\\n\\n"), lambda t: F.regexp_replace(t, "(?U)^\\s+|\\s+$", "")), lambda t: t != ""))
    rows = pages.select("doc_id", "page", parts.alias("part", "text"))
    order = Window.partitionBy("doc_id").orderBy("page", "part")
    return rows.select("doc_id", F.row_number().over(order).alias("cand"), F.lit("PARAGRAPH").alias("kind"), "text", F.lit(None).cast("string").alias("style"), F.col("page").cast("int").alias("page"))
