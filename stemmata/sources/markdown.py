"""Markdown to block candidates, with windows over a document's lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The patterns of lines, and below in `plain` those of inline marks.
ATX = "^#{1,6}[ \\t]+(.+?)[ \\t#]*$"
UNDERLINE = "^[ \\t]*(=+|-+)[ \\t]*$"
QUOTE = "^[ \\t]*>[ \\t]?(.*)$"
ITEM = "^[ \\t]*(?:[-*+]|[0-9]+[.)])[ \\t]+(.+)$"
FENCE = "^[ \\t]*(```+|~~~+)"


def plain(text: Column) -> Column:
    """Without inline marks: images, links, code, strong, emphasis."""
    text = F.regexp_replace(text, "!\\[([^\\]]*)\\]\\([^)]+\\)", "$1")
    text = F.regexp_replace(text, "\\[([^\\]]+)\\]\\([^)]+\\)", "$1")
    text = F.regexp_replace(text, "`([^`]+)`", "$1")
    text = F.regexp_replace(text, "(\\*\\*|__)(.+?)\\1", "$2")
    return F.regexp_replace(text, "(?<!\\*)\\*([^*\\n]+)\\*(?!\\*)|(?<!_)_([^_\\n]+)_(?!_)", "$1$2")


def candidates(documents: DataFrame) -> DataFrame:
    """doc_id, cand, kind, text, style, page, stripped (inline marks were removed)."""
    lines = documents.select("doc_id", F.posexplode(F.split(F.regexp_replace(F.coalesce("text", F.lit("")), "\\r\\n?", "\n"), "\n")).alias("n", "line"))
    order = Window.partitionBy("doc_id").orderBy("n")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    fence = F.col("line").rlike(FENCE)
    lines = lines.withColumn("fence", fence).withColumn("inside", F.coalesce(F.sum(F.when(fence, 1).otherwise(0)).over(before), F.lit(0)) % 2 == 1)
    text_line = ~F.col("fence") & ~F.col("inside")
    lines = lines.withColumn("kind", F.when(F.col("fence"), "FENCE").when(F.col("inside"), "ARTIFACT").when(~F.col("line").rlike("(?U)\\S"), "BLANK").when(F.col("line").rlike(ATX), "HEADING"))
    # An underline makes a heading of the line above it, unless that line is an underline taken the same way: in a run of
    # lines that could be underlines, each second one is taken.
    under = F.col("line").rlike(UNDERLINE) & text_line
    lines = lines.withColumn("under", under)
    run = F.sum(F.when(F.col("under"), 0).otherwise(1)).over(order)
    lines = lines.withColumn("run", run)
    open_line = F.col("kind").isNull()
    first = Window.partitionBy("doc_id", "run").orderBy("n")
    nth = F.row_number().over(first)
    lines = lines.withColumn("nth", nth).withColumn("head_open", F.first(~F.col("under") & open_line).over(first))
    # nth counts from the line above the run where there is one (it is no underline), else from the run's first line.
    lines = lines.withColumn("taken", F.col("under") & F.when(F.col("head_open"), F.col("nth") % 2 == 0).otherwise((F.col("nth") % 2 == F.when(F.first(F.col("under")).over(first), 0).otherwise(1)) & (F.col("nth") > F.when(F.first(F.col("under")).over(first), 1).otherwise(2))))
    titled = F.coalesce(F.lead("taken").over(order), F.lit(False))
    lines = lines.withColumn("kind", F.when(F.col("taken"), "UNDERLINE").when(titled & open_line, "HEADING").otherwise(F.col("kind")))
    lines = lines.withColumn("kind", F.coalesce("kind", F.when(F.col("line").rlike(QUOTE), "QUOTE").when(F.col("line").rlike(ITEM), "LIST_ITEM").otherwise("PARAGRAPH")))
    body = (
        F.when((F.col("kind") == "HEADING") & F.col("line").rlike(ATX), F.regexp_extract("line", ATX, 1))
        .when(F.col("kind") == "QUOTE", F.regexp_extract("line", QUOTE, 1))
        .when(F.col("kind") == "LIST_ITEM", F.regexp_extract("line", ITEM, 1))
        .otherwise(F.col("line"))
    )
    lines = lines.withColumn("body", F.when(F.col("kind") == "ARTIFACT", F.col("line")).otherwise(F.regexp_replace(body, "(?U)^\\s+|\\s+$", "")))
    grows = F.col("kind").isin("PARAGRAPH", "ARTIFACT") & (F.lag("kind").over(order) == F.col("kind"))
    lines = lines.withColumn("block", F.sum(F.when(F.coalesce(grows, F.lit(False)), 0).otherwise(1)).over(order))
    kept = lines.filter(~F.col("kind").isin("FENCE", "BLANK", "UNDERLINE"))
    joined = kept.groupBy("doc_id", "block").agg(F.min("n").alias("cand"), F.first("kind").alias("kind"), F.array_sort(F.collect_list(F.struct("n", "body"))).alias("parts"))
    raw = F.array_join(F.transform("parts", lambda p: p["body"]), "\n")
    text = F.when(F.col("kind") == "ARTIFACT", raw).otherwise(plain(raw))
    return joined.select("doc_id", "cand", "kind", text.alias("text"), F.lit(None).cast("string").alias("style"), F.lit(None).cast("int").alias("page"), (text != raw).alias("stripped"))
