"""Candidates to blocks: normalisation, segmentation, verse, offsets, metadata and warnings, as one plan.

candidates: doc_id, cand (ordinal), kind, text, and optionally style and page. blocks: doc_id, block_index, block_id, kind,
text, style, page, char_start, char_end, starts_stanza. Texts stay where they are until the one exchange by doc_id for
offsets; a document's blocks are ordered there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from . import hyphens

KINDS = ("PARAGRAPH", "HEADING", "VERSE_LINE", "QUOTE", "LIST_ITEM", "ARTIFACT")
NEVER_REFLOWED = ("VERSE_LINE", "ARTIFACT")


def line_candidates(documents: DataFrame) -> DataFrame:
    """One paragraph candidate a line, as word-processor paragraphs arrive."""
    lines = F.posexplode(F.split(F.coalesce("text", F.lit("")), "\\n"))
    return documents.select("doc_id", lines.alias("cand", "text")).select("doc_id", "cand", F.lit("PARAGRAPH").alias("kind"), "text", F.lit(None).cast("string").alias("style"), F.lit(None).cast("int").alias("page"))


def text_candidates(documents: DataFrame) -> DataFrame:
    """One paragraph candidate a blank-line separated part of the normalised text, as plain text arrives."""
    parts = F.posexplode(T.split_blocks(T.normalize_text(F.coalesce("text", F.lit("")))))
    return documents.select("doc_id", parts.alias("cand", "text")).select("doc_id", "cand", F.lit("PARAGRAPH").alias("kind"), "text", F.lit(None).cast("string").alias("style"), F.lit(None).cast("int").alias("page"))


def block_candidates(blocks: DataFrame) -> DataFrame:
    """Blocks as candidates again: a stored document normalised anew keeps its kinds, styles and pages."""
    return blocks.select("doc_id", F.col("block_index").alias("cand"), "kind", "text", "style", "page")


def segment(candidates: DataFrame, reflow_lines: bool = False, compose: bool = True) -> DataFrame:
    """Normalised parts of each candidate, verse as one row a line: doc_id, cand, part, line, kind, text, style, page,
    starts_stanza, joined (hyphens closed up in the candidate)."""
    text = F.col("text")
    rows = candidates.withColumn("text", F.when(T.is_tidy(text), text).otherwise(T.fold_ligatures(T.normalize_text(text, compose))))
    rows = rows.withColumn("joined", F.lit(0))
    if reflow_lines:
        rows = hyphens.dehyphenate(rows, candidates)
        flowing = ~F.col("kind").isin(*NEVER_REFLOWED)
        rows = rows.withColumn("text", F.when(flowing, T.tidy_lines(T.reflow(F.col("text")))).otherwise(F.col("text")))
    parts = rows.select("doc_id", "cand", "kind", "style", "page", "joined", F.posexplode(T.split_blocks(F.col("text"))).alias("part", "text"))
    parts = parts.withColumn("verse", F.when(F.col("kind") == "PARAGRAPH", T.verse_lines(F.col("text"))))
    lines = F.posexplode(F.coalesce("verse", F.array("text")))
    out = parts.select("doc_id", "cand", "part", "kind", "style", "page", "joined", F.col("verse").isNotNull().alias("is_verse"), lines.alias("line", "text"))
    return out.select(
        "doc_id", "cand", "part", "line", F.when(F.col("is_verse"), "VERSE_LINE").otherwise(F.col("kind")).alias("kind"), "text", "style", "page",
        (F.col("is_verse") & (F.col("line") == 0)).alias("starts_stanza"), "joined",
    )


def number(segments: DataFrame, witness: str = "a") -> DataFrame:
    """Ordinals, ids and half-open character offsets into the blocks joined by blank lines."""
    order = Window.partitionBy("doc_id").orderBy("cand", "part", "line")
    index = F.row_number().over(order) - 1
    start = F.coalesce(F.sum(F.length("text") + 2).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("int")
    return segments.select(
        "doc_id", index.cast("int").alias("block_index"), F.format_string(f"blk_{witness}_%04d", index).alias("block_id"), "kind", "text", "style", "page",
        start.alias("char_start"), (start + F.length("text")).cast("int").alias("char_end"), "starts_stanza",
    )


def build_blocks(candidates: DataFrame, reflow_lines: bool = False, witness: str = "a", compose: bool = True) -> DataFrame:
    return number(segment(candidates, reflow_lines, compose), witness)


def metadata(blocks: DataFrame) -> DataFrame:
    """doc_id, word_count, block_count, char_count of the blocks joined by blank lines."""
    return blocks.groupBy("doc_id").agg(F.sum(T.word_count(F.col("text"))).alias("word_count"), F.count("*").alias("block_count"), (F.sum(F.length("text")) + 2 * (F.count("*") - 1)).alias("char_count"))


def warnings(candidates: DataFrame, segments: DataFrame) -> DataFrame:
    """doc_id, code, n: what normalisation changed, one row a document and code."""
    controls = candidates.groupBy("doc_id").agg(F.count_if(T.has_controls(F.col("text"))).alias("n")).filter("n > 0").select("doc_id", F.lit("CONTROL_CHARACTERS_REMOVED").alias("code"), F.lit(1).cast("long").alias("n"))
    first = (F.col("part") == 0) & (F.col("line") == 0)
    counts = segments.groupBy("doc_id").agg(F.sum(F.when(first, F.col("joined")).otherwise(0)).cast("long").alias("joins"), F.count_if(F.col("starts_stanza")).alias("passages"))
    joins = counts.filter("joins > 0").select("doc_id", F.lit("DEHYPHENATION_APPLIED").alias("code"), F.col("joins").alias("n"))
    verse = counts.filter("passages > 0").select("doc_id", F.lit("VERSE_SEGMENTED").alias("code"), F.col("passages").alias("n"))
    return controls.unionByName(joins).unionByName(verse)


def full_text(blocks: DataFrame) -> DataFrame:
    """doc_id and the blocks joined by blank lines."""
    ordered = F.array_sort(F.collect_list(F.struct("block_index", "text")))
    return blocks.groupBy("doc_id").agg(F.array_join(F.transform(ordered, lambda b: b["text"]), "\n\n").alias("full_text"))
