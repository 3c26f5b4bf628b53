"""A comparison's whole result as one JSON value: summaries, blocks, metrics and options.

comparisons: cmp_id, created_at, expires_at, a_doc_id, b_doc_id. documents: doc_id, title, source_format, parser_name,
parser_version, and optionally warnings (array of strings). A comparison's blocks meet in one aggregation; what is over
the window (views.windowed) is cut to its first page, so a value is bounded.
"""

from __future__ import annotations

from dataclasses import asdict

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.worddiff import DiffOptions
from . import views

STAMP = "yyyy-MM-dd'T'HH:mm:ss'Z'"
OPTIONS = ("granularity", "detect_moves", "align_threshold", "move_threshold", "ignore_case", "ignore_punctuation", "normalize_whitespace")
BLOCK_METRICS = ("similarity", "edit_count", "insertions", "deletions", "churn")
METRICS = ("similarity", "edit_count", "insertions", "deletions", "unchanged_tokens", "churn", "blocks_moved", "blocks_split", "blocks_merged", "stanza_breaks_changed", "a_word_count", "b_word_count")
BLOCK = ("status", "kind", "a_index", "b_index", "a_block_id", "b_block_id", "tokens", "a_tokens", "b_tokens")


def summaries(documents: DataFrame, metadata: DataFrame) -> DataFrame:
    """doc_id and summary: what a result says of a witness."""
    null = lambda kind, name: F.lit(None).cast(kind).alias(name)
    facts = F.struct("word_count", "block_count", "char_count", null("string", "detected_language"), "parser_name", "parser_version", null("double", "ocr_confidence"))
    warnings = F.col("warnings") if "warnings" in documents.columns else F.array().cast("array<string>")
    summary = F.struct(F.col("doc_id").cast("string").alias("id"), "title", "source_format", facts.alias("metadata"), warnings.alias("warnings"))
    return documents.join(metadata, "doc_id").select("doc_id", summary.alias("summary"))


def payloads(blocks: DataFrame, metrics: DataFrame, comparisons: DataFrame, witnesses: DataFrame, options: DiffOptions | None = None) -> DataFrame:
    """cmp_id, payload (JSON, null fields included) of every comparison; one without blocks has an empty list."""
    chosen = asdict(options or DiffOptions())
    shown = views.windowed(blocks)
    block = F.struct(F.col("block_id").alias("id"), *BLOCK, F.struct(*BLOCK_METRICS).alias("metrics"), "move_distance", "group_id", "stanza_boundary")
    listed = shown.groupBy("cmp_id").agg(F.array_sort(F.collect_list(F.struct("seq", block.alias("block")))).alias("listed"), F.first("truncated").alias("truncated"), F.first("total_blocks").alias("total_blocks"))
    listed = listed.select("cmp_id", F.transform("listed", lambda x: x["block"]).alias("blocks"), "truncated", "total_blocks")
    sums = metrics.select("cmp_id", F.struct(*METRICS).alias("metrics"))
    side = lambda s: witnesses.select(F.col("doc_id").alias(f"{s}_doc_id"), F.col("summary").alias(s))
    rows = comparisons.join(side("a"), "a_doc_id").join(side("b"), "b_doc_id").join(listed, "cmp_id", "left").join(sums, "cmp_id", "left")
    value = F.struct(
        F.col("cmp_id").alias("comparison_id"), F.date_format("created_at", STAMP).alias("created_at"), F.date_format("expires_at", STAMP).alias("expires_at"), "a", "b",
        F.coalesce("blocks", F.array()).alias("blocks"), "metrics", F.struct(*(F.lit(chosen[o]).alias(o) for o in OPTIONS)).alias("options"),
        F.coalesce("truncated", F.lit(False)).alias("truncated"), F.coalesce("total_blocks", F.lit(0)).alias("total_blocks"),
    )
    return rows.select("cmp_id", F.to_json(value, {"ignoreNullFields": "false"}).alias("payload"))
