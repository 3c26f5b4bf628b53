"""Stored documents and comparisons: upserts, expiry, sweeps, admission and listings, on plain tables.

documents: doc_id, created_at, expires_at, ...; comparisons: cmp_id, a_doc_id, b_doc_id, created_at, expires_at, status,
message. Tables are partitioned by expiry day, so reads and sweeps prune files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

TTL_DAYS = 7
INLINE_BLOCKS, INLINE_WORDS = 4000, 220_000
MOST_BLOCKS, MOST_WORDS = 12_000, 700_000

# Error codes and their HTTP status.
ERRORS = {
    "UNSUPPORTED_FORMAT": 415, "FILE_TOO_LARGE": 413, "EMPTY_DOCUMENT": 422, "OCR_REQUIRED": 422, "MALFORMED_DOCUMENT": 422,
    "DOCUMENT_NOT_FOUND": 404, "COMPARISON_NOT_FOUND": 404, "COMPARISON_EXPIRED": 410, "DIFF_BUDGET_EXCEEDED": 413, "RATE_LIMITED": 429, "INTERNAL_ERROR": 500,
}


def with_expiry(rows: DataFrame, created_at: Column, days: int = TTL_DAYS) -> DataFrame:
    expires = created_at + F.make_dt_interval(F.lit(days))
    return rows.withColumn("created_at", created_at).withColumn("expires_at", expires).withColumn("expires_on", F.to_date(expires))


def live(rows: DataFrame, now: Column) -> DataFrame:
    """Rows not expired; the day prunes partitions where the table has it."""
    out = rows.filter(F.col("expires_at") > now)
    return out.filter(F.col("expires_on") >= F.to_date(now)) if "expires_on" in rows.columns else out


def swept(documents: DataFrame, comparisons: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """What a sweep leaves: live documents, and live comparisons of two live documents."""
    docs = live(documents, now)
    ids = docs.select("doc_id").distinct()
    left = live(comparisons, now)
    for side in ("a_doc_id", "b_doc_id"):
        left = left.join(ids, left[side] == ids["doc_id"], "left_semi")
    return docs, left


def upsert(table: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """table with the rows of new in place of those of the same key; the last of equal keys in new wins by created_at."""
    newest = Window.partitionBy(key).orderBy(F.desc("created_at"))
    one = new.withColumn("_n", F.row_number().over(newest)).filter("_n = 1").drop("_n")
    return table.join(one.select(key), key, "left_anti").unionByName(one)


def delete(documents: DataFrame, comparisons: DataFrame, doc_ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Without the documents, and without comparisons of them."""
    left = comparisons
    for side in ("a_doc_id", "b_doc_id"):
        left = left.join(doc_ids, left[side] == doc_ids["doc_id"], "left_anti")
    return documents.join(doc_ids, "doc_id", "left_anti"), left


def statuses(comparisons: DataFrame, documents: DataFrame, now: Column) -> DataFrame:
    """comparisons with `state`: EXPIRED where it or a document is gone or expired, else its own status."""
    ends = documents.select("doc_id", "expires_at")
    a, b = ends.select(F.col("doc_id").alias("a_doc_id"), F.col("expires_at").alias("a_end")), ends.select(F.col("doc_id").alias("b_doc_id"), F.col("expires_at").alias("b_end"))
    gone = (F.col("expires_at") <= now) | F.col("a_end").isNull() | F.col("b_end").isNull() | (F.col("a_end") <= now) | (F.col("b_end") <= now)
    return comparisons.join(a, "a_doc_id", "left").join(b, "b_doc_id", "left").withColumn("state", F.when(gone, "EXPIRED").otherwise(F.col("status"))).drop("a_end", "b_end")


def put_comparisons(comparisons: DataFrame, new: DataFrame, documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The table with the new rows whose documents exist, and the rows refused."""
    ids = documents.select("doc_id").distinct()
    good = new
    for side in ("a_doc_id", "b_doc_id"):
        good = good.join(ids, good[side] == ids["doc_id"], "left_semi")
    return upsert(comparisons, good, "cmp_id"), new.join(good.select("cmp_id"), "cmp_id", "left_anti").withColumn("error", F.lit("DOCUMENT_NOT_FOUND"))


def failed(comparisons: DataFrame, cmp_id: str, message: str) -> DataFrame:
    """Marks one comparison as failed, with at most 500 characters of the reason."""
    this = F.col("cmp_id") == cmp_id
    return comparisons.withColumn("status", F.when(this, "FAILED").otherwise(F.col("status"))).withColumn("message", F.when(this, F.lit(message[:500])).otherwise(F.col("message")))


def route(pairs: DataFrame, metadata: DataFrame) -> DataFrame:
    """pairs with blocks, words and route: INLINE, BACKGROUND, or REFUSED beyond the comparison budget."""
    m = metadata.select("doc_id", "block_count", "word_count")
    side = lambda s: m.select(F.col("doc_id").alias(f"{s}_doc_id"), F.col("block_count").alias(f"{s}_blocks"), F.col("word_count").alias(f"{s}_words"))
    sized = pairs.join(side("a"), "a_doc_id").join(side("b"), "b_doc_id").withColumn("blocks", F.col("a_blocks") + F.col("b_blocks")).withColumn("words", F.col("a_words") + F.col("b_words"))
    refused = (F.col("blocks") > MOST_BLOCKS) | (F.col("words") > MOST_WORDS)
    inline = (F.col("blocks") <= INLINE_BLOCKS) & (F.col("words") <= INLINE_WORDS)
    return sized.select("cmp_id", "a_doc_id", "b_doc_id", "blocks", "words", F.when(refused, "REFUSED").when(inline, "INLINE").otherwise("BACKGROUND").alias("route"))


def capabilities(spark: SparkSession) -> DataFrame:
    """The parsers and what they read."""
    from ..sources.registry import PARSERS

    return spark.createDataFrame([(i, p.name, ",".join(p.extensions), ",".join(p.media_types)) for i, p in enumerate(PARSERS)], "priority int, parser string, extensions string, media_types string")
