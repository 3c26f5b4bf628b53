"""Queries over difference blocks: changed blocks, structure, source order, pages, windows and shown percentages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PAGE, PAGE_MOST = 200, 500
WINDOW_BLOCKS, WINDOW_BYTES = 2500, 12 * 1024 * 1024
EXCERPT, SHOWN, RELATIONS = 110, 12, 5
STRUCTURAL = ("MOVED", "SPLIT", "MERGED")


def changed_blocks(blocks: DataFrame) -> DataFrame:
    """cmp_id, change (1, 2, ...), seq, status of every block that differs."""
    order = Window.partitionBy("cmp_id").orderBy("seq")
    return blocks.filter("status <> 'UNCHANGED'").select("cmp_id", F.row_number().over(order).alias("change"), "seq", "status")


def structural_relationships(blocks: DataFrame, most: int = RELATIONS) -> DataFrame:
    """Moves, splits and merges in the order of their first block: cmp_id, status, key, a_positions, b_positions (from 1),
    members (seq), sentence, and shown (among the first `most` of its comparison)."""
    key = F.coalesce("group_id", F.format_string("dbk_%04d", "seq"))
    places = lambda c: F.array_sort(F.collect_set(F.col(c) + 1))
    rows = blocks.filter(F.col("status").isin(*STRUCTURAL)).groupBy("cmp_id", "status", key.alias("key"))
    found = rows.agg(places("a_index").alias("a_positions"), places("b_index").alias("b_positions"), F.array_sort(F.collect_list("seq")).alias("members"))
    found = found.filter((F.size("a_positions") > 0) & (F.size("b_positions") > 0))
    listed = lambda side, c: F.concat(F.lit(f"{side} "), F.array_join(F.col(c).cast("array<string>"), ", "))
    verb = F.when(F.col("status") == "MOVED", " now stands at ").when(F.col("status") == "SPLIT", " was split into ").otherwise(" were merged into ")
    rank = F.row_number().over(Window.partitionBy("cmp_id").orderBy(F.col("members")[0]))
    return found.withColumn("sentence", F.concat(listed("A", "a_positions"), verb, listed("B", "b_positions"))).withColumn("shown", rank <= most)


def source_order(blocks: DataFrame, most: int = SHOWN, texts: DataFrame | None = None) -> DataFrame:
    """Each side's blocks in its own order: cmp_id, side, block_index, structural, others (places on the other side, from
    1), excerpt. A side of more than `most` blocks shows its first `most` moved, split and merged ones alone. Blocks without
    tokens have no excerpt, unless `texts` (cmp_id, side, block_index, text), which tokens join to, has it."""
    other = {"a": "b", "b": "a"}
    told = "a_tokens" in blocks.columns
    text = lambda s: F.array_join(F.transform(f"{s}_tokens", lambda t: t["text"]), "") if told else F.lit(None).cast("string")
    side = lambda s: blocks.filter(F.col(f"{s}_index").isNotNull()).select("cmp_id", "seq", F.lit(s).alias("side"), F.col(f"{s}_index").alias("block_index"), F.col(f"{other[s]}_index").alias("other"), "status", text(s).alias("text"))
    rows = side("a").unionByName(side("b"))
    joined = rows.groupBy("cmp_id", "side", "block_index").agg(F.max(F.col("status").isin(*STRUCTURAL)).alias("structural"), F.array_sort(F.collect_set(F.col("other") + 1)).alias("others"), F.array_sort(F.collect_list(F.struct("seq", "text"))).alias("parts"))
    own = Window.partitionBy("cmp_id", "side")
    rank = F.row_number().over(own.orderBy(~F.col("structural"), "block_index"))
    joined = joined.withColumn("n", F.count("*").over(own)).withColumn("rank", rank).filter((F.col("n") <= most) | (F.col("structural") & (F.col("rank") <= most)))
    whole = F.array_join(F.transform("parts", lambda p: p["text"]), "")
    if not told and texts is None:
        whole = F.lit(None).cast("string")
    elif not told:
        joined, whole = joined.join(texts.select("cmp_id", "side", "block_index", "text"), ["cmp_id", "side", "block_index"]), F.col("text")
    whole = F.trim(F.regexp_replace(whole, "(?U)\\s+", " "))
    excerpt = F.when(F.length(whole) > EXCERPT, F.concat(F.rtrim(F.substring(whole, 1, EXCERPT - 1)), F.lit("…"))).otherwise(whole)
    return joined.select("cmp_id", "side", "block_index", "structural", "others", excerpt.alias("excerpt"))


def shown_percent(similarity: Column, edit_count: Column) -> Column:
    """Rounded only where nothing was edited; otherwise cut off, and never above 99."""
    return F.when(edit_count == 0, F.round(similarity * 100)).otherwise(F.least(F.floor(similarity * 100), F.lit(99))).cast("int")


def page(blocks: DataFrame, offset: int = 0, limit: int = PAGE) -> DataFrame:
    """Blocks offset + 1 to offset + limit of each comparison: a range of seq, which reaches the scan."""
    if offset < 0 or not 1 <= limit <= PAGE_MOST:
        raise ValueError("offset from 0, limit from 1 to 500")
    return blocks.filter(F.col("seq").between(offset + 1, offset + limit))


def windowed(blocks: DataFrame) -> DataFrame:
    """Comparisons over 2,500 blocks or 12 MiB of JSON cut to their first page: adds total_blocks and truncated."""
    sizes = blocks.groupBy("cmp_id").agg(F.count("*").alias("total_blocks"), F.sum(F.octet_length(F.to_json(F.struct("tokens", "a_tokens", "b_tokens")))).alias("bytes"))
    big = (F.col("total_blocks") > WINDOW_BLOCKS) | (F.col("bytes") > WINDOW_BYTES)
    return blocks.join(sizes.select("cmp_id", "total_blocks", big.alias("truncated")), "cmp_id").filter(~F.col("truncated") | (F.col("seq") <= PAGE))
