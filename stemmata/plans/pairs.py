"""Choosing pairs of documents to collate: earlier and later copies that share lines.

Every line counts, however common. What keeps the common ones cheap: lines that only one document has share nothing;
documents that are left with equal sets of lines are one class, and only its first member is compared with others (the
other members share all their lines with it); and lines common among the classes are looked at apart, on the documents
reduced to them, where far fewer sets differ.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import written

#: Lines in more documents than this are looked at apart, on documents reduced to such lines.
COMMON_LINE = 10
#: How often what is common is looked at apart before all that is left is joined; documents of a line in one cell of that.
LEVELS, CELL = 3, 100


def _joined(lines: DataFrame) -> DataFrame:
    """Rows (doc_id, line, n: documents of the line) to a_doc_id, b_doc_id, shared. A line's documents are dealt to cells
    of some CELL by CELL, so that no task has a whole common line."""
    blocks = F.ceil(F.col("n") / CELL).cast("int")
    rows = lines.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("doc_id", "line", "block", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"))
    cells = rows.groupBy("line", "x", "y").agg(F.collect_list(F.struct("doc_id", "block")).alias("docs"))
    pairs = cells.select("x", "y", F.explode("docs").alias("a"), "docs").select("x", "y", "a", F.explode("docs").alias("b"))
    pairs = pairs.filter("a.doc_id < b.doc_id AND (x = y OR a.block <> b.block)")
    return pairs.groupBy(F.col("a.doc_id").alias("a_doc_id"), F.col("b.doc_id").alias("b_doc_id")).agg(F.count("*").alias("shared"))


def _best(found: DataFrame) -> DataFrame:
    """Of each b_doc_id the pair that shares most, of equal ones the one of least a_doc_id."""
    least = found.groupBy("b_doc_id").agg(F.min(F.struct((-F.col("shared")).alias("minus"), "a_doc_id")).alias("x"))
    return least.select(F.col("x.a_doc_id").alias("a_doc_id"), "b_doc_id", (-F.col("x.minus")).alias("shared"))


def _nearest(lines: DataFrame, common: int, levels: int) -> DataFrame:
    """Distinct (doc_id, line) to the best a_doc_id of each b_doc_id, and the lines shared."""
    counted = lambda rows: rows.groupBy("line").agg(F.count("*").alias("n")).filter("n > 1")
    kept = written(lines.join(counted(lines), "line").select("doc_id", "line"), "pair-lines")
    sets = kept.groupBy("doc_id").agg(F.array_sort(F.collect_list("line")).alias("set"))
    sets = sets.select("doc_id", F.md5(F.array_join("set", ",")).alias("set"), F.size("set").cast("long").alias("size"))
    firsts = sets.groupBy("set").agg(F.min("doc_id").alias("first"))
    sets = written(sets.join(firsts, "set").select("doc_id", "first", "size"), "pair-sets")
    ours = kept.join(sets.filter("doc_id = first").select("doc_id"), "doc_id")
    ours = written(ours.join(counted(ours), "line").select("doc_id", "line", "n"), "pair-class-lines")
    hot = ours.filter(F.col("n") > common).select("doc_id", "line")
    if levels == 0 or hot.isEmpty():
        found = _joined(ours)
    else:
        # A document that shares a rare line is met there, and its common lines are added; one that shares common lines
        # only shares just those, so the best of the documents reduced to common lines covers it.
        rare, reduced = _joined(ours.filter(F.col("n") <= common)), hot.groupBy("doc_id").agg(F.collect_list("line").alias("lines"))
        side = lambda s: reduced.select(F.col("doc_id").alias(f"{s}_doc_id"), F.col("lines").alias(f"{s}_lines"))
        both = F.coalesce(F.size(F.array_intersect("a_lines", "b_lines")), F.lit(0))
        met = rare.join(side("a"), "a_doc_id", "left").join(side("b"), "b_doc_id", "left")
        met = met.select("a_doc_id", "b_doc_id", (F.col("shared") + F.when(F.col("a_lines").isNotNull() & F.col("b_lines").isNotNull(), both).otherwise(0)).alias("shared"))
        found = met.unionByName(_nearest(hot, common, levels - 1))
    best = written(_best(found), "pair-best")
    # The other members of a class share all lines with its first, and so does an earlier document only if the first has it too.
    later = sets.filter("doc_id > first").join(best.select(F.col("b_doc_id").alias("first"), "a_doc_id", "shared"), "first", "left")
    later = later.select(F.when(F.col("shared") == F.col("size"), F.col("a_doc_id")).otherwise(F.col("first")).alias("a_doc_id"), F.col("doc_id").alias("b_doc_id"), F.col("size").alias("shared"))
    return best.unionByName(later)


def sharing_pairs(blocks: DataFrame, common: int = COMMON_LINE) -> DataFrame:
    """For each document the earlier one that shares most different lines (of equal ones the first): cmp_id, a_doc_id,
    b_doc_id, shared. Lines travel as hashes; those in more than `common` documents count as all others do."""
    lines = blocks.filter("doc_id IS NOT NULL").select("doc_id", F.xxhash64("text").alias("line")).distinct()
    one = _nearest(lines, common, LEVELS)
    return one.select(F.format_string("cmp_%d_%d", "a_doc_id", "b_doc_id").alias("cmp_id"), "a_doc_id", "b_doc_id", "shared")
