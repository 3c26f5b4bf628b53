"""Mixing sources to target weights along a curriculum.

Targets: sources in code-point order (null last) weigh WEIGHTS in turn and share `share` times all words; a target
stops at `most` times its source's words and the excess is shared again by weight until none is above. With sources
sorted by limit over weight this is one pass of prefix sums over the table of sources, which has a row a source and is one task's (some 50 bytes a source).

Documents of a source stand in a fixed shuffled order (md5 of the id). Its words are taken in that order, from the
beginning again where the target is larger than the source, and the last document is cut at the target, so that each
source gives exactly its rounded target and no document more than `most` times its words.

Curriculum: a source's weight at training time t in [0, 1] runs linearly from RAMPS[k][0] to RAMPS[k][1]. Its integral,
scaled to the target, is the source's cumulative demand D(t); a copy whose first word is word c of the source's stream
gets position D^-1(c), and copies are range-sorted by position.

Only keys and sizes go through the windows: (source, digest, id, text hash) is range-partitioned and written, so a source
with a third of all rows lies in as many ranges as it needs; sums of (source, range) alone are summed in one window a
source. Texts move twice at most, and only for training_order: to their positions by key, then by position.

Defined results: null texts have size 0; a source without words has target 0 and gives nothing; an empty table gives no
row; ties in md5 (equal or null ids) are ordered by id, then by text hash, and identical rows take in any order with
equal sizes. In training_order, rows equal in id, text and source are one document taken as often as all of them, with
the other columns of the least of them; extra columns ride along untouched in `row`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import LAST, written

WORD = "[^\\x20\\x09-\\x0D]+"
WEIGHTS = (3, 1, 2)
#: Weight at the beginning and at the end of training, for the sources in turn: falling, level, rising.
RAMPS = ((3.0, 1.0), (1.0, 1.0), (1.0, 3.0))


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sized: DataFrame, share: float = 1.5, most: int = 2) -> DataFrame:
    """source, k (place in order, from 0), source_size, weight, target."""
    everything = Window.orderBy("ratio", "k")
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    sources = sources.withColumn("k", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    sources = sources.withColumn("weight", F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("k") % len(WEIGHTS) + 1).cast("int")))
    sources = sources.withColumn("limit", F.col("source_size") * most).withColumn("ratio", F.col("limit") / F.col("weight"))
    before = everything.rowsBetween(Window.unboundedPreceding, -1)
    after = everything.rowsBetween(0, Window.unboundedFollowing)
    all_words = F.sum("source_size").over(Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    sources = sources.withColumn("level", (all_words.cast("double") * share - F.coalesce(F.sum("limit").over(before), F.lit(0)).cast("double")) / F.sum("weight").over(after).cast("double"))
    # The first source, by limit over weight, that the level does not fill gives the level of all that are not filled.
    whole = everything.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = F.first(F.when(F.col("level") <= F.col("ratio"), F.col("level")), ignorenulls=True).over(whole)
    return sources.withColumn("level", level).select("source", "k", "source_size", "weight", F.least(F.col("limit").cast("double"), F.col("level") * F.col("weight")).alias("target"))


def _position(part: Column, k: Column) -> Column:
    """Inverse of the cumulative demand: the time at which a share `part` of the source's words is taken."""
    out = None
    for i, (a, z) in enumerate(RAMPS):
        d = z - a
        at = part if d == 0 else (F.sqrt(F.lit(a * a) + F.lit(d * (a + z)) * part) - F.lit(a)) / F.lit(d)
        out = F.when(k % len(RAMPS) == i, at) if out is None else out.when(k % len(RAMPS) == i, at)
    return out


def _keyed(documents: DataFrame) -> DataFrame:
    """row (all input columns) and the keys dk, tk and sk, never null."""
    source = F.col("row.source").cast("string")
    keys = [F.coalesce(F.col("row.doc_id").cast("long"), F.lit(LAST)).alias("dk"), F.xxhash64(F.col("row.text").cast("string")).alias("tk"), F.coalesce(F.concat(F.lit("="), source), F.lit("")).alias("sk")]
    return documents.select(F.struct("*").alias("row")).select("row", *keys)


def mix(documents: DataFrame, share: float = 1.5, most: int = 2) -> DataFrame:
    """doc_id, dk, tk, sk (keys), size, source_size, target, taken, and copies: an array of (position, words), one entry
    for each time that the mix takes the document; empty where it doesn't."""
    digest = F.md5(F.coalesce(F.col("row.doc_id").cast("string"), F.lit("")))
    rows = _keyed(documents).select(F.col("row.doc_id").alias("doc_id"), F.col("row.source").cast("string").alias("source"), "dk", "tk", "sk", word_count(F.col("row.text")).alias("size"), digest.alias("digest"))
    # doc_id as it is, null first among equal digests: the order that the window below has.
    rows = written(rows.repartitionByRange("sk", "digest", "doc_id", "tk").withColumn("part", F.spark_partition_id()), "mix-order")
    sums = rows.groupBy("source", "sk", "part").agg(F.sum("size").alias("size"))
    before = F.coalesce(F.sum("size").over(Window.partitionBy("sk").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    targets = source_targets(sums, share, most).withColumnRenamed("source", "t_source")
    known = sums.withColumn("part_start", before).drop("size").join(targets, F.col("source").eqNullSafe(F.col("t_source"))).drop("source", "t_source")
    known = known.withColumnRenamed("sk", "s_sk").withColumnRenamed("part", "s_part")
    inner = Window.partitionBy("sk", "part").orderBy("digest", "doc_id", "tk").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("local", F.coalesce(F.sum("size").over(inner), F.lit(0))).join(known, (F.col("sk") == F.col("s_sk")) & (F.col("part") == F.col("s_part")))
    start, wanted = F.col("part_start") + F.col("local"), F.round("target").cast("long")
    copies = []
    for i in range(most):
        c = start + F.col("source_size") * i
        words = F.greatest(F.lit(0), F.least(F.col("size"), wanted - c)).cast("long")
        copies.append(F.struct(_position(F.try_divide(c.cast("double"), wanted.cast("double")), F.col("k")).alias("position"), words.alias("words")))
    placed = placed.withColumn("copies", F.filter(F.array(*copies), lambda x: x["words"] > 0))
    taken = F.aggregate("copies", F.lit(0).cast("long"), lambda n, x: n + x["words"])
    return placed.select("doc_id", "dk", "tk", "sk", "size", "source_size", "target", taken.alias("taken"), "copies")


def training_order(documents: DataFrame, mixed: DataFrame) -> DataFrame:
    """One row for each copy, range-sorted by position: row, copy (from 0), position, words."""
    keys = ["dk", "tk", "sk"]
    places = mixed.groupBy(*keys).agg(F.array_sort(F.flatten(F.collect_list("copies"))).alias("copies")).filter(F.size("copies") > 0)
    met = _keyed(documents).join(places, keys)
    # Rows equal in all keys: the copies of all of them are the first's. The join has dealt them by these keys already.
    first = F.row_number().over(Window.partitionBy(*keys).orderBy(F.xxhash64("row")))
    met = met.withColumn("nth", first).filter("nth = 1")
    copies = met.select("row", "dk", "tk", F.posexplode("copies").alias("copy", "taken_copy"))
    return copies.select("row", "copy", F.col("taken_copy.position").alias("position"), F.col("taken_copy.words").alias("words"), "dk", "tk").orderBy("position", "dk", "tk", "copy").drop("dk", "tk")


def first_words(text: Column, words: Column) -> Column:
    """The text up to the end of its word number `words`; whole where it has no more."""
    ends = "(?<=[^\\x20\\x09-\\x0D])(?=[\\x20\\x09-\\x0D])"
    return F.when(words >= word_count(text), text).otherwise(F.array_join(F.slice(F.split(text, ends), F.lit(1), words.cast("int")), ""))


ORACLE = r"""
WITH d AS (SELECT doc_id, source, CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) END AS size FROM documents),
s0 AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
s1 AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS k FROM s0),
s2 AS (SELECT *, CASE k % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS weight, 2 * source_size AS lim FROM s1),
s3 AS (SELECT *, CAST(lim AS DOUBLE) / weight AS ratio FROM s2),
s4 AS (SELECT *, (CAST((SELECT sum(source_size) FROM s0) AS DOUBLE) * 1.5
    - CAST(coalesce(sum(lim) OVER (ORDER BY ratio, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE))
    / CAST(sum(weight) OVER (ORDER BY ratio, k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS level FROM s3),
s5 AS (SELECT source, k, source_size, least(CAST(lim AS DOUBLE), (SELECT arg_min(level, (ratio, k)) FROM s4 WHERE level <= ratio) * weight) AS target FROM s4),
p AS (SELECT d.doc_id, d.size, s5.source_size, s5.target, s5.k, CAST(round(s5.target) AS BIGINT) AS wanted,
    CAST(coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY md5(CAST(d.doc_id AS VARCHAR)), d.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start
    FROM d JOIN s5 ON d.source IS NOT DISTINCT FROM s5.source),
c AS (SELECT *, greatest(0, least(size, wanted - start)) AS a, greatest(0, least(size, wanted - start - source_size)) AS b,
    CAST(start AS DOUBLE) / CAST(wanted AS DOUBLE) AS part FROM p)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target, CAST(a + b AS BIGINT) AS taken,
    CASE WHEN a > 0 THEN CASE k % 3 WHEN 0 THEN (sqrt(9.0::DOUBLE + (-8.0)::DOUBLE * part) - 3.0::DOUBLE) / (-2.0)::DOUBLE
        WHEN 1 THEN part ELSE (sqrt(1.0::DOUBLE + 8.0::DOUBLE * part) - 1.0::DOUBLE) / 2.0::DOUBLE END END AS position
FROM c
"""
