"""Document fingerprints: invertible Bloom lookup tables of paragraph digests, in DataFrame functions only.

A text's paragraphs are its different \\n-split lines; a digest is a 64-bit hash. Digests are dealt into a power of two of
blocks of about BLOCK_KEYS, and each block is a table of 3 x CELLS cells: every digest adds itself to one cell of each
third (count, xor of digests, xor of check hashes). These tables are the fingerprint. Two versions' published tables are
subtracted cell by cell, so equal digests vanish; the tables of the version with more blocks are folded to the other's
number first (cells of blocks that agree in the lower bits add up). Peeling recovers the rest: a cell with count 1 or -1
whose check fits holds one digest, which is taken out of its three cells, in rounds. Where a block's table does not
empty, its digests are built again into tables of four times the cells, with other hashes each time, and peeled again;
the size stops growing at 2 ** 14 cells a third, or eight times the block's digests, but the attempts go on with new
hashes. After TRIES attempts, which only two digests equal in 64 bits could use up, the query fails rather than guess.
likeness = shared / all digests, from the sizes and the number recovered; 1 for two texts without paragraphs.

Order: "next" is the next smaller doc_id, null ids at the end, ties by text hash, and after the last the first.
Neighbours come from a narrow table of keys, range-sorted and written once; only one row a range is ordered in one task.
Texts are exchanged once, by their keys; from there each sends the prefix that the edit of the document before it takes,
and its digests, and meets what it is sent itself.

Defined results: a null text is empty, with one empty paragraph; rows equal in id and text count as one document in the
order and are each returned; a lone document is its own next; an empty table gives no row; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

BLOCK_KEYS = 16
#: Cells in a third of a block's published table; attempts at peeling; rounds of peeling a hundred digests.
CELLS, TRIES, ROUNDS = 8, 24, 16
MOST_CELLS = 2**14
FIRST = -(2**63)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once, even where body uses it inside other lambdas: those would compute it again
    for each element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def digests(text: Column) -> Column:
    return F.array_distinct(F.transform(F.split(text, "\n"), lambda line: F.xxhash64(line)))


def _check(key: Column) -> Column:
    return F.xxhash64(key, F.lit(77))


def _in_cell(key: Column, cell: Column, cells: Column) -> Column:
    """Whether the digest belongs to a cell; cells of the three thirds are numbered through."""
    third = F.floor(cell / cells).cast("int")
    return F.pmod(F.call_function("shiftrightunsigned", key, third * 16 + 14).bitwiseAND(F.lit(0x3FFF)), cells) == F.pmod(cell, cells)


def _cell(count: Column, key: Column, check: Column) -> Column:
    return F.struct(count.cast("int").alias("count"), key.cast("long").alias("key"), check.cast("long").alias("check"))


def table(keys: Column, cells: Column) -> Column:
    """The cells of a block's digests. cells: a power of two up to MOST_CELLS."""
    empty = _cell(F.lit(0), F.lit(0), F.lit(0))
    add = lambda c, k: _cell(c["count"] + 1, c["key"].bitwiseXOR(k), c["check"].bitwiseXOR(_check(k)))
    return _let(keys, lambda own: F.transform(F.sequence(F.lit(0), cells * 3 - 1), lambda i: F.aggregate(F.filter(own, lambda k: _in_cell(k, i, cells)), empty, add)))


def subtract(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: _cell(x["count"] - y["count"], x["key"].bitwiseXOR(y["key"]), x["check"].bitwiseXOR(y["check"])))


def peel(cells_of: Column, cells: Column) -> Column:
    """Digests recovered from subtracted cells, with signs; null if some cell does not empty."""
    pure_cell = lambda c: (F.abs(c["count"]) == 1) & (_check(c["key"]) == c["check"])
    take = lambda c, p: _cell(c["count"] - p["count"], c["key"].bitwiseXOR(p["key"]), c["check"].bitwiseXOR(p["check"]))

    def one(state: Column, _: Column) -> Column:
        def without(pure: Column) -> Column:
            rest = F.transform(state["cells"], lambda c, i: F.aggregate(F.filter(pure, lambda p: _in_cell(p["key"], i, cells)), c, take))
            return F.when(F.size(pure) == 0, state).otherwise(F.struct(rest.alias("cells"), F.concat(state["found"], pure).alias("found")))

        return _let(F.array_distinct(F.filter(state["cells"], pure_cell)), without)

    none = F.filter(cells_of, lambda c: F.lit(False))
    end = F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), F.struct(cells_of.alias("cells"), none.alias("found")), one)
    dirty = lambda c: (c["count"] != 0) | (c["key"] != 0) | (c["check"] != 0)
    return _let(end, lambda s: F.when(~F.exists(s["cells"], dirty), s["found"]))


def _bits(n: Column) -> Column:
    """Binary logarithm of the number of blocks, for about BLOCK_KEYS digests a block."""
    return F.ceil(F.greatest(F.lit(0.0), F.log2(n / BLOCK_KEYS))).cast("int")


def _power(bits: Column) -> Column:
    return F.pow(F.lit(2.0), bits).cast("int")


def blocks(keys: Column, bits: Column) -> Column:
    """The digests dealt by their lower `bits` bits, one array a block. Three digits are dealt one after the other, so n
    digests cost about 3 n times the cube root of the number of blocks."""

    def dealt(groups: Column, shift: Column, width: Column) -> Column:
        # The digit dealt now is above those dealt before: groups come out in the order of the whole number.
        digit = lambda k, s, n: F.pmod(F.call_function("shiftrightunsigned", k, s), n)
        each = lambda g, s, n: F.flatten(F.transform(F.sequence(F.lit(0), n - 1), lambda d: F.transform(g, lambda x: F.filter(x, lambda k: digit(k, s, n) == d))))
        return _let(F.struct(groups.alias("g"), shift.alias("s"), _power(width).alias("n")), lambda v: each(v["g"], v["s"], v["n"]))

    third = F.floor(bits / 3).cast("int")
    two = F.floor((bits - third) / 2).cast("int")
    by_digits = dealt(dealt(dealt(F.array(keys), F.lit(0), third), third, two), third + two, bits - third - two)
    return F.when(bits == 0, F.array(keys)).otherwise(by_digits)


def tables(dealt: Column) -> Column:
    """The published table of each block."""
    return F.transform(dealt, lambda keys: table(keys, F.lit(CELLS)))


def folded(published: Column, count: Column) -> Column:
    """Tables of `count` blocks from those of a multiple of it: blocks that agree in the lower bits add up."""
    add = lambda x, y: _cell(x["count"] + y["count"], x["key"].bitwiseXOR(y["key"]), x["check"].bitwiseXOR(y["check"]))
    times = (F.size(published) / count).cast("int")
    one = lambda b: F.aggregate(F.sequence(F.lit(1), times), F.transform(F.get(published, b), lambda c: c), lambda done, i: F.when(i == times, done).otherwise(F.zip_with(done, F.get(published, b + count * i), add)))
    return F.when(F.size(published) == count, published).otherwise(F.transform(F.sequence(F.lit(0), count - 1), one))


def fingerprint(published: Column, n: Column) -> Column:
    """The tables as text: digests, blocks, then count, digest and check of each cell in use."""
    cell = lambda c: F.when(c["count"] == 0, F.lit("")).otherwise(F.concat(c["count"].cast("string"), F.lit("."), F.lower(F.hex(c["key"])), F.lit("."), F.lower(F.hex(c["check"]))))
    return F.concat(n.cast("string"), F.lit("/"), F.size(published).cast("string"), F.lit("/"), F.array_join(F.transform(published, lambda t: F.array_join(F.transform(t, cell), ",")), ";"))


def _again(x: Column, y: Column) -> Column:
    """Number of digests that only one of two versions of a block has, from larger tables."""
    enough = F.least(F.lit(MOST_CELLS), F.pow(F.lit(2.0), F.ceil(F.log2(8.0 * (F.size(x) + F.size(y)) + 1))).cast("int"))

    def attempt(done: Column, nth: Column) -> Column:
        size = F.least(enough, F.pow(F.lit(4.0), F.least(nth, F.lit(7))).cast("int") * CELLS)
        seeded = lambda keys, c: table(F.transform(keys, lambda k: F.xxhash64(k, nth)), c)
        return F.when(done >= 0, done).otherwise(F.coalesce(_let(size, lambda c: F.size(peel(subtract(seeded(x, c), seeded(y, c)), c))), F.lit(-1)))

    return F.aggregate(F.sequence(F.lit(1), F.lit(TRIES)), F.lit(-1), attempt)


def with_likeness(rows: DataFrame, a: str, b: str, name: str) -> DataFrame:
    """Adds `name`: shared / all digests of versions a and b (columns a_keys and a_tables, b_keys and b_tables). The
    published tables are subtracted and peeled block by block; blocks that do not empty are built again, larger.

    One step a column: Catalyst keeps a column that costs much and is used twice, but would repeat parts of a struct."""
    keys = [F.col(f"{a}_keys"), F.col(f"{b}_keys")]
    bits = [_bits(F.size(k)) for k in keys]
    rows = rows.withColumn("_count", _power(F.least(*bits))).withColumn("_bits", F.greatest(*bits))
    for side, column in (("_x", a), ("_y", b)):
        rows = rows.withColumn(side, folded(F.col(f"{column}_tables"), F.col("_count")))
    rows = rows.withColumn("_found", F.transform(F.zip_with("_x", "_y", subtract), lambda t: F.size(peel(t, F.lit(CELLS)))))
    open_blocks = F.exists("_found", lambda n: ~F.coalesce(n >= 0, F.lit(False)))
    for side, k in zip(("_x", "_y"), keys, strict=True):
        rows = rows.withColumn(side, F.when(open_blocks, blocks(k, F.col("_bits"))))
    # What stays open is peeled in the blocks of the version that has more of them. Arrays are arguments here, as a
    # lambda would compute what it only captures again for each element.
    times = F.floor(_power(F.col("_bits")) / F.col("_count")).cast("int")
    coarse = F.flatten(F.transform(F.sequence(F.lit(1), times), lambda i: F.transform(F.col("_coarse"), lambda n: F.struct(n.alias("n"), (i == 1).alias("first")))))
    rows = rows.withColumn("_coarse", F.col("_found")).withColumn("_each", F.zip_with(coarse, F.zip_with("_x", "_y", lambda x, y: F.struct(x.alias("x"), y.alias("y"))), lambda c, k: F.struct(c["n"].alias("n"), c["first"].alias("first"), k["x"].alias("x"), k["y"].alias("y"))))
    peeled = F.transform("_each", lambda t: F.when(t["n"] >= 0, F.when(t["first"], t["n"]).otherwise(0)).otherwise(_again(t["x"], t["y"])))
    rows = rows.withColumn("_found", F.when(open_blocks, peeled).otherwise(F.col("_coarse")))
    failed = F.raise_error(F.lit("two paragraph digests are equal")).cast("int")
    rows = rows.withColumn("_found", F.aggregate("_found", F.lit(0), lambda s, d: F.when(d >= 0, s + d).otherwise(failed)))
    both, d = F.size(keys[0]) + F.size(keys[1]), F.col("_found")
    return rows.withColumn(name, F.when(both + d == 0, F.lit(1.0)).otherwise((both - d).cast("double") / (both + d))).drop("_bits", "_count", "_x", "_y", "_each", "_coarse", "_found")


def with_tables(rows: DataFrame, name: str) -> DataFrame:
    """Adds `name`_tables, the published tables of the digests in `name`_keys."""
    keys = F.col(f"{name}_keys")
    return rows.withColumn(f"{name}_blocks", blocks(keys, _bits(F.size(keys)))).withColumn(f"{name}_tables", tables(F.col(f"{name}_blocks"))).drop(f"{name}_blocks")


def _neighbours(keys: DataFrame) -> DataFrame:
    """For different (nk, tk, n_chars): those of the next document, next_nk and next_tk, and of the one before, before_*."""
    ranges = keys.repartitionByRange("nk", "tk").withColumn("part", F.spark_partition_id())
    ranges = written(ranges, "fingerprint-order")
    inner = Window.partitionBy("part").orderBy(F.desc("nk"), F.desc("tk"))
    this = F.struct("nk", "tk", "n_chars")
    edges = ranges.groupBy("part").agg(F.max(this).alias("top"), F.min(this).alias("low"))
    outer = Window.orderBy(F.desc("part"))
    whole = outer.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    edges = edges.select(F.col("part").alias("e_part"), F.coalesce(F.lead("top").over(outer), F.first("top").over(whole)).alias("below"), F.coalesce(F.lag("low").over(outer), F.last("low").over(whole)).alias("above"))
    placed = ranges.withColumn("next", F.lead(this).over(inner)).withColumn("before", F.lag(this).over(inner)).join(edges, F.col("part") == F.col("e_part"))
    return placed.select("nk", "tk", F.coalesce("next", "below").alias("next"), F.coalesce("before", "above").alias("before"))


def compare_with_edits(documents: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every row."""
    doc_id, text = F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit(""))
    docs = documents.select(doc_id.alias("doc_id"), F.coalesce(doc_id, F.lit(FIRST)).alias("nk"), F.xxhash64(text).alias("tk"), text.alias("text"))
    keys = docs.groupBy("nk", "tk").agg(F.first(F.length("text")).cast("long").alias("n_chars"))
    order = written(_neighbours(keys), "fingerprint-neighbours")
    # Both joins below read the one exchange of docs by (nk, tk): they use the same columns of it.
    here = docs.join(order.select("nk", "tk", "before"), ["nk", "tk"])
    prefix = F.substring("text", F.lit(1), F.floor(F.col("before.n_chars") / 3).cast("int"))
    sent = here.select(F.col("before.nk").alias("to_nk"), F.col("before.tk").alias("to_tk"), prefix.alias("prefix"), digests(F.col("text")).alias("next_keys"), F.col("doc_id").alias("next_id")).dropDuplicates(["to_nk", "to_tk"])
    met = docs.join(sent, (F.col("nk") == F.col("to_nk")) & (F.col("tk") == F.col("to_tk")))
    n = F.length("text")
    edited = F.concat(F.substring("text", F.lit(1), n - F.floor(n / 3).cast("int")), F.col("prefix"))
    rows = met.select("doc_id", n.cast("long").alias("n_chars"), "text", edited.alias("edited"), "next_keys", "next_id")
    rows = rows.select("doc_id", "n_chars", "next_id", F.sha2("edited", 256).alias("edited_sha256"), digests(F.col("text")).alias("own_keys"), digests(F.col("edited")).alias("changed_keys"), "next_keys")
    for name in ("own", "changed", "next"):
        rows = with_tables(rows, name)
    rows = with_likeness(with_likeness(rows, "own", "changed", "near_edited"), "own", "next", "near_next")
    shown = lambda v: fingerprint(F.col(f"{v}_tables"), F.size(f"{v}_keys"))
    return rows.select("doc_id", "n_chars", "edited_sha256", shown("own").alias("fingerprint"), shown("changed").alias("edited_fingerprint"), "near_edited", "near_next", "next_id")
