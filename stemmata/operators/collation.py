"""From alignments to difference blocks and metrics.

An alignment's texts meet in one exchange; equal texts and one-sided blocks get their tokens in the JVM, and only changed
pairs and groups go through the word-difference function, one alignment a row. Counts and metrics are column functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.worddiff import DELETE, INSERT, DiffOptions, block_similarity, diff_texts, distributed
from ..plans.tables import written
from . import alignment

TOKENS = "array<struct<text:string,status:string>>"
MEMBERS = f"array<struct<tokens:{TOKENS},a_tokens:{TOKENS},b_tokens:{TOKENS},similarity:double>>"


def _members(a: list[str], b: list[str], relation: str, options: DiffOptions) -> list[dict]:
    as_rows = lambda tokens: [{"text": t, "status": s} for t, s in tokens]
    if relation == "MATCHED":
        unified, left, right = diff_texts(a[0], b[0], options)
        return [{"tokens": as_rows(unified), "a_tokens": as_rows(left), "b_tokens": as_rows(right), "similarity": block_similarity(a[0], b[0])}]
    many, absent = (b, DELETE) if relation == "SPLIT" else (a, INSERT)
    unified, _, _ = diff_texts(" ".join(a), " ".join(b), options)
    lengths = [len(t) + 1 for t in many[:-1]] + [len(many[-1])]
    out = []
    for tokens in distributed(unified, lengths, absent):
        left, right = ([x for x in tokens if x[1] != gone] for gone in (INSERT, DELETE))
        texts = ["".join(t for t, _ in side) for side in (left, right)]
        out.append({"tokens": as_rows(tokens), "a_tokens": as_rows(left), "b_tokens": as_rows(right), "similarity": block_similarity(*texts)})
    return out


def words_of(tokens: Column, status: str | None = None) -> Column:
    counted = tokens if status is None else F.filter(tokens, lambda t: t["status"] == status)
    return F.aggregate(F.transform(counted, lambda t: T.word_count(t["text"])), F.lit(0).cast("long"), lambda n, x: n + x)


def _met(rows: DataFrame, alignments: DataFrame) -> DataFrame:
    """alignments with their blocks on both sides as a and b."""
    alignments = written(alignments, "alignments")  # read three times
    each = lambda side: alignments.select("cmp_id", "position", F.lit(side).alias("side"), F.posexplode(f"{side}_indices").alias("nth", "block_index"))
    members = each("a").unionByName(each("b")).join(rows, ["cmp_id", "side", "block_index"])
    own = lambda side: F.transform(F.array_sort(F.filter("members", lambda m: m["side"] == side)), lambda m: m["block"])
    block = F.struct("block_index", "text", "kind", "starts_stanza", "block_id").alias("block")
    texts = members.groupBy("cmp_id", "position").agg(F.collect_list(F.struct("side", "nth", block)).alias("members")).select("cmp_id", "position", own("a").alias("a"), own("b").alias("b"))
    return alignments.join(texts, ["cmp_id", "position"])


def _listed(members: DataFrame, *more: str) -> DataFrame:
    """Difference blocks from rows of _met, one a member (nth), with further columns of theirs."""
    split, merged = F.col("relation") == "SPLIT", F.col("relation") == "MERGED"
    at_a = F.get("a", F.when(merged, F.col("nth")).otherwise(F.lit(0)))
    at_b = F.get("b", F.when(split, F.col("nth")).otherwise(F.lit(0)))
    members = members.withColumn("x", at_a).withColumn("y", at_b)
    order = Window.partitionBy("cmp_id").orderBy("position", "nth")
    heads = F.sum(F.when((split | merged) & (F.col("nth") == 0), 1).otherwise(0)).over(order)
    kind = F.coalesce(F.get("b", F.lit(0))["kind"], F.get("a", F.lit(0))["kind"])
    is_moved = F.col("move_distance").isNotNull()
    state = F.when(F.col("relation") != "MATCHED", F.col("relation")).when(is_moved, "MOVED").when(F.col("x.text") == F.col("y.text"), "UNCHANGED").otherwise("MODIFIED")
    starts = lambda side: F.coalesce(F.col(f"{side}.starts_stanza"), F.lit(False))
    boundary = F.when(starts("x") & starts("y"), "SHARED").when(starts("x"), "A_ONLY").when(starts("y"), "B_ONLY").otherwise("NONE")
    return members.select(
        "cmp_id", F.row_number().over(order).alias("seq"), state.alias("status"), kind.alias("kind"), F.col("x.block_index").alias("a_index"), F.col("y.block_index").alias("b_index"),
        F.col("x.block_id").alias("a_block_id"), F.col("y.block_id").alias("b_block_id"), *more, "move_distance",
        F.when(split | merged, F.format_string("grp_%04d", heads)).alias("group_id"), F.when(kind == "VERSE_LINE", boundary).alias("stanza_boundary"),
    )


def structure(rows: DataFrame, alignments: DataFrame) -> DataFrame:
    """Difference blocks without their tokens and what is counted from these: no words are compared."""
    n = F.when(F.col("relation") == "SPLIT", F.size("b")).when(F.col("relation") == "MERGED", F.size("a")).otherwise(1)
    members = _met(rows, alignments).withColumn("nth", F.explode(F.sequence(F.lit(0), n - 1)))
    return _listed(members).withColumn("block_id", F.format_string("dbk_%04d", "seq"))


def diff_blocks(rows: DataFrame, alignments: DataFrame, options: DiffOptions | None = None) -> DataFrame:
    """One row a difference block: cmp_id, seq, block_id, status, kind, a_index, b_index, a_block_id, b_block_id, tokens,
    a_tokens, b_tokens, similarity, edit_count, insertions, deletions, churn, move_distance, group_id, stanza_boundary."""
    options = options or DiffOptions()
    met = written(_met(rows, alignments), "met")
    a, b = F.col("a")[0]["text"], F.col("b")[0]["text"]
    simple = (F.size("a") + F.size("b") == 1) | ((F.col("relation") == "MATCHED") & (a == b))
    nothing = F.array().cast(TOKENS)
    status = F.when(F.col("relation") == "INSERTED", INSERT).when(F.col("relation") == "DELETED", DELETE).otherwise("UNCHANGED")
    whole = F.coalesce(F.get("a", F.lit(0))["text"], F.get("b", F.lit(0))["text"])
    token = F.when(whole == "", nothing).otherwise(F.array(F.struct(whole.alias("text"), status.alias("status"))))
    simple_member = F.struct(
        token.alias("tokens"), F.when(F.size("a") > 0, token).otherwise(nothing).alias("a_tokens"), F.when(F.size("b") > 0, token).otherwise(nothing).alias("b_tokens"),
        F.when((F.size("a") > 0) & (F.size("b") > 0), 1.0).otherwise(0.0).alias("similarity"),
    )

    def changed(frames):
        for f in frames:
            f["members"] = [_members(list(x), list(y), r, options) for x, y, r in zip(f["a_texts"], f["b_texts"], f["relation"], strict=True)]
            yield f[["cmp_id", "position", "members"]]

    todo = met.filter(~simple).select("cmp_id", "position", F.col("a.text").alias("a_texts"), F.col("b.text").alias("b_texts"), "relation")
    done = todo.mapInPandas(changed, f"cmp_id string, position int, members {MEMBERS}")
    both = met.join(done, ["cmp_id", "position"], "left").withColumn("members", F.coalesce("members", F.array(simple_member).cast(MEMBERS)))
    out = _listed(both.select("*", F.posexplode("members").alias("nth", "m")), "m.tokens", "m.a_tokens", "m.b_tokens", "m.similarity")
    out = out.withColumn("insertions", words_of(F.col("tokens"), INSERT)).withColumn("deletions", words_of(F.col("tokens"), DELETE))
    total = F.greatest(F.lit(1), words_of(F.col("a_tokens")) + words_of(F.col("b_tokens")))
    return out.withColumn("edit_count", F.col("insertions") + F.col("deletions")).withColumn("churn", F.round(F.col("edit_count") / total, 4)).withColumn("block_id", F.format_string("dbk_%04d", "seq"))


def document_metrics(blocks: DataFrame, *more: Column) -> DataFrame:
    """Per comparison: word sums, Dice similarity, churn and structural counts; and more aggregates, in the same look at the
    blocks."""
    status = F.col("status")
    unchanged = words_of(F.col("tokens"), "UNCHANGED")
    sums = blocks.groupBy("cmp_id").agg(
        F.sum("insertions").alias("insertions"), F.sum("deletions").alias("deletions"), F.sum(unchanged).alias("unchanged_tokens"),
        F.sum(words_of(F.col("a_tokens"))).alias("a_word_count"), F.sum(words_of(F.col("b_tokens"))).alias("b_word_count"),
        F.count_if(status == "MOVED").alias("blocks_moved"), F.count_if(status == "SPLIT").alias("blocks_split"), F.count_if(status == "MERGED").alias("blocks_merged"),
        F.count_if(F.col("stanza_boundary").isin("A_ONLY", "B_ONLY")).alias("stanza_breaks_changed"), F.count("*").alias("total_blocks"), *more,
    )
    total, edits = F.col("a_word_count") + F.col("b_word_count"), F.col("insertions") + F.col("deletions")
    return sums.withColumn("edit_count", edits).withColumn("similarity", F.when(total == 0, 1.0).otherwise(F.round(2 * F.col("unchanged_tokens") / total, 4))).withColumn("churn", F.when(total == 0, 0.0).otherwise(F.round(edits / total, 4)))


def collate(pairs: DataFrame, blocks: DataFrame, options: DiffOptions | None = None) -> DataFrame:
    """pairs (cmp_id, a_doc_id, b_doc_id) and blocks to difference blocks."""
    rows = alignment.sides(pairs, blocks, options)
    return diff_blocks(rows, alignment.align(rows, options), options)


def violations(blocks: DataFrame, metrics: DataFrame | None = None, rows: DataFrame | None = None) -> DataFrame:
    """cmp_id, seq, rule of every broken promise of the result; expected to be empty. With the sides' rows, texts and
    sums are compared with those; seq is 0 where a rule is about a comparison."""
    text = lambda tokens: F.array_join(F.transform(tokens, lambda t: t["text"]), "")
    has = lambda tokens, status: F.exists(tokens, lambda t: t["status"] == status)
    words = lambda text: F.regexp_extract_all(text, F.lit("(?U)\\S+"), F.lit(0))
    without = lambda tokens, gone: text(F.filter(tokens, lambda t: t["status"] != gone))
    a, b, tokens = F.col("a_tokens"), F.col("b_tokens"), F.col("tokens")
    rules = {
        "a_words": words(without(tokens, INSERT)) == words(text(a)),
        "b_words": words(without(tokens, DELETE)) == words(text(b)),
        "a_purity": ~has(a, INSERT),
        "b_purity": ~has(b, DELETE),
        "edit_count": F.col("edit_count") == words_of(tokens, INSERT) + words_of(tokens, DELETE),
        "inserted": F.col("a_index").isNull() == (F.col("status") == "INSERTED"),
        "deleted": F.col("b_index").isNull() == (F.col("status") == "DELETED"),
        "moved": F.col("move_distance").isNotNull() == (F.col("status") == "MOVED"),
        "grouped": F.col("group_id").isNotNull() == F.col("status").isin("SPLIT", "MERGED"),
        "stanza": F.col("stanza_boundary").isNotNull() == (F.col("kind") == "VERSE_LINE"),
    }
    broken = F.array_compact(F.array(*(F.when(~rule, F.lit(name)) for name, rule in rules.items())))
    out = blocks.select("cmp_id", "seq", F.explode(broken).alias("rule"))
    groups = blocks.filter("group_id IS NOT NULL").groupBy("cmp_id", "group_id").agg(F.countDistinct("status").alias("n"), F.min("seq").alias("seq")).filter("n > 1")
    out = out.unionByName(groups.select("cmp_id", "seq", F.lit("one_status_a_group").alias("rule")))
    if rows is not None:
        side = lambda s: blocks.filter(F.col(f"{s}_index").isNotNull()).select("cmp_id", F.lit(s).alias("side"), F.col(f"{s}_index").alias("block_index"), "seq", "group_id", text(F.col(f"{s}_tokens")).alias("shown"))
        # Blocks of a group show their parts; a block that stands alone shows its text, and every block stands somewhere.
        met = rows.select("cmp_id", "side", "block_index", "text").join(side("a").unionByName(side("b")), ["cmp_id", "side", "block_index"], "full")
        wrong = met.filter("text IS NULL OR shown IS NULL OR (group_id IS NULL AND text <> shown)")
        out = out.unionByName(wrong.select("cmp_id", F.coalesce("seq", F.lit(0)).alias("seq"), F.concat("side", F.lit("_text")).alias("rule")))
    if metrics is not None:
        again = document_metrics(blocks) if rows is None else _sums(blocks, rows)
        names = [c for c in again.columns if c != "cmp_id"]
        close = lambda c: F.coalesce(F.abs(F.col(f"m.{c}") - F.col(f"n.{c}")) <= 0.0002, F.lit(False))
        differ = F.exists(F.array(*(close(c) for c in names)), lambda ok: ~ok)
        wrong = metrics.alias("m").join(again.alias("n"), F.col("m.cmp_id") == F.col("n.cmp_id"), "full").filter(differ)
        out = out.unionByName(wrong.select(F.coalesce("m.cmp_id", "n.cmp_id").alias("cmp_id"), F.lit(0).alias("seq"), F.lit("document_sums").alias("rule")))
    return out


def _sums(blocks: DataFrame, rows: DataFrame) -> DataFrame:
    """What document_metrics sums, counted from single tokens and the sides' texts instead."""
    tokens = blocks.select("cmp_id", F.explode("tokens").alias("t")).select("cmp_id", "t.status", T.word_count(F.col("t.text")).alias("n"))
    of = lambda column, value: F.sum(F.when(F.col(column) == value, F.col("n")).otherwise(0))
    edits = tokens.groupBy("cmp_id").agg(of("status", INSERT).alias("insertions"), of("status", DELETE).alias("deletions"), of("status", "UNCHANGED").alias("unchanged_tokens"))
    texts = rows.select("cmp_id", "side", T.word_count(F.col("text")).alias("n")).groupBy("cmp_id").agg(of("side", "a").alias("a_word_count"), of("side", "b").alias("b_word_count"))
    sums = texts.join(edits, "cmp_id", "left").fillna(0, ["insertions", "deletions", "unchanged_tokens"])
    total, edited = F.col("a_word_count") + F.col("b_word_count"), F.col("insertions") + F.col("deletions")
    return sums.withColumn("edit_count", edited).withColumn("similarity", F.when(total == 0, 1.0).otherwise(2 * F.col("unchanged_tokens") / total)).withColumn("churn", F.when(total == 0, 0.0).otherwise(edited / total))
