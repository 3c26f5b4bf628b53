"""Line-ending hyphens: closed up or kept on the evidence of the whole document, in column functions.

A text falls into its breaks (word, hyphen, line end, word, and a further hyphen if one follows) and the pieces between
them. Each break has two forms, as one word and as a compound. Only documents with breaks gather evidence: their forms are
looked up in the words and compounds of their candidates by a join, so no document's vocabulary is ever one value. Then a
row's breaks are judged in place and the text is put together again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

# Hyphens that may be closed up, dashes that never are, and prefixes that keep their hyphen.
HYPHENS = "-‐­"
DASHES = "–—―−"
PREFIXES = (
    "all", "anti", "co", "counter", "cross", "ex", "extra", "half", "inter", "mid", "multi", "neo", "non", "over", "post",
    "pre", "pro", "pseudo", "quasi", "re", "self", "semi", "sub", "super", "trans", "ultra", "un", "under", "well",
)

WORD = "\\w[\\w'’]*"
BREAK = f"(?U)({WORD})[{HYPHENS}]\\n({WORD})([-‐]?)"


def breaks(text: Column) -> Column:
    """Of each break: first, second (the words) and more (the hyphen after them, or nothing)."""
    group = lambda n: F.regexp_extract_all(text, F.lit(BREAK), F.lit(n))
    pairs = F.zip_with(group(1), group(2), lambda a, b: F.struct(a.alias("first"), b.alias("second")))
    return F.zip_with(pairs, group(3), lambda p, m: F.struct(p["first"].alias("first"), p["second"].alias("second"), m.alias("more")))


def forms(found: Column) -> Column:
    """The two forms of each break, as they are looked up."""
    both = F.transform(found, lambda b: F.array(F.struct(F.lit(False).alias("compound"), F.concat(b["first"], b["second"]).alias("form")), F.struct(F.lit(True).alias("compound"), F.concat_ws("-", b["first"], b["second"]).alias("form"))))
    return F.flatten(both)


def closes(b: Column, folded: Column, known: Column) -> Column:
    """Whether a break's words become one. known: forms that the document has elsewhere; folded: the break, case-folded.

    A compound that stands elsewhere, or a chain of hyphens, keeps its hyphen even against the joined word; that word,
    standing elsewhere, outweighs what the words look like: numbers, a capital after the hyphen, or a known prefix."""
    seen = lambda compound, form: F.array_contains(known, F.struct(F.lit(compound).alias("compound"), form.alias("form")))
    keeps = seen(True, F.concat_ws("-", folded["first"], folded["second"])) | (b["more"] != "")
    joined_elsewhere = seen(False, F.concat(folded["first"], folded["second"]))
    numeric = F.concat(b["first"], b["second"]).rlike("\\p{N}")
    looks_compound = numeric | b["second"].rlike("^\\p{Lu}") | folded["first"].isin(*PREFIXES)
    return ~keeps & (joined_elsewhere | ~looks_compound)


def put_together(text: Column, judged: Column) -> Column:
    """The text with its breaks (first, second, more, close) replaced and lines ending in dashes run on."""
    pieces = F.split(text, BREAK)
    words = F.transform(judged, lambda b: F.concat(b["first"], F.when(b["close"], "").otherwise("-"), b["second"], b["more"]))
    whole = F.array_join(F.flatten(F.zip_with(pieces, F.concat(words, F.array(F.lit(""))), lambda p, w: F.array(p, w))), "")
    return F.regexp_replace(whole, f"(?U)([{DASHES}])\\n(?=\\w)", "$1")


def dehyphenate(rows: DataFrame, candidates: DataFrame) -> DataFrame:
    """rows with `text` repaired and `joined` counted; candidates give the evidence, before ligatures are folded."""
    flowing = ~F.col("kind").isin("VERSE_LINE", "ARTIFACT")
    found = rows.withColumn("found", F.when(flowing & F.col("text").rlike(BREAK), breaks(F.col("text"))))
    # Case folding goes through Python, and only texts with breaks do.
    found = found.withColumn("folded", breaks(T.casefold(F.when(F.col("found").isNotNull(), F.col("text")))))
    wanted = found.filter("found IS NOT NULL").select("doc_id", F.explode(forms(F.col("folded"))).alias("f")).select("doc_id", "f.compound", "f.form").distinct()
    corpus = candidates.join(wanted.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", T.casefold(T.normalize_text(F.col("text"))).alias("text"))
    stands = lambda compound, pattern: corpus.select("doc_id", F.lit(compound).alias("compound"), F.explode(F.regexp_extract_all("text", F.lit(f"(?U){pattern}"), F.lit(0))).alias("form"))
    seen = stands(False, "[\\w'’]+").unionByName(stands(True, f"{WORD}-{WORD}")).distinct()
    known = wanted.join(seen, ["doc_id", "compound", "form"], "left_semi").groupBy(F.col("doc_id").alias("e_doc")).agg(F.collect_set(F.struct("compound", "form")).alias("known"))
    none = F.array().cast("array<struct<compound:boolean,form:string>>")
    met = found.join(known, F.col("doc_id") == F.col("e_doc"), "left").withColumn("known", F.coalesce("known", none))
    pairs = F.arrays_zip("found", "folded")
    judge = lambda x: F.struct(x["found"]["first"].alias("first"), x["found"]["second"].alias("second"), x["found"]["more"].alias("more"), closes(x["found"], x["folded"], F.col("known")).alias("close"))
    met = met.withColumn("judged", F.transform(pairs, judge))
    plain = F.regexp_replace("text", f"(?U)([{DASHES}])\\n(?=\\w)", "$1")
    text = F.when(F.col("judged").isNotNull(), put_together(F.col("text"), F.col("judged"))).when(flowing, plain).otherwise(F.col("text"))
    joined = F.when(F.col("judged").isNotNull(), F.size(F.filter("judged", lambda b: b["close"]))).otherwise(0)
    return met.withColumn("joined", joined).withColumn("text", text).drop("found", "folded", "judged", "known", "e_doc")
