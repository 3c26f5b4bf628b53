"""Queries over the driver's tables, each with DuckDB SQL where SQL can express it.

The tables hold no control characters, double spaces, ligatures, line-end hyphens or verse, so the queries on
normalisation disturb the texts first, in the same way in both engines.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.similarity import similarity_ratio
from ..operators import alignment, collation, hyphens, store, tei, views
from ..operators import blocks as B
from ..sources import markdown, pdf_lines
from . import alignment_sql as Q
from . import pairs as P
from .tables import written

FLAGSHIP = "doc_metrics"

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(run: Query) -> Query:
        QUERIES[run.__name__] = run
        if sql:
            ORACLES[run.__name__] = sql
        return run

    return register


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")


def line_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A block a line."""
    return B.build_blocks(B.line_candidates(documents(spark, sf_dir)))


def _sides(spark: SparkSession, sf_dir: str, admission: bool = True) -> tuple[DataFrame, DataFrame]:
    """The pairs that admission lets through, or all of them, and the blocks of both their sides. Refused ones reach no kernel."""
    blocks = written(line_blocks(spark, sf_dir), "blocks")
    pairs = P.sharing_pairs(blocks)
    if admission:
        pairs = pairs.join(store.route(pairs, B.metadata(blocks)).filter("route <> 'REFUSED'").select("cmp_id"), "cmp_id", "left_semi")
    return pairs, written(alignment.sides(pairs, blocks), "sides")


def _structure(spark: SparkSession, sf_dir: str, admission: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    """As _collated, but the blocks carry no tokens, and no words are compared."""
    pairs, rows = _sides(spark, sf_dir, admission)
    return pairs, rows, collation.structure(rows, alignment.align(rows))


def _collated(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Pairs, sides and difference blocks of the tables' near copies."""
    pairs, rows = _sides(spark, sf_dir)
    return pairs, rows, written(collation.diff_blocks(rows, alignment.align(rows)), "diff-blocks")


LINES = """
lines AS (SELECT doc_id, cand, trim(line, ' ') AS text FROM (SELECT doc_id, unnest(string_split(nfc_normalize(text), chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS cand FROM documents) WHERE trim(line, ' ') <> ''),
blocks AS (SELECT doc_id, CAST(row_number() OVER w - 1 AS INTEGER) AS block_index, text,
  CAST(coalesce(sum(length(text) + 2) OVER (PARTITION BY doc_id ORDER BY cand ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INTEGER) AS char_start
  FROM lines WINDOW w AS (PARTITION BY doc_id ORDER BY cand))"""
CHOSEN = LINES + """,
dl AS (SELECT DISTINCT doc_id, text FROM blocks),
rare AS (SELECT text FROM dl GROUP BY text HAVING count(*) > 1),
sh AS (SELECT a.doc_id AS a_doc_id, b.doc_id AS b_doc_id, count(*) AS shared FROM dl a JOIN rare USING (text) JOIN dl b ON a.text = b.text AND a.doc_id < b.doc_id GROUP BY ALL),
pairs AS (SELECT 'cmp_' || a_doc_id || '_' || b_doc_id AS cmp_id, a_doc_id, b_doc_id, shared FROM sh QUALIFY row_number() OVER (PARTITION BY b_doc_id ORDER BY shared DESC, a_doc_id) = 1),
"""
SIDES = """rows AS (SELECT cmp_id, 'a' AS side, block_index, text FROM %(of)s JOIN blocks ON doc_id = a_doc_id UNION ALL SELECT cmp_id, 'b', block_index, text FROM %(of)s JOIN blocks ON doc_id = b_doc_id),
anchors AS (SELECT cmp_id, max(block_index) FILTER (side = 'a') AS a_index, max(block_index) FILTER (side = 'b') AS b_index FROM rows GROUP BY cmp_id, text HAVING count(*) FILTER (side = 'a') = 1 AND count(*) FILTER (side = 'b') = 1)"""
PAIRS = CHOSEN + """size AS (SELECT doc_id, count(*) AS n, sum(len(regexp_extract_all(text, '\\S+'))) AS w FROM blocks GROUP BY doc_id),
admitted AS (SELECT pairs.* FROM pairs JOIN size x ON x.doc_id = a_doc_id JOIN size y ON y.doc_id = b_doc_id WHERE x.n + y.n <= 12000 AND x.w + y.w <= 700000),
""" + SIDES % {"of": "admitted"}
# As PAIRS, but with every pair, however large.
EVERY_PAIR = CHOSEN + SIDES % {"of": "pairs"}
# Parts between blank lines of `c` (doc_id, cand, text), verse as lines: r (doc_id, cand, part, line, text, verse).
VERSE = """
p AS (SELECT doc_id, cand, generate_subscripts(a, 1) AS part, unnest(a) AS t FROM (SELECT doc_id, cand, list_filter(list_transform(string_split_regex(text, '\\n[ \\t]*\\n+'), lambda x: trim(x, ' ' || chr(9) || chr(10))), lambda x: x <> '') AS a FROM c)),
l AS (SELECT *, list_filter(string_split(t, chr(10)), lambda x: trim(x) <> '') AS ls FROM p),
m AS (SELECT *, len(ls) AS k, list_transform(ls, lambda x: length(x)) AS n, list_sort(list_transform(ls, lambda x: length(x))) AS o, list_sort(list_transform(ls, lambda x: len(regexp_extract_all(x, '\\S+')))) AS w FROM l),
d AS (SELECT *, (o[k // 2 + 1] + o[(k - 1) // 2 + 1]) / 2.0 AS med FROM m),
v AS (SELECT *, coalesce(k >= 3 AND med > 0 AND med <= 45 AND len(list_filter(n[1:k - 1], lambda x: x < med * 0.55)) = 0 AND list_max(n) - list_min(n) < med * 0.6 AND w[k // 2 + 1] >= 3, false) AS verse FROM d),
r AS (SELECT doc_id, cand, part, verse, unnest(CASE WHEN verse THEN range(1, k + 1) ELSE [1::BIGINT] END) AS line, unnest(CASE WHEN verse THEN list_transform(ls, lambda x: trim(x)) ELSE [t] END) AS text FROM v)"""
FOLDED = "replace(replace(replace(replace(%s, 'œ', 'oe'), 'æ', 'ae'), 'Œ', 'OE'), 'Æ', 'AE')"
TIDY = "trim(regexp_replace(regexp_replace(" + FOLDED + ", '[ \\t]+', ' ', 'g'), ' \\n', chr(10), 'g'), ' ' || chr(9) || chr(10))"
WORDS = "len(regexp_extract_all(text, '\\S+'))"


@query(f"WITH {LINES} SELECT doc_id, block_index, format('blk_a_{{:04d}}', block_index) AS block_id, text, char_start, CAST(char_start + length(text) AS INTEGER) AS char_end FROM blocks")
def blocks_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_blocks(spark, sf_dir).select("doc_id", "block_index", "block_id", "text", "char_start", "char_end")


@query(f"WITH {LINES} SELECT doc_id, CAST(sum({WORDS}) AS BIGINT) AS word_count, count(*) AS block_count, CAST(sum(length(text)) + 2 * (count(*) - 1) AS BIGINT) AS char_count FROM blocks GROUP BY doc_id")
def doc_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.metadata(line_blocks(spark, sf_dir))


@query(r"""SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(nfc_normalize(regexp_replace(replace(replace(regexp_replace(text, 'e', 'e' || chr(769), 'g'), chr(10), chr(13) || chr(10)), ', ', ',' || chr(9) || '  ' || chr(7)), ' of ', ' of' || chr(12), 'g')), '\r\n?|\f', chr(10), 'g'), '[\x00-\x08\x0b\x0e-\x1f\x7f]', '', 'g'), '[ \t]*\n', chr(10), 'g').regexp_replace('[ \t]+', ' ', 'g'), ' ' || chr(10) || chr(9)) AS text FROM documents""")
def text_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Disturbed by decomposed letters, CR LF, tabs, BEL and form feeds, then normalised."""
    text = F.regexp_replace("text", "e", "é")
    text = F.regexp_replace(F.replace(F.replace(text, F.lit("\n"), F.lit("\r\n")), F.lit(", "), F.lit(",\t  \u0007")), " of ", " of\f")
    return documents(spark, sf_dir).select("doc_id", T.normalize_text(text).alias("text"))


@query("SELECT doc_id, " + "".join("replace(" for _ in range(4)) + "replace(replace(replace(text, 'fi', 'ﬁ'), 'oe', 'œ'), 'st', 'ﬆ'), 'ﬁ', 'fi'), 'œ', 'oe'), 'ﬆ', 'st'), 'æ', 'ae') AS text FROM documents")
def ligature_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    for letters, ligature in (("fi", "ﬁ"), ("oe", "œ"), ("st", "ﬆ")):
        text = F.replace(text, F.lit(letters), F.lit(ligature))
    return documents(spark, sf_dir).select("doc_id", T.fold_ligatures(text).alias("text"))


@query(r"SELECT doc_id, CAST(generate_subscripts(t, 1) - 1 AS INTEGER) AS n, unnest(t) AS token FROM (SELECT doc_id, regexp_extract_all(text, '\S+\s*') AS t FROM documents)")
def word_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", F.posexplode(T.words(F.col("text"))).alias("n", "token"))


@query("SELECT doc_id, token, count(*) AS n FROM (SELECT doc_id, unnest(string_split(text, '')) AS token FROM documents) GROUP BY ALL")
def char_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", F.explode(T.characters(F.col("text"))).alias("token")).groupBy("doc_id", "token").agg(F.count("*").alias("n"))


@query(r"SELECT key, count(*) AS n FROM (SELECT regexp_replace(replace(lower(unnest(regexp_extract_all(text, '\S+'))), 'ß', 'ss'), '\p{P}', '', 'g') AS key FROM documents) GROUP BY key")
def comparison_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Case folded in Python over different tokens only."""
    tokens = documents(spark, sf_dir).select(F.explode(T.words(F.col("text"))).alias("token")).groupBy("token").agg(F.count("*").alias("c"))
    return tokens.groupBy(T.comparison_key(F.col("token"), ignore_case=True, ignore_punctuation=True).alias("key")).agg(F.sum("c").alias("n"))


@query(r"""WITH w AS (SELECT doc_id, regexp_replace(text, '((?:\S+\s+){4}\S+)\s', '\1' || chr(10), 'g') AS text FROM documents),
l AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '') AS ls FROM w),
m AS (SELECT doc_id, ls, list_transform(ls, lambda x: length(x)) AS n FROM l), s AS (SELECT *, list_sort(n) AS o, len(n) AS c FROM m),
d AS (SELECT *, CASE WHEN c = 0 THEN NULL ELSE (o[c // 2 + 1] + o[(c - 1) // 2 + 1]) / 2.0 END AS med FROM s)
SELECT doc_id, coalesce(c >= 3 AND med > 0 AND med <= 45 AND len(list_filter(n[1:c - 1], lambda x: x < med * 0.55)) = 0 AND list_max(n) - list_min(n) < med * 0.6, false) AS verse FROM d""")
def verse_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts rewrapped to five words a line first."""
    text = F.regexp_replace("text", "((?:\\S+\\s+){4}\\S+)\\s", "$1\n")
    return documents(spark, sf_dir).select("doc_id", T.looks_like_verse(text).alias("verse"))


@query("WITH c AS (SELECT doc_id, 0 AS cand, " + TIDY % "regexp_replace(text, '((?:\\S+\\s+){4}\\S+)\\s', '\\1' || chr(10), 'g')" + f" AS text FROM documents), {VERSE} SELECT doc_id, CASE WHEN verse THEN 'VERSE_LINE' ELSE 'PARAGRAPH' END AS kind, count(*) AS n, count(*) FILTER (verse AND line = 1) AS stanzas FROM r GROUP BY ALL")
def verse_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.regexp_replace("text", "((?:\\S+\\s+){4}\\S+)\\s", "$1\n")
    return B.build_blocks(B.text_candidates(documents(spark, sf_dir).withColumn("text", text))).groupBy("doc_id", "kind").agg(F.count("*").alias("n"), F.count_if("starts_stanza").alias("stanzas"))


LETTER = "[\\p{L}\\p{M}\\p{Nd}_]"
ANY_WORD = f"{LETTER}(?:{LETTER}|[''’])*"
BREAK = f"({ANY_WORD})[-‐­]\\n({ANY_WORD})([-‐]?)"
KEY = "replace(lower(%s), 'ß', 'ss')"


@query(f"""WITH t AS (SELECT doc_id, {TIDY % "regexp_replace(text, '([a-z]{4})([a-z]{5})', '\\1-' || chr(10) || '\\2', 'g')"} AS text FROM documents),
e AS (SELECT *, regexp_extract_all({KEY % "text"}, '(?:{LETTER}|[''’])+') AS words, regexp_extract_all({KEY % "text"}, '{ANY_WORD}-{ANY_WORD}') AS compounds,
  string_split_regex(text, '{BREAK}') AS pieces, regexp_extract_all(text, '{BREAK}', 1) AS f, regexp_extract_all(text, '{BREAK}', 2) AS g, regexp_extract_all(text, '{BREAK}', 3) AS h FROM t),
d1 AS (SELECT *, list_transform(range(1, len(f) + 1), lambda i: NOT (list_contains(compounds, {KEY % "f[i] || '-' || g[i]"}) OR h[i] <> '') AND (list_contains(words, {KEY % "f[i] || g[i]"})
  OR NOT (regexp_matches(f[i] || g[i], '\\p{{N}}') OR regexp_matches(g[i], '^\\p{{Lu}}') OR list_contains([{", ".join(f"'{p}'" for p in hyphens.PREFIXES)}], {KEY % "f[i]"})))) AS closed FROM e),
w AS (SELECT doc_id, regexp_replace(array_to_string(list_transform(range(1, len(pieces) + 1), lambda i: pieces[i] || CASE WHEN i > len(f) THEN '' ELSE f[i] || CASE WHEN closed[i] THEN '' ELSE '-' END || g[i] || h[i] END), ''), '([–—―−])\\n({LETTER})', '\\1\\2', 'g') AS text FROM d1),
l1 AS (SELECT doc_id, text, string_split(text, chr(10)) AS raw, list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '') AS ls FROM w),
l2 AS (SELECT *, len(ls) AS k, list_transform(ls, lambda x: length(x)) AS n, list_sort(list_transform(ls, lambda x: length(x))) AS o FROM l1),
l3 AS (SELECT *, (o[k // 2 + 1] + o[(k - 1) // 2 + 1]) / 2.0 AS med FROM l2),
l4 AS (SELECT *, coalesce(k >= 3 AND med > 0 AND med <= 45 AND len(list_filter(n[1:k - 1], lambda x: x < med * 0.55)) = 0 AND list_max(n) - list_min(n) < med * 0.6, false) AS verse FROM l3),
c AS (SELECT doc_id, 0 AS cand, {TIDY % ("CASE WHEN len(raw) < 2 OR verse THEN text ELSE array_to_string(list_reduce(list_transform(ls, lambda x: [trim(x)]), "
  "lambda acc, x: CASE WHEN len(acc) = 0 OR (k >= 4 AND length(acc[-1]) < med * 0.55) THEN acc || x ELSE acc[1:-2] || [acc[-1] || ' ' || x[1]] END, CAST([] AS VARCHAR[])), chr(10)) END")} AS text FROM l4), {VERSE}
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY cand, part, line) - 1 AS INTEGER) AS block_index, CASE WHEN verse THEN 'VERSE_LINE' ELSE 'PARAGRAPH' END AS kind, text FROM r""")
def dehyphenated_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long words broken over lines, then closed up on the document's evidence and reflowed."""
    text = F.regexp_replace("text", "([a-z]{4})([a-z]{5})", "$1-\n$2")
    docs = documents(spark, sf_dir).withColumn("text", text)
    return B.build_blocks(B.text_candidates(docs), reflow_lines=True).select("doc_id", "block_index", "kind", "text")


@query(f"WITH {PAIRS} SELECT cmp_id, a_doc_id, b_doc_id, shared FROM pairs")
def witness_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.sharing_pairs(line_blocks(spark, sf_dir))


@query(f"WITH {PAIRS} SELECT cmp_id, a_index, b_index FROM anchors")
def anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.anchors(_sides(spark, sf_dir)[1])


@query(f"WITH {PAIRS} SELECT cmp_id, side, block_index FROM rows ANTI JOIN (SELECT cmp_id, 'a' AS side, a_index AS block_index FROM anchors UNION ALL SELECT cmp_id, 'b', b_index FROM anchors) USING (cmp_id, side, block_index)")
def unmatched_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, rows = _sides(spark, sf_dir)
    return alignment.gaps(rows, alignment.anchors(rows)).select("cmp_id", "side", "block_index")


@query(f"WITH {PAIRS}, {Q.CANDIDATES} SELECT cmp_id, gap, i AS a_index, j AS b_index, score FROM scored")
def gap_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, rows = _sides(spark, sf_dir)
    return alignment.scored(alignment.gaps(rows, written(alignment.anchors(rows), "anchors")))


@query(f"WITH {PAIRS}, {Q.CANDIDATES} SELECT cmp_id, i AS a_index, j AS b_index, score FROM paired")
def greedy_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.assigned(gap_candidates(spark, sf_dir))


# A longest common subsequence is a longest increasing one of the places in b that match, by place in a, then backwards.
@query("""WITH t AS (SELECT item_id, text, coalesce(lead(text) OVER (ORDER BY item_id), (SELECT min_by(text, item_id) FROM benchmark)) AS later FROM benchmark),
a AS (SELECT item_id, unnest(string_split(text, '')) AS c, generate_subscripts(string_split(text, ''), 1) AS i FROM t WHERE text <> ''),
b AS (SELECT item_id, unnest(string_split(later, '')) AS c, generate_subscripts(string_split(later, ''), 1) AS j FROM t WHERE later <> ''),
m AS (SELECT item_id, list([j] ORDER BY i, j DESC) AS js FROM a JOIN b USING (item_id, c) GROUP BY item_id),
s AS (SELECT item_id, len(list_reduce(js, lambda ends, x: ends[1:len(list_filter(ends, lambda e: e < x[1]))] || x || ends[len(list_filter(ends, lambda e: e < x[1])) + 2:])) AS lcs FROM m)
SELECT item_id, CASE WHEN text = '' AND later = '' THEN 1.0::DOUBLE ELSE 2 * coalesce(lcs, 0)::DOUBLE / (length(text) + length(later)) END AS score FROM t LEFT JOIN s USING (item_id)""")
def similarity_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each benchmark passage against the next one, and the last against the first."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    ordered, whole = Window.orderBy("item_id"), Window.partitionBy(F.lit(1))
    later = F.coalesce(F.lead("text").over(ordered), F.min_by("text", "item_id").over(whole))
    return items.withColumn("later", later).select("item_id", similarity_ratio(F.col("text"), F.col("later")).alias("score"))


@query(f"""WITH {PAIRS}, {Q.ALIGNED}
SELECT cmp_id, position, relation, array_to_string(xs, ',') AS a_indices, array_to_string(ys, ',') AS b_indices, similarity, move_distance FROM aligned""")
def alignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = alignment.align(_sides(spark, sf_dir)[1])
    numbers = lambda c: F.array_join(F.col(c).cast("array<string>"), ",").alias(c)
    return found.select("cmp_id", "position", "relation", numbers("a_indices"), numbers("b_indices"), "similarity", "move_distance")


@query()
def diff_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _collated(spark, sf_dir)[2]


@query(f"""WITH {EVERY_PAIR}, {Q.LISTED}
SELECT cmp_id, seq, format('dbk_{{:04d}}', seq) AS block_id, status, 'PARAGRAPH' AS kind, i AS a_index, j AS b_index, format('blk_a_{{:04d}}', i) AS a_block_id, format('blk_a_{{:04d}}', j) AS b_block_id, move_distance, CASE WHEN key LIKE 'grp%' THEN key END AS group_id FROM listed""")
def block_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Difference blocks of every pair, also of those that admission refuses, without their tokens and what is counted from
    these."""
    return _structure(spark, sf_dir, admission=False)[2].select("cmp_id", "seq", "block_id", "status", "kind", "a_index", "b_index", "a_block_id", "b_block_id", "move_distance", "group_id")


@query("SELECT CAST(NULL AS VARCHAR) AS cmp_id, CAST(NULL AS INTEGER) AS seq, CAST(NULL AS VARCHAR) AS rule WHERE false")
def invariant_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, rows, blocks = _collated(spark, sf_dir)
    return collation.violations(blocks, collation.document_metrics(blocks), rows)


@query()
def doc_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, rows = _sides(spark, sf_dir)
    return collation.document_metrics(collation.diff_blocks(rows, alignment.align(rows)))  # read once


@query(f"WITH {PAIRS}, n AS (SELECT cmp_id, sum({WORDS}) FILTER (side = 'a') AS a, sum({WORDS}) FILTER (side = 'b') AS b FROM rows GROUP BY cmp_id) SELECT cmp_id, CAST(a AS BIGINT) AS a_word_count, CAST(b AS BIGINT) AS b_word_count FROM n")
def word_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of both sides as the difference blocks carry them: none is lost or doubled."""
    return doc_metrics(spark, sf_dir).select("cmp_id", "a_word_count", "b_word_count")


@query(f"""WITH {PAIRS}, t AS (SELECT cmp_id, count(*) FILTER (side = 'a') AS na, count(*) FILTER (side = 'b') AS nb FROM rows GROUP BY cmp_id),
k AS (SELECT cmp_id, count(*) AS n, sum({WORDS}) AS words FROM anchors JOIN rows USING (cmp_id) WHERE side = 'a' AND block_index = a_index GROUP BY cmp_id)
SELECT cmp_id, n AS unchanged_blocks, CAST(words AS BIGINT) AS unchanged_words FROM t JOIN k USING (cmp_id) WHERE n = na AND n = nb""")
def exact_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Comparisons that anchors cover wholly, with their unchanged or moved blocks."""
    _, rows = _sides(spark, sf_dir)
    lines = written(alignment.anchors(rows).groupBy("cmp_id").agg(F.count("*").alias("k")), "anchored-lines")
    # Others hold a block that no anchor holds; they are set aside before anything is aligned.
    sizes = rows.groupBy("cmp_id").agg(F.count_if(F.col("side") == "a").alias("n_a"), F.count_if(F.col("side") == "b").alias("n_b"))
    rows = written(rows.join(sizes.join(lines, "cmp_id").filter("k = n_a AND k = n_b").select("cmp_id"), "cmp_id", "left_semi"), "anchored-sides")
    blocks = collation.diff_blocks(rows, alignment.align(rows))
    anchored = (F.col("similarity") == 1.0) & (F.col("insertions") + F.col("deletions") == 0)
    whole = blocks.groupBy("cmp_id").agg(F.count("*").alias("unchanged_blocks"), F.count_if(anchored & F.col("status").isin("UNCHANGED", "MOVED")).alias("n"), F.sum(collation.words_of(F.col("tokens"))).alias("unchanged_words"))
    return whole.join(lines, "cmp_id").filter("n = unchanged_blocks AND k = n").select("cmp_id", "unchanged_blocks", "unchanged_words")


@query(f"WITH {PAIRS}, {Q.LISTED} SELECT cmp_id, CAST(row_number() OVER (PARTITION BY cmp_id ORDER BY seq) AS INTEGER) AS change, seq, status FROM listed WHERE status <> 'UNCHANGED'")
def changed_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.changed_blocks(_structure(spark, sf_dir)[2])


@query(f"""WITH {PAIRS}, {Q.LISTED}, g AS (SELECT cmp_id, status, key, list_sort(list(DISTINCT i + 1)) AS a, list_sort(list(DISTINCT j + 1)) AS b, list_sort(list(seq)) AS m FROM listed WHERE status IN ('MOVED', 'SPLIT', 'MERGED') GROUP BY ALL)
SELECT cmp_id, status, key, array_to_string(a, ', ') AS a_positions, array_to_string(b, ', ') AS b_positions, array_to_string(m, ', ') AS members,
'A ' || array_to_string(a, ', ') || CASE status WHEN 'MOVED' THEN ' now stands at ' WHEN 'SPLIT' THEN ' was split into ' ELSE ' were merged into ' END || 'B ' || array_to_string(b, ', ') AS sentence,
row_number() OVER (PARTITION BY cmp_id ORDER BY m[1]) <= 5 AS shown FROM g""")
def structural_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = views.structural_relationships(_structure(spark, sf_dir)[2])
    numbers = lambda c: F.array_join(F.col(c).cast("array<string>"), ", ").alias(c)
    return found.select("cmp_id", "status", "key", numbers("a_positions"), numbers("b_positions"), numbers("members"), "sentence", "shown")


@query(f"""WITH {PAIRS}, n AS (SELECT cmp_id, side, count(*) AS n FROM rows GROUP BY ALL)
SELECT cmp_id, side, block_index, CASE WHEN length(t) > 110 THEN rtrim(substr(t, 1, 109)) || '…' ELSE t END AS excerpt
FROM (SELECT cmp_id, side, block_index, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS t FROM rows JOIN n USING (cmp_id, side) WHERE n <= 12)""")
def source_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can express of source_structure: the excerpts of sides shown whole."""
    _, rows = _sides(spark, sf_dir)
    whole = written(rows.groupBy("cmp_id", "side").agg(F.count("*").alias("n")).filter(F.col("n") <= views.SHOWN).select("cmp_id", "side"), "whole-sides")
    # Comparisons without such a side are set aside before they are aligned.
    rows = written(rows.join(whole.select("cmp_id").distinct(), "cmp_id", "left_semi"), "shown-sides")
    blocks = collation.structure(rows, alignment.align(rows))
    return views.source_order(blocks, texts=rows).join(whole, ["cmp_id", "side"], "left_semi").select("cmp_id", "side", "block_index", "excerpt")


@query(f"""WITH {PAIRS}, {Q.LISTED},
o AS (SELECT cmp_id, 'a' AS side, i AS block_index, j AS other, status FROM listed WHERE i IS NOT NULL UNION ALL SELECT cmp_id, 'b', j, i, status FROM listed WHERE j IS NOT NULL),
g AS (SELECT cmp_id, side, block_index, bool_or(status IN ('MOVED', 'SPLIT', 'MERGED')) AS structural, list_sort(list(DISTINCT other + 1) FILTER (other IS NOT NULL)) AS others FROM o GROUP BY ALL),
n AS (SELECT *, count(*) OVER (PARTITION BY cmp_id, side) AS n, row_number() OVER (PARTITION BY cmp_id, side ORDER BY structural DESC, block_index) AS nth FROM g)
SELECT cmp_id, side, block_index, structural, coalesce(array_to_string(others, ', '), '') AS others FROM n WHERE n <= 12 OR (structural AND nth <= 12)""")
def source_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each side's shown blocks in its own order, gathered over splits and merges, with the flag of moved, split and merged
    ones and their places on the other side; of long sides those alone. Their excerpts are source_order's."""
    found = views.source_order(_structure(spark, sf_dir)[2])
    return found.select("cmp_id", "side", "block_index", "structural", F.array_join(F.col("others").cast("array<string>"), ", ").alias("others"))


@query(f"WITH {LINES} SELECT 'doc_' || doc_id AS cmp_id, block_index + 1 AS seq, text FROM blocks WHERE block_index BETWEEN 2 AND 5")
def block_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = line_blocks(spark, sf_dir).select(F.format_string("doc_%d", "doc_id").alias("cmp_id"), (F.col("block_index") + 1).alias("seq"), "text")
    return views.page(blocks, 2, 4)


# By the number of blocks alone: SQL has no tokens whose JSON it could measure.
@query(f"WITH {PAIRS}, {Q.LISTED} SELECT cmp_id, CAST(CASE WHEN count(*) > 2500 THEN 200 ELSE count(*) END AS BIGINT) AS n, count(*) > 2500 AS truncated FROM listed GROUP BY cmp_id")
def windowed_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.windowed(_collated(spark, sf_dir)[2]).groupBy("cmp_id").agg(F.count("*").alias("n"), F.max("truncated").alias("truncated"))


@query()
def tei_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs, rows = _sides(spark, sf_dir)
    blocks = collation.diff_blocks(rows, alignment.align(rows))  # read once
    titles = pairs.select("cmp_id", F.format_string("Document %d", "a_doc_id").alias("a_title"), F.format_string("Document %d", "b_doc_id").alias("b_title"), F.lit("TXT").alias("a_format"), F.lit("TXT").alias("b_format"))
    return tei.export(blocks, None, titles)


@query(f"""WITH {PAIRS}, m AS (SELECT doc_id, count(*) AS n, sum({WORDS}) AS w FROM blocks GROUP BY doc_id)
SELECT cmp_id, a_doc_id, b_doc_id, a.n + b.n AS blocks, CAST(a.w + b.w AS BIGINT) AS words, CASE WHEN a.n + b.n > 12000 OR a.w + b.w > 700000 THEN 'REFUSED' WHEN a.n + b.n <= 4000 AND a.w + b.w <= 220000 THEN 'INLINE' ELSE 'BACKGROUND' END AS route
FROM pairs JOIN m a ON a.doc_id = a_doc_id JOIN m b ON b.doc_id = b_doc_id""")
def admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = line_blocks(spark, sf_dir)
    return store.route(P.sharing_pairs(blocks), B.metadata(blocks))


@query("""WITH n AS (SELECT max(ts) AS now FROM events), d AS (SELECT event_id, ts + INTERVAL 7 DAY AS expires_at FROM events)
SELECT CAST(CAST(expires_at AS DATE) AS VARCHAR) AS expires_on, count(*) AS n FROM d, n WHERE expires_at > now GROUP BY 1""")
def ttl_live(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as stored documents, seen at the time of the last one."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    now = F.lit(events.agg(F.max("ts")).first()[0])
    stored = store.with_expiry(events.select(F.col("event_id").alias("doc_id"), "ts"), F.col("ts"))
    return store.live(stored, now).groupBy(F.col("expires_on").cast("string").alias("expires_on")).agg(F.count("*").alias("n"))


@query(r"""WITH l AS (SELECT doc_id, generate_subscripts(s, 1) - 1 AS n, unnest(s) AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents)),
g AS (SELECT doc_id, n, text, n // 8 + 1 AS page, (n % 8) * 12.0 + 100 + CASE WHEN (n % 8) >= 4 THEN 20 ELSE 0 END AS top FROM l),
s AS (SELECT *, lag(page) OVER w AS pp, lag(top) OVER w AS pt, lag(text) OVER w AS px FROM g WINDOW w AS (PARTITION BY doc_id ORDER BY n)),
st AS (SELECT doc_id, round(top - pt, 1) AS step, count(*) AS c, min(n) AS f FROM s WHERE pp = page AND top > pt GROUP BY ALL),
ldg AS (SELECT doc_id, CASE WHEN max(c) > 1 THEN arg_max(step, (c, -f)) ELSE min(step) END AS ld FROM st GROUP BY doc_id),
k AS (SELECT s.*, pp IS NULL OR (page = pp AND coalesce(ld, 0) > 0 AND top - pt > ld * 1.6) OR (page <> pp AND regexp_matches(rtrim(px), '[.!?"”’'']$')) AS brk FROM s LEFT JOIN ldg USING (doc_id)),
b AS (SELECT *, sum(CASE WHEN brk THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY n) AS block FROM k)
SELECT doc_id, CAST(min(n) AS INTEGER) AS cand, string_agg(text, chr(10) ORDER BY n) AS text FROM b GROUP BY doc_id, block""")
def pdf_line_grouping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines set eight to a page, with a wider gap in its middle."""
    lines = documents(spark, sf_dir).select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "text"))
    nth = F.col("line_no") % 8
    lines = lines.withColumn("page", F.floor(F.col("line_no") / 8) + 1).withColumn("top", nth * 12.0 + 100 + F.when(nth >= 4, 20).otherwise(0)).withColumn("page_height", F.lit(792.0))
    return pdf_lines.candidates(lines).select("doc_id", "cand", "text")


@query(r"""WITH t AS (SELECT doc_id, regexp_replace(regexp_replace(text, '\n(\w+) ', chr(10) || '> *\1* ', 'g'), '\. ', '.' || chr(10) || '- ', 'g') AS text FROM documents),
l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM t),
k AS (SELECT *, CASE WHEN trim(line) = '' THEN 'BLANK' WHEN regexp_matches(line, '^#{1,6}[ \t]+.+?[ \t#]*$') THEN 'HEADING' WHEN regexp_matches(line, '^[ \t]*>') THEN 'QUOTE' WHEN regexp_matches(line, '^[ \t]*(?:[-*+]|[0-9]+[.)])[ \t]+.+$') THEN 'LIST_ITEM' ELSE 'PARAGRAPH' END AS kind FROM l),
b AS (SELECT *, trim(CASE kind WHEN 'HEADING' THEN regexp_extract(line, '^#{1,6}[ \t]+(.+?)[ \t#]*$', 1) WHEN 'QUOTE' THEN regexp_extract(line, '^[ \t]*>[ \t]?(.*)$', 1) WHEN 'LIST_ITEM' THEN regexp_extract(line, '^[ \t]*(?:[-*+]|[0-9]+[.)])[ \t]+(.+)$', 1) ELSE line END) AS body,
  kind = 'PARAGRAPH' AND coalesce(lag(kind) OVER (PARTITION BY doc_id ORDER BY n) = 'PARAGRAPH', false) AS grows FROM k),
g AS (SELECT *, sum(CASE WHEN grows THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY n) AS block FROM b),
j AS (SELECT doc_id, any_value(kind) AS kind, string_agg(body, chr(10) ORDER BY n) AS raw FROM g WHERE kind <> 'BLANK' GROUP BY doc_id, block),
s AS (SELECT doc_id, kind, regexp_replace(regexp_replace(raw, '\*\*(.+?)\*\*', '\1', 'g'), '(^|[^*])\*([^*\n]+)\*', '\1\2', 'g') AS text FROM j UNION ALL SELECT doc_id, 'HEADING', 'Title' FROM documents)
SELECT doc_id, kind, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS chars FROM s GROUP BY ALL""")
def markdown_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with headings, quotes, lists and emphasis put in."""
    text = F.concat(F.lit("# Title\n\n"), F.regexp_replace(F.regexp_replace("text", "\n(\\w+) ", "\n> *$1* "), "\\. ", ".\n- "))
    return markdown.candidates(documents(spark, sf_dir).withColumn("text", text)).groupBy("doc_id", "kind").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))


@query("WITH c AS (SELECT conv_id AS doc_id, turn AS cand, " + TIDY % "text" + f""" AS text FROM conversations), {VERSE}
SELECT doc_id, CAST(row_number() OVER w - 1 AS INTEGER) AS block_index, format('blk_a_{{:04d}}', row_number() OVER w - 1) AS block_id, CASE WHEN verse THEN 'VERSE_LINE' ELSE 'PARAGRAPH' END AS kind, text, CAST(NULL AS VARCHAR) AS style, CAST(NULL AS INTEGER) AS page,
CAST(coalesce(sum(length(text) + 2) OVER b, 0) AS INTEGER) AS char_start, CAST(coalesce(sum(length(text) + 2) OVER b, 0) + length(text) AS INTEGER) AS char_end, verse AND line = 1 AS starts_stanza
FROM r WINDOW w AS (PARTITION BY doc_id ORDER BY cand, part, line), b AS (PARTITION BY doc_id ORDER BY cand, part, line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
def conversation_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as candidates: the second corpus."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return B.build_blocks(turns.select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("cand"), F.lit("PARAGRAPH").alias("kind"), "text", F.lit(None).cast("string").alias("style"), F.lit(None).cast("int").alias("page")))
