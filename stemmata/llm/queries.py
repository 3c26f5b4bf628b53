"""The queries of this folder, one for each operator, with DuckDB SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import mixing


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def tokenizer(name: str) -> str:
    """Place of a public vocabulary; executors have the same files."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language_id import identify

    return identify(documents(spark, sf_dir))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring_dedup import remove_repeated_windows

    return remove_repeated_windows(documents(spark, sf_dir)).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix_dedup import remove_repeated_bytes

    return remove_repeated_bytes(documents(spark, sf_dir)).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_files import read_tokens, write_tokens

    files = write_tokens(documents(spark, sf_dir), tokenizer("byte_bpe_50k.json"), end_id=2)
    return read_tokens(files).select("doc_id", "start", "n_tokens", "ids_crc32")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import judge

    return judge(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix

    mixed = mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken", F.try_element_at("copies", F.lit(1))["position"].alias("position"))
    return mixed.orderBy("position", "doc_id")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(documents(spark, sf_dir), tokenizer("word_bpe_49k.json"), end_id=1, with_ids=False).drop("ids")


def op8_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A ledger for each folder of tables: what an earlier run of the query scanned there is not read again."""
    from .secrets import Ledger, scan

    found = scan(documents(spark, sf_dir), Ledger.of(spark, sf_dir))
    base = F.filter("findings", lambda x: x["kind"].isin("assign", "access", "hex"))
    listed = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["stop"])), ",")
    count = lambda kind: F.size(F.filter("findings", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("findings")).alias("spans"), "blob")


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .fingerprints import compare_with_edits

    return compare_with_edits(documents(spark, sf_dir))


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .near_dedup import near_duplicates

    return near_duplicates(documents(spark, sf_dir)).select("doc_id", "class_id", "is_first")


QUERIES = {
    "op1_language_id": op1_language_id,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_token_files": op4_token_files,
    "op5_quality_rules": op5_quality_rules,
    "op6_mixing": op6_mixing,
    "op7_packing": op7_packing,
    "op8_secret_scans": op8_secret_scans,
    "op9_fingerprints": op9_fingerprints,
    "op10_near_dedup": op10_near_dedup,
}

WORDS = r"""w AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, CASE WHEN text IS NULL THEN [] ELSE regexp_extract_all(text, '[^\x20\x09-\x0D]+') END AS words FROM documents)"""

SUBSTRING = f"""WITH {WORDS},
p AS (SELECT r, doc_id, generate_subscripts(words, 1) AS i, unnest(words) AS word, words FROM w),
k AS (SELECT r, doc_id, i, word, CASE WHEN i + 49 <= len(words) THEN md5(array_to_string(words[i:i + 49], ' ')) END AS key FROM p),
f AS (SELECT *, key IS NOT NULL AND min(coalesce(doc_id, 9223372036854775807)) OVER (PARTITION BY key) < coalesce(doc_id, 9223372036854775807) AS later FROM k),
c AS (SELECT r, i, word, max(later) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS gone FROM f),
a AS (SELECT r, count(*) FILTER (gone) AS n, string_agg(word, ' ' ORDER BY i) FILTER (NOT gone) AS kept FROM c GROUP BY r)
SELECT doc_id, len(words) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN a USING (r)"""

#: Bytes as pairs of hexadecimal digits.
SUFFIX = """WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
p AS (SELECT r, h, unnest(range(1, length(h) // 2 + 1)) AS i FROM d),
k AS (SELECT r, i, substr(h, 2 * i - 1, 2) AS b, CASE WHEN i + 399 <= length(h) // 2 THEN md5(substr(h, 2 * i - 1, 800)) END AS key FROM p),
f AS (SELECT r, i, b, key IS NOT NULL AND count(*) OVER (PARTITION BY key) > 1 AS twice FROM k),
c AS (SELECT r, i, b, max(twice) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN 399 PRECEDING AND CURRENT ROW) AS gone FROM f),
s AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY r ORDER BY i), false) AS opens FROM c),
a AS (SELECT r, count(*) FILTER (gone) AS n, count(*) FILTER (opens) AS spans, string_agg(b, '' ORDER BY i) FILTER (NOT gone) AS kept FROM s GROUP BY r)
SELECT doc_id, length(h) // 2 AS n_bytes, coalesce(n, 0) AS n_removed, coalesce(spans, 0) AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256 FROM d LEFT JOIN a USING (r)"""

NEAR = f"""WITH RECURSIVE {WORDS},
g AS (SELECT r, unnest(CASE WHEN len(words) >= 5 THEN list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' ')) WHEN len(words) > 0 THEN [array_to_string(words, ' ')] ELSE [] END) AS gram FROM w),
m AS (SELECT r, md5(gram) AS gram, count(*) AS n FROM g GROUP BY ALL),
t AS (SELECT r, sum(n) AS n FROM m GROUP BY r),
j AS (SELECT a.r AS x, b.r AS y, sum(least(a.n, b.n)) AS shared FROM m a JOIN m b ON a.gram = b.gram AND a.r < b.r GROUP BY ALL),
e AS (SELECT x, y FROM j JOIN t a ON a.r = x JOIN t b ON b.r = y WHERE shared >= 0.8 * (a.n + b.n - shared)
  UNION ALL SELECT min(r) OVER (), r FROM w WHERE len(words) = 0),
u AS (SELECT x, y FROM e UNION SELECT y, x FROM e UNION SELECT r, r FROM w),
c AS (SELECT x, y FROM u UNION SELECT c.x, u.y FROM c JOIN u ON c.y = u.x),
h AS (SELECT c.x, min(coalesce(w.doc_id, 9223372036854775807)) AS least FROM c JOIN w ON w.r = c.y GROUP BY c.x)
SELECT doc_id, CASE WHEN least < 9223372036854775807 THEN least END AS class_id, coalesce(doc_id, 9223372036854775807) = least AS is_first FROM w JOIN h ON h.x = w.r"""

#: The patterns for DuckDB's engine, which has no look-ahead; a private key without its last line ends before "-----END".
SECRET_PATTERNS = (
    ("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""),
    ("access", "AKIA[A-Z0-9]+"),
    ("hex", "[0-9a-f]{24,}"),
    ("private_key", r"-----BEGIN (?:[A-Z]+ )?PRIVATE KEY-----(?s:.*?)(?:-----END (?:[A-Z]+ )?PRIVATE KEY-----|-----END|$)"),
    ("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
    ("url_password", r"[a-z][a-z0-9+.-]{1,20}://[^\s/:@]{1,64}:[^\s/:@]{3,128}@"),
    ("provider_token", r"(?:gh[pousr]_[A-Za-z0-9]{36,}|sk_live_[A-Za-z0-9]{16,}|github_pat_[A-Za-z0-9_]{22,})"),
)


def _secret_sql() -> str:
    """A match's place: the text between matches and the matches before it."""
    quoted = [(k, n, p.replace("'", "''")) for n, (k, p) in enumerate(SECRET_PATTERNS)]
    found = " UNION ALL ".join(f"SELECT r, '{k}' AS kind, {n} AS nth, regexp_extract_all(text, '{p}', 0) AS ms, regexp_extract_all(text, '{p}', {2 if k == 'assign' else 0}) AS vs, string_split_regex(text, '{p}') AS ps FROM d" for k, n, p in quoted)
    listed = lambda where: f"coalesce(string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, nth) FILTER ({where}), '')"
    return f"""WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
m AS ({found}),
x AS (SELECT r, kind, nth, unnest(ms) AS s, unnest(vs) AS v, unnest(range(len(ms))) AS i, ms, ps FROM m),
y AS (SELECT r, kind, nth, CASE WHEN kind = 'private_key' THEN regexp_replace(s, '-----END$', '') ELSE s END AS s, v,
  CAST(list_sum(list_transform(ps[1:i + 1], lambda t: length(t))) + coalesce(list_sum(list_transform(ms[1:i], lambda t: length(t))), 0) AS BIGINT) AS start FROM x),
z AS (SELECT r, kind, nth, start, start + length(s) AS stop FROM y WHERE CASE kind WHEN 'assign' THEN length(v) >= 6 WHEN 'access' THEN length(s) >= 20 ELSE true END),
a AS (SELECT r, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex, {listed("nth < 3")} AS base, {listed("true")} AS spans FROM z GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, sha256(text) AS blob FROM d LEFT JOIN a USING (r)"""


#: Where rows of one document id repeat, op10's is_first marks one of them only by its text as well.
ORACLES: dict[str, str] = {"op2_substring_dedup": SUBSTRING, "op3_suffix_dedup": SUFFIX, "op6_mixing": mixing.ORACLE, "op8_secret_scans": _secret_sql(), "op10_near_dedup": NEAR}
