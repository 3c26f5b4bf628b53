"""Secret scans with an incremental blob ledger.

Every row is a version at a path (doc_id); its content address is the SHA-256 of its UTF-8 text. The ledger is a table in
the shared folder that outlives the query: a row for each blob and rule version that was scanned, with its findings. A
scan takes the blobs of the given versions that the ledger lacks for this rule version, reads each such blob once, and
appends them in one commit, so a scan that dies leaves the ledger as it was; findings are then joined from the ledger
back to all versions by blob. Blobs of one content are one scan, however many paths hold them; each map task sends only
one of equal blobs. The rule version is a digest of the rules, so changed rules are scanned anew. Two scans at once may
both add a blob; it counts once.

Kinds: the three base patterns, which always stay, and ADDED: private-key blocks, JSON web tokens, passwords in URLs and
provider tokens. Spans are code-point places, end exclusive.

Defined results: a null text is the empty blob and has no findings; repeated rows are each returned; an empty table
gives no row; null ids are allowed; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batches, shared_dir, with_text_key

KINDS = ("assign", "access", "hex", "private_key", "jwt", "url_password", "provider_token")
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
HINTS = ("passw", "secret", "token", "api")
ACCESS = re.compile("AKIA[A-Z0-9]+")
HEX = re.compile("[0-9a-f]{24,}")
ADDED = (
    ("private_key", "PRIVATE KEY-----", re.compile(r"-----BEGIN (?:[A-Z]+ )?PRIVATE KEY-----(?:(?!-----END)[\s\S])*(?:-----END (?:[A-Z]+ )?PRIVATE KEY-----)?")),
    ("jwt", "eyJ", re.compile(r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}")),
    ("url_password", "://", re.compile(r"[a-z][a-z0-9+.-]{1,20}://[^\s/:@]{1,64}:[^\s/:@]{3,128}@")),
    ("provider_token", "_", re.compile(r"(?:gh[pousr]_[A-Za-z0-9]{36,}|sk_live_[A-Za-z0-9]{16,}|github_pat_[A-Za-z0-9_]{22,})")),
)
#: The rule version.
RULES = hashlib.sha256(repr((ASSIGN.pattern, ACCESS.pattern, HEX.pattern, [(k, p.pattern) for k, _, p in ADDED])).encode()).hexdigest()[:16]
FINDINGS = "array<struct<kind:string,start:int,stop:int>>"
LEDGER = f"blob string, rules string, findings {FINDINGS}"


def find(text: str) -> list[tuple[str, int, int]]:
    """All spans of a text, by start, then kind."""
    out: list[tuple[int, int, int]] = []
    low = text.lower()
    if any(h in low for h in HINTS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    for k, (_, hint, pattern) in enumerate(ADDED, 3):
        if hint in text:
            out += [(m.start(), k, m.end()) for m in pattern.finditer(text)]
    return [(KINDS[k], a, z) for a, k, z in sorted(out)]


def _scanned(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("stop", pa.int32())]))
    for batch in batches(frames):
        found = [[{"kind": k, "start": a, "stop": z} for k, a, z in find(t or "")] for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("blob"), pa.array([RULES] * len(found)), pa.array(found, kind)], names=["blob", "rules", "findings"])


class Ledger:
    """The table of scanned blobs at a path of the shared folder."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path
        self.append(spark.createDataFrame([], LEDGER))

    @classmethod
    def of(cls, spark: SparkSession, name: str) -> Ledger:
        """The ledger of a named collection of documents."""
        return cls(spark, f"{shared_dir(spark)}/stemmata/secret-ledger/{hashlib.sha256(name.encode()).hexdigest()[:24]}")

    def append(self, rows: DataFrame) -> None:
        rows.write.mode("append").parquet(self.path)

    def rows(self) -> DataFrame:
        """One row a blob of this rule version: blob, rules, findings."""
        return self.spark.read.schema(LEDGER).parquet(self.path).filter(F.col("rules") == RULES).dropDuplicates(["blob"])


def scan(documents: DataFrame, ledger: Ledger) -> DataFrame:
    """Brings the ledger up to date and returns the versions with its findings: doc_id, dk, tk, blob, findings."""
    docs = with_text_key(documents).withColumn("blob", F.sha2(F.coalesce("text", F.lit("")), 256))
    blobs = docs.select("blob", "text").dropDuplicates(["blob"])
    unseen = blobs.join(ledger.rows().select("blob"), "blob", "left_anti")
    ledger.append(unseen.select("blob", "text").mapInArrow(_scanned, LEDGER))
    some = ledger.rows().filter(F.size("findings") > 0).select(F.col("blob").alias("k_blob"), "findings")
    joined = docs.select("doc_id", "dk", "tk", "blob").join(some, F.col("blob") == F.col("k_blob"), "left")
    return joined.select("doc_id", "dk", "tk", "blob", F.coalesce("findings", F.array().cast(FINDINGS)).alias("findings"))


def redact(text: str | None, findings: list) -> str | None:
    """The text with every span, joined where they overlap, replaced by a mark of its first kind."""
    if not text or not findings:
        return text
    out, at = [], 0
    for f in sorted(findings, key=lambda f: (f["start"], -f["stop"])):
        if f["start"] >= at:
            out += [text[at : f["start"]], f"[{f['kind']}]"]
        at = max(at, f["stop"])
    return "".join(out) + text[at:]
