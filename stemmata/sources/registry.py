"""Uploads: probing, parser choice, limits, and the parsers' way to block candidates."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MOST_BYTES = 25 * 1024 * 1024
PROBE_BYTES = 8192


@dataclass(frozen=True)
class Parser:
    name: str
    extensions: tuple[str, ...]
    media_types: tuple[str, ...]
    magic: tuple[bytes, ...] = ()


# Byte-order marks of texts; parsers in the order of their priority, of which the last is used only by name.
TEXT_MARKS = (b"\xef\xbb\xbf", b"\xff\xfe", b"\xfe\xff")
PARSERS = (
    Parser("plaintext", (".txt",), ("text/plain",)),
    Parser("markdown", (".md", ".markdown"), ("text/markdown", "text/x-markdown")),
    Parser("docx", (".docx",), ("application/vnd.openxmlformats-officedocument.wordprocessingml.document",), (b"PK\x03\x04",)),
    Parser("pdf_lines", (".pdf",), ("application/pdf",), (b"%PDF-",)),
    Parser("pdf_text", (), ()),
)


def read_files(spark: SparkSession, path: str, most: int = MOST_BYTES) -> tuple[DataFrame, DataFrame]:
    """path, length, content of files up to `most` bytes, and path, error of the larger ones, whose content is never read."""
    files = spark.read.format("binaryFile").load(path)
    large = files.select("path", "length").filter(F.col("length") > most)
    return files.filter(F.col("length") <= most).select("path", "length", "content"), large.select("path", F.lit("FILE_TOO_LARGE").alias("error"))


def probe(files: DataFrame) -> DataFrame:
    """files with filename, suffix, head (the first 8 KiB) and media_type (without parameters)."""
    media = F.lower(F.trim(F.split_part(F.coalesce("media_type", F.lit("")), F.lit(";"), F.lit(1)))) if "media_type" in files.columns else F.lit("")
    return files.withColumn("filename", F.element_at(F.split("path", "/"), -1)).withColumn("suffix", F.lower(F.regexp_extract("path", "\\.[^./]+$", 0))).withColumn("head", F.substring("content", 1, PROBE_BYTES)).withColumn("media_type", media)


def _marked(marks: tuple[bytes, ...]) -> Column:
    return F.coalesce(F.array_contains(F.array(*(F.startswith("head", F.lit(m)) for m in marks)), True), F.lit(False))


def _can_parse(parser: Parser) -> Column:
    """Whether a parser takes the probe: containers by their magic bytes, texts by what they are declared to be. A package
    cut off by the probe counts as one if it is declared so; its parser has the last word."""
    declared = F.col("media_type").isin(*parser.media_types) | F.col("suffix").isin(*parser.extensions) if parser.media_types else F.lit(False)
    if parser.magic:
        package = _marked(parser.magic)
        if parser.name == "docx":
            whole = F.length("head") >= F.col("length")
            package = package & (F.contains("head", F.lit(b"word/document.xml")) | (~whole & declared))
        return package | (F.length("head") == 0) & declared
    containers = tuple(m for p in PARSERS for m in p.magic)
    texts = F.lit(True) if parser.name == "plaintext" else F.col("suffix").isin(*parser.extensions)
    return ~_marked(containers) & F.when(_marked(TEXT_MARKS), texts).otherwise(declared)


def resolve(probed: DataFrame, forced: str | None = None) -> DataFrame:
    """Adds parser: by magic bytes and byte-order marks, else by media type, else by suffix; null where none fits. A forced
    parser must exist (ValueError) and take the probe (else null)."""
    if "length" not in probed.columns:
        probed = probed.withColumn("length", F.length("content"))
    if forced is not None:
        named = [p for p in PARSERS if p.name == forced]
        if not named:
            raise ValueError(f"no parser is called {forced}")
        fits = _can_parse(named[0]) if named[0].media_types else _can_parse(next(p for p in PARSERS if p.name == "pdf_lines"))
        return probed.withColumn("parser", F.when(fits, forced))
    public = [p for p in PARSERS if p.media_types]
    by_magic = [F.when(_marked(p.magic) & _can_parse(p), p.name) for p in public if p.magic]
    by_mark = [F.when(_marked(TEXT_MARKS), "plaintext")]
    by_media = [F.when(F.col("media_type").isin(*p.media_types) & _can_parse(p), p.name) for p in public]
    by_suffix = [F.when(F.col("suffix").isin(*p.extensions) & _can_parse(p), p.name) for p in public]
    return probed.withColumn("parser", F.coalesce(*by_magic, *by_mark, *by_media, *by_suffix))


def admit(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Files to parse, and path, error of the refused: too large, empty, or of no known format."""
    empty = F.col("content").isNull() | (F.length(F.regexp_replace(F.decode("head", "ISO-8859-1"), "\\s", "")) == 0) & (F.col("length") <= PROBE_BYTES)
    error = F.when(F.col("length") > MOST_BYTES, "FILE_TOO_LARGE").when(empty, "EMPTY_DOCUMENT").when(F.col("parser").isNull(), "UNSUPPORTED_FORMAT")
    judged = files.withColumn("error", error)
    return judged.filter("error IS NULL").drop("error"), judged.filter("error IS NOT NULL").select("path", "error")


def decoded(content: Column) -> tuple[Column, Column]:
    """Text by byte-order mark, else UTF-8; and whether bytes had to be replaced."""
    head = lambda b: F.startswith(content, F.lit(b))
    utf8 = F.when(head(b"\xef\xbb\xbf"), F.substring(content, F.lit(4), F.length(content))).otherwise(content)
    wide = head(b"\xff\xfe") | head(b"\xfe\xff")
    text = F.when(wide, F.decode(content, "UTF-16")).otherwise(F.make_valid_utf8(utf8.cast("string")))
    return text, ~wide & ~F.is_valid_utf8(utf8.cast("string"))


def plain_text(files: DataFrame, *more: str) -> DataFrame:
    """doc_id (path), title, text, replaced, and what else is named."""
    text, replaced = decoded(F.col("content"))
    return files.select(F.col("path").alias("doc_id"), F.element_at(F.split("path", "/"), -1).alias("title"), text.alias("text"), replaced.alias("replaced"), *more)


CANDIDATES = ("doc_id", "cand", "kind", "text", "style", "page")


def parsed(files: DataFrame, forced: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The upload path for texts, Markdown and word-processor files (path, content, and optionally media_type and length):
    candidates (doc_id = path) for blocks.build_blocks, and notes: path, code, refused (no candidates come of the file).
    PDF files need a reader of positioned lines first and are refused here."""
    from ..operators import blocks
    from . import docx, markdown

    good, bad = admit(resolve(probe(files if "length" in files.columns else files.withColumn("length", F.length("content"))), forced))
    of = lambda name: good.filter(F.col("parser") == name)
    notes = bad.select("path", F.col("error").alias("code"), F.lit(True).alias("refused"))
    notes = notes.unionByName(good.filter(F.col("parser").isin("pdf_lines", "pdf_text")).select("path", F.lit("UNSUPPORTED_FORMAT").alias("code"), F.lit(True).alias("refused")))
    texts = plain_text(good.filter(F.col("parser").isin("plaintext", "markdown")).select("path", "content", "parser"), "parser")
    notes = notes.unionByName(texts.filter("replaced").select(F.col("doc_id").alias("path"), F.lit("TEXT_DECODING_REPLACEMENT").alias("code"), F.lit(False).alias("refused")))
    marked = markdown.candidates(texts.filter(F.col("parser") == "markdown"))
    notes = notes.unionByName(marked.filter("stripped").select(F.col("doc_id").alias("path"), F.lit("MARKDOWN_INLINE_STRIPPED").alias("code"), F.lit(False).alias("refused")).distinct())
    office = docx.candidates(of("docx"))
    notes = notes.unionByName(office.filter("error IS NOT NULL").select(F.col("doc_id").alias("path"), F.col("error").alias("code"), F.lit(True).alias("refused")))
    notes = notes.unionByName(office.select(F.col("doc_id").alias("path"), F.explode("warnings").alias("code"), F.lit(False).alias("refused")).distinct())
    found = blocks.text_candidates(texts.filter(F.col("parser") == "plaintext")).select(*CANDIDATES)
    for more in (marked, office.filter("error IS NULL")):
        found = found.unionByName(more.select(*CANDIDATES))
    raw = texts.select("doc_id", "text").unionByName(office.filter("error IS NULL").select("doc_id", "text"))
    changed = blocks.warnings(raw, blocks.segment(found)).select(F.col("doc_id").alias("path"), "code", F.lit(False).alias("refused"))
    return found, notes.unionByName(changed)
