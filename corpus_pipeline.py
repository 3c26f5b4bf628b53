"""The corpus pipeline: five stages over documents, each written and read again.

Every stage takes (spark, docs, sf_dir) and returns the columns of documents, but the last, which returns the pieces of
the packed sequences with their ids. Rows may repeat a doc_id after mixing: a document that the mix takes twice is two rows.

Defined results, of every stage: an empty table gives no row; columns other than those of documents are left out, so no
name can clash; null ids, languages, sources and sizes are allowed. Null, empty and letterless texts go in the first
stage; each stage alone treats them as its docstring says.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stemmata.llm import language_id, mixing, near_dedup, packing, secrets
from stemmata.llm.common import LAST, deleted, shared_dir
from stemmata.llm.queries import tokenizer

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _keyed(docs: DataFrame) -> DataFrame:
    """docs with the keys dk and tk that the operators' results carry."""
    return docs.select(*COLUMNS).withColumn("dk", F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST))).withColumn("tk", F.xxhash64(F.col("text").cast("string")))


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents whose language is rejected (null, without letters, or unlike every language learned); lang of
    the others becomes the identified one. Repeated rows all stay; ties between languages go to the first in code-point
    order."""
    shared = spark.sparkContext.broadcast(language_id.train(docs))
    docs = docs.select(*COLUMNS)

    def kept(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = COLUMNS.index("lang")
        for batch in language_id.batches(frames, language_id.BATCH):
            lang, _, _, rejected = shared.value.identify(batch.column("text").to_pylist())
            yield batch.set_column(at, "lang", pa.array(lang, pa.string())).filter(pa.array(~rejected))

    return docs.mapInArrow(kept, docs.withColumn("lang", F.col("lang").cast("string")).schema)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class stays, the one of least doc_id (null ids last, then by text hash); null,
    empty and word-free texts are one class. Of rows equal in id and text the first by source, lang and n_chars stays."""
    firsts = near_dedup.near_duplicates(docs).filter("is_first").select(F.col("dk").alias("f_dk"), F.col("tk").alias("f_tk")).distinct()
    kept = _keyed(docs).join(firsts, (F.col("dk") == F.col("f_dk")) & (F.col("tk") == F.col("f_tk")), "left_semi")
    # Rows equal in id and text are both first: one of them stays.
    once = Window.partitionBy("dk", "tk").orderBy("source", "lang", "n_chars")
    return kept.withColumn("nth", F.row_number().over(once)).filter("nth = 1").select(*COLUMNS)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row stays, repeated ones too; spans that the scan finds are replaced by a mark of their kind, and n_chars is
    counted anew where any is. Null and empty texts have none."""
    found = secrets.scan(docs, secrets.Ledger.of(spark, f"pipeline {sf_dir}"))
    some = found.filter(F.size("findings") > 0).select(F.col("dk").alias("s_dk"), F.col("tk").alias("s_tk"), "findings").dropDuplicates(["s_dk", "s_tk"])
    joined = _keyed(docs).join(some, (F.col("dk") == F.col("s_dk")) & (F.col("tk") == F.col("s_tk")), "left").select(*COLUMNS, "findings")

    def masked(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in secrets.batches(frames):
            texts = [secrets.redact(t, f) for t, f in zip(batch.column("text").to_pylist(), batch.column("findings").to_pylist(), strict=True)]
            sizes = [n if f is None else len(t) for n, t, f in zip(batch.column("n_chars").to_pylist(), texts, batch.column("findings").to_pylist(), strict=True)]
            columns = {c: batch.column(c) for c in COLUMNS} | {"text": pa.array(texts, pa.string()), "n_chars": pa.array(sizes, pa.int64())}
            yield pa.RecordBatch.from_pydict(columns)

    shape = joined.select("doc_id", F.col("text").cast("string").alias("text"), "lang", "source", F.col("n_chars").cast("long").alias("n_chars"))
    return joined.withColumn("n_chars", F.col("n_chars").cast("long")).mapInArrow(masked, shape.schema)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix in training order: a row for each time that a document is taken, cut where its source's target ends. Texts
    without words and sources without target are never taken; rows equal in id, text and source are one document taken
    as often as all of them."""
    docs = docs.select(*COLUMNS)
    taken = mixing.training_order(docs, mixing.mix(docs))
    text = mixing.first_words(F.col("row.text"), F.col("words"))
    return taken.select("row.doc_id", text.alias("text"), "row.lang", "row.source", F.length(text).cast("long").alias("n_chars"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of full sequences, in the order of the rows' files; a null or empty text is its end id alone."""
    return packing.pack(docs, tokenizer("word_bpe_49k.json"), end_id=1)


STAGES = [
    ("language ID", identify_language),
    ("near-dedup", drop_near_duplicates),
    ("secret scans", mask_secrets),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: SQL expresses neither the language models nor the signatures; tests/llm/test_pipeline.py compares every stage, and all
#: in a row, with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over documents; each is written to the shared folder and read again, and what only served the
    stage after it is deleted."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    at = f"{shared_dir(spark)}/stemmata/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{at}/{k}")
        docs = spark.read.parquet(f"{at}/{k}")
        if k:
            deleted(spark, f"{at}/{k - 1}")
    return docs
