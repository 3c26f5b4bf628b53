"""A store of documents, comparisons and their blocks as tables of a folder that driver and executors share.

Each table is a log that is only ever appended to, partitioned by the day on which its rows expire: a row has a version, and
of equal ids the highest version counts; a deletion is a row too. So a put writes its own rows alone, whatever the table's
size, a reader that started earlier sees the table as it was, and a put that dies leaves nothing, as Spark's committer moves
files in one go. A sweep deletes whole days that are over, without reading them beyond a count; rows of the current day are
hidden by their time until then.

Defined results: an id put twice is its last put (in one put, the last by created_at); deleting an unknown id changes
nothing; a comparison of a document that isn't there is refused; rows expire at expires_at exactly; empty tables are fine.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import store, views

DOCUMENTS = "doc_id string, title string, source_format string, payload string, size_bytes long"
COMPARISONS = "cmp_id string, a_doc_id string, b_doc_id string, status string, message string, options string, metrics string"
BLOCKS = "cmp_id string, seq int, status string, payload string"
LOG = "version long, deleted boolean, created_at timestamp, expires_at timestamp, expires_on date"
KEYS = {"documents": ["doc_id"], "comparisons": ["cmp_id"], "blocks": ["cmp_id", "seq"]}
SHAPES = {"documents": DOCUMENTS, "comparisons": COMPARISONS, "blocks": BLOCKS}
MESSAGE = 500


class SessionStore:
    def __init__(self, spark: SparkSession, path: str, days: int = store.TTL_DAYS) -> None:
        self.spark, self.path, self.days = spark, path.rstrip("/"), days
        for name, shape in SHAPES.items():
            self._write(name, spark.createDataFrame([], f"{shape}, {LOG}"))

    def _write(self, name: str, rows: DataFrame) -> None:
        rows.write.mode("append").partitionBy("expires_on").parquet(f"{self.path}/{name}")

    def _log(self, name: str) -> DataFrame:
        return self.spark.read.schema(f"{SHAPES[name]}, {LOG}").parquet(f"{self.path}/{name}")

    def _next(self, name: str) -> int:
        return int(self._log(name).agg(F.max("version")).first()[0] or 0) + 1

    def _append(self, name: str, rows: DataFrame, deleted: bool = False) -> None:
        stamped = rows.withColumn("version", F.lit(self._next(name)).cast("long")).withColumn("deleted", F.lit(deleted)).withColumn("expires_on", F.to_date("expires_at"))
        columns = [f.split()[0] for f in f"{SHAPES[name]}, {LOG}".split(", ")]
        self._write(name, stamped.select(*columns))

    def live(self, name: str, now: Column) -> DataFrame:
        """The rows that count at a time. Days that are over are pruned before the log is read."""
        rows = self._log(name).filter(F.col("expires_on") >= F.to_date(now))
        newest = Window.partitionBy(*KEYS[name]).orderBy(F.desc("version"), F.desc("created_at"))
        return rows.withColumn("_n", F.row_number().over(newest)).filter((F.col("_n") == 1) & ~F.col("deleted") & (F.col("expires_at") > now)).drop("_n", "version", "deleted", "expires_on")

    def _stamped(self, rows: DataFrame, now: Column) -> DataFrame:
        return store.with_expiry(rows, now, self.days)

    def put_documents(self, rows: DataFrame, now: Column) -> None:
        """rows: doc_id, title, source_format, payload (JSON)."""
        sized = rows.withColumn("size_bytes", F.octet_length("payload").cast("long"))
        self._append("documents", self._stamped(sized, now))

    def get_documents(self, ids: list[str], now: Column) -> DataFrame:
        return self.live("documents", now).filter(F.col("doc_id").isin(ids))

    def put_comparisons(self, rows: DataFrame, blocks: DataFrame, now: Column) -> DataFrame:
        """rows: cmp_id, a_doc_id, b_doc_id, options, metrics (JSON); blocks: cmp_id, seq, status, payload. Returns the rows
        refused, with their error."""
        known = self.live("documents", now).select("doc_id")
        good, bad = store.put_comparisons(self._shell(rows, "READY").limit(0), self._shell(rows, "READY"), known)
        good = self._stamped(good, now)
        kept = good.select("cmp_id")
        self._append("blocks", self._stamped(blocks.join(kept, "cmp_id", "left_semi"), now))
        self._append("comparisons", good)
        return bad.select("cmp_id", "error")

    def put_pending(self, rows: DataFrame, now: Column) -> DataFrame:
        """As put_comparisons for comparisons whose result is still to come: no blocks, and metrics of nothing."""
        known = self.live("documents", now).select("doc_id")
        shells = self._shell(rows.withColumn("metrics", F.lit("{}")), "PENDING")
        good, bad = store.put_comparisons(shells.limit(0), shells, known)
        self._append("comparisons", self._stamped(good, now))
        return bad.select("cmp_id", "error")

    @staticmethod
    def _shell(rows: DataFrame, status: str) -> DataFrame:
        return rows.select("cmp_id", "a_doc_id", "b_doc_id", F.lit(status).alias("status"), F.lit(None).cast("string").alias("message"), "options", "metrics", F.current_timestamp().alias("created_at"))

    def mark_failed(self, cmp_id: str, reason: str, now: Column) -> None:
        """A comparison that is there fails for a reason, of which 500 characters are kept."""
        rows = self.live("comparisons", now).filter(F.col("cmp_id") == cmp_id)
        self._append("comparisons", rows.withColumn("status", F.lit("FAILED")).withColumn("message", F.lit(reason[:MESSAGE])))

    def comparisons(self, now: Column) -> DataFrame:
        """All comparisons not expired themselves, with `state`: EXPIRED where a document of theirs is gone."""
        return store.statuses(self.live("comparisons", now), self.live("documents", now), now)

    def page(self, cmp_id: str, now: Column, offset: int = 0, limit: int = views.PAGE) -> DataFrame:
        """Blocks offset + 1 to offset + limit of a finished comparison; none of one that is pending, failed or expired."""
        ready = self.comparisons(now).filter((F.col("cmp_id") == cmp_id) & (F.col("state") == "READY")).select("cmp_id")
        return views.page(self.live("blocks", now).filter(F.col("cmp_id") == cmp_id).join(ready, "cmp_id", "left_semi"), offset, limit)

    def delete_documents(self, ids: list[str], now: Column) -> None:
        """Deletes documents, their comparisons and those comparisons' blocks."""
        gone = self.live("comparisons", now).filter(F.col("a_doc_id").isin(ids) | F.col("b_doc_id").isin(ids))
        self._append("blocks", self.live("blocks", now).join(gone.select("cmp_id"), "cmp_id", "left_semi"), deleted=True)
        self._append("comparisons", gone, deleted=True)
        self._append("documents", self.get_documents(ids, now), deleted=True)

    def sweep(self, now: Column) -> int:
        """Deletes the days that are over and returns how many documents and comparisons those held."""
        over = F.col("expires_on") < F.to_date(now)
        counts = [self._log(name).filter(over).select(*KEYS[name]).distinct().count() for name in ("documents", "comparisons")]
        today = str(self.spark.range(1).select(F.to_date(now).alias("d")).first().d)
        fs_path = self.spark._jvm.org.apache.hadoop.fs.Path
        for name in SHAPES:
            folder = fs_path(f"{self.path}/{name}")
            files = folder.getFileSystem(self.spark._jsc.hadoopConfiguration())
            for entry in files.listStatus(folder):
                day = re.fullmatch(r"expires_on=(\d{4}-\d\d-\d\d)", entry.getPath().getName())
                if day and day[1] < today:
                    files.delete(entry.getPath(), True)
        return sum(counts)
