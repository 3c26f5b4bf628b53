from datetime import datetime

from pyspark.sql import functions as F
from stemmata.operators.session_store import SessionStore


def at(day, hour=0):
    return F.lit(datetime(2026, 1, day, hour)).cast("timestamp")


def test_session_store(spark, tmp_path):
    s = SessionStore(spark, f"file://{tmp_path}/store")
    documents = lambda *ids, text="x": spark.createDataFrame([(i, f"T {i}", "TXT", f'{{"t":"{text}"}}') for i in ids], "doc_id string, title string, source_format string, payload string")
    pairs = lambda *rows: spark.createDataFrame([(*r, "{}", "{}") for r in rows], "cmp_id string, a_doc_id string, b_doc_id string, options string, metrics string")
    blocks = lambda c, n: spark.createDataFrame([(c, i, "UNCHANGED", "{}") for i in range(1, n + 1)], "cmp_id string, seq int, status string, payload string")
    assert s.comparisons(at(1)).count() == 0 and s.sweep(at(1)) == 0

    s.put_documents(documents("a", "b"), at(1))
    s.put_documents(documents("c"), at(3))
    s.put_documents(documents("a", text="new"), at(1, 5))
    assert {r.doc_id: r.payload for r in s.get_documents(["a", "b", "z"], at(2)).collect()} == {"a": '{"t":"new"}', "b": '{"t":"x"}'}
    assert s.get_documents(["a"], at(2)).first().size_bytes == 11

    refused = s.put_comparisons(pairs(("x", "a", "c"), ("y", "a", "nobody")), blocks("x", 5), at(3))
    assert [(r.cmp_id, r.error) for r in refused.collect()] == [("y", "DOCUMENT_NOT_FOUND")]
    assert [r.seq for r in s.page("x", at(3), 1, 2).orderBy("seq").collect()] == [2, 3] and s.page("x", at(3), 9, 2).count() == 0

    s.put_pending(pairs(("p", "b", "c")), at(3))
    assert s.page("p", at(3)).count() == 0
    assert {r.cmp_id: r.state for r in s.comparisons(at(3)).collect()} == {"x": "READY", "p": "PENDING"}
    s.mark_failed("p", "e" * 900, at(3, 1))
    failed = s.comparisons(at(3, 2)).filter("cmp_id = 'p'").first()
    assert failed.state == "FAILED" and failed.message == "e" * 500
    s.put_comparisons(pairs(("p", "b", "c")), blocks("p", 2), at(3, 3))
    assert s.comparisons(at(3, 4)).filter("cmp_id = 'p'").first().state == "READY" and s.page("p", at(3, 4)).count() == 2

    # b expires on the 8th at 0, a on the 8th at 5: their comparisons are expired before their own time.
    assert {r.cmp_id: r.state for r in s.comparisons(at(8, 1)).collect()} == {"x": "READY", "p": "EXPIRED"}
    assert s.page("p", at(8, 1)).count() == 0 and s.get_documents(["b"], at(8)).count() == 0
    assert s.sweep(at(8, 1)) == 0  # no whole day is over
    assert s.sweep(at(9)) == 2 and s.live("documents", at(7)).count() == 1
    assert s.sweep(at(11)) == 3 and s.live("comparisons", at(3)).count() == 0


def test_deletion_cascades(spark, tmp_path):
    s = SessionStore(spark, f"file://{tmp_path}/store")
    s.put_documents(spark.createDataFrame([("a", "A", "TXT", "{}"), ("b", "B", "TXT", "{}"), ("c", "C", "TXT", "{}")], "doc_id string, title string, source_format string, payload string"), at(1))
    pairs = spark.createDataFrame([("x", "a", "b", "{}", "{}"), ("y", "b", "c", "{}", "{}")], "cmp_id string, a_doc_id string, b_doc_id string, options string, metrics string")
    s.put_comparisons(pairs, spark.createDataFrame([("x", 1, "UNCHANGED", "{}"), ("y", 1, "UNCHANGED", "{}")], "cmp_id string, seq int, status string, payload string"), at(1))
    s.delete_documents(["a", "nobody"], at(2))
    assert sorted(r.doc_id for r in s.live("documents", at(2)).collect()) == ["b", "c"]
    assert [r.cmp_id for r in s.comparisons(at(2)).collect()] == ["y"] and [r.cmp_id for r in s.live("blocks", at(2)).collect()] == ["y"]
