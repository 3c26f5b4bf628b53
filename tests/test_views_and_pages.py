"""Titles, shown figures, pages, columns and the smaller views, each against values worked out by hand."""

import xml.etree.ElementTree as ElementTree

from pyspark.sql import functions as F
from stemmata.functions import text as T
from stemmata.operators import blocks, store, tei, views
from stemmata.sources import pdf_lines


def test_titles(spark):
    rows = spark.createDataFrame([("  A\ttitle \r\nover\x0clines\x07 ",), ("é plain",), ("",), (None,)], "t string")
    assert [r.t for r in rows.select(T.normalize_title(F.col("t")).alias("t")).collect()] == ["A title over lines", "é plain", "", None]


def test_shown_percent(spark):
    rows = spark.createDataFrame([(1.0, 0), (0.996, 0), (0.9999, 3), (1.0, 2), (0.501, 9), (0.0, 4)], "s double, e int")
    assert [r.p for r in rows.select(views.shown_percent(F.col("s"), F.col("e")).alias("p")).collect()] == [100, 100, 99, 99, 50, 0]


def test_pages_of_text(spark):
    rows = spark.createDataFrame([(1, 2, "second\n\n \n\nlast"), (1, 1, " first \n\nmore\nlines")], "doc_id long, page int, text string")
    got = pdf_lines.page_text_candidates(rows).orderBy("cand").collect()
    assert [(r.cand, r.page, r.text) for r in got] == [(1, 1, "first"), (2, 1, "more\nlines"), (3, 2, "second"), (4, 2, "last")]


def test_columns(spark):
    left, right = [(1, 1, 50.0 + i) for i in range(60)], [(1, 1, 400.0 + i) for i in range(50)]
    across = [(1, 2, 10.0 * i) for i in range(60)]
    lopsided = [(1, 3, 50.0)] * 60 + [(1, 3, 400.0)] * 20
    rows = spark.createDataFrame([(*r, 600.0) for r in left + right + across + lopsided], "doc_id long, page int, x0 double, page_width double")
    assert [(r.doc_id, r.page) for r in pdf_lines.multi_column(rows).collect()] == [(1, 1)]


def test_bands_and_refusals(spark):
    rows = spark.createDataFrame([(0.0, 100.0), (9.0, 100.0), (9.1, 100.0), (90.9, 100.0), (91.0, 100.0), (5.0, 0.0)], "top double, height double")
    assert [r.b for r in rows.select(pdf_lines.band(F.col("top"), F.col("height")).alias("b")).collect()] == ["header", "header", "body", "body", "footer", "body"]
    keys = spark.createDataFrame([(" Page 12 ",), ("PAGE 7",)], "t string").select(pdf_lines.repeat_key(F.col("t")).alias("k")).collect()
    assert [r.k for r in keys] == ["page ##", "page #"]
    lines = spark.createDataFrame([(1, p, p, 50.0, 100.0, "ab") for p in range(1, 21)] + [(2, p, p, 50.0, 100.0, "x" * 9) for p in range(1, 4)] + [(3, 5001, 1, 50.0, 100.0, "long enough to be read")], "doc_id long, page int, line_no int, top double, page_height double, text string")
    found = lines.select("doc_id", "text")
    # Document 1 has 40 characters on 8 looked at: 5 a page.
    assert {r.doc_id: r.error for r in pdf_lines.refused(lines, found).collect()} == {1: "OCR_REQUIRED", 3: "MALFORMED_DOCUMENT"}


def test_capabilities(spark):
    got = store.capabilities(spark).orderBy("priority").collect()
    assert [r.parser for r in got] == ["plaintext", "markdown", "docx", "pdf_lines", "pdf_text"] and got[0].extensions == ".txt"


def test_full_text_and_offsets(spark):
    rows = spark.createDataFrame([(1, "One.\n\nTwo words.\n\n\nThree")], "doc_id long, text string")
    built = blocks.build_blocks(blocks.text_candidates(rows))
    whole = blocks.full_text(built).first().full_text
    assert whole == "One.\n\nTwo words.\n\nThree" and all(whole[r.char_start : r.char_end] == r.text for r in built.collect())


def test_blocks_normalised_anew_are_the_same(spark):
    rows = spark.createDataFrame([(1, "One.\n\nshort line one here\nshort line two here\nshort line three here\n\nﬁn")], "doc_id long, text string")
    built = blocks.build_blocks(blocks.text_candidates(rows))
    again = blocks.build_blocks(blocks.block_candidates(built))
    facts = lambda frame: [(r.block_index, r.kind, r.text, r.char_start) for r in frame.orderBy("block_index").collect()]
    assert facts(built) == facts(again) and [k for _, k, _, _ in facts(built)] == ["PARAGRAPH", "VERSE_LINE", "VERSE_LINE", "VERSE_LINE", "PARAGRAPH"]


TOKENS = "array<struct<text:string,status:string>>"


def test_tei_runs_and_files(spark, tmp_path):
    u, d, i = "UNCHANGED", "DELETION", "INSERTION"
    cases = [[], [("a < b ", u)], [("old ", d), ("new ", i), ("same", u)], [("x ", i), ("y ", u), ("gone", d)], [("1", u), ("2", u), ("3", d), ("4", d), ("5", i), ("6", u)]]
    rows = spark.createDataFrame([(n, c) for n, c in enumerate(cases)], f"n int, tokens {TOKENS}")
    got = [r.x for r in rows.orderBy("n").select(tei.content(F.col("tokens")).alias("x")).collect()]
    assert got == [
        "", "a &lt; b ", '<app><rdg wit="#A">old </rdg><rdg wit="#B">new </rdg></app>same', '<app><rdg wit="#A" /><rdg wit="#B">x </rdg></app>y <app><rdg wit="#A">gone</rdg><rdg wit="#B" /></app>',
        '12<app><rdg wit="#A">34</rdg><rdg wit="#B">5</rdg></app>6',
    ]
    exports = spark.createDataFrame([("c1", "<TEI>one\ntwo</TEI>"), ("c2", "<TEI/>")], "cmp_id string, tei string")
    tei.write(exports, f"file://{tmp_path}/out")
    files = {p.parent.name: p.read_text().rstrip("\x00") for p in (tmp_path / "out").rglob("part-*")}
    assert files == {"cmp_id=c1": "<TEI>one\ntwo</TEI>", "cmp_id=c2": "<TEI/>"} and ElementTree.fromstring(files["cmp_id=c1"]).text == "one\ntwo"


def test_source_order_of_long_sides(spark):
    token = lambda t: [(t, "UNCHANGED")]
    rows = [("c", n, "MOVED" if n in (3, 20) else "UNCHANGED", n, n + 100, token(f"a {n}"), token(f"b {n}")) for n in range(30)]
    rows += [("d", n, "UNCHANGED", n, n, token("x" * 200), token("y  y")) for n in range(2)]
    got = views.source_order(spark.createDataFrame(rows, f"cmp_id string, seq int, status string, a_index int, b_index int, a_tokens {TOKENS}, b_tokens {TOKENS}")).collect()
    assert {(r.side, r.block_index, r.structural, tuple(r.others)) for r in got if r.cmp_id == "c"} == {("a", 3, True, (104,)), ("a", 20, True, (121,)), ("b", 103, True, (4,)), ("b", 120, True, (21,))}
    assert {(r.side, r.excerpt) for r in got if r.cmp_id == "d"} == {("a", "x" * 109 + "…"), ("b", "y y")}
