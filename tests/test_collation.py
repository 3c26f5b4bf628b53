import io
import xml.etree.ElementTree as ET
import zipfile
from datetime import datetime

import pytest
from pyspark.sql import functions as F
from stemmata.operators import alignment, blocks, collation, store, tei, views
from stemmata.sources import docx, markdown, pdf_lines, registry

A = ["Alpha opens the account.", "A steady line between.", "Beta follows with some detail about the house.", "Gamma closes it.", "Only here in the first."]
B = ["Gamma closes it.", "Alpha opens the account.", "A steady line between.", "Beta follows with more detail about the house.", "New in the second <witness> & more."]
SCHEMA = "doc_id long, block_index int, kind string, text string, starts_stanza boolean, block_id string"


def witness(doc_id, texts, kind="PARAGRAPH"):
    return [(doc_id, i, kind, t, i == 0 and kind == "VERSE_LINE", f"blk_a_{i:04d}") for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def collated(spark):
    verse = ["The sea goes out at evening tide,", "The boats are drawn along the sand,", "The gulls stand inward side by side,"]
    rows = witness(1, A) + witness(2, B) + witness(3, A) + witness(4, verse, "VERSE_LINE") + witness(5, verse[:2] + ["The gulls go inward side by side,"], "VERSE_LINE")
    pairs = spark.createDataFrame([("x", 1, 2), ("same", 1, 3), ("verse", 4, 5)], "cmp_id string, a_doc_id long, b_doc_id long")
    return collation.collate(pairs, spark.createDataFrame(rows, SCHEMA)).cache()


def test_statuses_and_metrics(collated):
    rows = collated.filter("cmp_id = 'x'").orderBy("seq").collect()
    assert [(r.status, r.a_index, r.b_index, r.move_distance) for r in rows] == [("MOVED", 3, 0, -3), ("UNCHANGED", 0, 1, None), ("UNCHANGED", 1, 2, None), ("MODIFIED", 2, 3, None), ("INSERTED", None, 4, None), ("DELETED", 4, None, None)]
    assert (rows[3].insertions, rows[3].deletions) == (1, 1)
    metrics = {r.cmp_id: r for r in collation.document_metrics(collated).collect()}
    assert metrics["same"].similarity == 1.0 and metrics["same"].edit_count == 0
    assert metrics["x"].blocks_moved == 1 and metrics["x"].a_word_count == sum(len(t.split()) for t in A)
    assert collation.violations(collated, collation.document_metrics(collated)).count() == 0


def test_views(collated):
    assert [r.seq for r in views.changed_blocks(collated.filter("cmp_id = 'x'")).orderBy("change").collect()] == [1, 4, 5, 6]
    assert [r.status for r in views.structural_relationships(collated).collect()] == ["MOVED"]
    assert views.page(collated.filter("cmp_id = 'x'"), 1, 2).count() == 2
    assert views.source_order(collated).filter("cmp_id = 'x' AND side = 'a'").count() == 5
    with pytest.raises(ValueError):
        views.page(collated, -1)


def test_tei_carries_both_witnesses(spark, collated):
    titles = spark.createDataFrame([(c, "One & two", "Three", "TXT", "TXT") for c in ("x", "same", "verse")], "cmp_id string, a_title string, b_title string, a_format string, b_format string")
    out = {r.cmp_id: r.tei for r in tei.export(collated, collation.document_metrics(collated), titles).collect()}
    ns = {"t": tei.NAMESPACE}
    root = ET.fromstring(out["x"].encode())

    def reading(block, witness):
        parts = [block.text or ""]
        for app in block:
            parts += [r.text or "" for r in app if r.get("wit") == f"#{witness}"] + [app.tail or ""]
        return "".join(parts).split()

    found = root.findall(".//t:body/t:p", ns)
    assert [w for b in found for w in reading(b, "B")] == " ".join(B).split()
    assert root.find(".//t:linkGrp[@type='moved']/t:link", ns).get("target") == "#blk-dbk_0001"
    assert len(ET.fromstring(out["verse"].encode()).findall(".//t:lg", ns)) == 1
    with pytest.raises(ValueError):
        tei.export(collated.withColumn("truncated", F.lit(True)), collation.document_metrics(collated), titles)


def test_blocks(spark):
    quatrain = "The sea goes out at evening tide,\nThe boats are drawn along the sand,\nThe gulls stand inward side by side,\nAnd no one walks upon the land."
    docs = spark.createDataFrame([(1, f"One\x07  two\r\n \r\n{quatrain}\n\nﬁrst œuvre"), (2, None), (3, "un-\nkind words here\nand unkind ones")], "doc_id long, text string")
    got = {(r.doc_id, r.block_index): r for r in blocks.build_blocks(blocks.text_candidates(docs)).collect()}
    assert got[1, 0].text == "One two" and got[1, 1].kind == "VERSE_LINE" and got[1, 1].starts_stanza and not got[1, 2].starts_stanza
    assert got[1, 5].text == "first oeuvre" and got[1, 1].char_start == 9
    text = blocks.full_text(blocks.build_blocks(blocks.text_candidates(docs))).filter("doc_id = 1").first().full_text
    assert text[got[1, 2].char_start : got[1, 2].char_end] == got[1, 2].text
    flowing = blocks.build_blocks(blocks.text_candidates(docs), reflow_lines=True).filter("doc_id = 3").collect()
    assert [r.text for r in flowing] == ["unkind words here and unkind ones"]


def test_markdown(spark):
    text = "# Title #\n\nSome *soft* text\nwith a [link](x).\n\nHeading\n---\n> quoted\n- item\n```\ncode\n```\nend"
    rows = markdown.candidates(spark.createDataFrame([(1, text)], "doc_id long, text string")).orderBy("cand").collect()
    assert [(r.kind, r.text) for r in rows] == [("HEADING", "Title"), ("PARAGRAPH", "Some soft text\nwith a link."), ("HEADING", "Heading"), ("QUOTE", "quoted"), ("LIST_ITEM", "item"), ("ARTIFACT", "code"), ("PARAGRAPH", "end")]


def test_pdf_lines(spark):
    rows = []
    for page in (1, 2, 3):
        rows.append((1, page, 10.0, f"CHAPTER {page}"))
        rows += [(1, page, 100.0 + 12 * i, f"line {i} of page {page}" + ("." if i == 3 else "")) for i in range(4)]
        rows.append((1, page, 180.0, "apart"))
    lines = spark.createDataFrame([(d, p, i, t, 792.0, x) for i, (d, p, t, x) in enumerate(rows)], "doc_id long, page int, line_no int, top double, page_height double, text string")
    got = pdf_lines.candidates(lines).orderBy("cand").collect()
    assert [r.kind for r in got].count("ARTIFACT") == 3
    assert got[1].text == "line 0 of page 1\nline 1 of page 1\nline 2 of page 1\nline 3 of page 1." and got[2].text == "apart"
    assert pdf_lines.refused(lines, pdf_lines.candidates(lines)).count() == 0


def test_docx(spark):
    body = '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body><w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>Top</w:t></w:r></w:p><w:p><w:r><w:t>Plain</w:t><w:tab/><w:t>text</w:t></w:r></w:p><w:p/></w:body></w:document>'
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("word/document.xml", body)
    files = spark.createDataFrame([("a.docx", bytearray(data.getvalue())), ("b.docx", bytearray(b"PK\x03\x04nothing"))], "path string, content binary")
    got = docx.candidates(files).collect()
    assert [(r.kind, r.text) for r in got if r.error is None] == [("HEADING", "Top"), ("PARAGRAPH", "Plain\ttext")]
    assert [r.error for r in got if r.error] == ["MALFORMED_DOCUMENT"]


def test_registry(spark):
    rows = [("d/a.txt", b"plain", "text/plain; charset=utf-8"), ("d/b.md", b"# x", None), ("d/c.bin", b"%PDF-1.7", None), ("d/e.xyz", b"data", None), ("d/f.txt", b"  \n", None)]
    files = spark.createDataFrame([(p, len(c), bytearray(c), m) for p, c, m in rows], "path string, length long, content binary, media_type string")
    found = registry.resolve(registry.probe(files))
    assert {r.filename: r.parser for r in found.collect()} == {"a.txt": "plaintext", "b.md": "markdown", "c.bin": "pdf_lines", "e.xyz": None, "f.txt": "plaintext"}
    good, bad = registry.admit(found)
    assert good.count() == 3 and {r.path: r.error for r in bad.collect()} == {"d/e.xyz": "UNSUPPORTED_FORMAT", "d/f.txt": "EMPTY_DOCUMENT"}


def test_store(spark):
    now, old, late = datetime(2026, 1, 9), datetime(2026, 1, 1), datetime(2026, 1, 8)
    docs = store.with_expiry(spark.createDataFrame([(1, old), (2, late), (3, late)], "doc_id long, at timestamp"), F.col("at"))
    comparisons = store.with_expiry(spark.createDataFrame([("x", 2, 3, "READY", None, late), ("y", 1, 2, "READY", None, late)], "cmp_id string, a_doc_id long, b_doc_id long, status string, message string, at timestamp"), F.col("at"))
    kept, left = store.swept(docs, comparisons, F.lit(now))
    assert sorted(r.doc_id for r in kept.collect()) == [2, 3] and [r.cmp_id for r in left.collect()] == ["x"]
    assert {r.cmp_id: r.state for r in store.statuses(comparisons, docs, F.lit(now)).collect()} == {"x": "READY", "y": "EXPIRED"}
    good, refused = store.put_comparisons(comparisons.limit(0), comparisons.withColumn("a_doc_id", F.when(F.col("cmp_id") == "y", 9).otherwise(F.col("a_doc_id"))), docs)
    assert [r.cmp_id for r in good.collect()] == ["x"] and [r.error for r in refused.collect()] == ["DOCUMENT_NOT_FOUND"]
    assert store.failed(comparisons, "x", "e" * 900).filter("status = 'FAILED'").first().message == "e" * 500
    docs, left = store.delete(docs, comparisons, spark.createDataFrame([(3,)], "doc_id long"))
    assert docs.count() == 2 and [r.cmp_id for r in left.collect()] == ["y"]


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    pairs = spark.createDataFrame([], "cmp_id string, a_doc_id long, b_doc_id long")
    assert alignment.align(alignment.sides(pairs, none)).count() == 0
    assert collation.collate(pairs, none).count() == 0
