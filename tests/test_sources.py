import io
import zipfile

import pytest
from stemmata.operators import blocks
from stemmata.sources import docx, registry

SPACE = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def package(paragraphs, styles=(), extra=(), inside=""):
    """A word-processor file of (style id, text) paragraphs and (id, name) styles."""
    body = "".join(f'<w:p><w:pPr><w:pStyle w:val="{s}"/></w:pPr><w:r><w:t>{t}</w:t></w:r></w:p>' if s else f"<w:p><w:r><w:t>{t}</w:t></w:r></w:p>" for s, t in paragraphs)
    listed = "".join(f'<w:style w:type="paragraph" w:styleId="{i}"><w:name w:val="{n}"/></w:style>' for i, n in styles)
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("word/document.xml", f"<w:document {SPACE}><w:body>{body}{inside}</w:body></w:document>")
        if styles:
            z.writestr("word/styles.xml", f"<w:styles {SPACE}>{listed}</w:styles>")
        for name, content in extra:
            z.writestr(name, content)
    return data.getvalue()


@pytest.mark.parametrize(
    ("name", "style_id", "kind", "guess"),
    [
        ("Heading 1", "x", "HEADING", False), ("Título 2", "Ttulo2", "HEADING", False), ("Überschrift 1", "Heading1", "HEADING", False), ("Heading 10", "x", "PARAGRAPH", True), ("heading 1", "x", "PARAGRAPH", True),
        ("Intense Quote", "x", "QUOTE", False), ("Zitat", "IntenseQuote", "QUOTE", False), ("quote", "x", "PARAGRAPH", True), ("List Bullet", "x", "LIST_ITEM", False), ("Liste", "ListNumber", "LIST_ITEM", False),
        ("list", "x", "PARAGRAPH", True), ("Normal", "Standard", "PARAGRAPH", False), ("Body Text", "x", "PARAGRAPH", False), ("", "", "PARAGRAPH", False), ("", "BodyText", "PARAGRAPH", True), ("Epigraph", "x", "PARAGRAPH", True),
    ],
)
def test_styles_by_name_and_id(name, style_id, kind, guess):
    assert docx.kind_of(name, style_id) == (kind, guess)


def test_packages(spark):
    good = package([("H", "Top"), ("", "Plain"), ("E", "  "), ("E", "Odd")], [("H", "heading 2"), ("E", "Epigraph")], [("word/comments.xml", "<x/>"), ("word/endnotes.xml", "<x/>")], f"<w:p><w:ins><w:r><w:t>new</w:t></w:r></w:ins></w:p><w:p><w:r><w:txbxContent/></w:r></w:p><v:textbox xmlns:v='v'/>")
    broken_styles = package([("", "text")], extra=[("word/styles.xml", "<w:styles")])
    damaged = bytearray(package([("", "text " * 400)]))
    at = damaged.find(b"<w:body>")
    damaged[at : at + 4] = b"\x00\x00\x00\x00"
    files = {"a": good, "b": broken_styles, "c": bytes(damaged), "d": b"PK\x03\x04", "e": package([], extra=[]), "f": b"", "g": package([("", "x")], extra=[("big", b"0" * 10)])}
    table = spark.createDataFrame([(p, bytearray(c)) for p, c in files.items()], "path string, content binary")
    rows = docx.candidates(table).collect()
    assert {r.doc_id: r.error for r in rows if r.error} == {"b": "MALFORMED_DOCUMENT", "c": "MALFORMED_DOCUMENT", "d": "MALFORMED_DOCUMENT", "e": "EMPTY_DOCUMENT", "f": "MALFORMED_DOCUMENT"}
    top = [r for r in rows if r.doc_id == "a"]
    assert [(r.kind, r.text, r.style, r.uncertain) for r in top] == [("HEADING", "Top", "Heading 2", False), ("PARAGRAPH", "Plain", None, False), ("PARAGRAPH", "Odd", "Epigraph", True)]
    assert top[0].warnings == ["COMMENTS_IGNORED", "ENDNOTES_IGNORED", "TEXT_BOXES_IGNORED", "TRACKED_CHANGES_IGNORED", "STYLE_MAPPING_UNCERTAIN"]


WORD_TYPE = "application/vnd.openxmlformats-officedocument.wordprocessingml.document"


def resolved(spark, rows, forced=None):
    files = spark.createDataFrame([(p, len(c), bytearray(c), m) for p, c, m in rows], "path string, length long, content binary, media_type string")
    return {r.path: r.parser for r in registry.resolve(registry.probe(files), forced).collect()}


def test_parsers_are_chosen(spark):
    word, sheet = package([("", "x")]), io.BytesIO()
    with zipfile.ZipFile(sheet, "w") as z:
        z.writestr("xl/workbook.xml", "<x/>")
    large = b"PK\x03\x04" + b"0" * 9000
    rows = [
        ("a.bin", b"%PDF-1.4", None), ("b.bin", word, None), ("c.docx", sheet.getvalue(), None), ("d.docx", large, None), ("e.bin", large, WORD_TYPE), ("f.bin", large, None), ("g.xyz", b"x", "text/markdown"),
        ("h.md", b"x", "text/plain"), ("i.txt", b"%PDF-", "text/plain"), ("j.text", b"x", None), ("k.md", b"\xef\xbb\xbfx", "text/markdown"), ("l.docx", b"\xff\xfex\x00", None), ("m.docx", b"plain", None), ("n.docx", b"", None), ("o", b"x", None),
    ]
    assert resolved(spark, rows) == {
        "a.bin": "pdf_lines", "b.bin": "docx", "c.docx": None, "d.docx": "docx", "e.bin": "docx", "f.bin": None, "g.xyz": "markdown", "h.md": "plaintext", "i.txt": "pdf_lines", "j.text": None,
        "k.md": "plaintext", "l.docx": "plaintext", "m.docx": None, "n.docx": "docx", "o": None,
    }
    assert resolved(spark, [("a.pdf", b"%PDF-", None), ("b.txt", b"x", None)], "pdf_text") == {"a.pdf": "pdf_text", "b.txt": None}
    assert resolved(spark, [("a.md", b"x", None), ("b.md", b"\xef\xbb\xbfx", None)], "markdown") == {"a.md": "markdown", "b.md": "markdown"}
    with pytest.raises(ValueError, match="no parser"):
        resolved(spark, [("a", b"x", None)], "odt")


def test_upload_path(spark, tmp_path):
    files = {
        "plain.txt": "One line-\nending.\n\nTwo\x07 words.".encode(), "bad.txt": b"caf\xe9 is bad", "wide.txt": "﻿wide text".encode("utf-16-le"), "marks.md": b"# Top\n\nSome *bold* text\n\n- item\n",
        "word.docx": package([("Heading1", "Head"), ("Odd", "Body")], [("Odd", "Epigraph")], [("word/footnotes.xml", "<x/>")]), "empty.txt": b" \n ", "sheet.xls": b"what", "large.txt": b"x" * 5000, "page.pdf": b"%PDF-1.4 x",
    }
    for name, content in files.items():
        (tmp_path / name).write_bytes(content)
    small, large = registry.read_files(spark, f"file://{tmp_path}", most=4000)
    found, notes = registry.parsed(small)
    name = lambda path: path.rsplit("/", 1)[1]
    assert [name(r.path) for r in large.collect()] == ["large.txt"]
    got = {(name(r.path), r.code, r.refused) for r in notes.collect()}
    assert got == {
        ("plain.txt", "CONTROL_CHARACTERS_REMOVED", False), ("bad.txt", "TEXT_DECODING_REPLACEMENT", False), ("marks.md", "MARKDOWN_INLINE_STRIPPED", False), ("word.docx", "FOOTNOTES_IGNORED", False),
        ("word.docx", "STYLE_MAPPING_UNCERTAIN", False), ("empty.txt", "EMPTY_DOCUMENT", True), ("sheet.xls", "UNSUPPORTED_FORMAT", True), ("page.pdf", "UNSUPPORTED_FORMAT", True),
    }
    rows = {}
    for r in sorted(blocks.build_blocks(found).collect(), key=lambda r: (r.doc_id, r.block_index)):
        rows.setdefault(name(r.doc_id), []).append((r.kind, r.text))
    assert rows == {
        "plain.txt": [("PARAGRAPH", "One line-\nending."), ("PARAGRAPH", "Two words.")], "bad.txt": [("PARAGRAPH", "caf� is bad")], "wide.txt": [("PARAGRAPH", "wide text")],
        "marks.md": [("HEADING", "Top"), ("PARAGRAPH", "Some bold text"), ("LIST_ITEM", "item")], "word.docx": [("HEADING", "Head"), ("PARAGRAPH", "Body")],
    }
