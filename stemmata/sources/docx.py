"""Word-processor files to block candidates, with the standard library's ZIP and XML readers in an Arrow map."""

from __future__ import annotations

import io
import re
import struct
import zipfile
import zlib
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame

MOST_EXPANDED = 128 * 1024 * 1024
BODY = "word/document.xml"
W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"

# What is left out, by marks in the body or by parts of the package, and the styles that mean nothing.
BODY_MARKS = {
    "TRACKED_CHANGES_IGNORED": (b"<w:ins", b"<w:del"),
    "TEXT_BOXES_IGNORED": (b"<w:txbxContent", b"<v:textbox", b"wps:txbx"),
}
PARTS = {"COMMENTS_IGNORED": "word/comments.xml", "FOOTNOTES_IGNORED": "word/footnotes.xml", "ENDNOTES_IGNORED": "word/endnotes.xml"}
PLAIN_STYLES = ("", "Normal", "Body Text")
QUOTE_NAMES, QUOTE_IDS = ("Quote", "Intense Quote"), ("Quote", "IntenseQuote")
HEADING_NAME, HEADING_ID = re.compile("(?:Heading|Título) 0*[1-9]"), re.compile("Heading0*[1-9]")

RESULT = "doc_id string, cand int, kind string, text string, style string, page int, uncertain boolean, warnings array<string>, error string"


def kind_of(name: str, style_id: str) -> tuple[str, bool]:
    """Block kind of a style, by its name or its id, and whether it is only a guess."""
    name, style_id = name.strip(), style_id.strip()
    if HEADING_NAME.fullmatch(name) or HEADING_ID.fullmatch(style_id):
        return "HEADING", False
    if name in QUOTE_NAMES or style_id in QUOTE_IDS:
        return "QUOTE", False
    if name.startswith("List") or style_id.startswith("List"):
        return "LIST_ITEM", False
    return "PARAGRAPH", (name or style_id) not in PLAIN_STYLES


def _runs(paragraph: ElementTree.Element) -> Iterator[ElementTree.Element]:
    for child in paragraph:
        if child.tag == f"{W}r":
            yield child
        elif child.tag == f"{W}hyperlink":
            yield from child.findall(f"{W}r")


def _shown(piece: ElementTree.Element) -> str:
    if piece.tag == f"{W}t":
        return piece.text or ""
    return "\t" if piece.tag == f"{W}tab" else "\n" if piece.tag in (f"{W}br", f"{W}cr") else ""


def _styles(archive: zipfile.ZipFile) -> tuple[dict[str, str], str]:
    """Style id to name, and the id of the paragraph style that holds where none is named."""
    names, default = {}, ""
    if "word/styles.xml" in archive.namelist():
        for s in ElementTree.fromstring(archive.read("word/styles.xml")).iter(f"{W}style"):
            name, own = s.find(f"{W}name"), s.get(f"{W}styleId", "")
            label = name.get(f"{W}val", "") if name is not None else ""
            # Built-in names are stored in lower case and shown capitalised.
            names[own] = re.sub("^heading (?=[1-9]$)", "Heading ", label)
            if s.get(f"{W}type") == "paragraph" and s.get(f"{W}default") in ("1", "true"):
                default = own
    return names, default


def paragraphs(content: bytes) -> tuple[list[tuple[str, str, str]], list[str]]:
    """(text, style name, style id) of the body's paragraphs with text, and warnings. ValueError for anything else."""
    try:
        archive = zipfile.ZipFile(io.BytesIO(content))
        if BODY not in archive.namelist():
            raise ValueError("UNSUPPORTED_FORMAT")
        if sum(i.file_size for i in archive.infolist()) > MOST_EXPANDED:
            raise ValueError("FILE_TOO_LARGE")
        names, default = _styles(archive)
        raw = archive.read(BODY)
        body = ElementTree.fromstring(raw).find(f"{W}body")
        parts = set(archive.namelist())
    except (zipfile.BadZipFile, zlib.error, ElementTree.ParseError, RuntimeError, NotImplementedError, EOFError, struct.error) as e:
        raise ValueError("MALFORMED_DOCUMENT") from e
    out = []
    for p in body.findall(f"{W}p") if body is not None else []:
        style = p.find(f"{W}pPr/{W}pStyle")
        own = style.get(f"{W}val", "") if style is not None else default
        text = "".join(_shown(piece) for run in _runs(p) for piece in run)
        if text.strip():
            out.append((text, names.get(own, ""), own))
    found = [w for w, marks in BODY_MARKS.items() if any(m in raw for m in marks)] + [w for w, part in PARTS.items() if part in parts]
    return out, sorted(found)


def candidates(files: DataFrame) -> DataFrame:
    """files (path, content) to candidates; a file that can't be read is one row with its error."""

    def parsed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for path, content in zip(f["path"], f["content"], strict=True):
                try:
                    found, warnings = paragraphs(bytes(content))
                except ValueError as e:
                    rows.append((path, None, None, None, None, None, None, None, str(e)))
                    continue
                kinds = [kind_of(name, own) for _, name, own in found]
                if any(guess for _, guess in kinds):
                    warnings = [*warnings, "STYLE_MAPPING_UNCERTAIN"]
                if not found:
                    rows.append((path, None, None, None, None, None, None, warnings, "EMPTY_DOCUMENT"))
                for i, ((text, name, _), (kind, guess)) in enumerate(zip(found, kinds, strict=True)):
                    rows.append((path, i, kind, text, name or None, None, guess, warnings, None))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in RESULT.split(", ")]).astype({"cand": "Int32", "page": "Int32", "uncertain": "boolean"})

    return files.select("path", "content").mapInPandas(parsed, RESULT)
