"""TEI P5 parallel-segmentation export, one XML text a comparison.

Block elements are row-local column expressions; a comparison's elements and links, and its metrics if they aren't given,
meet in one aggregation by cmp_id, so difference blocks are read once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import collation

# Elements by kind, link types by status.
ELEMENTS = {"PARAGRAPH": "p", "HEADING": "head", "VERSE_LINE": "l", "QUOTE": "quote", "LIST_ITEM": "item", "ARTIFACT": "fw"}
LINKS = (("MOVED", "moved"), ("SPLIT", "split"), ("MERGED", "merged"))
NAMESPACE = "http://www.tei-c.org/ns/1.0"


def escaped(text: Column) -> Column:
    for c, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(c), F.lit(name))
    return text


def _reading(witness: str, text: Column) -> Column:
    return F.when(text == "", f'<rdg wit="#{witness}" />').otherwise(F.concat(F.lit(f'<rdg wit="#{witness}">'), escaped(text), F.lit("</rdg>")))


def content(tokens: Column) -> Column:
    """Unchanged runs as text; each longest stretch of changes as one <app> with both readings, empty ones too."""
    # A run starts where sameness changes; its end is where the next one starts. No run is built token by token.
    same = lambda t: t["status"] == "UNCHANGED"
    starts = F.filter(F.sequence(F.lit(0), F.size(tokens) - 1), lambda i: (i == 0) | (same(F.get(tokens, i)) != same(F.get(tokens, i - 1))))
    ends = F.concat(F.slice(starts, 2, F.size(starts)), F.array(F.size(tokens)))
    text = lambda part, gone: F.array_join(F.transform(F.filter(part, lambda t: t["status"] != gone), lambda t: t["text"]), "")
    parts = F.zip_with(starts, ends, lambda i, j: F.slice(tokens, i + 1, j - i))
    runs = F.when(F.size(tokens) > 0, F.transform(parts, lambda p: F.struct(same(F.get(p, F.lit(0))).alias("same"), text(p, "INSERTION").alias("a"), text(p, "DELETION").alias("b"))))
    runs = F.coalesce(runs, F.array().cast("array<struct<same:boolean,a:string,b:string>>"))
    app = lambda r: F.concat(F.lit("<app>"), _reading("A", r["a"]), _reading("B", r["b"]), F.lit("</app>"))
    return F.array_join(F.transform(runs, lambda r: F.when(r["same"], escaped(r["a"])).otherwise(app(r))), "")


def elements(blocks: DataFrame) -> DataFrame:
    """blocks with lg (number of the line group, null in prose), opens, xml of each block's element, and key (of its link)."""
    tag = F.coalesce(F.create_map(*(F.lit(x) for kv in ELEMENTS.items() for x in kv))[F.col("kind")], F.lit("p"))
    order = Window.partitionBy("cmp_id").orderBy("seq")
    verse = F.col("kind") == "VERSE_LINE"
    opens = verse & (~F.coalesce(F.lag(verse).over(order), F.lit(False)) | (F.col("stanza_boundary") != "NONE"))
    rows = blocks.withColumn("opens", opens)
    xml = F.concat(F.lit("<"), tag, F.lit(' xml:id="blk-'), F.format_string("dbk_%04d", "seq"), F.lit('">'), content(F.col("tokens")), F.lit("</"), tag, F.lit(">"))
    return rows.select("*", F.when(verse, F.sum(F.when(F.col("opens"), 1).otherwise(0)).over(order)).alias("lg"), xml.alias("xml"), F.coalesce("group_id", F.format_string("dbk_%04d", "seq")).alias("key"))


def link_groups(links: Column) -> Column:
    """The back matter of (rank, key, seq), sorted: a link a key, by its first block, in a group for each rank; null without
    any."""
    at = lambda i: F.get(links, i)
    differs = lambda i, field: at(i)[field] != at(i - 1)[field]
    starts = F.filter(F.sequence(F.lit(0), F.size(links) - 1), lambda i: (i == 0) | differs(i, "rank") | differs(i, "key"))
    ends = F.concat(F.slice(starts, 2, F.size(starts)), F.array(F.size(links)))
    target = lambda part: F.array_join(F.transform(part, lambda x: F.concat(F.lit("#blk-"), F.format_string("dbk_%04d", x["seq"]))), " ")
    link = lambda part: F.concat(F.lit('\n        <link target="'), target(part), F.lit('" />'))
    found = F.array_sort(F.zip_with(starts, ends, lambda i, j: F.struct(at(i)["rank"].alias("rank"), at(i)["seq"].alias("first"), link(F.slice(links, i + 1, j - i)).alias("link"))))
    group = lambda rank, name: F.when(F.exists(links, lambda x: x["rank"] == rank), F.concat(F.lit(f'\n      <linkGrp type="{name}">'), F.array_join(F.transform(F.filter(found, lambda x: x["rank"] == rank), lambda x: x["link"]), ""), F.lit("\n      </linkGrp>"))).otherwise("")
    return F.when(F.size(links) > 0, F.concat(F.lit("\n    <back>"), *(group(rank, name) for rank, (_, name) in enumerate(LINKS)), F.lit("\n    </back>")))


def export(blocks: DataFrame, metrics: DataFrame | None, titles: DataFrame, granularity: str = "WORD") -> DataFrame:
    """cmp_id, tei. titles: cmp_id, a_title, b_title, a_format, b_format. Without metrics, those of the blocks are taken.
    Refuses windowed results."""
    if "truncated" in blocks.columns and not blocks.filter("truncated").isEmpty():
        raise ValueError("a windowed comparison can't be exported: blocks are missing")
    order = Window.partitionBy("cmp_id").orderBy("seq")
    rows = elements(blocks).withColumn("closes", F.col("lg").isNotNull() & ~F.coalesce((F.lead("lg").over(order) == F.col("lg")), F.lit(False)))
    in_group = F.col("lg").isNotNull()
    line = F.concat(
        F.when(F.coalesce(F.col("opens"), F.lit(False)), "\n      <lg>").otherwise(""), F.lit("\n      "), F.when(in_group, "  ").otherwise(""), F.col("xml"), F.when(F.col("closes"), "\n      </lg>").otherwise(""),
    )
    rank = F.create_map(*(F.lit(x) for i, (status, _) in enumerate(LINKS) for x in (status, i)))[F.col("status")]
    link = F.when(F.col("status").isin(*(status for status, _ in LINKS)), F.struct(rank.alias("rank"), "key", "seq"))
    lists = (F.array_sort(F.collect_list(F.struct("seq", line.alias("line")))).alias("lines"), F.array_sort(F.collect_list(link)).alias("links"))
    if metrics is None:
        met = titles.join(collation.document_metrics(rows, *lists), "cmp_id")
    else:
        met = titles.join(metrics, "cmp_id").join(rows.groupBy("cmp_id").agg(*lists), "cmp_id", "left")
    unit = {"WORD": "words", "CHARACTER": "characters"}[granularity]
    figure = lambda label, column: F.concat(F.lit(f", {label} "), F.col(column).cast("string"))
    prose = F.concat(
        F.lit(f"Compared by {unit}; likeness "), F.format_number("similarity", 3), figure("words added", "insertions"), figure("words taken out", "deletions"), figure("words kept", "unchanged_tokens"),
        figure("blocks moved", "blocks_moved"), figure("blocks split", "blocks_split"), figure("blocks merged", "blocks_merged"), F.lit("."),
    )
    witness = lambda w, s: F.concat(F.lit(f'<witness xml:id="{w}">'), escaped(F.concat(F.col(f"{s}_title"), F.lit(" ("), F.col(f"{s}_format"), F.lit(")"))), F.lit("</witness>"))
    body, back = F.array_join(F.transform("lines", lambda x: x["line"]), ""), link_groups(F.col("links"))
    tei = F.concat(
        F.lit(f'<?xml version="1.0" encoding="UTF-8"?>\n<TEI xmlns="{NAMESPACE}">\n  <teiHeader>\n    <fileDesc>\n      <titleStmt>\n        <title>Parallel text: '), escaped(F.col("a_title")), F.lit(" and "), escaped(F.col("b_title")),
        F.lit("</title>\n      </titleStmt>\n      <publicationStmt>\n        <p>Computed from two texts; neither is taken as the base.</p>\n      </publicationStmt>\n      <sourceDesc>\n        <listWit>\n          "),
        witness("A", "a"), F.lit("\n          "), witness("B", "b"),
        F.lit('\n        </listWit>\n      </sourceDesc>\n    </fileDesc>\n    <encodingDesc>\n      <variantEncoding method="parallel-segmentation" location="internal" />\n      <p>'), prose,
        F.lit("</p>\n    </encodingDesc>\n  </teiHeader>\n  <text>\n    <body>"), F.coalesce(body, F.lit("")), F.lit("\n    </body>"), F.coalesce(back, F.lit("")), F.lit("\n  </text>\n</TEI>\n"),
    )
    return met.select("cmp_id", tei.alias("tei"))


def write(exports: DataFrame, path: str) -> None:
    """One text file row a comparison, by Spark's own writer: cmp_id as a folder."""
    exports.write.partitionBy("cmp_id").option("lineSep", "\u0000").text(path)
