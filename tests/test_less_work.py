"""Queries do no work that their results don't need, and return the same."""

import random
import time

import pytest
from pyspark.sql import functions as F
from stemmata.functions import similarity
from stemmata.functions import text as T
from stemmata.operators import alignment
from stemmata.plans import catalogue, tables

ONE, TWO = "The harbour lay quiet under a low sky.", "Nobody had come down to the boats since morning."
COPY = ["Alpha opens the account.", "Beta follows with some detail."]
TEXTS = {
    1: COPY, 2: COPY[::-1], 3: [*COPY, "Only here."], 4: ["Gamma closes it.", f"{ONE} {TWO}", "Delta is moved."],
    5: ["Delta is moved.", "Gamma closes it.", ONE, TWO], 6: [f"Line number {n} of a longer text." for n in range(14)], 7: [f"Line number {n} of a longer text." for n in range(1, 15)],
}


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("less"))
    rows = [(d, "\n".join(lines), "x") for d, lines in TEXTS.items()]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{path}/documents.parquet")
    return path


def aligned(monkeypatch):
    """The comparisons that are aligned from here on."""
    seen, align = set(), catalogue.alignment.align

    def noted(rows, *more):
        seen.update(r.cmp_id for r in rows.select("cmp_id").distinct().collect())
        return align(rows, *more)

    monkeypatch.setattr(catalogue.alignment, "align", noted)
    return seen


def test_exact_copies_align_no_others(spark, folder, monkeypatch):
    seen = aligned(monkeypatch)
    got = catalogue.exact_copies(spark, folder).collect()
    assert {tuple(r) for r in got} == {("cmp_1_2", 2, 9)} and seen == {"cmp_1_2"}


def test_one_look_is_quick(spark):
    """Looking for what is wrong took about ten times as long as a plain pass over the texts."""
    frame = spark.range(400).select(F.repeat(F.lit("some plain words, and more of them. "), 3000).alias("text")).select(F.trim("text").alias("text")).cache()
    frame.count()

    def took(column):
        times = []
        for _ in range(3):
            began = time.time()
            frame.filter(column).count()
            times.append(time.time() - began)
        return min(times)

    assert frame.filter(T.is_tidy(F.col("text"))).count() == 400
    assert took(T.is_tidy(F.col("text"))) < 4 * took(~F.col("text").rlike("[^ -~]")) + 0.2


def no_words(monkeypatch):
    def refused(*_):
        raise AssertionError("words are compared")

    monkeypatch.setattr(catalogue.collation, "diff_blocks", refused)


def test_structure_equals_the_blocks_with_tokens(spark, folder, monkeypatch):
    whole = catalogue.diff_blocks(spark, folder).cache()
    columns = catalogue.block_structure(spark, folder).columns
    want = sorted(map(str, whole.select(columns).collect()))
    summary = sorted(map(str, catalogue.views.structural_relationships(whole).select("cmp_id", "status", "key", "sentence", "shown").collect()))
    no_words(monkeypatch)
    assert sorted(map(str, catalogue.block_structure(spark, folder).collect())) == want
    got = catalogue.structural_summary(spark, folder)
    assert {"SPLIT", "MOVED"} <= {r.status for r in got.collect()}
    assert sorted(map(str, got.select("cmp_id", "status", "key", "sentence", "shown").collect())) == summary


def test_changed_blocks_compare_no_words(spark, folder, monkeypatch):
    want = sorted(map(str, catalogue.views.changed_blocks(catalogue.diff_blocks(spark, folder)).collect()))
    no_words(monkeypatch)
    assert sorted(map(str, catalogue.changed_blocks(spark, folder).collect())) == want != []


def test_source_structure_compares_no_words(spark, folder, monkeypatch):
    facts = lambda rows: sorted((r.cmp_id, r.side, r.block_index, r.structural) for r in rows.collect())
    want = facts(catalogue.views.source_order(catalogue.diff_blocks(spark, folder)))
    no_words(monkeypatch)
    assert facts(catalogue.source_structure(spark, folder)) == want != []


def test_source_order_aligns_sides_shown_whole(spark, folder, monkeypatch):
    """The comparison of two sides of 14 blocks is not aligned; the others' excerpts are those of the tokens."""
    whole = catalogue.views.source_order(catalogue.diff_blocks(spark, folder)).filter("cmp_id <> 'cmp_6_7'")
    want = sorted((r.cmp_id, r.side, r.block_index, r.excerpt) for r in whole.collect())
    no_words(monkeypatch)
    seen = aligned(monkeypatch)
    assert sorted(tuple(r) for r in catalogue.source_order(spark, folder).collect()) == want != []
    assert "cmp_6_7" not in seen and len(seen) >= 3


def test_metrics_write_no_difference_blocks(spark, folder, monkeypatch):
    """They are read once, so nothing but what the sums need is computed."""
    names, written = [], catalogue.written
    monkeypatch.setattr(catalogue, "written", lambda df, name: (names.append(name), written(df, name))[1])
    got = {(r.cmp_id, r.a_word_count, r.b_word_count) for r in catalogue.word_balance(spark, folder).collect()}
    assert ("cmp_1_2", 9, 9) in got and "sides" in names and "diff-blocks" not in names


def test_blocks_share_their_windows_packs(monkeypatch):
    """Unmatched blocks that meet the same windows meet them in one pack; each had packs of its own before."""
    draw = random.Random(5)
    prose = lambda n: " ".join(draw.choice("the of and a to in he was that it his her with as had for she not at but on be".split()) for _ in range(n))
    ones, many = [prose(60) for _ in range(12)], [prose(draw.randrange(12, 24)) for _ in range(40)]
    made, pack = [], similarity.Pack
    monkeypatch.setattr(similarity, "Pack", lambda texts: made.append(len(texts)) or pack(texts))
    texts = alignment.Texts(dict(enumerate(ones)), dict(enumerate(many)), {}, False)
    assert alignment.gathered(list(range(12)), set(range(40)), texts, 0.8) == [] and 0 < len(made) < 12


def test_tei_reads_difference_blocks_once(spark, folder, monkeypatch):
    """Elements, links and metrics come from one look at the blocks, which are not written first."""
    stored, write = [], tables.written
    for module in (catalogue, catalogue.collation, catalogue.alignment):
        monkeypatch.setattr(module, "written", lambda df, name: stored.append(name) or write(df, name))
    got = {r.cmp_id: r.tei for r in catalogue.tei_export(spark, folder).collect()}
    assert "alignments" in stored and "diff-blocks" not in stored
    pairs, _, blocks = catalogue._collated(spark, folder)
    titles = pairs.select("cmp_id", *(F.format_string("Document %d", f"{s}_doc_id").alias(f"{s}_title") for s in "ab"), *(F.lit("TXT").alias(f"{s}_format") for s in "ab"))
    assert got == {r.cmp_id: r.tei for r in catalogue.tei.export(blocks, catalogue.collation.document_metrics(blocks), titles).collect()}
    assert 'target="#blk-dbk_' in got["cmp_1_2"] and '<linkGrp type="moved">' in got["cmp_1_2"] and '<linkGrp type="split">' in got["cmp_4_5"]


def test_links_by_first_block(spark):
    """A link a key, by its first block, also where a group's members don't stand together; no group without links."""
    rows = spark.createDataFrame([(1, [(0, "dbk_0009", 9), (2, "grp_0001", 2), (2, "grp_0002", 1), (2, "grp_0001", 5)]), (2, [])], "n int, links array<struct<rank:int,key:string,seq:int>>")
    got = [r.back for r in rows.orderBy("n").select(catalogue.tei.link_groups(F.array_sort("links")).alias("back")).collect()]
    link = lambda *seqs: '\n        <link target="' + " ".join(f"#blk-dbk_{s:04d}" for s in seqs) + '" />'
    group = lambda name, *links: f'\n      <linkGrp type="{name}">' + "".join(links) + "\n      </linkGrp>"
    assert got == ["\n    <back>" + group("moved", link(9)) + group("merged", link(1), link(2, 5)) + "\n    </back>", None]


def test_portions_and_groups_change_no_choice(monkeypatch):
    """However few windows are held or met at once, the same ones are chosen."""
    draw = random.Random(11)
    many = ["".join(draw.choice("abcdef ") for _ in range(draw.randrange(5, 30))) for _ in range(40)]
    ones = [" ".join(many[k : k + n]) for k, n in ((0, 2), (1, 3), (5, 4), (7, 2), (20, 3), (22, 2), (30, 4))] + many[10:14]
    chosen = lambda: alignment.gathered(list(range(len(ones))), set(range(40)), alignment.Texts(dict(enumerate(ones)), dict(enumerate(many)), {}, False), 0.5)
    before = chosen()
    monkeypatch.setattr(alignment, "HELD", 3)
    monkeypatch.setattr(alignment, "MET", 40)
    assert chosen() == before and [g[:2] for g in before][:1] == [(0, (0, 1))] and len(before) >= 4
