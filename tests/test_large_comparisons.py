"""Block structure holds every pair, also those beyond admission: 12,000 blocks or 700,000 words."""

import random

import duckdb
from stemmata.operators import alignment
from stemmata.plans import catalogue

LONG = "a " * 360_000 + "end."
ONE, TWO = "The harbour lay quiet under a low sky.", "Nobody had come down to the boats since morning."


def kept(spark, folder, texts):
    rows = [(d, "\n".join(lines), "x") for d, lines in texts.items()]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{folder}/documents.parquet")
    return str(folder)


def test_many_words_equal_the_sql(spark, tmp_path):
    """A pair of 720,000 words beside a small one."""
    folder = kept(spark, tmp_path, {
        1: [LONG, "Alpha opens it.", f"{ONE} {TWO}", "Gamma closes it.", "Delta is moved."], 2: ["Delta is moved.", LONG, "Alpha opens this.", ONE, TWO, "Gamma closes it."],
        3: ["Small one.", "Here."], 4: ["Small one.", "There."],
    })
    assert {r.cmp_id: r.route for r in catalogue.admission(spark, folder).collect()} == {"cmp_1_2": "REFUSED", "cmp_3_4": "INLINE"}
    got = sorted(map(str, (tuple(r) for r in catalogue.block_structure(spark, folder).collect())))
    with duckdb.connect() as sql:
        sql.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")
        assert got == sorted(map(str, sql.execute(catalogue.ORACLES["block_structure"]).fetchall()))
    assert sum("cmp_1_2" in r for r in got) == 6 and sum("cmp_3_4" in r for r in got) == 2


def test_many_blocks(spark, tmp_path):
    lines = [f"Line number {n} of a long text." for n in range(6100)]
    other = [*lines[1:3000], "Something else altogether, and new.", *lines[3001:], lines[0]]
    folder = kept(spark, tmp_path, {1: lines, 2: other})
    assert [r.route for r in catalogue.admission(spark, folder).collect()] == ["REFUSED"]
    got = {(r.status, r.a_index, r.b_index) for r in catalogue.block_structure(spark, folder).collect()}
    same = {("UNCHANGED", i, i - 1) for i in range(1, 6100) if i != 3000}
    assert got == same | {("MOVED", 0, 6099), ("DELETED", 3000, None), ("INSERTED", None, 2999)}


def drawn(spark, seed):
    """Sides of comparisons with repeated, split, merged and altered blocks, some of them far away."""
    draw = random.Random(seed)
    text = lambda: " ".join("".join(draw.choice("abcdefghij") for _ in range(draw.randrange(3, 8))) for _ in range(draw.randrange(3, 7)))
    refrains = [text() for _ in range(4)]
    rows = []
    for cmp_id in ("cmp_1_2", "cmp_3_4", "cmp_5_6"):
        a, b = [], []
        for _ in range(24):
            x, y, z = text(), text(), text()
            parts = [(f"{x} {y}", [x, y]), ([x, y, z], f"{x} {y} {z}"), (draw.choice(refrains),) * 2, (f"{x} {y} one", f"{x} two {y}"), (x, y)][draw.randrange(5)]
            a, b = (side + ([part] if isinstance(part, str) else part) for side, part in zip((a, b), parts, strict=True))
        at = draw.randrange(len(b))
        rows += [(cmp_id, side, i, t) for side, texts in (("a", a), ("b", b[at:] + b[:at])) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "cmp_id string, side string, block_index int, text string").cache()


def test_a_stream_of_texts_pairs_as_all_blocks(spark, monkeypatch):
    """Repeated blocks are paired as if each pair of them had a row, however the sides are dealt."""
    for seed, chunk, facing in ((1, 256, 1024), (2, 3, 5)):
        monkeypatch.setattr(alignment, "CHUNK", chunk)
        monkeypatch.setattr(alignment, "FACING", facing)
        rows = drawn(spark, seed)
        open_blocks = alignment.gaps(rows, alignment.anchors(rows)).cache()
        every = alignment.scored(open_blocks).collect()
        want = []
        for key in {(r.cmp_id, r.gap) for r in every}:
            want += [(key[0], *p) for p in alignment._best_first((r.score, r.a_index, r.b_index) for r in every if (r.cmp_id, r.gap) == key)]
        assert sorted(tuple(r) for r in alignment.paired(open_blocks).collect()) == sorted(want) and len(want) > 20


def test_dealt_windows_change_no_choice(spark, monkeypatch):
    """Groups found from windows that other tasks have scored are those of the kernel."""
    for seed, chunk in ((3, 256), (4, 5)):
        rows = drawn(spark, seed)
        monkeypatch.setattr(alignment, "DEALT", 10**9)
        want = sorted(map(str, alignment.align(rows).collect()))
        assert sum("relation='SPLIT'" in r for r in want) and sum("relation='MERGED'" in r for r in want)
        monkeypatch.setattr(alignment, "DEALT", 0)
        monkeypatch.setattr(alignment, "CHUNK", chunk)
        monkeypatch.setattr(alignment, "CELLS", 7)
        assert sorted(map(str, alignment.align(rows).collect())) == want


def test_repeated_blocks_have_no_row_a_pair(spark, monkeypatch):
    """A refrain of 3,000 blocks on both sides would make nine million scored pairs."""
    rows = spark.createDataFrame([("cmp_1_2", side, i, "the same again") for side in "ab" for i in range(3000)], "cmp_id string, side string, block_index int, text string")
    seen, ready = [], alignment._each
    monkeypatch.setattr(alignment, "_each", lambda *x: seen.append(ready(*x).localCheckpoint()) or seen[-1])
    found = alignment.paired(rows.withColumn("gap", alignment.F.lit(0).cast("long"))).collect()
    assert sorted((r.a_index, r.b_index) for r in found) == [(i, i) for i in range(3000)] and seen[0].count() < 10_000
