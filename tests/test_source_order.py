from stemmata.operators import views
from stemmata.plans import catalogue

ONE, TWO = "The harbour lay quiet under a low sky.", "Nobody had come down to the boats since morning."
TEXTS = {1: ["Alpha opens the account.", f"{ONE} {TWO}", "Beta follows with some detail.", "Gamma closes it."], 2: ["Gamma closes it.", "Alpha opens the account.", ONE, TWO, "Beta follows with some detail."]}


def test_source_structure_is_collated(spark, tmp_path):
    rows = [(d, "\n".join(lines), "x") for d, lines in TEXTS.items()]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r.side, r.block_index): (r.excerpt, r.structural) for r in views.source_order(catalogue._collated(spark, str(tmp_path))[2]).collect()}
    shown = lambda t: t if len(t) <= 110 else t[:109].rstrip() + "…"
    structural = {("a", 1), ("a", 3), ("b", 0), ("b", 2), ("b", 3)}
    assert got == {(s, i): (shown(t), (s, i) in structural) for s, d in (("a", 1), ("b", 2)) for i, t in enumerate(TEXTS[d])}
