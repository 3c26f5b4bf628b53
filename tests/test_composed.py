from stemmata.plans import catalogue


def test_composed_and_decomposed_copies_are_one_text(spark, tmp_path):
    texts = [(1, "Le café est fermé\nautre ligne", "x"), (2, "Le cafe\u0301 est ferme\u0301\nautre ligne", "x"), (3, None, "x"), (4, "", "x")]
    spark.createDataFrame(texts, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 0, "cafe\u0301")], "conv_id long, turn long, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    rows = {(r.doc_id, r.block_index): (r.text, r.char_start, r.char_end) for r in catalogue.blocks_offsets(spark, str(tmp_path)).collect()}
    assert rows[1, 0] == rows[2, 0] == ("Le café est fermé", 0, 17) and rows[1, 1] == rows[2, 1] and len(rows) == 4
    assert [(r.a_doc_id, r.b_doc_id, r.shared) for r in catalogue.witness_pairs(spark, str(tmp_path)).collect()] == [(1, 2, 2)]
    assert [r.text for r in catalogue.conversation_blocks(spark, str(tmp_path)).collect()] == ["café"]
