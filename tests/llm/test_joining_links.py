from collections import Counter

from stemmata.llm import near_dedup


def test_joining_links_are_different_links(spark):
    words = [f"word{i}" for i in range(60)]
    texts = [" ".join(words[:k] + [f"other{k}"] + words[k + 1 :]) for k in range(12)] + ["something else entirely here"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = near_dedup.near_duplicates(docs, block=2).collect()
    sizes = Counter(r.class_id for r in got)
    assert all(r.joining_links <= sizes[r.class_id] - 1 for r in got)
    assert all((r.joining_links > 0) == (sizes[r.class_id] > 1) for r in got)
