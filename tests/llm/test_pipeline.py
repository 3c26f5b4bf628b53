"""Every stage of the pipeline, and all of them in a row, against plain Python on odd rows."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import corpus_pipeline as pipeline
import numpy as np
import public_tokenizers
import pytest
from stemmata.llm import language_id, queries, secrets
from stemmata.llm.tokens import Encoder

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, dk long, row string, position double, copy int"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SPEECH = {"en": "the sea goes out at night boats drawn along there would harbour quiet".split(), "de": "der und nicht straße über schön mit zug heute morgen wieder fahren".split()}


def rows():
    rng, out = random.Random(11), []
    for i in range(60):
        lang = rng.choice(["en", "de"])
        text = " ".join(rng.choice(SPEECH[lang]) for _ in range(rng.randrange(30, 90)))
        if i % 9 == 0:
            text += f" password = hunter{i}xyz and token: abcdef{i}"
        out.append([i, text, lang if i % 7 else None, rng.choice(["a", "b", None])])
    long_text = " ".join(rng.choice(SPEECH["en"]) for _ in range(6000))
    edited = out[4][1].split(" ")
    edited[10] = "night"
    out += [[100, out[3][1], "en", "a"], [101, out[3][1], "en", "b"], [102, " ".join(edited), "en", "a"], [103, None, "en", "a"], [104, "", "en", None], [105, "12 !!", None, "c"], [106, "жук шёл по лесу и пел песню о весне", None, "c"]]
    out += [[107, long_text, "en", "b"], [None, out[5][1] + " sea out", "en", "a"], [None, out[6][1] + " zug", "de", "a"], [None, None, None, None], list(out[8]), list(out[8])]
    return [(d, t, x, s, None if t is None else len(t), 3, "clash", 0.5, 9) for d, t, x, s in out]


ROWS = rows()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3)


def plain(frame):
    return [tuple(r[c] for c in pipeline.COLUMNS) for r in frame.collect()]


def near(got):
    last = 2**63 - 1
    sets = []
    for d, t, *_ in got:
        w = WORD.findall(t or "")
        sets.append(Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)] if w else []))
    up = list(range(len(got)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if sum((a & sets[j]).values()) >= 0.8 * sum((a | sets[j]).values()):
                up[root(i)] = root(j)
    classes = defaultdict(list)
    for i, row in enumerate(got):
        classes[root(i)].append(row)
    return {frozenset(r[:2] for r in c if (last if r[0] is None else r[0]) == min(last if x[0] is None else x[0] for x in c)): c for c in classes.values()}


def masked(got):
    out = []
    for d, t, x, s, n in got:
        found = [{"kind": k, "start": a, "stop": z} for k, a, z in secrets.find(t or "")]
        out.append((d, secrets.redact(t, found), x, s, len(secrets.redact(t, found)) if found else n))
    return out


def mixed(got):
    """(position, doc_id, text up to its last word taken, source) in order."""
    size = lambda t: len(WORD.findall(t or ""))
    sources = sorted({r[3] for r in got}, key=lambda s: (s is None, s or ""))
    total = {s: sum(size(r[1]) for r in got if r[3] == s) for s in sources}
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(sources)}
    target, open_sources, left = {}, list(sources), 1.5 * sum(total.values())
    while open_sources:
        level = left / sum(weight[s] for s in open_sources)
        full = [s for s in open_sources if level * weight[s] > 2 * total[s]]
        for s in full or open_sources:
            target[s] = 2.0 * total[s] if full else level * weight[s]
        left -= sum(target[s] for s in full)
        open_sources = [s for s in open_sources if s not in full] if full else []
    out = []
    for k, s in enumerate(sources):
        own = sorted((r for r in got if r[3] == s), key=lambda r: (hashlib.md5(b"" if r[0] is None else str(r[0]).encode()).hexdigest(), r[0] is not None, r[0] or 0))
        wanted, at, (a, z) = math.floor(target[s] + 0.5), 0, ((3.0, 1.0), (1.0, 1.0), (1.0, 3.0))[k % 3]
        for r in own * 2:
            n = min(size(r[1]), wanted - at)
            if n > 0:
                part, d = at / wanted, z - a
                position = part if d == 0 else (math.sqrt(a * a + d * (a + z) * part) - a) / d
                ends = [m.end() for m in WORD.finditer(r[1])]
                out.append((position, r[0], r[1] if n == len(ends) else r[1][: ends[n - 1]], r[2], s))
            at += size(r[1])
    return sorted(out, key=lambda x: x[:2])


def test_identify_language(spark, docs):
    model = language_id.train(docs)
    texts = [r[1] for r in ROWS]
    lang, _, _, rejected = model.identify(texts)
    expected = Counter((r[0], r[1], x, r[3], r[4]) for r, x, gone in zip(ROWS, lang, rejected, strict=True) if not gone)
    assert Counter(plain(pipeline.identify_language(spark, docs, "x"))) == expected
    gone = [r[0] for r, no in zip(ROWS, rejected, strict=True) if no]
    assert sorted(d for d in gone if d is not None) == [103, 104, 105, 106]


def test_drop_near_duplicates(spark, docs):
    got = plain(pipeline.drop_near_duplicates(spark, docs, "x"))
    classes = near([r[:5] for r in ROWS])
    assert len(got) == len(classes) and all(sum(r[:2] in firsts for r in got) >= 1 for firsts in classes)
    assert set(got) <= {r[:5] for r in ROWS}


def test_mask_secrets(spark, docs, tmp_path):
    assert Counter(plain(pipeline.mask_secrets(spark, docs, str(tmp_path)))) == Counter(masked([r[:5] for r in ROWS]))


def test_mix_sources(spark, docs):
    # Rows equal in all columns but the place are one; null ids are told apart by their text hash, whose order is Spark's own.
    once = [r for r in dict.fromkeys(ROWS) if r[0] is not None]
    got = plain(pipeline.mix_sources(spark, spark.createDataFrame(once, SCHEMA).repartition(3), "x"))
    expected = mixed([r[:5] for r in once])
    assert [(r[0], r[1], r[2], r[3], r[4]) for r in got] == [(d, t, x, s, len(t)) for _, d, t, x, s in expected]
    whole = plain(pipeline.mix_sources(spark, docs, "x"))
    assert len(whole) >= len(got) and {r[0] for r in whole} >= {None, 8}


def stream(pieces):
    got = sorted(pieces, key=lambda r: (r.sequence_id, r.offset))
    assert [r.sequence_id * 2048 + r.offset for r in got] == np.append(0, np.cumsum([r.length for r in got]))[:-1].tolist()
    return [x for r in got for x in np.frombuffer(r.ids, "<u4").tolist()]


def test_pack_sequences(spark, docs, tmp_path):
    docs.select(*pipeline.COLUMNS).write.parquet(f"{tmp_path}/docs")
    library = Encoder(public_tokenizers.path("word_bpe_49k.json")).library
    table = spark.read.parquet(f"{tmp_path}/docs")
    ids = stream(pipeline.pack_sequences(spark, table, "x").collect())
    expected = Counter(tuple([*library.encode(t or "", add_special_tokens=False).ids, 1]) for _, t, *_ in ROWS)
    got, at = Counter(), []
    for x in ids:
        at.append(x)
        if x == 1:
            got[tuple(at)] += 1
            at = []
    assert got == expected and not at


def test_all_stages(spark, tmp_path):
    """One row an id, so that the order is defined by the plain version alone."""
    table = [r for r in dict.fromkeys(ROWS) if r[0] is not None]
    spark.createDataFrame(table, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    lang, _, _, rejected = language_id.train(spark.createDataFrame(table, SCHEMA)).identify([r[1] for r in table])
    got = [(r[0], r[1], x, r[3], r[4]) for r, x, no in zip(table, lang, rejected, strict=True) if not no]
    got = [min((r for r in c), key=lambda r: r[0]) for c in near(got).values()]
    library = Encoder(public_tokenizers.path("word_bpe_49k.json")).library
    expected = [i for _, _, t, *_ in mixed(masked(got)) for i in [*library.encode(t, add_special_tokens=False).ids, 1]]
    assert stream(pipeline.run(spark, str(tmp_path)).collect()) == expected


def test_empty_tables(spark, tmp_path):
    none = spark.createDataFrame([], SCHEMA)
    for _, stage in pipeline.STAGES:
        assert stage(spark, none, str(tmp_path)).count() == 0


def test_queries(spark, tmp_path):
    """Every registered query over a small table; those with digests against the contract's words."""
    none = [r for r in dict.fromkeys(ROWS)]
    spark.createDataFrame(none, SCHEMA).repartition(2).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (2, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    ids = Counter(r[0] for r in none)
    for name, query in queries.QUERIES.items():
        got = query(spark, str(tmp_path)).collect()
        assert name == "op7_packing" or Counter(r.doc_id for r in got) == ids, name
        if name == "op8_secret_scans":
            for r in got:
                found = [secrets.find(t or "") for d, t, *_ in none if d == r.doc_id]
                shown = [(",".join(f"{k}:{a}:{z}" for k, a, z in f), hashlib.sha256(",".join(f"{k}:{a}:{z}" for k, a, z in f if k in secrets.KINDS[:3]).encode()).hexdigest(), *(sum(x[0] == k for x in f) for k in secrets.KINDS[:3])) for f in found]
                assert (r.spans, r.base_sha256, r.n_assign, r.n_access, r.n_hex) in shown
    # A second run of op8 reads the ledger and gives the same.
    again = queries.op8_secret_scans(spark, str(tmp_path))
    assert Counter(map(tuple, again.collect())) == Counter(map(tuple, queries.op8_secret_scans(spark, str(tmp_path)).collect()))
