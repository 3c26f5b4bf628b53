"""Each operator on odd rows (nulls, empty and long texts, ties, repeats, clashing columns) against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from stemmata.llm import fingerprints, language_id, mixing, near_dedup, packing, quality, secrets, sketch, substring_dedup, suffix_dedup, token_files
from stemmata.llm.tokens import Encoder

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, row string, dk long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def corpus():
    rng = random.Random(5)
    prose = lambda n, seed: " ".join(random.Random(seed).choice(["the", "sea", "goes", "out", "at", "night,", "boats", "drawn", "along", "Straße", "été"]) + str(random.Random(seed * 1000 + i).randrange(300)) for i in range(n))
    base, shared = prose(160, 1), prose(70, 2)
    edited = base.split(" ")
    edited[80] = "changed"
    texts = {
        1: base, 2: " ".join(edited), 3: base, 4: prose(40, 3) + "\n" + shared, 5: shared + "\n" + prose(60, 4), 6: None, 7: "", 8: "one two", 9: "a " * 700,
        10: prose(5000, 6), 11: "   \t\n", 12: "!!! 123", 13: "x" * 900, 14: prose(30, 7) + " " + base + "\n" + prose(20, 8), 15: "ß" * 450,
    }
    rows = [(i, t, rng.choice(["en", "de", None]), rng.choice(["s1", "s2", None]), None, 7, "clash", 3) for i, t in texts.items()]
    return [*rows, rows[0], rows[0], (None, base, "en", None, 0, 0, None, None), (None, "unlike the others entirely", None, "s1", 0, 0, None, None)]


ROWS = corpus()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def words(text):
    return WORD.findall(text or "")


def counted(rows):
    return Counter(tuple(r) for r in rows)


def test_substring_dedup(docs, none):
    least = {}
    for doc, text, *_ in ROWS:
        w = words(text)
        for s in range(len(w) - 49):
            k = tuple(w[s : s + 50])
            least[k] = min(least.get(k, float("inf")), float("inf") if doc is None else doc)
    expected = []
    for doc, text, *_ in ROWS:
        w, gone = words(text), set()
        for s in range(len(w) - 49):
            if least[tuple(w[s : s + 50])] < (float("inf") if doc is None else doc):
                gone.update(range(s, s + 50))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        expected.append((doc, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    # The least sketch lets more windows through; the result is the same.
    for heavy, cells in ((substring_dedup.HEAVY, sketch.MAX_CELLS), (2, sketch.MAX_CELLS), (substring_dedup.HEAVY, sketch.SLOT)):
        got = substring_dedup.remove_repeated_windows(docs, heavy=heavy, max_cells=cells).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()
        assert counted(got) == counted(expected)
    assert substring_dedup.remove_repeated_windows(none).count() == 0


def test_suffix_dedup(docs, none):
    data = [(doc, (text or "").encode()) for doc, text, *_ in ROWS]
    seen = Counter(b[s : s + 400] for _, b in data for s in range(len(b) - 399))
    expected = []
    for doc, b in data:
        gone = np.zeros(len(b), bool)
        for s in range(len(b) - 399):
            if seen[b[s : s + 400]] > 1:
                gone[s : s + 400] = True
        spans = int((np.diff(np.append(0, gone.astype(int))) == 1).sum())
        expected.append((doc, len(b), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()))
    for heavy in (suffix_dedup.HEAVY, 2):
        got = suffix_dedup.remove_repeated_bytes(docs, heavy=heavy).drop("kept").collect()
        assert counted(got) == counted(expected)
    assert suffix_dedup.remove_repeated_bytes(none).count() == 0


def test_loser_tree_and_front_coding():
    rng = random.Random(1)
    strings = [bytes(rng.choice(b"ab") for _ in range(rng.randrange(12))) for _ in range(300)]
    runs = []
    for k in range(5):
        own = sorted(strings[k::5])
        runs.append((own, [0] + [suffix_dedup.common_prefix(a, b) for a, b in zip(own, own[1:], strict=False)]))
    out = [(runs[r][0][i], h) for r, i, h in suffix_dedup.merged(runs)]
    assert [s for s, _ in out] == sorted(strings)
    assert all(suffix_dedup.common_prefix(a, b) == h for (a, _), (b, h) in zip(out, out[1:], strict=False))
    entries = sorted({(s, s[::-1]) for s in strings})
    suffixes, _, lefts, places = suffix_dedup.front_decoded(suffix_dedup.front_coded(entries, [[(1, 2, 3)]] * len(entries)))
    assert list(zip(suffixes, lefts, strict=True)) == entries and all(p.tolist() == [[1, 2, 3]] for p in places)


@given(st.lists(st.tuples(st.binary(max_size=7), st.binary(max_size=7)), min_size=1, max_size=25, unique=True), st.integers(2, 8))
@settings(max_examples=150, deadline=None)
def test_reaches_are_the_longest(entries, length):
    entries = sorted((bytes(x % 2 for x in a), bytes(x % 2 for x in b)) for a, b in entries)
    entries = sorted(set(entries))
    suffixes, lefts = [e[0] for e in entries], [e[1] for e in entries]
    shared = [0] + [suffix_dedup.common_prefix(a, b) for a, b in zip(suffixes, suffixes[1:], strict=False)]
    got = suffix_dedup.reaches(suffixes, shared, lefts, [True] * len(entries), length)
    for i, (r, x) in enumerate(entries):
        pairs = [(suffix_dedup.common_prefix(x, y), suffix_dedup.common_prefix(r, q)) for j, (q, y) in enumerate(entries) if j != i]
        pairs = [p for p in pairs if sum(p) >= length]
        assert got[i] == ((max(p[0] for p in pairs), max(p[1] for p in pairs)) if pairs else None)


@given(st.text(alphabet="aB1 '\n\t.,sStTreéß²Ωи |<>_-\x1c", max_size=80))
@settings(max_examples=200, deadline=None)
def test_cut_encodings_are_the_librarys(text):
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        enc = ENCODERS.setdefault(name, Encoder(public_tokenizers.path(name)) if name not in ENCODERS else None)
        assert enc.ids([text])[0].tolist() == enc.library.encode(text, add_special_tokens=False).ids


ENCODERS: dict[str, Encoder] = {}


@given(st.lists(st.integers(0, 5000), min_size=1, max_size=300))
@settings(max_examples=100, deadline=None)
def test_boundaries_round_trip(sizes):
    sums = np.append(0, np.cumsum(sizes))
    b = token_files.Boundaries.of(sums)
    assert b.all().tolist() == sums.tolist() and [b[i] for i in range(len(sums))] == sums.tolist()


def test_token_files(docs, none):
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Encoder(path).library
    files = token_files.write_tokens(docs, path, end_id=2, shard_ids=500)
    got = token_files.read_tokens(files).orderBy("start").collect()
    ids = {t: np.array([*library.encode(t or "", add_special_tokens=False).ids, 2], "<u4") for _, t, *_ in ROWS}
    assert counted((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == counted((d, len(ids[t]), zlib.crc32(ids[t].tobytes())) for d, t, *_ in ROWS)
    known = [r.doc_id for r in got if r.doc_id is not None]
    assert known == sorted(known) and [r.doc_id for r in got][-2:] == [None, None]
    assert [r.start for r in got] == [sum(x.n_tokens for x in got[:i]) for i in range(len(got))]
    shard = token_files.Shard(bytes(files.filter("n_docs > 1").first()["data"]))
    assert np.concatenate([shard.document(i) for i in range(shard.n)]).tolist() == shard.ids.tolist()
    assert token_files.read_tokens(token_files.write_tokens(none, path, end_id=2)).count() == 0


def test_packing(docs, none):
    path = public_tokenizers.path("word_bpe_49k.json")
    library = Encoder(path).library
    got = packing.pack(docs, path, end_id=1, length=64).collect()
    stream, by_sequence = 0, defaultdict(list)
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.sequence_id * 64 + r.offset == stream
        by_sequence[r.sequence_id].append(r)
        stream += r.length
    pieces = sorted(((r.sequence_id, r.offset), r) for r in got)
    texts, at = [], []
    for _, r in pieces:
        at += np.frombuffer(r.ids, "<u4").tolist()
        if r.start + r.length == r.doc_tokens:
            texts.append((r.doc_id, tuple(at)))
            at = []
    assert counted(texts) == counted((d, (*library.encode(t or "", add_special_tokens=False).ids, 1)) for d, t, *_ in ROWS)
    last = stream % 64
    assert {r.padded_length for r in got if r.sequence_id == stream // 64} <= {last if last & (last - 1) == 0 else 64}
    assert packing.pack(none, path, end_id=1).count() == 0


def test_mixing(docs, none):
    rows = docs.select("doc_id", F.xxhash64("text").alias("tk"), "source").distinct().withColumnRenamed("doc_id", "d")
    mixed = mixing.mix(docs)
    rows = mixed.join(rows, mixed["doc_id"].eqNullSafe(rows["d"]) & (mixed["tk"] == rows["tk"])).select(mixed["*"], "source").collect()
    size = defaultdict(int)
    for _, t, _, source, *_ in ROWS:
        size[source] += len(words(t))
    order = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    target, open_sources, left = {}, list(order), 1.5 * sum(size.values())
    while True:
        share = {s: left * weight[s] / sum(weight[x] for x in open_sources) for s in open_sources}
        full = [s for s in open_sources if share[s] > 2 * size[s]]
        if not full:
            target |= share
            break
        for s in full:
            target[s] = 2.0 * size[s]
            left -= target[s]
            open_sources.remove(s)
    taken = defaultdict(int)
    for r in rows:
        assert abs(r.target - target[r.source]) < 1e-6 and r.source_size == size[r.source] and r.taken <= 2 * r["size"]
        assert all(0 <= c.position <= 1 for c in r.copies)
        taken[r.source] += r.taken
    assert len(rows) == len(ROWS) and all(abs(taken[s] - target[s]) <= 1 for s in order)
    ordered = mixing.training_order(docs, mixing.mix(docs)).collect()
    assert [r.position for r in ordered] == sorted(r.position for r in ordered)
    assert mixing.mix(none).count() == 0
    text = docs.select(mixing.first_words(F.lit("  a b\n c d "), F.lit(3)).alias("x"), mixing.first_words(F.lit(" a "), F.lit(9)).alias("y")).first()
    assert (text.x, text.y) == ("  a b\n c", " a ")


def plain_secrets(text):
    """The base patterns as the contract has them, without hints."""
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.I | re.A) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if m.end() - m.start() >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if m.end() - m.start() >= 24]
    return sorted(out)


@given(st.lists(st.sampled_from(["password", "PassWd", "secret", "tOken", "api_key", "APIKEY", '"', "'", " ", ":", "=", "abc123", "x/y+z.", "AKIA", "ABCDEFGH1234", "0123456789abcdef", "deadbeef" * 3, "é", "ſecret", "toKen", "\n", "://", "u:pw1@", "ghp_", "A" * 40]), max_size=14))
@settings(max_examples=300, deadline=None)
def test_base_secrets_are_the_plain_patterns(parts):
    text = "".join(parts)
    base = [(a, secrets.KINDS.index(k), z) for k, a, z in secrets.find(text) if k in secrets.KINDS[:3]]
    assert base == plain_secrets(text)


def test_secrets(spark, docs, none, tmp_path):
    ledger = lambda name: secrets.Ledger(spark, f"file://{tmp_path}/{name}")
    text = 'api_key = "abcdef0123456789abcdef0123456789" AKIA' + "Z" * 18 + " token: short password=hunter22 https://me:pass@host/"
    more = spark.createDataFrame([(90, text), (91, text), (92, None)], "doc_id long, text string")
    first = ledger("a")
    rows = {r.doc_id: [(f.kind, text[f.start : f.stop]) for f in r.findings] for r in secrets.scan(more, first).collect()}
    assert rows[90] == rows[91] and rows[92] == []
    assert [k for k, _ in rows[90]] == ["assign", "hex", "access", "assign", "url_password"]
    assert first.rows().count() == 2
    # A later scan reads only what the ledger lacks: the mark put in it for a known blob stays.
    marked = first.rows().select("blob", "rules", F.when(F.size("findings") > 0, F.slice("findings", 1, 1)).otherwise(F.col("findings")).alias("findings"))
    second = ledger("b")
    second.append(marked)
    second.append(spark.createDataFrame([("0" * 64, "older rules", None)], secrets.LEDGER))
    extra = spark.createDataFrame([(93, "secret = abcdefgh"), (94, "secret = abcdefgh")], "doc_id long, text string")
    again = {r.doc_id: [f.kind for f in r.findings] for r in secrets.scan(more.unionByName(extra), second).collect()}
    assert again == {90: ["assign"], 91: ["assign"], 92: [], 93: ["assign"], 94: ["assign"]} and second.rows().count() == 3
    assert spark.read.parquet(second.path).count() == 4
    assert secrets.redact("a secret = abcdefgh b", [{"kind": "assign", "start": 2, "stop": 19}]) == "a [assign] b"
    found = secrets.scan(docs, ledger("c")).collect()
    assert counted((r.doc_id, len(r.findings)) for r in found) == counted((d, len(secrets.find(t or ""))) for d, t, *_ in ROWS)
    assert secrets.scan(none, ledger("d")).count() == 0


def test_quality(spark, docs, none):
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (2, 1, 0), (10, 1, 1), (99, 0, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")
    got = quality.judge(docs, labels).collect()
    expected = []
    for doc, t, *_ in ROWS:
        w, t = words(t), t or ""
        c = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        covered = {j for i in range(len(w) - 7) if c[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        expected.append((doc, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered), len(w) < 20 or 100 * len(covered) > 30 * len(w)))
    assert counted((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got) == counted(expected)
    assert all(not (r.base_failed and r.kept) for r in got)
    assert quality.judge(none, labels).count() == 0


def test_isolation_forest_finds_outliers():
    rng = np.random.default_rng(0)
    rows = np.vstack([rng.normal(0, 1, (2000, 3)), [[9, 9, 9]]])
    scores = quality.Forest(rows).scores(rows)
    assert scores.argmax() == 2000 and scores[2000] > 0.6 and np.median(scores) < 0.5


def test_language_id(spark, docs, none):
    rng = random.Random(3)
    speech = {"en": ["the", "sea", "out", "night", "boats", "along", "there", "would"], "de": ["der", "und", "nicht", "straße", "über", "schön", "mit", "zug"]}
    rows = [(i, " ".join(rng.choice(speech[x]) for _ in range(60)), x) for i in range(200) for x in [rng.choice(["en", "de"])]]
    extra = [(1000, None, "en"), (1001, "", "en"), (1002, "123 !!", "de"), (1003, "жук шёл по лесу и пел песню о весне", None)]
    table = spark.createDataFrame(rows + extra, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in language_id.identify(table).collect()}
    assert all(got[i].lang_pred == x for i, _, x in rows) and not any(got[i].rejected for i, _, _ in rows)
    assert all(got[i].lang_pred == "und" and got[i].score == 0 and got[i].rejected for i in (1000, 1001, 1002)) and got[1003].rejected
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items())
    assert language_id.identify(docs).count() == len(ROWS) and language_id.identify(none).count() == 0


def test_kneser_ney_sums_to_one():
    grams, which, _ = language_id._grams(["a banana and a bandana", "an anagram"])
    model = language_id.Model(grams, np.bincount(which))
    letters = np.unique(grams[:, -1])
    for context in grams[:5, :-1]:
        full = model._probability(np.column_stack([np.tile(context, (len(letters), 1)), letters]))
        assert 0.9 < full.sum() <= 1.0 + 1e-9  # the rest is for letters never seen


def test_fingerprints(docs, none):
    got = fingerprints.compare_with_edits(docs).collect()
    keys = sorted({(-(2**63) if d is None else d, t or "") for d, t, *_ in ROWS}, reverse=True)
    for r in got:
        own = [t or "" for d, t, *_ in ROWS if d == r.doc_id and len(t or "") == r.n_chars][0]
        nexts = [keys[(i + 1) % len(keys)][1] for i, k in enumerate(keys) if k == (-(2**63) if r.doc_id is None else r.doc_id, own)]
        edits = {own[: len(own) - len(own) // 3] + n[: len(own) // 3]: n for n in [*nexts, *(t for _, t in keys if r.doc_id is None)]}
        after = {hashlib.sha256(e.encode()).hexdigest(): (e, n) for e, n in edits.items()}
        edited, following = after[r.edited_sha256]
        jaccard = lambda a, b: len(set(a) & set(b)) / len(set(a) | set(b))
        assert abs(r.near_edited - jaccard(own.split("\n"), edited.split("\n"))) < 1e-12
        if r.doc_id is not None:
            assert abs(r.near_next - jaccard(own.split("\n"), following.split("\n"))) < 1e-12
    assert len({(r.fingerprint) for r in got if r.doc_id in (1, 3)}) == 1
    assert fingerprints.compare_with_edits(none).count() == 0


@pytest.mark.parametrize(("m", "n", "shared"), [(90, 85, 5), (400, 3, 2), (1, 0, 0), (3000, 2990, 2900), (40, 0, 40)])
def test_fingerprint_retries_until_peeled(spark, m, n, shared):
    both = [f"c{i}" for i in range(shared)]
    a, b = "\n".join([f"a{i}" for i in range(m)] + both), "\n".join([f"b{i}" for i in range(n)] + both)
    rows = spark.createDataFrame([(a, b)], "a string, b string").select(fingerprints.digests(F.col("a")).alias("a_keys"), fingerprints.digests(F.col("b")).alias("b_keys"))
    rows = fingerprints.with_tables(fingerprints.with_tables(rows, "a"), "b")
    row = fingerprints.with_likeness(fingerprints.with_likeness(rows, "a", "b", "x"), "b", "a", "y").first()
    # A text without lines has one empty paragraph.
    lines = len(set(a.split("\n")) | set(b.split("\n")))
    assert abs(row.x - len(set(a.split("\n")) & set(b.split("\n"))) / lines) < 1e-12 and row.x == row.y


def test_fingerprint_blocks_and_folds(spark):
    keys = [(i * 0x9E3779B97F4A7C15 + 12345) % 2**64 - 2**63 for i in range(700)]
    df = spark.createDataFrame([(keys,)], "k array<long>").select("k", *(fingerprints.blocks(F.col("k"), F.lit(b)).alias(f"b{b}") for b in (0, 1, 5, 7)))
    df = df.select("*", *(fingerprints.tables(F.col(f"b{b}")).alias(f"t{b}") for b in (1, 5)))
    row = df.select("*", fingerprints.folded(F.col("t5"), F.lit(2)).alias("f")).first()
    for b in (0, 1, 5, 7):
        assert [sorted(x) for x in row[f"b{b}"]] == [sorted(k for k in keys if k % 2**b == i) for i in range(2**b)]
    assert row.f == row.t1


def multiset(text):
    w = words(text)
    return Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)] if w else [])


def test_near_duplicates(docs, none):
    sets = [(2**63 - 1 if d is None else d, multiset(t), t) for d, t, *_ in ROWS]
    up = list(range(len(sets)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, (_, a, _) in enumerate(sets):
        for j in range(i):
            b = sets[j][1]
            both, every = sum((a & b).values()), sum((a | b).values())
            if both >= 0.8 * every:
                up[max(root(i), root(j))] = min(root(i), root(j))
    least = defaultdict(lambda: 2**63)
    for i, (d, _, _) in enumerate(sets):
        least[root(i)] = min(least[root(i)], d)
    got = near_dedup.near_duplicates(docs).collect()
    rounds = near_dedup.near_duplicates(docs, block=2).collect()
    assert counted((r.doc_id, r.class_id) for r in rounds) == counted((r.doc_id, r.class_id) for r in got)
    expected = [(None if d == 2**63 - 1 else d, None if least[root(i)] == 2**63 - 1 else least[root(i)]) for i, (d, _, _) in enumerate(sets)]
    assert counted((r.doc_id, r.class_id) for r in got) == counted(expected)
    assert len({(r.dk, r.tk) for r in got if r.is_first}) == len(least)
    assert near_dedup.near_duplicates(none).count() == 0


def test_signatures_are_unbiased():
    rng, errors = np.random.default_rng(0), []
    for _ in range(12):
        a = rng.integers(1, 9, 200).astype(float)
        b = np.where(rng.random(200) < 0.6, a, rng.integers(0, 9, 200)).astype(float)
        keys = rng.integers(0, 2**63, 200).astype(np.uint64)
        sig = near_dedup.signatures(np.append(keys, keys[b > 0]), np.append(a, b[b > 0]), np.repeat([0, 1], [200, (b > 0).sum()]), 2, 1024)
        errors.append((sig[0] == sig[1]).mean() - np.minimum(a, b).sum() / np.maximum(a, b).sum())
    assert abs(np.mean(errors)) < 0.015
