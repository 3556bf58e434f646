"""Language, personal data, repeats and near duplicates against brute force."""

import random
import re
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from knownby.llm import language_crf, order_minhash, pii, substring_dedup
from knownby.llm.graph import connected_components
from knownby.session import checkpoint_dir

from .conftest import prose

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, None, "s", len(t or "")) for i, t in rows], SCHEMA)


# -- language ---------------------------------------------------------------------------------------------------------

WORDS = {"aa": "kato kame sune rokitu manako soriti kana".split(), "bb": "blurg stront glemp drask wulst krent brosk".split(), "cc": "çoué éaux îlon œur àment ûtre nçais".split()}


def sentence(lang, n, seed):
    pick = random.Random(seed)
    return " ".join(pick.choice(WORDS[lang]) + pick.choice(["", "x", "n"]) for _ in range(n))


@pytest.fixture(scope="module")
def model():
    data = [(lang, sentence(lang, 40, i)) for lang in WORDS for i in range(30)]
    return language_crf.train([t for _, t in data], [lang for lang, _ in data], sequences=600)


def test_languages_of_whole_and_switched_texts(llm, model):
    rows = [(1, sentence("aa", 200, "a")), (2, sentence("bb", 3, "b")), (3, sentence("cc", 30, "c").upper()), (4, None), (5, ""), (6, "123 !? …"), (7, sentence("aa", 20, 1) + " " + sentence("bb", 20, 2)),
            (8, sentence("bb", 5000, "d")), (8, sentence("bb", 5000, "d"))]
    got = language_crf.predict(docs_of(llm, rows).withColumn("score", F.lit("old")), model, words=True).collect()
    by_id = {r.doc_id: r for r in got}
    assert [by_id[i].lang_pred for i in (1, 2, 3, 4, 5, 6, 8)] == ["aa", "bb", "cc", "und", "und", "und", "bb"]
    assert by_id[4].score == by_id[5].score == 0.0 and all(0 <= r.score <= 1 for r in got)
    assert len(got) == len(rows)
    labels = by_id[7].word_langs
    assert sum(x == "aa" for x in labels[:20]) >= 18 and sum(x == "bb" for x in labels[20:]) >= 18


def test_forward_backward_against_all_paths():
    pick = np.random.default_rng(1)
    emissions, moves = pick.normal(size=(4, 2, 3)), pick.normal(size=(3, 3))
    lengths = np.array([4, 2])
    pairs = np.zeros((3, 3))
    got = language_crf.forward_backward(emissions, lengths, moves, pairs)
    want_pairs = np.zeros((3, 3))
    for chain, n in enumerate(lengths):
        weights, total = np.zeros((n, 3)), 0.0
        for path in np.ndindex(*[3] * int(n)):
            w = np.exp(sum(emissions[t, chain, s] for t, s in enumerate(path)) + sum(moves[a, b] for a, b in zip(path, path[1:])))
            total += w
            for t, s in enumerate(path):
                weights[t, s] += w
        assert np.allclose(got[:n, chain], weights / total)
        for path in np.ndindex(*[3] * int(n)):
            w = np.exp(sum(emissions[t, chain, s] for t, s in enumerate(path)) + sum(moves[a, b] for a, b in zip(path, path[1:])))
            for a, b in zip(path, path[1:]):
                want_pairs[a, b] += w / total
    assert np.allclose(pairs, want_pairs)


def test_learning_ignores_held_out_null_and_missing_rows(llm):
    rows = [(i, sentence(lang, 30, i), lang, None, 1) for i, lang in enumerate(["aa", "bb"] * 30)] + [(None, "zz zz", "zz", None, 1), (900, None, "aa", None, 1), (901, "qq", None, None, 1)]
    df = llm.createDataFrame(rows, SCHEMA)
    model = language_crf.fit(df, language_crf.HELD_OUT, per_language=20, sequences=200)
    assert model.languages == ["aa", "bb"]
    empty = language_crf.fit(df.limit(0))
    assert {(r.lang_pred, r.score) for r in language_crf.predict(df, empty).collect()} == {("und", 0.0)}
    assert language_crf.predict(df.limit(0), model).count() == 0


def test_held_out_accuracy(llm):
    docs = llm.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language_crf.fit(docs, language_crf.HELD_OUT)
    told = language_crf.predict(docs.where(language_crf.HELD_OUT), model)
    right, n = told.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double")), F.count("*")).first()
    assert n > 100 and right > 0.97


# -- personal data ----------------------------------------------------------------------------------------------------

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def base_spans(text):
    def fits(kind, value):
        digits = [int(c) for c in value if c in "0123456789"]
        if kind == "ip":
            return all(int(p) <= 255 for p in value.split("."))
        if kind == "card":
            return 14 <= len(digits) <= 19 and sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(digits[::-1])) % 10 == 0
        return kind != "phone" or 10 <= len(digits) <= 15

    found = [(m.start(), i, m.end(), kind) for i, (kind, p) in enumerate(PATTERNS.items()) for m in re.finditer(p, text or "") if fits(kind, m.group())]
    return [(a, b, kind) for a, _, b, kind in sorted(found)]


def test_base_spans_are_those_of_the_plain_patterns(llm):
    pick = random.Random(3)
    letters = "ab.@1+- 0.5()é\n𝒳_4@."
    rows = [(i, "".join(pick.choice(letters) for _ in range(pick.randint(0, 60)))) for i in range(400)]
    rows += [(1000, None), (1001, ""), (1002, "a" * 100_000), (1003, "1 " * 30_000), (1004, "a@b." * 10_000), (1005, "+1 (386) 555-3733 é " * 1000), (None, "x@y.zz 4111 1111 1111 1111"), (7, "0000.1.2.255 x@y.zz_z@y.zz")]
    docs = docs_of(llm, rows)
    got = pii.detect(docs).collect()
    assert len(got) == len(rows)
    want = Counter((i, tuple(base_spans(t))) for i, t in rows)
    assert Counter((r.doc_id, tuple((s.start, s.end, s.kind) for s in r.spans)) for r in got) == want


def test_terms_that_reveal_an_identifier_are_found_and_masked(llm):
    rows = [(i, f"{prose(i, 12)} call Zebulon at +1 (386) 555-3733 the {prose(i + 100, 8)}") for i in range(6)]
    rows += [(50 + i, f"{prose(i + 500, 10)} the house of {prose(i + 900, 6)} the end") for i in range(40)]
    rows += [(200, rows[0][1]), (201, None), (202, ""), (None, "mail a@b.cd now"), (50, rows[6][1])]
    docs = docs_of(llm, rows)
    found = {r.doc_id: r for r in pii.find(docs).collect() if r.doc_id is not None}
    texts = dict(rows)
    for i in range(6):
        assert "zebulon" in {t.term for t in found[i].terms}
        assert "the" not in {t.term for t in found[i].terms}
        for t in found[i].terms:
            assert texts[i][t.start:t.end].lower() == t.term and t.share >= pii.GENERALISE
        assert [(s.start, s.end, s.kind) for s in found[i].spans] == base_spans(texts[i])
    assert not found[55].terms
    clean = pii.sanitise(docs.withColumn("spans", F.lit(1)))
    assert clean.columns == docs.columns + ["spans"] and clean.count() == len(rows)
    got = {r.doc_id: r.text for r in clean.collect()}
    assert "<PHONE>" in got[0] and "Zebulon" not in got[0] and "555" not in got[0] and got[55] == texts[55]
    assert got[201] is None and got[202] == "" and got[None] == "mail <EMAIL> now"
    assert pii.find(docs.limit(0)).count() == 0 and pii.sanitise(docs.limit(0)).count() == 0


def test_terms_far_from_an_identifier_are_found_and_masked(llm):
    far = "the house of the end " * 10
    rows = [(i, f"Zebulon {far}{prose(i, 8)} flat 5, call +1 (386) 555-3733 {prose(i + 70, 8)} {far} zebulon") for i in range(4)]
    rows += [(50 + i, f"{prose(i + 500, 10)} the house of {prose(i + 900, 6)} the end flat call") for i in range(40)]
    docs = docs_of(llm, rows)
    found = {r.doc_id: r for r in pii.find(docs).collect()}
    for i in range(4):
        assert [t.start for t in found[i].terms if t.term == "zebulon"] == [0, len(rows[i][1]) - 7]
        assert not {"the", "house", "end"} & {t.term for t in found[i].terms}
    assert not any("zebulon" in r.text.lower() for r in pii.sanitise(docs).collect())
    # Copies of one text are one piece of evidence.
    assert not any(r.terms for r in pii.find(docs_of(llm, [(i, rows[0][1]) for i in range(9)] + rows[4:])).collect())


def test_shares_follow_the_definition(llm):
    rows = [(i, f"Quixo x@y.zz w{i}a") for i in range(4)] + [(10 + i, f"Quixo alone v{i}b") for i in range(4)] + [(20 + i, f"nothing u{i}c") for i in range(12)]
    terms = {t.term: t.share for r in pii.find(docs_of(llm, rows), generalise=0.0).collect() for t in r.terms}
    n, entity, both, term = 20, 4, 4, 8
    assert terms["quixo"] == pytest.approx(np.log(n * both / (entity * term)) / np.log(n / entity))


# -- repeats ----------------------------------------------------------------------------------------------------------

def kept_words(rows, window):
    words = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    least = {}
    for i, w in words:
        if i is not None:
            for s in range(len(w) - window + 1):
                key = tuple(w[s:s + window])
                least[key] = min(least.get(key, i), i)
    out = []
    for i, w in words:
        gone = set()
        if i is not None:
            for s in range(len(w) - window + 1):
                if least[tuple(w[s:s + window])] < i:
                    gone.update(range(s, s + window))
        out.append((i, [x for p, x in enumerate(w) if p not in gone], len(gone)))
    return out


@pytest.mark.parametrize("window", [5, 50])
def test_repeats_against_brute_force(llm, window):
    pick = random.Random(window)
    passages = [prose(900 + i, pick.randint(window - 2, 3 * window)).split() for i in range(6)]
    rows = []
    for i in range(60):
        words = prose(i, pick.randint(0, 60)).split()
        for _ in range(pick.randint(0, 3)):
            passage = pick.choice(passages)
            at = pick.randint(0, len(words))
            words[at:at] = passage[pick.randint(0, 2):]
        rows.append((pick.randrange(50), pick.choice([" ", "\n", "  "]).join(words)))
    rows += [(70, "In. " * 300), (71, "In. " * 400), (72, None), (73, ""), (None, " ".join(passages[0])), (rows[0][0], rows[0][1]), (74, "é\x85x " * 80), (75, "é\x85x " * 70)]
    docs = docs_of(llm, rows).withColumn("kept", F.lit("other"))
    lost = {(r.doc_id, r.kept, r.n_removed) for r in substring_dedup.repeats(docs, window=window).collect()}
    want = kept_words(rows, window)
    assert lost == {(i, " ".join(w), n) for i, w, n in want if n}
    whole = substring_dedup.remove_repeats(docs, window=window)
    assert whole.columns == docs.columns
    assert Counter((r.doc_id, r.text) for r in whole.collect()) == Counter((i, " ".join(w) if n else t) for (i, w, n), (_, t) in zip(want, rows))


def test_no_rows_no_repeats(llm):
    docs = docs_of(llm, [])
    assert substring_dedup.repeats(docs).count() == 0 and substring_dedup.remove_repeats(docs).count() == 0


# -- near duplicates --------------------------------------------------------------------------------------------------

def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b):
            before, row[j + 1] = row[j + 1], before + 1 if x == y else max(row[j + 1], row[j])
    return row[-1]


def test_banded_alignment_is_exact_inside_the_band():
    pick = random.Random(2)
    for _ in range(400):
        a, b = ([pick.randint(0, 6) for _ in range(pick.randint(0, 14))] for _ in range(2))
        best = lcs(a, b)
        assert order_minhash.banded_lcs(a, b, len(a) + len(b) - 2 * best) == best
        assert order_minhash.banded_lcs(a, b, pick.randint(0, 4)) <= best


def similarity(x, y):
    s, t = (list(zip(*[w[i:] for i in range(5)])) if len(w) >= 5 else [tuple(w)] for w in (x, y))
    m = lcs(s, t)
    return m / (len(s) + len(t) - m)


def edited(words, edits, pick):
    out = list(words)
    for _ in range(edits):
        out[pick.randrange(len(out))] = f"new{pick.randrange(10**6)}"
    return out


def test_classes_against_all_pairs(llm):
    pick = random.Random(8)
    rows = []
    for g in range(8):
        base = prose(g, 150).split()
        for _ in range(pick.randint(1, 9)):
            rows.append((len(rows) * 3 % 199, " ".join(edited(base, pick.choice([0, 1, 1, 2, 3, 5, 9]), pick))))
    shuffled = rows[0][1].split()
    rows.append((500, " ".join(shuffled[75:] + shuffled[:75])))  # same shingles, other order
    rows += [(501, None), (502, ""), (503, "!!"), (504, "!!"), (505, "Short text"), (506, "short, TEXT."), (507, "short text here"), (rows[3][0], rows[3][1]), (None, rows[0][1]), (None, "only here")]
    words = [re.findall(r"[0-9a-z\x80-\U0010ffff]+", (t or "").lower()) for _, t in rows]
    n = len(rows)
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(n):
        for j in range(i):
            same = words[i] == words[j] if words[i] and words[j] else (rows[i][1] or "") == (rows[j][1] or "")
            near = rows[i][0] is not None and rows[j][0] is not None and words[i] and words[j] and similarity(words[i], words[j]) >= 0.8
            if same or near:
                root[find(i)] = find(j)
    members = {}
    for i in range(n):
        members.setdefault(find(i), []).append(rows[i][0])
    classes = {k: min((x for x in v if x is not None), default=None) for k, v in members.items()}
    want = Counter((rows[i][0], classes[find(i)]) for i in range(n))
    docs = docs_of(llm, rows).withColumn("class_id", F.lit("x"))
    found = order_minhash.near_duplicates(docs).collect()
    assert Counter((r.doc_id, r.class_id) for r in found) == want
    assert all(r.kept == (r.class_id is None or r.doc_id == r.class_id) for r in found)
    left = order_minhash.deduplicate(docs)
    assert left.columns == docs.columns
    assert Counter(r.doc_id for r in left.collect()) == Counter(r.doc_id for r in found if r.kept)


def test_a_large_group_of_drifting_copies_is_not_paired_out(llm):
    pick = random.Random(9)
    base = prose(77, 200).split()
    rows = [(i, " ".join(edited(base, 0 if i == 150 else pick.choice([2, 4, 8, 12]), pick))) for i in range(300)]
    found = {r.doc_id: r.class_id for r in order_minhash.near_duplicates(docs_of(llm, rows)).collect()}
    near = [i for i, t in rows if similarity(t.split(), base) >= 0.8]
    assert {found[i] for i in near} == {min(near)}


def stored_files(spark):
    """Part files of each intermediate that was stored so far."""
    return {p.parent.name: len(list(p.parent.glob("part-*"))) for p in Path(checkpoint_dir(spark).removeprefix("file:")).rglob("_SUCCESS")}


def test_few_rows_are_stored_and_compared_by_few_tasks(llm):
    pick = random.Random(12)
    base = [prose(g, 80).split() for g in range(20)]
    docs = docs_of(llm, [(i, " ".join(edited(base[i % 20], pick.choice([0, 1, 3, 6]), pick))) for i in range(300)])
    want = {r.doc_id: r.class_id for r in order_minhash.near_duplicates(docs).collect()}
    given = {"spark.sql.shuffle.partitions": "211", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {k: llm.conf.get(k) for k in given}
    before = stored_files(llm)
    try:
        for k, v in given.items():
            llm.conf.set(k, v)
        assert {r.doc_id: r.class_id for r in order_minhash.near_duplicates(docs).collect()} == want
    finally:
        for k, v in old.items():
            llm.conf.set(k, v)
    files = {k: n for k, n in stored_files(llm).items() if k not in before}
    assert files and max(files.values()) <= 2 * llm.sparkContext.defaultParallelism


def test_compared_pairs_count_shared_shingles(llm):
    pick = random.Random(13)
    texts = [edited("a b a b a c d ".split() * 6, n, pick) for n in (0, 1, 1, 2, 4)] + [["a"], ["a", "b"], "a b c d e".split()]
    number = {w: i for i, w in enumerate(sorted({w for t in texts for w in t}))}
    words = llm.createDataFrame([(i, bytearray(np.array([number[w] * 7919 + 1 for w in t], np.uint32).tobytes())) for i, t in enumerate(texts)], "node long, words binary")
    pairs = llm.createDataFrame([(i, j) for i in range(len(texts)) for j in range(len(texts)) if i != j], "a long, b long").repartition(1)
    rows = order_minhash.compared(pairs, words, 5, 0.8, apart=True).collect()
    assert len(rows) == len(texts) * (len(texts) - 1)
    for r in rows:
        x, y = (Counter(zip(*[t[i:] for i in range(5)]) if len(t) >= 5 else [tuple(t)]) for t in (texts[r.a], texts[r.b]))
        assert r.shared == sum((x & y).values()) and len(r.rest) == len(set(r.rest)) == sum((x - y).values())
        assert r.linked == (similarity(texts[r.a], texts[r.b]) >= 0.8)
    numbered = order_minhash.Numbered(5)
    scalar = pa.scalar(np.arange(40, dtype=np.uint32).tobytes())
    assert numbered(1, scalar) is numbered(1, scalar)  # hashed once for the pairs of a node


def test_near_duplicates_of_nothing(llm):
    assert order_minhash.near_duplicates(docs_of(llm, [])).count() == 0


def test_links_that_are_stars_take_no_round(llm):
    links = llm.createDataFrame([(1, 5), (6, 1), (2, 8), (3, 3), (1, 7)], "a long, b long")
    before = stored_files(llm)
    assert {r.node: r.component for r in connected_components(links).collect()} == {1: 1, 5: 1, 6: 1, 7: 1, 2: 2, 8: 2}
    assert len(stored_files(llm)) == len(before) + 1


def test_components(llm):
    pick = random.Random(3)
    edges = [(pick.randrange(60), pick.randrange(60)) for _ in range(40)] + [(i, i + 1) for i in range(100, 140)] + [(200, 201 + i) for i in range(50)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    got = {r.node: r.component for r in connected_components(llm.createDataFrame(edges, "a long, b long")).collect()}
    linked = {x for e in edges if e[0] != e[1] for x in e}
    assert got == {x: find(x) for x in linked}
    assert connected_components(llm.createDataFrame([], "a long, b long")).count() == 0


def test_masks_and_words_of_long_texts_with_overlaps(llm):
    pieces = [f"Nám {i} a{i}@b.example, +1 555 010 {i % 900 + 100:04d}; 10.0.0.{i % 256}\n" for i in range(1500)]
    text = "".join(pieces) + "é" * 300
    df = llm.createDataFrame([(1, text), (2, ""), (3, "x" * 80), (4, "a@b.example " + "y " * 40)], "doc_id long, text string")
    spans = {r.doc_id: r.spans for r in pii.detect(df).collect()}
    assert all(text[s.start:s.end] == s.value for s in spans[1])
    terms = F.array().cast("array<struct<start:bigint,end:bigint,share:double,term:string>>")
    joined = df.join(pii.detect(df).select("doc_id", "spans"), "doc_id")
    masked = {r.doc_id: r.m for r in joined.select("doc_id", pii.masked(F.col("text"), F.col("spans"), terms, 0.9).alias("m")).collect()}
    out, at = [], 0
    for s in spans[1]:  # one pass in Python
        if s.start >= at:
            out += [text[at:s.start], pii.MASKS[s.kind]]
        at = max(at, s.end)
    assert masked[1] == "".join(out) + text[at:]
    assert masked[2] == "" and masked[3] == "x" * 80 and masked[4] == "<EMAIL> " + "y " * 40
    words = {r.doc_id: r.w for r in df.select("doc_id", pii.words_with_starts(F.col("text")).alias("w")).collect()}
    assert all(text[w.at:w.at + len(w.word)] == w.word for w in words[1]) and words[2] == []
