"""The stages one after the other on a small table with odd rows."""

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from knownby.llm.order_minhash import near_duplicates

from .conftest import prose
from .test_documents import SCHEMA, kept_words, sentence


def table_of(llm):
    rows = [(i, sentence(lang, 60, i), lang, f"s{i % 3}", 1) for i, lang in enumerate(["aa", "bb", "cc"] * 8)]
    passage = prose(1, 60).replace("1", "a")
    rows += [(100, rows[0][1], "aa", "s", 1), (101, f"{sentence('aa', 40, 'x')} {passage}", "aa", None, None), (102, f"{passage} {sentence('aa', 50, 'y')} mail a@b.cd", None, "s", 1),
             (103, None, "aa", "s", 1), (104, "", "aa", "s", 1), (105, "1 2 3", "aa", "s", 1), (None, sentence("bb", 30, "z"), "bb", "s", 1)]
    return llm.createDataFrame(rows, SCHEMA).withColumns({"score": F.lit("kept as it is"), "kept": F.lit(7)})


def test_each_stage_takes_effect(llm):
    docs = table_of(llm)
    given = {r.doc_id: r for r in docs.collect()}
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language", "near_duplicates", "repeats", "personal_data", "packing"]

    told = stages["language"](llm, docs, "")
    rows = {r.doc_id: r for r in told.collect()}
    assert told.columns == docs.columns
    assert set(given) - set(rows) == {103, 104, 105}
    assert rows[102].lang == "aa" and rows[0] == given[0]

    classes = {r.doc_id: r.kept for r in near_duplicates(told).collect()}
    unique = stages["near_duplicates"](llm, told, "")
    left = {r.doc_id: r for r in unique.collect()}
    assert unique.columns == docs.columns
    assert set(left) == {i for i, kept in classes.items() if kept} and 100 not in left and 0 in left and None in left

    cut = stages["repeats"](llm, unique, "")
    got = {r.doc_id: r for r in cut.collect()}
    want = {i: (" ".join(w) if n else left[i].text) for i, w, n in kept_words([(r.doc_id, r.text) for r in left.values()], 50)}
    assert {i: r.text for i, r in got.items()} == want
    assert all(r.n_chars == len(r.text) for r in got.values()) and got[102].text != left[102].text

    clean = stages["personal_data"](llm, cut, "")
    masked = {r.doc_id: r.text for r in clean.collect()}
    assert clean.columns == docs.columns and masked[102].endswith("mail <EMAIL>") and masked[0] == want[0]

    pieces = stages["packing"](llm, clean, "").collect()
    assert {p.doc_id for p in pieces} == set(masked)
    for p in pieces:
        assert p.length & p.length - 1 == 0 and len(np.frombuffer(p.ids, "<u4")) == p.length


def test_mixed_and_very_short_documents_stay(llm):
    more = [(300 + i, " ".join(sentence(lang, 20, f"{i}{lang}") for lang in ("aa", "bb", "cc")), None, "s", 1) for i in range(5)]
    more += [(310, "Xq", None, "s", 1), (311, "7 8", None, "s", 1)]
    docs = table_of(llm).select("doc_id", "text", "lang", "source", "n_chars").unionByName(llm.createDataFrame(more, SCHEMA))
    kept = {r.doc_id for r in corpus_pipeline.language(llm, docs, "").collect()}
    assert {300, 301, 302, 303, 304, 310} <= kept and 311 not in kept


def test_empty_documents(llm):
    docs = table_of(llm).limit(0)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(llm, docs, "")
        assert docs.count() == 0
    assert corpus_pipeline.STAGES[-1][1](llm, docs, "").count() == 0
