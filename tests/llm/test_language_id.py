import random

import numpy as np
import pytest

from georisk.llm import language_id as L
from georisk.llm.common import table
from tests.llm.texts import awkward, documents

SF001 = "/root/testdata/sf0.01"


def test_suffix_automaton_accepts_exactly_the_substrings():
    r = random.Random(1)
    text = "".join(r.choices("abc ", k=200))
    go = L.suffix_automaton(text)

    def known(s):
        state = 0
        for c in s:
            if c not in go[state]:
                return False
            state = go[state][c]
        return True

    for n in range(1, 9):
        for _ in range(200):
            s = "".join(r.choices("abc ", k=n))
            assert known(s) == (s in text)
    assert len(go) <= 2 * len(text)


def test_sparse_table_is_the_full_table(monkeypatch):
    r = random.Random(3)
    model = L.LanguageModel({"a": ["".join(r.choices("abcd ", k=300))], "b": ["".join(r.choices("cdef ", k=300))]})
    _, full, width = model.tables()
    monkeypatch.setattr(L, "DENSE_BYTES", 0)
    _, sparse, _ = model.tables()
    for f, s in zip(full, sparse):
        assert isinstance(s, L.SparseTable) and (s[np.arange(len(f))] == f).all()


def test_many_letters():
    """Letters beyond the 253 most frequent ones take part."""
    r = random.Random(4)
    letters = {k: [chr(at + i) for i in range(1500)] for k, at in (("x", 0x4E00), ("y", 0x6000))}
    train = {k: ["".join(r.choices(v, k=4)) * 3 for _ in range(300)] for k, v in letters.items()} | {"tiny": ["ab"]}
    model = L.LanguageModel(train)
    assert len(model.alphabet) == len(set("".join("".join(v) for v in train.values())))
    classes, tables, width = model.tables()
    held = {k: L.letters_of("\n".join(v)) for k, v in train.items()}
    for k in ("x", "y"):
        texts = ["".join(r.choices(train[k], k=9))[:100] for _ in range(30)]
        columns, first, sizes, _ = L._blocks(texts, classes, width - 1)
        cost = []
        for size, table, lang in zip(model.log_size, tables, model.languages):
            n = L.phrases(columns, table, first)
            assert list(n) == [brute_phrases(L.letters_of(t), held[lang]) for t in texts]
            cost.append(n * size / sizes)
        assert all(model.languages[b] == k for b in np.argmin(cost, axis=0))


def brute_phrases(text, train):
    """Greedy longest phrases of the whole text."""
    n = i = 0
    while i < len(text):
        j = i + 1
        while j < len(text) and text[i: j + 1] in train:
            j += 1
        n, i = n + 1, j
    return n


@pytest.mark.parametrize("block", [256, 5, 1])
def test_phrase_counts_match_brute_force(monkeypatch, block):
    monkeypatch.setattr(L, "BLOCK", block)
    r = random.Random(2)
    train = {"a": ["".join(r.choices("abcd ", k=300)) + "ab" * 400], "b": ["".join(r.choices("cdef ", k=300))]}
    model = L.LanguageModel(train)
    classes, tables, width = model.tables()
    texts = ["".join(r.choices("abcdefz ", k=k)) for k in (1, 5, 255, 256, 257, 900)] + ["", "ab" * 390 + "c" + "ab" * 700]
    columns, first, sizes, letters = L._blocks(texts, classes, width - 1)
    for lang, t in zip(model.languages, tables):
        known = L.letters_of("\n".join(train[lang]))
        want = []
        for text in texts:
            lowered = "".join(c if c.isalpha() else " " for c in text.lower())
            shrunk = "".join(c for i, c in enumerate(lowered) if c != " " or i and lowered[i - 1] != " ")
            want.append(brute_phrases(shrunk, known))
        assert L.phrases(columns, t, first).tolist() == want


def test_sixty_languages_of_two_hundred_letters():
    """No bound on the number of languages; tables stay small."""
    r = random.Random(6)
    train = {}
    for k in range(60):
        letters = [chr(0x3400 + 200 * k + i) for i in range(200)]
        train[f"l{k:02d}"] = ["".join(r.choices(letters, k=5)) for _ in range(600)]
    model = L.LanguageModel(train)
    classes, tables, width = model.tables()
    assert width > 11_900 and all(isinstance(t, L.SparseTable) for t in tables)
    assert classes.nbytes + sum(t.keys.nbytes + t.moves.nbytes + t.restart.nbytes for t in tables) < 64 << 20
    columns, first, sizes, _ = L._blocks(["".join(train["l07"][:40]), "".join(train["l59"][5:30])], classes, width - 1)
    cost = [L.phrases(columns, t, first) * s for t, s in zip(tables, model.log_size)]
    assert [model.languages[i] for i in np.argmin(cost, axis=0)] == ["l07", "l59"]


def test_the_sample_is_whole_texts_of_all_languages(spark):
    rows = [(i, f"text {i} " + "x" * (20 if i % 5 else 9000), f"lang{i % 300}") for i in range(1500)] + [(None, "y", "lang0"), (7, None, "lang1")]
    sample = L.labelled_sample(documents(spark, rows), docs_per_language=2)
    assert len(sample) == 300
    texts = {t for _, t, _ in rows}
    assert all(1 <= len(v) <= 2 and set(v) <= texts for v in sample.values())
    assert sum(len(t) > 4000 for t in sample["lang5"]) == len(sample["lang5"])  # this one has long texts only


def test_held_out_accuracy(spark):
    got = L.op1_language_id(spark, SF001).join(table(spark, SF001, "documents").select("doc_id", "lang"), "doc_id")
    rows = got.where("held_out").collect()
    assert len(rows) > 100
    assert sum(r.lang == r.lang_pred for r in rows) / len(rows) > 0.98
    assert all(0 <= r.score <= 1 for r in rows)


def test_labels_of_the_held_out_fold_are_not_used(spark):
    docs = table(spark, SF001, "documents")
    from pyspark.sql import functions as F
    masked = docs.withColumn("lang", F.when(L.held_out(F.col("doc_id")), F.lit("xx")).otherwise(F.col("lang")))
    assert L.fit(masked).plain()[:3] == L.fit(docs).plain()[:3]


def test_awkward_rows(spark):
    docs = documents(spark, awkward())
    rows = L.identify(docs, L.fit(docs)).collect()
    assert len(rows) == len(awkward())
    for r in rows:
        if r.text is None or not any(c.isalpha() for c in r.text):
            assert (r.lang_pred, r.score) == ("und", 0.0)
        else:
            assert r.lang_pred in {"en", "fr", "de"}
        assert r.fp == 7  # other columns pass through


@pytest.mark.parametrize("rows", [[], [(1, "abc", None)]])
def test_nothing_to_learn_from(spark, rows):
    docs = documents(spark, rows)
    got = L.identify(docs, L.fit(docs), keep=["doc_id"]).collect()
    assert [(r.doc_id, r.lang_pred, r.score) for r in got] == [(i, "und", 0.0) for i, _, _ in rows]
