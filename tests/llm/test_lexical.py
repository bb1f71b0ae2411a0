import math
import random
import re
from collections import Counter

import pytest

from georisk.llm import lexical as L
from tests.llm.texts import awkward, documents, prose

TERM = re.compile("[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(docs, items, k):
    """The contract, word by word."""
    held = [(i, Counter(terms(t)), len(terms(t))) for i, t in docs if terms(t)]
    count, total = len(held), sum(n for *_, n in held)
    df = Counter(w for _, c, _ in held for w in c)
    weight = {w: math.floor(1000 * math.log((2 * count + 2) / (2 * f + 1))) for w, f in df.items()}
    out = []
    for item, text in items:
        asked = set(terms(text))
        scored = []
        for i, c, n in held:
            m = 100 - 50 + 50 * n * count // total
            score = sum(weight[w] * (1_000_000_000 * c[w] // (1000 * c[w] + 20 * m)) for w in asked if w in c)
            if score > 0:
                scored.append((-score, i is None, i or 0, i))
        scored.sort(key=lambda x: x[:3])
        out += [(item, r + 1, x[3], -x[0]) for r, x in enumerate(scored[:k])]
    return Counter(out)


def found(df):
    assert df.columns == ["item_id", "rank", "doc_id", "score"]
    return Counter(tuple(r) for r in df.collect())


def mixed(seed, n, common):
    """Words of very different frequency."""
    r = random.Random(seed)
    return " ".join(r.choice(common)[: 1 + min(r.randint(0, 9), r.randint(0, 9))] + r.choice(["", "", str(r.randint(0, 40))]) for _ in range(n))


WORDS = ["Alpha", "beta", "gamma", "naïve", "漢字漢字"]


@pytest.mark.parametrize("run,step,accumulators,postings", [(128, 64, 4096, 2_000_000), (4, 2, 30, 700), (4, 3, 0, 10**6), (1, 1, 10**6, 50)])
def test_search_against_brute_force(spark, monkeypatch, run, step, accumulators, postings):
    for name, v in (("RUN", run), ("STEP", step), ("ACCUMULATORS", accumulators), ("SHARD_POSTINGS", postings), ("FAN_IN", 2)):
        monkeypatch.setattr(L, name, v)
    rows = awkward() + [(100 + i % 300, mixed(i, 3 + i % 50, WORDS), "en") for i in range(400)] + [(90 + i, "same text beta", "en") for i in range(9)]
    items = [(i, mixed(1000 + i, 4 + 3 * i, WORDS)) for i in range(12)] + [
        (50, None), (51, " ,\0"), (None, "BETA alph"), (52, "no"), (52, "same row"), (52, "same row"), (53, "absent words here")]
    df = documents(spark, rows, 5)
    asked = spark.createDataFrame([(i, t, 1, "x") for i, t in items], "item_id bigint, text string, q bigint, terms string")
    assert found(L.search(df, asked, k=7)) == brute([(i, t) for i, t, _ in rows], items, 7)


def test_blocks_of_items(spark, monkeypatch):
    monkeypatch.setattr(L, "BLOCK_TERMS", 20)
    rows = [(i, mixed(i, 20, WORDS), "en") for i in range(60)]
    items = [(i, mixed(500 + i, 8, WORDS)) for i in range(10)]
    asked = spark.createDataFrame(items, "item_id bigint, text string")
    assert found(L.search(documents(spark, rows), asked, k=5)) == brute([(i, t) for i, t, _ in rows], items, 5)


def test_nothing(spark):
    items = spark.createDataFrame([(1, "a b")], "item_id bigint, text string")
    docs = documents(spark, [(1, "a c", "en")])
    assert L.search(docs.limit(0), items).collect() == [] and L.search(docs, items.limit(0)).collect() == []
    assert found(L.search(documents(spark, [(1, "...", "en"), (2, None, "en")]), items)) == Counter()


def test_terms_across_parts(monkeypatch):
    text = prose(3, 400, "abcÉé漢XYZ-_9") + " " + "long" * 3000
    whole = [w for part in L.terms(text.encode()) for w in part]
    monkeypatch.setattr(L, "PART", 7)
    assert [w for part in L.terms(text.encode()) for w in part] == whole == [w.encode() for w in terms(text)]


def test_runs_are_skipped_and_lists_probed():
    """Long lists open no document once accumulators and maxima say that none can win."""
    import numpy as np
    n_docs, weights = 8000, np.array([1, 9000], np.int64)
    ids = [[0, 1] if i % 400 == 3 else [0] for i in range(n_docs)]
    starts = np.cumsum([0, *map(len, ids)])
    flat = np.array([x for d in ids for x in d], np.int64)
    shard = L.Shard(np.full(n_docs, 10), starts, flat, np.ones(len(flat), np.int64), weights, n_docs, 10 * n_docs)
    read = []
    whole = shard._runs
    shard._runs = lambda t, a, b: read.append(t) or whole(t, a, b)
    docs, _ = shard.best(np.array([0, 1]), 20, 1)
    assert sorted(docs.tolist()) == [i for i in range(n_docs) if i % 400 == 3]
    assert read == []  # the accumulators opened all documents; the long list was only probed
