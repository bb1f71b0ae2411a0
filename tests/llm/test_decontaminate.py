import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from georisk.llm import decontaminate as D
from georisk.llm.common import WordHash, table
from tests.llm.texts import awkward, documents, prose

SF001 = "/root/testdata/sf0.01"


def words(text):
    return re.findall(r"[^\W_]+", text.lower())


def brute_tiles(item, doc, least):
    """The textbook loop: mark all longest matches, again and again."""
    marked_i, marked_d, out = set(), set(), []
    while True:
        best = least - 1
        found = []
        for p in range(len(item)):
            for q in range(len(doc)):
                n = 0
                while (p + n < len(item) and q + n < len(doc) and item[p + n] == doc[q + n] and doc[q + n] != 0
                       and p + n not in marked_i and q + n not in marked_d):
                    n += 1
                if n > best:
                    best, found = n, [(p, q)]
                elif n == best and n >= least:
                    found.append((p, q))
        if best < least:
            return out
        for p, q in found:
            if not (marked_i & set(range(p, p + best)) or marked_d & set(range(q, q + best))):
                marked_i |= set(range(p, p + best))
                marked_d |= set(range(q, q + best))
                out.append((p, q, best))


@pytest.mark.parametrize("seed", range(40))
def test_tiles_against_the_textbook_loop(seed):
    r = random.Random(seed)
    item = [r.randint(1, 4) for _ in range(r.randint(1, 30))]
    doc = [r.randint(0, 4) for _ in range(r.randint(1, 40))]
    got = D.tiles(np.array(item, np.uint64), np.array(doc, np.uint64), 3, WordHash())
    want = brute_tiles(item, doc, 3)
    assert [t[2] for t in got] == [t[2] for t in want]
    assert got == want


def found(spark, docs, items, **kw):
    bench = spark.createDataFrame(items, "item_id bigint, text string, doc_id string, words int")
    return {(r.doc_id, r.item_id): round(r.coverage, 6) for r in D.contaminated(documents(spark, docs), bench, **kw).collect()}


def cases():
    a, b = prose(1, 40), prose(2, 30)
    wa = a.split()
    items = [(1, a), (2, b), (3, "two words"), (4, ""), (5, None), (None, a), (6, "Unique"), (1, prose(3, 10))]
    docs = awkward() + [
        (100, prose(9, 50) + " " + a.upper() + ". " + prose(10, 50), "en"),
        (101, " ".join(wa[20:] + ["filler"] * 3 + wa[:20]), "en"),  # reordered halves
        (102, " ".join(wa[:19]), "en"), (103, " ".join(wa[:20]), "en"),
        (104, prose(11, 30) + " two,  Words! " + prose(12, 5), "en"),
        (105, b.replace(" ", "\n"), "en"), (106, prose(13, 400), "en"), (107, "two or words", "en"),
        (108, " ".join(w + " x" for w in wa), "en"), (109, "unique", "en"), (109, prose(3, 10), "en")]
    return docs, [(*i, "clash", 1) for i in items]


WANT = {(100, 1): 1.0, (101, 1): 1.0, (103, 1): 0.5, (104, 3): 1.0, (105, 2): 1.0, (109, 6): 1.0, (109, 1): 1.0}


@pytest.mark.parametrize("full", [False, True])
def test_cases(spark, monkeypatch, full):
    if full:  # a filter that lets all words through
        monkeypatch.setattr(D, "in_bloom", lambda bits, h: np.ones(len(h), bool))
    docs, items = cases()
    assert found(spark, docs, items) == WANT


def test_parts_of_a_document_add_up(spark):
    a = prose(1, 40).split()
    docs = [(1, " ".join(a[:12]), "en"), (1, prose(5, 30) + " " + " ".join(a[8:20]), "en"), (1, " ".join(a[:12]), "en"),
            (2, " ".join(a[:12]), "en"), (2, " ".join(a[7:19]), "en")]
    assert found(spark, docs, [(1, " ".join(a), "", 1)]) == {(1, 1): 0.5}


def test_a_long_item(spark):
    words = [f"w{i}" for i in range(80_000)]
    docs = [(1, " ".join(words[40_000:]), "en"), (2, " ".join(words[40_001:]), "en")]
    assert found(spark, docs, [(7, " ".join(words), "", 1)]) == {(1, 7): 0.5}


def plain(docs, items, threshold):
    """Every document against every item."""
    hasher, ids = WordHash(), {}
    code = lambda t: np.array([ids.setdefault(w, len(ids) + 1) for w in words(t)], np.uint64)
    out = {}
    for i, t, *_ in items:
        for d, u, _ in docs:
            item = code(t)
            n = sum(x[2] for x in D.tiles(item, code(u), min(D.SEED, len(item)), hasher))
            if n / len(item) >= threshold:
                out[d, i] = round(n / len(item), 6)
    return out


@pytest.mark.parametrize("threshold", [0.3, 0.5, 1.0])
def test_hot_phrases_against_every_pair(spark, threshold):
    r = random.Random(threshold)
    hot, own = prose(50, 14).split(), [prose(60 + i, 30).split() for i in range(12)]
    items = [(i, " ".join(hot + w[: r.randint(6, 30)]), "", 1) for i, w in enumerate(own)]
    docs = []
    for i in range(60):
        w = own[r.randrange(12)]
        cut = sorted(r.sample(range(31), 2))
        docs.append((i, " ".join([*hot[r.choice([0, 0, 3, 9]):], prose(200 + i, 8), *w[cut[0]: cut[1]]]), "en"))
    want = plain(docs, items, threshold)
    assert found(spark, docs, items, threshold=threshold) == want and 0 < len(want) < 700


def test_a_hot_phrase_gives_no_pairs(spark):
    hot = prose(50, 10)
    bench = spark.createDataFrame([(i, hot + " " + prose(60 + i, 30)) for i in range(5)], "item bigint, text string")
    bench = D.item_words(bench).withColumn("version", F.col("item"))
    seeds = bench.agg(F.flatten(F.collect_list("seeds")).alias("s")).first().s
    common = [x for x in set(seeds) if seeds.count(x) == 5]
    hits = spark.createDataFrame([(i, common) for i in range(20)] + [(20, seeds)], "key bigint, seeds array<bigint>")
    rare = D.rare_seeds(bench, hits, 0.5)
    assert len(common) == 6 and rare.where(F.col("seed").isin(common)).count() == 0 and rare.select("version").distinct().count() == 5
    assert D.rare_seeds(bench, hits.where("key < 20"), 0.5).count() == 0  # nobody can reach half of an item


def test_the_filter_holds_all_seeds(spark):
    h = np.random.default_rng(1).integers(-2**63, 2**63, 5000)
    bits = D.bloom(spark.createDataFrame([(int(x),) for x in h], "seed bigint"), len(h))
    assert D.in_bloom(bits, h.view(np.uint64)).all()
    other = np.random.default_rng(2).integers(-2**63, 2**63, 100_000).view(np.uint64)
    assert D.in_bloom(bits, other).mean() < 0.002
    assert not D.in_bloom(D.bloom(spark.createDataFrame([], "seed bigint"), 0), other).any()


def test_empty(spark):
    docs, items = cases()
    assert found(spark, [], items) == {} and found(spark, docs, []) == {}


def test_planted_passages_of_the_tables(spark):
    got = {(r.doc_id, r.item_id) for r in D.op6_decontamination(spark, SF001).collect()}
    items = {r.item_id: " ".join(words(r.text)) for r in table(spark, SF001, "benchmark").collect()}
    want = {(d.doc_id, i) for d in table(spark, SF001, "documents").collect() for i, t in items.items()
            if f" {t} " in f" {' '.join(words(d.text))} "}
    assert want and want == got
