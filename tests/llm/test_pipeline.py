"""The whole pipeline against a plain version of it, and its stages on awkward rows."""

import hashlib

import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline as C
from georisk.llm import bpe, pii
from tests.llm.test_decontaminate import brute_tiles, words
from tests.llm.test_pii import brute as personal
from tests.llm.test_simhash import brute_components, brute_fp
from tests.llm.texts import awkward, documents

SF0001 = "/root/testdata/sf0.001"


def plain(docs, items):
    """{doc_id: text after redaction} of what the stages keep; docs: (id, text)."""
    docs = [(i, t) for i, t in docs if t and any(c.isalpha() for c in t)]
    fps = [brute_fp(t) for _, t in docs]
    order = sorted(set(fps))
    group = dict(zip(order, brute_components(order)))
    best = {}
    for (i, t), f in zip(docs, fps):
        best[group[f]] = min(best.get(group[f], (i, t)), (i, t))
    kept = {}
    for i, t in best.values():
        doc, flagged = words(t), False
        text = f" {' '.join(doc)} "
        for item in items:
            w = words(item)
            if w and any(f" {' '.join(w[k: k + min(5, len(w))])} " in text for k in range(max(1, len(w) - 4))):
                flagged |= sum(n for *_, n in brute_tiles(w, doc, min(5, len(w)))) / len(w) >= 0.5
        if not flagged:
            clean, at = "", 0
            for s, e, k in sorted((s, e, k) for k, s, e in personal(t)):
                if s >= at:
                    clean += t[at:s] + f"[{pii.KINDS[k].upper()}]"
                at = max(at, e)
            kept[i] = clean + t[at:]
    return kept


def test_whole_pipeline_against_a_plain_version(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF0001}/documents.parquet").collect()]
    items = [r.text for r in spark.read.parquet(f"{SF0001}/benchmark.parquet").collect()]
    want = plain(docs, items)
    got = {r.doc_id: r for r in C.run(spark, SF0001).collect()}
    assert 100 < len(want) < len(docs) and set(got) == set(want)
    ranks, pattern = bpe.production()
    public = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    for i, t in want.items():
        assert got[i].ids == public.encode_ordinary(t) and got[i].n_tokens == len(got[i].ids)
        assert got[i].decoded_sha256 == hashlib.sha256(t.encode()).hexdigest()


def test_names_and_contract():
    assert [n for n, _ in C.STAGES] == ["language_id", "simhash_near_dedup", "decontamination", "pii", "byte_bpe"]
    import __spark_entry__ as E
    from georisk.llm.queries import QUERIES
    assert E.queries()["pipeline"] is C.run and set(QUERIES) <= set(E.queries())
    assert [sum(q.startswith(f"op{n}_") for q in QUERIES) for n in range(1, 11)] == [1] * 10


@pytest.mark.parametrize("rows", [[], awkward()])
def test_stages_on_awkward_rows(spark, rows):
    rows = rows + [(30, "write to a.b@c.example.org now", "en")] * bool(rows)
    docs, seen = documents(spark, rows), []
    for name, stage in C.STAGES:
        out = C.written(stage(spark, docs, SF0001), f"t-{name}")
        if name != "byte_bpe":
            assert out.columns == docs.columns
            assert [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
        seen.append(out.count())
        docs = out
        if name == "pii" and rows:
            clean = {r.doc_id: r for r in out.collect()}
            assert clean[30].text == "write to [EMAIL] now" and clean[30].n_chars == len(clean[30].text)
            assert clean[30].component == 8 and clean[30].ids == [1, 2]
    if rows:
        with_letters = {t for _, t, _ in rows if t and any(c.isalpha() for c in t)}
        assert seen[0] == sum(1 for _, t, _ in rows if t in with_letters)
        assert seen[1] == len({brute_fp(t) for t in with_letters}) == seen[2] == seen[3] == seen[4]
    else:
        assert seen == [0] * 5


def test_oracles_are_sql_and_match(spark):
    import duckdb
    from georisk.llm.queries import ORACLES, QUERIES
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF0001}/{t}.parquet'")
    for name, sql in ORACLES.items():
        got = QUERIES[name](spark, SF0001)
        want = con.execute(sql)
        names = [c[0] for c in want.description]
        assert sorted(names) == sorted(got.columns), name
        assert sorted(map(repr, (tuple(r) for r in got.select(*names).collect()))) == sorted(map(repr, want.fetchall())), name
