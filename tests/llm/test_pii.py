import re

from pyspark.sql import functions as F

from georisk.llm import pii as P
from tests.llm.texts import awkward, documents


def luhn(d):
    s = 0
    for i, c in enumerate(reversed(d)):
        v = int(c) * (1 + i % 2)
        s += v - 9 * (v > 9)
    return s % 10 == 0


def brute(text):
    text, out = text or "", []
    for k, p in enumerate((P.EMAIL, P.IP, P.CARD, P.PHONE)):
        for m in re.finditer(p, text):
            d = re.sub("[^0-9]", "", m[0])
            if (k == 0 or k == 1 and all(int(x) <= 255 for x in m[0].split("."))
                    or k == 2 and 13 <= len(d) <= 19 and luhn(d) or k == 3 and 9 <= len(d) <= 15):
                out.append((k, m.start(), m.end()))
    return out


TEXTS = [
    "mail me: é.ana@mail.example.com, 10.0.0.256 10.0.0.255 001.02.3.4.5", "4111 1111 1111 1111 or 4111111111111112",
    "+1 (048) 555-4142 +123 +1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6", "a@b.c_d@e.f.g@h.i x@@y.z .@-.-", "1.2.3.4.5.6.7.8 and 1..2.3.4",
    "😀 +49 30 1234567 😀 card 5500-0000-0000-0004, 5500--0000", "99" * 40, "a" * 3000 + "@" + "b." * 3000 + "c",
    "1." * 5000, "1 " * 5000, "+1" + "(" * 4000, "phone (212) 555-0123 call 212-555-0199 now", "bob [at] example [dot] com",
    ("x@y.zz " * 700)]


def rows():
    return awkward() + [(100 + i, t, "en") for i, t in enumerate(TEXTS)]


def test_base_spans_against_brute_force(spark):
    got = P.detect(documents(spark, rows()), ["doc_id", "text"]).collect()
    assert sorted(((r.doc_id, r.text, [(s.kind, s.start, s.end) for s in r["__base"]]) for r in got), key=repr) == sorted(
        ((i, t, brute(t)) for i, t, _ in rows()), key=repr)
    for r in got:  # base spans stay, added ones overlap none of them
        spans = [(s.kind, s.start, s.end) for s in r["__spans"]]
        base = [(s.kind, s.start, s.end) for s in r["__base"]]
        assert set(base) <= set(spans) and spans == sorted(spans)
        for k, s, e in set(spans) - set(base):
            assert not any(bs < e and s < be for _, bs, be in base)


def test_the_classifier_adds_likely_spans_only(spark):
    texts = [f"card {n}" for n in ("4111111111111111", "5500000000000004", "340000000000009")] * 20
    texts += ["code 9111111111111112 of"] * 20 + ["ring phone (212) 555-0123 now", "phone +1 212 555 0123"] * 20
    docs = documents(spark, [(i, t, "en") for i, t in enumerate(texts)])
    got = {r.text: [t for t in r["__spans"]] for r in P.detect(docs, ["doc_id", "text"]).collect()}
    assert got["code 9111111111111112 of"] == []
    assert [(s.kind, s.start, s.end) for s in got["ring phone (212) 555-0123 now"]] == [(3, 11, 25)]


LIKELY = ["call me on (212) 555-0{:03d} please", "write to jo{}.kim [at] mail{} (dot) org please", "phone 212-555-0{:03d} mobile"]
DECOYS = ["order no 9111-1111-1111-{:04d}", "serial 999999 12345678 {:04d}x", "=212-555-0{:03d}/", "meet (at) noon {}"]


def test_planted_spans_on_the_whole_table(spark):
    """Looser spans put into every document of the table are added, decoys and all else left alone."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    rows, want, plain = [], {}, {}
    for d in docs:
        add = (LIKELY + DECOYS)[d.doc_id % (len(LIKELY) + len(DECOYS))].format(d.doc_id % 1000, d.doc_id % 7)
        head = f"{d.text or ''}\n"
        rows.append((d.doc_id, head + add + "\n", "en"))
        m = re.search(r"\(212\) 555-0\d+|jo\d.* org|212-555-0\d+", add)
        likely = d.doc_id % (len(LIKELY) + len(DECOYS)) < len(LIKELY)
        want[d.doc_id] = [(0 if "[at]" in add else 3, len(head) + m.start(), len(head) + m.end())] if likely else []
        plain[d.doc_id] = brute(head + add + "\n")
    got = {r.doc_id: [(s.kind, s.start, s.end) for s in r["__spans"]] for r in P.detect(documents(spark, rows), ["doc_id"]).collect()}
    assert len(got) == len(rows) and got == {i: sorted(plain[i] + want[i]) for i in want}


def test_traits_decide_where_votes_are_split():
    """Equal votes, told apart by what the classifier learned of the traits."""
    yes, no, split = 2 + 2 * 3 + 2 * 9 + 27, 0 + 0 * 3 + 9 + 0, 1 + 2 * 3 + 9 + 0
    counts = {(3, yes, 4 + 8): 100, (3, no, 2): 100, (3, split, 4 + 8): 5, (3, split, 2): 5}
    post = {(3, yes): 1.0, (3, no): 0.0, (3, split): 0.5}
    w = P.train(counts, post)
    assert [sum(w[j] for j in P.features(3, split, t)) > 0 for t in (12, 2)] == [True, False]


def test_posteriors_do_not_depend_on_the_size():
    counts = {(2, 2 + 2 * 3 + 9 + 27): 50, (2, 0 + 0 * 3 + 9 + 27): 40, (2, 0 + 2 * 3 + 9 + 27): 12}
    small = P.estimate(counts)
    large = P.estimate({k: n * 1000 for k, n in counts.items()})
    assert {k: p > 0.5 for k, p in small.items()} == {k: p > 0.5 for k, p in large.items()}
    assert [p > 0.5 for p in small.values()] == [True, False, False]


def test_redaction(spark):
    found = P.detect(documents(spark, rows()), ["doc_id", "text"])
    for r in found.withColumn("clean", P.redacted(F.col("text"), F.col("__spans"))).collect():
        spans = sorted((s.start, s.end, s.kind) for s in r["__spans"])
        want, at = "", 0
        for s, e, k in spans:
            if s >= at:
                want += r.text[at:s] + f"[{P.KINDS[k].upper()}]"
            at = max(at, e)
        assert r.clean == (want + r.text[at:] if spans else r.text)


def test_empty(spark):
    assert P.detect(documents(spark, []), ["doc_id"]).collect() == []
