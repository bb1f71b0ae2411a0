import random

import pytest

from georisk.llm import substring_dedup as S
from tests.llm.texts import awkward, documents, prose


def brute(rows, length):
    words = [(i, (t or "").encode().split()) for i, t, *_ in rows]
    first = {}
    for i, w in words:
        if i is not None:
            for k in range(len(w) - length + 1):
                s = tuple(w[k: k + length])
                first[s] = min(i, first.get(s, i))
    out = []
    for i, w in words:
        gone = [False] * len(w)
        for k in range(len(w) - length + 1):
            if i is not None and first[tuple(w[k: k + length])] < i:
                gone[k: k + length] = [True] * length
        out.append((i, len(w), sum(gone), b" ".join(x for x, g in zip(w, gone) if not g).decode()))
    return sorted(out, key=repr)


def found(spark, rows, **kw):
    got = S.remove_repeats(documents(spark, rows), **kw).collect()
    return sorted([(r.doc_id, r.n_words, r.n_removed, r.kept) for r in got], key=repr)


@pytest.mark.parametrize("period", [2, 3, 7, 13, 31])
def test_cover_has_every_difference(period):
    cover = S.difference_cover(period)
    assert {(a - b) % period for a in cover for b in cover} == set(range(period))


def test_any_two_equal_windows_share_an_aligned_anchor():
    cover, p = set(S.difference_cover(S.PERIOD)), S.PERIOD
    for i in range(p):
        for j in range(p):
            assert any((i + d) % p in cover and (j + d) % p in cover for d in range(p))


def test_small_windows_against_brute_force(spark):
    r = random.Random(3)
    rows = []
    for i in range(60):
        parts = [" ".join(r.choices("a b c".split(), k=r.randint(0, 25))), prose(r.randint(0, 5), 20), prose(100 + i, r.randint(0, 15))]
        r.shuffle(parts)
        rows.append((i, " ".join(parts), "en"))
    rows += [(3, rows[9][1], "en"), (None, rows[4][1], "en"), (70, None, None)]
    assert found(spark, rows, length=8, period=3) == brute(rows, 8)


def test_passages_of_fifty_words(spark):
    passage = prose(1, 55)
    rows = [(5, prose(2, 30) + " " + passage, "en"), (6, passage + "\n" + prose(3, 40), "en"),
            (7, prose(4, 3) + "\t" + " ".join(passage.split()[2:52]) + " tail", "en"),
            (8, " ".join(passage.split()[:49]), "en"), (4, prose(5, 80), "en"), (9, prose(5, 80), "en")]
    got = found(spark, rows)
    assert got == brute(rows, 50)
    assert [x[2] for x in got] == [0, 0, 55, 50, 0, 80]


def test_awkward_rows(spark):
    rows = awkward()
    assert found(spark, rows) == brute(rows, 50)
    assert found(spark, []) == []
