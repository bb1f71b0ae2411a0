import itertools
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from georisk.llm import packing as P
from tests.llm.texts import awkward, documents, prose

PUBLIC = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
PUBLIC.encode_special_tokens = True


def ids_of(text):
    return [*PUBLIC.encode(text or "", add_special_tokens=False).ids, 0]


def test_closest_against_all_subsets():
    r = random.Random(1)
    for _ in range(200):
        items = [r.randint(1, 30) for _ in range(r.randint(0, 9))]
        room = r.randint(0, 60)
        sums = {sum(c) for n in range(len(items) + 1) for c in itertools.combinations(items, n)}
        got = P.closest(Counter(items), room)
        assert not Counter(got) - Counter(items)
        assert sum(n * c for n, c in got.items()) == max(s for s in sums if s <= room)


def hists():
    r = random.Random(2)
    yield {}
    yield {1: 1}
    yield {600: 10_001}
    yield {64: 5}
    yield {63: 3, 64: 2}
    for size in (3, 40, 500, 20_000):
        yield Counter(r.choice([37, r.randint(1, 64)]) for _ in range(size))


@pytest.mark.parametrize("n", range(9))
def test_plan_places_every_piece_once(n):
    hist = list(hists())[n]
    capacity = 1024 if 600 in hist else 64
    p = P.plan(hist, capacity, 4)
    length = np.repeat(np.array(sorted(hist), np.int64), [hist[k] for k in sorted(hist)])
    rank = np.concatenate([np.arange(hist[k]) for k in sorted(hist)] or [np.zeros(0, np.int64)])
    row, skip, take, seq, off = P.places(p.arrays(), length, rank)
    whole, windows = defaultdict(list), defaultdict(list)
    for x in zip(row.tolist(), skip.tolist(), take.tolist(), seq.tolist(), off.tolist()):
        whole[x[0]].append(x[1:3])
        windows[x[3]].append((x[4], x[2]))
    assert sorted(whole) == list(range(len(length)))
    for i, parts in whole.items():
        assert [a for a, _ in sorted(parts)] == [sum(t for _, t in sorted(parts)[:k]) for k in range(len(parts))]
        assert sum(t for _, t in parts) == length[i]
    assert sorted(windows) == list(range(p.sequences))
    short = []
    for w in windows.values():
        assert [a for a, _ in sorted(w)] == [sum(t for _, t in sorted(w)[:k]) for k in range(len(w))]
        total = sum(t for _, t in w)
        assert 0 < total <= capacity
        short.append(capacity - total)
    # All but the last are full up to a gap too small for a cut.
    assert sorted(short)[:-1] == [] or max(sorted(short)[:-1]) < 4
    assert len(p.rows) < 40 * capacity


def check(rows, found, encode, capacity):
    """The contract, over (doc_id, text) rows and (doc_id, start, ids, doc_tokens, sequence_id, offset)."""
    want, docs, windows = Counter(), defaultdict(list), defaultdict(list)
    for i, t in rows:
        want[i, tuple(encode(t))] += 1
    for i, start, ids, n, seq, off in found:
        docs[i, n].append((start, ids))
        windows[seq].append((off, len(ids)))
        assert 0 < len(ids) <= capacity
    for w in windows.values():
        w.sort()
        assert [a for a, _ in w] == [sum(t for _, t in w[:k]) for k in range(len(w))]
        assert sum(t for _, t in w) <= capacity
    total = sum(len(k[1]) * c for k, c in want.items())
    assert sum(len(x[2]) for x in found) == total
    assert len(windows) <= total / (capacity - P.LEAST_CUT + 1) + 1
    flat = Counter()
    for (i, n), parts in docs.items():
        starts = defaultdict(list)
        for s, ids in parts:
            starts[s].append(ids)
        # Documents of one id and length: piece by piece, as a multiset of (id, start, ids).
        flat.update((i, n, s + k, t) for s, found_ids in starts.items() for ids in found_ids for k, t in enumerate(ids))
    assert flat == Counter({(i, len(ids), k, t): 0 for (i, ids) in want for k, t in enumerate(ids)}) + sum(
        (Counter({(i, len(ids), k, t): c for k, t in enumerate(ids)}) for (i, ids), c in want.items()), Counter())


def test_awkward_rows(spark):
    rows = awkward() + [(60, " " * 300_000 + "x", "en"), (61, "<|endoftext|> a", "en")] + [(100 + i, prose(i, 5 * i), "en") for i in range(40)]
    packed = P.pack(documents(spark, rows), "doc_id")
    found = [(r.doc_id, r.start, tuple(r.ids), r.doc_tokens, r.sequence_id, r.offset) for r in packed.collect()]
    check([(i, t) for i, t, _ in rows], found, ids_of, 1024)
    whole = {r.sequence_id: r.ids for r in P.sequences(packed).collect()}
    for _, _, ids, _, seq, off in found:
        assert tuple(whole[seq][off: off + len(ids)]) == ids


def test_other_encoders_capacities_and_cuts(spark):
    def by_bytes():  # local, so that workers need not import the tests
        return lambda text: np.frombuffer(text.encode(), np.uint8).astype(np.uint32) + 1

    rows = [(i % 7, "x" * 39) for i in range(300)] + [(50, "y" * 200), (None, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    packed = P.pack(df, "doc_id", capacity=64, encoder=by_bytes)
    assert packed.where("length = 24").count()  # 40 tokens each: a second one only fits when cut
    check(rows, [(r.doc_id, r.start, tuple(r.ids), r.doc_tokens, r.sequence_id, r.offset) for r in packed.collect()],
          lambda t: [*(b + 1 for b in (t or "").encode()), 0], 64)
    assert P.pack(df.limit(0), "doc_id").collect() == []


def test_query(spark):
    d = "/root/testdata/sf0.001"
    texts = {r.doc_id: ids_of(r.text) for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    got = P.op11_packing(spark, d).collect()
    assert got[0].asDict().keys() == {"doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"}
    found = []
    for r in got:
        ids = texts[r.doc_id][r.start: r.start + r.length]
        assert r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes()) and r.doc_tokens == len(texts[r.doc_id])
        found.append((r.doc_id, r.start, tuple(ids), r.doc_tokens, r.sequence_id, r.offset))
    used = Counter((i, s + k) for i, s, ids, *_ in found for k in range(len(ids)))
    assert set(used.values()) == {1} and len(used) == sum(map(len, texts.values()))
    windows = Counter()
    for _, _, ids, _, seq, _ in found:
        windows[seq] += len(ids)
    assert max(windows.values()) <= 1024 and sum(1024 - n for n in windows.values()) < 1024 + 16 * len(windows)
