import random

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from georisk.llm import simhash as S
from georisk.llm import components as C
from georisk.llm.components import connected_components, hub_join
from tests.llm.texts import awkward, documents, prose


def brute_fp(text):
    w = (text or "").encode().lower().split()
    shingles = [b" ".join(w[i: i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps, radius=3):
    """fps: list of unsigned; the index of each one's group leader."""
    group = list(range(len(fps)))
    a = np.array(fps, np.uint64)
    todo = set(range(len(fps)))
    while todo:
        root = min(todo)
        queue = [root]
        todo.discard(root)
        while queue:
            i = queue.pop()
            group[i] = root
            near = [j for j in todo if int(np.bitwise_count(a[i] ^ a[j])) <= radius]
            todo.difference_update(near)
            queue += near
    return group


@settings(max_examples=300, deadline=None)
@given(st.integers(0, 4), st.data())
def test_masks_cover_every_pair_within_the_radius(radius, data):
    flips = data.draw(st.lists(st.integers(0, 63), max_size=radius, unique=True))
    difference = sum(1 << i for i in flips)
    assert any(m & difference == 0 for m in S.covering_masks(radius)) and len(S.covering_masks(radius)) == 2 ** (radius + 1) - 1


def clusters(n, seed=1):
    r = random.Random(seed)
    out = []
    while len(out) < n:
        base = r.getrandbits(64)
        for _ in range(r.randint(1, 12)):
            out.append(base)
            for _ in range(r.randint(0, 3)):
                base ^= 1 << r.randrange(64)
    return sorted(set(out[:n]))


@pytest.mark.parametrize("block,crowded,links", [(1024, 16384, 250_000), (4, 16384, 20), (4, 6, 7)])
def test_groups_against_brute_force(spark, monkeypatch, block, crowded, links):
    monkeypatch.setattr(S, "BLOCK", block)
    monkeypatch.setattr(S, "CROWDED", crowded)
    monkeypatch.setattr(C, "TASK_LINKS", links)
    fps = clusters(300)
    # A dense ball: many fingerprints of one bucket.
    fps = sorted(set(fps + [5 ^ (1 << i) ^ (1 << j) for i in range(12) for j in range(12)]))
    signed = [f - 2**64 if f >> 63 else f for f in fps]
    rows = [(k, signed[k]) for k in range(len(fps))] + [(1000 + k, signed[k]) for k in range(0, len(fps), 5)] + [(None, signed[3])]
    facts = {r.fp: r for r in S.groups(spark.createDataFrame(rows, "key bigint, fp bigint"), 3).collect()}
    want = brute_components(fps)
    assert {s: facts[s].component for s in signed} == dict(zip(signed, want))
    assert sum(r.n for r in facts.values()) == len(rows)


def test_fingerprints_and_awkward_rows(spark):
    rows = awkward() + [(20, "one", "en"), (21, "One two", "en"), (22, "ONE TWO", "en"), (23, "a b c d É", "en"), (24, prose(1, 300), "en")]
    got = S.near_duplicates(documents(spark, rows)).collect()
    assert len(got) == len(rows)
    fps = {t: brute_fp(t) for _, t, _ in rows}
    by_fp = {}
    for r in got:
        by_fp.setdefault(r.fp % 2**64, []).append(r)
    assert sorted(by_fp) == sorted(set(fps.values()))
    order = sorted(by_fp)
    group = brute_components(order)
    least = {}
    for g, f in zip(group, order):
        ids = [r.doc_id for r in by_fp[f] if r.doc_id is not None]
        least[g] = min([*ids, *([least[g]] if least.get(g) is not None else [])], default=None)
    for g, f in zip(group, order):
        assert {r.component for r in by_fp[f]} == {least[g]}
    assert S.near_duplicates(documents(spark, [])).collect() == []


def test_long_texts_stream_alike(monkeypatch):
    text = ("Some Words\n here  and\tthere " * 50).encode()
    whole = [s for part in S._shingles(text, 3) for s in part]
    monkeypatch.setattr(S, "LONG_TEXT", 10)
    monkeypatch.setattr(S, "CHUNK", 7)
    assert [s for part in S._shingles(text, 3) for s in part] == whole
    for n in range(5):
        t = b" ".join([b"w"] * n)
        assert [s for part in S._shingles(t, 3) for s in part] == ([b"w w w"] * (n - 2) if n > 2 else [t] * (n > 0))


def test_keep_one_of_each_group(spark):
    rows = awkward() + [(30, "same row", "fr"), (None, "only without id", "en"), (31, "", "en")]
    kept = S.keep_one(documents(spark, rows)).collect()
    groups = {}
    for i, t, lang in rows:
        groups.setdefault(brute_fp(t), []).append((i is None, i))
    assert sorted((r.doc_id is None, r.doc_id) for r in kept if r.doc_id is not None) == sorted(
        min(g, key=lambda x: (x[0], x[1] or 0)) for g in groups.values() if any(i is not None for _, i in g))
    assert len(kept) == len(groups)
    assert kept[0].__hint == "x" if hasattr(kept[0], "__hint") else True


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 4), st.data())
def test_finer_masks_cover_what_their_bucket_holds(radius, data):
    mask = data.draw(st.sampled_from(S.covering_masks(radius)))
    free = [i for i in range(64) if not mask >> i & 1]
    flips = data.draw(st.lists(st.sampled_from(free), max_size=radius, unique=True)) if free else []
    difference = sum(1 << i for i in flips)
    assert all(m & mask == mask for m in S.finer_masks(mask, radius))
    assert any(m & difference == 0 for m in S.finer_masks(mask, radius))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 30), st.integers(0, 30)), min_size=1, max_size=60))
def test_stars_against_a_search(edges):
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    want = {}
    for x in sorted(near):
        queue = [x] if x not in want else []
        while queue:
            y = queue.pop()
            if y not in want:
                want[y] = x
                queue += near[y]
    node, root = C.stars(*(np.array(x, np.int64) for x in zip(*edges)))
    assert dict(zip(node.tolist(), root.tolist())) == {x: r for x, r in want.items() if x != r}


@pytest.mark.parametrize("links", [250_000, 5])
def test_components_of_a_long_path_and_a_star(spark, monkeypatch, links):
    monkeypatch.setattr(C, "TASK_LINKS", links)
    edges = [(i, i + 1) for i in range(60)] + [(100, 101 + i) for i in range(50)] + [(7, 7), (300, 200), (200, 300)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {i: 0 for i in range(61)} | {i: 100 for i in range(100, 151)} | {200: 200, 300: 200}
    assert connected_components(spark.createDataFrame([], "a bigint, b bigint")).collect() == []


def test_hub_join_splits_hubs(spark, monkeypatch):
    monkeypatch.setattr(C, "HUB_LEAST", 10)
    rows = spark.createDataFrame([(1, i) for i in range(50)] + [(2, 5), (3, 6)], "k int, v int")
    facts = spark.createDataFrame([(1, 50, "a"), (2, 1, "b")], "k int, n int, f string")
    got = hub_join(rows, facts, "k", "n", 52).collect()
    assert sorted((r.k, r.v, r.f) for r in got) == [(1, i, "a") for i in range(50)] + [(2, 5, "b")]
