import math

import numpy as np
import pytest

from georisk.llm import whitening as W


def usable(rows):
    good = [(i, v) for i, v in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    dim = max((len(v) for _, v in good), default=0)
    good = [(i, v) for i, v in good if len(v) == dim]
    return [i for i, _ in good], np.array([[math.floor(1024 * x) + 100_000 for x in v] for _, v in good], np.int64).reshape(-1, dim)


def plain(x, k):
    """Whitened rows (up to sign) and explained shares, from numpy's eigendecomposition."""
    centred = x - x.sum(axis=0) / len(x)
    values, vectors = np.linalg.eigh(centred.T @ centred / len(x))
    values, vectors = values[::-1], vectors[:, ::-1]
    k = int((values[:k] > W.FLAT * values[0]).sum())
    return centred @ vectors[:, :k] / np.sqrt(values[:k]), values[:k] / values.sum()


@pytest.mark.parametrize("dim", [1, 2, 7, 40])
@pytest.mark.parametrize("kind", ["plain", "equal", "flat", "repeats", "single rows", "unit"])
def test_rank_one_updates_against_one_decomposition(dim, kind):
    r = np.random.default_rng(dim)
    out, other, rows = W.Spectrum(dim), W.Spectrum(dim), []
    for b in range(6):
        x = np.floor(r.normal(size=(r.integers(2, 90), dim)) * 100 * np.arange(1, dim + 1)).astype(np.int64) + 100_000
        if kind == "equal":
            x[:] = x[0]
        elif kind == "flat":
            x[:, dim // 2:] = 7
        elif kind == "repeats":
            x = np.tile(x[:2], (30, 1))
        elif kind == "unit":  # many equal eigenvalues
            x = np.eye(dim, dtype=np.int64)
        rows.append(x)
        for part in ([x] if kind != "single rows" else x[:, None, :]):
            (out if b % 2 else other).add(part)
    out.combine(other)
    x = np.concatenate(rows)
    centred = x - x.mean(axis=0)
    scatter = centred.T @ centred
    top = max(np.abs(scatter).max(), 1)
    assert out.n == len(x) and (out.sums == x.sum(axis=0)).all()
    assert np.abs(out.vectors * out.values @ out.vectors.T - scatter).max() / top < 1e-10
    assert np.abs(out.vectors.T @ out.vectors - np.eye(dim)).max() < 1e-10


def test_secular_roots_interlace():
    r = np.random.default_rng(3)
    for n in (1, 2, 9):
        d, z = np.sort(r.random(n)) * 10, r.random(n) + 0.01
        pole, x = W.secular_roots(d, z, 2.5)
        want = np.linalg.eigvalsh(np.diag(d) + 2.5 * np.outer(z, z))
        assert np.allclose(d[pole] + x, want, rtol=1e-13)


def held(df, k):
    out = {}
    for r in df.collect():
        out.setdefault(r.vec_id, []).append(r)
    return out


@pytest.mark.parametrize("block,fan", [(8192, 16), (16, 2)])
def test_whiten_against_one_decomposition(spark, monkeypatch, block, fan):
    monkeypatch.setattr(W, "BLOCK_ROWS", block)
    monkeypatch.setattr(W, "FAN_IN", fan)
    r = np.random.default_rng(5)
    rows = [(i, [float(x) for x in r.normal(size=5) * [5, 4, 3, 2, 1]]) for i in range(300)]
    rows += [rows[7], rows[7], (None, rows[3][1]), (400, None), (401, []), (402, [1.0] * 4), (403, [1.0, None, 1.0, 1.0, 1.0]),
             (404, [float("nan")] * 5), (405, [1.0, 2.0, 3.0, 4.0, float("-inf")])]
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id bigint, embedding array<double>, n int, x string").repartition(5)
    ids, x = usable(rows)
    white, explained = plain(x, 3)
    got = W.whiten(df, components=3).collect()
    assert sorted((r.vec_id is None, r.vec_id or 0) for r in got) == sorted((i is None, i or 0) for i in ids)
    sign, by_id = None, {i: (w, int(((len(x) * row - x.sum(axis=0)).astype(object) ** 2).sum())) for i, w, row in zip(ids, white, x)}
    for g in got:
        w, deviation = by_id[g.vec_id]
        sign = np.sign(w * g.whitened) if sign is None else sign
        assert np.allclose(sign * g.whitened, w, rtol=1e-9, atol=1e-9)
        assert (g.n, g.deviation) == (len(x), deviation) and np.allclose(g.explained, explained, rtol=1e-9)
        assert g.identity_error < 1e-9


def test_flat_huge_and_no_rows(spark):
    def run(rows, k=8):
        return W.whiten(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"), components=k).collect()

    assert run([]) == [] and run([(1, None)]) == [] and run([(1, [1.0, 2.0])]) == [] and run([(1, [1.0]), (2, [1.0])]) == []
    line = run([(1, [0.0, 1.0]), (2, [1.0, 1.0])])  # one direction only
    assert [len(r.whitened) for r in line] == [1, 1] and {round(abs(r.whitened[0]), 9) for r in line} == {1.0}
    huge = run([(1, [1e300, 0.0]), (2, [0.0, 0.0]), (3, [3.0, 0.0])])
    assert len(huge) == 3 and all(r.deviation is None for r in huge)
    mid = run([(1, [2e6]), (2, [0.0]), (3, [1.0])])
    xs = [1024 * 2_000_000 + 100_000, 100_000, 101_024]
    want = {i + 1: (3 * x - sum(xs)) ** 2 for i, x in enumerate(xs)}
    assert {r.vec_id: r.deviation for r in mid} == {i: v if v < 1 << 63 else None for i, v in want.items()}


def test_query(spark):
    d = "/root/testdata/sf0.001"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{d}/embeddings.parquet").collect()]
    ids, x = usable(rows)
    white, explained = plain(x, 8)
    got = W.op12_whitening(spark, d).toPandas().sort_values(["vec_id", "component"])
    assert len(got) == 8 * len(ids) and got.identity_error.max() < 1e-9
    order = np.argsort(ids)
    mine, want = got.whitened.to_numpy().reshape(-1, 8), white[order]
    assert np.allclose(mine * np.sign((mine * want).sum(axis=0)), want, rtol=1e-7, atol=1e-8)
    assert np.allclose(got.explained.to_numpy()[:8], explained, rtol=1e-9)
    deviation = ((len(x) * x - x.sum(axis=0)) ** 2).sum(axis=1)[order]
    assert (got.deviation.to_numpy()[::8] == deviation).all()
