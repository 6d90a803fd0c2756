"""Whitening and near-duplicates of vectors, against numpy on whole small tables."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.llm import vector_dedup, whitening

SCHEMA = "vec_id long, embedding array<double>, `_id` string, `_v` int, k int, u int, n string, ball long, label int"


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], "x", 1, 2, 3, "n", 4, 5) for i, v in rows], SCHEMA).repartition(parts)


def odd(width):
    """Rows that hold no vector to compare."""
    bad = [[0.5] * width for _ in range(4)]
    bad[0][-1], bad[1][0], bad[2][-1], bad[3][0] = None, float("nan"), float("inf"), float("-inf")
    return [None, [], [0.5] * (width + 1), *bad]


# --- whitening ----------------------------------------------------------------------------------------------


@pytest.mark.parametrize("kind", ["random", "equal eigenvalues", "low rank", "large numbers", "one entry", "two entries"])
def test_whitening_against_numpy(spark, kind):
    rng = np.random.default_rng(3)
    width = {"one entry": 1, "two entries": 2}.get(kind, 40)
    v = rng.normal(size=(400, width))
    if kind == "equal eigenvalues":
        v = np.repeat(np.r_[np.eye(40), -np.eye(40)], 5, axis=0)
    if kind == "low rank":
        v = np.round(rng.normal(size=(400, 6)) * 64) @ rng.integers(-3, 4, (6, 40)) / 64
    if kind == "large numbers":
        v[0] *= 1e9
        v[:, 3] += 1e8
    rows = [(int(i // 2), x) for i, x in enumerate(v.tolist())] + [(None, v[0].tolist())]  # ids repeat, one is null
    out = whitening.whiten(frame(spark, rows + [(900 + i, x) for i, x in enumerate(odd(width))])).cache()
    got = out.toPandas()
    every = np.array([x for _, x in rows])
    x = np.floor(64 * every).astype(int).astype(object) + 1_000_000
    n, s = len(x), x.sum(axis=0)
    deviation = ((n * x - s) ** 2).sum(axis=1)
    centred = np.array([[float(e) for e in r] for r in (n * x - s)]) / n
    cov = centred.T @ centred / n
    values = np.linalg.eigvalsh(cov)[::-1]
    k = int((values[:32] > 1e-11 * values[0]).sum())
    assert k == {"low rank": 6}.get(kind, min(32, width)) or kind == "large numbers"
    assert len(got) == n * k and set(got["component"]) == set(range(1, k + 1)) and set(got["n"]) == {n} and got["identity_error"].nunique() == 1
    want = sorted(str(d if d < 2**63 else None) for d in deviation)
    assert sorted(str(r.deviation) for r in out.where("component = 1").collect()) == want
    assert got["identity_error"].iloc[0] <= 1e-4
    for c, e in got.groupby("component")["explained"].first().items():
        assert e == pytest.approx(values[c - 1] / np.trace(cov), rel=1e-6)
    if kind in ("random", "one entry", "two entries"):
        vectors = np.linalg.eigh(cov)[1][:, ::-1][:, :k]
        expected = centred @ vectors / np.sqrt(values[:k])
        for c in range(1, k + 1):
            own = np.sort(got[got["component"] == c]["whitened"].to_numpy())
            assert min(np.abs(own - np.sort(sign * expected[:, c - 1])).max() for sign in (1, -1)) < 1e-9


def test_whitening_without_variance_or_rows(spark):
    assert whitening.whiten(frame(spark, [])).count() == 0
    assert whitening.whiten(frame(spark, [(1, None), (2, [])])).count() == 0
    assert whitening.whiten(frame(spark, [(1, [1.0, 2.0])] * 5)).count() == 0
    empty = whitening.whiten(frame(spark, []))
    assert empty.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_whole_sums_do_not_depend_on_partitions(spark):
    v = np.random.default_rng(5).normal(size=(300, 8)) * 1e5
    rows = [(i, x) for i, x in enumerate(v.tolist())]
    one, many = (sorted(map(tuple, whitening.whiten(frame(spark, rows, p)).select("vec_id", "component", "deviation", "explained", "whitened").collect())) for p in (1, 7))
    assert [r[:4] for r in one] == [r[:4] for r in many]
    assert np.abs(np.array([r[4] for r in one]) - [r[4] for r in many]).max() < 1e-12


@pytest.mark.parametrize("most", [3, 2**20, 2**25, 2**40])
def test_products_are_exact(most):
    y = np.random.default_rng(1).integers(-most, most, (50, 5))
    wide = y.astype(object)
    assert whitening.exact_products(y) == (wide.T @ wide).tolist()


@pytest.mark.parametrize("seed", range(6))
def test_eigenvalues_and_vectors(seed):
    rng = np.random.default_rng(seed)
    n = [3, 10, 64, 64, 90, 33][seed]
    q = np.linalg.qr(rng.normal(size=(n, n)))[0]
    spectrum = [np.arange(1.0, n + 1), np.r_[np.ones(n // 2), np.full(n - n // 2, 2.0)], np.geomspace(1, 1e-9, n), rng.random(n), np.r_[np.full(5, 7.0), np.linspace(0.1, 1, max(n - 5, 0))], np.r_[1, 1 + 1e-13, np.zeros(n - 2)]][seed]
    v = (q * spectrum) @ q.T
    v = (v + v.T) / 2
    e, z = whitening.components(v, 32)
    want = np.linalg.eigvalsh(v)[::-1][: len(e)]
    assert np.abs(e - want).max() < 1e-14 * n * want[0]
    assert np.abs(z.T @ z - np.eye(len(e))).max() < 1e-11 and np.abs(v @ z - z * e).max() < 1e-13 * n * want[0]
    a, b, mirrors = whitening.tridiagonal(v)
    t = np.diag(a) + np.diag(b, 1) + np.diag(b, -1)
    assert np.abs(np.linalg.eigvalsh(t) - np.linalg.eigvalsh(v)).max() < 1e-13 * n * want[0]
    at = rng.random(20) * want[0]
    assert whitening.counts_below(a, b, at).tolist() == [(np.linalg.eigvalsh(t) < x).sum() for x in at]


# --- near-duplicates ----------------------------------------------------------------------------------------


def linked(vectors):
    unit = lambda x: x / np.abs(x).max() / np.linalg.norm(x / np.abs(x).max())
    v = [unit(np.array(x, float)) if x is not None and len(x) and None not in x and np.isfinite(np.array(x, float)).all() and any(x) else None for x in vectors]
    width = max((len(x) for x in v if x is not None), key=[len(x) for x in v if x is not None].count, default=0)
    return {(i, j) for (i, x), (j, y) in itertools.combinations(enumerate(v), 2) if x is not None and y is not None and len(x) == len(y) == width and x @ y >= 0.9}


def expected(ids, pairs):
    root, n = list(range(len(ids))), [0] * len(ids)

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in pairs:
        root[find(j)] = find(i)
        n[i], n[j] = n[i] + 1, n[j] + 1
    least = {}
    for i, x in enumerate(ids):
        least.setdefault(find(i), []).append(x)
    least = {r: min((x for x in xs if x is not None), default=None) for r, xs in least.items()}
    return sorted(((x, n[i], least[find(i)], x == least[find(i)]) for i, x in enumerate(ids)), key=str)


def near(rng, v, noise):
    return v + noise * rng.normal(size=v.shape) / np.sqrt(len(v)) * np.linalg.norm(v)


@pytest.mark.parametrize(("block", "seed"), [(512, 0), (16, 1)])
def test_near_vectors_against_brute_force(spark, monkeypatch, block, seed):
    monkeypatch.setattr(vector_dedup, "BLOCK", block)
    rng = np.random.default_rng(seed)
    v = [rng.normal(size=64) * 10.0 ** rng.integers(-3, 4) for _ in range(250)]
    v += [near(rng, v[0], 0.05) for _ in range(120)]  # one group of copies and near copies
    v += [near(rng, v[0], 0.30) for _ in range(40)] + [v[0] * 2.5] * 90
    v += [near(rng, v[5], x) for x in np.linspace(0.1, 0.45, 30)]
    for i in range(20, 50):  # pairs and chains
        v.append(near(rng, v[i], 0.25))
        v.append(near(rng, v[-1], 0.25))
    v = [x.tolist() for x in v] + odd(64) + [[0.0] * 64, [1e-200] * 64, [2e-200] * 64, [1e200] * 64]
    ids = [1000 - i for i in range(len(v))]
    ids[3], ids[255], ids[256] = None, None, ids[257]
    got = [tuple(r) for r in vector_dedup.near_vectors(frame(spark, list(zip(ids, v, strict=True)))).collect()]
    want = expected(ids, linked(v))
    assert len(got) == len(want)
    have, all_ = sum(r[1] for r in got), sum(r[1] for r in want)
    assert 0.99 * all_ <= have <= all_
    assert sum(a == b for a, b in zip(sorted(got, key=str), want, strict=True)) >= 0.95 * len(want)
    exact = {r[0]: r for r in want if r[0] is not None}
    assert all(r[1] <= exact[r[0]][1] for r in got if r[0] is not None and ids.count(r[0]) == 1)  # no link that is none
    group = {exact[ids[i]][1] for i in range(250, 370) if ids.count(ids[i]) == 1 and ids[i] is not None}
    assert min(group) > 150


def test_copies_alone_and_empty_tables(spark):
    assert vector_dedup.near_vectors(frame(spark, [])).count() == 0
    got = sorted(map(tuple, vector_dedup.near_vectors(frame(spark, [(i % 50 + 3, [0.3, -0.4, 0.5]) for i in range(100)])).collect()))
    assert got == sorted((i % 50 + 3, 99, 3, i % 50 == 0) for i in range(100))
    assert sorted(map(tuple, vector_dedup.near_vectors(frame(spark, [(1, None), (2, [0.0]), (2, []), (None, None)])).collect()), key=str) == [(1, 0, 1, True), (2, 0, 2, True), (2, 0, 2, True), (None, 0, None, True)]


@pytest.mark.parametrize("width", [1, 2, 3, 8])
def test_short_vectors(spark, width):
    rng = np.random.default_rng(width)
    v = [x.tolist() for x in rng.normal(size=(150, width))]
    ids = list(range(150))
    got = [tuple(r) for r in vector_dedup.near_vectors(frame(spark, list(zip(ids, v, strict=True)))).collect()]
    want = expected(ids, linked(v))
    have, all_ = sum(r[1] for r in got), sum(r[1] for r in want)
    assert 0.95 * all_ <= have <= all_


@pytest.mark.parametrize("n", [500, 50_000])
def test_calibrated_recall(n):
    """Pairs that the calibration has not seen, at exactly the least cosine and nearer."""
    m = vector_dedup.family_size(n)
    m, half, enough = vector_dedup.calibrate(64, m, 0.9)
    assert m == vector_dedup.family_size(n) and enough > 1
    rng = np.random.default_rng(99)
    for cos, most in ((0.9, 0.035), (0.95, 0.006)):
        u = rng.normal(size=(1500, 64))
        u /= np.linalg.norm(u, axis=1, keepdims=True)
        w = rng.normal(size=u.shape)
        w -= (w * u).sum(axis=1, keepdims=True) * u
        v = cos * u + np.sqrt(1 - cos**2) * w / np.linalg.norm(w, axis=1, keepdims=True)
        (a, x), (b, y) = vector_dedup.largest_projections(u, m), vector_dedup.largest_projections(v, m)
        lost = 0
        for i in range(len(u)):
            p, q = dict(zip(a[i], x[i], strict=True)), dict(zip(b[i], y[i], strict=True))
            met = sum(c in q and abs(q[c] - p[c]) <= half for c in a[i][: vector_dedup.ASKED]) + sum(c in p and abs(q[c] - p[c]) <= half for c in b[i][: vector_dedup.ASKED])
            lost += met < enough
        assert lost / len(u) <= most


def test_largest_projections_are_the_largest():
    x = np.random.default_rng(2).normal(size=(5, 16))
    names, values = vector_dedup.largest_projections(x, 128)
    first, second = vector_dedup.directions(16, 128)
    every = ((x.astype(np.float32) @ first)[:, :, None] + (x.astype(np.float32) @ second)[:, None, :]).reshape(5, -1)
    assert np.allclose(values, -np.sort(-every, axis=1)[:, : vector_dedup.LISTED], atol=1e-5)
    assert np.allclose(values, np.take_along_axis(every, names, 1), atol=1e-5)


def test_links_of_groups_within_half_the_angle_need_no_pairs(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=64)
    rows = [(i, near(rng, base, 0.02).tolist()) for i in range(400)]
    got = vector_dedup.near_vectors(frame(spark, rows))
    assert {(r.n_links, r.component_id) for r in got.collect()} == {(399, 0)}
    assert got.where(F.col("kept")).count() == 1
