import math

import numpy as np
import pytest

from clausemill.llm import feast, whitening


def symmetric(values, seed=0):
    q, _ = np.linalg.qr(np.random.default_rng(seed).standard_normal((len(values), len(values))))
    a = q @ np.diag(values) @ q.T
    return (a + a.T) / 2


SPECTRA = {
    "even": np.arange(1.0, 41),
    "falling": 0.5 ** np.arange(30),
    "tie at the edge": np.array([9.0, 8, 7, 6, 5, 4, 3, 2, 2, 2, 1, 0.5]),
    "tie inside": np.array([5.0, 5, 5, 5, 4, 4, 3, 2, 1, 1, 1, 1]),
    "near tie": np.array([3.0, 3 - 1e-9, 2, 2 - 1e-10, 1, 1, 0.9, 0.8, 0.8 - 1e-11, 0.1]),
    "low rank": np.array([4.0, 2, 1, 0, 0, 0, 0, 0, 0, 0]),
    "steep": np.array([1e6, 1e4, 1e3, 1, 0.1, 1e-2, 1e-3, 1e-4, 1e-5]),
    "one": np.array([2.5]),
    "flat": np.linspace(1, 1.2, 64),
}


@pytest.mark.parametrize("name", SPECTRA)
@pytest.mark.parametrize("count", [1, 3, 8])
def test_largest_eigenpairs(name, count):
    values = SPECTRA[name]
    a = symmetric(values)
    expected = np.sort(values)[::-1][:count]
    expected = expected[expected > 1e-12 * expected[0]]
    found, vectors = feast.largest(a, count)
    assert len(found) == len(expected)
    assert np.allclose(found, expected, rtol=1e-9, atol=1e-12 * expected[0])
    assert np.allclose(vectors.T @ vectors, np.eye(len(found)), atol=1e-12)
    assert np.linalg.norm(a @ vectors - vectors * found, axis=0).max() < 1e-10 * expected[0]


def test_inertia_counts():
    for seed in range(20):
        rng = np.random.default_rng(seed)
        values = np.sort(rng.standard_normal(rng.integers(1, 20)))
        a = symmetric(values, seed)
        for shift in (-3, -0.5, 0.01, 0.7, 3):
            assert feast.below(a, shift) == (values < shift).sum()
    assert feast.below(np.array([[0.0, 1], [1, 0]]), 0) == 1 and feast.below(np.zeros((3, 3)), 0) == 0
    assert feast.largest(np.zeros((4, 4)), 8)[0].size == 0 and feast.largest(np.zeros((0, 0)), 8)[0].size == 0


def test_contour_projects_onto_the_interval():
    values = np.array([5.0, 4, 3, 1, 0.5, -2])
    a = symmetric(values)
    w, v = np.linalg.eigh(a)
    inside = v[:, (w > 2) & (w < 6)]
    out = feast.project(a, 2, 6, np.eye(6), 40)
    assert np.allclose(out, inside @ inside.T, atol=1e-6)


def plain(rows):
    """Whitening of (id, vector) rows by whole-matrix numpy, in Python's whole numbers."""
    good = [(i, v) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    x = [[math.floor(1024 * float(c)) + 100000 for c in v] for _, v in good]
    n, sums = len(x), [sum(c) for c in zip(*x, strict=True)]
    dev = [sum((n * c - s) ** 2 for c, s in zip(v, sums, strict=True)) for v in x]
    centred = np.array(x, float) - np.array(sums) / n
    cov = centred.T @ centred / n
    e, u = np.linalg.eigh(cov)
    return good, n, dev, centred, e[::-1], u[:, ::-1], np.trace(cov)


def check(found, rows, components=8):
    good, n, dev, centred, e, u, trace = plain(rows)
    by = {}
    for r in found:
        by.setdefault(r.vec_id, []).append(r)
    assert sorted(by) == sorted(i for i, _ in good)
    signs = None
    for k, (i, _) in enumerate(good):
        own = sorted(by[i], key=lambda r: r.component)
        assert [r.component for r in own] == list(range(1, components + 1))
        white = np.array([r.whitened for r in own])
        expected = centred[k] @ u[:, :components] / np.sqrt(e[:components])
        if signs is None or (signs == 0).any():
            now = np.where(np.abs(expected) > 1e-6, np.sign(white * expected), 0)
            signs = now if signs is None else np.where(signs == 0, now, signs)
        assert np.allclose(white, np.where(signs == 0, white, signs * expected), atol=1e-6)
        assert all(r.n == n and r.deviation == dev[k] for r in own)
        assert all(abs(r.explained / (e[r.component - 1] / trace) - 1) < 1e-9 and r.identity_error < 1e-9 for r in own)


@pytest.mark.parametrize("sf", ["0.001", "0.01"])
def test_query_against_numpy(spark, sf):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"/root/testdata/sf{sf}/embeddings.parquet").collect()]
    check(whitening.op12_whitening(spark, f"/root/testdata/sf{sf}").collect(), rows)


def query(spark, tmp_path, rows, schema="vec_id long, embedding array<double>, whitened string"):
    spark.createDataFrame([(*r, "x") for r in rows], schema).repartition(3).write.mode("overwrite").parquet(f"{tmp_path}/embeddings.parquet")
    return whitening.op12_whitening(spark, str(tmp_path))


def test_odd_vectors(spark, tmp_path):
    rng = np.random.default_rng(5)
    rows = [(k, [float(c) for c in rng.standard_normal(12) * np.arange(1, 13)]) for k in range(60)]
    bad = [(100, None), (101, []), (102, [None] + [1.0] * 11), (103, [float("nan")] + [1.0] * 11), (104, [float("-inf")] + [1.0] * 11), (105, [1.0] * 5), (106, [1e300] * 12)]
    check(query(spark, tmp_path, rows + bad).collect(), rows)
    twice = query(spark, tmp_path, [*rows, rows[0], (None, rows[1][1])])
    assert twice.where("vec_id = 0").count() == 16 and twice.where("vec_id is null").count() == 8
    for none in ([], bad[:1], [(1, [2.0, 3.0])], [(1, [2.0, 3.0])] * 4):
        assert query(spark, tmp_path, none).count() == 0
    line = query(spark, tmp_path, [(k, [float(k), 2.0 * k]) for k in range(9)]).collect()
    assert len(line) == 9 and abs(sum(r.whitened**2 for r in line) / 9 - 1) < 1e-9 and abs(line[0].explained - 1) < 1e-9


def test_whole_numbers_beyond_longs(spark, tmp_path):
    rows = [(k, [float(k * 10**14), float((k * k % 7) * 10**13)]) for k in range(12)]
    found = query(spark, tmp_path, rows).collect()
    _, n, dev, *_ = plain(rows)
    assert {r.deviation for r in found} == {None} and {r.n for r in found} == {n}
    model = whitening.fit(spark.read.parquet(f"{tmp_path}/embeddings.parquet"))
    exact = whitening.whitened(spark.read.parquet(f"{tmp_path}/embeddings.parquet"), model).select("vec_id", "deviation").collect()
    assert all(int(r.deviation) == dev[r.vec_id] for r in exact if r.deviation is not None)
    middle = query(spark, tmp_path, [(k, [k * 3e6, -k * 1e6]) for k in range(9)]).collect()
    _, _, dev, *_ = plain([(k, [k * 3e6, -k * 1e6]) for k in range(9)])
    assert all(r.deviation == (dev[r.vec_id] if dev[r.vec_id] < 2**63 else None) for r in middle)
