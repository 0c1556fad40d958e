"""Rank-one updates, combined spectra and whitened rows against dense linear algebra."""

import math

import numpy as np
import pytest

from dipstick.llm import queries, whitening

FOLDER = "/root/testdata/sf0.01"
KIND = "vec_id bigint, embedding array<float>, n string, part string, whitened string"


def whole(vectors):
    return np.array([[math.floor(64 * float(c)) + 1_000_000 for c in v] for v in vectors], dtype=object)


def dense(vectors):
    """(n, deviations, covariance, eigenvalues, components) by whole numbers and one dense decomposition."""
    x = whole(vectors)
    n, sums = len(x), x.sum(axis=0)
    offsets = n * x - sums
    y = (offsets / n).astype(float)
    cov = y.T @ y / n
    values, axes = np.linalg.eigh(cov)
    return n, (offsets**2).sum(axis=1), cov, values[::-1], axes[:, ::-1], y


def scatter(s):
    return (s.vectors * s.values) @ s.vectors.T


@pytest.mark.parametrize("seed", range(6))
def test_rank_one(seed):
    rng = np.random.default_rng(seed)
    d = 12
    kinds = [np.zeros(d), np.ones(d), np.sort(rng.random(d)), np.repeat([0, 1e-9, 1, 1e6], 3), np.sort(np.r_[np.zeros(6), rng.random(6) * 1e-14]), np.arange(d) * 1e-16]
    values, vectors = kinds[seed].astype(float), np.linalg.qr(rng.normal(size=(d, d)))[0]
    for along in (rng.normal(size=d), vectors[:, 3], np.zeros(d), vectors[:, 0] + 1e-13 * vectors[:, 5], rng.normal(size=d) * 1e-9):
        want = (vectors * values) @ vectors.T + 2.5 * np.outer(along, along)
        values, vectors = whitening.rank_one(values, vectors, along, 2.5)
        scale = max(np.abs(want).max(), 1e-300)
        assert np.abs((vectors * values) @ vectors.T - want).max() < 1e-13 * scale * d
        assert np.abs(vectors.T @ vectors - np.eye(d)).max() < 1e-12
        assert (np.diff(values) >= 0).all()


def test_many_updates_stay_orthogonal():
    rng = np.random.default_rng(3)
    x = (rng.normal(size=(600, 20)) * np.geomspace(1, 1e4, 20)).astype(np.int64)
    found = whitening.Spectrum.empty(20)
    for row in x:  # one row at a time: the mean's update alone
        found.add(row[None, :])
    want = np.cov(x.T, bias=True) * len(x)
    assert np.abs(scatter(found) - want).max() < 1e-9 * np.abs(want).max()
    assert np.abs(found.vectors.T @ found.vectors - np.eye(20)).max() < 1e-10
    assert found.sums == x.sum(axis=0).tolist() and found.n == 600


def test_merged_is_learned_at_once():
    rng = np.random.default_rng(4)
    x = rng.integers(-1000, 1000, size=(500, 8))
    one, two, both = (whitening.Spectrum.empty(8) for _ in range(3))
    one.add(x[:90])
    two.add(x[90:])
    both.add(x)
    one.merge(two)
    assert np.abs(scatter(one) - scatter(both)).max() < 1e-9 * both.values[-1] and one.sums == both.sums and one.n == both.n
    assert np.allclose(one.mean, both.mean)


def check(df, kept, dims, components=32):
    """``kept``: (vec_id, vector) of the rows that remain."""
    n, deviations, cov, values, axes, y = dense([v for _, v in kept])
    rows = df.collect()
    k = min(components, dims)
    assert len(rows) == len(kept) * k and {r.n for r in rows} == {n}
    by = {}
    for r in rows:
        by.setdefault(r.component, []).append(r)
    for c, found in by.items():
        want = sorted(zip([str(i) for i, _ in kept], deviations.tolist()))
        assert sorted((str(r.vec_id), r.deviation) for r in found) == want
        real = values[c - 1] > 1e-10 * values[0]
        assert all((r.whitened is not None) == real for r in found)
        assert all(abs(r.explained - max(values[c - 1], 0) / np.trace(cov)) < 1e-9 for r in found)
        if real and len({i for i, _ in kept}) == len(kept):
            white = y @ axes[:, c - 1] / math.sqrt(values[c - 1])
            white = dict(zip([i for i, _ in kept], white))
            got = {r.vec_id: r.whitened for r in found}
            sign = math.copysign(1, sum(got[i] * white[i] for i in got))
            assert max(abs(got[i] - sign * white[i]) for i in got) < 1e-6
    assert max(r.identity_error for r in rows) < 1e-9


def test_query_against_dense(spark):
    kept = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/embeddings.parquet").select("vec_id", "embedding").collect()]
    check(queries.QUERIES["op11_embedding_whitening"](spark, FOLDER), kept, 64)


def test_odd_rows(spark):
    rng = np.random.default_rng(5)
    fine = [(i, [float(np.float32(c)) for c in rng.normal(size=5)]) for i in range(40)] + [(None, [0.5] * 5), (3, [1.0, 2.0, 3.0, 4.0, 5.0])] * 2
    bad = [(50, None), (51, []), (52, [1.0, None, 2.0, 3.0, 4.0]), (53, [float("nan")] * 5), (54, [float("inf"), 1.0, 2.0, 3.0, 4.0]), (55, [1.0, 2.0])]
    docs = spark.createDataFrame([(*r, "x", "y", "z") for r in fine + bad], KIND)
    check(whitening.whiten(docs.repartition(6)), fine, 5)
    check(whitening.whiten(docs.repartition(40), components=2), fine, 5, 2)


def test_without_variance(spark):
    same = spark.createDataFrame([(i, [0.25, 0.5], "", "", "") for i in range(4)], KIND)
    rows = whitening.whiten(same).collect()
    assert len(rows) == 8 and all((r.n, r.deviation, r.whitened, r.explained, r.identity_error) == (4, 0, None, None, None) for r in rows)
    assert whitening.whiten(same.limit(0)).count() == 0
    line = spark.createDataFrame([(i, [float(i), 2.0 * i, 1.0], "", "", "") for i in range(9)], KIND)
    check(whitening.whiten(line), [(i, [float(i), 2.0 * i, 1.0]) for i in range(9)], 3)


def test_entries_of_any_size(spark):
    rows = [(i, [3e38 * (-1) ** i, float(i), 1e30]) for i in range(6)]
    found = whitening.whiten(spark.createDataFrame([(*r, "", "", "") for r in rows], KIND)).collect()
    assert len(found) == 18 and {r.deviation for r in found} == {None}
