"""Whitening against a plain eigendecomposition and exact integer sums."""

from fractions import Fraction

import numpy as np
import pytest

from cubeloom.llm import whitening
from cubeloom.llm.queries import QUERIES

ROWS = "vec_id bigint, embedding array<float>, label int, x string, v string, i string, n string"


def frame(spark, vectors):
    return spark.createDataFrame([(k, v, 0, "x", "x", "x", "x") for k, v in vectors], ROWS).repartition(3)


def whole(vector):
    return [int(np.floor(64 * float(np.float32(c)))) + 1_000_000 for c in vector]


def plain(vectors):
    x = np.array(sorted(set(map(tuple, (whole(v) for v in vectors)))))
    values, basis = np.linalg.eigh(np.cov(x.T, bias=True).reshape(x.shape[1], -1))
    return x, values[::-1], basis[:, ::-1]


def run(spark, vectors, most=16):
    numbers = whitening.whole_numbers(frame(spark, vectors))
    return whitening.whiten(numbers, whitening.fit(numbers, most)).collect()


def held(rows, vectors, most=16):
    usable = [(k, v) for k, v in vectors if v and all(c is not None and np.isfinite(np.float32(c)) for c in v)]
    x, values, basis = plain([v for _, v in usable])
    n, sums = len(x), [sum(map(int, c)) for c in x.T]
    k = min(most, int((values > 1e-9 * values[0]).sum()))
    assert len(rows) == k * len(usable)
    by_id = {}
    for r in rows:
        by_id.setdefault((r["vec_id"], r["component"]), []).append(r)
    signs = {}
    for key, v in usable:
        one = whole(v)
        away = sum((n * c - s) ** 2 for c, s in zip(one, sums, strict=True))
        for c in range(1, k + 1):
            r = by_id[key, c][0]
            assert r["n"] == n and r["deviation"] == away and 0 <= r["identity_error"] <= 1e-4
            assert abs(r["explained"] / (values[c - 1] / values.sum()) - 1) < 1e-9
            centred = [float(Fraction(a) - Fraction(s, n)) for a, s in zip(one, sums, strict=True)]
            want = float(np.dot(centred, basis[:, c - 1]) / np.sqrt(values[c - 1]))
            if abs(want) > 1e-6:
                sign = signs.setdefault(c, np.sign(want * r["whitened"]))
                assert abs(r["whitened"] * sign - want) < 1e-7
    return by_id


def test_query(spark):
    vectors = [(r["vec_id"], list(r["embedding"])) for r in spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").collect()]
    held(QUERIES["op13_spectrum_slicing"](spark, "/root/testdata/sf0.01").collect(), vectors)


def test_copies_count_once_and_bad_vectors_go(spark):
    rng = np.random.default_rng(3)
    some = rng.normal(0, [5, 3, 2, 1, 0.5], (40, 5)).tolist()
    vectors = list(enumerate(some + [some[0]] * 30))
    bad = [(900, None), (901, [1.0, None, 2.0, 3.0, 4.0]), (902, [float("nan")] * 5), (903, [float("inf"), 0.0, 0.0, 0.0, 0.0]), (904, [])]
    rows = run(spark, vectors + bad + [(905, [1e30] * 5), (906, [1.0, 2.0])])
    by_id = held(rows, vectors)
    assert {k[0] for k in by_id} == set(range(70))
    assert run(spark, [*vectors, (None, some[1]), (3, some[3])])[0]["n"] == 40


def test_no_spectrum(spark):
    assert run(spark, []) == [] and run(spark, [(1, None)]) == []
    assert run(spark, [(1, [2.0, 3.0])] * 3) == []
    flat = [(k, [float(k), 2.0 * k, 7.0]) for k in range(9)]
    assert {r["component"] for r in run(spark, flat)} == {1}


def test_large_entries_stay_exact(spark):
    vectors = [(k, [float(k * 2**36), float((k * 7 % 5) * 2**20)]) for k in range(6)]
    rows = run(spark, vectors)
    x = [whole(v) for _, v in vectors]
    sums = [sum(c) for c in zip(*x, strict=True)]
    for r in rows:
        away = sum((6 * c - s) ** 2 for c, s in zip(x[r["vec_id"]], sums, strict=True))
        assert r["deviation"] == (away if away < 2**63 else None)


SPECTRA = {
    "spread": np.logspace(3, -3, 40), "equal": np.full(40, 7.0), "threes": np.repeat(np.arange(14, 0, -1.0), 3)[:40],
    "close": 60 + 1e-9 * np.arange(40), "rank": np.r_[np.arange(1, 6.0), np.zeros(35)], "steep": np.logspace(12, 0, 40),
}


@pytest.mark.parametrize("name", sorted(SPECTRA))
def test_leading_components_of_a_known_spectrum(name):
    rng = np.random.default_rng(5)
    basis = np.linalg.qr(rng.standard_normal((40, 40)))[0]
    matrix = (basis * SPECTRA[name]) @ basis.T
    matrix = (matrix + matrix.T) / 2
    values, vectors = whitening.leading(matrix, 16)
    want = np.sort(np.linalg.eigvalsh(matrix))[::-1]
    assert len(values) == (5 if name == "rank" else 16)
    assert np.abs(values - want[: len(values)]).max() < 1e-12 * want[0]
    assert np.abs(vectors.T @ vectors - np.eye(len(values))).max() < 1e-12
    assert np.abs(matrix @ vectors - vectors * values).max() < 1e-12 * want[0]


@pytest.mark.parametrize("size", [1, 2, 3, 17])
def test_counts_of_negative_pivots(size):
    rng = np.random.default_rng(size)
    for _ in range(30):
        matrix = rng.integers(-2, 3, (size, size)).astype(float)
        matrix = matrix + matrix.T
        values = np.linalg.eigvalsh(matrix)
        for shift in (-3.3, -0.7, 0.1, 1.9, 4.1):
            if np.abs(values - shift).min() > 1e-9:
                assert whitening.below(matrix, shift) == (values < shift).sum()
