"""Whitened components against numpy over the whole matrix, and exact deviations."""

import math
import random

import numpy as np
import pytest

from contactdq.llm import whitening as W

SCHEMA = "vec_id long, embedding array<float>, label int, component int, x double"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, 7, 0.5) for i, v in rows], SCHEMA)


def plain(rows, components=8):
    valid = [(i, [math.floor(1024 * float(np.float32(c))) + 100_000 for c in v]) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    x = np.array([v for _, v in valid], np.int64)
    n, sums = len(x), [int(s) for s in x.sum(axis=0)]
    y = x - np.array([s / n for s in sums])
    v = y.T @ y / n
    values, vectors = np.linalg.eigh(v)
    order = np.argsort(-values)[:components]
    w = y @ vectors[:, order] / np.sqrt(values[order])
    deviations = [sum((n * c - s) ** 2 for c, s in zip(row.tolist(), sums)) for row in x]
    return [i for i, _ in valid], n, deviations, w, values[order] / np.trace(v)


@pytest.mark.parametrize("d,tile", [(5, 2), (12, 16), (33, 8)])
def test_components_like_numpy(spark, d, tile, monkeypatch):
    rnd = random.Random(d)
    base = [[rnd.gauss(0, 1) * (1 + k % 4) + k for k in range(d)] for _ in range(300)]
    rows = [(i, v) for i, v in enumerate(base)] + [(300, None), (301, []), (302, [None] + base[0][1:]), (303, [float("nan")] + base[0][1:]), (304, [float("-inf")] + base[0][1:])]
    rows += [(5, base[5])] * 150 + [(None, base[6])]  # a hot vector of a repeated id, a row without an id
    monkeypatch.setattr(W, "BLOCK_BYTES", 40 * 8 * d)
    monkeypatch.setattr(W, "HELD_BYTES", 3000)
    got = W.whitened(frame(spark, rows), 8, tile).collect()
    ids, n, deviations, w, explained = plain(rows)
    k = min(8, d)
    assert len(got) == n * k and {r["n"] for r in got} == {n}
    assert len({r["identity_error"] for r in got}) == 1 and got[0]["identity_error"] < 1e-9
    by = {}
    for r in got:
        by.setdefault((r["vec_id"], r["component"]), []).append(r)
    for c in range(k):
        sign = np.sign(by[1, c + 1][0]["whitened"] * w[ids.index(1), c])
        for i, dev, value in zip(ids, deviations, w[:, c]):
            for r in by[i, c + 1]:
                assert r["deviation"] == dev
                assert r["whitened"] * sign == pytest.approx(value, abs=1e-8)
                assert r["explained"] == pytest.approx(explained[c], rel=1e-9)


def test_no_variance_and_no_rows(spark):
    assert frame(spark, []).count() == 0 == W.whitened(frame(spark, [])).count()
    assert W.whitened(frame(spark, [(1, [0.5, 1.0])])).count() == 0
    assert W.whitened(frame(spark, [(1, [0.5, 1.0]), (2, [0.5, 1.0])])).count() == 0
    # Two rows that differ have one component with variance.
    got = W.whitened(frame(spark, [(1, [0.5, 1.0]), (2, [0.5, 3.0])])).collect()
    assert sorted((r["vec_id"], r["component"], r["deviation"], abs(round(r["whitened"], 9))) for r in got) == [(1, 1, 2048**2, 1.0), (2, 1, 2048**2, 1.0)]


def test_lengths_that_differ_and_large_entries(spark):
    rows = [(i, [float(i), float(i * i)]) for i in range(9)] + [(20 + i, [1.0]) for i in range(8)] + [(40, [1e30, 0.0])]
    got = W.whitened(frame(spark, rows), 8).collect()
    assert {r["vec_id"] for r in got} == set(range(9)) and got[0]["n"] == 9
    # n * x - sum of a million: its square is beyond a long
    wide = W.whitened(frame(spark, [(0, [4.0e12]), (1, [-4.0e12]), (2, [1.0])]), 8).collect()
    exact = {r["vec_id"]: r["deviation"] for r in wide}
    assert exact[0] is None and exact[2] is not None and wide[0]["identity_error"] < 1e-9


def test_exact_deviations_beyond_machine_integers():
    of = W.Totals(3_000_000_000, (5, 7), (-9, -9), (9, 9))
    x = np.array([[0, 0], [1, 0], [2, 9]])
    want = [sum((of.n * v - s) ** 2 for v, s in zip(row.tolist(), of.sums)) for row in x]
    assert of.deviations(x) == [v if v < 1 << 63 else None for v in want]
