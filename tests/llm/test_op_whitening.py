"""Operator 11 against a full eigendecomposition and plain integers."""

import math
import random

import numpy as np
import pytest
from cellweave.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, label int, v string, component int, n long"


def plain(vectors):
    """Remaining (id, integers), the number of rows, sums, eigenvalues and eigenvectors by brute force."""
    rows = [(i, [math.floor(1024 * c) + 100000 for c in v]) for i, v in vectors if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    width = max((len(x) for _, x in rows), default=0)
    rows = [(i, x + [100000] * (width - len(x))) for i, x in rows]
    n, sums = len(rows), [sum(col) for col in zip(*(x for _, x in rows), strict=True)]
    z = np.array([[n * a - s for a, s in zip(x, sums, strict=True)] for _, x in rows], float) / n
    e, axes = np.linalg.eigh(z.T @ z / n)
    return rows, n, sums, z, e[::-1], axes[:, ::-1]


def agree(got, vectors, most=8):
    rows, n, sums, z, e, axes = plain(vectors)
    k = min(most, int((e > 1e-9 * e[0]).sum()))
    assert len(got) == k * len(rows)
    by = {}
    for r in got:
        by.setdefault(r["component"], []).append(r)
    assert sorted(by) == list(range(1, k + 1))
    for c, own in by.items():
        want = sorted((str(i), sum((n * a - s) ** 2 for a, s in zip(x, sums, strict=True)), w) for (i, x), w in zip(rows, z @ axes[:, c - 1] / e[c - 1] ** 0.5, strict=True))
        have = sorted((str(r["vec_id"]), r["deviation"], r["whitened"]) for r in own)
        assert [h[:2] for h in have] == [w[:2] for w in want]
        a, b = np.array([h[2] for h in have]), np.array([w[2] for w in want])
        assert min(abs(a - b).max(), abs(np.sort(a + b)).max()) < 1e-7
        assert all(r["n"] == n and r["explained"] == pytest.approx(e[c - 1] / e.sum(), rel=1e-9) and r["identity_error"] < 1e-9 for r in own)


def vectors(count, width, seed=1):
    rng = random.Random(seed)
    scale = [3 / (1 + i) for i in range(width)]
    return [(i, [float(np.float32(rng.gauss(0.2, s))) for s in scale]) for i in range(count)]


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 0, "x", 5, 6) for i, v in rows], SCHEMA).repartition(3)


@pytest.mark.parametrize("width,blocks", [(12, whitening.BASIS_BLOCKS), (40, 3), (3, 24), (1, 24)])
def test_whitening(spark, width, blocks, monkeypatch):
    monkeypatch.setattr(whitening, "BASIS_BLOCKS", blocks)
    rows = vectors(120, width)
    agree(whitening.whiten(frame(spark, rows)).collect(), rows)


def test_awkward_rows(spark):
    rows = vectors(60, 10, 2)
    rows += [(100, None), (101, [None] * 10), (102, [1.0] * 9 + [math.nan]), (103, [math.inf] + [0.0] * 9), (104, [1.0] * 4), (105, []), (None, rows[0][1]), (3, rows[3][1]), (3, rows[3][1]), (106, [-0.0005] * 10)]
    # distinct pairs of (id, row) only: equal ids with equal vectors agree in all columns
    agree(whitening.whiten(frame(spark, rows)).collect(), rows)
    assert whitening.whiten(frame(spark, [])).count() == 0
    assert whitening.whiten(frame(spark, [(1, None), (2, [None])])).count() == 0
    assert whitening.whiten(frame(spark, [(1, [1.0, 2.0])] * 3)).count() == 0
    assert whitening.whiten(frame(spark, [(1, [])])).count() == 0
    line = [(i, [float(i), 2.0 * i, 0.0]) for i in range(5)]
    agree(whitening.whiten(frame(spark, line)).collect(), line)
    far = whitening.whiten(frame(spark, [(1, [3e38, 0.0]), (2, [-3e38, 1.0]), (3, [0.0, 0.5])])).collect()
    assert all(r["deviation"] is None and math.isfinite(r["whitened"]) for r in far if r["vec_id"] < 3) and len(far) == 3


@pytest.mark.parametrize("spread", ["equal", "pairs", "rank"])
def test_lanczos_with_breakdowns(spread):
    """Equal eigenvalues, pairs of them, and a low rank: blocks break down and start anew."""
    rng = np.random.default_rng(4)
    turn = np.linalg.qr(rng.normal(size=(60, 60)))[0]
    e = {"equal": np.ones(60), "pairs": np.repeat(np.arange(30, 0, -1.0), 2), "rank": np.r_[np.full(3, 5.0), np.zeros(57)]}[spread]
    a = turn * e @ turn.T
    calls = []
    values, axes = whitening.leading_eigenpairs(lambda v: calls.append(v.shape[1]) or a @ v, 60, 8)
    assert np.allclose(values, e[:8], atol=1e-11) and np.allclose(axes.T @ axes, np.eye(8), atol=1e-12)
    assert np.linalg.norm(a @ axes - axes * values) < 1e-10

