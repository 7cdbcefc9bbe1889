import math
from collections import Counter

import numpy as np
import pytest
from llm_cases import with_clashes

from evalspark.llm import whitening

KIND = "vec_id long, embedding array<double>, label int"


def brute(rows, components=4):
    """Rows by numpy's dense eigensolver; the sign of a component makes its largest entry positive."""
    ok = [(i, e) for i, e, _ in rows if e and all(c is not None and math.isfinite(c) for c in e)]
    out = []
    for dim in {len(e) for _, e in ok}:
        xs = [(i, [math.floor(256 * c) for c in e]) for i, e in ok if len(e) == dim]
        fit = sorted({tuple(x) for _, x in xs})
        n, sums = len(fit), [sum(c) for c in zip(*fit)]
        z = np.array(fit, float) - np.array([s / n for s in sums])
        v = z.T @ z / n
        e, u = np.linalg.eigh(v)
        e, u = e[::-1][:components], u[:, ::-1][:, :components]
        for c in range(len(e)):
            if e[c] <= 1e-12 * max(e[0], 1e-300):
                continue
            axis = u[:, c] * np.sign(u[np.abs(u[:, c]).argmax(), c])
            for i, x in xs:
                dev = sum((n * a - s) ** 2 for a, s in zip(x, sums))
                out.append((i, c + 1, n, dev, (np.array(x) - np.array([s / n for s in sums])) @ axis / math.sqrt(e[c]), e[c] / np.trace(v)))
    return out


def compare(got, want):
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[2], r[3] if r[3] is not None else -1, r[4])
    got, want = sorted((tuple(r)[:6] for r in got), key=key), sorted(want, key=key)
    assert [r[:4] for r in got] == [r[:4] for r in want]
    assert np.allclose([r[4] for r in got], [r[4] for r in want], rtol=1e-9, atol=1e-9)
    assert np.allclose([r[5] for r in got], [r[5] for r in want], rtol=1e-10)


def cases():
    rng = np.random.default_rng(5)
    turn = np.linalg.qr(rng.normal(size=(12, 12)))[0]
    x = rng.normal(size=(300, 12)) * (3 * 0.7 ** np.arange(12)) @ turn + rng.normal(size=12)
    rows = [(i, [float(c) for c in v], i % 3) for i, v in enumerate(x)]
    rows += [(1000 + i, rows[7][1], 0) for i in range(200)]        # copies count once
    rows += [rows[7], (None, rows[8][1], 1)]
    return rows + [(2000, None, 0), (2001, [], 0), (2002, [None, *rows[0][1][1:]], 0), (2003, [float("nan"), *rows[0][1][1:]], 0),
                   (2004, [float("-inf"), *rows[0][1][1:]], 0), (2005, [1.0, 2.0], 0), (2006, [1.5, 2.0], 0), (2007, [1.0, -3.0], 0)]


def test_whitened_rows_against_the_dense_solver(spark):
    rows = cases()
    got = whitening.whiten(with_clashes(spark.createDataFrame(rows, KIND)).repartition(3)).collect()
    compare(got, brute(rows))
    assert max(r.identity_error for r in got) < 1e-9
    assert Counter(r.n for r in got) == Counter({300: 4 * 502, 3: 2 * 3})


def test_ranks_below_the_wanted_components(spark):
    line = [(i, [float(i), 2.0 * i, 0.0, 1.0, -1.0], 0) for i in range(9)]
    got = whitening.whiten(spark.createDataFrame(line, KIND)).collect()
    compare(got, brute(line))
    assert {r.component for r in got} == {1}
    for rows in ([], [(1, [1.0, 2.0], 0), (2, [1.0, 2.0], 1)], [(1, None, 0)]):
        assert whitening.whiten(spark.createDataFrame(rows, KIND)).count() == 0


def test_deviation_is_exact_up_to_64_bits():
    n = 10**6
    x = np.array([[3000, -1], [3037, 5], [3036, 1010], [2**62, -2**62], [-2**63, 0]], np.int64)
    sums = [7, -3]
    want = [sum((n * int(a) - s) ** 2 for a, s in zip(r, sums)) for r in x]
    got = whitening._deviation(x, n, sums, np.array([s / n for s in sums])).to_pylist()
    assert got == [w if w < 2**63 else None for w in want] and got[0] is not None and got[3] is None


def test_sums_pass_64_bits(spark):
    rows = spark.createDataFrame([(i, [2**62 + i, -2**62 - i]) for i in range(7)], "vec_id long, x array<long>")
    n, sums = whitening.exact_sums(whitening._blocks(rows, 2), 2)
    assert (n, sums) == (7, [7 * 2**62 + 21, -7 * 2**62 - 21])


@pytest.mark.parametrize("dim,decay", [(1, 1.0), (2, 0.5), (5, 0.9), (40, 1.0), (40, 0.8), (200, 0.97)])
def test_solver_reaches_double_precision(dim, decay):
    rng = np.random.default_rng(dim)
    z = rng.normal(size=(400, dim)) * decay ** np.arange(dim) * 100
    v = z.T @ z / 400
    e, u, r = whitening.eigenpairs(lambda t: v @ t, dim, 4)
    want = np.linalg.eigvalsh(v)[::-1][:4]
    assert np.allclose(e, want, rtol=1e-12) and r.max() <= max(64, dim) * whitening.EPS * e[0]
    assert np.allclose(u.T @ u, np.eye(len(e)), atol=1e-13)
    assert np.linalg.norm(v @ u - u * e, axis=0).max() <= 2 * max(64, dim) * whitening.EPS * e[0]


def test_equal_eigenvalues():
    e, u, _ = whitening.eigenpairs(lambda t: np.diag([5.0, 5, 5, 2, 2, 1, 0]) @ t, 7, 4)
    assert np.allclose(e, [5, 5, 5, 2]) and np.allclose(u.T @ u, np.eye(4))


def test_minres_solves_indefinite_systems_side_by_side():
    rng = np.random.default_rng(2)
    q = np.linalg.qr(rng.normal(size=(30, 30)))[0]
    a = q @ np.diag(np.r_[np.linspace(1, 3, 20), -np.linspace(1, 2, 10)]) @ q.T
    b = rng.normal(size=(30, 3))
    x = whitening.minres(lambda v: a @ v, b, np.full(3, 1e-12), steps=60)
    assert np.allclose(a @ x, b, atol=1e-9)
