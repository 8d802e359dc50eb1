"""Kernels on simulations with known answers."""

import numpy as np
import pytest

from tidemark.kernels import bootstrap, regimes, regression, statespace


def simulate(T=240, n=10, k=2, seed=42, noise=0.5):
    rng = np.random.default_rng(seed)
    f = np.zeros((T, k))
    for t in range(1, T):
        f[t] = 0.8 * f[t - 1] + rng.normal(0, 0.6, k)
    L = rng.normal(0, 1, (n, k))
    return f, f @ L.T + rng.normal(0, noise, (T, n))


def canonical(a, b):
    qa, _ = np.linalg.qr(a - a.mean(axis=0))
    qb, _ = np.linalg.qr(b - b.mean(axis=0))
    return np.linalg.svd(qa.T @ qb, compute_uv=False)


def dense_filter(y, A, C, Q, R, p0=10.0):
    """The textbook update in the observations' dimension."""
    x, P, ll, out = np.zeros(len(A)), p0 * np.eye(len(A)), 0.0, []
    for row in y:
        x, P = A @ x, A @ P @ A.T + Q
        s = ~np.isnan(row)
        if s.any():
            c = C[s]
            S = c @ P @ c.T + np.diag(R[s])
            v = row[s] - c @ x
            G = P @ c.T @ np.linalg.inv(S)
            ll -= 0.5 * (s.sum() * np.log(2 * np.pi) + np.linalg.slogdet(S)[1] + v @ np.linalg.solve(S, v))
            x, P = x + G @ v, (np.eye(len(A)) - G @ c) @ P
        out.append(x)
    return np.array(out), ll


def test_filter_equals_textbook_with_missing_rows():
    rng = np.random.default_rng(1)
    _, y = simulate(80)
    y[rng.random(y.shape) < 0.15] = np.nan
    y[7] = np.nan
    A, C = np.array([[0.7, 0.1], [0.0, 0.6]]), rng.normal(0, 1, (10, 2))
    Q, R = 0.4 * np.eye(2), rng.uniform(0.2, 1, 10)
    f = statespace.kalman_filter(y, A, C, Q, R)
    mean, ll = dense_filter(y, A, C, Q, R)
    assert np.allclose(f.mean, mean, atol=1e-9) and f.loglik == pytest.approx(ll)


def test_smoother_ends_at_the_filter_and_has_less_variance():
    _, y = simulate(60)
    one = np.eye(1)
    f = statespace.kalman_filter(y[:, :1], one, one, one, np.array([4.0]))
    m, P, cross = statespace.rts_smoother(f, one)
    assert np.allclose(m[-1], f.mean[-1]) and (P <= f.cov + 1e-9).all() and len(cross) == 59


@pytest.mark.parametrize("missing", [0.0, 0.15])
def test_factors_are_recovered(missing):
    f, y = simulate()
    y[np.random.default_rng(3).random(y.shape) < missing] = np.nan
    model, filtered, smoothed = statespace.fit_factors(y, 2, max_iter=50)
    assert model.status in ("converged", "max_iter")
    assert canonical(f, smoothed).min() > 0.9
    assert np.allclose(smoothed.mean(axis=0), 0, atol=1e-8) and np.allclose(smoothed.std(axis=0), 1)
    assert np.isfinite(model.transform(y)).all() and filtered.shape == (240, 2)


def test_quarterly_series_and_outlier():
    f, y = simulate()
    y[np.arange(240) % 3 != 2, 0] = np.nan
    y[100, 3] += 25
    _, _, s = statespace.fit_factors(y, 2, quarterly=(0,), max_iter=30)
    assert canonical(f, s).min() > 0.85


def test_varimax_is_a_rotation_and_signs_are_fixed():
    L = np.random.default_rng(0).normal(0, 1, (12, 3))
    R = statespace.varimax(L)
    assert np.allclose(R.T @ R, np.eye(3), atol=1e-8)
    assert (((L @ R) ** 2).var(axis=0).sum()) >= ((L**2).var(axis=0).sum()) - 1e-9
    assert ((L @ R * statespace.signs(L @ R)).sum(axis=0) >= 0).all()
    assert np.allclose(statespace.varimax(L[:, :1]), 1)


def test_names_follow_anchors():
    L = np.array([[0.9, 0.1], [0.8, 0.0], [0.1, 0.7], [0.0, 0.9]])
    names, quality = statespace.name_factors(L, list("abcd"), {"second": ["c", "d"], "first": ["a", "b"]})
    assert names == ["first", "second"] and (quality > 0.8).all()


def test_regimes_are_recovered_in_order():
    rng = np.random.default_rng(45)
    state = np.repeat([1, 0, 1, 0], [30, 20, 30, 20])
    x = np.where(state == 1, 1.5, -0.5) + rng.normal(0, 0.3, 100)
    m = regimes.fit_regimes(x, 2)
    f, s = m.filter(x)
    assert m.means[0] < m.means[1] and (s.argmax(axis=1) == state).mean() > 0.97
    assert np.allclose(f[-1], s[-1]) and np.allclose(m.P.sum(axis=1), 1)
    two = regimes.fit_regimes(np.column_stack([x, x + rng.normal(0, 0.2, 100)]), 2)
    assert (two.filter(np.column_stack([x, x]))[1].argmax(axis=1) == state).mean() > 0.95


def test_probit_recovers_coefficients_and_handles_missing():
    rng = np.random.default_rng(5)
    X = rng.normal(0, 1, (3000, 2))
    y = (X @ [1.0, -0.5] + 0.3 + rng.normal(0, 1, 3000) > 0).astype(float)
    m = regression.probit_fit(X, y, lam=0.01, balanced=False)
    assert np.allclose(m.beta, [1.0, -0.5, 0.3], atol=0.1)
    p = m.predict(np.array([[np.nan, np.nan], [5.0, -5.0], [np.nan, 0.0]]))
    assert p[0] == 0.5 and p[1] == pytest.approx(0.999) and 0 < p[2] < 1
    assert regression.probit_fit(X[:10], y[:10]).status == "too_few_rows"


@pytest.mark.parametrize(("lam", "balanced"), [(0.01, True), (1.0, True), (5.0, False)])
def test_probit_ends_where_the_gradient_is_zero(lam, balanced):
    """The penalised likelihood written out, and its slope by central differences."""
    from math import erf

    rng = np.random.default_rng(8)
    X = rng.normal(0, 1, (200, 3))
    y = (X @ [0.8, 0.0, -0.4] + rng.normal(0, 1, 200) > 0.9).astype(float)
    m = regression.probit_fit(X, y, lam=lam, balanced=balanced)
    w = np.where(y == 1, 200 / (2 * y.sum()), 200 / (2 * (200 - y.sum()))) if balanced else np.ones(200)

    def loss(b):
        p = np.array([0.5 * (1 + erf(v / 2**0.5)) for v in X @ b[:3] + b[3]])
        return -(w * np.log(np.where(y == 1, p, 1 - p))).sum() + 0.5 * lam * (b**2).sum()

    for i in range(4):
        step = np.eye(4)[i] * 1e-5
        assert abs(loss(m.beta + step) - loss(m.beta - step)) / 2e-5 < 1e-3


def test_calibration_ridge_and_trees():
    rng = np.random.default_rng(6)
    p = rng.random(500)
    y = (rng.random(500) < p**2).astype(float)
    iso = regression.calibrate(p, y)(np.linspace(0, 1, 50))
    assert (np.diff(iso) >= -1e-12).all()
    assert np.allclose(regression.calibrate(p[:5], y[:5])(p[:5]), p[:5])
    X = rng.normal(0, 1, (200, 3))
    t = X @ [1.0, 0.0, -2.0] + rng.normal(0, 0.1, 200)
    assert np.corrcoef(regression.ridge(X, t, 0.1)(X), t)[0, 1] > 0.99
    assert np.corrcoef(regression.boost(X, t)(X), t)[0, 1] > 0.95


def test_auc_bootstrap_and_ic():
    y, p = np.array([0, 0, 1, 1.0]), np.array([0.1, 0.4, 0.4, 0.8])
    assert bootstrap.auc(y, p) == 0.875 and np.isnan(bootstrap.auc(y * 0, p))
    assert [len(b) for b in bootstrap.runs(np.array([0, 0, 1, 0, 0]))] == [2, 1, 2]
    blocks = bootstrap.runs(y)
    assert (bootstrap.resample(blocks, 0, 3) == bootstrap.resample(blocks, 0, 3)).all()
