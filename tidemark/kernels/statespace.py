"""Linear-Gaussian state space: filter, smoother and the dynamic factor model.

Observation noise is diagonal, so the update works in the state's dimension:
with W = C' R^-1 over the observed rows, the gain is (I + P W C)^-1 P W.  Missing
observations (NaN) drop out of W; a row without any only predicts.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import permutations

import numpy as np


@dataclass
class Filtered:
    mean: np.ndarray
    cov: np.ndarray
    prior_mean: np.ndarray
    prior_cov: np.ndarray
    loglik: float


def kalman_filter(y, A, C, Q, R, x0=None, p0: float = 10.0) -> Filtered:
    """``y`` is T x N with NaN for missing, R the diagonal of the noise covariance."""
    T, n = len(y), len(A)
    x = np.zeros(n) if x0 is None else np.asarray(x0, float)
    P = p0 * np.eye(n)
    out = [np.zeros((T, n)), np.zeros((T, n, n)), np.zeros((T, n)), np.zeros((T, n, n))]
    loglik, eye = 0.0, np.eye(n)
    for t in range(T):
        x, P = A @ x, A @ P @ A.T + Q
        P = (P + P.T) / 2
        out[2][t], out[3][t] = x, P
        seen = ~np.isnan(y[t])
        if seen.any():
            c, r = C[seen], R[seen]
            v = y[t, seen] - c @ x
            W = c.T / r
            M = eye + P @ W @ c
            sign, logdet = np.linalg.slogdet(M)
            K = np.linalg.solve(M, P)
            g = W @ v
            if sign > 0:
                quad = v @ (v / r) - g @ K @ g
                loglik -= 0.5 * (len(v) * np.log(2 * np.pi) + np.log(r).sum() + logdet + quad)
            x, P = x + K @ g, K
            P = (P + P.T) / 2
        out[0][t], out[1][t] = x, P
    return Filtered(*out, loglik)


def rts_smoother(f: Filtered, A) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Smoothed means, covariances and lag-one cross-covariances (T - 1 of them)."""
    T, n = f.mean.shape
    m, P = f.mean.copy(), f.cov.copy()
    cross = np.zeros((max(T - 1, 0), n, n))
    for t in range(T - 2, -1, -1):
        J = np.linalg.solve(f.prior_cov[t + 1] + 1e-12 * np.eye(n), A @ f.cov[t]).T
        m[t] += J @ (m[t + 1] - f.prior_mean[t + 1])
        P[t] += J @ (P[t + 1] - f.prior_cov[t + 1]) @ J.T
        cross[t] = P[t + 1] @ J.T
    return m, P, cross


def pca_init(y, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Scores and loadings of the first k components of a mean-filled panel."""
    filled = np.where(np.isnan(y), np.nan_to_num(np.nanmean(y, axis=0)), y)
    _, s, vt = np.linalg.svd(filled - filled.mean(axis=0), full_matrices=False)
    return filled @ vt[:k].T, vt[:k].T


def varimax(L, iters: int = 500, tol: float = 1e-8) -> np.ndarray:
    """The rotation that maximises the variance of squared loadings; identity for one factor or bad input."""
    n, k = L.shape
    R, before = np.eye(k), 0.0
    if k < 2 or not np.isfinite(L).all():
        return R
    for _ in range(iters):
        B = L @ R
        u, s, vt = np.linalg.svd(L.T @ (B**3 - B * (B**2).mean(axis=0)))
        R = u @ vt
        if s.sum() - before < tol:
            break
        before = s.sum()
    return R


def signs(L) -> np.ndarray:
    """Per factor +1 or -1, so that loadings sum to a non-negative number; near zero the largest decides."""
    total = L.sum(axis=0)
    largest = L[np.abs(L).argmax(axis=0), np.arange(L.shape[1])]
    s = np.sign(np.where(np.abs(total) > 1e-8, total, largest))
    return np.where(s == 0, 1.0, s)


def name_factors(L, codes: list[str], anchors: dict[str, list[str]]) -> tuple[list[str], np.ndarray]:
    """Names for factors by their mean absolute loading on anchor sets, one name each, and the match quality.

    Quality is the anchors' mean over the factor's 90th percentile of absolute loadings.
    """
    k, size = L.shape[1], np.abs(L)
    names = list(anchors)
    score = np.zeros((k, len(names)))
    for j, name in enumerate(names):
        rows = [i for i, c in enumerate(codes) if c in set(anchors[name])]
        if rows:
            score[:, j] = size[rows].mean(axis=0)
    wide = np.concatenate([score, np.zeros((k, max(0, k - len(names))))], axis=1)
    best = max(permutations(range(wide.shape[1]), k), key=lambda p: sum(wide[i, j] for i, j in enumerate(p)))
    high = np.maximum(np.quantile(size, 0.9, axis=0), 1e-12)
    out = [names[j] if j < len(names) and wide[i, j] > 0 else f"factor_{i + 1}" for i, j in enumerate(best)]
    return out, np.array([wide[i, j] / high[i] for i, j in enumerate(best)])


@dataclass
class FactorModel:
    A: np.ndarray
    C: np.ndarray
    Q: np.ndarray
    R: np.ndarray
    mean: np.ndarray
    std: np.ndarray
    rotation: np.ndarray
    k: int
    loadings: np.ndarray
    scale_mean: np.ndarray
    scale_std: np.ndarray
    loglik: float
    iterations: int
    status: str

    def transform(self, y) -> np.ndarray:
        """Filtered factors of new rows under the stored parameters."""
        z = (np.asarray(y, float) - self.mean) / self.std
        f = kalman_filter(z, self.A, self.C, self.Q, self.R).mean[:, : self.k]
        return (f @ self.rotation - self.scale_mean) / self.scale_std


def fit_factors(y, k: int = 4, quarterly=(), max_iter: int = 200, tol: float = 1e-6, rotate: bool = True):
    """EM for a k-factor model; returns (model, filtered, smoothed) with factors in z-scale.

    Quarterly columns load equally on the factors of three months.  Loadings are
    summed over the rows in which a series is observed.  On divergence the last good
    parameters stay and ``status`` says so.
    """
    y = np.asarray(y, float)
    T, N = y.shape
    mean = np.nanmean(y, axis=0)
    filled = np.where(np.isnan(y), mean, y)
    std = filled.std(axis=0)
    std = np.where(std > 0, std, 1.0)
    z = (y - mean) / std
    k = max(1, min(k, N, T - 1))
    lags = 3 if len(quarterly) else 1
    n = k * lags
    _, load = pca_init(z, k)
    load = load * np.sqrt(N) / np.sqrt(max(k, 1))
    is_q = np.zeros(N, bool)
    is_q[list(quarterly)] = True
    base = load.copy()

    def full_c(c):
        out = np.zeros((N, n))
        out[:, :k] = c
        for lag in range(1, lags):
            out[is_q, lag * k : (lag + 1) * k] = c[is_q]
        return out

    def full_a(a):
        out = np.zeros((n, n))
        out[:k, :k] = a
        for lag in range(1, lags):
            out[lag * k : (lag + 1) * k, (lag - 1) * k : lag * k] = np.eye(k)
        return out

    def full_q(q):
        out = np.zeros((n, n))
        out[:k, :k] = q
        return out

    a, q, R = 0.8 * np.eye(k), 0.5 * np.eye(k), np.ones(N)
    good, before, status, it = (a, base, q, R), -np.inf, "max_iter", 0
    seen = ~np.isnan(z)
    zero = np.nan_to_num(z)
    for it in range(1, max_iter + 1):
        a, c, q, R = good
        A, C, Q = full_a(a), full_c(c), full_q(q)
        f = kalman_filter(z, A, C, Q, R)
        if not np.isfinite(f.loglik):
            status = "diverged"
            break
        m, P, cross = rts_smoother(f, A)
        if abs(f.loglik - before) < tol * max(1.0, abs(before)) and it > 1:
            status = "converged"
            break
        before = f.loglik
        # What each column loads on: the month's factors, or the sum of three.
        pick = [np.zeros((k, n)), np.zeros((k, n))]
        pick[0][:, :k] = np.eye(k)
        for lag in range(lags):
            pick[1][:, lag * k : (lag + 1) * k] = np.eye(k)
        c_new, r_new = c.copy(), R.copy()
        for kind in (0, 1):
            cols = np.flatnonzero(is_q == bool(kind))
            if not len(cols):
                continue
            g = m @ pick[kind].T
            G = np.einsum("ij,tjl,kl->tik", pick[kind], P, pick[kind]) + g[:, :, None] * g[:, None, :]
            S = np.einsum("tn,tij->nij", seen[:, cols].astype(float), G) + 1e-6 * np.eye(k)
            b = np.einsum("tn,ti->ni", zero[:, cols] * seen[:, cols], g)
            c_new[cols] = np.linalg.solve(S, b[:, :, None])[:, :, 0]
            resid = (zero[:, cols] ** 2 * seen[:, cols]).sum(axis=0) - (c_new[cols] * b).sum(axis=1)
            r_new[cols] = np.maximum(resid / np.maximum(seen[:, cols].sum(axis=0), 1), 0.01)
        x, Pk = m[:, :k], P[:, :k, :k]
        S00 = Pk[:-1].sum(axis=0) + x[:-1].T @ x[:-1]
        S11 = Pk[1:].sum(axis=0) + x[1:].T @ x[1:]
        S10 = cross[:, :k, :k].sum(axis=0) + x[1:].T @ x[:-1]
        a_new = np.linalg.solve(S00.T + 1e-9 * np.eye(k), S10.T).T
        q_new = (S11 - a_new @ S10.T) / max(T - 1, 1)
        q_new = (q_new + q_new.T) / 2 + 1e-9 * np.eye(k)
        # Identification: loadings with orthonormal columns, the state absorbs the rest.
        u, s, vt = np.linalg.svd(c_new, full_matrices=False)
        s = np.maximum(s, 1e-8)
        H = s[:, None] * vt
        Hi = np.linalg.inv(H)
        trial = (H @ a_new @ Hi, u, H @ q_new @ H.T, r_new)
        if not all(np.isfinite(p).all() and np.abs(p).max() <= 1e6 for p in trial):
            status = "diverged"
            break
        good = trial
    a, c, q, R = good
    A, C, Q = full_a(a), full_c(c), full_q(q)
    f = kalman_filter(z, A, C, Q, R)
    m, _, _ = rts_smoother(f, A)
    rotation = varimax(c) if rotate else np.eye(k)
    rotation = rotation * signs(c @ rotation)
    filtered, smoothed = f.mean[:, :k] @ rotation, m[:, :k] @ rotation
    mu, sd = smoothed.mean(axis=0), smoothed.std(axis=0)
    if not (sd > 0).any() or not np.isfinite(smoothed).all():
        status = "degenerate"
    sd = np.where(sd > 0, sd, 1.0)
    model = FactorModel(A, C, Q, R, mean, std, rotation, k, c @ rotation, mu, sd, f.loglik, it, status)
    return model, (filtered - mu) / sd, (smoothed - mu) / sd


def factor_strength(smoothed_raw, loadings) -> np.ndarray:
    """Each factor's share of explained variance: var(f) times squared norm of its loadings."""
    v = smoothed_raw.var(axis=0) * (loadings**2).sum(axis=0)
    return v / max(v.sum(), 1e-12)
