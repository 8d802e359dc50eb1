"""Markov-switching models: Hamilton filter, Kim smoother and EM, vectorised over regimes."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

FLOOR = 1e-300


def log_density(x, means, covs) -> np.ndarray:
    """T x R log densities of T x D rows, clipped to +-500; singular covariances use a pseudo-inverse."""
    out = np.empty((len(x), len(means)))
    d = x.shape[1]
    for r, (m, S) in enumerate(zip(means, covs, strict=True)):
        v = x - m
        try:
            L = np.linalg.cholesky(S)
            u = np.linalg.solve(L, v.T)
            quad, logdet = (u * u).sum(axis=0), 2 * np.log(np.diag(L)).sum()
        except np.linalg.LinAlgError:
            inv = np.linalg.pinv(S)
            quad = np.einsum("ti,ij,tj->t", v, inv, v)
            logdet = np.log(np.maximum(np.linalg.eigvalsh(S), 1e-12)).sum()
        out[:, r] = -0.5 * (d * np.log(2 * np.pi) + logdet + quad)
    return np.clip(out, -500, 500)


def hamilton_filter(logeta, P, start=None) -> tuple[np.ndarray, np.ndarray, float]:
    """Filtered and one-step predicted probabilities, and the log likelihood; starts uniform."""
    T, R = logeta.shape
    high = logeta.max(axis=1, keepdims=True)
    eta = np.exp(logeta - high)
    filtered, predicted = np.empty((T, R)), np.empty((T, R))
    p = np.full(R, 1 / R) if start is None else np.asarray(start, float)
    ll = 0.0
    for t in range(T):
        p = p if t == 0 else filtered[t - 1] @ P
        predicted[t] = p
        joint = p * eta[t]
        total = max(joint.sum(), FLOOR)
        filtered[t] = joint / total
        ll += np.log(total) + high[t, 0]
    return filtered, predicted, float(ll)


def kim_smoother(filtered, predicted, P) -> np.ndarray:
    out = filtered.copy()
    for t in range(len(filtered) - 2, -1, -1):
        out[t] = filtered[t] * (P @ (out[t + 1] / np.maximum(predicted[t + 1], FLOOR)))
        out[t] /= max(out[t].sum(), FLOOR)
    return out


def lloyd(x, k: int, seed: int, iters: int = 100) -> np.ndarray:
    """Cluster labels by Lloyd's steps from spread-out starts; deterministic for a seed."""
    rng = np.random.default_rng(seed)
    centres = [x[rng.integers(len(x))]]
    while len(centres) < k:
        d = np.min([((x - c) ** 2).sum(axis=1) for c in centres], axis=0)
        centres.append(x[rng.choice(len(x), p=d / d.sum())] if d.sum() > 0 else x[rng.integers(len(x))])
    c = np.array(centres)
    label = np.zeros(len(x), int)
    for _ in range(iters):
        label = ((x[:, None] - c) ** 2).sum(axis=2).argmin(axis=1)
        new = np.array([x[label == r].mean(axis=0) if (label == r).any() else c[r] for r in range(k)])
        if np.allclose(new, c):
            break
        c = new
    return label


@dataclass
class RegimeModel:
    means: np.ndarray
    covs: np.ndarray
    P: np.ndarray
    loglik: float
    iterations: int
    collapsed: bool

    def filter(self, x) -> tuple[np.ndarray, np.ndarray]:
        x = np.atleast_2d(np.asarray(x, float).T).T
        f, pred, _ = hamilton_filter(log_density(x, self.means, self.covs), self.P)
        return f, kim_smoother(f, pred, self.P)


def fit_regimes(x, k: int = 2, max_iter: int = 200, tol: float = 1e-6, restarts: int = 3, seed: int = 42) -> RegimeModel:
    """EM from several starts, the best likelihood wins; regimes in ascending order of their mean."""
    x = np.asarray(x, float)
    x = x[:, None] if x.ndim == 1 else x
    T, D = x.shape
    best = None
    for r in range(restarts):
        label = lloyd(x, k, seed + 17 * r)
        means = np.array([x[label == j].mean(axis=0) if (label == j).any() else x.mean(axis=0) for j in range(k)])
        covs = np.array([np.cov(x.T).reshape(D, D) + 1e-4 * np.eye(D)] * k)
        P = np.full((k, k), 0.05 / max(k - 1, 1))
        np.fill_diagonal(P, 0.95 if k > 1 else 1.0)
        before, it, share = -np.inf, 0, None
        for it in range(1, max_iter + 1):
            f, pred, ll = hamilton_filter(log_density(x, means, covs), P)
            share = kim_smoother(f, pred, P)
            if abs(ll - before) < tol:
                break
            before = ll
            weight = np.maximum(share.sum(axis=0), 1e-8)
            means = (share.T @ x) / weight[:, None]
            for j in range(k):
                v = x - means[j]
                covs[j] = (share[:, j, None] * v).T @ v / weight[j] + 1e-4 * np.eye(D)
            pairs = P * (f[:-1].T @ (share[1:] / np.maximum(pred[1:], FLOOR)))
            P = pairs / np.maximum(pairs.sum(axis=1, keepdims=True), FLOOR)
        order = means.mean(axis=1).argsort(kind="stable")
        _, _, ll = hamilton_filter(log_density(x, means, covs), P)
        found = RegimeModel(means[order], covs[order], P[np.ix_(order, order)], ll, it, bool((share.mean(axis=0) < 0.05).any()))
        if best is None or found.loglik > best.loglik:
            best = found
    return best


def transition_features(P, last, T: int) -> tuple[float, float, float]:
    """Persistence of the first regime, its expected duration (at most T), and P(first regime | last state)."""
    stay = float(P[0, 0])
    return stay, min(1 / max(1 - stay, 1e-12), float(T)), float(P[int(last), 0])
