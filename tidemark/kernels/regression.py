"""Probit, ridge, least squares, isotonic and Platt calibration, small boosted trees, in numpy."""

from __future__ import annotations

from dataclasses import dataclass
from math import erf, sqrt

import numpy as np

_erf = np.vectorize(erf, otypes=[float])


def normal_cdf(z) -> np.ndarray:
    return 0.5 * (1 + _erf(np.asarray(z, float) / sqrt(2)))


def _pdf(z) -> np.ndarray:
    return np.exp(-0.5 * z * z) / sqrt(2 * np.pi)


def balanced_weights(y) -> np.ndarray:
    """N / (2 n_class) for each row; 1 where only one class is there."""
    n1 = y.sum()
    if n1 in (0, len(y)):
        return np.ones(len(y))
    return np.where(y == 1, len(y) / (2 * n1), len(y) / (2 * (len(y) - n1)))


@dataclass
class Probit:
    names: list[str]
    beta: np.ndarray
    train_means: np.ndarray
    status: str

    def predict(self, X, most_missing: float = 0.5, margin: float = 1e-3) -> np.ndarray:
        """P(y = 1); missing features take their training mean, rows with too many missing are 0.5."""
        X = np.asarray(X, float)
        gone = np.isnan(X)
        filled = np.where(gone, self.train_means, X)
        p = np.clip(normal_cdf(filled @ self.beta[:-1] + self.beta[-1]), margin, 1 - margin)
        return np.where(gone.mean(axis=1) > most_missing, 0.5, p)

    def coefficients(self) -> dict[str, float]:
        return dict(zip([*self.names, "intercept"], map(float, self.beta), strict=True))


def probit_fit(X, y, lam: float = 1.0, balanced: bool = True, names=None, least_rows: int = 20) -> Probit:
    """Newton steps on the penalised likelihood; the penalty covers the intercept and is not averaged."""
    X, y = np.asarray(X, float), np.asarray(y, float)
    names = list(names or [f"x{i}" for i in range(X.shape[1])])
    means = np.nan_to_num(np.nanmean(X, axis=0)) if len(X) else np.zeros(X.shape[1])
    Z = np.column_stack([np.where(np.isnan(X), means, X), np.ones(len(X))])
    beta = np.zeros(Z.shape[1])
    if len(X) < least_rows:
        return Probit(names, beta, means, "too_few_rows")
    w, s = (balanced_weights(y) if balanced else np.ones(len(y))), 2 * y - 1

    def loss(b) -> float:
        return float(-(w * np.log(np.clip(normal_cdf(s * (Z @ b)), 1e-10, 1))).sum() + 0.5 * lam * b @ b)

    now = loss(beta)
    for _ in range(60):
        z = s * (Z @ beta)
        ratio = _pdf(z) / np.clip(normal_cdf(z), 1e-10, 1)
        grad = -Z.T @ (w * s * ratio) + lam * beta
        hess = (Z * (w * ratio * (ratio + z))[:, None]).T @ Z + (lam + 1e-10) * np.eye(len(beta))
        step = np.linalg.solve(hess, grad)
        size = 1.0
        while size > 1e-8 and (new := loss(beta - size * step)) > now:
            size /= 2
        if size <= 1e-8:
            break
        beta, before, now = beta - size * step, now, new
        if before - now < 1e-12 * (1 + abs(now)):
            break
    return Probit(names, beta, means, "ok")


def probit_cv(X, y, grid=(0.1, 1.0, 5.0, 20.0, 100.0), blocks: int = 4) -> list[tuple[float, float]]:
    """(lambda, mean log-loss) by forward chaining over contiguous blocks."""
    edges = [i * len(y) // (blocks + 1) for i in range(blocks + 2)]
    out = []
    for lam in grid:
        losses = []
        for b in range(1, blocks + 1):
            train, test = slice(0, edges[b]), slice(edges[b], edges[b + 1])
            model = probit_fit(X[train], y[train], lam)
            if model.status == "ok" and len(y[test]):
                p = model.predict(X[test])
                losses.append(-np.mean(y[test] * np.log(p) + (1 - y[test]) * np.log(1 - p)))
        out.append((lam, float(np.mean(losses)) if losses else float("nan")))
    return out


def ols(X, y) -> tuple[np.ndarray, float, np.ndarray]:
    """Coefficients with intercept last, residual standard error, and (Z'Z)^-1 for leverages."""
    Z = np.column_stack([X, np.ones(len(X))])
    inv = np.linalg.pinv(Z.T @ Z)
    beta = inv @ Z.T @ y
    rest = y - Z @ beta
    return beta, float(np.sqrt(rest @ rest / max(len(y) - Z.shape[1], 1))), inv


def gdp_nowcast(X, y, x_now, fallback=(2.5, 1.5), least_rows: int = 20) -> dict[str, float]:
    """Point and 90 % interval; the predictive error grows with leverage, and is 0.5 at least."""
    if len(y) < least_rows:
        point, se = fallback
    else:
        beta, s, inv = ols(X, y)
        z = np.append(x_now, 1.0)
        point, se = float(z @ beta), s * float(np.sqrt(1 + z @ inv @ z))
    half = 1.645 * max(se, 0.5)
    return {"point": point, "lo": point - half, "hi": point + half}


def ridge(X, y, alpha: float):
    """Standardised ridge; returns a predictor."""
    mu, sd = X.mean(axis=0), X.std(axis=0)
    sd = np.where(sd > 0, sd, 1.0)
    Z, mean = (X - mu) / sd, y.mean()
    beta = np.linalg.solve(Z.T @ Z + alpha * np.eye(Z.shape[1]), Z.T @ (y - mean))
    return lambda new: (new - mu) / sd @ beta + mean


def ridge_purged(X, y, folds, alphas=np.logspace(-2, 4, 13)):
    """The ridge whose alpha has the least error over purged inner ``folds`` (train, test index arrays)."""
    errors = [
        np.mean([np.mean((ridge(X[a], y[a], al)(X[b]) - y[b]) ** 2) for a, b in folds]) if folds else 0.0
        for al in alphas
    ]
    return ridge(X, y, float(alphas[int(np.argmin(errors))]))


def isotonic(p, y):
    """Pool-adjacent-violators; returns a monotone step interpolation."""
    order = np.argsort(p, kind="stable")
    level: list[list[float]] = []
    for x, v in zip(p[order], y[order], strict=True):
        level.append([float(v), 1.0, float(x), float(x)])
        while len(level) > 1 and level[-2][0] >= level[-1][0]:
            b, a = level.pop(), level.pop()
            n = a[1] + b[1]
            level.append([(a[0] * a[1] + b[0] * b[1]) / n, n, a[2], b[3]])
    xs = [x for v, _, lo, hi in level for x in (lo, hi)]
    vs = [v for v, *_ in level for _ in (0, 1)]
    return lambda new: np.interp(new, xs, vs)


def platt(p, y, iters: int = 50):
    """Logistic regression of y on logit(p)."""
    def logit(q):
        q = np.clip(q, 1e-6, 1 - 1e-6)
        return np.log(q / (1 - q))

    Z = np.column_stack([logit(p), np.ones(len(p))])
    b = np.array([1.0, 0.0])
    for _ in range(iters):
        m = 1 / (1 + np.exp(-Z @ b))
        h = (Z * (m * (1 - m))[:, None]).T @ Z + 1e-6 * np.eye(2)
        b = b + np.linalg.solve(h, Z.T @ (y - m) - 1e-6 * b)
    return lambda new: 1 / (1 + np.exp(-np.column_stack([logit(np.asarray(new)), np.ones(len(new))]) @ b))


def calibrate(p, y, how: str = "isotonic", least_rows: int = 30):
    """A calibrator on enough rows, else the identity."""
    p, y = np.asarray(p, float), np.asarray(y, float)
    if len(p) < least_rows:
        return lambda new: np.asarray(new, float)
    return (isotonic if how == "isotonic" else platt)(p, y)


def boost(X, y, trees: int = 100, rate: float = 0.1):
    """Gradient boosting of depth-two trees on squared error; deterministic."""
    def stump(rows, r):
        best = (np.inf, 0, 0.0)
        for j in range(X.shape[1]):
            order = rows[np.argsort(X[rows, j], kind="stable")]
            v, s = X[order, j], np.cumsum(r[order])
            n = np.arange(1, len(order) + 1)
            cut = np.flatnonzero(v[1:] > v[:-1])
            if len(cut):
                left, total = s[cut], s[-1]
                gain = left**2 / n[cut] + (total - left) ** 2 / (len(order) - n[cut])
                i = int(gain.argmax())
                if -gain[i] < best[0]:
                    best = (-gain[i], j, (v[cut[i]] + v[cut[i] + 1]) / 2)
        return None if best[0] == np.inf else best[1:]

    def grow(rows, r, depth):
        split = stump(rows, r) if depth and len(rows) > 1 else None
        if split is None:
            return float(r[rows].mean())
        j, at = split
        left = X[rows, j] <= at
        return (j, at, grow(rows[left], r, depth - 1), grow(rows[~left], r, depth - 1))

    def walk(tree, new, rows, out):
        if isinstance(tree, float):
            out[rows] = tree
            return
        left = new[rows, tree[0]] <= tree[1]
        walk(tree[2], new, rows[left], out)
        walk(tree[3], new, rows[~left], out)

    def run(tree, new):
        out = np.zeros(len(new))
        walk(tree, new, np.arange(len(new)), out)
        return out

    base, fitted, grown = float(y.mean()), np.full(len(y), y.mean()), []
    for _ in range(trees):
        tree = grow(np.arange(len(y)), y - fitted, 2)
        grown.append(tree)
        fitted = fitted + rate * run(tree, X)
    return lambda new: base + rate * sum(run(t, new) for t in grown)
