"""Small regression models over samples: driver solves on aggregated moments, or one fit per group."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: (name, parameters): the candidates, in order; the first of equals wins.
CANDIDATES = (
    ("persistence", {}), ("moving-average", {"window": 5}), ("moving-average", {"window": 20}),
    ("ridge", {"alpha": 0.01}), ("ridge", {"alpha": 0.1}), ("ridge", {"alpha": 1.0}),
    ("stumps", {"rounds": 32, "rate": 0.05}), ("stumps", {"rounds": 64, "rate": 0.05}),
)
CLAMP = 0.5


def ridge(x: np.ndarray, y: np.ndarray, alpha: float) -> dict:
    """Standardised ridge regression: (X'X / n + alpha I) w = X'y / n."""
    if not alpha > 0:
        raise ValueError("alpha must be positive")
    mean, scale = x.mean(axis=0), x.std(axis=0)
    return ridge_from_moments(mean, scale, float(y.mean()), (x - mean).T @ (x - mean) / len(x), (x - mean).T @ (y - y.mean()) / len(x), alpha)


def ridge_from_moments(mean, scale, intercept: float, cov, cross, alpha: float) -> dict:
    """The same from means, covariances and cross moments, as one Spark aggregation gives them."""
    scale = np.where(scale < 1e-12, 1.0, scale)
    a = cov / np.outer(scale, scale) + alpha * np.eye(len(mean))
    if abs(np.linalg.det(a)) < 1e-14 ** len(mean):
        raise ValueError("singular system")
    return {"kind": "ridge", "mean": mean.tolist(), "scale": scale.tolist(), "intercept": intercept, "weights": np.linalg.solve(a, cross / scale).tolist()}


def stumps(x: np.ndarray, y: np.ndarray, rounds: int, rate: float) -> dict:
    """Boosted regression stumps; candidate cuts at every max(1, n // 32)-th row of a feature's stable order."""
    if not (1 <= rounds <= 128 and 0 < rate <= 1):
        raise ValueError("invalid boosting parameters")
    n, model = len(x), {"kind": "stumps", "intercept": float(y.mean()), "stumps": []}
    predicted = np.full(n, model["intercept"])
    stride = max(1, n // 32)
    size = np.arange(1, n + 1)
    order = np.argsort(x, axis=0, kind="stable")
    ordered = np.take_along_axis(x, order, axis=0)
    cut = (size >= 5) & (n - size >= 5) & (size % stride == 0)
    allowed = cut[:-1, None] & (ordered[:-1] != ordered[1:])
    for _ in range(rounds):
        residual = y - predicted
        total, square = residual.sum(), (residual**2).sum()
        left = np.cumsum(residual[order], axis=0)[:-1]
        k = size[:-1, None]
        loss = square - left**2 / k - (total - left) ** 2 / (n - k)
        loss = np.where(allowed, loss, np.inf)
        j = best = None
        floor = square
        for f in range(x.shape[1]):
            at = int(np.argmin(loss[:, f]))
            if loss[at, f] < floor - 1e-15:
                floor, j, best = loss[at, f], f, at
        if j is None:
            break
        threshold = (ordered[best, j] + ordered[best + 1, j]) / 2
        lo, hi = rate * left[best, j] / (best + 1), rate * (total - left[best, j]) / (n - best - 1)
        model["stumps"].append([j, float(threshold), float(lo), float(hi)])
        predicted += np.where(x[:, j] <= threshold, lo, hi)
    return model


def fit(name: str, parameters: dict, x: np.ndarray, y: np.ndarray) -> dict:
    if name == "ridge":
        return ridge(x, y, **parameters)
    if name == "stumps":
        return stumps(x, y, **parameters)
    return {"kind": name, **parameters}


def predict(model: dict, x: np.ndarray) -> np.ndarray:
    """Log returns, held to +-CLAMP.  Moving averages read the inputs close / sma - 1 (third and fourth)."""
    kind = model["kind"]
    if kind == "persistence":
        out = np.zeros(len(x))
    elif kind == "moving-average":
        out = -np.log1p(x[:, {5: 2, 20: 3}[model["window"]]])
    elif kind == "ridge":
        out = model["intercept"] + (x - model["mean"]) / model["scale"] @ np.array(model["weights"])
    else:
        out = np.full(len(x), model["intercept"])
        for j, threshold, lo, hi in model["stumps"]:
            out += np.where(x[:, j] <= threshold, lo, hi)
    return np.clip(out, -CLAMP, CLAMP)


def expression(model: dict, inputs: list[str]) -> Column:
    """The prediction as a Column."""
    x = [F.col(c) for c in inputs]
    kind = model["kind"]
    if kind == "persistence":
        out = F.lit(0.0)
    elif kind == "moving-average":
        out = -F.log1p(x[{5: 2, 20: 3}[model["window"]]])
    else:
        out = F.lit(model["intercept"])
        if kind == "ridge":
            for c, m, s, w in zip(x, model["mean"], model["scale"], model["weights"], strict=True):
                out = out + (c - m) / s * w
        else:
            for j, threshold, lo, hi in model["stumps"]:
                out = out + F.when(x[j] <= threshold, lo).otherwise(hi)
    return F.greatest(F.least(out, F.lit(CLAMP)), F.lit(-CLAMP))
