"""Model experiments over samples: tuning, frozen holdout and walk-forward folds, and replay of stored models.

One series and one candidate family is one group, so series and families run side by side; a group holds
one series' samples, at most MAX_SAMPLES of them (a longer one is refused, never cut).
Tuning sees training and tuning rows only; a fold fits on rows whose targets lie before its first origin.
"""

from __future__ import annotations

import json
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyrill.functions.scalars import SCALE
from tallyrill.plans import market, models

INPUTS = [f"x{k}" for k in range(1, 8)]
MAX_SAMPLES, LEAST_TRAINING, LEAST_CALIBRATION = 20_000, 40, 10
FAMILIES = tuple(dict.fromkeys(name for name, _ in models.CANDIDATES))
PREDICTIONS = "symbol string, family string, spec string, mode string, fold int, ts bigint, target_ts bigint, regime string, actual bigint, baseline bigint, predicted bigint, lower bigint, upper bigint, radius double"


def scores(part: pd.DataFrame, model: dict) -> np.ndarray:
    """Log returns that the model predicts."""
    return models.predict(model, part[INPUTS].to_numpy(float))


def price(close: np.ndarray, log_return: np.ndarray) -> np.ndarray:
    """Close moved by a log return, half away from zero, at least one unit."""
    return np.maximum(1, np.floor(close * np.exp(np.clip(log_return, -0.5, 0.5)) + 0.5)).astype(np.int64)


def mean_error(part: pd.DataFrame, model: dict) -> float:
    return float(np.abs(price(part["close"].to_numpy(), scores(part, model)) - part["future"].to_numpy()).mean() / SCALE)


def calibrated(name: str, parameters: dict, train: pd.DataFrame, calibration: pd.DataFrame, coverage: float) -> tuple[dict, float]:
    """A fitted model and its residual radius; refuses short parts and training labels that reach the calibration's origins."""
    if len(train) < LEAST_TRAINING or len(calibration) < LEAST_CALIBRATION:
        raise ValueError("not enough history")
    if train["target_ts"].iloc[-1] >= calibration["ts"].iloc[0]:
        raise ValueError("training labels overlap calibration origins")
    model = models.fit(name, parameters, train[INPUTS].to_numpy(float), train["y"].to_numpy(float))
    residual = np.sort(np.abs(calibration["y"].to_numpy(float) - scores(calibration, model)))
    return model, float(residual[min(len(residual), math.ceil((len(residual) + 1) * coverage)) - 1])


def tuned(train: pd.DataFrame, tune: pd.DataFrame) -> pd.DataFrame:
    """(family, spec, tuning_mae) of every candidate, in order."""
    rows = []
    for name, parameters in models.CANDIDATES:
        model = models.fit(name, parameters, train[INPUTS].to_numpy(float), train["y"].to_numpy(float))
        rows.append((name, json.dumps(parameters, sort_keys=True), mean_error(tune, model)))
    return pd.DataFrame(rows, columns=["family", "spec", "tuning_mae"])


def _predicted(block: pd.DataFrame, model: dict, radius: float) -> pd.DataFrame:
    close, y = block["close"].to_numpy(), scores(block, model)
    return pd.DataFrame({"ts": block["ts"], "target_ts": block["target_ts"], "regime": block["regime"], "actual": block["future"], "baseline": close, "predicted": price(close, y), "lower": price(close, y - radius), "upper": price(close, y + radius), "radius": radius})


def evaluated(rows: pd.DataFrame, name: str, parameters: dict, coverage: float, every: int, window: int) -> pd.DataFrame:
    """Predictions of the test part: frozen, and walking forward with a new fit for each ``every`` rows."""
    part = {p: rows[rows["part"] == p] for p in market.PARTS}
    model, radius = calibrated(name, parameters, pd.concat([part["train"], part["tune"]]), part["calibration"], coverage)
    out = [_predicted(part["test"], model, radius).assign(mode="holdout", fold=0)]
    for fold, at in enumerate(range(0, len(part["test"]), every)):
        block = part["test"].iloc[at : at + every]
        known = rows[rows["target_ts"] < block["ts"].iloc[0]]
        known = known.iloc[-window:] if window else known
        calibration = known.iloc[len(known) - len(part["calibration"]) :]
        train = known.iloc[: len(known) - len(part["calibration"])]
        train = train[train["target_ts"] < calibration["ts"].iloc[0]]
        model, radius = calibrated(name, parameters, train, calibration, coverage)
        out.append(_predicted(block, model, radius).assign(mode="walk-forward", fold=fold))
    return pd.concat(out)


def parted(sampled: DataFrame) -> DataFrame:
    """All samples with the part they keep after purging; purged rows have none."""
    kept = market.split_purged(sampled).select("symbol", "ts", "part")
    return sampled.join(kept, ["symbol", "ts"], "left")


def _group(rows: pd.DataFrame) -> pd.DataFrame:
    if len(rows) > MAX_SAMPLES:
        raise ValueError(f"{rows['symbol'].iloc[0]} has more than {MAX_SAMPLES} samples; split the range")
    return rows.sort_values("ts")


def tuning(sampled: DataFrame) -> DataFrame:
    """(symbol, family, spec, tuning_mae, chosen, selected): every candidate on the tuning part; chosen is the first best of its family, selected of all."""

    def task(rows: pd.DataFrame) -> pd.DataFrame:
        rows = _group(rows)
        found = tuned(rows[rows["part"] == "train"], rows[rows["part"] == "tune"])
        found["chosen"] = found.index.isin(found.groupby("family", sort=False)["tuning_mae"].idxmin())
        found["selected"] = found.index == found["tuning_mae"].idxmin()
        return found.assign(symbol=rows["symbol"].iloc[0])[["symbol", "family", "spec", "tuning_mae", "chosen", "selected"]]

    return parted(sampled).groupBy("symbol").applyInPandas(task, "symbol string, family string, spec string, tuning_mae double, chosen boolean, selected boolean")


def experiment(sampled: DataFrame, coverage: float = 0.9, every: int = 20, window: int = 0, chosen: DataFrame | None = None) -> DataFrame:
    """Predictions of the chosen spec of each series and family, in both modes."""
    if not (0 < coverage < 1 and every >= 1 and window >= 0):
        raise ValueError("coverage lies between 0 and 1, every is positive and the window is not negative")
    specs = (tuning(sampled) if chosen is None else chosen).filter("chosen").select("symbol", "family", "spec")

    def task(rows: pd.DataFrame) -> pd.DataFrame:
        rows = _group(rows)
        family, spec = rows["family"].iloc[0], rows["spec"].iloc[0]
        found = evaluated(rows, family, json.loads(spec), coverage, every, window)
        return found.assign(symbol=rows["symbol"].iloc[0], family=family, spec=spec)[[c.split()[0] for c in PREDICTIONS.split(", ")]]

    return parted(sampled).join(specs, "symbol").groupBy("symbol", "family", "spec").applyInPandas(task, PREDICTIONS)


def report(predictions: DataFrame) -> DataFrame:
    """Metrics by series, family and mode, with the improvement on persistence in the same mode."""
    each = market.metrics(predictions, "symbol", "family", "mode")
    base = each.filter("family = 'persistence'").select("symbol", "mode", F.col("mae").alias("base"))
    return each.join(base, ["symbol", "mode"], "left").withColumn("improvement", F.when(F.col("base") > 0, 1 - F.col("mae") / F.col("base"))).drop("base")


def validated(model: dict) -> dict:
    """A stored model, checked before it predicts anything."""
    finite = lambda values: all(isinstance(v, int | float) and math.isfinite(v) for v in values)
    n, kind = len(INPUTS), model.get("kind")
    if kind == "persistence":
        good = True
    elif kind == "moving-average":
        good = model.get("window") in (5, 20)
    elif kind == "ridge":
        vectors = [model.get(k, []) for k in ("mean", "scale", "weights")]
        good = all(len(v) == n and finite(v) for v in vectors) and min(vectors[1]) > 0 and finite([model.get("intercept", math.nan)])
    elif kind == "stumps":
        good = finite([model.get("intercept", math.nan)]) and all(0 <= s[0] < n and finite(s[1:]) and len(s) == 4 for s in model.get("stumps", [None]) if s is not None) and "stumps" in model
    else:
        good = False
    if not good:
        raise ValueError(f"invalid model artifact {kind!r}")
    return model


def replay(sampled: DataFrame, artifact: str) -> DataFrame:
    """(symbol, ts, predicted) of a stored model over samples, as an expression."""
    model = validated(json.loads(artifact))
    return sampled.select("symbol", "ts", market.predicted_price(F.col("close"), models.expression(model, INPUTS)).alias("predicted"))
