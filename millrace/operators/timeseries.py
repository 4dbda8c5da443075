"""Forecasters: one model for each series, fitted in parallel with ``applyInPandas`` by ``series_id``.

``fit(df, value, time, series)`` keeps the table; ``forecast(steps)`` returns ``series, step, prediction``.
A series is one group and must fit in a task.
"""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..base import Params, forecaster


def _lags(y: np.ndarray, p: int) -> np.ndarray:
    return np.stack([y[p - i - 1 : len(y) - i - 1] for i in range(p)], axis=1) if p else np.zeros((len(y), 0))


def _solve(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.linalg.lstsq(x, y, rcond=None)[0] if x.size else np.zeros(x.shape[1])


def arma(y: np.ndarray, p: int, q: int, steps: int) -> np.ndarray:
    """Two-stage least squares: residuals of a long autoregression, then lags of values and residuals."""
    mean, n = y.mean(), len(y)
    z = y - mean
    p, q = min(p, max(0, n // 3)), min(q, max(0, n // 4))
    e = np.zeros(n)
    if q:
        long = max(1, min(20, n // 4))
        e[long:] = z[long:] - _lags(z, long) @ _solve(_lags(z, long), z[long:])
    m = max(p, q)
    x = np.concatenate([_lags(z, p)[m - p :], _lags(e, q)[m - q :]], axis=1) if m else np.zeros((n, 0))
    b = _solve(x, z[m:]) if m else np.zeros(0)
    if m:
        e[m:] = z[m:] - x @ b
    past, errors, out = list(z), list(e), []
    for _ in range(steps):
        v = sum(b[i] * past[-1 - i] for i in range(p)) + sum(b[p + i] * errors[-1 - i] for i in range(q))
        past.append(v)
        errors.append(0.0)
        out.append(v + mean)
    return np.array(out)


class _Forecaster(Params):
    def fit(self, df: DataFrame, value: str = "value", time: str = "t", series: str | None = None):
        key = F.col(series) if series else F.lit(0)
        self.rows = df.select(key.alias("series"), F.col(time).alias("t"), F.col(value).cast("double").alias("y")).where("y is not null")
        return self

    def _predict(self, y: np.ndarray, steps: int) -> np.ndarray:
        raise NotImplementedError

    def forecast(self, steps: int = 1) -> DataFrame:
        kind, model = self.rows.schema["series"].dataType.simpleString(), self.clone()

        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            y = pdf.sort_values("t")["y"].to_numpy(float)
            return pd.DataFrame({"series": pdf["series"].iloc[0], "step": np.arange(1, steps + 1), "prediction": model._predict(y, steps)})

        return self.rows.groupBy("series").applyInPandas(run, f"series {kind}, step int, prediction double")

    predict = forecast


@forecaster
class AR(_Forecaster):
    """``method``: yule_walker solves the equations of the autocovariances, ols regresses on the lags."""

    defaults = {"order": 1, "method": "yule_walker", "trend": "c"}

    def _predict(self, y, steps):
        if self.method != "yule_walker":
            return arma(y, self.order, 0, steps)
        mean = y.mean() if self.trend == "c" else 0.0
        z, p = y - mean, min(self.order, len(y) - 1)
        c = np.array([(z[k:] * z[: len(z) - k]).sum() for k in range(p + 1)])
        b = np.linalg.lstsq(c[np.abs(np.subtract.outer(np.arange(p), np.arange(p)))], c[1:], rcond=None)[0] if p and c[0] else np.zeros(p)
        past = list(z)
        for _ in range(steps):
            past.append(float(b @ np.array(past[: -p - 1 : -1])) if p else 0.0)
        return np.array(past[len(z) :]) + mean


@forecaster
class MA(_Forecaster):
    defaults = {"order": 1, "method": "hannan_rissanen", "max_iter": 100}

    def _predict(self, y, steps):
        return arma(y, 0, self.order, steps)


@forecaster
class ARMA(_Forecaster):
    defaults = {"order": (1, 0), "trend": "c", "method": "css-mle", "maxiter": 50}

    def _predict(self, y, steps):
        return arma(y, *self.order, steps)


@forecaster
class ARIMA(_Forecaster):
    """Differences, a mixed model of them, and sums back."""

    defaults = {"order": (1, 0, 0), "seasonal_order": None, "trend": None, "method": "css-mle", "maxiter": 50}

    def _predict(self, y, steps):
        if self.seasonal_order:
            raise ValueError("seasonal_order is not supported; take seasonal differences first")
        p, d, q = self.order
        tails = []
        for _ in range(d):
            tails.append(y[-1])
            y = np.diff(y)
        out = arma(y, p, q, steps) if len(y) else np.zeros(steps)
        for last in reversed(tails):
            out = last + np.cumsum(out)
        return out


@forecaster
class ExponentialSmoothing(_Forecaster):
    """Level, optional (damped) trend and additive or multiplicative season.

    Smoothing parameters that are not given are those of a grid with the least squared error one step ahead.
    """

    defaults = {"trend": None, "seasonal": None, "seasonal_periods": None, "smoothing_level": None, "smoothing_trend": None, "smoothing_seasonal": None, "damped_trend": False, "damping": 0.98}

    def _predict(self, y, steps):
        grid = lambda given, used: [given] if given is not None else [0.05, 0.2, 0.4, 0.6, 0.8, 0.95] if used else [0.0]
        tried = itertools.product(grid(self.smoothing_level, True), grid(self.smoothing_trend, self.trend), grid(self.smoothing_seasonal, self.seasonal))
        return min((self._smooth(y, steps, *p) for p in tried), key=lambda x: x[0])[1]

    def _smooth(self, y, steps, a, b, g):
        """Sum of squared errors one step ahead, and the forecast."""
        error = 0.0
        m, phi = self.seasonal_periods or 1, self.damping if self.damped_trend else 1.0
        mul = self.seasonal == "mul"
        base = y[:m].mean()
        season = list((y[:m] / base if mul else y[:m] - base) if self.seasonal and len(y) >= m else np.full(m, 1.0 if mul else 0.0))
        level, trend = base if self.seasonal else y[0], (y[min(m, len(y) - 1)] - y[0]) / max(m, 1) if self.trend else 0.0
        for i, v in enumerate(y):
            s = season[i % m]
            error += (v - ((level + phi * trend) * s if mul else level + phi * trend + s)) ** 2
            before = level
            level = a * ((v / s if s else v) if mul else v - s) + (1 - a) * (level + phi * trend)
            if self.trend:
                trend = b * (level - before) + (1 - b) * phi * trend
            if self.seasonal:
                season[i % m] = g * ((v / level if level else 1.0) if mul else v - level) + (1 - g) * s
        out, damp = [], 0.0
        for h in range(1, steps + 1):
            damp += phi**h
            f, s = level + damp * trend, season[(len(y) + h - 1) % m]
            out.append(f * s if mul else f + s)
        return error, np.array(out)


def decompose(y: np.ndarray, period: int, robust_rounds: int = 2) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Trend (centered means over a period), season (medians of what remains by place in the period), rest."""
    n, half = len(y), period // 2
    trend = np.array([y[max(0, i - half) : i + half + 1].mean() for i in range(n)])
    season = np.zeros(n)
    for _ in range(robust_rounds):
        by = np.array([np.median((y - trend)[k::period]) if len(y[k::period]) else 0.0 for k in range(period)])
        season = (by - by.mean())[np.arange(n) % period]
        flat = y - season
        trend = np.array([flat[max(0, i - half) : i + half + 1].mean() for i in range(n)])
    return trend, season, y - trend - season


@forecaster
class STLDecomposition(_Forecaster):
    """``decompose()`` returns ``series, t, trend, seasonal, resid``."""

    defaults = {"period": 7, "seasonal": 7, "trend": None, "robust": False}

    def decompose(self) -> DataFrame:
        kind, time = self.rows.schema["series"].dataType.simpleString(), self.rows.schema["t"].dataType.simpleString()
        period = self.period

        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("t")
            t, s, r = decompose(pdf["y"].to_numpy(float), period)
            return pd.DataFrame({"series": pdf["series"].iloc[0], "t": pdf["t"].to_numpy(), "trend": t, "seasonal": s, "resid": r})

        return self.rows.groupBy("series").applyInPandas(run, f"series {kind}, t {time}, trend double, seasonal double, resid double")

    def _predict(self, y, steps):
        t, s, _ = decompose(y, self.period)
        k = max(2, min(len(t), self.period))
        slope = np.polyfit(np.arange(k), t[-k:], 1)[0] if len(t) > 1 else 0.0
        h = np.arange(1, steps + 1)
        return t[-1] + slope * h + np.array([s[(len(y) + i - 1) % self.period] if (len(y) + i - 1) % self.period < len(s) else 0.0 for i in h])


@forecaster
class Prophet(STLDecomposition):
    """A linear trend and the mean season of a year's days."""

    defaults = {"growth": "linear", "changepoints": None, "n_changepoints": 25, "changepoint_range": 0.8, "period": 365}

    def _predict(self, y, steps):
        x = np.arange(len(y))
        slope, base = np.polyfit(x, y, 1) if len(y) > 1 else (0.0, y[0])
        rest, h = y - base - slope * x, np.arange(len(y), len(y) + steps)
        season = np.array([rest[i % self.period :: self.period].mean() if len(rest[i % self.period :: self.period]) else 0.0 for i in h])
        return base + slope * h + season
