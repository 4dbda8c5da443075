"""Cross-validation, tuning, experiments and their reports."""

from __future__ import annotations

import itertools
import math
import time
from abc import ABC, abstractmethod
from dataclasses import dataclass, field
from enum import Enum
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from ..base import Params, Regressor, resolve
from ..functions import metrics as M
from ..functions import stats as S
from .splitting import HashKFold

SCORERS = {
    "accuracy": M.accuracy_score, "balanced_accuracy": M.balanced_accuracy_score, "kappa": M.cohen_kappa_score, "mcc": M.matthews_corrcoef,
    "f1": lambda d, t, p: M.f1_score(d, t, p, average="macro"), "precision": lambda d, t, p: M.precision_score(d, t, p, average="macro"), "recall": lambda d, t, p: M.recall_score(d, t, p, average="macro"),
    "r2": M.r2_score, "mse": M.mean_squared_error, "rmse": M.root_mean_squared_error, "mae": M.mean_absolute_error, "neg_mse": lambda d, t, p: -M.mean_squared_error(d, t, p), "neg_rmse": lambda d, t, p: -M.root_mean_squared_error(d, t, p), "neg_mae": lambda d, t, p: -M.mean_absolute_error(d, t, p),
}


def evaluate(model, df: DataFrame, y: str, metrics="auto") -> dict[str, float]:
    names = (["r2", "rmse", "mae"] if isinstance(model, Regressor) else ["accuracy", "f1", "kappa"]) if metrics == "auto" else [metrics] if isinstance(metrics, str) else metrics
    out = model.predict(df)
    return {m: float(SCORERS[m](out, y, "prediction")) for m in names}


def cross_val_score(estimator, df, y, *, features=None, cv=5, scoring="accuracy", random_state=None, id_col="row_id") -> list[float]:
    split = HashKFold(cv, True, random_state, id_col) if isinstance(cv, int) else cv
    out = []
    for train, test in split.split(df, y):
        model = resolve(estimator).clone().fit(train, y, features) if isinstance(resolve(estimator), Params) else resolve(estimator).fit(train, y, features)
        out.append(float(SCORERS[scoring](model.predict(test), y, "prediction")))
    return out


# ---------------------------------------------------------------- tuning


class ParameterGrid:
    def __init__(self, param_grid: dict[str, list]):
        self.grid = param_grid

    def __iter__(self):
        names = list(self.grid)
        return (dict(zip(names, v, strict=True)) for v in itertools.product(*self.grid.values()))

    def __len__(self):
        return math.prod(len(v) for v in self.grid.values())


class ParameterDistribution:
    """Lists, callables of a generator, or ranges (low, high[, 'log' or 'int'])."""

    def __init__(self, param_distributions: dict[str, Any]):
        self.space = param_distributions

    def draw(self, rng: np.random.Generator) -> dict:
        out = {}
        for k, v in self.space.items():
            if callable(v):
                out[k] = v(rng)
            elif isinstance(v, tuple) and len(v) >= 2 and all(isinstance(x, (int, float)) for x in v[:2]):
                kind = v[2] if len(v) > 2 else "int" if all(isinstance(x, int) for x in v) else ""
                x = math.exp(rng.uniform(math.log(v[0]), math.log(v[1]))) if kind == "log" else rng.uniform(v[0], v[1] + (kind == "int"))
                out[k] = min(int(x), v[1]) if kind == "int" else float(x)
            else:
                out[k] = v[int(rng.integers(len(v)))]
        return out


@dataclass
class TuningResult:
    best_params: dict
    best_score: float
    results: pd.DataFrame


class BaseTuner(Params):
    defaults = {"estimator": None, "scoring": "accuracy", "cv": 3, "refit": True, "random_state": None, "id_col": "row_id"}

    def _candidates(self, score):
        raise NotImplementedError

    def fit(self, df, y, features=None):
        rows = []

        def score(p: dict) -> float:
            model = resolve(self.estimator).clone().set_params(**p)
            s = cross_val_score(model, df, y, features=features, cv=self.cv, scoring=self.scoring, random_state=self.random_state, id_col=self.id_col)
            rows.append({"params": p, "mean": float(np.mean(s)), "std": float(np.std(s))})
            return rows[-1]["mean"]

        self._candidates(score)
        best = max(rows, key=lambda r: r["mean"])
        table = pd.DataFrame(rows)
        table["rank"] = table["mean"].rank(ascending=False, method="min").astype(int)
        self.result = TuningResult(best["params"], best["mean"], table)
        self.best_params, self.best_score = best["params"], best["mean"]
        if self.refit:
            self.best_estimator = resolve(self.estimator).clone().set_params(**best["params"]).fit(df, y, features)
        return self

    def predict(self, df):
        return self.best_estimator.predict(df)


class GridSearchCV(BaseTuner):
    defaults = {"estimator": None, "param_grid": None} | BaseTuner.defaults

    def _candidates(self, score):
        for p in ParameterGrid(self.param_grid):
            score(p)


class RandomSearchCV(BaseTuner):
    defaults = {"estimator": None, "param_distributions": None, "n_iter": 10} | BaseTuner.defaults

    def _candidates(self, score):
        rng, space = np.random.default_rng(self.random_state), ParameterDistribution(self.param_distributions)
        for _ in range(self.n_iter):
            score(space.draw(rng))


class GaussianProcess:
    """RBF surrogate on the unit cube."""

    def __init__(self, kernel="rbf", length_scale=0.3, noise=1e-6):
        self.length, self.noise = length_scale, noise

    def _k(self, a, b):
        return np.exp(-((a[:, None] - b[None]) ** 2).sum(axis=2) / (2 * self.length**2))

    def fit(self, x, y):
        self.x, self.mean, self.sd = np.asarray(x, float), float(np.mean(y)), float(np.std(y)) or 1.0
        self.inv = np.linalg.inv(self._k(self.x, self.x) + self.noise * np.eye(len(x)))
        self.w = self.inv @ ((np.asarray(y, float) - self.mean) / self.sd)
        return self

    def predict(self, x):
        k = self._k(np.asarray(x, float), self.x)
        return k @ self.w * self.sd + self.mean, np.sqrt(np.maximum(1 - np.einsum("ij,jk,ik->i", k, self.inv, k), 1e-12)) * self.sd


class AcquisitionFunction:
    def __init__(self, kind="ei", xi=0.01, kappa=2.576):
        self.kind, self.xi, self.kappa = kind, xi, kappa

    def __call__(self, mean, sd, best):
        z = (mean - best - self.xi) / sd
        cdf, pdf = 0.5 * np.array([math.erfc(-v / math.sqrt(2)) for v in z]), np.exp(-z * z / 2) / math.sqrt(2 * math.pi)
        return {"ei": sd * (z * cdf + pdf), "pi": cdf, "ucb": mean + self.kappa * sd}[self.kind]


class BayesianSearchCV(BaseTuner):
    defaults = {"estimator": None, "param_space": None, "n_iterations": 20, "acquisition": "ei", "n_random_starts": 5} | BaseTuner.defaults

    def _candidates(self, score):
        rng, space = np.random.default_rng(self.random_state), ParameterDistribution(self.param_space)

        def place(p):
            out = []
            for k, v in self.param_space.items():
                if isinstance(v, tuple):
                    f = math.log if len(v) > 2 and v[2] == "log" else float
                    out.append((f(p[k]) - f(v[0])) / ((f(v[1]) - f(v[0])) or 1))
                else:
                    out.append(list(v).index(p[k]) / max(len(v) - 1, 1))
            return out

        xs, ys, acq = [], [], AcquisitionFunction(self.acquisition)
        for i in range(self.n_iterations):
            p = space.draw(rng)
            if i >= self.n_random_starts:
                options = [space.draw(rng) for _ in range(256)]
                mean, sd = GaussianProcess().fit(xs, ys).predict([place(o) for o in options])
                p = options[int(np.argmax(acq(mean, sd, max(ys))))]
            xs.append(place(p))
            ys.append(score(p))


# ---------------------------------------------------------------- experiments


class ExperimentType(Enum):
    CLASSIFICATION = "classification"
    REGRESSION = "regression"


class ValidationMethod(Enum):
    CROSS_VALIDATION = "cv"
    HOLDOUT = "holdout"
    BOOTSTRAP = "bootstrap"


@dataclass
class ExperimentConfig:
    n_folds: int = 10
    random_state: int | None = 42
    id_col: str = "row_id"
    method: ValidationMethod = ValidationMethod.CROSS_VALIDATION


@dataclass
class FoldResult:
    """Scores of one fitted model on one fold."""

    fold: int
    scores: dict[str, float]
    seconds: float = 0.0


@dataclass
class ModelResult:
    """A model's folds on one dataset."""

    model: str
    folds: list[FoldResult] = field(default_factory=list)

    def values(self, metric: str) -> np.ndarray:
        return np.array([f.scores.get(metric, math.nan) for f in self.folds])

    def mean(self, metric: str) -> float:
        return float(np.nanmean(self.values(metric)))

    def std(self, metric: str) -> float:
        return float(np.nanstd(self.values(metric)))


@dataclass
class DatasetResult:
    dataset: str
    models: dict[str, ModelResult] = field(default_factory=dict)

    def best(self, metric: str, higher_better: bool = True) -> str:
        pick = max if higher_better else min
        return pick(self.models, key=lambda m: self.models[m].mean(metric))


@dataclass
class ExperimentResults:
    """One long table: dataset, model, fold, metric, value."""

    table: pd.DataFrame = field(default_factory=pd.DataFrame)

    def summary(self) -> pd.DataFrame:
        return self.table.groupby(["dataset", "model", "metric"])["value"].agg(["mean", "std"]).reset_index()

    def datasets(self) -> dict[str, DatasetResult]:
        """The same results as records: dataset, model, fold."""
        out: dict[str, DatasetResult] = {}
        for (dname, mname), rows in self.table.groupby(["dataset", "model"], sort=False):
            model = out.setdefault(dname, DatasetResult(dname)).models.setdefault(mname, ModelResult(mname))
            for f, fold in rows.groupby("fold"):
                scores = dict(zip(fold["metric"], fold["value"], strict=True))
                model.folds.append(FoldResult(int(f), scores, scores.pop("seconds", 0.0)))
        return out

    def matrix(self, metric: str, **kw) -> ResultMatrix:
        return ResultMatrix(self.table[self.table["metric"] == metric], metric, **kw)


class BaseValidator(ABC):
    """Anything with ``split(df, y)``, which yields (train, test) pairs."""

    @abstractmethod
    def split(self, df: DataFrame, y: str | None = None): ...


class BaseExperiment(ABC):
    def __init__(self, config: ExperimentConfig | None = None):
        self.config = config or ExperimentConfig()

    @abstractmethod
    def run(self, models: dict, datasets: dict, features=None) -> ExperimentResults: ...


class Experiment(BaseExperiment):
    """models x datasets x folds; a fold that fails gives NaN."""

    def __init__(self, config: ExperimentConfig | None = None, metrics=None, experiment_type=ExperimentType.CLASSIFICATION):
        super().__init__(config)
        self.metrics = metrics or (["accuracy", "f1"] if experiment_type is ExperimentType.CLASSIFICATION else ["r2", "rmse"])

    def run(self, models: dict, datasets: dict[str, tuple[DataFrame, str]], features=None) -> ExperimentResults:
        rows = []
        for dname, (df, y) in datasets.items():
            for mname, model in models.items():
                folds = HashKFold(self.config.n_folds, True, self.config.random_state, self.config.id_col)
                for f, (train, test) in enumerate(folds.split(df, y)):
                    began = time.time()
                    try:
                        fitted = resolve(model).clone().fit(train, y, features)
                        got = evaluate(fitted, test, y, self.metrics)
                    except (ValueError, ArithmeticError):
                        got = dict.fromkeys(self.metrics, float("nan"))
                    rows += [{"dataset": dname, "model": mname, "fold": f, "metric": m, "value": v} for m, v in (got | {"seconds": time.time() - began}).items()]
        return ExperimentResults(pd.DataFrame(rows))


def run_experiment(models, datasets, n_folds=10, metrics=None, random_state=42, id_col="row_id") -> ExperimentResults:
    return Experiment(ExperimentConfig(n_folds, random_state, id_col), metrics).run(models, datasets)


@dataclass
class ComparisonCell:
    mean: float
    std: float
    verdict: S.SignificanceLevel


class ResultMatrix:
    """Datasets by models, with paired tests against the first model."""

    def __init__(self, table: pd.DataFrame, metric_name: str = "metric", higher_better: bool = True, significance_level: float = 0.05):
        self.metric, self.cells = metric_name, {}
        self.datasets, self.models = list(dict.fromkeys(table["dataset"])), list(dict.fromkeys(table["model"]))
        for d in self.datasets:
            base = table[(table["dataset"] == d) & (table["model"] == self.models[0])].sort_values("fold")["value"].to_numpy()
            for m in self.models:
                v = table[(table["dataset"] == d) & (table["model"] == m)].sort_values("fold")["value"].to_numpy()
                verdict = S.SignificanceLevel.TIE if m == self.models[0] or len(v) < 2 else S.paired_t_test(v, base, significance_level, higher_better).significance
                self.cells[d, m] = ComparisonCell(float(np.nanmean(v)), float(np.nanstd(v)), verdict)

    def means(self) -> pd.DataFrame:
        return pd.DataFrame([[self.cells[d, m].mean for m in self.models] for d in self.datasets], self.datasets, self.models)

    def ranks(self, lower_better=False) -> np.ndarray:
        return S.compute_ranks(self.means().to_numpy(), lower_better).mean(axis=0)

    def _rows(self, precision):
        mark = {S.SignificanceLevel.TIE: "", S.SignificanceLevel.WIN: " v", S.SignificanceLevel.LOSS: " *"}
        return [[d, *[f"{c.mean:.{precision}f} ({c.std:.{precision}f}){mark[c.verdict]}" for c in (self.cells[d, m] for m in self.models)]] for d in self.datasets]


def format_results(results: ResultMatrix, metric_name: str = "metric", format_type: str = "plain", precision: int = 4) -> str:
    head, rows = ["dataset", *results.models], results._rows(precision)
    if format_type == "markdown":
        return "\n".join(["| " + " | ".join(head) + " |", "|" + "---|" * len(head), *["| " + " | ".join(r) + " |" for r in rows]])
    if format_type == "latex":
        return "\\begin{tabular}{l" + "r" * len(results.models) + "}\n" + " \\\\\n".join(" & ".join(r) for r in [head, *rows]) + " \\\\\n\\end{tabular}"
    if format_type == "html":
        return "<table>" + "".join("<tr>" + "".join(f"<td>{c}</td>" for c in r) + "</tr>" for r in [head, *rows]) + "</table>"
    if format_type == "csv":
        return "\n".join(",".join(r) for r in [head, *rows])
    return "\n".join("  ".join(f"{c:>24}" for c in r) for r in [head, *rows])


def to_markdown_table(matrix, precision=4):
    return format_results(matrix, format_type="markdown", precision=precision)


def to_latex_table(matrix, precision=4):
    return format_results(matrix, format_type="latex", precision=precision)


def to_html_table(matrix, precision=4):
    return format_results(matrix, format_type="html", precision=precision)
