"""One-call API and fluent workflows; models are kept as their parameters, fitted state and pyspark.ml parts."""

from __future__ import annotations

import json
import os
import pickle
from dataclasses import dataclass, field
from typing import Any

from pyspark.ml.util import MLWritable
from pyspark.sql import DataFrame

from ..base import InstanceTransformer, registry, resolve
from . import validation as V
from .splitting import holdout


@dataclass
class WorkflowResult:
    model: Any = None
    metrics: dict = field(default_factory=dict)
    cv_results: dict = field(default_factory=dict)
    pipeline: list = field(default_factory=list)

    def predict(self, df: DataFrame) -> DataFrame:
        """The steps again, without those that change rows, then the model."""
        for step in self.pipeline:
            if not isinstance(step, InstanceTransformer):
                df = step.transform(df)
        return self.model.predict(df)


class Workflow:
    """load / impute / normalize / encode / select / sample / split / train / evaluate, run in the order added."""

    def __init__(self, data: DataFrame | None = None, target: str | None = None, id_col: str = "row_id"):
        self.data, self.target, self.id_col, self.steps = data, target, id_col, []
        self.algorithm, self.test_size, self.metrics, self.cv = None, 0.25, "auto", None

    def load(self, data, target=None):
        self.data, self.target = data, target or self.target
        return self

    def add(self, step, **kw):
        self.steps.append(resolve(step, **kw) if isinstance(step, (str, type)) else step)
        return self

    def impute(self, strategy="mean", **kw):
        return self.add("SimpleImputer", strategy=strategy, **kw)

    def normalize(self, **kw):
        return self.add("MinMaxScaler", **kw)

    def standardize(self, **kw):
        return self.add("StandardScaler", **kw)

    def encode(self, **kw):
        return self.add("OneHotEncoder", **kw)

    def select(self, selector="SelectKBestSelector", **kw):
        return self.add(selector, **kw)

    def sample(self, sampler="RandomOverSampler", **kw):
        return self.add(sampler, **kw)

    def split(self, test_size=0.25):
        self.test_size = test_size
        return self

    def train(self, algorithm, **kw):
        self.algorithm = resolve(algorithm, **kw) if isinstance(algorithm, (str, type)) else algorithm
        return self

    def evaluate(self, metrics="auto"):
        self.metrics = metrics
        return self

    def cross_validate(self, cv=5):
        self.cv = cv
        return self

    def run(self) -> WorkflowResult:
        rows = holdout(self.data, float(self.test_size), None, self.id_col)
        train, test = rows.where("not is_test").drop("is_test"), rows.where("is_test").drop("is_test")
        for step in self.steps:
            if getattr(step, "columns", 0) is None and type(step).__name__ not in ("OneHotEncoder", "OrdinalEncoder", "LabelEncoder", "RareCategoryEncoder"):
                from ..base import numeric_columns

                step.set_params(columns=numeric_columns(train, None, (self.target, self.id_col)))
            train = step.fit_transform(train, self.target)
            if not isinstance(step, InstanceTransformer):
                test = step.transform(test)
        from ..base import numeric_columns

        features = numeric_columns(train, None, (self.target, self.id_col))
        model = self.algorithm.fit(train, self.target, features)
        out = WorkflowResult(model, V.evaluate(model, test, self.target, self.metrics), {}, self.steps)
        if self.cv:
            metric = "accuracy" if "accuracy" in out.metrics else next(iter(out.metrics))
            s = V.cross_val_score(self.algorithm, train, self.target, features=features, cv=self.cv, scoring=metric, id_col=self.id_col)
            out.cv_results = {"scores": s, "mean": sum(s) / len(s)}
        return out


def train(algorithm, data: DataFrame, target: str, *, preprocessing=(), feature_selection=None, test_size=0.25, cv=None, metrics="auto", id_col="row_id", **params) -> WorkflowResult:
    w = Workflow(data, target, id_col).split(test_size).evaluate(metrics)
    for step in [preprocessing] if isinstance(preprocessing, str) else preprocessing:
        w.add(*([step] if not isinstance(step, dict) else [step["name"]]), **(step.get("params", {}) if isinstance(step, dict) else {}))
    if feature_selection:
        w.add(feature_selection)
    if cv:
        w.cross_validate(cv)
    return w.train(algorithm, **params).run()


def run(config: dict) -> WorkflowResult:
    return train(**config)


def predict(model, data: DataFrame) -> DataFrame:
    return model.predict(data)


def evaluate(model, data: DataFrame, target: str, metrics="auto") -> dict:
    return V.evaluate(model, data, target, metrics)


def experiment(algorithms, datasets, *, cv=10, metrics=None, id_col="row_id"):
    models = algorithms if isinstance(algorithms, dict) else {str(a): a for a in algorithms}
    return V.run_experiment(models, datasets, cv, metrics, id_col=id_col)


def get_api_info(name: str | None = None) -> dict:
    return registry.describe(name) if name else {k: registry.list(k) for k in sorted({x["kind"] for x in registry.items.values()})}


def save_model(model, path: str, metadata: dict | None = None) -> None:
    """A folder: pyspark.ml parts in their own format (any store), the rest pickled through Spark's file system."""
    spark_parts, state = {}, dict(model.__dict__)
    for k, v in list(state.items()):
        if isinstance(v, MLWritable):
            v.write().overwrite().save(os.path.join(path, f"part_{k}"))
            spark_parts[k] = f"{type(v).__module__}.{type(v).__name__}"
            del state[k]
        elif isinstance(v, DataFrame):
            v.write.mode("overwrite").parquet(os.path.join(path, f"table_{k}"))
            spark_parts[k] = "table"
            del state[k]
    from pyspark.sql import SparkSession

    blob = bytearray(pickle.dumps((type(model), state, spark_parts, json.dumps(metadata or {}))))
    SparkSession.active().createDataFrame([(blob,)], "blob binary").coalesce(1).write.mode("overwrite").parquet(os.path.join(path, "state"))


def load_model(path: str):
    from importlib import import_module

    from pyspark.sql import SparkSession

    spark = SparkSession.active()
    cls, state, parts, _ = pickle.loads(bytes(spark.read.parquet(os.path.join(path, "state")).first()[0]))
    out = cls.__new__(cls)
    out.__dict__.update(state)
    for k, name in parts.items():
        if name == "table":
            setattr(out, k, spark.read.parquet(os.path.join(path, f"table_{k}")))
        else:
            module, _, kind = name.rpartition(".")
            setattr(out, k, getattr(import_module(module), kind).load(os.path.join(path, f"part_{k}")))
    return out


def load_model_info(path: str) -> dict:
    from pyspark.sql import SparkSession

    cls, _, parts, meta = pickle.loads(bytes(SparkSession.active().read.parquet(os.path.join(path, "state")).first()[0]))
    return {"class": cls.__name__, "parts": parts, "metadata": json.loads(meta)}


def execute_read_data(df: DataFrame, n: int = 10, mode: str = "head", condition: str | None = None, columns: list[str] | None = None, seed: int = 0) -> list[dict]:
    """A preview of at most ``n`` rows: the first (head), a sample, or those that meet an SQL ``condition``."""
    rows = df.where(condition) if condition else df
    rows = rows.select(*columns) if columns else rows
    if mode == "sample":
        rows = rows.sample(min(1.0, 4 * n / max(1, rows.count())), seed)
    elif mode != "head":
        raise ValueError(f"no mode {mode!r}: head or sample")
    return [r.asDict(recursive=True) for r in rows.limit(n).collect()]


def execute_data_profile(df: DataFrame, target: str | None = None) -> dict:
    """Shape, types, missing values, statistics and class sizes; see :func:`profile`."""
    out = profile(df, target)
    return {"shape": (out["rows"], len(df.columns)), **out}


def profile(df: DataFrame, target: str | None = None) -> dict:
    """Rows, types, missing values and statistics in one aggregate."""
    from pyspark.sql import functions as F

    from ..base import clean, numeric_columns

    names = numeric_columns(df)
    exprs = [F.count(F.lit(1)).alias("rows"), *[F.count_if(F.col(c).isNull()).alias(f"null.{c}") for c in df.columns]]
    exprs += [e for c in names for e in (F.avg(clean(c)).alias(f"mean.{c}"), F.stddev_pop(clean(c)).alias(f"std.{c}"), F.min(clean(c)).alias(f"min.{c}"), F.max(clean(c)).alias(f"max.{c}"))]
    r = df.agg(*exprs).first().asDict()
    out = {"rows": r["rows"], "types": dict(df.dtypes), "missing": {c: r[f"null.{c}"] for c in df.columns}, "statistics": {c: {k: r[f"{k}.{c}"] for k in ("mean", "std", "min", "max")} for c in names}}
    if target:
        out["classes"] = {x[0]: x["count"] for x in df.groupBy(target).count().collect()}
    return out
