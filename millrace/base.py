"""Parameters, registry and base classes of all components.

A component declares ``defaults``; its constructor takes these by position or name.  ``fit`` runs at most a few
aggregate jobs and keeps state of the order of columns x classes; ``transform`` and ``predict`` are projections
or joins that stay lazy.
"""

from __future__ import annotations

import json
from enum import Enum
from importlib import import_module
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Params:
    defaults: dict[str, Any] = {}

    def __init__(self, *args, **kw):
        names = list(self.defaults)
        if len(args) > len(names):
            raise TypeError(f"{type(self).__name__} takes at most {len(names)} parameters")
        given = dict(zip(names, args, strict=False)) | kw
        if unknown := set(given) - set(names):
            raise TypeError(f"{type(self).__name__} has no parameter {', '.join(sorted(unknown))}")
        for k, v in (self.defaults | given).items():
            setattr(self, k, v)

    def get_params(self) -> dict[str, Any]:
        return {k: getattr(self, k) for k in self.defaults}

    def set_params(self, **kw):
        if unknown := set(kw) - set(self.defaults):
            raise TypeError(f"unknown parameters {sorted(unknown)}")
        for k, v in kw.items():
            setattr(self, k, v)
        return self

    @classmethod
    def get_parameter_schema(cls) -> dict[str, dict]:
        kinds = {bool: "boolean", int: "integer", float: "number", str: "string", list: "array", tuple: "array"}
        return {k: {"type": kinds.get(type(v), "any"), "default": v} for k, v in cls.defaults.items()}

    def clone(self):
        return type(self)(**self.get_params())

    def __repr__(self) -> str:
        return f"{type(self).__name__}({', '.join(f'{k}={v!r}' for k, v in self.get_params().items())})"


_MODULES = ("operators.preprocessing", "operators.features", "operators.neighbors", "operators.sampling", "operators.learners", "operators.online", "operators.trees", "operators.clustering", "operators.associations", "operators.timeseries", "operators.rules", "functions.text", "functions.kernels", "plans.splitting")


class Registry:
    """Component classes by kind and name, with tags.  Looking up loads all modules that register components."""

    def _load(self) -> None:
        if not getattr(self, "loaded", False):
            self.loaded = True
            for m in _MODULES:
                import_module(f".{m}", __package__)

    def __init__(self):
        self.items: dict[str, dict] = {}
        self.hooks: list = []

    def add(self, cls: type, kind: str, name: str | None = None, tags: list[str] | None = None, version: str = "1.0.0", author: str | None = None) -> type:
        self.items[name or cls.__name__] = {"cls": cls, "kind": kind, "tags": list(tags or ()), "version": version, "author": author}
        for hook in self.hooks:
            hook(name or cls.__name__, cls)
        return cls

    def get(self, name: str) -> type:
        self._load()
        if name not in self.items:
            raise KeyError(f"no component named {name!r}; see list()")
        return self.items[name]["cls"]

    def list(self, kind: str | None = None, tag: str | None = None) -> list[str]:
        self._load()
        return sorted(n for n, x in self.items.items() if kind in (None, x["kind"]) and (tag is None or tag in x["tags"]))

    def search(self, query: str) -> list[str]:
        self._load()
        q = query.lower()
        return sorted(n for n, x in self.items.items() if q in n.lower() or q in (x["cls"].__doc__ or "").lower() or any(q in t for t in x["tags"]))

    def describe(self, name: str) -> dict:
        self._load()
        x = self.items[name]
        return {"name": name, "kind": x["kind"], "tags": x["tags"], "version": x["version"], "doc": (x["cls"].__doc__ or "").strip(), "parameters": x["cls"].get_parameter_schema()}


AlgorithmRegistry = Registry
registry = Registry()


class ComponentType(Enum):
    """Kinds of registered components."""

    CLASSIFIER = "classifier"
    REGRESSOR = "regressor"
    CLUSTERER = "clusterer"
    ASSOCIATOR = "associator"
    TRANSFORMER = "transformer"
    FILTER = "filter"
    PREPROCESSOR = "preprocessor"
    FEATURE_SELECTOR = "feature_selector"
    FEATURE_EXTRACTOR = "feature_extractor"
    FEATURE_CONSTRUCTOR = "feature_constructor"
    KERNEL = "kernel"
    DETECTOR = "detector"
    FORECASTER = "forecaster"
    SAMPLER = "sampler"
    SPLITTER = "splitter"


class Registrable:
    """Subclasses that name a ``component_type`` register themselves."""

    component_type: ComponentType | None = None

    def __init_subclass__(cls, **kw):
        super().__init_subclass__(**kw)
        if cls.component_type is not None:
            registry.add(cls, cls.component_type.value, tags=getattr(cls, "tags", None))


def _decorator(kind: str):
    def outer(name: str | None = None, tags: list[str] | None = None, version: str = "1.0.0", author: str | None = None):
        if isinstance(name, type):
            return registry.add(name, kind)
        return lambda cls: registry.add(cls, kind, name, tags, version, author)

    return outer


classifier, regressor, clusterer, associator = map(_decorator, ("classifier", "regressor", "clusterer", "associator"))
transformer, filter_method, preprocessor = map(_decorator, ("transformer", "filter", "preprocessor"))
feature_selector, feature_extractor, feature_constructor, kernel = map(_decorator, ("feature_selector", "feature_extractor", "feature_constructor", "kernel"))
detector, forecaster, sampler, splitter = map(_decorator, ("detector", "forecaster", "sampler", "splitter"))


def algorithm(type: str = "classifier"):
    return _decorator(type)


def get_algorithm(name: str) -> type:
    return registry.get(name)


def list_algorithms(type: str | None = None) -> list[str]:
    return registry.list(type)


def search_algorithms(query: str) -> list[str]:
    return registry.search(query)


def describe_algorithm(name: str) -> dict:
    return registry.describe(name)


def resolve(x, **kw):
    """A component from a name, a class or an instance."""
    if isinstance(x, str):
        x = registry.get(x)
    return x(**kw) if isinstance(x, type) else x


def numeric_columns(df: DataFrame, columns=None, skip=()) -> list[str]:
    """Names of the columns meant: names or positions given, else all numeric ones but ``skip``."""
    if columns is not None:
        return [df.columns[c] if isinstance(c, int) else c for c in ([columns] if isinstance(columns, (str, int)) else columns)]
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType) and f.name not in skip]


def clean(name: str) -> F.Column:
    """A number with NaN as null."""
    c = F.col(f"`{name}`").cast("double")
    return F.when(F.isnan(c), None).otherwise(c)


def one_row(df: DataFrame, exprs: list[F.Column]) -> dict:
    """One aggregate job over all expressions."""
    return df.agg(*exprs).first().asDict() if exprs else {}


class Transformer(Params):
    def fit(self, df: DataFrame, y: str | None = None):
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        raise NotImplementedError

    def fit_transform(self, df: DataFrame, y: str | None = None) -> DataFrame:
        return self.fit(df, y).transform(df)


class SupervisedTransformer(Transformer):
    """A transformer whose fit needs the label column ``y``."""


class InstanceTransformer(Transformer):
    """A transformer that changes the rows; used on training data only."""

    def fit_resample(self, df: DataFrame, y: str) -> DataFrame:
        return self.fit(df, y).transform(df)


class Filter(Transformer):
    pass


Preprocessor = Transformer


class Algorithm(Params):
    """A learner: ``fit(df, label, features)``, then ``predict(df)`` adds ``prediction``."""

    def fit(self, df: DataFrame, label: str | None = None, features: list[str] | None = None):
        raise NotImplementedError

    def predict(self, df: DataFrame) -> DataFrame:
        raise NotImplementedError

    def _names(self, df: DataFrame, label: str | None, features: list[str] | None) -> None:
        self.label = label
        self.features = numeric_columns(df, features, skip=(label,))

    def fit_predict(self, df: DataFrame, label: str | None = None, features: list[str] | None = None) -> DataFrame:
        return self.fit(df, label, features).predict(df)


class Classifier(Algorithm):
    """Adds ``prediction`` and, where it has one, ``probability``: a map from class to chance."""

    def predict_proba(self, df: DataFrame) -> DataFrame:
        return self.predict(df)


class Regressor(Algorithm):
    pass


class Clusterer(Algorithm):
    """``prediction`` is the cluster's number, -1 for noise."""


class DensityBasedClusterer(Clusterer):
    pass


class UpdateableClusterer(Clusterer):
    def update(self, df: DataFrame):
        raise NotImplementedError


def to_json(x: Params) -> str:
    return json.dumps({"name": type(x).__name__, "parameters": x.get_params()}, default=str)
