"""Well-known small tables by name.

The files are not part of this package.  They are read from a folder that holds them as ARFF files: the argument
``folder``, else :data:`FOLDER`, which :func:`set_folder` changes.  Nominal columns become the places of their values
in the declaration (``labels`` has the values), missing tokens become nulls.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from .files import Dataset, catalog, load_arff

FOLDER: str | None = None
#: Name: file, target column, task.
TABLES: dict[str, tuple[str, str, str]] = {}


def set_folder(folder: str | None) -> None:
    """Where the files are; tables found there can also be loaded through the catalog."""
    global FOLDER
    FOLDER = folder
    for name, (file, target, task) in TABLES.items():
        if folder:
            catalog.register(name, f"{folder.rstrip('/')}/{file}", task, target=target)


def _bundled(name: str, file: str, target: str, task: str = "classification"):
    TABLES[name] = (file, target, task)

    def load(spark: SparkSession, folder: str | None = None) -> Dataset:
        where = folder or FOLDER
        if not where:
            raise FileNotFoundError(f"{file} is not bundled: give its folder, or call set_folder()")
        return load_arff(spark, f"{where.rstrip('/')}/{file}", target)

    load.__name__, load.__doc__ = f"load_{name}", f"{file}, target {target}."
    return load


load_iris = _bundled("iris", "iris.arff", "class")
load_iris_2d = _bundled("iris_2d", "iris.2D.arff", "class")
load_diabetes = _bundled("diabetes", "diabetes.arff", "class")
load_breast_cancer = _bundled("breast_cancer", "breast-cancer.arff", "Class")
load_glass = _bundled("glass", "glass.arff", "Type")
load_ionosphere = _bundled("ionosphere", "ionosphere.arff", "class")
load_vote = _bundled("vote", "vote.arff", "Class")
load_credit = _bundled("credit", "credit-g.arff", "class")
load_weather = _bundled("weather", "weather.numeric.arff", "play")
load_weather_nominal = _bundled("weather_nominal", "weather.nominal.arff", "play")
load_soybean = _bundled("soybean", "soybean.arff", "class")
load_labor = _bundled("labor", "labor.arff", "class")
load_contact_lenses = _bundled("contact_lenses", "contact-lenses.arff", "contact-lenses")
load_hypothyroid = _bundled("hypothyroid", "hypothyroid.arff", "Class")
load_segment = _bundled("segment", "segment-challenge.arff", "class")
load_segment_test = _bundled("segment_test", "segment-test.arff", "class")
load_unbalanced = _bundled("unbalanced", "unbalanced.arff", "Outcome")
load_cpu = _bundled("cpu", "cpu.arff", "class", "regression")
load_cpu_with_vendor = _bundled("cpu_with_vendor", "cpu.with.vendor.arff", "class", "regression")
load_airline = _bundled("airline", "airline.arff", "passenger_numbers", "timeseries")
load_supermarket = _bundled("supermarket", "supermarket.arff", "total", "association")
load_reuters_corn = _bundled("reuters_corn", "ReutersCorn-test.arff", "class-att", "text")
load_reuters_grain = _bundled("reuters_grain", "ReutersGrain-test.arff", "class-att", "text")
